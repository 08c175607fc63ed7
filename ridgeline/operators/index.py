"""A stored full-text index with positions, that documents can be added to, replaced in and deleted from (FTS-02, 03, 04).

postings: term, doc, part, tf, len, places (of the term among the document's words), in buckets by
term; each file is sorted by it. docs: doc, part, len, in buckets by doc. gone: doc, part of what was replaced
or deleted. Each change adds a part and is one commit of all three tables; a posting counts if its
document and part are not gone. A search reads the buckets of its terms, and no texts; a prefix
reads the range of terms that begin so, which the sorted files leave by their statistics.

A document's postings are made in its own row, so texts are dealt to tasks once and words never are. A task
sorts what it holds, which is bounded, in memory and writes a file to each bucket. A merge reads a
bucket's files together, some at a time, and writes one for them; postings move between no tasks.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators.search import B, K1, words
from ridgeline.plans.program import let
from ridgeline.session import written
from ridgeline.sources.store import Change, Store, Version

#: Words that a task makes postings of, about, and the fewest where the cluster has room for more tasks.
WORDS, LEAST = 1 << 22, 1 << 18
#: How a merge reads: bytes of a bucket's files that are read, sorted and written together, however small they are.
MERGED = {"spark.sql.files.maxPartitionBytes": "8m", "spark.sql.files.openCostInBytes": "64k", "spark.sql.files.minPartitionNum": "1"}
#: Rows of what is gone up to which they are broadcast; above, postings are shuffled by document to leave them out.
GONE = 1_000_000


def parsed(query: str) -> list[tuple[list[tuple[list[str], bool]], list[tuple[list[str], bool]]]]:
    """The alternatives of a query: what must be there and what must not, each as words and whether the last is a prefix."""
    out, negate = [([], [])], False
    for part in re.findall(r'"[^"]*"|\S+', query):
        if part == "OR":
            out.append(([], []))
        elif part == "NOT":
            negate = True
        else:
            own = re.findall(r"\w+", part.lower())
            if own:
                out[-1][negate].append((own, part.endswith("*")))
            negate = False
    if any(not must for must, _ in out):
        raise ValueError("each alternative needs something that is to be found")
    return out


def _less(places: Column, n: int) -> Column:
    return F.transform(places, lambda p: p - n)


def _postings(w: Column) -> Column:
    """term and places of each different word of a document, as an array: its words are sorted, and those that are the same lie side by side."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["term"] != x["term"]), i)), lambda i: i.isNotNull())
        own = lambda h: F.transform(h, lambda a, k: F.slice(s, a + 1, F.coalesce(F.get(h, k + 1), F.size(s)) - a))
        return F.transform(let(heads, own), lambda r: F.struct(F.get(r, F.lit(0))["term"].alias("term"), F.transform(r, lambda x: x["at"]).alias("places")))

    return let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("term"), i.alias("at")))), runs)


def _left(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings of documents and parts that are not gone."""
    return postings.join(F.broadcast(gone) if gone.count() <= GONE else gone, ["doc", "part"], "left_anti")


class Index:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.store = spark, Store(spark, root, buckets)

    def add(self, docs: DataFrame, key: str, text: str) -> Version:
        """Adds documents, each id once; those that are there already are replaced."""
        own = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        return self._changed(own.select("doc", F.size(words(F.col("text"))).cast("long").alias("len")), own)

    def delete(self, ids: DataFrame, key: str) -> Version:
        return self._changed(ids.select(F.col(key).alias("doc"), F.lit(None).cast("long").alias("len")).distinct(), None)

    def _changed(self, docs: DataFrame, texts: DataFrame | None) -> Version:
        """docs: doc, len (null: deleted)."""
        docs = written(docs)

        def change(base: Version) -> tuple[list[Change], dict]:
            part, store = base.number + 1, self.store
            buckets = store.touched(docs, "doc")
            now = docs.withColumn("part", F.lit(part)).select("doc", "part", "len")
            held = base.read("docs", now.schema, buckets)
            old = held.join(docs.select("doc"), "doc", "left_semi")
            sums = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first()
            new = docs.where("len is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("t")).first()
            kept = held.join(docs.select("doc"), "doc", "left_anti").unionByName(now.where("len is not null"))
            changes = [Change("docs", kept, ("doc",), add=False, only=buckets), Change("gone", old.select("doc", "part"), ("doc",))]
            if texts is not None:
                shares = max(1, -(-new.t // WORDS), min(self.spark.sparkContext.defaultParallelism, -(-new.t // LEAST)))
                each = texts.repartition(shares, "doc").select("doc", words(F.col("text")).alias("w"))
                each = each.select("doc", F.size("w").cast("double").alias("len"), F.explode(_postings(F.col("w"))).alias("p"))
                found = each.select("p.term", "doc", F.lit(part).alias("part"), F.size("p.places").cast("double").alias("tf"), "len", "p.places")
                changes.append(Change("postings", found, ("term",), sort=("term", "doc"), placed=True))
            return changes, {"n": base.notes.get("n", 0) - sums.n + new.n, "total": base.notes.get("total", 0) - sums.t + new.t}

        return self.store.commit(change)

    def merge(self) -> Version:
        """Writes what counts as one part and forgets what is gone; scores stay."""

        def change(base: Version) -> tuple[list[Change], dict]:
            own = self.spark.newSession()  # MERGED is of this read alone
            for name, value in MERGED.items():
                own.conf.set(name, value)
            gone = base.read("gone", spark=own)
            each = [base.read("postings", buckets=[b], spark=own) for b in base.tables.get("postings", {"buckets": ()})["buckets"]]
            left = _left(reduce(DataFrame.union, each) if each else base.read("postings", spark=own), gone)
            return [Change("postings", left.select("term", "doc", "part", "tf", "len", "places"), ("term",), add=False, sort=("term", "doc"), placed=True), Change("gone", gone.limit(0), ("doc",), add=False)], {}

        return self.store.commit(change)

    def postings(self, terms: list[str], prefixes: list[str] = (), version: Version | None = None) -> DataFrame:
        """What counts of terms, and of those that begin with a prefix."""
        base = version or self.store.current()
        test = reduce(lambda a, b: a | b, [F.col("term").isin(terms), *(F.col("term").startswith(p) for p in prefixes)])
        buckets = None
        if not prefixes:
            asked = self.spark.createDataFrame([(t,) for t in terms], "term string")
            buckets = self.store.touched(asked, "term")
        return _left(base.read("postings", buckets=buckets).where(test), base.read("gone"))

    def match(self, query: str) -> DataFrame:
        """doc: documents that meet a query of terms, "phrases", prefixes*, OR and NOT. Phrases are found by places."""
        ways = parsed(query)
        parts = [p for must, rest in ways for p in (*must, *rest)]
        terms = sorted({w for own, prefix in parts for w in (own[:-1] if prefix else own)})
        starts = sorted({own[-1] for own, prefix in parts if prefix})
        held = F.map_from_entries(F.collect_list(F.struct("term", "places")))  # of one document, the terms asked for
        docs = self.postings(terms, starts).groupBy("doc").agg(held.alias("m"))

        def places(word: str, prefix: bool) -> Column:
            if prefix:
                return F.flatten(F.map_values(F.map_filter("m", lambda k, _: k.startswith(word))))
            return F.coalesce(F.element_at("m", F.lit(word)), F.array().cast("array<int>"))

        def test(part: tuple[list[str], bool]) -> Column:
            own, prefix = part
            found = [places(w, prefix and i == len(own) - 1) for i, w in enumerate(own)]
            at = found[0]
            for i, x in enumerate(found[1:], 1):
                at = F.array_intersect(at, _less(x, i))
            return F.size(at) > 0

        either = [reduce(lambda a, b: a & b, [*map(test, must), *(~test(p) for p in rest)]) for must, rest in ways]
        return docs.where(reduce(lambda a, b: a | b, either)).select("doc")

    def ranked(self, terms: list[str]) -> DataFrame:
        """doc, score of the documents that hold every term, as search.bm25() has them of the present documents."""
        terms = list(dict.fromkeys(t.lower() for t in terms))
        base = self.store.current()
        n, average = base.notes.get("n", 0), base.notes.get("total", 0) / max(base.notes.get("n", 0), 1)
        own = self.postings(terms, version=base)
        df = own.groupBy("term").agg(F.count("*").cast("double").alias("df"))  # a row for each term asked
        idf = F.greatest(F.lit(1e-6), F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(average or 1.0)))
        scored = own.join(F.broadcast(df), "term").select("doc", weight.alias("s"))
        return scored.groupBy("doc").agg(F.sum("s").alias("score"), F.count("*").alias("held")).where(F.col("held") == len(terms)).select("doc", "score")
