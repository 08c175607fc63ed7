"""Ranked text search, snippets, chunks and vector retrieval (FTS, VEC, TOPK)."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.session import cut

K1, B = 1.2, 0.75


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _idf(n: float, df: float) -> float:
    return max(1e-6, float(math.log((n - df + 0.5) / (df + 0.5)))) if n else 0.0


def _weight(tf: Column, length: Column, average: float, idf: Column | float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average or 1.0)))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, score of the documents that hold every term (FTS-01, 02).

    Texts are read once and cut into words once; a document's length and its counts of the query's terms are kept,
    and corpus numbers and scores are made of these. So no text is shuffled; for many searches, use index().
    """
    terms = [t.lower() for t in terms]
    count = lambda t: F.size(F.filter("w", lambda w: w == t)).cast("double")
    split = docs.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    counted = cut(split.select(key, F.size("w").cast("double").alias("len"), *(count(t).alias(f"t{i}") for i, t in enumerate(terms))))
    whole = counted.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"t{i}") > 0).cast("double").alias(f"d{i}") for i in range(len(terms)))).first()
    score, held = F.lit(0.0), F.lit(True)
    for i in range(len(terms)):
        tf = F.col(f"t{i}")
        score = score + _weight(tf, F.col("len"), whole["avg"], F.lit(_idf(whole["n"], whole[f"d{i}"])))
        held = held & (tf > 0)
    return counted.where(held).select(key, score.alias("score"))


def index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, len, docs, avg: an inverted index of a corpus, to be written once, sorted by term, and searched often (FTS-03, JOIN-01).

    Counts are summed before the shuffle, so a term that most documents hold is a row of each.
    """
    tokens = docs.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    whole = tokens.agg(F.count("*").cast("double").alias("docs"), F.avg(F.size("w").cast("double")).alias("avg")).first()
    held = tokens.select(key, F.size("w").cast("double").alias("len"), F.explode("w").alias("term")).groupBy("term", key, "len").agg(F.count("*").cast("double").alias("tf"))
    return held.select("term", key, "tf", "len", F.lit(whole["docs"]).alias("docs"), F.lit(whole["avg"]).alias("avg"))


def with_documents(old: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """An index with further documents (FTS-04): only theirs are read; the corpus numbers are made anew."""
    new = index(docs, key, text).drop("docs", "avg")
    both = old.drop("docs", "avg").unionByName(new)
    fresh = docs.agg(F.count("*").cast("double").alias("n"), F.avg(F.size(words(F.coalesce(F.col(text), F.lit("")))).cast("double")).alias("a")).first()
    was = old.select("docs", "avg").first()
    n, total = fresh.n + (was.docs if was else 0), fresh.n * (fresh.a or 0) + (was.docs * was.avg if was else 0)
    return both.withColumns({"docs": F.lit(n), "avg": F.lit(total / n if n else 0.0)})


def search_index(postings: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """key, score as bm25() has them: only the rows of the terms are read (JOIN-01)."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    own = postings.where(F.col("term").isin(terms))
    frequency = own.groupBy("term").agg(F.count("*").cast("double").alias("df"))  # a row for each term asked
    idf = F.greatest(F.lit(1e-6), F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tf, length = F.col("tf"), F.col("len")
    scored = own.join(F.broadcast(frequency), "term").select(key, (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg")))).alias("s"))
    return scored.groupBy(key).agg(F.sum("s").alias("score"), F.count("*").alias("n")).where(F.col("n") == len(terms)).select(key, "score")


def query_test(text: Column, query: str) -> Column:
    """Whether a text meets a query of terms, "phrases", prefixes*, OR and NOT; terms that stand together must all be met."""
    padded = F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))
    out, any_, negate = None, None, False
    for part in re.findall(r'"[^"]*"|\S+', query):
        if part == "OR":
            any_ = out if any_ is None else any_ | out
            out = None
            continue
        if part == "NOT":
            negate = True
            continue
        own = re.findall(r"\w+", part.lower())
        test = padded.contains(" " + " ".join(own) + ("" if part.endswith("*") else " "))
        test = ~test if negate else test
        negate = False
        out = test if out is None else out & test
    return out if any_ is None else any_ | out if out is not None else any_


def snippet(text: Column, n: int = 500) -> Column:
    """The first n characters, with ... if there are more (FN-20)."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 for other lengths, empty or zero vectors (FN-16)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def top_k(rows: DataFrame, key: str, vector: str, query: list[float], k: int = 10, least: float = 0.3) -> DataFrame:
    """key, score: the k most similar, less those not above `least` (VEC-01, TOPK-03)."""
    scored = rows.select(key, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k).where(F.col("score") > least)


def merged(sources: list[DataFrame], k: int, order: list[str]) -> DataFrame:
    """The k best hits of several sources of the same columns (TOPK-04, VEC-05)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.orderBy(F.desc("score"), *order).limit(k)


# What hits of sources without a score of their own count (VEC-04).
SOURCE_SCORES = {"local": 0.5, "ima": 0.8}


def scored(hits: DataFrame, source: str) -> DataFrame:
    """hits with the source's fixed score, or their own (VEC-04)."""
    return hits.withColumn("score", F.lit(SOURCE_SCORES[source])) if source in SOURCE_SCORES else hits


def chunks(text: Column, mark: str = "\n## ", least: int = 50) -> Column:
    """The parts between headings, trimmed, of more than `least` characters (VEC-03)."""
    parts = F.transform(F.split(text, re.escape(mark).replace("\\\n", "\n"), -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: F.length(x) > least)


def greedy_chunks(text: Column) -> Column:
    """Pieces of about 1000 characters that end at the last newline after half of that (VEC-03, texts without headings): each cut depends on the one before."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(texts: pd.Series) -> pd.Series:
        return pd.Series([_pieces(t or "") for t in texts])

    return pieces(text)


def _pieces(text: str, size: int = 1000) -> list[str]:
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            cut = text.rfind("\n", at + size // 2, end)
            end = cut + 1 if cut > 0 else end
        if piece := text[at:end].strip():
            out.append(piece)
        at = end
    return out


def knowledge(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is known of each file's present content, and the chunks that are new (SRC-12).

    files: file, text of *.md files, as read whole. cached: file, content_hash, chunk_no, chunk (and
    more, such as vectors). A file that has changed, by the hash of its text, is chunked anew.
    """
    now = files.select("file", F.sha2("text", 256).alias("content_hash"), "text")
    known = cached.join(now.select("file", "content_hash"), ["file", "content_hash"], "left_semi")
    fresh = now.join(known.select("file", "content_hash").distinct(), ["file", "content_hash"], "left_anti")
    return known, fresh.select("file", "content_hash", F.posexplode(chunks(F.col("text"))).alias("chunk_no", "chunk"))


def float_vector(raw: Column) -> Column:
    """The little-endian 32-bit floats that bytes hold (FN-17); null if they are not whole."""

    @F.arrow_udf("array<float>")
    def decode(values: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(v, "<f4").tolist() if v is not None and len(v) % 4 == 0 else None for v in values.to_pylist()], pa.list_(pa.float32()))

    return decode(raw)
