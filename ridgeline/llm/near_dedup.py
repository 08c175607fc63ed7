"""Near duplicates by SetSketch registers, banded, filtered by joint likelihood, then verified.

1. Each text becomes a set of word shingles, a sketch and a class: equal sets are one class.
2. Register bands bring classes together in buckets, each with a head. A class is compared with its
   first head, then with those of its other heads that are still in another component. So a group of
   any size is linked with hardly more comparisons than members.
3. Likelihood of the two sketches rules out pairs; the rest are verified on their full sets.
4. Buckets whose members are still in several components are compared on full sets, in blocks of
   bounded bytes: members outside the bucket's main component against all of a fitting size. So
   every pair that meets in a bucket is either compared or already in one component; no bucket is
   capped, and no task returns more links than it holds members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import setsketch, textblocks
from ridgeline.llm.components import components
from ridgeline.llm.tuning import release, small_batches
from ridgeline.session import cut

#: Bytes of sets on either side of a block that one task compares in full.
SIDE = 4 << 20


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For blocks of texts: number of the first text, and each text's distinct shingles, sorted."""
    for block in textblocks.blocks(texts):
        runs, bounds = textblocks.runs(block.hashes(), block.words, words)
        yield block.first, [np.unique(runs[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]


def class_of(s: np.ndarray) -> int:
    """A hash of a set."""
    both = np.bitwise_xor.reduce(textblocks.mix(s), keepdims=True) + s.sum(keepdims=True) * np.uint64(3) + np.uint64(len(s))
    return int(textblocks.signed(textblocks.mix(both))[0])


def sketched(docs: DataFrame, id_col: str, text_col: str, words: int, m: int) -> DataFrame:
    """id, text_hash, node (class; null without words), n (size of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), words):
                sizes = np.array([len(s) for s in sets])
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                regs = setsketch.registers(np.concatenate(sets), bounds, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        batch.column(2).slice(first, len(sets)),
                        pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([r.tobytes() if k else None for r, k in zip(regs, sizes, strict=True)], pa.binary()),
                    ],
                    names=["id", "text_hash", "node", "n", "sketch"],
                )
        release()

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("text_hash", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).mapInArrow(run, schema)


def _banded(classes: DataFrame, m: int, bands: int) -> DataFrame:
    """key, node: every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, m)
            keys = textblocks.signed(setsketch.band_keys(regs, bands).ravel())
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], names=["key", "node"])

    return classes.select("node", "sketch").mapInArrow(run, "key long, node long")


def _likely(pairs: DataFrame, classes: DataFrame, m: int, similarity: float) -> DataFrame:
    """a, b, na, nb of the pairs that sizes and sketches do not rule out."""

    @F.pandas_udf("boolean")
    def keep(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, na, nb in parts:
            x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, m) for s in (a, b))
            yield pd.Series(setsketch.worth_verifying(x, y, na.to_numpy(), nb.to_numpy(), similarity))
        release()

    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a")  # a may have many partners: what is dealt by it is split where it is skewed
    return met.where(keep("sa", "sb", "na", "nb")).select("a", "b", "na", "nb")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """node, n, shingles (sorted, as bytes) of the wanted classes. Texts are shuffled once, here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), words):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["node", "n", "shingles"],
                )
        release()

    ids = classes.join(wanted, "node").select("id")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = own.join(ids, own.id.eqNullSafe(ids.id), "left_semi").select("text")
    return texts.mapInArrow(run, "node long, n long, shingles binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs whose full sets are similar enough."""

    @F.pandas_udf("long")
    def both(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")
        release()

    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", both("sa", "sb").alias("both"))
    return met.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _apart(met: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b: links between components that a bucket holds, beside those to its head.

    Members outside a bucket's main component are compared with all members whose sizes allow the
    similarity, on full sets, in blocks of SIDE bytes a side. A block returns links that join
    components, no more than it has members.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base, probe = pdf[~pdf.probe].reset_index(drop=True), pdf[pdf.probe].reset_index(drop=True)
        found = []
        if len(base) and len(probe):
            known, x = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in base.shingles]), return_inverse=True)
            bounds = np.concatenate([[0], np.cumsum(base.n.to_numpy())])[:-1]
            bn, root = base.n.to_numpy(), base.component.to_numpy().copy()
            own = probe.component.to_numpy().copy()
            has = np.zeros(len(known), np.int32)
            for j, shingles in enumerate(probe.shingles):
                s = np.frombuffer(shingles, np.uint64)
                size = len(s)
                fit = (100 * np.minimum(bn, size) >= percent * np.maximum(bn, size)) & (root != own[j])
                if not fit.any():
                    continue
                at = np.searchsorted(known, s)
                at[at == len(known)] = 0
                at = at[known[at] == s]
                has[at] = 1
                both = np.add.reduceat(has[x], bounds)
                has[at] = 0
                for i in np.flatnonzero(fit & (100 * both >= percent * (bn + size - both))):
                    if root[i] != own[j]:
                        old, new = own[j], root[i]
                        root[root == old], own[own == old] = new, new
                        found.append(sorted((int(base.node[i]), int(probe.node[j]))))
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    step = float(np.log(100 / percent)) * (1 + 1e-9)
    sized = F.floor(F.log(F.col("n").cast("double")) / step)  # sizes that allow the similarity differ by one at most
    known = sets.select("node", sized.alias("size"), (8 * F.col("n")).alias("bytes")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    held = cut(met.where("c > 2").select("key", "node", "head").join(known, "node"))
    mixed = cut(held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"))
    held = held.join(mixed, "key", "left_semi").where("node <> head").select("key", "node", "size", "bytes", "component")  # all were compared with the head
    of = held.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    held = cut(held.join(cut(of.select("key", "main")), "key").withColumn("probe", F.col("component") != F.col("main")).drop("main"))
    probes = held.where("probe").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)))
    parts = lambda df, name: df.groupBy("key", "size").agg(F.ceil(F.sum("bytes") / SIDE).alias(name))
    blocks = cut(parts(held, "bs").join(parts(probes, "ps"), ["key", "size"]))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    columns = ["key", "size", "node", "component", "probe", "i", "j"]
    base = held.withColumn("probe", F.lit(False)).join(blocks, ["key", "size"]).withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), "bs")).withColumn("j", every("ps"))
    probe = probes.join(blocks, ["key", "size"]).withColumn("j", F.pmod(F.xxhash64("node", F.lit(2)), "ps")).withColumn("i", every("bs"))
    rows = base.select(columns).union(probe.select(columns)).join(sets, "node")
    return rows.groupBy("key", "size", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, m: int = 128, bands: int = 32) -> DataFrame:
    """id_col, n_shingles, component_id, kept, text_hash (xxhash64 of the text) for each row of docs.

    Texts are linked if 100 * |A and B| >= percent * |A or B| for their sets of word shingles;
    component_id is the smallest id reachable by links, kept is whether that is the row's own.
    With 4 registers in each of 32 bands, a pair at 0.8 meets in no bucket once in 20 million.

    A text of fewer words is one shingle. Null or empty texts have n_shingles 0 and are linked with
    nothing. Equal texts are linked. Rows that repeat an id and text are one document and get equal
    results. A null id counts as no id: such a row is kept only if nothing else is reachable. An
    empty table gives no rows; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    similarity = percent / 100
    rows = cut(sketched(docs, id_col, text_col, words, m))
    classes = cut(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("sketch").alias("sketch")))
    banded = _banded(classes, m, bands)
    heads = cut(banded.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("c")).where("c > 1"))
    met = cut(banded.join(heads, "key"))
    sets = cut(_sets(docs, classes, cut(met.select("node").distinct()), id_col, text_col, words))
    own = Window.partitionBy("b").orderBy("a")  # a class has as many heads as bands at most
    stars = cut(met.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct().withColumn("nth", F.row_number().over(own)))
    compared = lambda pairs: cut(_verified(_likely(pairs.select("a", "b"), classes, m, similarity), sets, percent))
    links = compared(stars.where("nth = 1"))
    at = lambda x: links.select(F.col("b").alias(x), F.col("a").alias(f"c{x}"))  # noqa: E731  # the first head of a class, if it is similar
    apart = stars.where("nth > 1").join(at("b"), "b", "left").join(at("a"), "a", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    labels = cut(components(links.union(compared(apart))))
    more = cut(_apart(met, sets, labels, percent))
    if not more.isEmpty():
        labels = cut(components(more.union(labels.where("node <> component"))))
    info = classes.select("node", "id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = info.groupBy("component").agg(F.min("id").alias("component_id"))
    info = info.join(least, "component").select("node", "component_id")
    out = rows.select("id", "text_hash", "node", "n").join(info, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
