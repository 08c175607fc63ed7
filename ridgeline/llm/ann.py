"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced halving of a bounded sample. Each distinct vector goes to the list of
its nearest centroid and, near a boundary, to further lists whose centroids are hardly farther.
A query finds centroids by walking a graph of them in memory and keeps the lists whose distance is
within a ratio of the nearest; the ratio is the one that reached the wanted recall on the sample.
Lists and their queries are then met in blocks of bounded size and scored in double precision: first
the nearest lists, whose scores bound what the further lists need to return.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import cut

#: Values of the vectors in a block, queries in one, and lists that set a query's bound.
BLOCK_VALUES, ASKED, LEAD = 1 << 18, 512, 8
#: Queries whose lists one task finds.
WALKS = 128


@dataclass
class Index:
    """Centroids of unit length, their graph, and the ratio of distances within which lists are read."""

    centroids: np.ndarray
    graph: np.ndarray
    starts: np.ndarray
    ratio: float

    def near(self, q: np.ndarray, most: int) -> np.ndarray:
        """Centroids by distance, at most `most`: a best-first walk over the graph."""
        d = lambda i: 1.0 - self.centroids[i] @ q
        seen = np.zeros(len(self.centroids), bool)
        seen[self.starts] = True
        rest = [(x, int(i)) for x, i in zip(d(self.starts), self.starts, strict=True)]
        heapq.heapify(rest)
        found: list[tuple[float, int]] = []  # a heap with the farthest on top
        for x, i in rest:
            heapq.heappush(found, (-x, i))
        while rest:
            x, i = heapq.heappop(rest)
            if len(found) >= most and x > -found[0][0]:
                break
            new = self.graph[i][~seen[self.graph[i]]]
            seen[new] = True
            for y, j in zip(d(new), new, strict=True):
                if len(found) < most or y < -found[0][0]:
                    heapq.heappush(found, (-y, int(j)))
                    heapq.heappush(rest, (y, int(j)))
                    if len(found) > most:
                        heapq.heappop(found)
        return np.array([i for _, i in sorted((-x, i) for x, i in found)], np.int64)

    def lists(self, q: np.ndarray) -> np.ndarray:
        """The lists to read for a unit vector. The walk widens until the ratio ends it."""
        most = 32
        while True:
            found = self.near(q, min(most, len(self.centroids)))
            d = np.sqrt(np.maximum(2 * (1 - self.centroids[found] @ q), 0))
            keep = d <= self.ratio * max(d[0], 1e-9)
            if not keep[-1] or len(found) < most or most >= len(self.centroids):
                return found[keep]
            most *= 2


def halves(x: np.ndarray, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Groups of rows of near-equal number, at most `size`, by splitting at the median between two means."""
    done, rest = [], [np.arange(len(x))]
    while rest:
        at = rest.pop()
        if len(at) <= size:
            done.append(at)
            continue
        a, b = x[rng.choice(at, 2, replace=False)]
        for _ in range(6):
            side = x[at] @ (a - b)
            order = np.argsort(side, kind="stable")
            low, high = at[order[: len(at) // 2]], at[order[len(at) // 2 :]]
            b, a = x[low].mean(0), x[high].mean(0)
        rest += [low, high]
    return done


def assign(x: np.ndarray, centroids: np.ndarray, closure: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and list for each place of unit vectors: the nearest list, and up to most - 1 within the closure ratio."""
    d = np.sqrt(np.maximum(2 * (1 - x @ centroids.T), 0))
    k = min(most, d.shape[1])
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    own = np.take_along_axis(d, near, 1)
    keep = own <= closure * np.maximum(own.min(1, keepdims=True), 1e-9)
    row, col = np.nonzero(keep)
    return row, near[row, col]


def build(sample: np.ndarray, lists: int, recall: float, closure: float, copies: int, top: int) -> Index:
    """An index from unit vectors; its ratio reaches the recall on queries of the sample."""
    rng = np.random.default_rng(11)
    groups = halves(sample, max(1, -(-len(sample) // lists)), rng)
    c = np.stack([sample[g].mean(0) for g in groups])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    links = min(24, len(c) - 1)
    near = np.argsort(-(c @ c.T), axis=1)[:, 1 : 1 + links] if links else np.zeros((1, 0), np.int64)
    far = rng.integers(0, len(c), (len(c), 4))  # long links keep the graph connected
    ring = ((np.arange(len(c)) + 1) % len(c))[:, None]
    index = Index(c, np.concatenate([near, far, ring], 1), rng.choice(len(c), min(16, len(c)), replace=False), 1.0)
    row, place = assign(sample, c, closure, copies)
    asked = rng.choice(len(sample), min(400, len(sample)), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -2
    k = min(top, max(1, len(sample) - 1))
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    d = np.sqrt(np.maximum(2 * (1 - sample[asked] @ c.T), 0))
    order = np.argsort(row, kind="stable")
    row, place = row[order], place[order]
    bounds = np.searchsorted(row, np.arange(len(sample) + 1))
    need = [min(d[i, place[bounds[j] : bounds[j + 1]]]) / max(d[i].min(), 1e-9) for i in range(len(asked)) for j in best[i]]
    index.ratio = float(np.quantile(need, recall)) + 1e-9 if need else 2.0
    return index


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring the largest component near one: cosines stay what they are, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 16_384, per_list: int = 256, most_lists: int = 4096, recall: float = 0.985, closure: float = 1.06, copies: int = 4) -> DataFrame:
    """query_id, rank, id, score: the `top` rows of vectors nearest to each row of queries by cosine.

    The index is fitted on the `sample` distinct vectors with the least hash; every row is indexed.
    Equal vectors are one entry that keeps the top + 1 least ids, which are all that ties to smaller
    ids can let through. A query's own id is never its neighbour; fewer candidates than `top` all
    come back.

    Vectors that are null, zero, or hold null or non-finite components take no part, on either
    side; vectors of different lengths are no neighbours, so each length that queries have is a
    search of its own. Rows that repeat an id and vector count once; a null id takes no part. An
    empty table gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    kind = vectors.schema[id_col].dataType.simpleString()
    # Floats stay floats on the way, which is exact and half as much; tasks reckon in doubles.
    vector = "array<float>" if {df.schema[vector_col].dataType.simpleString() for df in (vectors, queries)} == {"array<float>"} else "array<double>"

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast(vector)
        df = df.select(F.col(id_col).alias("id"), v.alias("v")).where("id is not null and v is not null")
        fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where(fine & F.exists("v", lambda x: x != 0))

    whole, asked = clean(vectors), clean(queries)
    out = spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    for (dim,) in asked.select(F.size("v")).distinct().collect():  # lengths, as a rule one
        of_length = [df.where(F.size("v") == dim) for df in (whole, asked)]
        out = out.union(_nearest(*of_length, dim, kind, vector, id_col, top, sample, per_list, most_lists, recall, closure, copies))
    return out


def _nearest(whole: DataFrame, asked: DataFrame, dim: int, kind: str, vector: str, id_col: str, top: int, sample: int, per_list: int, most_lists: int, recall: float, closure: float, copies: int) -> DataFrame:
    """nearest() among vectors of one length."""
    spark = whole.sparkSession
    of = Window.partitionBy("v").orderBy("id")
    rows = whole.distinct().withColumn("n", F.row_number().over(of)).where(F.col("n") <= top + 1)
    rows = cut(rows.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))  # at most top + 1 ids
    asked = cut(asked.distinct())
    goals = cut(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()))
    total, walks = rows.count(), 1 + goals.count() // WALKS
    if not total:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    took = rows.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(sample).select("v").toArrow()
    lists = max(1, min(most_lists, total // per_list))
    index = build(_unit(_matrix(took.column(0), dim)), lists, recall, closure, copies, top)
    held = spark.sparkContext.broadcast(index)  # at most most_lists centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, to = assign(_unit(_matrix(batch.column(0), dim)), held.value.centroids, closure, copies)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["list", "v", "ids"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [held.value.lists(q) for q in _unit(_matrix(batch.column(0), dim))]
                sizes = [len(f) for f in found]
                place = np.concatenate([np.arange(n) for n in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int32)), pa.array(place.astype(np.int32)), batch.column(1).take(pa.array(np.repeat(np.arange(len(found)), sizes)))], names=["list", "place", "q"])

    placed = cut(rows.mapInArrow(place, f"list int, v {vector}, ids array<{kind}>"))
    read = cut(goals.repartition(walks, "q").mapInArrow(walk, "list int, place int, q long"))
    block = max(256, BLOCK_VALUES // dim)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def meet(base: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(asks):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        x, y = (_scaled(np.stack(df.v.to_numpy()).astype(np.float64)) for df in (base, asks))
        # All that are as near as the last one, but for rounding, are reckoned in full; of equal ones the least ids stay.
        near = _unit(y) @ _unit(x).T
        k = min(top + 1, len(x))
        least = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] - 1e-9
        own, flat = np.nonzero(near >= least[:, None])
        dots = (x[flat] * y[own]).sum(1)
        score = dots / (np.sqrt((x * x).sum(1))[flat] * np.sqrt((y * y).sum(1))[own])
        first = np.array([i[0] for i in base.ids])
        order = np.lexsort((first[flat], -score, own))
        own, flat, score = own[order], flat[order], score[order]
        place = np.arange(len(own)) - np.searchsorted(own, own)
        keep = (place < k) & (score >= asks.bound.to_numpy()[own])
        return pd.DataFrame({"q": asks.q.to_numpy()[own[keep]], "ids": base.ids.to_numpy()[flat[keep]], "score": score[keep]})

    def search(asks: DataFrame) -> DataFrame:
        """q, first, score, ids: what queries (list, q, v, bound) find in their lists, each entry once."""
        blocks = placed.groupBy("list").agg(F.ceil(F.count("*") / block).alias("s")).join(asks.groupBy("list").agg(F.ceil(F.count("*") / ASKED).alias("t")), "list")
        left = placed.join(blocks, "list").select("list", F.pmod(F.xxhash64("v"), "s").alias("i"), every("t").alias("j"), "v", "ids")
        right = asks.join(blocks, "list").select("list", every("s").alias("i"), F.pmod(F.xxhash64("q"), "t").alias("j"), "v", "q", "bound")
        key = ["list", "i", "j"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, f"q long, ids array<{kind}>, score double")
        return found.withColumn("first", F.element_at("ids", 1)).groupBy("q", "first").agg(F.max("score").alias("score"), F.max("ids").alias("ids"))

    # The nearest lists give each query a score that top + 1 entries reach; from the further lists only what reaches it too can count.
    near = cut(search(read.where(F.col("place") < LEAD).join(goals, "q").withColumn("bound", F.lit(-2.0))))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    bound = near.withColumn("n", F.row_number().over(best)).where(F.col("n") == top + 1).select("q", (F.col("score") - 1e-12).alias("bound"))
    asks = goals.join(bound, "q", "left").select("q", "v", F.coalesce("bound", F.lit(-2.0)).alias("bound"))
    met = near.unionByName(search(read.where(F.col("place") >= LEAD).join(asks, "q"))).groupBy("q", "first").agg(F.max("score").alias("score"), F.max("ids").alias("ids"))
    by_q = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    met = met.withColumn("n", F.row_number().over(by_q)).where(F.col("n") <= top + 1).join(goals, "q").select("v", "score", F.explode("ids").alias("id"))
    out = asked.withColumnRenamed("id", "query_id").join(met, "v").where("query_id <> id").select("query_id", "id", "score")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = out.groupBy("query_id", "id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= top)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
