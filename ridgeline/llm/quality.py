"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

A text's terms are the shapes of its words (which kinds of characters follow each other), pairs of
adjacent shapes and whether the second word repeats the first, and the words themselves with less
weight, all hashed into DIM buckets. They are weighted by their frequency in the text and by how few
of all documents have them. The leading directions of the labelled sample's matrix span the space.

The sample's vectors are broadcast, as their number is bounded; every document is compared with
each of them, block by block, and the NEAREST vote for their label with a power of the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import textblocks
from ridgeline.llm.textblocks import U, mix
from ridgeline.llm.tuning import small_batches
from ridgeline.session import cut

DIM, RANK = 1 << 13, 64
#: Documents that vote (all that are as near as the last count too), and the power of their cosines.
NEAREST, POWER = 15, 16
#: What a word counts, beside a shape or a pair of shapes.
WORD = 0.25
#: Texts that are compared with the sample at once.
ROWS = 512

#: Kinds of characters: capital, letter (and all beyond ASCII), digit; every other byte is its own.
KIND = np.arange(256, dtype=np.uint8)
KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = 65, 97, 97, 48


def shapes(block: textblocks.Block) -> np.ndarray:
    """A hash of each word's kinds of characters, those that follow an equal one left out."""
    kinds = KIND[block.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[block.starts] = True
    place = np.cumsum(keep) - 1
    steps, inverse = textblocks.powers(len(kinds) + 1)
    sums = np.zeros(len(kinds) + 1, np.uint64)
    np.cumsum(np.where(keep, mix(kinds.astype(np.uint64) + U(1)) * steps[place], U(0)), out=sums[1:])
    return mix((sums[block.ends] - sums[block.starts]) * inverse[place[block.starts]])


def terms(block: textblocks.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, bucket and weight of each different term of a block of texts (not lowered), by text."""
    owner = np.repeat(np.arange(len(block.words) - 1), np.diff(block.words))
    shape, word = shapes(block), block.hashes()
    inside = owner[1:] == owner[:-1]
    pair = mix(shape[:-1] * U(31) ^ mix(shape[1:] + (word[1:] == word[:-1]).astype(np.uint64)))[inside]
    found = [(owner, shape, 1.0), (owner[1:][inside], pair, 1.0), (owner, word ^ U(0x5851F42D4C957F2D), WORD)]
    keys = np.concatenate([own.astype(np.int64) * DIM + (mix(h) % U(DIM)).astype(np.int64) for own, h, _ in found])
    weights = np.concatenate([np.full(len(own), w) for own, _, w in found])
    unique, at = np.unique(keys, return_inverse=True)
    return unique // DIM, unique % DIM, np.log1p(np.bincount(at, weights, len(unique))).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # DIM x RANK
    vectors: np.ndarray  # of the sample
    votes: np.ndarray  # weights of the sample's documents, so that classes count as all labels have them
    labels: np.ndarray
    rate: float  # of label 1


def _normed(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size > 1e-9, x / np.maximum(size, 1e-9), 0).astype(np.float32)


def vectors(block: textblocks.Block, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors of a block's texts; zero for a text without words."""
    owner, bucket, weight = terms(block)
    out = np.zeros((len(block.words) - 1, basis.shape[1]), np.float32)
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] = np.add.reduceat((weight * idf[bucket])[:, None] * basis[bucket], first, axis=0)
    return _normed(out)


def voted(found: np.ndarray, model: Model) -> np.ndarray:
    """Scores of vectors, by cosines with every one of the sample, to five decimals."""
    out = np.full(len(found), model.rate)
    if len(model.labels):
        for lo in range(0, len(found), ROWS):
            near = np.round(found[lo : lo + ROWS] @ model.vectors.T, 5)
            k = min(NEAREST, near.shape[1])
            last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
            weight = np.where(near >= last, np.maximum(near, 0), 0).astype(np.float64) ** POWER * model.votes
            total = weight.sum(1)
            share = (weight @ model.labels + 1e-9 * model.rate) / (total + 1e-9)
            out[lo : lo + ROWS] = np.where(total > 0, share, model.rate)
    return np.clip(out, 0, 1)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """The weight of each bucket, by the share of all documents that have it. Each task gives one row for a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for block in textblocks.blocks(batch.column(0), lower=False):
                held += np.bincount(terms(block)[1], minlength=DIM)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[n], held]))], names=["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(DIM + 1)
    counts[got.column("bucket").to_numpy() + 1] = got.column("n").to_numpy()
    return (np.log((counts[0] + 1) / (counts[1:] + 1)) + 0.1).astype(np.float32)


def _space(matrix: np.ndarray) -> np.ndarray:
    """The leading right singular vectors, by block power iteration from a fixed start."""
    rank = min(RANK, *matrix.shape)
    q = np.random.default_rng(13).normal(size=(matrix.shape[1], min(rank + 16, *matrix.shape))).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(matrix.T @ np.linalg.qr(matrix @ q)[0])
    _, _, turned = np.linalg.svd(matrix @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turned.T)[:, :rank], np.float32)


def fit(labels: DataFrame, docs: DataFrame, per_class: int = 2048) -> Model:
    """A model from labels (doc_id, quality: 0 or 1, once for each doc_id) of docs (doc_id, text).

    Document frequencies are those of all docs. The labelled sample is bounded: of each class the
    per_class labels with the least hash of doc_id, so at most 2 * per_class texts of at most DIM
    terms come to the driver; of rows that repeat a doc_id one counts. Classes vote by their share of all labels.
    """
    small_batches(docs.sparkSession)
    idf = inverse_frequencies(docs)
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    shares = {r.quality: r.n for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    ids = [labels.where(F.col("quality") == c).orderBy(order, "doc_id").limit(per_class).select("doc_id", F.col("quality").cast("int").alias("quality")) for c in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    sample = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textblocks.blocks(batch.column(2), lower=False):
                owner, bucket, weight = terms(block)
                n = len(block.words) - 1
                offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (bucket.astype(np.int16), weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, n), batch.column(1).slice(block.first, n), *lists], names=["doc_id", "quality", "bucket", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = cut(sample.select("doc_id", "quality", "text").mapInArrow(run, f"doc_id {kind}, quality int, bucket array<short>, weight array<float>")).orderBy("doc_id").toArrow()
    y = got.column("quality").to_numpy().astype(np.float64)
    total = sum(shares.values())
    rate = shares.get(1, 0) / total if total else 0.5
    matrix = np.zeros((len(y), DIM), np.float32)
    buckets, weights = (got.column(c).combine_chunks() for c in ("bucket", "weight"))
    for i in range(len(y)):
        at = buckets[i].values.to_numpy(zero_copy_only=False)
        matrix[i, at] = weights[i].values.to_numpy(zero_copy_only=False) * idf[at]
    basis = _space(_normed(matrix)) if len(y) else np.zeros((DIM, 1), np.float32)
    own = {c: max((y == c).sum(), 1) for c in (0, 1)}
    votes = np.where(y == 1, rate / own[1], (1 - rate) / own[0]) * len(y)
    return Model(idf, basis, _normed(matrix @ basis), votes, y, rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text. A text without words gets the share of label 1, as does every text where there are no labels of one kind."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textblocks.blocks(batch.column(1), lower=False):
                p = voted(vectors(block, held.value.idf, held.value.basis), held.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(p)), pa.array(p)], names=["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out() -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, learnt from the labels that are not held out.

    Labels other than 0 and 1, and of documents that are labelled both ways, are left out. Without
    any, every score is 0.5. Equal texts have equal scores. Null ids are kept, null texts are empty,
    an empty table gives no rows; other columns are not looked at.
    """
    both = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = both.where("quality = most and doc_id is not null").select("doc_id", "quality")
    scored = score(docs, fit(known, docs))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
