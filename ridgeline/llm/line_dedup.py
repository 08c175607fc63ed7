"""Line dedup by pairwise alignment of documents that share rare runs of lines.

A single line may be common; a passage is rare. So the fewest lines from each line on, and up to
it, that hold min_words words have one hash, and a hash that several documents have pairs each of them with the
first that has it: as many pairs as passages, however frequent one is. Each pair's line hashes are
aligned by patience diff, and aligned runs of min_words words or more go from the later document.
A shared run of lines that the chain of the diff leaves out, since passages cross or stand twice,
is aligned by itself. What goes is thus exactly each line that stands in a run of lines, of
min_words words or more, which one earlier document has too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import textblocks
from ridgeline.llm.textblocks import U
from ridgeline.llm.tuning import release, small_batches
from ridgeline.session import cut


def patience(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of a with the places of b that they are aligned with, both ascending.

    Lines that both have once are anchors, or, in a gap without any, the first, second, ... of equal
    lines with the same one of the other side. The longest increasing chain of anchors is kept,
    grown over equal neighbours, and the gaps between are aligned in the same way.
    """
    out, rest = [], [(0, len(a), 0, len(b))]
    while rest:
        alo, ahi, blo, bhi = rest.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        x, y = a[alo:ahi], b[blo:bhi]
        ux, ix, nx = np.unique(x, return_index=True, return_counts=True)
        uy, iy, ny = np.unique(y, return_index=True, return_counts=True)
        _, px, py = np.intersect1d(ux[nx == 1], uy[ny == 1], assume_unique=True, return_indices=True)
        at, to = ix[nx == 1][px], iy[ny == 1][py]
        if not len(at):
            at, to = _by_occurrence(x, y)
        order = np.argsort(at)
        at, to = at[order], to[order]
        if not len(at):
            continue
        ends: list[int] = []
        last: list[int] = []
        before = np.full(len(to), -1)
        for i, t in enumerate(to.tolist()):
            k = bisect_left(ends, t)
            before[i] = last[k - 1] if k else -1
            ends[k : k + 1], last[k : k + 1] = [t], [i]
        chain, i = [], last[-1]
        while i >= 0:
            chain.append(i)
            i = before[i]
        pa_, pb = alo, blo
        for i in reversed(chain):
            qa, qb = alo + int(at[i]), blo + int(to[i])
            rest.append((pa_, qa, pb, qb))
            out.append((qa, qb))
            pa_, pb = qa + 1, qb + 1
        rest.append((pa_, ahi, pb, bhi))
    return sorted(out)


def _by_occurrence(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal lines, each occurrence in x with the same one in y."""
    places: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for j, v in enumerate(y.tolist()):
        seen[v] = seen.get(v, 0) + 1
        places[v, seen[v]] = j
    at, to, seen = [], [], {}
    for i, v in enumerate(x.tolist()):
        seen[v] = seen.get(v, 0) + 1
        if (v, seen[v]) in places:
            at.append(i)
            to.append(places[v, seen[v]])
    return np.array(at, np.int64), np.array(to, np.int64)


def windows(h: np.ndarray, w: np.ndarray, bounds: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, hash of the fewest lines from each line on, and up to each line, that hold min_words words.

    h, w: hashes and words of lines, none of them blank, of texts that begin at bounds. Any run of
    min_words words or more is the union of those that lie in it.
    """
    words, sizes = np.concatenate([[0], np.cumsum(w)]), np.diff(bounds)
    start = np.arange(len(h))
    end = np.searchsorted(words, words[:-1] + min_words)
    fits = end <= np.repeat(bounds[1:], sizes)
    back = np.searchsorted(words, words[1:] - min_words, "right") - 1
    holds = back >= np.repeat(bounds[:-1], sizes)
    n = len(h) + 1
    both = np.unique(np.concatenate([start[fits] * n + end[fits], back[holds] * n + start[holds] + 1]))
    start, end = both // n, both % n
    powers, inverse = textblocks.powers(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textblocks.mix(h) * powers[: len(h)], dtype=np.uint64)])
    return start, end, textblocks.mix((sums[end] - sums[start]) * inverse[start] ^ (end - start).astype(np.uint64))


def aligned(a: np.ndarray, b: np.ndarray, words: np.ndarray, shared: np.ndarray, min_words: int) -> np.ndarray:
    """Numbers of the lines of a in runs of min_words words or more that b has too.

    words: of the lines of a. shared: hashes of windows of a that b is known to have.
    """
    na, nb = np.flatnonzero(words > 0), np.flatnonzero(b)
    x, y, w = a[na], b[nb], words[na]
    mark = np.zeros(len(na), bool)
    pairs = np.array(patience(x, y), np.int64).reshape(-1, 2)
    breaks = np.flatnonzero((np.diff(pairs[:, 0]) != 1) | (np.diff(pairs[:, 1]) != 1)) + 1
    for run in np.split(pairs[:, 0], breaks):
        if len(run) and w[run].sum() >= min_words:
            mark[run] = True
    start, end, keys = windows(x.view(np.uint64), w, np.array([0, len(x)]), min_words)
    for i in np.flatnonzero(np.isin(keys.view(np.int64), shared)):  # what the chain has left out
        mark[start[i] : end[i]] = True
    return na[mark]


def _line_hashes(block: textblocks.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (0: blank) and words of every line of a block's texts, without the blanks around it, and where each text's lines begin."""
    newline = np.flatnonzero(block.data == 10)
    own = block.offsets
    counts = 1 + np.searchsorted(newline, own[1:]) - np.searchsorted(newline, own[:-1])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    first, last = np.zeros(bounds[-1], bool), np.zeros(bounds[-1], bool)
    first[bounds[:-1]], last[bounds[1:] - 1] = True, True
    starts[first], starts[~first] = own[:-1], newline + 1
    ends[last], ends[~last] = own[1:], newline
    lo, hi = np.searchsorted(block.starts, starts), np.searchsorted(block.starts, ends)
    w = np.maximum(hi - lo, 0)
    h = np.zeros(len(w), np.uint64)
    full = w > 0
    h[full] = np.maximum(block.span_hashes(block.starts[lo[full]], block.ends[hi[full] - 1]), U(1))
    return h, w, bounds


def _held(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """k (id and a hash of the text), h, w (hash and words of each line), keys (distinct windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textblocks.blocks(batch.column(2), lower=False):
                h, w, bounds = _line_hashes(block)
                full = np.flatnonzero(w > 0)
                inner = np.searchsorted(full, bounds)
                start, _, found = windows(h[full], w[full], inner, min_words)
                owner = np.searchsorted(inner, start, "right") - 1
                order = np.lexsort((found, owner))
                found, owner = found[order], owner[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
                found, owner = found[new], owner[new]
                n = len(bounds) - 1
                lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, n), batch.column(1).slice(block.first, n), lists(bounds, textblocks.signed(h)), lists(bounds, w.astype(np.int32)), lists(np.searchsorted(owner, np.arange(n + 1)), textblocks.signed(found))],
                    names=["id", "hash", "h", "w", "keys"],
                )
        release()

    own = F.coalesce(F.col(text_col), F.lit(""))
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("hash", T.LongType())]
    fields += [T.StructField(n, T.ArrayType(t)) for n, t in (("h", T.LongType()), ("w", T.IntegerType()), ("keys", T.LongType()))]
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(own).alias("hash"), own.alias("text")).mapInArrow(run, T.StructType(fields))
    return found.select(F.struct("id", "hash").alias("k"), "h", "w", "keys")


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """_id, _hash, gone, gone_words: for documents that lose lines, the numbers of these (from 0) and their words."""
    small_batches(docs.sparkSession, 256)

    @F.pandas_udf("array<int>")
    def align(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([aligned(*map(np.asarray, x), min_words) for x in zip(*part, strict=True)])
        release()

    held = cut(_held(docs, id_col, text_col, min_words))
    seen = held.select("k", F.explode("keys").alias("line"))
    first = cut(seen.groupBy("line").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1").select("line", "first"))
    met = seen.join(first, "line").where("k <> first")
    pairs = cut(met.groupBy("k", "first").agg(F.collect_set("line").alias("shared")))  # no more than a document's own windows
    theirs = held.select(F.col("k").alias("first"), F.col("h").alias("b"))
    theirs = theirs.join(pairs.select("first").distinct(), "first", "left_semi")
    both = pairs.join(held.select("k", "h", "w"), "k").join(theirs, "first")  # the first holder may have many partners: what is dealt by it is split where it is skewed
    marked = cut(both.select("k", align("h", "b", "w", "shared").alias("m")))
    merged = marked.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("m"))).alias("gone"))  # a document's own lines, once for each partner
    found = merged.join(held.select("k", "w"), "k").where(F.size("gone") > 0).dropDuplicates(["k"])
    return found.select(F.col("k.id").alias("_id"), F.col("k.hash").alias("_hash"), "gone", F.aggregate("gone", F.lit(0), lambda a, i: a + F.element_at("w", i + 1)).alias("gone_words"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 51) -> DataFrame:
    """docs with the text less its repeated passages, and lines_deleted, words_deleted.

    A passage is a run of whole lines of at least min_words words (51: over fifty; 1: every line)
    that one earlier document has too. Lines are equal if they are without the blanks around them,
    and blank lines don't count. Documents come in order of id, and of a hash of their text where
    ids are equal; rows that repeat both are one document and get equal results. A null id comes
    first. Null texts stay null and empty ones empty. A document all of whose lines go has the empty
    text. An empty table gives no rows. Other columns are carried along, whatever their names, but
    for lines_deleted and words_deleted, which are replaced.
    """
    found = cut(repeated_lines(docs, id_col, text_col, min_words))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    rows = rows.join(found, F.col(f"row.{id_col}").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    text, gone = F.col(f"row.{text_col}"), F.col("gone")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    new = {"lines_deleted": F.when(gone.isNull(), 0).otherwise(F.size(gone)), "words_deleted": F.coalesce("gone_words", F.lit(0))}
    kept = {c: F.col(f"row.`{c}`") for c in docs.columns if c not in new} | {text_col: F.when(gone.isNull(), text).otherwise(left)}
    return rows.select(*(c.alias(name) for name, c in (kept | new).items()))
