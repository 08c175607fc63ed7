"""Toxicity by class-conditional Kneser-Ney models of expressions.

For each class, toxic and ordinary, P(word | word before) backs off to the word, to its first six,
four and three bytes, and in the end to counts that both classes share. Lower orders count the
distinct contexts an expression was seen in, not its occurrences. So an expression that is new but
begins like known ones gets its weight from the counts of those.

A text's log-likelihood ratio is normalised by length: over the whole text, and over windows of a
few words, of which the largest count. A logistic curve over these makes the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm import textblocks
from ridgeline.llm.textblocks import LOOSE, U, mix, signed
from ridgeline.llm.tuning import small_batches
from ridgeline.session import cut

PREFIXES = (6, 4, 3)
DISCOUNT = 0.75
#: An entry of an order that was seen less often than so, in both classes together, takes the value it
#: backs off to, at any size of the sample. If all entries count, held-out toxic texts found fall from
#: 0.99 to 0.89, since the largest of a text's windows is then that of a chance word.
SEEN = {"p3": 1, "p4": 2, "p6": 2, "w": 3, "pair": 4}
WINDOW = 6
FEATURES = 5


@dataclass
class Level:
    """Sorted keys, and a value for each."""

    keys: np.ndarray
    values: np.ndarray

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return at, self.keys[at] == x


@dataclass
class Model:
    pairs: Level  # log ratios of a word after a word
    words: Level  # log ratios
    after: np.ndarray  # log ratio of the weights with which a known word backs off
    prefixes: list[Level]
    unseen: float
    curve: np.ndarray | None = None  # weights of the logistic curve
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None


def expressions(block: textblocks.Block) -> dict[str, np.ndarray]:
    """Hashes of each word, the word before (0 at a text's start), the pair, and prefixes."""
    w = block.hashes()
    before = np.zeros_like(w)
    before[1:] = w[:-1]
    before[block.words[:-1][block.words[:-1] < len(w)]] = 0
    found = {"w": w, "p": before, "pair": mix(before * U(0x9E3779B97F4A7C15) ^ w)}
    return found | {f"p{n}": block.hashes(n) for n in PREFIXES}


def ratios(block: textblocks.Block, model: Model) -> np.ndarray:
    """A log-likelihood ratio for each word."""
    if not len(block.starts):
        return np.zeros(0)
    e = expressions(block)
    out = np.full(len(e["w"]), model.unseen)
    left = np.arange(len(out))
    at, known = model.words.find(e["w"])
    out[known] = model.words.values[at[known]]
    left = left[~known]
    for n, level in zip(PREFIXES, model.prefixes, strict=True):
        if len(left):
            i, hit = level.find(e[f"p{n}"][left])
            out[left[hit]] = level.values[i[hit]]
            left = left[~hit]
    if len(model.after):
        at = np.concatenate([[0], at[:-1]])
        known = np.concatenate([[False], known[:-1]]) & (e["p"] != 0)
        out[known] += model.after[at[known]]
    i, hit = model.pairs.find(e["pair"])
    out[hit] = model.pairs.values[i[hit]]
    return out


def features(block: textblocks.Block, model: Model) -> np.ndarray:
    """For each text: the mean ratio, the largest means over windows, the largest over halves of a window, and log length."""
    r = ratios(block, model)
    out = np.zeros((len(block.words) - 1, FEATURES))
    sums = np.concatenate([[0.0], np.cumsum(r)])
    for t in range(len(out)):
        lo, hi = block.words[t], block.words[t + 1]
        n = hi - lo
        if not n:
            continue
        s = sums[lo : hi + 1]
        own = r[lo:hi]
        size = min(WINDOW, n)
        means = (s[size:] - s[:-size]) / WINDOW
        k = min(3, n)
        best = np.partition(own, n - k)[n - k :]
        out[t] = (s[-1] - s[0]) / n, means.max(), best.max() / 2, best.sum() / 6, np.log1p(n)
    return out


def _counted(rows: DataFrame) -> DataFrame:
    """toxic, p, w, p6, p4, p3, pair, n: occurrences of each word after each word, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic in (0, 1):
                texts = batch.column(1).filter(pa.compute.equal(batch.column(0), toxic))
                for block in textblocks.blocks(texts, LOOSE):
                    if not len(block.starts):
                        continue
                    e = expressions(block)
                    _, first, n = np.unique(e["pair"], return_index=True, return_counts=True)
                    columns = [pa.array(signed(e[c][first])) for c in ("p", "w", "p6", "p4", "p3", "pair")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), toxic, np.int32)), *columns, pa.array(n.astype(np.int64))], names=names)

    names = ["toxic", "p", "w", "p6", "p4", "p3", "pair", "n"]
    found = rows.select("toxic", "text").mapInArrow(run, "toxic int, p long, w long, p6 long, p4 long, p3 long, pair long, n long")
    return found.groupBy("toxic", "p", "w", "p6", "p4", "p3", "pair").agg(F.sum("n").alias("n"))


def _by_class(df: DataFrame, keys: list[str], value) -> DataFrame:
    """keys, n0, n1: the value for each class."""
    return df.groupBy(*keys).agg(*(F.sum(F.when(F.col("toxic") == c, value).otherwise(0)).alias(f"n{c}") for c in (0, 1)))


def _take(df: DataFrame, least: int = 1) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The rows seen `least` times; what all rows sum to and how many there are, by class. The sample bounds them."""
    total = df.agg(*(F.sum(f"n{c}") for c in (0, 1)), *(F.count_if(F.col(f"n{c}") > 0) for c in (0, 1))).first()
    got = df.where(F.col("n0") + F.col("n1") >= least).toArrow()
    columns = {c: got.column(c).to_numpy() for c in got.column_names}
    return columns, np.array([float(x or 0) for x in total[:2]]), np.array([float(x or 0) for x in total[2:]])


def _discounted(n: np.ndarray, total: float) -> np.ndarray:
    return np.maximum(n - DISCOUNT, 0) / max(total, 1.0)


def fit_counts(rows: DataFrame) -> Model:
    """The two models, from rows of toxic (0, 1) and text."""
    counted = cut(_counted(rows))
    orders = {"w": ["w", "p6", "p4", "p3"], "p6": ["p6", "p4", "p3"], "p4": ["p4", "p3"], "p3": ["p3"]}
    level, types = counted, {}
    for name, keys in orders.items():  # each order counts the distinct entries of the one above
        level = level.groupBy("toxic", *keys).agg(F.count("*").alias("n"))
        types[name] = level
    beta: dict[str, np.ndarray] = {}
    kept, levels, unseen = {}, {}, 0.0
    above = None
    for name in ("p3", "p4", "p6", "w"):
        columns, totals, distinct = _take(_by_class(types[name], orders[name], F.col("n")), SEEN[name])
        n = np.stack([columns["n0"], columns["n1"]]).astype(float)
        rest = DISCOUNT * distinct / np.maximum(totals, 1)
        rest = np.where(rest > 0, rest, 1.0)
        pooled = n.sum(0)
        if name == "p3":
            lower = np.broadcast_to(pooled / max(pooled.sum(), 1), n.shape)
            unseen = float(np.log(rest[1] / rest[0]))
        else:
            keys, values, of = above
            parent = columns[orders[name][1]]
            at = np.minimum(np.searchsorted(keys, parent), max(len(keys) - 1, 0))
            known = keys[at] == parent if len(keys) else np.zeros(len(parent), bool)
            lower = np.full(n.shape, 1e-9)
            if len(keys):
                lower[:, known] = values[:, at[known]] * (pooled / np.maximum(of[at], pooled))[known]
        p = np.stack([_discounted(n[c], totals[c]) + rest[c] * lower[c] for c in (0, 1)])
        order = np.argsort(columns[name])
        sorted_keys = columns[name][order]
        above = sorted_keys, p[:, order], pooled[order]
        # A word that is not kept takes the ratio of its prefix, after the weights of backing off.
        beta[name] = np.log(p[1] / p[0])[order]
        kept[name], levels[name] = (columns, order, rest), sorted_keys
    back = {name: float(np.log(kept[name][2][1] / kept[name][2][0])) for name in ("w", "p6", "p4")}
    shift = {"p6": back["w"], "p4": back["w"] + back["p6"], "p3": back["w"] + back["p6"] + back["p4"]}
    by_hash = lambda keys, values: Level(*(lambda u, o: (u[o], values[o]))(keys.view(np.uint64), np.argsort(keys.view(np.uint64))))
    words = by_hash(levels["w"], beta["w"])
    prefixes = [by_hash(levels[f"p{n}"], beta[f"p{n}"] + shift[f"p{n}"]) for n in PREFIXES]
    # Words after words: P = discounted + weight(before) * P(word).
    context = counted.groupBy("toxic", "p").agg(F.sum("n").alias("c"), F.count("*").alias("t"))
    by = context.groupBy("p").agg(*(F.sum(F.when(F.col("toxic") == c, F.col(x)).otherwise(0)).alias(f"{x}{c}") for c in (0, 1) for x in "ct"))
    by = by.where("p <> 0").toArrow()
    weights = np.stack([DISCOUNT * by.column(f"t{c}").to_numpy() / np.maximum(by.column(f"c{c}").to_numpy(), 1) for c in (0, 1)])
    weights = np.where(weights > 0, weights, 1.0)
    size = np.stack([by.column(f"c{c}").to_numpy() for c in (0, 1)]).astype(float)
    # A context seen seldom says nothing: its weights are drawn to each other.
    trust = size.min(0) / (size.min(0) + 50.0)
    contexts = by_hash(by.column("p").to_numpy(), np.arange(len(trust)))
    at, known = contexts.find(words.keys)
    after = np.zeros(len(words.keys))
    if len(trust):
        i = contexts.values[at[known]].astype(int)
        after[known] = trust[i] * np.log(weights[1, i] / weights[0, i])
    pair, _, _ = _take(_by_class(counted, ["pair", "p", "w"], F.col("n")), SEEN["pair"])
    n = np.stack([pair["n0"], pair["n1"]]).astype(float)
    pi, pk = contexts.find(pair["p"].view(np.uint64))
    wi, wk = words.find(pair["w"].view(np.uint64))
    both = np.flatnonzero(pk & wk & (pair["p"] != 0))
    columns, order, _ = kept["w"]
    pw = above[1][:, np.argsort(levels["w"].view(np.uint64))]
    value = np.zeros(0)
    if len(both):
        c = contexts.values[pi[both]].astype(int)
        full = [(np.maximum(n[k][both] - DISCOUNT, 0)) / np.maximum(size[k, c], 1) + weights[k, c] * pw[k, wi[both]] for k in (0, 1)]
        value = np.log(full[1] / full[0])
    pairs = by_hash(pair["pair"][both], value)
    return Model(pairs, words, after, prefixes, unseen + shift["p3"])


def _features(rows: DataFrame, model: Model) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textblocks.blocks(batch.column(1), LOOSE):
                f = features(block, held.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(f)), *(pa.array(f[:, i]) for i in range(FEATURES))], names=["toxic", *(f"f{i}" for i in range(FEATURES))])

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, " + ", ".join(f"f{i} double" for i in range(FEATURES)))


def fit_curve(model: Model, rows: DataFrame, rate: float) -> Model:
    """Adds the logistic curve: Newton steps over the features of at most the sampled rows. rate: the share of toxic rows among all labelled ones."""
    got = _features(rows, model).toArrow()
    x = np.stack([got.column(f"f{i}").to_numpy() for i in range(FEATURES)], 1)
    y = got.column("toxic").to_numpy().astype(float)
    model.centre = x.mean(0) if len(x) else np.zeros(FEATURES)
    model.scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(FEATURES)
    z = np.column_stack([np.ones(len(x)), (x - model.centre) / model.scale])
    own = np.array([max((y == c).sum(), 1) for c in (0, 1)])
    weight = np.where(y == 1, rate / own[1], (1 - rate) / own[0]) * len(y)
    w = np.zeros(FEATURES + 1)
    ridge = np.array([1e-3] + [1.0] * FEATURES)
    for _ in range(60 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -2, 2)
    model.curve = w
    return model


def fit(labels: DataFrame, docs: DataFrame, per_class: int = 4000) -> Model:
    """A model from labels (doc_id, toxic: 0 or 1) of docs (doc_id, text).

    It is fitted on a bounded sample: of each class the per_class labels with the least hash of
    doc_id, 2 * per_class ids in all, which is what is broadcast; of rows that repeat an id one counts. Three in four of those texts are
    counted, the rest place the curve. The share of toxic labels is that of all labels.
    """
    rate = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    ids = [labels.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class).select("doc_id", F.col("toxic").cast("int").alias("toxic")) for c in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    sample = cut(rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(4))
    model = fit_counts(sample.where(part != 0))
    return fit_curve(model, sample.where(part == 0), min(max(rate or 0.5, 0.01), 0.99))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) of every whole text.

    Null and empty texts get the score of a text without words. Equal texts get equal scores, so
    repeated rows do too. Null ids are kept, an empty table gives no rows, other columns are not
    looked at.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textblocks.blocks(batch.column(1), LOOSE):
                m = held.value
                z = (features(block, m) - m.centre) / m.scale @ m.curve[1:] + m.curve[0]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(p)), pa.array(p)], names=[id_col, "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, learnt from the labels that are not held out.

    Labels other than 0 and 1 are left out. A document with labels of both kinds is toxic.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = fit(known, docs)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
