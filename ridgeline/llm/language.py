"""Language identification by fusing evidence in Bayes' rule.

log posterior = text likelihood (byte trigrams, tempered by length)
              + likelihood of the language that the markup declares
              + prior of the host, smoothed towards its domain, its address suffix and all rows.

How often declarations are right, and the priors, come from grouped counts over all rows of what
the text alone says. The class `und` has a flat likelihood: what no language explains goes there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm import textblocks
from ridgeline.llm.tuning import release, small_batches
from ridgeline.session import cut

CODES = 1 << 16
UNKNOWN = "und"
#: Weight of a parent's prior, in rows; characters whose evidence counts in full.
PULL, FULL = 20.0, 120.0
#: How often a trigram counts that a language's sample lacks.
UNSEEN = 0.05
#: Hosts are dealt to so many shares where they meet the counts of all rows and of their suffix.
SHARES = 32
#: Up to so many hosts, priors are broadcast (a number for each language); beyond, they are joined.
FEW = 20_000
#: Bytes of texts that are scored at a time, and for how many classes; with more classes, fewer bytes.
PART, CLASSES = 1 << 17, 33
_FOLD = np.where(textblocks.LOOSE, 32, textblocks.LOWER).astype(np.uint8)


@dataclass
class Model:
    """What each language says of a trigram's code: its floor, and what codes that were seen in it have above that.

    A language takes memory by the different codes that its sample has, not by all there could be.
    """

    languages: list[str]  # the last is UNKNOWN
    floors: np.ndarray  # of languages
    starts: np.ndarray  # where each code's entries begin
    owners: np.ndarray  # numbers of languages, by code
    gains: np.ndarray  # log probability above the floor, beside owners


def _codes(raw: np.ndarray) -> np.ndarray:
    """A code for each three bytes, letters folded, other characters as blanks."""
    x = _FOLD[raw].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    return (((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., many of them, one range after the other."""
    return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())


def likelihoods(texts: pa.Array, model: Model) -> np.ndarray:
    """Tempered log likelihoods of texts, and in the last column whether a text has letters."""
    offsets, data = textblocks.buffers(texts)
    out = np.zeros((len(offsets) - 1, len(model.languages) + 1))
    part = PART * CLASSES // max(CLASSES, len(model.languages))
    for lo, hi in textblocks.spans(offsets, part):
        own = offsets[lo : hi + 1] - offsets[lo]
        for at in range(0, max(1, int(own[-1])), part):  # more than once for a text that is longer
            raw = data[offsets[lo] + at : min(offsets[hi], offsets[lo] + at + part + 2)]
            codes = _codes(raw)
            letters = np.concatenate([[0], np.cumsum(~textblocks.LOOSE[raw[:part]])])
            a, b = np.clip(own[:-1] - at, 0, len(codes)), np.clip(own[1:] - 2 - at, 0, len(codes))
            m = np.maximum(b - a, 0)
            codes = codes[_ranges(a, m)]
            first, many = model.starts[codes], model.starts[codes + 1] - model.starts[codes]
            entry = _ranges(first, many)
            cell = np.repeat(np.repeat(np.arange(hi - lo) * len(model.floors), m), many) + model.owners[entry]
            gains = np.bincount(cell, model.gains[entry], (hi - lo) * len(model.floors))
            out[lo:hi, :-1] += m[:, None] * model.floors + gains.reshape(hi - lo, -1)
            out[lo:hi, -1] += letters[np.clip(own[1:] - at, 0, len(letters) - 1)] - letters[np.clip(own[:-1] - at, 0, len(letters) - 1)]
    n = np.diff(offsets) - 2
    out[:, :-1] *= (np.minimum(n, FULL) / np.maximum(n, 1) * (n > 0))[:, None]
    out[:, -1] = out[:, -1] > 0
    return out


def fit(docs: DataFrame, lang_col: str, text_col: str, id_col: str, per_language: int = 400) -> Model:
    """Trigram models of all languages that lang_col names, each from the per_language rows with the least hash of their ids.

    A language takes some ten bytes of each process's memory for each different trigram of its sample.
    """
    small_batches(docs.sparkSession)
    named = docs.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != "")).select(F.col(lang_col).alias("_l"), F.col(id_col).alias("_i"))
    languages = sorted(r[0] for r in named.select("_l").distinct().collect())
    taken = named.withColumn("_o", F.xxhash64(F.col("_i").cast("string"), F.lit("language")))
    # The least of each of 64 shares of a language, so that a common one is not one task's, then the least of those.
    for by in (["_l", F.pmod("_o", F.lit(64))], ["_l"]):
        taken = taken.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_o", "_i"))).where(F.col("_n") <= per_language).drop("_n")
    taken = taken.select("_i", "_l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(_codes(np.frombuffer((text or "").encode(), np.uint8)), minlength=CODES)
                counts[name] = counts[name] + found if name in counts else found
        for name, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(c[at].astype(np.int64))], names=["l", "code", "n"])

    rows = docs.join(F.broadcast(taken.distinct()), F.col(id_col) == F.col("_i")).select("_l", text_col)  # per_language ids a language
    got = rows.mapInArrow(run, "l string, code long, n long").groupBy("l", "code").agg(F.sum("n").alias("n")).toArrow()  # what the samples have, CODES rows a language at most
    name = pa.compute.index_in(got.column("l"), pa.array(languages, pa.string())).to_numpy()
    code, n = got.column("code").to_numpy(), got.column("n").to_numpy()
    order = np.lexsort((name, code))
    totals = np.bincount(name, n, len(languages)) if languages else np.zeros(0)
    floors = np.append(np.log(UNSEEN / (totals + UNSEEN * CODES)), -np.log(CODES))
    return Model([*languages, UNKNOWN], floors, np.searchsorted(code[order], np.arange(CODES + 1)), name[order].astype(np.int32), np.log1p(n[order] / UNSEEN))


def text_evidence(spark: SparkSession, text: Column, model: Model) -> Column:
    """The tempered log likelihoods of a text (null: no letters)."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def evidence(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            found = likelihoods(texts, held.value)
            yield pa.array([x[:-1].tolist() if x[-1] else None for x in found], pa.list_(pa.float64()))
        release()

    return evidence.asNondeterministic()(text)  # so that a filter on it does not score texts once more


def _best(scores: Column) -> Column:
    """Number of the largest of an array, from 0."""
    return F.array_position(scores, F.array_max(scores)) - 1


def _levels(host: Column, suffix: Column) -> list[Column]:
    """Names of a host's levels, from all rows down to the host."""
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    return [F.lit("*"), F.concat(F.lit("s:"), suffix), F.concat(F.lit("d:"), domain), F.concat(F.lit("h:"), host)]


def priors(told: DataFrame, n: int) -> DataFrame:
    """host, suffix, prior: log priors of every host, from host, suffix, said (number of the language that the text says) and n, how often."""
    counts = told.groupBy("host", "suffix", "said").agg(F.sum("n").alias("n"))
    hosts = counts.select("host", "suffix").distinct()
    names = _levels(F.col("host"), F.col("suffix"))
    for k, name in enumerate(names):
        # A row for each language that a level has, then one for the level.
        level = counts.groupBy(name.alias("level"), "said").agg(F.sum("n").cast("double").alias("n"))
        level = level.groupBy("level").agg(F.map_from_entries(F.collect_list(F.struct("said", "n"))).alias("c"), F.sum("n").alias("_total"))
        share, shares = F.lit(0), F.array(F.lit(0))
        if k < 2:  # few levels, of very many hosts each
            share, shares = F.pmod(F.xxhash64("host"), F.lit(SHARES)).cast("int"), F.sequence(F.lit(0), F.lit(SHARES - 1))
        level = level.select("*", F.explode(shares).alias("share"))
        hosts = hosts.select("*", name.alias("level"), share.alias("share")).join(level, ["level", "share"]).drop("level", "share")
        pull = F.lit(PULL if k else 1.0)
        below = F.col("_prior") if k else F.array_repeat(F.lit(1.0 / n), n)
        fused = F.transform(below, lambda p, i: (F.coalesce(F.element_at("c", i), F.lit(0.0)) + pull * p) / (F.col("_total") + pull))  # noqa: B023
        hosts = hosts.withColumn("_prior", fused).drop("c", "_total")
    return hosts.select("host", "suffix", F.transform("_prior", lambda p: F.log(p)).alias("prior"))


def identify(rows: DataFrame, model: Model, text_col: str, host: Column, suffix: Column, declared: Column, least: float = 0.5, keep: list[str] | None = None, once: bool | None = None) -> DataFrame:
    """Columns keep of rows (all of them), with language, confidence, accepted.

    host, suffix and declared are expressions over rows; null where there is no such evidence. A
    row is accepted if a language has a posterior of `least` or more. A null or empty text, or one
    without letters, is `und` with confidence 0 and not accepted, whatever the other evidence says.
    Equal rows get equal results. An empty table gives no rows. Columns may have any names; those
    named like the three new ones are replaced. Texts are not shuffled. once: each text is scored once
    and what keep names is written to the checkpoint folder with its few numbers, as is meant where
    keep leaves the text out; else a text is scored for the counts and once more.
    """
    n, names, wanted = len(model.languages), F.array(*[F.lit(x) for x in model.languages]), rows.columns if keep is None else keep
    primary = F.lower(F.regexp_extract(F.trim(declared), "^([A-Za-z]+)", 1))
    said = F.when(declared.isNull() | (primary == ""), -1).otherwise(F.coalesce(F.nullif(F.array_position(names, primary), F.lit(0)) - 1, F.lit(n))).cast("int")
    row = F.struct(*(F.col(f"`{c}`") for c in wanted)).alias("row")
    evidence = text_evidence(rows.sparkSession, F.col(text_col), model)
    rows = rows.select(row, F.coalesce(F.lower(host), F.lit("")).alias("host"), F.coalesce(F.lower(suffix), F.lit("")).alias("suffix"), said.alias("declared"), evidence.alias("text"))
    if once if once is not None else text_col not in wanted:
        rows = cut(rows)
    told = rows.where("text is not null").select("host", "suffix", "declared", _best(F.col("text")).cast("int").alias("said"))
    told = cut(told.groupBy("host", "suffix", "declared", "said").agg(F.count("*").alias("n")))
    known = cut(priors(told, n).toDF("_host", "_suffix", "prior"))
    known = F.broadcast(known) if known.count() <= FEW else known
    # P(declared | language), from n * (n + 1) counts; declarations are right before any count.
    table = np.full((n + 1, n), 0.5)
    table[np.arange(n), np.arange(n)] += 20
    for r in told.where("declared >= 0").groupBy("declared", "said").agg(F.sum("n").alias("n")).collect():
        table[r.declared, r.said] += r.n
    table = np.log(table / table.sum(0))
    declarations = F.from_json(F.lit(str([[0.0] * n, *table.tolist()])), "array<array<double>>")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    out = rows.join(known, (F.col("host") == F.col("_host")) & (F.col("suffix") == F.col("_suffix")), "left")
    out = out.select("row", add(add(F.col("text"), F.col("prior")), F.element_at(declarations, F.col("declared") + 2)).alias("score"))
    out = out.withColumn("top", F.array_max("score"))
    confidence = 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    language = F.element_at(names, F.array_position("score", F.col("top")).cast("int"))
    found = {"language": F.coalesce(F.when(F.col("top").isNotNull(), language), F.lit(UNKNOWN)), "confidence": F.coalesce(F.when(F.col("top").isNotNull(), confidence), F.lit(0.0))}
    out = out.withColumns(found).withColumn("accepted", (F.col("language") != UNKNOWN) & (F.col("confidence") >= least))
    new = ["language", "confidence", "accepted"]
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in wanted if c not in new), *new)
