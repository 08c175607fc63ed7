"""The corpus pipeline: language ID, line dedup, near dedup, mixing to target weights, packing.

Each stage takes the documents that the one before kept, written as Parquet and read again, and
returns documents with the same columns; the last returns packed pieces. A null text is one without
words: the first stage rejects it, as it rejects empty texts. Rows that repeat an id and text are
told apart nowhere: a stage keeps or drops them alike, and the mix takes each. A null id comes
first where order counts. Further columns are carried along, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import language
from ridgeline.llm.line_dedup import line_dedup
from ridgeline.llm.mixing import mixed
from ridgeline.llm.near_dedup import near_duplicates
from ridgeline.llm.packing import pack
from ridgeline.session import checkpoint_dir

#: Registers and bands of sketches and the likelihoods of text have no SQL.
ORACLE_SQL = None


def _whole(docs: DataFrame):
    """A row of documents as one column, so that no name in it meets those of an operator."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def _columns(docs: DataFrame, new: dict | None = None) -> list:
    """The columns of documents from such a row, some of them new."""
    return [(new or {}).get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known from the text and the habits of their source."""
    model = language.fit(docs, "lang", "text", "doc_id")
    nothing = F.lit(None).cast("string")
    rows = docs.select(_whole(docs), "text", F.concat(F.lit("source:"), F.col("source")).alias("host"))
    told = language.identify(rows, model, "text", F.col("host"), nothing, nothing, keep=["row"], once=False)
    return told.where("accepted").select(_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; those of which nothing is left go."""
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    out = line_dedup(docs.select("doc_id", "text", rest))
    changed = F.col("lines_deleted") > 0
    out = out.where(~changed | (F.length(F.trim(F.col("text"))) > 0))
    return out.select(_columns(docs, {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Runs of five words, similarity of 0.8."""
    kept = near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept"), "text_hash").distinct()
    rows = docs.select(_whole(docs), F.xxhash64("text").alias("hash"))
    own = F.col("row.doc_id").eqNullSafe(F.col("_kept")) & (F.col("hash") == F.col("text_hash"))
    return rows.join(kept, own, "left_semi").select(_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as their source's target takes them."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, placed in sequences of 2048."""
    return pack(docs, keep=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is kept in the checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
