"""Queries of the training-data operators, as registered in __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import dialogue, language, manifest, merkle
from ridgeline.llm.ann import nearest
from ridgeline.llm.licences import scan
from ridgeline.llm.line_dedup import line_dedup
from ridgeline.llm.mixing import mix
from ridgeline.llm.near_dedup import near_duplicates
from ridgeline.llm.packing import pack
from ridgeline.llm.pages import article_texts, extract
from ridgeline.llm.quality import quality
from ridgeline.llm.toxicity import toxicity
from ridgeline.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), top=5)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, whose source stands for the host, and pages, with what their markup and address say."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language.fit(docs, "lang", "text", "doc_id")
    nothing = F.lit(None).cast("string")
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.concat(F.lit("source:"), "source").alias("host"), nothing.alias("suffix"), nothing.alias("declared"))
    found = article_texts(pages)
    host = F.regexp_extract(F.lower("url"), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)
    rows = rows.union(found.select(F.lit(None).cast("long"), "page_id", "text", host, F.substring_index(host, ".", -1), "declared"))
    return language.identify(rows, model, "text", F.col("host"), F.col("suffix"), F.col("declared"), keep=["doc_id", "page_id"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "begun")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), ids=False)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.checked(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.checked(table(spark, sf_dir, "conversations"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op3_fingerprints": merkle.ORACLE, "op11_manifest": manifest.ORACLE, "op12_conversations": dialogue.ORACLE}
