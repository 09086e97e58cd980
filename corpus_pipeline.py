"""A training corpus from raw documents, in five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arachne.llm import decontaminate, near_dup, packing, pii, quality
from arachne.llm import shared as S
from arachne.llm.queries import table, vocabulary

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Each row is judged by its own text: null, empty and too short ones go, very long ones are read whole, and repeated or null ids are no matter."""
    return quality.keep_documents(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact or near copies one row: that with the smallest id, null ids last.

    Rows are told apart by a number of their own, so of rows that repeat an id each is judged by its text, and rows with
    a null id take part. Texts without words are copies of nothing and stay; very long ones are compared whole; of rows
    that tie, one is kept; an empty table stays empty.
    """
    row = S.unused(docs, "row")
    rows = S.saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = S.saved(near_dup.jaccard_components(rows, row), "groups").select(F.col(row).alias("r"), "component_id")
    copied = groups.where("r <> component_id").select("component_id").distinct()
    members = groups.join(copied, "component_id", "left_semi").join(rows.select(F.col(row).alias("r"), F.col("doc_id").alias("id")), "r")
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r")).alias("kept"))
    drop = S.saved(members.join(kept, "component_id").where("r <> kept.r").select(F.col("r").alias(row)), "copies")
    return rows.join(S.maybe_broadcast(drop, drop.count()), row, "left_anti").select(docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks; each row is judged by its own whole text."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their whole texts replaced by its kind, n_chars counted again; a null text stays null."""
    out = pii.redact_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; see packing.pack_documents for its cases."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate_benchmark),
    ("pii", redact_personal_data),
    ("best-fit packing", pack),
]

#: Tokenisation and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        docs, at = S.write_out(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        S.remove(spark, *before)
        before = (at,)
    return docs
