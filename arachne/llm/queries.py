"""One query for each training-data operator, with its parameters, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arachne.llm import decontaminate, html_text, licenses, near_dup, packing, pii, quality, token_counts, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The file of the 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.jaccard_components(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_index(*warc.write_archive(table(spark, sf_dir, "pages")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(pages, urls.repeated_urls(pages))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_warc, op3_best_fit_packing, op4_quality_rules, op5_token_counts, op6_html_extraction, op7_benchmark_decontamination, op8_url_filters, op9_pii, op10_license_scans)}
ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": near_dup.ORACLE, "op2_warc": warc.ORACLE, "op4_quality_rules": quality.ORACLE, "op6_html_extraction": html_text.ORACLE, "op7_benchmark_decontamination": decontaminate.ORACLE, "op8_url_filters": urls.oracle(), "op9_pii": pii.ORACLE}
