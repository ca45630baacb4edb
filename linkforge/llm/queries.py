"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkforge.llm import chatpref, decontam, html_extract, licenses, mixing, quality, secrets, sharding, simhash, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": lambda s, d: sharding.shard_documents(table(s, d, "documents"), 16),
        "op2_warc": lambda s, d: warc.round_trip(table(s, d, "pages")),
        "op3_decontamination": lambda s, d: decontam.contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_html_extraction": lambda s, d: html_extract.extract(table(s, d, "pages")),
        "op5_quality_rules": lambda s, d: quality.quality_report(table(s, d, "documents")),
        "op6_chat_preference": lambda s, d: chatpref.neighbours(table(s, d, "conversations")),
        "op7_mixing": lambda s, d: mixing.mix(table(s, d, "documents")),
        "op8_secret_scan": lambda s, d: secrets.scan(table(s, d, "documents")),
        "op9_license_scan": lambda s, d: licenses.license_report(table(s, d, "documents")),
        "op10_simhash": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle(16), "op2_warc": warc.ORACLE_SQL, "op5_quality_rules": quality.oracle(), "op6_chat_preference": chatpref.ORACLE_SQL}
