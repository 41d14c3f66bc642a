"""The given tables, and archive records made of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as archive records: (ord, id, provider, archive_id, source_url, title, text, relation_tags)."""
    # the ninth part is the rest of the text, which isn't split
    title = F.array_join(F.slice(F.split("text", r"\s+", 9), 1, 8), " ")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("doc:"), "source", F.lit(":"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("provider"),
        F.col("doc_id").cast("string").alias("archive_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("source_url"),
        title.alias("title"),
        "text",
        F.array("lang", "source").alias("relation_tags"),
    )
