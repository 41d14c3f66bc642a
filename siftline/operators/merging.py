"""Which version of a record stays: latest, last, merged, canonical; publications and their lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.text import normalize_doi


def _best(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def dedup_latest(rows: DataFrame, key: str, updated: str, ordinal: str) -> DataFrame:
    """Per key the row with the greatest update text; ties go to the later row. A missing update is the least."""
    return _best(rows, [key], F.coalesce(F.col(updated).cast("string"), F.lit("")).desc(), F.col(ordinal).desc())


def dedup_last(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Per key the last row. Null keys are a key of their own."""
    return _best(rows, keys, F.col(ordinal).desc())


def merge_records(prior: DataFrame, current: DataFrame, key: str, ordinal: str) -> DataFrame:
    """prior and current as one; current wins, within a batch the later row."""
    both = prior.withColumn("_b", F.lit(0)).unionByName(current.withColumn("_b", F.lit(1)), allowMissingColumns=True)
    return _best(both, [key], F.col("_b").desc(), F.col(ordinal).desc()).drop("_b")


def publication_key(doi: Column, title: Column, first_author: Column, ident: Column) -> Column:
    """The normalised DOI, else normalised title and first author, else the id."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))
    by_title = F.when((plain != "") & first_author.isNotNull(), F.concat(F.lit("title:"), plain, F.lit("|"), F.lower(first_author)))
    return F.coalesce(F.concat(F.lit("doi:"), normalize_doi(doi)), by_title, F.concat(F.lit("id:"), ident.cast("string")))


def dedupe_publications(rows: DataFrame) -> DataFrame:
    """One row per publication: rows (id, doi, title, first_author, score, updated, families).

    The row of the highest (score, updated, id) of a publication_key() stands for
    all; families are merged and the highest score is kept, so copies earn credit
    once. A publication's families are distinct before they meet.
    """
    keyed = rows.withColumn("key", publication_key(F.col("doi"), F.col("title"), F.col("first_author"), F.col("id")))
    best = keyed.groupBy("key").agg(F.max_by("id", F.struct("score", "updated", "id")).alias("id"), F.max("score").alias("score"), F.count(F.lit(1)).alias("versions"))
    named = keyed.select("key", F.explode("families").alias("family")).groupBy("key").agg(F.array_sort(F.collect_set("family")).alias("families"))
    return best.join(named, "key", "left").withColumn("families", F.coalesce("families", F.array().cast("array<string>")))


def lineage_edges(records: DataFrame) -> DataFrame:
    """(a, b): each record with the last record that owns its parent URL."""
    owner = records.filter("source_url is not null").groupBy("source_url").agg(F.max_by("id", "ord").alias("b"))
    return records.select(F.col("id").alias("a"), F.col("parent_url").alias("source_url")).filter("source_url != ''").join(owner, "source_url").select("a", "b")
