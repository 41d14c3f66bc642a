"""Context of a subject in long form: observations, facet status, coverage, merges and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import matches

#: Facets and fields that extraction can fill.
REGISTRY = (("time", "year"), ("time", "iso_date"), ("time", "clock"), ("place", "latitude"), ("place", "longitude"), ("origin", "source"), ("origin", "language"))
_PATTERNS = {("time", "year"): r"(?<![0-9])(?:18|19|20)[0-9]{2}(?![0-9])", ("time", "iso_date"): r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])", ("time", "clock"): r"(?<![0-9:])(?:[01][0-9]|2[0-3]):[0-5][0-9](?![0-9:])"}
_PAIR = r"(-?[0-9]{1,2}\.[0-9]+)\s*,\s*(-?[0-9]{1,3}\.[0-9]+)"


def observations(rows: DataFrame, pass_id: str, facets: tuple[str, ...] | None = None) -> DataFrame:
    """(subject, facet, field, value, source_ref, signature, pass_id, ord) from rows (subject, ord, text, source, lang); of some facets alone, where named."""
    base = rows.select("subject", "ord", F.col("source").alias("source_ref"), "text", "source", "lang")
    none = F.array().cast("array<string>")
    lat, lon = F.regexp_extract("text", _PAIR, 1), F.regexp_extract("text", _PAIR, 2)
    ok = (lat != "") & (F.abs(lat.try_cast("double")) <= 90) & (F.abs(lon.try_cast("double")) <= 180)
    found = {k: F.array_distinct(matches(F.col("text"), p)) for k, p in _PATTERNS.items()}
    found |= {("place", "latitude"): F.when(ok, F.array(lat)).otherwise(none), ("place", "longitude"): F.when(ok, F.array(lon)).otherwise(none), ("origin", "source"): F.array("source"), ("origin", "language"): F.array("lang")}
    # a filter on the facet would come after all texts were searched
    values = [F.struct(F.lit(f).alias("facet"), F.lit(n).alias("field"), c.alias("values")) for (f, n), c in found.items() if facets is None or f in facets]
    long = base.select("subject", "ord", "source_ref", F.explode(F.array(*values)).alias("x")).select("subject", "ord", "source_ref", "x.facet", "x.field", F.explode("x.values").alias("value")).filter("value is not null")
    sig = F.sha2(F.concat_ws("|", "subject", "facet", "field", "value", "source_ref"), 256)
    return long.withColumn("signature", sig).withColumn("pass_id", F.lit(pass_id))


def coverage(obs: DataFrame, subjects: DataFrame, registry: DataFrame) -> DataFrame:
    """(subject, facet, known, fields, status): how many fields of each facet are filled."""
    want = registry.groupBy("facet").agg(F.countDistinct("field").alias("fields"))
    have = obs.groupBy("subject", "facet").agg(F.countDistinct("field").alias("known"))
    rows = subjects.select("subject").distinct().crossJoin(F.broadcast(want)).join(have, ["subject", "facet"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("known") == 0, "MISSING").when(F.col("known") < F.col("fields"), "PARTIAL").otherwise("COMPLETE"))


def merge(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations to add, conflicts): unseen signatures, and those whose value differs from one known before them.

    Values are never averaged. Arrival counts: a new row also conflicts with
    earlier new rows of its field.
    """
    fresh = new.join(existing.select("signature"), "signature", "left_anti").dropDuplicates(["signature"])
    cols = ["subject", "facet", "field", "value", "ord"]
    known = existing.select(*cols).withColumn("_b", F.lit(0)).unionByName(fresh.select(*cols).withColumn("_b", F.lit(1)))
    k = known.select("subject", "facet", "field", F.col("value").alias("other"), F.struct("_b", "ord").alias("_o"))
    n = fresh.select("subject", "facet", "field", "value", F.struct(F.lit(1).alias("_b"), "ord").alias("_n"))
    clash = n.join(k, ["subject", "facet", "field"]).filter((F.col("value") != F.col("other")) & (F.col("_o") < F.col("_n")))
    return fresh, clash.select("subject", "facet", "field", "value", "other").distinct()


def receipt(coverage: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One row (subjects, complete, partial, missing, tasks, conflicts): facets by status; each facet that lacks a field is a task."""
    by = lambda s: F.count_if(F.col("status") == s)
    facets = coverage.agg(F.countDistinct("subject").alias("subjects"), by("COMPLETE").alias("complete"), by("PARTIAL").alias("partial"), by("MISSING").alias("missing"), F.count_if(F.col("known") < F.col("fields")).alias("tasks"))
    return facets.crossJoin(conflicts.agg(F.count(F.lit(1)).alias("conflicts")))
