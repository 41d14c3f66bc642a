"""Places on a sphere as Column expressions, and nulls by simulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth in kilometres.
RADIUS = 6371.0088


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def cap_probability(km: float) -> float:
    """Share of a sphere within km of a point."""
    import math

    return (1 - math.cos(km / RADIUS)) / 2


def cap_null(spark: SparkSession, lat: float, lon: float, km: float, n: int, seed: int = 0) -> DataFrame:
    """One row (n, hits, p, se, analytic): uniform points on the sphere that fall within km of a place."""
    points = spark.range(n).select(F.degrees(F.asin(2 * F.rand(seed) - 1)).alias("lat"), (F.rand(seed + 1) * 360 - 180).alias("lon"))
    hit = (great_circle_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= km).cast("int")
    out = points.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"))
    p = F.col("hits") / F.col("n")
    return out.select("n", "hits", p.alias("p"), F.sqrt(p * (1 - p) / F.col("n")).alias("se"), F.lit(cap_probability(km)).alias("analytic"))


def digest_null(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(hamming, n): how far apart the digests of n random pairs are."""
    from siftline.functions.hashing import hex_hamming

    pairs = spark.range(n).select(F.sha2(F.rand(seed).cast("string"), 256).alias("a"), F.sha2(F.rand(seed + 1).cast("string"), 256).alias("b"))
    return pairs.select(hex_hamming(F.col("a"), F.col("b")).alias("hamming")).groupBy("hamming").agg(F.count(F.lit(1)).alias("n"))
