"""Joins of rows that share a key, in bounded pieces however many rows a key has.

A hot key's rows are dealt to blocks of a bounded size. Within one table the pairs
of blocks form a triangle, between two tables a grid; each pair of blocks is a key of
its own, so it is a bounded part of a task. Only hot keys are sent to more than one
place, as often as they have blocks, and there are fewer of them than blocks in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 1024
#: So many hot keys are broadcast at most; more are joined.
MOST_HOT = 100_000


def _blocks(rows: DataFrame, hot: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    hot = F.broadcast(hot) if hot.limit(MOST_HOT + 1).count() <= MOST_HOT else hot
    return rows.join(hot, keys, "left").withColumns({n: F.coalesce(n, F.lit(1)) for n in names})


def _struct(rows: DataFrame, keys: list[str], name: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in keys]).alias(name)


#: Bits of a table of hashes.
BITS = 1 << 24


def maybe_among(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The rows whose col may be among those of keys, by a broadcast table of BITS bits: none is lost, a few others stay."""
    slot = F.pmod(F.xxhash64(col), F.lit(BITS)) + 1
    table = keys.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))
    own = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(table), "_bucket")
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return own.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*[f"`{c}`" for c in rows.columns])


def pairs_within(rows: DataFrame, keys: list[str], ident: str, block: int = BLOCK) -> DataFrame:
    """(keys, a, b): structs of all pairs of rows that agree in keys, a's ident below b's. Null keys and idents pair with nothing, equal idents don't either."""
    hot = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n")).filter("_n > 1")
    some = hot.limit(MOST_HOT + 1).count()
    hot = F.broadcast(hot) if some <= MOST_HOT else hot
    dealt = rows.join(hot, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_i", F.pmod(F.xxhash64(ident), F.col("_n")).cast("int"))
    own = [F.col(f"`{k}`") for k in keys]
    # of two blocks the lower one's rows stand on the left, so each pair of rows meets once
    left = dealt.select(*own, F.col("_i").alias("_x"), F.explode(F.sequence(F.col("_i"), F.col("_n") - 1)).alias("_y"), _struct(rows, keys, "a"))
    right = dealt.select(*own, F.explode(F.sequence(F.lit(0), F.col("_i"))).alias("_x"), F.col("_i").alias("_y"), _struct(rows, keys, "b"))
    if some:  # partitions of few bytes make many pairs, so they aren't put together by their size
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        left, right = (side.repartition(parts, *own, "_x", "_y") for side in (left, right))
    below = F.col(f"a.{ident}") < F.col(f"b.{ident}")
    apart = below | ((F.col("_x") != F.col("_y")) & (F.col(f"a.{ident}") != F.col(f"b.{ident}")))
    met = left.join(right, [*keys, "_x", "_y"]).filter(apart)
    return met.select(*keys, F.when(below, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(below, F.col("b")).otherwise(F.col("a")).alias("b"))


def met_between(left: DataFrame, right: DataFrame, keys: list[str], left_ident: str, right_ident: str, block: int = BLOCK) -> DataFrame:
    """(keys, a, b): structs of all pairs of a left and a right row that agree in keys."""
    size = lambda rows, n: rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n))
    hot = size(left, "_n").join(size(right, "_m"), keys).filter("_n * _m > 1")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda ident, n: F.pmod(F.xxhash64(ident), F.col(n)).cast("int")
    own = [F.col(f"`{k}`") for k in keys]
    a = _blocks(left, hot, keys, ["_n", "_m"]).withColumn("_x", place(left_ident, "_n")).withColumn("_y", spread("_m")).select(*own, "_x", "_y", _struct(left, keys, "a"))
    b = _blocks(right, hot, keys, ["_n", "_m"]).withColumn("_y", place(right_ident, "_m")).withColumn("_x", spread("_n")).select(*own, "_x", "_y", _struct(right, keys, "b"))
    return a.join(b, [*keys, "_x", "_y"]).select(*keys, "a", "b")
