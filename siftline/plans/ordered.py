"""Sums and positions along an order of all rows, without a task that sees them all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saver


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, str], save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with a column for each of sums (new name: summed column): its sum over all rows that come before in ascending order.

    Rows are dealt to ranges of the order and written once; the sums of ranges,
    a row each, are added up and sent back to the rows, which add them to the
    sums inside their own range. Rows that agree in the whole order fall in one
    range, so aggregate them first if they can be many. Nulls of the order come
    first, nulls of summed columns count as 0.
    """
    part = f"part_{uuid.uuid4().hex[:8]}"
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn(part, F.spark_partition_id())
    ranged = (save or saver(rows.sparkSession))(ranged)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(part).agg(*[F.sum(c).alias(f"{part}_{name}") for name, c in sums.items()])
    carried = totals.select(part, *[F.coalesce(F.sum(f"{part}_{name}").over(before), F.lit(0)).alias(f"{part}_{name}") for name in sums])
    inside = Window.partitionBy(part).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    own = {name: F.col(f"{part}_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}
    return ranged.join(F.broadcast(carried), part).select(*rows.columns, *[c.alias(name) for name, c in own.items()])


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = (), save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Exact quantiles of value in each group (by), or over all rows, by linear interpolation: a column for each of shares, and n, the count of values.

    Values are counted first, so ranges are of distinct values; the two values
    around a quantile's place are those whose running counts enclose it. No group
    is sorted in one task. Null values don't count; a group of nulls alone is left
    out, and without any value a single row of nulls with n 0 is given where there
    is no by. Groups of null keys are groups.
    """
    used = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    counted = used.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = running_sums(counted, [*by, "_v"], {"_before": "_c"}, save)
    groups = placed.groupBy(*by).agg(F.min("_before").alias("_first"), F.sum("_c").alias("n"))
    if by:
        own = groups.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], "_first", "n")
        same = F.lit(True)
        for i, b in enumerate(by):
            same = same & placed[b].eqNullSafe(own[f"_g{i}"])
        found = placed.join(own, same)
    else:
        found = placed.crossJoin(F.broadcast(groups))
    at = F.col("_before") - F.col("_first")
    held = lambda place: F.max(F.when((at <= place) & (place < at + F.col("_c")), F.col("_v").cast("double")))
    place = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    ends = {name: (held(F.floor(p)), held(F.ceil(p))) for name, p in place.items()}
    out = found.groupBy(*by).agg(F.max("n").alias("n"), *[e.alias(f"_{side}_{name}") for name, both in ends.items() for side, e in zip(("low", "high"), both, strict=True)])

    def between(name: str, q: float):
        p = F.lit(q) * (F.col("n") - 1)
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return F.when(F.floor(p) == F.ceil(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return out.select(*by, F.coalesce("n", F.lit(0)).alias("n"), *[between(name, q).alias(name) for name, q in shares.items()])
