"""Exposure statistics: nightly roll-ups, rate ratios, exact shift and permutation tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nightly(rows: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.8)) -> DataFrame:
    """Per date: candidates, summed score, and how many reach each threshold. rows: (date, score)."""
    over = [F.count_if(F.col("score") >= t).alias(f"n_{int(t * 100)}") for t in thresholds]
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("weighted"), *over)


def range_violations(rows: DataFrame) -> DataFrame:
    """Rows whose score isn't finite or lies outside [0, 1], with the reason; nothing is clipped."""
    s = F.col("score")
    why = F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), "NOT_FINITE").when((s < 0) | (s > 1), "OUT_OF_RANGE")
    return rows.withColumn("reason", why).filter("reason is not null")


def day_index(date: Column, first: Column) -> Column:
    return F.datediff(date, first)


def exposed_days(events: DataFrame, width: int, n: Column | int) -> DataFrame:
    """(day): distinct day indexes within width days of any event, on a circle of n days."""
    near = F.explode(F.sequence(F.lit(-width), F.lit(width)))
    return events.select("day", near.alias("d")).select(F.pmod(F.col("day") + F.col("d"), F.lit(n)).alias("day")).distinct()


def rate_ratio(days: DataFrame, exposed: DataFrame, outcome: str, opportunity: str) -> DataFrame:
    """One row: exposed and unexposed sums, their rates and ratio. An unexposed rate of 0 gives an infinite ratio, no opportunity gives null."""
    both = days.join(exposed.withColumn("e", F.lit(1)), "day", "left")
    hit = F.col("e").isNotNull()
    sums = both.agg(*[F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).cast("double").alias(a) for a, c, v in (("eo", hit, outcome), ("en", hit, opportunity), ("uo", ~hit, outcome), ("un", ~hit, opportunity))])
    ratio = F.when((F.col("en") <= 0) | (F.col("un") <= 0), None).when(F.col("uo") == 0, F.lit(float("inf"))).otherwise(F.col("eo") / F.col("en") / (F.col("uo") / F.col("un")))
    return sums.withColumn("ratio", ratio)


def shift_table(days: DataFrame, events: DataFrame, width: int, n: int, outcome: str, opportunity: str) -> DataFrame:
    """(shift, ratio) for all n circular shifts of the events.

    Only exposed sums are added up per shift; unexposed ones are totals minus them.
    """
    shifts = days.sparkSession.range(n).select(F.col("id").alias("shift"))
    near = F.explode(F.sequence(F.lit(-width), F.lit(width))).alias("d")
    hit = shifts.crossJoin(F.broadcast(events.select("day", near))).select("shift", F.pmod(F.col("day") + F.col("shift") + F.col("d"), F.lit(n)).alias("day")).distinct()
    sums = hit.join(days.select("day", F.col(outcome).alias("o"), F.col(opportunity).alias("n")), "day").groupBy("shift").agg(F.sum("o").alias("eo"), F.sum("n").alias("en"))
    total = days.agg(F.sum(outcome).alias("to"), F.sum(opportunity).alias("tn"))
    both = sums.crossJoin(F.broadcast(total)).select("shift", "eo", "en", (F.col("to") - F.col("eo")).alias("uo"), (F.col("tn") - F.col("en")).alias("un"))
    return both.filter("en > 0 and un > 0").select("shift", F.when(F.col("uo") == 0, F.lit(float("inf"))).otherwise((F.col("eo") / F.col("en")) / (F.col("uo") / F.col("un"))).alias("ratio"))


def shift_test(ratios: DataFrame) -> DataFrame:
    """(shifts, observed, p_upper, p_two_sided): shift 0 counts itself; two sides by distance of logs from the null's median."""
    own = ratios.filter("shift = 0").select(F.col("ratio").alias("observed"))
    rows = ratios.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(ratios.agg(F.percentile("ratio", 0.5).alias("mid"))))
    far = lambda c: F.abs(F.log(F.greatest(F.col(c), F.lit(1e-12))) - F.log(F.greatest(F.col("mid"), F.lit(1e-12))))
    return rows.agg(F.count(F.lit(1)).alias("shifts"), F.max("observed").alias("observed"), F.avg((F.col("ratio") >= F.col("observed")).cast("int")).alias("p_upper"), F.avg((far("ratio") >= far("observed") - 1e-12).cast("int")).alias("p_two_sided"))


def exact_permutation(values: DataFrame, n: int, k: int) -> DataFrame:
    """One-sided p of the first group's mean over all C(n, k) assignments. values: (pos 0..n-1, value, first: boolean), n at most 24."""
    if n > 24:
        raise ValueError("exact permutation takes at most 24 values")
    masks = values.sparkSession.range(2**n).filter(F.bit_count("id") == k)
    sums = masks.crossJoin(F.broadcast(values)).groupBy("id").agg(F.sum(F.when(F.expr("(id >> pos) & 1 = 1"), F.col("value")).otherwise(0)).alias("s"))
    own = values.filter("first").agg(F.sum("value").alias("own"))
    return sums.crossJoin(F.broadcast(own)).agg(F.count(F.lit(1)).alias("assignments"), F.avg((F.col("s") >= F.col("own") - 1e-12).cast("int")).alias("p"))


def evaluate_cohort(days: DataFrame, exposed: DataFrame, outcomes: list[str], opportunity: str) -> DataFrame:
    """(outcome, eo, en, uo, un, ratio) of several outcomes in one pass over the days."""
    long = days.select("day", opportunity, F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("v")) for o in outcomes])).alias("x")).select("day", opportunity, "x.outcome", "x.v")
    hit = F.col("e").isNotNull()
    both = long.join(exposed.withColumn("e", F.lit(1)), "day", "left").groupBy("outcome")
    sums = both.agg(*[F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0.0)).alias(a) for a, c, v in (("eo", hit, "v"), ("en", hit, opportunity), ("uo", ~hit, "v"), ("un", ~hit, opportunity))])
    return sums.withColumn("ratio", F.when((F.col("en") <= 0) | (F.col("un") <= 0), None).when(F.col("uo") == 0, F.lit(float("inf"))).otherwise(F.col("eo") / F.col("en") / (F.col("uo") / F.col("un"))))


def harmonize(rows: DataFrame, cohort: str) -> DataFrame:
    """Rows on dates that every cohort has. rows: (date, cohort column, ...)."""
    k = rows.agg(F.countDistinct(cohort).alias("k"))
    common = rows.groupBy("date").agg(F.countDistinct(cohort).alias("c")).crossJoin(F.broadcast(k)).filter("c = k").select("date")
    return rows.join(common, "date", "left_semi")


def harmonized(days: DataFrame, exposed: DataFrame, outcomes: list[str], opportunity: str) -> DataFrame:
    """(scope, cohort, outcome, eo, en, uo, un, ratio): each cohort on all its days, then all again on the days that every cohort has.

    days: (cohort, day, opportunity, outcomes), a row for each day of a cohort.
    """
    whole = days.withColumn("scope", F.lit("ALL")).unionByName(harmonize(days.withColumnRenamed("day", "date"), "cohort").withColumnRenamed("date", "day").withColumn("scope", F.lit("COMMON")))
    cell = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("v")) for o in outcomes])).alias("x")
    long = whole.select("scope", "cohort", "day", opportunity, cell).select("scope", "cohort", "day", opportunity, "x.outcome", "x.v")
    hit = F.col("e").isNotNull()
    both = long.join(exposed.withColumn("e", F.lit(1)), "day", "left").groupBy("scope", "cohort", "outcome")
    sums = both.agg(*[F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0.0)).alias(a) for a, c, v in (("eo", hit, "v"), ("en", hit, opportunity), ("uo", ~hit, "v"), ("un", ~hit, opportunity))])
    return sums.withColumn("ratio", F.when((F.col("en") <= 0) | (F.col("un") <= 0), None).when(F.col("uo") == 0, F.lit(float("inf"))).otherwise(F.col("eo") / F.col("en") / (F.col("uo") / F.col("un"))))
