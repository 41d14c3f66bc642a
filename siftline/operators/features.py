"""Feature rails: checked joins, sidecar audits, labels, folds, review samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.hashing import fold
from siftline.plans.ordered import quantiles

#: Names, and parts of a name, that give the label away.
LEAKS = (
    "plate_id", "date_obs", "obs_date", "group_id", "nuclear_window",
    "nuclear_test", "nuclear_event", "harmonization_outcome", "effect_p_value",
    "uap", "nhi", "label", "target", "ground_truth",
)
LEAK_PARTS = (
    "nuclear_", "atomic_test", "bomb_test", "detonation_", "harmonization_",
    "uap_", "nhi_", "outcome_",
)


def guard_names(names: list[str], exact: tuple[str, ...] = LEAKS, parts: tuple[str, ...] = LEAK_PARTS) -> list[str]:
    """names as they are; one that is forbidden or holds a forbidden part, in any case of letters, raises ValueError before any plan is built."""
    bad = [n for n in names if n.lower() in exact or any(f in n.lower() for f in parts)]
    if bad:
        raise ValueError(f"features that leak the label: {', '.join(sorted(bad))}")
    return names


def coerce(column: Column, kind: str) -> Column:
    """A double, long or boolean; blanks and what can't be read are null, as are numbers that aren't finite."""
    text = F.nullif(F.trim(column.cast("string")), F.lit(""))
    if kind == "bool":
        low = F.lower(text)
        return F.when(low.isin("1", "true", "t", "yes", "y"), True).when(low.isin("0", "false", "f", "no", "n"), False)
    number = text.try_cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return number if kind == "float" else F.when(number == F.floor(number), number.cast("long"))


def checked_join(rows: DataFrame, dim: DataFrame, key: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows left-joined to one row of dim per key, keys of dim whose rows disagree)."""
    one = dim.groupBy(key).agg(*[F.min(v).alias(v) for v in values], *[(F.countDistinct(v) > 1).alias(f"_{v}") for v in values])
    clash = F.lit(False)
    for v in values:
        clash = clash | F.col(f"_{v}")
    return rows.join(one.select(key, *values), key, "left"), one.filter(clash).select(key)


def complete_join(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows joined to side on key; a row whose key side lacks raises ValueError, so that nothing is lost in silence."""
    lost = rows.join(side, key, "left_anti").select(key).limit(1).collect()
    if lost:
        raise ValueError(f"no side row for {key} {lost[0][0]!r}")
    return rows.join(side, key)


def sidecar_gate(verified: dict[str, DataFrame], base: DataFrame, key: str, fields: dict[str, list[str]], least: float = 0.5, present: tuple[str, ...] = ()) -> DataFrame:
    """(sidecar, status, reasons, coverage, admitted): which sidecars a feature rail may take.

    All are audited in one pass each. If any fails, none is admitted; a sidecar
    whose name is present already raises ValueError.
    """
    again = sorted(set(verified) & set(present))
    if again:
        raise ValueError(f"sidecars that are there already: {', '.join(again)}")
    audits = None
    for name, side in sorted(verified.items()):
        own = sidecar_audit(base, side, key, fields[name], least).select(F.lit(name).alias("sidecar"), "status", "reasons", "coverage")
        audits = own if audits is None else audits.unionByName(own)
    all_pass = audits.agg(F.bool_and(F.col("status") == "PASS").alias("all_pass"))
    return audits.crossJoin(F.broadcast(all_pass)).select("sidecar", "status", "reasons", "coverage", F.col("all_pass").alias("admitted"))


def feature_rail(base: DataFrame, key: str, tiles: DataFrame, tile: str, sides: dict[str, tuple[DataFrame, list[str]]], full: tuple[str, ...] = ()) -> DataFrame:
    """One row per base row: base columns, those of its tile, and each sidecar's fields as <sidecar>_<field>.

    Tiles and sidecars have one row a key or the rail is refused; sidecars named
    in full must cover the base. features_present counts the fields that aren't null.
    """
    for name, side, own in (("tiles", tiles, tile), *((n, s, key) for n, (s, _) in sides.items())):
        twice = side.groupBy(own).count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{name}: {own} {twice[0][0]!r} repeats")
    out, names = base.join(tiles, tile, "left"), [c for c in tiles.columns if c != tile]
    for name, (side, fields) in sides.items():
        own = side.select(key, *[F.col(f).alias(f"{name}_{f}") for f in fields])
        out = complete_join(out, own, key) if name in full else out.join(own, key, "left")
        names += [f"{name}_{f}" for f in fields]
    guard_names(names)
    present = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    return out.withColumn("features_present", present)


def sidecar_audit(base: DataFrame, side: DataFrame, key: str, fields: list[str], least: float = 0.5) -> DataFrame:
    """One row: rows, distinct and repeated ids, ids inside and outside the base, coverage, empty fields, and why it fails."""
    ids = side.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    known = base.select(key).distinct().withColumn("known", F.lit(1))
    got = ids.join(known, key, "left").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("ids"), F.count_if(F.col("c") > 1).alias("repeated"), F.count("known").alias("matched"), F.count_if(F.col("known").isNull()).alias("outside"))
    holes = side.agg(*[F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in fields])
    total = known.agg(F.count(F.lit(1)).alias("base"))
    out = got.crossJoin(holes).crossJoin(total).withColumn("coverage", F.col("matched") / F.col("base"))
    reasons = F.array_compact(F.array(F.when(F.col("rows") == 0, "EMPTY"), F.when(F.col("repeated") > 0, "DUPLICATE_IDS"), F.when(F.col("outside") > 0, "OUTSIDE_BASE"), F.when(F.col("coverage") < least, "LOW_COVERAGE")))
    return out.withColumn("reasons", reasons).withColumn("status", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL"))


def coverage(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(feature, present, rows): how often each feature isn't null, in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).isNotNull().cast("long").alias("has")) for n in names])).alias("x"))
    return long.groupBy("x.feature").agg(F.sum("x.has").alias("present"), F.count(F.lit(1)).alias("rows"))


def census(labels: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, n) for every dimension in one aggregation over grouping sets."""
    spark = labels.sparkSession
    cols = ", ".join(f"`{d}`" for d in dims)
    name = "CASE " + " ".join(f"WHEN grouping(`{d}`) = 0 THEN '{d}'" for d in dims) + " END"
    value = "CASE " + " ".join(f"WHEN grouping(`{d}`) = 0 THEN cast(`{d}` AS string)" for d in dims) + " END"
    return spark.sql(f"SELECT {name} AS dimension, {value} AS value, count(*) AS n FROM {{labels}} GROUP BY GROUPING SETS ({', '.join(f'(`{d}`)' for d in dims)})".replace(cols, cols), labels=labels)


def consensus(reviews: DataFrame) -> DataFrame:
    """Per candidate: SINGLE, AGREED or CONFLICT; agreed ones have the label, the weakest tier and all witnesses."""
    g = reviews.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("reviews"), F.collect_set("label").alias("labels"), F.max("label_tier").alias("tier"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("witness_families")))).alias("witnesses"))
    state = F.when(F.col("reviews") < 2, "SINGLE").when(F.size("labels") == 1, "AGREED").otherwise("CONFLICT")
    return g.select("candidate_id", "reviews", state.alias("state"), F.when(state == "AGREED", F.element_at("labels", 1)).alias("label"), F.when(state == "AGREED", F.col("tier")).alias("tier"), "witnesses")


def capped_sample(rows: DataFrame, group: str, key: Column, per_group: int, n: int) -> DataFrame:
    """At most per_group rows of a group and n in all, by sha256 of the key: what a greedy walk in hash order takes."""
    h = F.sha2(key, 256)
    ranked = rows.withColumn("_h", h).withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy("_h"))).filter(F.col("_r") <= per_group)
    return ranked.orderBy("_h").limit(n).drop("_h", "_r")


def group_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    return rows.withColumn("fold", fold(F.col(group), folds))


def psf_reference(stars: DataFrame, candidates: DataFrame, tile: str, value: str, least: int = 5) -> DataFrame:
    """Candidates with the ratio of value to the median of their tile's reference stars, or why there is none."""
    ref = quantiles(stars, value, {"reference": 0.5}, (tile,)).withColumnRenamed("n", "stars")
    out = candidates.join(ref, tile, "left")
    why = F.when(F.col("stars").isNull(), "NO_REFERENCE").when(F.col("stars") < least, "TOO_FEW_STARS")
    return out.withColumn("reason", why).withColumn("ratio", F.when(why.isNull(), F.col(value) / F.col("reference")))
