"""Grouped out-of-fold classification with Spark ML, and the guards before it."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.features import group_folds, guard_names

if TYPE_CHECKING:  # Spark ML loads pandas, which other queries' drivers do without
    from pyspark.ml import Pipeline


def guard_report(rows: DataFrame, label: str, group: str, folds: int, tier: str | None = None, witnesses: str | None = None, families: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(by, guard, n, failed): what stands against training on rows, for each cohort (by) apart.

    TOO_FEW_ROWS: under 20. TOO_FEW_GROUPS: under twice the folds. TIER_C_ONLY: no
    label of another tier. WITNESS_OVERLAP: labels made by a family that is a
    predictor's too. THIN_FOLDS: folds without both classes. n is the count that
    each guard looks at. rows have a fold.
    """
    better = F.count_if(F.coalesce(F.col(tier), F.lit("")) != "C") if tier else F.count(F.lit(1))
    clash = F.count_if(F.arrays_overlap(witnesses, F.array(*[F.lit(f) for f in families]))) if witnesses and families else F.lit(0).cast("long")
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.countDistinct(group).alias("_groups"), better.alias("_better"), clash.alias("_clash"))
    thin = rows.groupBy(*by, "fold").agg(F.countDistinct(label).alias("_k")).groupBy(*by).agg(F.count_if(F.col("_k") < 2).alias("_thin"))
    both = sums.join(thin, list(by)) if by else sums.crossJoin(thin)  # one row each
    one = lambda guard, n, failed: F.struct(F.lit(guard).alias("guard"), F.col(n).alias("n"), failed.alias("failed"))
    c = F.col
    each = F.array(one("TOO_FEW_ROWS", "_rows", c("_rows") < 20), one("TOO_FEW_GROUPS", "_groups", c("_groups") < 2 * folds), one("TIER_C_ONLY", "_better", c("_better") == 0), one("WITNESS_OVERLAP", "_clash", c("_clash") > 0), one("THIN_FOLDS", "_thin", c("_thin") > 0))
    return both.select(*by, F.inline(each))


def check_training(rows: DataFrame, label: str, group: str, folds: int, tier: str | None = None, witnesses: str | None = None, families: tuple[str, ...] = ()) -> None:
    """Raises ValueError where a guard of guard_report() fails; five rows come to the driver."""
    failed = [f"{r['guard']} ({r['n']})" for r in guard_report(rows, label, group, folds, tier, witnesses, families).filter("failed").collect()]
    if failed:
        raise ValueError("training is refused: " + ", ".join(failed))


def models(seed: int = 7) -> dict:
    """The ensemble. Two forests of different depth stand for the kinds that Spark ML has no class for."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    own = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "logistic": LogisticRegression(maxIter=50, regParam=0.01, **own),
        "forest": RandomForestClassifier(numTrees=40, maxDepth=6, seed=seed, **own),
        "wide_forest": RandomForestClassifier(numTrees=40, maxDepth=10, featureSubsetStrategy="all", subsamplingRate=0.7, seed=seed + 1, **own),
        "boosted": GBTClassifier(maxIter=20, maxDepth=3, seed=seed, **own),
    }


def pipeline(features: list[str], model) -> Pipeline:
    """Median imputation with missing indicators, scaling, and the model. Rows need the columns of prepared()."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"{f}_filled" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled + [f"{f}_missing" for f in features], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        model,
    ])


def prepared(rows: DataFrame, features: list[str]) -> DataFrame:
    guard_names(features)
    return rows.withColumns({f: F.col(f).cast("double") for f in features}).withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in features})


def train_oof(rows: DataFrame, features: list[str], group: str, folds: int = 3, names: tuple[str, ...] | None = None, seed: int = 7, tier: str | None = None, witnesses: str | None = None, families: tuple[str, ...] = ()) -> DataFrame:
    """(id, label, fold, scores by model, score): every row is scored once, by models that saw no row of its group.

    rows: (id, label, group, features, and the columns tier and witnesses where
    given). Classes weigh alike. Guards run first; families are the predictors'.
    """
    from pyspark.ml.functions import vector_to_array

    data = group_folds(prepared(rows, features), group, folds).withColumn("label", F.col("label").cast("double")).persist()
    try:
        check_training(data, "label", group, folds, tier, witnesses, families)
        n = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
        total = sum(n.values())
        data_w = data.withColumn("weight", F.when(F.col("label") == 1.0, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0])))
        own = {k: m for k, m in models(seed).items() if names is None or k in names}
        out = None
        for fold in range(folds):
            train, test = data_w.filter(F.col("fold") != fold), data_w.filter(F.col("fold") == fold)
            for k, m in own.items():
                fit = pipeline(features, m).fit(train)
                got = fit.transform(test).select("id", "label", "fold", F.lit(k).alias("model"), vector_to_array("probability")[1].alias("p"))
                out = got if out is None else out.unionByName(got)
        scored = out.groupBy("id", "label", "fold").agg(F.map_from_entries(F.collect_list(F.struct("model", "p"))).alias("scores"), F.avg("p").alias("score"))
        return scored.withColumn("label", F.col("label").cast("int"))
    finally:
        data.unpersist()


def score_population(rows: DataFrame, fitted: list, oof: DataFrame) -> DataFrame:
    """(id, score, score_origin): the mean of fitted pipelines, replaced by out-of-fold scores where a row was trained on. rows are prepared()."""
    from pyspark.ml.functions import vector_to_array

    out = None
    for m in fitted:
        got = m.transform(rows).select("id", vector_to_array("probability")[1].alias("p"))
        out = got if out is None else out.unionByName(got)
    mean = out.groupBy("id").agg(F.avg("p").alias("model"))
    both = mean.join(oof.select("id", F.col("score").alias("own")), "id", "left")
    return both.select("id", F.coalesce("own", "model").alias("score"), F.when(F.col("own").isNull(), "MODEL").otherwise("OUT_OF_FOLD").alias("score_origin"))
