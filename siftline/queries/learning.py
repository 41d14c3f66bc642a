"""Queries that train models."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import classify as K
from siftline.operators import metrics as M
from siftline.registry import query
from siftline.sources.tables import table

FEATURES = ["n_chars", "words", "lines", "symbols", "digits", "distinct"]


def feature_rows(spark, sf_dir):
    """Documents with counts of their text as features; the group is source and a third of the ids."""
    t = F.col("text")
    words = F.split(t, r"\s+")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("n_chars"), F.size(words).alias("words"), F.size(F.split(t, "\n")).alias("lines"),
        (F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "")) / F.greatest(F.length(t), F.lit(1))).alias("symbols"), (F.length(F.regexp_replace(t, "[^0-9]+", "")) / F.greatest(F.length(t), F.lit(1))).alias("digits"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct"), F.concat_ws("|", "source", (F.col("doc_id") % 3).cast("string")).alias("group"),
    )


def training_rows(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return feature_rows(spark, sf_dir).join(labels, "id")


@query()
def train_oof(spark, sf_dir):
    out = K.train_oof(training_rows(spark, sf_dir), FEATURES, "group", 3)
    return out.select("id", "label", "fold", F.round("score", 6).alias("score"))


@query()
def oof_metrics(spark, sf_dir):
    """Metrics of the out-of-fold scores of the training query."""
    out = M.binary_metrics(train_oof(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_COHORT = "CASE WHEN lang = 'es' THEN 'C' WHEN quality = 1 THEN 'A' ELSE 'C' END"


@query(f"""WITH r AS (SELECT lang, quality AS label, source AS g, {_COHORT} AS tier, CASE WHEN source IN ('src1', 'src2') THEN lang ELSE 'reader' END AS witness, doc_id % 3 AS fold FROM documents JOIN labels USING (doc_id)),
s AS (SELECT lang, count(*) AS n, count(DISTINCT g) AS groups, count(*) FILTER (tier != 'C') AS better, count(*) FILTER (witness IN ('de', 'fr')) AS clash FROM r GROUP BY lang),
t AS (SELECT lang, count(*) FILTER (k < 2) AS thin FROM (SELECT lang, fold, count(DISTINCT label) AS k FROM r GROUP BY ALL) GROUP BY lang)
SELECT lang, 'TOO_FEW_ROWS' AS guard, n, n < 20 AS failed FROM s UNION ALL SELECT lang, 'TOO_FEW_GROUPS', groups, groups < 6 FROM s UNION ALL SELECT lang, 'TIER_C_ONLY', better, better = 0 FROM s
UNION ALL SELECT lang, 'WITNESS_OVERLAP', clash, clash > 0 FROM s UNION ALL SELECT lang, 'THIN_FOLDS', thin, thin > 0 FROM t""")
def leakage_guards(spark, sf_dir):
    """What stands against training on each language's labels: Spanish ones are of tier C alone, some German and French ones were witnessed by a predictor's family."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    tier = F.when((F.col("lang") != "es") & (F.col("quality") == 1), "A").otherwise("C")
    witness = F.array(F.when(F.col("source").isin("src1", "src2"), F.col("lang")).otherwise("reader"))
    rows = rows.select("lang", F.col("quality").alias("label"), F.col("source").alias("g"), tier.alias("tier"), witness.alias("witnesses"), (F.col("doc_id") % 3).alias("fold"))
    return K.guard_report(rows, "label", "g", 3, "tier", "witnesses", ("de", "fr"), ("lang",))


@query()
def score_population(spark, sf_dir):
    """Every document's score by a model of the labelled ones; those keep their out-of-fold scores."""
    train, every = training_rows(spark, sf_dir), feature_rows(spark, sf_dir)
    oof = K.train_oof(train, FEATURES, "group", 3, ("logistic",))
    fitted = K.pipeline(FEATURES, K.models()["logistic"]).fit(K.prepared(train, FEATURES).withColumn("label", F.col("label").cast("double")).withColumn("weight", F.lit(1.0)))
    return K.score_population(K.prepared(every, FEATURES), [fitted], oof).select("id", F.round("score", 6).alias("score"), "score_origin")
