"""Score metrics as DataFrame aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.plans.ordered import quantiles, running_sums


def score_summary(rows: DataFrame, score: str = "score") -> DataFrame:
    s = F.col(score)
    return rows.agg(F.count(s).alias("n"), F.min(s).alias("min"), F.max(s).alias("max"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd"), F.countDistinct(s).alias("distinct"), F.count_if(s == 0).alias("zeros"), F.count_if(s == 1).alias("ones"))


def score_distribution(rows: DataFrame, score: str = "score", digits: int = 6, collapse: float = 0.5) -> DataFrame:
    """Quantiles, distinct rounded values, the largest share of one value, and whether that share means collapse.

    Quantiles come from ranges of the distinct scores, which are written once.
    """
    buckets = rows.groupBy(F.round(score, digits).alias("b")).agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("buckets"), F.max("c").alias("top"), F.sum("c").alias("n"))
    qs = quantiles(rows, score, {f"p{int(q * 100):02d}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)}).drop("n")
    return buckets.crossJoin(qs).withColumn("top_share", F.col("top") / F.col("n")).withColumn("collapsed", F.col("top_share") > collapse).drop("top")


def reliability(rows: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).alias("bin")
    return rows.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def binary_metrics(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC-AUC by mid-ranks, average precision, balanced accuracy at 0.5 and Brier score.

    Rows are counted by distinct score; what lies below a score is summed along
    ranges of scores, which are written once, and what lies above is the rest.
    """
    y = F.col(label).cast("double")
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    run = running_sums(by, ["s"], {"p_below": "p", "n_below": "n"})
    run = run.crossJoin(F.broadcast(run.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))))
    tp, fp = F.col("all_p") - F.col("p_below"), F.col("all_n") - F.col("n_below")
    area = run.agg((F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2)) / (F.max("all_p") * F.max("all_n"))).alias("auc"), (F.sum(F.col("p") * tp / (tp + fp)) / F.max("all_p")).alias("average_precision"))
    hit = (F.col(score) >= 0.5).cast("double")
    rest = rows.agg(((F.sum(y * hit) / F.sum(y) + F.sum((1 - y) * (1 - hit)) / F.sum(1 - y)) / 2).alias("balanced_accuracy"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"))
    return area.crossJoin(rest)


def cosine_correlation(a: str, b: str) -> tuple:
    """Cosine and Pearson correlation of two equally long numeric arrays, as a pair of Columns; zero norms give null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    A, B, n = F.col(a), F.col(b), F.size(a)
    cos = dot(A, B) / F.nullif(F.sqrt(dot(A, A) * dot(B, B)), F.lit(0.0))
    cov = dot(A, B) - total(A) * total(B) / n
    var = F.sqrt((dot(A, A) - total(A) * total(A) / n) * (dot(B, B) - total(B) * total(B) / n))
    return cos, cov / F.nullif(var, F.lit(0.0))
