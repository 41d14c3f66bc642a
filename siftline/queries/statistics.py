"""Queries over events, embeddings and conversations: exposure tests, metrics, sequences."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.operators import exposure as X
from siftline.operators import metrics as M
from siftline.operators import rules as R
from siftline.plans.ordered import quantiles
from siftline.registry import query
from siftline.sources.tables import table

#: An event's score: its value against the largest it can take here.
SCALE = 200.0
_EV = f"ev AS (SELECT CAST(ts AS DATE) AS date, event_id, user_id, event_type, least(greatest(value / {SCALE}, 0), 1) AS score, event_type = 'signup' AS is_event FROM events)"
_DAYS = f"""{_EV}, span AS (SELECT min(date) AS d0, date_diff('day', min(date), max(date)) + 1 AS n FROM ev),
days AS (SELECT date_diff('day', d0, date) AS day, count(*)::DOUBLE AS opportunity, sum(score) AS weighted FROM ev, span GROUP BY ALL)"""
#: Days whose share of signups is above the median day's count as days of an event.
_EVENTS = "sh AS (SELECT date_diff('day', d0, date) AS day, avg(is_event::INT) AS share FROM ev, span GROUP BY ALL), evd AS (SELECT day FROM sh WHERE share > (SELECT median(share) FROM sh))"


def scored(spark, sf_dir):
    score = F.least(F.greatest(F.col("value") / SCALE, F.lit(0.0)), F.lit(1.0))
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), "event_id", "user_id", "event_type", score.alias("score"), (F.col("event_type") == "signup").alias("is_event"))


def days(spark, sf_dir):
    """(day, opportunity, weighted) by day index from the first date, days of an event (day), and the number of days."""
    rows = scored(spark, sf_dir)
    d0, d1 = rows.agg(F.min("date"), F.max("date")).first()
    indexed = rows.withColumn("day", F.datediff("date", F.lit(d0)))
    by_day = indexed.groupBy("day").agg(F.count(F.lit(1)).cast("double").alias("opportunity"), F.sum("score").alias("weighted"))
    share = indexed.groupBy("day").agg(F.avg(F.col("is_event").cast("int")).alias("share"))
    events = share.crossJoin(F.broadcast(share.agg(F.percentile("share", 0.5).alias("mid")))).filter("share > mid").select("day")
    return by_day, events, (d1 - d0).days + 1


@query(f"WITH {_EV} SELECT date, count(*) AS n, round(sum(score), 6) AS weighted, count(*) FILTER (WHERE score >= 0.5) AS n_50, count(*) FILTER (WHERE score >= 0.8) AS n_80 FROM ev GROUP BY date")
def nightly_rollup(spark, sf_dir):
    return X.nightly(scored(spark, sf_dir)).withColumn("weighted", F.round("weighted", 6))


@query("SELECT event_id, value / 20.0 AS score, CASE WHEN NOT isfinite(value) THEN 'NOT_FINITE' ELSE 'OUT_OF_RANGE' END AS reason FROM events WHERE value / 20.0 > 1 OR value < 0")
def range_guard(spark, sf_dir):
    return X.range_violations(table(spark, sf_dir, "events").select("event_id", (F.col("value") / 20.0).alias("score")))


@query(f"WITH {_EV} SELECT count(*) AS n, min(score) AS min, max(score) AS max, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS sd, count(DISTINCT score) AS \"distinct\", count(*) FILTER (WHERE score = 0) AS zeros, count(*) FILTER (WHERE score = 1) AS ones FROM ev")
def score_summary(spark, sf_dir):
    return M.score_summary(scored(spark, sf_dir)).withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query(f"""WITH {_EV}, b AS (SELECT round(score, 6) AS b, count(*) AS c FROM ev GROUP BY ALL)
SELECT (SELECT count(*) FROM b) AS buckets, count(*) AS n, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.95), 6) AS p95,
round((SELECT max(c) FROM b) / count(*), 6) AS top_share, (SELECT max(c) FROM b) / count(*) > 0.5 AS collapsed FROM ev""")
def score_distribution(spark, sf_dir):
    out = M.score_distribution(scored(spark, sf_dir))
    return out.select("buckets", "n", "collapsed", *[F.round(c, 6).alias(c) for c in ("p05", "p25", "p50", "p75", "p95", "top_share")])


@query(f"WITH {_EV} SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN is_event THEN 1.0 ELSE 0.0 END), 6) AS positive_rate FROM ev GROUP BY ALL")
def reliability_table(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("label", F.col("is_event").cast("int"))
    return M.reliability(rows).withColumn("mean_score", F.round("mean_score", 6)).withColumn("positive_rate", F.round("positive_rate", 6))


@query(f"""WITH {_EV}, y AS (SELECT score AS s, is_event::INT AS y FROM ev), b AS (SELECT s, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM y GROUP BY s),
r AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS below, sum(p) OVER (ORDER BY s DESC) AS tp, sum(p + n) OVER (ORDER BY s DESC) AS seen FROM b)
SELECT (SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) FROM r) AS auc, (SELECT round(sum(p * tp / seen) / sum(p), 6) FROM r) AS average_precision,
round((sum(y) FILTER (WHERE s >= 0.5) / sum(y) + sum(1 - y) FILTER (WHERE s < 0.5) / sum(1 - y)) / 2, 6) AS balanced_accuracy, round(avg((s - y) * (s - y)), 6) AS brier FROM y""")
def binary_metrics(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("label", F.col("is_event").cast("int"))
    out = M.binary_metrics(rows)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {_DAYS}, {_EVENTS}, ex AS (SELECT DISTINCT (((day + d) % n) + n) % n AS day FROM evd, span, unnest(range(-1, 2)) AS r(d))
SELECT round(sum(weighted) FILTER (WHERE e.day IS NOT NULL), 6) AS eo, sum(opportunity) FILTER (WHERE e.day IS NOT NULL) AS en, round(coalesce(sum(weighted) FILTER (WHERE e.day IS NULL), 0), 6) AS uo, coalesce(sum(opportunity) FILTER (WHERE e.day IS NULL), 0) AS un,
round((sum(weighted) FILTER (WHERE e.day IS NOT NULL) / sum(opportunity) FILTER (WHERE e.day IS NOT NULL)) / (sum(weighted) FILTER (WHERE e.day IS NULL) / sum(opportunity) FILTER (WHERE e.day IS NULL)), 6) AS ratio
FROM days LEFT JOIN ex e ON e.day = days.day""")
def rate_ratio(spark, sf_dir):
    by_day, events, n = days(spark, sf_dir)
    exposed = X.exposed_days(events, 1, n)
    out = X.rate_ratio(by_day, exposed, "weighted", "opportunity")
    return out.select(F.round("eo", 6).alias("eo"), "en", F.round("uo", 6).alias("uo"), "un", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH {_DAYS}, {_EVENTS} SELECT DISTINCT ((((day + d) % n) + n) % n)::INT AS day FROM evd, span, unnest(range(-1, 2)) AS r(d)""")
def interval_exposure_join(spark, sf_dir):
    _, events, n = days(spark, sf_dir)
    return X.exposed_days(events, 1, n)


_SHIFTS = f"""{_DAYS}, {_EVENTS}, hit AS (SELECT DISTINCT s, (((day + s + d) % n) + n) % n AS day FROM evd, span, unnest(range(0, n)) AS t(s), unnest(range(0, 1)) AS r(d)),
ex AS (SELECT s, sum(weighted) AS eo, sum(opportunity) AS en FROM hit JOIN days USING (day) GROUP BY s), tot AS (SELECT sum(weighted) AS wo, sum(opportunity) AS wn FROM days),
rr AS (SELECT s AS shift, (eo / en) / ((wo - eo) / (wn - en)) AS ratio FROM ex, tot WHERE en > 0 AND wn - en > 0)"""


@query(f"WITH {_SHIFTS} SELECT shift, round(ratio, 6) AS ratio FROM rr")
def circular_shifts(spark, sf_dir):
    by_day, events, n = days(spark, sf_dir)
    out = X.shift_table(by_day, events, 0, n, "weighted", "opportunity")
    return out.withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {_SHIFTS}, o AS (SELECT ratio AS observed FROM rr WHERE shift = 0), m AS (SELECT median(ratio) AS mid FROM rr)
SELECT count(*) AS shifts, round(any_value(observed), 6) AS observed, round(avg((ratio >= observed)::INT), 6) AS p_upper,
round(avg((abs(ln(greatest(ratio, 1e-12)) - ln(greatest(mid, 1e-12))) >= abs(ln(greatest(observed, 1e-12)) - ln(greatest(mid, 1e-12))) - 1e-12)::INT), 6) AS p_two_sided FROM rr, o, m""")
def circular_shift_test(spark, sf_dir):
    by_day, events, n = days(spark, sf_dir)
    ratios = X.shift_table(by_day, events, 0, n, "weighted", "opportunity")
    out = X.shift_test(ratios)
    return out.select("shifts", *[F.round(c, 6).alias(c) for c in ("observed", "p_upper", "p_two_sided")])


@query(f"""WITH {_EV}, k AS (SELECT date FROM ev GROUP BY date HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM ev)) SELECT e.date, count(*) AS n FROM ev e SEMI JOIN k ON k.date = e.date GROUP BY e.date""")
def date_intersection(spark, sf_dir):
    rows = scored(spark, sf_dir)
    kinds = rows.agg(F.countDistinct("event_type").alias("kinds"))
    common = rows.groupBy("date").agg(F.countDistinct("event_type").alias("k")).crossJoin(F.broadcast(kinds)).filter("k = kinds").select("date")
    return rows.join(common, "date", "left_semi").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EV}, g AS (SELECT event_type, avg(score) AS m, row_number() OVER (ORDER BY event_type) - 1 AS pos FROM ev GROUP BY event_type), n AS (SELECT count(*)::INT AS n FROM g), own AS (SELECT sum(m) AS own FROM g WHERE pos < 2),
masks AS (SELECT i AS id FROM n, unnest(range(0, CAST(2 ** n AS BIGINT))) AS r(i) WHERE bit_count(i) = 2), s AS (SELECT id, sum(CASE WHEN (id >> pos) & 1 = 1 THEN m ELSE 0 END) AS s FROM masks, g GROUP BY id)
SELECT count(*) AS assignments, round(avg((s >= own - 1e-12)::INT), 6) AS p FROM s, own""")
def exact_permutation(spark, sf_dir):
    means = scored(spark, sf_dir).groupBy("event_type").agg(F.avg("score").alias("value"))
    rows = means.withColumn("pos", F.row_number().over(W.orderBy("event_type")) - 1).withColumn("first", F.col("pos") < 2)
    n = means.count()
    return X.exact_permutation(rows.select("pos", "value", "first"), n, 2).withColumn("p", F.round("p", 6))


@query(f"WITH {_EV} SELECT event_type, count(*) AS n, round(avg(score), 6) AS mean FROM ev GROUP BY event_type")
def group_summary(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("""WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events), d AS (SELECT user_id, epoch_us(ts) / 1e6 - epoch_us(before) / 1e6 AS s FROM e WHERE before IS NOT NULL)
SELECT user_id, count(*) AS n, round(avg(s), 3) AS mean_s, round(avg(s) / (SELECT avg(s) FROM d) - 1, 6) AS difference FROM d GROUP BY user_id""")
def cadence(spark, sf_dir):
    """Mean interval between a user's events, and its difference to the mean of all as a fraction."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    gaps = table(spark, sf_dir, "events").withColumn("s", at - F.lag(at).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).filter("s is not null")
    mean = gaps.agg(F.avg("s").alias("all"))
    out = gaps.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("m")).crossJoin(F.broadcast(mean))
    return out.select("user_id", "n", F.round("m", 3).alias("mean_s"), F.round(F.col("m") / F.col("all") - 1, 6).alias("difference"))


@query("""WITH e AS (SELECT event_type, date_diff('day', o.d, CAST(ts AS DATE)) AS d FROM events, (SELECT min(CAST(ts AS DATE)) AS d FROM events) o)
SELECT event_type, count(*) AS n, round(avg(d), 6) AS mean, median(d) AS median, min(d) AS min, max(d) AS max, round(max(d) / median(d), 6) AS last_ratio FROM e GROUP BY event_type""")
def delay_baseline(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("date"))
    first = rows.agg(F.min("date").alias("d0"))
    days_ = rows.crossJoin(F.broadcast(first)).select("event_type", F.datediff("date", "d0").alias("d"))
    mid = quantiles(days_, "d", {"median": 0.5}, ("event_type",)).select("event_type", "median")
    out = days_.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.min("d").cast("long").alias("min"), F.max("d").cast("long").alias("max")).join(mid, "event_type")
    return out.select("event_type", "n", "mean", "median", "min", "max").withColumn("last_ratio", F.round(F.col("max") / F.col("median"), 6))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, lag(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, day, count(*) AS segments, count(*) FILTER (WHERE before IS NOT NULL AND epoch_us(ts) - epoch_us(before) > 3600000000) AS gaps FROM e GROUP BY ALL""")
def segment_continuity(spark, sf_dir):
    """Segments of each user and day, and how many follow the one before by more than an hour."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(W.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    return rows.withColumn("gap", gap).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("gap") > 3_600_000_000).alias("gaps"))


@query("SELECT user_id, min(day) AS day FROM (SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY ALL HAVING count(DISTINCT event_type) >= 2) GROUP BY user_id")
def earliest_complete_day(spark, sf_dir):
    """Each user's first day with at least two kinds of events."""
    full = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.countDistinct("event_type").alias("k")).filter("k >= 2")
    return full.groupBy("user_id").agg(F.min("day").alias("day"))


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY ALL")
def type_date_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("signup", "purchase"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))


@query("""WITH p AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings), v AS (SELECT p.a, p.b, x.embedding::DOUBLE[] AS x, y.embedding::DOUBLE[] AS y FROM p JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b),
s AS (SELECT a, b, len(x) AS n, list_inner_product(x, y) AS xy, list_inner_product(x, x) AS xx, list_inner_product(y, y) AS yy, list_sum(x) AS sx, list_sum(y) AS sy FROM v)
SELECT a, b, round(xy / sqrt(xx * yy), 6) AS cosine, round((xy - sx * sy / n) / sqrt((xx - sx * sx / n) * (yy - sy * sy / n)), 6) AS correlation FROM s""")
def vector_pair_similarity(spark, sf_dir):
    """Cosine and correlation of each vector with the next one."""
    e = table(spark, sf_dir, "embeddings")
    both = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y")), "a")
    cos, cor = M.cosine_correlation("x", "y")
    return both.select("a", (F.col("a") + 1).alias("b"), F.round(cos, 6).alias("cosine"), F.round(cor, 6).alias("correlation"))


_CHAIN = "c AS (SELECT conv_id, turn, coalesce(text, '') AS t, sha256(coalesce(role, '') || '|' || coalesce(text, '')) AS sha FROM conversations), p AS (SELECT *, CASE WHEN length(t) % 13 = 5 THEN sha ELSE lag(sha, 1, repeat('0', 64)) OVER (PARTITION BY conv_id ORDER BY turn) END AS previous FROM c)"


@query(f"""WITH {_CHAIN}, l AS (SELECT conv_id, turn, previous = lag(sha, 1, repeat('0', 64)) OVER (PARTITION BY conv_id ORDER BY turn) AS ok FROM p)
SELECT conv_id, count(*) AS links, bool_and(ok) AS intact, min(turn) FILTER (WHERE NOT ok) AS first_broken FROM l GROUP BY conv_id""")
def hash_chain_verify(spark, sf_dir):
    """Turns as a chain of receipts: each must name its predecessor's hash, the first one 64 zeros. Those whose text has a length of 5 modulo 13 name their own instead, so their chains are broken there."""
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"), F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("|"), t), 256).alias("sha"))
    before = F.coalesce(F.lag("sha").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("0" * 64))
    receipts = rows.withColumn("previous", F.when(F.length("t") % 13 == 5, F.col("sha")).otherwise(before))
    return R.verify_chain(receipts, "conv_id", "turn")
