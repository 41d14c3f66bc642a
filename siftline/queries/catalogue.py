"""Queries over the star schema and labels: checked joins, audits, labels, folds, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import hashing as H
from siftline.operators import features as X
from siftline.operators import rules as R
from siftline.operators.tfidf import contained_sets
from siftline.plans.pairs import pairs_within
from siftline.registry import query
from siftline.sources.tables import table


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderstatus FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def feature_tile_join(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    joined, _ = X.checked_join(rows, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", ["o_custkey", "o_orderstatus"])
    return joined.withColumnRenamed("o_orderkey", "l_orderkey")


@query("SELECT o_custkey, count(*) AS orders, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def join_conflicts(spark, sf_dir):
    """Customers whose orders disagree on priority, as a checked join reports them."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    _, clash = X.checked_join(orders.select("o_custkey").distinct(), orders, "o_custkey", ["o_orderpriority"])
    return orders.join(clash, "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("SELECT o_orderkey, o_orderdate, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def feature_plate_join(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("c_custkey"))
    joined, _ = X.checked_join(rows, table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"])
    return joined.drop("c_custkey")


@query("SELECT c_custkey, c_name, n AS orders, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def sidecar_join(spark, sf_dir):
    side = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(side, "c_custkey", "left")


@query("""WITH i AS (SELECT o_custkey AS k, count(*) AS c FROM orders GROUP BY 1), b AS (SELECT DISTINCT c_custkey AS k FROM customer)
SELECT (SELECT count(*) FROM orders) AS rows, count(*) AS ids, count(*) FILTER (WHERE c > 1) AS repeated, count(b.k) AS matched, count(*) FILTER (WHERE b.k IS NULL) AS outside, (SELECT count(*) FROM orders WHERE o_orderstatus IS NULL) AS missing_o_orderstatus,
(SELECT count(*) FROM b) AS base, round(count(b.k) / (SELECT count(*) FROM b), 6) AS coverage, 'DUPLICATE_IDS' AS reasons, 'FAIL' AS status FROM i LEFT JOIN b ON b.k = i.k""")
def sidecar_audit(spark, sf_dir):
    side = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    out = X.sidecar_audit(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), side, "k", ["o_orderstatus"])
    return out.withColumn("reasons", F.array_join("reasons", ",")).withColumn("coverage", F.round("coverage", 6))


@query("SELECT f AS feature, CASE f WHEN 'total' THEN count(total) ELSE count(n) END AS present, count(*) AS rows FROM (SELECT c_custkey, n, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey), unnest(['orders', 'total']) AS u(f) GROUP BY f")
def feature_coverage(spark, sf_dir):
    return X.coverage(sidecar_join(spark, sf_dir), "c_custkey", ["orders", "total"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def novel_records(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclude_labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def label_feature_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("SELECT d.doc_id, coalesce(l.quality / 2.0 + 0.25, least(d.n_chars / 10000.0, 1)) AS score, CASE WHEN l.doc_id IS NULL THEN 'MODEL' ELSE 'OUT_OF_FOLD' END AS score_origin FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def oof_override_join(spark, sf_dir):
    """Model scores, replaced by out-of-fold ones where a row was trained on."""
    model = table(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("model"))
    oof = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") / 2.0 + 0.25).alias("oof"))
    return model.join(oof, "doc_id", "left").select("doc_id", F.coalesce("oof", "model").alias("score"), F.when(F.col("oof").isNull(), "MODEL").otherwise("OUT_OF_FOLD").alias("score_origin"))


@query("SELECT ps.p_partkey, ps.p_name, l.n FROM part ps JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_partkey = ps.p_partkey")
def plate_wcs_join(spark, sf_dir):
    side = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    used = table(spark, sf_dir, "part").select("p_partkey", "p_name").join(side.select("p_partkey"), "p_partkey", "left_semi")
    return X.complete_join(used, side, "p_partkey")


_TIER = "CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END"
_LABELS = f"lab AS (SELECT l.doc_id::VARCHAR AS candidate_id, l.quality AS label, CASE l.doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS label_tier, d.source AS label_source, d.lang AS lang, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def label_rows(spark, sf_dir):
    """labels as label rows: tier by id, the source as label source, one witness, evidence for two ids in three."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    tier = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("doc_id") % 3 + 1).cast("int"))
    refs = F.when(F.col("doc_id") % 2 == 0, F.array("source")).otherwise(F.array().cast("array<string>"))
    return rows.select(F.col("doc_id").cast("string").alias("candidate_id"), F.col("quality").alias("label"), tier.alias("label_tier"), F.col("source").alias("label_source"), F.array("lang").alias("witness_families"), refs.alias("evidence_refs"), "lang", "toxic")


@query(f"WITH {_LABELS} SELECT candidate_id, CASE WHEN label_tier = 'A' AND candidate_id::BIGINT % 2 = 1 THEN 'TIER_A_WITHOUT_EVIDENCE' ELSE '' END AS errors, NOT (label_tier = 'A' AND candidate_id::BIGINT % 2 = 1) AS valid FROM lab")
def validate_labels(spark, sf_dir):
    return R.validate_labels(label_rows(spark, sf_dir)).select("candidate_id", F.array_join("errors", ",").alias("errors"), "valid")


@query(f"WITH {_LABELS} SELECT 'label' AS dimension, label::VARCHAR AS value, count(*) AS n FROM lab GROUP BY 2 UNION ALL SELECT 'label_tier', label_tier, count(*) FROM lab GROUP BY 2 UNION ALL SELECT 'label_source', label_source, count(*) FROM lab GROUP BY 2")
def label_census(spark, sf_dir):
    return X.census(label_rows(spark, sf_dir), ["label", "label_tier", "label_source"])


_REVIEWS = f"{_LABELS}, rev AS (SELECT candidate_id, label, label_tier, lang FROM lab UNION ALL SELECT candidate_id, toxic, label_tier, label_source FROM lab WHERE candidate_id::BIGINT % 4 != 0)"


@query(f"""WITH {_REVIEWS} SELECT candidate_id, count(*) AS reviews, CASE WHEN count(*) < 2 THEN 'SINGLE' WHEN count(DISTINCT label) = 1 THEN 'AGREED' ELSE 'CONFLICT' END AS state,
CASE WHEN count(*) >= 2 AND count(DISTINCT label) = 1 THEN max(label) END AS label, CASE WHEN count(*) >= 2 AND count(DISTINCT label) = 1 THEN max(label_tier) END AS tier, array_to_string(list_sort(list(DISTINCT lang)), ',') AS witnesses FROM rev GROUP BY candidate_id""")
def consensus(spark, sf_dir):
    rows = label_rows(spark, sf_dir)
    second = rows.filter(F.col("candidate_id").cast("long") % 4 != 0).select("candidate_id", F.col("toxic").alias("label"), "label_tier", F.array("label_source").alias("witness_families"))
    out = X.consensus(rows.select("candidate_id", "label", "label_tier", "witness_families").unionByName(second))
    return out.withColumn("witnesses", F.array_join("witnesses", ","))


@query("WITH h AS (SELECT doc_id, source, sha256('review:' || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS r FROM h) SELECT doc_id, source FROM r WHERE r <= 6 ORDER BY h LIMIT 90")
def group_capped_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return X.capped_sample(docs, "source", F.concat(F.lit("review:"), F.col("doc_id").cast("string")), 6, 90)


@query("SELECT doc_id, (('0x' || substr(sha256(source || '|' || lang), 1, 16))::UBIGINT % 5)::INT AS fold FROM documents")
def group_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", "source", "lang").alias("g"))
    return X.group_folds(rows, "g", 5).select("doc_id", "fold")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('Y', 'y') THEN true WHEN l_returnflag IN ('N', 'n', 'F') THEN false END AS returned, l_quantity::BIGINT AS quantity FROM lineitem")
def coerce_features(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.coerce(F.col("l_returnflag"), "bool").alias("returned"), X.coerce(F.col("l_quantity"), "int").alias("quantity"))


@query("""WITH r AS (SELECT l_suppkey, median(l_extendedprice) AS m, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN r.n IS NULL THEN 'NO_REFERENCE' WHEN r.n < 5 THEN 'TOO_FEW_STARS' END AS reason, round(CASE WHEN r.n >= 5 THEN l_extendedprice / m END, 6) AS ratio FROM lineitem LEFT JOIN r USING (l_suppkey) WHERE l_returnflag = 'A'""")
def psf_reference(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    out = X.psf_reference(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'A'"), "l_suppkey", "l_extendedprice")
    return out.select("l_orderkey", "l_linenumber", "reason", F.round("ratio", 6).alias("ratio"))


@query("""WITH p AS (SELECT o_custkey AS target, o_orderkey AS id, o_totalprice AS f, o_orderdate AS t FROM orders)
SELECT a.id AS a, b.id AS b, round(b.f - a.f, 2) AS spacing, round((b.f - a.f) / 1000, 0)::BIGINT AS nearest, date_diff('day', a.t, b.t) AS days FROM p a JOIN p b ON a.target = b.target AND a.id < b.id""")
def same_target_pairs(spark, sf_dir):
    """Pairs of orders of one customer: spacing in price, the nearest whole thousand, and days between them."""
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("f"), F.col("o_orderdate").alias("t"))
    gap = F.col("b.f") - F.col("a.f")
    return pairs_within(p, ["target"], "id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(gap, 2).alias("spacing"), F.round(gap / 1000, 0).cast("long").alias("nearest"), F.datediff("b.t", "a.t").cast("long").alias("days"))


@query("SELECT o_orderkey, string_agg(b, ',' ORDER BY b) AS bands FROM orders JOIN (VALUES ('high', 200000, 1e9), ('low', 0, 50000), ('mid', 40000, 250000)) AS v(b, lo, hi) ON o_totalprice >= lo AND o_totalprice <= hi GROUP BY o_orderkey")
def band_tags(spark, sf_dir):
    bands = spark.createDataFrame([("high", 200000.0, 1e9), ("low", 0.0, 50000.0), ("mid", 40000.0, 250000.0)], "band string, lo double, hi double")
    o = table(spark, sf_dir, "orders")
    hit = o.join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") <= F.col("hi")))
    return hit.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_set("band")), ",").alias("bands"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS e FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY k)
SELECT a.k AS contained, b.k AS container FROM s a JOIN s b ON b.e = a.e AND b.k != a.k JOIN n ON n.k = a.k GROUP BY a.k, b.k HAVING count(*) = any_value(n.n)""")
def containment_join(spark, sf_dir):
    """Orders whose set of suppliers lies within another order's."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("e")).distinct()
    return contained_sets(s)


@query("SELECT c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\",\"c_name\":\"' || c_name || '\"}') AS sha FROM customer")
def row_sha(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", H.row_sha("c_custkey", "c_mktsegment", "c_name").alias("sha"))


@query("""WITH h AS (SELECT c_custkey, sha256(c_name) AS a, sha256(c_mktsegment) AS b FROM customer)
SELECT c_custkey, (SELECT sum(bit_count(xor(('0x' || a[8*i+1:8*i+8])::BIGINT, ('0x' || b[8*i+1:8*i+8])::BIGINT))) FROM range(0, 8) AS r(i))::INT AS hamming, (SELECT count(*) FROM range(1, 65) AS r(i) WHERE a[i] = b[i])::INT AS same FROM h""")
def digest_distance(spark, sf_dir):
    h = table(spark, sf_dir, "customer").select("c_custkey", F.sha2("c_name", 256).alias("a"), F.sha2("c_mktsegment", 256).alias("b"))
    return h.select("c_custkey", H.hex_hamming(F.col("a"), F.col("b")).alias("hamming"), H.equal_positions(F.col("a"), F.col("b")).alias("same"))


_CLAIM = """c AS (SELECT *, doc_id % 7 = 0 AS guess, ['SOURCE_FACT', 'FORMAL_DERIVATION', 'REPRODUCIBLE_EXPERIMENT', 'STATISTICAL_INFERENCE', 'HYPOTHESIS_ONLY', 'NONE'][doc_id % 6 + 1] AS ev,
['SOURCE_BOUND_FACT', 'PROVED_IN_SCOPE', 'HYPOTHESIS_ONLY', 'WEAKENED', 'OPEN'][doc_id % 5 + 1] AS st, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'PEER_MESSAGE' WHEN 2 THEN 'DIRECT_OBSERVATION' ELSE 'RUMOUR' END AS ch FROM labels)"""


def _when(*rules: tuple[str, str]) -> str:
    return " || ".join(f"CASE WHEN {cond} THEN ['{code}'] ELSE [] END" for code, cond in rules)


_ERRORS = _when(
    ("INVALID_CLAIM_KIND", "guess"), ("DEPRECATED_HEURISTIC_OR_LEGACY_STATUS_FORBIDDEN_FOR_ACTIVE_CLAIM", "st = 'WEAKENED'"), ("INVALID_STATUS", "st = 'OPEN'"), ("MISSING_OR_INVALID_EVIDENCE_CLASS", "ev = 'NONE'"),
    ("INVALID_PROVENANCE_CHANNEL", "ch = 'RUMOUR'"), ("UNCALIBRATED_CONFIDENCE_FORBIDDEN", "toxic = 1"), ("CONSENSUS_IS_NOT_WORLD_TRUTH", "doc_id % 11 = 0"),
    ("SOURCE_FACT_REQUIRES_SOURCE_POINTER", "ev = 'SOURCE_FACT' AND quality = 0"), ("SOURCE_FACT_REQUIRES_PROVENANCE_CHANNEL", "ev = 'SOURCE_FACT' AND ch = ''"),
    ("FORMAL_DERIVATION_REQUIRES_DERIVATION_OR_SOURCE_OBJECT", "ev = 'FORMAL_DERIVATION' AND quality = 0"), ("FORMAL_DERIVATION_STATUS_MISMATCH", "ev = 'FORMAL_DERIVATION' AND st != 'PROVED_IN_SCOPE'"),
    ("REPRODUCIBLE_EXPERIMENT_REQUIRES_VERSIONED_EVIDENCE_OBJECT", "ev = 'REPRODUCIBLE_EXPERIMENT' AND quality = 0"), ("FINITE_EXPERIMENT_CANNOT_BE_PROMOTED_TO_UNIVERSAL_PROOF", "ev = 'REPRODUCIBLE_EXPERIMENT' AND st = 'PROVED_IN_SCOPE'"),
    ("STATISTICAL_INFERENCE_REQUIRES_MODEL", "ev = 'STATISTICAL_INFERENCE' AND doc_id % 9 != 3"), ("STATISTICAL_MODEL_MISSING:model,uncertainty", "ev = 'STATISTICAL_INFERENCE' AND doc_id % 9 = 3"),
    ("HYPOTHESIS_CANNOT_BE_PROMOTED_AS_EVIDENCE", "ev = 'HYPOTHESIS_ONLY' AND st != 'HYPOTHESIS_ONLY'"), ("HYPOTHESIS_REQUIRES_FALSIFICATION_ROUTE", "ev = 'HYPOTHESIS_ONLY' AND quality = 0"),
    ("INDEPENDENT_REPLICATION_REQUIRES_MULTIPLE_SOURCE_POINTERS", "doc_id % 13 = 0"), ("INDEPENDENT_REPLICATION_REQUIRES_DEPENDENCY_ANALYSIS", "doc_id % 13 = 0"), ("PREDICTION_NOT_FROZEN_BEFORE_SCORING", "doc_id % 17 = 0"),
)
_WARNINGS = _when(("SOURCE_FACT_IS_REPORT_OCCURRENCE_ONLY_FOR_CONTEXT_CHANNEL", "ev = 'SOURCE_FACT' AND ch = 'PEER_MESSAGE' AND st = 'SOURCE_BOUND_FACT'"), ("EVENT_TIME_NOT_RECORDED", "NOT guess"), ("EVENT_LOCATION_NOT_RECORDED", "NOT guess"), ("CLOSED_BELIEF_LOOP_WARNING", "ev = 'HYPOTHESIS_ONLY' AND quality = 0"))


@query(f"WITH {_CLAIM}, e AS (SELECT doc_id::VARCHAR AS claim_id, {_ERRORS} AS e, {_WARNINGS} AS w FROM c) SELECT claim_id, array_to_string(e, ',') AS errors, array_to_string(w, ',') AS warnings, len(e) = 0 AS admissible FROM e")
def validate_claims(spark, sf_dir):
    """Labels as claims, whose fields follow from id, quality and toxicity so that most rules are met by some."""
    n = F.col("doc_id")
    one = lambda k, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % k + 1).cast("int"))
    some = F.when(F.col("quality") == 1, F.array(n.cast("string"))).otherwise(F.array().cast("array<string>"))
    claims = table(spark, sf_dir, "labels").select(
        n.cast("string").alias("claim_id"), F.lit("agent").alias("origin_agent_id"), F.lit("claim").alias("claim_text"),
        F.when(n % 7 == 0, "GUESS").otherwise("REPORTED").alias("claim_kind"), one(5, "SOURCE_BOUND_FACT", "PROVED_IN_SCOPE", "HYPOTHESIS_ONLY", "WEAKENED", "OPEN").alias("status"),
        one(6, "SOURCE_FACT", "FORMAL_DERIVATION", "REPRODUCIBLE_EXPERIMENT", "STATISTICAL_INFERENCE", "HYPOTHESIS_ONLY", "NONE").alias("evidence_class"),
        one(4, "", "PEER_MESSAGE", "DIRECT_OBSERVATION", "RUMOUR").alias("provenance_channel"),
        some.alias("source_pointers"), some.alias("evidence_objects"), some.alias("falsification_tests"), F.when(F.col("toxic") == 1, "HIGH").alias("confidence"),
        (n % 13 == 0).alias("independent_replication"), F.when(n % 11 == 0, F.array(F.lit("consensus_as_truth"))).alias("flags"),
        F.when(n % 9 == 3, F.struct(F.lit("rate").alias("target"), F.lit("").alias("model"), F.lit(None).cast("string").alias("uncertainty"))).alias("statistical_model"),
        F.when(n % 17 == 0, F.from_json(F.lit('{"scored":true}'), "frozen boolean, scored boolean, post_hoc_redefined boolean, prediction_timestamp string, deadline_or_window string, success_criterion string, failure_criterion string, analysis_rule string, score string")).alias("prediction"),
    )
    return R.validate_claims(claims).select("claim_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "admissible")
