"""Queries that treat documents and pages as files of a tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import exposure as X
from siftline.operators import files as O
from siftline.queries.statistics import _DAYS, _EVENTS, days
from siftline.registry import query
from siftline.sources import web
from siftline.sources.tables import table

_PREFIX = [("src1", "ALPHA"), ("src2", "BETA")]
_ROLES = {"LICENCE": "(?i)license", "ABUSE": "idiot|moron", "NUMBERS": "[0-9]{3}"}
_LEXICON = {"license": 3, "idiot": 4, "the ": 2, "que ": 2}
_F = """f AS (SELECT doc_id, source || '/' || doc_id AS path, text, CASE WHEN starts_with(source, 'src1') THEN 'ALPHA' WHEN starts_with(source, 'src2') THEN 'BETA' ELSE 'OTHER' END AS domain FROM documents),
r AS (SELECT *, CASE WHEN regexp_matches(path || chr(10) || text, '(?i)license') THEN ['LICENCE'] ELSE [] END || CASE WHEN regexp_matches(path || chr(10) || text, 'idiot|moron') THEN ['ABUSE'] ELSE [] END || CASE WHEN regexp_matches(path || chr(10) || text, '[0-9]{3}') THEN ['NUMBERS'] ELSE [] END AS roles FROM f)"""


def files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    return d.select("path", "text", O.classify_domain(F.col("path"), _PREFIX).alias("domain"), O.roles_for(F.col("path"), F.col("text"), _ROLES).alias("roles"))


@query(f"WITH {_F} SELECT path, domain, array_to_string(roles, ',') AS roles FROM r")
def file_roles(spark, sf_dir):
    return files(spark, sf_dir).select("path", "domain", F.array_join("roles", ",").alias("roles"))


@query(f"WITH {_F} SELECT 'domain' AS dimension, domain AS value, count(*) AS n FROM r GROUP BY domain UNION ALL SELECT 'role', u, count(*) FROM (SELECT unnest(roles) AS u FROM r) GROUP BY u")
def repo_scan_summary(spark, sf_dir):
    return O.scan_summary(files(spark, sf_dir))


_SC = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {n} ELSE 0 END" for w, n in _LEXICON.items())


@query(f"SELECT source || '/' || doc_id AS path, ({_SC})::INT AS score FROM documents WHERE {_SC} >= 5")
def routing_queue(spark, sf_dir):
    scored = files(spark, sf_dir).select("path", O.lexicon_score(F.col("text"), _LEXICON).alias("score"))
    return O.routing_queue(scored)


@query(f"WITH {_F} SELECT 'file:' || path AS id, array_to_string(list_sort(list_distinct([lower(domain)] || list_transform(roles, lambda x: lower(x)))), ',') AS tags FROM r WHERE domain != 'BETA'")
def repo_to_seed(spark, sf_dir):
    return O.to_seeds(files(spark, sf_dir), ("BETA",)).select("id", F.array_join("relation_tags", ",").alias("tags"))


@query("""WITH p AS (SELECT url, html, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS h, page_id FROM pages)
SELECT page_id, CASE WHEN NOT (h = 'example.com' OR ends_with(h, '.example.com')) THEN 'HOST_NOT_ALLOWED' WHEN page_id % 3 = 0 THEN 'NOT_FETCHED' ELSE 'ENRICHED' END AS state FROM p""")
def rowwise_enrich(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rows = p.select("page_id", F.concat_ws("#", "url", "page_id").alias("url"))
    fetched = p.filter("page_id % 3 != 0").select(F.concat_ws("#", "url", "page_id").alias("url"), "html")
    return O.enrich(rows, fetched, web.on_hosts(F.col("url"), ["example.com"])).select("page_id", "state")


@query("SELECT lang AS source, count(*) FILTER (WHERE n_chars > 500) AS passed, count(*) FILTER (WHERE n_chars <= 500) AS unavailable, sum(n_chars)::BIGINT AS records FROM documents GROUP BY lang")
def source_health(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return O.source_health(d.select(F.col("lang").alias("source"), (F.col("n_chars") > 500).alias("ok"), F.col("n_chars").alias("records")))


_RATES = """round(coalesce(sum(v) FILTER (WHERE e.day IS NOT NULL), 0), 6) AS eo, coalesce(sum(opportunity) FILTER (WHERE e.day IS NOT NULL), 0) AS en, round(coalesce(sum(v) FILTER (WHERE e.day IS NULL), 0), 6) AS uo, coalesce(sum(opportunity) FILTER (WHERE e.day IS NULL), 0) AS un,
round((sum(v) FILTER (WHERE e.day IS NOT NULL) / sum(opportunity) FILTER (WHERE e.day IS NOT NULL)) / (sum(v) FILTER (WHERE e.day IS NULL) / sum(opportunity) FILTER (WHERE e.day IS NULL)), 6) AS ratio"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in ("eo", "uo", "ratio") else c for c in df.columns])


@query(f"""WITH {_DAYS}, {_EVENTS}, l AS (SELECT day, opportunity, 'weighted' AS outcome, weighted AS v FROM days UNION ALL SELECT day, opportunity, 'opportunity', opportunity FROM days)
SELECT outcome, {_RATES} FROM l LEFT JOIN evd e ON e.day = l.day GROUP BY outcome""")
def evaluate_cohort(spark, sf_dir):
    by_day, events, n = days(spark, sf_dir)
    return _rounded(X.evaluate_cohort(by_day, X.exposed_days(events, 0, n), ["weighted", "opportunity"], "opportunity"))


@query(f"""WITH {_DAYS}, {_EVENTS}, h AS (SELECT event_type || CASE WHEN event_type = 'signup' AND dayofmonth(date) % 3 = 0 THEN '-late' ELSE '' END AS cohort, date_diff('day', d0, date) AS day, score FROM ev, span),
c AS (SELECT cohort, day, count(*)::DOUBLE AS opportunity, sum(score) AS v FROM h GROUP BY ALL), k AS (SELECT day FROM c GROUP BY day HAVING count(DISTINCT cohort) = (SELECT count(DISTINCT cohort) FROM c)),
s AS (SELECT 'ALL' AS scope, * FROM c UNION ALL SELECT 'COMMON', * FROM c SEMI JOIN k ON k.day = c.day), l AS (SELECT scope, cohort, day, opportunity, 'weighted' AS outcome, v FROM s)
SELECT scope, cohort, outcome, {_RATES} FROM l LEFT JOIN evd e ON e.day = l.day GROUP BY scope, cohort, outcome""")
def harmonize(spark, sf_dir):
    """Kinds of events as cohorts (late signups, on each third day of a month, are one of their own), each over all its days and over the days that all have."""
    from siftline.queries.statistics import scored

    _, events, n = days(spark, sf_dir)
    rows = scored(spark, sf_dir)
    d0 = rows.agg(F.min("date")).first()[0]
    late = F.when((F.col("event_type") == "signup") & (F.dayofmonth("date") % 3 == 0), "-late").otherwise("")
    by_day = rows.groupBy(F.concat("event_type", late).alias("cohort"), F.datediff("date", F.lit(d0)).alias("day")).agg(F.count(F.lit(1)).cast("double").alias("opportunity"), F.sum("score").alias("weighted"))
    return _rounded(X.harmonized(by_day, X.exposed_days(events, 0, n), ["weighted"], "opportunity"))


_PARSED = "CASE WHEN path LIKE '%.json' THEN json_valid(text) END"


@query(f"""WITH f AS (SELECT source || '/' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '.json' ELSE '.txt' END AS path, CASE WHEN doc_id % 20 = 0 THEN '{{{{"doc_id":' || doc_id || '}}}}' ELSE coalesce(text, '') END AS text FROM documents),
d AS (SELECT *, CASE WHEN starts_with(path, 'src1') THEN 'ALPHA' WHEN starts_with(path, 'src2') THEN 'BETA' ELSE 'OTHER' END AS domain, CASE WHEN regexp_matches(path || chr(10) || text, '(?i)license') THEN ['LICENCE'] ELSE [] END || CASE WHEN regexp_matches(path || chr(10) || text, 'idiot|moron') THEN ['ABUSE'] ELSE [] END || CASE WHEN regexp_matches(path || chr(10) || text, '[0-9]{{3}}') THEN ['NUMBERS'] ELSE [] END AS roles, {_SC} AS score FROM f),
s AS (SELECT *, sha256(path || '|' || domain || '|' || array_to_string(roles, ',') || '|' || score) AS sha FROM d),
i AS (SELECT sha256(string_agg(h, '' ORDER BY b)) AS h FROM (SELECT sha[:2] AS b, sha256(string_agg(sha, '' ORDER BY sha)) AS h FROM s GROUP BY b)),
q AS (SELECT sha256(string_agg(h, '' ORDER BY b)) AS h FROM (SELECT sha[:2] AS b, sha256(string_agg(sha, '' ORDER BY sha)) AS h FROM s WHERE score >= 5 GROUP BY b))
SELECT count(*) AS files, count(*) FILTER (score >= 5) AS candidates, count(*) FILTER (regexp_matches(text, '(?i)not |no ')) AS negative, count(*) FILTER (NOT ({_PARSED})) AS json_errors,
CASE WHEN count(*) FILTER (NOT ({_PARSED})) > 0 THEN 'PASS_WITH_JSON_PARSE_WARNINGS' ELSE 'PASS' END AS status, (SELECT h FROM i) AS index_sha256, (SELECT h FROM q) AS queue_sha256 FROM s""".replace("{{", "{").replace("}}", "}"))
def assimilate_tree(spark, sf_dir):
    """The receipt of documents as a tree of files; each twentieth is JSON, and as many only say so."""
    name = F.concat(F.concat_ws("/", "source", "doc_id"), F.when(F.col("doc_id") % 10 == 0, ".json").otherwise(".txt"))
    text = F.when(F.col("doc_id") % 20 == 0, F.to_json(F.struct("doc_id"))).otherwise(F.coalesce("text", F.lit("")))
    files_ = table(spark, sf_dir, "documents").select(name.alias("path"), text.alias("text"))
    return O.assimilate(files_, _PREFIX, _ROLES, _LEXICON, "(?i)not |no ")[2]
