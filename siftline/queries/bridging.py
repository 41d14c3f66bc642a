"""Queries: pull rounds, phrase matching, snapshots, quotas, context, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import bridges as B
from siftline.operators import context as C
from siftline.operators import pull as P
from siftline.operators import sieve as S
from siftline.operators import state as Z
from siftline.operators import tfidf as V
from siftline.plans.storage import saver
from siftline.queries import relations as R
from siftline.queries.mining import TOKENS, _vectors, n_docs, packed_vectors
from siftline.registry import SQL, query
from siftline.sources.tables import records, table

_TAGW = """tg AS (SELECT DISTINCT doc_id, unnest([lang, source]) AS tag FROM documents), tw AS (SELECT tag, CASE WHEN count(*) / (SELECT count(*) FROM documents) > 0.2 THEN 0::DOUBLE ELSE ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) END AS weight FROM tg GROUP BY tag),
tag AS (SELECT doc_id, tag, weight FROM tg JOIN tw USING (tag)), tt AS (SELECT doc_id, sum(weight) AS total FROM tag GROUP BY doc_id)"""
_DATES = f"dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(^|[^0-9A-Za-z_])((18|19|20)[0-9][0-9](-[0-9][0-9]-[0-9][0-9])?)($|[^0-9A-Za-z_])', 2)) AS date FROM documents), dn AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id)"
#: Seeds are the documents whose id is divisible by this; all others are candidates.
SEED = 50
#: Candidates so far behind a seed name it as their parent.
LINKED = 7


def _score_sql(n: int, cand: str, seed: str) -> str:
    """CTEs up to fs{n}: scores of the pairs of a candidate and a seed, conditions on their {d}.doc_id, that share anything."""
    both = f"{cand.format(d='x')} AND {seed.format(d='y')}"
    return f"""sem{n} AS (SELECT x.doc_id AS c, y.doc_id AS s, sum(x.weight * y.weight) AS sem FROM vectors x JOIN vectors y ON y.token = x.token AND {both} GROUP BY ALL),
tgs{n} AS (SELECT x.doc_id AS c, y.doc_id AS s, sum(x.weight) AS shared, max(x.weight) AS most FROM tag x JOIN tag y ON y.tag = x.tag AND {both} GROUP BY ALL),
dts{n} AS (SELECT x.doc_id AS c, y.doc_id AS s, count(*) AS n FROM dt x JOIN dt y ON y.date = x.date AND {both} GROUP BY ALL),
lk{n} AS (SELECT x.doc_id AS c, y.doc_id AS s FROM documents x JOIN documents y ON y.doc_id = x.doc_id - {LINKED} AND x.doc_id % {SEED} = {LINKED} AND {both}),
ks{n} AS (SELECT c, s FROM sem{n} UNION SELECT c, s FROM tgs{n} UNION SELECT c, s FROM dts{n} UNION SELECT c, s FROM lk{n}),
sc{n} AS (SELECT ks.c, ks.s, coalesce(sem, 0) AS sem, coalesce(CASE WHEN shared > 0 THEN shared / (a.total + b.total - shared) * least(1, shared / 1.5) END, 0) AS tag, coalesce(most >= 0.2, false) AS inf, coalesce(d.n / (da.n + db.n - d.n), 0) AS date, (ca.source != cb.source)::INT AS apart, lk.c IS NOT NULL AS explicit
FROM ks{n} ks LEFT JOIN sem{n} e ON e.c = ks.c AND e.s = ks.s LEFT JOIN tgs{n} g ON g.c = ks.c AND g.s = ks.s LEFT JOIN dts{n} d ON d.c = ks.c AND d.s = ks.s JOIN tt a ON a.doc_id = ks.c JOIN tt b ON b.doc_id = ks.s LEFT JOIN dn da ON da.doc_id = ks.c LEFT JOIN dn db ON db.doc_id = ks.s JOIN documents ca ON ca.doc_id = ks.c JOIN documents cb ON cb.doc_id = ks.s LEFT JOIN lk{n} lk ON lk.c = ks.c AND lk.s = ks.s),
fs{n} AS (SELECT *, {n} AS round, CASE WHEN explicit THEN 1::DOUBLE ELSE least(0.99::DOUBLE, 0.72 * sem + 0.16 * tag + 0.07 * date + 0.05 * apart) END AS score, explicit OR (tag > 0 AND inf) OR date > 0 AS structural FROM sc{n})"""


def _got_sql(n: int) -> str:
    """got{n} from bs{n}: what a round pulls."""
    return f"got{n} AS (SELECT * FROM bs{n} WHERE explicit OR (score >= 0.24 AND (structural OR sem >= 0.42)) ORDER BY round(score, 9) DESC, round(sem, 9) DESC, c LIMIT 100)"


_BEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(score, 12) DESC, round, s) AS r FROM {rows}) WHERE r = 1"
_OPEN = "{d}.doc_id % " + f"{SEED} != 0"
_SCORED = f"""{_vectors(1)}, {_TAGW}, {_DATES}, {_score_sql(1, _OPEN, "{d}.doc_id % " + f"{SEED} = 0")}, bs1 AS ({_BEST.format(rows="fs1")}), {_got_sql(1)}"""
_PULLED = f"""{_SCORED}, {_score_sql(2, _OPEN + " AND {d}.doc_id NOT IN (SELECT c FROM got1)", "{d}.doc_id IN (SELECT c FROM got1)")},
left2 AS (SELECT * EXCLUDE (r) FROM bs1 WHERE c NOT IN (SELECT c FROM got1) UNION ALL SELECT * FROM fs2), bs2 AS ({_BEST.format(rows="left2")}), {_got_sql(2)}"""


def _parts(spark, sf_dir):
    url = lambda c: F.concat(F.lit("https://docs.example.org/"), c.cast("string"))
    parent = F.when(F.col("ord") % SEED == LINKED, url(F.col("ord") - LINKED))
    r = records(spark, sf_dir).withColumns({"id": F.col("ord"), "source_url": url(F.col("ord")), "parent_url": parent})
    tags = V.tag_rows(r)
    weights = V.tag_idf(tags, n_docs(spark, sf_dir), "capped").select("tag", "weight")
    own = tags.select("id", "tag").join(weights, "tag").select("id", "tag", "weight")
    dates = r.select("id", F.explode(T.dates(F.col("text"))).alias("date"))
    seeds, candidates = r.filter(F.col("id") % SEED == 0), r.filter(F.col("id") % SEED != 0)
    return seeds, candidates, packed_vectors(spark, sf_dir), own, dates


@query("SELECT doc_id AS candidate, doc_id - 7 AS seed FROM documents WHERE doc_id % 50 = 7 AND doc_id - 7 IN (SELECT doc_id FROM documents)")
def explicit_link_join(spark, sf_dir):
    """Candidates that name a seed as their parent."""
    seeds, cands, *_ = _parts(spark, sf_dir)
    return P.explicit_links(cands, seeds).select(F.col("cid").alias("candidate"), F.col("sid").alias("seed"))


@query(f"WITH {_SCORED} SELECT c AS candidate, s AS seed, round(score, 5) AS score FROM bs1")
def best_seed_join(spark, sf_dir):
    seeds, cands, v, tags, dates = _parts(spark, sf_dir)
    best = P.best_seed(P.best_pairs(cands, seeds, v, tags, dates, P.explicit_links(cands, seeds)))
    return best.select(F.col("cid").alias("candidate"), F.col("sid").alias("seed"), F.round("score", 5).alias("score"))


@query(f"WITH {_SCORED} SELECT c AS candidate, s AS seed, round(score, 5) AS score FROM got1")
def ranked_pull(spark, sf_dir):
    seeds, cands, v, tags, dates = _parts(spark, sf_dir)
    best = P.best_seed(P.best_pairs(cands, seeds, v, tags, dates, P.explicit_links(cands, seeds)))
    return P.ranked_pull(best, 0.24, 0.42, 100).select(F.col("cid").alias("candidate"), F.col("sid").alias("seed"), F.round("score", 5).alias("score"))


@query(f"""WITH {_PULLED}, pulled AS (SELECT *, 1 AS pulled FROM got1 UNION ALL SELECT *, 2 FROM got2)
SELECT c AS id, pulled AS round, s AS connected_to, round(score, 6) AS score, round(sem, 6) AS sem, round(tag, 6) AS tag, CASE WHEN structural THEN 'CONNECTED_PULL' ELSE 'SPECULATIVE_SEMANTIC_PULL' END AS status FROM pulled""")
def selective_pull(spark, sf_dir):
    seeds, cands, v, tags, dates = _parts(spark, sf_dir)
    return P.selective_pull(seeds, cands, v, tags, dates, saver(spark), rounds=2)


# phrases

ALIASES = [("insult", "idiot"), ("insult", "clown"), ("licence", "licensed under"), ("licence", "license"), ("place", "the and")]
_AL = ", ".join(f"('{f}', '{a}')" for f, a in ALIASES)
_NORM = "array_to_string(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z0-9]+'), ' ')"
_TB = f"tb AS (SELECT doc_id, {_NORM.format(chr(97) + 'rray_to_string(regexp_split_to_array(text, ' + chr(39) + chr(92) + 's+' + chr(39) + ')[:8], ' + chr(39) + ' ' + chr(39) + ')')} AS t, {_NORM.format('text')} AS b FROM documents), al AS (SELECT * FROM (VALUES {_AL}) AS v(family, alias))"


def papers(spark, sf_dir):
    return records(spark, sf_dir).select(F.col("ord").alias("id"), "title", F.col("text").alias("body"))


@query(f"WITH {_TB} SELECT doc_id, family, round(max(CASE WHEN contains(t, alias) THEN 2 ELSE 1 END) + least(1::DOUBLE, 0.15::DOUBLE * count(*)), 6) AS score, count(*) AS hits FROM tb JOIN al ON contains(t, alias) OR contains(b, alias) GROUP BY ALL")
def match_substring(spark, sf_dir):
    out = B.match_substring(papers(spark, sf_dir), spark.createDataFrame(ALIASES, "family string, alias string"))
    return out.select(F.col("id").alias("doc_id"), "family", F.round("score", 6).alias("score"), "hits")


@query(f"""WITH {_TB}, m AS (SELECT doc_id, family, max(CASE WHEN contains(' ' || t || ' ', ' ' || alias || ' ') THEN 2 ELSE 1 END) + least(1::DOUBLE, 0.15::DOUBLE * count(*)) AS score, count(*) AS hits FROM tb JOIN al ON contains(' ' || t || ' ', ' ' || alias || ' ') OR contains(' ' || b || ' ', ' ' || alias || ' ')
WHERE family != 'insult' OR contains(' ' || b || ' ', ' the ') OR contains(' ' || t || ' ', ' the ') GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM m) SELECT doc_id, family, round(score, 6) AS score, hits FROM n WHERE family != 'place' OR n > 1""")
def match_strict(spark, sf_dir):
    out = B.match_strict(papers(spark, sf_dir), spark.createDataFrame(ALIASES, "family string, alias string"), {"insult": ["the"]}, "place")
    return out.select(F.col("id").alias("doc_id"), "family", F.round("score", 6).alias("score"), "hits")


ROUTES = [("insult", "hub", 0), ("insult", "west", 1), ("licence", "hub", 0), ("licence", "gone", 1)]
_BR = f"""{_TB}, m AS (SELECT doc_id, family, max(CASE WHEN contains(t, alias) THEN 2 ELSE 1 END) + least(1::DOUBLE, 0.15::DOUBLE * count(*)) AS score FROM tb JOIN al ON contains(t, alias) OR contains(b, alias) GROUP BY ALL),
rt AS (SELECT doc_id, string_agg(family, ',' ORDER BY family) AS families, round(sum(score), 6) AS route_score FROM m GROUP BY doc_id), top AS (SELECT * FROM rt ORDER BY route_score DESC, doc_id::VARCHAR LIMIT 80),
br AS (SELECT doc_id::VARCHAR AS source_id, 'CANDIDATE' AS kind, families, route_score FROM top UNION ALL SELECT 'source:' || n_name, 'CANONICAL', CASE WHEN n_regionkey = 0 THEN 'insult' ELSE 'place' END, NULL FROM nation)"""
_ANCHORED = "CASE WHEN contains(families, 'insult') THEN 'hub,west' WHEN contains(families, 'licence') THEN 'hub' ELSE '' END"


def _frames(spark):
    return spark.createDataFrame(ALIASES, "family string, alias string"), spark.createDataFrame(ROUTES, "family string, anchor string, place int"), spark.createDataFrame([("hub",), ("west",)], "anchor string")


def _bridges(spark, sf_dir):
    aliases, routes, anchors = _frames(spark)
    sources = table(spark, sf_dir, "nation").select(F.concat(F.lit("source:"), "n_name").alias("id"), F.array(F.when(F.col("n_regionkey") == 0, "insult").otherwise("place")).alias("families"))
    return B.assemble_bridges(papers(spark, sf_dir), aliases, routes, anchors, sources)


@query(f"WITH {_BR} SELECT source_id, kind, families, route_score, {_ANCHORED} AS anchors FROM br")
def assemble_bridges(spark, sf_dir):
    """The 80 best documents (a top-k report) and the nations as given sources."""
    return _bridges(spark, sf_dir).select("source_id", "kind", F.array_join("families", ",").alias("families"), "route_score", F.array_join("anchors", ",").alias("anchors"))


@query(f"WITH {_BR} SELECT source_id, {_ANCHORED} AS anchors, {_ANCHORED} != '' AS routed FROM br")
def enrich_routes(spark, sf_dir):
    _, routes, anchors = _frames(spark)
    return B.enrich_routes(_bridges(spark, sf_dir), routes, anchors).select("source_id", F.array_join("anchors", ",").alias("anchors"), "routed")


@query(f"""WITH {_BR}, sm AS (SELECT doc_id, family, max(CASE WHEN contains(' ' || t || ' ', ' ' || alias || ' ') THEN 2 ELSE 1 END) + least(1::DOUBLE, 0.15::DOUBLE * count(*)) AS score FROM tb JOIN al ON contains(' ' || t || ' ', ' ' || alias || ' ') OR contains(' ' || b || ' ', ' ' || alias || ' ')
WHERE family != 'insult' OR contains(' ' || b || ' ', ' the ') OR contains(' ' || t || ' ', ' the ') GROUP BY ALL), sn AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sm), sr AS (SELECT doc_id, string_agg(family, ',' ORDER BY family) AS families, round(sum(score), 6) AS route_score FROM sn WHERE family != 'place' OR n > 1 GROUP BY doc_id)
SELECT rt.doc_id, sr.doc_id IS NOT NULL AS kept, sr.families, sr.route_score, rt.families AS old_families FROM rt LEFT JOIN sr ON sr.doc_id = rt.doc_id""")
def strict_refine(spark, sf_dir):
    """Every document with a family, matched again on whole words and with context."""
    aliases, _, _ = _frames(spark)
    rows = papers(spark, sf_dir)
    found = B.match_substring(rows, aliases).groupBy("id").agg(F.array_sort(F.collect_set("family")).alias("families"))
    out = B.strict_refine(rows, found, aliases, {"insult": ["the"]}, "place")
    return out.select(F.col("id").alias("doc_id"), "kept", F.array_join("families", ",").alias("families"), "route_score", F.array_join("old_families", ",").alias("old_families"))


_WORDS = {"abuse": ["idiot", "moron", "the and"], "legal": ["license", "all rights", "apache"]}


def _kw(words: list[str]) -> tuple[str, str]:
    n = " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)
    return n, " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {B.keyword_weight(w)}::DOUBLE ELSE 0 END" for w in words)


_KW = " UNION ALL ".join(f"SELECT '{o}' AS operator, doc_id AS path, CASE WHEN {_kw(w)[0]} >= 2 THEN {_kw(w)[1]} ELSE 0 END AS score FROM documents" for o, w in _WORDS.items())


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lower("text").alias("text"))


@query(f"WITH k AS ({_KW}), r AS (SELECT *, row_number() OVER (PARTITION BY operator ORDER BY round(score, 6) DESC, path) AS rank FROM k WHERE score > 0) SELECT operator, path, round(score, 6) AS score, rank FROM r WHERE rank <= 12")
def keyword_rank(spark, sf_dir):
    return B.keyword_rank(_files(spark, sf_dir), _WORDS).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id AS path, {_kw(['idiot', 'clown', 'the '])[1]} AS score FROM documents WHERE (contains(lower(text), 'idiot') OR contains(lower(text), 'clown')) AND contains(lower(text), 'the ')")
def match_conjunctive(spark, sf_dir):
    return _files(spark, sf_dir).select("path", B.match_conjunctive(F.col("text"), [["idiot", "clown"], ["the "]]).alias("score")).filter("score > 0")


def _ranked(rows):
    return B.keyword_rank(rows, _WORDS, 1_000_000_000)


@query(f"""WITH k AS (SELECT * FROM ({_KW}) WHERE score > 0), o AS (SELECT * FROM (VALUES ('abuse'), ('legal')) AS v(operator)), c AS (SELECT operator, count(DISTINCT path) FILTER (WHERE path % 2 = 0) AS before, count(DISTINCT path) FILTER (WHERE path % 2 = 1) AS now FROM k GROUP BY operator)
SELECT operator, before, now, CASE WHEN before > 0 THEN 'PREEXISTING' WHEN now > 0 THEN 'TODAY_ONLY' ELSE 'DARK' END AS state FROM c""")
def snapshot_relations(spark, sf_dir):
    """Documents of even and odd ids as two snapshots."""
    f = _files(spark, sf_dir)
    return B.snapshot_relations(_ranked(f.filter("path % 2 = 0")), _ranked(f.filter("path % 2 = 1")))


@query(f"WITH k AS (SELECT * FROM ({_KW}) WHERE score > 0) SELECT path, count(DISTINCT operator) AS operators, round(sum(score), 6) AS score, path % 2 = 0 AS known FROM k GROUP BY path ORDER BY operators DESC, score DESC, path LIMIT 25")
def hub_ranking(spark, sf_dir):
    f = _files(spark, sf_dir)
    return B.hub_ranking(_ranked(f), f.filter("path % 2 = 0")).withColumn("score", F.round("score", 6))


_FAMILIES = {"abuse": ["idiot", "moron"], "licence": [r"licen[cs]e", "all rights reserved"], "number": ["[0-9]{4}"], "symbol": ["†", r"U\+2020"]}
_AUDIT = """d AS (SELECT d.doc_id, coalesce(d.text, '') AS text, d.source, EXISTS (FROM labels l WHERE l.doc_id = d.doc_id) AS old FROM documents d),
h AS (SELECT doc_id, old, unnest(['abuse', 'licence', 'number', 'symbol']) AS family, unnest([regexp_matches(text, 'idiot|moron', 'i'), regexp_matches(text, 'licen[cs]e|all rights reserved', 'i'), regexp_matches(text, '[0-9]{4}'), regexp_matches(text, '†|U\\+2020', 'i')]) AS hit FROM d),
a AS (SELECT family, count(DISTINCT CASE WHEN hit AND old THEN doc_id END) AS before, count(DISTINCT CASE WHEN hit THEN doc_id END) AS now FROM h GROUP BY family),
p AS (SELECT min(doc_id) AS doc_id FROM d WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT p.doc_id, d.old, sha256(d.text) AS sha256, regexp_matches(d.text, 'licen[cs]e|the', 'i') AS has_meaning, regexp_matches(d.text, 'not.*proof', 'is') AS has_guard FROM p JOIN d ON d.doc_id = p.doc_id)"""


def _snapshots(spark, sf_dir):
    """Labelled documents as the earlier snapshot, all as the later one, each source's first document as an anchor."""
    docs = table(spark, sf_dir, "documents")
    now = docs.select(F.col("doc_id").alias("path"), "text")
    before = now.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")), "path", "left_semi")
    return before, now, docs.filter("source is not null").groupBy("source").agg(F.min("doc_id").alias("path"))


def _anchors(files, anchors):
    return B.anchor_state(files, anchors, "licen[cs]e|the", "not.*proof")


@query(f"WITH {_AUDIT} SELECT family, before, now, CASE WHEN before > 0 THEN 'PREEXISTING' WHEN now > 0 THEN 'TODAY_ONLY' ELSE 'DARK' END AS state FROM a")
def snapshot_family_audit(spark, sf_dir):
    before, now, _ = _snapshots(spark, sf_dir)
    return B.family_audit(before, now, _FAMILIES)


@query(f"WITH {_AUDIT} SELECT doc_id, old AS present, CASE WHEN old THEN sha256 END AS sha256, CASE WHEN old THEN has_meaning END AS has_meaning, CASE WHEN old THEN has_guard END AS has_guard FROM s")
def snapshot_anchors(spark, sf_dir):
    before, _, anchors = _snapshots(spark, sf_dir)
    return _anchors(before, anchors).withColumnRenamed("path", "doc_id")


@query(f"""WITH {_AUDIT}, c AS (SELECT count(*) FILTER (WHERE old AND has_meaning) AS ab, count(*) FILTER (WHERE has_meaning) AS an FROM s), v AS (SELECT sum(before) FILTER (WHERE family IN ('abuse', 'licence')) AS i, sum(before) FILTER (WHERE family = 'symbol') AS e, sum(now) FILTER (WHERE family = 'symbol') AS en FROM a)
SELECT ab AS anchors_before, an AS anchors_now, CASE WHEN ab >= 3 AND i > 0 THEN 'HARD_PASS' ELSE 'NOT_ESTABLISHED' END AS preexistence, CASE WHEN ab > 0 THEN 'PASS' ELSE 'FAIL' END AS contained_before, CASE WHEN e > 0 THEN 'PASS' ELSE 'NOT_FOUND' END AS exact_before, en::BIGINT AS exact_now, CASE WHEN ab >= 3 AND i > 0 THEN 'HIGH' ELSE 'UNRESOLVED' END AS stable_anchor FROM c, v""")
def snapshot_verdict(spark, sf_dir):
    before, now, anchors = _snapshots(spark, sf_dir)
    return B.audit_verdict(B.family_audit(before, now, _FAMILIES), _anchors(before, anchors), _anchors(now, anchors), ["abuse", "licence"], "symbol")


@query(f"WITH {_AUDIT}, f AS (SELECT DISTINCT doc_id, family FROM h WHERE hit) SELECT x.family AS a, y.family AS b, count(*) AS n FROM f x JOIN f y ON y.doc_id = x.doc_id AND x.family < y.family GROUP BY ALL")
def snapshot_cooccurrence(spark, sf_dir):
    _, now, _ = _snapshots(spark, sf_dir)
    return S.cooccurrence(B.family_files(now, _FAMILIES).withColumnRenamed("path", "id"), ["id"]).drop("documents")


@query("WITH r AS (SELECT doc_id, lang, source FROM documents) SELECT doc_id, CASE WHEN lang = 'en' THEN 'hub,west' WHEN lang = 'de' THEN 'hub,north' ELSE 'hub' END AS anchors FROM r WHERE lang IN ('en', 'de', 'fr')")
def anchor_route_join(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("families"))
    routes = spark.createDataFrame([("en", "hub", 0), ("en", "west", 1), ("de", "hub", 0), ("de", "north", 1), ("fr", "hub", 0), ("fr", "gone", 1)], "family string, anchor string, place int")
    anchors = spark.createDataFrame([("hub",), ("west",), ("north",)], "anchor string")
    return B.anchor_routes(rows, routes, anchors).select(F.col("id").alias("doc_id"), F.array_join("anchors", ",").alias("anchors"))


@query()
def quota_assign(spark, sf_dir):
    """Documents that fill a slot of their language or source."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("families"))
    return B.quota_assign(rows, {"en": 200, "de": 100, "src3": 30, "src4": 20})


@query("""WITH a AS (SELECT o_orderkey AS id, o_custkey AS who FROM orders), w AS (SELECT l_orderkey AS id, list_distinct(list(l_suppkey)) AS w FROM lineitem GROUP BY 1)
SELECT x.id AS a, y.id AS b, 1::DOUBLE AS authors, round(len(list_intersect(wx.w, wy.w)) / len(list_distinct(wx.w || wy.w)), 6) AS titles FROM a x JOIN a y ON x.who = y.who AND x.id < y.id JOIN w wx ON wx.id = x.id JOIN w wy ON wy.id = y.id WHERE len(list_intersect(wx.w, wy.w)) / len(list_distinct(wx.w || wy.w)) >= 0.2""")
def lineage_pairs(spark, sf_dir):
    """Orders of one customer whose suppliers overlap, as works of one author whose titles do."""
    words = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("words"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_custkey").alias("authors")).join(words, "id")
    return B.lineage_pairs(rows, 0.2).withColumn("titles", F.round("titles", 6))


@query("SELECT source AS repo, c AS concept, count(*) AS files FROM documents JOIN (VALUES ('licence', '(?i)license'), ('abuse', 'idiot|moron')) AS v(c, p) ON regexp_matches(text, p) GROUP BY ALL")
def concept_coverage(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), "text")
    return B.concept_coverage(files, {"licence": "(?i)license", "abuse": "idiot|moron"})[0]


@query("SELECT source AS repo, c AS concept, doc_id AS path, row_number() OVER (PARTITION BY source, c ORDER BY doc_id) AS rank FROM documents JOIN (VALUES ('licence', '(?i)license'), ('abuse', 'idiot|moron')) AS v(c, p) ON regexp_matches(text, p) QUALIFY rank <= 20")
def concept_audit(spark, sf_dir):
    """The evidence behind concept_coverage: up to twenty files for each concept and repository, its report's length."""
    files = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), "text")
    return B.concept_coverage(files, {"licence": "(?i)license", "abuse": "idiot|moron"})[1].select("repo", "concept", "path", "rank")


# context

#: Values of every field of a document. Digits and clock times are taken as whole runs, which is what the patterns' look-arounds ask for.
_OBS = r"""pr AS (SELECT doc_id, regexp_extract(text, '(-?[0-9]{1,2}\.[0-9]+)\s*,\s*(-?[0-9]{1,3}\.[0-9]+)', 1) AS lat, regexp_extract(text, '(-?[0-9]{1,2}\.[0-9]+)\s*,\s*(-?[0-9]{1,3}\.[0-9]+)', 2) AS lon FROM documents),
ok AS (SELECT * FROM pr WHERE lat != '' AND abs(try_cast(lat AS DOUBLE)) <= 90 AND abs(try_cast(lon AS DOUBLE)) <= 180),
ob AS (SELECT doc_id, 'origin' AS facet, 'source' AS field, source AS value FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, 'origin', 'language', lang FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT doc_id, 'time', 'iso_date', unnest(list_distinct(regexp_extract_all(text, '(^|[^0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})($|[^0-9])', 2))) FROM documents
UNION ALL SELECT doc_id, 'time', 'year', unnest(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: regexp_full_match(x, '(18|19|20)[0-9]{2}')))) FROM documents
UNION ALL SELECT doc_id, 'time', 'clock', unnest(list_distinct(list_filter(regexp_extract_all(text, '[0-9:]+'), lambda x: regexp_full_match(x, '([01][0-9]|2[0-3]):[0-5][0-9]')))) FROM documents
UNION ALL SELECT doc_id, 'place', 'latitude', lat FROM ok UNION ALL SELECT doc_id, 'place', 'longitude', lon FROM ok)"""
_COVERED = f"""{_OBS}, want AS (SELECT * FROM (VALUES ('time', 3), ('place', 2), ('origin', 2)) AS v(facet, fields)), have AS (SELECT doc_id, facet, count(DISTINCT field) AS known FROM ob GROUP BY ALL),
cov AS (SELECT doc_id::VARCHAR AS subject, want.facet, coalesce(known, 0) AS known, fields FROM documents CROSS JOIN want LEFT JOIN have USING (doc_id, facet))"""


def _context(spark, sf_dir):
    rows = records(spark, sf_dir).select(F.col("ord").cast("string").alias("subject"), "ord", "text", F.col("provider").alias("source"), F.element_at("relation_tags", 1).alias("lang"))
    return rows, C.observations(rows, "pass-1")


@query(f"WITH {_OBS} SELECT facet, field, count(*) AS n, count(DISTINCT doc_id) AS subjects FROM ob GROUP BY ALL")
def context_build(spark, sf_dir):
    _, obs = _context(spark, sf_dir)
    return obs.groupBy("facet", "field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("subjects"))


@query(f"WITH {_COVERED} SELECT subject, facet, known, fields, CASE WHEN known = 0 THEN 'MISSING' WHEN known < fields THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM cov")
def context_coverage(spark, sf_dir):
    rows, obs = _context(spark, sf_dir)
    return C.coverage(obs, rows, spark.createDataFrame(list(C.REGISTRY), "facet string, field string"))


_SECOND = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'xx' ELSE lang END AS lang, lang AS was FROM documents"


@query(f"""WITH {_COVERED} SELECT count(DISTINCT subject) AS subjects, count(*) FILTER (known = fields) AS complete, count(*) FILTER (known > 0 AND known < fields) AS partial, count(*) FILTER (known = 0) AS missing, count(*) FILTER (known < fields) AS tasks,
(SELECT count(*) FILTER (WHERE lang != was) FROM ({_SECOND})) AS conflicts FROM cov""")
def fur_receipt(spark, sf_dir):
    """Facets of all documents by status, and conflicts of a second pass with the first."""
    rows, obs = _context(spark, sf_dir)
    first, second = _origins(spark, sf_dir)
    covered = C.coverage(obs, rows, spark.createDataFrame(list(C.REGISTRY), "facet string, field string"))
    return C.receipt(covered, C.merge(first, second)[1])


@query(f"""WITH {_COVERED} SELECT (SELECT count(*) FROM ({SQL['calibrate_edges']})) AS edges, (SELECT count(*) FROM ({SQL['edge_attention']})) AS attention_edges,
(SELECT count(*) FROM ({SQL['focus_rank']})) AS attention_nodes, (SELECT count(*) FILTER (focus_state IN ('PRIMARY_FOCUS', 'ACTIVE_FOCUS')) FROM ({SQL['focus_rank']})) AS active_focus_nodes,
count(*) AS subjects, round(avg(share), 6) AS mean_coverage FROM (SELECT subject, sum(known) / sum(fields) AS share FROM cov GROUP BY subject)""")
def package_stats(spark, sf_dir):
    """Counts of the edges of two passes, their attention and focus, and the context of all documents."""
    rows, obs = _context(spark, sf_dir)
    covered = C.coverage(obs, rows, spark.createDataFrame(list(C.REGISTRY), "facet string, field string"))
    return Z.package_stats(R.two_passes(spark, sf_dir), R.attention(spark, sf_dir), R.focus_rank(spark, sf_dir), covered)


def _origins(spark, sf_dir):
    """Origins of two passes; the second reads another language for every third document."""
    rows, _ = _context(spark, sf_dir)
    again = rows.withColumn("lang", F.when(F.col("ord") % 3 == 0, "xx").otherwise(F.col("lang")))
    return C.observations(rows, "pass-1", ("origin",)), C.observations(again, "pass-2", ("origin",))


@query(f"SELECT (SELECT count(source) + count(lang) FROM documents) AS fresh, 0::BIGINT AS replayed, count(*) FILTER (WHERE lang IS DISTINCT FROM was) AS changed, count(*) FILTER (WHERE lang != was) AS conflicts FROM ({_SECOND})")
def context_merge(spark, sf_dir):
    """Merging a pass into nothing adds all of it; merging it again adds nothing; a differing pass adds what it changed and is in conflict there."""
    first, second = _origins(spark, sf_dir)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    changed, clash = C.merge(first, second)
    return count(C.merge(first.limit(0), first)[0], "fresh").crossJoin(count(C.merge(first, first)[0], "replayed")).crossJoin(count(changed, "changed")).crossJoin(count(clash, "conflicts"))


@query(f"SELECT doc_id::VARCHAR AS subject, 'language' AS field, lang AS value, was AS other FROM ({_SECOND}) WHERE lang != was")
def context_conflicts(spark, sf_dir):
    """What a second pass says otherwise than the first; both values stay."""
    first, second = _origins(spark, sf_dir)
    return C.merge(first, second)[1].select("subject", "field", "value", "other")
