"""Queries: records, pages, search, graphs, sieve, state over passes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.functions.hashing import source_family
from siftline.operators import graph as G
from siftline.operators import merging as M
from siftline.operators import search as S
from siftline.operators import sieve as C
from siftline.operators import state as Z
from siftline.operators import tfidf as V
from siftline.operators.index import Index, append
from siftline.plans.storage import new_folder, saver, written
from siftline.queries.keys import NODES_V1
from siftline.queries.mining import _TAGS, SIMILAR, WHOLE, _vectors, n_docs, pair_sql, token_sql
from siftline.registry import query
from siftline.sources import web
from siftline.sources.tables import records, table


@query(r"""SELECT doc_id, source AS provider, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, sha256('{"archive_id":"' || doc_id || '","provider":"' || source || '"}') AS record_sha256 FROM documents""")
def make_archive_record(spark, sf_dir):
    from siftline.functions.hashing import row_sha

    rows = records(spark, sf_dir)
    return rows.select(F.col("ord").alias("doc_id"), "provider", T.squeezed(F.col("text")).alias("text"), row_sha("archive_id", "provider").alias("record_sha256"))


@query("SELECT doc_id, source FROM documents WHERE (contains(lower(text), 'idiot') OR contains(lower(text), 'license')) AND contains(lower(text), 'the')")
def search_records(spark, sf_dir):
    return S.needles(table(spark, sf_dir, "documents"), ("Idiot", "license"), ("the",), field="text").select("doc_id", "source")


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'null' ELSE 'string' END AS kind FROM documents UNION ALL SELECT 'number' FROM documents) GROUP BY kind")
def profile_records(spark, sf_dir):
    from siftline.sources.records import type_census

    return type_census(table(spark, sf_dir, "documents").select("text", "n_chars"))


@query("WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type FROM r WHERE r = 1")
def dedup_latest(spark, sf_dir):
    return M.dedup_latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_type", "event_id")


@query("SELECT conv_id, role, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def dedup_last(spark, sf_dir):
    return M.dedup_last(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text"), ["conv_id", "role"], "turn")


@query("WITH b AS (SELECT user_id, event_id, value, (event_id % 2)::INT AS b FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY b DESC, event_id DESC) AS r FROM b) SELECT user_id, event_id, value FROM r WHERE r = 1")
def merge_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return M.merge_records(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "event_id")


@query("SELECT d.doc_id AS a, p.doc_id AS b FROM documents d JOIN documents p ON p.doc_id = d.doc_id - 7 AND p.source = 'src' || ((d.doc_id - 7) % 20) WHERE d.doc_id % 5 = 0 AND p.source IS NOT NULL")
def lineage_edges(spark, sf_dir):
    r = records(spark, sf_dir)
    parent = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("https://src"), ((F.col("ord") - 7) % 20).cast("string"), F.lit(".example.org/"), (F.col("ord") - 7).cast("string")))
    out = M.lineage_edges(r.withColumn("parent_url", parent))
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("long")
    return out.select(number("a").alias("a"), number("b").alias("b"))


@query("""WITH p AS (SELECT doc_id AS id, trim(regexp_replace(lower(array_to_string(regexp_split_to_array(text, '\\s+')[:8], ' ')), '[^a-z0-9]+', ' ', 'g')) AS t, CASE WHEN doc_id % 4 = 0 THEN '10.9/w' || (doc_id // 12) END AS doi, source, n_chars, lang FROM documents),
k AS (SELECT *, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN t != '' THEN 'title:' || t || '|' || source ELSE 'id:' || id END AS key FROM p)
SELECT key, (arg_max(id, (n_chars, lang, id))) AS id, max(n_chars) AS score, count(*) AS versions, array_to_string(list_sort(list(DISTINCT lang)), ',') AS families FROM k GROUP BY key""")
def dedupe_publications(spark, sf_dir):
    """Documents as publications; each fourth has a DOI, in three spellings, which three of them share."""
    r = records(spark, sf_dir)
    work = F.concat(F.lit("10.9/W"), F.floor(F.col("ord") / 12).cast("string"))
    doi = F.when(F.col("ord") % 12 == 0, F.concat(F.lit("https://doi.org/"), work)).when(F.col("ord") % 12 == 4, F.concat(F.lit("doi: "), work)).when(F.col("ord") % 12 == 8, work)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "n_chars", "lang")
    rows = r.join(docs, "ord").select(F.col("ord").alias("id"), doi.alias("doi"), "title", F.col("provider").alias("first_author"), F.col("n_chars").alias("score"), F.col("lang").alias("updated"), F.array("lang").alias("families"))
    return M.dedupe_publications(rows).withColumn("families", F.array_join("families", ","))


# pages


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text, len(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS n_links FROM pages""")
def parse_html_pages(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", web.page_title(h).alias("title"), web.page_text(h).alias("text"), F.size(web.links(h)).cast("long").alias("n_links"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"


@query(f"SELECT page_id, {_HOST} AS host, {_HOST} = 'example.com' OR ends_with({_HOST}, '.example.com') AS allowed FROM pages")
def host_allowlist(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.host(F.col("url")).alias("host"), web.on_hosts(F.col("url"), ["example.com"]).alias("allowed"))


@query(f"WITH p AS (SELECT page_id, {_HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) AS path FROM pages) SELECT page_id FROM p WHERE host = (SELECT min(host) FROM p) AND (rtrim(path, '/') = '/en' OR starts_with(path, '/en/'))")
def collection_boundary(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    first = pages.agg(F.min(web.host(F.col("url")))).first()[0]
    return pages.filter(web.inside(F.col("url"), first, "/en")).select("page_id")


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), lambda u: u || CASE WHEN length(u) % 3 = 0 THEN '.PDF?page=1' WHEN length(u) % 3 = 1 THEN '.html' ELSE '.zip#part' END), lambda u: regexp_matches(regexp_replace(u, '[?#].*$', ''), '(?i)\.(pdf|zip|jpg|png|mp4|tif)$'))))[:100], ' ') AS links FROM pages""")
def binary_pointers(spark, sf_dir):
    """Links to files by suffix. These pages name no files, so each link gets a suffix by its length."""
    named = F.transform(web.links(F.col("html")), lambda u: F.concat(u, F.when(F.length(u) % 3 == 0, ".PDF?page=1").when(F.length(u) % 3 == 1, ".html").otherwise(".zip#part")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(web.binary_pointers(named), " ").alias("links"))


@query(r"""WITH l AS (SELECT page_id, u.url, u.pos FROM pages, LATERAL (SELECT unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1)) AS url, generate_subscripts(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), 1) AS pos) u),
i AS (SELECT *, lower(regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1)) AS id FROM l WHERE contains(url, '/')) SELECT id, arg_min(url, (page_id, pos)) AS url FROM i WHERE id != '' GROUP BY id""")
def parse_collection_listing(spark, sf_dir):
    return web.collection_listing(table(spark, sf_dir, "pages").select("page_id", "html"), "/")


# search

_BM = """f AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(array_to_string(regexp_split_to_array(text, '\\s+')[:8], ' ')), 'ß', 'ss'), '[a-z0-9]+')) AS token, 3.0 AS w FROM documents
UNION ALL SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+')), 1.5 FROM documents),
p AS (SELECT doc_id, token, sum(w) AS tf, count(*) AS c FROM f GROUP BY ALL), l AS (SELECT doc_id, sum(c) AS length FROM p GROUP BY doc_id), m AS (SELECT avg(length) AS mean FROM l), n AS (SELECT count(*) AS n FROM documents),
h AS (SELECT * FROM p WHERE token IN ('idiot', 'license', 'apache', 'trash')), d AS (SELECT token, count(*) AS df FROM h GROUP BY token),
s AS (SELECT doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))) AS score, count(*) AS matched FROM h JOIN d USING (token) JOIN l USING (doc_id), m, n GROUP BY doc_id)"""
_QUERY = ["idiot", "license", "apache", "trash"]


_BM_WEIGHTS = {"title": 3.0, "text": 1.5}


def _index(spark, sf_dir):
    """What gives the postings of some tokens in all documents, and the documents' mean length."""
    r = records(spark, sf_dir).select(F.col("ord").alias("id"), "title", "text")
    return (lambda words: S.postings(r, _BM_WEIGHTS, words)), S.mean_length(r, _BM_WEIGHTS)


@query(f"WITH {_BM} SELECT doc_id, round(score, 5) AS score, matched FROM s")
def bm25_search(spark, sf_dir):
    index, mean = _index(spark, sf_dir)
    return S.bm25(index(_QUERY), n_docs(spark, sf_dir), _QUERY, mean=mean).select(F.col("id").alias("doc_id"), F.round("score", 5).alias("score"), "matched")


@query(f"WITH {_BM} SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s ORDER BY rank LIMIT 20")
def search_rank(spark, sf_dir):
    top = _searched(spark, sf_dir, 20)
    return top.select(F.col("id").alias("doc_id"), F.row_number().over(W.orderBy(F.round("score", 9).desc(), "id")).alias("rank"))


@query(f"WITH {_BM} SELECT doc_id, round(score, 5) AS score, matched FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 50")
def search_limit(spark, sf_dir):
    """The fifty best documents of a stored index that was written in two batches."""
    return _searched(spark, sf_dir, 50).select(F.col("id").alias("doc_id"), F.round("score", 5).alias("score"), "matched")


def _searched(spark, sf_dir, limit):
    docs = records(spark, sf_dir).select(F.col("ord").alias("id"), "title", "text", "provider")
    path = new_folder(spark, "index")
    late = F.pmod(F.crc32(F.col("provider").cast("binary")), F.lit(2)) == 1
    for name, part in (("early", docs.filter(~F.coalesce(late, F.lit(False)))), ("late", docs.filter(late))):
        append(part.drop("provider"), {"title": 3.0, "text": 1.5}, path, name)
    return Index(spark, path).search(_QUERY, limit)


_TOPIC = "Apache license, trash or an idiot"


@query("WITH " + _BM.replace("('idiot', 'license', 'apache', 'trash')", "('apache', 'license', 'trash', 'idiot')") + f""", r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 100)
SELECT rank, doc_id, '(all:"{_TOPIC}" OR (all:apache AND all:license AND all:trash AND all:idiot))' AS query, round(score, 5) AS score, matched, sha256('{_TOPIC}|' || rank || '|' || doc_id || '|https://' || source || '.example.org/' || doc_id) AS route_sha256 FROM r JOIN documents USING (doc_id)""")
def investigate(spark, sf_dir):
    """A topic's hundred best documents as candidates for review."""
    docs = records(spark, sf_dir).select(F.col("ord").alias("id"), "title", "source_url")
    index, mean = _index(spark, sf_dir)
    found = S.investigate(index, n_docs(spark, sf_dir), docs, _TOPIC, mean=mean)
    return found.select("rank", F.col("id").alias("doc_id"), "query", F.round("score", 5).alias("score"), "matched", "route_sha256")


_FED = """u AS (SELECT 'documents:' || doc_id AS id, '' AS title, text AS body, lang AS extra FROM documents UNION ALL SELECT 'turns:' || conv_id || '/' || turn, coalesce(role, ''), coalesce(text, ''), '' FROM conversations UNION ALL SELECT 'benchmark:' || item_id, '', text, '' FROM benchmark),
f AS (SELECT id, unnest(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '[a-z0-9]+')) AS token, 3.0 AS w FROM u UNION ALL SELECT id, unnest(regexp_extract_all(replace(lower(body), 'ß', 'ss'), '[a-z0-9]+')), 1.5 FROM u UNION ALL SELECT id, unnest(regexp_extract_all(replace(lower(extra), 'ß', 'ss'), '[a-z0-9]+')), 1.0 FROM u),
p AS (SELECT id, token, sum(w) AS tf, count(*) AS c FROM f GROUP BY ALL), l AS (SELECT id, sum(c) AS length FROM p GROUP BY id), m AS (SELECT avg(length) AS mean FROM l), n AS (SELECT count(*) AS n FROM u),
h AS (SELECT * FROM p WHERE token IN ('idiot', 'license', 'user', 'the')), d AS (SELECT token, count(*) AS df FROM h GROUP BY token),
s AS (SELECT id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))) AS score, count(*) AS matched FROM h JOIN d USING (token) JOIN l USING (id), m, n GROUP BY id)"""


_FED_QUERY = ["idiot", "license", "user", "the"]
_FED_WEIGHTS = {"title": 3.0, "body": 1.5, "extra": 1.0}


def _corpora(spark, sf_dir):
    doc = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("body"), F.col("lang").alias("extra"))
    turn = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("role").alias("title"), F.col("text").alias("body"), F.lit("").alias("extra"))
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("body"), F.lit("").alias("extra"))
    return {"documents": doc, "turns": turn, "benchmark": item}


@query(f"WITH {_FED} SELECT id, split_part(id, ':', 1) AS source, round(score, 5) AS score, matched FROM s")
def federated_search(spark, sf_dir):
    """BM25 over three corpora as one: titles weigh 3, bodies 1.5, the rest 1; every record that has one of the words, with its score."""
    union = S.federated(_corpora(spark, sf_dir))
    found = S.bm25(S.postings(union, _FED_WEIGHTS, _FED_QUERY), union.agg(F.count(F.lit(1)).alias("n")), _FED_QUERY, mean=S.mean_length(union, _FED_WEIGHTS))
    return found.select("id", F.split("id", ":")[0].alias("source"), F.round("score", 5).alias("score"), "matched")


@query(f"WITH {_FED} SELECT row_number() OVER (ORDER BY round(score, 9) DESC, id)::INTEGER AS rank, id, split_part(id, ':', 1) AS source, round(score, 5) AS score, matched FROM s ORDER BY rank LIMIT 50")
def federated_rank(spark, sf_dir):
    """The fifty best records of the federation, from a stored index to which each corpus is added as a batch."""
    path = new_folder(spark, "index")
    for name, part in _corpora(spark, sf_dir).items():
        append(S.federated({name: part}).drop("source"), _FED_WEIGHTS, path, name)
    best = Index(spark, path).search(_FED_QUERY, 50)
    return best.select(F.row_number().over(W.orderBy(F.round("score", 9).desc(), "id")).alias("rank"), "id", F.split("id", ":")[0].alias("source"), F.round("score", 5).alias("score"), "matched")


# graph

_W = f"{_TAGS}, w AS (SELECT tag, CASE WHEN count(*) / any_value(n) > 0.2 THEN 0 ELSE ln((1 + any_value(n)) / (1 + count(*))) END AS weight FROM tags, docs GROUP BY tag)"


def graph_vectors(spark, sf_dir):
    """(id, vector) of title, text and tags."""
    r = records(spark, sf_dir)
    whole = T.text_of(F.col("title"), F.col("text"), None, F.col("relation_tags"))
    return written(V.vectors(r.select(F.col("ord").alias("id"), whole.alias("whole")), F.col("whole"), n_docs(spark, sf_dir), count=T.word_counter()), "weights")


def tag_entities(spark, sf_dir):
    """(id, kind, value, weight): tags with capped weights."""
    tags = V.tag_rows(records(spark, sf_dir))
    weights = V.tag_idf(tags, n_docs(spark, sf_dir), "capped").select("tag", "weight")
    return tags.join(weights, "tag").select("id", F.lit("tag").alias("kind"), F.col("tag").alias("value"), "weight")


def entities(spark, sf_dir, v):
    """(id, kind, value, weight): tags with capped weights, dates, and salient keywords of documents by their vectors."""
    r = records(spark, sf_dir)
    dates = r.select("id", F.lit("date").alias("kind"), F.explode(T.dates(F.col("text"))).alias("value"), F.lit(None).cast("double").alias("weight"))
    words = V.salient_of(v).join(r.select(F.col("ord").alias("n"), F.col("id").alias("name")), F.col("id") == F.col("n")).select(F.col("name").alias("id"), F.lit("keyword").alias("kind"), F.col("token").alias("value"), F.lit(None).cast("double").alias("weight"))
    return tag_entities(spark, sf_dir).unionByName(dates).unionByName(words)


@query(f"WITH {_W}, m AS (SELECT doc_id, provider, tag FROM tags JOIN w USING (tag) WHERE weight >= 0.2) SELECT a.doc_id AS a, b.doc_id AS b, 'tag:' || a.tag AS via, round(0.26::DOUBLE + 0.1 * (a.provider != b.provider)::INT, 6) AS confidence FROM m a JOIN m b ON a.tag = b.tag AND a.doc_id < b.doc_id")
def shared_entity_pairs(spark, sf_dir):
    r = records(spark, sf_dir).select("id", "ord", "provider")
    return G.entity_pairs(tag_entities(spark, sf_dir), r).select("a", "b", "via", "confidence")


def _edges(spark, sf_dir, informative: bool = False):
    """All edges of the graph; with informative every tag counts as such."""
    r = records(spark, sf_dir).select("id", "ord", "provider")
    v = graph_vectors(spark, sf_dir)
    nodes = entities(spark, sf_dir, v)
    nodes = saver(spark)(nodes.withColumn("weight", F.lit(None).cast("double")) if informative else nodes)
    return _woven(G.mentions(nodes), G.shared_classes(nodes, r), G.semantic(_topical(r, v)))


def _topical(r, v):
    """The five most similar of the later documents of each, by name."""
    names = lambda c: r.select(F.col("ord").alias(c), F.col("id").alias(f"{c}_id"))
    top = V.semantic_topk(V.cosine_pairs(v, SIMILAR, V.NEAREST)).join(names("a"), "a").join(names("b"), "b")
    return top.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "similarity")


def _woven(mentions, classes, similar):
    one = mentions.unionByName(similar).withColumn("links", F.lit(1).cast("long"))
    return one.unionByName(classes).withColumn("confidence", F.round("confidence", 6))


_DATE_NODES = "SELECT DISTINCT doc_id, 'date' AS kind, unnest(regexp_extract_all(text, '(^|[^0-9A-Za-z_])((18|19|20)[0-9][0-9](-[0-9][0-9]-[0-9][0-9])?)($|[^0-9A-Za-z_])', 2)) AS value, NULL::DOUBLE AS weight FROM documents"
_V2_NODES = f"""{_TAGS.replace('docs AS', 'docs2 AS')}, w AS (SELECT tag, CASE WHEN count(*) / any_value(n) > 0.2 THEN 0 ELSE ln((1 + any_value(n)) / (1 + count(*))) END AS weight FROM tags, docs2 GROUP BY tag),
salient AS (SELECT doc_id, token FROM vectors QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, token) <= 8),
ent AS (SELECT doc_id, 'tag' AS kind, tag AS value, {{weight}} AS weight FROM tags JOIN w USING (tag) UNION ALL {_DATE_NODES} UNION ALL SELECT doc_id, 'keyword', token, NULL FROM salient)"""


def _graph_sql(vectors_: str, nodes: str, base: float = 0.26, apart: float = 0.10, similar: float = 0.14) -> str:
    """The edges over entities ent (doc_id, kind, value, weight)."""
    named = "(SELECT doc_id, 'doc:' || source || ':' || doc_id AS id, source AS provider FROM documents)"
    return f"""{pair_sql(vectors_)}, {nodes}, r AS {named},
weak AS (SELECT *, coalesce(kind = 'tag' AND weight < 0.2, false) AS weak FROM ent JOIN r USING (doc_id)),
mentions AS (SELECT id AS source, kind || ':' || value AS target, 'MENTIONS' AS relation, NULL::VARCHAR AS via, CASE WHEN weak THEN 0.1 WHEN kind = 'keyword' THEN 0.3 ELSE 0.35 END::DOUBLE AS confidence, 1 AS evidence_count, 1 AS independence_count, CASE WHEN weak THEN 'COLLECTION_CONTEXT_EDGE' ELSE 'WEAK_DISCOVERY_EDGE' END AS status, 1::BIGINT AS links FROM weak),
own AS (SELECT kind || ':' || value AS via, provider, count(*) AS n, arg_min(id, doc_id) AS id, min(doc_id) AS first FROM weak WHERE NOT weak GROUP BY ALL),
sums AS (SELECT via, sum(n) AS n, arg_min(id, first) AS id, coalesce(sum(n) FILTER (provider IS NOT NULL), 0) AS k, coalesce(sum(n * (n - 1)) FILTER (provider IS NOT NULL), 0) AS same FROM own GROUP BY via),
parts AS (SELECT via, id, 0 AS ind, (n * (n - 1) - (k * (k - 1) - same)) // 2 AS links FROM sums UNION ALL SELECT via, id, 1, (k * (k - 1) - same) // 2 FROM sums),
classes AS (SELECT id AS source, via AS target, 'SHARED_ENTITY' AS relation, via, round({base}::DOUBLE + {apart}::DOUBLE * ind, 6) AS confidence, 2 AS evidence_count, ind AS independence_count, 'WEAK_ASSOCIATION' AS status, links::BIGINT AS links FROM parts WHERE links > 0),
top AS (SELECT a, b, similarity FROM pairs QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(similarity, 9) DESC, b DESC) <= 5),
semantic AS (SELECT x.id AS source, y.id AS target, 'SEMANTIC_SIMILARITY' AS relation, NULL::VARCHAR AS via, round(least(0.49, {similar}::DOUBLE + 0.35::DOUBLE * similarity), 6) AS confidence, 0 AS evidence_count, 0 AS independence_count, 'SPECULATIVE_SEMANTIC_EDGE' AS status, 1::BIGINT AS links FROM top JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b),
graph AS (SELECT * FROM mentions UNION ALL SELECT * FROM classes UNION ALL SELECT * FROM semantic)"""


_GRAPH = _graph_sql(_vectors(1, token_sql(WHOLE)), _V2_NODES.format(weight="weight"))


@query(f"WITH {_GRAPH} SELECT * FROM graph")
def weave_graph(spark, sf_dir):
    """Edges of the graph over documents: mentions, shared entities, similarity. Documents name no parent, so there is no lineage.

    The documents that share an entity are a class: its row says how many pairs it
    stands for (links), its members are those that mention it.
    """
    return _edges(spark, sf_dir)


@query(f"WITH {_graph_sql(_vectors(1, token_sql(WHOLE)), _V2_NODES.format(weight='NULL::DOUBLE'))} SELECT * FROM graph")
def weave_graph_v2(spark, sf_dir):
    """As weave_graph, where every tag is informative."""
    return _edges(spark, sf_dir, informative=True)


@query(f"WITH {_graph_sql(_vectors(2, token_sql(WHOLE, T.STOP_V1, keep_digits=True)), NODES_V1 + ', ent AS (SELECT *, NULL::DOUBLE AS weight FROM nodes)', 0.28, 0.12, 0.15)} SELECT * FROM graph")
def weave_graph_v1(spark, sf_dir):
    """Entities are topics, places, dates and tags; vectors keep numbers, leave out the first stop words only and tokens of a single document."""
    r = records(spark, sf_dir)
    nodes = r.select("id", F.explode(T.entity_nodes(F.col("text"), F.array_compact("relation_tags"))).alias("n")).select("id", "n.kind", "n.value", F.lit(None).cast("double").alias("weight"))
    whole = T.text_of(F.col("title"), F.col("text"), None, F.col("relation_tags"))
    docs = r.select("id", "ord", "provider")
    v = V.vectors(r.select(F.col("ord").alias("id"), whole.alias("whole")), F.col("whole"), n_docs(spark, sf_dir), 2, T.word_counter(T.STOP_V1, keep_digits=True))
    return _woven(G.mentions(nodes), G.shared_classes(nodes, docs, 0.28, 0.12), G.semantic(_topical(docs, v), 0.15))


@query(f"WITH {_GRAPH} SELECT relation, sum(links)::BIGINT AS edges, coalesce(sum(links) FILTER (confidence < 0.5), 0)::BIGINT AS weak, round(sum(confidence * links) / sum(links), 6) AS mean_confidence FROM graph GROUP BY relation")
def graph_receipt(spark, sf_dir):
    return G.receipt(_edges(spark, sf_dir)).withColumn("mean_confidence", F.round("mean_confidence", 6))


_NATIONS = "e AS (SELECT DISTINCT 'n' || least(c_nationkey, s_nationkey) AS a, 'n' || greatest(c_nationkey, s_nationkey) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey != s_nationkey)"


def nation_edges(spark, sf_dir):
    """Nations linked by order lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    rows = li.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    name = lambda f: F.concat(F.lit("n"), f("c_nationkey", "s_nationkey").cast("string"))
    return rows.filter("c_nationkey != s_nationkey").select(name(F.least).alias("source"), name(F.greatest).alias("target")).distinct()


@query(f"""WITH {_NATIONS}, p AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e), n AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), d AS (SELECT x, 1 / greatest(1, log2(2 + count(*))) AS part FROM n GROUP BY x),
s AS (SELECT p.a, p.b, least(1, sum(part) / 3) AS support FROM p JOIN n l ON l.x = p.a JOIN n r ON r.x = p.b AND r.y = l.y JOIN d ON d.x = l.y GROUP BY ALL) SELECT p.a, p.b, round(coalesce(support, 0), 6) AS support FROM p LEFT JOIN s ON s.a = p.a AND s.b = p.b""")
def topology_support(spark, sf_dir):
    return G.topology_support(nation_edges(spark, sf_dir)).withColumn("support", F.round("support", 6))


# state over passes: a user's link to a kind of event, in the first and second half of the days

_PASS = """ev AS (SELECT user_id, event_type, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS pass FROM events),
g AS (SELECT pass, user_id || '|' || event_type AS edge_key, user_id, event_type, count(*) AS n FROM ev GROUP BY ALL), t AS (SELECT *, least(0.99::DOUBLE, 0.18::DOUBLE + 0.07::DOUBLE * least(n % 3, 3) + 0.025::DOUBLE * least(n, 4)) AS target, sha256(n::VARCHAR) AS sig FROM g),
s1 AS (SELECT edge_key, round(0.2::DOUBLE + 0.55::DOUBLE * (target - 0.2::DOUBLE), 6) AS weight, sig AS seen FROM t WHERE pass = 1), e2 AS (SELECT * FROM t WHERE pass = 2),
b AS (SELECT coalesce(e2.edge_key, s1.edge_key) AS edge_key, e2.sig IS NOT NULL AS observed, e2.sig IS NOT NULL AND (seen IS NULL OR seen != sig) AS fresh, coalesce(weight, 0.2::DOUBLE) AS old, target FROM e2 FULL JOIN s1 ON s1.edge_key = e2.edge_key),
c AS (SELECT *, CASE WHEN observed THEN old + CASE WHEN fresh THEN 0.55::DOUBLE ELSE 0.18::DOUBLE END * (target - old) ELSE old * 0.93::DOUBLE END AS new FROM b),
st AS (SELECT edge_key, round(new, 6) AS weight, round(old, 6) AS previous_weight, round(new - old, 6) AS delta, CASE WHEN observed AND new - old > 0.015 THEN 'STRENGTHENED' WHEN observed AND new - old < -0.015 THEN 'WEAKENED' WHEN NOT observed AND new < old THEN 'WEAKENED_NOT_REOBSERVED' ELSE 'STABLE' END AS movement, observed, fresh, (NOT observed)::INT AS misses FROM c)"""


def pass_edges(spark, sf_dir, number: int):
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").filter(early if number == 1 else ~early)
    g = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = g.select(F.concat_ws("|", "user_id", "event_type").alias("edge_key"), F.lit("SHARED_ENTITY").alias("relation"), F.lit(None).cast("double").alias("similarity"), F.lit(0.2).alias("confidence"), (F.col("n") % 3).alias("independence_count"), F.col("n").alias("evidence_count"), F.lit(0).alias("contradiction_count"), F.lit(0.0).alias("support"), F.sha2(F.col("n").cast("string"), 256).alias("signature"))
    return rows.select("edge_key", "signature", Z.relation_target().alias("target"), "confidence")


def two_passes(spark, sf_dir):
    empty = spark.createDataFrame([], "edge_key string, weight double, seen array<string>, misses int")
    first = Z.calibrate(pass_edges(spark, sf_dir, 1), empty, "pass-1")
    return Z.calibrate(pass_edges(spark, sf_dir, 2), first.select("edge_key", "weight", "seen", "misses"), "pass-2")


@query(f"WITH {_PASS} SELECT pass, edge_key, round(target, 6) AS target FROM t")
def relation_target(spark, sf_dir):
    both = [pass_edges(spark, sf_dir, k).select(F.lit(k).alias("pass"), "edge_key", F.round("target", 6).alias("target")) for k in (1, 2)]
    return both[0].unionByName(both[1])


@query(f"WITH {_PASS} SELECT * FROM st")
def calibrate_edges(spark, sf_dir):
    return two_passes(spark, sf_dir).drop("seen", "pass_id")


@query(f"WITH {_PASS} SELECT movement, count(*) AS n FROM st GROUP BY movement")
def movement_counts(spark, sf_dir):
    return two_passes(spark, sf_dir).groupBy("movement").agg(F.count(F.lit(1)).alias("n"))


_ATT = f"""{_PASS}, k AS (SELECT edge_key, weight, observed, fresh, CASE WHEN fresh THEN 0 ELSE observed::INT END AS streak FROM st),
x AS (SELECT *, 0.18 * (1 - exp(-0.9 * least(streak, 6))) AS burst FROM k), aim AS (SELECT *, greatest(0, least(1, greatest(0, least(1, weight)) + CASE WHEN fresh THEN 0.14 ELSE 0 END + burst)) AS aim FROM x),
att AS (SELECT edge_key, observed, fresh, streak, weight, CASE WHEN observed THEN greatest(0, least(1, weight + CASE WHEN fresh THEN 0.72 ELSE 0.5 END * (aim - weight))) ELSE greatest(0, least(1, weight * 0.78)) END AS new FROM aim)"""


def attention(spark, sf_dir):
    state = two_passes(spark, sf_dir).select("edge_key", "weight", "observed", "fresh", F.lit(0).alias("contradictions"))
    empty = spark.createDataFrame([], "edge_key string, attention double, streak int, fresh_events int, passes int")
    return Z.edge_attention(state, empty)


@query(f"WITH {_ATT} SELECT edge_key, round(new, 6) AS attention, round(new - weight, 6) AS delta, CASE WHEN new - weight > 0.02 THEN 'ATTENTION_STRENGTHENED' WHEN new - weight < -0.02 THEN 'ATTENTION_WEAKENED' ELSE 'ATTENTION_STABLE' END AS movement, streak FROM att")
def edge_attention(spark, sf_dir):
    return attention(spark, sf_dir).select("edge_key", "attention", "delta", "movement", "streak")


_NODES = f"""{_ATT}, ea AS (SELECT split_part(edge_key, '|', 1) AS s, split_part(edge_key, '|', 2) AS t, round(new, 6) AS a, fresh, observed FROM att),
ends AS (SELECT s AS node, a, fresh, observed FROM ea UNION ALL SELECT t, a, fresh, observed FROM ea), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY a DESC) AS r FROM ends),
loc AS (SELECT node, count(*) AS degree, greatest(0, least(1, (0.55 * max(a) + 0.27 * avg(a) FILTER (WHERE r <= 3) + 0.18 * sum(fresh::INT) / greatest(1, sum(observed::INT))) / (1 + 0.1 * ln(1 + greatest(count(*) - 4, 0))))) AS l FROM r GROUP BY node),
near AS (SELECT s AS node, t AS other, greatest(0.01, a) AS w FROM ea UNION ALL SELECT t, s, greatest(0.01, a) FROM ea),
p1 AS (SELECT loc.node, greatest(0, least(1, 0.66 * any_value(loc.l) + 0.34 * sum(o.l * w) / sum(w))) AS v FROM loc JOIN near ON near.node = loc.node JOIN loc o ON o.node = near.other GROUP BY loc.node),
p2 AS (SELECT loc.node, greatest(0, least(1, 0.66 * any_value(loc.l) + 0.34 * sum(o.v * w) / sum(w))) AS v FROM loc JOIN near ON near.node = loc.node JOIN p1 o ON o.node = near.other GROUP BY loc.node),
p3 AS (SELECT loc.node, greatest(0, least(1, 0.66 * any_value(loc.l) + 0.34 * sum(o.v * w) / sum(w))) AS v FROM loc JOIN near ON near.node = loc.node JOIN p2 o ON o.node = near.other GROUP BY loc.node)"""


def _nodes(spark, sf_dir):
    e = attention(spark, sf_dir).select(F.split("edge_key", r"\|")[0].alias("source"), F.split("edge_key", r"\|")[1].alias("target"), "attention", "fresh", "observed")
    return Z.node_signals(e), e


@query(f"WITH {_NODES} SELECT loc.node, degree, round(l, 5) AS local, round(v, 5) AS signal FROM loc JOIN p3 ON p3.node = loc.node")
def node_attention(spark, sf_dir):
    local, e = _nodes(spark, sf_dir)
    return Z.propagate(local, e).join(local.select("node", "degree"), "node").select("node", "degree", F.round("local", 5).alias("local"), F.round("signal", 5).alias("signal"))


@query(f"""WITH {_NODES}, s AS (SELECT node, round(0.58 * v, 4) AS score FROM p3), q AS (SELECT greatest(0.28, quantile_cont(score, 0.75)) AS edge FROM s), rk AS (SELECT node, score, row_number() OVER (ORDER BY score DESC, node) AS r FROM s), cc AS (SELECT node, r FROM rk, q WHERE r <= 5 AND (score >= edge OR r = 1))
SELECT s.node, s.score, cc.r AS rank, CASE WHEN cc.r = 1 THEN 'PRIMARY_FOCUS' WHEN cc.r IS NOT NULL THEN 'ACTIVE_FOCUS' WHEN s.score < 0.1 THEN 'DORMANT' ELSE 'PERIPHERY' END AS focus_state FROM s LEFT JOIN cc ON cc.node = s.node""")
def focus_rank(spark, sf_dir):
    local, e = _nodes(spark, sf_dir)
    return Z.focus(Z.propagate(local, e).select("node", F.round(F.lit(Z.NODE_RATE) * F.col("signal"), 4).alias("score")))


# sieve

ALIASES = [("insult", "idiot"), ("insult", "moron"), ("licence", "licensed under the"), ("licence", "all rights reserved"), ("place", "the and"), ("place", "que la")]
_AL = ", ".join(f"('{f}', '{a}')" for f, a in ALIASES)
_CH = f"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x != '') AS w FROM documents),
ch AS (SELECT doc_id, i AS chunk_index, w[i * 135 + 1 : i * 135 + 180] AS ws, i * 135 AS word_start, least(len(w), i * 135 + 180) AS word_end FROM w, unnest(range(0, greatest(0, ceil((len(w) - 180) / 135))::BIGINT + 1)) AS r(i) WHERE len(w) > 0),
nm AS (SELECT doc_id, chunk_index, ' ' || array_to_string(regexp_extract_all(replace(lower(array_to_string(ws, ' ')), 'ß', 'ss'), '[a-z0-9]+'), '  ') || ' ' AS s FROM ch),
al AS (SELECT family, alias, ' ' || replace(alias, ' ', '  ') || ' ' AS p FROM (VALUES {_AL}) AS v(family, alias)),
hit AS (SELECT doc_id, chunk_index, family, alias, ((len(s) - len(replace(s, p, ''))) / len(p))::BIGINT AS n FROM nm JOIN al ON contains(s, p)),
dir AS (SELECT doc_id, chunk_index, list_sort(list(DISTINCT family)) AS families, sum(n) AS hits FROM hit GROUP BY ALL),
j AS (SELECT ch.doc_id, ch.chunk_index, families, hits, families IS NOT NULL AS direct FROM ch LEFT JOIN dir ON dir.doc_id = ch.doc_id AND dir.chunk_index = ch.chunk_index),
nb AS (SELECT *, list_filter(list(CASE WHEN direct THEN chunk_index END) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), lambda x: x IS NOT NULL AND x != chunk_index) AS near FROM j),
kept AS (SELECT *, CASE WHEN direct THEN least(1::DOUBLE, 0.32::DOUBLE + 0.16::DOUBLE * len(families) + 0.025::DOUBLE * hits) ELSE 0::DOUBLE END AS sc FROM nb WHERE direct OR len(near) > 0)"""


def sieved(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select(F.col("ord").alias("id"), source_family(F.col("provider"), F.col("archive_id"), F.col("source_url")).alias("source_family"), "text")


def chunks(spark, sf_dir):
    return C.chunk_text(sieved(spark, sf_dir))


def hits(spark, sf_dir):
    return C.family_hits(chunks(spark, sf_dir), ALIASES)


def kept(spark, sf_dir):
    return C.retain(chunks(spark, sf_dir), ALIASES)


@query(f"WITH {_CH} SELECT doc_id, chunk_index, word_start, word_end, sha256(array_to_string(ws, ' ')) AS text_sha256 FROM ch")
def chunk_text(spark, sf_dir):
    return chunks(spark, sf_dir).select(F.col("id").alias("doc_id"), "chunk_index", "word_start", "word_end", F.sha2("chunk", 256).alias("text_sha256"))


@query(f"WITH {_CH} SELECT doc_id, chunk_index, family, alias, n FROM hit")
def match_patterns(spark, sf_dir):
    return hits(spark, sf_dir).withColumnRenamed("id", "doc_id")


@query(f"WITH {_CH} SELECT doc_id, chunk_index, direct, array_to_string(near, ',') AS near, round(CASE WHEN len(near) > 0 THEN greatest(sc, 0.12::DOUBLE) ELSE sc END, 6) AS score FROM kept")
def neighbor_context(spark, sf_dir):
    near = F.array_join(F.transform("near", lambda x: x.cast("string")), ",")
    return kept(spark, sf_dir).select(F.col("id").alias("doc_id"), "chunk_index", "direct", near.alias("near"), "score")


@query(f"""WITH {_CH}, d AS (SELECT doc_id, chunk_index, unnest(families) AS family FROM kept WHERE direct), s AS (SELECT doc_id, chunk_index AS pos, unnest(near) AS hit FROM kept WHERE NOT direct),
c AS (SELECT family, count(*) AS n FROM (SELECT DISTINCT family, s.doc_id, s.pos FROM s JOIN d ON d.doc_id = s.doc_id AND d.chunk_index = s.hit) GROUP BY family)
SELECT family, count(*) AS direct_chunks, count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) AS source_families, coalesce(any_value(c.n), 0) AS context_chunks FROM d LEFT JOIN c USING (family) GROUP BY family""")
def family_summary(spark, sf_dir):
    return C.family_summary(kept(spark, sf_dir))


@query(f"WITH {_CH}, d AS (SELECT doc_id, chunk_index, unnest(families) AS family FROM kept WHERE direct) SELECT x.family AS a, y.family AS b, count(*) AS n, count(DISTINCT x.doc_id) AS documents, count(DISTINCT x.doc_id) AS source_families FROM d x JOIN d y ON y.doc_id = x.doc_id AND y.chunk_index = x.chunk_index AND x.family < y.family GROUP BY ALL")
def pattern_cooccurrence(spark, sf_dir):
    rows = kept(spark, sf_dir).filter("direct").select("id", "source_family", "chunk_index", F.explode("families").alias("family"))
    return C.cooccurrence(rows, ["id", "chunk_index"], "source_family")


@query(f"WITH {_CH} SELECT family, count(DISTINCT doc_id) AS documents FROM hit GROUP BY family")
def family_counts(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("family").agg(F.countDistinct("id").alias("documents"))


@query(f"WITH {_CH}, d AS (SELECT DISTINCT doc_id, family FROM hit) SELECT x.family AS a, y.family AS b, count(*) AS n, count(*) AS documents FROM d x JOIN d y ON y.doc_id = x.doc_id AND x.family < y.family GROUP BY ALL")
def family_doc_cooccurrence(spark, sf_dir):
    return C.cooccurrence(hits(spark, sf_dir).select("id", "family"), ["id"])


@query(f"WITH {_CH}, o AS (SELECT doc_id, chunk_index, row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS i FROM kept) SELECT (i // 64) AS batch, count(*) AS size, min(doc_id) AS first_doc FROM o GROUP BY ALL")
def batching(spark, sf_dir):
    rows = C.batches(kept(spark, sf_dir).select("id", "chunk_index"), F.col("id"), F.col("chunk_index"), save=saver(spark))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first_doc"))


_SHIN = f"""{_CH}, t AS (SELECT doc_id * 100000 + ch.chunk_index AS ord, regexp_extract_all(s, '[a-z0-9]+') AS t FROM ch JOIN nm USING (doc_id, chunk_index)),
sh AS (SELECT ord, list_distinct(CASE WHEN len(t) < 4 THEN t ELSE list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' ')) END) AS h FROM t),
u AS (SELECT ord, len(h) AS n, unnest(h) AS x FROM sh), pr AS (SELECT a.ord AS a, b.ord AS b FROM u a JOIN u b ON a.x = b.x AND a.ord < b.ord GROUP BY a.ord, b.ord HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.88)"""


def chunk_shingles(spark, sf_dir):
    words = chunks(spark, sf_dir).select((F.col("id") * 100_000 + F.col("chunk_index")).alias("ord"), T.norm_tokens(F.col("chunk")).alias("w"))
    return words.select("ord", T.shingles(F.col("w")).alias("shingles"))


@query(f"WITH {_SHIN} SELECT a, b FROM pr")
def similar_chunks(spark, sf_dir):
    return C.similar_pairs(chunk_shingles(spark, sf_dir), 0.88)


def _save(df):
    return written(df, "sieve")


def whole_sieve(spark, sf_dir):
    return C.chunk_sieve(sieved(spark, sf_dir), ALIASES, _save)


@query()
def near_duplicates(spark, sf_dir):
    """Each retained chunk and the one it repeats, by number in order."""
    return C.duplicates(_save(C.numbered(kept(spark, sf_dir), F.col("id"), F.col("chunk_index"), save=_save)), _save)


@query()
def chunk_sieve(spark, sf_dir):
    rows = whole_sieve(spark, sf_dir)
    return rows.select(F.col("id").alias("doc_id"), "chunk_index", "chunk_id", "direct", F.array_join("families", ",").alias("families"), "score", "batch", "duplicate_id")


@query(f"""WITH {_CH}, o AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS i, upper(source) || ':' || doc_id || ':' || chunk_index || ':' || sha256(array_to_string(ws, ' '))[:12] AS cid FROM kept JOIN ch USING (doc_id, chunk_index) JOIN documents USING (doc_id))
SELECT (i // 64) AS batch, count(*) AS size, sha256(string_agg(cid, chr(10) ORDER BY i)) AS sha256 FROM o GROUP BY ALL""")
def sieve_batches(spark, sf_dir):
    save = saver(spark)
    rows = C.retain(chunks(spark, sf_dir), ALIASES).withColumn("chunk_id", F.concat_ws(":", "source_family", "chunk_index", F.substring(F.sha2("chunk", 256), 1, 12)))
    placed = C.numbered(rows.select("id", "chunk_index", "chunk_id"), F.col("id"), F.col("chunk_index"), save=save)
    return C.batch_digests(placed.withColumn("batch", F.floor(F.col("ord") / 64)))
