"""Queries: keys, names, entities and searches of single records."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import hashing as H
from siftline.functions import text as T
from siftline.operators import bridges as B
from siftline.operators import features as X
from siftline.operators.index import Index, append
from siftline.plans.storage import new_folder
from siftline.registry import query
from siftline.sources import web
from siftline.sources.tables import records, table

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("SELECT doc_id, sha256(concat_ws(' ', array_to_string(regexp_split_to_array(text, '\\s+')[:8], ' '), text, '', concat_ws(' ', lang, source), source, 'note ' || lang)) AS text_sha256 FROM documents")
def text_of(spark, sf_dir):
    """Documents with two of the metadata keys set; another key and blank ones don't count."""
    meta = F.create_map(F.lit("description"), F.concat(F.lit("note "), F.element_at("relation_tags", 1)), F.lit("title"), F.col("provider"), F.lit("pages"), F.lit("9"), F.lit("subject"), F.lit(""))
    whole = T.text_of(F.col("title"), F.col("text"), None, F.col("relation_tags"), meta)
    return records(spark, sf_dir).select(F.col("ord").alias("doc_id"), F.sha2(whole, 256).alias("text_sha256"))


@query("""WITH r AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN doc_id::VARCHAR END AS a, CASE WHEN doc_id % 4 = 1 THEN 'https://' || upper(source) || '.example.org/' || doc_id END AS u,
CASE WHEN doc_id % 4 = 2 THEN array_to_string(regexp_split_to_array(text, '\\s+')[:8], ' ') END AS t FROM documents)
SELECT doc_id, CASE WHEN a IS NOT NULL THEN 'ARCHIVE' WHEN u IS NOT NULL THEN 'URL' WHEN trim(coalesce(t, '')) != '' THEN 'TITLE' ELSE 'SHA' END AS kind,
CASE WHEN a IS NOT NULL THEN upper(source) || '|' || a WHEN u IS NOT NULL THEN lower(u) WHEN trim(coalesce(t, '')) != '' THEN trim(lower(t)) ELSE sha256(doc_id::VARCHAR) END AS key FROM r""")
def record_key(spark, sf_dir):
    """Records of which a quarter each have an archive id, a URL, a title and nothing."""
    k = F.col("ord") % 4
    key = H.record_key(F.col("provider"), F.when(k == 0, F.col("archive_id")), F.when(k == 1, F.concat(F.lit("https://"), F.upper("provider"), F.lit(".example.org/"), F.col("archive_id"))), F.when(k == 2, F.col("title")), F.sha2(F.col("archive_id"), 256))
    return records(spark, sf_dir).select(F.col("ord").alias("doc_id"), key.alias("k")).select("doc_id", "k.kind", "k.key")


@query("SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || chr(9) || p_partkey, '\\s+', ' ', 'g'))) AS title, regexp_replace(lower('  ' || p_name || chr(9) || p_partkey), '[^a-z0-9]+', '', 'g') AS simple, trim(regexp_replace('  ' || p_name || chr(9) || p_partkey, '[^A-Za-z0-9._-]+', '-', 'g'), '-') AS slug FROM part")
def normalize_title(spark, sf_dir):
    raw = F.concat(F.lit("  "), "p_name", F.lit("\t"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_title(raw).alias("title"), T.simple(raw).alias("simple"), T.slug(raw).alias("slug"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '10.1/' || lower(c_name) END AS doi FROM customer")
def normalize_doi(spark, sf_dir):
    k = F.col("c_custkey") % 5
    raw = F.concat(F.when(k == 1, "https://doi.org/").when(k == 2, "http://DOI.org/").when(k == 3, " doi:").otherwise(""), F.lit("10.1/"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalize_doi(F.when(k != 0, raw).otherwise(" ")).alias("doi"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) || ':' || doc_id ELSE upper(source) || ':URL:' || sha256('https://' || source || '.example.org/' || doc_id)[:16] END AS family FROM documents WHERE source IS NOT NULL")
def source_family(spark, sf_dir):
    own = F.when(F.col("ord") % 2 == 0, F.col("archive_id"))
    return records(spark, sf_dir).filter("provider is not null").select(F.col("ord").alias("doc_id"), H.source_family(F.col("provider"), own, F.col("source_url")).alias("family"))


_TOKENS = "list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+'), lambda x: len(x) >= 3)"


@query(f"""WITH q AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, {_TOKENS} AS k FROM benchmark), w AS (SELECT item_id, t, list_filter(k, lambda x, i: list_position(k, x) = i)[:12] AS w FROM q)
SELECT item_id, CASE WHEN t = '' THEN NULL WHEN len(w) <= 1 THEN 'all:"' || replace(t, '"', '') || '"' ELSE '(all:"' || replace(t, '"', '') || '" OR (' || array_to_string(list_transform(w, lambda x: 'all:' || x), ' AND ') || '))' END AS query FROM w""")
def build_search_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.search_query(F.col("text")).alias("query"))


@query(f"""WITH qt AS (SELECT DISTINCT item_id AS query, unnest({_TOKENS}) AS token FROM benchmark WHERE item_id % 50 = 0),
f AS (SELECT doc_id AS id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+')) AS token FROM documents), p AS (SELECT id, token, sum(1.5) AS tf FROM f GROUP BY ALL)
SELECT query, id, count(*) AS matched, sum(tf)::DOUBLE AS tf FROM p JOIN qt USING (token) GROUP BY query, id""")
def search_join(spark, sf_dir):
    """The tokens of each fiftieth benchmark item, looked up in a stored index of all documents."""
    items = table(spark, sf_dir, "benchmark").filter("item_id % 50 = 0")
    words = items.select(F.col("item_id").alias("query"), F.explode(T.norm_tokens(F.col("text"))).alias("token")).filter(F.length("token") >= 3)
    path = new_folder(spark, "index")
    append(records(spark, sf_dir).select(F.col("ord").alias("id"), "text"), {"text": 1.5}, path, "documents")
    return Index(spark, path).lookup(words)


#: (doc_id, kind, value) of a document's topics, places, dates and tags.
NODES_V1 = f"""d AS (SELECT doc_id, lang, source, lower(text) AS low, text FROM documents), n AS (
SELECT doc_id, 'topic' AS kind, v AS value FROM d, unnest({_LIST(T.TOPICS)}) AS t(v) WHERE contains(low, v) UNION SELECT doc_id, 'place', v FROM d, unnest({_LIST(T.PLACES)}) AS t(v) WHERE contains(low, v)
UNION SELECT doc_id, 'date', unnest(regexp_extract_all(text, '(^|[^0-9A-Za-z_])((18|19|20)[0-9][0-9](-[0-9][0-9]-[0-9][0-9])?)($|[^0-9A-Za-z_])', 2)) FROM d UNION SELECT doc_id, 'tag', unnest([lower(lang), lower(source)]) FROM d),
nodes AS (SELECT doc_id, kind, value FROM n WHERE value IS NOT NULL)"""


@query(f"WITH {NODES_V1} SELECT * FROM nodes")
def entity_nodes_v1(spark, sf_dir):
    nodes = F.explode(T.entity_nodes(F.col("text"), F.array_compact("relation_tags"))).alias("n")
    return records(spark, sf_dir).select(F.col("ord").alias("doc_id"), nodes).select("doc_id", "n.kind", "n.value")


@query("SELECT doc_id, octet_length(encode(text)) <= 2000 AS inspected FROM documents")
def is_text_inspected(spark, sf_dir):
    """Texts of up to 2,000 bytes are looked at; longer ones keep their row."""
    return table(spark, sf_dir, "documents").select("doc_id", T.inspected(F.col("text"), 2000).alias("inspected"))


@query("SELECT doc_id, n_chars AS route_score FROM documents ORDER BY n_chars DESC, doc_id::VARCHAR LIMIT 80")
def route_topk(spark, sf_dir):
    return B.route_topk(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("route_score")), id_col="doc_id")


@query("SELECT ps.doc_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 3 END AS features_present, l.quality, ps.n_chars FROM documents ps LEFT JOIN labels l ON l.doc_id = ps.doc_id")
def build_feature_rail(spark, sf_dir):
    """Documents with their source's tile and the labels as a sidecar."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    tiles = docs.select("source").filter("source is not null").distinct().withColumn("tile_letters", F.length("source"))
    side = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rail = X.feature_rail(docs, "doc_id", tiles, "source", {"review": (side, ["quality", "toxic"])})
    return rail.select("doc_id", "features_present", F.col("review_quality").alias("quality"), "n_chars")


@query("""WITH b AS (SELECT count(*) AS n FROM documents), l AS (SELECT count(*) AS n FROM labels) SELECT 'labels' AS sidecar, CASE WHEN l.n / b.n < 0.05 THEN 'FAIL' ELSE 'PASS' END AS status, round(l.n / b.n, 6) AS coverage, l.n / b.n >= 0.05 AS admitted FROM b, l
UNION ALL SELECT 'lengths', 'PASS', 1.0, l.n / b.n >= 0.05 FROM b, l""")
def sidecar_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    out = X.sidecar_gate({"labels": table(spark, sf_dir, "labels"), "lengths": docs}, docs, "doc_id", {"labels": ["quality"], "lengths": ["n_chars"]}, 0.05)
    return out.select("sidecar", "status", F.round("coverage", 6).alias("coverage"), "admitted")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE '10.5/p' || page_id END AS archive_id, CASE WHEN page_id % 3 != 0 THEN '10.5/p' || page_id END AS doi, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, html AS text, url AS source_url FROM pages")
def normalize_crossref(spark, sf_dir):
    """Pages as literature items, two thirds of them with a DOI."""
    doi = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("https://doi.org/10.5/P"), F.col("page_id").cast("string")))
    items = table(spark, sf_dir, "pages").select("page_id", doi.alias("DOI"), F.col("url").alias("URL"), F.array(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("second")).alias("title"), F.col("html").alias("abstract"))
    return web.crossref_records(items, kept=("page_id",)).select("page_id", "archive_id", "doi", "title", "text", "source_url")


@query("SELECT doc_id, CASE WHEN doc_id % 4 != 0 THEN '10.7/d' || doc_id ELSE source || '/' || doc_id END AS archive_id, CASE WHEN doc_id % 4 != 0 THEN '10.7/d' || doc_id END AS doi, lang AS title, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x != ''), ' ') AS text, CASE WHEN doc_id % 4 != 0 THEN 'https://doi.org/10.7/D' || doc_id ELSE source || '/' || doc_id END AS source_url FROM documents")
def normalize_openalex(spark, sf_dir):
    """Documents as catalogue items whose abstracts are inverted indexes of their words: whole texts come back in order of position."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("id"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("https://doi.org/10.7/D"), F.col("doc_id").cast("string"))).alias("doi"), F.col("lang").alias("title"), words.alias("w"))
    # words are sorted with their places in their own row, so no text is shuffled; runs of a word are its entry
    placed = rows.withColumn("s", F.sort_array(F.transform("w", lambda x, p: F.struct(x.alias("word"), p.alias("p")))))
    start = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i)["word"] != F.get("s", i - 1)["word"]))
    cut = placed.withColumn("at", F.when(F.size("s") > 0, start))
    places = lambda i, k: F.transform(F.slice("s", i + 1, F.coalesce(F.get("at", k + 1), F.size("s")) - i), lambda e: e["p"])
    entries = F.transform("at", lambda i, k: F.struct(F.get("s", i)["word"].alias("word"), places(i, k).alias("places")))
    items = cut.withColumn("abstract_inverted_index", F.map_from_entries(entries)).drop("w", "s", "at")
    return web.openalex_records(items, kept=("doc_id",)).select("doc_id", "archive_id", "doi", "title", "text", "source_url")


@query("SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+'), ' ') || ' ', ' licensed under the ')")
def phrase_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(T.phrase_hit(T.normalized(F.col("text")), F.lit("licensed under the"))).select("doc_id")


@query("SELECT o_orderkey, o_custkey AS customer, o_orderstatus AS mark, NULL::VARCHAR AS nothing FROM orders")
def resolve_path(spark, sf_dir):
    """Parts of nested records by their dotted paths; one leads beyond an array's end."""
    record = F.struct(F.struct("o_custkey").alias("customer"), F.array(F.lit("first"), F.col("o_orderstatus")).alias("marks"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", record.alias("r"))
    at = lambda path, name: T.resolve_path(F.col("r"), path).alias(name)
    return rows.select("o_orderkey", at("customer.o_custkey", "customer"), at("marks.1", "mark"), at("marks.7", "nothing"))


@query("SELECT l_orderkey || '-' || l_linenumber AS id, l_returnflag AS title, 'supplier ' || l_suppkey || '; part ' || l_partkey AS agency FROM lineitem")
def expand_metadata(spark, sf_dir):
    """Orders as metadata documents of their lines (seven at most), each with two creators."""
    heading = lambda kind, c: F.struct(F.concat_ws(" ", F.lit(kind), F.col(c).cast("string")).alias("heading"))
    item = F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_returnflag").alias("title"), F.array(heading("supplier", "l_suppkey"), heading("part", "l_partkey")).alias("creators"))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("records"))
    return web.expand_metadata(docs)
