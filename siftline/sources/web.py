"""Pages, feeds and listings as rows."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import normalize_doi
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def unescape(text: pa.Array) -> pa.Array:
    """HTML entities as characters."""
    return pa.array([None if x is None else html.unescape(x) for x in text.to_pylist()], pa.string())


def page_text(page: Column) -> Column:
    """Text of a page without scripts, styles and tags, white space squeezed; entities stay for unescape()."""
    bare = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def page_title(page: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def links(page: Column) -> Column:
    return F.regexp_extract_all(page, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def on_hosts(url: Column, allowed: list[str]) -> Column:
    """Whether the host is one of allowed or under one."""
    h, out = host(url), F.lit(False)
    for a in allowed:
        out = out | (h == a) | h.endswith(f".{a}")
    return out


def inside(url: Column, root_host: str, root_path: str) -> Column:
    """The landing page itself or a descendant of its path."""
    root = root_path.rstrip("/")
    return (host(url) == root_host) & ((F.rtrim(F.lit("/"), path(url)) == root) | path(url).startswith(f"{root}/"))


def binary_pointers(urls: Column, suffixes: tuple[str, ...] = ("pdf", "zip", "jpg", "png", "mp4", "tif"), most: int = 100) -> Column:
    """Distinct links to files of the suffixes, sorted, the first most of them."""
    end = rf"(?i)\.({'|'.join(suffixes)})$"
    return F.slice(F.array_sort(F.array_distinct(F.filter(urls, lambda u: F.regexp_replace(u, "[?#].*$", "").rlike(end)))), 1, most)


def bulk_listing(pages: DataFrame) -> DataFrame:
    """(id, metadata_url, zip_url): metadata links of listing pages with the first zip link of the same id. pages: (page_id, html)."""
    at = pages.select("page_id", F.posexplode(links(F.col("html"))).alias("pos", "url"))
    key = F.regexp_extract("url", r"([A-Za-z0-9_-]+)\.(?:json|zip)$", 1)
    named = at.withColumn("id", key).filter("id != ''")
    zips = named.filter(F.col("url").endswith(".zip")).groupBy("id").agg(F.min_by("url", F.struct("page_id", "pos")).alias("zip_url"))
    return named.filter(F.col("url").endswith(".json")).select("id", F.col("url").alias("metadata_url")).join(zips, "id", "left")


def collection_listing(pages: DataFrame, marker: str, most: int | None = None) -> DataFrame:
    """(id, url): the first link under the marker for each lower-cased last path part, in page order. pages: (page_id, html)."""
    at = pages.select("page_id", F.posexplode(links(F.col("html"))).alias("pos", "url")).filter(F.contains("url", F.lit(marker)))
    found = at.withColumn("id", F.lower(F.regexp_extract("url", r"([^/?#]+)/?(?:[?#].*)?$", 1))).filter("id != ''")
    out = found.groupBy("id").agg(F.min_by("url", F.struct("page_id", "pos")).alias("url"), F.min(F.struct("page_id", "pos")).alias("_o"))
    out = out if most is None else out.orderBy("_o").limit(most)
    return out.select("id", "url")




def atom_feed(spark: SparkSession, where: str) -> DataFrame:
    """Paper rows of Atom files: ids, squeezed title and abstract, authors, categories, and the pdf and abstract links."""
    schema = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_href:string,_rel:string,_title:string,_type:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(where)
    pick = lambda test: F.get(F.filter("link", test), 0)["_href"]
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.select(
        F.regexp_extract("id", r"([^/]+)$", 1).alias("paper_id"), F.col("id").alias("entry_id"), squeeze("title").alias("title"), squeeze("summary").alias("abstract"),
        F.col("author.name").alias("authors"), F.col("category._term").alias("categories"), "published", "updated",
        pick(lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf")).alias("pdf_url"), pick(lambda x: x["_rel"] == "alternate").alias("abs_url"),
    )


def expand_metadata(rows: DataFrame) -> DataFrame:
    """One record per item of a metadata document's records, its agency the creators' headings. rows: (records array<struct<id,title,creators array<struct<heading>>>>)."""
    item = rows.select(F.explode("records").alias("r"))
    return item.select("r.id", "r.title", F.array_join(F.transform("r.creators", lambda c: c["heading"]), "; ").alias("agency"))


def abstract_of(inverted: Column, most: int | None = None) -> Column:
    """A text from its inverted index (word to positions), in order of position; with most it is cut at so many characters."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    whole = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
    return whole if most is None else F.substring(whole, 1, most)


def fits_cards(files: DataFrame) -> DataFrame:
    """(path, key, value): 80-byte header cards up to END. files: (path, content)."""
    card = F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.octet_length("content") / 80).cast("int") - 1)), lambda i: F.substring(F.col("content"), i * 80 + 1, F.lit(80)).cast("string"))).alias("pos", "card")
    rows = files.select("path", card)
    end = rows.filter(F.trim(F.substring("card", 1, 8)) == "END").groupBy("path").agg(F.min("pos").alias("end"))
    own = rows.join(end, "path", "left").filter((F.col("end").isNull() | (F.col("pos") < F.col("end"))) & (F.substring("card", 9, 1) == "="))
    value = F.trim(F.regexp_replace(F.regexp_extract(F.substring("card", 10, 71), r"^\s*('(?:[^']|'')*'|[^/]*)", 1), "^'|'\\s*$", ""))
    return own.select("path", F.trim(F.substring("card", 1, 8)).alias("key"), F.trim(value).alias("value"))


def observed_date(text: Column) -> Column:
    """A date from ISO, day/month/year or slashed forms, in that order; two-digit years are of the twentieth century."""
    tries = [F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.try_to_date(text, "dd/MM/yyyy"), F.try_to_date(text, "yyyy/MM/dd"), F.try_to_date(text, "dd/MM/yy")]
    found = F.coalesce(*tries)
    short = text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$")
    return F.when(short & (F.year(found) >= 2000), F.add_months(found, -1200)).otherwise(found)


#: What literature records are marked with.
LITERATURE_TAGS = ("P_VS_NP", "LITERATURE_DISCOVERY")
REVIEW_STATE, AUTHORITY, CEILING = "UNEXAMINED", "DISCOVERY_METADATA_ONLY", "PAPER_METADATA_AND_CLAIMS_REQUIRE_SEPARATE_VALIDATION"


def _literature(provider: str, doi: Column, other: Column, title: Column, text: Column, url: Column) -> list[Column]:
    marks = [F.array(*map(F.lit, LITERATURE_TAGS)).alias("relation_tags"), F.lit(REVIEW_STATE).alias("review_state"), F.lit(AUTHORITY).alias("scientific_authority"), F.lit(CEILING).alias("claim_ceiling")]
    return [F.lit(provider).alias("provider"), F.coalesce(doi, other).alias("archive_id"), doi.alias("doi"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(text, F.lit("")).alias("text"), url.alias("source_url"), *marks]


def crossref_records(items: DataFrame, kept: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Literature records from items (DOI, URL, title array<string>, abstract), with the items' columns kept; the first title counts. With most abstracts end at so many characters."""
    doi = normalize_doi(F.col("DOI"))
    url = F.coalesce(F.nullif("URL", F.lit("")), F.concat(F.lit("https://doi.org/"), doi), F.lit(""))
    text = F.col("abstract") if most is None else F.substring("abstract", 1, most)
    return items.select(*kept, *_literature("CROSSREF", doi, F.col("URL"), F.get("title", F.lit(0)), text, url))


def openalex_records(items: DataFrame, kept: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Literature records from items (id, doi, title, abstract_inverted_index map<string,array<int>>), with the items' columns kept. With most abstracts end at so many characters."""
    doi = normalize_doi(F.col("doi"))
    url = F.coalesce(F.nullif("doi", F.lit("")), F.nullif("id", F.lit("")), F.lit(""))
    return items.select(*kept, *_literature("OPENALEX", doi, F.col("id"), F.col("title"), abstract_of(F.col("abstract_inverted_index"), most), url))
