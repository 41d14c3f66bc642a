"""File trees as records: domains, roles, lexicon scores, routing, workflows, seeds, enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.hashing import stream_digest


def classify_domain(path: Column, prefixes: list[tuple[str, str]], other: str = "OTHER") -> Column:
    """The domain of the first prefix that a path begins with."""
    out = F.lit(other)
    for prefix, domain in reversed(prefixes):
        out = F.when(path.startswith(prefix), domain).otherwise(out)
    return out


def roles_for(path: Column, text: Column, roles: dict[str, str]) -> Column:
    """Roles whose pattern is found in the path or the text, in the order given."""
    whole = F.concat_ws("\n", path, text)
    return F.array_compact(F.array(*[F.when(whole.rlike(p), F.lit(r)) for r, p in roles.items()]))


def lexicon_score(text: Column, weights: dict[str, int]) -> Column:
    """Summed weights of the terms that a text has."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(w)), n).otherwise(0) for w, n in weights.items()])


def routing_queue(rows: DataFrame, least: int = 5) -> DataFrame:
    """Rows (path, score) that score enough, best first."""
    return rows.filter(F.col("score") >= least).orderBy(F.col("score").desc(), "path")


def workflow_flags(text: Column) -> dict[str, Column]:
    """What a workflow file's triggers and permissions are."""
    return {"has_schedule": text.rlike(r"(?m)^\s*schedule:"), "has_dispatch": text.rlike(r"(?m)^\s*workflow_dispatch:"), "has_push": text.rlike(r"(?m)^\s*push:"), "can_write": text.rlike(r"(?m)^\s*contents:\s*write")}


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; NaN and infinities pass, null doesn't.

    The functions for JSON read the first value and pass over what follows it, so
    the text is put before another element of an array and before another field of
    an object: what ends the one early is no part of the other.
    """
    strict = {"allowSingleQuotes": "false"}
    element = F.size(F.from_json(F.concat(F.lit("["), text, F.lit(",0]")), "array<string>", strict)) == 2
    field = F.from_json(F.concat(F.lit('{"v":'), text, F.lit(',"end":true}')), "v string, end boolean", strict)["end"]
    return F.coalesce(element & field, F.lit(False))


def declared_metadata(text: Column, keys: list[str]) -> Column:
    """The scalar values that a JSON document gives for the keys, as a map; null where it isn't JSON."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.get_json_object(text, f"$.{k}").alias("value")) for k in keys])
    found = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return F.when(is_json(text), found)


def scan_summary(rows: DataFrame) -> DataFrame:
    """(dimension, value, n) of domains and roles of rows (path, domain, roles)."""
    a = rows.select(F.lit("domain").alias("dimension"), F.col("domain").alias("value"))
    b = rows.select(F.lit("role").alias("dimension"), F.explode("roles").alias("value"))
    return a.unionByName(b).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def to_seeds(rows: DataFrame, skip: tuple[str, ...] = ("INFRASTRUCTURE",)) -> DataFrame:
    """Seed records (id, title, text, relation_tags) of files (path, domain, roles, text) outside the skipped domains."""
    tags = F.array_sort(F.array_distinct(F.concat(F.array(F.lower("domain")), F.transform("roles", F.lower))))
    return rows.filter(~F.col("domain").isin(*skip)).select(F.concat(F.lit("file:"), "path").alias("id"), F.regexp_extract("path", "([^/]+)$", 1).alias("title"), F.concat_ws(" ", "path", "domain", F.array_join("roles", " "), F.substring("text", 1, 1000)).alias("text"), tags.alias("relation_tags"))


def enrich(rows: DataFrame, fetched: DataFrame, allowed: Column) -> DataFrame:
    """rows (url, ...) with the status of their enrichment from pages fetched before (url, html); every row stays."""
    got = rows.join(fetched, "url", "left")
    return got.withColumn("state", F.when(~allowed, "HOST_NOT_ALLOWED").when(F.col("html").isNull(), "NOT_FETCHED").otherwise("ENRICHED"))


def source_health(rows: DataFrame) -> DataFrame:
    """Per source: passes, failures and records. rows: (source, ok, records)."""
    return rows.groupBy("source").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("unavailable"), F.sum("records").alias("records"))


def pack(nodes: DataFrame, context: DataFrame, attention: DataFrame) -> DataFrame:
    """Nodes with their facets and attention; a node without either stays. nodes (id, ...), context (subject, facet, status), attention (node, score)."""
    facets = context.groupBy(F.col("subject").alias("id")).agg(F.array_sort(F.collect_list(F.struct("facet", "status"))).alias("facets"))
    return nodes.join(facets, "id", "left").join(attention.select(F.col("node").alias("id"), "score"), "id", "left")


def assimilate(files: DataFrame, prefixes: list[tuple[str, str]], roles: dict[str, str], lexicon: dict[str, int], negative: str, least: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tree's files as (index, queue, receipt). files: (path, text), one for each path.

    index: path, domain, roles, score, negative (whether the text has what the
    pattern negative finds) and json (whether a .json file parses, null for
    others). queue: the files that score at least least, best first. receipt: one row
    of counts, the status and order-free digests of both. A null text counts as
    empty, and isn't JSON; no files give an empty index and FAIL_EMPTY_SCAN.
    """
    text = F.coalesce("text", F.lit(""))
    parses = F.when(F.lower("path").endswith(".json"), is_json(text))
    index = files.select("path", classify_domain(F.col("path"), prefixes).alias("domain"), roles_for(F.col("path"), text, roles).alias("roles"), lexicon_score(text, lexicon).alias("score"), text.rlike(negative).alias("negative"), parses.alias("json"))
    line = F.concat_ws("|", "path", "domain", F.array_join("roles", ","), F.col("score").cast("string"))
    signed = index.withColumn("sha", F.sha2(line, 256))
    queue = routing_queue(index, least)
    counts = index.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("score") >= least).alias("candidates"), F.count_if("negative").alias("negative"), F.count_if(~F.col("json")).alias("json_errors"))
    status = F.when(F.col("files") == 0, "FAIL_EMPTY_SCAN").when(F.col("json_errors") > 0, "PASS_WITH_JSON_PARSE_WARNINGS").otherwise("PASS")
    digest = lambda rows, name: stream_digest(rows, "sha").select(F.col("digest").alias(name))
    receipt = counts.withColumn("status", status).crossJoin(digest(signed, "index_sha256")).crossJoin(digest(signed.filter(F.col("score") >= least), "queue_sha256"))  # one row each
    return index, queue, receipt
