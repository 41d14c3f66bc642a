"""Identities and digests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(*names: str) -> Column:
    """Sorted-key JSON without spaces. Only strings, integers, booleans and nulls are byte-stable; doubles aren't."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def row_sha(*names: str) -> Column:
    return F.sha2(canonical_json(*names), 256)


def document_id(provider: Column, archive_id: Column, url: Column) -> Column:
    own = F.coalesce(F.nullif(archive_id, F.lit("")), F.substring(F.sha2(F.coalesce(url, F.lit("")), 256), 1, 16))
    return F.concat_ws(":", F.lit("doc"), F.coalesce(provider, F.lit("?")), own)


def source_family(provider: Column, archive_id: Column, url: Column) -> Column:
    pr = F.upper(F.coalesce(F.nullif(provider, F.lit("")), F.lit("UNKNOWN")))
    aid = F.trim(F.coalesce(archive_id, F.lit("")))
    by_url = F.concat(pr, F.lit(":URL:"), F.substring(F.sha2(F.coalesce(url, F.lit("")), 256), 1, 16))
    return F.when(aid != "", F.concat(pr, F.lit(":"), F.upper(aid))).otherwise(by_url)


def fold(group: Column, folds: int) -> Column:
    """First eight bytes of sha256, as an unsigned integer, modulo folds."""
    return (F.conv(F.substring(F.sha2(group, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(folds)).cast("int")


def hex_hamming(a: Column, b: Column, digits: int = 64) -> Column:
    """Differing bits of two equally long hex digests, eight digits at a time."""
    part = lambda c, i: F.conv(F.substring(c, i, 8), 16, 10).cast("long")
    out = F.lit(0)
    for i in range(1, digits + 1, 8):
        out = out + F.bit_count(part(a, i).bitwiseXOR(part(b, i)))
    return out.cast("int")


def equal_positions(a: Column, b: Column, digits: int = 64) -> Column:
    """Positions with the same hex digit."""
    at = F.sequence(F.lit(1), F.lit(digits))
    return F.size(F.filter(at, lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))


def stream_digest(df: DataFrame, sha: str, buckets: int = 256) -> DataFrame:
    """(digest, n): one digest of all row hashes that doesn't depend on their order.

    Hashes are sorted inside buckets by their first digits, and the buckets'
    digests in order of bucket, so no task holds more than its bucket.
    """
    cut = (F.conv(F.substring(sha, 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int")
    inside = df.groupBy(cut.alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(sha)), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return inside.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), ""), 256).alias("digest"), F.sum("n").alias("n"))


def record_key(provider: Column, archive_id: Column, url: Column, title: Column, digest: Column) -> Column:
    """(kind, key) by which records are the same: provider and archive id, else URL, else title, else digest."""
    none, low = F.lit(""), lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    a, u, t = low(archive_id), low(url), F.lower(F.trim(F.regexp_replace(F.coalesce(title, none), r"\s+", " ")))
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    by_archive = pair("ARCHIVE", F.concat_ws("|", F.upper(F.coalesce(provider, none)), a))
    return F.when(a != "", by_archive).when(u != "", pair("URL", u)).when(t != "", pair("TITLE", t)).otherwise(pair("SHA", digest))
