"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask covers six or eight token positions and ignores some of them. The hashes of what each mask
keeps, at every position of every document, are joined to those of the
benchmark's items; a hit fixes how the item lies along the document, and the
overlap is verified there token by token, allowing substitutions. Positions are
exploded and hashed inside code generation; what is broadcast is a bounded number of
seeds with the numbers and positions of their items, and only texts that a hit names
are shuffled.

Recall: of all ways to substitute a fifth of an item's tokens (of a window's, where
the item is longer), at least 0.98 leave a seed whole, at every length from ten
tokens on; a test enumerates them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, maybe_among, row_key, stored, table

#: Positions that a seed keeps (1) or ignores (0).
MASKS = ("111011", "11001011", "11010011")
#: Items of fewer tokens are too short to convict a document.
SPAN = 10
#: Of an aligned window of WINDOW tokens (the whole item if it is shorter) this share must agree.
WINDOW, SHARE = 16, 0.8
#: Benchmark tokens whose seeds are broadcast at once; a larger benchmark is taken in blocks, one pass over the documents each. Long items are split among them.
BLOCK_TOKENS = 200_000


def tokens(text: Column) -> Column:
    """Lower-case runs of anything but white space and ASCII punctuation; null counts as empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\s\\p{Punct}]+"), "")


def _seeds(rows: DataFrame, extra: list[str]) -> DataFrame:
    """A row (extra, pos, seed) for each position and each mask that fits there; the column h holds token hashes."""
    used = sorted({i for m in MASKS for i, x in enumerate(m) if x == "1"})
    n = F.greatest(F.size("h") - (min(map(len, MASKS)) - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("h", F.lit(i + 1), n).alias(f"t{i}") for i in used])
    name = {i: f"t{i}" for i in used}
    flat = rows.select(*extra, F.posexplode(zipped).alias("pos", "w"))
    have = flat.schema["w"].dataType.fieldNames()
    at = {i: F.col("w").getField(name[i] if name[i] in have else have[k]) for k, i in enumerate(used)}
    # a mask that reaches beyond the last token gives no seed
    made = F.array(*[F.when(at[len(m) - 1].isNotNull(), F.xxhash64(F.lit(k), *[at[i] for i, x in enumerate(m) if x == "1"])) for k, m in enumerate(MASKS)])
    return flat.select(*extra, "pos", F.explode(made).alias("seed")).filter("seed is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_tokens: int | None = None) -> DataFrame:
    """(id, item_id, matched, overlap): pairs of a document and an item that it holds.

    overlap is the length of the item's longest extent along the document and
    matched the number of equal tokens in it, at the alignment that matches most
    (then overlaps most). Items of fewer than SPAN tokens are too short to
    convict a document and never match; empty texts hold nothing. Rows that share
    an id count as one document and items that share an item_id as one item.
    Items and documents may be of any length.
    """
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    items = stored(benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("it")).filter(F.size("it") >= SPAN).distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    total = items.agg(F.coalesce(F.sum(F.size("it")), F.lit(0))).first()[0]
    blocks = -(-total // (block_tokens or BLOCK_TOKENS)) or 1
    k1, k2 = row_key(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    places = _seeds(rows.select("k1", "k2", hashed(tokens(F.col("text"))).alias("h")), ["k1", "k2"])
    seeds = _seeds(items.select("item", hashed("it").alias("h")), ["item"]).withColumnRenamed("pos", "ip").distinct()
    found = None
    for block in range(blocks):
        own = seeds if blocks == 1 else seeds.filter(F.pmod(F.xxhash64("item", F.floor(F.col("ip") / 1024)), F.lit(blocks)) == block)
        hits = places.join(F.broadcast(own), "seed").select("k1", "k2", "item", (F.col("pos") - F.col("ip")).alias("start")).distinct()
        part = stored(hits, "hits")
        found = part if found is None else found.unionByName(part)
    found = found.distinct() if blocks > 1 else found
    texts = maybe_among(rows, found, "k1").join(found, ["k1", "k2"]).select("_id", "item", "start", tokens(F.col("text")).alias("dt"))
    best = F.max(F.struct("matched", "overlap"))
    out = _verified(texts.join(items, "item"))
    return out.groupBy("_id", "item_id").agg(best.alias("b")).select(F.col("_id").alias(id_col), "item_id", F.col("b.matched").alias("matched"), F.col("b.overlap").alias("overlap"))


def _verified(alignments: DataFrame) -> DataFrame:
    """Alignments of an item (it) with a document (dt) from token start on that have a window with enough equal tokens."""
    lo = F.greatest(-F.col("start"), F.lit(0))
    n = F.least(F.size("it") - lo, F.size("dt") - (F.col("start") + lo))
    eq = F.zip_with(F.slice("it", lo + 1, n), F.slice("dt", F.col("start") + lo + 1, n), lambda x, y: (x == y).cast("int"))
    cut = alignments.select("_id", "item_id", eq.alias("eq")).filter(F.size("eq") >= SPAN)
    wide = F.least(F.size("eq"), F.lit(WINDOW))
    total = F.aggregate("eq", F.lit(0), lambda s, x: s + x)
    cut = cut.select("_id", "item_id", "eq", wide.alias("wide"), total.alias("matched"))
    return cut.filter(F.col("matched") >= F.ceil(F.col("wide") * SHARE)).filter(_has_window()).select("_id", "item_id", F.col("matched").cast("long").alias("matched"), F.size("eq").cast("long").alias("overlap"))


def _has_window() -> Column:
    """Whether some wide consecutive ones of eq sum up to the needed share."""
    need = F.ceil(F.col("wide") * SHARE)
    at = F.sequence(F.lit(1), F.size("eq") - F.col("wide") + 1)
    return F.exists(at, lambda i: F.aggregate(F.slice("eq", i, F.col("wide")), F.lit(0), lambda s, x: s + x) >= need)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item. Rows are told apart by id and text, so one with a null or repeated id goes only for its own text; null and empty texts stay."""
    key, text = fresh("row"), fresh("text")
    keyed = docs.withColumn(key, F.struct(*row_key(id_col, text_col)))
    bad = contaminated(keyed.select(key, F.col(text_col).alias(text)), benchmark, key, text).select(key).distinct()
    return keyed.join(bad, key, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
