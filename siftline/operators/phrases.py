"""Phrases of a lexicon in texts: an index of phrases by their first token, joined to token positions and verified there.

A position costs one look-up however many phrases there are, and a plan doesn't
grow with the lexicon. A lexicon is broadcast after a look at its size; a larger
one is joined by shuffle, with no more of the text than its longest phrase needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import norm_tokens

#: So many phrases are broadcast at most.
MOST = 100_000
#: Characters of a phrase's beginning that a substring search looks up.
GRAM = 4


def lexicon(aliases: DataFrame) -> DataFrame:
    """(family, alias, words): the lexicon's lines with their normalised tokens. Repeated lines count once, lines without a token never match."""
    return aliases.select("family", "alias").distinct().withColumn("words", norm_tokens(F.col("alias"))).filter(F.size("words") > 0)


def _sized(lines: DataFrame) -> tuple[DataFrame, int]:
    """The lines, broadcast if they aren't too many, and the words of the longest."""
    size = lines.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("words")).alias("words")).first()
    return (F.broadcast(lines) if size["n"] <= MOST else lines), size["words"] or 1


def _positions(rows: DataFrame, longest: int) -> DataFrame:
    """rows (keys, w) with a row for each place in w: at (from 0), token, and ahead, the words from there on that a phrase can reach."""
    keys = [f"`{c}`" for c in rows.columns if c != "w"]
    flat = rows.select(*keys, "w", F.posexplode("w").alias("at", "token"))
    return flat.select(*keys, "at", "token", F.slice("w", F.col("at") + 1, longest).alias("ahead"))


def whole_words(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(keys, family, alias, size, at): every occurrence of a phrase as whole words, size words from place at on. rows: keys and w, an array of normalised tokens."""
    lines, longest = _sized(lexicon(aliases).withColumn("token", F.element_at("words", 1)))
    keys = [f"`{c}`" for c in rows.columns if c != "w"]
    met = _positions(rows, longest).join(lines, "token").filter(F.slice("ahead", F.lit(1), F.size("words")) == F.col("words"))
    return met.select(*keys, "family", "alias", F.size("words").alias("size"), "at")


def substrings(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(keys, family, alias, at): every place whose token begins an occurrence of a phrase, also inside words; w's tokens stand one space apart."""
    lines = lexicon(aliases).withColumn("phrase", F.array_join("words", " "))
    lines = lines.withColumn("gram", F.substring(F.element_at("words", 1), 1, GRAM))
    lines, longest = _sized(lines)
    lengths = [r[0] for r in lines.select(F.length("gram")).distinct().collect()]  # GRAM of them at most
    keys = [f"`{c}`" for c in rows.columns if c != "w"]

    def cut(q: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.length("token")), lambda i: i + q - 1 <= F.length("token"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.substring(F.col("token"), i, F.lit(q)).alias("gram")))

    grams = F.concat(*[cut(q) for q in sorted(lengths)]) if lengths else F.array().cast("array<struct<start:int,gram:string>>")
    flat = _positions(rows, longest).select(*keys, "at", "ahead", F.explode(grams).alias("g")).select(*keys, "at", "ahead", "g.start", "g.gram")
    met = flat.join(lines, "gram").filter(F.substring(F.array_join("ahead", " "), F.col("start"), F.length("phrase")) == F.col("phrase"))
    return met.select(*keys, "family", "alias", "at")


def apart(places: Column, size: Column) -> Column:
    """How many of the places (an array) a scan from the left counts, passing over those inside the last counted phrase of that size."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("int").alias("end"))
    step = lambda s, p: F.when(p < s["end"], s).otherwise(F.struct((s["n"] + 1).alias("n"), (p + size).cast("int").alias("end")))
    return F.aggregate(F.array_sort(places), zero, step, lambda s: s["n"])
