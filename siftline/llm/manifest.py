"""Merkle dataset manifest: a hash tree over a table by groups, with proofs, ranks taken from bitmaps.

1. Every row becomes a leaf digest where its text is; texts are never shuffled.
2. The ids of each group are a bitmap: 64-bit words, of which only those with an id
   exist. Partial words of all tasks are merged by OR. A directory gives each word
   the number of the group's rows before it: words are counted up inside containers
   of 512, containers along ranges of their order. A leaf's coordinate is its word's
   start plus the popcount of the lower bits; leaves are never sorted.
3. A node's children meet under (group, rank div FAN) and are put in an array by
   their slot, rank mod FAN. Each level is one such aggregation over an eighth of the
   rows of the one below, and is written once.
4. Paths go down the levels again by joins on the same keys: a node's siblings, left
   and right of it, before those of its parent.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.plans.ordered import running_sums

from .shared import stored, table

#: Children of a node.
FAN = 8
#: Words of a container, as a power of two.
_CONTAINER = 9
#: The word of null ids, before all others.
_NO_ID = -(1 << 57) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """The field's part in the hashed string: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """sha256 of the parts, concatenated, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else; texts of one byte a character need no table."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def leaves(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang", others: tuple[str, ...] = ("source", "lang", "n_chars"), tampered: Column | None = None) -> DataFrame:
    """(g, id, leaf, other): each row's group key, id and digest, and that of the row with its text's A-Z lower-cased where the condition tampered holds, else null.

    g orders groups by the bytes of their name, the null one first.
    """
    before = F.concat(framed(F.col(id_col)), *[framed(F.col(c)) for c in others])
    text = F.col(text_col)
    changed = F.when(F.coalesce(tampered, F.lit(False)), digest(before, framed(ascii_lower(text)))) if tampered is not None else F.lit(None).cast("binary")
    return docs.select(F.coalesce(F.concat(F.lit("+"), F.col(group_col)), F.lit("")).alias("g"), F.col(id_col).cast("long").alias("id"), digest(before, framed(text)).alias("leaf"), changed.alias("other"))


def _words(rows: DataFrame) -> DataFrame:
    """(g, word, bits, extra, n): bitmaps of each group's ids; extra holds the bits of ids with several rows and how many more than one they have, n counts rows."""
    ids = rows.select("g", "word", "bit").repartition("g", "word").groupBy("g", "word", "bit").agg(F.count(F.lit(1)).alias("rows"))
    more = F.when(F.col("rows") > 1, F.struct("bit", (F.col("rows") - 1).alias("more")))
    return ids.groupBy("g", "word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("bits"), F.collect_list(more).alias("extra"), F.sum("rows").alias("n"))


def _directory(words: DataFrame) -> DataFrame:
    """words with start (rows of the group before the word) and m (rows of the group)."""
    here = words.withColumn("container", F.shiftright("word", _CONTAINER))
    boxes = running_sums(here.groupBy("g", "container").agg(F.sum("n").alias("rows")), ["g", "container"], {"before": "rows"}, lambda df: stored(df, "containers"))
    groups = boxes.groupBy("g").agg(F.min("before").alias("first"), F.sum("rows").alias("m"))
    boxes = boxes.join(groups, "g").select("g", "container", (F.col("before") - F.col("first")).alias("base"), "m")
    inside = Window.partitionBy("g", "container").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    counted = here.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counted.join(boxes, ["g", "container"]).select("g", "word", "bits", "extra", (F.col("base") + F.col("below")).alias("start"), "m")


def ranked(rows: DataFrame) -> DataFrame:
    """rows (g, id, leaf, other) with m, the number of rows of the group, and rank, the row's place in it by id from 0.

    Null ids come first; rows of one id are in the order of their leaf, equal rows as they come.
    """
    placed = rows.withColumns({"word": F.coalesce(F.shiftright("id", 6), F.lit(_NO_ID)), "bit": F.coalesce(F.col("id").bitwiseAND(F.lit(63)).cast("int"), F.lit(0))})
    words = stored(_words(placed), "bitmaps")
    lower = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("bit"))))).cast("long")
    more = F.aggregate(F.filter("extra", lambda x: x["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda s, x: s + x["more"])
    found = placed.join(_directory(words), ["g", "word"]).withColumn("rank", F.col("start") + lower + more)
    again = F.exists("extra", lambda x: x["bit"] == F.col("bit"))
    names = ["g", "id", "leaf", "other", "m", "rank"]
    if words.filter(F.size("extra") > 0).isEmpty():
        return found.select(names)
    same = found.filter(again).groupBy("g", "id", "leaf", "other", "m", "rank").agg(F.count(F.lit(1)).alias("copies"))
    same = running_sums(same, ["g", "id", "leaf"], {"before": "copies"}, lambda df: stored(df, "repeated"))
    first = same.groupBy("g", "rank").agg(F.min("before").alias("first"))
    at = F.col("rank") + F.col("before") - F.col("first")
    spread = same.join(first, ["g", "rank"]).withColumn("rank", F.explode(F.sequence(at, at + F.col("copies") - 1)))
    return found.filter(~again).select(names).unionByName(spread.select(names))


def _reduced(nodes: DataFrame, most: int, kept: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(levels, roots). A level holds (g, rank, m, kids, hash) of the nodes that it makes: kids are structs of kept, in the order of their slots, and m counts the level's nodes in the group. roots are the (g, hash) that remain; most is the largest group.

    nodes: (g, rank, m, hash, and the columns kept).
    """
    levels, roots = [], nodes.filter("m = 1").select("g", "hash")
    while most > 1:
        kid = F.struct((F.col("rank") % FAN).alias("slot"), *kept, "hash")
        up = nodes.filter("m > 1").withColumn("up", F.floor(F.col("rank") / FAN)).groupBy("g", "up").agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.max("m").alias("m"))
        hash_ = digest(F.array_join(F.transform("kids", lambda k: hexed(k["hash"])), ""))
        made = stored(up.select("g", F.col("up").alias("rank"), F.ceil(F.col("m") / FAN).alias("m"), "kids", hash_.alias("hash")), "level")
        levels.append(made)
        nodes, kept, most = made, [], -(-most // FAN)
        roots = roots.unionByName(made.filter("m = 1").select("g", "hash"))
    return levels, roots


def _joined(kids: Column) -> Column:
    return F.aggregate(kids, F.lit(b""), lambda s, k: F.concat(s, k["hash"]))


def _paths(levels: list[DataFrame], top: DataFrame, kept: list[str]) -> DataFrame:
    """(g, columns of top but path, path, rank, hash, kept) of every node under the lowest level; path lists the siblings left and right of it and of its ancestors. top: a row (g, path, ...) for each group of several nodes."""
    carried = [c for c in top.columns if c not in ("g", "path")]
    at = top.withColumn("rank", F.lit(0).cast("long"))
    for k, level in reversed(list(enumerate(levels))):
        # the groups whose root is at this level start here, the others come from above
        start = level.filter("m = 1").join(top, "g").select("g", "rank", "kids", "path", *carried)
        here = level.filter("m > 1").join(at, ["g", "rank"]).select("g", "rank", "kids", "path", *carried) if k + 1 < len(levels) else None
        here = start if here is None else start.unionByName(here)
        one = here.select("g", "rank", "kids", "path", *carried, F.posexplode("kids").alias("slot", "kid"))
        siblings = F.struct(_joined(F.slice("kids", 1, F.col("slot"))).alias("left"), _joined(F.slice("kids", F.col("slot") + 2, FAN)).alias("right"))
        names = ["hash", *kept] if k == 0 else []
        at = one.select("g", *carried, (F.col("rank") * FAN + F.col("slot")).alias("rank"), F.concat(F.array(siblings), "path").alias("path"), *[F.col("kid")[c].alias(c) for c in names])
    return at


def manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang", others: tuple[str, ...] = ("source", "lang", "n_chars"), tampered: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of docs, digests in lower-case hex.

    A leaf is the digest of the row's id, others and text. Leaves of each group
    ascend by id; every FAN consecutive ones (the last run: fewer, even one)
    become the digest of theirs until one, the group's subroot, remains; subroots
    in the order of group names give root likewise. A proof lists a leaf's
    siblings up to root. folded_root is recomputed from the leaf and its proof,
    where tampered holds from the leaf of the row with its text's A-Z lower-cased,
    and verified says whether it equals root.

    Null ids come first in their group, the null group before all others. Rows of
    one id are ordered by their leaf; equal rows are leaves of their own. A single
    leaf is its subroot, a single subroot is root, with empty proofs. An empty table
    gives no rows. Empty texts differ from null ones. Further columns aren't read.
    """
    rows = stored(leaves(docs, id_col, text_col, group_col, others, tampered), "leaves")
    nodes = ranked(rows).withColumnRenamed("leaf", "hash")
    nodes = stored(nodes, "ranked")
    most = nodes.agg(F.max("m")).first()[0]
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    if most is None:
        return docs.select(F.col(id_col), *[F.lit("").alias(c) for c in names], F.lit(True).alias("verified")).limit(0)
    levels, roots = _reduced(nodes, most, ["id", "other"])
    groups = running_sums(roots.withColumn("one", F.lit(1).cast("long")), ["g"], {"rank": "one"}, lambda df: stored(df, "roots"))
    n = groups.count()
    tops, root = _reduced(groups.select(F.lit("").alias("g"), "rank", F.lit(n).cast("long").alias("m"), "hash", F.col("g").alias("name")), n, ["name"])
    whole = root.select("g", F.col("hash").alias("root"))
    no_path = F.filter(F.array(F.struct(F.lit(b"").alias("left"), F.lit(b"").alias("right"))), lambda s: F.lit(False))
    if n > 1:
        above = _paths(tops, whole.withColumn("path", no_path), ["name"]).select(F.col("name").alias("g"), F.col("hash").alias("subroot"), "root", "path")
    else:
        above = groups.select("g", F.col("hash").alias("subroot"), F.col("hash").alias("root"), no_path.alias("path"))
    above = stored(above, "subroots")
    found = nodes.filter("m = 1").join(above, "g").select("id", "hash", "other", "subroot", "root", "path")
    if levels:
        found = found.unionByName(_paths(levels, above, ["id", "other"]).select("id", "hash", "other", "subroot", "root", "path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: hexed(F.concat(s["left"], s["right"]))), ""), 256)
    fold = F.aggregate("path", hexed(F.coalesce("other", "hash")), lambda h, s: F.sha2(F.concat(hexed(s["left"]), h, hexed(s["right"])), 256))
    out = found.select(F.col("id").alias(id_col), hexed(F.col("hash")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, tampered=F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0)


_CRC = """list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)"""
_FRAMED = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_FIELDS = " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_ASCII_LOWER = f"translate(text, '{_UPPER}', '{_LOWER}')"

#: The crc folds a document id's digits; every level and every step of the paths is a step of a recursive query.
OP12_SQL = f"""
WITH RECURSIVE
docs AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, sha256({_FIELDS} || {_FRAMED.format("text")}) AS leaf,
         CASE WHEN xor({_CRC}, 4294967295) % 3 = 0 THEN sha256({_FIELDS} || {_FRAMED.format(_ASCII_LOWER)}) END AS other
  FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS m FROM docs),
up AS (
  SELECT 0 AS level, g, r, m, leaf AS h FROM ranked
  UNION ALL
  SELECT level + 1, g, r // 8, any_value((m + 7) // 8), sha256(string_agg(h, '' ORDER BY r)) FROM up WHERE m > 1 GROUP BY level, g, r // 8),
subroots AS (SELECT g, h FROM up WHERE m = 1),
tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS m, h FROM subroots
  UNION ALL
  SELECT level + 1, r // 8, any_value((m + 7) // 8), sha256(string_agg(h, '' ORDER BY r)) FROM tops WHERE m > 1 GROUP BY level, r // 8),
root AS (SELECT h AS root FROM tops WHERE m = 1),
nodes AS (SELECT 'up' || g AS tree, level, r, m, h FROM up UNION ALL SELECT 'top', level, r, m, h FROM tops),
siblings AS (
  SELECT a.tree, a.level, a.r, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r < a.r), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.r) FILTER (b.r > a.r), '') AS after
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.r // 8 = b.r // 8 WHERE a.m > 1 GROUP BY ALL),
inside AS (
  SELECT g, r AS leaf_r, 0 AS level, r, coalesce(other, leaf) AS fold, '' AS proof FROM ranked
  UNION ALL
  SELECT w.g, w.leaf_r, w.level + 1, w.r // 8, sha256(s.before || w.fold || s.after), w.proof || s.before || s.after
  FROM inside w JOIN siblings s ON s.tree = 'up' || w.g AND s.level = w.level AND s.r = w.r),
below AS (SELECT g, leaf_r, max_by(fold, level) AS fold, max_by(proof, level) AS proof FROM inside GROUP BY g, leaf_r),
above AS (
  SELECT g, leaf_r, 0 AS level, n.r, fold, proof FROM below JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS r FROM subroots) n USING (g)
  UNION ALL
  SELECT w.g, w.leaf_r, w.level + 1, w.r // 8, sha256(s.before || w.fold || s.after), w.proof || s.before || s.after
  FROM above w JOIN siblings s ON s.tree = 'top' AND s.level = w.level AND s.r = w.r),
paths AS (SELECT g, leaf_r, max_by(fold, level) AS folded_root, max_by(proof, level) AS proof FROM above GROUP BY g, leaf_r)
SELECT doc_id, leaf, s.h AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ranked d JOIN subroots s USING (g) JOIN paths p ON p.g = d.g AND p.leaf_r = d.r CROSS JOIN root
"""
