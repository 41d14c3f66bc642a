"""Line deduplication by overlapping three-line windows, in DataFrame operations only.

Every run of three consecutive lines is hashed; a window that occurs more than
once anywhere keeps its first occurrence, in order of (id, position), and all
lines under its later occurrences go. Overlapping windows merge, as positions are
gathered in a set. Only hashes and positions are shuffled to find repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh, row_key, table

LINES = 3


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_k1, _k2, _id, _pos, _h1, _h2): a row for each window. A text of one or two lines is one window of all its lines."""
    lines = F.split(F.col(text_col), "\n")
    k1, k2 = row_key(id_col, text_col)
    rows = docs.filter(F.col(text_col).isNotNull()).select(k1.alias("_k1"), k2.alias("_k2"), F.col(id_col).alias("_id"), lines.alias("l"))
    n = F.size("l")
    zipped = F.arrays_zip(*[F.slice("l", i + 1, n).alias(f"l{i}") for i in range(LINES)])
    rows = rows.select("_k1", "_k2", "_id", F.least(n, F.lit(LINES)).alias("own"), F.greatest(n - (LINES - 1), F.lit(1)).alias("many"), F.posexplode(zipped).alias("_pos", "w")).filter("_pos < many")
    parts = [F.col("w").getField(str(i) if f"l{i}" not in rows.schema["w"].dataType.fieldNames() else f"l{i}") for i in range(LINES)]
    return rows.select("_k1", "_k2", "_id", "_pos", F.xxhash64("own", *parts).alias("_h1"), F.xxhash64(*parts, "own").alias("_h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cleaned, and n_lines and n_removed counted; all rows and other columns stay.

    A text whose lines are all gone becomes empty; null texts stay null with no
    lines. Null ids come first in the order of occurrences. Rows that agree in id
    and text are one row in that order: what the first occurrence keeps, each
    keeps. Columns of docs named n_lines or n_removed are replaced.
    """
    found = windows(docs, id_col, text_col)
    first = found.groupBy("_h1", "_h2").agg(F.min(F.struct("_id", "_pos")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    later = found.join(first, ["_h1", "_h2"]).filter(F.struct("_id", "_pos") > F.col("_first"))
    gone_, k1, k2, left_ = (fresh(c) for c in ("gone", "k1", "k2", "left"))
    gone = later.groupBy(F.col("_k1").alias(k1), F.col("_k2").alias(k2)).agg(F.collect_set("_pos").alias(gone_))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    own = row_key(id_col, text_col)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], own[0].alias(k1), own[1].alias(k2)).join(gone, [k1, k2], "left")
    lines = F.split(F.col(text_col), "\n")
    n = F.size(lines)
    under = F.flatten(F.transform(gone_, lambda p: F.sequence(p, F.least(p + (LINES - 1), n - 1))))
    left = F.array_except(F.sequence(F.lit(0), n - 1), under)
    rows = rows.withColumn(left_, F.when(F.col(gone_).isNotNull(), left))
    clean = F.when(F.col(left_).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left_, lambda i: F.element_at(lines, i + 1)), "\n"))
    count = F.when(F.col(text_col).isNull(), 0).otherwise(n)
    return rows.select(
        *[(clean.alias(c) if c == text_col else F.col(f"`{c}`")) for c in kept],
        count.cast("long").alias("n_lines"),
        F.when(F.col(left_).isNull(), 0).otherwise(n - F.size(left_)).cast("long").alias("n_removed"),
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, p - 1 AS pos, CASE WHEN len(lines) < 3 THEN lines ELSE lines[p:p+2] END AS win
  FROM l, unnest(range(1, greatest(len(lines) - 2, 1) + 1)) AS r(p)
),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM w),
g AS (SELECT DISTINCT doc_id, pos + d AS pos FROM f, unnest(range(0, 3)) AS r(d) WHERE k > 1),
e AS (SELECT doc_id, i - 1 AS pos, lines[i] AS line FROM l, unnest(range(1, len(lines) + 1)) AS r(i)),
k AS (
  SELECT e.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(e.line, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL) AS text
  FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY e.doc_id
)
SELECT doc_id, coalesce(text, '') AS text, n_lines, n_removed FROM k
"""
