"""Reading, writing and profiling record files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for end in (".gz", ".bz2"):
        name = name.removesuffix(end)
    return name.rsplit(".", 1)[-1]


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """JSON (one document or array a file), JSONL or NDJSON, plain or compressed, by suffix. strict raises on a malformed line, else it is dropped."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("multiLine", _suffix(path) == "json").json(path)


def read_records_lenient(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, errors): errors hold the file, line number and first 240 characters of lines that aren't JSON objects.

    Line numbers count a file's lines as Spark reads them, so they need files that
    aren't split: compressed ones, or a large spark.sql.files.maxPartitionBytes.
    """
    from pyspark.sql import Window as W

    lines = spark.read.text(path).withColumn("_m", F.monotonically_increasing_id()).withColumn("file", F.input_file_name())
    numbered = lines.withColumn("line", F.row_number().over(W.partitionBy("file").orderBy("_m"))).filter("trim(value) != ''")
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    parsed = numbered.withColumn("r", F.from_json("value", T.StructType([*kind.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    wrong = F.col("r._bad").isNotNull() | F.col("r").isNull() | ~F.ltrim("value").startswith("{")
    return parsed.filter(~wrong).select(*[F.col(f"r.{f.name}") for f in kind.fields]), parsed.filter(wrong).select("file", "line", F.substring("value", 1, 240).alias("preview"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV table with header (a byte-order mark is dropped) or records, by suffix."""
    if _suffix(path) != "csv":
        return read_records(spark, path, schema)
    reader = spark.read.option("header", True)
    out = (reader.schema(schema) if schema is not None else reader).csv(path)
    return out.toDF(*[c.removeprefix("﻿") for c in out.columns])


def write_jsonl(df: DataFrame, path: str, compression: str | None = None, mode: str = "errorifexists") -> None:
    """Sorted-key JSON lines, null fields kept."""
    df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)]).write.mode(mode).option("ignoreNullFields", "false").option("compression", compression or "none").json(path)


def write_json_doc(df: DataFrame, path: str) -> None:
    """The only row of df as one JSON document that replaces what was there; another number of rows is an error."""
    if len(df.limit(2).collect()) != 1:
        raise ValueError("a document is exactly one row")
    write_jsonl(df.coalesce(1), path, mode="overwrite")


def append_history(df: DataFrame, path: str, pass_id: str) -> None:
    """Append a pass to a history that is partitioned by pass."""
    df.withColumn("pass_id", F.lit(pass_id)).write.mode("append").partitionBy("pass_id").parquet(path)


def convert_records(spark: SparkSession, source: str, target: str, schema: T.StructType | str, compression: str | None = None) -> dict:
    """Transcode record files; returns how many rows were written and how many lines were malformed."""
    good, bad = read_records_lenient(spark, source, schema)
    write_jsonl(good, target, compression)
    return {"rows": spark.read.schema(good.schema).json(target).count(), "malformed": bad.count()}


def json_type(kind: T.DataType, column: Column) -> Column:
    name = {T.StringType: "string", T.BooleanType: "bool", T.ArrayType: "array", T.StructType: "object", T.MapType: "object"}.get(type(kind), "number")
    return F.when(column.isNull(), "null").otherwise(name)


def type_census(df: DataFrame) -> DataFrame:
    """(kind, n): how many values of each JSON type the columns hold."""
    kinds = F.array(*[json_type(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields])
    return df.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...], skip: tuple[str, ...] = (".git", "node_modules"), most_bytes: int = 4 << 20) -> DataFrame:
    """Files of a tree: (path, bytes, suffix, sha256, text); text is null for files over most_bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    end = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    inside = reduce(lambda a, b: a & b, [~F.contains("path", F.lit(f"/{s}/")) for s in skip], F.lit(True))
    rows = files.withColumn("suffix", end).filter(F.col("suffix").isin(*suffixes) & inside)
    return rows.select("path", F.col("length").alias("bytes"), "suffix", F.sha2("content", 256).alias("sha256"), F.when(F.col("length") <= most_bytes, F.decode("content", "utf-8")).alias("text"))


def verify_pinned(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest (path, sha256) with what was found: OK, MISSING or MISMATCH."""
    got = found.select("path", F.col("sha256").alias("found"))
    state = F.when(F.col("found").isNull(), "MISSING").when(F.col("found") != F.col("sha256"), "MISMATCH").otherwise("OK")
    return manifest.join(got, "path", "left").withColumn("state", state)
