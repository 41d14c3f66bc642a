"""Where intermediate tables live and how per-partition Python reads them."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder inside the one that spark.checkpoint.dir names; it is removed when the driver ends.

    Where none is named a local session (as in tests) takes a temporary one; a
    cluster, whose executors don't share such a folder, gets an error instead.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="siftline-")
        _FOLDERS[app] = f"{named.rstrip('/')}/siftline-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: what it left stays for the cluster to clear
        pass


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.stored_at)


def fresh(name: str) -> str:
    """A column name that no given table has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell rows apart by id and text; two hashes of both."""
    a, b = F.col(id_col).cast("string"), F.col(text_col)
    return [F.xxhash64(F.lit(1), a, F.lit("/"), b), F.xxhash64(b, F.lit(2), a)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, n: int):
    """crc32 of an id as text, modulo n: how the contracts cut folds. A null id falls in fold 0."""
    return F.pmod(F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(0)), F.lit(n))


#: A key is hot if it has more than one in so many rows, so fewer than HOT keys are.
HOT = 1000


def hot_join(rows: DataFrame, found: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """rows with found's columns (one row a key; copies: how many rows have it), null where the key isn't there.

    Rows of hot keys, of which there are fewer than HOT, take theirs from a
    broadcast and are spread over all tasks of the shuffle that the others need.
    """
    total = found.agg(F.sum(copies)).first()[0] or 0
    hot, cold, spread = fresh("hot"), fresh("cold"), fresh("spread")
    values = [c for c in found.columns if c not in (*keys, copies)]
    rows_ = rows.join(F.broadcast(found.filter(F.col(copies) * HOT > total).select(*keys, F.struct(*values).alias(hot))), keys, "left")
    rows_ = rows_.withColumn(spread, F.when(F.col(hot).isNull(), -1).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(4096))).cast("int"))
    other = found.filter(F.col(copies) * HOT <= total).select(*keys, F.struct(*values).alias(cold), F.lit(-1).alias(spread))
    both = F.coalesce(F.col(hot), F.col(cold))
    return rows_.join(other, [*keys, spread], "left").select(*rows.columns, *[both.getField(v).alias(v) for v in values])


#: Bits of a table of hashes, whatever they are hashes of.
BITS = 1 << 24


def maybe_among(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """The rows whose 64-bit hash col may be among those of keys. None is lost; how many others go depends on how full a table of BITS bits, which is broadcast, is."""
    slot = F.pmod(F.col(col), F.lit(BITS)) + 1
    bucket, bits = fresh("bucket"), fresh("bits")
    table_ = keys.groupBy(F.bitmap_bucket_number(slot).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias(bits))
    own = rows.withColumn(bucket, F.bitmap_bucket_number(slot)).join(F.broadcast(table_), bucket)
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return own.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


#: Rows that Python code works on at once; an Arrow batch may hold more.
ROWS = 512


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def by_batch(fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], rows: int = ROWS) -> Callable:
    """mapInArrow function that applies fn to batches of at most that many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows):
            yield from fn(batch)

    return run


def returning(fn: Callable) -> Callable:
    """fn of a partition's batches, after which its Python worker, which is kept for later tasks, gives freed memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError, TypeError):  # a C library that has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of a partition that is sorted by the integer column key, one table at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), n]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            k = keys[lo]
            if held and k != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = k
    if held:
        yield pa.Table.from_batches(held)


def widened(schema: T.StructType, **more: str) -> T.StructType:
    """schema with further columns at its end, by name and type (long, string, double, integer, boolean, binary)."""
    return T.StructType([*schema.fields, *(T.StructField(k, getattr(T, f"{v.capitalize()}Type")()) for k, v in more.items())])
