"""Record and edge streams: search, latest versions, corpus merges, and weights as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from siftline.operators import state as Z
from siftline.operators.search import needles

EDGE = "edge_key string, pass_no int, weight double, previous_weight double, delta double, movement string, observed boolean, fresh boolean, misses int, passes long"
_STATE = "weight double, seen array<string>, misses int, passes long, last int"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Event time between two passes, in milliseconds: a pass is a number, its time is that many steps.
STEP = 60_000
#: Buckets of a corpus's keys.
BUCKETS = 64


def read_stream(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 16) -> DataFrame:
    """JSON lines that arrive in a folder; malformed lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_trigger).json(folder)


def search_stream(stream: DataFrame, **how) -> DataFrame:
    """Rows of a stream that match needles(); it keeps no state."""
    return needles(stream, **how)


def latest(stream: DataFrame, key: str, updated: str, delay: str, columns: list[str]) -> DataFrame:
    """The row with the greatest event time per key, in update mode. Keys stay in state; rows later than the delay are dropped."""
    return stream.withWatermark(updated, delay).groupBy(key).agg(F.max_by(F.struct(*columns), updated).alias("row"), F.max(updated).alias(updated)).select(key, updated, *[F.col(f"row.{c}").alias(c) for c in columns])


class EdgeWeights(StatefulProcessor):
    """An edge's weight over passes. Observations move it to their target; a pass that ends without one is an event too, told by a timer: the weight decays and misses add up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("edge", _STATE)

    def _load(self) -> list:
        if not self.state.exists():
            return [None, [], 0, 0, None]
        weight, seen, misses, passes, last = self.state.get()
        return [weight, list(seen), misses, passes, last]

    def _row(self, number: int, old: float, new: float, move: str, observed: bool, fresh: bool, own: list) -> tuple:
        own[0] = round(new, 6)
        return (number, own[0], round(old, 6), round(new - old, 6), move, observed, fresh, own[2], own[3])

    def _absent(self, own: list, until: int) -> Iterator[tuple]:
        """The passes before until that ended without the edge."""
        while own[4] + 1 < until:
            own[4] += 1
            old = own[0]
            new = old * Z.ABSENT
            own[2] += 1
            move = "DORMANT_CANDIDATE" if own[2] >= 4 and new < 0.08 else "WEAKENED_NOT_REOBSERVED" if new < old else "STABLE"
            yield self._row(own[4], old, new, move, False, False, own)

    def _observed(self, own: list, number: int, signature: str, target: float, confidence: float | None) -> tuple:
        known = confidence if confidence is not None and confidence == confidence else 0.2
        old = own[0] if own[0] is not None else known
        fresh = signature not in own[1]
        new = old + (Z.FRESH if fresh else Z.REPLAY) * (target - old)
        own[1:4] = sorted({*own[1], signature})[-64:], 0, own[3] + 1
        own[4] = number
        move = "STRENGTHENED" if new - old > 0.015 else "WEAKENED" if new - old < -0.015 else "STABLE"
        return self._row(number, old, new, move, True, fresh, own)

    def _kept(self, key: tuple, own: list, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((own[4] + 1) * STEP + 1)
        self.state.update(tuple(own))
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in EDGE.split(", ")][1:])
        frame.insert(0, "edge_key", key[0])
        yield frame

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own, out = self._load(), []
        for r in pd.concat(list(rows)).sort_values(["pass_no", "signature"]).itertuples():
            if own[4] is not None:
                out += self._absent(own, r.pass_no)
            out.append(self._observed(own, r.pass_no, r.signature, r.target, r.confidence))
        yield from self._kept(key, own, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = self._load()
        # passes whose time the watermark has passed are over
        over = -(-timerValues.getCurrentWatermarkInMs() // STEP)
        yield from self._kept(key, own, list(self._absent(own, over)))

    def close(self) -> None:
        pass


def calibrate_stream(edges: DataFrame) -> DataFrame:
    """A row for every edge and pass, observed or not, from (edge_key, pass_no, signature, target, confidence): what calibrate() gives pass by pass.

    A pass's number is its event time. It is over once a row of a later pass has
    come; edges it didn't hold decay then, count a miss, and after four under 0.08
    are dormant candidates. Rows of a pass that is over are late and dropped. Several
    rows of an edge in one pass are taken in order of signature. State is kept in
    RocksDB, a row and a timer for each edge.
    """
    edges.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    timed = edges.withColumn("at", F.timestamp_millis(F.col("pass_no").cast("long") * STEP)).withWatermark("at", "0 seconds")
    return timed.groupBy("edge_key").transformWithStateInPandas(statefulProcessor=EdgeWeights(), outputStructType=EDGE, outputMode="Append", timeMode="EventTime")


def _log(spark: SparkSession, path: str) -> list[str]:
    """The batches of a corpus that are whole."""
    try:
        rows = spark.read.schema("records long, batch string").parquet(f"{path}/log").select("batch").collect()  # a line a batch
    except Exception as e:  # nothing is there before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return sorted(r["batch"] for r in rows)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The records of a corpus that merge_into() writes, with their batch and bucket; half-written batches aren't seen."""
    rows = spark.read.parquet(f"{path}/data")
    return rows.withColumn("batch", F.col("batch").cast("string")).filter(F.col("batch").isin(_log(spark, path)))


def merge_into(path: str, key: str, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends records whose key the corpus at path doesn't have, the first of each key.

    Records lie in buckets of their key's hash, and a batch reads the keys of its own
    buckets alone. A batch's records are written under its own name and its line in
    the log last: a batch that is in the log is passed over, one that isn't is
    written anew over what it left, so a replay of any batch changes nothing. stream
    names the stream, whose batch numbers are its own; null keys are never records.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = f"{stream}-{number}"
        known = _log(spark, path)
        if name in known:
            return
        new = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int"))
        new = new.persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
            if known and touched:
                old = read_corpus(spark, path).filter(F.col("bucket").isin(touched)).select("bucket", key)
                fresh = new.join(old, ["bucket", key], "left_anti")
            else:
                fresh = new
            own = f"{path}/data/batch={name}"
            fresh.select(*batch.columns, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(own)
            count = spark.read.schema(batch.schema).parquet(own).count()
            spark.range(1).select(F.lit(count).cast("long").alias("records")).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch={name}")
        finally:
            new.unpersist()

    return merge
