"""Weights of edges as a stream against the batch operator, and merges that are replayed or broken off."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from siftline.operators import state
from siftline.streaming import passes

EDGE = "edge_key string, pass_no int, signature string, target double, confidence double"


def _batch(spark, rows, last):
    """calibrate(), pass after pass."""
    known = spark.createDataFrame([], "edge_key string, weight double, seen array<string>, misses int")
    out = set()
    for p in range(1, last + 1):
        own = spark.createDataFrame([(r["edge_key"], r["signature"], r["target"], r["confidence"]) for r in rows if r["pass_no"] == p], "edge_key string, signature string, target double, confidence double")
        found = state.calibrate(own, known, str(p)).collect()
        out |= {(r["edge_key"], p, round(r["weight"], 5), r["movement"], r["observed"], r["fresh"], r["misses"]) for r in found}
        known = spark.createDataFrame([(r["edge_key"], r["weight"], r["seen"], r["misses"]) for r in found], known.schema)
    return out


def test_the_stream_of_weights_is_the_batch(spark, tmp_path):
    rng = random.Random(6)
    last = 7
    rows = [{"edge_key": f"e{i}", "pass_no": p, "signature": f"s{rng.randrange(3)}", "target": rng.choice([0.05, 0.3, 0.9]), "confidence": rng.choice([None, 0.06, 0.5])} for i in range(9) for p in range(1, last + 1) if rng.random() < (0.15 if i < 4 else 0.6) or (p == 1 and i % 2)]
    rows += [{"edge_key": "fades", "pass_no": 1, "signature": "s", "target": 0.05, "confidence": 0.06}]
    folder = tmp_path / "in"
    folder.mkdir()
    stream = passes.calibrate_stream(passes.read_stream(spark, str(folder), EDGE, 1))
    q = stream.writeStream.format("memory").queryName("edge_passes").option("checkpointLocation", str(tmp_path / "c")).start()
    # two passes at once, single ones, and a later one that closes the last
    for n, own in enumerate([(1, 2), (3,), (4,), (5, 6), (7,)]):
        (folder / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows if r["pass_no"] in own))
        q.processAllAvailable()
    (folder / "end.json").write_text(json.dumps({"edge_key": "end", "pass_no": last + 1, "signature": "s", "target": 0.5, "confidence": 0.2}))
    q.processAllAvailable()
    q.stop()
    got = [(r["edge_key"], r["pass_no"], round(r["weight"], 5), r["movement"], r["observed"], r["fresh"], r["misses"]) for r in spark.sql("select * from edge_passes where edge_key != 'end'").collect()]
    assert len(got) == len(set(got))
    assert set(got) == _batch(spark, rows, last)
    assert ("fades", last) in {g[:2] for g in got if g[3] == "DORMANT_CANDIDATE"}


def test_any_batch_may_be_replayed(spark, tmp_path):
    path = str(tmp_path / "corpus")
    schema = "id string, v int"
    batch = lambda ids, v=0: spark.createDataFrame([(i, v) for i in ids], schema)
    merge = passes.merge_into(path, "id", "a")
    merge(batch(["x", "y", "y", None]), 0)
    merge(batch(["y", "z"], 1), 1)
    whole = lambda: sorted((r["id"], r["v"]) for r in passes.read_corpus(spark, path).collect())
    once = [("x", 0), ("y", 0), ("z", 1)]
    assert whole() == once
    for number, ids in ((0, ["x", "y", "y", None]), (1, ["y", "z"]), (0, ["x"])):
        merge(batch(ids, 9), number)
        assert whole() == once
    # a batch that broke off before its log: nobody sees it, and its replay replaces it
    batch(["w", "half"], 5).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/data/batch=a-2")
    assert whole() == once
    merge(batch(["w", "x"], 2), 2)
    assert whole() == sorted([*once, ("w", 2)])
    # another stream counts its own batches; an empty one changes nothing
    passes.merge_into(path, "id", "b")(batch(["x", "v"], 3), 0)
    merge(batch([]), 3)
    assert whole() == sorted([*once, ("w", 2), ("v", 3)])


def test_a_merge_reads_the_buckets_of_its_batch(spark, tmp_path):
    path = str(tmp_path / "corpus")
    passes.merge_into(path, "id")(spark.range(2000).select(F.col("id").cast("string")), 0)
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("7")), F.lit(passes.BUCKETS))).first()[0]
    plan = passes.read_corpus(spark, path).filter(F.col("bucket").isin([bucket])).select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (=|IN)", text)
    assert len({r[0] for r in plan.select(F.input_file_name()).collect()}) <= 1
