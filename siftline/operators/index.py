"""A stored inverted index: postings by buckets of tokens, added to in batches, searched block by block.

Layout under a path: postings/batch=B/bucket=N holds (token, block, id, tf, length)
sorted by token and block; blocks/batch=B/bucket=N holds for each token and block
of documents how many have it, its largest tf and their least length; log/batch=B
holds the batch's counts and is written last.

A search reads the buckets of its own tokens only. BM25 rises with tf and falls
with length, so blocks bounds what a block's documents can score, whatever the
mean length and document frequencies are by now: batches are added without
touching what is there. Blocks hold documents of about one length, which keeps
bounds near.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.search import B, K1, idf, lengths, postings
from siftline.plans.storage import saver

BUCKETS = 16
#: Documents of a block at most, about.
BLOCK = 1024
#: Parts by block in which a bucket is written.
PARTS = 64
#: Blocks that a search with a limit scores first, and by how much that grows.
FIRST, GROWTH = 16, 8
#: So many blocks are named in the scan; more are joined.
NAMED = 1024


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def append(docs: DataFrame, weights: dict[str, float], path: str, batch: str) -> None:
    """Add a batch of documents (id, and the fields of weights) to the index at path, which may be new.

    Ids are unique in the index. Writing a batch again replaces its own folders and
    nothing else, so a replay changes nothing; a batch whose log is missing
    (half-written) isn't read. Documents without a token count for the number of
    documents alone.
    """
    spark = docs.sparkSession
    size = lengths(docs, weights).agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("length") > 0).alias("filled"), F.coalesce(F.sum("length"), F.lit(0)).alias("words"))
    n = docs.count()
    step = F.least(F.floor(F.log2("length")), F.lit(63)).cast("long")
    block = F.pmod(F.xxhash64("id"), F.lit(-(-n // BLOCK) or 1)) * 64 + step
    own = postings(docs, weights).select(bucket_of(F.col("token")).alias("bucket"), "token", block.alias("block"), "id", "tf", "length")
    order = ["bucket", "token", "block"]
    # a token's block has a bounded number of rows; a range would sample, that is cut all texts into words once more
    own.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(PARTS))).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    written = spark.read.schema(own.schema).parquet(f"{path}/postings/batch={batch}")
    bounds = written.groupBy(*order).agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("tf"), F.min("length").alias("length"))
    bounds.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks/batch={batch}")
    size.coalesce(1).write.mode("overwrite").parquet(f"{path}/log/batch={batch}")


class Index:
    """The batches of an index that are logged now."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        log = spark.read.option("recursiveFileLookup", False).schema("docs long, filled long, words long, batch string").parquet(f"{path}/log")
        rows = log.collect()  # a line a batch
        self.batches = sorted(r["batch"] for r in rows)
        self.n = sum(r["docs"] for r in rows)
        self.mean = sum(r["words"] for r in rows) / max(1, sum(r["filled"] for r in rows))

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", False).parquet(f"{self.path}/{name}").withColumn("batch", F.col("batch").cast("string")).filter(F.col("batch").isin(self.batches))

    def postings(self) -> DataFrame:
        """(token, block, id, tf, length, batch, bucket) of all batches."""
        return self._table("postings")

    def blocks(self) -> DataFrame:
        """(token, block, df, tf, length, batch, bucket) of all batches."""
        return self._table("blocks")

    def _asked(self, words: list[str]) -> Column:
        """The condition that reads the buckets of words alone."""
        row = self.spark.range(1).select(F.array(*[bucket_of(F.lit(w)) for w in words]).alias("b")).first()
        return F.col("bucket").isin(sorted(set(row["b"]))) & F.col("token").isin(words)

    def search(self, query: list[str], limit: int | None = None) -> DataFrame:
        """(id, score, matched): documents with any of the query's tokens, as bm25() of search.py scores them.

        With a limit the best ones (ties by id): blocks are scored from the greatest
        bound down until the limit-th score is above all bounds that are left. A
        query without tokens, or with unknown ones alone, finds nothing.
        """
        words = sorted(set(query))
        known = self.blocks().filter(self._asked(words)) if words else self.blocks().filter(F.lit(False))
        df = {r["token"]: r["df"] for r in known.groupBy("token").agg(F.sum("df").alias("df")).collect()}
        weight = F.lit(0.0)
        for w in df:
            weight = F.when(F.col("token") == w, idf(self.n, df[w])).otherwise(weight)
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / self.mean))
        hits = self.postings().filter(self._asked(sorted(df)) if df else F.lit(False))
        scored = lambda rows: rows.groupBy("id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched"))
        if limit is None:
            return scored(hits)
        save = saver(self.spark)
        bounds = save(known.groupBy("batch", "block").agg(F.sum(part).alias("bound")))
        best, above, take = None, math.inf, FIRST
        while True:
            top = bounds.orderBy(F.desc("bound")).limit(take).agg(F.min("bound").alias("cut"), F.count(F.lit(1)).alias("n")).first()
            cut = top["cut"] if top["n"] == take else -math.inf
            chosen = bounds.filter((F.col("bound") >= cut) & (F.col("bound") < above))
            rows = scored(self._of(hits, chosen))
            best = save((rows if best is None else rows.unionByName(best)).orderBy(F.round("score", 9).desc(), "id").limit(limit))
            last = best.agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).first()
            least = last["score"] if last["n"] == limit else -math.inf
            # the slack covers ties of rounded scores and the order of sums
            if cut == -math.inf or bounds.filter((F.col("bound") < cut) & (F.col("bound") >= least - 1e-6)).isEmpty():
                return best
            above, take = cut, take * GROWTH

    def _of(self, hits: DataFrame, chosen: DataFrame) -> DataFrame:
        """The hits of chosen blocks; the names of few are part of the scan."""
        few = chosen.select("batch", "block").limit(NAMED + 1).collect()
        if len(few) > NAMED:
            return hits.join(chosen.select("batch", "block"), ["batch", "block"], "left_semi")
        own: dict[str, list[int]] = {}
        for r in few:
            own.setdefault(r["batch"], []).append(r["block"])
        keep = F.lit(False)
        for batch, blocks in own.items():
            keep = keep | ((F.col("batch") == batch) & F.col("block").isin(blocks))
        return hits.filter(keep)

    def lookup(self, queries: DataFrame) -> DataFrame:
        """(query, id, matched, tf): records that have any of a query's tokens. queries: (query, token); only their buckets are read."""
        own = queries.select("query", "token").distinct().withColumn("bucket", bucket_of(F.col("token")))
        return self.postings().join(own, ["bucket", "token"]).groupBy("query", "id").agg(F.count(F.lit(1)).alias("matched"), F.sum("tf").alias("tf"))
