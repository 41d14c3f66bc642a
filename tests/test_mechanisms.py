"""The stored index, order statistics by ranges, the phrase index, the walk by stretches and triangles, against brute force."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import graph, metrics, phrases, search, sieve
from siftline.operators import index as ix
from siftline.plans.ordered import quantiles, running_sums
from siftline.plans.storage import saver

WEIGHTS = {"title": 3.0, "body": 1.5}


def jobs_of(spark, run):
    """run()'s result and the number of Spark jobs that it took."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# order statistics


def test_running_sums_add_up_across_ranges(spark):
    rows = spark.createDataFrame([(None, 3)] + [(i * 37 % 1009, i % 5) for i in range(1009)], "k int, n int").repartition(7)
    got = {r["k"]: r["before"] for r in running_sums(rows, ["k"], {"before": "n"}).collect()}
    total = 0
    for k, n in sorted(((r["k"], r["n"]) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        assert got[k] == total
        total += n


def test_quantiles_are_numpys(spark):
    rng = random.Random(5)
    groups = {"hot": [rng.choice([0.5, rng.random()]) for _ in range(900)], "one": [3.25], "two": [1.0, 2.0], None: [float(i) for i in range(10)], "tied": [7.0] * 40}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("hot", None), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.05, "mid": 0.5, "high": 0.95, "most": 1.0}
    got = {r["g"]: r for r in quantiles(df, "v", shares, ("g",)).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        assert got[g]["n"] == len(own)
        for name, q in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(own, q), abs=1e-12)
    every = [v for own in groups.values() for v in own]
    assert quantiles(df, "v", {"mid": 0.5}).first()["mid"] == pytest.approx(np.quantile(every, 0.5))
    assert tuple(quantiles(df.filter("v is null"), "v", {"mid": 0.5}).first()) == (0, None)


def test_curves_are_brute_force(spark):
    rng = random.Random(9)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(700)]
    got = metrics.binary_metrics(spark.createDataFrame(rows, "score double, label int").repartition(6)).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert got["auc"] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    steps = [(sum(p == s for p in pos), sum(p >= s for p in pos), sum(x >= s for x, _ in rows)) for s in {s for s, _ in rows}]
    assert got["average_precision"] == pytest.approx(sum(own * tp / seen for own, tp, seen in steps) / len(pos))


# the stored index


def _docs(n: int, start: int = 0, seed: int = 1):
    rng = random.Random(seed + start)
    words = [f"w{i}" for i in range(40)]
    own = lambda most: " ".join(words[min(39, int(rng.expovariate(0.15)))] for _ in range(rng.randrange(most)))
    return [(start + i, own(5), own(60 if i % 7 else 400)) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, body string")


def _brute_bm25(rows, query):
    tf, length = defaultdict(Counter), {}
    for i, title, body in rows:
        t, b = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (title, body))
        length[i] = len(t) + len(b)
        for word, w in [(x, 3.0) for x in t] + [(x, 1.5) for x in b]:
            tf[i][word] += w
    mean = np.mean([v for v in length.values() if v])
    df = {q: sum(q in tf[i] for i in tf) for q in set(query)}
    idf = {q: max(math.log((len(rows) - d + 0.5) / (d + 0.5)), 1e-6) for q, d in df.items() if d}
    return {i: sum(idf[q] * own[q] * 2.2 / (own[q] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for q in idf if q in own) for i, own in tf.items() if any(q in own for q in idf)}


@pytest.fixture(scope="module")
def stored_index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = _docs(1500) + [(9000, None, None), (9001, "", "")]
    ix.append(_frame(spark, rows[:1000]), WEIGHTS, path, "1")
    ix.append(_frame(spark, rows[1000:]), WEIGHTS, path, "2")
    return path, rows


@pytest.mark.parametrize("query", [["w0", "w3"], ["w30"], ["w38", "w1", "w1", "unknown"], ["unknown"], []])
def test_index_scores_as_brute_force(spark, stored_index, query):
    path, rows = stored_index
    want = _brute_bm25(rows, query)
    got = {r["id"]: r["score"] for r in ix.Index(spark, path).search(query).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    best = sorted(want, key=lambda i: (-round(want[i], 9), i))[:10]
    assert [r["id"] for r in ix.Index(spark, path).search(query, 10).orderBy(F.round("score", 9).desc(), "id").collect()] == best


def test_a_search_reads_its_own_buckets(spark, stored_index):
    path, _ = stored_index
    found = ix.Index(spark, path).search(["w3"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(ix.bucket_of(F.lit("w3"))).first()[0]
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ = {bucket}\b|PartitionFilters: \[[^\]]*bucket#\d+ IN \({bucket}\)", plan)
    assert "PushedFilters: [" in plan and "token" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_a_limit_skips_blocks(spark, tmp_path):
    # one short document in a thousand has the word often; a third of the others, which are long, have it once
    rows = [(i, "", "needle " * 9 if i % 1000 == 0 else "needle " * (i % 3 == 0) + "hay " * (100 + i % 400)) for i in range(4000)]
    ix.append(_frame(spark, rows), WEIGHTS, str(tmp_path), "1")
    own = ix.Index(spark, str(tmp_path))
    taken = []
    of = own._of
    own._of = lambda hits, chosen: taken.append(chosen.count()) or of(hits, chosen)
    ix_first, ix.FIRST = ix.FIRST, 2
    try:
        best = [r["id"] for r in own.search(["needle"], 4).orderBy("id").collect()]
    finally:
        ix.FIRST = ix_first
    assert best == [0, 1000, 2000, 3000]
    assert sum(taken) < own.blocks().select("batch", "block").distinct().count()


def test_batches_are_added_and_replayed_without_a_rewrite(spark, tmp_path):
    path, rows = str(tmp_path), _docs(300)
    ix.append(_frame(spark, rows[:200]), WEIGHTS, path, "1")
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("batch=1/**/*.parquet")}
    ix.append(_frame(spark, rows[200:]), WEIGHTS, path, "2")
    assert files and all(p.stat().st_mtime_ns == t for p, t in files.items())
    once = sorted(map(tuple, ix.Index(spark, path).search(["w2", "w9"]).collect()))
    ix.append(_frame(spark, rows[200:]), WEIGHTS, path, "2")
    assert sorted(map(tuple, ix.Index(spark, path).search(["w2", "w9"]).collect())) == once
    # a batch without its log is half-written: nobody reads it
    ix.append(_frame(spark, _docs(50, 5000)), WEIGHTS, path, "3")
    for p in sorted((tmp_path / "log" / "batch=3").rglob("*"), reverse=True):
        p.unlink()
    (tmp_path / "log" / "batch=3").rmdir()
    assert sorted(map(tuple, ix.Index(spark, path).search(["w2", "w9"]).collect())) == once


def test_lookup_is_the_search_join(spark, stored_index):
    path, rows = stored_index
    asked = spark.createDataFrame([("a", "w1"), ("a", "w5"), ("a", "w5"), ("b", "w39"), ("c", "none")], "query string, token string")
    got = sorted(map(tuple, ix.Index(spark, path).lookup(asked).collect()))
    assert got == sorted(map(tuple, search.search_join(search.postings(_frame(spark, rows), WEIGHTS), asked).collect())) and got


# phrases


def _spaced(words):
    return " ".join(words)


def test_phrases_are_found_as_by_regular_expressions(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "ab", "abc", "ca", "bca", "xab"])
    texts = [_spaced(word() for _ in range(rng.randrange(0, 30))) for _ in range(60)] + ["", "a a a a a"]
    aliases = sorted({(f"f{rng.randrange(3)}", _spaced(word() for _ in range(rng.randrange(1, 4)))) for _ in range(40)} | {("f0", "a a"), ("f1", "A-a"), ("f1", "!!")})
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)] + [(99, 0, None)], "id long, chunk_index int, chunk string")
    norm = lambda s: _spaced(re.findall("[a-z0-9]+", s.lower()))
    want = {(i, f, a, n) for i, t in enumerate(texts) for f, a in aliases if norm(a) and (n := len(re.findall(rf"(?<![a-z0-9]){norm(a)}(?![a-z0-9])", t)))}
    assert {(r["id"], r["family"], r["alias"], r["n"]) for r in sieve.family_hits(chunks, aliases).collect()} == want
    lex = spark.createDataFrame(aliases, "family string, alias string")
    inside = phrases.substrings(chunks.select("id", F.split(F.coalesce("chunk", F.lit("")), " ").alias("w")), lex).select("id", "family", "alias").distinct()
    assert {tuple(r) for r in inside.collect()} == {(i, f, a) for i, t in enumerate(texts) for f, a in aliases if norm(a) and norm(a) in t}


def test_a_lexicon_may_be_large_or_empty(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "x word7 word8 y word9999")], "id long, chunk_index int, chunk string")
    lex = spark.createDataFrame([(f"f{i % 9}", f"word{i} word{i + 1}") for i in range(10_000)] + [("z", "word9999")], "family string, alias string").cache()
    lex.count()
    began = time.time()
    found = sieve.family_hits(rows, lex)
    found._jdf.queryExecution().executedPlan()
    assert time.time() - began < 5 and len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    want = {("f7", "word7 word8"), ("z", "word9999")}
    assert {(r["family"], r["alias"]) for r in found.collect()} == want
    monkeypatch.setattr(phrases, "MOST", 10)  # joined by shuffle then
    assert {(r["family"], r["alias"]) for r in sieve.family_hits(rows, lex).collect()} == want
    assert sieve.family_hits(rows, []).count() == 0


def test_hits_mark_their_neighbours(spark):
    chunks = spark.createDataFrame([(d, i, "hit" if (d, i) in {(1, 0), (1, 4), (2, 2), (2, 3)} else "no") for d in (1, 2, 3) for i in range(6)], "id long, chunk_index int, chunk string")
    got = {(r["id"], r["chunk_index"]): (r["direct"], r["near"]) for r in sieve.retain(chunks, [("f", "hit")], 2).collect()}
    assert got == {(1, 0): (True, []), (1, 1): (False, [0]), (1, 2): (False, [0, 4]), (1, 3): (False, [4]), (1, 4): (True, []), (1, 5): (False, [4]), (2, 0): (False, [2]), (2, 1): (False, [2, 3]), (2, 2): (True, [3]), (2, 3): (True, [2]), (2, 4): (False, [2, 3]), (2, 5): (False, [3])}


# the walk in order


def _walk(n, pairs):
    near, of = defaultdict(set), {}
    for a, b in pairs:
        near[max(a, b)].add(min(a, b))
    for i in range(n):
        of[i] = min((a for a in near[i] if of[a] is None), default=None)
    return of


@pytest.mark.parametrize("seed,stretch", [(1, 4), (2, 7), (3, 1), (4, 4096)])
def test_the_walk_by_stretches_is_the_walk(spark, seed, stretch):
    rng = random.Random(seed)
    n = 90
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(110)} | {(i, i + 1) for i in range(40, 70)} | {(b, a) for a, b in [(1, 2), (5, 9)]}
    df = spark.createDataFrame(sorted(pairs), "a long, b long")
    got = {r["ord"]: r["duplicate_of"] for r in sieve.near_duplicates(spark.range(n).withColumnRenamed("id", "ord"), df, saver(spark), stretch).collect()}
    assert got == _walk(n, [p for p in pairs if p[0] < p[1]])


def test_a_chain_of_ten_thousand_takes_few_jobs(spark):
    n = 10_000
    chain = saver(spark)(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    rows = spark.range(n).withColumnRenamed("id", "ord")
    found, jobs = jobs_of(spark, lambda: {r["ord"]: r["duplicate_of"] for r in sieve.near_duplicates(rows, chain, saver(spark)).collect()})
    assert found == {i: (i - 1 if i % 2 else None) for i in range(n)}
    few, jobs_far = jobs_of(spark, lambda: sieve.near_duplicates(rows, chain, saver(spark), stretch=100).filter("duplicate_of is not null").count())
    assert few == n // 2
    assert jobs < 20 and jobs_far < 120  # a hundred stretches


# triangles


def test_support_is_brute_force(spark):
    rng = random.Random(8)
    edges = {tuple(sorted(rng.sample("abcdefghijkl", 2))) for _ in range(34)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    part = {x: 1 / max(1, math.log2(2 + len(v))) for x, v in near.items()}
    rows = [(a, b) for a, b in edges] + [(b, a) for a, b in list(edges)[:9]] + [("a", "a"), ("", "b")]
    got = {(r["a"], r["b"]): r["support"] for r in graph.topology_support(spark.createDataFrame(rows, "source string, target string")).collect()}
    assert got == {(a, b): pytest.approx(min(1, sum(part[x] for x in near[a] & near[b]) / 3)) for a, b in edges}


def test_a_star_pairs_nobody_up(spark):
    star = spark.range(1, 50_001).select(F.lit("hub").alias("a"), F.format_string("leaf%06d", "id").alias("b"))
    closed = spark.createDataFrame([("leaf000001", "leaf000002")], "a string, b string")
    pairs = star.unionByName(closed)
    got = graph.triangles(pairs).select("u", "v", "w", "dw").collect()
    assert [tuple(r) for r in got] == [("leaf000001", "leaf000002", "hub", 50_000)]
    # no end has more edges going out than the square root of twice their number
    degree = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).groupBy("x").count()
    both = pairs.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    out = both.select(F.when(F.struct("da", "a") < F.struct("db", "b"), F.col("a")).otherwise(F.col("b")).alias("u")).groupBy("u").count()
    assert out.agg(F.max("count")).first()[0] == 2


def test_pairs_of_documents_are_made_of_numbers_and_spread(spark, sf_dir):
    from siftline import catalog
    from siftline.plans.pairs import pairs_within

    plan = catalog.queries()["shared_entity_pairs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "round(" not in plan
    rows = spark.range(3000).selectExpr("'k' AS k", "id")
    out = pairs_within(rows, ["k"], "id", 250)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.count() == 3000 * 2999 // 2


def test_weights_of_joined_and_of_broadcast_tokens(spark, tmp_path, monkeypatch):
    from siftline.operators import tfidf

    rng = random.Random(5)
    texts = [[f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(0, 40))] for _ in range(60)] + [None, [None, "w1"]]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, words array<string>").repartition(3)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    counts = {i: Counter(w for w in t or [] if w is not None) for i, t in rows}
    often = Counter(w for c in counts.values() for w in c)
    for frequent, least in ((1 << 20, 1), (40, 1), (40, 2), (1, 3)):  # none, some or all tokens are joined
        monkeypatch.setattr(tfidf, "FREQUENT", frequent)
        want = {}
        for i, c in counts.items():
            raw = {w: k / len(texts[i]) * (math.log((1 + len(rows)) / (1 + often[w])) + 1) for w, k in c.items() if often[w] >= least}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            want |= {(i, w): x / norm for w, x in raw.items()}
        out = tfidf.vectors(df, F.col("words"), n, least)
        assert {(r.id, r.token): r.weight for r in tfidf.weights(out).collect()} == pytest.approx(want)
        long = tfidf.salient(tfidf.weights(out)).select("id", "rank", "token", "weight").collect()
        assert sorted(map(tuple, tfidf.salient_of(out).select("id", "rank", "token", "weight").collect())) == sorted(map(tuple, long))
    assert tfidf.vectors(df.limit(0), F.col("words"), n).count() == 0


def test_weights_move_each_document_once(spark, sf_dir):
    from siftline import catalog

    for name in ("tfidf", "tfidf_min_df2", "salient_keywords"):
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "MapInArrow" in plan, name
