"""Bounds on what a driver, a task or a shuffle holds."""

from __future__ import annotations

import subprocess
import sys
from fractions import Fraction

import numpy as np
import pyarrow as pa

from siftline.llm import setjoin


def test_queries_load_neither_pandas_nor_ml():
    out = subprocess.run([sys.executable, "-c", "import sys, __spark_entry__ as e; e.queries(); print([m for m in ('pandas', 'pyspark.ml') if m in sys.modules])"], capture_output=True, text=True, check=True)
    assert out.stdout.strip().splitlines()[-1] == "[]"


def test_sets_are_handed_over_in_small_batches():
    rows = ((4 << 20, (i,)) for i in range(32))
    assert [b.num_rows for b in setjoin._flushed(rows, {"n": pa.int64()})] == [5, 5, 5, 5, 5, 5, 2]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_where_they_are(spark, sf_dir):
    from siftline import catalog
    from siftline.operators.search import postings

    docs = spark.createDataFrame([(1, "b a b", "c a"), (2, None, ""), (3, "", "z z z")], "id long, title string, text string")
    found = postings(docs, {"title": 3.0, "text": 1.5})
    assert "Exchange" not in _plan(found) and "Exchange" not in _plan(catalog.queries()["tokens"](spark, sf_dir))
    assert {tuple(r) for r in found.select("id", "token", "tf", "length").collect()} == {(1, "a", 4.5, 5), (1, "b", 6.0, 5), (1, "c", 1.5, 5), (3, "z", 4.5, 3)}
    assert {tuple(r) for r in postings(docs, {"title": 3.0, "text": 1.5}, ["c", "z"]).select("id", "token", "tf", "length").collect()} == {(1, "c", 1.5, 5), (3, "z", 4.5, 3)}


def test_few_aliases_take_no_row_for_each_word(spark, monkeypatch):
    from siftline.operators import bridges

    rows = spark.createDataFrame([(1, "the end", "clowns and the Idiot"), (2, "a licen", "se x"), (3, None, "the  license, the and")], "id long, title string, body string")
    aliases = spark.createDataFrame([("insult", "idiot"), ("insult", "clown"), ("legal", "license"), ("legal", "licen se"), ("place", "the and"), ("none", "!")], "family string, alias string")
    context = {"insult": ["the"]}
    few = [bridges.match_substring(rows, aliases), bridges.match_strict(rows, aliases, context, "place")]
    assert all("posexplode" not in _plan(x) for x in few)
    got = [sorted(map(tuple, x.collect())) for x in few]
    monkeypatch.setattr(bridges, "FEW", 0)
    many = [bridges.match_substring(rows, aliases), bridges.match_strict(rows, aliases, context, "place")]
    assert got == [sorted(map(tuple, x.collect())) for x in many] and len(got[0]) == 3 and len(got[1]) == 3


def test_best_seeds_are_those_of_all_pairs(spark, monkeypatch):
    import random

    from siftline.operators import pull as P

    rng = random.Random(5)
    docs = [(i, i, f"p{i % 3}" if i % 7 else None, f"u{i}", f"u{i - 3}" if i % 10 == 3 else None) for i in range(60)]
    r = spark.createDataFrame(docs, "id long, ord long, provider string, source_url string, parent_url string")
    vectors = spark.createDataFrame([(i, t, rng.choice([0.25, 0.5])) for i in range(55) for t in rng.sample("abcdefghijklmnop", 3)], "id long, token string, weight double")
    tags = spark.createDataFrame([(i, t, {"x": 0.0, "y": 0.15, "z": 0.9}[t]) for i in range(0, 60, 2) for t in rng.sample("xyz", 2)], "id long, tag string, weight double")
    dates = spark.createDataFrame([(i, str(1990 + i % 4)) for i in range(0, 60, 5)], "id long, date string")
    seeds, cands = r.filter("id % 10 = 0"), r.filter("id % 10 != 0")
    args = (cands, seeds, vectors, tags, dates, P.explicit_links(cands, seeds))
    names = ["cid", "sid", "seed_ord", "score", "sem", "tag", "date", "explicit", "structural"]
    show = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in df.select(*names).collect())
    want = show(P.best_seed(P.score_pairs(*args)))
    for size in (4096, 7):
        monkeypatch.setattr(P, "VECTORS", size)
        pairs = P.best_pairs(*args)
        assert show(P.best_seed(pairs)) == want and pairs.count() < P.score_pairs(*args).count()
    assert any(row[7] for row in want)


def test_openalex_texts_stay_where_they_are(spark, sf_dir):
    from siftline import catalog

    assert "Exchange" not in _plan(catalog.queries()["normalize_openalex"](spark, sf_dir))


def test_links_of_a_batch_take_one_round(spark, monkeypatch):
    written = []
    stored = setjoin.stored
    monkeypatch.setattr(setjoin, "stored", lambda df, name: written.append(name) or stored(df, name))
    chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b").coalesce(1)
    got = setjoin.components(chain)
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(1, 301)}
    assert len(written) <= 4  # eleven by stars alone


def test_pairs_of_lists_come_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(setjoin, "ENTRIES", 1 << 10)
    n = 32 * 30
    rows = pa.record_batch({"gram": pa.array(np.repeat(np.arange(30), 32)), "nid": pa.array(np.arange(n)), "n": pa.array(np.full(n, 50, np.int32)), "pos": pa.array(np.zeros(n, np.int32))})
    got = list(setjoin._list_pairs(Fraction(9, 10))(iter([rows])))
    assert sum(b.num_rows for b in got) == 30 * 32 * 31 // 2
    assert max(b.num_rows for b in got) <= (1 << 10) + 64 * 30


def test_chunks_are_compared_from_few_postings(spark, monkeypatch):
    from siftline.operators import sieve as C

    kept = {}
    written = C.written
    monkeypatch.setattr(C, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    rows = [(i, [f"s{i}_{j}" for j in range(100)]) for i in range(40)] + [(i, [f"c{j}" for j in range(100)]) for i in range(40, 60)] + [(60, [f"c{j}" for j in range(99)])]
    got = {tuple(r) for r in C.similar_pairs(spark.createDataFrame(rows, "ord long, shingles array<string>"), 0.88).collect()}
    assert got == {(a, b) for a in range(40, 61) for b in range(a + 1, 61)}
    # beginnings of 42 sets, twenty copies being one; no posting of all shingles is dealt out
    assert kept["heads"].count() <= 42 * 14 and kept["met"].count() <= 2 * 14


def test_origins_read_no_text(spark, sf_dir):
    from siftline import catalog

    assert "text" not in _plan(catalog.queries()["context_merge"](spark, sf_dir)).split("ReadSchema: ")[1].split("\n")[0]
    assert "regexp_extract" not in _plan(catalog.queries()["context_merge"](spark, sf_dir))


def test_contained_sets_are_compared_where_they_meet(spark, monkeypatch):
    import random

    from siftline.operators import tfidf as V

    rng = random.Random(3)
    own = {k: set(rng.sample(range(40), rng.choice([1, 2, 3, 5, 25]))) for k in range(80)}
    want = {(a, b) for a in own for b in own if a != b and own[a] <= own[b]}
    rows = lambda sets: spark.createDataFrame([(k, e) for k, x in sets.items() for e in x], "k long, e long")
    assert {tuple(r) for r in V.contained_sets(rows(own)).collect()} == want
    few = {k: x for k, x in own.items() if len(x) <= V.SMALL}
    made = V.contained_sets(rows(few))
    # elements are compared in the join where the two meet
    join = next(x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert "array_except" in join and "sig" in join
    assert {tuple(r) for r in made.collect()} == {(a, b) for a, b in want if a in few and b in few}


def test_similarity_takes_matrices_not_vectors_one_by_one(spark, monkeypatch):
    import random

    from siftline.operators import similar as S

    rng = random.Random(11)
    own = {i: {t: rng.random() for t in {0, 1, *(min(59, int(rng.expovariate(0.1))) for _ in range(rng.randrange(1, 20)))}} for i in range(60)}
    dot = lambda a, b: sum(w * own[b].get(t, 0) for t, w in own[a].items())

    def block(ids):
        lists = pa.array([[*own[i]] for i in ids], pa.list_(pa.int64())), pa.array([[*own[i].values()] for i in ids], pa.list_(pa.float64()))
        return S.Postings(len(ids), *S.postings(*lists))

    for shared, cells in ((1, 1 << 20), (8, 100), (1 << 20, 1)):
        monkeypatch.setattr(S, "SHARED", shared)
        monkeypatch.setattr(S, "CELLS", cells)
        monkeypatch.setattr(S, "PRODUCTS", 7 if shared == 1 else 1 << 16)
        got = np.concatenate([m for _, _, m in S.products(block(range(40)), block(range(25, 60)))])
        assert np.allclose(got, [[dot(a, b) for b in range(25, 60)] for a in range(40)])
    monkeypatch.setattr(S, "VECTORS", 9)
    rows = spark.createDataFrame([(i, [(str(t), w) for t, w in v.items()]) for i, v in own.items()], "id long, vector array<struct<token: string, weight: double>>")
    from siftline.operators import tfidf as V

    few = V.cosine_pairs(rows, 0.5, 3)
    # one task meets some blocks alone, so it gives up to three for each
    assert few.count() < V.cosine_pairs(rows, 0.5).count()
    want = {(a, b) for a in own for b in sorted((b for b in own if b > a and dot(a, b) >= 0.5), key=lambda b: (-round(dot(a, b), 9), -b))[:3]}
    assert {(r.a, r.b) for r in V.semantic_topk(few, 3).collect()} == want


def test_rounds_of_a_pull_gather_words_once(spark, monkeypatch):
    from siftline.operators import pull as P
    from siftline.plans.storage import saver

    made = []
    profiles = P.profiles
    monkeypatch.setattr(P, "profiles", lambda *a: made.append(1) or profiles(*a))
    docs = spark.createDataFrame([(i, i, "p", f"u{i}", f"u{i - 1}" if i else None) for i in range(5)], "id long, ord long, provider string, source_url string, parent_url string")
    none = lambda kind: spark.createDataFrame([], kind)
    args = none("id long, token string, weight double"), none("id long, tag string, weight double"), none("id long, date string")
    got = P.selective_pull(docs.filter("id = 0"), docs.filter("id > 0"), *args, saver(spark), rounds=3)
    assert {(r.id, r.round, r.connected_to) for r in got.collect()} == {(1, 1, 0), (2, 2, 1), (3, 3, 2)}
    assert len(made) == 1


def test_words_of_vectors_are_counted_in_the_task(spark, sf_dir):
    from pyspark.sql import functions as F

    from siftline.functions import text as T
    from siftline.operators import tfidf as V
    from siftline.queries import mining

    texts = [(1, "The Quantum-Gravity report of 1999 ab Straße Привет 12345 1999"), (2, None), (3, ""), (4, "ЁЖИК ёжик İstanbul a.b.c 1.5e+3 x\ny zz\x85zzz Kelvin Kelvin KELVIN"), (5, "12 345 the")]
    df = spark.createDataFrame(texts, "id int, text string")
    for stop, digits in ((T.STOP, False), (T.STOP_V1, True)):
        count = T.word_counter(stop, digits)
        for r in df.select("text", T.tokens(F.col("text"), stop, digits).alias("w")).collect():
            if r.text is not None:
                own = count(r.text)
                assert sum(own.values()) == len(r.w) and all(own[w] == r.w.count(w) for w in r.w)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    show = lambda v: {(r.id, r.token, round(r.weight, 12)) for r in V.weights(v).collect()}
    assert show(V.vectors(df, F.col("text"), n, count=T.word_counter())) == show(V.vectors(df, T.tokens(F.col("text")), n))
    assert "regexp_extract_all" not in _plan(mining.packed_vectors(spark, sf_dir))


def test_few_sets_are_sent_to_be_compared(spark, monkeypatch):
    import random

    from siftline.operators import sieve as C

    kept = {}
    written = C.written
    monkeypatch.setattr(C, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    rng = random.Random(4)
    base = [f"c{j}" for j in range(200)]
    # a few texts are alike, the others share some shingles with each
    rows = [(i, base[i:] + [f"s{i}"]) for i in range(8)] + [(i, rng.sample([f"o{j}" for j in range(1000)], 200)) for i in range(8, 40)] + [(40, ["x"] * 9), (41, ["x"])]
    rows += [(i, [f"y{j}" for j in range(30_000)] + [f"z{i}"]) for i in (42, 43)]
    sets = {k: set(v) for k, v in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = {tuple(r) for r in C.similar_pairs(spark.createDataFrame(rows, "ord long, shingles array<string>"), 0.6).collect()}
    assert got == want and (42, 43) in want
    assert kept["near"].count() < kept["pairs"].count() / 2


def test_chunks_without_a_mark_stay_where_they_are(spark):
    from siftline.operators import sieve as C

    chunks = spark.createDataFrame([(d, i, "the license" if (d, i) == (3, 4) else "plain words") for d in range(20) for i in range(10)], "id long, chunk_index int, chunk string")
    kept = C.retain(chunks, [("legal", "license")])
    assert {(r.id, r.chunk_index, r.direct) for r in kept.collect()} == {(3, 3, False), (3, 4, True), (3, 5, False)}
    assert "bitmap" in _plan(kept)


def test_seeds_of_many_tasks_make_few_blocks(spark, monkeypatch):
    from siftline.operators import pull as P

    kept = {}
    written = P.written
    monkeypatch.setattr(P, "written", lambda df, name, rows=0: kept.setdefault(name, written(df, name, rows)))
    docs = spark.range(0, 400, 1, 16).selectExpr("id", "id AS ord", "'p' AS provider", "'u' || id AS source_url", "CAST(NULL AS string) AS parent_url")
    words = spark.range(400).selectExpr("id", "array(named_struct('token', 't' || id DIV 10 % 20, 'weight', 1.0D)) AS vector")
    none = lambda kind: spark.createDataFrame([], kind)
    seeds, cands = docs.filter("id % 10 = 0"), docs.filter("id % 10 != 0")
    pairs = P.best_pairs(cands, seeds, words, none("id long, tag string, weight double"), none("id long, date string"), none("cid long, sid long"))
    # of the two seeds with a candidate's word the first
    assert {(r.cid, r.sid) for r in P.best_seed(pairs).collect()} == {(i, i // 10 % 20 * 10) for i in range(400) if i % 10}
    assert kept["seeds"].count() == 1 and kept["seeds"].first()["n"] == 40
