"""Headers of image files, trees of files, guards before training, bounded pairs and similarity bounds."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftline import catalog
from siftline.operators import classify, files, tfidf
from siftline.operators.sieve import similar_pairs
from siftline.plans import pairs as P
from siftline.sources import headers
from siftline.sources.web import expand_metadata


def _card(text: str) -> bytes:
    return text.encode().ljust(80)


def _image(*cards: str, end: bool = True, data: int = 0) -> bytes:
    head = b"".join(_card(c) for c in cards) + (_card("END") if end else b"")
    return head.ljust(-(-len(head) // 2880) * 2880) + bytes(data)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("plates")
    (root / "sub").mkdir()
    files_ = {
        "dss_XE001.fits": _image("SIMPLE  =                    T / standard", "DATE-OBS= '12/03/54          '", "EXPOSURE=              4.5D+01 / minutes", "REGION  = 'XE001   '", "COMMENT a / b = c", data=3_000_000),
        "sub/dss_XE002.FITS": _image("DATE-OBS= '1955-07-30T01:02' / it''s", "EXPOSURE=                  0.0", "TELESCOP= 'Big / one'", *[f"KEY{i:05d}= {i}" for i in range(60)]),
        "dss_XE003.fits": _image("DATE-OBS= '25/12/1951'", "EXPOSURE= 50", "REGION  = 'XE009'", end=False),
        "dss_XE004.fits": b"",
        "notes.txt": b"DATE-OBS= '1950-01-01'",
    }
    for name, content in files_.items():
        (root / name).write_bytes(content)
    return root


def test_headers_are_read_and_images_are_not(spark, tree):
    cards = headers.header_cards(spark, str(tree))
    got = {(r["path"].rsplit("_", 1)[1], r["key"]): r["value"] for r in cards.collect()}
    assert got["XE001.fits", "EXPOSURE"] == "4.5D+01" and got["XE001.fits", "SIMPLE"] == "T" and got["XE002.FITS", "TELESCOP"] == "Big / one"
    assert ("XE001.fits", "COMMENT") not in got and len([k for k in got if k[0] == "XE002.FITS"]) == 63
    assert {r["key"] for r in cards.filter("key in ('REGION', 'EXPOSURE')").collect()} == {"REGION", "EXPOSURE"}
    read = {r["path"].rsplit("_", 1)[1]: (r["header_bytes"], r["whole"]) for r in cards.select("path", "header_bytes", "whole").distinct().collect()}
    assert read == {"XE001.fits": (2880, True), "XE002.FITS": (5760, True), "XE003.fits": (2880, False)}


def test_a_condition_on_keys_reaches_the_reader(spark, tree):
    own = headers._Reader({"path": str(tree)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    other = GreaterThan(("at",), 1)
    assert list(own.pushFilters([In(("key",), ["DATE-OBS", "EXPOSURE"]), other, EqualTo(("key",), "EXPOSURE")])) == [other]
    found = [row for part in own.partitions() for row in own.read(part)]
    assert {r[2] for r in found} == {"EXPOSURE"} and len(found) == 3


def test_the_table_of_headers_says_what_is_unfit(spark, tree):
    rows = {r["plate_id"]: r for r in headers.header_table(headers.header_cards(spark, str(tree))).collect()}
    assert {k: (str(r["date_obs"]), r["exposure"], r["problem"]) for k, r in rows.items()} == {"XE001": ("1954-03-12", 45.0, None), "XE002": ("1955-07-30", 0.0, "NO_EXPOSURE"), "XE003": ("1951-12-25", 50.0, "REGION_MISMATCH")}


@pytest.mark.parametrize("text,date", [("1952-02-29", "1952-02-29"), ("'03/04/51'", "1951-04-03"), ("12/25/49", "1949-12-25"), ("31/01/1953", "1953-01-31"), ("12/25/1953", "1953-12-25"), ("5-6-1950", "1950-06-05"), ("01/01/00", "1900-01-01"), ("soon", "None"), (None, "None"), ("1952-02-30", "None")])
def test_dates_of_headers(spark, text, date):
    df = spark.createDataFrame([(text,)], "d string")
    assert str(df.select(headers.header_date(F.col("d"))).first()[0]) == date


def test_an_empty_folder_has_no_cards(spark, tmp_path):
    assert headers.header_cards(spark, str(tmp_path)).count() == 0


def test_json_is_the_whole_text(spark, tmp_path):
    import duckdb

    good = ["1", " 1 ", "null", "NaN", '{"a":1,"a":2}', "[[1],[2]]", "[]", "{}", '"a" ']
    bad = ["1 and more", '"a" b', "{} x", "[1] 2", "true x", "", "1],[2", "1,2],[", '1,"x":2', '1,"end":true}', "1,0]", "{'a':1}", '"a\nb"']
    rows = [(i, t) for i, t in enumerate([*good, *bad])]
    assert [r.j for r in spark.createDataFrame(rows, "i int, t string").orderBy("i").select(files.is_json(F.col("t")).alias("j")).collect()] == [True] * len(good) + [False] * len(bad)
    docs = [(10 + 20 * i, t, "en", "src1", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert catalog.queries()["assimilate_tree"](spark, str(tmp_path)).first().json_errors == con.execute(catalog.oracle_sql()["assimilate_tree"]).fetchone()[3] == len(bad)


def test_a_tree_is_assimilated(spark):
    rows = [("a/x.json", '{"k": 1}'), ("a/y.json", "{broken"), ("b/z.txt", "alpha beta failed"), ("b/none.txt", None)]
    index, queue, receipt = files.assimilate(spark.createDataFrame(rows, "path string, text string"), [("a/", "A")], {"R": "beta"}, {"alpha": 3, "beta": 2}, "failed", 5)
    assert {r["path"]: (r["domain"], r["roles"], r["score"], r["negative"], r["json"]) for r in index.collect()} == {"a/x.json": ("A", [], 0, False, True), "a/y.json": ("A", [], 0, False, False), "b/z.txt": ("OTHER", ["R"], 5, True, None), "b/none.txt": ("OTHER", [], 0, False, None)}
    assert [r["path"] for r in queue.collect()] == ["b/z.txt"]
    r = receipt.first()
    assert (r["files"], r["candidates"], r["negative"], r["json_errors"], r["status"]) == (4, 1, 1, 1, "PASS_WITH_JSON_PARSE_WARNINGS")
    again = files.assimilate(spark.createDataFrame(rows[::-1], "path string, text string").repartition(3), [("a/", "A")], {"R": "beta"}, {"alpha": 3, "beta": 2}, "failed", 5)[2].first()
    assert again == r
    assert files.assimilate(spark.createDataFrame([], "path string, text string"), [], {"R": "x"}, {"x": 1}, "y")[2].first()["status"] == "FAIL_EMPTY_SCAN"


def test_training_is_refused_with_reasons(spark):
    rows = [(i, i % 2, f"g{i % 8}", i % 3, "C" if i < 40 else "A", ["shape"] if i == 3 else ["reader"]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label int, grp string, fold int, tier string, witnesses array<string>")
    failed = lambda d, *a: {r["guard"] for r in classify.guard_report(d, "label", "grp", 3, *a).filter("failed").collect()}
    assert failed(df, "tier", "witnesses", ("colour",)) == set()
    assert failed(df, "tier", "witnesses", ("shape",)) == {"WITNESS_OVERLAP"}
    assert failed(df.filter("id < 40"), "tier", "witnesses", ("colour",)) == {"TIER_C_ONLY"}
    assert failed(df.filter("id < 12 and label = 1"), "tier") == {"TOO_FEW_ROWS", "TOO_FEW_GROUPS", "TIER_C_ONLY", "THIN_FOLDS"}
    with pytest.raises(ValueError, match="WITNESS_OVERLAP"):
        classify.check_training(df, "label", "grp", 3, "tier", "witnesses", ("shape",))
    data = df.select("id", "label", F.col("grp").alias("group"), F.col("id").cast("double").alias("x"), "tier", "witnesses")
    with pytest.raises(ValueError, match="TIER_C_ONLY"):
        classify.train_oof(data.filter("id < 40"), ["x"], "group", 2, ("logistic",), tier="tier")


def test_population_scores_keep_out_of_fold_ones(spark, sf_dir):
    from siftline.queries import learning

    got = {r["id"]: r for r in catalog.queries()["score_population"](spark, sf_dir).collect()}
    oof = classify.train_oof(learning.training_rows(spark, sf_dir), learning.FEATURES, "group", 3, ("logistic",))
    own = {r["id"]: r["score"] for r in oof.collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and own
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["score_origin"] == ("OUT_OF_FOLD" if i in own else "MODEL")
        if i in own:
            assert r["score"] == pytest.approx(own[i], abs=1e-6)


def test_metadata_without_records_or_creators(spark):
    rows = spark.createDataFrame([([("1", "t", [("A",), ("B",)]), ("2", None, None)],), ([],), (None,)], "records array<struct<id:string,title:string,creators:array<struct<heading:string>>>>")
    assert {tuple(r) for r in expand_metadata(rows).collect()} == {("1", "t", "A; B"), ("2", None, None)}


# pairs in bounded blocks


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_pairs_in_blocks_are_all_pairs(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i if i % 11 else None, i * 10) for i in range(60)] + [("one", 500, 0), ("tie", 7, 1), ("tie", 7, 2)]
    df = spark.createDataFrame(rows, "k string, id int, v int").repartition(4)
    got = [(r["k"], r["a"]["id"], r["a"]["v"], r["b"]["id"], r["b"]["v"]) for r in P.pairs_within(df, ["k"], "id", block).collect()]
    want = [(x[0], *x[1:], *y[1:]) for x, y in itertools.permutations(rows, 2) if x[0] is not None and x[0] == y[0] and None not in (x[1], y[1]) and x[1] < y[1]]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_a_grid_of_blocks_is_the_join(spark, block):
    rng = random.Random(block)
    left = [(rng.choice("xxxxyz"), i) for i in range(40)]
    right = [(rng.choice("xxyyw"), 100 + i) for i in range(30)]
    got = P.met_between(spark.createDataFrame(left, "k string, l int"), spark.createDataFrame(right, "k string, r int"), ["k"], "l", "r", block)
    assert sorted((r["k"], r["a"]["l"], r["b"]["r"]) for r in got.collect()) == sorted((k, a, b) for k, a in left for q, b in right if k == q)


def test_a_hot_key_is_cut_into_bounded_parts(spark):
    n, block = 20_000, 500
    df = spark.range(n).select(F.lit("k").alias("k"), F.col("id"))
    hot = df.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"))
    dealt = P._blocks(df, hot, ["k"], ["_n"]).withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    largest = dealt.groupBy("k", F.least("_i", "_k"), F.greatest("_i", "_k")).count().agg(F.max("count")).first()[0]
    assert largest < 2.5 * block


def test_contained_sets_are_brute_force(spark):
    rng = random.Random(4)
    sets = {i: frozenset(["e0"] * (i % 3 > 0) + rng.sample([f"e{j}" for j in range(1, 9)], rng.randrange(1, 5))) for i in range(70)}
    got = {tuple(r) for r in tfidf.contained_sets(spark.createDataFrame([(k, e) for k, s in sets.items() for e in s], "k int, e string")).collect()}
    assert got == {(a, b) for a in sets for b in sets if a != b and sets[a] <= sets[b]}


# similarity bounds


def _vectors(spark, seed, n=80, hot=True):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        own = defaultdict(float)
        for _ in range(rng.randrange(1, 30)):
            own[f"t{min(79, int(rng.expovariate(0.06)))}"] += rng.random() + 0.1
        if hot:
            own["everywhere"] = 0.2
        norm = math.sqrt(sum(v * v for v in own.values()))
        out[i] = {t: v / norm for t, v in own.items()}
    return out, spark.createDataFrame([(i, t, w) for i, own in out.items() for t, w in own.items()], "id int, token string, weight double")


@pytest.mark.parametrize("threshold", [0.14, 0.4, 0.8])
def test_similarity_bounds_lose_no_pair_and_prune(spark, threshold):
    own, df = _vectors(spark, 3)
    dot = {(a, b): sum(w * own[b].get(t, 0) for t, w in own[a].items()) for a, b in itertools.combinations(own, 2)}
    want = {p for p, s in dot.items() if s >= threshold}
    got = {(r["a"], r["b"]): r["similarity"] for r in tfidf.cosine_pairs(df, threshold).collect()}
    assert got.keys() == want and all(got[p] == pytest.approx(dot[p]) for p in want)
    candidates = tfidf.cosine_candidates(df, threshold).count()
    meeting = sum(1 for s in dot.values() if s > 0)
    assert len(want) <= candidates <= meeting and candidates < meeting * {0.14: 1, 0.4: 0.7, 0.8: 0.4}[threshold]


@pytest.mark.parametrize("threshold", [0.5, 0.88])
def test_similar_pairs_are_brute_force(spark, threshold):
    rng = random.Random(7)
    base = [[f"s{rng.randrange(60)}" for _ in range(rng.randrange(1, 25))] for _ in range(30)]
    sets = {i: (base[i % 30] if i < 30 else [x for x in base[i % 30] if rng.random() > 0.06] + [f"own{i}"] * (i % 2)) for i in range(90)} | {90: [], 91: []}
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame(list(sets.items()), "ord int, shingles array<string>"), threshold).collect()}
    s = {k: set(v) for k, v in sets.items()}
    assert got == {(a, b) for a, b in itertools.combinations(s, 2) if s[a] and s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= threshold}


def test_similarity_takes_bounded_blocks(monkeypatch):
    import pyarrow as pa

    from siftline.operators import similar as S

    monkeypatch.setattr(S, "WEIGHTS", 12)
    monkeypatch.setattr(S, "VECTORS", 3)
    rng = random.Random(5)
    own = {f"d{i:02}": {rng.randrange(9): rng.random() for _ in range(rng.randrange(1, 15))} for i in range(25)}
    kinds = {"id": pa.string(), "class": pa.int64(), "tokens": pa.list_(pa.int64()), "weights": pa.list_(pa.float64())}
    rows = [{"id": k, "class": int(k[1:]) % 4, "tokens": [*v], "weights": [*v.values()]} for k, v in own.items()]
    batches = [pa.RecordBatch.from_pylist(rows[lo : lo + 10], pa.schema(kinds)) for lo in (0, 10, 20)]
    blocks = [b.to_pylist()[0] | {"block": i} for i, b in enumerate(S._packed(iter(batches)))]
    assert [x for b in blocks for x in b["ids"]] == [*own] and all(len(b["ids"]) <= 3 and (len(b["tokens"]) <= 12 or len(b["ids"]) == 1) for b in blocks)
    both = [x | {f"{c}2": v for c, v in y.items()} for x in blocks for y in blocks if x["block"] <= y["block"]]
    got = [r for b in S._met(0.5, pa.string())([pa.RecordBatch.from_pylist(both)]) for r in b.to_pylist()]
    want = {(a, b): s for a, b in itertools.combinations(own, 2) if (s := sum(w * own[b].get(t, 0) for t, w in own[a].items())) >= 0.5}
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == pytest.approx(want) and len(got) == len(want)
    assert all((r["class_a"], r["class_b"]) == (int(r["a"][1:]) % 4, int(r["b"][1:]) % 4) for r in got)


def test_words_are_counted_in_their_rows_and_pairs_stay_where_they_are(spark, tmp_path):
    df = spark.createDataFrame([(1, "b a b  b"), (2, None), (3, " "), (4, "c")], "id int, text string")
    counts = tfidf.term_counts(df, F.filter(F.split("text", " "), lambda w: w != ""))
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 1, 4), (1, "b", 3, 4), (4, "c", 1, 1)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    v = spark.createDataFrame([(i, f"t{i % 3}", 1.0) for i in range(9)], "id int, token string, weight double")
    pairs = tfidf.cosine_pairs(v, 0.9)
    assert "ShuffleExchange" not in pairs._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for a, b in itertools.combinations(range(9), 2) if a % 3 == b % 3}
