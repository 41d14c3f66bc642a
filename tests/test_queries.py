"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from siftline import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v if isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    expected = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", ["weave_graph", "graph_receipt", "near_duplicates", "selective_pull", "quota_assign", "context_coverage"])
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_graph_links_by_topic(spark, sf_dir, tmp_path):
    import collections
    import random
    import re

    from siftline.functions.text import STOP

    rng = random.Random(4)
    pool = [f"{a}{b}{c}" for a in ("bran", "dril", "fost") for b in "aeiou" for c in ("mel", "nor", "pix", "tun")]
    texts = [" ".join(rng.choice(pool) for _ in range(25)) for _ in range(30)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    counts = [collections.Counter(w for w in re.findall("[a-z]+", t) if w not in STOP) for t in texts]
    df = collections.Counter(w for c in counts for w in c)
    vectors = []
    for c in counts:
        raw = {w: n / sum(c.values()) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append({w: x / norm for w, x in raw.items()})
    want = set()
    for a in range(30):
        near = [(sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()), b) for b in range(a + 1, 30)]
        want |= {(a, b, round(min(0.49, 0.14 + 0.35 * s), 6)) for s, b in sorted(near, reverse=True)[:5] if s >= 0.14}
    edges = catalog.queries()["weave_graph"](spark, str(tmp_path)).filter("relation = 'SEMANTIC_SIMILARITY'").collect()
    number = lambda x: int(x.rsplit(":", 1)[1])
    assert {(number(r.source), number(r.target), r.confidence) for r in edges} == want
    assert any(c < 0.14 + 0.35 * 0.4 for _, _, c in want)


def test_training_takes_all_models_and_values(spark, sf_dir, monkeypatch):
    from siftline.queries import learning

    rows = learning.training_rows(spark, sf_dir)
    assert rows.filter("lines is null").count() == 0
    seen = []
    whole = learning.K.train_oof
    monkeypatch.setattr(learning.K, "train_oof", lambda *a, **b: seen.append(whole(*a, **b)) or seen[0])
    out = learning.train_oof(spark, sf_dir)
    assert out.count() == rows.count()
    assert all(set(r.scores) == set(learning.K.models()) for r in seen[0].collect())


def test_missing_values_are_the_median(spark):
    from siftline.operators import classify

    rows = [(i, float(i % 2), None if i == 5 else float(i), 1.0) for i in range(20)]
    data = classify.prepared(spark.createDataFrame(rows, "id long, label double, x double, weight double"), ["x"])
    fit = classify.pipeline(["x"], classify.models()["logistic"]).fit(data)
    got = {r.id: (r.x_filled, r.x_missing) for r in fit.transform(data).collect()}
    assert got == {i: (10.0, 1.0) if i == 5 else (float(i), 0.0) for i in range(20)}


def test_texts_are_taken_whole(spark, tmp_path):
    text = "x " * 150_000 + "license idiot 123"
    spark.createDataFrame([(1, text, "en", "src1", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert run("make_archive_record")[0].text == text
    assert run("file_roles")[0].roles == "LICENCE,ABUSE,NUMBERS"
    assert run("repo_to_seed")[0].tags == "abuse,alpha,licence,numbers"
    assert {r.value for r in run("repo_scan_summary")} == {"ALPHA", "LICENCE", "ABUSE", "NUMBERS"}


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
