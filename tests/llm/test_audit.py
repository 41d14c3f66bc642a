"""The manifest and the source divergence against brute force and SQL, the additive model on held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import divergence, manifest, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, rank int"


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _framed(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(hashes: list[str]):
    paths, own = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, below = [], []
        for lo in range(0, len(hashes), 8):
            run = hashes[lo : lo + 8]
            for j in range(len(run)):
                for x in own[lo + j]:
                    paths[x].append((run[:j], run[j + 1 :]))
            up.append(_sha("".join(run)))
            below.append(sum(own[lo : lo + 8], []))
        hashes, own = up, below
    return hashes[0], paths


def brute_manifest(rows: list[dict]) -> list[tuple]:
    def leaf(r, text):
        return _sha("".join(map(_framed, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))

    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), i))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs, found = [], {}
    for lang in langs:
        own = sorted(groups[lang])
        sub, paths = _tree([h for _, _, h, _ in own])
        subs.append(sub)
        found.update({i: (h, sub, p) for (_, _, h, i), p in zip(own, paths, strict=True)})
    root, above = _tree(subs)
    out = []
    for i, r in enumerate(rows):
        h, sub, path = found[i]
        path = path + above[langs.index(r["lang"])]
        x = h
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            x = leaf(r, r["text"] and r["text"].translate({c: c + 32 for c in range(65, 91)}))
        for a, b in path:
            x = _sha("".join(a) + x + "".join(b))
        out.append((r["doc_id"], h, sub, root, _sha("".join("".join(a) + "".join(b) for a, b in path)), x, x == root))
    return out


def _key(row):
    return tuple((v is not None, v) for v in row)


def _manifest(spark, rows):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return manifest.manifest(spark.createDataFrame(rows, DOCS), tampered=tampered)


def _doc(i, text="Some Text", lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "clash", 7)


@pytest.mark.parametrize(
    "rows",
    [
        [_doc(5)],
        [_doc(i) for i in range(9)],
        [_doc(i * 977 - 40_000, f"Text {i} É", ["en", "de", None, "zh", ""][i % 5]) for i in range(200)],
        [_doc(63), _doc(64), _doc(-1), _doc(-64), _doc(-65), _doc(1 << 40), _doc((1 << 63) - 1), _doc(-(1 << 63))],
        [_doc(1, None), _doc(2, ""), _doc(3, "-"), _doc(4, "x", None, None), _doc(None, "y"), _doc(None, "z"), _doc(None, "y")],
        [_doc(i // 40, f"T {i % 7}", f"l{i % 3}") for i in range(300)],
        [_doc(i, "Ab", f"lang{i:03}") for i in range(100)],
        [_doc(7, "A" * 300_000 + "é"), _doc(8, "x")],
    ],
    ids=["one", "ragged run", "groups", "far ids", "nulls", "repeated rows", "many groups", "long text"],
)
def test_manifest_is_brute_force(spark, rows):
    got = sorted(map(tuple, _manifest(spark, rows).collect()), key=_key)
    names = [x.split()[0] for x in DOCS.split(", ")]
    assert got == sorted(brute_manifest([dict(zip(names, r, strict=True)) for r in rows]), key=_key)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert manifest.manifest(empty).collect() == []
    assert divergence.divergence(empty).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(empty, labels)
    assert quality.score(empty, model).collect() == []
    assert quality.score(spark.createDataFrame([_doc(1)], DOCS), model).first()["score"] == 0.5


def test_running_sums(spark):
    from siftline.plans.ordered import running_sums

    rows = spark.range(5000).select(F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("n"))
    got = {r["k"]: r["before"] for r in running_sums(rows, ["k"], {"before": "n"}).collect()}
    total = 0
    for k, n in sorted((r["k"], r["n"]) for r in rows.collect()):
        assert got[k] == total
        total += n


def brute_divergence(rows: list[tuple], least: int, ranks: int) -> list[tuple]:
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, whole, own = Counter(), Counter(), defaultdict(Counter)
        for _, source, terms in (d for d in docs if d[0] == lang):
            df.update(set(terms))
            own[source].update(terms)
            whole.update(terms)
        kept = sorted(t for t in df if df[t] >= least)

        def prob(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q = prob(whole)
        p = {s: prob(c) for s, c in own.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            term = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, o, -v, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (v, _, o) in enumerate(found)]
    return sorted(out)


def _texts(seed: int, n: int, langs, sources) -> list[tuple]:
    rng = np.random.default_rng(seed)
    words = [f"w{i}" if i % 3 else f"Wört{i}" for i in range(60)]
    own = lambda: " ".join(words[min(59, int(rng.exponential(12)))] for _ in range(int(rng.integers(0, 60))))
    return [(i, None if i % 29 == 0 else own(), langs[i % len(langs)], sources[int(rng.integers(len(sources)))], 0, "clash", 1) for i in range(n)]


@pytest.mark.parametrize("peers,postings", [(1024, (1 << 13, 1 << 20)), (3, (8, 16))])
def test_divergence_is_brute_force(spark, peers, postings):
    rows = _texts(3, 300, ["en", "de", None], ["a", "b", None, "c", "é", "d", "B", "a"])
    # a language of one source, one without kept terms, a group of empty texts, repeated rows
    rows += [(900 + i, "only here", "xx", "a", 0, "", 1) for i in range(12)] + [(950, "x", "yy", "a", 0, "", 1), (951, "", "yy", "b", 0, "", 1), (952, "", "en", "empty", 0, "", 1)] + [rows[5]] * 4
    got = sorted(map(tuple, divergence.divergence(spark.createDataFrame(rows, DOCS), 5, 4, peers=peers, postings=postings).collect()))
    assert got == brute_divergence(rows, 5, 4)


def test_probabilities_beyond_longs(spark):
    big = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, total long, v long")
    got = big.select(divergence.probability(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 14)


@pytest.mark.parametrize("sql,query", [(manifest.OP12_SQL, manifest.op12_merkle_manifest), (divergence.OP13_SQL, divergence.op13_source_divergence)], ids=["op12", "op13"])
def test_queries_are_their_sql(spark, sql, query):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = query(spark, "/root/testdata/sf0.001")
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def _slow_features(text: str | None) -> dict:
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    folded = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    lines = [x for x in data.split(b"\n") if x]
    n, chars = max(1, len(words)), max(1, len((text or "")))
    symbols = set(b"#$%&*+/<=>@[\\]^_`{|}~")
    p = np.array(list(Counter(data).values())) / max(1, len(data))
    return {
        "log_bytes": np.log1p(len(data)), "log_words": np.log1p(len(words)), "word_bytes": sum(map(len, words)) / n,
        "symbols": sum(c in symbols for c in data) / chars, "symbol_words": sum(any(c in symbols for c in w) for w in words) / n,
        "distinct_words": len(set(folded)) / n, "commonest_word": max(Counter(folded).values(), default=0) / n,
        "repeats": sum(a == b for a, b in itertools.pairwise(folded)) / n, "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
        "log_lines": np.log1p(len(lines)), "digits": sum(48 <= c <= 57 for c in data) / chars, "entropy": float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
    }


def test_features_are_what_they_say():
    import pyarrow as pa

    texts = ["", None, "Éa a A a.\nb b\nb b\n", "x", "\n\n", " lone ", "a$$$ b### 12 c!" * 9, "wört " * 4000, "Ünï\tcode\n" * 3]
    got = quality._rows(pa.record_batch({"text": pa.array(texts, pa.string())}), "text")
    for row, text in zip(got, texts, strict=True):
        for name, value in _slow_features(text).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value, abs=1e-9), (text, name)


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.train(x[:2000], y[:2000], np.ones(2000))
    assert (0, 2) in model["pairs"]
    alone = quality.train(x[:2000], y[:2000], np.ones(2000), pairs=0)
    right = lambda m: ((quality.logits(m, x[2000:]) > 0) == y[2000:]).mean()
    assert right(model) > 0.9 > 0.65 > right(alone)


def test_quality_on_held_out_labels(spark):
    path = "/root/testdata/sf0.01"
    rows = quality.op11_quality(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", "quality").toPandas()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()
    good, bad = rows[rows["quality"] == 1]["score"], rows[rows["quality"] == 0]["score"]
    assert (good.to_numpy()[:, None] > bad.to_numpy()[None, :]).mean() > 0.97
    assert (good >= 0.7).mean() > 0.97


def test_quality_handles_any_row(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in enumerate(["", None, "a b c", "$$ %% " * 50_000, "word " * 100_000])] + [(2, "a b c", "en", "s", 0, "x", 1), (None, "a b c", None, None, None, None, None)], DOCS)
    labels = spark.createDataFrame([(0, 0), (2, 1), (2, 0), (3, 0), (4, 1), (None, 1), (1, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs.withColumn("score", F.lit("old")), model)
    assert got.columns == [*docs.columns, "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] == "a b c"}) == 1 and len({r["score"] for r in rows if not r["text"]}) == 1
