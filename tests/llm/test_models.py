"""Language identification, toxicity and LM scoring on held-out rows and by recomputation; the pipeline."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import langid, lmscore, queries, toxicity


def test_languages_of_held_out_documents(spark, sf_dir):
    got = langid.op10_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_language_edge_cases(spark):
    rows = [("das ist ein haus und der mann", "de"), ("the cat and the dog", "en"), (None, "en"), ("kein", None)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model["langs"] == ["de", "en"]
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "123 !?", "k"), (4, "der mann", "k"), (4, "the dog " * 50_000, "k")], "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(df, model).sort("doc_id", "text").collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "en")]
    none = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def brute_grams(text):
    """Buckets of all one-, two- and three-character n-grams, one by one."""
    chars = [int(x) for x in langid.letters(text)]
    for k in range(3):
        for i in range(len(chars) - k):
            h = sum(c * int(m) for c, m in zip(chars[i : i + k + 1], langid._MUL, strict=False)) % 2**32
            yield (h >> 17) + k * langid.BUCKETS


def test_language_counts_and_scores_by_brute_force(spark):
    texts = [("das ist ein haus", "de"), ("the cat, and THE dog", "en"), ("the dog 12", "en"), ("ñandú über élan", "es")]
    model = langid.fit(spark.createDataFrame(texts, "text string, lang string").repartition(3))
    counts = {lang: Counter(g for t, own in texts if own == lang for g in brute_grams(t)) for lang in ("de", "en", "es")}
    for k in range(3):
        span = range(k * langid.BUCKETS, (k + 1) * langid.BUCKETS)
        seen = len({g for c in counts.values() for g in c if g in span})
        for i, lang in enumerate(model["langs"]):
            total = sum(n for g, n in counts[lang].items() if g in span) + 0.1 * (seen + 1)
            for g in {g for c in counts.values() for g in c if g in span}:
                assert model["logp"][g, i] == pytest.approx(math.log((counts[lang][g] + 0.1) / total), rel=1e-5)
    some = ["the haus", "", None, "über", "ab " * 3000, "!", "d"]
    pred, score = langid.score_texts(some, model["langs"], model["logp"])
    for text, p, s in zip(some, pred, score, strict=True):
        own = list(brute_grams(text or ""))
        if not any(c.isalpha() for c in text or ""):
            assert (p, s) == ("und", 0.0)
            continue
        z = model["logp"][own].sum(0, dtype=np.float64) * min(len(own), langid.EVIDENCE) / len(own)
        e = np.exp(z - z.max())
        assert p == model["langs"][int(z.argmax())] and s == pytest.approx(float(e.max() / e.sum()), abs=1e-5)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame([("a", x) for x in "xyz"], "text string, lang string"))


def test_steps_of_a_long_text_score_as_one():
    rng = np.random.default_rng(0)
    logp = rng.random((3 * langid.BUCKETS, 2)).astype(np.float32)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 2 * langid.STEP + 5))
    total = sum(logp[at].sum(0, dtype=np.float64) for at in langid.grams(langid.letters(text)))
    n = sum(len(at) for at in langid.grams(langid.letters(text)))
    z = total * (langid.EVIDENCE / n)
    p = np.exp(z - z.max())
    (_,), (score,) = langid.score_texts([text], ["a", "b"], logp)
    assert score == pytest.approx(float(p.max() / p.sum()), abs=1e-4)


def test_toxicity_finds_unseen_spellings():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdlmnrst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    def doc(bad):
        own = [word() for _ in range(60)]
        if bad:
            for _ in range(4):
                own[rng.randrange(60)] = rng.choice(["zworx", "quapfel"]) + word()
        return " ".join(own)
    labels = np.array([i % 2 for i in range(400)])
    model = toxicity.train(toxicity.bags([doc(y) for y in labels]), labels, epochs=40)
    scorer = toxicity.Scorer(model)
    scores = scorer([doc(y) for y in [0, 1] * 100])
    assert (scores[1::2, None] > scores[None, ::2]).mean() > 0.95


def test_bags_gradients_and_scores_by_brute_force():
    texts = ["bad badd <b> good", None, "", "good Good, well", "x", "bad " * 9 + "y"]
    own = toxicity.bags(texts)
    for i, t in enumerate(texts):
        weight = Counter()
        words = (t or "").lower().split()
        for w in words:
            sub = toxicity.subwords([w])[0].tolist()
            assert len(sub) == 1 + sum(max(0, len(w.strip(toxicity._TRIM) or w) + 2 - n + 1) for n in toxicity.NGRAMS)
            for b in sub:
                weight[b] += 1 / len(words) / len(sub)
        lo, hi = own.begin[i], own.begin[i + 1]
        assert dict(zip(own.bucket[lo:hi].tolist(), own.weight[lo:hi].tolist(), strict=True)) == pytest.approx(dict(weight), rel=1e-5)
    rng = np.random.default_rng(0)
    emb, out, bias = rng.normal(size=(toxicity.BUCKETS, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    labels, weight = np.array([1, 0, 0, 0, 1, 1]), rng.random(6)

    def loss(emb, out, bias):
        z = np.array([sum((emb[b] * w for b, w in zip(own.bucket[lo:hi], own.weight[lo:hi], strict=True)), np.zeros(3)) @ out + bias for lo, hi in zip(own.begin[:-1], own.begin[1:], strict=True)])
        return sum(w * (np.log(np.exp(x).sum()) - x[y]) for w, x, y in zip(weight, z, labels, strict=True)) / 6

    used, grads = toxicity.gradients(own, labels, weight, emb, out, bias)
    for at, value, grad in ((used, emb, grads[0]), (np.arange(3), out, grads[1]), (np.arange(2), bias, grads[2])):
        for k, where in [*enumerate(at)][:: max(1, len(at) // 5)]:
            for d in [()] if value.ndim == 1 else [(j,) for j in range(value.shape[1])]:
                step = np.zeros_like(value)
                step[(where, *d)] = 1e-5
                args = [(emb, out, bias), (emb, out, bias)]
                ups = [tuple(v + s * step if v is value else v for v in a) for s, a in zip((1, -1), args, strict=True)]
                assert grad[(k, *d)] == pytest.approx((loss(*ups[0]) - loss(*ups[1])) / 2e-5, abs=1e-6)
    model = {"value": rng.normal(size=toxicity.BUCKETS).astype(np.float32), "bias": 0.3}
    assert toxicity.Scorer(model).logits(texts) == pytest.approx(toxicity.logits(model, own), rel=1e-4)


def test_calibration_fits_the_held_rows():
    rng = np.random.default_rng(3)
    own = toxicity.Bags(np.arange(400).astype(np.uint16), np.ones(400, np.float32), np.arange(401))
    value = np.zeros(toxicity.BUCKETS, np.float32)
    value[:400] = rng.normal(size=400)
    labels = (rng.random(400) < 1 / (1 + np.exp(-(3 * value[:400] - 2)))).astype(float)
    model = toxicity.calibrated({"value": value, "bias": 5.0}, own, labels, np.ones(400))
    p = 1 / (1 + np.exp(-toxicity.logits(model, own)))
    assert p.mean() == pytest.approx(labels.mean(), abs=0.01)
    assert 2 < model["value"][0] / value[0] < 4


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, "bad bad"), (2, "good"), (3, None), (4, ""), (None, "bad"), (1, "bad twice")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.withColumn("score", F.lit("old")), model)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == 6
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.collect())
    one_class = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert all(r.score < 0.01 for r in toxicity.score(docs, one_class).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_registered_toxicity_scores_all(spark, sf_dir):
    got = toxicity.op9_toxicity(spark, sf_dir).toPandas()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and got.score.between(0, 1).all()


def test_registered_toxicity_tells_held_out_rows_apart(spark, sf_dir):
    larger = f"{sf_dir}/../sf0.1"  # smaller tables have too few toxic labels
    got = toxicity.op9_toxicity(spark, larger).filter("held_out").join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").toPandas()
    bad, good = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert len(bad) > 50 and (bad[:, None] > good[None, :]).mean() > 0.85


def test_lm_losses_equal_a_recount(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e"][: 3 + i % 3]) for _ in range(rng.randrange(0, 12)))) for i in range(30)] + [(40, None), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(0, 30, 3)] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in lmscore.score(docs, lmscore.fit(docs, good), good).collect()}
    V, S, R = lmscore.VOCABULARY, lmscore.SHRINK, lmscore.PRIOR
    def tables(of):
        uni, prev, bi = Counter(), Counter(), Counter()
        for _, t in of:
            w = (t or "").split()
            uni.update(w)
            for a, b in zip(["^", *w], w, strict=False):
                bi[a, b] += 1
            prev.update(w)
            prev["^"] += bool(w)
        return uni, prev, bi
    whole = tables(rows)
    target = tables([r for r in rows if r[0] is not None and r[0] % 3 == 0 and r[0] < 30])
    for key, text in rows:
        w = (text or "").split()
        if not w:
            assert got[key].score == 0 and got[key].target_loss is None
            continue
        own = tables([(key, text)])
        same = [i for i, t in rows if t == text]
        learned = sum(i is not None and i % 3 == 0 and i < 30 for i in same)
        base = {x: (whole[0][x] - len(same) * own[0][x] + 0.5) / (sum(whole[0].values()) - len(same) * len(w) + 0.5 * V) for x in set(w)}
        for name, (uni, prev, bi), k in (("background_loss", whole, len(same)), ("target_loss", target, learned)):
            loss = 0.0
            for a, b in zip(["^", *w], w, strict=False):
                p = (uni[b] - k * own[0][b] + S * base[b]) / (sum(uni.values()) - k * len(w) + S)
                c = prev[a] - k * own[1][a]
                loss -= math.log((min(bi[a, b] - k * own[2][a, b], c) + R * p) / (c + R))
            assert getattr(got[key], name) == pytest.approx(loss / len(w), rel=1e-6)
    assert lmscore.score(docs.limit(0), lmscore.fit(docs.limit(0), good), good).count() == 0


def test_lm_counts_of_many_words_stay_apart(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(300))) for i in range(100)]
    docs, good = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(0, 100, 2)], "doc_id long")
    got = {r.doc_id: r for r in lmscore.score(docs, lmscore.fit(docs, good), good).collect()}
    V, S, R = lmscore.VOCABULARY, lmscore.SHRINK, lmscore.PRIOR
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        w = t.split()
        for k in (0, 1) if i % 2 == 0 else (0,):
            uni[k].update(["^", *w])
            bi[k].update(zip(["^", *w], w, strict=False))
    total = [sum(u.values()) - u["^"] for u in uni]
    for i, t in rows:
        w = t.split()
        own, own2 = Counter(["^", *w]), Counter(zip(["^", *w], w, strict=False))
        for k, name in enumerate(("background_loss", "target_loss")):
            m, loss = int(k == 0 or i % 2 == 0), 0.0
            for a, b in zip(["^", *w], w, strict=False):
                base = (uni[0][b] - own[b] + 0.5) / (total[0] - len(w) + 0.5 * V)
                p = (uni[k][b] - m * own[b] + S * base) / (total[k] - m * len(w) + S)
                c = uni[k][a] - m * own[a]
                loss -= math.log((min(bi[k][a, b] - m * own2[a, b], c) + R * p) / (c + R))
            assert getattr(got[i], name) == pytest.approx(loss / len(w), rel=1e-9)


def test_lm_copies_of_learned_documents_have_no_advantage(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice([f"w{i}" for i in range(300)]) for _ in range(40))
    rows = [(i, text()) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1])]
    docs, good = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = {r.doc_id: r.score for r in lmscore.score(docs, lmscore.fit(docs, good), good).collect()}
    assert got[0] == pytest.approx(got[100]) == pytest.approx(got[101])
    once = docs.filter("doc_id < 100")
    alone = {r.doc_id: r.score for r in lmscore.score(once, lmscore.fit(once, good), good).collect()}
    assert got[0] == pytest.approx(alone[0])


def test_lm_prefers_the_target(spark, sf_dir):
    larger = f"{sf_dir}/../sf0.1"  # smaller tables have too few labels
    got = lmscore.op7_lm_scoring(spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").toPandas()
    means = got.groupby("quality").score.median()
    assert means[1] > means[0]


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline as C

    from .test_dedup import brute_components, brute_lines, brute_overlaps

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs)
    given = [(r.doc_id, r.text) for r in docs.collect()]
    keep = set()
    for key, text in given:  # the language of each by summing its n-grams' log-probabilities
        chars = langid.letters(text or "")
        if (chars != langid._SPACE).any():
            own = np.concatenate(langid.grams(chars))
            z = model["logp"][own].sum(0, dtype=np.float64) * min(len(own), langid.EVIDENCE) / len(own)
            keep |= {key} if np.exp(z - z.max()).sum() <= 1 / C.SURE else set()
    assert len(keep) > 0.95 * len(given)
    rows = [(k, t) for k, t, _, _ in brute_lines([r for r in given if r[0] in keep])]
    group = {k: c for k, _, c in brute_components(rows, 5, 0.8)}
    rows = [(k, t) for k, t in rows if group[k] == k]
    # an item that shares no run of five tokens, no seed of a mask either, can't overlap enough
    cut = lambda t: re.split(r"[\s!-/:-@\[-`{-~]+", t.lower())
    pieces = lambda t: {tuple(x for x, m in zip(cut(t)[i : i + 8], mask, strict=False) if m == "1") for i in range(len(cut(t))) for mask in ("11111000", "11101100", "11001011", "11010011")}
    items = [(r.item_id, r.text, pieces(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = set()
    for k, t in rows:
        own = pieces(t or "")
        for i, b, p in items:
            if k not in bad and p & own:
                bad |= {x[0] for x in brute_overlaps([(k, t)], [(i, b)])}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines())}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = {k: (len(ids := enc.encode_ordinary(t)), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for k, t in rows if k not in bad}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in C.run(spark, sf_dir).collect()} == want


def test_pipeline_stages_and_odd_rows(spark, sf_dir):
    import corpus_pipeline as C

    long_ = " ".join(f"wort{i} und" for i in range(30_000))
    base = "the first text of several words that is here more than once and again"
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = [(1, base), (2, base + " then"), (3, base + " then so"), (3, "quite another one under the same id that nothing is like"), (3, "quite another one under the same id that nothing is like"), (4, None), (5, ""), (6, long_), (None, base), (None, "no id at all for this one of the texts"), (7, "so " + item), (7, "clean text of the same id as one that isn't")]
    docs = spark.createDataFrame([(i, t, None if i == 1 else "en", None, None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _k1 string").repartition(3)
    for name, stage in C.STAGES[1:4]:
        got = stage(spark, docs, sf_dir)
        assert got.columns == list(C.COLUMNS), name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert texts(C.near_duplicates(spark, docs, sf_dir)) == sorted((rows[i] for i in (0, 3, 5, 6, 7, 9, 10, 11)), key=repr)
    assert texts(C.benchmark_leaks(spark, docs, sf_dir)) == sorted((r for i, r in enumerate(rows) if i != 10), key=repr)
    left = C.language(spark, docs, sf_dir)
    assert left.columns == list(C.COLUMNS) and {4, 5}.isdisjoint({r.doc_id for r in left.collect()}) and left.count() == 10
    assert C.language(spark, docs.limit(0), sf_dir).count() == 0
    out = C.tokens(spark, docs, sf_dir)
    assert out.count() == 12 and {r.n_tokens for r in out.filter("doc_id in (4, 5)").collect()} == {0}
    assert C.tokens(spark, docs.limit(0), sf_dir).count() == 0


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
