"""Classes of shared entities, forms of the graph, bridges and receipts against brute force."""

from __future__ import annotations

import collections
import itertools
import random
import re
from difflib import SequenceMatcher

import pytest

from siftline import catalog
from siftline.functions.pairs import sequence_ratio
from siftline.operators import bridges as B
from siftline.operators import graph as G
from siftline.operators import search, sieve
from siftline.operators import state as Z
from siftline.plans.storage import saver
from siftline.sources import records as R

ENTITY = "id string, kind string, value string, weight double"


def _entities(spark, seed: int = 3):
    rng = random.Random(seed)
    docs = [(f"d{i}", i, rng.choice(["a", "b", "c", None])) for i in range(40)]
    rows = {(f"d{i}", k, rng.choice("uvwxyz")) for i in range(40) for k in ("tag", "date", "keyword") for _ in range(2)}
    weight = {v: rng.choice([None, 0.1, 0.2, 1.5]) for v in "uvwxyz"}
    return spark.createDataFrame([(d, k, v, weight[v] if k == "tag" else None) for d, k, v in sorted(rows)], ENTITY), spark.createDataFrame(docs, "id string, ord int, provider string")


def test_shared_classes_stand_for_all_pairs(spark):
    entities, docs = _entities(spark)
    weighted = entities.filter("kind != 'tag' or weight is not null")
    pairs, classes = G.shared_entities(weighted, docs), G.shared_classes(weighted, docs)
    want = collections.Counter((r.via, r.independence_count) for r in pairs.collect())
    got = {(r.via, r.independence_count): r.links for r in classes.collect()}
    assert got == dict(want)
    first = {v: min((r.source for r in pairs.collect() if r.via == v), key=lambda d: int(d[1:])) for v, _ in want}
    assert {r.via: r.source for r in classes.collect()} == first
    key = lambda df: {r.relation: (r.edges, r.weak, round(r.mean_confidence, 9)) for r in G.receipt(df).collect()}
    assert key(pairs) == key(classes)


def test_shared_classes_of_tags_without_weights_and_of_nothing(spark):
    docs = spark.createDataFrame([("p", 1, "x"), ("q", 2, "y"), ("r", 3, None)], "id string, ord int, provider string")
    rows = spark.createDataFrame([(d, "tag", "t", None) for d in "pqr"], ENTITY)
    out = {(r.source, r.target, r.independence_count, r.links, round(r.confidence, 6)) for r in G.shared_classes(rows, docs, 0.28, 0.12).collect()}
    assert out == {("p", "tag:t", 0, 2, 0.28), ("p", "tag:t", 1, 1, 0.4)}
    assert G.shared_classes(rows.limit(0), docs).count() == 0
    assert G.shared_classes(rows.filter("id = 'p'"), docs).count() == 0


def test_forms_of_the_graph(spark, tmp_path):
    texts = ["palomar plates of 1954 and ufo talk", "ufo over kyiv 1954-05-06", "plates plates 1954", None, ""]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = {v: catalog.queries()[f"weave_graph{v}"](spark, str(tmp_path)).collect() for v in ("_v1", "_v2", "")}
    mentioned = {v: {(r.source[-1], r.target) for r in rows if r.relation == "MENTIONS"} for v, rows in out.items()}
    assert {("0", "topic:ufo"), ("0", "topic:palomar"), ("0", "place:palomar"), ("1", "place:kyiv"), ("1", "date:1954-05-06"), ("4", "tag:s0")} <= mentioned["_v1"]
    assert mentioned["_v2"] == mentioned[""]
    for v, base, apart in (("_v1", 0.28, 0.12), ("_v2", 0.26, 0.1)):
        members = collections.defaultdict(set)
        for d, e in mentioned[v]:
            members[e].add(int(d))
        want = collections.Counter((e, int(a % 2 != b % 2)) for e, ds in members.items() for a, b in itertools.combinations(sorted(ds), 2))
        got = {(r.via, r.independence_count): r.links for r in out[v] if r.relation == "SHARED_ENTITY"}
        assert got == dict(want)
        assert all(r.confidence == round(base + apart * r.independence_count, 6) for r in out[v] if r.relation == "SHARED_ENTITY")
    assert not any(r.via == "tag:en" for r in out[""])


def test_work_lineages(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(14)]
    some = lambda pool, n: sorted(set(rng.sample(pool, n)))
    works = []
    for i in range(30):
        title = some(words[:7], 5)
        works.append((i, " ".join(title), some(["ann", "bo", "cy", "di"], 2), title, some(words, 9), some(["f", "g", "h"], rng.choice([1, 2]))))
    works.append((30, "lone", [], [], [], []))
    df = spark.createDataFrame(works, "id int, title string, authors array<string>, title_words array<string>, abstract_words array<string>, families array<string>")
    j = lambda p, q: round(len(set(p) & set(q)) / len(set(p) | set(q)), 6) if p and q else 0.0
    for sequence in (None, sequence_ratio):
        want = {}
        for a, b in itertools.combinations(works, 2):
            au, ti, ab, fa = (j(a[k], b[k]) for k in (2, 3, 4, 5))
            alike = ti >= 0.45 or (sequence is not None and SequenceMatcher(None, a[1], b[1], autojunk=False).ratio() >= 0.72)
            strong = au >= 0.5 and ab >= 0.4 and alike
            if strong or (au >= 0.34 and ti >= 0.35 and ab >= 0.3 and fa >= 0.5):
                want[a[0], b[0]] = (au, ti, ab, fa, strong)
        got = {(r.a, r.b): (r.authors, r.titles, r.abstracts, r.families, r.strong) for r in B.work_lineages(df, sequence).collect()}
        assert got == want and want


def test_assembled_bridges_keep_sources_and_ties(spark):
    papers = spark.createDataFrame([("p2", "alpha beta", "x"), ("p1", "alpha beta", "x"), ("p3", None, "beta"), ("p4", "", None)], "id string, title string, body string")
    aliases = spark.createDataFrame([("A", "alpha"), ("B", "beta"), ("B", "alpha beta")], "family string, alias string")
    routes = spark.createDataFrame([("A", "one", 0), ("A", "gone", 1)], "family string, anchor string, place int")
    anchors = spark.createDataFrame([("one",)], "anchor string")
    sources = spark.createDataFrame([("s", ["B"])], "id string, families array<string>")
    out = {r.source_id: (r.kind, r.families, r.route_score, r.anchors) for r in B.assemble_bridges(papers, aliases, routes, anchors, sources, 2).collect()}
    assert out == {"s": ("CANONICAL", ["B"], None, []), "p1": ("CANDIDATE", ["A", "B"], 4.45, ["one"]), "p2": ("CANDIDATE", ["A", "B"], 4.45, ["one"])}


def test_fur_receipt(spark, sf_dir):
    cover = [r.status for r in catalog.queries()["context_coverage"](spark, sf_dir).collect()]
    got = catalog.queries()["fur_receipt"](spark, sf_dir).collect()[0]
    n = collections.Counter(cover)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()
    assert (got.complete, got.partial, got.missing) == (n["COMPLETE"], n["PARTIAL"], n["MISSING"])
    assert got.tasks == n["PARTIAL"] + n["MISSING"] and got.subjects == len(docs)
    assert got.conflicts == sum(1 for d in docs if d.doc_id % 3 == 0 and d.lang not in (None, "xx"))


def test_package_stats(spark, sf_dir):
    run = lambda name: catalog.queries()[name](spark, sf_dir).collect()
    got, focus, cover = run("package_stats")[0], run("focus_rank"), run("context_coverage")
    assert (got.edges, got.attention_edges, got.attention_nodes) == (len(run("calibrate_edges")), len(run("edge_attention")), len(focus))
    assert got.active_focus_nodes == sum(r.focus_state in ("PRIMARY_FOCUS", "ACTIVE_FOCUS") for r in focus) > 0
    share = collections.defaultdict(lambda: [0, 0])
    for r in cover:
        share[r.subject][0] += r.known
        share[r.subject][1] += r.fields
    assert got.subjects == len(share)
    assert got.mean_coverage == pytest.approx(sum(k / n for k, n in share.values()) / len(share), abs=1e-6)


def test_package_of_nothing(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    out = Z.package_stats(none("x int"), none("x int"), none("node string, focus_state string"), none("subject string, known int, fields int"))
    assert tuple(out.collect()[0]) == (0, 0, 0, 0, 0, 0.0)


def test_a_document_is_one_row(spark, tmp_path):
    path = f"{tmp_path}/doc"
    for value in (None, "b"):
        R.write_json_doc(spark.createDataFrame([(value, 1)], "b string, a int"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"a":1,"b":"b"}']
    with pytest.raises(ValueError, match="exactly one row"):
        R.write_json_doc(spark.range(2), path)


ALIASES = [("a", "red fox"), ("a", "fox"), ("b", "Blue-Owl"), ("c", "  ")]


def _sieve_by_hand(docs, words, overlap, radius, limit):
    norm = lambda t: re.findall("[a-z0-9]+", t.lower())
    kept = []
    for i, text in sorted(docs):
        w = (text or "").split()
        parts = []
        for start in range(0, len(w), words - overlap):
            parts.append(" ".join(w[start : start + words]))
            if start + words >= len(w):
                break
        found = []
        for part in parts:
            s = f" {'  '.join(norm(part))} "
            n = {(f, a): s.count(f" {'  '.join(norm(a))} ") for f, a in ALIASES if norm(a)}
            found.append((sorted({f for (f, _), k in n.items() if k}), sum(n.values())))
        for k, (families, n) in enumerate(found):
            near = [j for j in range(max(0, k - radius), min(len(parts), k + radius + 1)) if j != k and found[j][0]]
            if families or near:
                score = min(1.0, 0.32 + 0.16 * len(families) + 0.025 * n) if families else 0.0
                kept.append([i, k, parts[k], families, round(max(score, 0.12) if near else score, 6)])
    runs = lambda t: {" ".join(t[i : i + 4]) for i in range(len(t) - 3)} if len(t) >= 4 else set(t)
    canonical, exact, of = [], {}, []
    for place, (_, _, text, families, _) in enumerate(kept):
        if text in exact:
            of.append(exact[text])
            continue
        own = runs(norm(text))
        dup = next((p for p, s, f in canonical if not (families and f and not set(families) & set(f)) and own and s and len(own & s) / len(own | s) >= limit), None)
        of.append(dup)
        if dup is None:
            canonical.append((place, own, families))
            exact[text] = place
    return [(i, k, ",".join(f), s, place // 5, of[place]) for place, (i, k, _, f, s) in enumerate(kept)]


@pytest.mark.parametrize("seed", range(3))
def test_chunk_sieve_walks_in_order(spark, seed):
    rng = random.Random(seed)
    pool = ["sun", "moon", "star", "red", "fox", "blue", "owl", "!", "Fox", "blue owl"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.choice([0, 2, 5, 14, 33]))) for _ in range(24)]
    for _ in range(40):
        t = rng.choice(texts).split(" ")
        kind = rng.randrange(4)
        if kind and len(t) > 1:
            t[rng.randrange(len(t))] = rng.choice(pool)
        texts.append(" ".join(t).upper() if kind == 3 else " ".join(t))
    docs = [*enumerate(texts), (900, None), (901, ""), (902, "fox"), (903, "fox"), (904, "† fox"), (905, "word " * 3000 + "fox")]
    df = spark.createDataFrame([(i, f"S{i % 3}", t) for i, t in docs], "id long, source_family string, text string")
    got = sieve.chunk_sieve(df, ALIASES, saver(spark), 12, 4, 1, 5, 0.6).sort("ord").collect()
    place = {r.chunk_id: r.ord for r in got}
    assert [r.ord for r in got] == list(range(len(got)))
    want = _sieve_by_hand(docs, 12, 4, 1, 0.6)
    assert [(r.id, r.chunk_index, ",".join(r.families), r.score, r.batch) for r in got] == [w[:5] for w in want]
    text = {r.ord: r.chunk for r in got}
    for r, w in zip(got, want, strict=True):
        named = None if r.duplicate_id is None else text[place[r.duplicate_id]]
        assert named == (None if w[5] is None else text[w[5]])
    assert any(w[5] is not None for w in want)


def test_sieve_of_nothing(spark):
    df = spark.createDataFrame([(1, "S", None)], "id long, source_family string, text string")
    assert sieve.chunk_sieve(df, ALIASES, saver(spark)).collect() == []


def test_anchors_and_verdicts(spark):
    old = spark.createDataFrame([(1, "the sign, not a proof"), (2, "sign"), (3, None), (4, "SIGN")], "path long, text string")
    now = old.unionByName(spark.createDataFrame([(5, "sign † and mark")], old.schema))
    anchors = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (6,)], "path long")
    a, b = (B.anchor_state(f, anchors, "sign", "not.*proof") for f in (old, now))
    assert {r.path: (r.present, r.has_meaning, r.has_guard) for r in a.collect()} == {1: (True, True, True), 2: (True, True, False), 3: (True, False, False), 4: (True, True, False), 5: (False, None, None), 6: (False, None, None)}
    audit = B.family_audit(old, now, {"sign": ["sign"], "mark": ["mark"], "symbol": ["†"], "none": ["zzz"]})
    assert {r.family: (r.before, r.now, r.state) for r in audit.collect()} == {"sign": (3, 4, "PREEXISTING"), "mark": (0, 1, "TODAY_ONLY"), "symbol": (0, 1, "TODAY_ONLY"), "none": (0, 0, "DARK")}
    verdict = lambda important, needed=3: B.audit_verdict(audit, a, b, important, "symbol", needed).first().asDict()
    assert verdict(["sign"]) == {"anchors_before": 3, "anchors_now": 4, "preexistence": "HARD_PASS", "contained_before": "PASS", "exact_before": "NOT_FOUND", "exact_now": 1, "stable_anchor": "HIGH"}
    assert verdict(["mark"])["preexistence"] == verdict(["sign"], 4)["preexistence"] == "NOT_ESTABLISHED"


def test_an_empty_topic_is_an_error(spark):
    docs = spark.createDataFrame([(1, "A fox", "u1", "the fox ran"), (2, "An owl", None, "fox")], "id long, title string, source_url string, text string")
    index, n = search.postings(docs, {"title": 3.0, "text": 1.5}), docs.selectExpr("count(*) as n")
    with pytest.raises(ValueError):
        search.investigate(index, n, docs, "  ")
    assert search.investigate(index, n, docs, "of").collect() == []
    assert [(r.rank, r.id, r.query) for r in search.investigate(index, n, docs, "Fox").sort("rank").collect()] == [(1, 1, 'all:"Fox"'), (2, 2, 'all:"Fox"')]
