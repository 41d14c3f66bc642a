"""Operators against brute force and worked examples."""

from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions import hashing as H
from siftline.functions import text as T
from siftline.operators import bridges, classify, context, features, graph, merging, pull, search, sieve, state, tfidf
from siftline.plans.storage import saver
from siftline.sources import records, web
from siftline.streaming import passes


def test_tokens_and_chunks(spark):
    df = spark.createDataFrame([(1, "The Quantum-Gravity report of 1999 ab Straße Привет 12345"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.t for r in df.select("id", T.tokens(F.col("text")).alias("t")).collect()}
    assert got == {1: ["quantum-gravity", "stra", "привет"], 2: None, 3: []}
    words = " ".join(f"w{i}" for i in range(400))
    c = sieve.chunk_text(spark.createDataFrame([(1, words), (2, "one two"), (3, None), (4, " ")], "id int, text string")).sort("id", "chunk_index").collect()
    assert [(r.id, r.word_start, r.word_end) for r in c] == [(1, 0, 180), (1, 135, 315), (1, 270, 400), (2, 0, 2)]


def test_cosine_prefixes_lose_no_pair(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["common", "usual", f"rare{rng.randrange(30)}", f"mid{rng.randrange(6)}"]) for _ in range(12))) for i in range(60)]
    df = spark.createDataFrame(docs, "id int, text string")
    v = tfidf.tfidf(tfidf.term_counts(df, T.tokens(F.col("text"))), df.agg(F.count(F.lit(1)).alias("n")))
    rows = {}
    for r in v.collect():
        rows.setdefault(r.id, {})[r.token] = r.weight
    for t in (0.14, 0.4, 0.8):
        want = {(a, b) for a in rows for b in rows if a < b and sum(w * rows[b].get(k, 0) for k, w in rows[a].items()) >= t}
        assert {(r.a, r.b) for r in tfidf.cosine_pairs(v, t).collect()} == want


def test_near_duplicates_walk_in_order(spark):
    rng = random.Random(9)
    for _ in range(3):
        n = 25
        edges = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.12}
        canonical, expected = [], {}
        for i in range(n):
            hit = next((c for c in canonical if (c, i) in edges), None)
            expected[i] = hit
            if hit is None:
                canonical.append(i)
        rows = spark.createDataFrame([(i,) for i in range(n)], "ord long")
        pairs = spark.createDataFrame(sorted(edges) or [(0, 0)], "a long, b long").filter("a < b")
        got = {r.ord: r.duplicate_of for r in sieve.near_duplicates(rows, pairs, saver(spark)).collect()}
        assert got == expected


def test_near_duplicates_of_a_long_chain(spark):
    rows = spark.range(100).toDF("ord")
    pairs = rows.selectExpr("ord AS a", "ord + 1 AS b").filter("b < 100")
    got = {r.ord: r.duplicate_of for r in sieve.near_duplicates(rows, pairs, saver(spark)).collect()}
    assert got == {i: i - 1 if i % 2 else None for i in range(100)}


def test_edges_over_three_passes(spark):
    edge = lambda *rows: spark.createDataFrame(rows, "edge_key string, signature string, target double, confidence double")
    empty = spark.createDataFrame([], "edge_key string, weight double, seen array<string>, misses int")
    first = state.calibrate(edge(("a", "s1", 0.8, 0.2), ("b", "s1", 0.2, None)), empty, "p1")
    r = {x.edge_key: x for x in first.collect()}
    assert r["a"].weight == pytest.approx(0.53) and r["a"].movement == "STRENGTHENED" and r["b"].movement == "STABLE" and r["a"].fresh
    second = state.calibrate(edge(("a", "s1", 0.8, 0.2)), first.select("edge_key", "weight", "seen", "misses"), "p2")
    r = {x.edge_key: x for x in second.collect()}
    assert r["a"].weight == pytest.approx(0.53 + 0.18 * 0.27) and not r["a"].fresh
    assert (r["b"].movement, r["b"].misses, r["b"].observed) == ("WEAKENED_NOT_REOBSERVED", 1, False)
    gone = spark.createDataFrame([("c", 0.05, ["x"], 3)], "edge_key string, weight double, seen array<string>, misses int")
    assert state.calibrate(edge(), gone, "p").first().movement == "DORMANT_CANDIDATE"
    many = spark.createDataFrame([("c", 0.05, [f"{i:03d}" for i in range(64)], 0)], "edge_key string, weight double, seen array<string>, misses int")
    assert state.calibrate(edge(("c", "zzz", 0.5, 0.2)), many, "p").first().seen == [f"{i:03d}" for i in range(1, 64)] + ["zzz"]


def test_attention_rises_then_tires(spark):
    now, seen = None, []
    edges = lambda fresh: spark.createDataFrame([("e", 0.5, True, fresh, 0)], "edge_key string, weight double, observed boolean, fresh boolean, contradictions int")
    for i in range(12):
        prior = [] if now is None else [("e", now.attention, now.streak, now.fresh_events, now.passes)]
        now = state.edge_attention(edges(i == 0), spark.createDataFrame(prior, "edge_key string, attention double, streak int, fresh_events int, passes int")).first()
        seen.append(now.attention)
    assert max(seen) > seen[0] and seen[-1] < max(seen) - 0.1 and now.streak == 11 and now.fresh_events == 1 and now.passes == 12


def test_support_of_a_triangle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("", "d")], "source string, target string")
    got = {(r.a, r.b): r.support for r in graph.topology_support(e).collect()}
    assert got[("a", "b")] == pytest.approx(1 / 2.321928094887362 / 3) and got[("c", "d")] == 0


def test_quota_fills_as_many_slots_as_can_be(spark):
    rng = random.Random(1)
    for _ in range(4):
        quotas = {f: rng.randrange(4) for f in "abcd"}
        rows = [(i, [f for f in "abcde" if rng.random() < 0.4]) for i in range(12)]
        got = bridges.quota_assign(spark.createDataFrame(rows, "id int, families array<string>"), quotas).collect()
        assert len({r.id for r in got}) == len(got) and all(r.family in dict(rows)[r.id] for r in got)
        slots = [f for f, n in quotas.items() for _ in range(n)]
        match: dict[int, int] = {}

        def augment(i, seen):
            for s, f in enumerate(slots):
                if f in rows[i][1] and s not in seen:
                    seen.add(s)
                    if s not in match or augment(match[s], seen):
                        match[s] = i
                        return True
            return False

        assert len(got) == sum(augment(i, set()) for i in range(len(rows)))
        for f, n in quotas.items():
            assert sum(r.family == f for r in got) <= n


def test_pull_takes_lineage_and_refuses_context(spark):
    cols = "id string, ord long, provider string, source_url string, parent_url string"
    seeds = spark.createDataFrame([("s1", 0, "p", "u:s1", None)], cols)
    cands = spark.createDataFrame([("good", 1, "q", "u:g", None), ("child", 2, "p", "u:c", "u:s1"), ("other", 3, "q", "u:o", None), ("next", 4, "q", "u:n", "u:c")], cols)
    v = spark.createDataFrame([("s1", "plasma", 0.8), ("s1", "orb", 0.6), ("good", "plasma", 0.8), ("good", "orb", 0.6), ("other", "tax", 1.0)], "id string, token string, weight double")
    tags = spark.createDataFrame([("s1", "ufo", 0.0), ("other", "ufo", 0.0)], "id string, tag string, weight double")
    dates = spark.createDataFrame([], "id string, date string")
    got = {r.id: r for r in pull.selective_pull(seeds, cands, v, tags, dates, saver(spark)).collect()}
    assert set(got) == {"good", "child", "next"}
    assert got["child"].score == 1 and got["next"].round == 2 and got["good"].status == "SPECULATIVE_SEMANTIC_PULL"
    with pytest.raises(ValueError):
        pull.selective_pull(seeds, cands, v, tags, dates, saver(spark), threshold=0.1)


def test_context_conflicts_follow_arrival(spark):
    cols = "subject string, facet string, field string, value string, source_ref string, signature string, ord long"
    old = spark.createDataFrame([("s", "time", "year", "1950", "a", "h0", 0)], cols)
    new = spark.createDataFrame([("s", "time", "year", "1950", "b", "h1", 1), ("s", "time", "year", "1951", "b", "h2", 2), ("s", "time", "year", "1950", "a", "h0", 3)], cols)
    fresh, clash = context.merge(old, new)
    assert {r.signature for r in fresh.collect()} == {"h1", "h2"}
    assert {(r.value, r.other) for r in clash.collect()} == {("1951", "1950")}


def test_publications_and_versions(spark):
    rows = spark.createDataFrame([(1, "10.1/X", "A title", "Ann", 0.5, "2020", ["a"]), (2, "10.1/x ", "Other", "Bob", 0.7, "2019", ["b"]), (3, None, "A Title!", "Ann", 0.1, "2021", ["c"]), (4, None, "a title", "ann", 0.1, "2020", ["c"]), (5, None, None, None, 0.2, "x", [])], "id long, doi string, title string, first_author string, score double, updated string, families array<string>")
    got = {(r.id, r.versions, tuple(r.families)) for r in merging.dedupe_publications(rows).collect()}
    assert got == {(2, 2, ("a", "b")), (3, 2, ("c",)), (5, 1, ())}
    v = spark.createDataFrame([("k", None, 1), ("k", "2020", 2), ("k", "2020", 3), (None, "x", 4)], "k string, updated string, ord long")
    assert {r.ord for r in merging.dedup_latest(v, "k", "updated", "ord").collect()} == {3, 4}


def test_records_in_every_form(spark, tmp_path):
    lines = [json.dumps({"id": i, "tag": t}) for i, t in enumerate(["palomar nuclear", "nuclear", "x"])]
    plain, packed, doc = tmp_path / "a.jsonl", tmp_path / "b.ndjson.gz", tmp_path / "c.json"
    plain.write_text("\n".join(lines) + "\n")
    packed.write_bytes(gzip.compress("\n".join(lines).encode()))
    doc.write_text(json.dumps([json.loads(x) for x in lines], indent=1))
    schema = "id int, tag string"
    for p in (plain, packed, doc):
        df = records.read_records(spark, str(p), schema)
        assert df.count() == 3 and search.needles(df, all_of=("Palomar", "nuclear"), field="tag").count() == 1
    plain.write_text("\n".join([lines[0], "{broken", "[1]", lines[1]]) + "\n")
    good, bad = records.read_records_lenient(spark, str(plain), schema)
    assert good.count() == 2 and sorted((r.line, r.preview) for r in bad.collect()) == [(2, "{broken"), (3, "[1]")]
    with pytest.raises(Exception):
        records.read_records(spark, str(plain), schema).collect()
    assert records.convert_records(spark, str(plain), str(tmp_path / "out"), schema, "gzip") == {"rows": 2, "malformed": 2}
    csv = tmp_path / "t.csv"
    csv.write_bytes("﻿a,b\n1,2\n".encode())
    assert records.read_table(spark, str(csv)).columns == ["a", "b"]
    for k in ("p1", "p2"):
        records.append_history(good, str(tmp_path / "history"), k)
    assert spark.read.parquet(str(tmp_path / "history")).filter("pass_id = 'p2'").count() == 2


def test_files_and_pins(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text("hello")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "b.md").write_text("no")
    found = records.scan_files(spark, str(tmp_path), (".md",))
    (row,) = found.collect()
    assert row.text == "hello" and row.bytes == 5
    pins = spark.createDataFrame([(row.path, row.sha256), (row.path + "x", "0")], "path string, sha256 string")
    assert {r.state for r in records.verify_pinned(found, pins).collect()} == {"OK", "MISSING"}


def test_pages_feeds_and_headers(spark, tmp_path):
    html = '<html><title> A &amp; B </title><script>var x="</p>";</script><a href="/r/one.json">1</a><a href="/r/one.zip">z</a><a href="/r/One.zip?x">y</a><p>Text&nbsp;here</p></html>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = df.select(web.unescape(web.page_title(F.col("html"))).alias("t"), web.page_text(F.col("html")).alias("x"), web.links(F.col("html")).alias("l")).first()
    assert r.t == "A & B" and "var x" not in r.x and len(r.l) == 3
    assert [tuple(x) for x in web.bulk_listing(df).collect()] == [("one", "/r/one.json", "/r/one.zip")]
    assert {x.id for x in web.collection_listing(df, "/r/").collect()} == {"one.json", "one.zip"}
    feed = tmp_path / "f.xml"
    feed.write_text('<feed><entry><id>http://a/abs/1v1</id><title>T\n x</title><summary>S</summary><published>2026</published><updated>2026</updated><author><name>Ann</name></author><category term="c"/><link rel="alternate" href="h"/><link title="pdf" href="p"/></entry></feed>')
    (e,) = web.atom_feed(spark, str(feed)).collect()
    assert (e.paper_id, e.title, e.authors, e.categories, e.pdf_url, e.abs_url) == ("1v1", "T x", ["Ann"], ["c"], "p", "h")
    card = lambda k, v: f"{k:<8}= {v}".ljust(80)
    fits = tmp_path / "h.fits"
    fits.write_text(card("DATE-OBS", "'12/07/52'") + card("EXPOSURE", "50.0 / minutes") + "END".ljust(80) + card("LATE", "1"))
    cards = {x.key: x.value for x in web.fits_cards(spark.read.format("binaryFile").load(str(fits))).collect()}
    assert cards == {"DATE-OBS": "12/07/52", "EXPOSURE": "50.0"}
    assert str(spark.range(1).select(web.observed_date(F.lit("12/07/52"))).first()[0]) == "1952-07-12"
    inv = spark.sql("select map('b', array(1), 'a', array(0, 2)) m")
    assert inv.select(web.abstract_of(F.col("m"))).first()[0] == "a b a"


def test_features_and_guards(spark):
    with pytest.raises(ValueError):
        features.guard_names(["ok", "label"])
    got = spark.createDataFrame([("1.5",), ("",), ("nan",), ("x",), ("2",)], "v string").select(features.coerce(F.col("v"), "float").alias("f"), features.coerce(F.col("v"), "int").alias("i"), features.coerce(F.lit("Yes"), "bool").alias("b")).collect()
    assert [(r.f, r.i, r.b) for r in got] == [(1.5, None, True), (None, None, True), (None, None, True), (None, None, True), (2.0, 2, True)]
    assert spark.range(1).select(H.fold(F.lit("g"), 7)).first()[0] == int(__import__("hashlib").sha256(b"g").hexdigest()[:16], 16) % 7


def test_stream_digest_ignores_order(spark):
    df = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    assert H.stream_digest(df, "sha").first() == H.stream_digest(df.orderBy(F.rand(1)).repartition(7), "sha").first()


def test_out_of_fold_scores(spark):
    rng = random.Random(0)
    rows = [(i, i % 2, f"g{i % 24}", rng.gauss(i % 2, 0.7), None if i % 9 == 0 else rng.random()) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label int, group string, x double, y double")
    out = classify.train_oof(df, ["x", "y"], "group", 3, ("logistic",)).toPandas()
    assert len(out) == 240 and out.score.between(0, 1).all()
    assert out[out.label == 1].score.mean() > out[out.label == 0].score.mean() + 0.2
    with pytest.raises(ValueError):
        classify.train_oof(df.limit(5), ["x", "y"], "group", 3, ("logistic",))


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"edge_key": "a", "pass_no": 1, "signature": "s1", "target": 0.8, "confidence": 0.2}, {"edge_key": "a", "pass_no": 2, "signature": "s1", "target": 0.8, "confidence": 0.2}]
    (folder / "1.json").write_text(json.dumps(rows[0]) + "\nbroken\n")
    schema = "edge_key string, pass_no int, signature string, target double, confidence double"
    s = passes.read_stream(spark, str(folder), schema)
    q = passes.calibrate_stream(s).writeStream.format("memory").queryName("weights").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    (folder / "2.json").write_text(json.dumps(rows[1]))
    q.processAllAvailable()
    q.stop()
    got = [(r.weight, r.fresh, r.passes) for r in spark.sql("select * from weights order by passes").collect()]
    assert got == [(0.53, True, 1), (0.5786, False, 2)]  # the malformed line is dropped
    corpus = str(tmp_path / "corpus")
    for n in range(2):
        q = passes.search_stream(passes.read_stream(spark, str(folder), schema), all_of=("a",), field="edge_key").writeStream.foreachBatch(passes.merge_into(corpus, "signature", f"s{n}")).option("checkpointLocation", str(tmp_path / f"m{n}")).start()
        q.processAllAvailable()
        q.stop()
    assert passes.read_corpus(spark, corpus).count() == 1


def test_places_and_pairs(spark):
    from siftline.functions import geo, pairs

    one = spark.range(1)
    lit = F.lit
    assert one.select(geo.great_circle_km(lit(0.0), lit(0.0), lit(0.0), lit(180.0))).first()[0] == pytest.approx(20015.1, abs=0.1)
    assert one.select(geo.wrap_lon(lit(190.0))).first()[0] == -170
    r = geo.cap_null(spark, 10.0, 20.0, 2000.0, 40_000, 3).first()
    assert abs(r.p - r.analytic) < 5 * r.se
    assert geo.digest_null(spark, 500).agg(F.sum("n")).first()[0] == 500
    got = one.select(pairs.longest_common_substring(lit("xabcy"), lit("zabcw")).alias("s"), pairs.sequence_ratio(lit("abcd"), lit("abce")).alias("r"), pairs.title_similarity(lit("A b"), lit("a b")).alias("t")).first()
    assert (got.s, got.r) == ("abc", 0.75) and 0 < got.t <= 1


def test_file_helpers(spark):
    from siftline.operators import files

    df = spark.createDataFrame([("on:\n  schedule:\n  push:\n", '{"title": "T", "n": 1}'), ("x", "no json")], "w string, j string")
    got = df.select(*[c.alias(k) for k, c in files.workflow_flags(F.col("w")).items()], files.declared_metadata(F.col("j"), ["title", "author"]).alias("m")).collect()
    assert (got[0].has_schedule, got[0].has_dispatch, got[0].has_push, got[0].m) == (True, False, True, {"title": "T"}) and got[1].m is None
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    packed = files.pack(nodes, spark.createDataFrame([("a", "time", "PARTIAL")], "subject string, facet string, status string"), spark.createDataFrame([("b", 0.5)], "node string, score double"))
    assert {(r.id, r.score, bool(r.facets)) for r in packed.collect()} == {("a", None, True), ("b", 0.5, False)}


STRING = "claim_id origin_agent_id claim_text raw_claim_text claim_kind status evidence_class provenance_channel firsthand_status event_time event_location confidence".split()
GOOD = dict(claim_id="c", origin_agent_id="a", claim_text="t", claim_kind="DERIVED", status="UNRESOLVED", evidence_class="SOURCE_FACT", provenance_channel="INSTRUMENT_RECORD", firsthand_status="FIRSTHAND", source_pointers=["s"], alternative_hypotheses=["x"])
FROZEN = dict(frozen=True, prediction_timestamp="1", deadline_or_window="2", success_criterion="3", failure_criterion="4", analysis_rule="5")
STATED = dict(model="m", conditioning="c", estimation_or_calibration="e", validation="v", uncertainty="u")
HYPOTHESIS = dict(evidence_class="HYPOTHESIS_ONLY", status="HYPOTHESIS_ONLY", falsification_tests=["f"])
CLAIMS = [
    ({}, [], []),
    (dict(claim_id=" "), ["MISSING_CLAIM_ID"], []),
    (dict(origin_agent_id=None), ["MISSING_ORIGIN_AGENT_ID"], []),
    (dict(claim_text="", raw_claim_text="raw"), ["MISSING_CLAIM_TEXT"], []),
    (dict(claim_text=""), ["MISSING_CLAIM_TEXT", "MISSING_RAW_CLAIM_TEXT"], []),
    (dict(claim_kind="GUESS"), ["INVALID_CLAIM_KIND"], []),
    (dict(claim_kind="measured", event_time="1"), [], ["EVENT_LOCATION_NOT_RECORDED"]),
    (dict(claim_kind=None, event_location="x"), [], ["EVENT_TIME_NOT_RECORDED"]),
    (dict(alternative_hypotheses=[]), [], ["ALTERNATIVE_HYPOTHESES_NOT_RECORDED"]),
    (dict(status="OPEN"), ["INVALID_STATUS"], []),
    (dict(status=None), [], []),
    (dict(evidence_class=None), ["MISSING_OR_INVALID_EVIDENCE_CLASS"], []),
    (dict(provenance_channel="RUMOUR"), ["INVALID_PROVENANCE_CHANNEL"], []),
    (dict(provenance_channel=""), ["SOURCE_FACT_REQUIRES_PROVENANCE_CHANNEL"], []),
    (dict(firsthand_status="MAYBE"), ["INVALID_FIRSTHAND_STATUS"], []),
    (dict(confidence="0.9"), ["UNCALIBRATED_CONFIDENCE_FORBIDDEN"], []),
    (dict(confidence="0.9", probability_model=STATED), [], []),
    (dict(probability_model=STATED | dict(model="", validation=None)), ["PROBABILITY_MODEL_MISSING:model,validation"], []),
    (dict(source_pointers=[" "]), ["SOURCE_FACT_REQUIRES_SOURCE_POINTER"], []),
    (dict(status="SOURCE_BOUND_FACT", provenance_channel="HEARSAY_REPORT"), [], ["SOURCE_FACT_IS_REPORT_OCCURRENCE_ONLY_FOR_CONTEXT_CHANNEL"]),
    (dict(evidence_class="FORMAL_DERIVATION", source_pointers=None), ["FORMAL_DERIVATION_REQUIRES_DERIVATION_OR_SOURCE_OBJECT"], []),
    (dict(evidence_class="FORMAL_DERIVATION", status="HYPOTHESIS_ONLY"), ["FORMAL_DERIVATION_STATUS_MISMATCH"], []),
    (dict(evidence_class="REPRODUCIBLE_EXPERIMENT"), ["REPRODUCIBLE_EXPERIMENT_REQUIRES_VERSIONED_EVIDENCE_OBJECT"], []),
    (dict(evidence_class="REPRODUCIBLE_EXPERIMENT", evidence_objects=["e"], status="PROVED_IN_SCOPE"), ["FINITE_EXPERIMENT_CANNOT_BE_PROMOTED_TO_UNIVERSAL_PROOF"], []),
    (dict(evidence_class="STATISTICAL_INFERENCE"), ["STATISTICAL_INFERENCE_REQUIRES_MODEL"], []),
    (dict(evidence_class="STATISTICAL_INFERENCE", status="SUPPORTED_BY_STATISTICAL_INFERENCE_WITH_MODEL"), ["STATISTICAL_INFERENCE_REQUIRES_MODEL", "STATISTICAL_STATUS_REQUIRES_MODEL"], []),
    (dict(evidence_class="STATISTICAL_INFERENCE", statistical_model=dict(target="t", model="", uncertainty="u")), ["STATISTICAL_MODEL_MISSING:model"], []),
    (HYPOTHESIS, [], []),
    (HYPOTHESIS | dict(status="REFUTED"), ["HYPOTHESIS_CANNOT_BE_PROMOTED_AS_EVIDENCE"], []),
    (HYPOTHESIS | dict(falsification_tests=[]), ["HYPOTHESIS_REQUIRES_FALSIFICATION_ROUTE"], ["CLOSED_BELIEF_LOOP_WARNING"]),
    (dict(independent_replication=True), ["INDEPENDENT_REPLICATION_REQUIRES_MULTIPLE_SOURCE_POINTERS", "INDEPENDENT_REPLICATION_REQUIRES_DEPENDENCY_ANALYSIS"], []),
    (dict(independent_replication=True, source_pointers=["a", "b"], independence_evidence=["i"]), [], []),
    (dict(prediction=FROZEN), [], []),
    (dict(prediction=FROZEN | dict(analysis_rule="")), ["FROZEN_PREDICTION_MISSING_CRITERIA"], []),
    (dict(prediction=dict(scored=True)), ["PREDICTION_NOT_FROZEN_BEFORE_SCORING"], []),
    (dict(prediction=FROZEN | dict(post_hoc_redefined=True)), ["NO_POST_HOC_REDEFINITION_TO_SAVE_A_FAILED_PREDICTION"], []),
    (dict(prediction=FROZEN | dict(score="good")), ["INVALID_PREDICTION_SCORE"], []),
    (dict(prediction=FROZEN | dict(score="pass")), [], []),
]


def test_claim_rules_and_values(spark):
    from siftline.operators import rules

    rows = [(change, errors, warnings) for change, errors, warnings in CLAIMS]
    rows += [(dict(flags=[name]), [code], []) for name, code in rules.FLAGS.items()]
    rows += [(dict(status=x), ["DEPRECATED_HEURISTIC_OR_LEGACY_STATUS_FORBIDDEN_FOR_ACTIVE_CLAIM"], []) for x in rules.OLD_STATUSES]
    rows += [(dict(claim_kind=x, event_time="1", event_location="2"), [], []) for x in rules.KINDS] + [(dict(firsthand_status=x), [], []) for x in rules.FIRSTHAND] + [(dict(provenance_channel=x), [], []) for x in rules.CHANNELS]
    rows += [(dict(status=x), [], []) for x in rules.STATUSES if x != "SOURCE_BOUND_FACT"] + [(dict(prediction=FROZEN | dict(score=x)), [], []) for x in rules.SCORES]
    given = spark.createDataFrame([GOOD | change for change, *_ in rows], rules.CLAIM)
    got = [(r.errors, r.warnings, r.admissible) for r in rules.validate_claims(given).coalesce(1).collect()]
    assert got == [(e, w, not e) for _, e, w in rows]
    few = spark.createDataFrame([("c", "a", "t", "SOURCE_FACT")], "claim_id string, origin_agent_id string, claim_text string, evidence_class string")
    assert rules.validate_claims(few).first().errors == ["SOURCE_FACT_REQUIRES_SOURCE_POINTER", "SOURCE_FACT_REQUIRES_PROVENANCE_CHANNEL"]


def test_broken_chains_are_found(spark):
    from siftline.operators import rules

    zero = "0" * 64
    rows = [("a", 1, "x", zero), ("a", 2, "y", "x"), ("a", 3, "z", "y"), ("b", 1, "x", zero), ("b", 2, "y", "q"), ("b", 3, "z", "y"), ("c", 1, "x", "y"), ("d", 1, "x", None)]
    got = {r.g: (r.links, r.intact, r.first_broken) for r in rules.verify_chain(spark.createDataFrame(rows, "g string, i int, sha string, previous string"), "g", "i").collect()}
    assert got == {"a": (3, True, None), "b": (3, False, 2), "c": (1, False, 1), "d": (1, False, 1)}


def test_names_that_leak_are_refused():
    from siftline.operators import features

    for name in (*features.LEAKS, *(f"x_{p}y" for p in features.LEAK_PARTS), "Plate_ID", "NUCLEAR_x"):
        with pytest.raises(ValueError):
            features.guard_names(["ok", name])
    assert features.guard_names(["is_labelled", "targets", "brightness"]) == ["is_labelled", "targets", "brightness"]


def test_rails_and_gates_fail_closed(spark):
    from siftline.operators import features

    base = spark.createDataFrame([(i, f"t{i % 2}") for i in range(4)], "id long, tile string")
    tiles = spark.createDataFrame([("t0", 1), ("t1", 2)], "tile string, area int")
    half = spark.createDataFrame([(0, 1.0), (1, None)], "id long, v double")
    rail = features.feature_rail(base, "id", tiles, "tile", {"s": (half, ["v"])})
    assert {r.id: (r.area, r.s_v, r.features_present) for r in rail.collect()} == {0: (1, 1.0, 2), 1: (2, None, 1), 2: (1, None, 1), 3: (2, None, 1)}
    with pytest.raises(ValueError, match="no side row"):
        features.feature_rail(base, "id", tiles, "tile", {"s": (half, ["v"])}, full=("s",))
    with pytest.raises(ValueError, match="repeats"):
        features.feature_rail(base, "id", tiles, "tile", {"s": (half.union(half), ["v"])})
    with pytest.raises(ValueError, match="leak"):
        features.feature_rail(base, "id", tiles, "tile", {"uap": (half, ["v"])})
    with pytest.raises(ValueError, match="no side row"):
        features.complete_join(base, half, "id")
    gate = lambda **sides: {r.sidecar: (r.status, r.reasons, r.admitted) for r in features.sidecar_gate(sides, base, "id", dict.fromkeys(sides, ["v"]), 0.5).collect()}
    assert gate(a=half) == {"a": ("PASS", [], True)}
    assert gate(a=half, b=half.limit(0)) == {"a": ("PASS", [], False), "b": ("FAIL", ["EMPTY", "LOW_COVERAGE"], False)}
    with pytest.raises(ValueError, match="already"):
        features.sidecar_gate({"a": half}, base, "id", {"a": ["v"]}, present=("a",))


def test_literature_records(spark):
    from siftline.sources import web

    items = spark.createDataFrame([("https://doi.org/10.1/X", None, ["one", "two"], "a" * 13_000), (None, "http://u", [], None)], "DOI string, URL string, title array<string>, abstract string")
    a, b = web.crossref_records(items).collect()
    assert (a.archive_id, a.doi, a.title, len(a.text), a.source_url) == ("10.1/x", "10.1/x", "one", 13_000, "https://doi.org/10.1/x")
    assert max(len(r.text) for r in web.crossref_records(items, most=12_000).collect()) == 12_000
    assert (b.archive_id, b.doi, b.title, b.text, b.source_url, b.provider) == ("http://u", None, "", "", "http://u", "CROSSREF")
    works = spark.createDataFrame([("w1", None, "t", {"b": [1], "a": [0, 2]}), ("w2", "doi:10.2/Y", None, None)], "id string, doi string, title string, abstract_inverted_index map<string,array<int>>")
    a, b = web.openalex_records(works).collect()
    assert (a.archive_id, a.text, a.source_url) == ("w1", "a b a", "w1")
    assert (b.archive_id, b.doi, b.text, b.title, b.source_url, b.review_state) == ("10.2/y", "10.2/y", "", "", "doi:10.2/Y", "UNEXAMINED")
