"""Set join, line dedup and decontamination against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from siftline.llm import decontam, lines, setjoin

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows, k, threshold):
    t = Fraction(str(threshold))
    sets = []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= t * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = find(i)
            least[r] = min(least.get(r, key), key)
    return sorted(((key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)), key=repr)


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("k", "threshold", "bounds"), [(3, 0.9, {}), (5, 0.8, {"list_size": 4, "task_grams": 2000}), (3, 0.9, {"list_size": 3, "task_grams": 10**6}), (3, 0.9, {"list_size": 2, "task_sets": 4}), (5, 0.8, {"task_sets": 3})])
def test_components_equal_brute_force(spark, k, threshold, bounds):
    rng = random.Random(k)
    texts = near_copies(60, 120, 6, 1) + near_copies(20, 40, 3, 2) + near_copies(12, 400, 20, 3)
    texts += [" ".join(f"w{rng.randrange(80)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += ["A B", "a b", "a", "", None, "   ", texts[0], texts[0].upper(), "a b c", "A  b\tc\n"]
    rows = list(enumerate(texts)) + [(3, "other words under one id"), (None, texts[5]), (None, None), (None, "alone here now")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, setjoin.jaccard_components(df, k, threshold, **bounds).collect()), key=repr)
    expected = [(a, b, None if a is None and not b else c) for a, b, c in brute_components(rows, k, threshold)]
    assert got == sorted(expected, key=repr)


def test_blocks_are_skipped_only_where_no_pair_can_reach():
    """Every pair of sets that reaches t, of lists of any length, is among the pairs of each list that both are in."""
    import numpy as np
    import pyarrow as pa

    t, rng = Fraction(4, 5), np.random.default_rng(0)
    base = rng.choice(400, 60, replace=False)
    sets = [np.sort(np.unique(np.concatenate([base[rng.random(60) > 0.1], rng.integers(0, 400, rng.integers(0, 12))]))) for _ in range(60)]
    entries = sorted((g, p, len(x), i) for i, x in enumerate(sets) for p, g in enumerate(x))
    batch = pa.record_batch({c: pa.array(v, pa.int64() if c in ("gram", "nid") else pa.int32()) for c, v in zip(("gram", "pos", "n", "nid"), zip(*entries, strict=True), strict=True)})
    got = {}
    for out in setjoin._list_pairs(t)([batch.slice(0, 500), batch.slice(500)]):
        for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True):
            got[a, b] = got.get((a, b), 0) + 1
    linked = 0
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(x, sets[j]))
            if both >= t * len(np.union1d(x, sets[j])):
                linked += 1
                assert got[i, j] == both
    every = sum(n * (n - 1) // 2 for n in np.unique([e[0] for e in entries], return_counts=True)[1])
    assert linked and sum(got.values()) < every


def test_overlaps_are_derived_from_similar_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.choice(10**6, 200, replace=False)
    sets = [np.unique(np.concatenate([base[: 200 - e], rng.integers(10**6, 10**7, e)])).astype(np.uint64) for e in range(12)]
    fam = setjoin.Family(sets)
    for i in fam.order(np.ones(12, bool)):
        assert fam.overlaps(i).tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]
    assert fam.derived >= 8


def test_answers_are_derived_and_large_families_split(spark):
    """A large group of near copies in one long list: tasks stay small, most answers are derived, and no link is lost."""
    texts = near_copies(400, 60, 3, 5) + near_copies(30, 80, 4, 6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    own = setjoin.Links(df, 3, 0.9, "doc_id", "text", task_sets=64)
    assert own.found.filter("derived").count() > 0
    got = sorted(map(tuple, setjoin.jaccard_components(df, 3, 0.9, task_sets=64).collect()))
    assert got == sorted(brute_components(list(enumerate(texts)), 3, 0.9))


def test_many_short_texts_of_one_phrase(spark):
    """Sets of six 3-grams can only be linked to equal ones at 0.9 and aren't indexed; those of nine and ten can."""
    n = 100_000
    df = spark.range(n).selectExpr("id AS doc_id", "concat('thank you very much dear ', id % 50000, ' and bye') AS text")
    more = [(n + i, "one two three four five six seven eight nine ten eleven" + " twelve" * i) for i in range(2)]
    got = setjoin.jaccard_components(df.unionByName(spark.createDataFrame(more, "doc_id long, text string")), 3, 0.9)
    assert got.filter(f"doc_id < {n} and component_id != doc_id % 50000").count() == 0
    assert {tuple(r) for r in got.filter(f"doc_id >= {n}").collect()} == {(n, 9, n), (n + 1, 10, n)}


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BATCH_BYTES", 1000)
    rng = random.Random(8)
    long_ = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, long_), (2, long_ + " more words at the end"), (3, "w1 " * 200_000), (4, None)]
    got = {tuple(r) for r in setjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).collect()}
    assert {(a, c) for a, _, c in got} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_one_row_of_each_component_stays(spark):
    a = "some words that make one text of a dozen words and then more of them"
    rows = [(1, a, "x"), (3, a + " end", "y"), (3, "linked with nothing at all under the same id", "z"), (5, "twice the very same row is here", "p"), (5, "twice the very same row is here", "p"), (6, None, "q"), (6, "", "q"), (6, "", "q"), (None, a + " end too", "n"), (None, "alone without any id among all", "n"), (None, "alone without any id among all", "n")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, k1 string, root int").repartition(3)
    got = sorted(((r.doc_id, r.text, r.k1, r.root) for r in setjoin.one_of_each(df).collect()), key=repr)
    assert got == sorted(((*rows[i], 7) for i in (0, 2, 3, 5, 6, 7, 9)), key=repr)
    assert setjoin.one_of_each(df.limit(0)).count() == 0
    names = spark.createDataFrame([("b", a), ("a", a + " end"), ("c", "else")], "name string, body string")
    assert {r.name for r in setjoin.one_of_each(names, id_col="name", text_col="body").collect()} == {"a", "c"}


def test_components_of_an_empty_table(spark):
    assert setjoin.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_lines(rows):
    """(id, text) rows with distinct ids or equal texts, in order of id."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    first, gone = {}, {}
    for i in order:
        if rows[i][1] is None:
            continue
        own = rows[i][1].split("\n")
        for p in range(max(1, len(own) - 2)):
            key = (min(len(own), 3), *own[p : p + 3])
            where = (rows[i][0], p)
            if first.setdefault(key, where) != where:
                gone.setdefault(i, set()).update(range(p, min(p + 3, len(own))))
    return [(k, t, 0, 0) if t is None else (k, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(i, ())), len(t.split("\n")), len(gone.get(i, ()))) for i, (k, t) in enumerate(rows)]


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 12))) for _ in range(80)] + ["", None, "a", "a", "a\nb", "a\nb", "\n\n\n", "x" * 200_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "q\nr\ns\nt")]
    df = spark.createDataFrame([(k, t, "old", 9) for k, t in rows], "doc_id long, text string, source string, n_removed int").repartition(3)
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr) == sorted(brute_lines(rows), key=repr)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_decontamination_finds_exact_and_substituted_passages(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.randrange(16, 50)))) for i in range(30)] + [(98, "too short"), (99, None)]
    docs, truth = [], set()
    for d in range(120):
        own = [word() for _ in range(rng.randrange(0, 200))]
        if d % 3 == 0:
            i, text = items[d % 30]
            part = text.split()
            if d % 2:
                for at in range(3, len(part), 9):
                    part[at] = word()
            at = rng.randrange(len(own) + 1)
            own[at:at] = [w.capitalize() + "," for w in part]
            truth.add((d, i))
        docs.append((d, " ".join(own)))
    docs += [(500, None), (501, ""), (502, "too short"), (503, items[3][1][:40]), (0, items[7][1])]
    truth.add((0, 7))
    ddf = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string").repartition(3)
    bdf = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(ddf.drop("item_id"), bdf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    kept = {r.doc_id for r in decontam.clean(ddf, bdf).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in truth}
    assert decontam.contaminated(ddf.limit(0), bdf).count() == 0
    assert decontam.contaminated(ddf, bdf.limit(0)).count() == 0


def test_benchmark_blocks_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"t{i}x{j}" for j in range(20))) for i in range(8)]
    docs = spark.createDataFrame([(i, "start " + t + " end") for i, t in items], "doc_id long, text string")
    whole = set(map(tuple, decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()))
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 40)
    assert set(map(tuple, decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect())) == whole
    assert {(a, b) for a, b, *_ in whole} == {(i, i) for i in range(8)}


def brute_overlaps(rows, items):
    """(id, item, matched, overlap) of the best alignment of every pair whose window agrees enough, by trying all alignments."""
    cut = lambda t: [x for x in re.split(r"[\s!-/:-@\[-`{-~]+", (t or "").lower()) if x]
    import numpy as np

    out, number = {}, {}
    code = lambda t: np.array([number.setdefault(x, len(number)) for x in cut(t)], np.int64)
    coded = [(item, code(body)) for item, body in items]
    for key, text in rows:
        d = code(text)
        for item, it in coded:
            if len(it) < decontam.SPAN:
                continue
            for start in range(-len(it) + 1, len(d)):
                lo = max(0, -start)
                n = min(len(it) - lo, len(d) - start - lo)
                wide = min(n, decontam.WINDOW)
                if wide < decontam.SPAN:
                    continue
                total = np.concatenate([[0], np.cumsum(it[lo : lo + n] == d[start + lo : start + lo + n])])
                if (total[wide:] - total[:-wide]).max() >= -(-wide * 4 // 5):
                    out[key, item] = max(out.get((key, item), (0, 0)), (int(total[-1]), n))
    return {(*k, *v) for k, v in out.items()}


def test_matched_and_overlap_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([10, 12, 15, 16, 24, 40])))) for i in range(12)]
    docs = []
    for d in range(60):
        own = [word() for _ in range(rng.randrange(0, 40))]
        part = items[d % 12][1].split()
        part = part[rng.randrange(0, 5) :] if d % 4 == 0 else part
        for at in range(d % 7, len(part), 8):
            part[at] = word()
        own[len(own) // 2 : len(own) // 2] = part
        docs.append((d, " ".join(own)))
    docs += [(90, items[0][1] + " " + items[1][1] + " " + items[0][1]), (91, None), (92, "word " * 120_000 + items[4][1])]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute_overlaps(docs[:-1], items) | {(92, 4, len(items[4][1].split()), len(items[4][1].split()))}


def test_seeds_survive_substitutions_at_every_length():
    import itertools
    import math

    masks = [[i for i, x in enumerate(m) if x == "1"] for m in decontam.MASKS]
    for n in range(decontam.SPAN, decontam.WINDOW + 1):
        lost = [set(c) for c in itertools.combinations(range(n), n - math.ceil(n * decontam.SHARE))]
        hit = sum(any(not any(a + i in c for i in m) for m in masks for a in range(n - m[-1])) for c in lost)
        assert hit >= 0.98 * len(lost), n


def test_rows_are_cleaned_by_their_own_text(spark):
    item = " ".join(f"t{i}" for i in range(20))
    rows = [(1, "x " + item, 5), (1, "another text under that id", 6), (None, item, 7), (None, "fine", 8), (2, None, 9), (3, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    got = decontam.clean(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got.columns == df.columns and sorted(r.item_id for r in got.collect()) == [6, 8, 9, 9]


def test_long_lines_between_different_neighbours_stay(spark):
    """A line of over 50 words is a window of its own only in a text of one line; the window is three lines."""
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{line}\nb"), (2, f"c\n{line}\nd"), (3, f"x\na\n{line}\nb\ny"), (4, line), (5, line)]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _k1 int, _gone int")).collect()}
    assert got == {1: 0, 2: 0, 3: 3, 4: 0, 5: 1}


def test_rows_that_may_be_among_keys(spark):
    from siftline.llm.shared import hot_join, maybe_among

    rows = spark.range(3000).selectExpr("id", "xxhash64(id) AS h", "id % 7 AS k")
    keys = rows.filter("id % 100 = 3").select("h")
    got = {r.id for r in maybe_among(rows, keys, "h").collect()}
    assert {i for i in range(3000) if i % 100 == 3} <= got and len(got) < 60
    found = rows.filter("k < 5 OR id > 2990").groupBy("k").agg(F.min("id").alias("least"), F.count("h").alias("m")).filter("k != 2")
    want = {(r.id, None if r.k == 2 else {0: 0, 1: 1, 3: 3, 4: 4}.get(r.k, 2991 + (r.k - 2991) % 7)) for r in rows.collect()}
    assert {(r.id, r.least) for r in hot_join(rows, found, ["k"], "m").collect()} == want


def test_items_of_any_length(spark):
    """What is broadcast is split among blocks, also inside an item, and a long alignment is verified once."""
    long_ = [f"tok{i * 7919 % 100_003}" for i in range(30_000)]
    changed = [("other" if i % 9 == 4 else w) for i, w in enumerate(long_)]
    docs = [(1, "before " + " ".join(changed) + " after"), (2, " ".join(long_[25_000:25_020])), (3, "nothing of it here at all, but ten words and more")]
    items = [(7, " ".join(long_)), (8, " ".join(f"tok{i}" for i in range(20)))]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_tokens=8_000)
    equal = sum(a == b for a, b in zip(long_, changed, strict=True))
    assert {tuple(r) for r in got.collect()} == {(1, 7, equal, 30_000), (2, 7, 20, 20)}


def test_prefixes_and_counts_stay_small(spark):
    import numpy as np
    import pyarrow as pa

    texts = [" ".join(f"w{(7 * i + j) % 900}" for j in range(120)) for i in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    own = setjoin.Links(df, 3, 0.9, "doc_id", "text")
    assert not {"prefix", "often"} & {*own.signed.columns, *own.sets.columns}
    rank = own.order.value
    seen = np.zeros(setjoin.SLOTS, np.int64)
    for grams, t in zip(setjoin.gram_sets(pa.array(texts), 3), texts, strict=True):
        assert len(grams) == len(t.split()) - 2
        np.add.at(seen, setjoin._slot(grams), 1)
    assert (rank == seen).all()
    counted = df.select("text").mapInArrow(setjoin._counts(3), "part int, width int, n binary")
    assert counted.count() <= 4 * setjoin.SLOTS // setjoin.PART
    assert counted.agg({"width": "max"}).first()[0] == 1


def test_no_plan_holds_a_step_many_times(spark, monkeypatch):
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(pool) for _ in range(30)) for _ in range(6)]
    texts = [t + f" x{i}" for t in texts for i in range(8)]
    scans, keep = {}, setjoin.stored

    def counted(df, name, *more):
        scans[name] = max(scans.get(name, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return keep(df, name, *more)

    monkeypatch.setattr(setjoin, "stored", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert setjoin.jaccard_components(df, 3, 0.9, list_size=3).count() == len(texts)
    assert max(scans.values()) <= 16, scans
