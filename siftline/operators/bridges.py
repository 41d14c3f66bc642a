"""Bridges between papers and topics: phrase families, routes, quotas, snapshots, concepts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftline.functions.text import norm_tokens
from siftline.operators.phrases import lexicon, substrings, whole_words
from siftline.plans.pairs import pairs_within


#: So many lines of a lexicon are looked for one by one in a text; more are joined by their beginnings.
FEW = 64


def _met(rows: DataFrame, aliases: DataFrame, whole: bool, gates: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(id, gates, family, alias, title) for every alias in a row's title or body; title: whether it is in the title. whole: on whole words alone.

    gates(title, body), of the normalised texts, goes along. Title and body are searched apart, so no phrase crosses from one to the other.
    """
    lines = lexicon(aliases)
    title, body = (norm_tokens(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "body"))
    texts = rows.select("id", F.array_join(title, " ").alias("_t"), F.array_join(body, " ").alias("_b"))
    gate = (gates(F.col("_t"), F.col("_b")) if gates else F.lit(None)).alias("gates")
    if lines.limit(FEW + 1).count() <= FEW:
        edge = F.lit(" " if whole else "")
        found = [F.contains(F.concat(edge, F.col(c), edge), F.col("_p")) for c in ("_t", "_b")]
        phrases = lines.select("family", "alias", F.concat(edge, F.array_join("words", " "), edge).alias("_p"))
        return texts.select("id", gate, "_t", "_b").crossJoin(F.broadcast(phrases)).filter(found[0] | found[1]).select("id", "gates", "family", "alias", found[0].alias("title"))
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    words = texts.select("id", gate, F.size(split("_t")).alias("_n"), F.concat(split("_t"), F.array(F.lit("")), split("_b")).alias("w"))
    return (whole_words if whole else substrings)(words, aliases).select("id", "gates", "family", "alias", (F.col("at") < F.col("_n")).alias("title"))


def _scored(met: DataFrame) -> DataFrame:
    """(id, family, score, hits) of found aliases: 2 where one is in the title, else 1, plus up to 1 for the number of aliases found."""
    g = met.groupBy("id", "family").agg(F.max(F.when(F.col("title"), 2.0).otherwise(1.0)).alias("base"), F.countDistinct("alias").alias("hits"))
    return g.select("id", "family", (F.col("base") + F.least(F.lit(1.0), 0.15 * F.col("hits"))).alias("score"), "hits")


def match_substring(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, family, score, hits): aliases found in title or body, also inside words. rows: (id, title, body), one for each id."""
    return _scored(_met(rows, aliases, False))


def match_strict(rows: DataFrame, aliases: DataFrame, context: dict[str, list[str]] | None = None, generic: str | None = None) -> DataFrame:
    """Like match_substring on whole words; a family with context terms needs one of them in the text, and a lone generic family is dropped."""

    def gates(title: Column, body: Column) -> Column:
        spaced = F.concat(F.lit(" "), title, F.lit("  "), body, F.lit(" "))
        open_ = [F.when(reduce(lambda a, c: a | c, [F.contains(spaced, F.lit(f" {x} ")) for x in terms]), F.lit(family)) for family, terms in (context or {}).items()]
        return F.array_compact(F.array(*open_, F.lit(None).cast("string")))

    met = _met(rows, aliases, True, gates)
    out = _scored(met.filter(~F.col("family").isin(list(context or {})) | F.array_contains("gates", F.col("family"))))
    if generic is not None:
        out = out.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("id"))).filter((F.col("family") != generic) | (F.col("_n") > 1)).drop("_n")
    return out


def keyword_weight(word: str) -> float:
    """Several words weigh more than one."""
    return 1.35 if " " in word else 1.0


def match_conjunctive(text: Column, groups: list[list[str]]) -> Column:
    """The summed weight of found keywords if every group has one, else 0."""
    every = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in g]) for g in groups])
    return F.when(every, sum((F.when(F.contains(text, F.lit(w)), keyword_weight(w)).otherwise(0.0) for g in groups for w in g), F.lit(0.0))).otherwise(0.0)


def match_keywords(text: Column, words: list[str], least: int = 2) -> Column:
    """The summed weight of found keywords if at least so many are found, else 0."""
    hits = [F.contains(text, F.lit(w)) for w in words]
    n = sum((h.cast("int") for h in hits), F.lit(0))
    return F.when(n >= least, sum((F.when(h, keyword_weight(w)).otherwise(0.0) for h, w in zip(hits, words, strict=True)), F.lit(0.0))).otherwise(0.0)


def keyword_rank(rows: DataFrame, operators: dict[str, list[str]], most: int = 12) -> DataFrame:
    """(operator, path, score, rank): each operator's best paths. rows: (path, text)."""
    scored = rows.select("path", F.explode(F.array(*[F.struct(F.lit(o).alias("operator"), match_keywords(F.col("text"), w).alias("score")) for o, w in operators.items()])).alias("x")).select("path", "x.operator", "x.score").filter("score > 0")
    w = W.partitionBy("operator").orderBy(F.round("score", 6).desc(), "path")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def snapshot_relations(before: DataFrame, now: DataFrame) -> DataFrame:
    """(operator, before, now, state): hits of each operator at two snapshots. Both: (operator, path)."""
    a = before.groupBy("operator").agg(F.countDistinct("path").alias("before"))
    b = now.groupBy("operator").agg(F.countDistinct("path").alias("now"))
    both = a.join(b, "operator", "fullouter").select("operator", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("now", F.lit(0)).alias("now"))
    return both.withColumn("state", F.when(F.col("before") > 0, "PREEXISTING").when(F.col("now") > 0, "TODAY_ONLY").otherwise("DARK"))


def family_files(files: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """(family, path): files whose text matches one of a family's patterns, case aside. files: (path, text)."""
    hit = F.array_compact(F.array(*[F.when(F.col("text").rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in families.items()]))
    return files.select("path", F.explode(hit).alias("family")).select("family", "path").distinct()


def anchor_state(files: DataFrame, anchors: DataFrame, meaning: str, guard: str) -> DataFrame:
    """(path, present, sha256, has_meaning, has_guard): what a snapshot holds at the anchors' paths; null beside a path that it lacks.

    anchors: (path). files: (path, text), one for each path; a null text counts as empty.
    """
    own = files.withColumn("_t", F.coalesce("text", F.lit(""))).select("path", F.lit(True).alias("_in"), F.sha2("_t", 256).alias("sha256"), F.col("_t").rlike(f"(?is){meaning}").alias("has_meaning"), F.col("_t").rlike(f"(?is){guard}").alias("has_guard"))
    return anchors.select("path").distinct().join(own, "path", "left").select("path", F.coalesce("_in", F.lit(False)).alias("present"), "sha256", "has_meaning", "has_guard")


def family_audit(before: DataFrame, now: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """(family, before, now, state): files of every family at two snapshots; families without a file have zeros. Both: (path, text)."""
    sides = [family_files(f, families).withColumnRenamed("family", "operator") for f in (before, now)]
    every = before.sparkSession.createDataFrame([(f,) for f in families], "family string")
    found = every.join(snapshot_relations(*sides).withColumnRenamed("operator", "family"), "family", "left")
    return found.select("family", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("state", F.lit("DARK")).alias("state"))


def audit_verdict(audit: DataFrame, anchors_before: DataFrame, anchors_now: DataFrame, important: list[str], exact: str, needed: int = 3) -> DataFrame:
    """One row: anchors with a meaning at both snapshots, and what follows for the earlier one.

    A meaning was there before if enough anchors had it and any important family
    had a file; the exact family is judged by itself.
    """
    count = lambda a, name: a.agg(F.count(F.when(F.col("has_meaning"), 1)).alias(name))
    sums = audit.agg(F.coalesce(F.sum(F.when(F.col("family").isin(important), F.col("before"))), F.lit(0)).alias("_i"), F.coalesce(F.sum(F.when(F.col("family") == exact, F.col("before"))), F.lit(0)).alias("_e"), F.coalesce(F.sum(F.when(F.col("family") == exact, F.col("now"))), F.lit(0)).alias("exact_now"))
    row = count(anchors_before, "anchors_before").crossJoin(count(anchors_now, "anchors_now")).crossJoin(sums)  # one row each
    preexists = (F.col("anchors_before") >= needed) & (F.col("_i") > 0)
    return row.select(
        "anchors_before",
        "anchors_now",
        F.when(preexists, "HARD_PASS").otherwise("NOT_ESTABLISHED").alias("preexistence"),
        F.when(F.col("anchors_before") > 0, "PASS").otherwise("FAIL").alias("contained_before"),
        F.when(F.col("_e") > 0, "PASS").otherwise("NOT_FOUND").alias("exact_before"),
        "exact_now",
        F.when(preexists, "HIGH").otherwise("UNRESOLVED").alias("stable_anchor"),
    )


def hub_ranking(rows: DataFrame, prior: DataFrame, most: int = 25) -> DataFrame:
    """Paths by how many operators reach them, then by score; known tells whether the prior snapshot had the path."""
    g = rows.groupBy("path").agg(F.countDistinct("operator").alias("operators"), F.sum("score").alias("score"))
    out = g.join(prior.select("path").distinct().withColumn("_k", F.lit(True)), "path", "left").select("path", "operators", "score", F.coalesce("_k", F.lit(False)).alias("known"))
    return out.orderBy(F.col("operators").desc(), F.round("score", 6).desc(), "path").limit(most)


def anchor_routes(rows: DataFrame, routes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, anchors): existing anchors of a row's families, distinct, in order of family. rows: (id, families)."""
    f = rows.select("id", F.posexplode("families").alias("pos", "family"))
    hit = f.join(F.broadcast(routes), "family").join(F.broadcast(anchors.select("anchor")), "anchor", "left_semi")
    first = hit.groupBy("id", "anchor").agg(F.min(F.struct("pos", "place")).alias("o"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "anchor"))), lambda x: x["anchor"]).alias("anchors"))


def lineage_pairs(rows: DataFrame, title: float = 0.5, author: float = 0.3) -> DataFrame:
    """(a, b, authors, titles) of works that share an author and are alike in authors and title words. rows: (id, authors, words)."""
    who = rows.select("id", F.explode("authors").alias("who"))
    pairs = pairs_within(who, ["who"], "id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    x = rows.toDF("a", "aa", "wa")
    y = rows.toDF("b", "ab", "wb")
    j = lambda p, q: F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", j("aa", "ab").alias("authors"), j("wa", "wb").alias("titles"))
    return both.filter((F.col("authors") >= author) & (F.col("titles") >= title))


def quota_assign(rows: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(id, family): each id fills at most one slot of one of its families, and as many slots are filled as can be.

    rows: (id, families). Rows are counted by their set of families in Spark; a
    maximum flow from those few sets to the quotas is found on the driver, and
    spread back by rank. Which ids fill the slots of a set follows their order.
    """
    known = sorted(quotas)
    own = rows.select("id", F.array_sort(F.array_distinct(F.filter("families", lambda f: f.isin(known)))).alias("families")).filter(F.size("families") > 0)
    key = F.array_join("families", "|")
    # at most 2 ** len(quotas) sets
    sizes = {r["k"]: r["n"] for r in own.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    flow: dict[tuple[str, str], int] = {}
    used = dict.fromkeys(known, 0)

    def push(k: str, seen: set[str]) -> bool:
        for f in k.split("|"):
            if f in seen:
                continue
            seen.add(f)
            if used[f] < quotas[f]:
                used[f] += 1
                flow[k, f] = flow.get((k, f), 0) + 1
                return True
            for (other, g), n in list(flow.items()):
                if g == f and n and other != k and push(other, seen):
                    flow[other, f] -= 1
                    flow[k, f] = flow.get((k, f), 0) + 1
                    return True
        return False

    for k in sorted(sizes):
        for _ in range(min(sizes[k], sum(quotas[f] for f in k.split("|")))):
            if not push(k, set()):
                break
    spans, at = [], {}
    for (k, f), n in sorted(flow.items()):
        if n:
            spans.append((k, f, at.get(k, 0), at.get(k, 0) + n))
            at[k] = at.get(k, 0) + n
    table = rows.sparkSession.createDataFrame(spans, "k string, family string, lo long, hi long")
    ranked = own.select("id", key.alias("k")).withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("id")) - 1)
    return ranked.join(F.broadcast(table), "k").filter((F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).select("id", "family")


def concept_coverage(files: DataFrame, concepts: dict[str, str], most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(files per concept and repository, evidence rows): a literal or pattern per concept; most evidence rows a concept and repository. files: (repo, path, text)."""
    hits = files.select("repo", "path", F.explode(F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(c)) for c, p in concepts.items()]))).alias("concept"))
    w = W.partitionBy("repo", "concept").orderBy("path")
    return hits.groupBy("repo", "concept").agg(F.countDistinct("path").alias("files")), hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def route_topk(scored: DataFrame, most: int = 80, id_col: str = "id") -> DataFrame:
    """The `most` records of the highest route_score, ties by id; a top-k report."""
    return scored.orderBy(F.col("route_score").desc(), F.col(id_col).cast("string")).limit(most)


def _routed(scored: DataFrame) -> DataFrame:
    """(id, families, route_score) from (id, family, score)."""
    return scored.groupBy("id").agg(F.array_sort(F.collect_set("family")).alias("families"), F.round(F.sum("score"), 6).alias("route_score"))


def assemble_bridges(papers: DataFrame, aliases: DataFrame, routes: DataFrame, anchors: DataFrame, sources: DataFrame, most: int = 80) -> DataFrame:
    """(source_id, kind, families, route_score, anchors): given sources, and the `most` best papers that have a family.

    papers: (id, title, body); sources: (id, families), all kept without a score.
    A source or paper of no anchored family has an empty list.
    """
    live = route_topk(_routed(match_substring(papers, aliases)), most).select(F.col("id").cast("string"), F.lit("CANDIDATE").alias("kind"), "families", "route_score")
    known = sources.select(F.col("id").cast("string"), F.lit("CANONICAL").alias("kind"), "families", F.lit(None).cast("double").alias("route_score"))
    rows = known.unionByName(live)
    out = rows.join(anchor_routes(rows, routes, anchors), "id", "left")
    return out.select(F.col("id").alias("source_id"), "kind", "families", "route_score", F.coalesce("anchors", F.array().cast("array<string>")).alias("anchors"))


def strict_refine(papers: DataFrame, candidates: DataFrame, aliases: DataFrame, context: dict[str, list[str]] | None = None, generic: str | None = None) -> DataFrame:
    """(id, kept, families, route_score, old_families): candidates matched again by match_strict; those without a family are kept = false.

    candidates: (id, families).
    """
    # papers that are no candidates go with the join below; what is matched is small, texts aren't shuffled
    again = _routed(match_strict(papers, aliases, context, generic))
    both = candidates.select("id", F.col("families").alias("old_families")).join(again, "id", "left")
    return both.select("id", F.col("families").isNotNull().alias("kept"), "families", "route_score", "old_families")


def work_lineages(works: DataFrame, sequence=None) -> DataFrame:
    """(a, b, authors, titles, abstracts, families, strong): pairs of works that may share their core result.

    works: (id, title, authors, title_words, abstract_words, families), all but id
    and title as sets. Pairs without a common author can't pass, so they are found
    by author. sequence(a, b), a Column function, may vouch for titles by 0.72.
    """
    who = works.select("id", F.explode("authors").alias("who"))
    pairs = pairs_within(who, ["who"], "id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    left, right = ([F.col("id").alias(k)] + [F.col(c).alias(f"{k}_{c}") for c in works.columns if c != "id"] for k in "ab")
    both = pairs.join(works.select(*left), "a").join(works.select(*right), "b")
    j = lambda c: F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(f"a_{c}", f"b_{c}")), F.size(F.array_union(f"a_{c}", f"b_{c}"))), F.lit(0.0)), 6)
    x = both.select("a", "b", "a_title", "b_title", j("authors").alias("authors"), j("title_words").alias("titles"), j("abstract_words").alias("abstracts"), j("families").alias("families"))
    x = x.filter("authors >= 0.34 and abstracts >= 0.3")
    alike = F.col("titles") >= 0.45
    if sequence is not None:
        alike = alike | (sequence(F.col("a_title"), F.col("b_title")) >= 0.72)
    strong = (F.col("authors") >= 0.5) & (F.col("abstracts") >= 0.4) & alike
    related = (F.col("titles") >= 0.35) & (F.col("families") >= 0.5)
    return x.withColumn("strong", strong).filter(F.col("strong") | related).drop("a_title", "b_title")


def enrich_routes(bridges: DataFrame, routes: DataFrame, anchors: DataFrame) -> DataFrame:
    """bridges (source_id, families, ...) with anchors of the given routes and routed, which tells whether there is one."""
    b = bridges.drop("anchors", "routed")
    found = anchor_routes(b.select(F.col("source_id").alias("id"), "families"), routes, anchors).withColumnRenamed("id", "source_id")
    out = b.join(found, "source_id", "left")
    return out.withColumn("routed", F.col("anchors").isNotNull()).withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))
