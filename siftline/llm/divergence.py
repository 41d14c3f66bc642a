"""Source divergence audit: how far apart the term distributions of a language's sources are.

Groups are (language, source). Terms of a language that are in enough of its
documents are kept; a group gives each a smoothed probability in billionths. Two
groups' divergence sums floor((p - q)^2 / (p + q)) over all kept terms, also over
those that one or both of them lack, all in integers.

Pairs of groups are rows of a sparse matrix times itself, accumulated row by row
(Gustavson): a task holds a block of terms as a term-major index; each group
scatters the index rows of its terms into a dense accumulator over its peers, so
no pair of postings is ever a row. A term that a group lacks has the group's zero
baseline there. The accumulators hold what differs from baselines alone: one-sided
for all of a group's terms, corrected where a peer has the term too; the baselines
of all kept terms are added once. Tasks are bounded in postings and in peers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.plans.ordered import running_sums

from .manifest import ascii_lower
from .shared import stored, table

#: What separates terms.
SEPARATORS = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: A kept term is in so many documents of its language.
LEAST_DOCS = 10
SCALE = 1_000_000_000
#: Ranks that part ``term`` lists.
TERMS = 10
#: Groups of a block; a task holds two blocks at most.
PEERS = 1024
#: Bounds on the postings of a task; between them four for each pair of groups.
POSTINGS = (1 << 13, 1 << 20)


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in decimals where longs would overflow; null without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    part = F.call_function("div", wide(count + 2) * F.lit(SCALE).cast("decimal(11,0)"), wide(total + 2 * terms))
    return F.when(terms > 0, F.lit(1).cast("long") + part)


def distance(p, q):
    """floor((p - q)^2 / (p + q)) of arrays of integers; 0 where both are."""
    return (p - q) * (p - q) // np.maximum(p + q, 1)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and documents with it. Nulls count as empty strings."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    terms = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.split(ascii_lower(text(text_col)), SEPARATORS).alias("terms"))
    # every occurrence, then every distinct term
    each = terms.select("lang", "source", F.size("terms").alias("size"), F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term")).filter("term != ''")
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("at") < F.col("size")).alias("n"), F.count_if(F.col("at") >= F.col("size")).alias("docs"))


class Audit:
    """peers: a row for each group, numbered in its language; own: its kept terms with their p and their language's q."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", peers: int = PEERS, postings: tuple[int, int] = POSTINGS):
        self.peers_of_block = peers
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        counts = stored(term_counts(docs, text_col, lang_col, source_col), "terms")
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("all_n")).filter(F.col("df") >= least_docs).drop("df")
        own = stored(counts.drop("docs").join(kept, ["lang", "term"]), "kept")
        sizes = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("postings"))
        groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct().join(sizes, ["lang", "source"], "left").na.fill(0, ["total", "postings"])
        groups = running_sums(groups.withColumn("one", F.lit(1).cast("long")), ["lang", "source"], {"before": "one"}, lambda df: stored(df, "groups"))
        terms = own.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("lang_total"))
        langs = groups.groupBy("lang").agg(F.min("before").alias("first"), F.count(F.lit(1)).alias("peers"), F.sum("postings").alias("lang_postings")).join(terms, "lang", "left").na.fill(0, ["terms", "lang_total"])
        groups = groups.join(langs, "lang").withColumn("i", F.col("before") - F.col("first"))
        zero = F.coalesce(probability(F.lit(0).cast("long"), F.col("total"), F.col("terms")), F.lit(0))
        most = F.greatest(F.lit(postings[0]), F.least(F.lit(postings[1]), 4 * F.col("peers") * F.col("peers")))
        blocks = F.greatest(F.lit(1), F.ceil(F.col("lang_postings") / most)).cast("int")
        self.peers = stored(groups.select("lang", "source", "i", "peers", "total", "terms", "lang_total", zero.alias("zero"), blocks.alias("blocks")), "peers")
        named = own.join(self.peers.select("lang", "source", "i", "peers", "total", "terms", "lang_total", "blocks"), ["lang", "source"])
        p = probability(F.col("n"), F.col("total"), F.col("terms"))
        q = probability(F.col("all_n"), F.col("lang_total"), F.col("terms"))
        self.own = stored(named.select("lang", "source", "term", "i", "peers", "blocks", p.alias("p"), q.alias("q")), "index")

    def _tasks(self, rows: DataFrame, block: Column) -> DataFrame:
        """rows with block, x and y: the blocks of terms and of peers whose tasks need them."""
        of = F.floor(F.col("i") / self.peers_of_block).cast("int")
        out = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("peers") - 1) / self.peers_of_block).cast("int"))))
        return out.withColumns({"x": F.least(of, "other"), "y": F.greatest(of, "other")})

    def pairs(self) -> DataFrame:
        """(lang, a, b, value): the divergence of all pairs a < b of a language's groups."""
        keys = ["lang", "block", "x", "y"]
        index = self._tasks(self.own, F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).select(*keys, "i", "term", "p")
        peers = self._tasks(self.peers, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, "i", "zero", "terms")
        found = index.groupBy(keys).cogroup(peers.groupBy(keys)).applyInArrow(_accumulator(self.peers_of_block), "lang string, a long, b long, value long")
        return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    def ranked_pairs(self) -> DataFrame:
        both = stored(self.pairs(), "pairs")
        both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
        name = lambda c: self.peers.select("lang", F.col("i").alias(c), F.col("source").alias({"a": "source", "b": "item"}[c]))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return both.join(name("a"), ["lang", "a"]).join(name("b"), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))

    def ranked_terms(self, ranks: int = TERMS) -> DataFrame:
        value = F.expr("((p - q) * (p - q)) div (p + q)")
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        over = self.own.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
        return over.withColumn("rank", rank).filter(F.col("rank") <= ranks)


def _accumulator(peers_of_block: int) -> Callable:
    return lambda key, index, peers: accumulated(key, index, peers, peers_of_block)


def accumulated(key: tuple, index: pa.Table, peers: pa.Table, peers_of_block: int = PEERS) -> pa.Table:
    """What a block of terms adds to each pair of peers; the first block adds the baselines of all terms."""
    lang, block, x, y = (k.as_py() for k in key)
    order = np.argsort(peers["i"].to_numpy(), kind="stable")
    name, zero = peers["i"].to_numpy()[order], peers["zero"].to_numpy()[order].astype(np.int64)
    n = len(name)
    total = np.zeros((n, n), np.int64)
    if index.num_rows:
        term = index["term"].combine_chunks().dictionary_encode()
        at = term.indices.to_numpy().astype(np.int64)
        who = np.searchsorted(name, index["i"].to_numpy())
        p = index["p"].to_numpy().astype(np.int64)
        by = np.lexsort((who, at))
        row_of, peer_of, p_of = at[by], who[by], p[by]
        begin = np.concatenate([[0], np.cumsum(np.bincount(row_of, minlength=len(term.dictionary)))])
        for g in np.unique(who):
            mine = np.flatnonzero(who == g)
            value, times = np.unique(p[mine], return_counts=True)
            base = distance(zero[g], zero)
            step = max(1, (1 << 21) // n)
            for lo in range(0, len(value), step):
                one_sided = distance(value[lo : lo + step, None], zero[None, :]) - base
                total[g] += times[lo : lo + step] @ one_sided
            rows, own = at[mine], p[mine]
            length = begin[rows + 1] - begin[rows]
            cell = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            later = peer_of[cell] > g
            cell, own = cell[later], np.repeat(own, length)[later]
            h, q = peer_of[cell], p_of[cell]
            np.add.at(total[g], h, distance(own, q) - distance(own, zero[h]) - distance(zero[g], q) + base[h])
    total += total.T
    if block == 0:
        total += peers["terms"][0].as_py() * distance(zero[:, None], zero[None, :])
    a, b = np.triu_indices(n, 1)
    if x != y:
        apart = (name[a] // peers_of_block == x) & (name[b] // peers_of_block == y)
        a, b = a[apart], b[apart]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(name[a], pa.int64()), "b": pa.array(name[b], pa.int64()), "value": pa.array(total[a, b], pa.int64())})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **bounds) -> DataFrame:
    """(lang, source, part, item, value, rank), ranks from 1 in each group and part by value from the greatest, then item.

    Part ``pair``: every other source of the language, and the divergence of the
    two groups. Part ``term``: the group's terms that are likelier in it than in
    the whole language, and what each adds to their divergence, up to ranks.

    Null texts, languages and sources count as empty strings. A group of empty
    texts has its peers but no terms; a language without kept terms has pairs of
    value 0, one of a single source has none. Repeated rows count as often as they
    occur. An empty table gives no rows, further columns aren't read.
    """
    audit = Audit(docs, least_docs, text_col, lang_col, source_col, **bounds)
    return audit.ranked_pairs().unionByName(audit.ranked_terms(ranks))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
seen AS (SELECT doc_id, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM seen GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM seen SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counts GROUP BY lang, source),
probs AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN sizes s USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM probs a JOIN probs b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM probs WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms)
WHERE rank <= 10
"""
