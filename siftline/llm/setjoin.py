"""N-gram Jaccard join: an exact prefix-index set join that uses relations between sets.

1. Each text becomes the set of its hashed word k-grams. Equal sets are one set
   from here on (grouped by a 128-bit fingerprint). A set so small that no other
   set reaches the threshold with it isn't indexed.
2. A fixed-size table of k-gram counts, summed over all documents, orders k-grams
   from rare to frequent (ties by hash; any order is right, this one keeps index
   lists short). Two sets of Jaccard >= t share at least SHARED k-grams in
   prefixes of |x| - ceil(t|x|) + SHARED of them, so only prefixes are indexed.
3. Index lists of up to list_size entries are sorted by the k-gram's position in
   the sets and cut into blocks. A pair of blocks is skipped when its sizes and
   positions leave no pair that can reach t; pairs of what is left are counted,
   and those that meet SHARED times are candidates. Candidates with one smallest
   neighbour make a group.
4. Longer lists aren't paired up, nor gathered anywhere. Their entries are dealt to
   bands of sizes, and bands with one smallest set form a family. Its sets are
   compared with that set first. Only where a family is still in several
   components are the sets outside its largest one compared with the others, in
   blocks by size and position, of which pairs are skipped as above.
5. A task holds a bounded number of sets and k-grams, and takes its answers from
   one another: it visits similar sets one after the other and derives a set's
   overlaps with all others from those of the set before, by taking off the lists
   of k-grams that went and adding the lists of k-grams that came.
6. Links give components by alternating large-star and small-star rounds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, fresh, hot_join, maybe_among, returning, row_key, slices, sorted_groups, stored, table
from .textbytes import chunks, joined, words

SHARED = 3
LIST = 32
#: Entries of a block of an index list.
BLOCK = 8
#: Slots of the table of counts, which is summed in parts.
SLOT_BITS, PART_BITS = 21, 16
SLOTS, PART = 1 << SLOT_BITS, 1 << PART_BITS
#: K-grams and sets that a task holds, about (a single larger set is a task with its partner).
TASK_GRAMS, TASK_SETS = 1 << 20, 256
#: Bytes of Arrow data after which a batch of sets is handed over.
BATCH_BYTES = 16 << 20
#: Index entries that are worked on at once, and pairs of them after which a batch is handed over.
ENTRIES = 1 << 18
_U = np.uint64


def gram_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-gram hashes of each text, A-Z lower-cased; shorter texts give the hash of all their words, empty ones none."""
    for _, _, buf, off in chunks(texts):
        _, _, h, first = words(buf, off)
        grams, begin = joined(h, first, k)
        for lo, hi in zip(begin[:-1], begin[1:], strict=True):
            own = np.sort(grams[lo:hi])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def fingerprint(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _ceil(t: Fraction, n: np.ndarray | int):
    return -(-(n * t.numerator) // t.denominator)


def _needed(t: Fraction, a, b):
    """The least overlap of sets of a and b k-grams with Jaccard >= t."""
    s = t / (1 + t)
    return -(-((a + b) * s.numerator) // s.denominator)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> _U(64 - SLOT_BITS)).astype(np.int64)


def _counts(k: int):
    """(part, width, n) of a partition's table of counts: the compressed counts of each part, in so many bytes each."""

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, buf, off in chunks(batch.column("text")):
                _, _, h, first = words(buf, off)
                grams, _ = joined(h, first, k)
                total += np.bincount(_slot(grams), minlength=SLOTS)
        for part, own in enumerate(total.reshape(-1, PART)):
            if own.any():
                kind = next(d for d in (np.uint8, np.uint16, np.uint32, np.int64) if own.max() <= np.iinfo(d).max)
                packed = pa.compress(own.astype(kind).tobytes(), codec="zstd", asbytes=True)
                yield pa.record_batch({"part": pa.array([part], pa.int32()), "width": pa.array([np.dtype(kind).itemsize], pa.int32()), "n": pa.array([packed], pa.binary())})

    return returning(run)


def _summed(batches):
    """(part, n): the summed counts of each part that a partition has, as 32-bit integers."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, width, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "width", "n")), strict=True):
            raw = pa.decompress(packed, decompressed_size=width * PART, codec="zstd", asbytes=True)
            own = total.setdefault(part, np.zeros(PART, np.int64))
            own += np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[width]).astype(np.int64)
    for part, own in total.items():
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "n": pa.array([np.minimum(own, np.iinfo(np.int32).max).astype(np.int32).tobytes()], pa.binary())})


def _flushed(rows: Iterator[tuple[int, tuple]], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of (bytes, values) rows of at most 1024 rows or about BATCH_BYTES."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if len(held) == 1024 or size > BATCH_BYTES:
            yield pa.record_batch({c: pa.array(x, kinds[c]) for c, x in zip(kinds, zip(*held, strict=True), strict=True)})
            held, size = [], 0
    if held:
        yield pa.record_batch({c: pa.array(x, kinds[c]) for c, x in zip(kinds, zip(*held, strict=True), strict=True)})


def _signatures(k: int, t: Fraction, order, kind: pa.DataType):
    """(id, k1, k2, fp, n, prefix, often): prefix in order of position, often how many occurrences its k-grams have in the corpus at most."""
    kinds = {"id": kind, "k1": pa.int64(), "k2": pa.int64(), "fp": pa.binary(), "n": pa.int32(), "prefix": pa.list_(pa.int64()), "often": pa.list_(pa.int32())}

    def rows(batches):
        rank = order.value
        for batch in slices(batches, 1024):
            named = zip(*(batch.column(c).to_pylist() for c in ("id", "k1", "k2")), strict=True)
            for (key, k1, k2), grams in zip(named, gram_sets(batch.column("text"), k), strict=True):
                n = len(grams)
                keep = min(n, n - int(_ceil(t, n)) + SHARED)
                by = rank[_slot(grams)]
                if keep < n:
                    part = np.argpartition(by, keep - 1)[:keep] if n else np.zeros(0, np.int64)
                    edge = by[part].max()
                    sure, tied = np.flatnonzero(by < edge), np.flatnonzero(by == edge)
                    part = np.concatenate([sure, tied[: keep - len(sure)]])
                else:
                    part = np.arange(n)
                part = part[np.lexsort((grams[part], by[part]))]
                yield 12 * len(part), (key, k1, k2, fingerprint(grams), n, grams[part].view(np.int64), by[part])

    return returning(lambda batches: _flushed(rows(batches), kinds))


def _can_reach(t: Fraction, s1, s2, p1, p2, low1, low2, lp1, lp2):
    """Whether sets of at most s1 and s2 k-grams that share one at positions of at most p1 and p2 can reach t; low and lp are the least sizes and positions."""
    sizes = (s1 * t.denominator >= low2 * t.numerator) & (s2 * t.denominator >= low1 * t.numerator)
    return sizes & (np.minimum(p1, p2) + np.minimum(s1 - lp1, s2 - lp2) >= _needed(t, low1, low2))


def _list_pairs(t: Fraction):
    """(a, b, na, nb): pairs of sets that meet in an index list, with their sizes."""

    def run(batches):
        for gram, nid, size, pos in _list_runs(batches):
            cut = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]]))
            length = np.diff(cut)
            out: list[tuple] = []
            size_ = 0
            for g in np.unique(length[length > 1]):
                rows = cut[:-1][length == g][:, None] + np.arange(g)
                n, s, p = nid[rows], size[rows], pos[rows]
                edge = np.arange(0, g, BLOCK)
                stop = np.append(edge[1:], g)
                hs, ls = np.maximum.reduceat(s, edge, axis=1), np.minimum.reduceat(s, edge, axis=1)
                hp, lp = np.maximum.reduceat(p, edge, axis=1), np.minimum.reduceat(p, edge, axis=1)
                for x in range(len(edge)):
                    for y in range(x, len(edge)):
                        left = np.flatnonzero(_can_reach(t, hs[:, x], hs[:, y], hp[:, x], hp[:, y], ls[:, x], ls[:, y], lp[:, x], lp[:, y]))
                        if not len(left):
                            continue
                        i, j = np.meshgrid(np.arange(edge[x], stop[x]), np.arange(edge[y], stop[y]), indexing="ij")
                        i, j = (i[i < j], j[i < j]) if x == y else (i.ravel(), j.ravel())
                        i, j = (left[:, None], i), (left[:, None], j)
                        ok = _can_reach(t, s[i], s[j], p[i], p[j], s[i], s[j], p[i], p[j])
                        a, b, na, nb = n[i][ok], n[j][ok], s[i][ok], s[j][ok]
                        swap = a > b
                        out.append((np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)))
                        size_ += len(a)
                        if size_ >= ENTRIES:
                            yield _pair_batch(out)
                            out, size_ = [], 0
            if out:
                yield _pair_batch(out)

    return returning(run)


def _pair_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"a": pa.int64(), "b": pa.int64(), "na": pa.int32(), "nb": pa.int32()}
    return pa.record_batch({c: pa.array(np.concatenate(x), kinds[c]) for c, x in zip(kinds, zip(*out, strict=True), strict=True)})


def _list_runs(batches):
    """Arrays of whole lists from a partition sorted by gram, about ENTRIES at a time; lists are short."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column("gram").to_numpy()
        start = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if (gram != gram[-1]).any() else 0
        if size + start < ENTRIES or start == 0:
            held.append(batch)
            size += batch.num_rows
            continue
        yield _arrays([*held, batch.slice(0, start)])
        held, size = [batch.slice(start)], batch.num_rows - start
    if held:
        yield _arrays(held)


def _arrays(held):
    t = pa.Table.from_batches(held)
    return tuple(t[c].to_numpy() for c in ("gram", "nid", "n", "pos"))


class Family:
    """Overlaps inside a bounded group of sets, each derived from a similar set's."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        _, gram = np.unique(flat, return_inverse=True)
        self.own = np.split(gram, np.cumsum(self.size)[:-1])
        order = np.argsort(gram, kind="stable")
        self.post = owner[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(gram))])
        self.last = -1
        self.cnt = np.zeros(len(sets), np.int64)
        self.derived = 0

    def _lists(self, grams: np.ndarray) -> np.ndarray:
        lo, n = self.at[grams], self.at[grams + 1] - self.at[grams]
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.post[where], minlength=len(self.sets))

    def overlaps(self, i: int) -> np.ndarray:
        """Sizes of the intersections of set i with all sets."""
        if self.last >= 0 and 2 * self.cnt[i] > self.size[i]:
            went = np.setdiff1d(self.own[self.last], self.own[i], assume_unique=True)
            came = np.setdiff1d(self.own[i], self.own[self.last], assume_unique=True)
            if len(went) + len(came) < self.size[i]:
                self.cnt = self.cnt - self._lists(went) + self._lists(came)
                self.last = i
                self.derived += 1
                return self.cnt
        self.cnt, self.last = self._lists(self.own[i]), i
        return self.cnt

    def order(self, visited: np.ndarray) -> Iterator[int]:
        """All sets to visit; each next one overlaps most with the one before, among those left."""
        left = visited.copy()
        i = int(np.argmax(left))
        while left[i]:
            left[i] = False
            yield i
            i = int(np.argmax(np.where(left, self.cnt * 2 - self.size, np.iinfo(np.int64).min)))


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def family_links(sets: list[np.ndarray], visited: np.ndarray, t: Fraction) -> list[tuple[int, int, bool]]:
    """Links of visited sets with all others that join what is linked into trees, and whether the answer that gave each was derived."""
    fam, parent, out = Family(sets), np.arange(len(sets)), []
    for i in fam.order(visited):
        before = fam.derived
        c = fam.overlaps(i)
        hit = c * t.denominator >= (fam.size + fam.size[i] - c) * t.numerator
        hit[i] = False
        for j in np.flatnonzero(hit):
            a, b = _find(parent, i), _find(parent, int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j), fam.derived > before))
    return out


def _join_tasks(t: Fraction):
    """Links of each task, from rows sorted by task."""

    def run(batches):
        for group in sorted_groups(batches, "task"):
            nid = group["nid"].to_numpy()
            sets = [np.frombuffer(x, _U) for x in group["grams"].to_pylist()]
            found = family_links(sets, group["visited"].to_numpy().astype(bool), t)
            if found:
                a, b, derived = zip(*found, strict=True)
                yield pa.record_batch({"a": pa.array(nid[list(a)], pa.int64()), "b": pa.array(nid[list(b)], pa.int64()), "derived": pa.array(derived)})

    return returning(run)


def _grams_of(k: int):
    kinds = {"nid": pa.int64(), "fp": pa.binary(), "own": pa.binary(), "grams": pa.binary()}

    def rows(batches):
        for batch in slices(batches, 1024):
            named = zip(batch.column("nid").to_pylist(), batch.column("fp").to_pylist(), strict=True)
            for (nid, fp), grams in zip(named, gram_sets(batch.column("text"), k), strict=True):
                yield grams.nbytes, (nid, fp, fingerprint(grams), grams.tobytes())

    return returning(lambda batches: _flushed(rows(batches), kinds))


def _dealt(rows: DataFrame, group: str, bound: tuple[int, int]) -> DataFrame:
    """rows (group, nid, n, ...) with block: sets dealt by hash to blocks of about bounded k-grams and sets in each group."""
    grams, sets = bound
    size = rows.groupBy(group).agg(F.ceil(F.greatest(F.sum("n") / grams, F.count(F.lit(1)) / sets)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m"))
    return hot_join(rows, size, [group], "m").withColumn("block", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int")).drop("blocks")


class Links:
    """signed: a row for each document; sets: a row for each distinct set; found: links that connect all that are linked."""

    def __init__(self, docs: DataFrame, k: int, threshold: float, id_col: str, text_col: str, list_size: int = LIST, task_grams: int = TASK_GRAMS, task_sets: int = TASK_SETS):
        self.t, self.k = Fraction(str(threshold)), k
        self.bound = (max(1, task_grams // 2), max(1, task_sets // 2))
        k1, k2 = row_key(id_col, text_col)
        rows = docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).cast("string").alias("text"))
        self.order = self._order(rows)
        kind = dict(rows.dtypes)["id"]
        schema = f"id {kind}, k1 long, k2 long, fp binary, n int, prefix array<long>, often array<int>"
        arrow = pa.string() if kind == "string" else getattr(pa, {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8"}.get(kind, kind))()
        signatures = stored(rows.mapInArrow(_signatures(k, self.t, self.order, arrow), schema), "signatures")
        firsts = signatures.filter("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.min(F.struct("k1", "k2")).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("often").alias("often"))
        indexed = stored(firsts.withColumn("nid", F.monotonically_increasing_id()), "sets")
        # prefixes are kept as long as the index is built, no longer
        self.signed = stored(signatures.drop("prefix", "often"), "signed")
        discard(signatures)

        lists, long_ = self._index(indexed, list_size)
        members = stored(self._families(long_), "members")
        pairs = stored(self._candidates(lists), "pairs")
        self.sets = stored(indexed.drop("prefix", "often"), "sets")
        discard(indexed, *self.spent)
        groups, stars = self._groups(pairs), self._stars(members)
        tasks = groups.unionByName(stars)
        grams = self._grams(rows, tasks)
        found = self._joined(tasks, grams, "links")
        roots = components(found.select("a", "b"))
        rest = self._rest(members, roots)
        if rest.isEmpty():
            self.found, self.roots = found, roots
        else:
            more = self._joined(rest, grams, "links")
            self.found = found.unionByName(more)
            # the stars found so far stand for their links
            self.roots = components(roots.toDF("a", "b").unionByName(more.select("a", "b")))
        discard(members, pairs, groups, stars, grams, rest)

    def _order(self, rows: DataFrame):
        counted = rows.select("text").mapInArrow(_counts(self.k), "part int, width int, n binary")
        summed = counted.repartition("part").mapInArrow(_summed, "part int, n binary").toArrow()
        rank = np.zeros((SLOTS // PART, PART), np.int32)
        for part, own in zip(summed["part"].to_pylist(), summed["n"], strict=True):
            rank[part] = np.frombuffer(own.as_buffer(), np.int32)
        return rows.sparkSession.sparkContext.broadcast(rank.ravel())

    def _index(self, sets: DataFrame, list_size: int) -> tuple[DataFrame, DataFrame]:
        """(entries of lists of at most list_size, entries of longer lists); lists of one entry are left out."""
        t = self.t
        least = -(-t.numerator // (t.denominator - t.numerator)) if t < 1 else 1 << 31
        entries = sets.filter(F.col("n") >= least).select("nid", "n", F.posexplode(F.arrays_zip("prefix", "often")).alias("pos", "e")).select("nid", "n", "pos", F.col("e.prefix").alias("gram"), F.col("e.often").alias("often")).filter("often > 1")
        many = entries.filter(F.col("often") > list_size).drop("often")
        sizes = stored(many.groupBy("gram").agg(F.count(F.lit(1)).alias("length")).filter("length > 1").withColumn("m", F.col("length")), "lengths")
        many = stored(hot_join(maybe_among(many, sizes, "gram"), sizes, ["gram"], "m").filter("length > 1"), "lists")
        self.spent = [sizes, many]
        short = entries.filter(F.col("often") <= list_size).drop("often").unionByName(many.filter(F.col("length") <= list_size).drop("length"))
        return short, many.filter(F.col("length") > list_size).drop("length")

    def _candidates(self, lists: DataFrame) -> DataFrame:
        """(a, b, na, nb) of sets that meet often enough in short lists."""
        s = self.t / (1 + self.t)
        need = F.expr(f"((na + nb) * {s.numerator}L + {s.denominator - 1}L) div {s.denominator}L")
        sorted_ = lists.repartition("gram").sortWithinPartitions("gram", "pos", "n", "nid")
        met = sorted_.mapInArrow(_list_pairs(self.t), "a long, b long, na int, nb int").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("met"))
        return met.filter(F.col("met") >= F.least(F.lit(SHARED).cast("long"), need)).drop("met")

    def _groups(self, pairs: DataFrame) -> DataFrame:
        """Tasks of candidate pairs. A pair belongs to the group of its first set's smallest neighbour; a large group is split into blocks, and each pair goes to the task of its two blocks."""
        near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hub = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("hub"))
        # steps of which more than one reads the rows are stored, so that no plan holds them several times
        hubs = own = stored(pairs.join(hub, pairs["a"] == hub["u"]).drop("u"), "hubs")
        sets = own.select("hub", F.col("a").alias("nid"), F.col("na").alias("n")).unionByName(own.select("hub", F.col("b").alias("nid"), F.col("nb").alias("n"))).distinct()
        grams, most = self.bound
        blocks = sets.groupBy("hub").agg(F.ceil(F.greatest(F.sum("n") / grams, F.count(F.lit(1)) / most)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m"))
        at = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
        own = hot_join(own, blocks, ["hub"], "m").withColumn("task", F.xxhash64("hub", at("a"), at("b"), F.lit("group")))
        ends = F.array(F.struct(F.col("a").alias("nid"), F.lit(1).alias("visited")), F.struct(F.col("b").alias("nid"), F.lit(0).alias("visited")))
        out = stored(own.select("task", F.inline(ends)).groupBy("task", "nid").agg(F.max("visited").alias("visited")), "tasks")
        discard(hubs)
        return out

    def _families(self, entries: DataFrame) -> DataFrame:
        """(fam, nid, n, low, high): members of families, with the least and greatest position of the k-grams that they share."""
        band = F.floor(F.log("n") / (math.log(float(1 / self.t)) * (1 + 1e-9) if self.t < 1 else 1.0))
        both = entries.withColumn("band", band).withColumn("lower", F.explode(F.array(F.lit(1), F.lit(0)))).withColumn("band", F.col("band") - 1 + F.col("lower"))
        fams = both.groupBy("gram", "band").agg(F.min("nid").alias("fam"), F.count(F.lit(1)).alias("m"), F.max("lower").alias("any")).filter("m > 1 and any = 1").select("gram", "band", "fam", "m")
        return hot_join(both, fams, ["gram", "band"], "m").filter("fam IS NOT NULL").groupBy("fam", "nid").agg(F.first("n").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"))

    def _stars(self, members: DataFrame) -> DataFrame:
        """Tasks that compare a family's sets with its smallest one."""
        others = _dealt(members.filter("nid != fam"), "fam", self.bound)
        others = stored(others.select(F.xxhash64("fam", "block", F.lit("star")).alias("task"), "fam", "nid"), "stars")
        out = stored(others.select("task", "nid", F.lit(0).alias("visited")).unionByName(others.select("task", F.col("fam").alias("nid"), F.lit(1).alias("visited")).distinct()), "tasks")
        discard(others)
        return out

    def _rest(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """Tasks for families of several components: blocks of sets outside the largest component against all blocks that sizes and positions don't rule out."""
        t, s = self.t, self.t / (1 + self.t)
        named = stored(members.join(roots, members["nid"] == roots["node"], "left").select("fam", "nid", "n", "low", "high", F.coalesce("root", "nid").alias("c")), "named")
        counts = named.groupBy("fam", "c").agg(F.count(F.lit(1)).alias("m"))
        main = counts.groupBy("fam").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m")).filter("parts > 1").drop("parts")
        kinds = stored(hot_join(named, main, ["fam"], "m").filter("main IS NOT NULL").withColumn("kind", F.xxhash64("fam", (F.col("c") != F.col("main")), F.floor(F.log("n") / 0.05), F.floor(F.log2(F.col("low") + 1)))), "kinds")
        discard(named)
        dealt = stored(_dealt(kinds, "kind", self.bound).withColumn("block", F.xxhash64("kind", "block")), "blocks")
        discard(kinds)
        about = dealt.groupBy("fam", "block").agg(F.max(F.col("c") != F.col("main")).alias("odd"), F.min("n").alias("ln"), F.max("n").alias("hn"), F.min("low").alias("lp"), F.max("high").alias("hp"), F.min("c").alias("lc"), F.max("c").alias("hc"))
        x, y = (about.select("fam", *[F.col(c).alias(f"{c}{i}") for c in about.columns if c != "fam"]) for i in (1, 2))
        need = F.expr(f"((ln1 + ln2) * {s.numerator}L + {s.denominator - 1}L) div {s.denominator}L")
        reach = (F.col("hn1") * t.denominator >= F.col("ln2") * t.numerator) & (F.col("hn2") * t.denominator >= F.col("ln1") * t.numerator) & (F.least("hp1", "hp2") + F.least(F.col("hn1") - F.col("lp1"), F.col("hn2") - F.col("lp2")) >= need)
        apart = ~((F.col("lc1") == F.col("hc1")) & (F.col("lc2") == F.col("hc2")) & (F.col("lc1") == F.col("lc2")))
        pairs = x.filter("odd1").join(y, "fam").filter((~F.col("odd2") | (F.col("block1") <= F.col("block2"))) & reach & apart)
        task = stored(pairs.select("fam", "block1", "block2", F.xxhash64("fam", "block1", "block2", F.lit("rest")).alias("task")), "met")
        first = task.select("fam", F.col("block1").alias("block"), "task", F.lit(1).alias("visited"))
        second = task.filter("block1 != block2").select("fam", F.col("block2").alias("block"), "task", F.lit(0).alias("visited"))
        out = stored(first.unionByName(second).join(dealt.select("fam", "block", "nid"), ["fam", "block"]).select("task", "nid", "visited"), "tasks")
        discard(dealt, task)
        return out

    def _grams(self, rows: DataFrame, tasks: DataFrame) -> DataFrame:
        """(nid, grams) of every set of a task, from the text of one document that has it."""
        needed = tasks.select("nid").distinct().join(self.sets.select("nid", "fp", F.col("row.k1").alias("k1"), F.col("row.k2").alias("k2")), "nid")
        texts = maybe_among(rows.drop("id"), needed, "k1").join(needed, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("nid", "fp", "text")
        return stored(texts.mapInArrow(_grams_of(self.k), "nid long, fp binary, own binary, grams binary").filter("fp = own").select("nid", "grams"), "grams")

    def _joined(self, tasks: DataFrame, grams: DataFrame, name: str) -> DataFrame:
        shipped = tasks.join(grams, "nid").repartition("task").sortWithinPartitions("task", "nid")
        return stored(shipped.mapInArrow(_join_tasks(self.t), "a long, b long, derived boolean"), name)

    def named(self) -> DataFrame:
        """(fp, copies, root) of each distinct set; root names its component."""
        return self.sets.select("nid", "fp", "copies", "id").join(self.roots, self.sets["nid"] == self.roots["node"], "left").select("fp", "copies", "id", F.coalesce("root", "nid").alias("root"))


def _contracted(batches):
    """The links of each batch as stars: (u, v) with v the smallest node that u reaches in the batch."""
    for batch in batches:
        parent: dict[int, int] = {}
        root = lambda x: _find(parent, x)
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
            parent[max(a, b)] = min(a, b)
        stars = [(u, v) for u in parent if (v := root(u)) != u]
        if stars:
            u, v = zip(*stars, strict=True)
            yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def components(found: DataFrame) -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node of its component.

    A batch's links become stars in its task; alternating large-star and small-star
    joins them up: each round is a min per node (which pre-aggregates) and a join of
    it back to the links, one row a node; adaptive skew joins split the links of a hub.
    """
    links = found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = stored(links.mapInArrow(_contracted, "u long, v long"), "edges")
    state = lambda: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state()
    while True:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # a link may come several times here; the round's result is distinct
        large = near.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").filter("x != m").select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, stored(small, "edges")
        discard(last)
        now = state()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def jaccard_components(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs.

    component_id is the smallest id reachable over links of Jaccard >= threshold
    between sets of word k-grams. Null and empty texts have no k-grams and are
    linked with nothing: their component is their own id. Rows with equal sets
    are linked, also where ids repeat; null ids are passed over in the minimum.
    An empty table gives no rows; ids are integers or strings.
    """
    own = Links(docs, k, threshold, id_col, text_col, **bounds)
    roots = own.named()
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    named = stored(roots.join(least, "root").select("fp", "copies", "component_id"), "components")
    full = hot_join(own.signed.filter("n > 0").select("id", "fp", "n"), named, ["fp"], "copies").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")
    empty = own.signed.filter("n = 0").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.unionByName(empty)


def one_of_each(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """docs with one row of each component of near duplicates: that of the smallest id (null ids last; of rows that share it, by a hash of the text).

    Rows are told apart by id and text, so a row linked with nothing stays
    whatever its id. Of rows that agree in both one stays. Null and empty texts
    are linked with nothing and all stay.
    """
    own = Links(docs, k, threshold, id_col, text_col, **bounds)
    named = stored(own.named().select("fp", "copies", "root"), "components")
    rows = hot_join(own.signed.filter("n > 0").select("id", "fp", "k1", "k2"), named, ["fp"], "copies")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("first")).select("first.k1", "first.k2")
    by_row = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"))
    out = by_row.join(first, ["k1", "k2"], "left_anti").select("k1", "k2")
    a, b = fresh("k1"), fresh("k2")
    k1, k2 = row_key(id_col, text_col)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns({a: k1, b: k2})
    kept = keyed.join(out.toDF(a, b), [a, b], "left_anti")
    again = stored(by_row.filter("rows > 1").select("k1", "k2").toDF(a, b), "repeated")
    if again.isEmpty():
        return kept.select(columns)
    return kept.join(again, [a, b], "left_anti").unionByName(kept.join(again, [a, b], "left_semi").dropDuplicates([a, b])).select(columns)


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 0.9)
