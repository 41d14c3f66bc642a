"""Language-model scoring by cross-entropy difference (Moore-Lewis).

Two interpolated bigram models, matched in order, vocabulary and smoothing: the
target's counts come from the documents labelled good, the background's from all
documents. Words and pairs of words are counted apart, each under its own 64-bit
hash, in tables that grow with the corpus: documents are dealt to blocks of
bounded size, each block sends its distinct keys with their counts to the tasks
that own a range of keys, and gets back the corpus's counts of just those keys.
Nothing is broadcast. A document's score is the mean over its tokens of
background loss minus target loss: higher means closer to the target. The counts of
all documents of the same text (which have a key of their own) are left out of
both models while it is scored, so that having been learned from, itself or as a
copy, is no advantage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunkwords import hashes
from .shared import shuffle_parts, table
from .textbytes import chunks, mix, words

#: Number of words that the uniform estimate under both models' unigrams spreads its mass over.
VOCABULARY = 1 << 18
#: Weight of the bigram estimate's prior on the unigram estimate, in counts.
PRIOR = 2.0
#: Weight, in counts, of the background's unigrams in both models' unigrams.
SHRINK = 0.5 * VOCABULARY
#: Bytes of text that a block has about.
BLOCK = 1 << 25
_U = np.uint64
#: Key of the place before a text's first word.
_OPEN = _U(0x5851F42D4C957F2D)


def _seats(spark: SparkSession, n: int) -> list[int]:
    """Numbers that hash partitioning deals to n partitions one by one."""
    at = spark.range(32 * n).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k"))
    found = {r["p"]: r["k"] for r in at.collect()}
    return [found.get(p, p) for p in range(n)]


def _dealt(docs: DataFrame, target: DataFrame, seats: list[int], id_col: str, text_col: str) -> DataFrame:
    """(id, text, hit, block): documents, and the ids of the target as rows with hit, dealt to blocks by id; null ids are no target and are dealt by text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(False).alias("hit"))
    ids = target.select(F.col(id_col).cast(rows.schema["id"].dataType).alias("id")).filter("id is not null").distinct().select("id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("hit"))
    at = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(len(seats))).cast("int")
    return rows.unionByName(ids).withColumn("block", F.element_at(F.lit(seats), at + 1)).repartition(len(seats), "block")


def _keys(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words and of pairs (each word with the one before), first words, and keys of whole texts."""
    _, _, w, first = words(buf, off)
    prev = np.empty(len(w), _U)
    prev[1:] = w[:-1]
    prev[first[:-1][first[:-1] < first[1:]]] = _OPEN
    return w, mix(prev * _U(0x9E3779B97F4A7C15) + mix(w)), first, mix(hashes(buf, off[:-1], off[1:])[0] ^ _OPEN)


def _texts(block: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whether learned from, word keys, pair keys, first words, text keys) of runs of a block's documents."""
    ids = block.filter(block["hit"])["id"].combine_chunks()
    for batch in block.filter(pc.invert(block["hit"])).to_batches():
        if not batch.num_rows:
            continue
        target = pc.is_in(batch.column("id"), value_set=ids).to_numpy(zero_copy_only=False)
        for lo, hi, buf, off in chunks(batch.column("text")):
            yield batch.column("id").slice(lo, hi - lo), target[lo:hi], *_keys(buf, off)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, byte by byte of the numbers, compressed."""
    rows = np.stack([c.astype(_U) for c in columns])
    return pa.Codec("zstd", 1).compress(rows.view(np.uint8).reshape(*rows.shape, 8).transpose(0, 2, 1).tobytes(), asbytes=True)


def _unpack(data: bytes, n: int, columns: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(data, columns * n * 8, asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(columns, 8, n).transpose(0, 2, 1).copy().view(_U).reshape(columns, n)


_ASKED = "seat int, bucket int, block int, n long, words long, target_words long, keys binary"
_FOUND = "block int, bucket int, n long, words long, target_words long, counts binary"


def _distinct(runs: list[tuple]) -> np.ndarray:
    """The sorted distinct keys of a block."""
    return np.unique(np.concatenate([np.array([_OPEN]), *(run[k] for run in runs for k in (2, 3, 5))]))


def _asking(seats: list[int]) -> Callable:
    """Function of a block to its distinct keys with its own counts of them, by ranges of keys."""
    starts = np.array([(i << 64) // len(seats) for i in range(len(seats))], _U)

    def run(block: pa.Table) -> pa.Table:
        runs = list(_texts(block))
        keys = _distinct(runs)
        count = np.zeros((2, len(keys)), np.int64)
        total = [0, 0]
        for _, target, w, pair, first, text in runs:
            n = np.diff(first)
            good = np.repeat(target, n)
            for row, (keep, has, whole) in enumerate(((slice(None), n > 0, slice(None)), (good, (n > 0) & target, target))):
                for x in (w[keep], pair[keep], text[whole]):
                    own, times = np.unique(x, return_counts=True)
                    count[row, np.searchsorted(keys, own)] += times
                count[row, np.searchsorted(keys, _OPEN)] += int(has.sum())
                total[row] += len(w[keep])
        cuts = [*np.searchsorted(keys, starts).tolist(), len(keys)]
        rows = [(s, i, lo, hi) for i, (s, lo, hi) in enumerate(zip(seats, cuts[:-1], cuts[1:], strict=True))] if runs else []
        step = np.diff(keys, prepend=_U(0))
        step[[lo for _, _, lo, hi in rows if lo < hi]] = keys[[lo for _, _, lo, hi in rows if lo < hi]]
        me = block["block"][0].as_py()
        out = [(s, i, me, hi - lo, *total, _pack(step[lo:hi], count[0, lo:hi], count[1, lo:hi])) for s, i, lo, hi in rows]
        kinds = [pa.int32()] * 3 + [pa.int64()] * 3 + [pa.binary()]
        names = [x.split()[0] for x in _ASKED.split(", ")]
        return pa.table([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names=names)

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """Counts of the whole corpus for the keys of a range that each block asks for, in the order asked."""
    n = asked["n"].to_numpy()
    parts = [_unpack(data, k, 3) for data, k in zip(asked["keys"].to_pylist(), n.tolist(), strict=True)]
    keys, at = np.unique(np.concatenate([np.cumsum(p[0], dtype=_U) for p in parts]), return_inverse=True)
    counts = np.zeros((2, len(keys)), np.int64)
    for row in (0, 1):
        np.add.at(counts[row], at, np.concatenate([p[row + 1] for p in parts]).astype(np.int64))
    cuts = [0, *np.cumsum(n).tolist()]
    found = [_pack(*counts[:, at[lo:hi]]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    one = asked.filter(pc.equal(asked["bucket"], asked["bucket"][0]))
    totals = [pa.array(np.full(len(n), pc.sum(one[c]).as_py()), pa.int64()) for c in ("words", "target_words")]
    return pa.table([asked["block"], asked["bucket"], asked["n"], *totals, pa.array(found, pa.binary())], names=[x.split()[0] for x in _FOUND.split(", ")])


def fit(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Both models: how documents are dealt to blocks (seats), and each block's keys' counts in the corpus. target holds the ids of the documents that the target model learns from; null texts count as empty."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    seats = _seats(docs.sparkSession, max(shuffle_parts(docs.sparkSession), -(-size // BLOCK)))
    asked = _dealt(docs, target, seats, id_col, text_col).groupBy("block").applyInArrow(_asking(seats), _ASKED)
    return {"seats": seats, "counts": asked.repartition(len(seats), "seat").groupBy("seat").applyInArrow(_answer, _FOUND)}


def _own(doc: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """How often the token's key occurs in the token's own document."""
    _, where, n = np.unique(doc * most + at, return_inverse=True, return_counts=True)
    return n[where]


def _losses(model: dict, doc: np.ndarray, w: np.ndarray, prev: np.ndarray, pair: np.ndarray, n: np.ndarray, text: np.ndarray) -> dict:
    """Loss of each token under both models, without the counts of documents of its text. w, prev, pair and text are places in the models' tables."""
    most = len(model["background"])
    own = {k: _own(doc, at, most) for k, at in (("w", w), ("pair", pair))}
    own["prev"] = np.where(prev == model["open"], 1, np.concatenate([[0], own["w"][:-1]])) if len(w) else own["w"]
    copies = {name: model[name][text][doc] for name in ("background", "target")}
    base = model["background"]
    uniform = (base[w] - copies["background"] * own["w"] + 0.5) / (model["background_words"] - copies["background"] * n[doc] + 0.5 * VOCABULARY)
    out = {}
    for name, weight in copies.items():
        table_ = model[name]
        count = {k: np.maximum(table_[at] - weight * own[k], 0) for k, at in (("w", w), ("prev", prev))}
        both = np.maximum(table_[pair] - weight * own["pair"], 0)
        p = (count["w"] + SHRINK * uniform) / (model[f"{name}_words"] - weight * n[doc] + SHRINK)
        out[name] = -np.log((np.minimum(both, count["prev"]) + PRIOR * p) / (count["prev"] + PRIOR))
    return out


def score(docs: DataFrame, model: dict, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score): mean losses in nats a token, and their difference.

    model must come from fit() over the same documents and target. Texts without
    words, null ones too, have no tokens, null losses and score 0. Rows that
    share an id are scored one by one.
    """
    seats = model["seats"]
    names = [id_col, "n_tokens", "target_loss", "background_loss", "score"]

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        runs = list(_texts(block))
        out = [pa.table([block["id"].slice(0, 0), *(pa.array([], k) for k in (pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=names)]
        if not runs:
            return out[0]
        keys = _distinct(runs)
        found = found.sort_by("bucket")
        counts = np.concatenate([_unpack(data, k, 2) for data, k in zip(found["counts"].to_pylist(), found["n"].to_pylist(), strict=True)], 1).astype(np.int64)
        if counts.shape[1] != len(keys):
            raise RuntimeError(f"{counts.shape[1]} counts for {len(keys)} keys: the model is of other documents")
        own = {"background": counts[0], "target": counts[1], "open": int(np.searchsorted(keys, _OPEN)), "background_words": found["words"][0].as_py(), "target_words": found["target_words"][0].as_py()}
        for ids, _, w, pair, first, text in runs:
            w, pair, text = (np.searchsorted(keys, x) for x in (w, pair, text))
            prev = np.empty(len(w), np.int64)
            prev[1:] = w[:-1]
            prev[first[:-1][first[:-1] < first[1:]]] = own["open"]
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            each = _losses(own, doc, w, prev, pair, n, text)
            loss = [np.bincount(doc, each[k], minlength=len(n)) / np.maximum(n, 1) for k in ("target", "background")]
            none = n == 0
            out.append(pa.table([ids, pa.array(n, pa.int64()), *(pa.array(x, pa.float64(), mask=none) for x in loss), pa.array(np.where(none, 0.0, loss[1] - loss[0]))], names=names))
        return pa.concat_tables(out)

    rows = _dealt(docs, target, seats, id_col, text_col)
    counts = model["counts"].repartition(len(seats), "block")
    return rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, f"`{id_col}` {dict(rows.dtypes)['id']}, n_tokens long, target_loss double, background_loss double, score double")


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs, good = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1")
    return score(docs, fit(docs, good), good)
