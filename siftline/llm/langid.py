"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters in BUCKETS hash buckets per
length; the log-probability matrix (languages x buckets, a fixed size) is
broadcast and each batch of texts becomes one sparse matrix (text, bucket, count),
which is multiplied with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, crc_mod, slices, table, widened

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Bound on the labelled rows that a fit uses, in expectation: rows are taken by a hash of their text.
MAX_TRAIN = 40_000
#: Evidence beyond this many n-grams is scaled down, so that long texts don't all score exactly 1.
EVIDENCE = 60
#: Characters per piece of a text and per sparse matrix, which bound both whatever a text holds.
STEP, MATRIX = 20_000, 1 << 18
#: More languages than these are refused, as the matrix that is broadcast grows with them.
MAX_LANGS = 512
_MUL = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
_SPACE = 32
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a space for what isn't a letter; made once in a process."""
    if not _FOLD:
        table = np.full(0x110000, _SPACE, np.uint32)
        for c in (*range(0xD800), *range(0xE000, 0x33480)):
            x = chr(c)
            if x.isalpha():
                table[c] = ord(x.lower()[0])
        _FOLD.append(table)
    return _FOLD[0]


def letters(text: str) -> np.ndarray:
    return _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def grams(chars: np.ndarray) -> list[np.ndarray]:
    """Buckets of the one-, two- and three-character n-grams, each length in its own range."""
    own = [chars * m for m in _MUL]
    h = [own[0]]
    for k in range(1, len(ORDERS)):
        h.append(h[-1][:-1] + own[k][k:])
    return [(x >> np.uint32(17)).astype(np.int64) + k * BUCKETS for k, x in enumerate(h)]


def _count(batches):
    found: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            acc = found.setdefault(lang, np.zeros(BUCKETS * len(ORDERS), np.int64))
            for at in grams(letters(text)):
                bucket, n = np.unique(at, return_counts=True)
                acc[bucket] += n
    for lang, acc in found.items():
        at = np.flatnonzero(acc)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(acc[at])})


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_train: int = MAX_TRAIN) -> dict:
    """Counts by language and bucket, summed in Spark; the result is at most languages x buckets numbers.

    Rows without text or language are not learned from. With no rows at all the
    model knows no language and every prediction is ``und``. More than MAX_LANGS
    languages raise ValueError.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    n, many = rows.agg(F.count(F.lit(1)), F.count_distinct("lang")).first()
    if many > MAX_LANGS:
        raise ValueError(f"{many} languages; the model is broadcast and takes at most {MAX_LANGS}")
    if n > max_train:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(1_000_003 * max_train / n))
    counts = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    logp = np.zeros((len(langs), BUCKETS * len(ORDERS)))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        logp[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
    for k in range(len(ORDERS)):
        part = logp[:, k * BUCKETS : (k + 1) * BUCKETS]
        seen = max(1, int((part.sum(0) > 0).sum()))
        part[:] = np.log((part + 0.1) / (part.sum(1, keepdims=True) + 0.1 * (seen + 1)))
    return {"langs": langs, "logp": np.ascontiguousarray(logp.T.astype(np.float32))}


def _matrices(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse matrices (text, bucket, count), sorted, of pieces of the texts; their sum counts every n-gram of every text once."""
    held, size = [], 0
    for row, chars in enumerate(texts):
        for lo in range(0, len(chars), STEP):
            part = chars[lo : lo + STEP + len(ORDERS) - 1]
            held.append((row, min(STEP, len(chars) - lo), part))
            size += len(part)
            if size >= MATRIX:
                yield _matrix(held)
                held, size = [], 0
    if held:
        yield _matrix(held)


def _matrix(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(part) for *_, part in held])
    row = np.repeat([row for row, *_ in held], size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    starts, left = at < np.repeat([n for _, n, _ in held], size), np.repeat(size, size) - at
    keys = []
    for k, bucket in enumerate(grams(np.concatenate([part for *_, part in held]))):
        ok = starts[: len(bucket)] & (left[: len(bucket)] > k)
        keys.append((row[: len(bucket)][ok] << 17) | bucket[ok])
    keys = np.sort(np.concatenate(keys).astype(np.uint32))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    own = keys[first]
    return (own >> np.uint32(17)).astype(np.int64), (own & np.uint32(0x1FFFF)).astype(np.int64), np.diff(np.append(first, len(keys)))


def score_texts(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], list[float]]:
    """Of at most 32,768 texts the likeliest language of each and its share of the evidence."""
    chars = [letters(t or "") for t in texts]
    open_ = [bool(langs) and bool((c != _SPACE).any()) for c in chars]
    total, n = np.zeros((len(texts), max(1, len(langs)))), np.zeros(len(texts))
    for row, bucket, count in _matrices([c if o else c[:0] for c, o in zip(chars, open_, strict=True)]):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        total[row[first]] += np.add.reduceat(logp[bucket] * count[:, None], first)
        n += np.bincount(row, count, minlength=len(texts))
    z = total * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
    p = np.exp(z - z.max(1, keepdims=True))
    best = np.argmax(z, 1)
    share = p[np.arange(len(texts)), best] / p.sum(1)
    return [langs[b] if o else "und" for b, o in zip(best, open_, strict=True)], [float(x) if o else 0.0 for x, o in zip(share, open_, strict=True)]


def identify(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language, or ``und`` for null texts and texts without a letter) and score (0 to 1; 0 for ``und``).

    Ties go to the language that sorts first. Columns of docs named lang_pred or
    score are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model["langs"], model["logp"]))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = widened(out.schema, lang_pred="string", score="double")

    def run(batch: pa.RecordBatch):
        pred, score = score_texts(batch.column(text_col).to_pylist(), *shared.value)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    return out.mapInArrow(by_batch(run), schema)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(crc_mod("doc_id", 4) != 2))
    return identify(docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
