"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams
(of the word between boundary marks) and of the whole word; a text's vector is
the mean of its words' vectors; a softmax over two classes reads it. Embeddings
and softmax are trained together (Adam on mini-batches). Misspelt or inflected
words that never occurred in training share n-grams with those that did.

Both means are linear, so a text is a bag of subword buckets with weights. Bags are
made where the texts are; the driver trains on those of a bounded sample alone.
As the softmax is linear too, a word's part in a text's logit is one number, so
scoring looks distinct words up in a bounded cache and averages those numbers.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, crc_mod, table, widened

BUCKETS = 1 << 16
DIM = 8
NGRAMS = (3, 4)
EPOCHS = 5
#: Small samples are gone through more often, to make so many steps.
STEPS = 400
#: One in so many rows of the sample isn't trained on, but calibrates the scores.
HELD = 5
#: A missed toxic row costs so many times what a false alarm does.
MISS = 2.0
BATCH = 128
#: Bounds on the labelled clean and toxic rows that a fit uses, in expectation.
MAX_ROWS = (5_000, 2_500)
#: Distinct words whose part in the logit a Python worker remembers.
CACHE = 400_000
_TRIM = ".,;:!?\"'()[]{}<>|*#%$&-_"


def tokens(text: str | None) -> list[str]:
    return [] if text is None else text.lower().split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all subwords of the words, one after the other, and where each word's begin, with the end appended."""
    marked = [f"<{w.strip(_TRIM) or w}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(marked)), size)
    left = start[1:][word] - np.arange(len(chars))
    owner, bucket = [np.arange(len(marked))], []
    powers = np.multiply.accumulate(np.full(len(chars) + 1, 0x9E3779B97F4A7C15 | 1, np.uint64))
    inverse = np.multiply.accumulate(np.full(len(chars) + 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64), np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars + np.uint64(17)) * np.uint64(0xC2B2AE3D27D4EB4F) * powers[: len(chars)])])
    whole = (total[start[1:]] - total[start[:-1]]) * inverse[start[:-1]]
    bucket.append(whole ^ np.uint64(0x5DEECE66D))
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        bucket.append((total[at + n] - total[at]) * inverse[at] + np.uint64(n))
        owner.append(word[at])
    h = np.concatenate(bucket)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    h = ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
    who = np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return h[order], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(words)))])


class Bags(NamedTuple):
    """Subword buckets of texts with their weights, one text after the other, and where each text's begin, with the end appended."""

    bucket: np.ndarray
    weight: np.ndarray
    begin: np.ndarray

    def take(self, rows: np.ndarray) -> Bags:
        size = np.diff(self.begin)[rows]
        begin = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.begin[rows] - begin[:-1], size) + np.arange(begin[-1])
        return Bags(self.bucket[at], self.weight[at], begin)


def bags(texts: list[str | None]) -> Bags:
    """A bucket's weight in a text: over its words, the word's share of the text's words times the bucket's share of the word's subwords."""
    index: dict[str, int] = {}
    own = [np.fromiter((index.setdefault(w, len(index)) for w in tokens(t)), np.int64) for t in texts]
    sub, at = subwords(list(index)) if index else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    size = np.diff(at)
    bucket, weight, begin = [], [], [0]
    for words in own:
        word, n = np.unique(words, return_counts=True)
        spans = size[word]
        grams = sub[np.repeat(at[word] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())]
        used, place = np.unique(grams, return_inverse=True)
        bucket.append(used)
        weight.append(np.bincount(place, np.repeat(n / max(1, len(words)) / spans, spans), minlength=len(used)))
        begin.append(begin[-1] + len(used))
    return Bags(np.concatenate([*bucket, np.zeros(0, np.int64)]).astype(np.uint16), np.concatenate([*weight, np.zeros(0)]).astype(np.float32), np.array(begin))


def train(own: Bags, labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> dict:
    """Embeddings (BUCKETS x DIM), softmax weights and bias; classes weigh alike. Without both classes it scores a constant."""
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        base = float(labels.mean()) if len(labels) else 0.0
        return {"value": np.zeros(BUCKETS, np.float32), "bias": 8.0 if base > 0.5 else -8.0}
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    m_e, v_e = np.zeros_like(emb), np.zeros_like(emb)
    m_o, v_o, m_b, v_b = (np.zeros_like(x) for x in (out, out, bias, bias))
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    step, rate = 0, 0.05
    epochs = max(epochs, -(-STEPS * BATCH // len(labels)))
    place = np.zeros(BUCKETS, np.int64)
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            part = own.take(docs)
            if not len(part.bucket):
                continue
            used, grads = gradients(part, labels[docs], weight[labels[docs]], emb, out, bias, place)
            step += 1
            fix = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for at, value, grad, m, v in zip((used, slice(None), slice(None)), (emb, out, bias), grads, (m_e, m_o, m_b), (v_e, v_o, v_b), strict=True):
                m[at] = 0.9 * m[at] + 0.1 * grad
                v[at] = 0.999 * v[at] + 0.001 * grad * grad
                value[at] = value[at] - fix * m[at] / (np.sqrt(v[at]) + 1e-8)
    return {"value": (emb @ (out[:, 1] - out[:, 0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def gradients(part: Bags, labels: np.ndarray, weight: np.ndarray, emb: np.ndarray, out: np.ndarray, bias: np.ndarray, place: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """(buckets used, gradients of their embeddings, of the softmax and of its bias) of the weighted mean cross-entropy of a mini-batch."""
    place = np.zeros(len(emb), np.int64) if place is None else place
    rows = np.repeat(np.arange(len(labels)), np.diff(part.begin))
    used = np.flatnonzero(np.bincount(part.bucket, minlength=len(emb)))
    place[used] = np.arange(len(used))
    gram = place[part.bucket]
    vectors = emb[part.bucket]
    doc_vec = np.stack([np.bincount(rows, part.weight * vectors[:, d], minlength=len(labels)) for d in range(emb.shape[1])], 1)
    z = doc_vec @ out + bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(labels)), labels] -= 1
    p *= (weight / len(labels))[:, None]
    g_doc = p @ out.T
    g_emb = np.stack([np.bincount(gram, part.weight * g_doc[rows, d], minlength=len(used)) for d in range(emb.shape[1])], 1)
    return used, (g_emb, doc_vec.T @ p, p.sum(0))


def logits(model: dict, own: Bags) -> np.ndarray:
    rows = np.repeat(np.arange(len(own.begin) - 1), np.diff(own.begin))
    return model["bias"] + np.bincount(rows, own.weight * model["value"][own.bucket], minlength=len(own.begin) - 1)


def calibrated(model: dict, own: Bags, labels: np.ndarray, weights: np.ndarray) -> dict:
    """model with its logits stretched and shifted to fit held-back rows (two parameters, by Newton's method with a small ridge), whose weights stand for the share of either class among all labels."""
    labels = np.asarray(labels, float)
    if not len(labels) or labels.min() == labels.max():
        return model
    z = logits(model, own)
    mid, wide = float(z.mean()), float(z.std()) or 1.0
    x = np.stack([(z - mid) / wide, np.ones(len(z))], 1)
    w, at = weights / weights.mean(), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        grad = x.T @ (w * (p - labels)) + 0.5 * (at - np.array([1.0, 0.0]))
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    a = max(at[0], 1e-3) / wide
    return {"value": (model["value"] * a).astype(np.float32), "bias": float(a * (model["bias"] - mid) + at[1])}


class Scorer:
    """Scores texts with a trained model; remembers words' parts in the logit up to CACHE of them."""

    def __init__(self, model: dict):
        self.value, self.bias, self.known = model["value"], model["bias"], {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -60, 60)))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        split = [tokens(t) for t in texts]
        new = list({w for own in split for w in own if w not in self.known})
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list({w for own in split for w in own})
        if new:
            sub, at = subwords(new)
            self.known.update(zip(new, (np.add.reduceat(self.value[sub], at[:-1]) / np.diff(at)).tolist(), strict=True))
        look = self.known.__getitem__
        return np.array([self.bias + (sum(map(look, own)) / len(own) if own else 0.0) for own in split])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: tuple[int, int] = MAX_ROWS, seed: int = 7) -> dict:
    """Train on labelled texts; of each class at most about max_rows of them, taken by a hash of the id.
    Their ids, bounded by max_rows, are broadcast, so texts aren't shuffled, and
    only their bags come to the driver: at most BUCKETS numbers a row, whatever its text.
    A fifth of the sample is held back to calibrate the scores for the share of
    toxic rows among all labels.

    Ids without text, null labels and labels other than 0 and 1 aren't learned
    from; an id with several equal labels counts once, with clashing labels as 1.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    part = [min(1.0, most / max(1, sizes.get(y, 0))) for y, most in enumerate(max_rows)]
    share = F.when(F.col("y") == 1, part[1]).otherwise(part[0])
    taken = marked.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) < share * 1_000_003)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken), "id").select("id", "text", "y")
    found = rows.mapInArrow(by_batch(_bagged, 256), f"id {dict(rows.dtypes)['id']}, y int, bucket binary, weight binary").toArrow().sort_by("id")
    y = found["y"].to_numpy()
    raw = {c: found[c].to_pylist() for c in ("bucket", "weight")}
    del found
    begin = np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw["bucket"]], dtype=np.int64)])
    own = Bags(np.frombuffer(b"".join(raw.pop("bucket")), "<u2"), np.frombuffer(b"".join(raw.pop("weight")), "<f4"), begin)
    held = np.random.default_rng(seed).permutation(len(y)) % HELD == 0
    model = train(own.take(np.flatnonzero(~held)), y[~held], seed)
    return calibrated(model, own.take(np.flatnonzero(held)), y[held], np.where(y[held] == 1, MISS, 1.0) / np.array(part)[y[held]])


def _bagged(batch: pa.RecordBatch):
    own = bags(batch.column("text").to_pylist())
    cut = list(zip(own.begin[:-1], own.begin[1:], strict=True))
    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([own.bucket[a:b].astype("<u2").tobytes() for a, b in cut], pa.binary()), pa.array([own.weight[a:b].astype("<f4").tobytes() for a, b in cut], pa.binary())], names=["id", "y", "bucket", "weight"])


_SCORERS: dict[str, Scorer] = {}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on). Null and empty texts get the score of the bias alone.

    Columns of docs named score or predicted are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = widened(out.schema, score="double", predicted="integer")

    def run(batch: pa.RecordBatch):
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        p = _SCORERS[name](batch.column(text_col).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return out.mapInArrow(by_batch(run, 256), schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    return score(docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
