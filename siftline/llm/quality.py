"""Quality: a generalised additive model with pairwise interactions over statistics of a text.

Each feature is cut into bins at quantiles of the training sample. Boosting goes
round the features one after the other: a tree of at most three leaves over the
bins of one feature is fitted to the loss's gradient, and its leaves are added to
that feature's lookup table with a small rate. Then the pairs of features whose best
quadrants explain most of what is left get tables of two dimensions, boosted the
same way by trees that cut one feature and each side along the other. A score is
the sum of the tables' entries at a text's bins, calibrated and made a probability:
scoring is nothing but binning and additions.

Features are computed where the texts are, in numpy over batches of bytes; the
driver trains on those of a bounded sample of labelled rows alone, a few hundred
bytes a row.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunkwords import hashes
from .shared import by_batch, crc_mod, table, widened
from .textbytes import chunks, words

#: Bounds on the labelled rows of label 0 and 1 that a fit uses, in expectation.
MAX_ROWS = (8_000, 8_000)
#: Bins of a feature, and of a feature in a table of two.
BINS, PAIR_BINS = 64, 12
#: Rounds over all features and over all pairs, and the rate of each step.
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
PAIRS = 12
#: One in so many rows of the sample isn't boosted on, but calibrates the scores.
HELD = 5
#: Weight of rows below which a leaf isn't made, and ridge on a leaf's value.
LEAST, RIDGE = 10.0, 1.0

FEATURES = (
    "log_bytes log_words word_bytes long_words short_words letters digits capitals marks symbols other spaces non_ascii "
    "symbol_words capital_words letterless distinct_words commonest_word repeats log_lines line_bytes repeated_lines sentence_words entropy"
).split()


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, np.int32)
    for lo, hi in ranges:
        out[lo : hi + 1] = 1
    return out


_LETTER = _byte_class((65, 90), (97, 122), (0xC3, 0xFF))
_DIGIT, _CAPITAL, _LATER = _byte_class((48, 57)), _byte_class((65, 90)), _byte_class((0x80, 0xBF))
_SPACE = _byte_class((32, 32), (9, 13))
_MARK = np.zeros(256, np.int32)
_MARK[list(b".,;:!?'\"()-")] = 1
_ENDS = np.zeros(256, np.int32)
_ENDS[list(b".!?")] = 1
_SYMBOL = _byte_class((33, 47), (58, 64), (91, 96), (123, 126)) - _MARK


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _runs(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each of n documents, and how often its commonest occurs."""
    if not len(key):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    by = np.lexsort((key, doc))
    new = np.flatnonzero(np.concatenate([[True], (doc[by][1:] != doc[by][:-1]) | (key[by][1:] != key[by][:-1])]))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[by][new], np.diff(np.append(new, len(by))))
    return np.bincount(doc[by][new], minlength=n), most


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The FEATURES of each text, a row each."""
    n = len(off) - 1
    size = np.diff(off)
    start, end, h, first = words(buf, off)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    per_word = lambda x: np.bincount(doc, x, minlength=n)
    counted = {name: _sums(code[buf], off) for name, code in (("letter", _LETTER), ("digit", _DIGIT), ("capital", _CAPITAL), ("mark", _MARK), ("symbol", _SYMBOL), ("space", _SPACE), ("later", _LATER), ("ends", _ENDS))}
    chars = size - counted["later"]
    long_ = end - start
    marked = np.concatenate([[0], np.cumsum(_SYMBOL[buf], dtype=np.int64)])
    lettered = np.concatenate([[0], np.cumsum(_LETTER[buf], dtype=np.int64)])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct, most = _runs(doc, h, n)

    cut = np.flatnonzero(buf == 10)
    edge = np.unique(np.concatenate([off, cut, cut + 1]))
    a, b = edge[:-1], edge[1:]
    line = buf[a] != 10 if len(a) else np.zeros(0, bool)
    a, b = a[line], b[line]
    line_doc = np.searchsorted(off, a, side="right") - 1
    lines = np.bincount(line_doc, minlength=n)
    line_hash = hashes(buf, a, b)[0] if len(a) else np.zeros(0, np.uint64)
    fresh_lines, _ = _runs(line_doc, line_hash, n)

    entropy = np.zeros(n)
    step = max(1, (1 << 20) // 256)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        own = buf[off[lo] : off[hi]].astype(np.int64)
        table_ = np.bincount(np.repeat(np.arange(hi - lo), size[lo:hi]) * 256 + own, minlength=256 * (hi - lo)).reshape(hi - lo, 256)
        p = table_ / np.maximum(table_.sum(1, keepdims=True), 1)
        entropy[lo:hi] = -(p * np.log2(np.maximum(p, 1e-12))).sum(1)
    columns = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(count), "word_bytes": _share(per_word(long_), count),
        "long_words": _share(per_word(long_ > 14), count), "short_words": _share(per_word(long_ < 4), count),
        "letters": _share(counted["letter"], chars), "digits": _share(counted["digit"], chars), "capitals": _share(counted["capital"], chars),
        "marks": _share(counted["mark"], chars), "symbols": _share(counted["symbol"], chars), "spaces": _share(counted["space"], chars), "non_ascii": _share(counted["later"], chars),
        "other": _share(chars - counted["letter"] - counted["digit"] - counted["mark"] - counted["symbol"] - counted["space"], chars),
        "symbol_words": _share(per_word(marked[end] > marked[start]), count), "capital_words": _share(per_word(_CAPITAL[buf[start]]), count), "letterless": _share(per_word(lettered[end] == lettered[start]), count),
        "distinct_words": _share(distinct, count), "commonest_word": _share(most, count), "repeats": _share(per_word(again), count),
        "log_lines": np.log1p(lines), "line_bytes": np.log1p(_share(size, lines)), "repeated_lines": _share(lines - fresh_lines, lines),
        "sentence_words": np.log1p(_share(count, counted["ends"])), "entropy": entropy,
    }
    return np.stack([np.asarray(columns[c], np.float64) for c in FEATURES], 1)


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 distinct cuts at quantiles; a value's bin is the number of cuts at or below it."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _best(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradients g and weights h; no cut: gain 0 at place 0."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(cg):
        return 0.0, 0
    rg, rh = g.sum() - cg, h.sum() - ch
    gain = np.where((ch >= LEAST / 4) & (rh >= LEAST / 4), cg**2 / (ch + RIDGE) + rg**2 / (rh + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE), 0.0)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What a tree of at most three leaves adds to each bin."""
    edges = [0, len(g)]
    for _ in range(2):
        found = [(*_best(g[a:b], h[a:b]), a) for a, b in itertools.pairwise(edges)]
        gain, at, a = max(found)
        if gain <= 0:
            break
        edges = sorted([*edges, a + at])
    out = np.empty(len(g))
    for a, b in itertools.pairwise(edges):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts the first feature and each side along the second, or the other way round."""
    best = (0.0, np.zeros(g.shape))
    for turned in (False, True):
        g_, h_ = (g.T, h.T) if turned else (g, h)
        gain, at = _best(g_.sum(1), h_.sum(1))
        # without a cut of its own the first feature is tried in the middle: an interaction may have no margin
        at = at if gain > 0 else g_.shape[0] // 2
        out, whole = np.empty(g_.shape), 0.0
        for side in (slice(0, at), slice(at, None)):
            gs, hs = g_[side].sum(0), h_[side].sum(0)
            _, cut = _best(gs, hs)
            for part in (slice(0, cut), slice(cut, None)):
                w = hs[part].sum() + RIDGE
                out[side, part] = gs[part].sum() / w
                whole += gs[part].sum() ** 2 / w
        whole -= g.sum() ** 2 / (h.sum() + RIDGE)
        if whole > best[0]:
            best = (whole, out.T if turned else out)
    return best


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> dict:
    """Boost tables for the rows x (a column a feature) with labels y and weights."""
    cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    z = np.full(len(y), bias)
    for _ in range(rounds):
        for j, at in enumerate(bins):
            p = _sigmoid(z)
            n = len(tables[j])
            step = RATE * _tree(np.bincount(at, weight * (y - p), n), np.bincount(at, weight * p * (1 - p), n))
            tables[j] += step
            z += step[at]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    low = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]

    def histogram(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        at = low[a] * shape[1] + low[b]
        p = _sigmoid(z)
        g, h = (np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (weight * (y - p), weight * p * (1 - p)))
        return at, g, h

    gains = []
    for a, b in itertools.combinations(range(x.shape[1]), 2):
        _, g, h = histogram(a, b)
        gains.append((-_pair_tree(g, h)[0], a, b))
    chosen = [(a, b) for gain, a, b in sorted(gains)[:pairs] if gain < 0]
    squares = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(pair_rounds):
        for a, b in chosen:
            at, g, h = histogram(a, b)
            step = RATE * _pair_tree(g, h)[1]
            squares[a, b] += step
            z += step.ravel()[at]
    return {"bias": bias, "cuts": cuts, "tables": tables, "coarse": coarse, "pairs": chosen, "squares": [squares[p] for p in chosen], "scale": 1.0}


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    """Sums of the tables' entries at the rows' bins."""
    z = np.zeros(len(x))
    for j, (cuts, values) in enumerate(zip(model["cuts"], model["tables"], strict=True)):
        z += values[np.searchsorted(cuts, x[:, j], side="right")]
    low = {j: np.searchsorted(model["coarse"][j], x[:, j], side="right") for p in model["pairs"] for j in p}
    for (a, b), values in zip(model["pairs"], model["squares"], strict=True):
        z += values[low[a], low[b]]
    return model["bias"] + model["scale"] * z


def calibrated(model: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """The model with a scale and bias that fit held-back rows best, by Newton steps on a ridge-bound logistic fit."""
    if len(np.unique(y)) < 2:
        return model
    z = logits(model, x) - model["bias"]
    at = np.array([1.0, model["bias"]])
    a = np.stack([z, np.ones(len(z))], 1)
    prior = np.diag([1.0, 1e-2])
    for _ in range(30):
        p = _sigmoid(a @ at)
        slope = a.T @ (weight * (y - p)) - prior @ (at - [1.0, model["bias"]])
        bend = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + prior
        move = np.linalg.solve(bend, slope)
        at = at + np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return model | {"scale": float(max(at[0], 1e-2)), "bias": float(at[1])}


def _rows(batch: pa.RecordBatch, text: str) -> np.ndarray:
    found = [features(buf, off) for _, _, buf, off in chunks(batch.column(text))]
    return np.concatenate(found) if found else np.zeros((0, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: tuple[int, int] = MAX_ROWS, seed: int = 11) -> dict:
    """Train on labelled texts; of each label at most about max_rows of them, taken by a hash of the id.

    Their ids, bounded by max_rows, are broadcast, so texts aren't shuffled, and
    only their features come to the driver. Rows are weighted so that labels keep
    the shares that they have among all labelled ids. Ids without text rows, null
    ids, null labels and labels other than 0 and 1 aren't learned from; an id with
    clashing labels counts as 0. Without any labels every score is one half.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    part = [min(1.0, most / max(1, sizes.get(y, 0))) for y, most in enumerate(max_rows)]
    share = F.when(F.col("y") == 1, part[1]).otherwise(part[0])
    taken = marked.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) < share * 1_000_003)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken), "id").select("id", "y", "text")

    def run(batch: pa.RecordBatch):
        x = _rows(batch, "text").astype("<f8")
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    found = rows.mapInArrow(by_batch(run), f"id {dict(rows.dtypes)['id']}, y int, x binary").toArrow()
    x = np.frombuffer(b"".join(found["x"].to_pylist()), "<f8").reshape(-1, len(FEATURES))
    # an order that doesn't depend on how rows came
    order = np.lexsort((*x.T, found["y"].to_numpy()))
    x, y = x[order], found["y"].to_numpy()[order].astype(np.float64)
    weight = np.where(y == 1, 1 / part[1], 1 / part[0])
    if not len(y):
        empty = [np.zeros(1)] * len(FEATURES)
        return {"bias": 0.0, "cuts": [np.zeros(0)] * len(FEATURES), "tables": empty, "coarse": [np.zeros(0)] * len(FEATURES), "pairs": [], "squares": [], "scale": 1.0}
    weight *= len(y) / weight.sum()
    held = np.random.default_rng(seed).permutation(len(y)) % HELD == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    model = train(x[~held], y[~held], weight[~held])
    return calibrated(model, x[held], y[held], weight[held]) if held.any() else model


def score(docs: DataFrame, model: dict, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from least on). Null texts count as empty; empty texts have features like others.

    Rows are scored one by one, whatever their ids; columns of docs named score or
    predicted are replaced. A text is scored whole, whatever its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = widened(out.schema, score="double", predicted="integer")

    def run(batch: pa.RecordBatch):
        p = _sigmoid(logits(shared.value, _rows(batch, text_col)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= least).astype(np.int32))], names=[*kept, "score", "predicted"])

    return out.mapInArrow(by_batch(run), schema)


def op11_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 4) == 2
    model = fit(docs, labels.filter(~held_out))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
