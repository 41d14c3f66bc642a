"""Token ids in binary shards of patched frame-of-reference blocks.

Shard: magic, which part of the corpus and which shard of it this is, how many ids
of the part came before, counts; the documents' keys as JSON, the number of ids of
each document, the start byte of each block, then the blocks. Block (of BLOCK ids, the last shorter and filled with its
minimum): minimum, width, number of exceptions; BLOCK offsets from the minimum
packed at that width; the exceptions' positions and their high parts. The width
is that of the PERCENTILE-th largest offset, so a few outliers don't widen a
block. Block starts let a reader unpack any run of ids without the rest.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from struct import Struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunkwords import Encoder, split_ids, strings
from .shared import by_batch, shuffle_parts, slices, stored, table

BLOCK, PERCENTILE = 256, 90
#: Ids after which a shard is closed, at a document's end.
SHARD_IDS = 1 << 19
#: magic, part, shard, ids of the part before it, documents, ids, blocks, bytes of keys
_HEAD = Struct("<4sIIQIQII")
_BLOCK = Struct("<IBB")
_MAGIC = b"PFR2"


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Each block's bytes. Blocks of equal width are packed together, lane by lane."""
    n = -(-len(ids) // BLOCK)
    grid = np.empty((n, BLOCK), np.uint32)
    if n:
        grid.reshape(-1)[: len(ids)] = ids
        grid.reshape(-1)[len(ids) :] = grid.reshape(-1)[(n - 1) * BLOCK : len(ids)].min()
    low = grid.min(1) if n else np.zeros(0, np.uint32)
    off = grid - low[:, None]
    rank = np.sort(off, 1)[:, (BLOCK * PERCENTILE) // 100] if n else low
    width = np.zeros(n, np.int64)
    for bit in range(32):
        width[rank >> np.uint32(bit) > 0] = bit + 1
    out: list[bytes] = [b""] * n
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        part = off[rows].astype(np.uint64)
        small = np.ascontiguousarray((part & np.uint64((1 << int(w)) - 1)).T)
        lanes = np.zeros(((BLOCK * int(w)) // 64, len(rows)), np.uint64)
        for i in range(BLOCK if w else 0):
            word, shift = divmod(i * int(w), 64)
            lanes[word] |= small[i] << np.uint64(shift)
            if shift + int(w) > 64:
                lanes[word + 1] |= small[i] >> np.uint64(64 - shift)
        lanes = np.ascontiguousarray(lanes.T).astype("<u8")
        over = part >> np.uint64(w)
        at_row, at_col = np.nonzero(over)
        first = np.searchsorted(at_row, np.arange(len(rows) + 1))
        high = over[at_row, at_col].astype("<u4")
        pos = at_col.astype(np.uint8)
        for k, r in enumerate(rows):
            lo, hi = first[k], first[k + 1]
            out[r] = _BLOCK.pack(int(low[r]), int(w), hi - lo) + lanes[k].tobytes() + pos[lo:hi].tobytes() + high[lo:hi].tobytes()
    return out


class Shard(NamedTuple):
    part: int
    shard: int
    #: Ids of the part before this shard.
    first: int
    keys: list
    sizes: np.ndarray
    ids: np.ndarray


def write_shard(docs: list[np.ndarray], keys: list | None = None, part: int = 0, shard: int = 0, first: int = 0) -> bytes:
    """Keys (integers, strings or null) name the documents; without any they are numbered."""
    ids = np.concatenate([*docs, np.zeros(0, np.uint32)]).astype(np.uint32)
    blocks = pack_blocks(ids)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u4")
    named = json.dumps(list(range(len(docs))) if keys is None else keys).encode()
    return b"".join([_HEAD.pack(_MAGIC, part, shard, first, len(docs), len(ids), len(blocks), len(named)), named, np.array([len(d) for d in docs], "<u4").tobytes(), starts.tobytes(), *blocks])


def read_header(data: bytes) -> tuple:
    """(part, shard, ids of the part before it, documents, ids, blocks, bytes of keys)"""
    magic, *fields = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a token shard")
    return tuple(fields)


def read_shard(data: bytes, first: int = 0, last: int | None = None) -> Shard:
    """A shard with its ids from position first up to last, unpacking only the blocks in between."""
    part, shard, before, docs, n, blocks, named = read_header(data)
    at = _HEAD.size + named
    keys = json.loads(data[_HEAD.size : at])
    sizes = np.frombuffer(data, "<u4", docs, at)
    starts = np.frombuffer(data, "<u4", blocks + 1, at + 4 * docs).astype(np.int64)
    body = at + 4 * docs + 4 * (blocks + 1)
    last = n if last is None else min(last, n)
    lo, hi = first // BLOCK, -(-last // BLOCK)
    grid = np.zeros((max(0, hi - lo), BLOCK), np.uint64)
    heads = [_BLOCK.unpack_from(data, body + int(starts[b])) for b in range(lo, hi)]
    widths = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        size = BLOCK * int(w) // 8
        lanes = np.frombuffer(b"".join(data[(p := body + int(starts[lo + r]) + _BLOCK.size) : p + size] for r in rows), "<u8").reshape(len(rows), -1)
        lanes, got = np.ascontiguousarray(lanes.T), np.empty((BLOCK, len(rows)), np.uint64)
        mask = np.uint64((1 << int(w)) - 1)
        for i in range(BLOCK if w else 0):
            word, shift = divmod(i * int(w), 64)
            x = lanes[word] >> np.uint64(shift)
            if shift + int(w) > 64:
                x = x | (lanes[word + 1] << np.uint64(64 - shift))
            got[i] = x & mask
        if w:
            grid[rows] = got.T
    for r, (low, w, over) in enumerate(heads):
        if over:
            p = body + int(starts[lo + r]) + _BLOCK.size + BLOCK * w // 8
            grid[r, np.frombuffer(data, np.uint8, over, p)] |= np.frombuffer(data, "<u4", over, p + over).astype(np.uint64) << np.uint64(w)
    grid += np.array([h[0] for h in heads], np.uint64)[:, None] if len(heads) else np.uint64(0)
    return Shard(part, shard, before, keys, sizes, grid.reshape(-1)[first - lo * BLOCK : last - lo * BLOCK].astype(np.uint32))


def write_shards(docs: DataFrame, make: Callable[[], Encoder], end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(part, shard, data) rows: the documents in ascending id order, null ids first, each closed by end_id.

    Ids are integers or strings. Null texts count as empty, so their document is
    end_id alone. Rows that share an id follow each other, by text. Ranges of ids
    are dealt to parts partitions.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = parts or shuffle_parts(docs.sparkSession)
    dealt = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text").withColumn("part", F.spark_partition_id())
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(name, make)
        end = np.array([end_id], "<u4")
        keys, held, size, shard, first, part = [], [], 0, 0, 0, None

        def full() -> pa.RecordBatch:
            return pa.record_batch({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "data": pa.array([write_shard(held, keys, part, shard, first)], pa.binary())})

        for batch in slices(batches, 2048):
            part = batch.column("part")[0].as_py()
            for key, own in zip(batch.column("id").to_pylist(), enc.encode(batch.column("text")), strict=True):
                own = np.concatenate([own, end])
                keys.append(key)
                held.append(own)
                size += len(own)
                if size >= SHARD_IDS:
                    yield full()
                    first += size
                    keys, held, size, shard = [], [], 0, shard + 1
        if held:
            yield full()

    return dealt.mapInArrow(run, "part int, shard int, data binary")


def read_shards(shards: DataFrame, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the shards' bytes alone.

    start counts all ids before the document. It adds up three figures: the ids
    of earlier parts (a row a part, from a first look at the headers), of the
    part's earlier shards (in the header) and of the shard's earlier documents.
    """

    def heads(batch: pa.RecordBatch):
        found = [read_header(x) for x in batch.column("data").to_pylist()]
        yield pa.record_batch({"part": pa.array([h[0] for h in found], pa.int32()), "n": pa.array([h[4] for h in found], pa.int64())})

    sums = shards.select("data").mapInArrow(by_batch(heads, 8), "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))

    def run(batch: pa.RecordBatch):
        own = read_shard(batch.column("data")[0].as_py())
        at = np.concatenate([[0], np.cumsum(own.sizes, dtype=np.int64)])
        raw = memoryview(own.ids.astype("<u4").tobytes())
        n = len(own.sizes)
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([own.part] * n, pa.int32()), pa.array(own.keys, kind), pa.array(at[:-1] + own.first), pa.array(own.sizes.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", id_col, "local", "n_tokens", "ids_crc32"])

    kind = pa.string() if id_type == "string" else pa.int64()
    rows = shards.select("data").mapInArrow(by_batch(run, 1), f"part int, `{id_col}` {id_type}, local long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(parts), "part").select(id_col, (F.col("local") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def export(shards: DataFrame, folder: str) -> None:
    """Each shard as a file tokens-<part>-<shard>.pfr in a folder that all executors share."""

    def write(batch: pa.RecordBatch):
        for data in batch.column("data").to_pylist():
            part, shard, *_ = read_header(data)
            with open(f"{folder}/tokens-{part:06d}-{shard:06d}.pfr", "wb") as f:
                f.write(data)
        yield batch.select(["part"])

    shards.select("part", "data").mapInArrow(by_batch(write, 4), "part int").count()


def _plain(spec: dict) -> bool:
    """Whether the file describes plain byte-level BPE, whose texts may be cut into chunks."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    own = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return bool(own and spec.get("normalizer") is None and not spec.get("truncation") and not spec.get("padding") and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")))


class LibraryEncoder(Encoder):
    """The tokenizers library's ids for a tokenizer file, without adding special tokens.

    Plain byte-level BPE goes through chunks, but for texts that hold an added
    token's string, which the library recognises: those and all texts of other
    tokenizers are given to the library whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        fields = json.loads(spec)
        self.own = Tokenizer.from_str(spec)
        super().__init__(self._chunks, not _plain(fields))
        added = [x["content"] for x in fields.get("added_tokens", [])]
        self.added = "|".join(re.escape(x) for x in added)
        self.width = None
        if not self.whole:
            # each character of a byte-level token stands for one byte
            own = self.own.get_vocab(with_added_tokens=True)
            self.width = np.zeros(max(own.values()) + 1, np.int64)
            self.width[list(own.values())] = [len(t) for t in own]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array("I", x.ids), np.uint32) for x in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, data: bytes, ends: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, stop, texts = strings(data, ends, opens)
        ids = self._ids(texts)
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)])
        if self.whole:
            count = np.array([len(x) for x in ids], np.int64)
            return flat, count
        return split_ids(order, stop, flat, self.width[flat])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        held = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added and not self.whole else np.zeros(len(texts), bool)
        if not held.any():
            yield from super().encode(texts)
            return
        rest = super().encode(texts.filter(pa.array(~held)))
        for i, own in enumerate(held):
            yield self._ids([texts[i].as_py()])[0] if own else next(rest)


def library_encoder(path: str) -> Callable[[], Encoder]:
    """An encoder of the tokenizers library's file at path, whose text travels with the job. An added token's string in a text is that token, as in a plain call of the library; none is put around a text."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    return lambda: LibraryEncoder(spec)


def op2_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = stored(write_shards(table(spark, sf_dir, "documents"), library_encoder(public_tokenizers.path("byte_bpe_50k.json")), 2), "tokens", "none")
    return read_shards(shards)
