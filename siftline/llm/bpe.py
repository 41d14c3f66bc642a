"""Byte-level BPE with DuckDB recursive queries in each partition.

Encoding: pieces of text (matches of the pattern) become rows of token positions
that join the merge table; in each round every piece contracts its leftmost pair
of the lowest rank, until no piece has a pair in the table. Decoding joins ids to
the vocabulary and aggregates the bytes in order of position. A Python worker
holds one in-memory DuckDB with the merge table, single-threaded, and feeds it
the distinct pieces of a batch that it hasn't met.

Short pieces hold their ids in a list. A piece of LONG bytes or more keeps one row
for each position instead, so that a round copies no list, and its rounds are split
into queries whose rows are bounded. There a round contracts all places of the
lowest rank at once, from left to right, if every token ranks above its parts (as
it does in any trained vocabulary; then the order can't matter); otherwise the
leftmost alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunkwords import PATTERN, Encoder, split_ids, strings
from .shared import by_batch, table

#: Distinct pieces that one recursive query takes, and the sum of their squared lengths, which bounds the rows of all rounds.
PIECES, SQUARES = 20_000, 6_000_000
#: From so many bytes on a piece has a row for each position.
LONG = 512
#: Rows of all rounds of one query over long pieces, but for a piece with more rows in one round.
ROWS = 1 << 20
#: Ids that one decoding query takes; longer lists are decoded in slices.
DECODE_IDS = 1 << 18
#: Memory of a worker's DuckDB in MB; a piece of more bytes than a fifth of ROWS gets more, in proportion.
MEMORY_MB = 300

ENCODE = """
WITH RECURSIVE state(piece, ids) AS (
    SELECT piece, ids FROM pieces
  UNION ALL
    SELECT s.piece, s.ids[:b.pos - 1] || [b.made] || s.ids[b.pos + 2:]
    FROM (SELECT piece, (min(best) // 65536)::INTEGER AS made, (min(best) % 65536)::INTEGER AS pos
          FROM (SELECT p.piece, m.made * 65536::BIGINT + p.pos AS best
                FROM (SELECT piece, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, generate_subscripts(ids[2:], 1) AS pos FROM state) p
                JOIN merges m ON m.pair = p.a::BIGINT * 4294967296 + p.b)
          GROUP BY piece) b
    JOIN state s ON s.piece = b.piece
)
SELECT piece, arg_min(ids, len(ids)) AS ids FROM state GROUP BY piece ORDER BY piece
"""

#: Rounds over position rows: pairs meet the merge table, hits of the lowest rank are numbered in their runs, and of each run every other one is contracted.
ENCODE_ROWS = """
WITH RECURSIVE state(step, piece, pos, id) AS (
    SELECT 0, piece, pos, id FROM rows
  UNION ALL
    SELECT step + 1, piece, pos, CASE WHEN taken THEN made ELSE id END
    FROM (SELECT *, coalesce(lag(taken) OVER (PARTITION BY piece ORDER BY pos), false) AS eaten
          FROM (SELECT *, hit AND {odd} AS taken
                FROM (SELECT *, k - row_number() OVER (PARTITION BY piece, hit ORDER BY pos) AS run
                      FROM (SELECT *, coalesce(made = low, false) AS hit
                            FROM (SELECT n.*, m.made, min(m.made) OVER (PARTITION BY n.piece) AS low
                                  FROM (SELECT *, lead(id) OVER w AS nxt, row_number() OVER w AS k FROM state WHERE step < {rounds} WINDOW w AS (PARTITION BY piece ORDER BY pos)) n
                                  LEFT JOIN merges m ON m.pair = n.id::BIGINT * 4294967296 + n.nxt)
                            WHERE low IS NOT NULL))))
    WHERE NOT eaten
)
SELECT piece, pos, id, step FROM (SELECT *, max(step) OVER (PARTITION BY piece) AS last FROM state) WHERE step = last ORDER BY piece, pos
"""
_ODD = "row_number() OVER (PARTITION BY piece, hit, run ORDER BY pos) % 2 = 1"
_FIRST = "row_number() OVER (PARTITION BY piece, hit ORDER BY pos) = 1"

DECODE = """
SELECT t.doc, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS bytes
FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM texts) t JOIN vocabulary v ON v.id = t.id
GROUP BY t.doc
"""


class Bpe:
    """Encoder and decoder of one rank file, given as its bytes (base64 token, rank a line)."""

    def __init__(self, ranks: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in ranks.splitlines() if x.strip())}
        self.pattern, self.whole = regex.compile(pattern), pattern != PATTERN
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        parts = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.ranked = all(r > max(a, b) for a, b, r in parts)
        self.known = np.sort(np.array(list(self.ranks.values()), np.int64))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        self.db.register("given", pa.table({"pair": pa.array([(a << 32) + b for a, b, _ in parts], pa.int64()), "made": pa.array([r for *_, r in parts], pa.int64())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.db.unregister("given")

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of pieces of at least one byte. A piece that is a token as a whole is that token, as in the public encoders."""
        out: list = [None] * len(pieces)
        open_, long_ = [], []
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = self.ranks[p].to_bytes(4, "little")
            else:
                (open_ if len(p) < LONG else long_).append(i)
        runs, squares = [], SQUARES
        for i in open_:
            squares += len(pieces[i]) ** 2
            if squares > SQUARES or len(runs[-1]) == PIECES:
                runs.append([])
                squares = len(pieces[i]) ** 2
            runs[-1].append(i)
        for run in runs:
            data = np.frombuffer(b"".join(pieces[i] for i in run), np.uint8)
            off = np.cumsum([0, *(len(pieces[i]) for i in run)]).astype(np.int32)
            self.db.register("pieces", pa.table({"piece": pa.array(np.arange(len(run), dtype=np.int32)), "ids": pa.ListArray.from_arrays(pa.array(off), pa.array(self.byte[data]))}))
            found = self.db.sql(ENCODE).to_arrow_table()["ids"].combine_chunks()
            flat, at = found.values.to_numpy().astype("<u4").tobytes(), (found.offsets.to_numpy() * 4).tolist()
            for k, i in enumerate(run):
                out[i] = flat[at[k] : at[k + 1]]
        for i in long_:
            out[i] = self._long(pieces[i])
        return out

    def _long(self, piece: bytes) -> bytes:
        """A long piece, by a row for each position; each query makes as many rounds as ROWS allows."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        if len(ids) > ROWS // 5:
            self.db.execute(f"SET memory_limit = '{MEMORY_MB * (1 + 5 * len(ids) // ROWS)}MB'")
        while True:
            rounds = max(1, ROWS // len(ids))
            self.db.register("rows", pa.table({"piece": pa.array(np.zeros(len(ids), np.int32)), "pos": pa.array(np.arange(len(ids), dtype=np.int32)), "id": pa.array(ids, pa.int64())}))
            got = self.db.sql(ENCODE_ROWS.format(rounds=rounds, odd=_ODD if self.ranked else _FIRST)).to_arrow_table()
            ids = got["id"].to_numpy()
            if got["step"][0].as_py() < rounds:
                self.db.execute(f"SET memory_limit = '{MEMORY_MB}MB'")
                return ids.astype("<u4").tobytes()

    def encode_chunks(self, data: bytes, ends: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, stop, texts = strings(data, ends, opens)
        pieces = [p.encode("utf-8", "surrogatepass") for t in texts for p in self.pattern.findall(t)]
        place = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        made = self.merge(list(place))
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        flat = np.frombuffer(b"".join(made), "<u4")
        at = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        count = size[at]
        ids = flat[np.repeat(begin[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())] if len(at) else flat
        # a piece's bytes are counted at its last id
        width = np.zeros(len(ids), np.int64)
        width[np.cumsum(count) - 1] = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return split_ids(order, stop, ids, width)

    def decode(self, texts: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id list; an unknown id raises KeyError."""
        out: list[list[bytes]] = [[] for _ in texts]
        slices = [(i, t[lo : lo + DECODE_IDS]) for i, t in enumerate(texts) for lo in range(0, len(t), DECODE_IDS)]
        lo = 0
        while lo < len(slices):
            hi, n = lo, 0
            while hi < len(slices) and (hi == lo or n + len(slices[hi][1]) <= DECODE_IDS):
                n += len(slices[hi][1])
                hi += 1
            run = [x for _, x in slices[lo:hi]]
            flat = np.concatenate(run).astype(np.int64)
            at = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
            if (self.known[at] != flat).any():
                raise KeyError(int(flat[self.known[at] != flat][0]))
            off = np.cumsum([0, *map(len, run)]).astype(np.int32)
            self.db.register("texts", pa.table({"doc": pa.array(np.arange(lo, hi, dtype=np.int32)), "ids": pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int32)))}))
            for k, data in sorted(self.db.execute(DECODE).fetchall()):
                out[slices[k][0]].append(data)
            lo = hi
        return [b"".join(x) for x in out]


class BpeEncoder(Encoder):
    def __init__(self, ranks: bytes, pattern: str):
        self.bpe = Bpe(ranks, pattern)
        super().__init__(self.bpe.encode_chunks, self.bpe.whole)


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with their ids as little-endian unsigned 32-bit integers in a binary column. Null texts count as empty, which has no ids.

    A column of docs named like out_col is replaced; all others pass.
    """
    name = uuid.uuid4().hex
    kept = [c for c in docs.columns if c != out_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.withColumn(out_col, F.lit(b"")).schema

    def run(batch: pa.RecordBatch):
        enc = Encoder.of(name, lambda: BpeEncoder(ranks, pattern))
        ids = [x.tobytes() for x in enc.encode(batch.column(text_col))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*kept, out_col])

    return rows.mapInArrow(by_batch(run, 2048), schema)


def decode(rows: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with the bytes of their ids; null ids give null."""
    name = uuid.uuid4().hex
    kept = [c for c in rows.columns if c != out_col]
    rows = rows.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.withColumn(out_col, F.lit(b"")).schema

    def run(batch: pa.RecordBatch):
        enc = Encoder.of(name, lambda: BpeEncoder(ranks, pattern))
        ids = batch.column(ids_col).to_pylist()
        data = enc.bpe.decode([np.frombuffer(x or b"", "<u4") for x in ids])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else d for x, d in zip(ids, data, strict=True)], pa.binary())], names=[*kept, out_col])

    return rows.mapInArrow(by_batch(run, 256), schema)


def digests(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids, and digest both in one pass over each batch."""
    name = uuid.uuid4().hex
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch):
        enc = Encoder.of(name, lambda: BpeEncoder(ranks, pattern))
        ids = list(enc.encode(batch.column("text")))
        data = enc.bpe.decode(ids)
        yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in data])], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(by_batch(run, 2048), f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
