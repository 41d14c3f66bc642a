"""Token files, BPE, Ogg and WARC: exact round trips, the public libraries' results, damaged input."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm import bpe, chunkwords, ogg, tokenfile, warc

P = pytest.importorskip("public_tokenizers")
TEXTS = ["", None, "a", " ", "  a", "a  b", "a   b \n c", "tab\tand\r\nline ", "it's we'll don't", "Ünïcödé  ñ日本語 text", "x" * 700 + " y", "a,b. c, d.. e", "trailing, ", "\n\n a", " nbsp", "é" * 600, "<|endoftext|> plain", "same words " * 50, "123 4567, 89.", "a  <|endoftext|>  b <|endoftext|><|endoftext|>", " <|endoftext|", "'s ''s don't. x' 's", "a\u00a0b \u3000 c \u2003d", "(see [x]), e.g. --y-- z!? \x1c \x7f q"]


def fuzz(n, seed):
    """Texts of spaces of all kinds, marks, letters and digits, in which any cut that isn't a match's end shows."""
    rng = np.random.default_rng(seed)
    pool = [*" " * 12, *"\t\n\r\x0b\x1c\x85\xa0\u2003\u3000\u200b", *"abcXYZ", *"éßñ日Ж", *"0129\u0663", *",.;'-_()'\x7f", "'s", "'ll", "\U0001f600", "\u0301"]
    return ["".join(rng.choice(pool) for _ in range(rng.integers(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_join_to_the_library_ids(name):
    from tokenizers import Tokenizer

    enc = tokenfile.library_encoder(P.path(name))()
    own = Tokenizer.from_file(P.path(name))
    assert enc.whole == name.startswith("word")
    texts = [*TEXTS, *fuzz(600, 3), "<|endoftext|> among " + "words " * 9]
    for _ in range(2):  # the second time from memory
        got = [x.tolist() for x in enc.encode(pa.array(texts))]
        assert got == [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 50256 in got[-1] or enc.whole


def test_very_long_texts_are_cut_into_parts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(chunkwords, "BATCH", 1000)
    enc = tokenfile.library_encoder(P.path("byte_bpe_50k.json"))()
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [" ".join(fuzz(400, 5)), "x" * 30_000 + " y", " " * 9000, "a"]
    assert [x.tolist() for x in enc.encode(pa.array(texts))] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_equals_tiktoken_and_decodes():
    import tiktoken

    data = bpe.rank_file(P.path("byte_bpe_multi_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.BpeEncoder(data, P.PATTERN)
    rng = np.random.default_rng(0)
    more = ["".join(chr(c) for c in rng.integers(32, 1200, 40)) for _ in range(60)] + ["ab" * 400, "word" * 300]
    texts = [*TEXTS, *more, *fuzz(300, 7), "".join(rng.choice(list("abcdefgh"), 3000)), "".join(rng.choice([" ", "\n"], 900)), "é" * 2000]
    ids = list(enc.encode(pa.array(texts)))
    assert [x.tolist() for x in ids] == [own.encode_ordinary(t or "") for t in texts]
    assert enc.bpe.decode(ids) == [(t or "").encode() for t in texts]
    with pytest.raises(KeyError):
        enc.bpe.decode([np.array([len(ranks)], "<u4")])


def small_ranks(tokens):
    """A rank file of the 256 bytes and further tokens."""
    return b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in {**{bytes([i]): i for i in range(256)}, **tokens}.items())


def brute_bpe(piece, ranks):
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ranks_beyond_16_bits_and_sparse_ranks():
    tokens = {b"ca": 70_000, b"ab": 65_600, b"zc": 65_537, b"adz": 131_072, b"ad": 66_000, b"zz": 200_000, b"abc": 80_000}
    data = small_ranks(tokens)
    ranks = {bytes([i]): i for i in range(256)} | tokens
    b = bpe.Bpe(data, chunkwords.PATTERN)
    rng = np.random.default_rng(2)
    pieces = [b"caazzcadz", *("".join(rng.choice(list("abcdz"), n)).encode() for n in (3, 9, 40, 511, 512, 700, 1500))]
    got = [np.frombuffer(x, "<u4") for x in b.merge(pieces)]
    assert [x.tolist() for x in got] == [brute_bpe(p, ranks) for p in pieces]
    assert b.decode(got) == pieces
    with pytest.raises(KeyError):
        b.decode([np.array([300], "<u4")])


@pytest.mark.parametrize("ordered", [True, False])
def test_long_pieces_in_split_rounds(monkeypatch, ordered):
    """Also where a token ranks below its parts, so that only the leftmost pair may be contracted at a time."""
    monkeypatch.setattr(bpe, "ROWS", 3000)
    names = ["aa", "ab", "ba", "bb", "aab", "abab", "bba", "aaaa", "abb"]
    tokens = {t.encode(): 300 + (i if ordered else -i) for i, t in enumerate(names)}
    b = bpe.Bpe(small_ranks(tokens), chunkwords.PATTERN)
    assert b.ranked == ordered
    rng = np.random.default_rng(4)
    pieces = [b"a" * 1200, b"ab" * 500, "".join(rng.choice(["a", "b"], 1100)).encode(), "".join(rng.choice(["a", "b", "c"], 900)).encode()]
    ranks = {bytes([i]): i for i in range(256)} | tokens
    assert [np.frombuffer(x, "<u4").tolist() for x in b.merge(pieces)] == [brute_bpe(p, ranks) for p in pieces]


def test_another_pattern_takes_whole_texts():
    import tiktoken

    data = bpe.rank_file(P.path("byte_bpe_multi_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    pattern = r"[^ ]+ [^ ]+|[^ ]+|\s+"
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["one two, three. four five", " a  b ", *fuzz(80, 9)]
    assert [x.tolist() for x in bpe.BpeEncoder(data, pattern).encode(pa.array(texts))] == [own.encode_ordinary(t) for t in texts]


def test_ten_million_ids_of_one_text():
    import tiktoken

    data = bpe.rank_file(P.path("byte_bpe_multi_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh123"), 6)) for _ in range(2000)]
    text = " ".join(rng.choice(words, 2_600_000))
    enc = bpe.BpeEncoder(data, P.PATTERN)
    (ids,) = enc.encode(pa.array([text]))
    assert len(ids) > 10_000_000
    assert hashlib.sha256(ids.astype("<u4")).digest() == hashlib.sha256(np.array(own.encode_ordinary(text), "<u4")).digest()
    assert enc.bpe.decode([ids])[0] == text.encode()


def test_bpe_frames(spark):
    data = bpe.rank_file(P.path("byte_bpe_multi_50k.tiktoken"))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "again", "x"), (None, "no id", "x")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, data, P.PATTERN), data, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in out.collect())
    digest = {(r.doc_id, r.decoded_sha256) for r in bpe.digests(df, data, P.PATTERN).collect()}
    assert digest == {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect()}
    assert bpe.digests(df.limit(0), data, P.PATTERN).count() == 0


def test_memory_forgets_but_never_errs(monkeypatch):
    monkeypatch.setattr(chunkwords, "YOUNG", 5)
    m = chunkwords.Memory(12)
    for i in range(40):
        h, g = np.arange(i, i + 3, dtype=np.uint64), np.arange(i, i + 3, dtype=np.uint64) * np.uint64(7)
        known, size, flat = m.find(h, g)
        assert flat.tolist() == [x for k in np.flatnonzero(known) for x in [i + k] * (i + k)] and size[known].tolist() == (h[known]).tolist()
        assert not m.find(h, g + np.uint64(1))[0].any()  # one hash alone isn't enough
        n = h[~known].astype(np.int64)
        m.put(h[~known], g[~known], n, np.repeat(n, n).astype(np.uint32))
        assert m.find(h, g)[0].sum() > 0 and len(m.old.h) + len(m.young.h) <= 20


def test_chunks_of_equal_first_hash_stay_apart(monkeypatch):
    from tokenizers import Tokenizer

    real = chunkwords.hashes
    monkeypatch.setattr(chunkwords, "hashes", lambda *a: (real(*a)[0] & np.uint64(7), real(*a)[1]))
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    enc = tokenfile.library_encoder(P.path("byte_bpe_50k.json"))()
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(pa.array(TEXTS[:12]))] == [own.encode(t or "", add_special_tokens=False).ids for t in TEXTS[:12]]


@pytest.mark.parametrize("seed", range(6))
def test_shards_round_trip(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, rng.choice([1, 2, 300, 50_000, 2**32]), rng.integers(0, 500)).astype(np.uint32) for _ in range(rng.integers(0, 12))]
    if docs and len(docs[0]) > 4:
        docs[0][3] = 2**32 - 1  # an outlier goes to the exception list
    keys = [None, *range(1, len(docs))][: len(docs)]
    data = tokenfile.write_shard(docs, keys, 3, 1, 77)
    part, shard, first, named, sizes, ids = tokenfile.read_shard(data)
    assert (part, shard, first, named) == (3, 1, 77, keys)
    flat = np.concatenate([*docs, np.zeros(0, np.uint32)])
    assert sizes.tolist() == [len(d) for d in docs] and ids.tolist() == flat.tolist()
    if len(flat) > 10:
        a, b = sorted(rng.integers(0, len(flat), 2).tolist())
        assert tokenfile.read_shard(data, a, b).ids.tolist() == flat[a:b].tolist()


def test_token_file_of_a_frame(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i * 7 % 40, f"{t or ''} {i}" if i % 5 else t) for i, t in enumerate(TEXTS * 2)] + [(3, "b again"), (3, "a again"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = tokenfile.read_shards(tokenfile.write_shards(df, tokenfile.library_encoder(P.path("byte_bpe_50k.json")), 2, parts=3)).collect()
    at, expected = 0, []
    for key, text in sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 2], "<u4")
        expected.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert tokenfile.read_shards(tokenfile.write_shards(df.limit(0), tokenfile.library_encoder(P.path("byte_bpe_50k.json")), 2)).count() == 0


def test_shards_as_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 40)
    df = spark.createDataFrame([(f"k{i:02d}", f"text number {i} of some words") for i in range(30)], "name string, body string")
    shards = tokenfile.write_shards(df, tokenfile.library_encoder(P.path("byte_bpe_50k.json")), 2, "name", "body", parts=2)
    rows = sorted(map(tuple, tokenfile.read_shards(shards, "name", "string").collect()), key=lambda r: r[1])
    tokenfile.export(shards, str(tmp_path))
    files = [tokenfile.read_shard(f.read_bytes()) for f in sorted(tmp_path.glob("*.pfr"))]
    assert len(files) > 4 and [k for f in files for k in f.keys] == [r[0] for r in rows] == [f"k{i:02d}" for i in range(30)]
    at = 0
    for f in files:
        for key, n in zip(f.keys, f.sizes.tolist(), strict=True):
            assert (key, at, n) == rows[[r[0] for r in rows].index(key)][:3]
            at += n


def crc_by_bits(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksum_and_long_packets():
    data = bytes(range(256)) * 3
    assert ogg.page_crc(data) == crc_by_bits(data)
    packets = [b"a" * n for n in (0, 254, 255, 256, 70_000, 1)]
    pages = ogg.write_stream(7, packets, list(range(1, 7)))
    got = ogg.decode(b"".join(pages))[7]
    assert got["packets"] == packets and got["pages"] == len(pages) > 1
    assert got["times"][-1] == 6 / ogg.RATE


@pytest.mark.parametrize("at", [30, 200, 5])
def test_a_damaged_page_is_found(at):
    media = bytearray(ogg.encode(b"x" * ogg.FRAME * 100, 5))
    media[at] ^= 1
    with pytest.raises(ValueError):
        ogg.decode(bytes(media))
    with pytest.raises(ValueError):
        ogg.decode(bytes(ogg.encode(b"x" * ogg.FRAME, 5)[:-3]))


def test_media_columns(spark):
    texts = [*TEXTS, "z" * 576, "z" * 577, "long " * 40_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a", "x")], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in ogg.read_media(ogg.to_media(df)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[None].media_sha256 == rows[2].media_sha256 and rows[None].feature == rows[2].feature
    assert ogg.read_media(ogg.to_media(df.limit(0))).count() == 0


def test_warc_revisits(spark, tmp_path):
    bodies = ["<p>a</p>", "", None, "<p>a</p>", "x" * 3_000_000, "\r\n\r\n", "日本"] * 3
    rows = [(i, f"http://h/{i}", b, "y") for i, b in enumerate(bodies)] + [(None, None, "<p>a</p>", "y"), (0, "http://again\r\nX: 1", "<p>a</p>", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    archives = warc.write_archives(df)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, b, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault((b or "").encode(), i)
    for r in got:
        body = next((b or "").encode() for i, _, b, _ in rows if i == r.page_id)
        of = first[body] if r.page_id is not None else None
        assert (r.record_type, r.refers_to) == (("response", None) if of in (None, r.page_id) else ("revisit", of))
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert bytes(r.payload) == (body if r.record_type == "response" else b"")
    warc.export(archives, str(tmp_path))
    assert sum(1 for f in tmp_path.glob("*.warc.gz") for _ in warc.read_records(f.read_bytes())) == len(rows)
    assert warc.read_archives(warc.write_archives(df, min_bytes=100)).filter("record_type = 'revisit'").count() == 2
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0
    names = spark.createDataFrame([("p\r\n/ü", "u", "same"), ("a b", "u", "same"), ("c", "u", None)], "page_id string, url string, html string")
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(names), "string").collect()} == {("p\r\n/ü", "revisit", "a b"), ("a b", "response", None), ("c", "response", None)}
    broken = next(iter(tmp_path.glob("*.warc.gz"))).read_bytes()
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_records(broken[:-9]))
