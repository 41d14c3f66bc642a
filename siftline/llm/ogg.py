"""Media columns in Ogg: texts stored as 8-bit samples, read back page by page.

A stored stream multiplexes two logical streams. The sample stream has one
packet of FRAME samples per frame; the note stream has one packet with the
number of samples that carry content. Writing is plain RFC 3533: pages with
lacing values, granule positions, sequence numbers and a checksum. Reading
verifies every page's checksum and sequence number, joins packets across lacing
values and pages, splits the logical streams by serial number and derives
timestamps from granule positions (samples ended by the page over RATE).
"""

from __future__ import annotations

import hashlib
import zlib
from struct import pack, unpack_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, stored, table

#: Samples in a packet and their rate; both belong to the stored format.
FRAME, RATE = 576, 8000
SAMPLES, NOTES = 0x53414D50, 0x4E4F5445
#: Bytes of a page header before its lacing values.
HEAD = 27
_FLIP = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def page_crc(page: bytes) -> int:
    """Checksum of a page whose checksum field is zero: polynomial 0x04C11DB7, most significant bit first, from 0.

    zlib runs the same polynomial least significant bit first, so the bytes go in
    with their bits reversed and the result comes out likewise.
    """
    crc = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_FLIP), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(serial: int, number: int, flags: int, granule: int, laces: bytes, body: bytes) -> bytes:
    head = pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(laces)]) + laces
    crc = page_crc(head + body)
    return head[:22] + pack("<I", crc) + head[26:] + body


def write_stream(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of one logical stream; a packet that overruns a page's 255 lacing values continues on the next."""
    pages: list[bytes] = []
    laces, body, granule, carried = bytearray(), bytearray(), -1, False
    for packet, end in zip(packets, granules, strict=True):
        own, at = lacing(len(packet)), 0
        for i in range(0, len(own)):
            if len(laces) == 255:
                pages.append(page(serial, len(pages), (2 if not pages else 0) | carried, granule, bytes(laces), bytes(body)))
                carried = i > 0
                laces, body, granule = bytearray(), bytearray(), -1
            laces.append(own[i])
            body += packet[at : at + own[i]]
            at += own[i]
        granule = end
    pages.append(page(serial, len(pages), (2 if not pages else 0) | carried | 4, granule, bytes(laces), bytes(body)))
    return pages


def encode(payload: bytes, content: int) -> bytes:
    """payload (a multiple of FRAME samples) and the number of its samples that carry content, as one multiplexed Ogg file."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    samples = write_stream(SAMPLES, frames, [FRAME * (i + 1) for i in range(len(frames))])
    notes = write_stream(NOTES, [pack("<4sQ", b"NOTE", content)], [0])
    return b"".join([samples[0], *notes, *samples[1:]])  # all first pages stand before any other


def decode(media: bytes) -> dict[int, dict]:
    """Logical streams by serial number: their packets, the timestamp at the end of each page, and the number of pages.

    A wrong capture pattern, checksum, sequence number, continuation flag or end
    raises ValueError.
    """
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + HEAD > len(media):
            raise ValueError(f"no page at byte {at}")
        _, _, flags, granule, serial, number, crc, n = unpack_from("<4sBBqIIIB", media, at)
        laces = media[at + HEAD : at + HEAD + n]
        end = at + HEAD + n + sum(laces)
        if end > len(media) or page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"page at byte {at}: checksum differs")
        own = streams.setdefault(serial, {"packets": [], "times": [], "pages": 0, "open": b"", "ended": False})
        if number != own["pages"] or bool(flags & 2) != (number == 0) or bool(flags & 1) != bool(own["open"]) or own["ended"]:
            raise ValueError(f"page at byte {at}: out of sequence")
        own["pages"] += 1
        own["ended"] = bool(flags & 4)
        body, held = at + HEAD + n, own["open"]
        for size in laces:
            held += media[body : body + size]
            body += size
            if size < 255:
                own["packets"].append(held)
                held = b""
        own["open"] = held
        if granule >= 0:
            own["times"].append(granule / RATE)
        at = end
    if any(x["open"] or not x["ended"] for x in streams.values()):
        raise ValueError("a stream isn't ended")
    return streams


def features(payload: bytes, stream: dict) -> str:
    """Figures of the samples read back: duration, pages, packets, mean, root mean square around it, entropy in bits."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    mean = float((n * np.arange(256)).sum() / len(x))
    rms = float(np.sqrt((n * (np.arange(256) - mean) ** 2).sum() / len(x)))
    return f"seconds={stream['times'][-1]:.3f};pages={stream['pages']};packets={len(stream['packets'])};mean={mean:.4f};rms={rms:.4f};bits={float(-(p * np.log2(p)).sum()):.4f}"


def _store(batch: pa.RecordBatch, id_col: str, text_col: str):
    media = []
    for text in batch.column(text_col).to_pylist():
        data = (text or "").encode("utf-8", "surrogatepass")
        payload = data + b"\xff" * (-len(data) % FRAME if data else FRAME)
        media.append(encode(payload, len(data)))
    yield pa.record_batch({id_col: batch.column(id_col), "media": pa.array(media, pa.binary())})


def _read(batch: pa.RecordBatch, id_col: str):
    rows = []
    for media in batch.column("media").to_pylist():
        streams = decode(media)
        samples = streams[SAMPLES]
        payload = b"".join(samples["packets"])
        (content,) = unpack_from("<4xQ", streams[NOTES]["packets"][0])
        rows.append((content, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, samples), samples["times"]))
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "page_seconds")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id_col, *names])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text's UTF-8 bytes, filled with 255 up to a positive multiple of FRAME, as an Ogg file in a binary column.

    Null texts count as empty and store one frame of filling. Ids pass as they
    are, null and repeated ones too; other columns are left behind.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(by_batch(lambda b: _store(b, id_col, text_col), 128), rows.drop(text_col).withColumn("media", F.lit(b"")).schema)


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per stored file with what its pages say; a damaged file fails the job with the byte at fault."""
    schema = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, page_seconds array<double>"
    kind = dict(media.dtypes)[id_col]
    return media.select(id_col, "media").mapInArrow(by_batch(lambda b: _read(b, id_col), 128), f"`{id_col}` {kind}, {schema}")


def op5_ogg_media(spark, sf_dir: str) -> DataFrame:
    kept = stored(to_media(table(spark, sf_dir, "documents")), "media")
    return read_media(kept).drop("page_seconds")
