"""MPEG audio columns: writing Layer III streams, and reading those of all versions and layers, byte by byte, without a decoder.

A payload is stored losslessly in the main-data area of MPEG-1 Layer III frames (128 to 320 kbit/s, 44.1 kHz, stereo, each with a CRC) whose side
information claims no coded audio, so a player hears silence and the bytes are ancillary data. The stream has an ID3v2 tag and a frame
with a variable-bitrate table before them. The reader trusts none of it: it finds frames by resynchronising on headers, parses
the tag and the table, verifies every checksum, and derives exact durations and seek offsets from the frames themselves.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: kbit/s by (MPEG-1 or not, layer) and index; sampling rates by version and index; samples in a frame.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES_OF = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
SAMPLES_OF = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
#: Widths in bits of Layer II's allocation, as (width, subbands): for two or three classes of rate in MPEG-1, and for MPEG-2.
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "2": ((4, 4), (3, 7), (2, 19))}
BITRATES, RATES = KBITS[True, 3], RATES_OF["1"]
HEADER, CRC, SIDE_STEREO = 4, 2, 32
TAG_OWNER = b"lexispark payload"
_SIDE = bytes(SIDE_STEREO)
_SYNC = re.compile(rb"\xff[\xe0-\xff]|ID3|TAG")


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def frame_crc(data: bytes, bits: int | None = None) -> int:
    """CRC-16 with polynomial 0x8005 from 0xFFFF, of the first so many bits of data, or of all."""
    c, whole = 0xFFFF, len(data) if bits is None else bits // 8
    for x in data[:whole]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ x]
    for i in range(0 if bits is None else bits % 8):
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ (data[whole] >> 7 - i & 1) else 0)) & 0xFFFF
    return c


def frame_length(kbits: int, rate: int, padding: int) -> int:
    return 144000 * kbits // rate + padding


def _frame_head(index: int) -> bytes:
    """Sync, MPEG-1, Layer III, CRC present, bitrate index, 44.1 kHz, no padding, stereo; the CRC; empty side information."""
    head = bytes([0xFF, 0xFA, index << 4, 0x00])
    return head + struct.pack(">H", frame_crc(head[2:] + _SIDE)) + _SIDE


_HEADS = {i: _frame_head(i) for i in range(1, 15)}
_ROOM = {i: frame_length(BITRATES[i], RATES[0], 0) - HEADER - CRC - SIDE_STEREO for i in range(1, 15)}
_LARGEST = 14


def _synchsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def padded(data: bytes) -> bytes:
    """data with bytes 0 appended up to a positive multiple of 64."""
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def write(payload: bytes) -> bytes:
    """A stream whose frames hold the payload: largest frames, then the smallest frame that holds the rest."""
    room = _ROOM[_LARGEST]
    full, rest = divmod(len(payload), room)
    bodies = [_HEADS[_LARGEST] + payload[i * room : (i + 1) * room] for i in range(full)]
    if rest:
        index = next(i for i in range(1, 15) if _ROOM[i] >= rest)
        bodies.append(_HEADS[index] + payload[full * room :].ljust(_ROOM[index], b"\0"))
    audio = sum(map(len, bodies))
    # the table's frame: magic, flags for frames, bytes and seek points, 100 seek points in 1/256 of the bytes
    n, first = len(bodies), _HEADS[5]
    size = frame_length(BITRATES[5], RATES[0], 0)
    total = size + audio
    points = bytes(min(255, 256 * (size + sum(map(len, bodies[: p * n // 100]))) // total) if n <= 200 else min(255, 256 * (size + p * n // 100 * len(bodies[0])) // total) for p in range(100))
    table = first + b"Xing" + struct.pack(">III", 7, n, total) + points
    content = TAG_OWNER + b"\0" + struct.pack(">Q", len(payload))
    frame = b"PRIV" + _synchsafe(len(content)) + b"\0\0" + content
    return b"ID3\x04\0\0" + _synchsafe(len(frame)) + frame + table.ljust(size, b"\0") + b"".join(bodies)


@dataclass
class Audio:
    """What a stream holds. offsets: the byte at which each audio frame begins; skipped: bytes outside frames and tags."""

    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    duration_us: int = 0
    kbits_least: int = 0
    kbits_most: int = 0
    bad_crc: int = 0
    unchecked: int = 0
    skipped: int = 0
    tags: dict = field(default_factory=dict)
    table: dict | None = None
    payload: bytes = b""


@dataclass(frozen=True)
class Header:
    """A frame's header: bytes in the frame, kbit/s, rate, samples, layer, MPEG-1 or not, channels, first subband that joint stereo shares, CRC or not, bytes of Layer III's side information."""

    length: int
    kbits: int
    rate: int
    samples: int
    layer: int
    first: bool
    channels: int
    bound: int
    checked: bool
    side: int


@lru_cache(4096)
def _parsed(head: bytes) -> Header | None:
    """A valid header of any version and layer; free-format streams (index 0) are not read."""
    version, layer = {0: "2.5", 2: "2", 3: "1"}.get(head[1] >> 3 & 3), 4 - (head[1] >> 1 & 3)
    index, rate, padding = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1
    if head[0] != 0xFF or head[1] < 0xE0 or version is None or layer == 4 or not 0 < index < 15 or rate == 3:
        return None
    first, mode = version == "1", head[3] >> 6
    kbits, hertz = KBITS[first, layer][index], RATES_OF[version][rate]
    length = (12000 * kbits // hertz + padding) * 4 if layer == 1 else SAMPLES_OF[first, layer] * 125 * kbits // hertz + padding
    side = 0 if layer < 3 else (17 if mode == 3 else 32) if first else 9 if mode == 3 else 17
    return Header(length, kbits, hertz, SAMPLES_OF[first, layer], layer, first, 1 if mode == 3 else 2, 4 * (1 + (head[3] >> 4 & 3)) if mode == 1 else 32, not head[1] & 1, side)


def _header(data: bytes, at: int) -> Header | None:
    return _parsed(data[at : at + HEADER]) if at + HEADER <= len(data) and data[at] == 0xFF else None


def _follows(data: bytes, at: int, before: int) -> bool:
    """Whether a header of the same version, layer and rate as the one at before is there."""
    return _header(data, at) is not None and (data[at + 1] ^ data[before + 1]) & 0xFE == 0 and (data[at + 2] ^ data[before + 2]) & 0x0C == 0


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left, self.read = int.from_bytes(data, "big"), 8 * len(data), 0

    def take(self, n: int) -> int:
        self.left -= n
        self.read += n
        return self.value >> max(self.left, 0) & (1 << n) - 1


def _layer_2_bits(h: Header, body: bytes) -> int:
    """Bits of a Layer II frame's allocation and scale-factor selection, which its CRC covers."""
    each = h.kbits // h.channels
    table = "2" if not h.first else "a" if each >= 56 and (h.rate == 48000 or each <= 80) else "b" if each >= 96 else "d" if h.rate == 32000 else "c"
    widths = [w for w, n in ALLOCATION[table] for _ in range(n)]
    bits, used = _Bits(body), 0
    for band, width in enumerate(widths):
        shared = band >= h.bound and h.channels == 2
        for _ in range(1 if shared else h.channels):
            used += (bits.take(width) > 0) * (2 if shared else 1)
    return bits.read + 2 * used


def _checksum_right(data: bytes, at: int, h: Header) -> bool:
    """Whether a frame's CRC fits what it covers: the header's last two bytes, and the side information or (Layers I and II) the allocation."""
    body = at + HEADER + CRC
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 1:
        bits = 4 * (min(h.bound, 32) * h.channels + (32 - h.bound)) if h.channels == 2 else 128
    else:
        bits = _layer_2_bits(h, data[body : min(at + h.length, body + 64)])
    covered = data[at + 2 : at + HEADER] + data[body : body + -(-bits // 8)]
    return body + -(-bits // 8) <= at + h.length and frame_crc(covered, 16 + bits) == struct.unpack(">H", data[at + HEADER : body])[0]


def _tag(data: bytes, at: int, tags: dict) -> int:
    """Reads the ID3v2 tag at a place, of version 2.2 to 2.4, and returns where it ends. Sizes of frames are plain up to 2.3 and synchsafe in 2.4."""
    version, flags, n = data[at + 3], data[at + 5], len(data)
    end = min(n, at + 10 + _unsafe(data[at + 6 : at + 10]))
    body = data[at + 10 : end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    i = 0
    if flags & 0x40 and version > 2 and len(body) >= 4:
        i = _unsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    width, head = (3, 6) if version == 2 else (4, 10)
    while i + head <= len(body) and body[i : i + width].isalnum():
        raw = body[i + width : i + 2 * width]
        size = _unsafe(raw) if version >= 4 else int.from_bytes(raw, "big")
        name, value = body[i : i + width].decode("latin-1"), body[i + head : i + head + size]
        if version >= 4 and body[i + 9] & 2:
            value = value.replace(b"\xff\x00", b"\xff")
        owner, _, own = value.partition(b"\0")
        if name == "PRIV":
            tags["PRIV:" + owner.decode("latin-1")] = own
        else:
            tags[name] = value
        i += head + size
    return min(n, end + 10 * bool(version >= 4 and flags & 0x10))


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table that a first frame may hold instead of sound: Xing's (Info) or VBRI's."""
    body = at + HEADER + CRC * h.checked + h.side
    if data[body : body + 4] in (b"Xing", b"Info") and body + 8 <= at + h.length:
        flags, i, table = struct.unpack(">I", data[body + 4 : body + 8])[0], body + 8, {}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                table[key] = int.from_bytes(data[i : i + 4], "big")
                i += 4
        if flags & 4:
            table["points"] = list(data[i : i + 100])
        return table
    body = at + HEADER + 32
    if data[body : body + 4] == b"VBRI" and body + 26 <= at + h.length:
        n_bytes, frames, entries, scale, width, every = struct.unpack(">IIHHHH", data[body + 10 : body + 26])
        own = data[body + 26 : min(at + h.length, body + 26 + entries * width)]
        return {"frames": frames, "bytes": n_bytes, "every": every, "points": [int.from_bytes(own[k : k + width], "big") * scale for k in range(0, len(own) - width + 1, width)] if width else []}
    return None


def read(data: bytes) -> Audio:
    """Parse a stream. Junk before, between and after frames is skipped; a frame counts if its checksum is right or another header of its kind, a tag or the end follows it."""
    out, at, n = Audio(), 0, len(data)
    parts: list[bytes] = []
    known: dict[bytes, bool] = {}
    by_rate: dict[int, int] = {}
    while at < n:
        if data[at : at + 3] == b"ID3" and at + 10 <= n and 2 <= data[at + 3] <= 4 and not any(x & 0x80 for x in data[at + 6 : at + 10]):
            at = _tag(data, at, out.tags)
            continue
        if data[at : at + 3] == b"TAG" and at + 128 == n:
            out.tags["ID3v1"] = data[at + 3 : n]
            break
        h, right = _header(data, at), None
        if h is not None and at + h.length <= n and h.checked:
            # Layer III repeats a few heads in a stream, so their checksums are kept
            head = data[at : at + HEADER + CRC + h.side] if h.layer == 3 else b""
            if (right := known.get(head)) is None:
                right = _checksum_right(data, at, h)
                if head:
                    known[head] = right
                    if len(known) > 1000:
                        known.clear()
        if h is None or at + h.length > n or not (right or at + h.length == n or _follows(data, at + h.length, at) or data[at + h.length : at + h.length + 3] in (b"TAG", b"ID3")):
            # resynchronise at the next byte that can begin a frame or a tag
            m = _SYNC.search(data, at + 1)
            found = m.start() if m else n
            out.skipped += found - at
            at = found
            continue
        if h.checked:
            out.bad_crc += not right
        else:
            out.unchecked += 1
        table = _table(data, at, h) if not out.offsets and out.table is None and h.layer == 3 else None
        if table is not None:
            out.table = table
        else:
            out.offsets.append(at)
            out.samples += h.samples
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
            out.rate = out.rate or h.rate
            out.kbits_least, out.kbits_most = min(out.kbits_least or h.kbits, h.kbits), max(out.kbits_most, h.kbits)
            parts.append(data[at + HEADER + CRC * h.checked + h.side : at + h.length])
        at += h.length
    out.duration_us = sum(n_samples * 1_000_000 // rate for rate, n_samples in by_rate.items())
    stored = b"".join(parts)
    size = out.tags.get("PRIV:" + TAG_OWNER.decode())
    out.payload = stored[: struct.unpack(">Q", size)[0]] if size and len(size) == 8 else stored
    return out


def feature(a: Audio) -> str:
    """The stored columns in one string: frames, samples, microseconds, bitrates, failures, what the table says, a checksum of the seek offsets."""
    offsets = zlib.crc32(struct.pack(f"<{len(a.offsets)}Q", *a.offsets))
    table = a.table or {}
    return f"frames={len(a.offsets)};samples={a.samples};us={a.duration_us};kbits={a.kbits_least}-{a.kbits_most};bad_crc={a.bad_crc};skipped={a.skipped};table={table.get('frames')}/{table.get('bytes')};seek={offsets}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text as a stream. Null counts as the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write(padded((x or "").encode())) for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, "doc_id long, media binary")


def parse(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each stream: doc_id, n_frames, samples, rate, duration_us, offsets (of frames), bad_crc, unchecked, skipped, payload. Null has no frames."""
    schema = "doc_id long, n_frames long, samples long, rate int, duration_us long, offsets array<long>, bad_crc long, unchecked long, skipped long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [read(x or b"") for x in part.column(1).to_pylist()]
                cols = [[len(a.offsets) for a in found], [a.samples for a in found], [a.rate for a in found], [a.duration_us for a in found], [a.offsets for a in found], [a.bad_crc for a in found], [a.unchecked for a in found], [a.skipped for a in found], [a.payload for a in found]]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_frames", "samples", "rate", "duration_us", "offsets", "bad_crc", "unchecked", "skipped", "payload"])

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("_m")).mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, from the stream that is written, read back and parsed, in one pass without a shuffle.

    doc_id, n_bytes, payload_bytes, payload_sha256 (of the payload read back), tail_crc32 (of its last 64 bytes), media_bytes, media_sha256,
    feature, duration_us, seek_offsets (the byte at which each frame begins). Null counts as the empty text (64 bytes 0). Equal texts have equal values; ids may be null or repeat. Other columns
    are left out.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, seek_offsets array<long>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, rows = batch.slice(at, 512), []
                for x in part.column(1):
                    raw = (x.as_py() or "").encode()
                    media = write(padded(raw))
                    a = read(media)
                    rows.append((len(raw), len(a.payload), hashlib.sha256(a.payload).hexdigest(), zlib.crc32(a.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(a), a.duration_us, a.offsets))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, schema)
