"""Operator 2: MPEG audio in a binary column: exact durations, frame offsets, tags, tables and checksums.

A stream is read as a chain of frames of versions 1, 2 and 2.5 and layers I, II and III. Where no frame header stands,
the reader looks for the next place at which two frames follow on each other with the same version, layer
and sampling rate (or one that ends where the audio ends): bytes passed over are junk, and each such place after the first frame is a resynchronisation. A header that no other follows is passed over too if such a place comes before its frame would end. ID3v2
(title and artist; also where several stand in a row), ID3v1 and APEv2 are read or passed over as tags. A first frame with a Xing, Info or VBRI table carries no
sound and is left out of the sums; an encoder's delay and padding are
taken off the duration. Its frame and byte counts are held against what was found, and so are the places of its seek table, which are stored as offsets (`toc`):
those of Xing and Info stand for hundredths of the duration in 256ths of the bytes, those of VBRI for some frames each. A place agrees within a 256th of the bytes and a frame, or the table's scale.
Checksums are verified for all layers; of layer II, bit allocation and scale factor selection are parsed for it. The length of free-format frames (bit rate 0) is
the distance to the next header alike, held against the one after; they keep it through the stream. A last frame that is cut off counts as truncated and adds nothing.

A null or empty value, or one without any frame, gives a row with 0 frames, null properties and an empty list.
Repeated rows each give a row; an empty table gives an empty one; extra columns are ignored.

The driver's tables have no audio, so `media` makes the column from documents: each text becomes the payload of a valid stream of
a kind that depends on doc_id, with tags, tables, checksums, junk and damage.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



_V1 = {1: [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448], 2: [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384], 3: [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]}
_V2 = {1: [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256], 2: [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
_V2[3] = _V2[2]
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_VERSION = {3: "1", 2: "2", 0: "2.5"}
#: Bytes within which the next free-format frame must begin.
LONGEST_FREE = 16_384

PARSED = (
    "doc_id long, version string, layer int, sample_rate int, channels int, frames int, samples long, duration double, mode string, bitrate double, title string, artist string, "
    "info_table string, info_frames int, info_agrees boolean, info_bytes long, bytes_agree boolean, quality int, toc array<long>, toc_agrees boolean, delay int, padding int, crc_checked int, crc_bad int, resyncs int, junk_bytes long, tag_bytes long, truncated boolean, seek array<long>"
)


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    channels: int
    joint: int  # -1, or the bound of subbands
    length: int  # 0: free format, to be found
    samples: int
    pad: int = 0

    @property
    def like(self) -> tuple[int, int, int]:
        return self.version, self.layer, self.rate

    @property
    def side(self) -> int:
        """Bytes of side information of layer III."""
        return (17 if self.channels == 1 else 32) if self.version == 3 else (9 if self.channels == 1 else 17)

    @property
    def covered(self) -> int:
        """Bytes after the checksum that it covers; -1 if not known."""
        if self.layer == 3:
            return self.side
        if self.layer == 1:
            bits = 4 * 32 if self.channels == 1 else 8 * 32 if self.joint < 0 else 8 * self.joint + 4 * (32 - self.joint)
            return bits // 8
        return -1


_known: dict[int, Header | None] = {}


def header(data: bytes, at: int) -> Header | None:
    if at + 4 > len(data) or data[at] != 0xFF:
        return None
    word = int.from_bytes(data[at + 1 : at + 4])
    if word not in _known:
        if len(_known) > 100_000:
            _known.clear()
        _known[word] = _read(word)
    return _known[word]


def _read(word: int) -> Header | None:
    if word >> 21 != 7:
        return None
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    index, rate = word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer == 4 or index == 15 or rate == 3 or word & 3 == 2:
        return None
    bitrate = (_V1 if version == 3 else _V2)[layer][index - 1] if index else 0
    hz, pad = _RATES[version][rate], word >> 9 & 1
    if layer == 1:
        length, samples = (12_000 * bitrate // hz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 3 else 576
        length = samples // 8 * 1000 * bitrate // hz + pad
    mode = word >> 6 & 3
    return Header(version, layer, not word >> 16 & 1, bitrate, hz, 1 if mode == 3 else 2, (word >> 4 & 3) * 4 + 4 if mode == 1 else -1, length if index else 0, samples, pad * (4 if layer == 1 else 1))


def _alike(a: Header, b: Header | None) -> bool:
    return b is not None and b.like == a.like and (b.bitrate == 0) == (a.bitrate == 0)


def _free(data: bytes, at: int, end: int, h: Header) -> int:
    """Bytes of a free-format frame without its padding, from the next two headers alike; 0 if they aren't there."""
    q = at + 8
    while 0 <= (q := data.find(b"\xff", q, min(end, at + LONGEST_FREE))):
        n = header(data, q)
        if _alike(h, n):
            base = q - at - h.pad
            after = q + base + n.pad
            if after == end or (after < end and _alike(h, header(data, after))):
                return base
        q += 1
    return 0


def _sized(h: Header, base: int) -> Header:
    """A free-format header with its length and rate."""
    length = base + h.pad
    return replace(h, length=length, bitrate=round(length * 8 * h.rate / h.samples / 1000))


#: Bits for the allocation of each subband in layer II, by table.
_BITS = {k: [n for n, times in v for _ in range(times)] for k, v in {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}.items()}


def _allocation(h: Header) -> list[int]:
    per = h.bitrate / h.channels
    if h.version != 3:
        return _BITS["low"]
    if per >= 56 and (h.rate == 48_000 or per <= 80):
        return _BITS["a"]
    if h.rate != 48_000 and per >= 96:
        return _BITS["b"]
    return _BITS["c" if h.rate != 32_000 and per <= 48 else "d"]


def covered_bits(h: Header, body: bytes) -> int:
    """Bits of a layer II frame after its checksum that this covers: the allocation, and two bits for each subband and channel that has one; -1 if they don't fit."""
    widths = _allocation(h)
    bound = len(widths) if h.joint < 0 else min(h.joint, len(widths))
    most = sum(w * (h.channels if k < bound else 1) for k, w in enumerate(widths))
    if most > 8 * len(body):
        return -1
    bits, left, chosen = int.from_bytes(body[: most + 7 >> 3]), 8 * (most + 7 >> 3), 0
    for k, w in enumerate(widths):
        for _ in range(h.channels if k < bound else 1):
            left -= w
            chosen += (bits >> left & (1 << w) - 1 > 0) * (1 if k < bound else h.channels)
    return most + 2 * chosen if most + 2 * chosen <= 8 * len(body) else -1


def crc_bits(data: bytes, bits: int) -> int:
    """CRC-16 of the first bits of some bytes."""
    c = 0xFFFF
    for byte in data[: bits >> 3]:
        c = (c << 8 & 0xFFFF) ^ int(_CRC[c >> 8 ^ byte])
    for k in range(bits & 7):
        top = c >> 15 ^ (data[bits >> 3] >> 7 - k & 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def _table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out[i] = c
    return out


_CRC = _table()


def crc(rows: np.ndarray) -> np.ndarray:
    """CRC-16 of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for i in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, i]]
    return c


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(b: bytes) -> str:
    if not b:
        return ""
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0], "latin-1")
    return b[1:].decode(code, "replace").split("\0")[0]


@dataclass
class Stream:
    frames: list[tuple[int, Header]] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    tag_bytes: int = 0
    junk: int = 0
    resyncs: int = 0
    truncated: bool = False
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    table_at: int = 0
    quality: int | None = None
    hundredths: bytes | None = None
    entries: list[int] | None = None
    per_entry: int = 0
    scale: int = 0
    delay: int = 0
    padding: int = 0
    checked: int = 0
    bad: int = 0


def _id3v2(data: bytes, at: int, s: Stream) -> int:
    """Bytes of an ID3v2 tag at this place, 0 if none."""
    head = data[at : at + 10]
    if len(head) < 10 or head[:3] != b"ID3" or max(head[6:10]) > 127:
        return 0
    size, major = _synchsafe(head[6:10]), head[3]
    body = data[at + 10 : at + 10 + size]
    p = 0
    if head[5] & 0x40 and len(body) >= 4:  # extended header
        p = _synchsafe(body[:4]) if major == 4 else int.from_bytes(body[:4]) + 4
    while major >= 3 and p + 10 <= len(body) and body[p]:
        name = body[p : p + 4]
        n = _synchsafe(body[p + 4 : p + 8]) if major == 4 else int.from_bytes(body[p + 4 : p + 8])
        for key, frame in (("title", b"TIT2"), ("artist", b"TPE1")):
            if name == frame:
                s.tags.setdefault(key, _text(body[p + 10 : p + 10 + n]))
        p += 10 + n
    return min(len(data) - at, 10 + size + (10 if head[5] & 0x10 else 0))


def _ends(data: bytes, s: Stream) -> int:
    """Where the audio ends: before ID3v1 and APEv2."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        for key, a, b in (("title", 3, 33), ("artist", 33, 63)):
            s.tags.setdefault(key, data[end - 128 + a : end - 128 + b].split(b"\0")[0].decode("latin-1").rstrip())
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little") + (32 if data[end - 9] & 0x80 else 0)
        end = max(0, end - size)
    s.tag_bytes += len(data) - end
    return end


def _sync(data: bytes, at: int, end: int) -> int:
    """Next place from `at` on where the chain of frames can go on; `end` if none."""
    while True:
        at = data.find(b"\xff", at, end)
        if at < 0:
            return end
        h = header(data, at)
        if h and not h.length:
            if _free(data, at, end, h):
                return at
        elif h and at + h.length <= end:
            after = at + h.length
            if after == end or _alike(h, header(data, after)):
                return at
        at += 1


def _info(data: bytes, at: int, h: Header, s: Stream) -> bool:
    """Read the table of a first frame, if it has one."""
    for start in ((at + 4 + h.side, at + 6 + h.side) if h.protected else (at + 4 + h.side,)) if h.layer == 3 else ():
        name = data[start : start + 4]
        if name in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[start + 4 : start + 8]), start + 8
            if flags & 1:
                s.table_frames = int.from_bytes(data[p : p + 4])
                p += 4
            if flags & 2:
                s.table_bytes = int.from_bytes(data[p : p + 4])
                p += 4
            if flags & 4:
                s.hundredths = data[p : p + 100]
                p += 100
            if flags & 8:
                s.quality = int.from_bytes(data[p : p + 4])
                p += 4
            s.table, s.table_at = name.decode(), at
            if p + 24 <= at + h.length and data[p : p + 4].isalnum():
                gap = int.from_bytes(data[p + 21 : p + 24])
                s.delay, s.padding = gap >> 12, gap & 0xFFF
            return True
    if h.layer == 3 and data[at + 36 : at + 40] == b"VBRI" and 54 <= h.length:
        s.table, s.table_at = "VBRI", at
        _, _, s.quality, s.table_bytes, s.table_frames = struct.unpack(">HHHII", data[at + 40 : at + 54])
        if 62 <= h.length:
            n, s.scale, size, s.per_entry = struct.unpack(">HHHH", data[at + 54 : at + 62])
            if 1 <= size <= 4 and 62 + n * size <= h.length:
                s.entries = [int.from_bytes(data[p : p + size]) for p in range(at + 62, at + 62 + n * size, size)]
        return True
    return False


def read(data: bytes) -> Stream:
    s = Stream()
    end = _ends(data, s)
    at = 0
    while n := _id3v2(data, at, s):
        at += n
        s.tag_bytes += n
    like, base = None, 0
    while at < end:
        h = header(data, at)
        if h and not h.length and base:
            h = _sized(h, base)
        if h and h.length and like == h.like:
            after = at + h.length
            if after != end and not _alike(h, header(data, after)):
                # A chain that begins before this frame would end shows that its header is none.
                to = _sync(data, at + 1, end)
                if to < min(after, end):
                    s.junk, s.resyncs, at = s.junk + to - at, s.resyncs + 1, to
                    continue
                if after > end:
                    s.truncated = True
                    break
        else:
            n = _id3v2(data, at, s)
            if n:
                at += n
                s.tag_bytes += n
                continue
            to = _sync(data, at, end)
            if not (like is None and to < end and to == at):
                # A frame that is cut off by the end of the stream is no junk.
                if to == end and h and like is not None and h.like == like:
                    s.truncated = True
                    break
                s.junk += to - at
                s.resyncs += like is not None and to < end
                at = to
                if at >= end:
                    break
            h = header(data, at)
            if not h.length:
                base = _free(data, at, end, h)
                h = _sized(h, base)
            like = h.like
        if s.frames or s.table or not _info(data, at, h, s):
            s.frames.append((at, h))
        at += h.length
    by: dict[int, list[int]] = {}
    for place, h in s.frames:
        if h.protected and h.covered >= 0 and 6 + h.covered <= h.length:
            by.setdefault(h.covered, []).append(place)
    for place, h in s.frames:
        if h.protected and h.layer == 2:
            body = data[place + 6 : place + h.length]
            bits = covered_bits(h, body)
            if bits >= 0:
                s.checked += 1
                s.bad += crc_bits(data[place + 2 : place + 4] + body[: bits + 7 >> 3], 16 + bits) != int.from_bytes(data[place + 4 : place + 6])
    raw = np.frombuffer(data, np.uint8)
    for covered, places in by.items():
        p = np.array(places)[:, None]
        rows = raw[p + np.r_[2, 3, np.arange(6, 6 + covered)]]
        want = raw[p[:, 0] + 4].astype(np.uint16) << np.uint16(8) | raw[p[:, 0] + 5]
        s.checked += len(places)
        s.bad += int((crc(rows) != want).sum())
    return s


def seek_table(s: Stream) -> tuple[list[int] | None, bool | None]:
    """Offsets that the first frame's table gives, and whether they are those of the frames found."""
    if not s.frames or (s.hundredths is None and not s.entries):
        return None, None
    place = np.array([p for p, _ in s.frames] + [s.frames[-1][0] + s.frames[-1][1].length])
    longest = int(np.diff(place).max())
    if s.entries:
        toc = place[0] + np.r_[0, np.cumsum(np.array(s.entries, np.int64) * s.scale)]
        at = np.minimum(np.arange(len(toc)) * s.per_entry, len(s.frames))
        # Each entry is rounded to the scale.
        near = np.abs(toc - place[at]) <= np.arange(len(toc)) * max(0, s.scale - 1)
    else:
        size = s.table_bytes or int(place[-1] - s.table_at)
        toc = s.table_at + np.frombuffer(s.hundredths, np.uint8).astype(np.int64) * size // 256
        at = np.arange(len(toc)) * len(s.frames) // 100
        near = np.abs(toc - place[at]) <= size // 256 + 1 + longest
    return toc.tolist(), bool(near.all())


def _row(doc: int, data: bytes | None) -> dict:
    s = read(data or b"")
    out = {"doc_id": doc, "frames": len(s.frames), "samples": 0, "duration": 0.0, "title": s.tags.get("title"), "artist": s.tags.get("artist"), "info_table": s.table, "info_frames": s.table_frames, "delay": s.delay, "padding": s.padding}
    out |= {"crc_checked": s.checked, "crc_bad": s.bad, "resyncs": s.resyncs, "junk_bytes": s.junk, "tag_bytes": s.tag_bytes, "truncated": s.truncated, "seek": [p for p, _ in s.frames]}
    if s.frames:
        h = s.frames[0][1]
        total = sum(x.samples for _, x in s.frames)
        samples = max(0, total - s.delay - s.padding)
        rates = {x.bitrate for _, x in s.frames}
        # Frames of another rate after damage count at their own rate.
        seconds = sum(x.samples / x.rate for _, x in s.frames) - (total - samples) / h.rate if len({x.rate for _, x in s.frames}) > 1 else samples / h.rate
        length = sum(x.length for _, x in s.frames)
        out |= {"version": _VERSION[h.version], "layer": h.layer, "sample_rate": h.rate, "channels": h.channels, "samples": samples, "duration": seconds, "mode": "cbr" if len(rates) == 1 else "vbr"}
        toc, same = seek_table(s)
        found = s.frames[-1][0] + s.frames[-1][1].length - (s.table_at if s.table in ("Xing", "Info") else s.frames[0][0])
        out |= {"info_bytes": s.table_bytes, "bytes_agree": None if s.table_bytes is None else s.table_bytes == found, "quality": s.quality, "toc": toc, "toc_agrees": same}
        out |= {"bitrate": length * 8 / 1000 / (total / h.rate), "info_agrees": None if s.table_frames is None else s.table_frames == len(s.frames)}
    return out


def parse(media: DataFrame, key: str = "doc_id", audio: str = "audio") -> DataFrame:
    """PARSED for each row of a table with a key and a binary column."""
    names = [x.split()[0] for x in PARSED.split(", ")]
    kinds = {"doc_id": pa.int64(), "version": pa.string(), "layer": pa.int32(), "sample_rate": pa.int32(), "channels": pa.int32(), "frames": pa.int32(), "samples": pa.int64(), "duration": pa.float64(), "mode": pa.string(), "bitrate": pa.float64(), "title": pa.string(), "artist": pa.string(), "info_table": pa.string(), "info_frames": pa.int32(), "info_agrees": pa.bool_(), "info_bytes": pa.int64(), "bytes_agree": pa.bool_(), "quality": pa.int32(), "toc": pa.list_(pa.int64()), "toc_agrees": pa.bool_(), "delay": pa.int32(), "padding": pa.int32(), "crc_checked": pa.int32(), "crc_bad": pa.int32(), "resyncs": pa.int32(), "junk_bytes": pa.int64(), "tag_bytes": pa.int64(), "truncated": pa.bool_(), "seek": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [_row(k.as_py(), a.as_py()) for k, a in zip(part.column(0), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[n]) for n in names], names)

    return media.select(F.col(key).cast("long").alias("doc_id"), F.col(audio).alias("audio")).mapInArrow(run, PARSED)


def frame_header(version: int, layer: int, protected: bool, index: int, rate: int, pad: int, mode: int) -> bytes:
    word = 0x7FF << 21 | version << 19 | (4 - layer) << 17 | (0 if protected else 1) << 16 | index << 12 | rate << 10 | pad << 9 | mode << 6
    return word.to_bytes(4)


def _id3(title: str, artist: str) -> bytes:
    body = b"".join(name + struct.pack(">I", len(v) + 1) + b"\0\0\3" + v for name, v in ((b"TIT2", title.encode()), (b"TPE1", artist.encode())))
    n = len(body)
    return b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def render(doc: int, text: str, source: str) -> bytes:
    """A stream whose frames carry the text's bytes; its kind follows from doc."""
    seed = hashlib.blake2b(str(doc).encode(), digest_size=8).digest()
    version, layer = (3, 2, 3, 0, 3)[seed[0] % 5], (3, 3, 3, 1, 2)[seed[1] % 5]
    protected, vbr, mode, rate = seed[2] % 3 == 0, seed[3] % 2 == 0, (0, 1, 3)[seed[4] % 3], seed[5] % 3
    base = 5 + seed[6] % 5
    # One stream in eight is of free format, of frames of its own length.
    own = 400 + 4 * seed[6] if seed[4] % 8 == 7 else 0
    data, out, p, k, damage = text.encode(), [], 0, 0, seed[7] % 4 == 0
    # A frame alone would not tell its length.
    own = own if len(data) > 2 * own else 0
    frames: list[bytes] = []
    while p < len(data) or not frames:
        head = frame_header(version, layer, protected, 0 if own else base + (k * 7 % 3 if vbr else 0), rate, k % 5 == 0 and 1, mode)
        h = _read(int.from_bytes(head[1:]))
        h = _sized(h, own) if own else h
        room = h.length - 4 - 2 * protected
        body = data[p : p + room].ljust(room, b"\0")
        p += room
        if protected:
            bits = covered_bits(h, body) if h.layer == 2 else 8 * h.covered
            sum_ = crc_bits(head[2:] + body, 16 + max(0, bits))
            if damage and k % 50 == 7:
                sum_ ^= 0x5A5A
            head += sum_.to_bytes(2)
        frames.append(head + body)
        k += 1
    for i, f in enumerate(frames):
        if damage and i and i % 97 == 0:
            out.append(b"\xff\xfb\x90 lost sync \xff\xff" + seed)
        out.append(f)
    first = b""
    if layer == 3 and seed[1] & 64:
        head = frame_header(version, 3, False, base + 4, rate, 0, mode)
        h = _read(int.from_bytes(head[1:]))
        at = np.r_[0, np.cumsum([len(f) for f in out])]
        place = at[:-1][[f is not None and f[:2] != b"\xff\xfb" or len(f) > 40 for f in out]]
        whole = int(at[-1])
        if seed[1] & 32 and h.length > 200:
            size = whole + h.length
            toc = bytes(min(255, (int(place[i * len(frames) // 100]) + h.length) * 256 // size) for i in range(100))
            first = (head + b"\0" * h.side + (b"Xing" if vbr else b"Info") + struct.pack(">III", 15, len(frames), size) + toc + struct.pack(">I", 78) + b"LAVC" + b"\0" * 17 + (576 << 12 | 100).to_bytes(3)).ljust(h.length, b"\0")
        else:
            per = max(1, -(-len(frames) // 40))
            steps = np.diff(np.r_[place[::per], whole]).tolist() if 62 + 2 * (len(place[::per])) <= h.length and not own else []
            scale = max(1, -(-max(steps, default=1) // 65_535))
            first = (head + b"\0" * 32 + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 50, whole, len(frames), len(steps), scale, 2, per) + b"".join(struct.pack(">H", x // scale) for x in steps)).ljust(h.length, b"\0")
    tag = _id3(f"document {doc}", source) if seed[2] & 64 else b""
    tail = (b"TAG" + f"document {doc}".encode().ljust(30, b"\0") + source.encode()[:30].ljust(30, b"\0")).ljust(128, b"\0") if seed[3] & 64 else b""
    return tag + first + b"".join(out) + tail


def media(docs: DataFrame) -> DataFrame:
    """doc_id and audio; a null text has null audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [None if t.as_py() is None else render(d.as_py(), t.as_py(), s.as_py() or "") for d, t, s in zip(part.column(0), part.column(1), part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["doc_id", "audio"])

    source = "source" if "source" in docs.columns else F.lit("").alias("source")
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", source).mapInArrow(run, "doc_id long, audio binary")
