"""MPEG audio as a binary column: frame index, tags, variable-bitrate tables, checksums, seek offsets.

``parse`` walks a stream from frame to frame. After a break it searches for the next header that is
valid and is followed by another of the same kind (or by the end of the audio), so a false sync word
inside other bytes does not count. ``wrap`` and ``unwrap`` store any bytes losslessly: frames of
silence whose ancillary bytes carry units of 192 bytes, behind an ID3 tag and a Xing frame.

Edge cases: null bytes give null columns; empty or foreign bytes give 0 frames, duration 0 and all
bytes counted as junk; a truncated last frame is not indexed and counts as junk.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), samples a second by version.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@lru_cache(4096)
def header(word: int) -> tuple[int, int, int, int, int, bool, int] | None:
    """(length, samples, rate, layer, version, has checksum, side information bytes) of a 32-bit header word."""
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    k, r = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or k in (0, 15) or r == 3 or word & 3 == 2:
        return None
    kbits, rate, pad, mono = KBITS[version == 3, layer][k], RATES[version][r], word >> 9 & 1, word >> 6 & 3 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    length = (12000 * kbits // rate + pad) * 4 if layer == 1 else samples * 125 * kbits // rate + pad
    side = 0 if layer != 3 else ((17 if mono else 32) if version == 3 else (9 if mono else 17))
    return length, samples, rate, layer, version, not word >> 16 & 1, side


def _crc_table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return tuple(out)


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The checksum of a frame's protected bytes (polynomial 0x8005, start 0xFFFF)."""
    c = 0xFFFF
    for byte in data:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ byte]
    return c


def _syncsafe(raw: bytes) -> int:
    return (raw[0] & 127) << 21 | (raw[1] & 127) << 14 | (raw[2] & 127) << 7 | raw[3] & 127


def _string(raw: bytes) -> str:
    kind, body = (raw[0], raw[1:]) if raw else (3, b"")
    return body.decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(kind, "utf-8"), "replace").rstrip("\0")


def id3v2(data: bytes, at: int = 0) -> tuple[int, dict[str, str]]:
    """(bytes of the tag, its text frames); (0, {}) where none begins."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return 0, {}
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size)
    p, found = at + 10, {}
    if flags & 64 and p + 4 <= end:
        p += _syncsafe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4])
    while p + 10 <= end and data[p] and major in (3, 4):
        name = data[p : p + 4].decode("latin-1")
        n = _syncsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8])
        if n <= 0 or p + 10 + n > end:
            break
        if name[0] == "T":
            value = _string(data[p + 10 : p + 10 + n])
            key, _, rest = value.partition("\0")
            found["TXXX:" + key if name == "TXXX" else name] = rest if name == "TXXX" else value
        p += 10 + n
    return min(len(data) - at, 10 + size + (10 if flags & 16 else 0)), found


def vbr_table(frame: bytes, side: int) -> dict | None:
    """The Xing, Info or VBRI table of a first frame."""
    at = 4 + side
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, p = int.from_bytes(frame[at + 4 : at + 8]), at + 8
        out = {"kind": frame[at : at + 4].decode(), "frames": None, "bytes": None, "toc": None}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key], p = int.from_bytes(frame[p : p + 4]), p + 4
        if flags & 4 and len(frame) >= p + 100:
            out["toc"] = list(frame[p : p + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        entries, scale, width, _ = struct.unpack(">HHHH", frame[54:62])
        body = frame[62 : 62 + entries * width]
        toc = [scale * int.from_bytes(body[i : i + width]) for i in range(0, len(body) - width + 1, width)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def _next(data: bytes, p: int, end: int, like: tuple | None) -> int:
    """The next trustworthy header at p or later, or end."""
    while (p := data.find(b"\xff", p, end)) >= 0:
        h = header(int.from_bytes(data[p : p + 4])) if p + 4 <= end else None
        if h and p + h[0] <= end and (like is None or h[2:5] == like):
            q = p + h[0]
            after = header(int.from_bytes(data[q : q + 4])) if q + 4 <= end else None
            if q == end or after and after[2:5] == h[2:5]:
                return p
        p += 1
    return end


def parse(data: bytes) -> dict:
    """What a stream holds; offsets are bytes from its start, the table's frame is not audio."""
    p, tags = id3v2(data)
    more = p
    while more:  # further tags may follow
        more, found = id3v2(data, p)
        tags, p = found | tags, p + more
    end = len(data)
    if end - p >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.setdefault("ID3v1", data[end + 3 : end + 33].decode("latin-1").rstrip("\0 "))
    out = {"tags": tags, "offsets": [], "lengths": [], "samples": 0, "rate": 0, "layer": 0, "version": 0, "junk": 0, "resyncs": 0, "crc_ok": 0, "crc_bad": 0, "vbr": None}
    like, lost, first = None, True, True
    while p < end:
        h = header(int.from_bytes(data[p : p + 4])) if p + 4 <= end else None
        if h is None or p + h[0] > end or lost or like != h[2:5]:
            q = _next(data, p, end, like)
            out["junk"] += q - p
            out["resyncs"] += q > p
            p, lost = q, False
            if p >= end:
                break
            h = header(int.from_bytes(data[p : p + 4]))
        length, samples, rate, layer, version, checked, side = h
        like = h[2:5]
        if checked and layer == 3:
            good = crc16(data[p + 2 : p + 4] + data[p + 6 : p + 6 + side]) == int.from_bytes(data[p + 4 : p + 6])
            out["crc_ok" if good else "crc_bad"] += 1
        table = vbr_table(data[p : p + length], side) if first and layer == 3 else None
        first = False
        if table:
            out["vbr"] = table
        else:
            out["offsets"].append(p)
            out["lengths"].append(length)
            out["samples"] += samples
        out["rate"], out["layer"], out["version"] = rate, layer, version
        p += length
    return out


@lru_cache(16)
def _head(units: int) -> bytes:
    """Header, checksum and silent side information of a mono 48 kHz Layer III frame for so many units."""
    k = KBITS[True, 3].index({1: 80, 2: 160, 3: 224, 4: 320}[units])
    word = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | k << 12 | 1 << 10 | 3 << 6)
    return word + struct.pack(">H", crc16(word[2:] + bytes(17))) + bytes(17)


def pad(raw: bytes) -> bytes:
    """raw and bytes 32 up to a positive multiple of UNIT."""
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))


def wrap(raw: bytes) -> bytes:
    """An MPEG-1 Layer III stream that holds pad(raw)."""
    payload = pad(raw)
    note = b"\x03payload\0" + str(len(raw)).encode()
    frame = b"TXXX" + struct.pack(">IH", len(note), 0) + note
    tag = b"ID3\x03\0\0" + bytes((len(frame) >> s) & 127 for s in (21, 14, 7, 0)) + frame
    frames = []
    for p in range(0, len(payload), 4 * UNIT):
        part = payload[p : p + 4 * UNIT]
        head = _head(len(part) // UNIT)
        frames.append((head + part).ljust(header(int.from_bytes(head[:4]))[0], b"\0"))
    total = UNIT + sum(map(len, frames))
    full = len(frames[0])
    toc = bytes(min(255, 256 * (UNIT + (i * len(frames) // 100) * full) // total) for i in range(100))
    word = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | 1 << 16 | 5 << 12 | 1 << 10 | 3 << 6)  # 64 kbit/s, 192 bytes
    table = (word + bytes(17) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc).ljust(UNIT, b"\0")
    return tag + table + b"".join(frames)


def unwrap(data: bytes, index: dict | None = None) -> tuple[bytes, int]:
    """(padded payload, bytes before padding) of a stream made by wrap."""
    index = index or parse(data)
    parts = [data[p + 23 : p + 23 + (n - 23) // UNIT * UNIT] for p, n in zip(index["offsets"], index["lengths"], strict=True)]
    return b"".join(parts), int(index["tags"]["TXXX:payload"])


INDEX = "frames bigint, samples bigint, rate int, duration double, version string, layer int, vbr string, vbr_frames bigint, vbr_bytes bigint, crc_ok bigint, crc_bad bigint, junk_bytes bigint, resyncs bigint, tags map<string,string>, seek_offsets array<bigint>"
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


def _row(x: dict) -> dict:
    vbr = x["vbr"] or {}
    return {
        "frames": len(x["offsets"]), "samples": x["samples"], "rate": x["rate"], "duration": x["samples"] / x["rate"] if x["rate"] else 0.0,
        "version": VERSIONS[x["version"]] if x["rate"] else None, "layer": x["layer"], "vbr": vbr.get("kind"), "vbr_frames": vbr.get("frames"), "vbr_bytes": vbr.get("bytes"),
        "crc_ok": x["crc_ok"], "crc_bad": x["crc_bad"], "junk_bytes": x["junk"], "resyncs": x["resyncs"], "tags": list(x["tags"].items()), "seek_offsets": x["offsets"],
    }


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array"):
        return pa.list_(pa.int64())
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}.get(kind) or pa.map_(pa.string(), pa.string())


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    return [(name, _arrow(kind)) for name, kind in (part.split(" ", 1) for part in ddl.split(", "))]


def frame_index(df: DataFrame, media: str, key: str) -> DataFrame:
    """(key, the columns of INDEX) for a binary column; all null where the bytes are null."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [None if b is None else _row(parse(b)) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r and r[name] for r in rows], kind) for name, kind in _fields(INDEX))], names=["key", *(n for n, _ in _fields(INDEX))])

    return df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(run, f"key {key_type}, {INDEX}").withColumnRenamed("key", key)


STORED = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, frames bigint, samples bigint, seek_offsets array<bigint>"


def store(df: DataFrame, text: str, key: str, keep_media: bool = False) -> DataFrame:
    """Each text as a stream, read back: (key, the columns of STORED[, media binary]). Null is empty."""
    key_type = df.schema[key].dataType.simpleString()
    ddl = STORED + (", media binary" if keep_media else "")

    def one(raw: bytes) -> dict:
        media = wrap(raw)
        x = parse(media)
        payload, n = unwrap(media, x)
        feature = f"mpeg{VERSIONS[x['version']]}.l{x['layer']};rate={x['rate']};frames={len(x['offsets'])};samples={x['samples']};vbr={x['vbr']['kind']}:{x['vbr']['frames']};crc={x['crc_ok']}/{x['crc_bad']};junk={x['junk']};half={x['offsets'][len(x['offsets']) // 2]};adler={zlib.adler32(payload)}"
        return {
            "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": binascii.crc32(payload[-16:]), "media_bytes": len(media),
            "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature, "frames": len(x["offsets"]), "samples": x["samples"], "seek_offsets": x["offsets"], "media": media if keep_media else None,
        }

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):  # bounds the streams held at once
                part = batch.slice(lo, 500)
                rows = [one(b or b"") for b in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[name] for r in rows], kind) for name, kind in _fields(ddl))], names=["key", *(n for n, _ in _fields(ddl))])

    raw = F.col(text).cast("string").cast("binary")
    return df.select(F.col(key).alias("key"), raw.alias("raw")).mapInArrow(run, f"key {key_type}, {ddl}").withColumnRenamed("key", key)
