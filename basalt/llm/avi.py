"""Media columns: AVI files of motion JPEG, their intra frames, and shots.

Payload bytes are the units that a JPEG file stores without loss, its quantized coefficients: a byte
b is the coefficient b - 128 (b < 128) or b - 127, which is never zero. A frame is 24 x 24 samples of
one component, nine blocks, so 576 bytes. With the Huffman tables below a coefficient of s bits has a
code of 9 - s bits, every coefficient takes nine bits and a block 72 bytes; each block is a restart
interval, so blocks begin at whole bytes. These are plain baseline JPEG frames in a plain AVI file
(RIFF, `hdrl`, `movi`, `idx1`).

Reading goes the usual way: the RIFF chunks and the index `idx1`, each frame's segments, removal of
stuffed bytes, Huffman decoding by the frame's own tables (the code lengths show where a code ends),
coefficients back to bytes. Shots are runs of frames: a shot begins where the difference between the
histograms of neighbouring frames is above three times what chance makes of it and above median + 3
median deviations of the other differences around it, or above mean + 3 deviations of all of them. So short files, both ends and cuts close to each other count.

Defined results: a null text is empty; an empty text is one frame of padding; a frame index that
points outside the file, or a payload that isn't in frames, raises ValueError; equal texts give equal
files and features; repeated rows are stored each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basalt.llm.common import map_arrow

SIDE, BLOCKS, FRAME = 24, 9, 576
#: Frames a second of the clips.
RATE = 25
BINS, AROUND, DEVIATIONS = 16, 8, 3.0


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def _head() -> bytes:
    """All of a frame before its entropy-coded data. Codes of 1 to 8 bits, one each, for 8 to 1 bits of value."""
    lengths = bytes([1] * 8 + [0] * 8)
    table = lengths + bytes(range(8, 0, -1))
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + table)
        + _segment(0xC4, b"\x10" + table)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


@cache
def _codes() -> np.ndarray:
    """The nine bits of each byte: the code of its coefficient's size, then the coefficient's bits."""
    out = np.zeros(256, np.uint16)
    for b in range(256):
        v = b - 128 if b < 128 else b - 127
        s = abs(v).bit_length()
        out[b] = int("1" * (8 - s) + "0" + format(v if v > 0 else v + (1 << s) - 1, f"0{s}b"), 2)
    return out


def pack_nine(codes: np.ndarray) -> np.ndarray:
    """Eight codes of nine bits as nine bytes; the last axis has a multiple of eight."""
    c = codes.reshape(*codes.shape[:-1], -1, 8)
    out = np.empty((*c.shape[:-1], 9), np.uint8)
    out[..., 0] = c[..., 0] >> 1
    for k in range(1, 8):
        out[..., k] = (c[..., k - 1] << (8 - k)) | (c[..., k] >> (k + 1))
    out[..., 8] = c[..., 7]
    return out.reshape(*codes.shape[:-1], -1)


def unpack_nine(packed: np.ndarray) -> np.ndarray:
    b = packed.reshape(*packed.shape[:-1], -1, 9).astype(np.uint16)
    out = np.empty((*b.shape[:-1], 8), np.uint16)
    for k in range(8):
        out[..., k] = ((b[..., k] << (k + 1)) | (b[..., k + 1] >> (7 - k))) & 511
    return out.reshape(*packed.shape[:-1], -1)


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """One JPEG for each 576 bytes."""
    if len(payload) % FRAME or not len(payload):
        raise ValueError("the payload is not in whole frames")
    blocks = pack_nine(_codes()[payload].reshape(-1, 64))  # 72 bytes for each block
    out, head = [], _head()
    for frame in blocks.reshape(-1, BLOCKS, 72):
        parts = [head]
        for k in range(BLOCKS):
            parts.append(frame[k].tobytes().replace(b"\xff", b"\xff\x00"))
            parts.append(bytes([0xFF, 0xD0 + k]) if k < BLOCKS - 1 else b"\xff\xd9")
        out.append(b"".join(parts))
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes]) -> bytes:
    """A RIFF AVI file with one video stream of type MJPG and an index."""
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        movi.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    body = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_index(media: bytes) -> tuple[list[tuple[int, int]], int]:
    """(place and size of each frame, microseconds a frame) from the RIFF chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    if struct.unpack_from("<I", media, 4)[0] + 8 > len(media):
        raise ValueError("the file is cut off")
    at, movi, entries, micros = 12, None, b"", 1_000_000 // RATE
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            micros = struct.unpack_from("<I", media, at + 20)[0]
        elif name == b"idx1":
            entries = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi is None:
        raise ValueError("no movi list")
    out = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", entries):
        if name[2:] in (b"dc", b"db"):
            place = movi + offset + 8
            if place + size > len(media) or media[place - 8 : place - 4] != name:
                raise ValueError("the index points outside the file")
            out.append((place, size))
    return out, micros


@cache
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(length of the code, value size) by the next eight bits, for a Huffman table of codes up to eight bits."""
    length, value = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    code, at = 0, 16
    for bits in range(1, 17):
        for _ in range(table[bits - 1]):
            if bits > 8:
                raise ValueError("a code of more than eight bits")
            span = 1 << (8 - bits)
            length[code * span : (code + 1) * span], value[code * span : (code + 1) * span] = bits, table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return length, value


@cache
def _values(table: bytes) -> np.ndarray:
    """Byte by the nine bits of a coefficient, -1 where they are no whole coefficient."""
    length, value = _lookup(table)
    out = np.full(512, -1, np.int16)
    for x in range(512):
        n, s = int(length[x >> 1]), int(value[x >> 1])
        if n and n + s == 9:
            raw = x & ((1 << s) - 1)
            v = raw if raw >> (s - 1) else raw - (1 << s) + 1
            out[x] = v + 128 if v < 0 else v + 127
    return out


@cache
def _parse_head(head: bytes) -> tuple[bytes, bytes]:
    """Huffman tables (DC, AC) of a frame, from its segments."""
    at, tables = 2, {}
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xC4:
            tables[body[0]] = body[1:]
        at += 2 + size
    return tables[0x00], tables[0x10]


def decode_frames(media: bytes, index: list[tuple[int, int]]) -> np.ndarray:
    """The stored bytes of all frames, a row of 576 for each."""
    packed, tables = [], set()
    for place, size in index:
        frame = media[place : place + size]
        sos = frame.index(b"\xff\xda")
        begin = sos + 2 + struct.unpack_from(">H", frame, sos + 2)[0]
        tables.add(_parse_head(frame[:begin]))
        data = frame[begin : frame.rindex(b"\xff\xd9")]
        for k in range(BLOCKS - 1):
            data = data.replace(bytes([0xFF, 0xD0 + k]), b"", 1)
        packed.append(data.replace(b"\xff\x00", b"\xff"))
    flat = b"".join(packed)
    if len(tables) != 1 or len(flat) != len(index) * BLOCKS * 72:
        raise ValueError("frames of another kind")
    dc, ac = tables.pop()
    nine = unpack_nine(np.frombuffer(flat, np.uint8).reshape(-1, 72))
    out = _values(ac)[nine]
    out[:, 0] = _values(dc)[nine[:, 0]]
    if (out < 0).any():
        raise ValueError("a code that the table doesn't have")
    return out.astype(np.uint8).reshape(len(index), FRAME)


def shots(frames: np.ndarray) -> list[int]:
    """First frame of each shot, by histogram differences against the others around them."""
    n = len(frames)
    if n < 2:
        return [0]
    hist = np.bincount((np.arange(n)[:, None] * BINS + (frames >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    scale = np.ones(n)
    # padding at the end isn't content (no UTF-8 text has a byte 255); the rest counts as a whole frame
    padding = FRAME - len(frames[-1].tobytes().rstrip(b"\xff"))
    if 0 < padding < FRAME:
        scale[-1] = FRAME / (FRAME - padding)
        hist[-1, -1] -= padding
    share = hist * scale[:, None]
    diff = np.abs(np.diff(share, axis=0)).sum(axis=1)
    # what chance makes of two frames of one source, bin by bin
    chance = np.sqrt(share[1:] * scale[1:, None] + share[:-1]).sum(axis=1)
    padded = np.pad(diff, AROUND, constant_values=np.inf)
    others = np.delete(np.lib.stride_tricks.sliding_window_view(padded, 2 * AROUND + 1), AROUND, axis=1)
    m = np.isfinite(others).sum(axis=1)
    middle = _median(others, m)
    with np.errstate(invalid="ignore"):
        spread = 1.4826 * _median(np.where(np.isfinite(others), np.abs(others - middle[:, None]), np.inf), m)
    found = (diff > middle + DEVIATIONS * spread) & (diff > DEVIATIONS * chance)
    sums, squares = np.append(0, np.cumsum(diff)), np.append(0, np.cumsum(diff * diff))
    low, high = np.maximum(np.arange(len(diff)) - AROUND, 0), np.minimum(np.arange(len(diff)) + AROUND + 1, len(diff))
    mean = (sums[high] - sums[low]) / (m + 1)
    deviation = np.sqrt(np.maximum((squares[high] - squares[low]) / (m + 1) - mean * mean, 0))
    found |= (diff > mean + DEVIATIONS * deviation + 1e-6) & (m > 9)  # of a window of ten or fewer no value is so far out
    return [0, *(np.nonzero(found)[0] + 1).tolist()]


def _median(rows: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Median of the m finite values of each row; 0 where there are none."""
    rows, at = np.sort(rows, axis=1), np.arange(len(rows))
    return np.where(m > 0, (rows[at, np.maximum(m - 1, 0) // 2] + rows[at, np.minimum(m // 2, rows.shape[1] - 1)]) / 2, 0)


def payload(text: str | None) -> tuple[bytes, np.ndarray]:
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // FRAME)) * FRAME
    return raw, np.frombuffer(raw.ljust(size, b"\xff"), np.uint8)


MEDIA = "doc_id long, media binary"
CLIPS = "doc_id long, clip int, first_frame int, frames int, start_ms long, end_ms long"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as an AVI file."""

    def run(batch):
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([write_avi(encode_frames(payload(t)[1]))], pa.binary())], ["doc_id", "media"])

    return map_arrow(_selected(docs, id_col, text_col), run, MEDIA)


def clips(media: DataFrame) -> DataFrame:
    """A row for each shot of each AVI file (doc_id, media), with its times; a null file has none."""

    def run(batch):
        rows = []
        for i, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
            if m:
                index, micros = read_index(m)
                at = [*shots(decode_frames(m, index)), len(index)]
                rows += [(i, k, a, b - a, a * micros // 1000, b * micros // 1000) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "clip", "first_frame", "frames", "start_ms", "end_ms"])

    return map_arrow(media.select("doc_id", "media"), run, CLIPS)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and describe both."""

    def run(batch):
        rows = []
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw, units = payload(t)
            media = write_avi(encode_frames(units))
            index, micros = read_index(media)
            frames = decode_frames(media, index)
            back, at = frames.tobytes(), shots(frames)
            spread = np.bincount(frames.ravel() >> 6, minlength=4)
            feature = f"frames={len(frames)};ms={len(frames) * micros // 1000};shots={','.join(map(str, at))};n_shots={len(at)};quarters={','.join(map(str, spread.tolist()))}"
            rows.append((i, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_arrow(_selected(docs, id_col, text_col), run, DIGESTS)
