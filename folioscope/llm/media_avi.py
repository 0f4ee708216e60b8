"""Media columns: motion-JPEG in AVI, read back through the RIFF index, cut into shots.

A payload is laid out in intra frames of 24 x 24: nine 8 x 8 blocks. Baseline
JPEG is exact in its own unit, the quantised coefficient, so that is where the
payload goes: byte b is the coefficient b if b > 127, else b - 255. These 256
values are just the ones of magnitude category 8, whose eight extra bits are then
the byte itself; the Huffman table gives this category a code of eight zeros, so
all lies on whole bytes. Restart markers after each block keep DC predictions at
zero. Frames are ordinary baseline JPEG, and every one is read as such: its tables
come from its own header, and its coefficients from the Huffman codes of its scan,
whatever these tables are; the payload is what the coefficients say.

Media are stored as a column of a parquet table in the shared folder; digests,
features and clips come from the bytes that are read back from it.

Shots: the histograms of successive frames are compared; a cut is a difference
that is the largest of its neighbours and above the mean of those around it by
several deviations. Clips are the runs of frames between cuts, with times.

Frames are coded, decoded and counted in steps, so a long text costs its media
bytes a few times over, and no more; the frames of short texts are decoded together.

Defined cases: null counts as the empty text, which is one frame of padding; equal
texts give equal media and features; repeated rows give repeated results; an empty
table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, scratch, trim, tune

SIDE, BLOCKS, FRAME = 24, 9, 576
FPS = 25
#: Frames coded at once: bounds memory.
STEP = 1024
#: Shots: bins of a histogram, frames on either side, deviations above the mean, least difference.
BINS, AROUND, DEVIATIONS, LEAST = 16, 8, 2.5, 0.10
ZERO_CODE = b"\0" * 7 + b"\x01" + b"\0" * 8 + b"\x08"  # one code of eight bits, for category 8
RESTARTS = [b"\xff" + bytes([0xD0 + k % 8]) for k in range(BLOCKS - 1)] + [b""]
CUT = re.compile(rb"\xff[\xd0-\xd7]")
#: What is added to the extra bits of a value of each category if their first is 0.
LOWEST = np.array([1 - (1 << size) for size in range(16)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\0" + ZERO_CODE)
    + _segment(0xC4, b"\x10" + ZERO_CODE)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)
END = b"\xff\xd9"


# -- frames -----------------------------------------------------------------


def _scan(payload: bytes) -> list[bytes]:
    """The coded blocks of a frame: a code and a unit for each coefficient."""
    coded = bytearray(2 * FRAME)
    coded[1::2] = payload
    return [bytes(coded[k : k + 128]).replace(b"\xff", b"\xff\0") for k in range(0, 2 * FRAME, 128)]


#: A frame without a unit 255 (which is followed by a zero in a scan), and the places of its units.
PLAIN = np.frombuffer(HEADER + b"".join(b"\0" * 128 + r for r in RESTARTS) + END, np.uint8)
UNITS = len(HEADER) + np.concatenate([130 * j + np.arange(1, 128, 2) for j in range(BLOCKS)])


def encode_frames(payload: bytes) -> Iterator[bytes]:
    """JPEG frames of a payload whose length is a multiple of FRAME."""
    for at in range(0, len(payload), STEP * FRAME):
        units = np.frombuffer(payload[at : at + STEP * FRAME], np.uint8).reshape(-1, FRAME)
        laid = np.repeat(PLAIN[None], len(units), axis=0)
        laid[:, UNITS] = units
        data, odd = laid.tobytes(), (units == 255).any(axis=1)
        for k, is_odd in enumerate(odd.tolist()):
            if is_odd:
                yield HEADER + b"".join(map(bytes.__add__, _scan(units[k].tobytes()), RESTARTS)) + END
            else:
                yield data[k * len(PLAIN) : (k + 1) * len(PLAIN)]


def _head(frame: bytes) -> bytes:
    """A frame up to the end of its scan's header."""
    at, marker = 2, 0
    while marker != 0xDA:
        if frame[:2] != b"\xff\xd8" or at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("no JPEG frame with a scan")
        marker = frame[at + 1]
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    return frame[:at]


class Layout(NamedTuple):
    """What a frame's header says: its blocks, the blocks of a restart interval, and the codes, as (bits, code) -> symbol."""

    blocks: int
    interval: int
    dc: dict[tuple[int, int], int]
    ac: dict[tuple[int, int], int]


@functools.lru_cache(maxsize=32)
def _layout(head: bytes) -> Layout:
    at, tables, restart, size = 2, {}, 0, (0, 0)
    while True:
        marker, length = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
        body = head[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC4:
            while body:
                counts, total = body[1:17], sum(body[1:17])
                codes, code, symbols = {}, 0, iter(body[17 : 17 + total])
                for bits, number in enumerate(counts, 1):
                    for _ in range(number):
                        codes[bits, code] = next(symbols)
                        code += 1
                    code <<= 1
                tables[body[0]] = codes
                body = body[17 + total :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            if body[5] != 1 or body[0] != 8:
                raise ValueError("only grey frames of 8 bits are decoded")
            size = struct.unpack(">HH", body[1:5])
        elif marker == 0xDA:
            blocks = -(-size[0] // 8) * -(-size[1] // 8)
            return Layout(blocks, min(restart or blocks, blocks), tables[body[2] >> 4], tables[0x10 | body[2] & 15])


@functools.lru_cache(maxsize=32)
def _lookups(head: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The codes for DC and AC by the next 16 bits: bits of the code * 256 + symbol, 0 where there is no code."""
    found = []
    for codes in _layout(head)[2:]:
        table = np.zeros(1 << 16, np.uint16)
        for (bits, code), symbol in codes.items():
            table[code << 16 - bits : code + 1 << 16 - bits] = bits << 8 | symbol
        found.append(table)
    return found[0], found[1]


def _segments(scans: bytes, marks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes without stuffing and markers, their number at the end of each segment) of scans that end with END each and
    hold the same marks."""
    raw = np.frombuffer(scans, np.uint8)
    high, after = raw[:-1] == 255, raw[1:]
    ends = np.flatnonzero(high & (after != 0) & (after != 255))
    if len(ends) % len(marks) or (raw[ends + 1].reshape(-1, len(marks)) != marks).any():
        raise ValueError("a scan has another number of blocks or bits than its frame")
    keep = np.ones(len(raw), bool)
    keep[1:][high & (after == 0)] = False  # stuffing
    keep[:-1][high & (after != 0)] = False  # markers, and bytes 255 that fill up before them
    keep[ends + 1] = False
    return raw[keep], np.cumsum(keep)[ends]


def _read(window: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, values after them, places after these) at places in bits; window holds the 64 bits from each byte on."""
    seen = window[at >> 3] << (at & 7).view(np.uint64)
    found = table[seen >> np.uint64(48)]
    if not found.all():
        raise ValueError("a scan has a code that its table hasn't")
    bits, size = found >> 8, found & 15
    seen <<= bits.astype(np.uint64)
    value = (seen >> np.uint64(1) >> (63 - size).astype(np.uint64)).view(np.int64)
    value += LOWEST[size] * (seen >> np.uint64(63) == 0)
    return found & 255, value, at + (bits + size)


def coefficients(frames: list[bytes]) -> np.ndarray:
    """Quantised coefficients, frames x blocks x 64 in zigzag order, of baseline grey frames with the same header.

    All restart intervals are decoded side by side, code by code: Huffman codes, the values' extra bits, runs of
    zeros, ends of blocks, DC predictions."""
    head = _head(frames[0])
    blocks, interval, _, _ = _layout(head)
    dc, ac = _lookups(head)
    parts = -(-blocks // interval)
    scans = b"".join(f[len(head) : f.rindex(END)] + END for f in frames)
    data, ends = _segments(scans, [0xD0 + k % 8 for k in range(parts - 1)] + [0xD9])
    if len(ends) != parts * len(frames):
        raise ValueError("a scan has another number of blocks or bits than its frame")
    padded = np.concatenate([data, np.zeros(64 * 4 + 16, np.uint8)])  # a block takes 64 * 31 bits at most
    window = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,)).astype(np.uint64)
    place, stop = 8 * np.concatenate([[0], ends[:-1]]), 8 * ends
    lane = np.arange(len(ends))
    first = lane // parts * blocks + lane % parts * interval
    number = np.minimum(interval, blocks - lane % parts * interval)
    out, before = np.zeros(len(frames) * blocks * 64, np.int32), np.zeros(len(ends), np.int64)
    for j in range(interval):
        who = np.flatnonzero(number > j)
        _, value, at = _read(window, place[who], dc)
        before[who] += value
        cell = (first[who] + j) * 64  # that was filled last
        last = cell + 63
        out[cell] = before[who]
        while len(who):
            symbol, value, at = _read(window, at, ac)
            cell = cell + (symbol >> 4) + 1
            if (cell > last).any():
                raise ValueError("a block has more than 64 coefficients")
            out[cell] = value
            done = (cell == last) | (symbol == 0)
            if done.any():
                place[who[done]] = at[done]
                left = ~done
                who, at, cell, last = who[left], at[left], cell[left], last[left]
        if (place > stop).any():
            raise ValueError("a scan has another number of blocks or bits than its frame")
    if (stop - place > 7).any():
        raise ValueError("a scan has another number of blocks or bits than its frame")
    return out.reshape(len(frames), blocks, 64)


def frame_units(frames: list[bytes]) -> list[bytes]:
    """The units of each frame, from its decoded coefficients; STEP frames are decoded at once."""
    out = [b""] * len(frames)
    for at in range(0, len(frames), STEP):
        alike: dict[bytes, list[int]] = {}
        for k in range(at, min(at + STEP, len(frames))):
            alike.setdefault(_head(frames[k]), []).append(k)
        for places in alike.values():
            found = coefficients([frames[k] for k in places])
            units = (found + 255 * (found <= 0)).astype(np.uint8)
            for k, own in zip(places, units, strict=True):
                out[k] = own.tobytes()
    return out


def decode_frames(frames: list[bytes]) -> bytes:
    """The units of all frames."""
    return b"".join(frame_units(frames))


def decode_frame(frame: bytes) -> np.ndarray:
    """As coefficients, for one frame and bit by bit: blocks x 64."""
    head = _head(frame)
    number, interval, dc, ac = _layout(head)
    out = np.zeros((number, 64), np.int64)
    done = 0
    for part in CUT.split(frame[len(head) : frame.rindex(END)]):
        bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\0", b"\xff"))
        place, before = 0, 0

        def symbol(codes: dict) -> int:
            nonlocal place
            for n in range(1, 17):
                if (found := codes.get((n, int(bits[place : place + n], 2)))) is not None:
                    place += n
                    return found
            raise ValueError("a scan has a code that its table hasn't")

        def value(n: int) -> int:
            nonlocal place
            raw = int(bits[place : place + n], 2) if n else 0
            place += n
            return raw if not n or raw >> (n - 1) else raw - (1 << n) + 1

        for _ in range(min(interval, number - done)):
            before += value(symbol(dc))
            out[done, 0] = before
            k = 1
            while k < 64:
                s = symbol(ac)
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    out[done, k] = value(s & 15)
                k += 1
            done += 1
    return out


# -- container --------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: Iterable[bytes]) -> bytes:
    index, parts, at = [], [], 4
    sizes = []
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        parts.append(_chunk(b"00dc", frame))
        sizes.append(len(frame))
        at += len(parts[-1])
    largest, count = max(sizes), len(sizes)
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, count, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, count, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    image = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image))
    body = b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def index_of(media: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(frames a second, place and size of each frame), from the headers and the index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI")
    at, end, fps, movi, index = 12, 8 + struct.unpack("<I", media[4:8])[0], FPS, -1, b""
    while at + 8 <= end:
        name, size = struct.unpack("<4sI", media[at : at + 8])
        if name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            fps = round(1_000_000 / max(1, struct.unpack("<I", media[at + 20 : at + 24])[0]))
        elif name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    found = []
    for name, _, place, size in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            if struct.unpack_from("<4sI", media, movi + place) != (name, size):
                raise ValueError("the index and the chunks differ")
            found.append((movi + place + 8, size))
    return fps, found


def read_avi(media: bytes) -> tuple[int, list[bytes]]:
    """(frames a second, frames), found through the index."""
    fps, found = index_of(media)
    return fps, [media[a : a + n] for a, n in found]


def payload_parts(media: Iterable[bytes]) -> Iterator[tuple[int, bytes]]:
    """(number of the media, some of its payload), in order. STEP frames are decoded at a time, of as many media as they are."""

    def frames() -> Iterator[tuple[int, bytes]]:
        for i, m in enumerate(media):
            for a, n in index_of(m)[1]:
                yield i, m[a : a + n]

    left = frames()
    while some := list(itertools.islice(left, STEP)):
        units = iter(frame_units([f for _, f in some]))
        for i, own in itertools.groupby(i for i, _ in some):
            yield i, b"".join(next(units) for _ in own)


def payload_steps(media: bytes) -> Iterator[bytes]:
    """The payload, some frames at a time."""
    return (part for _, part in payload_parts([media]))


# -- payloads and shots -----------------------------------------------------


def payload_of(data: bytes) -> bytes:
    """data, filled up with bytes 255 to a positive multiple of FRAME."""
    return data + b"\xff" * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def histograms(payload: bytes) -> np.ndarray:
    """Units of each frame by their upper four bits."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    n = len(samples)
    return np.bincount(((samples >> 4).astype(np.int32) + BINS * np.arange(n, dtype=np.int32)[:, None]).ravel(), minlength=BINS * n).reshape(n, BINS).astype(np.int16)


def shots(counts: np.ndarray) -> list[int]:
    """The first frames of all shots but the first, from the frames' histograms."""
    n = len(counts)
    if n < 3:
        return []
    change = np.abs(np.diff(counts, axis=0)).sum(axis=1, dtype=np.int64) / (2 * FRAME)  # change[k]: from frame k to k + 1
    one, two = (np.concatenate(([0.0], np.cumsum(change**p))) for p in (1, 2))
    k = np.arange(n - 1)
    a, b = np.maximum(k - AROUND, 0), np.minimum(k + AROUND + 1, n - 1)
    others = np.maximum(b - a - 1, 1)
    mean = (one[b] - one[a] - change) / others
    spread = np.sqrt(np.maximum((two[b] - two[a] - change**2) / others - mean**2, 0))
    peak = (change >= np.concatenate(([0], change[:-1]))) & (change > np.concatenate((change[1:], [0])))
    return (np.flatnonzero(peak & (change > LEAST) & (change > mean + DEVIATIONS * spread)) + 1).tolist()


def cuts(payload: bytes) -> list[int]:
    """The first frames of all shots but the first."""
    return shots(histograms(payload))


def clips_of(media: bytes) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frame after the last, start and end in seconds) of each shot."""
    fps, found = index_of(media)
    edges = [0, *shots(np.concatenate([histograms(part) for part in payload_steps(media)])), len(found)]
    return [(k, a, b, a / fps, b / fps) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]


def to_media():
    """A column function: text -> AVI bytes."""

    @F.pandas_udf("binary")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([write_avi(encode_frames(payload_of((t or "").encode("utf-8", "surrogatepass")))) for t in batch.tolist()], dtype=object)
            trim()

    return stored


def store_media(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", media: str = "media") -> DataFrame:
    """Writes a table of key, n_bytes (of the text) and media, a row per document, and returns what is read from it."""
    tune(documents.sparkSession)
    own = documents.select(F.col(key).alias(key), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), to_media()(F.col(text)).alias(media))
    return materialize(own, path, compression="zstd")


def clip_rows(table: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row per clip: key, clip, first_frame, end_frame, start_s, end_s."""
    tune(table.sparkSession)

    @F.pandas_udf("array<struct<clip:int,first_frame:int,end_frame:int,start_s:double,end_s:double>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[dict(zip(("clip", "first_frame", "end_frame", "start_s", "end_s"), c, strict=True)) for c in clips_of(bytes(m))] for m in batch.tolist()], dtype=object)

    return table.select(F.col(key).alias("key"), F.explode(found(F.col(media))).alias("c")).select(F.col("key").alias(key), "c.*")


def media_digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as AVI, reads it back, and describes both: a row per document."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    stored = store_media(documents, scratch(documents.sparkSession, "media"), key, text)

    @F.pandas_udf("struct<payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            media = batch.tolist()
            sizes, shas, tails, counts = [0] * len(media), [hashlib.sha256() for _ in media], [b""] * len(media), [[] for _ in media]
            for i, part in payload_parts(media):
                sizes[i] += len(part)
                shas[i].update(part)
                tails[i] = part[-32:]
                counts[i].append(histograms(part))
            rows = []
            for m, size, sha, tail, own in zip(media, sizes, shas, tails, counts, strict=True):
                found = shots(np.concatenate(own))
                feature = f"frames={size // FRAME};clips={len(found) + 1};cuts={','.join(map(str, found))}"
                rows.append((size, sha.hexdigest(), zlib.crc32(tail), len(m), hashlib.sha256(m).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=names)
            trim()

    own = stored.select(key, "n_bytes", described(F.col("media")).alias("d"))
    return own.select(key, "n_bytes", *[F.col(f"d.{n}").alias(n) for n in names])
