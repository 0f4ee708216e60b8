"""Token ids in fixed-width, bit-packed files with random access.

A file holds documents one after the other, in ascending order of id, as one
sequence of token ids, each in the fewest bits that the vocabulary needs. The
sequence is cut into blocks of BLOCK ids. Layout, little-endian:

    magic "FSTK0001", uint32 bits per id, uint32 ids per block
    the blocks, each of whole bytes; ids lie in them lowest bit first
    uint64 offset of each block, and of the end of the last one
    int64 id (or the smallest int64 for none) and uint64 first token of each document
    footer: uint64 ids, documents, blocks, place of the block offsets; magic

Any range of ids is read by reading its blocks only and unpacking them at once:
eight ids are as many bytes as an id has bits, so each of the eight is a column of
shifted bytes.
Files are written by the tasks of a range-partitioned job, through pyarrow's
file systems, into the shared folder. Each attempt of a task writes a file of its
own, and the table of the job's results names those that count.

Defined cases: null counts as the empty text, which has the end id alone; null
ids come first; rows that share an id follow one another in the order of their
texts' hashes; an empty table gives an empty one; keys that aren't integers raise a
TypeError; a long text costs a worker some twenty times its bytes; other columns
are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import claim, integer_key, materialize, scratch, trim, tune

MAGIC, BLOCK, NO_ID = b"FSTK0001", 4096, -(2**63)
FOOTER = struct.Struct("<4Q8s")
#: Ids read and unpacked at once: bounds a reader's memory.
READ_BLOCKS = 128
#: Distinct words that a worker remembers before it forgets the rare ones, and the bytes encoded together.
CACHE, JOINED_BYTES = 1 << 19, 4 << 20
#: Words encoded in one call of the library: bounds the memory of its results.
RUN = 4096
#: What `WordEncoder` is made for: fixed values of the tokenizer's file.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Signs that end a word wherever they follow a letter. Without those that begin the tokenizer's added tokens or contractions.
_SIGNS = np.isin(np.arange(256), np.frombuffer(b".,;:!?*#%&$", np.uint8))
_LOWER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8))
_UPPER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
#: The second byte of UTF-8's two for the letters from 192 to 255: capital, small.
_CAPITAL = (np.arange(256) >= 0x80) & (np.arange(256) <= 0x9E) & (np.arange(256) != 0x97)
_SMALL = (np.arange(256) >= 0x9F) & (np.arange(256) <= 0xBF) & (np.arange(256) != 0xB7)
#: Byte-level vocabularies show a byte by the character of its number if that prints, else by the next of those from 256 on.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTS)}


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.zeros(-(-len(ids) // 8) * 8, np.uint64)
    wide[: len(ids)] = ids
    wide, out = wide.reshape(-1, 8), np.zeros((-(-len(ids) // 8), bits), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        lane = wide[:, k] << np.uint64(shift)
        for j in range(-(-(shift + bits) // 8)):
            out[:, byte + j] |= (lane >> np.uint64(8 * j)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    rows = -(-count // 8)
    flat = np.frombuffer(data.ljust(rows * bits, b"\0"), np.uint8, rows * bits).reshape(rows, bits).astype(np.uint64)
    out = np.empty((rows, 8), np.uint32)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        lane = np.zeros(rows, np.uint64)
        for j in range(-(-(shift + bits) // 8)):
            lane |= flat[:, byte + j] << np.uint64(8 * j)
        out[:, k] = (lane >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.ravel()[:count]


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


class Writer:
    def __init__(self, uri: str, vocabulary: int):
        fs, path = opened(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.bits = fs.open_output_stream(path), bits_for(vocabulary)
        self.out.write(MAGIC + struct.pack("<2I", self.bits, BLOCK))
        self.place, self.offsets, self.docs, self.firsts, self.count = 16, [], [], [], 0
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.add_all([doc_id], np.array([len(ids)]), ids)

    def add_all(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Several documents, whose ids lie end to end."""
        self.docs += [NO_ID if d is None else d for d in doc_ids]
        self.firsts += (self.count + np.cumsum(sizes) - sizes).tolist()
        self.count += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        for k in range(0, upto, BLOCK):
            data = pack(ids[k : min(k + BLOCK, upto)], self.bits)
            self.offsets.append(self.place)
            self.out.write(data)
            self.place += len(data)
        self.waiting, self.held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._flush(self.held)
        table = self.place
        self.out.write(np.array([*self.offsets, self.place], "<u8").tobytes())
        self.out.write(np.array(self.docs, "<i8").tobytes() + np.array(self.firsts, "<u8").tobytes())
        self.out.write(FOOTER.pack(self.count, len(self.docs), len(self.offsets), table, MAGIC))
        self.out.close()


class Reader:
    def __init__(self, uri: str):
        fs, path = opened(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.count, docs, blocks, table, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        head, self.bits, self.block = struct.unpack("<8s2I", self.file.read_at(16, 0))
        if head != MAGIC or magic != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        rest = self.file.read_at(8 * (blocks + 1 + 2 * docs), table)
        self.offsets = np.frombuffer(rest, "<u8", blocks + 1).astype(np.int64)
        self.docs = np.frombuffer(rest, "<i8", docs, 8 * (blocks + 1))
        self.firsts = np.append(np.frombuffer(rest, "<u8", docs, 8 * (blocks + 1 + docs)).astype(np.int64), self.count)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file's sequence; reads the blocks that hold them."""
        if start >= end:
            return np.empty(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block + 1
        data = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        have = min(b * self.block, self.count) - a * self.block
        return unpack(data, self.bits, have)[start - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.firsts[k]), int(self.firsts[k + 1]))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(id, token ids) of all documents, reading the file once, front to back."""
        start, have = 0, np.empty(0, np.uint32)
        for k, doc in enumerate(self.docs.tolist()):
            a, b = int(self.firsts[k]), int(self.firsts[k + 1])
            if b > start + len(have):
                parts, upto = [have[a - start :]], start + len(have)
                while upto < b:
                    step = min(self.count, (upto // self.block + READ_BLOCKS) * self.block)
                    parts.append(self.ids(upto, step))
                    upto = step
                start, have = a, np.concatenate(parts)
            yield None if doc == NO_ID else doc, have[a - start : b - start]


class TextEncoder:
    """Any tokenizer: whole texts, by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of the texts, each followed by end_id."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        sizes = np.array([len(ids) + 1 for ids in found], np.int64)
        return sizes, np.fromiter(chain.from_iterable(chain(ids, (end_id,)) for ids in found), np.uint32, int(sizes.sum()))


class WordEncoder(TextEncoder):
    """Encodes each distinct word once, for tokenizers with the normalizer and pre-tokenizer named above.

    These drop white space, and cut between a letter and a sign, so a text's ids are
    those of its parts between spaces, line feeds and such places, in any of which
    A-Z and the capitals from 192 on may be lower-cased first unless a combining mark
    may follow. Parts of small letters need no normalising and go to the library's
    model at once; others go through all of the library. Finding the distinct parts
    of a block is numpy's and Arrow's work.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.clear()

    @staticmethod
    def fits(path: str) -> bool:
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, added = made["model"], [t for t in made.get("added_tokens", []) if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not re.fullmatch(r"<\|[^\s]*\|>", t["content"])]
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges") and not model.get("byte_fallback")
        return plain and not added and made["normalizer"] == NORMALIZER and made["pre_tokenizer"] == PRE_TOKENIZER and not made.get("truncation") and not made.get("padding")

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.size, self.begin, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int64), np.zeros(1024, np.uint32)
        self.asked = np.zeros(1024, np.int32)  # blocks that had the word
        self.words = self.ids = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)))

    def _store(self, words: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        w, k = self.words + len(words), self.ids + len(ids)
        self.size, self.begin, self.asked, self.flat = self._room(self.size, w), self._room(self.begin, w), self._room(self.asked, w), self._room(self.flat, k)
        self.size[self.words : w], self.flat[self.ids : k] = size, ids
        self.begin[self.words : w] = np.cumsum(size) - size + self.ids
        self.slot.update(zip(words, range(self.words, w), strict=True))
        self.words, self.ids = w, k

    def _renew(self) -> None:
        """Forget the rarer words: those that are left are half of what may be remembered, at most."""
        asked = self.asked[: self.words]
        often = max(2, int(np.sort(asked)[-(CACHE // 2) :][0]) + 1)
        slots = np.flatnonzero(asked >= often)
        keep = [w for w, k in zip(self.slot, (asked >= often).tolist(), strict=True) if k]
        size, ids, asked = self.size[slots], self._gather(slots), asked[slots] // 2
        self.clear()
        self._store(keep, size, ids)
        self.asked[: self.words] = asked

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        size = self.size[slots]
        ends = np.cumsum(size, dtype=np.int64)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[slots] - (ends - size), size)]

    @staticmethod
    def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(parts of the texts, each with a space at its end; their number in each text)."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        after = np.append(data[1:], 0).astype(np.uint8) if len(data) else data
        lead = np.concatenate(([False], data[:-1] == 0xC3)) if len(data) else np.empty(0, bool)
        letter = _LOWER[data] | _UPPER[data] | (lead & (_CAPITAL[data] | _SMALL[data]))
        places = np.concatenate((np.flatnonzero(letter & _SIGNS[after]) + 1, offsets[1:]))
        if b"<|" not in data.tobytes():  # an added token has its own case
            safe = (after < 0x80) | (after == 0xC3) | (after == 0xC2)
            data = data + np.uint8(32) * (safe & (_UPPER[data] | (lead & _CAPITAL[data])))
        data = np.insert(data, places, 32)
        data[data == 10] = 32
        ends = np.flatnonzero(data == 32) + 1
        parts = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data))
        inserted = np.searchsorted(np.sort(places, kind="stable"), offsets[1:], side="right")
        return parts, np.diff(np.searchsorted(ends, offsets[1:] + inserted, side="right"), prepend=0)

    @staticmethod
    def _plain(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which parts are of small letters only. ends: where each of the parts, which have a space at their end, ends."""
        after_lead = np.concatenate(([False], data[:-1] == 0xC3))
        bad = ~(_LOWER[data] | (data == 0xC3) | (after_lead & _SMALL[data]))
        bad[ends - 1] = False
        total = np.concatenate(([0], np.cumsum(bad)))
        begins = np.concatenate(([0], ends[:-1]))
        return (total[ends] == total[begins]) & (ends - begins > 1)

    def _learn(self, words: list[str], plain: np.ndarray, parts: list[str]) -> None:
        """words: each byte a character; plain: of small letters only; parts: the others as they are."""
        tokenize, odd = self.tokenizer.model.tokenize, iter(self.tokenizer.encode_batch_fast(parts, add_special_tokens=False) if parts else ())
        found = [[t.id for t in tokenize(w if w.isascii() else w.translate(BYTE_SIGNS))] if p else next(odd).ids for w, p in zip(words, plain.tolist(), strict=True)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        self._store(words, size, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        parts, number = self._cut(texts)
        coded = parts.dictionary_encode()
        known = coded.dictionary
        ends = np.frombuffer(known.buffers()[1], np.int32)[1 : len(known) + 1].astype(np.int64)
        data = np.frombuffer(known.buffers()[2], np.uint8)[: ends[-1]]
        words = data.tobytes().decode("latin-1").split(" ")[:-1]
        if self.words > CACHE:
            self._renew()
        slots = list(map(self.slot.get, words))
        new = [k for k, s in enumerate(slots) if s is None]
        if new:
            plain = self._plain(data, ends)
            for at in range(0, len(new), RUN):
                some = np.array(new[at : at + RUN])
                self._learn([words[k] for k in some.tolist()], plain[some], [w[:-1] for w in known.take(pa.array(some[~plain[some]])).to_pylist()])
            slots = list(map(self.slot.__getitem__, words))
        slots = np.array(slots, np.int64)
        self.asked[slots] += 1
        slots = slots[coded.indices.to_numpy()]
        cut = np.cumsum(number)
        sizes = np.concatenate(([0], np.cumsum(self.size[slots], dtype=np.int64)))[cut]
        return np.diff(sizes, prepend=0) + 1, np.insert(self._gather(slots), sizes, np.uint32(end_id))


_encoders: dict[str, TextEncoder] = {}


def _forget() -> None:
    """A function of the module, so that a worker runs it on its own memory and no closure carries the driver's."""
    _encoders.clear()


def encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = (WordEncoder if WordEncoder.fits(path) else TextEncoder)(path)
    return _encoders[path]


def write_tokens(documents: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Encodes all documents into token files. A row per file, in the order of their documents: part, path, docs, ids."""
    integer_key(documents, key)
    tune(documents.sparkSession)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Batches of some more rows: a word that many texts have is then looked up once for them."""
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= JOINED_BYTES:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens", _forget)
        own, writer, uri, part = encoder(tokenizer), None, "", 0
        for rows in joined(batches):
            if writer is None:
                part = rows["part"][0].as_py()
                uri = f"{folder}/{part:08d}-{uuid.uuid4().hex}.tokens"
                writer = Writer(uri, own.tokenizer.get_vocab_size())
            writer.add_all(rows["id"].to_pylist(), *own.encode(rows["text"].combine_chunks() if rows["text"].num_chunks != 1 else rows["text"].chunk(0), end_id))
            trim()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [uri], "docs": [len(writer.docs)], "ids": [writer.count]}, pa.schema([("part", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    rows = documents.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text", F.spark_partition_id().alias("part"))
    return materialize(ordered.mapInArrow(run, "part long, path string, docs long, ids long"), f"{folder}/files")


def read_tokens(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per document, from the files: key, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                reader = Reader(path)
                sums = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.documents()]
                docs = pa.array([None if d == NO_ID else d for d in reader.docs.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([docs, pa.array(reader.firsts[:-1] + base, pa.int64()), pa.array(np.diff(reader.firsts), pa.int64()), pa.array(sums, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return placed.repartition(max(1, files.count())).mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")


def token_table(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    folder = scratch(documents.sparkSession, "tokens")
    return read_tokens(write_tokens(documents, tokenizer, folder, key, text, end_id), key)
