"""Token-id files: ids one after another, document boundaries as Elias-Fano.

A block holds whole documents in ascending doc_id order:

    header      magic, id width in bytes, documents, ids, position of the first id
    boundaries  Elias-Fano of the end of each document
    doc ids     Elias-Fano of doc_id less the smallest
    ids         little-endian, 2 or 4 bytes each, concatenated

Elias-Fano splits n ascending numbers below u at bit l = floor(log2(u / n)): the low
l bits side by side, the high bits in unary. With one sample per SAMPLE ones, select
finds any boundary in a bounded number of words: about 2 + log2(u / n) bits a
document and no table of 64-bit offsets.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Shared, columns, slices, texts
from .tokens import json_tokenizer, pieces

#: A block is closed when it has so many ids; a longer document is a block alone.
BLOCK_IDS = 1 << 20
#: One sampled position per so many ones of the high bits.
SAMPLE = 256
#: Chunks of text whose ids a worker remembers; it starts anew when full.
KEEP_CHUNKS = 400_000
MAGIC = b"EFID"
_HEAD = struct.Struct("<4sBxxxQQQQqQQ")
_EF = struct.Struct("<QQBxxxxxxxQ")

# -- Elias-Fano -------------------------------------------------------------------


def ef_pack(values: np.ndarray) -> bytes:
    """Ascending numbers from 0, repeats allowed, as bytes."""
    n = len(values)
    v = np.asarray(values, dtype=np.uint64)
    top = int(v[-1]) + 1 if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lows = (v[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel() if low else np.empty(0, np.uint8)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    high_bytes = np.packbits(high, bitorder="little").tobytes()
    return _EF.pack(n, top, low, len(high_bytes)) + np.packbits(lows, bitorder="little").tobytes() + high_bytes + ones[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    """Reader of ``ef_pack``'s bytes; ``size`` is how many bytes it took."""

    def __init__(self, raw: bytes | memoryview, at: int = 0):
        self.n, self.top, self.low, n_high = _EF.unpack_from(raw, at)
        start = at + _EF.size
        n_low = (self.n * self.low + 7) // 8
        self._low = np.frombuffer(raw, np.uint8, n_low, start)
        self._high = np.frombuffer(raw, np.uint8, n_high, start + n_low)
        samples = -(-self.n // SAMPLE)
        self._sample = np.frombuffer(raw, "<u4", samples, start + n_low + n_high)
        self.size = _EF.size + n_low + n_high + 4 * samples

    def _lows(self, i: int) -> int:
        bit = i * self.low
        word = int.from_bytes(self._low[bit // 8 : (bit + self.low + 7) // 8].tobytes(), "little")
        return word >> bit % 8 & (1 << self.low) - 1

    def select(self, i: int) -> int:
        """The i-th number: a scan of the high bits from the nearest sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self._sample[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        part = int(self._high[byte]) >> at % 8 << at % 8
        while left >= part.bit_count():
            left -= part.bit_count()
            byte += 1
            part = int(self._high[byte])
        for _ in range(left):
            part &= part - 1
        one = byte * 8 + (part & -part).bit_length() - 1
        return (one - i) << self.low | self._lows(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self._low, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            out |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out.astype(np.int64)


# -- blocks -----------------------------------------------------------------------


def block_pack(doc_ids: list[int], ids: list[np.ndarray], first: int, width: int) -> bytes:
    """A block of documents; first: the position of its first id among all of its shard."""
    kind = {2: "<u2", 4: "<u4"}[width]
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    base = doc_ids[0] if doc_ids else 0
    bounds, names = ef_pack(ends), ef_pack(np.asarray(doc_ids, dtype=np.int64) - base)
    body = np.concatenate(ids).astype(kind).tobytes() if ids else b""
    return _HEAD.pack(MAGIC, width, len(doc_ids), int(ends[-1]) if len(ends) else 0, first, 0, base, len(bounds), len(names)) + bounds + names + body


class Block:
    """Reader of one block: ``document(i)`` by select, ``documents()`` in order."""

    def __init__(self, raw: bytes):
        magic, width, self.n, self.n_ids, self.first, _, self.base, n_bounds, n_names = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = _HEAD.size
        self.ends, self.names = EliasFano(raw, at), EliasFano(raw, at + n_bounds)
        self.ids = np.frombuffer(raw, {2: "<u2", 4: "<u4"}[width], self.n_ids, at + n_bounds + n_names)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_id(self, i: int) -> int:
        return self.base + self.names.select(i)

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Each document by select; its end is the start of the next."""
        start = 0
        for i in range(self.n):
            end = self.ends.select(i)
            yield self.doc_id(i), self.first + start, self.ids[start:end]
            start = end


# -- encoding ---------------------------------------------------------------------

_CHUNK = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
_ODD_SPACE = re.compile(r"[^\S \t\n\r\x0b\x0c]")
#: Anything but plain ASCII, its six spaces and the letters of Latin-1; and what may start an added token.
_NOT_PLAIN = re.compile(r"[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]|<\|")
_LETTERS = re.compile(r"[a-z\xe0-\xf6\xf8-\xff]+")
_STOP = re.compile(r"[.,](?<=[a-z\xe0-\xf6\xf8-\xff][.,])(?=\s|$)")


def _byte_letters() -> dict[int, str]:
    """The two letters by which byte-level rules write a Latin-1 letter.

    Printable bytes stand for themselves, the others for letters from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Encoder(dict):
    """Ids of the tokenizers library, by chunks; the dict has those of chunks that it has seen.

    Chunks (white space and the word after it) end at the safe boundaries of
    ``tokens.pieces``, so their ids in a row are those of the text. Texts with
    other white space, and files for which no boundary is safe, go through whole.

    Where the file drops white space and case (``loose``), a text of ASCII and
    Latin-1 letters is lower-cased first, which is all that its normaliser would
    do, and a full stop or comma after a letter becomes a chunk: the rules end a
    match between a letter and a mark in any case. A chunk of letters alone is one
    match then, and goes to the library's model without the steps before it.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.split = json_tokenizer(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind, self.code = {2: ("<u2", "H"), 4: ("<u4", "I")}[self.width]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = {x.get("type") for x in norm.get("normalizers", [norm])}
        self.loose = self.split and kinds == {"NFC", "Replace", "Lowercase"} and "Split" in {x.get("type") for x in pre.get("pretokenizers", [pre])}
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def chunks(self, text: str) -> list[str] | None:
        """None: the text has to go through the library as it is."""
        if self.loose and not _NOT_PLAIN.search(text):
            return _STOP.sub(r" \g<0>", text.lower()).split()
        return _CHUNK.findall(text) if self.split and not _ODD_SPACE.search(text) else None

    def _library(self, part: str) -> bytes:
        return array(self.code, self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        if self.loose and _LETTERS.fullmatch(part):
            out = array(self.code, [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.letters))]).tobytes()
        else:
            out = self._library(part)
        if len(self) >= KEEP_CHUNKS:
            self.clear()
        self[part] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        parts = self.chunks(text)
        if parts is None:
            return np.frombuffer(b"".join(self._library(p) for p in (pieces(text, 1 << 15) if self.split else (text,))), self.kind)
        return np.frombuffer(b"".join(map(self.__getitem__, parts)), self.kind)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


BLOCK_SCHEMA = "shard int, block int, first long, n_ids long, n_docs long, bytes binary"


def write_blocks(docs: DataFrame, path: str, *, end_id: int, shards: int | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of all documents: shards ascend by doc_id, and so do blocks and rows within.

    One shuffle deals the texts by ranges of doc_id; a task then encodes its range
    in order and holds one block at a time. ``first`` counts ids within the shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one, shard = encoder(path), TaskContext.get().partitionId()
        names: list[int] = []
        ids: list[np.ndarray] = []
        block = first = held = 0
        tail = np.asarray([end_id], one.kind)

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held
            raw = block_pack(names, ids, first, one.width)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([raw], pa.binary())], names=["shard", "block", "first", "n_ids", "n_docs", "bytes"])
            block, first, held = block + 1, first + held, 0
            names.clear()
            ids.clear()
            return out

        for batch in slices(batches, most=1 << 20):
            for name, own in zip(batch.column("doc_id").to_pylist(), map(one.encode, texts(batch)), strict=True):
                if held and held + len(own) + 1 > block_ids:
                    yield flush()
                names.append(name)
                ids.append(np.concatenate([own, tail]))
                held += len(own) + 1
        if names:
            yield flush()

    # Among rows of one doc_id their place in the input decides, so that many of them are many ranges.
    src = columns(docs, "doc_id", "text").where("doc_id is not null").withColumn("at", F.monotonically_increasing_id())
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return src.repartitionByRange(n, "doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text").mapInArrow(run, BLOCK_SCHEMA)


def read_blocks(blocks: DataFrame, *, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (and ids) of each document in written blocks.

    The shards' totals, one number per shard, go over the driver; they make the
    positions within a shard those within all.
    """
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    before, at = {}, 0
    for shard, n in totals:
        before[shard] = at
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("bytes"), strict=True):
                rows = list(Block(raw.as_py()).documents())
                out = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] + before[shard] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64())]
                if ids:
                    out.append(pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return blocks.select("shard", "bytes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def id_files(docs: DataFrame, path: str, *, end_id: int = 2, shards: int | None = None, ids: bool = False) -> DataFrame:
    """Writes the ids of all documents as blocks and reads the documents back from them.

    A null text counts as empty: end_id alone. Repeated ids keep all their rows, one
    after another; among them the order is free. Rows without a doc_id have no place
    in the order: they get start null and are read back from blocks of their own, written
    by many tasks.
    Very long texts fill a block alone. An empty table gives an empty table.
    """
    shared = Shared(docs.sparkSession)
    blocks = shared.keep(write_blocks(docs, path, end_id=end_id, shards=shards))
    out = read_blocks(blocks, ids=ids)
    rest = columns(docs, "doc_id", "text").where("doc_id is null")
    if rest.isEmpty():
        return out
    other = shared.keep(write_blocks(rest.withColumn("doc_id", F.monotonically_increasing_id()), path, end_id=end_id, shards=shards))
    return out.unionByName(read_blocks(other, ids=ids).withColumns({"doc_id": F.lit(None).cast("long"), "start": F.lit(None).cast("long")}))
