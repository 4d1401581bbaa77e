"""Line dedup: documents probe a sharded minimal perfect hash over line hashes.

1. A scan hashes each document's distinct line keys to 128 bits; a sum with partial
   aggregation counts the documents of each key.
2. All distinct keys are dealt to shards by hash. A shard indexes its keys of two or more
   documents (or of ``min_docs``, if that is less) in small arrays: a minimal perfect
   hash in levels of bits (a key owns a bit of the first level where no other key of that
   level hits it; its slot is the rank of that bit), a fingerprint of 16 bits and a count
   a slot. Keys of fewer documents are probed at once, and the few that a fingerprint
   takes for another key are listed, so every answer is exact.
3. The arrays go to the executors as files, which tasks map. A document's line is looked
   up where the document is read, by hash: shard, slot, fingerprint, count. No line and
   no list of lines is joined or shuffled, whatever the number of keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Shared, carried, columns, slices, texts
from .mapped import deliver, mapped, pack

#: Distinct keys that a shard has on average at most, and shards of a file.
SHARD_KEYS, FILE_SHARDS = 1 << 18, 256
#: Bits a key has in each level of the hash.
GAMMA = 2.0
#: Bits of a key's second hash that are its fingerprint.
PRINT = 0xFFFF
#: Most levels of a shard; keys that are left then are listed as they are. A level has about 4/10 of the keys of the one before.
LEVELS = 32
BLANK = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: str) -> str:
    out = line.strip(BLANK)
    return out.lower() if out.isascii() else out.translate(_LOWER)


def key_hash(key: str) -> tuple[int, int]:
    """128 bits as two signed longs: the first places the key, the second is its fingerprint."""
    h = xxhash.xxh3_128_intdigest(key.encode())
    a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


# -- minimal perfect hash ---------------------------------------------------------


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser with another seed for every level."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ x >> np.uint64(33)


def build(hashes: np.ndarray, prints: np.ndarray, counts: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The arrays of a shard from distinct pairs of 64-bit hashes and prints, and the documents of each.

    bits and ranks: the words of all levels end to end, and the slots before each word;
    words: how many each level has; prints and counts by slot, counts above 65,535 kept
    there; listed: hash, print and count of keys whose answer the slots do not give.
    """
    member = counts >= least
    order = np.lexsort((prints, hashes))
    order = order[member[order]]
    h = hashes[order]
    # Of members of one hash the first owns the slot.
    own = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    left = np.flatnonzero(own)
    at_slot: list[np.ndarray] = []
    bits: list[np.ndarray] = []
    words = np.zeros(LEVELS, np.int64)
    for level in range(LEVELS):
        if not len(left):
            break
        words[level] = max(1, -(-int(GAMMA * len(left)) // 64))
        at = (_mix(h[left], level) % np.uint64(words[level] * 64)).astype(np.int64)
        alone = np.bincount(at, minlength=words[level] * 64) == 1
        bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sure = alone[at]
        at_slot.append(left[sure][np.argsort(at[sure])])
        left = left[~sure]
    flat = np.concatenate(bits) if bits else np.empty(0, np.uint64)
    per = np.bitwise_count(flat).astype(np.int64)
    slot = order[np.concatenate(at_slot)] if at_slot else np.empty(0, np.int64)
    out = {
        "bits": flat, "ranks": (np.cumsum(per) - per).astype(np.uint32), "words": words,
        "prints": (prints[slot] & np.uint64(PRINT)).astype(np.uint16), "counts": np.minimum(counts[slot], 65535).astype(np.uint16), "listed": np.empty(0, np.uint64),
    }
    alone = Index([{k: (v, np.array([0, len(v)])) for k, v in out.items()}], 1)
    wrong = np.flatnonzero(alone.count(hashes, prints) != np.where(member, np.minimum(counts, 65535), 0))
    out["listed"] = np.stack([hashes[wrong], prints[wrong], np.where(member[wrong], counts[wrong], 0).astype(np.uint64)], axis=1).ravel()
    return out


class Index:
    """Shards of one or more files, probed for many keys at once.

    files: by name an array of all shards of the file end to end, and where each shard's
    part begins; ``keys`` has the shards' numbers, by default from 0.
    """

    def __init__(self, files: list[dict[str, tuple[np.ndarray, np.ndarray]]], n_shards: int, keys: list[np.ndarray] | None = None):
        self.n_shards = n_shards
        #: File and row of each shard; no row where a shard has none.
        self.file, self.row = np.full(n_shards, -1, np.int64), np.zeros(n_shards, np.int64)
        self.files = []
        for i, f in enumerate(files):
            rows = len(f["bits"][1]) - 1
            own = keys[i] if keys else np.arange(rows)
            self.file[own], self.row[own] = i, np.arange(rows)
            words = np.asarray(f["words"][0]).reshape(rows, LEVELS)
            listed = np.asarray(f["listed"][0]).reshape(-1, 3)
            self.files.append({k: f[k][0] for k in ("bits", "ranks", "prints", "counts")} | {
                "words": words, "word": f["bits"][1][:-1, None] + np.cumsum(words, axis=1) - words, "slot": f["counts"][1][:-1],
                "listed": listed[np.argsort(listed[:, 0], kind="stable")],
            })

    def count(self, hashes: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The documents of each key as far as they are kept; 0 for those of too few."""
        out = np.zeros(len(hashes), np.int64)
        where = shard_of(hashes, self.n_shards)
        file = self.file[where]
        for i, f in enumerate(self.files):
            asked = np.flatnonzero(file == i) if len(self.files) > 1 or (file < 0).any() else np.arange(len(hashes))
            out[asked] = self._count(f, hashes[asked], prints[asked], self.row[where[asked]])
        return out

    @staticmethod
    def _count(f: dict[str, np.ndarray], hashes: np.ndarray, prints: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        left = np.arange(len(hashes))
        for level in range(LEVELS):
            words = f["words"][row[left], level]
            left, words = left[words > 0], words[words > 0]
            if not len(left):
                break
            at = _mix(hashes[left], level) % (words * 64).astype(np.uint64)
            word, bit = f["word"][row[left], level] + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = f["bits"][word]
            hit = found >> bit & np.uint64(1) == 1
            sure = left[hit]
            below = found[hit] & (np.uint64(1) << bit[hit]) - np.uint64(1)
            slot = f["slot"][row[sure]] + f["ranks"][word[hit]] + np.bitwise_count(below)
            same = f["prints"][slot] == (prints[sure] & np.uint64(PRINT)).astype(np.uint16)
            out[sure[same]] = f["counts"][slot[same]]
            left = left[~hit]
        listed = f["listed"]
        if len(listed):
            low, high = np.searchsorted(listed[:, 0], hashes, "left"), np.searchsorted(listed[:, 0], hashes, "right")
            for i in np.flatnonzero(low < high).tolist():
                for _, p, n in listed[low[i] : high[i]]:
                    if p == prints[i]:
                        out[i] = n
        return out


def index(names: list[str], n_shards: int) -> Index:
    """On an executor: the shards of files of ``deliver``."""
    files = mapped(names)
    return Index([{k: (a, m.starts[k]) for k, a in m.arrays.items()} for m in files], n_shards, [m.keys for m in files])


def shard_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """By the top bits, which no level uses alone; the same number as in ``build_shards``."""
    return (hashes.astype(np.uint64) >> np.uint64(32)).astype(np.int64) % n


# -- counting and building --------------------------------------------------------


def _lines(text: str, min_chars: int) -> tuple[list[str], list[tuple[int, int] | None]]:
    lines = text.split("\n")
    return lines, [key_hash(k) if len(k := line_key(x)) >= min_chars else None for x in lines]


def counted(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2 and n (documents) of all distinct keys.

    Distinct within a row; rows are documents, so repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a: list[int] = []
            b: list[int] = []
            for text in texts(batch):
                own = set(_lines(text, min_chars)[1])
                own.discard(None)
                a += [x[0] for x in own]
                b += [x[1] for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["h1", "h2"])

    return columns(docs, "text").mapInArrow(run, "h1 long, h2 long").groupBy("h1", "h2").agg(F.count("*").alias("n"))


def build_shards(keys: DataFrame, n_shards: int, least: int) -> DataFrame:
    """key (the shard) and bytes of the arrays of ``build``. Shards are even: they are dealt by a hash of distinct keys."""

    def run(table: pa.Table) -> pa.Table:
        h, p = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        raw = pack(**build(h, p, table.column("n").to_numpy(), least))
        return pa.table({"key": pa.array([table.column("shard")[0].as_py()], pa.int32()), "bytes": pa.array([raw], pa.binary())})

    placed = keys.withColumn("shard", F.pmod(F.shiftrightunsigned("h1", 32), F.lit(n_shards)).cast("int"))
    return placed.groupBy("shard").applyInArrow(run, "key int, bytes binary")


# -- probing ----------------------------------------------------------------------


def _result(doc_ids: pa.Array, lines: list[list[str]], gone: list[set[int]], full: bool, extra: list[pa.Array]) -> pa.RecordBatch:
    kept = ["\n".join(x for i, x in enumerate(own) if i not in out) if out else "\n".join(own) for own, out in zip(lines, gone, strict=True)]
    cols = [doc_ids, pa.array([len(x) for x in lines], pa.int64()), pa.array([len(x) for x in gone], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string())]
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    if full:
        cols.append(pa.array(kept, pa.string()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(cols + extra, names=names + [f"x{i}" for i in range(len(extra))])


def line_dedup(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, full: bool = False, extra: tuple[str, ...] = (), shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row; full: also kept, the text that stays.

    Lines whose key (blanks off both ends, A-Z lower) has at least ``min_chars`` code
    points and is in at least ``min_docs`` rows go from every row. A null or empty
    text is one empty line, which has no key and stays. Repeated rows count as
    documents each; null ids stay as they are. A very long text is held whole by its
    task. An empty table gives an empty table. extra: further columns to carry along,
    as x0, x1 and so on.
    """
    if min_docs > 65535:
        raise ValueError("counts are kept up to 65535")
    shared = Shared(docs.sparkSession)
    keys = shared.keep(counted(docs, min_chars))
    n_shards = max(1, -(-keys.count() // shard_keys))
    files = deliver(shared, build_shards(keys, n_shards, min(2, min_docs)), -(-n_shards // FILE_SHARDS))
    shared.drop(keys)
    src, names, more = carried(docs, extra)
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * full + more

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = index(files, n_shards)
        for batch in slices(batches):
            found = [_lines(t, min_chars) for t in texts(batch)]
            flat = [h for _, own in found for h in own if h is not None]
            n = shards.count(np.array([x[0] for x in flat], np.int64).view(np.uint64), np.array([x[1] for x in flat], np.int64).view(np.uint64))
            hit, at, gone = (n >= min_docs).tolist(), 0, []
            for _, own in found:
                out = set()
                for i, h in enumerate(own):
                    if h is not None:
                        if hit[at]:
                            out.add(i)
                        at += 1
                gone.append(out)
            yield _result(batch.column("doc_id"), [x[0] for x in found], gone, full, [batch.column(n) for n in names])

    return src.mapInArrow(clean, schema)
