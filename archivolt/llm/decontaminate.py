"""Benchmark decontamination: a hash set of test n-grams on every executor, scanned and verified.

Every word has a 64-bit hash, and a window one of the hashes of its words. The distinct
windows of the benchmark, with their words and items, become sorted arrays, dealt to
parts by ranges of the hash. They reach the executors as files, which tasks map: so one
scan of the documents serves a benchmark of any size, and no worker holds it. A window of
a document whose hash is there is compared word by word before it counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Shared, carried, slices, texts
from .mapped import Mapped, deliver, mapped, pack

#: Test windows of a part, about, and parts of a file.
PART_WINDOWS, FILE_PARTS = 1 << 16, 64
#: Words whose hashes a worker remembers; it starts anew when full.
KEEP_WORDS = 400_000
_M1 = np.uint64(0xFF51AFD7ED558CCD)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Bytes to bytes: A-Z in lower case, and a space for ASCII that is no letter or digit.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class _Hashes(dict):
    """64-bit hashes of words, never 0: that parts documents."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word) or 1
        if len(self) >= KEEP_WORDS:
            self.clear()
        self[word] = out
        return out


_hashes = _Hashes()


def window_hashes(row: np.ndarray, size: int) -> np.ndarray:
    """Of all runs of ``size`` word hashes; windows of other sizes have other hashes."""
    n = max(0, len(row) - size + 1)
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ row[i : n + i]) * _M1
            out ^= out >> np.uint64(29)
    return out


def benchmark_windows(tests: DataFrame, n: int) -> DataFrame:
    """h, size, words (joined by spaces) and items (ascending) of the distinct windows of item_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 18):
            h: list[np.ndarray] = []
            size: list[int] = []
            found: list[bytes] = []
            item: list[int] = []
            for name, text in zip(batch.column("item_id").to_pylist(), texts(batch), strict=True):
                own = words(text)
                k = min(n, len(own))
                if k:
                    h.append(window_hashes(np.array([_hashes[w] for w in own], np.uint64), k).view(np.int64))
                    found += [b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)]
                    size += [k] * len(h[-1])
                    item += [name] * len(h[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h) if h else np.empty(0, np.int64)), pa.array(size, pa.int32()), pa.array(found, pa.binary()), pa.array(item, pa.int64())], names=["h", "size", "words", "item"])

    return tests.mapInArrow(run, "h long, size int, words binary, item long").groupBy("h", "size", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def build_parts(windows: DataFrame, parts: int) -> DataFrame:
    """key (the part) and bytes: hashes in order, and of each where its words and its items end."""

    def run(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        found, items = table.column("words").to_pylist(), table.column("items").to_pylist()
        raw = pack(
            hash=h[order], words_end=np.cumsum([len(found[i]) for i in order], dtype=np.int64), words=np.frombuffer(b"".join(found[i] for i in order), np.uint8),
            items_end=np.cumsum([len(items[i]) for i in order], dtype=np.int64), items=np.concatenate([np.array(items[i], np.int64) for i in order]),
        )
        return pa.table({"key": pa.array([table.column("part")[0].as_py()], pa.int32()), "bytes": pa.array([raw], pa.binary())})

    top = F.shiftrightunsigned("h", 40)
    placed = windows.select(F.shiftright(top * parts, 24).cast("int").alias("part"), "h", "words", "items")
    return placed.groupBy("part").applyInArrow(run, "key int, bytes binary")


class Windows:
    """The test windows of files of ``deliver``; sizes: the numbers of words that there are."""

    def __init__(self, files: list[Mapped], sizes: list[int]):
        self.files, self.sizes = files, sizes

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, list[tuple[Mapped, int]]]:
        """The places in ``hashes`` that are some window's hash, and the first such window of each."""
        at: list[np.ndarray] = []
        out: list[tuple[Mapped, int]] = []
        for f in self.files:
            own = f.arrays["hash"]
            place = np.searchsorted(own, hashes)
            hit = np.flatnonzero(own[np.minimum(place, len(own) - 1)] == hashes)
            at.append(hit)
            out += [(f, i) for i in place[hit].tolist()]
        return np.concatenate(at) if at else np.empty(0, np.int64), out

    @staticmethod
    def items(f: Mapped, i: int, found: bytes) -> list[int] | None:
        """Items of the window ``found``, one of those that have the hash at place i; None if it is none of them."""
        a = f.arrays
        for j in range(i, len(a["hash"])):
            if a["hash"][j] != a["hash"][i]:
                return None
            row = int(np.searchsorted(f.starts["hash"], j, "right")) - 1
            local = j - f.starts["hash"][row]
            own = {}
            for name in ("words", "items"):
                begin = a[f"{name}_end"][j - 1] if local else 0
                start = f.starts[name][row]
                own[name] = a[name][start + begin : start + a[f"{name}_end"][j]]
            if own["words"].tobytes() == found:
                return own["items"].tolist()
        return None

    def scan(self, docs: list[list[bytes]]) -> tuple[list[np.ndarray], list[set[int]]]:
        """For each document a mask of the words hit, and the items with a window in it."""
        starts: list[int] = []
        flat: list[bytes] = []
        for own in docs:
            starts.append(len(flat))
            flat += own
            flat.append(b"")
        row = np.fromiter(map(_hashes.__getitem__, flat), np.uint64, len(flat))
        begin = np.array(starts, np.int64)
        row[[s + len(own) for s, own in zip(starts, docs, strict=True)]] = 0
        zeros = np.concatenate([[0], np.cumsum(row == 0)])
        edge = np.zeros(len(row) + 1, np.int64)
        items: list[set[int]] = [set() for _ in docs]
        for size in self.sizes:
            if len(row) < size:
                continue
            at = np.flatnonzero(zeros[size:] == zeros[: len(zeros) - size])
            place, found = self.find(window_hashes(row, size)[at])
            for i, (f, k) in zip(at[place].tolist(), found, strict=True):
                own = self.items(f, k, b" ".join(flat[i : i + size]))
                if own is not None:
                    edge[i] += 1
                    edge[i + size] -= 1
                    items[int(np.searchsorted(begin, i, "right")) - 1].update(own)
        hit = np.cumsum(edge)[:-1] > 0
        return [hit[s : s + len(own)] for s, own in zip(starts, docs, strict=True)], items


def without(text: str, hit: np.ndarray) -> str:
    """The text less every run of hit words, from the start of its first to the end of its last."""
    out: list[str] = []
    at, run = 0, None
    for m, gone in zip(WORD.finditer(text.lower() if text.isascii() else text.translate(str.maketrans(_UPPER.decode(), _LOWER.decode()))), hit.tolist(), strict=True):
        if gone and run is None:
            out.append(text[at : m.start()])
            run = m.end()
        elif gone:
            run = m.end()
        elif run is not None:
            at, run = run, None
    if run is not None:
        at = run
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, full: bool = False, extra: tuple[str, ...] = (), part_windows: int = PART_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row.

    full: also items (their ids) and clean, the text without the hit spans.

    A test window is n consecutive words of a benchmark row, or all words of a row of
    fewer. Rows of the benchmark without words or without item_id have none; repeated
    ones count once. A null text has no words. Repeated rows and null ids stay as they
    are; an empty table gives an empty table, and with an empty benchmark nothing is
    hit. Documents are not shuffled. A task holds one slice of texts and their word hashes;
    a very long text is a slice alone. extra: further columns to carry along, as x0, x1 and so on.
    """
    shared = Shared(docs.sparkSession)
    tests = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    windows = shared.keep(benchmark_windows(tests, n))
    found = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    sizes, parts = sorted(found), max(1, -(-sum(found.values()) // part_windows))
    files = deliver(shared, build_parts(windows, parts), -(-parts // FILE_PARTS))
    shared.drop(windows)
    src, names, more = carried(docs, extra)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", items array<long>, clean string" * full + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Windows(mapped(files), sizes)
        for batch in slices(batches, most=1 << 20):
            masks, items = own.scan([words(t) for t in texts(batch)])
            hits = [int(m.sum()) for m in masks]
            out = [batch.column("doc_id"), pa.array([len(m) for m in masks], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 for h in hits], pa.bool_())]
            heads = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if full:
                out += [pa.array([sorted(x) for x in items], pa.list_(pa.int64())), pa.array([without(t, m) for t, m in zip(texts(batch), masks, strict=True)], pa.string())]
                heads += ["items", "clean"]
            yield pa.RecordBatch.from_arrays(out + [batch.column(n) for n in names], names=heads + [f"x{i}" for i in range(len(names))])

    return src.mapInArrow(run, schema)
