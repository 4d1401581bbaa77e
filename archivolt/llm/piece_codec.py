"""SentencePiece merge-type encoding and decoding, by backtracking.

``Codec`` reads a BPE model file and encodes without the library:

* an Aho-Corasick automaton lists, for every position of a chunk, the pieces that
  start there; the longest is tried first;
* a piece is taken after another only if the two are compatible, that is if
  merging the characters of both anew gives exactly these two pieces. A sequence
  whose neighbours are all compatible is the one that merging yields;
* a position from which nothing led to the end is marked in a bitfield and never
  tried again, so the search is linear in the number of positions and pieces; the
  field is bytes that are changed in place, so a mark costs the same in any chunk.

Characters without a piece never merge; they become bytes and part the chunk.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import columns, slices, texts

SPACE = "▁"
#: Chunks, and pairs of pieces, that a worker remembers; both start anew when full.
KEEP_CHUNKS, KEEP_PAIRS = 300_000, 500_000
#: Letters and marks between which chunks end, if no piece has a letter with a mark after it.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!\"#$%&'()*+,./:;<=>?@\\[\\]^_`{|}~-"

# Fixed values of the public model file format: field numbers and piece kinds.
PIECES, NORMALIZER, TRAINER = 1, 3, 2
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
MODEL_KIND, BYTE_FALLBACK = 3, 35
NORMALIZER_NAME, NORMALIZER_TABLE, ADD_PREFIX, TRIM, ESCAPE = 1, 2, 3, 4, 5
NORMAL, BYTE, BPE = 1, 6, 2


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one message; fixed-width values as bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(raw, at)
        else:
            n, at = _varint(raw, at) if wire == 2 else ({1: 8, 5: 4}[wire], at)
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


class Codec:
    """Encoder and decoder of one BPE model file with byte fallback."""

    def __init__(self, path: str):
        import struct

        import ahocorasick

        with open(path, "rb") as f:
            raw = f.read()
        self.piece: list[str] = []
        self.kind: list[int] = []
        score: list[float] = []
        norm: dict = {}
        trainer: dict = {}
        for field, value in _fields(raw):
            if field == PIECES:
                one = dict(_fields(value))
                self.piece.append(one[PIECE_TEXT].decode())
                self.kind.append(one.get(PIECE_KIND, NORMAL))
                score.append(struct.unpack("<f", one[PIECE_SCORE])[0])
            elif field == NORMALIZER:
                norm = dict(_fields(value))
            elif field == TRAINER:
                trainer = dict(_fields(value))
        if trainer.get(MODEL_KIND) != BPE or not trainer.get(BYTE_FALLBACK):
            raise ValueError(f"{path}: not a BPE model with byte fallback")
        if norm.get(NORMALIZER_TABLE) or norm.get(TRIM, 1) or not norm.get(ESCAPE, 1) or set(self.kind) - {NORMAL, 2, 3, BYTE}:
            raise ValueError(f"{path}: only the identity normaliser without trimming or own symbols is supported")
        self.prefix = bool(norm.get(ADD_PREFIX, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.piece, self.kind, strict=True)) if k == NORMAL}
        self.rank = {p: -score[i] for p, i in self.ids.items()}
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.piece, self.kind, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # A chunk is a run of spaces and what follows, up to the next space or line end, or a
        # word up to a mark. No piece has the two characters at such a boundary side by side, so
        # no merge reaches over it. A model for which this does not hold is searched as a whole.
        whole = all(re.fullmatch(f"{SPACE}*[^{SPACE}\n]*", p) for p in self.ids)
        words = not any(re.search(f"[{LETTERS}][{MARKS}]", p) for p in self.ids)
        word = f"{SPACE}*[{LETTERS}]++(?=[{MARKS}{SPACE}\n]|$)|" if words else ""
        self.chunks = re.compile(f"{word}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if whole else r"(?s).+")
        self.find = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.find.add_word(p, (i, len(p)))
        self.find.make_automaton()
        self.fits: dict[int, bool] = {}
        self.seen = _Seen(self)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: best score first, the leftmost among equals."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        out = self.fits.get(key)
        if out is None:
            a, b = self.piece[left], self.piece[right]
            out = self.merged(a + b) == [a, b]
            if len(self.fits) >= KEEP_PAIRS:
                self.fits.clear()
            self.fits[key] = out
        return out

    def _span(self, starts: list[list[tuple[int, int]]], first: int, last: int) -> list[int]:
        """Ids of the positions ``first`` to ``last``, all of which start a piece.

        starts: by position, (id, length) of the pieces there, shorter ones first.
        """
        failed = bytearray((last - first >> 3) + 1)  # bit p: nothing led from position first + p to the end
        ids: list[int] = []
        tried: list[int] = []  # by taken piece, its place in its list
        at, place = first, len(starts[first]) - 1
        while at < last:
            options = starts[at]
            while place >= 0:
                found, length = options[place]
                end = at + length
                if end <= last and not failed[end - first >> 3] >> (end - first & 7) & 1 and (self.compatible(ids[-1], found) if ids else self._single(found)):
                    break
                place -= 1
            if place >= 0:
                ids.append(found)
                tried.append(place)
                at = end
                place = len(starts[at]) - 1 if at < last else 0
            else:
                failed[at - first >> 3] |= 1 << (at - first & 7)
                if not ids:
                    raise ValueError("no sequence of compatible pieces")
                at -= len(self.piece[ids.pop()])
                place = tried.pop() - 1
        return ids

    def _single(self, found: int) -> bool:
        """Whether merging the characters of a piece gives that piece."""
        key = -1 - found
        out = self.fits.get(key)
        if out is None:
            out = self.fits[key] = self.merged(self.piece[found]) == [self.piece[found]]
        return out

    def chunk(self, text: str) -> list[int]:
        starts: list[list[tuple[int, int]]] = [[] for _ in range(len(text) + 1)]
        for end, (found, length) in self.find.iter(text):
            starts[end - length + 1].append((found, length))
        out: list[int] = []
        at, n = 0, len(text)
        while at < n:
            if text[at] not in self.ids:
                out += [self.bytes[b] for b in text[at].encode()]
                at += 1
                continue
            last = at + 1
            while last < n and text[last] in self.ids:
                last += 1
            out += self._span(starts, at, last)
            at = last
        return out

    def escaped(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks.findall(self.escaped(text)) for i in self.chunk(c)]

    def surface(self, ids: list[int]) -> str:
        """The text of ids with every space still there; runs of byte pieces as UTF-8."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                held.append(byte)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if self.kind[i] == NORMAL:
                out.append(self.piece[i].replace(SPACE, " "))
            elif self.kind[i] == 2:
                out.append(" ⁇ ")
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        out = self.surface(ids)
        starts = bool(ids) and self.kind[ids[0]] == NORMAL and self.piece[ids[0]].startswith(SPACE)
        return out[1:] if self.prefix and starts else out

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, the decoded text; chunks are remembered."""
        escaped = self.escaped(text)
        if not escaped:
            return 0, "", ""
        parts, seen = self.chunks.findall(escaped), self.seen
        seen.trim()
        ids = ",".join(map(seen.__getitem__, parts))
        # Of every chunk the ids have been decoded once; ``odd`` has those that give another text.
        back = "".join(seen.odd.get(c, c) for c in parts) if seen.odd else escaped
        back = back.replace(SPACE, " ")
        return ids.count(",") + 1, ids, back[1:] if self.prefix else back


class _Seen(dict):
    """Ids of chunks, joined by commas; ``odd`` has the text of those whose ids decode to another one."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.odd, self.long_odd = codec, {}, []

    def __missing__(self, chunk: str) -> str:
        own = self.codec.chunk(chunk)
        out, back = ",".join(map(str, own)), self.codec.surface(own)
        short = len(chunk) <= 64
        if back != chunk.replace(SPACE, " "):
            self.odd[chunk] = back
            if not short:
                self.long_odd.append(chunk)
        if len(self) >= KEEP_CHUNKS:
            self.clear()
        if short:
            self[chunk] = out
        return out

    def trim(self) -> None:
        """Between two texts: forgets the odd chunks that are not remembered, and all where they are many."""
        for chunk in self.long_odd:
            self.odd.pop(chunk, None)
        self.long_odd.clear()
        if len(self.odd) >= KEEP_CHUNKS:
            self.odd.clear()
            self.clear()


@functools.cache
def codec(path: str) -> Codec:
    return Codec(os.fspath(path))


def piece_digests(docs: DataFrame, path: str, *, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; full: also ids and decoded.

    path: a BPE ``.model`` file with byte fallback, at the same place on every
    executor. Ids are those of the sentencepiece library without begin and end;
    decoded is what its decode gives for them.

    One narrow stage. Only a chunk (spaces and the word after them) is searched at
    a time, so very long texts need memory in proportion to the text alone; what a
    worker remembers is bounded by KEEP_CHUNKS and KEEP_PAIRS. Null counts as empty:
    0 tokens and the digest of nothing. Repeated rows and null ids stay as they are;
    an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in slices(batches):
            rows = [one.digest(t) for t in texts(batch)]
            out = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([sha(r[1]) for r in rows], pa.string()), pa.array([sha(r[2]) for r in rows], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                out += [pa.array([[int(x) for x in r[1].split(",")] if r[1] else [] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return columns(docs, "doc_id", "text").mapInArrow(run, schema)
