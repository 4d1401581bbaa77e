"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import columns, slices, texts

#: Bytes of text that go to the library in one batch.
BATCH_BYTES = 1 << 20
#: Texts above so many characters are split at safe boundaries.
PIECE_CHARS = 1 << 15

#: After a character that no rule takes for white space, before one that every rule takes for it.
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c])")


def pieces(text: str, most: int) -> Iterator[str]:
    """``text`` in order, in pieces of about ``most`` characters, cut only at safe boundaries.

    A boundary lies between a non-space and a space. There the byte-level and the
    word-end pre-tokenizers end a match whatever follows, and a match that starts
    there looks only ahead; so the tokens of the pieces are those of the text. A
    text without such a place stays whole.
    """
    start = 0
    while len(text) - start > most:
        found = _BOUNDARY.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def splittable(spec: dict) -> bool:
    """Whether a tokenizer file uses only rules for which ``pieces`` is safe."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    steps = pre.get("pretokenizers", [pre])
    kinds = [x.get("type") for x in norm.get("normalizers", [norm]) if x]
    level = [x for x in steps if x.get("type") == "ByteLevel"]
    split = [x for x in steps if x.get("type") == "Split"]
    added = any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or re.search(r"\s", x["content"]) for x in spec.get("added_tokens", []))
    return (
        not added
        and len(level) == 1
        and len(level) + len(split) == len(steps)
        and not level[0].get("add_prefix_space")
        and (level[0].get("use_regex", True) if not split else all(x.get("invert") and x.get("behavior") == "Removed" and r"\s" in str(x.get("pattern")) for x in split))
        and set(kinds) <= {"NFC", "Replace", "Lowercase"}
        and spec["model"]["type"] == "BPE"
        and not spec["model"].get("dropout")
    )


@functools.cache
def json_tokenizer(path: str):
    """The tokenizer of a .json file, and whether long texts may be split."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    with open(path, encoding="utf-8") as f:
        return out, splittable(json.load(f))


@functools.cache
def piece_tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def lengths(path: str, found: list[str], batch_bytes: int, piece_chars: int) -> np.ndarray:
    """Tokens of each text, encoded in batches of about equal bytes."""
    out = np.zeros(len(found), dtype=np.int64)
    if path.endswith(".model"):
        encoder, split = piece_tokenizer(path), False
        encode = lambda part: [len(x) for x in encoder.encode(part, num_threads=1)]
    else:
        encoder, split = json_tokenizer(path)
        encode = lambda part: [len(x) for x in encoder.encode_batch_fast(part, add_special_tokens=False)]
    part: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if part:
            np.add.at(out, owner, encode(part))
        part.clear()
        owner.clear()
        held = 0

    for i, text in enumerate(found):
        for piece in pieces(text, piece_chars) if split else (text,):
            if piece:
                part.append(piece)
                owner.append(i)
                held += len(piece) if piece.isascii() else len(piece.encode())
                if held >= batch_bytes:
                    flush()
    flush()
    return out


def token_counts(docs: DataFrame, path: str, *, limit: int = 1024, batch_bytes: int = BATCH_BYTES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    path: a ``.json`` file of the tokenizers library or a ``.model`` file of
    sentencepiece, at the same place on every executor. Counts are those of the
    library without begin, end or added special tokens.

    One narrow stage: no shuffle, and only the lengths leave the Python workers.
    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids
    stay as they are. Very long texts go through in pieces. An empty table gives
    an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = lengths(path, texts(batch), batch_bytes, piece_chars)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    src = columns(docs, "doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
