"""Token counts, piece encoding and id files against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from archivolt.llm import id_files as I
from archivolt.llm.piece_codec import Codec, piece_digests
from archivolt.llm.tokens import lengths, pieces, token_counts

BYTE, WORD, PIECE = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
PARTS = ["a", "The", " ", "  ", "\n", "é", "é", " ́", "日本", "𝒳", "▁", "\x00", "'s", "ing", " t", "\xa0", "\x1c", "<|endoftext|>", "<|startoftext|>", "12", "!", ".", ", ", "\x85", "İ", "Σ", "x" * 40]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=16).map("".join) | st.text(max_size=30)


@pytest.fixture(scope="module")
def libs():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE), Codec(PIECE), I.Encoder(WORD)


@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_texts_as_the_libraries_encode_them(libs, text):
    byte, word, piece, codec, encoder = libs
    assert lengths(BYTE, [text], 50, 3)[0] == len(byte.encode(text, add_special_tokens=False).ids)
    ids = word.encode(text, add_special_tokens=False).ids
    assert lengths(WORD, [text], 50, 3)[0] == len(ids)
    assert encoder.encode(text).tolist() == ids
    ids = piece.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == piece.decode(ids)
    assert codec.digest(text) == (len(ids), ",".join(map(str, ids)), piece.decode(ids))


def test_backtracking_meets_dead_ends(libs):
    """Longest matches alone would often be wrong: the search has to go back."""
    codec, piece = libs[3], libs[2]
    went_back = 0
    rng = random.Random(3)
    letters = "theinganderonatioes"
    for _ in range(300):
        word = "".join(rng.choice(letters) for _ in range(12))
        ids = codec.chunk(word)
        assert "".join(codec.piece[i] for i in ids) == word
        assert codec.merged(word) == [codec.piece[i] for i in ids]
        at, greedy = 0, []
        while at < len(word):
            n = max(n for n in range(1, len(word) - at + 1) if word[at : at + n] in codec.ids)
            greedy.append(codec.ids[word[at : at + n]])
            at += n
        went_back += greedy != ids
    assert went_back > 20


def test_long_chunks_take_time_in_proportion(libs):
    """Runs without a boundary, up to 4 MB: the same ids as the library, in time that grows with the length."""
    import time

    codec, piece = libs[3], libs[2]
    rng = random.Random(1)
    took = []
    for n in (350_000, 700_000, 1_400_000):
        text = "".join(rng.choice("日本語の文字列は長い𝒳é") for _ in range(n))
        start = time.process_time()
        ids = codec.encode(text)
        took.append(time.process_time() - start)
        if n < 400_000:
            assert ids == piece.encode(text)
    assert took[2] < 8 * took[0] + 1


def test_odd_chunks_are_forgotten(libs, monkeypatch):
    """Chunks that decode to another text: remembered within bounds, and still right after they are forgotten."""
    from archivolt.llm import piece_codec

    piece = libs[2]
    codec = Codec(PIECE)
    monkeypatch.setattr(piece_codec, "KEEP_CHUNKS", 3)
    for i in range(40):
        text = f"a{i}▁b \x00{i} ▁ " + "▁x" * (i % 3) * 40
        ids = piece.encode(text)
        assert codec.digest(text) == (len(ids), ",".join(map(str, ids)), piece.decode(ids))
        assert len(codec.seen.odd) <= 3 + 12


def test_runs_of_spaces(libs):
    for n in range(70):
        for tail in ("", "x", "\n"):
            assert libs[3].encode(" " * n + tail) == libs[2].encode(" " * n + tail)


@given(text=TEXTS, most=st.integers(1, 9))
def test_pieces_join_to_the_text(text, most):
    assert "".join(pieces(text, most)) == text


@given(st.lists(st.integers(0, 5000), max_size=700), st.integers(0, 1 << 40))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values, base):
    v = np.sort(np.array(values, np.int64)) + (base if values else 0)
    raw = b"??" + I.ef_pack(v) + b"rest"
    e = I.EliasFano(raw, 2)
    assert e.all().tolist() == v.tolist()
    assert [e.select(i) for i in range(len(v))] == v.tolist()
    assert raw[2 + e.size :] == b"rest"
    with pytest.raises(IndexError):
        e.select(len(v))


def test_boundaries_take_little_room():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 20_000))
    assert len(I.ef_pack(ends)) * 8 / len(ends) < 14


def test_blocks_give_their_documents():
    ids = [np.arange(n, dtype=np.int64) % 60_000 for n in (3, 0, 500, 1)]
    for width in (2, 4):
        b = I.Block(I.block_pack([5, 7, 7, 90], ids, 11, width))
        assert [b.doc_id(i) for i in range(4)] == [5, 7, 7, 90]
        assert all((b.document(i) == x).all() for i, x in enumerate(ids))
        assert [r[1] for r in b.documents()] == [11, 14, 14, 514]


ROWS = [(3, "Hello there, friend. " * 50), (1, None), (2, ""), (5, "x" * 5000), (4, "Été à Paris <|endoftext|> ok"), (6, "same"), (7, "same")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "n_tokens", 1, None) for i, t in ROWS], "doc_id long, text string, n_tokens string, batch int, lang string")


def test_counts(spark, docs, libs):
    got = {r["doc_id"]: r for r in token_counts(docs, BYTE, limit=100, batch_bytes=100, piece_chars=64).collect()}
    for i, t in ROWS:
        n = len(libs[0].encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100)
    assert token_counts(docs.limit(0), BYTE).collect() == []
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs, PIECE).collect()}
    assert got == {i: len(libs[2].encode(t or "")) for i, t in ROWS}


def test_digests(docs, libs):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in piece_digests(docs, PIECE, full=True).collect():
        t = dict(ROWS)[r["doc_id"]] or ""
        ids = libs[2].encode(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(",".join(map(str, ids))) and r["decoded_sha256"] == sha(libs[2].decode(ids))
    assert piece_digests(docs.limit(0), PIECE).collect() == []


def test_files(spark, docs, libs):
    got = {r["doc_id"]: r for r in I.id_files(docs, WORD, shards=3, ids=True).collect()}
    at = 0
    for i, t in sorted(ROWS):
        ids = [*libs[1].encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids"]) == (at, len(ids), ids)
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert I.id_files(docs.limit(0), WORD).collect() == []
    odd = spark.createDataFrame([(None, "a b"), (9, "c"), (9, "d e"), (None, None)], "doc_id long, text string")
    out = sorted(((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in I.id_files(odd, WORD).collect()), key=repr)
    assert sum(x[0] == 0 for x in out) == 2 and all(x[1] is None for x in out if x[0] == 0)
    assert sorted(x[2] for x in out if x[0] == 9) == [2, 3]


def test_small_blocks_and_long_documents(spark, docs):
    from archivolt.llm.base import Shared

    blocks = Shared(spark).keep(I.write_blocks(docs, WORD, end_id=2, shards=1, block_ids=8))
    assert blocks.count() > 3
    assert {r["doc_id"] for r in I.read_blocks(blocks).collect()} == {i for i, _ in ROWS}


def test_documents_are_read_back_through_select(monkeypatch):
    from archivolt.llm import id_files as I

    ids = [np.arange(i % 7, dtype=np.int64) for i in range(700)]
    block = I.Block(I.block_pack([3 * i for i in range(700)], ids, 11, 2))
    monkeypatch.delattr(I.EliasFano, "all")
    start = 11
    for i, (name, at, own) in enumerate(block.documents()):
        assert (name, at, own.tolist()) == (3 * i, start, ids[i].tolist())
        start += len(own)
    assert i == 699
