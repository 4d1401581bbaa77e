"""Quality classifier: a linear-chain conditional random field over lines.

Every line gets a vector of its own shape; the field sees that of the line and of both
neighbours, and a weight for each change between good and bad. Labels exist for documents
only, so training alternates: lines of a good document are good; in a bad one, the lines
that the field takes for bad are bad, and of its length at least BAD_SHARE. A document's
score is a logistic curve, fitted on the same sample, over the mean of its lines'
forward-backward marginals, weighted by their lengths.

Training uses at most ``sample`` labelled documents, chosen by a hash of doc_id, of at
most SAMPLE_LINES lines each.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import carried, columns, slices, texts

#: Labelled documents that training takes at most.
SAMPLE = 2000
#: Lines of a document that training takes at most; documents of more are left out of the sample.
SAMPLE_LINES = 500
#: Lines whose features a worker holds at a time; chains of more than LONG lines are cut into blocks.
LINES, LONG = 1 << 14, 512
#: Rounds of labelling lines anew, and steps of the optimiser in each.
ROUNDS, STEPS = 3, 60
#: Share of a bad document's length that is bad at least.
BAD_SHARE = 0.3
RIDGE = 1e-4

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_SYMBOL = re.compile(r"[#*$%&|<>{}\[\]^~=_\\/+@]")
_LOUD = re.compile(r"[!?]")
_END = re.compile(r"[.!?:;,)\]\"'»”]$")
# Word beginnings of notices, menus and code.
_NOTICE = re.compile(r"(?i)licen[sc]|copyright|cookie|rights reserved|subscribe|sign in|log in|javascript|lorem ipsum|https?:|www\.|click here|©")
#: Edges that turn a share into steps.
_EDGES = np.array([0.02, 0.1, 0.3, 0.6])
N_SHARES = 10
WIDTH = 8 + N_SHARES * (1 + len(_EDGES))


def line_features(line: str, again: bool) -> list[float]:
    """Shape of a line; again: an earlier line of its document is equal. Its first 8 are plain, the rest shares."""
    words = line.split()
    n, size = len(words), len(line)
    if not size:
        return [1.0, 0, 0, 1.0, 0, 0, 0, 0] + [0.0] * N_SHARES
    m, k = max(1, n), max(1, n - 1)
    packed = len(zlib.compress(line.encode(), 1))
    return [
        1.0,
        np.log1p(size) / 8,
        np.log1p(n) / 5,
        0.0,
        float(again),
        float(_END.search(line) is not None),
        float(line[:1].isupper()),
        min(2.0, packed / (size + 12)),
        1 - len(set(words)) / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        1 - len(set(zip(words, words[1:], strict=False))) / k if n > 1 else 0.0,
        len(_UPPER.findall(line)) / size,
        min(1.0, 3 * len(_DIGIT.findall(line)) / size),
        min(1.0, 5 * len(_SYMBOL.findall(line)) / size),
        min(1.0, 5 * len(_LOUD.findall(line)) / size),
        sum(w == "|" for w in words) / m,
        sum(len(w) > 18 for w in words) / m,
        min(1.0, len(_NOTICE.findall(line)) * 10 / m),
    ]


_short_line = functools.lru_cache(1 << 15)(line_features)


def line_blocks(found: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of all lines of texts, text after text, at most ``most`` lines at a time, and weights (characters + 1).

    Lines are cut from the text as they come, so besides the block a text costs no more than its distinct lines.
    """
    rows: list[list[float]] = []
    weight: list[int] = []
    for text in found:
        seen: set[str] = set()
        at = 0
        while at >= 0:
            end = text.find("\n", at)
            line = text[at : end if end >= 0 else None]
            again = bool(line) and line in seen
            rows.append(_short_line(line, again) if len(line) <= 16 else line_features(line, again))
            seen.add(line)
            weight.append(len(line) + 1)
            at = end + 1 if end >= 0 else -1
            if len(rows) == most:
                yield _stepped(rows), np.array(weight, np.float64)
                rows, weight = [], []
    if rows:
        yield _stepped(rows), np.array(weight, np.float64)


def _stepped(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, np.float32).reshape(-1, 8 + N_SHARES)
    steps = (x[:, 8:, None] > _EDGES).reshape(len(x), -1)
    return np.concatenate([x, steps.astype(np.float32)], axis=1)


def line_counts(found: list[str]) -> np.ndarray:
    return np.array([t.count("\n") + 1 for t in found], np.int64)


def features(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of texts, lines by text, and weights; all in memory."""
    x, weight = zip(*line_blocks(found, 1 << 30), strict=True) if found else ([np.zeros((0, WIDTH), np.float32)], [np.zeros(0)])
    return np.concatenate(x), line_counts(found), np.concatenate(weight)


def beside(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features with those of the line before and after; zeros at the ends of a document."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(counts)
    before[(ends - counts)[counts > 0]] = 0
    after[(ends - 1)[counts > 0]] = 0
    return np.concatenate([x, before, after], axis=1)


class Chains:
    """Documents' lines by step, the longest documents first, so that a step's lines are together."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        longest = int(counts.max()) if len(counts) else 0
        live = np.searchsorted(-counts[order], -np.arange(longest), "left")
        self.steps = [first[:n] + t for t, n in enumerate(live)]

    def marginals(self, emit: np.ndarray, change: np.ndarray, start: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line; sums of pair marginals (2 x 2) and of first marginals (2), by the share of their document.

        emit: score of good less that of bad. share: weight of the document of each line. Forward and backward in logs.
        """
        share = np.ones(len(emit)) if share is None else share
        n = len(emit)
        score = np.zeros((n, 2))
        score[:, 1] = emit
        fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
        add = np.logaddexp
        for t, at in enumerate(self.steps):
            if not t:
                fwd[at] = start + score[at]
            else:
                f = fwd[at - 1]
                fwd[at, 0] = add(f[:, 0] + change[0, 0], f[:, 1] + change[1, 0])
                fwd[at, 1] = add(f[:, 0] + change[0, 1], f[:, 1] + change[1, 1]) + score[at, 1]
        for at in reversed(self.steps[1:]):
            b = bwd[at] + score[at]
            bwd[at - 1, 0] = add(change[0, 0] + b[:, 0], change[0, 1] + b[:, 1])
            bwd[at - 1, 1] = add(change[1, 0] + b[:, 0], change[1, 1] + b[:, 1])
        both = fwd + bwd
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        pairs = np.zeros((2, 2))
        if len(self.steps) > 1:
            at = np.concatenate(self.steps[1:])
            z = add(both[at, 0], both[at, 1])
            for i in (0, 1):
                for j in (0, 1):
                    pairs[i, j] = np.exp(fwd[at - 1, i] + change[i, j] + score[at, j] + bwd[at, j] - z) @ share[at]
        first = self.steps[0] if self.steps else np.zeros(0, np.int64)
        return good, pairs, np.array([(1 - good[first]) @ share[first], good[first] @ share[first]])


def long_chain(emit: np.ndarray, change: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(good) of each line of one long chain, as ``Chains.marginals`` gives it.

    The chain is cut into about as many blocks as a block has lines. A block's product of
    2 x 2 steps is taken for all blocks at once; messages are carried over the blocks; then
    all blocks go forward and backward from the messages at their ends. Some square roots
    of n steps on rows of that length, 100 bytes a line.
    """
    n = len(emit)
    size = max(1, math.isqrt(n))
    blocks = -(-n // size)
    none = -1e30
    # step[t, b]: from the state before line b * size + t to that of the line.
    score = np.zeros((blocks * size, 2))
    score[:n, 1] = emit
    step = change[None, :, :] + score[:, None, :]
    step[0] = np.where(np.eye(2, dtype=bool), score[0], none)
    step[n:] = np.where(np.eye(2, dtype=bool), 0.0, none)
    step = step.reshape(blocks, size, 2, 2).swapaxes(0, 1)
    add = np.logaddexp
    whole = np.broadcast_to(np.where(np.eye(2, dtype=bool), 0.0, none), (blocks, 2, 2))
    for t in range(size):
        whole = add(whole[:, :, 0, None] + step[t, :, 0, None, :], whole[:, :, 1, None] + step[t, :, 1, None, :])
    into, back = np.zeros((blocks, 2)), np.zeros((blocks, 2))
    into[0] = start
    for b in range(1, blocks):
        into[b] = add(into[b - 1, 0] + whole[b - 1, 0], into[b - 1, 1] + whole[b - 1, 1])
    for b in range(blocks - 1, 0, -1):
        back[b - 1] = add(whole[b, :, 0] + back[b, 0], whole[b, :, 1] + back[b, 1])
    both = np.zeros((size, blocks, 2))
    for t in range(size):
        into = add(into[:, 0, None] + step[t, :, 0], into[:, 1, None] + step[t, :, 1])
        both[t] = into
    for t in range(size - 1, -1, -1):
        both[t] += back
        back = add(step[t, :, :, 0] + back[:, 0, None], step[t, :, :, 1] + back[:, 1, None])
    flat = both.swapaxes(0, 1).reshape(-1, 2)[:n]
    return 1 / (1 + np.exp(np.clip(flat[:, 0] - flat[:, 1], -700, 700)))


@dataclass
class Model:
    weights: np.ndarray
    change: np.ndarray
    start: np.ndarray
    curve: tuple[float, float]

    def emissions(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score of good less that of bad of all lines, and their weights; features of LINES lines at a time.

        What a line gives to its own score and to those of its neighbours are three
        numbers, so only these are kept of it.
        """
        w = self.weights.reshape(3, WIDTH).T
        parts = [(x.astype(np.float64) @ w, weight) for x, weight in line_blocks(found, LINES)]
        own, weight = (np.concatenate(p) for p in zip(*parts, strict=True))
        counts = line_counts(found)
        ends = np.cumsum(counts)
        emit = own[:, 0].copy()
        before, after = own[:-1, 1].copy(), own[1:, 2].copy()
        before[ends[:-1] - 1] = after[ends[:-1] - 1] = 0
        emit[1:] += before
        emit[:-1] += after
        return emit, weight

    def document_means(self, emit: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Mean of the lines' marginals by weight. Chains up to LONG lines go side by side, longer ones alone."""
        if not len(counts):
            return np.zeros(0)
        good = np.zeros(len(emit))
        first = np.cumsum(counts) - counts
        long = counts > LONG
        for at, n in zip(first[long], counts[long], strict=True):
            good[at : at + n] = long_chain(emit[at : at + n], self.change, self.start)
        rows = np.repeat(~long, counts)
        good[rows] = Chains(counts[~long]).marginals(emit[rows], self.change, self.start)[0]
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)

    def score(self, found: list[str]) -> np.ndarray:
        if not found:
            return np.zeros(0)
        a, b = self.curve
        emit, weight = self.emissions(found)
        return 1 / (1 + np.exp(-np.clip(a + b * self.document_means(emit, line_counts(found), weight), -700, 700)))


def gradient(big: np.ndarray, chains: Chains, follow: np.ndarray, first: np.ndarray, y: np.ndarray, share: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of line labels y, each document's by its share, a line; less the ridge.

    follow: lines that have one before them; first: those that have none.
    """
    width = big.shape[1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[follow - 1], y[follow]), share[follow])
    begun = np.bincount(y[first], weights=share[first], minlength=2)
    w, change, start = theta[:width], theta[width : width + 4].reshape(2, 2), theta[width + 4 :]
    good, pairs, firsts = chains.marginals((big @ w.astype(np.float32)).astype(np.float64), change, start, share)
    return np.concatenate([(((y - good) * share).astype(np.float32) @ big).astype(np.float64), (seen - pairs).ravel(), begun - firsts]) / len(big) - RIDGE * theta


def _fit_lines(big: np.ndarray, chains: Chains, first: np.ndarray, follow: np.ndarray, y: np.ndarray, theta: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Steps of Adam along ``gradient``; share: weight of each line's document, by its class."""
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        grad = gradient(big, chains, follow, first, y, share, theta)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def train(x: np.ndarray, counts: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> Model:
    """Fits lines and curve. Without documents of both classes all scores lean to the only class."""
    width = 3 * WIDTH
    if len(set(labels.tolist())) < 2:
        only = labels[0] if len(labels) else 1
        return Model(np.zeros(width), np.zeros((2, 2)), np.zeros(2), (2.0 if only else -2.0, 0.0))
    doc = np.repeat(np.arange(len(counts)), counts)
    big = beside(x, counts)
    chains = Chains(counts)
    ends = np.cumsum(counts)
    first = ends - counts
    follow = np.setdiff1d(np.arange(len(x)), first)
    y = labels[doc].astype(np.int64)
    # Bad documents are rarer: lines of both classes weigh the same in all.
    bad = max(1, int((y == 0).sum()))
    share = np.where(labels[doc] == 0, min(10.0, max(1.0, (len(y) - bad) / bad)), 1.0)
    theta = np.zeros(width + 6)
    for turn in range(ROUNDS):
        if turn:
            good, _, _ = chains.marginals((big @ theta[:width].astype(np.float32)).astype(np.float64), theta[width : width + 4].reshape(2, 2), theta[width + 4 :])
            y = np.where(labels[doc] == 1, 1, (good > 0.5).astype(np.int64))
            # In a bad document the worst lines are bad until they make BAD_SHARE of it.
            order = np.lexsort((good, doc))
            before = np.cumsum(weight[order]) - weight[order]
            base = np.repeat(before[first], counts)
            total = np.repeat(np.add.reduceat(weight, first), counts)
            least = np.zeros(len(y), bool)
            least[order] = (before - base) < BAD_SHARE * total
            y[least & (labels[doc] == 0)] = 0
        theta = _fit_lines(big, chains, first, follow, y, theta, share)
    model = Model(theta[:width], theta[width : width + 4].reshape(2, 2), theta[width + 4 :], (0.0, 1.0))
    mean = model.document_means((big @ model.weights.astype(np.float32)).astype(np.float64), counts, weight)
    a = b = 0.0  # Newton on two parameters
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * mean, -700, 700)))
        h = p * (1 - p) + 1e-9
        g = np.array([(labels - p).sum() - 0.1 * a, ((labels - p) * mean).sum() - 0.1 * b])
        step = np.linalg.solve(np.array([[h.sum() + 0.1, (h * mean).sum()], [(h * mean).sum(), (h * mean * mean).sum() + 0.1]]), g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    return Model(model.weights, model.change, model.start, (float(a), float(max(b, 0.0))))


def fitted(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents that are not held out.

    The sample is the smallest hashes of doc_id; a doc_id with several labels counts as
    bad if one of them is 0. Only its features (about 10 lines of 58 numbers a document)
    reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, counts, weight = features(texts(batch))
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary()), pa.array([weight[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary()), batch.column("quality")],
                names=["doc_id", "x", "weight", "quality"],
            )

    # At most ``sample`` rows of two numbers are broadcast.
    short = F.length("text") - F.length(F.translate("text", "\n", "")) < SAMPLE_LINES
    rows = columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.coalesce(short, F.lit(True))).select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, x binary, weight binary, quality int").orderBy("doc_id").collect()
    if not rows:
        return train(np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    weight = [np.frombuffer(r["weight"]) for r in rows]
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in rows])
    return train(x, np.array([len(w) for w in weight]), np.concatenate(weight), np.array([int(r["quality"] > 0) for r in rows]))


def held_out(name: str):
    """Rows whose crc32 of doc_id as text leaves 2 when divided by 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, sample: int = SAMPLE, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels: doc_id and quality.

    A score depends on the text alone. A null text counts as empty: one empty line.
    Repeated rows get equal scores; null ids stay, and are never held out. An empty table
    gives an empty table; without labels of both classes every score is one constant.
    After training on a bounded sample, one narrow stage; a very long text is held by its
    task, with its distinct lines and some 200 bytes a line. extra: further columns to carry along, as x0, x1 and so on.
    """
    model = fitted(docs, labels, sample=sample)
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    src, names, more = carried(docs, extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, one = sent.value
        for batch in slices(batches):
            score = np.round(one.score(texts(batch)), 9)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), *(batch.column(n) for n in names)], names=["doc_id", "held_out", "score", *(f"x{i}" for i in range(len(names)))]
            )

    out = src.withColumn("held_out", held_out("doc_id")).mapInArrow(run, "doc_id long, held_out boolean, score double" + more)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)).select("doc_id", "held_out", "score", "predicted", *(f"x{i}" for i in range(len(names))))
