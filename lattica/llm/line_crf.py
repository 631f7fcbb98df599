"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are read from its bytes: length,
words, letter case, digits, symbols, punctuation, repeated and distinct words. Each is put
into bins fitted to the sample; the bins of the line and of both neighbours have weights,
and a 2 x 2 table scores neighbouring labels. Training maximises the likelihood of the
labels of a bounded sample of documents (each line has its document's label) by Adam on
exact gradients. A document's quality is the mean of its lines' forward-backward marginals,
weighted by their lengths in bytes.

Edge cases: a null or empty text is one empty line, and a text of empty lines only weighs
them alike; the first and last line have a bin of their own for the missing neighbour;
without labels of both kinds every score is the share of good labels (0 without labels); very long texts are
read whole; repeated rows get equal scores; null ids and ties play no part in a score; an empty table gives an
empty result; extra columns are carried, whatever their names, and replaced where they clash with results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, sampling
from .npbytes import BLOCK, IS_DIGIT, IS_LETTER, IS_SPACE, IS_UPPER, TO_LOWER, blocks, hashes, runs, table, tidy

#: Sample quantiles that bound the bins; the tails are finer, as rare traits tell most.
QUANTILES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.93, 0.96, 0.98, 0.99)
BINS = len(QUANTILES)
MAX_SAMPLE = 6000
MAX_SAMPLE_BYTES = 24 << 20
STEPS = 150
THRESHOLD = 0.7

IS_SYMBOL = table(b"#*$%&|<>=@^~_\\/{}[]")
IS_MARK = table(b"!?")
IS_STOP = table(b".,;:")


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every line of every text, and the first line of each text and the end."""
    feed = np.flatnonzero(data == 10)
    end = np.sort(np.concatenate((feed, offsets[1:])), kind="stable")
    counts = np.bincount(np.searchsorted(offsets, feed, "right") - 1, minlength=len(offsets) - 1) + 1
    first = np.concatenate(([0], np.cumsum(counts)))
    start = np.empty_like(end)
    start[1:] = end[:-1] + 1
    start[first[:-1]] = offsets[:-1]
    return start, end, first


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one row of numbers a line, bytes of each line, first line of each text and the end)."""
    start, end, first = lines_of(data, offsets)
    size = (end - start).astype(np.float64)
    n = len(start)

    def count(kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind[data], out=total[1:])
        return (total[end] - total[start]).astype(np.float64)

    w_start, w_end, _ = runs(~IS_SPACE[data], offsets)
    line = np.searchsorted(start, w_start, "right") - 1
    words = np.bincount(line, minlength=n).astype(np.float64)
    own = hashes(TO_LOWER[data], w_start, w_end)
    same = np.zeros(len(own))
    same[1:] = (own[1:] == own[:-1]) & (line[1:] == line[:-1])
    order = np.argsort(own ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    new = np.ones(len(own))
    new[1:] = (own[order][1:] != own[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], new, minlength=n)
    per_byte, per_word = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(count(IS_LETTER), 1)
    spaces = count(IS_SPACE)
    ends = np.zeros(n)
    if len(data):
        ends[end > start] = IS_STOP[data[np.maximum(end[end > start] - 1, 0)]]
    columns = [
        np.log2(1 + size), np.log2(1 + words), (size - spaces) / per_word, count(IS_UPPER) / letters, count(IS_DIGIT) / per_byte,
        count(IS_SYMBOL) / per_word, count(IS_MARK) / per_word, count(IS_STOP) / per_word, np.bincount(line, same, minlength=n) / per_word,
        distinct / per_word, letters / per_byte, np.bincount(line, (w_end - w_start) == 1, minlength=n) / per_word, ends,
    ]
    return np.stack(columns, axis=1), size, first


def marginals(emit: np.ndarray, first: np.ndarray, pair: np.ndarray, begin: np.ndarray, pairs: bool = False):
    """P(good) of every line, by forward-backward over all texts at once, step by step.

    ``emit`` is the score of good against bad; ``pair`` [from, to] and ``begin`` are scores
    of labels (0 bad, 1 good). With ``pairs`` also the summed pair marginals.
    """
    n, lengths = len(emit), np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    top, active = first[:-1][order], lengths[order]
    weight = np.exp(np.stack([-np.maximum(emit, 0), np.minimum(emit, 0)], axis=1))
    step, head = np.exp(pair - pair.max()), np.exp(begin - begin.max())
    ahead, back = np.empty((n, 2)), np.ones((n, 2))
    longest = int(active[0]) if len(active) else 0
    alive = np.searchsorted(-active, -np.arange(1, longest + 1), "right")
    for t in range(longest):
        at = top[: alive[t]] + t
        value = (head if t == 0 else ahead[at - 1] @ step) * weight[at]
        ahead[at] = value / value.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = top[: alive[t + 1]] + t
        value = (back[at + 1] * weight[at + 1]) @ step.T
        back[at] = value / value.sum(axis=1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return good
    inner = np.ones(n, bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    joint = ahead[at - 1][:, :, None] * step[None] * (weight[at] * back[at])[:, None, :]
    return good, (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


class Model:
    """Bin edges, weights [place, feature, bin], pair and begin scores."""

    def __init__(self, edges: list[np.ndarray]) -> None:
        self.edges = edges
        self.weights = np.zeros((3, len(edges), BINS + 2))
        self.bias, self.pair, self.begin = 0.0, np.zeros((2, 2)), np.zeros(2)
        self.constant: float | None = None

    def bins(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[line, place, feature] bins; the last bin is a neighbour that is missing."""
        own = np.stack([np.searchsorted(e, features[:, k], "right") for k, e in enumerate(self.edges)], axis=1)
        out = np.full((len(own), 3, own.shape[1]), BINS + 1, np.int16)
        out[:, 0] = own
        out[1:, 1], out[:-1, 2] = own[:-1], own[1:]
        out[first[:-1], 1] = BINS + 1
        out[first[1:] - 1, 2] = BINS + 1
        return out

    def emit(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.bias)
        for place in range(3):
            for k in range(bins.shape[2]):
                out += self.weights[place, k][bins[:, place, k]]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each text, P(good) of each line, first line of each text and the end)."""
        features, size, first = line_features(data, offsets)
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant), np.full(len(size), self.constant), first
        good = marginals(self.emit(self.bins(features, first)), first, self.pair, self.begin)
        total = np.add.reduceat(size, first[:-1])
        size = np.where(np.repeat(total, np.diff(first)) > 0, size, 1.0)
        return np.add.reduceat(size * good, first[:-1]) / np.add.reduceat(size, first[:-1]), good, first


def fit(texts: list[str], labels: np.ndarray, steps: int = STEPS, rate: float = 0.08, penalty: float = 1e-4) -> Model:
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        model = Model([])
        model.constant = float(labels.mean()) if len(labels) else 0.0
        return model
    parts = [line_features(data, offsets) for _, _, data, offsets in blocks(pa.array(texts, pa.large_string()))]
    features = np.concatenate([p[0] for p in parts])
    first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
    model = Model([np.unique(np.quantile(features[:, k], QUANTILES)) for k in range(features.shape[1])])
    bins, lengths = model.bins(features, first), np.diff(first)
    truth = np.repeat(labels, lengths)
    seen_pairs = np.diag([np.sum((lengths - 1) * (1 - labels)), np.sum((lengths - 1) * labels)])
    seen_begin = np.array([np.sum(1 - labels), np.sum(labels)])
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.weights, np.zeros(1), model.pair, model.begin)]
    for t in range(1, steps + 1):
        good, pairs = marginals(model.emit(bins), first, model.pair, model.begin, pairs=True)
        off = (truth - good) / len(truth)
        d_w = np.stack([[np.bincount(bins[:, p, k], off, minlength=BINS + 2) for k in range(bins.shape[2])] for p in range(3)])
        head = np.stack([1 - good[first[:-1]], good[first[:-1]]], axis=1).sum(axis=0)
        grads = [d_w - penalty * model.weights, np.array([off.sum()]), (seen_pairs - pairs) / len(truth) - penalty * model.pair, (seen_begin - head) / len(labels)]
        moves = []
        for g, (m, v) in zip(grads, state, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            moves.append(rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8))
        model.weights += moves[0]
        model.bias += float(moves[1][0])
        model.pair += moves[2]
        model.begin += moves[3]
    return model


def train(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_sample: int = MAX_SAMPLE, max_bytes: int = MAX_SAMPLE_BYTES) -> Model:
    """A model from at most ``max_sample`` labelled documents where ``keep`` (on the labels' id) holds."""
    rows = sampling.labelled(docs, labels, label_col, keep, max_sample, max_bytes, id_col, text_col)
    return fit([r["text"] for r in rows], np.array([r["__label"] for r in rows], np.float64))


def _scores(shared, kept: list[str], with_lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, good, ends = [np.zeros(0)], [np.zeros(0)], [np.zeros(1, np.int64)]
            for _, _, data, offsets in blocks(batch.column("__text"), BLOCK):
                score, line, first = shared.value.score(data, offsets)
                scores.append(score)
                if with_lines:
                    good.append(line)
                    ends.append(first[1:] + ends[-1][-1])
            made, names = [pa.array(np.concatenate(scores))], ["score"]
            if with_lines:
                made.append(pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(good))))
                names.append("line_scores")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], [*kept, *names])

    return tidy(run)


def classify(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False, with_lines: bool = False) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with score, and P(good) of every line if ``with_lines``."""
    whole = common.packed(docs, text_col, nulls=True)
    kept = ["__rest", "__text"] if keep_text else ["__rest"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = common.with_fields(whole, kept, "score double" + ", line_scores array<double>" * with_lines)
    made = {"score": F.col("score")} | ({"line_scores": F.col("line_scores")} if with_lines else {})
    scored = whole.mapInArrow(_scores(shared, kept, with_lines), schema)
    return scored.select(*common.unpacked(docs, text_col, made, text=F.col("__text") if keep_text else None))
