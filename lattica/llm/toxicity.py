"""Toxicity: a convolutional text classifier in numpy.

Words (runs of letters, digits or non-ASCII bytes, A-Z lower-cased) are hashed into a table
of embeddings; a word's vector is the sum of the rows of the word and of its first 4 and 5
bytes, which carries over to inflected and compound forms. Filters of several widths slide over them; the largest value of each filter
over the whole text goes through a logistic layer. Training is by mini-batches on all
labelled documents; since only the largest value of a filter gets a gradient, backward steps
touch a few words a document. Scores are the same whatever the batch.

The fit starts on the driver, on the first documents of a hash order. If there are more, it
goes on over all of them in rounds: documents are dealt to shards by a hash of their id, each
shard takes an epoch of steps from the round's model, and what the shards changed is averaged
over those that changed it. Sums are of whole numbers (2 ** -40 parts), so that neither
partitions nor their order play a part. Words are hashed once, into one row a shard.

Filters of width w are sums of w tables over word buckets, one for each position in the
window, so scoring is table look-ups and additions over all words of a block of texts.

Thresholds are calibrated by language on a fifth of the labelled documents, which the fit never
sees (counted by scores in 2 ** -16 steps where they are more than the start); they only serve the operator's own ``toxic`` column. The score never sees the language.

Edge cases: null, empty or wordless texts get the score of a text whose filters are all 0;
a language without enough labels uses the common threshold; without labels of both kinds
every score is the share of positive labels (0 without any label); very long texts are read whole; repeated rows
get equal scores; an empty table gives an empty result; extra columns are carried, and replaced where they clash with results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, sampling
from .npbytes import BLOCK, IS_DIGIT, IS_LETTER, TO_LOWER, blocks, hashes, runs, tidy

BUCKETS = 1 << 15
SIZE = 12
WIDTHS = {1: 16, 2: 8, 3: 8}
MAX_SAMPLE = 6000
MAX_SAMPLE_BYTES = 24 << 20
EPOCHS = 12
THRESHOLD = 0.7
#: Passes over all labelled documents after the start, and the documents and bytes of a shard.
ROUNDS, SHARD, SHARD_BYTES = 4, 512, 4 << 20
#: Steps of a score that thresholds tell apart, and parts of 1 in which changes are summed.
LEVELS, UNITS = 1 << 16, float(1 << 40)
#: Every ASIDE-th labelled row is left out of the fit, for thresholds; a language needs so many of them, and so many toxic ones.
ASIDE, LEAST, LEAST_TOXIC = 5, 40, 5
PAD = max(WIDTHS) - 1
PREFIXES = (4, 5)
PARTS = 1 + len(PREFIXES)


def word_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of each word by part, first word of each text and the end), bucket 0 being padding.

    Each text is followed by padding, so a window that starts on a word never joins two texts.
    """
    low = TO_LOWER[data]
    start, end, text = runs((IS_LETTER | IS_DIGIT)[data], offsets)
    ends = [end, *[np.minimum(start + k, end) for k in PREFIXES]]
    own = np.stack([(hashes(low, start, e) % np.uint64(buckets - 1)).astype(np.int32) + 1 for e in ends], axis=1)
    counts = np.bincount(text, minlength=len(offsets) - 1)
    at = np.concatenate(([0], np.cumsum(counts + PAD)))
    out = np.zeros((at[-1], PARTS), np.int32)
    out[np.arange(len(own)) + text * PAD] = own
    return out, at


class Model:
    """Embeddings, filters and the logistic layer; float32."""

    def __init__(self, seed: int = 7, buckets: int = BUCKETS) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (buckets, SIZE)).astype(np.float32)
        self.embed[0] = 0
        self.filters = {w: rng.normal(0, 0.3, (w, SIZE, n)).astype(np.float32) for w, n in WIDTHS.items()}
        self.weights = rng.normal(0, 0.1, sum(WIDTHS.values())).astype(np.float32)
        self.bias = np.float32(0)
        self.constant: float | None = None
        self.tables: dict[int, list[np.ndarray]] = {}
        self.seen: dict | None = None

    def begin(self, share: float) -> Model:
        """Bias of the share of positive labels, and the state of Adagrad."""
        self.bias = np.float32(np.log(share / (1 - share)))
        self.seen = {"embed": np.full_like(self.embed, 1e-6), "weights": np.full_like(self.weights, 1e-6), "bias": 1e-6, **{w: np.full_like(f, 1e-6) for w, f in self.filters.items()}}
        return self

    def flat(self) -> np.ndarray:
        """All weights beside their Adagrad sums, as rows of 2 * SIZE numbers: embeddings, then filters, then the logistic layer."""
        out = []
        for embed, filters, last in ((self.embed, self.filters, [*self.weights, self.bias]), (self.seen["embed"], self.seen, [*self.seen["weights"], self.seen["bias"]])):
            layer = np.zeros(-(-len(last) // SIZE) * SIZE)
            layer[: len(last)] = last
            out.append(np.concatenate([embed, *[filters[w].transpose(0, 2, 1).reshape(-1, SIZE) for w in self.filters], layer.reshape(-1, SIZE)]).astype(np.float64))
        return np.hstack(out)

    def filled(self, flat: np.ndarray) -> Model:
        """A model of this one's shape with the numbers of ``flat``."""
        model, at = Model(buckets=len(self.embed)), len(self.embed)
        values, seen = flat[:, :SIZE], flat[:, SIZE:]
        model.embed, model.seen = values[:at].astype(np.float32), {"embed": seen[:at].astype(np.float32)}
        for w, f in self.filters.items():
            rows = w * f.shape[2]
            for into, part in ((model.filters, values), (model.seen, seen)):
                into[w] = np.ascontiguousarray(part[at : at + rows].reshape(w, -1, SIZE).transpose(0, 2, 1), np.float32)
            at += rows
        last, sums, n = values[at:].ravel(), seen[at:].ravel(), len(self.weights)
        model.weights, model.bias = last[:n].astype(np.float32), np.float32(last[n])
        model.seen |= {"weights": sums[:n].astype(np.float32), "bias": float(sums[n])}
        return model.prepare()

    def prepare(self) -> Model:
        self.tables = {w: [self.embed @ f[k] for k in range(w)] for w, f in self.filters.items()}
        return self

    def pooled(self, ids: np.ndarray, at: np.ndarray, places: bool = False):
        """Largest filter values of each text (at least 0), and where they are."""
        n, out, where = len(at) - 1, [], []
        padding = (at[1:, None] - np.arange(1, PAD + 1)).ravel()
        for w, parts in self.tables.items():
            value = sum(parts[0][ids[:, j]] for j in range(PARTS))
            for k in range(1, w):
                for j in range(PARTS):
                    value[: len(ids) - k] += parts[k][ids[k:, j]]
            value[padding] = 0  # windows that start there would read the next text
            top = np.maximum.reduceat(value, at[:-1], axis=0) if len(ids) else np.zeros((n, value.shape[1]), np.float32)
            out.append(np.maximum(top, 0))
            if places:
                spots = np.empty(top.shape, np.int64)
                for i in range(n):
                    spots[i] = at[i] + value[at[i] : at[i + 1]].argmax(axis=0)
                where.append(np.where(top > 0, spots, -1))
        return (np.hstack(out), where) if places else np.hstack(out)

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.pooled(ids, at).astype(np.float64) @ self.weights.astype(np.float64) + float(self.bias))))


def _encoded(texts: list[str]) -> list[np.ndarray]:
    """Word buckets of each text, with its padding."""
    out = []
    for first, end, data, offsets in blocks(pa.array(texts, pa.large_string())):
        ids, at = word_buckets(data, offsets)
        out += [ids[at[i] : at[i + 1]].copy() for i in range(end - first)]
    return out


def fit(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, rate: float = 0.05, batch: int = 64) -> Model:
    """Adagrad on mini-batches; the positive class is weighted to a third of the loss at least."""
    model = Model(seed)
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        model.constant = float(labels.mean()) if len(labels) else 0.0
        return model.prepare()
    share = labels.mean()
    model.begin(share)
    return descend(model, _encoded(texts), labels, _raised(share), np.random.default_rng(seed), epochs, rate, batch)


def _raised(share: float) -> float:
    """The weight of the positive class."""
    return max(1.0, float(0.5 * (1 - share) / share))


def descend(model: Model, docs: list[np.ndarray], labels: np.ndarray, up: float, rng: np.random.Generator, epochs: int = 1, rate: float = 0.05, batch: int = 64) -> Model:
    """Epochs of mini-batches from where ``model`` is; changes it."""
    seen = model.seen
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for first in range(0, len(order), batch):
            picked = order[first : first + batch]
            ids = np.concatenate([docs[i] for i in picked])
            at = np.concatenate(([0], np.cumsum([len(docs[i]) for i in picked])))
            used, ids = np.unique(np.concatenate((np.zeros((1, PARTS), np.int32), ids)), return_inverse=True)
            ids, rows = ids.reshape(-1, PARTS)[1:], model.embed[used]
            model.tables = {w: [rows @ f[k] for k in range(w)] for w, f in model.filters.items()}
            top, where = model.pooled(ids, at, places=True)
            p = 1 / (1 + np.exp(-(top @ model.weights + model.bias)))
            off = (p - labels[picked]) * np.where(labels[picked] > 0, up, 1) / len(picked)
            slope = off[:, None] * model.weights[None, :]
            d_rows, column = np.zeros_like(rows), 0
            for (w, f), spots in zip(model.filters.items(), where, strict=True):
                own = np.where(spots >= 0, slope[:, column : column + f.shape[2]], 0)
                d_f = np.zeros_like(f)
                for k in range(w):
                    word = ids[np.minimum(np.maximum(spots, 0) + k, len(ids) - 1)]
                    step = (own[:, :, None] * f[k].T[None, :, :]).reshape(-1, SIZE)
                    for j in range(PARTS):
                        d_f[k] += np.einsum("ijd,ij->dj", rows[word[:, :, j]], own)
                        np.add.at(d_rows, word[:, :, j].ravel(), step)
                column += f.shape[2]
                seen[w] += d_f * d_f
                f -= rate * d_f / np.sqrt(seen[w])
            d_w = top.T @ off
            seen["weights"] += d_w * d_w
            model.weights -= (rate * d_w / np.sqrt(seen["weights"])).astype(np.float32)
            seen["bias"] += float(off.sum()) ** 2
            model.bias = np.float32(model.bias - rate * off.sum() / np.sqrt(seen["bias"]))
            d_rows[0] = 0
            seen["embed"][used] += d_rows * d_rows
            model.embed[used] -= rate * d_rows / np.sqrt(seen["embed"][used])
    return model.prepare()


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the largest F1; THRESHOLD where a kind is missing."""
    if not len(labels) or labels.min() == labels.max():
        return THRESHOLD
    order = np.argsort(-scores, kind="stable")
    hit = np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + labels.sum())
    last = np.append(scores[order][1:] != scores[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = scores[order][k + 1] if k + 1 < len(order) else 0.0
    return float((scores[order][k] + below) / 2)


def train(
    docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_sample: int = MAX_SAMPLE,
    max_bytes: int = MAX_SAMPLE_BYTES,
) -> tuple[Model, dict]:
    """A model and thresholds by language from all labelled documents where ``keep`` (on the id) holds.

    ``max_sample`` documents and ``max_bytes`` of text at most are fitted on the driver; if there are more, that is the start.
    """
    ids = common.cut(labels.where(keep & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__label_id")).agg(F.max(label_col).alias("__label")))
    held = ids.agg(F.sum(16 + F.coalesce(F.octet_length(F.col("__label_id").cast("string")), F.lit(0)))).first()[0] or 0
    own = F.col(f"`{id_col}`")
    rows = docs.where(keep).select(own.alias("__id"), common.text_or_empty(F.col(f"`{text_col}`")).alias("__text"), F.col(f"`{lang_col}`").alias("__lang"))
    rows = rows.join(F.broadcast(ids) if held <= common.BROADCAST_BYTES else ids, F.col("__id") == F.col("__label_id")).withColumn("__aside", F.pmod(F.xxhash64("__id", F.lit(ASIDE)), F.lit(ASIDE)) == ASIDE - 1)
    rows = common.cut(rows)  # texts are joined once, and only those with labels are kept
    common.drop(ids)
    fitted = ~F.col("__aside")
    n, n_fit, positive, size = rows.agg(
        F.count(F.lit(1)), F.count_if(fitted), F.sum(F.when(fitted, F.col("__label").cast("double"))), F.sum(F.when(fitted, F.octet_length("__text").cast("long")))
    ).first()
    marked = docs.withColumn("__aside", F.pmod(F.xxhash64(own, F.lit(ASIDE)), F.lit(ASIDE)) == ASIDE - 1)
    start = sampling.labelled(marked, labels, label_col, keep, max_sample, max_bytes, id_col, text_col, [lang_col, "__aside"])
    if len(start) < n and n_fit:
        begun = [r for r in start if not r["__aside"]]
        model = fit([r["text"] for r in begun], np.array([r["__label"] for r in begun], np.float64))
        model = _in_rounds(model, rows.where(fitted), n_fit, positive, size)
        limits = _limits(rows.where("__aside"), model)
        common.drop(rows)
        return model, limits
    common.drop(rows)
    texts, y, lang = [r["text"] for r in start], np.array([r["__label"] for r in start], np.float64), [r[lang_col] for r in start]
    aside = np.arange(len(start)) % ASIDE == ASIDE - 1  # rows come in the order of a hash
    model = fit([t for t, out in zip(texts, aside, strict=True) if not out], y[~aside])
    model.seen = None
    held = [t for t, out in zip(texts, aside, strict=True) if out]
    scores, y = np.concatenate([model.score(*_joined([d])) for d in _encoded(held)]) if held else np.zeros(0), y[aside]
    lang = [x for x, out in zip(lang, aside, strict=True) if out]
    limits = {None: best_threshold(scores, y)}
    for name in sorted({x for x in lang if x is not None}):
        own = np.array([x == name for x in lang])
        if own.sum() >= LEAST and y[own].sum() >= LEAST_TOXIC:
            limits[name] = best_threshold(scores[own], y[own])
    return model, limits


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a shard (word buckets, their number in each text, labels) of rows in the order of shards."""

    def packed(shard: int, docs: list[np.ndarray], labels: list[float]) -> pa.RecordBatch:
        parts = (np.concatenate(docs), np.array([len(d) for d in docs], np.int64), np.array(labels, np.float32))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["shard", "ids", "sizes", "labels"])

    own, docs, labels = None, [], []
    for batch in batches:
        shards, given = batch.column("__shard").to_pylist(), batch.column("__label").to_pylist()
        for first, end, data, offsets in blocks(batch.column("__text")):
            ids, at = word_buckets(data, offsets)
            ids = ids.astype(np.uint16)  # BUCKETS is 2 ** 15
            for i in range(first, end):
                if shards[i] != own:
                    if docs:
                        yield packed(own, docs, labels)
                    own, docs, labels = shards[i], [], []
                docs.append(ids[at[i - first] : at[i - first + 1]].copy())
                labels.append(given[i])
    if docs:
        yield packed(own, docs, labels)


def _round(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the shards of a partition change, summed by row of the model."""
        turn, flat, up, like = shared.value
        total, times = np.zeros(flat.shape, np.int64), np.zeros(len(flat), np.int64)
        for batch in batches:
            for shard, ids, sizes, labels in zip(*[batch.column(k) for k in ("shard", "ids", "sizes", "labels")], strict=True):
                at = np.cumsum(np.frombuffer(sizes.as_buffer(), np.int64))[:-1]
                docs = np.split(np.frombuffer(ids.as_buffer(), np.uint16).astype(np.int32).reshape(-1, PARTS), at)
                model = descend(like.filled(flat), docs, np.frombuffer(labels.as_buffer(), np.float32), up, np.random.default_rng([turn, shard.as_py()]))
                change = np.rint((model.flat() - flat) * UNITS).astype(np.int64)
                total += change
                times += change.any(axis=1)
        rows = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(times[rows]), *[pa.array(c) for c in total[rows].T]], ["row", "times", *_CHANGES])

    return tidy(run)


_CHANGES = [f"v{k}" for k in range(2 * SIZE)]


def _in_rounds(model: Model, rows: DataFrame, n: int, positive: float, size: int, rounds: int = ROUNDS) -> Model:
    """The fit carried on over all ``rows``: at each round every shard takes an epoch from the same model, and its changes are averaged."""
    share = positive / n
    if share <= 0 or share >= 1:
        model = Model()
        model.constant = float(share)
        return model.prepare()
    if model.constant is not None:  # the start had labels of one kind
        model = Model().begin(share)
    shards = max(-(-n // SHARD), -(-size // SHARD_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64("__id", F.lit("shard")), F.lit(shards)).cast("long").alias("__shard"), F.col("__label").cast("double").alias("__label"), "__id", "__text")
    dealt = dealt.repartition(min(2000, max(1, shards // 4)), "__shard").sortWithinPartitions("__shard", F.xxhash64("__id"), "__id", F.xxhash64("__text"), "__text", "__label")
    packs = common.cut(dealt.select("__shard", "__label", "__text").mapInArrow(tidy(_packs), "shard long, ids binary, sizes binary, labels binary"))
    flat, like = model.flat(), Model()
    for turn in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((turn, flat, _raised(share), like))
        changes = packs.mapInArrow(_round(shared), "row long, times long, " + ", ".join(f"{c} long" for c in _CHANGES))
        got = changes.groupBy("row").agg(F.sum("times").alias("times"), *[F.sum(c).alias(c) for c in _CHANGES]).toArrow()
        flat = flat.copy()
        flat[got.column("row").to_numpy()] += np.stack([got.column(c).to_numpy() for c in _CHANGES], axis=1) / (got.column("times").to_numpy()[:, None] * UNITS)
        flat = flat.astype(np.float32).astype(np.float64)  # what models hold, so that only steps are changes
        shared.unpersist()
    common.drop(packs)
    model = like.filled(flat)
    model.seen = None
    return model


def _limits(rows: DataFrame, model: Model) -> dict:
    """Thresholds of all ``rows`` and of each language with enough of them, from counts by level of score."""
    scored = classify(rows.select("__text", "__lang", "__label"), model, {None: THRESHOLD}, "__text", "__lang")
    counts = scored.groupBy("__lang", F.floor(F.col("score") * LEVELS).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__label").cast("double")).alias("hits"))
    counts = common.cut(counts)
    every = counts.groupBy("level").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow().to_pylist()
    enough = counts.groupBy("__lang").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where((F.col("n") >= LEAST) & (F.col("hits") >= LEAST_TOXIC)).select("__lang")
    own: dict[str, list] = {}
    for r in counts.join(enough, "__lang").toArrow().to_pylist():
        own.setdefault(r["__lang"], []).append(r)
    common.drop(counts)
    return {None: best_level(every)} | {name: best_level(own[name]) for name in sorted(own)}


def best_level(counts: list[dict]) -> float:
    """As best_threshold, of numbers of rows and of positive labels by level of score."""
    level, n, hits = (np.array([r[k] for r in sorted(counts, key=lambda r: -r["level"])], np.float64) for k in ("level", "n", "hits"))
    if not len(level) or not 0 < hits.sum() < n.sum():
        return THRESHOLD
    k = int(np.argmax(2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())))
    below = level[k + 1] + 1 if k + 1 < len(level) else 0
    return float((level[k] + below) / 2 / LEVELS)


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(*word_buckets(data, offsets)) for _, _, data, offsets in blocks(batch.column("__text"), BLOCK // 2)]
            yield pa.RecordBatch.from_arrays([batch.column("__rest"), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["__rest", "score"])

    return tidy(run)


def classify(docs: DataFrame, model: Model, limits: dict, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the text, with score and toxic (by the language's threshold)."""
    whole = common.packed(docs, text_col, nulls=True)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = whole.mapInArrow(_scores(shared), common.with_fields(whole, ["__rest"], "score double"))
    limit = F.lit(limits[None])
    for name, value in limits.items():
        if name is not None and lang_col in docs.columns:
            limit = F.when(F.col("__rest").getField(lang_col) == name, F.lit(value)).otherwise(limit)
    return scored.select(*common.unpacked(docs, text_col, {"score": F.col("score"), "toxic": F.col("score") >= limit}))
