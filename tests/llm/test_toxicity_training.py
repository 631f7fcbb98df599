"""The toxicity model is made from all labelled documents, however many the driver starts with."""

import random

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import toxicity


def test_documents_beyond_the_start_are_learned(spark):
    rng, n = random.Random(5), 3000
    order = [r["id"] for r in spark.range(n).orderBy(F.xxhash64("id")).collect()]
    rows = []
    for place, k in enumerate(order):
        own, toxic = [rng.choice(["kind", "good", "calm", "mild"]) for _ in range(9)], place % 3 == 0
        if toxic:
            own[rng.randrange(9)] = "vile" if place < 150 else "grim"
        rows.append((k, " ".join(own), "en" if k % 2 else None, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model, limits = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), F.lit(True), max_sample=150)
    got = {r["doc_id"]: r for r in toxicity.classify(docs.drop("toxic"), model, limits).collect()}
    assert np.mean([(got[k]["score"] >= 0.7) == bool(y) for k, _, _, y in rows]) > 0.98
    assert np.mean([got[k]["toxic"] == bool(y) for k, _, _, y in rows]) > 0.98 and set(limits) == {None, "en"}
    other, again = toxicity.train(docs.drop("toxic").repartition(7), docs.select("doc_id", "toxic").repartition(3), F.lit(True), max_sample=150)
    assert np.array_equal(model.embed, other.embed) and np.array_equal(model.weights, other.weights) and limits == again


def test_a_start_of_one_kind_and_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(k, "vile words" if k % 2 else "kind words", "en", k % 2) for k in range(1500)], "doc_id long, text string, lang string, toxic int")
    model, _ = toxicity.train(docs, docs.select("doc_id", "toxic"), F.lit(True), max_sample=1)
    vile, kind = (model.score(*toxicity._joined(toxicity._encoded([t])))[0] for t in ("vile words", "kind words"))
    assert vile > 0.7 > kind
    model, limits = toxicity.train(docs, docs.select("doc_id", F.lit(1).alias("toxic")), F.lit(True), max_sample=1)
    assert model.constant == 1.0 and set(limits.values()) == {toxicity.THRESHOLD}


def test_flat_models_and_thresholds_by_level():
    model = toxicity.fit(["bad vile words here", "good kind words there"] * 20, np.array([1, 0] * 20), epochs=2)
    back = model.filled(model.flat())
    assert all(np.array_equal(model.filters[w], back.filters[w]) and np.array_equal(model.seen[w], back.seen[w]) for w in model.filters)
    assert np.array_equal(model.embed, back.embed) and np.array_equal(model.weights, back.weights) and model.bias == back.bias
    rng = np.random.default_rng(2)
    level, y = rng.integers(0, 50, 400), rng.integers(0, 2, 400)
    counts = [{"level": int(v), "n": int((level == v).sum()), "hits": int(y[level == v].sum())} for v in set(level)]
    scores = (level + 0.5) / toxicity.LEVELS
    assert np.array_equal(scores >= toxicity.best_level(counts), scores >= toxicity.best_threshold(scores, y))
