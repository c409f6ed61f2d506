"""The label model and the classifier against held-out labels."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest

from keysift.llm import quality
from keysift.llm.shared import settled

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_accuracy_on_labels(spark):
    """Labels are not read by the classifier, so all of them are held out."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    judged = settled(quality.classify_quality(docs).select("doc_id", "accepted"), "judged")
    rows = judged.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("quality", "accepted").collect()
    good, junk = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert judged.count() == docs.count()
    assert np.mean([r["accepted"] for r in good]) > 0.98
    assert np.mean([not r["accepted"] for r in junk]) > 0.9


def test_accuracies_are_found():
    """Labellers that each know one kind of junk well and another a little; no truth given."""
    draw = np.random.default_rng(4)
    kind = np.where(draw.random(20_000) < 0.8, -1, draw.integers(0, 4, 20_000))
    fires = np.stack([np.where(kind == j, 0.95, np.where((kind + 1) % 4 == j, 0.3, 0.01)) for j in range(4)], axis=1)
    fires[kind < 0] = [0.002, 0.005, 0.02, 0.08]
    table = np.where(draw.random(fires.shape) < fires, quality._JUNK, quality._GOOD)
    table[draw.random(table.shape) < 0.1] = quality._SILENT
    patterns, counts = np.unique(quality._packed(table), return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float), 4)
    right = (model.posterior(quality._packed(table)) >= 0.5) == (kind < 0)
    majority = ((table == quality._GOOD).sum(axis=1) > (table == quality._JUNK).sum(axis=1)) == (kind < 0)
    anyone = ~(table == quality._JUNK).any(axis=1) == (kind < 0)
    assert right.mean() > majority.mean() + 0.03 and right.mean() >= anyone.mean() > 0.9


def test_measures():
    texts = pa.array(["Plain words, in a row. And more of them here", "BUY NOW!! BUY NOW!! GO!! YES!! OK!! SO!!",
                      "so so so so so so so so so so", "a%%% b*** c### d&&& e$$$ f%%% g### h***", "", None])
    votes = quality.votes(quality.features(texts))
    names = list(quality.LABELLERS)
    assert votes[0].tolist().count(quality._JUNK) == 0
    assert votes[1][names.index("capitals")] == votes[1][names.index("shouts")] == quality._JUNK
    assert votes[2][names.index("repeats")] == quality._JUNK
    assert votes[3][names.index("marked_words")] == votes[3][names.index("odd_words")] == quality._JUNK
    assert (votes[4:] == quality._SILENT).all()


def test_edges(spark):
    rows = [(None, None, 1, 2), (1, "", 3, 4), (1, "", 3, 4), (2, "a b c", None, None), (3, "word " * 40_000, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, `a.b` int")
    found = quality.classify_quality(docs)
    assert found.columns == ["doc_id", "text", "a.b", "posterior", "score", "accepted"]
    scores = [(r["text"], r["accepted"]) for r in found.collect()]
    assert len(scores) == 5 and scores.count(("", False)) == 2 and (None, False) in scores and ("a b c", True) in scores
    assert quality.classify_quality(docs.limit(0)).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('some plain words of text number ', id, ' and a few more') AS text")
    assert quality.classify_quality(docs, most_training_rows=20).filter("accepted").count() == 300


def plain_em(texts, labellers, rounds=500):
    """Expectation-maximisation text by text, without counts of patterns and without arrays."""
    kinds = range(labellers + 1)
    belief = []
    for votes in texts:
        junk = [v == quality._JUNK for v in votes]
        good = 0.1 if any(junk) else 0.9
        others = [1.0 if j else 1e-3 for j in junk]
        belief.append([good, *((1 - good) * o / sum(others) for o in others)])
    for _ in range(rounds):
        shares = [sum(b[k] for b in belief) + (2 * labellers if k == 0 else 1) for k in kinds]
        voting = [[[1.0, 1.0] for _ in kinds] for _ in range(labellers)]
        for j in range(labellers):
            voting[j][0][quality._JUNK] += 0.1 * len(texts) * 0.01
            voting[j][0][quality._GOOD] += 0.1 * len(texts) * 0.99
            voting[j][j + 1][quality._JUNK] += 1 + 0.001 * len(texts)
            for votes, b in zip(texts, belief):
                for k in kinds:
                    if votes[j] != quality._SILENT:
                        voting[j][k][votes[j]] += b[k]
        last, belief = belief, []
        for votes in texts:
            odds = [shares[k] / sum(shares) for k in kinds]
            for j, vote in enumerate(votes):
                if vote != quality._SILENT:
                    odds = [o * voting[j][k][vote] / sum(voting[j][k]) for k, o in enumerate(odds)]
            belief.append([o / sum(odds) for o in odds])
        if max(abs(x - y) for a, b in zip(last, belief) for x, y in zip(a, b)) < 1e-9:
            break
    return [b[0] for b in belief]


def test_label_model_equals_plain_em():
    draw = np.random.default_rng(8)
    table = draw.choice([quality._JUNK, quality._GOOD, quality._SILENT], (120, 3), p=[0.15, 0.65, 0.2])
    packed = quality._packed(table)
    patterns, counts = np.unique(packed, return_counts=True)
    found = quality.fit_labels(patterns, counts.astype(float), 3).posterior(packed)
    assert np.abs(found - plain_em(table.tolist(), 3)).max() < 1e-6


def test_scores_equal_a_plain_sum():
    """The score of a text is the logistic of the mean weight of its words and shapes, and of its repeats."""
    draw = np.random.default_rng(5)
    weights = draw.normal(size=quality.BUCKETS + 2)
    texts = ["plain words and plain words words", "ONE two 3,000 #tag", "", None, "word " * 500]
    model = quality.fit_labels(np.array([0]), np.array([1.0]), len(quality.LABELLERS))
    batch = pa.RecordBatch.from_pydict({"row": pa.array(range(len(texts))), "text": pa.array(texts)})
    scores = pa.Table.from_batches(quality._score([batch], model, weights, ("row",)))["score"].to_pylist()
    for text, score in zip(texts, scores):
        found = quality.features(pa.array([text], pa.string()))
        words = (text or "").split()
        total = sum(weights[b] for code in found.codes for b in found.buckets[code]) / max(len(words), 1)
        repeats = sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1)
        plain = 1 / (1 + np.exp(-(total + repeats * weights[quality.BUCKETS] + weights[-1]))) if words else 0.0
        assert len(found.codes) == len(words) and abs(score - plain) < 1e-9
