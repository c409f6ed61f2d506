"""The corpus pipeline: each stage on its own input, and on odd rows."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline as pipeline
from keysift.llm.shared import settled, table
from tests.llm.test_near import brute as near_groups
from tests.llm.test_pii_benchmark import brute as leaks

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_one_by_one(spark):
    docs, seen = table(spark, DATA, "documents"), {}
    for name, stage in pipeline.STAGES:
        seen[name] = docs = settled(stage(spark, docs, DATA), name)
    columns = table(spark, DATA, "documents").columns
    assert all(seen[name].columns == columns for name, _ in pipeline.STAGES[:-1])
    texts = {n: {r["doc_id"]: r["text"] for r in seen[n].select("doc_id", "text").collect()} for n in list(seen)[:-1]}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, DATA, "labels").collect()}
    whole = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in texts["quality"] for i in good) > 0.95 * len(good)
    assert all(texts["quality"][i] == whole[i] for i in texts["quality"])
    assert set(texts["lines"]) <= set(texts["quality"])
    groups = near_groups(list(texts["lines"].items()), 80)
    assert set(texts["near"]) == {g for _, g in groups.values()}
    items = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    cut = leaks(list(texts["near"].items()), items, 10)
    assert texts["benchmark"] == {i: row[4] for i, row in cut.items() if row[1] == 0 or row[1] < row[0]}
    packed = seen["packing"].collect()
    assert {r["doc_id"] for r in packed} == set(texts["benchmark"])
    assert pipeline.run(spark, DATA).count() == len(packed)


def test_odd_rows(spark):
    plain = "these are some words of plain prose that nobody would call junk at all"
    rows = [(None, None, "en", "a", None, 1), (1, "", "en", None, 0, 1), (2, plain, None, "b", 5, 1), (2, plain, None, "b", 5, 1),
            (3, plain.title() + " ́", "en", "c", 5, None), (4, "word " * 30_000, "en", "d", 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row.text` int")
    for odd in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            made = stage(spark, odd, DATA)
            if name == "packing":  # the long text is many pieces
                assert {r["doc_id"] for r in made.collect()} == {r["doc_id"] for r in odd.collect()}
            else:
                assert made.count() <= len(rows) and made.columns == docs.columns
