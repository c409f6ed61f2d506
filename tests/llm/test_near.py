"""Near-duplicate detection against all pairs in plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from keysift.llm import near

SCHEMA = "doc_id long, text string, `name` string, row int"


def shingles(text, width=5):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent):
    sets = [shingles(text) for _, text in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    ids = {}
    for (key, _), x in zip(rows, label):
        ids[x] = min(ids.get(x, key), key)
    return {key: (len(s), ids[x]) for (key, _), s, x in zip(rows, sets, label)}


def corpus(draw, groups, copies):
    rows = []
    for _ in range(groups):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([3, 5, 20, 80, 200]))]
        for _ in range(draw.randint(1, copies)):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                words[draw.randrange(len(words))] = f"e{draw.randint(0, 99)}"
            rows.append(" ".join(words).title() if draw.random() < 0.2 else "\n".join(words))
    draw.shuffle(rows)
    return [(i, t) for i, t in enumerate([*rows, "", None, " \n", "One", "one", "\u3000 x"])]


@pytest.mark.parametrize("blocks", [1000, 7])
@pytest.mark.parametrize("percent", [80, 85])
def test_components(spark, monkeypatch, blocks, percent):
    monkeypatch.setattr(near, "BLOCK_ROWS", blocks)
    rows = corpus(random.Random(percent), 25, 12)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    found = near.near_duplicates(docs, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, percent)
    assert {r["doc_id"] for r in found if r["first"]} == {r["component_id"] for r in found}


def test_edges(spark):
    rows = [(None, "a b c d e f", "x", 1), (4, "A b c d e f", "x", 1), (4, "A b c d e f", "x", 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = near.near_duplicates(docs).collect()
    assert sorted((r["component_id"] is None, r["n_shingles"]) for r in found) == [(False, 2)] * 3 + [(True, 0)]
    assert sum(r["first"] for r in found) == 2
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_long_text(spark):
    words = [f"w{i}" for i in range(50_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-2000]))], "doc_id long, text string")
    assert {r["component_id"] for r in near.near_duplicates(docs).collect()} == {1}


def test_sketches_estimate_similarity():
    """Every coordinate is filled, and equal coordinates are as common as the sets are similar."""
    draw = np.random.default_rng(1)
    for size, common in ((3, 2), (40, 30), (500, 450), (5000, 4000)):
        errors = []
        for _ in range(30):
            both = np.unique(draw.integers(1, 2**64, 2 * size - common, np.uint64))
            a, b = both[:size], both[-size:]
            sketch = near.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
            assert (sketch != near._EMPTY).all()
            errors.append((sketch[0] == sketch[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


def test_shingle_sets():
    texts = ["a b c d e f", "a b", "", None, "A  B\tC d e", "x " * 30]
    found, sizes = near.shingle_sets(pa.array(texts), 5)
    assert sizes.tolist() == [2, 1, 0, 0, 1, 1] and found[3] == found[0] or found[3] == found[1]
    assert len(set(found.tolist())) == 4


def test_words_made_to_share_a_polynomial_hash(spark):
    """Letters in Thue-Morse order and their complement are equal for every polynomial of an odd base modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    assert len(set(near.told_apart(pa.array([one, two])).tolist())) == 2
    docs = spark.createDataFrame([(1, f"{one} one two three four"), (2, f"{two} one two three four")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2}


@pytest.mark.parametrize("kinds", [1, 30])
def test_large_groups_are_dealt_a_few_times(spark, monkeypatch, kinds):
    """Near copies of one text, or of texts that share bands only: as brute force, without a row for each two blocks."""
    draw, rows = random.Random(kinds), []
    for i in range(240):
        words = [f"w{n}" for n in range(70)] + [f"k{i % kinds}_{n}" for n in range(0 if kinds == 1 else 12)]
        words[draw.randrange(30, len(words))] = f"e{i}"
        rows.append((i, " ".join(words)))
    dealt, large = [0], [0]

    def counted(deal):
        def run(*given):
            made = deal(*given)
            dealt[0] += made.count()
            return made
        return run

    def watched(rows_of, sizes, *rest):
        large[0] += sizes.filter(f"size > {near.BLOCK_ROWS}").agg({"size": "sum"}).first()[0] or 0
        return links(rows_of, sizes, *rest)

    links = near._links
    monkeypatch.setattr(near, "BLOCK_ROWS", 24)
    monkeypatch.setattr(near, "_links", watched)
    for deal in ("_near_hubs", "_rest_with_all"):
        monkeypatch.setattr(near, deal, counted(getattr(near, deal)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near.near_duplicates(docs, percent=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 80)
    assert large[0] > 0
    if kinds == 1:
        assert dealt[0] < 3 * large[0]
