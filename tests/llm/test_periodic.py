"""Periodic runs against a search of every start and period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from keysift.llm import periodic
from keysift.llm.periodic import find_runs, periodic_runs
from keysift.llm.queries import op13_periodic_runs

SCHEMA = "doc_id long, text string, `row` int, runs string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(words, least=24, rounds=3):
    """Every maximal stretch of each period, smallest periods first; a multiple of a period found is none."""
    n, found = len(words), {}
    for q in range(1, n // rounds + 1):
        start = 0
        while start + q < n:
            if words[start] != words[start + q]:
                start += 1
                continue
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(least, rounds * q):
                # The smallest period of a stretch of two periods divides any other.
                if not any(q % p == 0 and s <= start and end <= s + length for s, length, p in found.values()):
                    found[start, q] = (start, end - start, q)
            start = end - q + 1
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def prepared(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def brute_row(doc_id, text):
    words = prepared(doc_id, words_of(text))
    runs = brute_runs(words)
    best = None
    for s, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    digest = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(digest.encode()).hexdigest(), hashlib.sha256(collapse(words, runs).encode()).hexdigest())


def noisy(rng, letters, size):
    """Words with periodic stretches of all kinds, some with a stray word."""
    words = []
    while len(words) < size:
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 9))] * rng.randint(1, 3)
        words += (unit * rng.randint(1, 12))[: rng.randint(1, 60)]
        words += [rng.choice(letters) for _ in range(rng.choice([0, 0, 1, 5]))]
    return words[:size]


@pytest.mark.parametrize("least,rounds", [(24, 3), (6, 3), (1, 2), (10, 4)])
def test_runs_equal_brute_force(least, rounds):
    rng = random.Random(least * 10 + rounds)
    docs = [noisy(rng, "ab"[: rng.randint(1, 2)] if rng.random() < 0.3 else "abcdef", rng.choice([0, 1, 5, 40, 200])) for _ in range(120)]
    codes = np.array([ord(w) for d in docs for w in d], np.int64)
    found = find_runs(codes, np.array([len(d) for d in docs]), least, rounds)
    for i, words in enumerate(docs):
        assert [tuple(r) for r in found[found[:, 0] == i, 1:].tolist()] == brute_runs(words, least, rounds), words


def test_long_sets_of_positions():
    """One word 30,000 times, and two words in turn: sets of positions of many blocks."""
    found = find_runs(np.array([7] * 30_000 + [1, 2] * 15_000), np.array([30_000, 30_000]))
    assert found.tolist() == [[0, 0, 30_000, 1], [1, 0, 30_000, 2]]


@pytest.mark.parametrize("part_bytes", [1, 200, 1 << 20])
def test_operator_on_odd_rows(spark, part_bytes):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "x " * 30, "\x0bA\x0c" * 40, "  " * 25 + "a b"] + [" ".join(noisy(rng, "abc", 90)) for _ in range(20)]
    rows = [(i % 5 or None, t, i, "own") for i, t in enumerate(texts)] * 2
    made = periodic_runs(spark.createDataFrame(rows, SCHEMA), part_bytes=part_bytes)
    assert made.columns == ["doc_id", "text", "row", "n_words", "runs", "collapsed"]
    for r in made.collect():
        words = words_of(texts[r["row"]])
        runs = brute_runs(words)
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == collapse(words, runs)
        assert r["text"] == texts[r["row"]]
    assert made.count() == len(rows)
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    letters = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(noisy(rng, letters, rng.choice([0, 3, 50, 150]))) if i % 17 else None) for i in range(250)]
    rows += [(9, "again"), (None, "no id " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = sorted(((r["doc_id"] or -1, tuple(r[c] for c in columns)) for r in op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    expected = sorted(((i or -1, brute_row(i, t)) for i, t in rows if i is not None), key=str)
    assert [r for r in found if r[0] != -1 or r[1][0] != 1] == [r for r in expected if r[0] != -1 or r[1][0] != 1]
    assert sum(r[1][0] > 0 for r in expected) > 20
    assert periodic.LEAST_LENGTH == 24
