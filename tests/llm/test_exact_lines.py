"""Exact and line deduplication against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keysift.llm.exact import exact_dedup
from keysift.llm.lines import line_dedup

SCHEMA = "doc_id long, text string, source string, `text.row` int, hash int"


def rows_of(texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return [(i, t, s, i, None) for i, (t, s) in enumerate(zip(texts, sources))]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hashed", ["md5", "length"])
def test_exact_groups(spark, keep, hashed):
    """A hash that collides for all texts of one length gives the same groups."""
    texts = ["a", "b", "a", None, "", "bb", "ba", "bb", "x" * 70_000, "x" * 70_000]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    content_hash = F.md5 if hashed == "md5" else lambda text: F.length(text).cast("string")
    found = {r["doc_id"]: r for r in exact_dedup(docs, keep=keep, content_hash=content_hash).collect()}
    groups = defaultdict(list)
    for i, text in enumerate(texts):
        groups[text or ""].append(i)
    pick = min if keep == "smallest" else max
    for group in groups.values():
        for i in group:
            row = found[i]
            assert (row["keep_id"], row["group_size"], row["kept"]) == (pick(group), len(group), i == pick(group))


def test_exact_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "t"), (7, "t"), (7, "t"), (None, None)], "doc_id long, text string")
    for keep in ("smallest", "largest"):
        found = exact_dedup(docs, keep=keep).collect()
        kept = [r for r in found if r["kept"]]
        assert len(found) == 4 and sorted((r["doc_id"] is None, r["group_size"]) for r in kept) == [(False, 3), (True, 1)]
    assert exact_dedup(docs.limit(0)).count() == 0


def brute_lines(rows, sites, keep_first):
    spread, first = defaultdict(set), {}
    for key, text, site in sorted(rows, key=lambda r: r[0]):
        for at, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r")
            if line:
                if site is not None:
                    spread[line].add(site)
                first.setdefault(line, (key, at))
    out = {}
    for key, text, _ in rows:
        kept = []
        for at, line in enumerate((text or "").split("\n")):
            bare = line.strip(" \t\r")
            if not (bare and len(spread[bare]) >= sites and not (keep_first and first[bare] == (key, at))):
                kept.append(line)
        out[key] = None if text is None else "\n".join(kept)
    return out


@pytest.mark.parametrize("sites,keep_first", [(2, True), (5, True), (5, False), (40, True)])
def test_lines(spark, sites, keep_first):
    draw = random.Random(sites)
    pool = [f"line {i}" for i in range(30)] + ["", "  ", "\ttabbed ", "line 1 "]
    rows = [
        (i, "\n".join(draw.choice(pool) for _ in range(draw.randint(0, 9))) if i % 11 else None,
         None if i % 13 == 0 else f"site {draw.randint(0, 60)}")
        for i in range(400)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = line_dedup(docs, min_sites=sites, keep_first=keep_first).collect()
    assert {r["doc_id"]: r["text"] for r in found} == brute_lines(rows, sites, keep_first)


def test_lines_edges(spark):
    rows = [(None, "a\nb", "s", 1), (1, "a", "t", 2), (1, "a", "t", 2), (1, "c\na", "u", 3), (2, "", "v", 4), (3, None, "w", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `n_cut.x` int")
    found = line_dedup(docs, min_sites=3).collect()
    # The first occurrence is that of id 1 with the smaller hash of its text, in both repeated rows or in neither.
    assert sorted((r["doc_id"] is None, r["n_cut"], r["text"]) for r in found if r["doc_id"] != 2 and r["text"] is not None) in (
        [(False, 0, "a"), (False, 0, "a"), (False, 1, "c"), (True, 1, "b")],
        [(False, 0, "c\na"), (False, 1, ""), (False, 1, ""), (True, 1, "b")],
    )
    assert found[0].asDict().keys() == {"doc_id", "text", "source", "n_cut.x", "n_lines", "n_cut"}
    assert line_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size,sites", [(60_000, 2), (1_000_000, 2)])
def test_very_long_text(spark, size, sites):
    """A text of 11 MB; the time is linear in its lines."""
    text = "\n".join(f"line {i % 5000}" for i in range(size))
    docs = spark.createDataFrame([(1, text, "a"), (2, "line 3\nown", "b")], "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in line_dedup(docs, min_sites=sites).collect()}
    assert found[2]["text"] == "own" and found[1]["n_cut"] == size // 5000 - 1 and found[1]["n_lines"] == size
    assert found[1]["text"].count("line 3\n") == 1


def test_most_lines_of_a_long_text_are_cut(spark):
    lines = [f"line {i % 7}" if i % 3 else f"own {i}" for i in range(100_000)]
    rows = [(1, "\n".join(f"line {i}" for i in range(7)), "a"), (2, "\n".join(lines), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["text"] for r in line_dedup(docs, min_sites=2).collect()}
    assert found == {1: rows[0][1], 2: "\n".join(x for x in lines if x.startswith("own"))}
