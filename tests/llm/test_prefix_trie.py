"""The prefix trie of conversations against plain Python dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from keysift.llm.prefix_trie import Parentheses
from keysift.llm.queries import op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, code string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1] or 0))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(rows):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, convs in members.items()
    )


def made(rng, convs, longest, texts):
    rows = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            rows.append((c, t if rng.random() < 0.98 else None, rng.choice(["user", "assistant", None]), rng.choice(texts), 1, "own"))
    seen, kept = set(), []
    for row in rows:  # one null turn for each conversation, so that the order is certain
        if row[1] is not None or row[0] not in seen:
            kept.append(row)
            seen.add(row[0] if row[1] is None else None)
    rng.shuffle(kept)
    return kept


def check(spark, path, rows, **options):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/conversations.parquet")
    found = op11_prefix_trie(spark, str(path), **options)
    assert tuple(found.columns) == COLUMNS
    assert sorted(map(tuple, found.collect())) == brute(rows)


@pytest.mark.parametrize("segment_turns,shard_turns", [(256, 500_000), (256, 6), (3, 500_000), (2, 5), (1, 1)])
def test_query_equals_brute_force(spark, tmp_path, segment_turns, shard_turns):
    rng = random.Random(segment_turns + shard_turns)
    rows = made(rng, [*range(60), 101, 203, 1001], 14, ["a", "b", "", None, "é"])
    rows += [(c, t, "user", f"copy {t}", 1, "") for c in range(300, 340) for t in range(9)]  # a group of copies
    check(spark, tmp_path, rows, segment_turns=segment_turns, shard_turns=shard_turns)


def test_one_long_conversation(spark, tmp_path):
    """More than half of the rows are of two conversations with one start, in segments of 8 and shards of 40 turns."""
    rows = [(5, t, "user", f"t{t}", 1, "") for t in range(300)] + [(6, t, "user", f"t{t}" if t < 200 else "x", 1, "") for t in range(260)]
    rows += made(random.Random(1), range(20, 50), 6, ["a", "b"])
    check(spark, tmp_path, rows, segment_turns=8, shard_turns=40)


def test_repeated_rows_and_null_conversations(spark, tmp_path):
    rows = [(7, 1, "user", "same", 1, "")] * 30 + [(None, 1, "user", "x", 1, ""), (9, None, None, None, None, None)]
    check(spark, tmp_path, rows, segment_turns=4, shard_turns=10)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_prefix_trie(spark, str(tmp_path)).collect() == []


def test_parentheses():
    rng = random.Random(3)
    for size in (1, 2, 63, 64, 65, 900):
        depths = [0]
        while len(depths) < size:
            depths.append(rng.randint(0, depths[-1] + 1))
        tree = Parentheses(np.array(depths))
        close = tree.find_close(tree.opens)
        stack, matched = [], {}
        for at, bit in enumerate(tree.bits.tolist()):
            if bit:
                stack.append(at)
            else:
                matched[stack.pop()] = at
        assert not stack and close.tolist() == [matched[o] for o in tree.opens.tolist()]
        for i, leaves in enumerate(tree.leaf_pairs(tree.opens, close).tolist()):
            below = [j for j in range(i, size) if j == i or min(depths[i + 1 : j + 1]) > depths[i]]
            assert leaves == sum(j + 1 == size or depths[j + 1] <= depths[j] for j in below)
