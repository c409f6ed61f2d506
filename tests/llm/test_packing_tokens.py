"""Packing, token ids and edit-aware counts against the plain tokenizer."""

from __future__ import annotations

import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keysift.llm import packing, words
from keysift.llm.packing import Capacity, pack, plan, sequences
from keysift.llm.queries import revision, tokenizer_path
from keysift.llm.token_trees import TokenTree, apply_edits, cut_leaves, encoding, gather_edits, token_trees

TEXTS = [
    "Plain words, it's 42 o'clock!! Don't you're we'll", "Ünï çödé… naïve ﬁ ΣΑΣ İstanbul K Å é, á.", "", None,
    "# % && ''s 's ''' a's,b's 　wide space \x1c\x85 x​y", "日本語 テスト emoji 👍🏽👍", "word " * 700, "<|endoftext|> <|x",
    "tab\tnew\nline\r\n\x0b\x0c", "a" * 3000, "…! …? »« x…y", "1,2.3-4 ½ ² Ⅷ",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_texts_are_encoded_in_small_parts(monkeypatch):
    """No more than ``PART_BYTES`` of texts at once, and the same pieces as of one part."""
    texts = [f"word {n} " * 2000 for n in range(400)]
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(400)), "text": texts})
    path, seen = tokenizer_path("word_bpe_49k.json"), []

    class Told(words.WordEncoder):
        def encode(self, part):
            seen.append(sum(map(len, part.to_pylist())))
            return super().encode(part)

    encoder = Told(path)
    monkeypatch.setattr(packing, "word_encoder", lambda _: encoder)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    made = [pa.Table.from_batches(packing._pieces([batch], path, 2048, 0, pa.int64(), False))]
    assert sum(seen) > 5 << 20 and max(seen) <= 2 << 20
    monkeypatch.setattr(packing, "PART_BYTES", 1 << 30)
    made.append(pa.Table.from_batches(packing._pieces([batch], path, 2048, 0, pa.int64(), False)))
    assert made[0].to_pylist() == made[1].to_pylist()


def test_ids_are_the_tokenizers(tokenizer, monkeypatch):
    draw = random.Random(3)
    pool = [c for t in TEXTS if t for c in t.split()] + ["́", "̸<", "’s", "'", "ß", "Ǆ"]
    texts = TEXTS + ["".join(draw.choice(pool) + draw.choice(["", " ", "\n", "'"]) for _ in range(30)) for _ in range(150)]
    for most in (400_000, 5):
        monkeypatch.setattr(words, "MOST_WORDS", most)
        encoder = words.WordEncoder(tokenizer_path("word_bpe_49k.json"))
        for _ in range(2):
            ids, sizes = encoder.encode(pa.array(texts, pa.string()))
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for text, part in zip(texts, parts):
                assert part.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [Capacity(100), Capacity(100, documents=4), Capacity(100, cost=2500, weights=(1, 0.5, 0.5)), Capacity(7, 2, 30)])
def test_plan(rule, capacity):
    draw = random.Random(7)
    counts = {n: draw.choice([1, 3, 50, 4000]) for n in draw.sample(range(1, capacity.longest() + 1), min(40, capacity.longest()))}
    places, used = plan(counts, capacity, rule)
    tokens, documents, cost = (np.zeros(used, np.int64) for _ in range(3))
    placed = dict.fromkeys(counts, 0)
    for length, rank, at, bins, offset in sorted(places.tolist(), key=lambda p: p[4]):
        assert (tokens[at : at + bins] == offset).all()
        tokens[at : at + bins] += length
        documents[at : at + bins] += 1
        cost[at : at + bins] += length**2
        placed[length] += bins
    limits = capacity.limits()
    assert placed == counts
    assert tokens.max() <= limits[0] and documents.max() <= limits[1] and cost.max() <= limits[2] and tokens.min() > 0
    for length in counts:
        ranks = sorted((p[1], p[3]) for p in places.tolist() if p[0] == length)
        assert all(a + n == b for (a, n), (b, _) in zip(ranks, [*ranks[1:], (counts[length], 0)]))
    least = max(
        -(-sum(n * c for n, c in counts.items()) // limits[0]), -(-sum(counts.values()) // limits[1]),
        -(-sum(n * n * c for n, c in counts.items()) // limits[2]),
    )
    assert used <= 1.25 * least + 2
    assert plan({}, capacity, rule)[1] == 0


def test_pack(spark, tokenizer):
    draw = random.Random(1)
    texts = [None if i % 29 == 0 else " ".join(f"w{draw.randint(0, 999)}" for _ in range(draw.choice([0, 3, 40, 300]))) for i in range(200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    packed = pack(docs.repartition(5), tokenizer_path("word_bpe_49k.json"), Capacity(128), with_ids=True)
    rows = packed.collect()
    pieces, whole = {}, {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    for r in rows:
        ids = np.array(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert sorted(pieces[i]) == [(n, s, ids[s : s + 128]) for n, s in enumerate(range(0, len(ids), 128))]
    total = sum(r["length"] for r in rows)
    assert sum(map(len, whole.values())) == total and len(whole) <= -(-total // 128) + 2


def test_pack_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    found = pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    assert len(found) == 3 and {r["sequence_id"] for r in found} == {0}
    assert sorted(r["offset"] for r in found) == [0, 2, 4]
    assert pack(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


@pytest.fixture(scope="module")
def counted():
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return path, lambda text: len(encoding(*path).encode_ordinary(text))


def test_trees_follow_edits(counted):
    _, count = counted
    draw = random.Random(11)
    base = [" ".join(draw.choice(["word", "it's", "x,", "é", "日本", "12 3", "a  b", "\n", "…"]) for _ in range(n)) for n in (0, 3, 200, 3000)]
    for text in base * 12:
        leaves = cut_leaves(text)
        tree = TokenTree(leaves, [count(leaf) for leaf in leaves], count)
        for _ in range(8):
            start, removed = draw.randrange(len(text) + 3), draw.choice([0, 1, 2, 50, 5000])
            inserted = draw.choice(["", " ", "  ", "x", "'s", "\n", " word", "　", base[2], base[3][:900]])
            at = min(start, len(text))
            text = text[:at] + inserted + text[at + removed :]
            tree.edit(start, removed, inserted)
            assert (tree.tokens, tree.chars) == (count(text), len(text)) and tree.text() == text
            assert sum(tree.counts()) == tree.tokens


def test_only_touched_regions_are_encoded(counted):
    _, count = counted
    text = "some words " * 20_000
    leaves = cut_leaves(text)
    tree = TokenTree(leaves, [count(leaf) for leaf in leaves], count)
    tree.edit(100_000, 4, "other")
    assert tree.encoded < 3000 and tree.tokens == count(tree.text())


def test_edits_of_a_table(spark, counted):
    path, count = counted
    texts = [None, "", "one two three", "first\nsecond line of some words", "long words " * 500]
    docs = spark.createDataFrame([(i, t, "src", 9) for i, t in enumerate(texts)], "doc_id long, text string, source string, leaves int")
    trees = token_trees(docs, *path)
    assert {r["doc_id"]: r["n_tokens"] for r in trees.collect()} == {i: count(t or "") for i, t in enumerate(texts)}
    edits = spark.createDataFrame(
        [(2, 2, 0, 3, "ONE"), (2, 1, None, None, " four"), (1, 1, 5, 5, "new"), (4, 1, 100, 2, None), (None, 1, 0, 1, "x"), (77, 1, 0, 0, "y")],
        "doc_id long, seq int, start long, removed long, inserted string",
    )
    done = {r["doc_id"]: r for r in apply_edits(gather_edits(trees, edits), *path).collect()}
    assert [done[i]["text"] for i in range(4)] == [None, "new", "ONE two three four", texts[3]]
    assert all(r["n_tokens"] == count(r["text"] or "") == sum(x["tokens"] for x in r["leaves"]) for r in done.values())
    assert done[3]["n_encoded"] == 0 < done[4]["n_encoded"] < len(texts[4])
    assert apply_edits(gather_edits(trees.limit(0), edits), *path).count() == 0


def test_revision_counts(spark, counted):
    """The registered revision, done by plain string operations."""
    path, count = counted
    texts = [None, "", "a", "first\nsecond line of some words", "no line end in this text at all", "x\n" + "many words " * 300]
    docs = spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    edited = token_trees(docs.withColumn("edits", revision(F.col("text"), F.col("source"))), *path)
    for r in apply_edits(edited, *path).collect():
        text = texts[r["doc_id"]] or ""
        size, first, tail = len(text), text.find("\n") + 1, min(20, len(text))
        new = text[: size // 2] + " (src) " + text[size // 2 :]
        new = new[first:]
        at = min(max(size + 7 - first - tail, 0), len(new))
        new = new[:at] + text[size - tail :].upper() + new[at + tail :]
        assert (r["text"], r["n_tokens"]) == (new, count(new))
