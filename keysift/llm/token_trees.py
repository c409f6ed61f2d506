"""Edit-aware token counts: a segment tree of pre-token groups per document, re-encoded only where an edit touches it."""

from __future__ import annotations

import base64
import re
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keysift.llm.shared import Carried, slices

LEAF_CHARS = 512
# A single space between two printing characters starts a pre-token, whatever stands further off.
_SAFE = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
EDITS = "ARRAY<STRUCT<start: BIGINT, removed: BIGINT, inserted: STRING>>"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The byte-level BPE of a file of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut_leaves(text: str, least: int = LEAF_CHARS) -> list[str]:
    """The text in parts of about ``least`` characters, cut where the counts of the parts add up."""
    parts, at = [], 0
    while found := _SAFE.search(text, at + least):
        parts.append(text[at : found.start()])
        at = found.start()
    return [*parts, text[at:]]


class TokenTree:
    """Sums of characters and tokens over the leaves of one document; node 1 is the root, leaves are the last nodes."""

    def __init__(self, leaves: list[str], counts: list[int], count):
        self.count, self.encoded = count, 0
        self._build(leaves, counts)

    def _build(self, leaves: list[str], counts: list[int]) -> None:
        self.leaves, self.size = leaves, 1 << max(0, len(leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(leaves), 0] = [len(leaf) for leaf in leaves]
        self.sums[self.size : self.size + len(leaves), 1] = counts
        width = self.size
        while width > 1:
            self.sums[width // 2 : width] = self.sums[width : 2 * width].reshape(-1, 2, 2).sum(axis=1)
            width //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def counts(self) -> list[int]:
        return self.sums[self.size : self.size + len(self.leaves), 1].tolist()

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the character's place in it; past the end, the last leaf."""
        if at >= self.chars:
            return len(self.leaves) - 1, len(self.leaves[-1])
        node = 1
        while node < self.size:
            node *= 2
            if at >= self.sums[node, 0]:
                at -= int(self.sums[node, 0])
                node += 1
        return node - self.size, at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        change = np.array([len(text), tokens]) - self.sums[self.size + leaf]
        node = self.size + leaf
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``start`` on, and count anew what the change can reach.

        A boundary between leaves holds as long as the last character before it and the two after it stay, so an
        edit that comes closer takes the neighbouring leaf in.
        """
        start = min(max(start, 0), self.chars)
        end = min(start + max(removed, 0), self.chars)
        (first, into), (last, upto) = self.find(start), self.find(end)
        while first > 0 and into < 3:
            first -= 1
            into += len(self.leaves[first])
        while last < len(self.leaves) - 1 and len(self.leaves[last]) - upto < 3:
            upto -= len(self.leaves[last])
            last += 1
        old = "".join(self.leaves[first : last + 1])
        tail = len(self.leaves[last]) - upto
        text = old[:into] + inserted + old[len(old) - tail :]
        self.encoded += len(text)
        if len(text) > 4 * LEAF_CHARS:
            parts, counts = cut_leaves(text), self.counts()
            fresh = [self.count(part) for part in parts]
            self._build(self.leaves[:first] + parts + self.leaves[last + 1 :], counts[:first] + fresh + counts[last + 1 :])
            return
        self._set(first, text, self.count(text))
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "", 0)

    def text(self) -> str:
        return "".join(self.leaves)


def _counter(path: str, pattern: str):
    encode = encoding(path, pattern).encode_ordinary
    return lambda text: len(encode(text))


_LEAVES = pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64())]))
_LEAVES_DDL = "ARRAY<STRUCT<chars: BIGINT, tokens: BIGINT>>"


def _leaf_rows(leaves: list[str], counts: list[int]) -> list[dict]:
    return [{"chars": len(leaf), "tokens": n} for leaf, n in zip(leaves, counts)]


def _plant(batches, path: str, pattern: str):
    count = _counter(path, pattern)
    for batch in batches:
        for rows in slices(batch, "text"):
            trees, totals = [], []
            for text in rows.column("text").to_pylist():
                leaves = cut_leaves(text or "")
                counts = [count(leaf) for leaf in leaves]
                trees.append(_leaf_rows(leaves, counts))
                totals.append(sum(counts))
            yield pa.RecordBatch.from_pydict(
                {c: rows.column(c) for c in rows.schema.names}
                | {"n_tokens": pa.array(totals, pa.int64()), "leaves": pa.array(trees, _LEAVES)}
            )


def token_trees(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``leaves``: the token count of each text, and those of its parts.

    ``ranks`` is the path of the vocabulary, to be there on every executor, ``pattern`` its pre-tokenizer.  A null
    text has no tokens and one empty leaf.  Columns named like the added ones are replaced.
    """
    carried = Carried(docs, ("n_tokens", "leaves", text_col))
    rows = docs.select(carried.column, F.col(text_col).alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text STRING, n_tokens BIGINT, leaves {_LEAVES_DDL}"
    made = rows.mapInArrow(partial(_plant, path=ranks, pattern=pattern), schema)
    back = carried.back() | {text_col: F.col("text").alias(text_col)}
    return made.select(*(back[c] for c in docs.columns if c in back), "n_tokens", "leaves")


def _edited(batches, path: str, pattern: str):
    count = _counter(path, pattern)
    for batch in batches:
        for rows in slices(batch, "text"):
            texts, totals, trees, encoded = [], [], [], []
            columns = (rows.column(c).to_pylist() for c in ("text", "leaves", "edits"))
            for text, leaves, edits in zip(*columns):
                old, at, parts = text or "", 0, []
                for leaf in leaves:
                    parts.append(old[at : at + leaf["chars"]])
                    at += leaf["chars"]
                tree = TokenTree(parts, [leaf["tokens"] for leaf in leaves], count)
                for change in edits or ():
                    if change is not None:
                        start = tree.chars if change["start"] is None else change["start"]
                        tree.edit(start, change["removed"] or 0, change["inserted"] or "")
                texts.append(tree.text() if edits else text)
                totals.append(tree.tokens)
                trees.append(_leaf_rows(tree.leaves, tree.counts()))
                encoded.append(tree.encoded)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": rows.column("row"), "text": pa.array(texts, pa.string()),
                    "n_tokens": pa.array(totals, pa.int64()), "leaves": pa.array(trees, _LEAVES),
                    "n_encoded": pa.array(encoded, pa.int64()),
                }
            )


def apply_edits(
    trees: DataFrame, ranks: str, pattern: str, edits_col: str = "edits", text_col: str = "text"
) -> DataFrame:
    """``trees`` after the edits of each row: new text, ``n_tokens`` and ``leaves``, and ``n_encoded``.

    ``edits_col`` holds ``array<struct<start, removed, inserted>>``, applied in order, each to the text the ones
    before have left; places are in characters and are clipped to the text, a null ``start`` is its end, other nulls
    remove or insert nothing.  ``n_encoded`` counts the characters encoded anew: the touched leaves, and their
    neighbours where an edit comes near a boundary.  A row without edits stays as it is, null text included.
    """
    carried = Carried(trees, ("n_tokens", "leaves", "n_encoded", text_col, edits_col))
    rows = trees.select(carried.column, F.col(text_col).alias("text"), "leaves", F.col(edits_col).cast(EDITS).alias("edits"))
    schema = (
        f"row {rows.schema['row'].dataType.simpleString()}, text STRING, n_tokens BIGINT, leaves {_LEAVES_DDL}, n_encoded BIGINT"
    )
    made = rows.mapInArrow(partial(_edited, path=ranks, pattern=pattern), schema)
    back = carried.back() | {text_col: F.col("text").alias(text_col)}
    return made.select(*(back[c] for c in trees.columns if c in back), "n_tokens", "leaves", "n_encoded")


def gather_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", edits_col: str = "edits") -> DataFrame:
    """``docs`` with the edits of ``edits(id_col, seq, start, removed, inserted)`` in order of ``seq``.

    One document's edits build on each other, so they are one array; edits of a null id belong to no document.
    """
    own = edits.groupBy(F.col(id_col).alias("edited")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "start", "removed", "inserted"))).alias(edits_col)
    )
    changes = F.transform(edits_col, lambda e: F.struct(e["start"].alias("start"), e["removed"].alias("removed"), e["inserted"].alias("inserted")))
    own = own.withColumn(edits_col, changes.cast(EDITS))
    return docs.join(own, docs[id_col] == own["edited"], "left").drop("edited")
