"""Periodic runs of words: suffix classes united by decreasing common prefix, with union-find over ordered positions."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keysift.llm.shared import Carried, slices

LEAST_LENGTH, LEAST_ROUNDS = 24, 3
PART_BYTES = 8 << 20
_RUN = "struct<start: bigint, length: bigint, period: bigint>"
_MADE = ("n_words", "runs", "collapsed")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in a row, and how many each text has; words are parted by ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return flat.filter(pa.array(real)), np.bincount(owner[real], minlength=len(texts))


def _classes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers, in order, of ``values``, and how often each occurs."""
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), bool)
    new[1:] = values[order][1:] != values[order][:-1]
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, np.bincount(number)


def _repeating(words: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Documents in which some string of ``width`` words occurs twice.

    Strings of 1, 2, 4, ... words are classes; a position whose class is alone in its document takes no further
    part, as no longer string from there can occur twice.
    """
    n = len(words)
    count = int(doc[-1]) + 1 if n else 0
    rank, spots, done = np.full(n, -1, np.int64), np.arange(n), 1
    keys = words * count + doc
    while len(spots):
        number, sizes = _classes(keys)
        again = sizes[number] > 1
        rank[spots] = -1
        spots, number = spots[again], number[again]
        rank[spots] = number
        if done == width:
            break
        step = min(done, width - done)
        inside = spots + step < n
        ahead = np.where(inside, rank[np.minimum(spots + step, max(n - 1, 0))], -1)
        # The class of a neighbour in another document differs, as classes hold the document.
        whole = (ahead >= 0) & (doc[np.minimum(spots + step, max(n - 1, 0))] == doc[spots])
        stale, spots, number = spots, spots[whole], number[whole]
        keys = number * (int(rank.max()) + 1) + ahead[whole]
        kept = np.zeros(n, bool)
        kept[spots] = True
        rank[stale[~kept[stale]]] = -1
        done += step
    return np.unique(doc[spots])


def suffix_order(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of each document in lexicographic order, by doubling.

    ``words`` are those of all documents, ``ends[i]`` is where the document of position i ends; a suffix never
    reaches beyond it.  A rank is the place of the first suffix of its class, and only classes of several
    suffixes are sorted further.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n, np.int64)

    def settle(spots: np.ndarray, keys: np.ndarray, first: np.ndarray) -> None:
        """Ranks of ``spots``, sorted by ``keys``, that fill the places from ``first`` on."""
        new = np.ones(len(spots), bool)
        new[1:] = keys[1:] != keys[:-1]
        starts = np.flatnonzero(new)
        rank[spots] = np.repeat(first[starts], np.diff(np.append(starts, len(spots))))

    settle(order, words[order], np.arange(n))
    places, width = np.arange(n), 1
    while True:
        spots = order[places]
        size = np.bincount(rank[spots], minlength=n)
        places = places[size[rank[spots]] > 1]
        if not len(places):
            return order
        spots = order[places]
        ahead = spots + width
        after = np.where(ahead < ends[spots], rank[np.minimum(ahead, n - 1)], -ends[spots] - 1)
        by = np.lexsort((after, rank[spots]))
        spots, after = spots[by], after[by]
        keys = np.zeros(len(spots), np.int64)
        keys[1:] = np.cumsum((after[1:] != after[:-1]) | (rank[spots][1:] != rank[spots][:-1]))
        order[places] = spots
        settle(spots, keys, places)
        width *= 2


def common_prefixes(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Words each suffix shares with the one before it in ``order``, none across documents.

    A suffix whose left neighbour goes on a shared string has one word less in common than that neighbour, so
    words are compared only where the words to the left differ.
    """
    n = len(words)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    same = (before >= 0) & (begins[np.maximum(before, 0)] == begins)
    first = same & ((at == begins) | (before == begins))
    rest = np.flatnonzero(same & ~first)
    first[rest[words[rest - 1] != words[before[rest] - 1]]] = True
    common = np.zeros(n, np.int64)
    open_ = np.flatnonzero(first)
    length = 64
    while len(open_):
        other, done = before[open_], common[open_]
        most = ends[open_] - np.maximum(open_, other)
        equal, chunk = np.ones(len(open_), bool), max(1, min(length, (1 << 22) // len(open_)))
        for start in range(0, len(open_), 1 << 16):
            part = slice(start, start + (1 << 16))
            steps = done[part, None] + np.arange(chunk)
            inside = steps < most[part, None]
            left, right = (np.minimum(p[part, None] + steps, n - 1) for p in (open_, other))
            hit = inside & (words[left] == words[right])
            run = np.where(hit.all(axis=1), chunk, np.argmin(hit, axis=1))
            common[open_[part]] += run
            equal[part] = run == chunk
        open_ = open_[equal]
        length *= 2
    # Between such places the common prefix falls by one a word.
    marks = np.where(first, at, 0)
    known = np.maximum.accumulate(marks)
    return np.where(same & ~first, np.maximum(common[known] - (at - known), 0), common)


class _Positions:
    """Ordered sets of positions in blocks, so that a set of any size takes another position in a short time."""

    __slots__ = ("blocks", "size")
    MOST = 512

    def __init__(self, position: int):
        self.blocks, self.size = [[position]], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> tuple[int, int]:
        """The neighbours the position gets, -1 where it has none."""
        blocks, low, high = self.blocks, 0, len(self.blocks)
        while high - low > 1:
            middle = (low + high) >> 1
            if blocks[middle][0] <= position:
                low = middle
            else:
                high = middle
        block = blocks[low]
        at = bisect_left(block, position)
        left = block[at - 1] if at else (blocks[low - 1][-1] if low else -1)
        right = block[at] if at < len(block) else (blocks[low + 1][0] if low + 1 < len(blocks) else -1)
        block.insert(at, position)
        self.size += 1
        if len(block) > self.MOST:
            blocks.insert(low + 1, block[self.MOST // 2 :])
            del block[self.MOST // 2 :]
        return left, right


def seeds(order: np.ndarray, common: np.ndarray, least: int, rounds: int) -> list[tuple[int, int, int]]:
    """``(i, j, common prefix)`` of positions that become neighbours, ``rounds - 1`` periods or more in common.

    Suffixes next to each other in ``order`` are edges of weight ``common``; edges are taken by decreasing weight
    and unite two classes, the smaller one's positions entering the larger one's.
    """
    edges = np.flatnonzero(common[order] >= least)
    weights = common[order[edges]]
    edges, weights = edges[np.argsort(-weights, kind="stable")], np.sort(weights)[::-1]
    root: dict[int, int] = {}
    sets: dict[int, _Positions] = {}
    found = []

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = root[x]
        return x

    for a, b, shared in zip(order[edges - 1].tolist(), order[edges].tolist(), weights.tolist()):
        a, b = top(a), top(b)
        large, small = sets.get(a) or _Positions(a), sets.get(b) or _Positions(b)
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        root[b] = a
        sets[a] = large
        sets.pop(b, None)
        last = -1
        for position in small:
            left, right = large.add(position)
            if left not in (-1, last) and (rounds - 1) * (position - left) <= shared:
                found.append((left, position, shared))
            if right >= 0 and (rounds - 1) * (right - position) <= shared:
                found.append((position, right, shared))
            last = position
    return found


def _nearest(pairs: np.ndarray) -> np.ndarray:
    """Without pairs that a third position parts, which shares as much with the first and comes before the second.

    Such a pair was made before the third one was united with it, at the same length; the pair of the first and the
    third position is there too.
    """
    pairs = pairs[np.lexsort((-pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    height = np.cumsum(np.diff(pairs[:, 0], prepend=-1) != 0) * (int(pairs[:, 2].max(initial=0)) + 1) + pairs[:, 2]
    kept = np.ones(len(pairs), bool)
    kept[1:] = height[1:] > np.maximum.accumulate(height)[:-1]
    return pairs[kept]


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST_LENGTH, rounds: int = LEAST_ROUNDS) -> np.ndarray:
    """Rows ``(document, start, length, period)`` of all maximal runs, by document, start and period.

    ``words`` are numbers of the words of all documents in a row, ``sizes`` how many each document has.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    # A run of `rounds` periods and `least` words shares this many words with itself one period on.
    shared = max(1, -(-least * (rounds - 1) // rounds))
    docs = _repeating(words, doc, shared) if len(words) else doc
    if not len(docs):
        return np.zeros((0, 4), np.int64)
    chosen = np.zeros(len(sizes), bool)
    chosen[docs] = True
    words, own = words[chosen[doc]], sizes[docs]
    last = np.cumsum(own)
    begins, ends = np.repeat(last - own, own), np.repeat(last, own)
    # A word of one document is no word of another, so classes of suffixes never join documents.
    order = suffix_order(words * len(docs) + np.repeat(np.arange(len(docs)), own), ends)
    common = common_prefixes(words, begins, ends, order)
    made = _nearest(np.array(seeds(order, common, shared, rounds), np.int64).reshape(-1, 3))
    start, period = made[:, 0], made[:, 1] - made[:, 0]
    length = period + made[:, 2]
    # The leftmost pair of a run: its words to the left differ, or there are none.
    left = (start == begins[start]) | (words[np.maximum(start - 1, 0)] != words[np.maximum(made[:, 1] - 1, 0)])
    good = left & (length >= least) & (length >= rounds * period)
    which = np.searchsorted(last, start, side="right")
    rows = np.stack([docs[which], start - begins[start], length, period], axis=1)[good]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _judged(least: int, rounds: int, part_bytes: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", part_bytes):
                yield _of_part(part, least, rounds)

    return run


def _of_part(part: pa.RecordBatch, least: int, rounds: int) -> pa.RecordBatch:
    words, sizes = split_words(part.column("text"))
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    found = find_runs(codes, sizes, least, rounds)
    ends = np.cumsum(sizes)
    # A word is dropped if a run holds it after its first period.
    cover = np.zeros(len(codes) + 1, np.int64)
    base = (ends - sizes)[found[:, 0]]
    np.add.at(cover, base + found[:, 1] + found[:, 3], 1)
    np.add.at(cover, base + found[:, 1] + found[:, 2], -1)
    kept = np.cumsum(cover[:-1]) == 0
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.bincount(owner[kept], minlength=len(sizes))
    bounds = np.concatenate([[0], np.cumsum(left)]).astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words.filter(pa.array(kept))), " ")
    per = np.concatenate([[0], np.cumsum(np.bincount(found[:, 0], minlength=len(sizes)))]).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [part.column("row"), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(per), runs), collapsed.cast(pa.string())],
        ["row", *_MADE],
    )


def periodic_runs(
    docs: DataFrame, least: int = LEAST_LENGTH, rounds: int = LEAST_ROUNDS, text_col: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    A run is a stretch of words with smallest period q, at least ``least`` words and ``rounds`` (2 or more) periods
    long, that neither neighbour extends.  ``collapsed`` joins by one space the words that no run holds after its
    first q words.  Starts are word numbers from 0; words are parted by ASCII white space and compared as they are.

    The start of a run and the word one period on share the rest of it, and nothing between them shares as much;
    so they become neighbours when classes of suffixes are united by decreasing common prefix, at that length.
    Only documents in which a string of two thirds of ``least`` words (for three rounds) occurs twice are sorted.

    A null or empty text has no words, no runs and an empty ``collapsed``.  Repeated rows are judged alike, ids are
    not read, an empty table gives an empty result, and extra columns are passed on; those named like the three
    columns added are replaced.  No row needs another, so nothing is shuffled; texts are taken ``part_bytes`` at a
    time, and a longer one by itself, in memory of some 60 bytes a word where it repeats itself.
    """
    carried = Carried(docs, _MADE)
    kind = docs.select(carried.column).schema["row"].dataType.simpleString()
    rows = docs.select(carried.column, F.col(text_col).alias("text"))
    made = rows.mapInArrow(
        _judged(least, rounds, part_bytes), f"row {kind}, n_words BIGINT, runs ARRAY<{_RUN}>, collapsed STRING"
    )
    return made.select(*carried.back().values(), *_MADE)
