"""Benchmark decontamination: an FM-index per shard of documents, searched for the windows of all benchmark items."""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from keysift.llm.fm_index import FmIndex
from keysift.llm.shared import Carried, settled, slices

BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of each text; ends may hold empty ones."""
    return pc.ascii_split_whitespace(
        pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=_NOT_WORD, replacement=" ")
    )


class Windows:
    """Distinct windows of a block of items, as numbers of a vocabulary, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        lists = split_words(pa.array([text for _, text in items], pa.string())).to_pylist()
        words = [[w for w in words if w] for words in lists]
        self.vocabulary = pa.array(sorted({w for own in words for w in own}), pa.string())
        number = {w: i + 1 for i, w in enumerate(self.vocabulary.to_pylist())}
        holders: dict[tuple[int, ...], set[int]] = {}
        names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(names)}
        for (name, _), own in zip(items, words):
            codes = [number[w] for w in own]
            for at in range(max(1, len(codes) - width + 1)) if codes else ():
                holders.setdefault(tuple(codes[at : at + width]), set()).add(place[name])
        self.names = np.array(names, object)
        self.groups = []  # phrases of one length, and for each the items that hold it
        for length in sorted({len(w) for w in holders}):
            same = [w for w in holders if len(w) == length]
            sizes = np.array([len(holders[w]) for w in same])
            held = np.array([i for w in same for i in sorted(holders[w])], np.int64)
            self.groups.append((length, np.array(same, np.int64), np.cumsum(sizes) - sizes, sizes, held))


def _found(codes: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Start, end and items of all windows in ``codes``, zeros being words of no item or ends of documents.

    A window lies inside a run of known words at least as long as the shortest window, so only such runs are
    indexed; each ends with a zero.
    """
    if not windows.groups:
        return (np.zeros(0, np.int64),) * 3 + ([],)
    known = np.concatenate([[0], (codes > 0).astype(np.int8), [0]])
    edge = np.diff(known)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - begins >= windows.groups[0][0]
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return (np.zeros(0, np.int64),) * 3 + ([],)
    sizes = ends - begins + 1
    shifts = np.cumsum(sizes) - sizes
    where = np.repeat(begins - shifts, sizes) + np.arange(sizes.sum())
    text = np.append(codes, 0)[where].astype(np.int64)
    index = FmIndex(text, len(windows.vocabulary) + 1)
    starts, stops, held = [], [], []
    for length, phrases, first, many, items in windows.groups:
        low, high = index.search(phrases)
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        rows = np.repeat(low[hit] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        at = where[index.locate(rows)]
        window = np.repeat(hit, counts)
        starts.append(at), stops.append(at + length), held.append((window, first, many, items))
    order = np.concatenate([np.full(len(s), g) for g, s in enumerate(starts)])
    return np.concatenate(starts), np.concatenate(stops), order, held


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    words = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : words[start][0]])
        at = words[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def _scan(batches, windows, cleaned: bool):
    windows = windows.value
    for batch in batches:
        for rows in slices(batch, "text", SHARD_BYTES):
            texts = rows.column("text")
            lists = split_words(texts)
            flat = lists.flatten()
            real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[real]
            codes = pc.fill_null(pc.index_in(flat, value_set=windows.vocabulary), -1).to_numpy(zero_copy_only=False)[real] + 1
            n_words = np.bincount(owner, minlength=len(texts))
            # Every document is followed by one word of no item, so no window crosses its end.
            place = np.arange(len(codes)) + owner
            ended = np.zeros(len(codes) + len(lists), np.int32)
            ended[place] = codes
            del lists, flat, real, owner, codes, place  # the words are not needed any more
            starts, stops, group, held = _found(ended, windows)
            offset = np.cumsum(n_words + 1) - (n_words + 1)
            change = np.zeros(len(ended) + 1, np.int32)
            np.add.at(change, starts, 1)
            np.add.at(change, stops, -1)
            hit = np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]])
            begins, ends = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
            of = np.searchsorted(offset, begins, "right") - 1
            spans: list[list] = [[] for _ in range(len(texts))]
            for doc, begin, end in zip(of.tolist(), (begins - offset[of]).tolist(), (ends - offset[of]).tolist()):
                spans[doc].append((begin, end))
            names: list[list] = [[] for _ in range(len(texts))]
            docs = np.searchsorted(offset, starts, "right") - 1
            for number, (window, first, many, items) in enumerate(held):
                own = docs[group == number]
                pairs = np.unique(own * len(first) + window) if len(own) else np.zeros(0, np.int64)
                for doc, w in zip((pairs // len(first)).tolist(), (pairs % len(first)).tolist()):
                    names[doc].append(items[first[w] : first[w] + many[w]])
            named = [sorted(windows.names[np.unique(np.concatenate(n))].tolist()) if n else [] for n in names]
            columns = {c: rows.column(c) for c in rows.schema.names if c != "text"} | {
                "n_words": pa.array(n_words, pa.int64()),
                "items": pa.array(named, pa.list_(pa.string())),
                "spans": pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], _SPANS),
            }
            if cleaned:
                columns["text"] = pa.array(
                    [_cut(t.as_py(), s) if s else t.as_py() for t, s in zip(texts, spans)], pa.string()
                )
            yield pa.RecordBatch.from_pydict(columns)


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_FOUND = "n_words BIGINT, items ARRAY<STRING>, spans ARRAY<STRUCT<first: BIGINT, last: BIGINT>>"


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """``items`` with a block number, blocks being small enough to broadcast, and the number of blocks."""
    sized, count = items.withColumn("bytes", F.octet_length("text")), 1
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    count = max(1, -(-total // BLOCK_BYTES))
    while True:
        numbered = sized.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count)))
        largest = numbered.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        if largest.filter((F.col("bytes") > 2 * BLOCK_BYTES) & (F.col("n") > 1)).isEmpty():
            return numbered, count
        count *= 2


def covered_words(spans: Column) -> Column:
    """How many words the spans cover; they may overlap."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["last"] - F.greatest(s["to"], x["first"]))).alias("n"),
            F.greatest(s["to"], x["last"]).alias("to"),
        ),
    )
    return step["n"]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    cleaned: bool = False,
) -> DataFrame:
    """``docs`` without the text but with ``n_words``, ``n_hit``, ``items`` and ``spans``: where windows of items stand.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, in lower case.  A window
    is ``width`` consecutive words of an item, or the whole of a shorter one.  ``spans`` are the merged stretches
    of words inside any occurrence, ``first`` to before ``last``; ``items`` names the items found, sorted, a null
    id as ``null``.  ``cleaned`` keeps the text, with the spans cut out.

    Each task indexes the documents it reads, in shards of ``SHARD_BYTES``, and searches the windows of a block of
    items, which is broadcast; a benchmark larger than ``BLOCK_BYTES`` is searched block by block.  A null or empty
    text has no words, and an item without words no window; a null document id stays null, repeated rows are
    judged each, empty tables give an empty result or no hits.  Columns of ``docs`` named like the added ones are
    replaced.
    """
    spark = docs.sparkSession
    added = ("n_words", "n_hit", "items", "spans")
    carried = Carried(docs, (*added, text_col))
    items = benchmark.select(
        F.coalesce(F.col(item_id_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text")
    ).filter(F.octet_length("text") > 0).distinct()  # equal rows would stay in one block, however many there are
    numbered, blocks = _blocks(items)
    text = F.col(text_col)
    rows = docs.select(carried.column, text.alias("text"))  # the text travels once
    if blocks > 1:
        rows = settled(rows.withColumn("at", F.monotonically_increasing_id()), "documents")

    def scan(block: int, frame: DataFrame, columns: list[str], clean: bool) -> DataFrame:
        pairs = [(r["item"], r["text"]) for r in numbered.filter(F.col("block") == block).select("item", "text").collect()]
        windows = spark.sparkContext.broadcast(Windows(pairs, width))
        schema = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in columns)
        return frame.select(*columns, "text").mapInArrow(
            partial(_scan, windows=windows, cleaned=clean), f"{schema}, {_FOUND}" + (", text STRING" if clean else "")
        )

    if blocks == 1:
        found = scan(0, rows, ["row"], cleaned)
        done = found.withColumn("n_hit", covered_words(F.col("spans")))
    else:
        parts = [settled(scan(b, rows, ["at"], False).filter((F.size("spans") > 0) | F.lit(b == 0)), "hits") for b in range(blocks)]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        merged = every.groupBy("at").agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.flatten(F.collect_list("spans")).alias("spans"),
        )
        found = rows.join(merged, "at")
        done = found.withColumns({"n_hit": covered_words(F.col("spans")), "spans": merged_spans(F.col("spans"))})
        if cleaned:
            done = done.mapInArrow(
                _clean, f"row {rows.schema['row'].dataType.simpleString()}, {_FOUND}, n_hit BIGINT, text STRING"
            )
    back = carried.back() | ({text_col: F.col("text").alias(text_col)} if cleaned else {})
    return done.select(*(back[c] for c in docs.columns if c in back), *added)


def merged_spans(spans: Column) -> Column:
    """Overlapping and touching spans as one."""
    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))),
        )
        return F.when(F.size(done) == 0, F.array(x)).when(x["first"] <= last["last"], joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<first: bigint, last: bigint>>"), step)


def _clean(batches):
    for batch in batches:
        texts = [
            _cut(text, [(s["first"], s["last"]) for s in spans]) if spans else text
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
        ]
        columns = {c: batch.column(c) for c in ("row", "n_words", "items", "spans", "n_hit")}
        yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.string())})
