"""Vector best-fit packing of documents into sequences, planned on counts of lengths."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from keysift.llm.shared import settled, slices
from keysift.llm.words import word_encoder

PART_BYTES = 2 << 20  # of texts encoded at once


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens, documents, and attention cost, the sum of squared piece lengths."""

    tokens: int = 2048
    documents: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def limits(self) -> np.ndarray:
        documents = self.tokens if self.documents is None else self.documents
        return np.array([self.tokens, documents, self.tokens**2 if self.cost is None else self.cost], np.int64)

    def longest(self) -> int:
        """The longest piece that fits into a sequence of its own."""
        return int(min(self.tokens, np.sqrt(self.limits()[2])))


def plan(counts: dict[int, int], capacity: Capacity, rule: str) -> tuple[np.ndarray, int]:
    """Places for ``counts[length]`` pieces of each length, and the number of sequences.

    Pieces are placed from long to short.  Sequences with equal residual capacities are one class, an interval of
    sequence numbers, so the work depends on the number of lengths and not on the number of pieces.  Each piece
    goes to the fitting class of the best score: ``norm`` takes the smallest weighted norm of what is left,
    ``dot`` the largest weighted dot product of demand and residual.  A place is ``(length, first rank, first
    sequence, number of sequences, offset)``: pieces of that length with consecutive ranks go to consecutive sequences.
    """
    limits, weights = capacity.limits(), np.asarray(capacity.weights) / capacity.limits().astype(float) ** 2
    left = np.zeros((0, 3), np.int64)  # residual of each class
    first, many = np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, sequences = [], 0

    def put(length: int, rank: int, at: int, bins: int, copies: int, offset: int) -> int:
        for _ in range(copies):
            places.append((length, rank, at, bins, offset))
            rank, offset = rank + bins, offset + length
        return rank

    for length in sorted(counts, reverse=True):
        need, rank, total = np.array([length, 1, length**2], np.int64), 0, counts[length]
        while rank < total:
            fits = np.flatnonzero((left >= need).all(axis=1) & (many > 0))
            if len(fits):
                if rule == "norm":
                    best = fits[np.argmin((weights * (left[fits] - need).astype(float) ** 2).sum(axis=1))]
                else:
                    best = fits[np.argmax((weights * left[fits] * need).sum(axis=1))]
                room, at, bins = left[best], int(first[best]), int(many[best])
            else:
                room, at, bins = limits, sequences, total
            copies = min(int((room // need).min()), total - rank)
            used = min(bins, (total - rank) // copies)
            rank = put(length, rank, at, used, copies, int(limits[0] - room[0]))
            if len(fits):
                first[best], many[best] = at + used, bins - used
            else:
                sequences += used
            left = np.vstack([left, room - copies * need])
            first, many = np.append(first, at), np.append(many, used)
        open_ = (many > 0) & (left > 0).all(axis=1)
        left, first, many = left[open_], first[open_], many[open_]
    return np.array(places, np.int64).reshape(-1, 5), sequences


def _pieces(batches, path: str, longest: int, end_id: int, id_type: pa.DataType, with_ids: bool):
    """Token pieces of each text; ``rank`` numbers the pieces of one length within the task."""
    encoder, part, seen = word_encoder(path), TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
    for batch in batches:
        for rows in slices(batch, "text", PART_BYTES):
            flat, sizes = encoder.encode(rows.column("text"))
            begins = np.cumsum(sizes) - sizes
            texts, numbers, starts, lengths, crcs, ids = [], [], [], [], [], []
            for row, (begin, size) in enumerate(zip(begins.tolist(), sizes.tolist())):
                own = np.append(flat[begin : begin + size], np.uint32(end_id)).astype("<u4")
                for number, start in enumerate(range(0, len(own), longest)):
                    piece = own[start : start + longest]
                    texts.append(row), numbers.append(number), starts.append(start), lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            lengths = np.array(lengths, np.int64)
            order = np.argsort(lengths, kind="stable")
            ranks = np.empty_like(lengths)
            values, begin, many = np.unique(lengths[order], return_index=True, return_counts=True)
            ranks[order] = np.arange(len(order)) - np.repeat(begin, many) + np.repeat(seen[values], many)
            seen[values] += many
            columns = {
                "key": rows.column("key").take(pa.array(texts, pa.int64())).cast(id_type),
                "piece": pa.array(numbers, pa.int32()), "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths), "ids_crc32": pa.array(crcs, pa.int64()),
                "part": pa.array(np.full(len(lengths), part, np.int64)), "rank": pa.array(ranks),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)


def token_pieces(
    docs: DataFrame, tokenizer: str, longest: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Documents as pieces of at most ``longest`` tokens: ids of the text, then ``end_id``; null text is empty.

    ``tokenizer`` is the path of the vocabulary file, which must be there on every executor.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType
    schema = (
        f"key {kind.simpleString()}, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, part BIGINT, rank BIGINT"
        + (", ids ARRAY<INT>" if with_ids else "")
    )
    from pyspark.sql.pandas.types import to_arrow_type

    made = partial(_pieces, path=tokenizer, longest=longest, end_id=end_id, id_type=to_arrow_type(kind), with_ids=with_ids)
    return settled(rows.mapInArrow(made, schema), "pieces")


def _seat(batches, places: np.ndarray):
    """Sequence and offset of pieces of known length and rank."""
    by = np.lexsort((places[:, 1], places[:, 0]))
    length, rank, at, _, offset = places[by].T
    for batch in batches:
        lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        # Ranks start anew at each length; the last place that starts at or before the rank is its own.
        found = np.empty(len(ranks), np.int64)
        for one in np.unique(lengths):
            own = lengths == one
            low = np.searchsorted(length, one)
            high = np.searchsorted(length, one, "right")
            found[own] = low + np.searchsorted(rank[low:high], ranks[own], "right") - 1
        columns = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
        columns["sequence_id"] = pa.array(at[found] + ranks - rank[found])
        columns["offset"] = pa.array(offset[found])
        yield pa.RecordBatch.from_pydict(columns)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: Capacity = Capacity(),
    rules: tuple[str, ...] = ("norm", "dot"),
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of ``docs`` with the sequence and offset each goes to; ``ids`` as well ``with_ids``.

    Only counts of lengths are gathered, at most ``capacity.tokens`` numbers whatever the size of the input; the
    plan that needs the fewest sequences among ``rules`` is used.  Pieces find their place by their rank among
    those of one length, from ranks within tasks and the tasks' counts.  Null and empty texts are one ``end_id``;
    a null id stays null and repeated rows are packed each; an empty table gives an empty result; extra columns
    are not read.
    """
    pieces = token_pieces(docs, tokenizer, capacity.longest(), end_id, id_col, text_col, with_ids)
    shares = settled(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, _ = min((plan(counts, capacity, rule) for rule in rules), key=lambda made: made[1])
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    starts = shares.select("part", "length", before.alias("before"))
    ranked = pieces.join(starts, ["part", "length"]).select(
        "key", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"),
        *(["ids"] if with_ids else []),
    )
    kind = pieces.schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"
        + (", ids ARRAY<INT>" if with_ids else "") + ", sequence_id BIGINT, offset BIGINT"
    )
    return ranked.mapInArrow(partial(_seat, places=places), schema).withColumnRenamed("key", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the token ids of each sequence, from pieces packed ``with_ids``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
