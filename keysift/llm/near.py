"""Near-duplicate documents: fast similarity sketches of shingle sets, banding, and exact verification."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from keysift.llm.graph import connected_components
from keysift.llm.hashing import mixed, told_apart
from keysift.llm.shared import join_groups, settled, slices

BAND_ROWS, BANDS = 5, 38
COORDINATES = BAND_ROWS * BANDS
PART_BYTES = 4 << 20
BLOCK_ROWS = 1_000
BLOCK_SHINGLES = 1_000_000
HUBS = 4
_SEEDS = np.random.default_rng(44).integers(1, 2**64, 2 * COORDINATES + 64, np.uint64) | np.uint64(1)
_EMPTY = np.uint64(2**64 - 1)
_PAIRS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within a text, and how many each has.

    Words are lower-cased in ASCII and parted by ASCII white space.  A text of fewer words than ``width`` has one
    shingle, a text without words none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    owner = owner[real.to_numpy(zero_copy_only=False)]
    words = flat.filter(real).dictionary_encode()
    hashes = told_apart(words.dictionary)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    sizes = np.bincount(owner, minlength=len(texts))
    last = np.cumsum(sizes)
    sums = np.zeros(len(hashes), np.uint64)
    for ahead in range(width):
        moved = np.zeros(len(hashes), np.uint64)
        inside = np.arange(len(hashes)) + ahead < last[owner]
        moved[inside] = hashes[np.flatnonzero(inside) + ahead]
        sums += moved * _SEEDS[ahead]
    place = np.arange(len(hashes)) - (last - sizes)[owner]
    starts = (place + width <= sizes[owner]) | ((place == 0) & (sizes[owner] < width))
    short = np.minimum(sizes, width)[owner][starts].astype(np.uint64)
    found, of = mixed(sums[starts] + short * _SEEDS[width]), owner[starts]
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], np.bincount(of[new], minlength=len(texts))


def sketches(shingles: np.ndarray, sizes: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches: the share of equal coordinates of two sets estimates their similarity.

    Round after round, every shingle is put in a bin at random, and a bin keeps the smallest hash of the first
    round that reaches it; from round ``coordinates`` on, all shingles go to one bin each round, so every bin is
    filled after twice as many rounds.  Sets whose bins are full take no further part.
    """
    texts = len(sizes)
    out = np.full(texts * coordinates, _EMPTY, np.uint64)
    owner, left = np.repeat(np.arange(texts), sizes), shingles
    for number in range(2 * coordinates):
        if not len(left):
            break
        drawn = mixed(left ^ _SEEDS[number])
        if number < coordinates:
            bins = ((drawn >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(left), number - coordinates)
        spot = owner * coordinates + bins
        free = out[spot] == _EMPTY
        value = (np.uint64(number) << np.uint64(54)) | (drawn[free] & np.uint64(2**54 - 1))
        np.minimum.at(out, spot[free], value)
        open_ = (out.reshape(texts, coordinates) == _EMPTY).any(axis=1)
        going = open_[owner]
        owner, left = owner[going], left[going]
    return out.reshape(texts, coordinates)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), BANDS, BAND_ROWS)
    return mixed((parts * _SEEDS[:BAND_ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _SEEDS[BAND_ROWS])


def fewest_equal(similarity: float) -> int:
    """Equal coordinates that a pair of that similarity reaches but for one in 10^13: 7.5 standard deviations less."""
    return int(COORDINATES * similarity - 7.5 * np.sqrt(COORDINATES * similarity * (1 - similarity)))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _sketch(batches, width: int):
    for batch in batches:
        for rows in slices(batch, "text", PART_BYTES):
            shingles, sizes = shingle_sets(rows.column("text"), width)
            both = [mixed(_sums(mixed(shingles ^ _SEEDS[-k]), sizes) + sizes.astype(np.uint64)) for k in (1, 2)]
            names = np.stack(both, axis=1).astype(">u8").tobytes()
            sketch = sketches(shingles, sizes)
            small = (mixed(sketch) & np.uint64(255)).astype(np.uint8).tobytes()
            keys = band_keys(sketch).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": rows.column("row"), "key": rows.column("key"), "text_hash": rows.column("text_hash"),
                    "n": pa.array(sizes, pa.int64()),
                    "name": pa.array([names[i : i + 16] for i in range(0, len(names), 16)], pa.binary()),
                    "sketch": pa.array([small[i : i + COORDINATES] for i in range(0, len(small), COORDINATES)], pa.binary()),
                    "bands": pa.ListArray.from_arrays(
                        pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1))
                    ),
                }
            )


def _known(table: pa.Table) -> np.ndarray:
    """The first row each row is connected with already, by its ``label``."""
    codes = table["label"].combine_chunks().dictionary_encode().indices.to_numpy()
    return _first(codes)


def _first(codes: np.ndarray) -> np.ndarray:
    _, first, of = np.unique(codes, return_index=True, return_inverse=True)
    return first[of]


class _Stars:
    """Which rows of a task are connected; a row's label is the smallest row it is connected with."""

    def __init__(self, known: np.ndarray):
        self.known, self.label = known, known.copy()

    def join(self, rows: np.ndarray) -> None:
        labels = np.unique(self.label[rows])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]

    def edges(self, names: pa.Array) -> pa.Table:
        """What is new: one edge for each row that stood for others before and no longer does."""
        every = np.arange(len(self.label))
        ends = np.flatnonzero((self.known == every) & (self.label != every))
        return pa.table({"a": names.take(pa.array(ends)), "b": names.take(pa.array(self.label[ends]))}).cast(_PAIRS)


def _groups(table: pa.Table, columns: list[str]) -> list[np.ndarray]:
    """Row numbers of each combination of values in ``columns``."""
    order = pc.sort_indices(table, [(c, "ascending") for c in columns]).to_numpy().astype(np.int64)
    changed = np.zeros(len(order), bool)
    for c in columns:
        codes = table[c].combine_chunks().dictionary_encode().indices.to_numpy()[order]
        changed[1:] |= codes[1:] != codes[:-1]
    return np.split(order, np.flatnonzero(changed))


def _grid(sketch: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.frombuffer(sketch, np.uint8).reshape(len(sizes), COORDINATES)


def _alike(sketch: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    return (sketch[others] == sketch[one]).sum(axis=1)


def _candidates(table: pa.Table, least: int) -> pa.Table:
    """Stars over members of each bucket that may be linked: connected by pairs with ``least`` equal coordinates.

    One member after another is held against those it is not connected with, until the bucket is one star or all
    have had their turn; in a group of near copies the first few connect the rest.
    """
    names, known = table["name"].combine_chunks(), _known(table)
    codes = names.dictionary_encode().indices.to_numpy()
    sketch = _grid(b"".join(table["sketch"].to_pylist()), names)
    edges = [np.zeros((2, 0), np.int64)]
    for rows in _groups(table, ["bucket", "x", "y"]):
        rows = rows[np.unique(codes[rows], return_index=True)[1]]
        label = _first(known[rows])
        for at in range(len(rows) - 1):
            rest = at + 1 + np.flatnonzero(label[at + 1 :] != label[at])
            near = rest[_alike(sketch, rows[at], rows[rest]) >= least] if len(rest) else rest
            if len(near):
                edges.append(np.stack([rows[near], np.full(len(near), rows[at])]))
                label[np.isin(label, np.append(label[near], label[at]))] = min(label[near].min(), label[at])
            elif len(rest) == 0 and (label == label[0]).all():
                break
    ends, hubs = np.concatenate(edges, axis=1)
    return pa.table({"a": names.take(pa.array(ends)), "b": names.take(pa.array(hubs))}).cast(_PAIRS)


def _verified(table: pa.Table, least: int, percent: int) -> pa.Table:
    """Stars over documents connected by pairs whose full sets are similar enough, likely pairs tried first."""
    names, shingles = table["name"].combine_chunks(), table["shingles"].combine_chunks()
    sketch = _grid(b"".join(table["sketch"].to_pylist()), names)
    offsets, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
    sizes = np.diff(offsets)
    stars = _Stars(_known(table))

    def linked(a: int, b: int) -> bool:
        both = np.concatenate([values[offsets[a] : offsets[a + 1]], values[offsets[b] : offsets[b + 1]]])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= percent * (len(both) - common)

    for rows in _groups(table, ["component", "x", "y"]):
        pairs = [np.zeros((3, 0), np.int32)]
        for at, one in enumerate(rows[:-1].tolist()):
            rest = rows[at + 1 :]
            rest = rest[100 * np.minimum(sizes[one], sizes[rest]) >= percent * np.maximum(sizes[one], sizes[rest])]
            rest = rest[stars.label[rest] != stars.label[one]]
            equal = _alike(sketch, one, rest)
            likely = equal >= least
            pairs.append(np.stack([equal[likely], np.full(likely.sum(), one), rest[likely]]).astype(np.int32))
        tried = np.concatenate(pairs, axis=1)
        tried = tried[:, np.argsort(-tried[0], kind="stable")]
        for start in range(0, tried.shape[1], 1024):
            one, two = tried[1:, start : start + 1024].astype(np.int64)
            open_ = stars.label[one] != stars.label[two]
            for a, b in zip(one[open_].tolist(), two[open_].tolist()):
                if stars.label[a] != stars.label[b] and linked(a, b):
                    stars.join(np.array([a, b]))
    return stars.edges(names)


def _blocks(rows: str, weight: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(weight) / BLOCK_SHINGLES)).cast("int")


def _near_hubs(rows: DataFrame, hubs: DataFrame, group: str, seed: int) -> DataFrame:
    """``rows`` in the block each is dealt to this time, and the hubs of their group in all its blocks."""
    own = F.pmod(F.xxhash64("name", F.lit(seed)), F.col("blocks")).cast("int")
    there = F.when(F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    rows = rows.join(hubs.withColumn("hub", F.lit(True)), [group, "name"], "left")
    return rows.withColumn("x", F.explode(there)).withColumn("y", F.lit(0)).drop("hub")


def _rest_with_all(rows: DataFrame) -> DataFrame:
    """``rows`` so that each one of the rest meets every row of its group, in tasks of two blocks."""
    own, mine = (F.pmod(F.xxhash64("name", F.lit(n)), F.col(blocks)).cast("int") for n, blocks in enumerate(("blocks", "rest_blocks")))
    each = [F.sequence(F.lit(0), F.col(blocks) - 1) for blocks in ("rest_blocks", "blocks")]
    met = F.transform(each[0], lambda y: F.struct(own.alias("x"), y.alias("y")))
    of_rest = F.transform(each[1], lambda x: F.struct(x.alias("x"), mine.alias("y")))
    met = F.when(F.col("in_rest"), F.array_union(met, of_rest)).otherwise(met)
    return rows.select("*", F.inline(met))


def _links(rows_of: Callable[[DataFrame], DataFrame], sizes: DataFrame, group: str, weight: Column, tasks: int, work) -> DataFrame:
    """Edges ``(a, b)`` that connect, in each group of ``sizes(group, size, weight)``, what pairs of its rows connect.

    ``rows_of`` gives the rows of some groups, and ``work`` the edges of a table of rows, each pair of which is held
    against another if their ``label`` differs.  A group of up to ``BLOCK_ROWS`` rows and ``BLOCK_SHINGLES`` of
    ``weight`` is one block.  In a larger one every row is first held against ``HUBS`` rows of its group and those of
    its block, in one round after another, each with new hubs out of the rest, that is what the largest star does
    not hold yet, as long as this halves the rest.  At last each row of the rest is held against all rows.  Pairs
    inside a star need no look, so nothing is lost, and near copies of one text are dealt two or three times.
    """
    sizes = settled(sizes.withColumn("blocks", _blocks("size", "weight")).select(group, "size", "blocks"), "blocks")
    pair = "a BINARY, b BINARY"
    few = rows_of(sizes.filter("blocks = 1")).withColumns({"label": F.col("name"), "x": F.lit(0), "y": F.lit(0)})
    few = few.withColumn("task", F.pmod(F.xxhash64(group), F.lit(tasks)))
    edges = settled(few.groupBy("task").applyInArrow(work, pair), "edges")
    large = sizes.filter("blocks > 1")
    if large.isEmpty():
        return edges
    found, before, seed = edges.limit(0), None, 0
    while True:
        labels = connected_components(found).select(F.col("node").alias("name"), F.col("component").alias("label"))
        labels = settled(labels, "labels")

        def labelled(some: DataFrame) -> DataFrame:
            return rows_of(some).join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))

        stars = labelled(large).groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
        of_group = settled(stars, "stars").groupBy(group).agg(
            F.max(F.struct("n", "label", "w")).alias("top"), F.sum("n").alias("size"), F.sum("w").alias("w")
        ).select(
            group, "size", F.col("top.label").alias("top"), _blocks("size", "w").alias("blocks"),
            (F.col("size") - F.col("top.n")).alias("rest"), (F.col("w") - F.col("top.w")).alias("rest_w"),
        ).filter("rest > 0")
        open_ = settled(of_group.withColumn("rest_blocks", _blocks("rest", "rest_w")), "open")
        rest, most = open_.agg(F.coalesce(F.sum("rest"), F.lit(0)), F.coalesce(F.max("rest_blocks"), F.lit(0))).first()
        if rest == 0:
            break
        rows = labelled(open_).withColumn("in_rest", F.col("label") != F.col("top"))
        last = before is not None and (most <= 1 or 2 * rest > before)
        if last:
            dealt = _rest_with_all(rows)
        else:
            drawn = [F.min(F.struct(F.xxhash64("name", F.lit(seed * HUBS + n)), "name"))["name"] for n in range(HUBS)]
            hubs = rows.filter("in_rest").groupBy(group).agg(F.array_distinct(F.array(*drawn)).alias("hubs"))
            dealt = _near_hubs(rows, settled(hubs.select(group, F.explode("hubs").alias("name")), "hubs"), group, seed)
        dealt = dealt.drop("size", "blocks", "top", "rest", "rest_w", "rest_blocks", "in_rest")
        new = dealt.groupBy(F.xxhash64(group, "x", "y").alias("task")).applyInArrow(work, pair)
        found = settled(found.unionByName(new), "edges")
        if last:
            break
        before, seed = rest, seed + 1
    return edges.unionByName(found)


def _tasks(weight: int) -> int:
    """Tasks for small groups, some tens of thousands of rows or shingles each."""
    return max(1, int(weight // BLOCK_SHINGLES) + 1)


def near_duplicates(
    docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``row``, ``n_shingles``, ``component_id`` and ``first``.

    Two documents are linked when their shingle sets, of ``width`` words, share at least ``percent`` per cent of
    their union, and a component is what links connect; ``component_id`` is its smallest id and ``first`` tells
    the one row that stands for it.  ``row`` numbers the rows, by ``row_col`` if that holds distinct numbers already.

    Equal sets are one class from the start, so copies are no pairs.  Classes that share a band of their sketches
    are candidates if the whole sketch allows the similarity; connected candidates are compared on full sets, in
    blocks of bounded size, except where they are connected already (see ``_links``).  A link is missed if no band is shared, which
    happens to 3 in 10^7 pairs of 80 per cent, or if the sketch is 7.5 standard deviations off.

    A very long text is one row and one sketch; its set is compared whole.
    A text without words has no shingles and is a component of its own, named by its id.  Null ids are never the
    smallest unless all are null; repeated rows are in one component, of which one row is first; an empty table
    gives an empty result; extra columns are not read.
    """
    text = F.col(text_col)
    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col).cast("long")
    source = docs.select(F.col(id_col).alias("key"), text.alias("text"), number.alias("row"))
    kind = source.schema["key"].dataType.simpleString()
    hashed = source.withColumn("text_hash", F.md5(F.coalesce("text", F.lit(""))))
    schema = f"row BIGINT, key {kind}, text_hash STRING, n BIGINT, name BINARY, sketch BINARY, bands ARRAY<BIGINT>"
    rows = settled(hashed.mapInArrow(partial(_sketch, width=width), schema), "sketches")
    least = fewest_equal(percent / 100)

    smallest = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row", "text_hash")).alias("of")
    full = rows.filter("n > 0")
    classes = settled(
        full.groupBy("name").agg(F.count(F.lit(1)).alias("copies"), smallest, F.first("n").alias("n"),
                                 F.first("sketch").alias("sketch"), F.first("bands").alias("bands")),
        "classes",
    )
    # Buckets of two classes and more, and their members; sketches are fetched for those only.
    banded = classes.select("name", F.explode("bands").alias("bucket"))
    buckets = settled(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    member_rows = buckets.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sketch_of = classes.select("name", "sketch")

    def members(some: DataFrame) -> DataFrame:
        return join_groups(banded, some, ["bucket"], "size", member_rows, merge=True).join(sketch_of, "name")

    sized = buckets.withColumn("weight", F.lit(0))
    found = _links(members, sized, "bucket", F.lit(0), _tasks(100 * member_rows), lambda t: _candidates(t, least))
    groups = settled(connected_components(settled(found.distinct(), "candidates")).withColumnRenamed("node", "name"), "groups")

    # The full sets of candidates, from the text of one row of each class.
    wanted = groups.join(classes.select("name", "n", "sketch", "of"), "name")
    wanted = wanted.select("name", "component", "n", "sketch", F.col("of.key").alias("w_key"), F.col("of.text_hash").alias("w_hash"))
    texts = hashed.select("key", "text_hash", "text").join(
        wanted, F.col("key").eqNullSafe(F.col("w_key")) & (F.col("text_hash") == F.col("w_hash"))
    )
    texts = texts.groupBy("name").agg(*(F.first(c).alias(c) for c in ("component", "n", "sketch", "text")))
    sets = settled(
        texts.select("name", "component", "n", "sketch", "text").mapInArrow(
            partial(_sets, width=width), "name BINARY, component BINARY, n BIGINT, sketch BINARY, shingles ARRAY<BIGINT>"
        ),
        "sets",
    )
    sized = settled(sets.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")), "sizes")
    counted = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()

    def of_component(some: DataFrame) -> DataFrame:
        return join_groups(sets, some, ["component"], "size", counted[0], merge=True)

    links = _links(of_component, sized, "component", F.col("n"), _tasks(2 * counted[1]), lambda t: _verified(t, least, percent))
    linked = settled(connected_components(settled(links.distinct(), "links")).withColumnRenamed("node", "name"), "linked")

    # The smallest id of each component, for each of its classes.
    named = classes.select("name", "copies", "of").join(linked, "name", "left")
    named = named.withColumn("component", F.coalesce("component", "name"))
    tops = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("of").alias("top"))
    told = join_groups(named, settled(tops, "tops"), ["component"], "size", classes.count())
    told = settled(told.select("name", "copies", "top"), "named")
    slim = rows.select("row", "key", "n", "name")
    done = join_groups(slim.filter("n > 0"), told, ["name"], "copies", full.count())
    done = done.select("key", "row", "n", F.col("top.key").alias("component_id"), (F.col("row") == F.col("top.row")).alias("first"))
    alone = slim.filter("n = 0").select("key", "row", "n", F.col("key").alias("component_id"), F.lit(True).alias("first"))
    return done.unionByName(alone).select(
        F.col("key").alias(id_col), "row", F.col("n").alias("n_shingles"), "component_id", "first"
    )


def _sets(batches, width: int):
    for batch in batches:
        for rows in slices(batch, "text", PART_BYTES):
            shingles, sizes = shingle_sets(rows.column("text"), width)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns = {c: rows.column(c) for c in rows.schema.names if c != "text"}
            columns["shingles"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_pydict(columns)
