"""The prefix trie of conversations: balanced parentheses for each shard, searched by range minima of the excess."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from keysift.llm.shared import join_groups, settled

CODE_BYTES = 16
SEGMENT_TURNS = 256
SHARD_TURNS = 500_000
ROOT_KEY = b"root"
_SUMS = ("n_convs", "n_children", "n_leaves", "repeated", "distinct")
_NODES = pa.schema(
    [
        ("kind", pa.int8()), ("key", pa.binary()), ("above", pa.binary()), ("conv", pa.int64()), ("depth", pa.int64()),
        ("parent", pa.int64()), *((c, pa.int64()) for c in _SUMS), ("ends", pa.string()), ("ends_sha256", pa.string()),
        ("part", pa.int32()), ("shard", pa.int32()), ("seg", pa.int64()), ("root", pa.binary()),
        ("first", pa.binary()), ("last", pa.binary()), ("bytes", pa.list_(pa.int64())),
    ]
)
_NODE_DDL = (
    "kind BYTE, key BINARY, above BINARY, conv BIGINT, depth BIGINT, parent BIGINT, n_convs BIGINT, n_children BIGINT, "
    "n_leaves BIGINT, repeated BIGINT, distinct BIGINT, ends STRING, ends_sha256 STRING, part INT, shard INT, seg BIGINT, "
    "root BINARY, first BINARY, last BINARY, bytes ARRAY<BIGINT>"
)
NODE, SPINE, EDGE = 0, 1, 2


class Parentheses:
    """A forest as balanced parentheses: one bit opens a node, another closes it, children in between.

    The excess of opened over closed nodes falls below a node's own only where it is closed, so the end of a
    subtree is found by the minima of blocks of the excess, held as a tree.
    """

    BLOCK = 64

    def __init__(self, depths: np.ndarray):
        """``depths`` of the nodes in the order they are opened, roots 0."""
        n = len(depths)
        # Before a node is opened, all nodes of its depth and deeper are closed.
        closed = np.concatenate([[0], np.maximum(depths[:-1] - depths[1:] + 1, 0)]) if n else depths
        self.opens = np.arange(n) + np.cumsum(closed)
        self.bits = np.zeros(2 * n, bool)
        self.bits[self.opens] = True
        self.excess = np.cumsum(np.where(self.bits, 1, -1))
        blocks = -(-2 * n // self.BLOCK)
        self.leaves = 1 << max(0, blocks - 1).bit_length()
        whole = np.full(self.leaves * self.BLOCK, 2 * n + 1, np.int64)
        whole[: 2 * n] = self.excess
        self.rows = whole.reshape(self.leaves, self.BLOCK)
        self.minima = np.full(2 * self.leaves, 2 * n + 1, np.int64)
        self.minima[self.leaves :] = self.rows.min(axis=1)
        low = self.leaves
        while low > 1:
            self.minima[low // 2 : low] = self.minima[low : 2 * low].reshape(-1, 2).min(axis=1)
            low //= 2
        pair = self.bits[:-1] & ~self.bits[1:] if n else self.bits
        self.pairs = np.concatenate([[0], np.cumsum(pair), [pair.sum()]]) if n else np.zeros(1, np.int64)

    def find_close(self, spots: np.ndarray) -> np.ndarray:
        """Where the nodes opened at ``spots`` are closed."""
        out = np.empty(len(spots), np.int64)
        for start in range(0, len(spots), 1 << 16):
            out[start : start + (1 << 16)] = self._find_close(spots[start : start + (1 << 16)])
        return out

    def _find_close(self, spots: np.ndarray) -> np.ndarray:
        target = self.excess[spots] - 1
        block = spots // self.BLOCK
        hit = (self.rows[block] <= target[:, None]) & (np.arange(self.BLOCK) > (spots % self.BLOCK)[:, None])
        found = np.where(hit.any(axis=1), block * self.BLOCK + hit.argmax(axis=1), -1)
        far = np.flatnonzero(found < 0)
        node, want = block[far] + self.leaves, target[far]
        up = np.ones(len(far), bool)
        while up.any():  # to the first right neighbour of the way up whose minimum is low enough
            beside = (node % 2 == 0) & (self.minima[np.minimum(node + 1, len(self.minima) - 1)] <= want)
            node = np.where(up & beside, node + 1, np.where(up, node // 2, node))
            up &= ~beside
        while (down := node < self.leaves).any():
            left = 2 * np.where(down, node, 0)
            node = np.where(down, left + (self.minima[left] > want), node)
        hit = self.rows[node - self.leaves] <= want[:, None]
        found[far] = (node - self.leaves) * self.BLOCK + hit.argmax(axis=1)
        return found

    def leaf_pairs(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Childless nodes between, by the rank of an opening that is closed at once."""
        return self.pairs[closes] - self.pairs[opens]


def _shared_turns(a: bytes, b: bytes) -> int:
    most = min(len(a), len(b)) // CODE_BYTES
    left, right = (np.frombuffer(x, np.uint64, 2 * most) for x in (a, b))
    differ = np.flatnonzero(left != right)
    return int(differ[0]) // 2 if len(differ) else most


def _tile_key(root: bytes) -> bytes:
    """Key of the root of the tree of a stretch; that of a later stretch is no node of its own."""
    return b"tile" + root if root else ROOT_KEY


def _path_keys(seg: int, root: bytes, codes: bytes, after: bytes | None) -> list[bytes]:
    """A key for each node of a path, the tree's root first; ``after`` is that of the end of a full segment."""
    keys = [_tile_key(root)]
    path = hashlib.md5(b"%d:" % seg + root)
    for at in range(0, len(codes), CODE_BYTES):
        path.update(codes[at : at + CODE_BYTES])
        keys.append(path.digest())
    return keys if after is None else [*keys[:-1], after]


class _Shard:
    """Segments in order, one after another, as the nodes of a forest with a tree for each tile."""

    def __init__(self, turns: int):
        self.turns = turns  # of a full segment
        self.rows: list[dict] = []
        self.size = 0

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.size += len(row["codes"]) // CODE_BYTES + 1

    def nodes(self, part: int, number: int) -> pa.Table:
        depths: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        parents: list[np.ndarray] = []
        smallest: list[int] = []
        path = np.zeros(self.turns + 1, np.int64)
        low = np.full(self.size, np.iinfo(np.int64).max)
        end = np.zeros(len(self.rows), np.int64)
        tile, before, count = None, b"", 0
        tiles: list[tuple[int, dict]] = []
        for at, row in enumerate(self.rows):
            codes = row["codes"]
            long = len(codes) // CODE_BYTES
            if tile != (row["seg"], row["root"]):
                tile, same = (row["seg"], row["root"]), -1
                tiles.append((count, row))
            else:
                same = _shared_turns(before, codes)
            if same < long:
                new = np.arange(count, count + long - same)
                up = new - 1
                up[0] = path[same] if same >= 0 else -1
                path[same + 1 : long + 1] = new
                depths.append(np.arange(same + 1, long + 1))
                parents.append(up)
                weights = np.asarray(row["bytes"][max(same, 0) :], np.int64)
                sizes.append(weights if same >= 0 else np.append(0, weights))
                count += len(new)
            own = path[: long + 1]
            low[own] = np.minimum(low[own], row["conv"])
            end[at] = path[long]
            before = codes
        depth, parent, size = (np.concatenate(x) for x in (depths, parents, sizes))
        tree = Parentheses(depth)
        close = tree.find_close(tree.opens)
        # Nodes in the order they are opened: a subtree is a stretch of them.
        top = np.arange(count)
        until = top + (close - tree.opens + 1) // 2

        def below(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[until] - total[top]

        extra = {c: np.zeros(count, np.int64) for c in _SUMS[1:]}
        for at, row in enumerate(self.rows):
            if row["more"] is not None:
                for c, value in row["more"].items():
                    extra[c][end[at]] += value
        n_convs = below(np.bincount(end, minlength=count))
        made = {
            "n_convs": n_convs,
            "n_children": np.bincount(parent[parent >= 0], minlength=count) + extra["n_children"],
            "n_leaves": tree.leaf_pairs(tree.opens, close) + below(extra["n_leaves"]),
            "repeated": below(n_convs * size + extra["repeated"]),
            "distinct": below(size + extra["distinct"]),
        }
        return self._table(part, number, tiles, depth, parent, low[:count], end, made)

    def _table(self, part, number, tiles, depth, parent, low, end, made) -> pa.Table:
        count = len(depth)
        tile = np.searchsorted([at for at, _ in tiles], np.arange(count), side="right") - 1
        level = np.array([row["seg"] for _, row in tiles])[tile]
        keys: list[bytes | None] = [None] * count
        # Nodes other shards may hold too: those on the first and the last path.
        for row, at in ((self.rows[0], end[0]), (self.rows[-1], end[-1])):
            names = _path_keys(row["seg"], row["root"], row["codes"], row["after"])
            for name in reversed(names):
                keys[at] = name
                at = parent[at]
        for at, row in tiles:
            keys[at] = _tile_key(row["root"])
        full = np.flatnonzero(depth == self.turns)
        after = {int(at): row["after"] for at, row in zip(end, self.rows) if row["after"] is not None}
        for at in full.tolist():  # such a node is the root of a tile of later turns
            keys[at] = after[at]
        hung = list(keys)
        for at, row in tiles:  # whose node is the end of the segment before
            hung[at] = row["root"] or ROOT_KEY
        above = [hung[up] if up >= 0 else None for up in parent.tolist()]
        above_conv = np.where(parent >= 0, low[parent], -1)
        ends: list[list[int]] = [[] for _ in range(count)]
        for at, row in zip(end.tolist(), self.rows):
            if row["final"]:
                ends[at].append(row["conv"])
        texts = [",".join(map(str, found)) for found in ends]
        shown = [t if k is not None and t else None for t, k in zip(texts, keys)]
        digests = [None if k is not None else hashlib.sha256(t.encode()).hexdigest() for t, k in zip(texts, keys)]
        nothing = pa.nulls(count)
        columns = {
            "kind": np.array([NODE if k is None else SPINE for k in keys], np.int8), "key": pa.array(keys, pa.binary()),
            "above": pa.array(above, pa.binary()), "conv": low, "depth": depth + level * self.turns,
            "parent": pa.array(above_conv, mask=(parent < 0) | np.array([a is not None for a in above], bool)), **made,
            "ends": pa.array(shown, pa.string()), "ends_sha256": pa.array(digests, pa.string()),
            "part": np.full(count, part, np.int32), "shard": np.full(count, number, np.int32), "seg": level,
        }
        table = pa.table({f.name: columns.get(f.name, nothing) for f in _NODES}).cast(_NODES)
        first, last = self.rows[0], self.rows[-1]
        edge = {"kind": EDGE, "part": part, "shard": number, "seg": first["seg"], "root": first["root"], "first": first["codes"],
                "above": first["after"], "bytes": first["bytes"], "depth": last["seg"], "key": last["root"], "last": last["codes"]}
        return pa.concat_tables([table, pa.Table.from_pylist([{f.name: edge.get(f.name) for f in _NODES}], schema=_NODES)])


def _shards(turns: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, shard = TaskContext.get().partitionId(), 0, _Shard(turns)
        for batch in batches:
            for row in batch.to_pylist():
                if shard.size >= most:
                    yield from shard.nodes(part, number).to_batches(max_chunksize=50_000)
                    number, shard = number + 1, _Shard(turns)
                shard.add(row)
        if shard.rows:
            yield from shard.nodes(part, number).to_batches(max_chunksize=50_000)

    return run


def _overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What two neighbouring shards count twice, for each node they share."""
    for batch in batches:
        for row in batch.itertuples():
            same = _shared_turns(row.last, row.first)
            weights = np.concatenate([[0], np.asarray(row.bytes, np.int64)[:same]])
            twice = np.cumsum(weights[::-1])[::-1]
            whole = row.after is not None and len(row.first) // CODE_BYTES == same
            leaf = len(row.last) // CODE_BYTES == same  # closed in one shard, gone on with in the next
            yield pd.DataFrame(
                {"key": _path_keys(row.seg, row.root, row.first[: same * CODE_BYTES], row.after if whole else None), "n_children": [-1] * same + [0],
                 "n_leaves": -int(leaf), "distinct": -twice}
            )


def _digest_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each key, which come in order, joined by commas."""
    key, digest = None, None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = row["key"], hashlib.sha256(row["ends"].encode())
            else:
                digest.update(b"," + row["ends"].encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())],
                                         ["key", "digest"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "digest"])


def _merged(nodes: DataFrame) -> DataFrame:
    """Nodes on the spines of shards, once each, without what several shards count of them."""
    edges = nodes.filter(F.col("kind") == EDGE).select(
        "part", "shard", "seg", "root", "first", "bytes", F.col("above").alias("after"), F.col("depth").alias("last_seg"), F.col("key").alias("last_root"), "last"
    )
    # One row for each task that had rows: where its shards stand among all.
    counts = edges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for row in counts:
        starts.append((row["part"], total))
        total += row["n"]
    spark = nodes.sparkSession
    placed = edges.join(F.broadcast(spark.createDataFrame(starts, "part INT, start BIGINT")), "part")
    placed = placed.withColumn("place", F.col("start") + F.col("shard"))
    left = placed.select((F.col("place") + 1).alias("place"), F.col("last_seg").alias("seg"), F.col("last_root").alias("root"), "last")
    pairs = left.join(placed.select("place", "seg", "root", "first", "bytes", "after"), ["place", "seg", "root"])
    twice = pairs.select("seg", "root", "last", "first", "bytes", "after").mapInPandas(
        _overlaps, "key BINARY, n_children BIGINT, n_leaves BIGINT, distinct BIGINT"
    )
    spine = nodes.filter(F.col("kind") == SPINE)
    sums = spine.select("key", "above", "conv", "depth", "parent", *_SUMS).unionByName(twice, allowMissingColumns=True)
    merged = sums.groupBy("key").agg(
        F.min("above").alias("above"), F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS),
    )
    # Chunks of one node's ends follow each other as its shards do.  A digest is one pass by its nature; it holds one chunk.
    chunks = spine.filter(F.col("ends").isNotNull()).select("key", "part", "shard", "ends")
    chunks = chunks.repartition("key").sortWithinPartitions("key", "part", "shard").select("key", "ends")
    digests = chunks.mapInArrow(_digest_chunks, "key BINARY, digest STRING")
    merged = merged.join(digests, "key", "left")
    return merged.withColumn("ends_sha256", F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256))).drop("digest")


def _tries(segments: DataFrame, turns: int, most: int, label: str) -> DataFrame:
    """Nodes of the shards of ``segments``, which are put in order first."""
    ordered = segments.repartitionByRange("seg", "root", "codes", "conv").sortWithinPartitions("seg", "root", "codes", "conv")
    return settled(ordered.mapInArrow(_shards(turns, most), _NODE_DDL), label)


def _numbered(turns: DataFrame) -> DataFrame:
    """``turns(conv, turn, code, size)`` with ``pos`` from 0 in each conversation, however long one is.

    Turns are dealt out in order by range, so a long conversation is work for many tasks; a turn's place is that in
    its task plus those of the conversation in the tasks before.
    """
    ranged = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv", F.col("turn").asc_nulls_first(), "code", "tie")
    ranged = settled(ranged.withColumn("part", F.spark_partition_id()), "turns")
    own = Window.partitionBy("part", "conv").orderBy(F.col("turn").asc_nulls_first(), "code", "tie")
    rows = ranged.withColumn("own", F.row_number().over(own) - 1)
    counts = settled(ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    several = counts.groupBy("conv").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("conv")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A task shares a conversation with the task before and the one after at most, so these are two rows a task.
    starts = counts.join(several, "conv").select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.join(F.broadcast(starts), ["conv", "part"], "left")
    return rows.select("conv", "code", "size", (F.col("own") + F.coalesce("before", F.lit(0))).alias("pos"))


def rebuilt_turns(turns: DataFrame, base: Column, head: Column, most_head: int) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv, depth, code, size)`` of conversations that start as another one does, and all ``conv``.

    ``base`` and ``head`` are of the column ``conv``: a conversation takes the first ``head`` turns, ``most_head`` at
    most, of ``base`` instead of its own first ``head``.
    """
    rows = settled(_numbered(turns), "numbered")
    convs = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    heads = rows.filter(F.col("pos") < most_head).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("pos", "code", "size"))).alias("lead")
    )
    asked = convs.select("conv", "n", base.alias("base"), head.alias("head"))
    asked = asked.join(heads.withColumnRenamed("conv", "base"), "base", "left")
    lead = F.slice(F.coalesce("lead", F.array().cast(heads.schema["lead"].dataType)), F.lit(1), F.col("head"))
    asked = settled(asked.select("conv", "n", "head", lead.alias("lead")), "heads")
    moved = asked.select("conv", "n", "head", F.size("lead").alias("led"))
    own = join_groups(rows, moved, ["conv"], "n", rows.count()).filter(F.col("pos") >= F.col("head"))
    own = own.select("conv", (F.col("pos") - F.col("head") + F.col("led")).alias("depth"), "code", "size")
    led = asked.select("conv", F.posexplode("lead").alias("depth", "turn"))
    led = led.select("conv", F.col("depth").cast("bigint").alias("depth"), "turn.code", "turn.size")
    return own.unionByName(led), asked.select("conv")


def _segments(turns: DataFrame, convs: DataFrame, long: int) -> DataFrame:
    """Stretches of ``long`` turns, with the key of all turns before (``root``) and, where full, up to their end (``after``)."""
    cut = turns.groupBy("conv", F.floor(F.col("depth") / long).alias("seg")).agg(
        F.array_sort(F.collect_list(F.struct("depth", "code", "size"))).alias("turns")
    )
    cut = cut.select(
        "conv", "seg", F.unhex(F.array_join(F.transform("turns", lambda t: t["code"]), "")).alias("codes"),
        F.transform("turns", lambda t: t["size"].cast("bigint")).alias("bytes"),
    )
    empty = convs.join(cut.filter("seg = 0").select("conv"), "conv", "left_anti")
    empty = empty.select("conv", F.lit(0).cast("bigint").alias("seg"), F.lit(b"").alias("codes"), F.array().cast("array<bigint>").alias("bytes"))
    cut = settled(cut.unionByName(empty), "segments")
    # Keys of prefixes: each segment is known by its number and digest, a prefix by the sum of its segments'.
    full = F.octet_length("codes") == long * CODE_BYTES
    halves = [F.xxhash64(F.lit(k), "seg", F.md5("codes")) for k in (1, 2)]
    slim = cut.filter(full).select("conv", "seg", *(h.alias(f"h{k}") for k, h in enumerate(halves)))
    so_far = Window.partitionBy("conv").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    names = slim.select(
        "conv", "seg",
        F.unhex(F.concat(*(F.lpad(F.hex(F.expr(f"bit_xor(h{k})").over(so_far)), 16, "0") for k in (0, 1)), F.lpad(F.hex("seg"), 16, "0"))).alias("after"),
    )
    names = settled(names, "prefixes")
    cut = cut.join(names.withColumnRenamed("after", "own"), ["conv", "seg"], "left")
    before = names.select("conv", (F.col("seg") + 1).alias("seg"), F.col("after").alias("root"))
    cut = cut.join(before, ["conv", "seg"], "left").withColumn("root", F.coalesce("root", F.lit(b"")))
    goes_on = before.join(cut.select("conv", "seg"), ["conv", "seg"], "left_semi").select("conv", (F.col("seg") - 1).alias("seg"), F.lit(False).alias("final"))
    cut = cut.join(goes_on, ["conv", "seg"], "left")
    return cut.select("conv", "seg", "root", "codes", "bytes", F.col("own").alias("after"), F.coalesce("final", F.lit(True)).alias("final"))


def _is_tile() -> Column:
    """Whether a node is the root of a tree of later turns, which stands for the end of the segment before."""
    return F.startswith("key", F.lit(b"tile"))


_MORE = "struct<n_children: bigint, n_leaves: bigint, repeated: bigint, distinct: bigint>"


def _with_later_tiles(segments: DataFrame, turns: int, most: int) -> DataFrame:
    """``segments`` with ``more``: what trees of later turns add to the node where a segment ends.

    Such a tree counts once, at its smallest conversation, and at the ends of all earlier segments of that one.
    """
    tiles = _merged(_tries(segments.filter("seg > 0").withColumn("more", F.lit(None).cast(_MORE)), turns, most, "tiles"))
    tiles = tiles.filter(_is_tile()).select(
        "conv", F.floor(F.col("depth") / turns).alias("seg"), "n_children", (F.col("n_leaves") - 1).alias("n_leaves"), "repeated", "distinct"
    )
    several = segments.filter("seg > 0").select("conv").distinct()
    rows = segments.join(several, "conv", "left_semi").select("conv", "seg").join(tiles, ["conv", "seg"], "left")
    later = Window.partitionBy("conv").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("conv").orderBy(F.col("seg").desc())
    summed = (F.coalesce(F.sum(c).over(later), F.lit(0)).alias(c) for c in ("n_leaves", "repeated", "distinct"))
    more = F.struct(F.coalesce(F.lag("n_children").over(last), F.lit(0)).alias("n_children"), *summed).cast(_MORE)
    return segments.join(rows.select("conv", "seg", more.alias("more")), ["conv", "seg"], "left")


def prefix_trie(
    turns: DataFrame, convs: DataFrame, segment_turns: int = SEGMENT_TURNS, shard_turns: int = SHARD_TURNS
) -> DataFrame:
    """Nodes of the trie of ``turns(conv, depth, code, size)``: which turns conversations share from their start on.

    ``depth`` counts a conversation's turns from 0, ``code`` is an MD5 in hex that stands for a turn and ``size`` is what
    it costs; ``convs(conv)`` names all conversations, also those without turns.  Each row is a distinct sequence of
    first turns: ``conv_id`` (its smallest conversation), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved`` (cost of what the subtree holds more than once) and ``ends_sha256`` (digest of the
    conversations that end there, ascending).  The root is the sequence of no turns.

    Conversations are cut into segments and sorted by their codes.  Each task writes shards of the sorted segments
    as balanced parentheses; a subtree ends where its parenthesis closes, its leaves are ranked, and cumulative
    arrays over its stretch give sums.  Two shards next to each other share the start of one path, so sums of nodes
    on the first and last paths are added up and what the shared part was counted twice is taken off.  Trees of
    segments after the first count at the ends of those before.

    Turns are told apart by their codes.  Repeated conversations are members of the same nodes.  No conversations
    give no rows.  A conversation of any length, or a third of all conversations being copies, is work for many tasks:
    only digests of many ends are one pass each, over parts made before.
    """
    segments = settled(_segments(turns, convs, segment_turns), "cut")
    deep = segments.filter("seg > 0").limit(1).count() > 0
    ready = _with_later_tiles(segments, segment_turns, shard_turns) if deep else segments.withColumn("more", F.lit(None).cast(_MORE))
    nodes = _tries(ready, segment_turns, shard_turns, "nodes")
    spine = settled(_merged(nodes), "spine")
    spine = spine.filter(~_is_tile())
    plain = nodes.filter(F.col("kind") == NODE)
    columns = ("above", "conv", "depth", "parent", *_SUMS, "ends_sha256")
    rows = plain.select(*columns).unionByName(spine.select(*columns))
    parents = spine.select(F.col("key").alias("above"), F.col("conv").alias("found"), F.col("n_children").alias("hung"))
    hanging = settled(rows.filter(F.col("above").isNotNull()), "hanging")
    found = join_groups(hanging, parents, ["above"], "hung", hanging.count())
    named = rows.filter(F.col("above").isNull()).withColumn("found", F.col("parent")).unionByName(found.drop("hung").select(*columns, "found"))
    return named.select(
        F.col("conv").alias("conv_id"), "depth", F.col("found").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("repeated") - F.col("distinct")).alias("saved"), "ends_sha256",
    )
