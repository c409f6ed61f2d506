"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keysift.llm.shared import join_groups, settled

TASK_EDGES = 20_000


def _dealt(rows: DataFrame, edges: int) -> DataFrame:
    """``rows`` in as many tasks as so many edges are worth, however many the session shuffles to."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(4 * cores, -(-edges // TASK_EDGES)))


def _smallest(edges: DataFrame, total: int) -> DataFrame:
    """Edges ``(a, b)`` with ``low``, the smallest of ``a`` and the nodes it has an edge to."""
    lows = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("low"))
    lows = settled(_dealt(lows.withColumn("low", F.least("a", "low")), total), "lows")
    return _dealt(join_groups(edges, lows, ["a"], "n", total), total)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``; a component is named by its smallest node.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest neighbour,
    then its smaller neighbours.  Each round writes its edges to the shared folder, never more of them than there
    were, in tasks of ``TASK_EDGES`` or more, and a node with very many edges is no more work for a task than any other.  Loops name a node without
    linking it; null ends are left out; repeated edges count once; no edges give no components.
    """
    edges = edges.select("a", "b").dropna()
    nodes = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    links = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = settled(links, "edges")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _smallest(both, 2 * state[0]).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = settled(_dealt(large.filter("a != b").distinct(), state[0]), "edges")
        small = _smallest(large, large.count())
        pairs = F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))
        links = settled(_dealt(small.select(F.inline(pairs)).filter("a != b").distinct(), state[0]), "edges")
        before, state = state, _state(links)
        if state == before:
            break
    named = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = nodes.distinct().join(named.unionByName(roots), "node", "left_anti")
    return named.unionByName(roots).unionByName(alone)
