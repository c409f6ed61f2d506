"""Exact deduplication: groups of one 128-bit content hash, bytes compared inside groups, one stable id stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from keysift.llm.shared import join_groups, settled

BROADCAST_HASHES = 200_000


def _first(keep: str) -> Column:
    """The row that stays.  A null id comes after all others; the row number parts repeated rows."""
    if keep == "smallest":
        return F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    best = F.max(F.struct(F.col("key").isNotNull().alias("some"), "key", (-F.col("row")).alias("back")))
    return F.struct(best["key"].alias("key"), (-best["back"]).alias("row"))


def _clashes(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Hashes that stand for more than one text.

    The text is part of the grouping key, so bytes are compared in the task that reads them and a group of copies
    crosses the network once per task.  Texts whose hash occurs once have nothing to be compared with; they are
    left out before the shuffle where the repeated hashes are few enough to broadcast.
    """
    if repeated.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        texts = texts.join(F.broadcast(repeated), "hash", "left_semi")
    same = texts.groupBy("hash", "text").agg(F.count(F.lit(1)).alias("n"))
    return same.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("hash")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    keep: str = "smallest",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``n_bytes``.

    Two texts are equal when their normalised UTF-8 bytes are.  Of equal texts the row with the smallest id stays,
    or the one with the largest (``keep="largest"``).  Null text counts as empty.  A null id is outranked by any other; repeated rows
    with the same id are told apart by a row number, so exactly one row of each group is kept.  An empty table
    gives an empty result, and other columns, whatever their names, are not read.
    """
    texts = docs.select(F.col(id_col).alias("key"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    texts = texts.withColumn("hash", content_hash(F.col("text")))

    def fingerprints(rows: DataFrame) -> DataFrame:
        return settled(
            rows.select(
                F.monotonically_increasing_id().alias("row"), "key", "hash",
                F.sha2("text", 256).alias("text_sha256"), F.octet_length("text").cast("long").alias("n_bytes"),
            ),
            "fingerprints",
        )

    def grouped(prints: DataFrame) -> DataFrame:
        return settled(
            prints.groupBy("hash").agg(F.count(F.lit(1)).alias("group_size"), _first(keep).alias("first")), "groups"
        )

    prints = fingerprints(texts)
    groups = grouped(prints)
    clashes = settled(_clashes(texts, groups.filter("group_size > 1").select("hash")), "clashes")
    if not clashes.isEmpty():
        # A hash that stands for several texts is told apart by the text itself.
        told = texts.join(clashes.withColumn("clash", F.lit(True)), "hash", "left")
        prints = fingerprints(told.withColumn("hash", F.when(F.col("clash"), F.concat("hash", "text")).otherwise(F.col("hash"))))
        groups = grouped(prints)
    joined = join_groups(prints, groups, ["hash"], "group_size", prints.count())
    return joined.select(
        F.col("key").alias(id_col),
        F.col("first.key").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
        "n_bytes",
    )
