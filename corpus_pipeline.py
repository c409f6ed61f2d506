"""A training corpus from raw documents: judge, cut boilerplate, drop near copies, cut benchmark passages, pack.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's input.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from keysift.llm.decontaminate import decontaminate
from keysift.llm.lines import line_dedup
from keysift.llm.near import near_duplicates
from keysift.llm.packing import pack
from keysift.llm.quality import classify_quality
from keysift.llm.queries import tokenizer_path
from keysift.llm.shared import quoted, settled, table


def _same_columns(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the count of characters of the text as it is now."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*map(quoted, docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    judged = classify_quality(docs).filter("accepted")
    return judged.select(*map(quoted, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; one that had text and is left without any goes."""
    cut = line_dedup(docs)
    emptied = (F.col("n_cut") > 0) & (F.trim("text", F.lit(" \t\r\n")) == "")
    return _same_columns(cut.filter(~emptied), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, at 80 per cent."""
    # Which row stands for its group is told by row number, so the rows are numbered and written once.
    rows = settled(docs.withColumn("near_row", F.monotonically_increasing_id()), "rows")
    first = near_duplicates(rows, percent=80, id_col="doc_id", row_col="near_row").filter("first").select("row")
    kept = rows.join(first.withColumnRenamed("row", "near_row"), "near_row", "left_semi")
    return kept.select(*map(quoted, docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark cut out; one that had text and is left without words goes."""
    cut = decontaminate(docs, table(spark, sf_dir, "benchmark"), cleaned=True)
    return _same_columns(cut.filter(~((F.col("n_hit") > 0) & (F.col("n_hit") == F.col("n_words")))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and offset of every piece of every document that is left."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near", near),
    ("benchmark", benchmark),
    ("packing", packing),
]

# SQL cannot express the classifier's training, the tokenizer and the plan of the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
