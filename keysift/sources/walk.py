"""The listing of a tree, and reading what it lists, with an account of what could not be listed or read.

Spark's file sources skip every path with a part that starts with ``_`` or ``.``: ``__init__.py``, ``.npmrc``,
``_config.yml``.  An audit must see those, and must not lose a file in silence.  So a tree is listed once, one job
per depth, excluded folders are never listed, and files are read in tasks from that list, through ``pyarrow.fs``.
Storage that only Spark reaches is read by Spark's own source, without such files, with a warning.
"""

from __future__ import annotations

import os
import re
import time
import warnings
from functools import reduce
from typing import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keysift.plans.settle import settle

CHUNK_BYTES = 8 << 20
TASK_BYTES = 128 << 20  # of files for one task to read, about
ATTEMPTS = 3
_NAMES = {"s3a": "s3", "s3n": "s3"}  # Hadoop's names of storage that pyarrow calls otherwise
_LASTING = (FileNotFoundError, PermissionError, NotADirectoryError, IsADirectoryError)
LISTING = "path STRING, length BIGINT, is_dir BOOLEAN, is_link BOOLEAN, reason STRING"


def open_root(root: str):
    """The file system of a root as Spark writes it, unencoded, and the root's path there."""
    from pyarrow import fs

    if root.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", root)
    scheme, rest = root.split(":", 1)
    return fs.FileSystem.from_uri(quote(f"{_NAMES.get(scheme, scheme)}:{rest}", safe=":/@"))


def reachable(root: str) -> bool:
    """Whether ``pyarrow.fs`` reaches the root."""
    try:
        system, base = open_root(root)
        system.get_file_info(base)
    except (OSError, ValueError, NotImplementedError) as error:
        warnings.warn(f"hidden and empty files under {root} are left out: {error}", stacklevel=2)
        return False
    return True


def attempt(action: Callable):
    """What ``action`` returns, and why it failed if it did; a fault of the storage that may pass is tried again."""
    for turn in range(1, ATTEMPTS + 1):
        try:
            return action(), None
        except OSError as error:
            if turn == ATTEMPTS or isinstance(error, _LASTING):
                return None, f"{type(error).__name__}: {error}"
            time.sleep(0.2 * turn)


def _lister(root: str):
    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = open_root(root)
        local = isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for below in batch["path"]:
                folder = f"{base}/{below}".rstrip("/") or "/"
                infos, reason = attempt(lambda: system.get_file_info(fs.FileSelector(folder)))
                rows = [] if reason is None else [(below, 0, True, False, reason)]
                for info in infos or ():
                    is_dir = info.type == fs.FileType.Directory
                    linked = is_dir and local and os.path.islink(info.path)
                    rows.append((f"{below}/{info.base_name}".lstrip("/"), info.size or 0, is_dir, linked, None))
                yield pd.DataFrame(rows, columns=["path", "length", "is_dir", "is_link", "reason"])

    return entries


def walk(
    spark: SparkSession, root: str, descend: Callable[[Column], Column], keep: Callable[[Column], Column],
    written: list[str] | None = None,
) -> DataFrame:
    """``(path, length, reason)`` of the files under ``root`` that are kept; a folder that could not be listed has a reason.

    ``descend`` says of a folder's path whether to look into it, ``keep`` of a file's path whether to take it.
    Linked folders are not looked into.
    """
    found, level = [], spark.createDataFrame([("",)], "path STRING")
    while True:
        entries = _spread(level).mapInPandas(_lister(root), LISTING)
        entries = settle(entries.filter(F.col("is_dir") | keep(F.col("path"))), "walk", written)
        found.append(entries)
        level = entries.filter(
            F.col("is_dir") & ~F.col("is_link") & F.col("reason").isNull() & descend(F.col("path"))
        ).select("path")
        if level.isEmpty():
            every = reduce(DataFrame.unionAll, found)
            return every.filter(~F.col("is_dir") | F.col("reason").isNotNull()).select("path", "length", "reason")


def _spread(paths: DataFrame, size: int = 0) -> DataFrame:
    """Rows dealt out to as many tasks as there are cores, or as ``size`` bytes ask for."""
    cores = paths.sparkSession.sparkContext.defaultParallelism
    return paths.repartition(max(cores, -(-size // TASK_BYTES)))


def _reader(root: str):
    def content(system, path: str, length: int) -> pa.Buffer:
        with system.open_input_stream(path) as stream:
            parts = [stream.read_buffer(length + 1)]
            while parts[-1].size:
                parts.append(stream.read_buffer(CHUNK_BYTES))
        return parts[0] if len(parts) <= 2 else pa.py_buffer(b"".join(parts))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_root(root)
        rows, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                data, reason = attempt(lambda: content(system, f"{base}/{row['path']}", row["length"]))
                if data is not None and data.size >= CHUNK_BYTES and rows:
                    yield _contents(rows)
                    rows, size = [], 0
                rows.append({**row, "content": data, "reason": reason})
                size += 0 if data is None else data.size
                data = None
                if size >= CHUNK_BYTES:
                    made, rows, size = _contents(rows), [], 0
                    yield made
                    del made  # before the next file is read
        if rows:
            yield _contents(rows)

    return contents


def _contents(rows: list[dict]) -> pa.RecordBatch:
    """Rows as a batch; the content of a single row is not copied."""
    kinds = {"path": pa.string(), "length": pa.int64(), "content": pa.binary(), "reason": pa.string()}
    columns = {c: [row[c] for row in rows] for c in kinds}
    if len(rows) == 1 and rows[0]["content"] is not None:
        data = rows[0]["content"]
        ends = pa.py_buffer(np.array([0, data.size], np.int32))
        columns["content"] = pa.Array.from_buffers(pa.binary(), 1, [None, ends, data])
    else:
        columns["content"] = [data if data is None else data.to_pybytes() for data in columns["content"]]
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, kinds[c]) for c, x in columns.items()], list(kinds)
    )


def read_whole(files: DataFrame, root: str) -> DataFrame:
    """``(path, length, content, reason)`` of ``files(path, length)`` below the root.

    A file that cannot be read has a row with null content and the reason.
    """
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return _spread(files.select("path", "length"), size).mapInArrow(
        _reader(root), "path STRING, length BIGINT, content BINARY, reason STRING"
    )
