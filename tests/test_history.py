"""Logs read in splits of every size, against one pass in plain Python."""

from __future__ import annotations

import random
import re

import pytest

from keysift.sources.history import PATCH_LOG, STASH_LOG, read_commits, read_log

COLUMNS = ("log_row", "part", "at", "file", "commit", "author", "date", "line")


def plain(text, kind):
    """Added lines and records; a line ends as for str.splitlines, a record only after a newline."""
    lines, records = [], []
    meta, record, part, at, file = kind.unknown, -1, 0, -1, kind.unnamed
    for raw in text.split("\n")[: -1 if text.endswith("\n") else None]:
        pieces = re.split("[\r\x0b\x0c\x1c\x1d\x1e\x85  ]", raw[:-1] if raw.endswith("\r") else raw)
        for n, line in enumerate(p for piece in pieces for p in [piece]):
            at += 1
            if n == 0 and line.startswith(kind.mark):
                record, part, at, file = record + 1, 0, 0, kind.unnamed
                meta = kind.meta(line[len(kind.mark):]) or meta
                records.append((record, *meta))
            elif re.match(kind.header, line):
                part, at = part + 1, 0
                file = re.sub(r'"\s*$', "", line[7:]) if line[4] == '"' else line[6:].strip()
            elif line.startswith("+") and not line.startswith("+++"):
                lines.append((record, part, at, file, *meta, line[1:]))
    return lines, records


def made(draw, size, mark):
    choices = [
        lambda: mark + f"{draw.getrandbits(60):x}|Ann|day {draw.randint(1, 9)}", lambda: mark + "short|one", lambda: mark + "no parts",
        lambda: mark + "stash@{3}: WIP", lambda: "--- a/x.py", lambda: f"+++ b/dir/f{draw.randint(1, 9)}.py\t", lambda: '+++ "b/\\303.py" ',
        lambda: "+added é", lambda: "+", lambda: "+one\x0c+two\r+three", lambda: " same", lambda: "-gone", lambda: "+++ no header",
        lambda: "+crlf\r", lambda: f"+{mark}x|y|z", lambda: f"+a\x0b{mark}p|q|r", lambda: "", lambda: "+++ /dev/null",
    ]
    weights = [3, 1, 1, 1, 3, 4, 1, 8, 1, 1, 4, 3, 1, 1, 1, 1, 1, 1]
    return "\n".join(draw.choices(choices, weights, k=1)[0]() for _ in range(size)) + draw.choice(["", "\n"])


@pytest.fixture
def splits(spark):
    old = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def of(size):
        for key in old:
            spark.conf.set(key, str(size))

    yield of
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("kind", [PATCH_LOG, STASH_LOG], ids=["patch", "stash"])
@pytest.mark.parametrize("size,lines", [(40, 60), (200, 400), (1 << 20, 400)])
def test_splits_of_any_size(spark, tmp_path, splits, kind, size, lines):
    text = made(random.Random(lines + size), lines, kind.mark)
    (tmp_path / "log.txt").write_bytes(text.encode())
    splits(size)
    wanted, records = plain(text, kind)
    found = read_log(spark, str(tmp_path / "log.txt"), kind).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    named = read_commits(spark, str(tmp_path / "log.txt"), kind).select("log_row", "commit", "author", "date").collect()
    assert sorted(map(tuple, named), key=str) == sorted(records, key=str)


def test_one_commit_is_work_for_many_tasks(spark, tmp_path, splits):
    body = "\n".join(f"+line {n}" for n in range(20_000))
    (tmp_path / "log.txt").write_text(f"COMMIT:{'ab' * 20}|Ann|today\n\n--- /dev/null\n+++ b/big.py\n{body}\n")
    splits(4096)
    found = read_log(spark, str(tmp_path / "log.txt"))
    assert found.rdd.getNumPartitions() > 40
    rows = found.orderBy("at").collect()
    assert [(r["at"], r["line"]) for r in rows] == [(n + 1, f"line {n}") for n in range(20_000)]
    assert {(r["log_row"], r["part"], r["file"], r["commit"], r["author"]) for r in rows} == {(0, 1, "big.py", "abababab", "Ann")}


def test_a_folder_is_one_log_in_order_of_names(spark, tmp_path):
    text = made(random.Random(11), 200, "COMMIT:").rstrip("\n")
    lines = text.split("\n")
    (tmp_path / "log").mkdir()
    for n, at in enumerate(range(0, 200, 37)):
        (tmp_path / "log" / f"part-{n}").write_text("\n".join(lines[at : at + 37]) + "\n", newline="")
    found = read_log(spark, str(tmp_path / "log")).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=str) == sorted(plain(text, PATCH_LOG)[0], key=str)


def test_an_empty_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("")
    assert read_log(spark, str(tmp_path / "log.txt")).count() == 0 and read_commits(spark, str(tmp_path / "log.txt")).count() == 0
