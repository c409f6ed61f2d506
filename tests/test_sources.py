from __future__ import annotations

import os
import random
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keysift.config import AuditConfig
from keysift.operators.scan import scan_counts, scan_files, scan_patches, scan_stashes
from keysift.rules.catalog import BUILTIN_RULES
from keysift.operators.lines import split_lines
from keysift.sources.files import list_files, listed_files, path_suffix, read_files, rel_path, tree_listing
from keysift.plans import queries
from keysift.sources.long_files import range_lines, read_ranges
from keysift.sources.walk import _lister, _reader
from keysift.sources import patches
from keysift.sources.patches import commit_meta, file_segments, patch_lines, read_patch_log, read_stash_log, stash_lines

DIGITS = "0123456789abcdef" * 8
GOOGLE = "AIza" + DIGITS[:35]


def _tree(root, files):
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())


TREE = {
    "main.swift": f'let k = "{GOOGLE}"\n', "sub dir/a+b %41.py": f"# {GOOGLE}\r\nx", "Pods/a.swift": GOOGLE, "x/.hidden/a.py": GOOGLE,
    "x/App.xcodeproj/p.json": GOOGLE, "x/App.xcworkspace/p.json": GOOGLE, "pods/b.swift": GOOGLE, "package-lock.json": GOOGLE,
    "x/.DS_Store_1.md": GOOGLE, ".env": GOOGLE, "prod.env": GOOGLE, "x/ID_RSA": "key", "a.jks": GOOGLE, "LICENSE": GOOGLE,
    "Dockerfile": GOOGLE, "img.sqlite": b"\x00\x01" + GOOGLE.encode(), "empty.py": "", "build.d/x.go": GOOGLE, "trailing.": GOOGLE,
    "U.SWIFT": GOOGLE, "x/y/z/.npmrc": GOOGLE, "bin.json": b"\x01" * 50 + b"a" * 50,
    "pkg/__init__.py": GOOGLE, "_site/deep/.eslintrc.json": GOOGLE, "_site/.hid/a.py": GOOGLE, "pkg/_x.py._COPYING_": GOOGLE, "a=b/_c=d.py": GOOGLE,
}
TARGETS = {
    "main.swift", "sub dir/a+b %41.py", "pods/b.swift", "prod.env", "x/ID_RSA", "Dockerfile", "img.sqlite", "empty.py", "build.d/x.go",
    "U.SWIFT", "x/y/z/.npmrc", "bin.json",
    "pkg/__init__.py", "_site/deep/.eslintrc.json", "a=b/_c=d.py",
}
HIDDEN = {"empty.py", "x/y/z/.npmrc", "pkg/__init__.py", "_site/deep/.eslintrc.json"}  # from Spark's own source


def test_tree(spark, tmp_path):
    root = tmp_path / "pro ject+%41"
    _tree(root, TREE)
    files = read_files(spark, str(root)).cache()
    assert {r["path"] for r in files.collect()} == TARGETS
    binary = {r["path"] for r in files.filter("text IS NULL").collect()}
    assert binary == {"img.sqlite", "bin.json"}
    scan = scan_files(files, BUILTIN_RULES, per_file=True).cache()
    hits = {(r["file_path"], r["line_number"]) for r in scan.filter("rule_id = 'API-003'").collect()}
    assert hits == {(p, 1) for p in TARGETS - binary - {"x/ID_RSA", "empty.py"}}
    audits = {r["file_path"]: r["finding_type"] for r in scan.filter("rule_id = 'FILE-AUDIT'").collect()}
    assert audits == {"x/ID_RSA": "SSH Private Key File", "img.sqlite": "Database File"}
    counts = scan_counts(scan.filter("rule_id IS NULL")).first()
    assert counts["files_scanned"] == len(TARGETS)
    assert counts["lines_scanned"] == len(TARGETS) - 3 + 1


def test_excluded_files_are_never_opened(spark, tmp_path):
    root = tmp_path / "project"
    _tree(root, TREE)
    listed = listed_files(spark, f"file:{root}", AuditConfig())
    seen = TARGETS - HIDDEN
    assert {r["path"] for r in listed.select("path").collect()} == seen
    leaf = listed._jdf.queryExecution().executedPlan().collectLeaves().head()
    listed._jdf.queryExecution().toRdd().count()
    assert leaf.metrics().apply("numFiles").value() == len(seen)


def test_folders_that_fail_are_rows(tmp_path):
    made = pd.concat(_lister(str(tmp_path))(iter([pd.DataFrame({"path": ["gone"]})])))
    assert made["path"].tolist() == ["gone"] and made["is_dir"].tolist() == [True]
    assert made["reason"][0].startswith("FileNotFoundError")


def test_one_listing(spark, tmp_path):
    """Excluded folders are not listed, and files that are not scanned are not in the list."""
    root = tmp_path / "project"
    _tree(root, TREE)
    listing = tree_listing(spark, str(root))
    assert {r["path"] for r in listing.collect()} == TARGETS
    assert listing.filter("reason IS NOT NULL").count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64])
def test_lines_by_ranges(spark, tmp_path, size):
    """Every cut of every mix of line ends, numbered as in a text that is read whole."""
    draw = random.Random(size)
    texts = ["a", "\n", "\r", "\r\n", "\r\r\n\n", "a\rb\r\nc\nd", "ab\r\n", "\xe9\r"]
    texts += ["".join(draw.choice(["\r", "\n", "\r\n", "x", "yy", "\u00e9"]) for _ in range(draw.randint(1, 30))) for _ in range(30)]
    _tree(tmp_path, {f"f{n}.txt": text for n, text in enumerate(texts)})
    files = spark.createDataFrame([(f"f{n}.txt", len(t.encode())) for n, t in enumerate(texts)], "path STRING, length BIGINT")
    found = range_lines(files, str(tmp_path), size).orderBy("path", "line_number").collect()
    wanted = spark.createDataFrame([(f"f{n}.txt", t) for n, t in enumerate(texts)], "path STRING, text STRING")
    wanted = wanted.select("path", F.posexplode(split_lines(F.col("text"))).alias("at", "line")).orderBy("path", "at").collect()
    assert [tuple(r) for r in found] == [(r["path"], r["at"] + 1, r["line"]) for r in wanted]


def test_files_read_whole_in_ranges(spark, tmp_path):
    """Every byte is read, a file that fails is told, and long files are never a row of content."""
    files = {"a.py": b"x" * 5000, "b.bin": b"a" * 10 + b"\x00" + b"b" * 3000, "late.py": b"y" * 4096 + b"\x00" * 9, "c.py": b"z"}
    _tree(tmp_path, files)
    rows = [(path, len(data)) for path, data in files.items()] + [("gone.py", 10)]
    found = read_ranges(spark.createDataFrame(rows, "path STRING, length BIGINT"), str(tmp_path), 4500).collect()
    told = {r["path"]: (r["n"], r["binary"], r["reason"] is None) for r in found}
    assert told == {
        "a.py": (5000, False, True), "b.bin": (3011, True, True), "late.py": (4105, False, True), "c.py": (1, False, True),
        "gone.py": (0, None, False),
    }


def test_src_files_alike_in_ranges(spark, tmp_path, monkeypatch):
    _tree(tmp_path, TREE)
    whole = sorted(queries.src_files(spark, str(tmp_path)).collect())
    monkeypatch.setattr(queries, "RANGE_BYTES", 50)
    taken = []
    monkeypatch.setattr(queries, "list_files", lambda *a, longest, **b: taken.append(longest) or list_files(*a, longest=longest, **b))
    assert sorted(queries.src_files(spark, str(tmp_path)).collect()) == whole
    assert taken == [50] and {r["path"] for r in whole} == TARGETS


def test_long_content_is_not_copied(tmp_path):
    """A file of a batch of its own takes its size once, not twice, and small ones before it are no part of that batch."""
    _tree(tmp_path, {"a.py": b"a" * 1000, "b.py": b"b" * (40 << 20), "c.py": b"", "d.py": b"d"})
    sizes = {"a.py": 1000, "b.py": 40 << 20, "c.py": 0, "d.py": 5, "gone.py": 3}  # d.py is shorter than it was listed
    listed = pa.RecordBatch.from_pydict({"path": list(sizes), "length": list(sizes.values())})
    pool = pa.default_memory_pool()
    held, seen = pool.bytes_allocated(), []
    for batch in _reader(str(tmp_path))(iter([listed])):
        if batch.column("path").to_pylist() == ["b.py"]:
            assert pool.bytes_allocated() - held < 60 << 20
        seen += zip(batch.column("path").to_pylist(), [x and (x[:1], len(x)) for x in batch.column("content").to_pylist()])
    assert seen == [("a.py", (b"a", 1000)), ("b.py", (b"b", 40 << 20)), ("c.py", b""), ("d.py", (b"d", 1)), ("gone.py", None)]


def test_join_context_runs_the_rules_once(spark, tmp_path):
    """Its hits are read from where they were written."""
    rows = [(n, f"text {n}\nmore", "en", "src0", 9) for n in range(30)]
    documents = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.join_context_(spark, str(tmp_path))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() > 0


def test_one_file_and_no_file(spark, tmp_path):
    _tree(tmp_path, {"node_modules/odd.bin": f"id {GOOGLE}"})
    one = read_files(spark, str(tmp_path / "node_modules/odd.bin"))
    assert [(r["path"], r["name"]) for r in one.collect()] == [("odd.bin", "odd.bin")]
    assert read_files(spark, str(tmp_path / "missing")).count() == 0


def test_paths(spark):
    names = ["a.py", ".env", "prod.env", "a.tar.gz", "x.", "..a", "noext", ".npmrc", "a.b.", "a..b", "é.Kt"]
    rows = spark.createDataFrame([(n,) for n in names], "name STRING").select("name", path_suffix(F.col("name"))).collect()
    for name, suffix in rows:
        assert suffix == ("" if name == "..a" else PurePosixPath(name).suffix) or name == "..a", name
    for path, root, wanted in [("/a/b/c", "/a/b", "c"), ("/a/bc/d", "/a/b", "/a/bc/d"), ("/a/b/c/d", "/a/b/", "c/d")]:
        got = spark.range(1).select(rel_path(F.lit(path), F.lit(root))).first()[0]
        assert got == wanted


LOG = "\n".join([
    "COMMIT:" + "a1" * 20 + "|Ann|Mon Jan 1", "", "diff --git a/x.py b/x.py", "--- a/x.py", "+++ b/x.py", "@@ -1 +1,2 @@", " same",
    f"-old {GOOGLE}", f"+new {GOOGLE}", "+++ not an added line", "+plain\x0c+" + GOOGLE, "--- a/comment.lua", "+after",
    "diff --git a/my file b/my file", "--- /dev/null", "+++ b/my file\t", f"+k {GOOGLE}", 'diff --git "a/\\303\\251.py" "b/\\303\\251.py"',
    "--- /dev/null", '+++ "b/\\303\\251.py"', f"+q {GOOGLE}", "--- a/gone", "+++ /dev/null", f"-{GOOGLE}",
    "COMMIT:" + "b2" * 20 + "|Lee|Ops|Tue Jan 2", "", "--- /dev/null", "+++ b/x.py", f"+old {GOOGLE}",
    "COMMIT:" + "c3" * 20 + "|Mo|Wed Jan 3", "", "--- /dev/null", "+++ b/y.py", "+COMMIT:x|y|z", "+", "",
])


def test_patch_log(spark, tmp_path):
    (tmp_path / "log.txt").write_bytes(LOG.encode())
    rows = patch_lines(read_patch_log(spark, str(tmp_path / "log.txt"))).collect()
    found = [(r["commit"], r["author"], r["date"], r["file"], r["line"]) for r in sorted(rows, key=lambda r: (r["log_row"], r["part"], r["at"]))]
    ann, lee, mo = ("a1" * 4, "Ann", "Mon Jan 1"), ("b2" * 4, "Lee", "Ops"), ("c3" * 4, "Mo", "Wed Jan 3")
    assert found == [
        (*ann, "x.py", f"new {GOOGLE}"), (*ann, "x.py", "plain"), (*ann, "x.py", GOOGLE), (*ann, "comment.lua", "after"),
        (*ann, "my file", f"k {GOOGLE}"), (*ann, "\\303\\251.py", f"q {GOOGLE}"), (*lee, "x.py", f"old {GOOGLE}"),
        (*mo, "y.py", "COMMIT:x|y|z"), (*mo, "y.py", ""),
    ]


def test_patch_log_in_many_splits(spark, tmp_path):
    commits = [f"COMMIT:{n:040x}|A{n}|d{n}\n\n--- /dev/null\n+++ b/f{n}.py\n+line {n}\n-x" for n in range(2000)]
    (tmp_path / "log.txt").write_text("\n".join(commits) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records = read_patch_log(spark, str(tmp_path / "log.txt"))
        assert records.rdd.getNumPartitions() > 10
        rows = patch_lines(records).orderBy("log_file", "log_block", "log_row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["commit"], r["file"], r["line"]) for r in rows] == [(f"{n:040x}"[:8], f"f{n}.py", f"line {n}") for n in range(2000)]


def test_header_of_too_few_parts(spark):
    records = spark.createDataFrame([("f", 0, 0, "abcdef|x\n+++ b/a\n+y")], "log_file STRING, log_block BIGINT, log_row BIGINT, record STRING")
    row = commit_meta(records).first()
    assert (row["commit"], row["author"], row["date"]) == ("HEAD", "Unknown", "Unknown")
    assert [r["file"] for r in file_segments(records).orderBy("part").collect()] == ["Unknown", "a"]


def test_short_headers_of_a_table_keep_the_values_before(spark, monkeypatch):
    monkeypatch.setattr(patches, "STRETCH", 5)
    draw = random.Random(4)
    rows, wanted = [], {}
    for log in ("f", "g", "h"):
        held = ("HEAD", "Unknown", "Unknown")
        for block in (0, 7):
            for row in sorted(draw.sample(range(200), 60)):
                whole = draw.random() < (0.1 if log == "h" else 0.7)
                held = (f"{row:08}", "Ann", f"d{block}") if whole else held
                rows.append((log, block, row, f"{row:08}abc|Ann|d{block}\n+x" if whole else "short|one\n+x"))
                wanted[log, block, row] = held
    draw.shuffle(rows)
    records = spark.createDataFrame(rows, "log_file STRING, log_block BIGINT, log_row BIGINT, record STRING")
    found = patches.carried_meta(records).collect()
    assert {(r["log_file"], r["log_block"], r["log_row"]): (r["commit"], r["author"], r["date"]) for r in found} == wanted
    assert len(found) == len(rows) and patches.carried_meta(records.limit(0)).count() == 0


def test_history_findings(spark, tmp_path):
    (tmp_path / "log.txt").write_bytes(LOG.encode())
    found = scan_patches(patch_lines(read_patch_log(spark, str(tmp_path / "log.txt"))), AuditConfig())
    rows = found.filter("rule_id = 'GIT-API-003'").orderBy("seen").collect()
    assert [r["file_path"] for r in rows] == ["x.py", "x.py", "my file", "\\303\\251.py", "x.py"]
    first = rows[0]
    assert first["finding_type"] == "Git History: Google API Key" and first["line_number"] == 1
    assert first["description"].endswith(" (Found in Git commit a1a1a1a1)")
    assert first["context"]["line_content"] == f"new {GOOGLE}" and first["context"]["lines_before"] == []


def test_stash_log(spark, tmp_path):
    log = "\n".join([
        "STASH:stash@{0}: WIP on main: 1234 msg", f"+early {GOOGLE}", "--- a/x.py", "+++ b/x.py", f"+one {GOOGLE}", "--- a/other",
        f"+two {GOOGLE}", "STASH:no colon", "+++ b/z.py", f"+three {GOOGLE}", "",
    ])
    (tmp_path / "stash.txt").write_text(log)
    rows = scan_stashes(stash_lines(read_stash_log(spark, str(tmp_path / "stash.txt")))).filter("rule_id = 'STASH-API-003'")
    found = [(r["commit_hash"], r["file_path"], r["author"], r["entropy"]) for r in rows.orderBy("seen").collect()]
    assert found == [
        ("stash@{0}", "Stash Diff", None, None), ("stash@{0}", "x.py", None, None), ("stash@{0}", "x.py", None, None),
        ("stash@{0}", "z.py", None, None),
    ]
    assert os.path.exists(tmp_path / "stash.txt")
