"""The whole job on a small tree with history: findings, numbers and report files."""

from __future__ import annotations

import json
from dataclasses import replace
from pathlib import Path

import pytest

from keysift.config import AuditConfig, override
from keysift.plans.audit import audit_tree, run_audit
from keysift.sources.walk import open_root, reachable
from keysift.sinks.reports import NO_FINDINGS, number_findings, output_dir, print_summary, write_reports

DIGITS = "0123456789abcdef" * 8
GOOGLE = "AIza" + DIGITS[:35]
PEM = "-----BEGIN RSA PRIVATE" + " KEY-----"


@pytest.fixture(scope="module")
def project(tmp_path_factory) -> Path:
    root = tmp_path_factory.mktemp("project")
    (root / "app").mkdir()
    code = [f"line {n} <b>&" for n in range(1, 50)]
    code[24] = f'let k = "{GOOGLE}"; let k2 = "{GOOGLE}"'
    (root / "app" / "Main.swift").write_text("\n".join(code) + "\n")
    (root / "app" / "pipe.env").write_text("SECRET=a|b|c|d|e|f\n")
    (root / "server.pem").write_text(PEM + "\n")
    (root / "log.txt2").write_text(
        "COMMIT:" + "ab" * 20 + f"|Ann|today\n\n--- a/x.py\n+++ b/x.py\n+k {GOOGLE}\nCOMMIT:" + "cd" * 20 + f"|Mo|before\n\n+++ b/x.py\n+k {GOOGLE}\n"
    )
    return root


@pytest.fixture(scope="module")
def audit(spark, project):
    return audit_tree(spark, str(project), patch_log=str(project / "log.txt2"))


def _text(folder: Path) -> str:
    return "".join(part.read_text() for part in sorted(folder.glob("part-*")))


def test_findings(audit):
    rows = {(r["rule_id"], r["file_path"], r["line_number"]) for r in audit.findings.collect()}
    assert rows == {
        ("API-003", "app/Main.swift", 25), ("CONFIG-003", "app/pipe.env", 1), ("FILE-AUDIT", "server.pem", 1), ("KEY-001", "server.pem", 1),
        ("GIT-API-003", "x.py", 1), ("ENTROPY-001", "app/Main.swift", 25), ("GIT-ENTROPY", "x.py", 1),
    } - {(r, p, n) for r, p, n in [("ENTROPY-001", "app/Main.swift", 25), ("GIT-ENTROPY", "x.py", 1)] if (r, p, n) not in rows}
    commit = audit.findings.filter("rule_id = 'GIT-API-003'").collect()
    assert [(r["commit_hash"], r["author"]) for r in commit] == [("abababab", "Ann")]
    context = audit.findings.filter("rule_id = 'API-003'").first()["context"]
    assert len(context["lines_before"]) == 20 and len(context["lines_after"]) == 20


def test_stats(audit):
    stats = audit.stats.first()
    assert (stats["files_scanned"], stats["lines_scanned"]) == (3, 51)
    assert stats["critical_count"] == 1 and stats["total_findings"] == audit.findings.count()
    assert not audit.passed() and stats["elapsed_time_seconds"] > 0


def test_numbers_follow_the_order(audit):
    rows = number_findings(audit.findings).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["severity"] for r in rows] == sorted((r["severity"] for r in rows), reverse=True)


def test_reports(audit, tmp_path, capsys):
    out = Path(write_reports(audit, str(tmp_path), "2024-01-01 00:00:00"))
    total = audit.findings.count()
    markdown = _text(out / "report-markdown")
    assert "3 files with 51 lines" in markdown and markdown.index("## 1. server.pem:1\n\nCritical risk") < markdown.index("## 2. ")
    assert "`SECR**********..\\|e\\|f`" in markdown and "\nIntroduced by abababab (Ann, today)" in markdown
    assert markdown.count("\n## ") == total
    text = _text(out / "report-text")
    assert text.count("\n  | ") == total and "3 files" in text and "2024-01-01 00:00:00" in text
    html = _text(out / "report-html")
    assert html.count("<article id=") == total and "line 24 &lt;b&gt;&amp;" in html and "<b>&" not in html
    assert '<pre class="around" data-line="25">' in html and "<dt>commit<dd>abababab (Ann, today)" in html
    report = json.loads(_text(out / "report-json"))
    assert list(report) == ["scanned_path", "scan_timestamp", "stats", "findings"] and report["scan_timestamp"] == "2024-01-01 00:00:00"
    rows = report["findings"]
    assert [r["risk_level"] for r in rows] == [r["risk_level"] for r in number_findings(audit.findings).orderBy("idx").collect()]
    assert len(rows) == total and set(rows[0]) == {
        "finding_type", "risk_level", "description", "file_path", "line_number", "matched_string", "recommendation", "context",
        "commit_hash", "author", "date", "entropy", "rule_id"}
    assert rows[0]["risk_level"] == "Critical" and rows[0]["commit_hash"] is None
    assert report["stats"]["total_findings"] == total and report["stats"]["files_unread"] == 0
    print_summary(audit)
    shown = capsys.readouterr().out
    assert f"{total} findings on" in shown and " 1 Critical server.pem:1" in shown and "Private Key Header" in shown


def test_brief(spark, project, tmp_path):
    config = override(replace(AuditConfig(), json=False, markdown=False, text=False), brief=True, no_history=True)
    audit = audit_tree(spark, str(project), config, patch_log=str(project / "log.txt2"))
    assert audit.findings.filter("commit_hash IS NOT NULL").count() == 0
    out = Path(write_reports(audit, str(tmp_path)))
    assert sorted(p.name for p in out.iterdir()) == ["report-html"]
    html = _text(out / "report-html")
    assert '<pre class="alone" data-line="25">' in html and 'class="around"' not in html


def test_clean_input(spark, tmp_path):
    files = spark.createDataFrame([("a.txt", "a.txt", "nothing here\n"), ("b.txt", "b.txt", "")], "path STRING, name STRING, text STRING")
    audit = run_audit(files, scanned="clean")
    assert audit.passed() and audit.findings.count() == 0
    stats = audit.stats.first()
    assert (stats["files_scanned"], stats["lines_scanned"], stats["total_findings"]) == (2, 1, 0)
    out = Path(write_reports(audit, str(tmp_path)))
    assert NO_FINDINGS in _text(out / "report-markdown") and "| Place |" not in _text(out / "report-markdown")
    assert NO_FINDINGS in _text(out / "report-html") and json.loads(_text(out / "report-json"))["findings"] == []


def test_output_folder(audit, project, tmp_path):
    assert output_dir(audit, None).endswith(project.name)
    assert output_dir(audit, str(tmp_path)).endswith(tmp_path.name)
    assert output_dir(audit, str(tmp_path / "none")).endswith(Path.cwd().name)


@pytest.mark.parametrize("range_bytes", [7, 1000])
def test_long_files_are_scanned_alike(spark, project, tmp_path, range_bytes):
    """The same tree with every file of 40 bytes or more read as lines, in many splits."""
    root = tmp_path / "long"
    root.mkdir()
    lines = [f'n{n} = "{"x" * (n % 7)}" {GOOGLE if n % 31 == 0 else ""}' for n in range(300 if range_bytes == 7 else 3000)]
    (root / "big.py").write_bytes("\r\n".join(lines).encode())
    (root / "odd.log").write_bytes(b"a\rb\xff\n\n" + f"token = '{DIGITS[:30]}'\n".encode())
    (root / "data.sqlite").write_bytes(b"\x00" * 100 + GOOGLE.encode())
    (root / "tiny.env").write_text("SECRET=abcdefgh\n")
    (root / "_hidden.md").write_bytes(f"{GOOGLE} and more than forty bytes of text\r\n".encode() * 3 + b"\r\rtoken = '" + DIGITS[:30].encode() + b"'")
    (root / "mark.env").write_bytes(b"\xef\xbb\xbfAPI_KEY=abcdef123456 and more than forty bytes of text\nAPI_KEY=abcdef123457\n")
    (root / "_mark.env").write_bytes(b"\xef\xbb\xbfAPI_KEY=abcdef123456 and more than forty bytes of text\r\nAPI_KEY=abcdef123457\r")
    (root / "linked").symlink_to(project)
    (root / "loop").symlink_to(root)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {key: spark.conf.get(key) for key in keys}
    wanted = audit_tree(spark, str(root))
    for key in keys:
        spark.conf.set(key, "4096")
    try:
        found = audit_tree(spark, str(root), long_bytes=40, range_bytes=range_bytes)
        rows = found.findings.drop("seen").collect()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert sorted(map(str, rows)) == sorted(map(str, wanted.findings.drop("seen").collect()))
    assert {r["file_path"] for r in rows} == {"big.py", "odd.log", "data.sqlite", "tiny.env", "_hidden.md", "mark.env", "_mark.env"}
    assert [r["line_number"] for r in rows if r["file_path"] == "mark.env"] == [2]
    for column in ("files_scanned", "lines_scanned", "total_findings"):
        assert found.stats.first()[column] == wanted.stats.first()[column], column


@pytest.mark.parametrize("name", ["one.env", "_one.env", ".env"])
def test_a_file_as_root(spark, tmp_path, name):
    """Whole or as lines, and whatever it is called."""
    path = tmp_path / name
    path.write_bytes(b"\xef\xbb\xbfAPI_KEY=abcdef123456\nAPI_KEY=abcdef123457\n" + f"k = '{GOOGLE}'\n".encode())
    found = [audit_tree(spark, str(path), long_bytes=size) for size in (1, 1 << 20)]
    rows = [sorted(map(str, audit.findings.drop("seen").collect())) for audit in found]
    assert rows[0] == rows[1] and len(rows[0]) >= 2
    assert found[0].stats.first()["lines_scanned"] == found[1].stats.first()["lines_scanned"] == 3


def test_closed_audits_leave_nothing(spark, tmp_path):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in folder.iterdir()}
    files = spark.createDataFrame([("a.py", "a.py", f"k = '{GOOGLE}'\n")], "path STRING, name STRING, text STRING")
    with run_audit(files) as audit:
        assert audit.findings.count() > 0
        assert not any("keysift-scan" in p.name for p in folder.iterdir() if p.name not in before)
    assert not any(p.name.startswith("keysift-") for p in folder.iterdir() if p.name not in before)


def test_nothing_is_lost_in_silence(spark, project, tmp_path):
    """A file whose read fails is counted and told, whole or by its head; the others are audited."""
    root = tmp_path / "faulty"
    root.mkdir()
    (root / "good.py").write_text(f"k = '{GOOGLE}'\n")
    (root / "bad.py").symlink_to("/proc/self/mem")  # opens, and fails when it is read
    for long_bytes in (1 << 20, 0):
        with audit_tree(spark, str(root), long_bytes=long_bytes) as audit:
            assert [(r["path"], "rror" in r["reason"]) for r in audit.unread.collect()] == [("bad.py", True)]
            stats = audit.stats.first()
            assert (stats["files_scanned"], stats["files_unread"], stats["folders_unread"], stats["lines_scanned"]) == (2, 1, 0, 1)
            assert {r["file_path"] for r in audit.findings.collect()} == {"good.py"}
            _, _, summary = output_dir(audit, str(tmp_path)), print_summary(audit), audit.stats.columns
            assert "files_unread" in summary


def test_a_folder_that_cannot_be_listed_is_told(spark):
    files = spark.createDataFrame([("a.txt", "a.txt", "nothing\n")], "path STRING, name STRING, text STRING")
    folders = spark.createDataFrame([("src", 0, "PermissionError: no")], "path STRING, length INT, reason STRING")
    audit = run_audit(files, unlisted=folders)
    assert audit.stats.first()["folders_unread"] == 1 and audit.unread.collect() == [("src", "PermissionError: no")]


def test_unknown_storage_is_audited_without_hidden_files():
    with pytest.warns(UserWarning, match="left out"):
        assert not reachable("dbfs:/somewhere")
    assert open_root("file:///a/b")[1] == "/a/b"
