"""The scan against brute force, on planted lines and on lines made from them."""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import replace

import duckdb
import pytest

from keysift.config import AuditConfig
from keysift.functions.regex import compiles, to_java
from keysift.operators.detect import _looked_at
from keysift.operators.scan import lines_alone, scan_files
from keysift.plans.corpus import KINDS, PLANTED
from keysift.rules.anchors import anchor
from keysift.rules.catalog import BUILTIN_RULES, Rule
from keysift.rules.resolve import keyword_rule
from tests import brute

NAMES = ("a.swift", "a.xml", "k.p8", "a.properties", "a.xcconfig", "a.env", "Config.swift")


@pytest.fixture(scope="module")
def planted() -> list[str]:
    """Every kind of planted line, for one digest."""
    x = "".join(hashlib.md5(str(n).encode()).hexdigest() for n in range(8))
    row = ", ".join(KINDS)
    return list(duckdb.sql(f"SELECT {row} FROM (SELECT '{x}' AS x, md5('{x}') AS h)").fetchall()[0])


def _scan(spark, lines: list[tuple[str, str]], config=AuditConfig(), anchors=True, rules=BUILTIN_RULES):
    rows = [(f"d{n}/{name}", name, line) for n, (name, line) in enumerate(lines)]
    files = spark.createDataFrame(rows, "path STRING, name STRING, text STRING").repartition(4)
    found = scan_files(files, rules, config, anchors=anchors).select("file_path", "rule_id", "matched_string").collect()
    by_path: dict[str, list] = {path: [] for path, _, _ in rows}
    for row in found:
        if row["rule_id"] != "FILE-AUDIT":
            by_path[row["file_path"]].append((row["rule_id"], row["matched_string"]))
    return [sorted(by_path[path]) for path, _, _ in rows]


def _variants(planted: list[str], seed: int = 7) -> list[tuple[str, str]]:
    """Lines cut, wrapped, joined, re-cased and salted with characters the two regex dialects treat differently."""
    rng = random.Random(seed)
    odd = ["é", "ſ", "K", "İ", "ı", " ", "١", "²", "\x1c", "\x1f", " ", "\x85", "\x0b", "́", "‿", "ß", "中", "😀"]
    lines: list[str] = []
    for line in planted:
        lines += [line, line[:-3], f"é{line}é", f"({line})", line.upper(), line.lower(), f"\t{line} # x", line.replace(" ", " ")]
        lines += [line.replace("s", "ſ", 1).replace("k", "K", 1), line.replace("i", "ı", 1), line.replace("I", "İ", 1)]
        for _ in range(6):
            at = rng.randrange(len(line) + 1)
            lines.append(line[:at] + rng.choice(odd) + line[at:])
        lines.append(line + rng.choice([" ", ",", ";", "\x1c"]) + rng.choice(planted))
    return [(rng.choice(NAMES), line) for line in lines]


def test_every_rule_finds_its_planted_line(planted):
    for rule, line in zip(BUILTIN_RULES, planted):
        assert brute.PATTERNS[rule.id].search(line), rule.id
    assert list(PLANTED) == [rule.id for rule in BUILTIN_RULES]


def test_scan_equals_brute_force(spark, planted):
    lines = _variants(planted)
    for (name, line), found in zip(lines, _scan(spark, lines)):
        assert found == brute.findings(name, line), (name, line)


def test_anchors_lose_nothing(spark, planted):
    lines = _variants(planted, seed=11)
    assert _scan(spark, lines) == _scan(spark, lines, anchors=False)


def test_lines_that_are_looked_at(spark, planted):
    """Prose is left alone before any rule is asked; no line with a finding is."""
    assert all(anchor(rule).first for rule in BUILTIN_RULES)
    prose = ["", "Plain words, with a comma - and an under_score.", "\u00fcberall W\u00f6rter"]
    lines = ["fifteen--letter", *(line for name, line in _variants(planted, seed=3) if brute.findings(name, line))]
    rows = [(n, line) for n, line in enumerate([*prose, *lines])]
    seen = spark.createDataFrame(rows, "n INT, line STRING").filter(_looked_at(BUILTIN_RULES, []))
    assert sorted(row["n"] for row in seen.collect()) == list(range(len(prose), len(rows)))
    plain = spark.createDataFrame([("a word",), ("two words",)], "line STRING")
    own = Rule("CUSTOM-1", "", "Low", "Own", r"\btwo\b", "", "")
    assert [row["line"] for row in plain.filter(_looked_at([own], [])).collect()] == ["two words"]
    assert [row["line"] for row in plain.filter(_looked_at([], ["length(line) = 6"])).collect()] == ["a word"]


def test_short_tokens_are_looked_at(spark):
    """An entropy search for tokens shorter than a run asks for lines that hold no run."""
    low = replace(AuditConfig(), entropy_threshold=2.0, min_entropy_length=8)
    lines = [("a.txt", "see aZ3kQ9xWv1rTpLmNs8uY0 there"), ("a.txt", "see aZ3kQ9xW"), ("a.txt", "see it there")]
    assert _scan(spark, lines, low, rules=[]) == _scan(spark, lines, low, rules=[], anchors=False)


def test_lines_alone(spark):
    files = spark.createDataFrame([("d/a.py", "a.py", "one\ntoken = 'abcd-1234-efgh'\nthree\n")], "path STRING, name STRING, text STRING")
    found = scan_files(files, BUILTIN_RULES)
    (whole,), (alone,) = found.collect(), lines_alone(found).collect()
    assert whole["context"].lines_before == ["one"] and whole["context"].lines_after == ["three"]
    assert alone["context"].asDict() == whole["context"].asDict() | {"lines_before": [], "lines_after": []}
    assert [alone[c] for c in found.columns if c != "context"] == [whole[c] for c in found.columns if c != "context"]
    assert lines_alone(found).dtypes == found.dtypes


def test_keyword_anchors_lose_nothing(spark, planted):
    lines = [("a.py", line.replace("token", word)) for line in planted for word in ("token", "Kİste", "ſtraße", "KEYWORD.x")]
    lines += [("a.py", f"{word} = 'abcd-1234'") for word in ("kiste", "KİSTE", "straSSe", "ſtraße", "my_Keyword.X", "KEYWORD.x", "keywordyx")]
    off = replace(AuditConfig(), enable_entropy=False)
    for words in (["keyword.x", "kiste"], ["straße", "kiste"]):
        rule = keyword_rule(words)
        found = _scan(spark, lines, off, rules=[rule])
        wanted = [[(rule.id, brute.redact(m.group(0))) for m in re.finditer(rule.pattern, line)] for _, line in lines]
        assert found == [sorted(w) for w in wanted] and any(found)


def test_entropy_options(spark, planted):
    lines = [("a.py", line) for line in planted]
    off = replace(AuditConfig(), enable_entropy=False)
    for (name, line), found in zip(lines, _scan(spark, lines, off)):
        assert found == brute.findings(name, line, entropy_too=False)
    low = replace(AuditConfig(), entropy_threshold=3.5, min_entropy_length=12)
    for (name, line), found in zip(lines, _scan(spark, lines, low)):
        wanted = sorted(brute.redact(c) for c in brute.secrets(line, 12, 3.5))
        assert sorted(m for rule, m in found if rule == "ENTROPY-001") == wanted, line


@pytest.mark.parametrize("text, hit", [
    ('mapkitApiKeyRu: String = "q1w2e3r4t5y6"', True),
    ('let accessTokenValue = "abcd1234efgh"', True),
    ('let tokenizer = "abcd1234efgh"', False),
    ('static let keyPath = "some.nested.path"', False),
    ('let apiKey = "YOUR_API_KEY"', False),
    ('val token = "${BuildConfig.TOKEN}"', False),
    ('const val API_SECRET = "9f8e7d6c5b4a"', True),
])
def test_names(spark, text, hit):
    found = _scan(spark, [("a.kt", text)])[0]
    assert any(rule == "SWIFT-001" for rule, _ in found) is hit


def test_dialect(spark):
    assert compiles(spark, r"(?P<name>a)[\[&\&]\Z")
    assert not compiles(spark, "(unclosed")
    assert not compiles(spark, r"(?>a{,x)++(")
    assert to_java(r"[\w[]") == r"(?ud)[\p{L}\p{N}_\x{5b}]"
