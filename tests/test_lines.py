from __future__ import annotations

import io
import random

import pytest
from pyspark.sql import functions as F

from keysift.functions.text import format_duration, html_escape, redact, severity_score, shannon_entropy
from keysift.operators.context import join_context
from keysift.operators.lines import decode_text, explode_lines, is_binary, line_count
from keysift.operators.scan import line_context
from tests import brute

TEXTS = ["", "\n", "a", "a\n", "a\r\nb", "a\rb\r", "\r\n\r\n", "a\n\rb", "\n\na\x0cb c\n", "x\r\r\ny", "é\n中", "a\r\n\n"]


def _column(spark, values, kind, make):
    rows = spark.createDataFrame(list(enumerate(values)), f"n INT, v {kind}")
    return [r[1] for r in rows.select("n", make(F.col("v"))).orderBy("n").collect()]


def test_lines_end_as_in_universal_newlines(spark):
    files = spark.createDataFrame([(str(n), t) for n, t in enumerate(TEXTS)], "path STRING, text STRING")
    found: dict[str, list] = {str(n): [] for n in range(len(TEXTS))}
    for row in explode_lines(files).orderBy("line_number").collect():
        found[row["path"]].append(row["line"])
    counted = _column(spark, TEXTS, "STRING", line_count)
    for n, text in enumerate(TEXTS):
        wanted = [line.rstrip("\n") for line in io.StringIO(text, newline=None).readlines()]
        assert found[str(n)] == wanted, repr(text)
        assert counted[n] == len(wanted), repr(text)


def test_binary(spark):
    rng = random.Random(3)
    values = [b"", b"plain", b"a\x00b", b"a" * 4096 + b"\x00", b"a" * 4095 + b"\x00", bytes(range(256)), b"\x07\x08\x1b\t\n\r\x0c",
              b"\x01" * 3 + b"a" * 7, b"\x01" * 4 + b"a" * 7, "é中".encode() * 9, b"\x7f" * 4 + b"b" * 9, b"\xff\xfe" * 20]
    values += [bytes(rng.choice(b"abc\x01\x0b\x0e\x1a\x1c\x1f\x7f\x80") for _ in range(50)) for _ in range(20)]
    text = {7, 8, 9, 10, 12, 13, 27} | (set(range(32, 256)) - {127})

    def wanted(data: bytes) -> bool:
        head = data[:4096]
        return 0 in head or sum(b not in text for b in head) / max(len(head), 1) > 0.3

    assert _column(spark, values, "BINARY", is_binary) == [wanted(v) for v in values]


def test_malformed_utf8(spark):
    rng = random.Random(5)
    values = [b"", b"ok \xe2\x82\xac", b"\xff", b"a\xc0\x80b", b"\xe2\x82", b"\xe2\x82A", b"\xf0\x9f\x98", b"\xf0\x9fA", b"\xed\xa0\x80",
              b"\xf4\x90\x80\x80", b"\xe0\x80\x80", b"\xc3(", b"\x80\x80"]
    values += [bytes(rng.choice(b"a\x80\xbf\xc2\xe2\xed\xf0\xf4\xff\x90\xa0") for _ in range(8)) for _ in range(60)]
    assert _column(spark, values, "BINARY", decode_text) == [v.decode("utf-8", errors="replace") for v in values]


def test_redact(spark):
    values = ["", "a", "12345678", "123456789", "x" * 12, "x" * 13, "abcd" + "y" * 12 + "efgh", "z" * 40, "'quoted\"", '"abcdefghijkl"\n',
              " \t'\r\n", "é中😀" * 5, "'a b c d e f g'"]
    assert _column(spark, values, "STRING", redact) == [brute.redact(v) for v in values]


def test_entropy(spark):
    rng = random.Random(1)
    values = ["", "aaaa", "ab", "a1B2c3D4e5F6g7H8i9J0", "é中😀é", "0123456789abcdef" * 2, ".*+?[]()\\$^"]
    values += ["".join(rng.choice("abcdefghij=/+_") for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    for value, found in zip(values, _column(spark, values, "STRING", shannon_entropy)):
        assert found == pytest.approx(brute.entropy(value), abs=1e-12)


def test_entropy_of_long_texts(spark):
    """Many distinct characters and a long run: linear, and within the slack of the sum in order of occurrence."""
    rng = random.Random(2)
    values = ["".join(chr(rng.randrange(0x4E00, 0x4E00 + kinds)) for _ in range(size)) for kinds, size in ((300, 20_000), (20_000, 100_000), (3, 1000))]
    values += ["x" * 10**6, "ab" * 500, "".join(chr(0x100 + n) for n in range(999)), "".join(chr(0x100 + n) for n in range(1001))]
    for value, found in zip(values, _column(spark, values, "STRING", shannon_entropy)):
        assert found == pytest.approx(brute.entropy(value), abs=1e-12 if len(set(value)) <= 300 else 1e-11)


def test_small_functions(spark):
    assert _column(spark, [0.0, 0.0123, 0.9994, 1.0, 59.994, 60.0, 3725.25], "DOUBLE", format_duration) == [
        "0.0 ms", "12.3 ms", "999.4 ms", "1.00 s", "59.99 s", "1m 0.0s", "62m 5.2s"]
    assert _column(spark, ["<a href=\"x\">'&amp;"], "STRING", html_escape) == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;amp;"]
    assert _column(spark, ["", "plain", None, "a'b"], "STRING", html_escape) == ["", "plain", None, "a&#x27;b"]
    assert "RLIKE" in str(html_escape(F.lit("x"))).upper()  # tested once before anything is replaced
    assert _column(spark, ["Critical", "High", "Medium", "Low", "Info", "?"], "STRING", severity_score) == [5, 4, 3, 2, 1, 0]


def test_context(spark):
    text = [f"Line {n}" for n in range(1, 50)]
    files = spark.createDataFrame([(text, n) for n in (1, 2, 25, 49)], "lines ARRAY<STRING>, n INT")
    for size in (0, 5, 20):
        for row in files.select("n", line_context(F.col("lines"), F.col("n"), size).alias("c")).collect():
            n, context = row["n"], row["c"]
            assert context["line_content"] == f"Line {n}" and context["line_number"] == n
            assert context["lines_before"] == text[max(0, n - 1 - size):n - 1]
            assert context["lines_after"] == text[n:n + size]


def test_joined_context_equals_sliced(spark):
    text = {p: [f"{p}{n}" for n in range(size)] for p, size in (("a", 30), ("b", 3), ("c", 1))}
    lines = spark.createDataFrame([(p, n + 1, t) for p, ts in text.items() for n, t in enumerate(ts)], "path STRING, line_number INT, line STRING")
    hits = spark.createDataFrame([("a", 1), ("a", 7), ("a", 30), ("b", 2), ("c", 1)], "path STRING, line_number INT")
    for row in join_context(hits, lines, 5).collect():
        n, whole = row["line_number"], text[row["path"]]
        assert row["lines_before"] == whole[max(0, n - 6):n - 1]
        assert row["lines_after"] == whole[n:n + 5]
