from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from keysift.config import AuditConfig, config_from_json, load_config, override
from keysift.functions.regex import python_length, to_java
from keysift.operators.detect import detect
from keysift.rules.anchors import ANCHORS, GATES
from keysift.rules.catalog import BUILTIN_RULES, FILE_NAME_RULES, KEYWORD_RULE_ID, RISKS
from keysift.rules.resolve import active_rules, clean_keywords, custom_rule, enabled, keyword_rule, next_custom_id, rule_problems, rules_table


def test_catalogue():
    assert len({rule.id for rule in BUILTIN_RULES}) == len(BUILTIN_RULES) == 56
    assert Counter(rule.risk for rule in BUILTIN_RULES) == {"Critical": 20, "High": 26, "Medium": 9, "Low": 1}
    assert len({rule.category for rule in BUILTIN_RULES}) == 13 and len(FILE_NAME_RULES) == 11
    for rule in BUILTIN_RULES:
        re.compile(rule.pattern)
        assert rule.risk in RISKS and rule.description and rule.recommendation
    assert set(ANCHORS) <= {rule.id for rule in BUILTIN_RULES}
    assert {gate for anchor in ANCHORS.values() for gate in anchor.gates} <= {*GATES, "run"}


def test_group_one_is_the_value():
    rule = next(rule for rule in BUILTIN_RULES if rule.id == "SWIFT-001")
    assert re.search(rule.pattern, 'let apiKey: String = "v4lu3-of-the-key"').group(1) == "v4lu3-of-the-key"


def test_keywords():
    assert clean_keywords([" a.b ", "", "  ", "longer", "a.b"]) == ["longer", "a.b"]
    assert keyword_rule(["", " "]) is None
    rule = keyword_rule({"mapkit", "a.b"})
    assert (rule.id, rule.risk, rule.category) == (KEYWORD_RULE_ID, "High", "Custom")
    assert re.search(rule.pattern, 'MAPKIT_ID = "some-1234-thing-9"') is None  # a junk value
    assert re.search(rule.pattern, 'myMapkit = "k-1234-thing-9"') and re.search(rule.pattern, "a.b: 'k-1234-thing-9'")
    assert not re.search(rule.pattern, "aXb: 'k-1234-thing-9'")


def test_custom_rules():
    assert custom_rule({"pattern": "x"}).id == "CUSTOM"
    rule = custom_rule({"id": "CUSTOM-2", "name": "", "pattern": "x", "risk": "Severe"})
    assert (rule.name, rule.risk, rule.category) == ("Custom Rule", "High", "Custom")
    assert next_custom_id([]) == "CUSTOM-1" and next_custom_id(["CUSTOM-1", "CUSTOM-3"]) == "CUSTOM-2"


def test_active_rules(spark):
    broken, fine = custom_rule({"id": "CUSTOM-1", "pattern": "(x"}), custom_rule({"id": "CUSTOM-2", "pattern": "x"})
    config = replace(
        AuditConfig(), disabled_rules=frozenset({"API-001", "CUSTOM-3"}), keywords=frozenset({"mapkit"}),
        custom_rules=(broken, fine, custom_rule({"id": "CUSTOM-3", "pattern": "y"})),
    )
    ids = [rule.id for rule in active_rules(spark, config)]
    assert ids == [rule.id for rule in BUILTIN_RULES if rule.id != "API-001"] + [KEYWORD_RULE_ID, "CUSTOM-2"]
    left = enabled(rules_table(spark), spark.createDataFrame([("API-001",), ("none",)], "id STRING"))
    assert left.count() == 55
    off = replace(config, disabled_rules=frozenset({KEYWORD_RULE_ID}))
    assert KEYWORD_RULE_ID not in [rule.id for rule in active_rules(spark, off)]


def test_json_options(tmp_path, capsys):
    config = config_from_json(
        '{"excluded_dirs": ["gen"], "excluded_files": ["a.lock"], "included_extensions": [".zig"], "enable_entropy": false,'
        ' "entropy_threshold": 4, "min_entropy_length": 30, "enable_git": false, "max_workers": 3, "context_lines": 2}'
    )
    assert "gen" in config.excluded_dirs and "Pods" in config.excluded_dirs
    assert "a.lock" in config.excluded_files and ".zig" in config.included_extensions and ".py" in config.included_extensions
    assert (config.enable_entropy, config.entropy_threshold, config.min_entropy_length) == (False, 4.0, 30)
    assert (config.enable_history, config.context_lines) == (False, 2)
    assert config_from_json('{"enable_entropy": "no", "entropy_threshold": "x", "context_lines": 1.5, "excluded_dirs": "gen"}') == AuditConfig()
    assert config_from_json("{broken") == AuditConfig() and config_from_json("[1]") == AuditConfig()
    assert "Warning" in capsys.readouterr().out
    assert load_config(tmp_path / "none.json") == AuditConfig()
    (tmp_path / "c.json").write_text('{"context_lines": 7}')
    assert load_config(tmp_path / "c.json").context_lines == 7


def test_flags():
    base = replace(AuditConfig(), entropy_threshold=4.0)
    assert override(base) == base
    config = override(base, no_history=True, no_entropy=True, threshold=5.0, exclude_dirs="a, b,", exclude_files=["c"], brief=True)
    assert not config.enable_history and not config.enable_entropy and config.context_lines == 0
    assert config.entropy_threshold == 5.0 and {"a", "b"} <= config.excluded_dirs and "c" in config.excluded_files
    assert override(base, threshold=0).entropy_threshold == 4.0


HOSTILE = {
    "SDK-001": "https://" + "a" * 32 + "@" + "a." * 500_000 + "sentry.io/x",
    "API-025": "https://" + "a" * 500_000 + ":" + "b" * 499_000,
    "AUTH-001": "eyJ" + "a" * 500_000 + ".eyJ" + "b" * 499_000,
    "SWIFT-001": "token" + "Aa" * 499_000 + "='",
}


def test_long_lines_end_no_task(spark):
    """Lines of a million characters: words, labels, digits, quotes, and the start of what a rule looks for."""
    lines = [*HOSTILE.values(), "a" * 10**6, "a." * 500_000, "x=" * 500_000, "1" * 10**6, "\"" * 10**6, "sk-" * 333_333, "xy" * 500_000 + "z"]
    own = [custom_rule({"id": f"OWN-{n}", "pattern": p}) for n, p in enumerate((r"(?:x|y)+z", r"k(?:[a-z]+\.)*end", r"^(x+y)+z$"))]
    table = spark.createDataFrame([(line,) for line in lines], "line STRING")
    off = replace(AuditConfig(), enable_entropy=False)
    found = detect(table, [*BUILTIN_RULES, *own], off, entropy=False, distinct=True).groupBy("slot").count().collect()
    assert len(BUILTIN_RULES) in {row["slot"] for row in found}


PATTERNS = [
    r"(?P<my_key>ab)c", r"(?P<q>['\"])x(?P=q)", r"a{,2}b", r"(?:x|y)+z", r"[^\W\d]+", r"[^\s\w]", r"[\W_]+", r"[\D]{2}", r"(?i)k(?-i:A)b",
    r"(?i:straße)", r"\bé\w*\b", r"a.c", r"(?s)a.c", r"(?m)^b$", r"^b$", r"x$", r"\Ax\Z", r"[a&&b]", r"[[a]", r"(a)(b)?\1", r"(?<=a)b(?!c)",
    r"(?<!a)b(?=c)", r"a+?b", r"(?>a+)b", r"a++b", r"\.\-\/", r"[a\-z]", r"\d{2,}", r"(?a:\w+)", r"(?a)\d+\s", r"[\x41-\x43]\t", r"", r"a|", r"(|b)c",
    r"(?:ab|a)c", r"\Bb\B", r"[^a]", r"(?x) a  b # c", r"sentry\.io", r"(?:[a-z0-9\-]+\.)*io\b",
]


def test_patterns_mean_what_python_means(spark):
    draw = random.Random(8)
    signs = list("abcxyzABC_-./ \t'\"&[]=09é٣ßK") + ["k", "İ", "io", "sentry.io", "straße", "STRASSE", "ab", "\x85", "\u2028", "\u3000", "s"]
    lines = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 14))) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(lines)), "n INT, line STRING")
    for pattern in PATTERNS:
        got = table.select("n", F.expr("regexp_extract_all(line, '" + to_java(pattern).replace("\\", "\\\\").replace("'", "\\'") + "', 0)").alias("m"))
        found = {row["n"]: row["m"] for row in got.collect()}
        for n, line in enumerate(lines):
            assert found[n] == [m.group(0) for m in re.finditer(pattern, line)], (pattern, line)


def test_a_rule_keeps_its_own_gate(spark):
    """A user's rule with the id of a built-in one, and one with its pattern."""
    rules = [custom_rule({"id": "API-004", "pattern": r"internal-\d+"}), replace(BUILTIN_RULES[0], id="MINE")]
    lines = spark.createDataFrame([("internal-42",), ("nothing",), ("sk-" + "a1B2" * 12,)], "line STRING")
    off = replace(AuditConfig(), enable_entropy=False)
    found = sorted((r["slot"], r["matched"][:11]) for r in detect(lines, rules, off, entropy=False).collect())
    assert (0, "internal-42") in found and len(found) == 1 + len(BUILTIN_RULES[0].pattern and re.findall(BUILTIN_RULES[0].pattern, "sk-" + "a1B2" * 12))


def test_left_out_rules_are_told(spark):
    config = replace(AuditConfig(), custom_rules=tuple(custom_rule({"id": i, "pattern": p}) for i, p in (("A", "(x"), ("B", r"(a)?(?(1)b|c)"), ("C", "x"))))
    assert [rule for rule, _ in rule_problems(spark, config)] == ["A"]
    with pytest.warns(UserWarning, match="rule A is left out"):
        assert [rule.id for rule in active_rules(spark, config)][-2:] == ["B", "C"]


PYTHON_ONLY = [
    r"k=(?:ab)+c", r"(?:ab)+c", r"(a)?(?(1)b|c)", r"(?:ab){2,5000}", r"(?:ab){1500}", r"(?:a|bc)*?c", r"((?:ab)+c)+", r"(?=(?:ab)+c)a", r"(?>(?:ab)+)c",
    r"(?:(a)|b)+(?(1)c|d)", r"(?:a*b)+c", r"ab+c",
]


def test_groups_are_repeated_without_a_bound(spark):
    """As many rounds as the line holds, conditions on groups, and both sides of the length at which Python takes over."""
    lines = ["k=" + "ab" * n + "c" for n in (1, 998, 999, 1000, 1001, 1500)] + ["ab" * n for n in (999, 1000, 2000)] + ["abcbcc", "", "bd"]
    rules = [custom_rule({"id": f"OWN-{n}", "pattern": p}) for n, p in enumerate(PYTHON_ONLY)]
    table = spark.createDataFrame(list(enumerate(lines)), "n INT, line STRING")
    off = replace(AuditConfig(), enable_entropy=False)
    for distinct in (False, True):
        found = detect(table, rules, off, entropy=False, keep=("n",), distinct=distinct).collect()
        got = {}
        for row in sorted(found, key=lambda r: r["match_pos"]):
            got.setdefault((row["n"], row["slot"]), []).append(row["matched"])
        for n, line in enumerate(lines):
            for slot, pattern in enumerate(PYTHON_ONLY):
                wanted = [m.group(0) for m in re.finditer(pattern, line)]
                assert got.get((n, slot), []) == (list(dict.fromkeys(wanted)) if distinct else wanted), (pattern, line[:20], len(line))


def test_very_many_rounds(spark):
    table = spark.createDataFrame([("k=" + "ab" * 100_000 + "c",)], "line STRING")
    rules = [custom_rule({"id": "OWN", "pattern": r"k=(?:ab)+c"})]
    found = detect(table, rules, replace(AuditConfig(), enable_entropy=False), entropy=False).collect()
    assert [len(row["matched"]) for row in found] == [200_003]


def test_built_in_rules_need_no_python(spark):
    assert all(python_length(rule.pattern) is None for rule in BUILTIN_RULES)
    lines = spark.createDataFrame([("x",)], "line STRING")
    plan = detect(lines, BUILTIN_RULES, AuditConfig(), entropy=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Arrow" not in plan


def test_lines_without_a_match_are_not_spread(spark):
    """A rule without a gate is tested before its line gets a row of its own."""
    rules = [custom_rule({"id": "OWN", "pattern": r"x\d+"})]
    lines = spark.createDataFrame([("x1",), ("y",)], "line STRING")
    plan = detect(lines, rules, AuditConfig(), entropy=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan
