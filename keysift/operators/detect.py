"""The detection core: from lines to matches, by rules, entropy and file names.

One chain of projections and generators, without a shuffle:

    line -> is it looked at -> slots that may hit (substring tests) -> one row per slot -> expressions of that slot
    -> one row per match

Rule expressions are literals, so each is compiled once per task, and only the branch of the row's slot is run.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_
from typing import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from keysift.config import AuditConfig
from keysift.functions.regex import python_length, to_java
from keysift.functions.text import ENTROPY_SLACK, distinct_chars, shannon_entropy
from keysift.rules.anchors import FIRST_CHARS, FIRST_TEXT, GATES, RUN_CHARS, RUN_LENGTH, anchor
from keysift.rules.catalog import FILE_NAME_RULES, Rule

# Slots after the rules, which take 0, 1, 2, ...
NO_SLOT = -1
ENTROPY_SLOT = 1_000_000

# --- Fixed values: strings that are random-looking but harmless ---------------------------------------------
URL = r"^(?i:https?)://[^\s/$.?#].[^\s]*$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
HEX_HASH = r"^[0-9a-fA-F]{32,64}$"
DOTTED_ID = r"^[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9._-]+$"
PLACEHOLDERS = ("placeholder", "example", "sample", "your_secret", "dummy", "test")
MIN_CLEAN_LENGTH = 20
MAX_TRIVIAL_CHARS = 4


def _quoted_run(length: int) -> str:
    return rf"[\"'`]([^\r\n\"'`]{{{length},}})[\"'`]"


def _token_run(length: int) -> str:
    return rf"[A-Za-z0-9+/=_\-]{{{length},}}"


def entropy_candidates(line: str, min_length: int) -> Column:
    """Distinct quoted literals and unquoted tokens of at least ``min_length`` characters in a line column."""
    return F.expr(_entropy_candidates_sql(line, min_length))


def is_false_positive(candidate: Column) -> Column:
    clean = F.btrim(candidate, F.lit("\"'` \t\r\n"))
    lowered = F.lower(clean)
    return (
        (F.length(clean) < MIN_CLEAN_LENGTH)
        | clean.startswith("/")
        | clean.startswith("./")
        | clean.startswith("../")
        | reduce(or_, (F.contains(lowered, F.lit(word)) for word in PLACEHOLDERS))
        | reduce(or_, (clean.rlike(to_java(shape)) for shape in (URL, UUID, HEX_HASH, DOTTED_ID)))
        | (F.size(distinct_chars(clean)) <= MAX_TRIVIAL_CHARS)
    )


def _needed_chars(threshold: float) -> int:
    """Entropy is at most log2 of the number of distinct characters, so fewer cannot reach the threshold."""
    return max(0, math.ceil(2 ** (threshold - 1e-9))) if threshold < 64 else 2**31 - 1


# The scan's expressions are built as SQL text: one parse in the JVM instead of a call for every node.
# Characters that case-insensitive matching folds but lower() does not; lines with one skip the text tests.
_ODD = "octet_length(line) > length(line) AND line RLIKE '[\u0130\u0131\u017f\u212a]'"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(column: str, texts: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_sql(text)})" for text in texts) + ")"


# Written out class by class, as Java steps through these faster than through a counted class.
_RUN = f"(concat(' ', line) RLIKE {_sql(f'[^{RUN_CHARS}]' + f'[{RUN_CHARS}]' * RUN_LENGTH)}) OR ({_ODD})"


def _gates() -> dict[str, str]:
    return {**{name: _any("line", texts) for name, texts in GATES.items()}, "run": _RUN}


def _looked_at(rules: Sequence[Rule], others: Sequence[str]) -> str:
    """SQL test that every line passes which one of the rules or of the ``others``, SQL tests, may hit."""
    # Java looks for a long text by Boyer and Moore's method, so the last one is an expression too.
    tests = [f"line RLIKE {_sql(f'[{FIRST_CHARS}]')}", f"line RLIKE {_sql(FIRST_TEXT)}", f"({_RUN})"]
    # A rule without an anchor is tested by its pattern.
    tests += [f"line RLIKE {_sql(to_java(rule.pattern))}" for rule in rules if not anchor(rule).first]
    return " OR ".join((*tests, *others))


def _entropy_candidates_sql(line: str, min_length: int) -> str:
    quoted = f"regexp_extract_all({line}, {_sql(_quoted_run(min_length))}, 1)"
    tokens = f"regexp_extract_all({line}, {_sql(_token_run(min_length))}, 0)"
    return f"array_distinct(concat({quoted}, {tokens}))"


def _anchored(rule: Rule) -> str:
    """Necessary condition of a match, on the gate columns of ``detect``."""
    needs = anchor(rule)
    tests = [f"`_has {gate}`" for gate in needs.gates]
    if needs.groups:
        held = " AND ".join(_any("_lowered" if needs.folded else "line", group) for group in needs.groups)
        tests.append(f"({held} OR _odd)" if needs.folded else f"({held})")
    if needs.shape:
        tests.append(f"line RLIKE {_sql(to_java(needs.shape))}")
    # Without any, the pattern itself: a line is handed on only if it matches.
    return " AND ".join(tests) or f"line RLIKE {_sql(to_java(rule.pattern))}"


def _with_gates(lines: DataFrame) -> DataFrame:
    gates = {f"_has {gate}": F.expr(test) for gate, test in _gates().items()}
    return lines.withColumns({"_lowered": F.expr("lower(line)"), "_odd": F.expr(_ODD), **gates})


def values(lines: DataFrame, rule: Rule, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and ``value``, the first group of each match of one rule in ``lines(line, ...)``."""
    groups = F.expr(f"explode(regexp_extract_all(line, {_sql(to_java(rule.pattern))}, 1))")
    return _with_gates(lines).filter(F.expr(_anchored(rule))).select(*keep, groups.alias("value"))


def applies_to(rule: Rule, name: str) -> str:
    """SQL test whether a rule restricted to some files covers a file of this name."""
    tests = (f"{name} = {_sql(glob)} OR endswith({name}, {_sql(glob.lstrip('*'))})" for glob in rule.files)
    return "(" + " OR ".join(tests) + ")"


def file_name_rule(name: Column) -> Column:
    """Position of the first file name rule that hits, or null."""
    return F.coalesce(
        *(F.when(name.rlike(to_java(f"(?i){rule.pattern}")), n) for n, rule in enumerate(FILE_NAME_RULES))
    )


def _by_python(
    lines: DataFrame, rules: Mapping[int, Rule], name: str | None, late: Mapping[str, Column], keep: Sequence[str], distinct: bool
) -> DataFrame:
    """Matches of ``rules`` in lines on which Spark's expressions could find less than ``re``: long ones, or all.

    Only those lines go to Python, in Arrow batches, once for each such rule.
    """
    def reach(rule: Rule) -> str:
        test = f"length(line) >= {python_length(rule.pattern)}"
        return f"{applies_to(rule, name)} AND {test}" if rule.files and name else test

    slots = ", ".join(f"CASE WHEN {reach(rule)} THEN {n} ELSE {NO_SLOT} END" for n, rule in rules.items())
    hits = lines.withColumn("_slots", F.expr(f"array({slots})")).withColumn("slot", F.expr(f"explode(array_remove(_slots, {NO_SLOT}))"))
    rows = hits.select(*keep, *(c.alias(n) for n, c in late.items()), "slot", F.col("line").alias("_line"))
    patterns = {n: rule.pattern for n, rule in rules.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {n: re.compile(pattern) for n, pattern in patterns.items()}
        for batch in batches:
            pairs = zip(batch.column("slot").to_pylist(), batch.column("_line").to_pylist())
            found = [[m.group(0) for m in compiled[slot].finditer(line)] for slot, line in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "_found"])

    schema = StructType([*rows.schema.fields, StructField("_found", ArrayType(StringType()))])
    found = F.array_distinct("_found") if distinct else F.col("_found")
    return rows.mapInArrow(search, schema).select(*keep, *late, "slot", F.posexplode(found).alias("match_pos", "matched"))


def detect(
    lines: DataFrame,
    rules: Sequence[Rule],
    config: AuditConfig,
    *,
    entropy: bool,
    name: str | None = None,
    markers: Mapping[int, tuple[str, str]] | None = None,
    late: Mapping[str, Column] | None = None,
    keep: Sequence[str] = (),
    anchors: bool = True,
    distinct: bool = False,
) -> DataFrame:
    """One row per match in ``lines(line, ...)``: the ``keep`` columns, ``slot``, ``match_pos``, ``matched``
    and, for entropy findings, ``entropy`` in bits per character, rounded.

    ``name`` is the column with the file name, which file-restricted rules are tested on; without it every rule
    runs on every line.  ``markers`` are further slots, each an SQL test and, when it holds, an SQL array of matches.  ``late`` columns are computed only for lines with a slot, and may use any column of ``lines``.
    ``distinct`` leaves out repeated matches of one rule in one line, which deduplication would drop later.
    """
    markers, late = dict(markers or {}), dict(late or {})
    slot, needed = F.col("slot"), _needed_chars(config.entropy_threshold)

    def may_hit(rule: Rule) -> str:
        test = _anchored(rule) if anchors else "line IS NOT NULL"
        return f"{applies_to(rule, name)} AND {test}" if rule.files and name else test

    # Rules whose expressions Java runs up to some length of line; longer lines are left to Python.
    bounds = {n: python_length(rule.pattern) for n, rule in enumerate(rules)}
    python = {n: rules[n] for n, bound in bounds.items() if bound is not None}
    java = {n: rule for n, rule in enumerate(rules) if bounds[n] != 0}
    tests = {n: may_hit(rule) for n, rule in java.items()}
    tests |= {n: f"length(line) < {bounds[n]} AND {tests[n]}" for n in python if n in java}
    found = {n: f"regexp_extract_all(line, {_sql(to_java(rule.pattern))}, 0)" for n, rule in java.items()}
    others = [f"({test})" for test, _ in markers.values()]
    if entropy:
        least = max(config.min_entropy_length, needed)
        if least < RUN_LENGTH:
            others.append(f"line RLIKE {_sql(_token_run(least))}")
        token = f"line RLIKE {_sql(_token_run(least))}"
        if least >= RUN_LENGTH:
            token = f"`_has run` AND {token}"
        tests[ENTROPY_SLOT] = f"({token}) OR (`_has quote` AND line RLIKE {_sql(_quoted_run(least))})"
        found[ENTROPY_SLOT] = _entropy_candidates_sql("line", config.min_entropy_length)
    tests.update({number: test for number, (test, _) in markers.items()})
    found.update({number: strings for number, (_, strings) in markers.items()})
    if not tests:  # nothing to look for
        tests, found = {NO_SLOT - 1: "false"}, {NO_SLOT - 1: "array('')"}

    plain = lines
    if anchors:
        lines = lines.filter(F.expr(_looked_at(list(java.values()), others)))
    lines = _with_gates(lines)
    # The generators take expressions, not columns: for a plain column Spark would infer a size() filter and
    # evaluate the whole column once more for it.
    slots = ", ".join(f"CASE WHEN {test} THEN {n} ELSE {NO_SLOT} END" for n, test in tests.items())
    hits = lines.withColumn("_slots", F.expr(f"array({slots})")).withColumn(
        "slot", F.expr(f"explode(array_remove(_slots, {NO_SLOT}))")
    )
    branches = " ".join(f"WHEN slot = {n} THEN {strings}" for n, strings in found.items())
    matches = F.expr(f"array_distinct(CASE {branches} END)" if distinct else f"CASE {branches} END")
    # `late` goes below the generator: nothing above it then carries the columns it is made from.
    rows = hits.select(*keep, *(c.alias(n) for n, c in late.items()), "slot", "line", *([name] if name and name not in keep else []))
    rows = rows.select(*keep, *late, "slot", F.posexplode(matches).alias("match_pos", "matched"))
    if python:
        rows = rows.unionByName(_by_python(plain, python, name, late, keep, distinct))
    if not entropy:
        return rows.withColumn("entropy", F.lit(None).cast("double"))

    candidate, other = F.col("matched"), slot != ENTROPY_SLOT
    rows = rows.filter(
        other
        | (
            (F.length(candidate) >= needed)
            & ~is_false_positive(candidate)
            & (F.size(distinct_chars(candidate)) >= needed)
        )
    )
    rows = rows.withColumn("entropy", F.when(slot == ENTROPY_SLOT, shannon_entropy(candidate)))
    rows = rows.filter(other | (F.col("entropy") >= config.entropy_threshold - ENTROPY_SLACK))
    return rows.withColumn("entropy", F.bround("entropy", 2))
