"""Findings of files, patch logs and stashes."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keysift.config import AuditConfig
from keysift.functions.text import redact
from keysift.operators.context import join_context
from keysift.operators.detect import ENTROPY_SLOT, detect, file_name_rule
from keysift.operators.lines import split_lines
from keysift.rules.catalog import (
    BUILTIN_RULES,
    ENTROPY_ID,
    ENTROPY_NAME,
    ENTROPY_RECOMMENDATION,
    FILE_AUDIT_ID,
    FILE_AUDIT_RECOMMENDATION,
    FILE_NAME_RULES,
    HISTORY_ENTROPY_ID,
    HISTORY_ENTROPY_NAME,
    HISTORY_ENTROPY_RECOMMENDATION,
    SEVERITY,
    STASH_RECOMMENDATION,
    Rule,
)

FILE_AUDIT_SLOT = ENTROPY_SLOT + 1  # the first of one slot per file name rule
FILE_SLOT = ENTROPY_SLOT - 1  # not a finding: one row per file, which carries its number of lines

FINDING_COLUMNS = (
    "finding_type", "risk_level", "description", "file_path", "line_number", "matched_string", "recommendation",
    "context", "commit_hash", "author", "date", "entropy", "rule_id",
)


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _context(before: Column, line: Column, number: Column, after: Column) -> Column:
    return F.struct(
        before.alias("lines_before"), line.alias("line_content"), number.alias("line_number"), after.alias("lines_after")
    )


def line_context(lines: Column, number: Column, size: int) -> Column:
    """Up to ``size`` lines on both sides of the 1-based line ``number`` of an array of lines."""
    first = F.greatest(number - size, F.lit(1))
    return _context(
        F.slice(lines, first, number - first), F.get(lines, number - 1), number, F.slice(lines, number + 1, F.lit(size))
    )


def lines_alone(findings: DataFrame) -> DataFrame:
    """The findings with their own line as context and none before or after it."""
    line, number = F.col("context.line_content"), F.col("context.line_number")
    return findings.withColumn("context", _context(_no_lines(), line, number, _no_lines()))


def _order(origin: int, file: Column, block: Column, row: Column, part: Column, line: Column) -> Column:
    """Scan order, the tie order of deduplication and of the severity sort."""
    return F.struct(
        F.lit(origin).alias("origin"), file.cast("string").alias("file"), block.cast("bigint").alias("block"),
        row.cast("bigint").alias("row"), part.cast("int").alias("part"), line.cast("int").alias("line"),
        F.col("slot").alias("slot"), F.col("match_pos").alias("match"),
    )


def with_rules(matches: DataFrame, rules: Sequence[Rule], others: Sequence[Rule] = ()) -> DataFrame:
    """Attach the attributes of the rule behind each match; ``others`` take the slots from ``ENTROPY_SLOT`` on.

    The rules are options of the job, not data, so the table is small whatever is scanned.
    """
    slots = [*enumerate(rules), *enumerate(others, ENTROPY_SLOT)]
    rows = [(n, r.id, r.name, r.risk, SEVERITY[r.risk], r.description, r.recommendation) for n, r in slots]
    table = matches.sparkSession.createDataFrame(
        rows, "slot INT, rule_id STRING, finding_type STRING, risk_level STRING, severity INT, rule_description STRING, "
        "recommendation STRING",
    )
    return matches.join(F.broadcast(table), "slot", "left")


def _bits(text: Column) -> Column:
    """The entropy at the end of a description, or nothing for other findings."""
    return F.concat(text, F.when(F.col("entropy").isNotNull(), F.format_string("%.2f bits/char).", "entropy")).otherwise(""))


def scan_files(
    files: DataFrame,
    rules: Sequence[Rule],
    config: AuditConfig = AuditConfig(),
    *,
    per_file: bool = False,
    anchors: bool = True,
    distinct: bool = False,
) -> DataFrame:
    """Findings of ``files(path, name, text)``; ``text`` is null for a binary file, of which only the name is audited.

    The scan of a file needs nothing but its own row, so no shuffle takes place.  With ``per_file`` there is one
    more row per file, with a null ``rule_id``, the file's ``n_lines`` and its ``reason``, if it could not be read,
    so that one pass yields findings, counts and what is missing.
    """
    files = files if "reason" in files.columns else files.withColumn("reason", _no_text())
    files = files.select(
        "path", "name", "reason", F.coalesce(split_lines(F.col("text")), _no_lines()).alias("lines"),
        file_name_rule(F.col("name")).alias("audit"),
    )
    lines = files.select("path", "name", "reason", "lines", "audit", F.posexplode_outer("lines").alias("at", "line"))
    lines = lines.withColumn("line_number", F.coalesce(F.col("at") + 1, F.lit(1))).drop("at")
    markers = {FILE_AUDIT_SLOT: ("line_number = 1 AND audit IS NOT NULL", "array(name)")}
    if per_file:
        markers[FILE_SLOT] = ("line_number = 1", "array('')")
    slot, is_audit = F.col("slot"), F.col("slot") == FILE_AUDIT_SLOT
    matches = detect(
        lines, rules, config, entropy=config.enable_entropy, name="name", markers=markers, anchors=anchors, distinct=distinct,
        keep=("path", "name", "audit", "line_number"),
        late={
            "context": F.when(
                is_audit, _context(_no_lines(), F.concat(F.lit("File: "), "name"), F.lit(1), _no_lines())
            ).when(slot != FILE_SLOT, line_context(F.col("lines"), F.col("line_number"), config.context_lines)),
            "n_lines": F.when(slot == FILE_SLOT, F.size("lines").cast("bigint")),
            "unread": F.when(slot == FILE_SLOT, F.col("reason")),
        },
    )
    return _file_findings(matches.withColumn("slot", F.when(is_audit, slot + F.col("audit")).otherwise(slot)), rules, per_file)


def _file_findings(matches: DataFrame, rules: Sequence[Rule], per_file: bool) -> DataFrame:
    names = [Rule(FILE_AUDIT_ID, "", r.risk, r.name, "", r.description, FILE_AUDIT_RECOMMENDATION) for r in FILE_NAME_RULES]
    entropy = Rule(
        ENTROPY_ID, "", "Medium", ENTROPY_NAME, "", "Detected high Shannon entropy string (", ENTROPY_RECOMMENDATION
    )
    matches = matches.withColumn("seen", _order(0, F.col("path"), F.lit(0), F.lit(0), F.lit(0), F.col("line_number")))
    return with_rules(matches, rules, [entropy, *names]).select(
        "finding_type",
        "risk_level",
        _bits(F.col("rule_description")).alias("description"),
        F.col("path").alias("file_path"),
        "line_number",
        F.when(F.col("slot") >= FILE_AUDIT_SLOT, F.col("matched")).otherwise(redact(F.col("matched"))).alias("matched_string"),
        "recommendation",
        "context",
        _no_text().alias("commit_hash"), _no_text().alias("author"), _no_text().alias("date"),
        "entropy",
        "rule_id",
        "severity",
        "seen",
        *(["n_lines", "unread"] if per_file else []),
    )


def scan_long(
    files: DataFrame, lines: DataFrame, rules: Sequence[Rule], config: AuditConfig = AuditConfig(), *, distinct: bool = False,
    keep: Callable[[DataFrame], DataFrame] = lambda hits: hits,
) -> DataFrame:
    """Findings and per-file rows, as of ``scan_files``, of ``files(path)`` whose ``lines(path, line_number, line)`` are rows.

    The hits are read several times, to find the lines near them; ``keep`` may write them down in between.
    """
    named = lines.withColumn("name", F.element_at(F.split("path", "/"), -1))
    found = detect(
        named, rules, config, entropy=config.enable_entropy, name="name", keep=("path", "line_number", "line"), distinct=distinct
    )
    around = join_context(keep(found), lines, config.context_lines)
    context = _context(F.col("lines_before"), F.col("line"), F.col("line_number"), F.col("lines_after"))
    columns = ("path", "line_number", "slot", "match_pos", "matched", "entropy", "context", "n_lines", "unread")
    none = {"n_lines": F.lit(None).cast("bigint"), "unread": _no_text()}
    around = around.withColumns({"context": context, **none}).select(*columns)

    name = F.element_at(F.split("path", "/"), -1)
    sizes = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))
    files = files if "reason" in files.columns else files.withColumn("reason", _no_text())
    whole = files.select("path", "reason").join(sizes, "path", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    whole = whole.withColumns(
        {
            "line_number": F.lit(1),
            "match_pos": F.lit(0),
            "entropy": F.lit(None).cast("double"),
            "slot": F.explode(F.array_compact(F.array(F.lit(FILE_SLOT), FILE_AUDIT_SLOT + file_name_rule(name)))),
        }
    )
    is_file = F.col("slot") == FILE_SLOT
    whole = whole.withColumns(
        {
            "matched": F.when(is_file, "").otherwise(name),
            "context": F.when(~is_file, _context(_no_lines(), F.concat(F.lit("File: "), name), F.lit(1), _no_lines())),
            "n_lines": F.when(is_file, F.col("n_lines")),
            "unread": F.when(is_file, F.col("reason")),
        }
    )
    return _file_findings(around.unionByName(whole.select(*columns)), rules, per_file=True)


def _scan_added(
    added: DataFrame, attributes: Sequence[Rule], rules: Sequence[Rule], config: AuditConfig, *, origin: int, entropy: bool,
    where: str, name: str | None, distinct: bool,
) -> DataFrame:
    """``attributes`` are the rules as history findings show them; ``where`` comes before the commit."""
    columns = ("file", "line", "commit", "author", "date", "log_file", "log_block", "log_row", "part", "at")
    if name:
        added = added.withColumn(name, F.element_at(F.split("file", "/"), -1))
    matches = detect(added, rules, config, entropy=entropy, name=name, keep=columns, distinct=distinct)
    matches = matches.withColumn(
        "seen",
        _order(origin, F.col("log_file"), F.col("log_block"), F.col("log_row"), F.col("part"), F.col("at")),
    )
    in_commit = F.when(F.col("entropy").isNull(), F.concat("rule_description", F.lit(f" (Found in {where}"), "commit", F.lit(")")))
    in_commit = in_commit.otherwise(F.concat("rule_description", F.lit(" in commit "), "commit", F.lit(" (")))
    return with_rules(matches, attributes[:len(rules)], attributes[len(rules):]).select(
        "finding_type",
        "risk_level",
        _bits(in_commit).alias("description"),
        F.col("file").alias("file_path"),
        F.lit(1).alias("line_number"),
        redact(F.col("matched")).alias("matched_string"),
        "recommendation",
        _context(_no_lines(), F.col("line"), F.lit(1), _no_lines()).alias("context"),
        F.col("commit").alias("commit_hash"), "author", "date",
        "entropy",
        "rule_id",
        "severity",
        "seen",
    )


def scan_patches(
    added: DataFrame, config: AuditConfig = AuditConfig(), *, rules: Sequence[Rule] = BUILTIN_RULES,
    entropy: bool = True, file_filters: bool = False, distinct: bool = False,
) -> DataFrame:
    """Findings of the added lines of a patch log.

    Built-in rules run on every line, whatever the options of the file scan switch off; pass ``rules`` and
    ``file_filters`` to have history judged by the same rules as files.
    """
    shown = [replace(r, id=f"GIT-{r.id}", name=f"Git History: {r.name}") for r in rules]
    secret = Rule(
        HISTORY_ENTROPY_ID, "", "Medium", HISTORY_ENTROPY_NAME, "", "High entropy string", HISTORY_ENTROPY_RECOMMENDATION
    )
    return _scan_added(
        added, [*shown, secret], rules, config, origin=1, entropy=entropy and config.enable_entropy,
        where="Git commit ", name="_name" if file_filters else None, distinct=distinct,
    )


def scan_stashes(
    added: DataFrame, config: AuditConfig = AuditConfig(), *, rules: Sequence[Rule] = BUILTIN_RULES, distinct: bool = False,
) -> DataFrame:
    """Findings of the added lines of stashed changes, by rules only."""
    shown = [
        replace(r, id=f"STASH-{r.id}", name=f"Git Stash: {r.name}", recommendation=STASH_RECOMMENDATION) for r in rules
    ]
    added = added.withColumns({"author": _no_text(), "date": _no_text()})
    return _scan_added(added, shown, rules, config, origin=2, entropy=False, where="", name=None, distinct=distinct)


def union_findings(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def scan_counts(files: DataFrame) -> DataFrame:
    """Files and lines read, from the ``per_file`` rows of a file scan."""
    return files.agg(
        F.count(F.lit(1)).alias("files_scanned"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines_scanned")
    )


def unread_files(files: DataFrame) -> DataFrame:
    """``(path, reason)`` of the files that could not be read, from the ``per_file`` rows of a file scan."""
    return files.filter(F.col("unread").isNotNull()).select(F.col("file_path").alias("path"), F.col("unread").alias("reason"))


def empty_findings(spark: SparkSession) -> DataFrame:
    schema = (
        "finding_type STRING, risk_level STRING, description STRING, file_path STRING, line_number INT, "
        "matched_string STRING, recommendation STRING, context STRUCT<lines_before: ARRAY<STRING>, "
        "line_content: STRING, line_number: INT, lines_after: ARRAY<STRING>>, commit_hash STRING, author STRING, "
        "date STRING, entropy DOUBLE, rule_id STRING, severity INT, seen STRUCT<origin: INT, file: STRING, "
        "block: BIGINT, row: BIGINT, part: INT, line: INT, slot: INT, match: INT>"
    )
    return spark.createDataFrame([], schema)
