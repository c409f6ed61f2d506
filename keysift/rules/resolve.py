"""The rules one scan uses: built-ins, minus switched-off ones, plus the user's own."""

from __future__ import annotations

import re
import warnings
from dataclasses import replace
from typing import Any, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from keysift.config import AuditConfig
from keysift.functions.regex import compiles, problem
from keysift.rules.catalog import BUILTIN_RULES, KEYWORD_RULE, RISKS, Rule, name_assignment

RULE_SCHEMA = (
    "ordinal INT, id STRING, name STRING, pattern STRING, risk STRING, description STRING, "
    "recommendation STRING, files ARRAY<STRING>, category STRING"
)


def clean_keywords(keywords: Iterable[str]) -> list[str]:
    """Distinct non-blank keywords, longest first so that a longer word wins over its own prefix."""
    return sorted({word.strip() for word in keywords if word and word.strip()}, key=lambda word: (-len(word), word))


def keyword_rule(keywords: Iterable[str]) -> Rule | None:
    words = clean_keywords(keywords)
    if not words:
        return None
    return replace(KEYWORD_RULE, pattern=name_assignment("|".join(map(re.escape, words))), keywords=tuple(words))


def custom_rule(entry: Mapping[str, Any]) -> Rule:
    """A user's rule from its stored form, an object with id, name, pattern and risk."""
    risk = entry.get("risk", "High")
    return Rule(
        id=entry.get("id", "CUSTOM"),
        category="Custom",
        risk=risk if risk in RISKS else "High",
        name=entry.get("name") or "Custom Rule",
        pattern=entry.get("pattern", ""),
        description="User-defined detection rule.",
        recommendation="Review this match and move the value out of the repository if it is a secret.",
    )


def next_custom_id(used: Iterable[str]) -> str:
    taken, number = set(used), 1
    while f"CUSTOM-{number}" in taken:
        number += 1
    return f"CUSTOM-{number}"


def rule_problems(spark: SparkSession, config: AuditConfig) -> list[tuple[str, str]]:
    """Id and reason of each of the user's rules that cannot run."""
    found = ((rule.id, problem(spark, rule.pattern)) for rule in config.custom_rules)
    return [(rule_id, reason) for rule_id, reason in found if reason]


def active_rules(spark: SparkSession, config: AuditConfig) -> list[Rule]:
    """Rules in scan order.  A user's rule that cannot run is left out with a warning instead of failing the job."""
    added = [rule for rule in (keyword_rule(config.keywords), *config.custom_rules) if rule]
    for rule_id, reason in rule_problems(spark, config):
        warnings.warn(f"rule {rule_id} is left out: {reason}", stacklevel=2)
    added = [rule for rule in added if compiles(spark, rule.pattern)]
    return [rule for rule in (*BUILTIN_RULES, *added) if rule.id not in config.disabled_rules]


def rules_table(spark: SparkSession, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    rows = [
        (n, r.id, r.name, r.pattern, r.risk, r.description, r.recommendation, list(r.files), r.category)
        for n, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def enabled(rules: DataFrame, disabled: DataFrame) -> DataFrame:
    """Rules whose id is not in ``disabled(id)``."""
    return rules.join(F.broadcast(disabled.select("id").distinct()), "id", "left_anti")
