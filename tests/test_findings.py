from __future__ import annotations

from pyspark.sql import functions as F

from keysift.operators.findings import audit_gate, dedup_findings, finding_stats, search_findings, sort_severity, top_findings
from keysift.operators.scan import empty_findings, union_findings
from keysift.rules.catalog import SEVERITY


def make(spark, rows):
    """Findings from (type, risk, path, line, matched, origin, row)."""
    schema = empty_findings(spark).schema
    values = [
        (t, risk, f"about {t}", path, line, matched, "move it", ([], f"line {line}", line, []), None, None, None, None, "R", SEVERITY[risk],
         (origin, path, 0, row, 0, line, 0, 0))
        for t, risk, path, line, matched, origin, row in rows
    ]
    return spark.createDataFrame(values, schema).repartition(3)


ROWS = [
    ("Git: key", "High", "a.py", 1, "k", 1, 5), ("Git: key", "High", "a.py", 1, "k", 1, 2), ("Git: key", "High", "a.py", 1, "k2", 1, 9),
    ("key", "Critical", "b.py", 3, "k", 0, 0), ("key", "Critical", "b.py", 3, "k", 0, 0), ("word", "Low", "b.py", 3, "w", 0, 0),
    ("word", "Low", "b.py", 4, "w", 0, 0),
]


def test_first_of_each_key_stays(spark):
    found = dedup_findings(make(spark, ROWS))
    assert found.count() == 5
    assert found.filter("finding_type = 'Git: key' AND matched_string = 'k'").first()["seen"]["row"] == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchange, limits = plan.index("Exchange hashpartitioning"), plan.rindex("WindowGroupLimit")
    assert limits > exchange  # one row per key leaves each task


def test_order(spark):
    found = sort_severity(dedup_findings(make(spark, ROWS))).collect()
    assert [(r["risk_level"], r["line_number"]) for r in found] == [("Critical", 3), ("High", 1), ("High", 1), ("Low", 3), ("Low", 4)]
    assert [r["matched_string"] for r in top_findings(make(spark, ROWS), 2).collect()] == ["k", "k"]


def test_stats(spark):
    row = finding_stats(dedup_findings(make(spark, ROWS))).first().asDict()
    assert row == {"total_findings": 5, "suspicious_lines": 3, "critical_count": 1, "high_count": 2, "medium_count": 0,
                   "low_count": 2, "info_count": 0}
    empty = finding_stats(empty_findings(spark)).first().asDict()
    assert set(empty.values()) == {0}


def test_gate(spark):
    found = make(spark, ROWS)
    assert not audit_gate(found).first()["passed"]
    assert audit_gate(found.filter("risk_level != 'Critical'")).first()["passed"]
    assert audit_gate(empty_findings(spark)).first()["passed"]


def test_search(spark):
    found = make(spark, ROWS)
    assert search_findings(found, "GIT: K").count() == 3
    assert search_findings(found, "b.PY", "Low").count() == 2
    assert search_findings(found, "").count() == len(ROWS)
    assert search_findings(found, "nothing").count() == 0


def test_union(spark):
    found = union_findings([make(spark, ROWS), empty_findings(spark)])
    assert found.agg(F.count(F.lit(1))).first()[0] == len(ROWS)
