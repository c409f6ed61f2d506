"""What is done with findings: deduplicate, sort, count, search, pass or fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keysift.rules.catalog import RISKS

KEY = ("file_path", "line_number", "finding_type", "matched_string")


def severity_order() -> tuple[Column, Column]:
    """Gravest first, then scan order."""
    return F.col("severity").desc(), F.col("seen").asc()


def dedup_findings(findings: DataFrame) -> DataFrame:
    """The first finding of each key in scan order.

    Spark limits each key to one row before the shuffle, so copies of one secret never meet in one task.
    """
    first = Window.partitionBy(*KEY).orderBy("seen")
    return findings.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def sort_severity(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*severity_order())


def top_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    return findings.orderBy(*severity_order()).limit(n)


def _count_of(risk: str) -> Column:
    return F.count_if(F.col("risk_level") == risk).alias(f"{risk.lower()}_count")


def finding_stats(findings: DataFrame) -> DataFrame:
    """One row: number of findings, of distinct lines with one, and of each risk level, zeros included.

    Grouping by line first lets both the distinct count and the sums be pre-aggregated before the shuffle.
    """
    lines = findings.groupBy("file_path", "line_number").agg(
        F.count(F.lit(1)).alias("total_findings"), *(_count_of(risk) for risk in RISKS)
    )
    counts = ["total_findings", *(f"{risk.lower()}_count" for risk in RISKS)]
    return lines.agg(
        F.count(F.lit(1)).alias("suspicious_lines"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts),
    ).select("total_findings", "suspicious_lines", *counts[1:])


def audit_gate(findings: DataFrame) -> DataFrame:
    """Whether the audit passes: no finding is critical."""
    return findings.agg((F.count_if(F.col("risk_level") == "Critical") == 0).alias("passed"))


def search_findings(findings: DataFrame, query: str = "", risk: str = "ALL") -> DataFrame:
    text = F.lower(F.concat_ws(" ", "finding_type", "file_path", "description"))
    found = F.contains(text, F.lit(query.lower()))
    return findings.filter(found if risk == "ALL" else found & (F.col("risk_level") == risk))
