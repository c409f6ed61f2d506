"""Reports as rows of text, ordered by ``(section, idx)``, and their writers.

Every block of a report is one row, rendered where its finding is; a report is the rows in order.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from keysift.functions.text import format_duration, html_escape
from keysift.operators.findings import severity_order, sort_severity, top_findings
from keysift.operators.scan import FINDING_COLUMNS
from keysift.plans.audit import Audit
from keysift.plans.settle import settle
from keysift.rules.catalog import RISKS

_ROW_BITS = 33  # of monotonically_increasing_id, below the partition number
NO_FINDINGS = "Nothing that looks like a credential was found."
TOP = 10
JSON_FINDINGS = '},"findings":['  # after the last field of the statistics


def number_findings(findings: DataFrame) -> DataFrame:
    """Add ``idx``, 1, 2, ... in report order.

    The sorted rows keep their partition and place in it; a partition's start is the number of rows in those
    before it, so no task sees all findings.  The sum of starts runs over one row per partition.
    """
    placed = settle(sort_severity(findings).withColumn("_place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_start"))
    row = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("idx", F.col("_start") + row + 1)
        .drop("_place", "_part", "_start")
    )


def _lines(*parts: Column | str) -> Column:
    """Lines of text; a null part is left out."""
    return F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _say(template: str, *values: Column | str) -> Column:
    """Text with a value in place of each ``{}``."""
    pieces: list[Column] = [F.lit(template.split("{}")[0])]
    for value, rest in zip(values, template.split("{}")[1:]):
        shown = F.col(value) if isinstance(value, str) else value
        pieces += [shown.cast("string"), F.lit(rest)]
    return F.concat(*pieces)


def _thousands(column: str) -> Column:
    return F.format_number(F.col(column), 0)


def _rows(section: int, frame: DataFrame, value: Column, idx: Column | None = None) -> DataFrame:
    place = F.lit(0) if idx is None else idx
    return frame.select(F.lit(section).alias("section"), place.cast("bigint").alias("idx"), value.alias("value"))


def _tally() -> Column:
    """How many findings there are of each risk, gravest first."""
    return F.concat_ws(", ", *(_say(f"{{}} {risk.lower()}", f"{risk.lower()}_count") for risk in RISKS))


def _volume() -> Column:
    return _say("{} files with {} lines, read in {}", _thousands("files_scanned"), _thousands("lines_scanned"),
                format_duration(F.col("elapsed_time_seconds")))


def _place() -> Column:
    return _say("{}:{}", "file_path", "line_number")


def _origin() -> Column:
    """The commit of a finding of history, null for any other."""
    who = F.concat_ws(", ", F.nullif("author", F.lit("")), F.nullif("date", F.lit("")))
    commit = F.col("commit_hash")
    return F.when(commit != "", F.when(who == "", commit).otherwise(F.concat(commit, F.lit(" ("), who, F.lit(")"))))


# ---- Markdown ----------------------------------------------------------------------------------------------
def markdown_rows(numbered: DataFrame, stats: DataFrame, scanned: str, timestamp: str) -> DataFrame:
    """A headline, an index of all findings, then each finding under its place."""
    index = _lines("", "| # | Place | Finding | Risk | Value |", "| ---: | --- | --- | --- | --- |")
    head = _lines(
        f"# Leaked credentials in `{scanned}`",
        "",
        F.when(F.col("total_findings") == 0, NO_FINDINGS).otherwise(_say("{} findings: {}.", "total_findings", _tally())),
        "",
        _say("_{}; {}._", F.lit(timestamp), _volume()),
        F.when(F.col("total_findings") > 0, index),
    )
    entry = _say("| {} | {} | {} | {} | `{}` |", "idx", _place(), "finding_type", "risk_level",
                 F.replace("matched_string", F.lit("|"), F.lit("\\|")))
    detail = _lines(
        _say("## {}. {}", "idx", _place()),
        "",
        _say("{} risk, {}: {}", "risk_level", "finding_type", "description"),
        "",
        "~~~",
        F.col("context.line_content"),
        "~~~",
        "",
        _say("Next: {}", "recommendation"),
        F.when(_origin().isNotNull(), _say("\nIntroduced by {}", _origin())),
        "",
    )
    return (
        _rows(0, stats, head)
        .unionByName(_rows(1, numbered, entry, F.col("idx")))
        .unionByName(_rows(2, stats.filter(F.col("total_findings") > 0), F.lit("")))
        .unionByName(_rows(3, numbered, detail, F.col("idx")))
    )


# ---- Plain text --------------------------------------------------------------------------------------------
def text_rows(numbered: DataFrame, stats: DataFrame, scanned: str, timestamp: str) -> DataFrame:
    """Three lines of summary, then a paragraph per finding."""
    head = _lines(
        f"keysift {timestamp} {scanned}",
        _volume(),
        _say("{} findings: {}", "total_findings", _tally()),
        "",
    )
    block = _lines(
        _say("{} {} [{}]", "idx", _place(), F.lower("risk_level")),
        _say("  {} = {}", "finding_type", "matched_string"),
        _say("  | {}", F.col("context.line_content")),
        _say("  {}", "description"),
        _say("  {}", "recommendation"),
        "",
    )
    return _rows(0, stats, head).unionByName(_rows(1, numbered, block, F.col("idx")))


# ---- HTML cards --------------------------------------------------------------------------------------------
def html_rows(numbered: DataFrame, stats: DataFrame, scanned: str, timestamp: str) -> DataFrame:
    """A static page: a summary, then one card per finding, which opens with the code."""
    head = _lines(
        "<!DOCTYPE html>",
        '<html lang="en"><meta charset="utf-8"><title>keysift</title>',
        _say("<header><h1>{}</h1><time>{}</time>", html_escape(F.lit(scanned)), html_escape(F.lit(timestamp))),
        _say("<p>{} findings: {}</p>", "total_findings", _tally()),
        _say("<p>{}</p></header>", _volume()),
        F.when(F.col("total_findings") == 0, f'<p class="clean">{NO_FINDINGS}</p>'),
    )

    def escaped(column: str) -> Column:
        return html_escape(F.col(column))

    before, after = F.col("context.lines_before"), F.col("context.lines_after")
    code = _lines(
        F.when(F.size(before) > 0, html_escape(F.concat_ws("\n", before))),
        _say("<mark>{}</mark>", escaped("context.line_content")),
        F.when(F.size(after) > 0, html_escape(F.concat_ws("\n", after))),
    )
    around = F.when(F.size(before) + F.size(after) > 0, "around").otherwise("alone")

    def item(term: str, value: Column) -> Column:
        return _say(f"<dt>{term}<dd>{{}}", value)

    card = _lines(
        _say('<article id="f{}" class="{}">', "idx", F.lower("risk_level")),
        _say("<h2>{}:{}</h2>", escaped("file_path"), "line_number"),
        _say('<pre class="{}" data-line="{}">{}</pre>', around, "line_number", code),
        "<dl>",
        item("kind", escaped("finding_type")),
        item("risk", F.col("risk_level")),
        item("value", escaped("matched_string")),
        item("why", escaped("description")),
        item("next", escaped("recommendation")),
        F.when(_origin().isNotNull(), item("commit", html_escape(_origin()))),
        "</dl></article>",
    )
    return (
        _rows(0, stats, head)
        .unionByName(_rows(1, numbered, card, F.col("idx")))
        .unionByName(_rows(2, stats, F.lit("</html>")))
    )


# ---- Console -----------------------------------------------------------------------------------------------
def console_rows(findings: DataFrame, stats: DataFrame, scanned: str) -> DataFrame:
    """Statistics and the gravest findings: a bounded number of rows whatever the size of the audit."""
    head = _lines(
        f"keysift: {scanned}",
        _volume(),
        F.when(F.col("total_findings") == 0, NO_FINDINGS).otherwise(
            _say("{} findings on {} lines: {}", "total_findings", "suspicious_lines", _tally())
        ),
        F.when(F.col("total_findings") > 0, _say("\nThe gravest {}:", F.least(F.lit(TOP), F.col("total_findings")))),
    )
    top = top_findings(findings, TOP).withColumn("idx", F.row_number().over(Window.orderBy(*severity_order())))
    entry = _lines(
        _say("{} {} {}", F.format_string("%2d", "idx"), F.rpad("risk_level", 8, " "), _place()),
        _say("   {}: {}", "finding_type", "matched_string"),
        _say("   {}", "recommendation"),
    )
    more = _say("{} more; all of them are in the report files.", F.col("total_findings") - TOP)
    return (
        _rows(0, stats, head)
        .unionByName(_rows(1, top, entry, F.col("idx")))
        .unionByName(_rows(2, stats.filter(F.col("total_findings") > TOP), more))
    )


# ---- JSON --------------------------------------------------------------------------------------------------
def json_report(stats: DataFrame, scanned: str, timestamp: str) -> DataFrame:
    return stats.select(
        F.lit(scanned).alias("scanned_path"), F.lit(timestamp).alias("scan_timestamp"),
        F.struct(*stats.columns).alias("stats"),
    )


def json_rows(numbered: DataFrame, stats: DataFrame, scanned: str, timestamp: str) -> DataFrame:
    """One JSON object: path, time and statistics, then all findings in report order; the rows concatenate to it."""
    report = json_report(stats, scanned, timestamp)
    opened = F.concat(F.rtrim(F.to_json(F.struct(*report.columns)), F.lit("}")), F.lit(JSON_FINDINGS))
    finding = F.to_json(F.struct(*FINDING_COLUMNS), {"ignoreNullFields": "false"})
    entry = F.concat(F.when(F.col("idx") > 1, ",").otherwise(""), finding)
    return (
        _rows(0, report, opened)
        .unionByName(_rows(1, numbered, entry, F.col("idx")))
        .unionByName(_rows(2, report, F.lit("]}")))
    )


# ---- Writers -----------------------------------------------------------------------------------------------
def report_rows(audit: Audit, timestamp: str) -> dict[str, DataFrame]:
    """Rows of each report that is switched on; the findings are numbered once for all of them."""
    writers = {"markdown": markdown_rows, "text": text_rows, "html": html_rows, "json": json_rows}
    wanted = {kind: rows for kind, rows in writers.items() if getattr(audit.config, kind)}
    if not wanted:
        return {}
    numbered = number_findings(audit.findings)
    return {kind: rows(numbered, audit.stats, audit.scanned, timestamp) for kind, rows in wanted.items()}


def output_dir(audit: Audit, folder: str | None) -> str:
    """The folder asked for, else the scanned one; the working directory when that is not a folder."""
    spark = audit.findings.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder or audit.scanned or ".")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    is_folder = fs.exists(path) and fs.getFileStatus(path).isDirectory()
    return path.toString() if is_folder else fs.getWorkingDirectory().toString()


def write_reports(audit: Audit, folder: str | None = None, timestamp: str | None = None) -> str:
    """Write every report that is switched on below the output folder, each as a folder of ordered parts."""
    timestamp = timestamp or datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    out = output_dir(audit, folder)
    for kind, rows in report_rows(audit, timestamp).items():
        rows.orderBy("section", "idx").select("value").write.mode("overwrite").text(f"{out}/report-{kind}")
    return out


def print_summary(audit: Audit) -> None:
    for row in console_rows(audit.findings, audit.stats, audit.scanned).orderBy("section", "idx").collect():
        print(row["value"])
