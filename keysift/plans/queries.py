"""The registered queries: one per operator, each over whole tables and whole texts."""

from __future__ import annotations

import json
from dataclasses import replace
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keysift.config import AuditConfig, config_from_json, override
from keysift.functions.text import (
    ENTROPY_SLACK,
    format_duration,
    html_escape,
    redact,
    severity_score,
    shannon_entropy,
)
from keysift.operators.context import join_context
from keysift.operators.detect import applies_to, detect, entropy_candidates, is_false_positive, values
from keysift.operators.findings import (
    audit_gate,
    dedup_findings,
    finding_stats,
    search_findings,
    sort_severity,
    top_findings,
)
from keysift.operators.lines import decode_text, explode_lines, is_binary, line_count
from keysift.operators.scan import (
    FINDING_COLUMNS,
    empty_findings,
    lines_alone,
    scan_counts,
    scan_files,
    scan_patches,
    scan_stashes,
    union_findings,
    with_rules,
)
from keysift.plans import corpus as inputs
from keysift.plans.audit import all_findings, run_audit, stats_row
from keysift.plans.settle import settle
from keysift.rules.catalog import BUILTIN_RULES, ENTROPY_ID, FILE_AUDIT_ID, KEYWORD_RULE_ID, RISKS, Rule
from keysift.rules.resolve import active_rules, custom_rule, enabled, rules_table
from keysift.sinks import reports
from keysift.sources.files import (
    file_name,
    in_open_dirs,
    is_included,
    is_kept,
    is_target,
    list_files,
    listed_root,
    path_suffix,
    rel_path,
    tree_listing,
)
from keysift.sources.history import STASH_LOG, read_commits, read_log
from keysift.sources.long_files import RANGE_BYTES, read_ranges
from keysift.sources.patches import file_segments, patch_lines, stash_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Options the queries and their oracles share.
CONFIG = AuditConfig()
NO_ENTROPY = replace(CONFIG, enable_entropy=False)
JSON_OPTIONS = json.dumps(
    {"excluded_dirs": ["src0", "src1"], "included_extensions": [".bin"], "entropy_threshold": 4, "min_entropy_length": 24,
     "enable_entropy": "yes", "context_lines": 3}
)
DISABLED = ("API-001", "SWIFT-001", "DB-002", "KEY-001")
KEYWORDS = (" blob ", "dgis", "", "token", "tokenizer")
CUSTOM = (
    {"id": "CUSTOM-1", "name": "Host path", "pattern": r"host\.net/[0-9a-f]{8}", "risk": "Low"},
    {"pattern": r"\bdata Zq[0-9a-f]+", "risk": "Severe"},
    {"id": "CUSTOM-4", "name": "Python only", "pattern": r"(?P<my_host>host)\.(?:n|e|t)+/[0-9a-f]{,4}", "risk": "Info"},
    {"id": "CUSTOM-3", "name": "Broken", "pattern": r"(unclosed", "risk": "Low"},
)
ROOT = "src/main"
SEARCH = ("KEY", "Critical")
TIMESTAMP = "2024-01-01 00:00:00"
ELAPSED = 1.25
BOUND_RULES = tuple(rule for rule in BUILTIN_RULES if rule.files)


def query(function: Query) -> Query:
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.corpus(spark, sf_dir)


def _name_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.corpus(spark, sf_dir).select("path", "name")


def _where_path(spark: SparkSession, sf_dir: str, test: Column) -> DataFrame:
    return _name_only(spark, sf_dir).filter(test).select("path")


def _file_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_files(_corpus(spark, sf_dir), BUILTIN_RULES, CONFIG)


def _added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patch_lines(inputs.patch_records(spark, sf_dir))


def _stashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stash_lines(inputs.stash_records(spark, sf_dir))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of files that pass the path rules, of patches and of stashes."""
    targets = _corpus(spark, sf_dir).filter(is_target(F.col("path"), CONFIG))
    return union_findings(
        [
            scan_files(targets, BUILTIN_RULES, CONFIG, distinct=True),
            scan_patches(_added(spark, sf_dir), CONFIG, distinct=True),
            scan_stashes(_stashed(spark, sf_dir), CONFIG, distinct=True),
        ]
    )


def _audited(spark: SparkSession, sf_dir: str, *, around: bool = True) -> DataFrame:
    """Deduplicated findings of files that pass the path rules, of patches and of stashes.

    For readers that show no line ``around`` a finding these go before they are shuffled, sorted and written.
    """
    targets = _corpus(spark, sf_dir).filter(is_target(F.col("path"), CONFIG))
    found = scan_files(targets, BUILTIN_RULES, CONFIG, distinct=True)
    if not around:
        found = lines_alone(found)
    return all_findings(found, _added(spark, sf_dir), _stashed(spark, sf_dir), CONFIG)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _corpus(spark, sf_dir).filter(is_target(F.col("path"), CONFIG))
    return scan_counts(targets.select(line_count(F.col("text")).cast("bigint").alias("n_lines")))


SLIM = ("finding_type", "risk_level", "description", "file_path", "line_number", "matched_string", "recommendation",
        "commit_hash", "author", "date", "entropy", "rule_id")


def _slim(findings: DataFrame) -> DataFrame:
    """Findings with the context as texts, which both engines compare alike."""
    return findings.select(
        *SLIM, F.col("context.line_content").alias("line"),
        F.concat_ws("\n", "context.lines_before").alias("lines_before"),
        F.concat_ws("\n", "context.lines_after").alias("lines_after"),
    )


# ---- Sources and scans -------------------------------------------------------------------------------------
@query
def src_files(spark, sf_dir):
    config = replace(CONFIG, included_extensions=CONFIG.included_extensions | {".parquet"})
    listing = tree_listing(spark, sf_dir, config)
    files = list_files(spark, sf_dir, config, longest=RANGE_BYTES, listing=listing)
    files = files.select("path", "name", "length", is_binary(F.col("content")).alias("binary"))
    if listing is None:
        return files
    long = listing.filter(F.col("reason").isNull() & (F.col("length") >= RANGE_BYTES))
    long = read_ranges(long, listed_root(spark, sf_dir))
    return files.unionByName(long.select("path", file_name(F.col("path")).alias("name"), "length", "binary"))


@query
def src_documents(spark, sf_dir):
    return _corpus(spark, sf_dir).select("path", "name", F.md5("text").alias("digest"), line_count(F.col("text")).alias("n_lines"))


@query
def dir_prune(spark, sf_dir):
    return _where_path(spark, sf_dir, in_open_dirs(F.col("path"), CONFIG))


@query
def file_exclude(spark, sf_dir):
    return _where_path(spark, sf_dir, is_kept(F.col("name"), CONFIG))


@query
def file_include(spark, sf_dir):
    return _where_path(spark, sf_dir, is_included(F.col("name"), CONFIG))


@query
def path_suffix_(spark, sf_dir):
    return _name_only(spark, sf_dir).select("path", path_suffix(F.col("name")).alias("suffix"))


@query
def rel_path_(spark, sf_dir):
    return _name_only(spark, sf_dir).select("path", rel_path(F.col("path"), F.lit(ROOT)).alias("relative"))


@query
def is_binary_(spark, sf_dir):
    return inputs.byte_variants(spark, sf_dir).select("path", is_binary(F.col("content")).alias("binary"))


@query
def decode_text_(spark, sf_dir):
    files = inputs.byte_variants(spark, sf_dir)
    return files.select("path", F.md5(decode_text(F.col("content"))).alias("digest"))


@query
def split_lines_(spark, sf_dir):
    return explode_lines(inputs.line_end_variants(spark, sf_dir))


def _repo() -> Column:
    return F.regexp_extract("log_file", "repo=([^/]*)$", 1).alias("repo")


@query
def src_patch_log(spark, sf_dir):
    lines = read_log(spark, inputs.patch_log(spark, sf_dir))
    return lines.select(_repo(), "log_row", "commit", "author", "date", "file", "part", F.col("at").alias("place"), "line")


@query
def patch_commit_meta(spark, sf_dir):
    return read_commits(spark, inputs.patch_log(spark, sf_dir)).select(_repo(), "log_row", "commit", "author", "date")


@query
def patch_file_state(spark, sf_dir):
    return file_segments(inputs.patch_records(spark, sf_dir)).select("repo", "log_row", "part", "file")


@query
def patch_added_lines(spark, sf_dir):
    return _added(spark, sf_dir).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars")
    )


@query
def src_stash_log(spark, sf_dir):
    lines = read_log(spark, inputs.stash_log(spark, sf_dir), STASH_LOG)
    return lines.select(_repo(), "log_row", F.col("commit").alias("stash"), "file", "line")


@query
def cfg_json(spark, sf_dir):
    config = config_from_json(JSON_OPTIONS)
    targets = _corpus(spark, sf_dir).filter(is_target(F.col("path"), config))
    found = scan_files(targets, [], config).filter(F.col("rule_id") == ENTROPY_ID)
    return _slim(found).select("file_path", "line_number", "matched_string", "entropy", "lines_before", "lines_after")


@query
def cfg_overrides(spark, sf_dir):
    config = override(CONFIG, no_entropy=True, exclude_dirs="src2, src3,", exclude_files=["id_rsa"], brief=True)
    targets = _corpus(spark, sf_dir).filter(is_target(F.col("path"), config))
    found = scan_files(targets, BUILTIN_RULES, config)
    return found.select("file_path", "line_number", "rule_id", "matched_string", F.size("context.lines_before").alias("n_before"))


# ---- Rules -------------------------------------------------------------------------------------------------
def _per_rule(spark: SparkSession, sf_dir: str, rules) -> DataFrame:
    """Number of matches of each rule over all files, zeros included."""
    found = scan_files(_corpus(spark, sf_dir), rules, NO_ENTROPY).groupBy(F.col("rule_id").alias("id")).agg(
        F.count(F.lit(1)).alias("matches")
    )
    return rules_table(spark, rules).join(found, "id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


@query
def rule_catalog(spark, sf_dir):
    return _per_rule(spark, sf_dir, BUILTIN_RULES).select(
        "ordinal", "id", "name", "risk", "category", "description", "recommendation", F.size("files").alias("n_files"), "matches"
    )


@query
def rules_by_category(spark, sf_dir):
    return _per_rule(spark, sf_dir, BUILTIN_RULES).groupBy("category", "risk").agg(
        F.count(F.lit(1)).alias("rules"), F.sum("matches").alias("matches")
    )


def _own_rules(spark: SparkSession, **options) -> list[Rule]:
    return active_rules(spark, replace(CONFIG, **options))


@query
def rule_resolve(spark, sf_dir):
    rules = _own_rules(
        spark, disabled_rules=frozenset((*DISABLED, "CUSTOM-1")), keywords=frozenset(KEYWORDS),
        custom_rules=tuple(map(custom_rule, CUSTOM)),
    )
    return _per_rule(spark, sf_dir, rules).select("ordinal", "id", "name", "risk", "matches")


def _only(spark: SparkSession, sf_dir: str, rules) -> DataFrame:
    names = {rule.id for rule in rules}
    found = scan_files(_corpus(spark, sf_dir), rules, NO_ENTROPY).filter(F.col("rule_id").isin(*names))
    return found.select("rule_id", "risk_level", "file_path", "line_number", "matched_string")


@query
def rule_keyword(spark, sf_dir):
    rules = _own_rules(spark, keywords=frozenset(KEYWORDS))
    return _only(spark, sf_dir, [rule for rule in rules if rule.id == KEYWORD_RULE_ID])


@query
def rule_custom(spark, sf_dir):
    return _only(spark, sf_dir, [custom_rule(entry) for entry in CUSTOM[:3]])


@query
def rule_validate(spark, sf_dir):
    rules = _own_rules(spark, custom_rules=tuple(map(custom_rule, CUSTOM)))
    return _only(spark, sf_dir, rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("matches"))


@query
def rule_name_assignment(spark, sf_dir):
    names = next(rule for rule in BUILTIN_RULES if rule.id == "SWIFT-001")
    return values(explode_lines(_corpus(spark, sf_dir)), names, ("path", "line_number"))


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file and file-bound rule that covers it, as literal tests on the name."""
    tests = (f"CASE WHEN {applies_to(rule, 'name')} THEN '{rule.id}' ELSE '' END" for rule in BOUND_RULES)
    rules = F.expr(f"explode(array_remove(array({', '.join(tests)}), ''))")
    return _name_only(spark, sf_dir).select("path", rules.alias("rule_id"))


@query
def rule_file_filter(spark, sf_dir):
    return _covered(spark, sf_dir)


@query
def join_file_rule(spark, sf_dir):
    rules = rules_table(spark).select(F.col("id").alias("rule_id"), "name")
    covered = _covered(spark, sf_dir).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_files"))
    return covered.join(F.broadcast(rules), "rule_id")


@query
def filename_audit(spark, sf_dir):
    found = scan_files(_corpus(spark, sf_dir), [], NO_ENTROPY)
    return _slim(found.filter(F.col("rule_id") == FILE_AUDIT_ID))


@query
def rule_scan(spark, sf_dir):
    return _only(spark, sf_dir, BUILTIN_RULES)


def _slice(rule: Rule) -> Query:
    return lambda spark, sf_dir: _only(spark, sf_dir, [rule])


QUERIES.update({f"rule_{rule.id.replace('-', '_').lower()}": _slice(rule) for rule in BUILTIN_RULES})


# ---- Projections, filters and scalar functions -------------------------------------------------------------
def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = explode_lines(inputs.pages(spark, sf_dir).unionByName(_corpus(spark, sf_dir).select("path", "name", "text")))
    return lines.select(
        "path", "line_number", F.explode(entropy_candidates("line", CONFIG.min_entropy_length)).alias("candidate")
    )


@query
def entropy_candidates_(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query
def entropy_fp_filter(spark, sf_dir):
    return _candidates(spark, sf_dir).filter(~is_false_positive(F.col("candidate")))


@query
def shannon_entropy_(spark, sf_dir):
    return _candidates(spark, sf_dir).select(
        "path", "line_number", "candidate", F.round(shannon_entropy(F.col("candidate")), 6).alias("entropy")
    )


@query
def entropy_threshold(spark, sf_dir):
    return _candidates(spark, sf_dir).filter(
        shannon_entropy(F.col("candidate")) >= CONFIG.entropy_threshold - ENTROPY_SLACK
    )


@query
def entropy_findings(spark, sf_dir):
    return _slim(scan_files(inputs.pages(spark, sf_dir), [], CONFIG).filter(F.col("rule_id") == ENTROPY_ID))


@query
def redact_(spark, sf_dir):
    cut = F.expr("substr(planted, 1, kind)")
    return _corpus(spark, sf_dir).select("doc_id", redact(F.col("planted")).alias("whole"), redact(cut).alias("part"))


@query
def line_context(spark, sf_dir):
    return _slim(scan_files(_corpus(spark, sf_dir), BUILTIN_RULES, NO_ENTROPY)).select(
        "file_path", "line_number", "rule_id", "line", "lines_before", "lines_after"
    )


@query
def context_brief(spark, sf_dir):
    found = scan_files(_corpus(spark, sf_dir), BUILTIN_RULES, override(NO_ENTROPY, brief=True))
    return _slim(found).select("file_path", "line_number", "rule_id", "line", "lines_before", "lines_after")


@query
def format_duration_(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seconds, thousandths = F.col("n_chars") / 64.0, F.col("n_chars") / 1000.0
    return documents.select(
        "doc_id", format_duration(seconds).alias("long"), format_duration(seconds / 4096).alias("short"),
        format_duration(thousandths).alias("thousandths"), format_duration(thousandths / 100).alias("decimals"),
    )


@query
def severity_score_(spark, sf_dir):
    found = _only(spark, sf_dir, BUILTIN_RULES)
    return found.groupBy("risk_level", severity_score(F.col("risk_level")).alias("severity")).agg(
        F.count(F.lit(1)).alias("findings")
    )


@query
def search_findings_(spark, sf_dir):
    return _slim(search_findings(dedup_findings(_file_findings(spark, sf_dir)), *SEARCH))


@query
def html_escape_(spark, sf_dir):
    pages = inputs.pages(spark, sf_dir)
    return pages.select("path", F.md5(html_escape(F.col("text"))).alias("digest"))


# ---- History -----------------------------------------------------------------------------------------------
@query
def patch_rule_scan(spark, sf_dir):
    return _slim(scan_patches(_added(spark, sf_dir), CONFIG, entropy=False))


@query
def patch_entropy_scan(spark, sf_dir):
    return _slim(scan_patches(_added(spark, sf_dir), CONFIG, rules=[]))


@query
def stash_rule_scan(spark, sf_dir):
    return _slim(scan_stashes(_stashed(spark, sf_dir), CONFIG))


@query
def first_commit_per_secret(spark, sf_dir):
    return _slim(dedup_findings(scan_patches(_added(spark, sf_dir), CONFIG, entropy=False))).select(
        "file_path", "finding_type", "matched_string", "commit_hash", "author", "date"
    )


# ---- Joins -------------------------------------------------------------------------------------------------
def _raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = explode_lines(_corpus(spark, sf_dir)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return detect(lines, BUILTIN_RULES, NO_ENTROPY, entropy=False, name="name", keep=("path", "line_number"))


@query
def join_rule_meta(spark, sf_dir):
    return with_rules(_raw_matches(spark, sf_dir), BUILTIN_RULES).select(
        "path", "line_number", "matched", "rule_id", "finding_type", "risk_level", "recommendation"
    )


@query
def anti_disabled_rules(spark, sf_dir):
    disabled = spark.createDataFrame([(rule,) for rule in DISABLED], "id STRING")
    return enabled(_per_rule(spark, sf_dir, BUILTIN_RULES), disabled).select("ordinal", "id", "matches")


@query
def join_context_(spark, sf_dir):
    lines = explode_lines(_corpus(spark, sf_dir))
    # The hits are read three times, so the rules run once and their hits are written.
    hits = settle(_raw_matches(spark, sf_dir).select("path", "line_number").distinct(), "hits")
    return join_context(hits, lines, 5).select(
        "path", "line_number", F.concat_ws("\n", "lines_before").alias("lines_before"),
        F.concat_ws("\n", "lines_after").alias("lines_after"),
    )


# ---- Aggregations, set operations, order -------------------------------------------------------------------
@query
def union_findings_(spark, sf_dir):
    return _slim(
        union_findings(
            [_file_findings(spark, sf_dir), scan_patches(_added(spark, sf_dir), CONFIG), scan_stashes(_stashed(spark, sf_dir), CONFIG)]
        )
    )


@query
def dedup_findings_(spark, sf_dir):
    return _slim(_audited(spark, sf_dir))


@query
def sort_severity_(spark, sf_dir):
    return sort_severity(_audited(spark, sf_dir)).select("severity", *SLIM)


@query
def top_findings_(spark, sf_dir):
    return _slim(top_findings(_audited(spark, sf_dir)))


@query
def stats_by_risk(spark, sf_dir):
    return finding_stats(_audited(spark, sf_dir)).drop("suspicious_lines")


@query
def suspicious_lines(spark, sf_dir):
    return finding_stats(_audited(spark, sf_dir)).select("suspicious_lines")


@query
def scan_counts_(spark, sf_dir):
    return _counts(spark, sf_dir)


@query
def critical_high(spark, sf_dir):
    stats = finding_stats(_audited(spark, sf_dir))
    return stats.select((F.col("critical_count") + F.col("high_count")).alias("critical_high"))


@query
def audit_gate_(spark, sf_dir):
    # One critical finding fails the audit, however often it occurs, so nothing is deduplicated for it.
    return audit_gate(_found(spark, sf_dir))


@query
def scan_elapsed(spark, sf_dir):
    """The statistics of a whole audit; how long it took differs each time, that it is told does not."""
    targets = _corpus(spark, sf_dir).filter(is_target(F.col("path"), CONFIG))
    stats = run_audit(targets, CONFIG).stats
    return stats.select("files_scanned", "lines_scanned", (F.col("elapsed_time_seconds") > 0).alias("timed"))


STATS = ("files_scanned", "lines_scanned", "total_findings", "suspicious_lines", *(f"{risk.lower()}_count" for risk in RISKS))


# ---- Sinks -------------------------------------------------------------------------------------------------
def _stats(spark: SparkSession, sf_dir: str, findings: DataFrame) -> DataFrame:
    return stats_row(_counts(spark, sf_dir), finding_stats(findings), ELAPSED)


def _report(render, *, around: bool = True) -> Query:
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        numbered = reports.number_findings(_audited(spark, sf_dir, around=around))
        return render(numbered, _stats(spark, sf_dir, numbered), "corpus", TIMESTAMP)

    return rows


QUERIES["sink_markdown"] = _report(reports.markdown_rows, around=False)
QUERIES["sink_text"] = _report(reports.text_rows, around=False)
QUERIES["sink_html_cards"] = _report(reports.html_rows)


def _json_rows(spark: SparkSession, sf_dir: str, section: int) -> DataFrame:
    # The findings are section 1; the head and the end show none.
    return _report(reports.json_rows, around=section == 1)(spark, sf_dir).filter(F.col("section") == section)


@query
def sink_json(spark, sf_dir):
    """The findings of the JSON report, read back."""
    value = F.ltrim("value", F.lit(","))
    rows = _json_rows(spark, sf_dir, 1).select(F.from_json(value, empty_findings(spark).select(*FINDING_COLUMNS).schema).alias("finding"))
    return _slim(rows.select("finding.*"))


@query
def sink_json_summary(spark, sf_dir):
    """The head of the JSON report, closed and read back."""
    stats = "struct<" + ", ".join(f"{c}: bigint" for c in STATS) + ", elapsed_time_seconds: double>"
    value = F.concat(F.col("value"), F.lit("]}"))
    head = _json_rows(spark, sf_dir, 0).select(F.from_json(value, f"scanned_path string, scan_timestamp string, stats {stats}").alias("report"))
    return head.select("report.scanned_path", "report.scan_timestamp", "report.stats.*")


@query
def sink_console(spark, sf_dir):
    findings = settle(_audited(spark, sf_dir), "findings")
    return reports.console_rows(findings, _stats(spark, sf_dir, findings), "corpus")


@query
def sink_switch(spark, sf_dir):
    """Rows of each report that is switched on."""
    targets = _corpus(spark, sf_dir).filter(is_target(F.col("path"), CONFIG))
    audit = run_audit(targets, replace(CONFIG, html=False), scanned="corpus")
    kinds = [rows.select(F.lit(kind).alias("report"), "section") for kind, rows in reports.report_rows(audit, TIMESTAMP).items()]
    return union_findings(kinds).groupBy("report", "section").agg(F.count(F.lit(1)).alias("blocks"))
