"""The whole audit: one pass over the files, one over the history, then only findings are moved."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import partial
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from keysift.config import AuditConfig
from keysift.operators.findings import audit_gate, dedup_findings, finding_stats
from keysift.operators.scan import scan_counts, scan_files, scan_long, scan_patches, scan_stashes, union_findings, unread_files
from keysift.plans.settle import forget, settle
from keysift.rules.catalog import Rule
from keysift.rules.resolve import active_rules
from keysift.sources.files import read_files, tree_listing
from keysift.sources.long_files import LONG_BYTES, RANGE_BYTES, long_parts
from keysift.sources.history import STASH_LOG, read_log


@dataclass(frozen=True)
class Audit:
    scanned: str
    findings: DataFrame  # deduplicated, with `severity` and `seen`
    stats: DataFrame  # one row
    config: AuditConfig
    unread: DataFrame  # path and reason of every file and folder that could not be read
    tables: list[str] = field(default_factory=list)  # settled, until the audit is closed

    def close(self) -> None:
        """Delete the audit's tables, which hold unredacted lines; its findings cannot be read afterwards."""
        forget(self.findings.sparkSession, self.tables)

    def __enter__(self) -> Audit:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def passed(self) -> bool:
        return audit_gate(self.findings).first()["passed"]


def all_findings(
    file_findings: DataFrame, patches: DataFrame | None, stashes: DataFrame | None, config: AuditConfig
) -> DataFrame:
    """File findings first, then those of added patch and stash lines; the first of each key stays."""
    parts = [file_findings]
    if config.enable_history:
        if patches is not None:
            parts.append(scan_patches(patches, config, distinct=True))
        if stashes is not None:
            parts.append(scan_stashes(stashes, config, distinct=True))
    return dedup_findings(union_findings(parts))


def stats_row(counts: DataFrame, found: DataFrame, elapsed: float) -> DataFrame:
    """Two one-row tables side by side."""
    both = counts.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("elapsed_time_seconds", F.lit(round(elapsed, 3)))


def run_audit(
    files: DataFrame,
    config: AuditConfig = AuditConfig(),
    *,
    patches: DataFrame | None = None,
    stashes: DataFrame | None = None,
    long: tuple[DataFrame, DataFrame] | None = None,
    rules: Sequence[Rule] | None = None,
    scanned: str = "",
    unlisted: DataFrame | None = None,
) -> Audit:
    """Audit ``files(path, name, text)`` and, if given, long files and added lines of patches and stashes.

    Files with a ``reason`` could not be read: they count as scanned, and are told in ``unread`` and the statistics'
    ``files_unread``, as are the folders of ``unlisted(path, reason)`` in ``folders_unread``.
    """
    started = time.perf_counter()
    rules = active_rules(files.sparkSession, config) if rules is None else rules
    scanned_tables: list[str] = []
    tables: list[str] = []
    scan = scan_files(files, rules, config, per_file=True, distinct=True)
    if long is not None:
        hits = partial(settle, label="hits", written=scanned_tables)
        scan = scan.unionByName(scan_long(*long, rules, config, distinct=True, keep=hits))
    scan = settle(scan, "scan", scanned_tables)
    found = scan.filter(F.col("rule_id").isNotNull()).drop("n_lines", "unread")
    findings = settle(all_findings(found, patches, stashes, config), "findings", tables)
    per_file = scan.filter(F.col("rule_id").isNull())
    lost = unread_files(per_file).withColumn("is_folder", F.lit(False))
    if unlisted is not None:
        lost = lost.unionByName(unlisted.select("path", "reason", F.lit(True).alias("is_folder")))
    lost = settle(lost, "unread", tables)
    counts = scan_counts(per_file)
    missing = lost.agg(F.count_if(~F.col("is_folder")).alias("files_unread"), F.count_if("is_folder").alias("folders_unread"))
    counts = counts.withColumn("_one", F.lit(1)).join(missing.withColumn("_one", F.lit(1)), "_one").drop("_one")
    stats = settle(stats_row(counts, finding_stats(findings), time.perf_counter() - started), "stats", tables)
    forget(files.sparkSession, scanned_tables)
    return Audit(scanned, findings, stats, config, lost.select("path", "reason"), tables)


def audit_tree(
    spark: SparkSession,
    root: str,
    config: AuditConfig = AuditConfig(),
    *,
    patch_log: str | None = None,
    stash_log: str | None = None,
    long_bytes: int = LONG_BYTES,
    range_bytes: int = RANGE_BYTES,
) -> Audit:
    """Audit a tree of files together with its exported history; long files are scanned in ranges of bytes.

    The tree is listed once.  A file or folder that cannot be read does not end the audit, nor does it vanish: see
    ``Audit.unread`` and the statistics.  Only a long file that fails after its head was read ends it.
    """
    written: list[str] = []
    listing = tree_listing(spark, root, config, written)
    audit = run_audit(
        read_files(spark, root, config, longest=long_bytes, listing=listing),
        config,
        long=None if listing is None else long_parts(spark, root, config, long_bytes, listing, range_bytes, written),
        patches=read_log(spark, patch_log) if patch_log else None,
        stashes=read_log(spark, stash_log, STASH_LOG) if stash_log else None,
        scanned=root,
        unlisted=None if listing is None else listing.filter(F.col("reason").isNotNull()),
    )
    forget(spark, written)
    return audit
