"""Inputs of the registered queries, derived from the driver's tables.

The tables hold little to find, so each document gets a few more lines at its end: one that a rule detects, the same
line cut short, and one that must be left alone.  Which rule is asked for follows from the document's id; every
document is kept, whole.  The values are assembled from prefixes and md5 digits, so no secret stands here.

The expressions are the common subset of Spark SQL and DuckDB: the oracles derive the same inputs from the same text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from keysift.plans.settle import shared_dir
from keysift.sources.files import file_name, spread

_Q = "chr(34)"  # double quote


def _is(name: str, value: str) -> str:
    """``name = "value"`` around an SQL value."""
    return f"'{name} = ' || {_Q} || {value} || {_Q}"


def _x(size: int, start: int = 1) -> str:
    """``size`` hex digits of the document's digest."""
    return f"substr(x, {start}, {size})"


_UUID = f"{_x(8)} || '-' || {_x(4, 9)} || '-' || {_x(4, 13)} || '-' || {_x(4, 17)} || '-' || {_x(12, 21)}"
_MIXED = f"'Zq' || {_x(10)} || 'KmXvWtPy' || upper({_x(10, 33)}) || 'jRsUoLnBgH'"

# One line per rule, in catalogue order, that the rule detects.  ``x`` is a column of 256 hex digits.
PLANTED: dict[str, str] = {
    "API-001": f"'use sk-proj-' || {_x(40)}",
    "API-002": f"'use sk-ant-api03-' || {_x(96)}",
    "API-016": f"'use hf_' || {_x(34)}",
    "API-017": f"'use AIzaSy' || {_x(33)}",
    "API-003": f"'use AIza' || {_x(35)}",
    "API-004": f"'id AKIA' || upper({_x(16)})",
    "API-005": f"'AWS_SECRET_ACCESS_KEY: ' || {_x(40)}",
    "API-018": f"'DefaultEndpointsProtocol=https;AccountName=acc' || {_x(4)} || ';AccountKey=' || {_x(86)} || '=='",
    "API-019": _is("azure_client_secret", _x(34)),
    "API-020": _is("cloudflare_api_token", _x(40)),
    "API-021": f"'use dop_v1_' || {_x(64)}",
    "API-015": f"'use sbp_' || {_x(40)}",
    "API-022": f"'open https://app-' || {_x(6)} || '-default-rtdb.firebaseio.com now'",
    "API-006": f"'use ghp_' || {_x(36)} || ' or github_pat_' || {_x(22)} || '_' || {_x(59, 40)}",
    "API-007": f"'use glpat-' || {_x(24)}",
    "API-023": f"'use npm_' || {_x(36)}",
    "API-024": f"'use pypi-AgEIcHlwaS5vcmc' || {_x(60)}",
    "API-025": f"'get https://deploy:' || {_x(16)} || '@ci.host.net/path'",
    "API-008": f"'use sk_live_' || {_x(24)} || ' and rk_test_' || {_x(30)}",
    "API-009": f"'use appl_' || {_x(32)}",
    "API-026": f"'use access_token$production$' || {_x(16)} || '$' || {_x(32)}",
    "API-027": f"'use sq0atp-' || {_x(22)}",
    "API-014": f"'use pk.eyJ1I' || {_x(60)} || '.' || {_x(22)}",
    "MAP-001": _is("YandexMapKitKey", _UUID),
    "MAP-002": "'<meta-data android:name=' || chr(34) || 'com.google.android.geo.API_KEY' || chr(34) || '/>'",
    "MAP-003": _is("dgis_map", _x(20)),
    "SDK-001": f"'dsn https://' || {_x(32)} || '@o12.ingest.sentry.io/4567'",
    "SDK-002": _is("oneSignalApp", _UUID),
    "SDK-003": _is("mixpanel_id", _x(32)),
    "SDK-004": _is("appsflyer_dev_key", _x(22)),
    "SDK-005": _is("appmetrica_id", _x(36)),
    "API-010": f"'use xoxb-' || {_x(24)} || ' https://hooks.slack.com/services/T' || {_x(8)} || '/B' || {_x(8)} || '/' || {_x(24)}",
    "API-011": f"'bot 123456789:' || {_x(35)}",
    "API-012": f"'sid AC' || {_x(32)} || ' SK' || {_x(32, 33)}",
    "API-013": f"'use SG.' || {_x(22)} || '.' || {_x(43)}",
    "API-028": f"'bot M' || {_x(23)} || '.' || {_x(6)} || '.' || {_x(27)} || ' https://discord.com/api/webhooks/123/' || {_x(30)}",
    "API-029": f"'fcm AAAA' || {_x(7)} || ':APA91b' || {_x(134)}",
    "DB-001": f"'db postgres://admin:' || {_x(12)} || '@db.host:5432/app'",
    "DB-002": f"'db jdbc:mysql://db.host/app?user=u&password=' || {_x(12)}",
    "AUTH-001": f"'jwt eyJ' || {_x(20)} || '.eyJ' || {_x(30)} || '.' || {_x(40)}",
    "AUTH-002": f"'header Bearer ' || {_x(32)}",
    "AUTH-003": f"'header Basic ' || {_x(24)}",
    "KEY-001": "'-----BEGIN RSA PRIVATE ' || 'KEY-----'",
    "KEY-002": f"'-----BEGIN PRIVATE ' || 'KEY----- ' || {_x(64)} || ' -----END PRIVATE ' || 'KEY-----'",
    "KEY-003": f"'ssh-rsa AAAAB3NzaC1yc2E' || {_x(128)}",
    "SWIFT-002": _is("ivBytes", _x(16)),
    "IOS-001": f"'ASC_KEY_ID: ' || upper({_x(10)})",
    "IOS-002": f"'  # define MAPS_API_KEY @' || {_Q} || {_x(20)} || {_Q}",
    "CONFIG-001": f"'apple_id(' || {_Q} || 'dev-' || {_x(6)} || '@mail.net' || {_Q} || ')'",
    "ANDROID-001": f"'storePassword=' || {_x(10)}",
    "ANDROID-002": f"'maps.api.key.token = ' || {_x(12)}",
    "ANDROID-003": f"'buildConfigField(' || {_Q} || 'String' || {_Q} || ', ' || {_Q} || 'APP_KEY' || {_Q} || ', ' || {_Q} || {_x(14)} || {_Q} || ')'",
    "ANDROID-004": f"'<string name=' || {_Q} || 'maps_api_key' || {_Q} || '>' || {_x(24)} || '</string>'",
    "CONFIG-002": f"'APP_TOKEN = ' || {_x(16)}",
    "CONFIG-003": f"'export DB_PASSWORD=' || {_x(12)}",
    "SWIFT-001": _is("clientSecretValue", _x(24)),
}
# Further kinds of line: random-looking strings, values and names to leave alone, one secret twice, and two
# secrets with one redaction.
FURTHER = (
    _is("blob", _MIXED),
    f"'data ' || {_MIXED} || ' and ' || lower({_MIXED}) || ' ' || {_x(40)}",
    _is("password", "'changeme'"),
    _is("api_key", "'${' || 'SECRET_FROM_ENV}'"),
    _is("tokenizer", _x(20)),
    f"{_is('token', _x(24))} || ' ; ' || {_is('token', _x(24))}",
    f"'sk-' || {_x(34)} || {_x(6, 60)} || ' sk-' || {_x(4)} || {_x(30, 70)} || {_x(6, 60)}",
    f"'see http://host.net/' || {_x(24)} || ' ./dir/' || {_x(24)} || ' com.app.' || {_x(24)} || ' test' || {_MIXED}",
)
KINDS = (*PLANTED.values(), *FURTHER)

# Rules bound to some files get a fitting suffix three times out of four.
_BOUND = {"MAP-002": ".xml", "KEY-002": ".p8", "ANDROID-002": ".properties", "ANDROID-004": ".xml",
          "CONFIG-002": ".xcconfig", "CONFIG-003": ".sh"}
_SUFFIXES = (".swift", ".kt", ".py", ".json", ".md", ".js", ".env", ".go", ".bin", ".yml", "")
_DIRS = ("Pods/", ".hidden/", "App.xcodeproj/", "sub/build/", "Build/", "src/main/")
_NAMES = (
    "package-lock.json", ".DS_Store_old", "id_rsa", "known_hosts", "service-account-app.json", "credentials.json",
    "server.PEM", ".env", "prod.env", "key.p12", "data.sqlite3", "run.crash", "app.mobileprovision",
    "GoogleService-Info.plist", "Dockerfile", "archive.tar.gz", "trailing.", "Config.swift", "release.keystore",
)


def _case(value: str, options, quoted: bool = True) -> str:
    """The option at position ``value``; the last one stands for every further position."""
    shown = [f"'{o}'" if quoted else f"({o})" for o in options]
    whens = " ".join(f"WHEN {n} THEN {o}" for n, o in enumerate(shown[:-1]))
    return f"CASE {value} {whens} ELSE {shown[-1]} END"


def _name_sql() -> str:
    bound = " ".join(
        f"WHEN kind = {list(PLANTED).index(rule)} AND turn < 3 THEN '{suffix}'" for rule, suffix in _BOUND.items()
    )
    suffix = f"CASE {bound} ELSE {_case('doc_id % 11', _SUFFIXES)} END"
    return f"CASE WHEN kind < {len(PLANTED)} THEN 'f' || doc_id || {suffix} ELSE {_case('doc_id % 19', _NAMES)} END"


# FROM documents -> doc_id, lang, source, kind, planted lines, path and text.
_SEEDED = f"""
    SELECT doc_id, text, lang, source, doc_id % {len(KINDS)} AS kind,
           CAST(floor(doc_id / {len(KINDS)}) AS INT) % 4 AS turn, md5(CAST(doc_id AS STRING)) AS h
    FROM documents"""
_DIGITS = f"""
    SELECT *, h || md5(h) || md5(h || '1') || md5(h || '2') || md5(h || '3') || md5(h || '4') || md5(h || '5') AS x
    FROM ({_SEEDED}) AS seeded"""
_PLANTED = f"""
    SELECT *, {_case('kind', KINDS, quoted=False)} AS planted, {_name_sql()} AS name,
           {_case('doc_id % 13', _DIRS)} AS dir
    FROM ({_DIGITS}) AS digits"""
CORPUS_SQL = f"""
    SELECT doc_id, lang, source, kind, planted, name,
           dir || source || '/' || lang || '/d' || doc_id || '/' || name AS path,
           text || chr(10) || planted || chr(10) || substr(planted, 1, length(planted) - 3) || chr(10) AS text
    FROM ({_PLANTED}) AS planted_lines"""

# The same texts as the additions of commits: a file of its own, and a line in a file that many commits change.
_AUTHORS = ("Ann", "Lee|Ops", "Mo", "Zoe")
RECORD_SQL = f"""
    SELECT doc_id, source AS repo,
           md5('commit' || doc_id) || '|' || {_case('doc_id % 4', _AUTHORS)} || '|day ' || doc_id || chr(10) || chr(10)
           || 'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path
           || chr(10) || '@@ -0,0 +1 @@' || chr(10) || ' kept' || chr(10) || '-' || planted || chr(10) || '+'
           || replace(text, chr(10), chr(10) || '+') || chr(10)
           || 'diff --git a/gone.py b/gone.py' || chr(10) || '--- a/gone.py' || chr(10) || '+++ /dev/null' || chr(10)
           || '-' || planted || chr(10)
           || '--- /dev/null' || chr(10) || '+++ b/shared/config.yml' || chr(10) || '+shared: AKIA'
           || upper(substr(md5('shared' || kind), 1, 16)) || chr(10) || '\\ No newline at end of file' AS record
    FROM ({CORPUS_SQL}) AS corpus""".replace("'\\ No newline", "chr(92) || ' No newline")
STASH_SQL = f"""
    SELECT doc_id, source AS repo,
           CASE WHEN doc_id % 5 = 0 THEN 'WIP without a colon' ELSE 'stash@{{' || doc_id || '}}: WIP on main: work' END
           || chr(10) || '+' || planted || chr(10) || '--- a/' || path || chr(10) || '+++ b/' || path || chr(10)
           || '+' || replace(text, chr(10), chr(10) || '+') AS record
    FROM ({CORPUS_SQL}) AS corpus"""

# The same history as the text of a log; some of its headers are cut short and name no commit.
LOG_SQL = RECORD_SQL.replace("md5('commit' || doc_id) || '|' ||", "CASE WHEN doc_id % 7 = 3 THEN 'cut' ELSE md5('commit' || doc_id) || '|' END ||", 1)


LINE_ENDS_SQL = (
    "CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN 1 THEN replace(text, chr(10), chr(13)) "
    "WHEN 2 THEN substr(text, 1, length(text) - 1) ELSE text END"
)
# Bytes before, of and after the text.  The malformed ones decode to one, three, one and two U+FFFD.
BYTE_HEADS = {1: "X'00'", 4: "unhex(repeat('01', 5000))", 5: "X'FF'", 6: "unhex(repeat('1F', 200))"}
BYTE_TAILS = {2: "X'00'", 5: "X'FFC080'", 6: "X'E28241'", 7: "X'F09F41C3'"}


def _bytes_case(options: dict[int, str]) -> str:
    return "CASE doc_id % 9 " + " ".join(f"WHEN {n} THEN {o}" for n, o in options.items()) + " ELSE X'' END"


BYTES_SQL = (
    _bytes_case(BYTE_HEADS), "CASE WHEN doc_id % 9 = 8 THEN X'' ELSE encode(text, 'UTF-8') END", _bytes_case(BYTE_TAILS)
)


def _from_documents(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    template = sql.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents}")
    return spark.sql(template, documents=documents)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from_documents(spark, sf_dir, CORPUS_SQL)


def line_end_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with each of the three line ends."""
    return corpus(spark, sf_dir).select("path", F.expr(LINE_ENDS_SQL).alias("text"))


def byte_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as bytes: some with NUL early or late, many control characters, malformed UTF-8, or nothing."""
    return corpus(spark, sf_dir).select("path", F.expr(f"concat({', '.join(BYTES_SQL)})").alias("content"))


def _records(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return _from_documents(spark, sf_dir, sql).select(
        "repo", F.col("repo").alias("log_file"), F.lit(0).cast("bigint").alias("log_block"),
        F.col("doc_id").alias("log_row"), "record",
    )


def patch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per document, in order of the ids; each source is a repository with a log of its own."""
    return _records(spark, sf_dir, RECORD_SQL)


def stash_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, STASH_SQL)


def _log_text(spark: SparkSession, sf_dir: str, sql: str, mark: str) -> str:
    """Where the records were written as text: a folder for each repository, of parts in order of the ids."""
    records = _from_documents(spark, sf_dir, sql).select("repo", "doc_id", F.concat(F.lit(mark), "record").alias("value"))
    path = f"{shared_dir(spark)}/keysift-log-{uuid.uuid4().hex}"
    ordered = records.repartitionByRange("repo", "doc_id").sortWithinPartitions("repo", "doc_id")
    ordered.select("repo", "value").write.partitionBy("repo").text(path)
    return path


def patch_log(spark: SparkSession, sf_dir: str) -> str:
    return _log_text(spark, sf_dir, LOG_SQL, "COMMIT:")


def stash_log(spark: SparkSession, sf_dir: str) -> str:
    return _log_text(spark, sf_dir, STASH_SQL, "STASH:")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as files, one per page."""
    table = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return table.select(path.alias("path"), file_name(path).alias("name"), F.col("html").alias("text"))
