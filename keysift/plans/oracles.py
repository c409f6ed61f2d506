"""Plain SQL for the registered queries, as DuckDB runs it on the same tables.

DuckDB's expressions have no lookahead.  For the rules with one, the banned first characters are folded into the
value's first character, and junk values are filtered out after the match.
"""

from __future__ import annotations

from dataclasses import replace

from keysift.config import AuditConfig
from keysift.operators.detect import DOTTED_ID, HEX_HASH, PLACEHOLDERS, URL, UUID
from keysift.plans import queries as q
from keysift.plans.corpus import BYTE_HEADS, BYTE_TAILS, CORPUS_SQL, LINE_ENDS_SQL, RECORD_SQL, LOG_SQL, STASH_SQL
from keysift.rules import catalog as c

CONFIG = q.CONFIG
ORACLES: dict[str, str] = {}


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(text(v) for v in sorted(values)) + ")"


# ---- Lines -------------------------------------------------------------------------------------------------
def with_(*named: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in named) + "\n"


CORPUS = ("corpus", CORPUS_SQL)
PAGES = ("corpus", "SELECT 'pages/' || page_id || '.html' AS path, page_id || '.html' AS name, html AS text FROM pages")
BOTH = ("corpus", f"SELECT path, name, text FROM ({CORPUS_SQL}) UNION ALL SELECT * FROM ({PAGES[1]})")
CUT = (
    "cut",
    r"SELECT path, name, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines "
    r"FROM (SELECT path, name, regexp_split_to_array(text, '\r\n?|\n') AS parts FROM corpus)",
)
LINES = (
    "lines",
    "SELECT path, name, CAST(unnest(generate_series(1, len(lines))) AS INT) AS line_number, unnest(lines) AS line FROM cut",
)


# ---- Rules -------------------------------------------------------------------------------------------------
BAN = "(?![$<{@%])"
FIRST_BANNED = "$<{@%"
JUNK = f"(?i:{c.JUNK_VALUES})"


def re2(pattern: str) -> tuple[str, bool]:
    """Pattern without lookahead, and whether junk values are still to be filtered out."""
    junk = "(?!(?i:" in pattern
    while "(?!(?i:" in pattern:
        start = pattern.index("(?!(?i:")
        end = pattern.index(")", start + len("(?!(?i:" + c.JUNK_VALUES)) + 1
        end = pattern.index(")", end) + 1
        pattern = pattern[:start] + pattern[end:]
    if BAN in pattern:
        head, tail = pattern.split(BAN)
        members, rest = tail[len("([^"):].split("]{", 1)
        bounds, after = rest.split("}", 1)
        low, _, high = bounds.partition(",")
        fewer = f"{int(low) - 1},{int(high) - 1 if high else ''}"
        pattern = f"{head}([^{members}{FIRST_BANNED}][^{members}]{{{fewer}}}{after}"
    return pattern, junk


def _covers(rule: c.Rule) -> str:
    tests = [f"name = {text(g)} OR ends_with(name, {text(g.lstrip('*'))})" for g in rule.files]
    return "(" + " OR ".join(tests) + ")" if tests else "true"


def _hits_of(rule: c.Rule, ordinal: int, bound: bool, keep: str) -> str:
    pattern, junk = re2(rule.pattern)
    value = f"regexp_extract_all(line, {text(pattern)}, 1)" if junk else "NULL::VARCHAR[]"
    found = (
        f"SELECT {keep}, line, {ordinal} AS ordinal, regexp_extract_all(line, {text(pattern)}) AS found, {value} AS inner_found "
        f"FROM lines WHERE regexp_matches(line, {text(pattern)}) AND {_covers(rule) if bound else 'true'}"
    )
    rows = (
        f"SELECT {keep}, line, ordinal, unnest(generate_series(1, len(found))) AS pos, unnest(found) AS matched, "
        f"{'unnest(inner_found)' if junk else 'NULL'} AS inner_value FROM ({found})"
    )
    return rows if not junk else f"SELECT * FROM ({rows}) WHERE NOT regexp_full_match(inner_value, {text(JUNK)})"


def hits(rules=c.BUILTIN_RULES, bound: bool = True, keep: str = "path, name, line_number") -> tuple[str, str]:
    parts = [f"SELECT {keep}, line, ordinal, pos, matched FROM ({_hits_of(r, n, bound, keep)})" for n, r in enumerate(rules)]
    return "hits", "\nUNION ALL ".join(parts)


def rule_rows(rules=c.BUILTIN_RULES) -> tuple[str, str]:
    rows = ", ".join(
        f"({n}, {text(r.id)}, {text(r.name)}, {text(r.risk)}, {text(r.category)}, {text(r.description)}, "
        f"{text(r.recommendation)}, {len(r.files)})"
        for n, r in enumerate(rules)
    )
    names = "ordinal, id, name, risk, category, description, recommendation, n_files"
    return "rules", f"SELECT * FROM (VALUES {rows}) AS v({names})"


def redact(value: str) -> str:
    clean = f"trim({value}, chr(39) || chr(34) || ' ' || chr(9) || chr(13) || chr(10))"
    return (
        f"(SELECT CASE WHEN length(s) <= 8 THEN repeat('*', length(s)) ELSE substr(s, 1, 4) || "
        f"repeat('*', least(greatest(length(s) - 8, 4), 12)) || '..' || substr(s, length(s) - 3) END FROM (SELECT {clean} AS s))"
    )


# ---- Entropy -----------------------------------------------------------------------------------------------
def candidate_list(length: int) -> str:
    quoted = rf"[\"'`]([^\r\n\"'`]{{{length},}})[\"'`]"
    return (
        f"list_concat(regexp_extract_all(line, {text(quoted)}, 1), "
        f"regexp_extract_all(line, '[A-Za-z0-9+/=_\\-]{{{length},}}'))"
    )


def candidates(length: int = 20, keep: str = "path, line_number") -> tuple[str, str]:
    return (
        "candidates",
        f"SELECT {keep}, line, list_position(every, candidate) AS pos, candidate FROM ("
        f"SELECT {keep}, line, every, unnest(list_distinct(every)) AS candidate FROM ("
        f"SELECT {keep}, line, {candidate_list(length)} AS every FROM lines))",
    )


CLEAN = "trim(candidate, chr(34) || chr(39) || '` ' || chr(9) || chr(13) || chr(10))"
FALSE_POSITIVE = (
    f"(length({CLEAN}) < 20 OR "
    + " OR ".join(f"regexp_matches({CLEAN}, {text(p)})" for p in (URL, UUID, HEX_HASH, DOTTED_ID))
    + f" OR len(list_distinct(string_split({CLEAN}, ''))) <= 4"
    + "".join(f" OR starts_with({CLEAN}, {text(p)})" for p in ("/", "./", "../"))
    + "".join(f" OR contains(lower({CLEAN}), {text(p)})" for p in PLACEHOLDERS)
    + ")"
)
_SHARE = "((length(candidate) - length(replace(candidate, ch, ''))) / length(candidate))"
ENTROPY = (
    f"(-list_sum(list_transform(list_distinct(string_split(candidate, '')), lambda ch: {_SHARE} * log2({_SHARE}))))"
)


def entropy_hits(config: AuditConfig = CONFIG, keep: str = "path, line_number") -> tuple[str, str]:
    return (
        "secrets",
        f"SELECT * FROM (SELECT *, {ENTROPY} AS entropy FROM candidates WHERE NOT {FALSE_POSITIVE}) "
        f"WHERE entropy >= {config.entropy_threshold} - 1e-12",
    )


# ---- Paths -------------------------------------------------------------------------------------------------
def _first_name_rule(shown: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(name, {text(r.pattern)}, 'i') THEN {text(getattr(r, shown)) if shown else n}"
        for n, r in enumerate(c.FILE_NAME_RULES)
    )
    return f"CASE {whens} END"


_DIRS_OF = "string_split(path, '/')[:-2]"


def open_dirs(config: AuditConfig = CONFIG) -> str:
    closed = f"d IN {_list(config.excluded_dirs)} OR starts_with(d, '.') OR ends_with(d, '.xcodeproj') OR ends_with(d, '.xcworkspace')"
    return f"len(list_filter({_DIRS_OF}, lambda d: {closed})) = 0"


def kept(config: AuditConfig = CONFIG) -> str:
    return f"NOT (name IN {_list(config.excluded_files)} OR starts_with(name, '.DS_Store'))"


SUFFIX = r"regexp_extract(name, '^.+(\.[^.]+)$', 1)"


def included(config: AuditConfig = CONFIG) -> str:
    return (
        f"(lower({SUFFIX}) IN {_list(config.included_extensions)} OR name IN {_list(config.exact_filenames)} "
        f"OR {_first_name_rule('')} IS NOT NULL)"
    )


def is_target(config: AuditConfig = CONFIG) -> str:
    return f"{open_dirs(config)} AND {kept(config)} AND {included(config)}"


def _corpus_sql(select: str, where: str = "true") -> str:
    return f"SELECT {select} FROM ({CORPUS_SQL}) WHERE {where}"


# ---- Findings ----------------------------------------------------------------------------------------------
NULLS = "NULL::VARCHAR AS commit_hash, NULL::VARCHAR AS author, NULL::VARCHAR AS date"
BITS = "printf('%.2f', round_even(entropy, 2)) || ' bits/char).'"
FINDING = (
    "finding_type, risk_level, description, file_path, line_number, matched_string, recommendation, commit_hash, "
    "author, date, entropy, rule_id, line, lines_before, lines_after"
)
SLIM = ", ".join(q.SLIM)


def _context(size: int) -> str:
    return (
        f"array_to_string(lines[greatest(line_number - {size}, 1):line_number - 1], chr(10)) AS lines_before, "
        f"array_to_string(lines[line_number + 1:line_number + {size}], chr(10)) AS lines_after"
    ) if size else "'' AS lines_before, '' AS lines_after"


def by_rules(size: int) -> str:
    return (
        f"SELECT r.name AS finding_type, r.risk AS risk_level, r.description, h.path AS file_path, h.line_number, "
        f"{redact('h.matched')} AS matched_string, r.recommendation, {NULLS}, NULL::DOUBLE AS entropy, r.id AS rule_id, "
        f"h.line, {_context(size)}, h.ordinal AS slot, h.pos AS pos "
        f"FROM hits h JOIN rules r ON h.ordinal = r.ordinal JOIN cut c ON h.path = c.path"
    )


def by_entropy(size: int) -> str:
    return (
        f"SELECT {text(c.ENTROPY_NAME)} AS finding_type, 'Medium' AS risk_level, "
        f"'Detected high Shannon entropy string (' || {BITS} AS description, s.path AS file_path, s.line_number, "
        f"{redact('s.candidate')} AS matched_string, {text(c.ENTROPY_RECOMMENDATION)} AS recommendation, {NULLS}, "
        f"round_even(entropy, 2) AS entropy, '{c.ENTROPY_ID}' AS rule_id, s.line, {_context(size)}, 1000000 AS slot, s.pos "
        f"FROM secrets s JOIN cut c ON s.path = c.path"
    )


BY_NAME = (
    f"SELECT {_first_name_rule('name')} AS finding_type, {_first_name_rule('risk')} AS risk_level, "
    f"{_first_name_rule('description')} AS description, path AS file_path, 1 AS line_number, name AS matched_string, "
    f"{text(c.FILE_AUDIT_RECOMMENDATION)} AS recommendation, {NULLS}, NULL::DOUBLE AS entropy, '{c.FILE_AUDIT_ID}' AS rule_id, "
    f"'File: ' || name AS line, '' AS lines_before, '' AS lines_after, 1000001 AS slot, 0 AS pos "
    f"FROM corpus WHERE {_first_name_rule('')} IS NOT NULL"
)


def file_ctes(source=CORPUS, rules=c.BUILTIN_RULES, config: AuditConfig = CONFIG, target: bool = False):
    if target:
        source = ("corpus", f"SELECT * FROM ({source[1]}) WHERE {is_target(config)}")
    return [source, CUT, LINES, hits(rules), rule_rows(rules), candidates(config.min_entropy_length), entropy_hits(config)]


def file_findings(size: int = 20) -> str:
    return f"{by_rules(size)} UNION ALL {by_entropy(size)} UNION ALL {BY_NAME}"


# ---- History -----------------------------------------------------------------------------------------------
LINE_END = r"(?:\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])"


def _headers(*marks: str) -> str:
    return " OR ".join(f"starts_with(line, {text(m)})" for m in marks)


def history_lines(sql: str, *marks: str, unnamed: str) -> list[tuple[str, str]]:
    """Lines of the records with the file each belongs to, by a window over each record."""
    return [
        ("records", sql),
        (
            "every_line",
            f"SELECT doc_id, repo, unnest(generate_series(1, len(parts))) AS place, unnest(parts) AS line FROM "
            f"(SELECT doc_id, repo, regexp_split_to_array(record, '{LINE_END}') AS parts FROM records)",
        ),
        ("marked", f"SELECT *, CASE WHEN place > 1 AND ({_headers(*marks)}) THEN trim(substr(line, 7)) END AS header FROM every_line"),
        (
            "stretches",
            f"SELECT *, coalesce(last_value(header IGNORE NULLS) OVER w, '{unnamed}') AS file, "
            f"CAST(count(header) OVER w AS INT) AS part FROM marked "
            f"WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        ),
        (
            "plus_lines",
            "SELECT doc_id, repo, file, part, CAST(place - max(CASE WHEN header IS NOT NULL THEN place ELSE 1 END) OVER w AS INT) AS place, line, "
            "starts_with(line, '+') AND NOT starts_with(line, '+++') AS added FROM stretches "
            "WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        ),
    ]


_HEAD = "regexp_extract(record, '^([^\\n]*)', 1)"
_PARTS = f"string_split({_HEAD}, '|')"
META = (
    "meta",
    f"SELECT doc_id, repo, substr({_PARTS}[1], 1, 8) AS commit, {_PARTS}[2] AS author, {_PARTS}[3] AS date FROM records",
)
STASH_META = (
    "meta",
    f"SELECT doc_id, repo, CASE WHEN contains({_HEAD}, ':') THEN trim(string_split({_HEAD}, ':')[1]) ELSE 'stash@{{0}}' END AS commit, "
    f"NULL::VARCHAR AS author, NULL::VARCHAR AS date FROM records",
)
KEEP = "doc_id, repo, commit, author, date, file, part, place"
ADDED = (
    "lines",
    f"SELECT p.doc_id, p.repo, commit, author, date, file, part, place, substr(line, 2) AS line FROM plus_lines p "
    f"JOIN meta m ON p.doc_id = m.doc_id WHERE added",
)
PATCH = [*history_lines(RECORD_SQL, "--- a/", "+++ b/", unnamed="Unknown"), META, ADDED]
STASH = [*history_lines(STASH_SQL, "+++ b/", unnamed="Stash Diff"), STASH_META, ADDED]


def history_findings(label: str, prefix: str, where: str, recommendation: str) -> str:
    return (
        f"SELECT '{label}: ' || r.name AS finding_type, r.risk AS risk_level, r.description || {where} AS description, "
        f"file AS file_path, 1 AS line_number, {redact('h.matched')} AS matched_string, {recommendation} AS recommendation, "
        f"commit AS commit_hash, author, date, NULL::DOUBLE AS entropy, '{prefix}-' || r.id AS rule_id, line, "
        f"'' AS lines_before, '' AS lines_after, h.ordinal AS slot, h.pos, doc_id, repo, part, place "
        f"FROM hits h JOIN rules r ON h.ordinal = r.ordinal"
    )


PATCH_BY_RULES = history_findings("Git History", "GIT", "' (Found in Git commit ' || commit || ')'", "r.recommendation")
STASH_BY_RULES = history_findings("Git Stash", "STASH", "' (Found in ' || commit || ')'", text(c.STASH_RECOMMENDATION))
PATCH_BY_ENTROPY = (
    f"SELECT {text(c.HISTORY_ENTROPY_NAME)} AS finding_type, 'Medium' AS risk_level, "
    f"'High entropy string in commit ' || commit || ' (' || {BITS} AS description, file AS file_path, 1 AS line_number, "
    f"{redact('candidate')} AS matched_string, {text(c.HISTORY_ENTROPY_RECOMMENDATION)} AS recommendation, commit AS commit_hash, "
    f"author, date, round_even(entropy, 2) AS entropy, '{c.HISTORY_ENTROPY_ID}' AS rule_id, line, '' AS lines_before, "
    f"'' AS lines_after, 1000000 AS slot, pos, doc_id, repo, part, place FROM secrets"
)
PATCH_SCAN = [*PATCH, hits(bound=False, keep=KEEP), rule_rows(), candidates(keep=KEEP), entropy_hits(keep=KEEP)]
STASH_SCAN = [*STASH, hits(bound=False, keep=KEEP), rule_rows()]


def _nested(ctes, body: str) -> str:
    return f"{with_(*ctes)} {body}"


_ORDER = "origin, file_key, block_row, part, place, slot, pos"
_FILE_ORDER = "0 AS origin, file_path AS file_key, 0 AS block_row, 0 AS part, line_number AS place, slot, pos"
_LOG_ORDER = "{} AS origin, repo AS file_key, doc_id AS block_row, part, place, slot, pos"


def every_finding(target: bool = True) -> str:
    files = _nested(file_ctes(target=target), f"SELECT {FINDING}, {_FILE_ORDER} FROM ({file_findings()})")
    patches = _nested(PATCH_SCAN, f"SELECT {FINDING}, {_LOG_ORDER.format(1)} FROM ({PATCH_BY_RULES} UNION ALL {PATCH_BY_ENTROPY})")
    stashes = _nested(STASH_SCAN, f"SELECT {FINDING}, {_LOG_ORDER.format(2)} FROM ({STASH_BY_RULES})")
    return f"SELECT * FROM ({files}) UNION ALL SELECT * FROM ({patches}) UNION ALL SELECT * FROM ({stashes})"


SEVERITY = "CASE risk_level " + " ".join(f"WHEN '{r}' THEN {s}" for r, s in c.SEVERITY.items()) + " END"
_NTH = f"row_number() OVER (PARTITION BY file_path, line_number, finding_type, matched_string ORDER BY {_ORDER})"


def dedup(findings: str) -> str:
    return f"SELECT *, {SEVERITY} AS severity FROM (SELECT *, {_NTH} AS nth FROM ({findings})) WHERE nth = 1"


AUDITED = ("audited", dedup(every_finding()))


ORACLES["src_documents"] = (
    with_(CORPUS, CUT) + "SELECT c.path, c.name, md5(text) AS digest, len(lines) AS n_lines FROM corpus c JOIN cut ON c.path = cut.path"
)
ORACLES["dir_prune"] = _corpus_sql("path", open_dirs())
ORACLES["file_exclude"] = _corpus_sql("path", kept())
ORACLES["file_include"] = _corpus_sql("path", included())
ORACLES["path_suffix"] = _corpus_sql(f"path, {SUFFIX} AS suffix")
ORACLES["rel_path"] = _corpus_sql(
    f"path, CASE WHEN starts_with(path, '{q.ROOT}/') THEN substr(path, {len(q.ROOT) + 2}) ELSE path END AS relative"
)

# The bytes of a variant, from the same parts as in Spark, as hex digits.
_PLAIN = "CASE WHEN doc_id % 9 = 8 THEN '' ELSE hex(encode(text)) END"


def _hex_case(options: dict[int, str]) -> str:
    shown = {n: o[2:-1] if o.startswith("X'") else None for n, o in options.items()}
    whens = " ".join(
        f"WHEN {n} THEN " + (f"'{shown[n]}'" if shown[n] is not None else options[n].removeprefix("unhex(").removesuffix(")"))
        for n in options
    )
    return f"CASE doc_id % 9 {whens} ELSE '' END"


_SAMPLE = f"substr({_hex_case(BYTE_HEADS)} || {_PLAIN} || {_hex_case(BYTE_TAILS)}, 1, 8192)"
_CONTROL = "('01','02','03','04','05','06','0B','0E','0F','10','11','12','13','14','15','16','17','18','19','1A','1C','1D','1E','1F','7F')"
ORACLES["is_binary"] = (
    f"SELECT path, list_contains(pairs, '00') OR len(list_filter(pairs, lambda b: b IN {_CONTROL})) / greatest(len(pairs), 1) > 0.3 "
    f"AS binary FROM (SELECT path, regexp_extract_all({_SAMPLE}, '..') AS pairs FROM ({CORPUS_SQL}))"
)
_SHOWN_HEAD = "CASE doc_id % 9 WHEN 1 THEN chr(0) WHEN 4 THEN repeat(chr(1), 5000) WHEN 5 THEN chr(65533) WHEN 6 THEN repeat(chr(31), 200) ELSE '' END"
_SHOWN_TAIL = (
    "CASE doc_id % 9 WHEN 2 THEN chr(0) WHEN 5 THEN repeat(chr(65533), 3) WHEN 6 THEN chr(65533) || 'A' "
    "WHEN 7 THEN chr(65533) || 'A' || chr(65533) ELSE '' END"
)
ORACLES["decode_text"] = _corpus_sql(
    f"path, md5({_SHOWN_HEAD} || CASE WHEN doc_id % 9 = 8 THEN '' ELSE text END || {_SHOWN_TAIL}) AS digest"
)
ORACLES["split_lines"] = (
    with_(("corpus", _corpus_sql(f"path, name, {LINE_ENDS_SQL} AS text")), CUT, LINES) + "SELECT path, line_number, line FROM lines"
)
# Logs: records are numbered, and one whose header is cut short has the values of the last whole one before it.
NUMBERED = ("numbered", "SELECT doc_id, row_number() OVER (PARTITION BY repo ORDER BY doc_id) - 1 AS log_row FROM records")


def _kept(part: str, otherwise: str) -> str:
    value = f"last_value(CASE WHEN len({_PARTS}) >= 3 THEN {part} END IGNORE NULLS)"
    return f"coalesce({value} OVER (PARTITION BY repo ORDER BY doc_id ROWS UNBOUNDED PRECEDING), '{otherwise}')"


LOG_META = (
    "meta",
    f"SELECT doc_id, repo, {_kept(f'substr({_PARTS}[1], 1, 8)', 'HEAD')} AS commit, {_kept(f'{_PARTS}[2]', 'Unknown')} AS author, "
    f"{_kept(f'{_PARTS}[3]', 'Unknown')} AS date FROM records",
)
LOG = [*history_lines(LOG_SQL, "--- a/", "+++ b/", unnamed="Unknown"), LOG_META, ADDED, NUMBERED]
ORACLES["src_patch_log"] = (
    with_(*LOG) + "SELECT repo, log_row, commit, author, date, file, part, place, line FROM lines JOIN numbered USING (doc_id)"
)
ORACLES["patch_commit_meta"] = (
    with_(LOG[0], LOG_META, NUMBERED) + "SELECT repo, log_row, commit, author, date FROM meta JOIN numbered USING (doc_id)"
)
ORACLES["patch_file_state"] = with_(*PATCH[:5]) + "SELECT DISTINCT repo, doc_id AS log_row, part, file FROM stretches"
ORACLES["patch_added_lines"] = (
    with_(*PATCH) + "SELECT file, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines GROUP BY file"
)
ORACLES["src_stash_log"] = (
    with_(*STASH, NUMBERED) + "SELECT repo, log_row, commit AS stash, file, line FROM lines JOIN numbered USING (doc_id)"
)

# What the JSON options say, written out.
_JSON_CONFIG = replace(
    CONFIG, excluded_dirs=CONFIG.excluded_dirs | {"src0", "src1"}, included_extensions=CONFIG.included_extensions | {".bin"},
    entropy_threshold=4.0, min_entropy_length=24, context_lines=3,
)
ORACLES["cfg_json"] = (
    with_(*file_ctes(rules=c.BUILTIN_RULES[:1], config=_JSON_CONFIG, target=True))
    + f"SELECT file_path, line_number, matched_string, entropy, lines_before, lines_after FROM ({by_entropy(_JSON_CONFIG.context_lines)})"
)
_FLAGS = AuditConfig(
    excluded_dirs=CONFIG.excluded_dirs | {"src2", "src3"}, excluded_files=CONFIG.excluded_files | {"id_rsa"}
)
ORACLES["cfg_overrides"] = (
    with_(*file_ctes(config=_FLAGS, target=True)[:5])
    + f"SELECT file_path, line_number, rule_id, matched_string, 0 AS n_before FROM ({by_rules(0)} UNION ALL {BY_NAME})"
)


# ---- Rules -------------------------------------------------------------------------------------------------
def _matches(rules=c.BUILTIN_RULES) -> str:
    return with_(CORPUS, CUT, LINES, hits(rules), rule_rows(rules))


_PER_RULE = "FROM rules r LEFT JOIN (SELECT ordinal, count(*) AS n FROM hits GROUP BY ordinal) h ON r.ordinal = h.ordinal"
ORACLES["rule_catalog"] = _matches() + (
    f"SELECT r.ordinal, id, name, risk, category, description, recommendation, n_files, coalesce(n, 0) AS matches {_PER_RULE}"
)
ORACLES["rules_by_category"] = _matches() + (
    f"SELECT category, risk, count(*) AS rules, CAST(sum(coalesce(n, 0)) AS BIGINT) AS matches {_PER_RULE} GROUP BY category, risk"
)
ORACLES["anti_disabled_rules"] = _matches() + (
    f"SELECT r.ordinal, id, coalesce(n, 0) AS matches {_PER_RULE} WHERE id NOT IN {_list(q.DISABLED)}"
)
_KEYWORD = c.Rule(
    c.KEYWORD_RULE_ID, "Custom", "High", c.KEYWORD_RULE.name,
    c.name_assignment("tokenizer|token|blob|dgis"), c.KEYWORD_RULE.description, c.KEYWORD_RULE.recommendation,
)
# The user's rules as they are to be understood, the broken one left out, in DuckDB's dialect.
_OWN = "User-defined detection rule.", "Review this match and move the value out of the repository if it is a secret."
_CUSTOM = [
    c.Rule("CUSTOM-1", "Custom", "Low", "Host path", r"host\.net/[0-9a-f]{8}", *_OWN),
    c.Rule("CUSTOM", "Custom", "High", "Custom Rule", r"\bdata Zq[0-9a-f]+", *_OWN),
    c.Rule("CUSTOM-4", "Custom", "Info", "Python only", r"host\.[net]+/[0-9a-f]{0,4}", *_OWN),
]
_RESOLVED = [r for r in (*c.BUILTIN_RULES, _KEYWORD, *_CUSTOM) if r.id not in (*q.DISABLED, "CUSTOM-1")]
ORACLES["rule_resolve"] = _matches(_RESOLVED) + f"SELECT r.ordinal, id, name, risk, coalesce(n, 0) AS matches {_PER_RULE}"


def _only(rules) -> str:
    return _matches(rules) + (
        f"SELECT r.id AS rule_id, r.risk AS risk_level, h.path AS file_path, line_number, {redact('matched')} AS matched_string "
        f"FROM hits h JOIN rules r ON h.ordinal = r.ordinal"
    )


ORACLES["rule_keyword"] = _only([_KEYWORD])
ORACLES["rule_custom"] = _only(_CUSTOM)
ORACLES["rule_validate"] = (
    _matches((*c.BUILTIN_RULES, *_CUSTOM))
    + "SELECT r.id AS rule_id, count(*) AS matches FROM hits h JOIN rules r ON h.ordinal = r.ordinal GROUP BY r.id"
)
_NAMES_RULE = next(rule for rule in c.BUILTIN_RULES if rule.id == "SWIFT-001")
ORACLES["rule_name_assignment"] = (
    with_(CORPUS, CUT, LINES) + f"SELECT path, line_number, inner_value AS value FROM ({_hits_of(_NAMES_RULE, 0, False, 'path, name, line_number')})"
)
_COVERED = " UNION ALL ".join(f"SELECT path, '{r.id}' AS rule_id FROM corpus WHERE {_covers(r)}" for r in q.BOUND_RULES)
ORACLES["rule_file_filter"] = with_(CORPUS) + _COVERED
ORACLES["join_file_rule"] = with_(CORPUS, rule_rows()) + (
    f"SELECT rule_id, name, n_files FROM (SELECT rule_id, count(*) AS n_files FROM ({_COVERED}) GROUP BY rule_id) f "
    f"JOIN (SELECT id, name FROM rules) r ON f.rule_id = r.id"
)
ORACLES["filename_audit"] = with_(CORPUS) + f"SELECT {FINDING} FROM ({BY_NAME})"
ORACLES["rule_scan"] = _only(c.BUILTIN_RULES)
for _rule in c.BUILTIN_RULES:
    ORACLES[f"rule_{_rule.id.replace('-', '_').lower()}"] = _only([_rule])

# ---- Projections, filters and scalar functions -------------------------------------------------------------
_CANDIDATES = with_(BOTH, CUT, LINES, candidates())
ORACLES["entropy_candidates"] = _CANDIDATES + "SELECT path, line_number, candidate FROM candidates"
ORACLES["entropy_fp_filter"] = _CANDIDATES + f"SELECT path, line_number, candidate FROM candidates WHERE NOT {FALSE_POSITIVE}"
ORACLES["shannon_entropy"] = _CANDIDATES + f"SELECT path, line_number, candidate, round({ENTROPY}, 6) AS entropy FROM candidates"
ORACLES["entropy_threshold"] = (
    _CANDIDATES + f"SELECT path, line_number, candidate FROM candidates WHERE {ENTROPY} >= {CONFIG.entropy_threshold} - 1e-12"
)
ORACLES["entropy_findings"] = with_(PAGES, CUT, LINES, candidates(), entropy_hits()) + f"SELECT {FINDING} FROM ({by_entropy(20)})"
ORACLES["redact"] = _corpus_sql(
    f"doc_id, {redact('planted')} AS whole, {redact('substr(planted, 1, CAST(kind AS BIGINT))')} AS part"
)
_RULE_FINDINGS = with_(*file_ctes()[:5])
ORACLES["line_context"] = _RULE_FINDINGS + (
    f"SELECT file_path, line_number, rule_id, line, lines_before, lines_after FROM ({by_rules(20)} UNION ALL {BY_NAME})"
)
ORACLES["context_brief"] = _RULE_FINDINGS + (
    f"SELECT file_path, line_number, rule_id, line, lines_before, lines_after FROM ({by_rules(0)} UNION ALL {BY_NAME})"
)


def _duration(s: str) -> str:
    return (
        f"CASE WHEN {s} < 1 THEN printf('%.1f ms', {s} * 1000) WHEN {s} < 60 THEN printf('%.2f s', {s}) "
        f"ELSE printf('%dm %.1fs', CAST(floor({s} / 60) AS INT), {s} % 60) END"
    )


ORACLES["format_duration"] = (
    f"SELECT doc_id, {_duration('(n_chars / 64.0::DOUBLE)')} AS long, {_duration('(n_chars / 64.0::DOUBLE / 4096)')} AS short, "
    f"{_duration('(n_chars / 1000.0::DOUBLE)')} AS thousandths, {_duration('(n_chars / 1000.0::DOUBLE / 100)')} AS decimals FROM documents"
)
ORACLES["severity_score"] = _matches() + (
    f"SELECT risk_level, {SEVERITY} AS severity, count(*) AS findings FROM "
    f"(SELECT r.risk AS risk_level FROM hits h JOIN rules r ON h.ordinal = r.ordinal) GROUP BY risk_level"
)
_QUERY, _RISK = q.SEARCH
ORACLES["search_findings"] = with_(
    *file_ctes(), ("audited", dedup(f"SELECT {FINDING}, {_FILE_ORDER} FROM ({file_findings()})"))
) + (
    f"SELECT {FINDING} FROM audited WHERE risk_level = '{_RISK}' AND "
    f"contains(lower(finding_type || ' ' || file_path || ' ' || description), '{_QUERY.lower()}')"
)


def escaped(value: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = f"replace({value}, {text(char)}, {text(entity)})"
    return value


ORACLES["html_escape"] = with_(PAGES) + f"SELECT path, md5({escaped('text')}) AS digest FROM corpus"

# ---- History -----------------------------------------------------------------------------------------------
ORACLES["patch_rule_scan"] = with_(*PATCH_SCAN[:-2]) + f"SELECT {FINDING} FROM ({PATCH_BY_RULES})"
ORACLES["patch_entropy_scan"] = with_(*PATCH, candidates(keep=KEEP), entropy_hits(keep=KEEP)) + f"SELECT {FINDING} FROM ({PATCH_BY_ENTROPY})"
ORACLES["stash_rule_scan"] = with_(*STASH_SCAN) + f"SELECT {FINDING} FROM ({STASH_BY_RULES})"
ORACLES["first_commit_per_secret"] = with_(
    *PATCH_SCAN[:-2], ("audited", dedup(f"SELECT {FINDING}, {_LOG_ORDER.format(1)} FROM ({PATCH_BY_RULES})"))
) + "SELECT file_path, finding_type, matched_string, commit_hash, author, date FROM audited"

# ---- Joins -------------------------------------------------------------------------------------------------
ORACLES["join_rule_meta"] = _matches() + (
    "SELECT h.path, line_number, matched, r.id AS rule_id, r.name AS finding_type, r.risk AS risk_level, r.recommendation "
    "FROM hits h JOIN rules r ON h.ordinal = r.ordinal"
)
ORACLES["join_context"] = _matches() + (
    "SELECT h.path, h.line_number, "
    "coalesce((SELECT string_agg(line, chr(10) ORDER BY l.line_number) FROM lines l WHERE l.path = h.path "
    "AND l.line_number BETWEEN h.line_number - 5 AND h.line_number - 1), '') AS lines_before, "
    "coalesce((SELECT string_agg(line, chr(10) ORDER BY l.line_number) FROM lines l WHERE l.path = h.path "
    "AND l.line_number BETWEEN h.line_number + 1 AND h.line_number + 5), '') AS lines_after "
    "FROM (SELECT DISTINCT path, line_number FROM hits) h"
)

# ---- Aggregations, set operations, order -------------------------------------------------------------------
ORACLES["union_findings"] = f"SELECT {FINDING} FROM ({every_finding(target=False)})"
ORACLES["dedup_findings"] = with_(AUDITED) + f"SELECT {FINDING} FROM audited"
ORACLES["sort_severity"] = with_(AUDITED) + f"SELECT severity, {SLIM} FROM audited ORDER BY severity DESC, {_ORDER}"
ORACLES["top_findings"] = with_(AUDITED) + f"SELECT {FINDING} FROM audited ORDER BY severity DESC, {_ORDER} LIMIT 10"
_RISK_COUNTS = ", ".join(f"count(*) FILTER (risk_level = '{r}') AS {r.lower()}_count" for r in c.RISKS)
ORACLES["stats_by_risk"] = with_(AUDITED) + f"SELECT count(*) AS total_findings, {_RISK_COUNTS} FROM audited"
_STATS = f"count(*) AS total_findings, count(DISTINCT (file_path, line_number)) AS suspicious_lines, {_RISK_COUNTS}"
ORACLES["suspicious_lines"] = with_(AUDITED) + "SELECT count(DISTINCT (file_path, line_number)) AS suspicious_lines FROM audited"
_TARGET_CUT = [("corpus", f"SELECT * FROM ({CORPUS_SQL}) WHERE {is_target()}"), CUT]
_COUNTS = "SELECT count(*) AS files_scanned, CAST(sum(len(lines)) AS BIGINT) AS lines_scanned FROM cut"
ORACLES["scan_counts"] = with_(*_TARGET_CUT) + _COUNTS
ORACLES["scan_elapsed"] = with_(*_TARGET_CUT) + f"SELECT *, true AS timed FROM ({_COUNTS})"
ORACLES["critical_high"] = with_(AUDITED) + "SELECT count(*) FILTER (risk_level IN ('Critical', 'High')) AS critical_high FROM audited"
ORACLES["audit_gate"] = with_(AUDITED) + "SELECT count(*) FILTER (risk_level = 'Critical') = 0 AS passed FROM audited"

# ---- Sinks -------------------------------------------------------------------------------------------------
NUMBERED = ("numbered", f"SELECT *, row_number() OVER (ORDER BY severity DESC, {_ORDER}) AS idx FROM audited")
REPORT = with_(
    AUDITED, NUMBERED, *_TARGET_CUT, ("counts", _COUNTS), ("found", f"SELECT {_STATS} FROM audited"),
    ("stats", "SELECT * FROM counts, found"),
)


ORACLES["sink_json"] = ORACLES["dedup_findings"]
ORACLES["sink_json_summary"] = REPORT + (
    f"SELECT 'corpus' AS scanned_path, '{q.TIMESTAMP}' AS scan_timestamp, *, {q.ELAPSED}::DOUBLE AS elapsed_time_seconds FROM stats"
)


def say(template: str, *values: str) -> str:
    pieces = [text(template.split("{}")[0])]
    for value, rest in zip(values, template.split("{}")[1:]):
        pieces += [f"CAST({value} AS VARCHAR)", text(rest)]
    return " || ".join(pieces)


def lines_of(*parts: str) -> str:
    return f"concat_ws(chr(10), {', '.join(parts)})"


def _report(*sections: tuple[str, str, str]) -> str:
    """Sections of ``(source, idx, value)``."""
    return REPORT + " UNION ALL ".join(
        f"SELECT {n} AS section, CAST({idx} AS BIGINT) AS idx, {value} AS value FROM {source}"
        for n, (source, idx, value) in enumerate(sections)
    )


_TALLY = "concat_ws(', ', " + ", ".join(say(f"{{}} {risk.lower()}", f"{risk.lower()}_count") for risk in c.RISKS) + ")"
_VOLUME = say("{} files with {} lines, read in 1.25 s", "format('{:,}', files_scanned)", "format('{:,}', lines_scanned)")
_PLACE = say("{}:{}", "file_path", "line_number")
_WHO = "concat_ws(', ', nullif(author, ''), nullif(date, ''))"
_ORIGIN = f"CASE WHEN commit_hash <> '' THEN CASE WHEN {_WHO} = '' THEN commit_hash ELSE commit_hash || ' (' || {_WHO} || ')' END END"
ORACLES["sink_markdown"] = _report(
    (
        "stats", "0",
        lines_of(
            text("# Leaked credentials in `corpus`"), "''", say("{} findings: {}.", "total_findings", _TALLY), "''",
            say(f"_{q.TIMESTAMP}; {{}}._", _VOLUME), "''", text("| # | Place | Finding | Risk | Value |"),
            text("| ---: | --- | --- | --- | --- |"),
        ),
    ),
    (
        "numbered", "idx",
        say("| {} | {} | {} | {} | `{}` |", "idx", f"({_PLACE})", "finding_type", "risk_level", "replace(matched_string, '|', '\\|')"),
    ),
    ("stats", "0", "''"),
    (
        "numbered", "idx",
        lines_of(
            say("## {}. {}", "idx", f"({_PLACE})"), "''", say("{} risk, {}: {}", "risk_level", "finding_type", "description"),
            "''", text("~~~"), "line", text("~~~"), "''", say("Next: {}", "recommendation"),
            f"chr(10) || 'Introduced by ' || {_ORIGIN}", "''",
        ),
    ),
)
ORACLES["sink_text"] = _report(
    (
        "stats", "0",
        lines_of(text(f"keysift {q.TIMESTAMP} corpus"), _VOLUME, say("{} findings: {}", "total_findings", _TALLY), "''"),
    ),
    (
        "numbered", "idx",
        lines_of(
            say("{} {} [{}]", "idx", f"({_PLACE})", "lower(risk_level)"), say("  {} = {}", "finding_type", "matched_string"),
            say("  | {}", "line"), say("  {}", "description"), say("  {}", "recommendation"), "''",
        ),
    ),
)
_HAS_CONTEXT = "rule_id NOT LIKE 'GIT-%' AND rule_id NOT LIKE 'STASH-%' AND rule_id <> 'FILE-AUDIT'"
ORACLES["sink_html_cards"] = _report(
    (
        "stats", "0",
        lines_of(
            text("<!DOCTYPE html>"), text('<html lang="en"><meta charset="utf-8"><title>keysift</title>'),
            text(f"<header><h1>corpus</h1><time>{q.TIMESTAMP}</time>"), say("<p>{} findings: {}</p>", "total_findings", _TALLY),
            say("<p>{}</p></header>", f"({_VOLUME})"),
        ),
    ),
    (
        "numbered", "idx",
        lines_of(
            say('<article id="f{}" class="{}">', "idx", "lower(risk_level)"), say("<h2>{}:{}</h2>", escaped("file_path"), "line_number"),
            # Every document has at least the planted line and its cut copy, so a line of a file has neighbours.
            say(
                '<pre class="{}" data-line="{}">{}</pre>', f"CASE WHEN {_HAS_CONTEXT} THEN 'around' ELSE 'alone' END", "line_number",
                lines_of(
                    f"CASE WHEN {_HAS_CONTEXT} AND line_number > 1 THEN {escaped('lines_before')} END",
                    say("<mark>{}</mark>", escaped("line")),
                    f"CASE WHEN {_HAS_CONTEXT} AND lines_after <> '' THEN {escaped('lines_after')} END",
                ),
            ),
            text("<dl>"), say("<dt>kind<dd>{}", escaped("finding_type")), say("<dt>risk<dd>{}", "risk_level"),
            say("<dt>value<dd>{}", escaped("matched_string")), say("<dt>why<dd>{}", escaped("description")),
            say("<dt>next<dd>{}", escaped("recommendation")), f"'<dt>commit<dd>' || {escaped(_ORIGIN)}", text("</dl></article>"),
        ),
    ),
    ("stats", "0", text("</html>")),
)
ORACLES["sink_console"] = _report(
    (
        "stats", "0",
        lines_of(
            text("keysift: corpus"), _VOLUME, say("{} findings on {} lines: {}", "total_findings", "suspicious_lines", _TALLY),
            say("\nThe gravest {}:", "least(10, total_findings)"),
        ),
    ),
    (
        "(SELECT * FROM numbered WHERE idx <= 10)", "idx",
        lines_of(
            say("{} {} {}", "printf('%2d', idx)", "rpad(risk_level, 8, ' ')", f"({_PLACE})"),
            say("   {}: {}", "finding_type", "matched_string"), say("   {}", "recommendation"),
        ),
    ),
    (
        "(SELECT * FROM stats WHERE total_findings > 10)", "0",
        say("{} more; all of them are in the report files.", "total_findings - 10"),
    ),
)
_FILES_ONLY = ("audited", dedup(_nested(file_ctes(target=True), f"SELECT {FINDING}, {_FILE_ORDER} FROM ({file_findings()})")))
ORACLES["sink_switch"] = with_(_FILES_ONLY, ("n", "SELECT count(*) AS findings FROM audited")) + " UNION ALL ".join(
    f"SELECT '{kind}' AS report, {section} AS section, CAST({blocks} AS BIGINT) AS blocks FROM n"
    for kind, section, blocks in (
        ("markdown", 0, 1), ("markdown", 1, "findings"), ("markdown", 2, 1), ("markdown", 3, "findings"), ("text", 0, 1), ("text", 1, "findings"),
        ("json", 0, 1), ("json", 1, "findings"), ("json", 2, 1),
    )
)
