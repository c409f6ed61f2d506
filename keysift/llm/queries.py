"""The registered queries of the operators, each over its whole table, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keysift.llm.decontaminate import decontaminate
from keysift.llm.exact import exact_dedup
from keysift.llm.katz import katz_scores
from keysift.llm.lines import line_dedup
from keysift.llm.near import near_duplicates
from keysift.llm.packing import pack
from keysift.llm.periodic import periodic_runs
from keysift.llm.pii import FORMATS, pseudonymise
from keysift.llm.prefix_trie import SEGMENT_TURNS, SHARD_TURNS, prefix_trie, rebuilt_turns
from keysift.llm.quality import classify_quality
from keysift.llm.shared import table
from keysift.llm.suffix_dedup import remove_repeats
from keysift.llm.token_trees import apply_edits, token_trees
from keysift.llm.urls import UrlRule, filter_urls


def tokenizer_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file, on the driver and on executors alike."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the component of near copies, at 85 per cent, that it belongs to."""
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)


OP1_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN ways l ON l.a = r.other
)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id, min(r.other) = r.doc_id AS kept
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label model's and the scorer's view of every document."""
    judged = classify_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return judged.select("doc_id", "posterior", "score", "accepted")


URL_RULES = [
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page: its rule's, else that of its aliases, else allow."""
    judged = filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH RECURSIVE rules(rule, host, path, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
         ('net/fr/', 'net', '/fr/', 'block')
), tags AS (
  SELECT page_id, coalesce(url, '') AS url,
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                   '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS named,
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
                   '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) AS moved
  FROM pages
), urls(page_id, kind, url) AS (
  SELECT page_id, 'page', url FROM tags
  UNION ALL SELECT page_id, 'named', CASE WHEN contains(named, '://') THEN named WHEN named[1:2] = '//' THEN 'http:' || named
    WHEN named[1] = '/' THEN 'http://' || regexp_extract(url, '://([^/?#]*)', 1) || named ELSE '' END FROM tags
  UNION ALL SELECT page_id, 'moved', CASE WHEN contains(moved, '://') THEN moved WHEN moved[1:2] = '//' THEN 'http:' || moved
    WHEN moved[1] = '/' THEN 'http://' || regexp_extract(url, '://([^/?#]*)', 1) || moved ELSE '' END FROM tags
), parts AS (
  SELECT page_id, kind, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM urls
), split AS (
  SELECT page_id, kind, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(rest, '^[^/?#]*', '') AS tail,
    list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND p NOT LIKE 'utm\_%' ESCAPE '\') AS kept
  FROM parts
), keyed AS (
  SELECT page_id, kind, host, path, host || tail AS node,
    CASE WHEN host = '' THEN '' ELSE host || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM split
), edges AS (
  SELECT p.canonical AS a, t.canonical AS b FROM keyed p JOIN keyed t USING (page_id)
  WHERE p.kind = 'page' AND t.kind <> 'page' AND p.canonical <> '' AND t.canonical <> '' AND p.canonical <> t.canonical
), linked AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reached(node, root) AS (
  SELECT a, a FROM linked UNION SELECT l.b, r.root FROM reached r JOIN linked l ON l.a = r.node
), members AS (
  SELECT DISTINCT k.node, coalesce(r.component, k.canonical) AS component
  FROM (SELECT node, canonical FROM keyed WHERE canonical <> '' UNION SELECT canonical, canonical FROM keyed WHERE canonical <> '') k
  LEFT JOIN (SELECT node, min(root) AS component FROM reached GROUP BY node) r ON r.node = k.canonical
), placed AS (
  SELECT node, component, regexp_extract(node, '^[^/?#]*') AS host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS path FROM members
), said AS (
  SELECT p.node, p.component, arg_max(r.verdict, length(r.rule)) AS verdict FROM placed p
  LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.node, p.component
), shared AS (
  SELECT component, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS verdict
  FROM said GROUP BY component
), ruled AS (
  SELECT k.page_id, k.host, k.path, k.node,
    arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM keyed k LEFT JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path)
  WHERE k.kind = 'page' GROUP BY k.page_id, k.host, k.path, k.node
)
SELECT u.page_id, u.host, u.path, u.rule, coalesce(u.verdict, s.verdict, 'allow') AS verdict
FROM ruled u LEFT JOIN members m ON m.node = u.node LEFT JOIN shared s ON s.component = m.component
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on five sites or more; the cleaned text is given by its digest."""
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return cleaned.select(
        "doc_id", "n_lines", "n_cut", F.length(text).cast("long").alias("n_chars_left"),
        F.sha2(text, 256).alias("text_sha256"),
    )


OP4_SQL = """
WITH split AS (
  SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS pieces FROM documents
), lines AS (
  SELECT doc_id, source, unnest(pieces) AS raw, unnest(range(len(pieces))) AS spot FROM split
), keyed AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines
), boilerplate AS (
  SELECT line, min(struct_pack(doc_id := doc_id, spot := spot)) AS first FROM keyed
  WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5
), judged AS (
  SELECT k.doc_id, k.spot, k.raw, b.line IS NOT NULL AND NOT (b.first.doc_id = k.doc_id AND b.first.spot = k.spot) AS cut
  FROM keyed k LEFT JOIN boilerplate b ON k.line = b.line
), left_over AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_cut,
         coalesce(string_agg(raw, chr(10) ORDER BY spot) FILTER (WHERE NOT cut), '') AS text
  FROM judged GROUP BY doc_id
)
SELECT doc_id, n_lines, n_cut, length(text) AS n_chars_left, sha256(text) AS text_sha256 FROM left_over
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is left without strings of 100 bytes that also start earlier."""
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the row of its text that stays: the one with the largest id."""
    found = exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and offset of every piece of every document."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


PII_KEY = "corpus-2024"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal values, and how many of each kind were replaced."""
    masked = pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return masked.select("doc_id", "text", F.size("found").cast("long").alias("n_replaced"), *map(count, FORMATS))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold ten words in a row of a benchmark item, how many words that hits, and of which items."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH split AS (
  SELECT 'doc' AS kind, doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
  UNION ALL
  SELECT 'item', item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')
  FROM benchmark
), windows AS (
  SELECT DISTINCT id, least(10, len(words)) AS size, array_to_string(words[i : i + 9], ' ') AS phrase
  FROM (SELECT id, words, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM split WHERE kind = 'item' AND len(words) > 0)
), places AS (
  SELECT d.id, d.i, s.size, array_to_string(d.words[d.i : d.i + s.size - 1], ' ') AS phrase
  FROM (SELECT id, words, unnest(range(1, len(words) + 1)) AS i FROM split WHERE kind = 'doc') d
  JOIN (SELECT DISTINCT size FROM windows) s ON d.i + s.size - 1 <= len(d.words)
), occurrences AS (
  SELECT p.id, p.i, p.size, w.id AS item FROM places p JOIN windows w ON w.size = p.size AND w.phrase = p.phrase
), hit AS (
  SELECT id, count(DISTINCT word) AS n_hit
  FROM (SELECT id, unnest(range(i, i + size)) AS word FROM occurrences) GROUP BY id
), named AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM occurrences) GROUP BY id
)
SELECT s.id AS doc_id, len(s.words) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN hit h ON h.id = s.id LEFT JOIN named n ON n.id = s.id WHERE s.kind = 'doc'
"""

def revision(text: Column, source: Column) -> Column:
    """A revision of a document: its source noted in the middle, its first line cut, its last words in capitals."""
    text, note = F.coalesce(text, F.lit("")), F.concat(F.lit(" ("), F.coalesce(source, F.lit("")), F.lit(") "))
    size, first, tail = F.length(text), F.locate("\n", text), F.least(F.length(text), F.lit(20))
    kept = size + F.length(note) - first - tail

    def edit(start: Column, removed: Column, inserted: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), removed.cast("long").alias("removed"), inserted.alias("inserted"))

    return F.array(
        edit(F.floor(size / 2), F.lit(0), note),
        edit(F.lit(0), first, F.lit("")),
        edit(kept, tail, F.upper(F.right(text, tail))),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its revision, and how many characters that took to encode anew."""
    import public_tokenizers

    ranks, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", revision(F.col("text"), F.col("source")).alias("edits"))
    before = token_trees(docs, ranks, pattern).withColumn("n_tokens_before", F.col("n_tokens"))
    after = apply_edits(before, ranks, pattern)
    return after.select(
        "doc_id", "n_tokens_before", F.col("n_tokens").alias("n_tokens_after"),
        F.length("text").cast("long").alias("n_chars_after"), F.size("leaves").cast("long").alias("n_leaves"), "n_encoded",
    )


def op11_prefix_trie(
    spark: SparkSession, sf_dir: str, segment_turns: int = SEGMENT_TURNS, shard_turns: int = SHARD_TURNS
) -> DataFrame:
    """Nodes of the trie of conversations that start as the first of their five does.

    Rows without a conversation are left out; turns with one number come in order of a digest of role and text.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    code = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = table(spark, sf_dir, "conversations").filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", code.alias("code"), F.octet_length(text).alias("size")
    )
    conv = F.col("conv")
    head = (F.crc32(conv.cast("string").cast("binary")) % 9).cast("int")
    rebuilt, convs = rebuilt_turns(turns, conv - conv % 5, head, 8)
    return prefix_trie(rebuilt, convs, segment_turns, shard_turns).withColumnRenamed("saved", "saved_tokens")


OP11_SQL = """
WITH own AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
         octet_length(encode(coalesce(text, ''))) AS size, turn
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, code, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) - 1 AS pos FROM own
), bytes AS (
  SELECT c, i, ascii(substr(CAST(c AS VARCHAR), i, 1)) AS byte
  FROM (SELECT c, unnest(range(1, length(CAST(c AS VARCHAR)) + 1)) AS i FROM (SELECT DISTINCT conv_id AS c FROM own))
), steps AS (
  -- One entry of the table of the checksum for each byte.
  SELECT b AS byte, list_reduce([CAST(b AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS entry FROM range(256) r(b)
), tables AS (SELECT list(entry ORDER BY byte) AS entries FROM steps), sums AS (
  SELECT c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list(CAST(byte AS BIGINT) ORDER BY i)),
    lambda x, y: xor(x >> 8, any_value(entries)[xor(x & 255, y) + 1]))) AS crc FROM bytes CROSS JOIN tables GROUP BY c
), heads AS (SELECT c AS conv_id, c - c % 5 AS base, crc % 9 AS h FROM sums), moved AS (
  SELECT h.*, least(h.h, (SELECT count(*) FROM turns t WHERE t.conv_id = h.base)) AS led FROM heads h
), rebuilt AS (
  SELECT m.conv_id, t.pos + 1 AS depth, t.code, t.size FROM moved m JOIN turns t ON t.conv_id = m.base AND t.pos < m.h
  UNION ALL
  SELECT m.conv_id, t.pos - m.h + m.led + 1, t.code, t.size FROM moved m JOIN turns t ON t.conv_id = m.conv_id AND t.pos >= m.h
), paths AS (
  SELECT conv_id, depth, size, md5(string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM heads
), chained AS (
  SELECT *, lag(path) OVER own AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS final FROM paths
  WINDOW own AS (PARTITION BY conv_id ORDER BY depth)
), nodes AS (
  SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE final), '') AS ends
  FROM chained GROUP BY depth, path
), hung AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL), whole AS (
  SELECT n.*, coalesce(h.n, 0) AS n_children FROM nodes n LEFT JOIN hung h USING (depth, path)
), below AS (
  -- Each node counts for the nodes on the path of its smallest conversation.
  SELECT p.depth, p.path, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.size) AS saved
  FROM whole w JOIN paths p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY ALL
)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM whole w JOIN below b USING (depth, path) LEFT JOIN nodes u ON u.depth = w.depth - 1 AND u.path = w.above
"""


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learnt from nine tenths of them; a null id is held out."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    return katz_scores(table(spark, sf_dir, "documents"), fold != 0)


def repeating_tail(doc_id: Column, text: Column) -> Column:
    """The text of a document for ``op13``: that of one in ten repeats itself from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words, g = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.floor(h / 10)
    n = F.size(words)
    a = (g % n).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    rounds = F.ceil((n - a) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, period), rounds)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each document repeats itself: its runs, the one of most periods, and what is left without repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", repeating_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)

    def better(best: Column, run: Column) -> Column:
        # Runs come by start, then period, so the first of equal ones stays.
        whole = "decimal(38,0)"
        more = run["length"].cast(whole) * best["period"] > best["length"].cast(whole) * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    none = F.lit(None).cast(found.schema["runs"].dataType.elementType)
    found = found.withColumn("best", F.aggregate("runs", none, better))
    listed = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality": op2_quality,
    "op3_url_filter": op3_url_filter,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_pii": op8_pii,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_near_dedup": OP1_SQL,
    "op3_url_filter": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
}
