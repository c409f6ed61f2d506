"""Cross-site line deduplication: HyperLogLog sketches of the sites of each line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keysift.llm.shared import Carried, join_groups, settled

LG_BUCKETS = 10
# Six standard errors of a sketch with 2^LG_BUCKETS buckets.
_ERROR = 6 * 1.04 / 2 ** (LG_BUCKETS / 2)
_BLANKS = " \t\r"


def _line_key(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def line_spread(lines: DataFrame, min_sites: int) -> DataFrame:
    """Lines on at least ``min_sites`` sites, as ``(h1, h2, n, first)``, from ``lines(h1, h2, site, place)``.

    Each task sketches the sites of the lines it reads; sketches of one line merge, so a line that is on every
    page of every site still arrives as one small row per task.  Where an estimate is too close to the threshold
    for the sketch's error, distinct sites are counted exactly.
    """
    spread = settled(
        lines.groupBy("h1", "h2").agg(
            F.hll_sketch_agg("site", F.lit(LG_BUCKETS)).alias("sketch"),
            F.count(F.lit(1)).alias("n"),
            F.min("place").alias("first"),
        ).withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch")
        .filter(F.col("sites") >= min_sites * (1 - _ERROR) - 1),
        "spread",
    )
    near = F.col("sites") <= min_sites * (1 + _ERROR) + 1
    doubtful = spread.filter(near).select("h1", "h2")
    exact = (
        lines.filter(F.col("site").isNotNull()).select("h1", "h2", "site").distinct()
        .join(doubtful, ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    )
    sure = spread.filter(~near).select("h1", "h2", "n", "first")
    told = spread.filter(near).join(exact, ["h1", "h2"]).filter(F.col("exact") >= min_sites)
    return sure.unionByName(told.select("h1", "h2", "n", "first"))


def _without(lines: Column, cut: Column) -> Column:
    """The lines, joined, but for those at the places in ``cut``, in time linear in the lines.

    Whether a line stays is an array beside the lines; a lambda that looked a line up would split the text each time.
    """
    cut = F.array_sort(cut)
    stays = F.zip_with(
        F.concat(F.array(F.lit(-1)), cut), F.concat(cut, F.array(F.size(lines))),
        lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False))),
    )
    return F.array_join(F.zip_with(lines, F.flatten(stays), lambda line, stay: F.when(stay, line)), "\n")


def line_dedup(
    docs: DataFrame,
    min_sites: int = 5,
    keep_first: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """``docs`` with boilerplate lines cut out of the text, and ``n_lines`` and ``n_cut``.

    A line, without blanks at its ends, is boilerplate when it stands on at least ``min_sites`` distinct sites.
    Its first occurrence (smallest id, then earliest in the text) stays unless ``keep_first`` is false, so a page
    that is copied to many sites remains once.  Blank lines are never boilerplate.  A null site counts as none; a
    null text stays null and has no lines; a null id orders after all others.  Repeated rows with the same id and
    text are one occurrence and are cut alike.  Two helper columns are added to whatever ``docs`` has; columns of
    those names are replaced.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A row is known by its id and its text, as ids may repeat.
    known = {"k_id": F.col(id_col), "k_text": F.md5(text)}
    pieces = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_BLANKS)))
    # The text is hashed below the generator, not once more for each line.
    whole = docs.select(F.col(site_col).cast("string").alias("site"), *(c.alias(k) for k, c in known.items()), pieces.alias("pieces"))
    lines = whole.select("site", *known, F.posexplode("pieces").alias("at", "line"))
    lines = settled(
        lines.filter(F.col("line") != "").select(
            "site", "k_id", "k_text", "at", *_line_key(F.col("line")),
        ),
        "lines",
    )
    place = F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_text", "at").alias("place")
    placed = lines.select("h1", "h2", "site", place)
    bad = settled(line_spread(placed, min_sites), "boilerplate")
    hits = join_groups(lines, bad, ["h1", "h2"], "n", lines.count())
    if keep_first:
        first = F.col("first")
        hits = hits.filter(~(F.col("k_id").eqNullSafe(first["k_id"]) & (F.col("k_text") == first["k_text"]) & (F.col("at") == first["at"])))
    cuts = hits.groupBy("k_id", "k_text").agg(F.collect_set("at").alias("cut"))
    cuts = cuts.select(F.col("k_id").alias("c_id"), F.col("k_text").alias("c_text"), "cut")
    carried = Carried(docs, ("n_lines", "n_cut", text_col))
    rows = docs.select(carried.column, F.col(text_col).alias("old"), *(c.alias(k) for k, c in known.items()))
    rows = rows.join(cuts, F.col("k_id").eqNullSafe(F.col("c_id")) & (F.col("k_text") == F.col("c_text")), "left")
    old = F.col("old")
    split = F.split(F.coalesce(old, F.lit("")), "\n")
    new = F.when(F.col("cut").isNull(), old).otherwise(_without(split, F.col("cut")))
    back = carried.back() | {text_col: new.alias(text_col)}
    return rows.select(
        *(back[c] for c in docs.columns if c in back),
        F.when(old.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_cut"),
    )
