"""Scalar column functions of the audit; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keysift.rules.catalog import RISKS, SEVERITY

# Two log2 implementations may differ in the last bit; thresholds allow for that.
ENTROPY_SLACK = 1e-12


def severity_score(risk: Column) -> Column:
    score = F.lit(0)
    for name in reversed(RISKS):
        score = F.when(risk == name, SEVERITY[name]).otherwise(score)
    return score


def redact(matched: Column, visible: int = 4) -> Column:
    """Mask a matched secret, leaving a few characters at each end when it is long enough."""
    clean = F.btrim(matched, F.lit("'\" \t\r\n"))
    size = F.length(clean)
    stars = F.least(F.greatest(size - 2 * visible, F.lit(4)), F.lit(12))
    return F.when(size <= 2 * visible, F.repeat(F.lit("*"), size)).otherwise(
        F.concat(F.substring(clean, 1, visible), F.repeat(F.lit("*"), stars), F.lit(".."), F.right(clean, F.lit(visible)))
    )


def distinct_chars(text: Column) -> Column:
    return F.array_distinct(F.split(text, ""))


LONG_CHARS = 1000  # from here on, characters are sorted and counted in one pass


def _entropy_by_runs(text: Column) -> Column:
    """Bits per character of a long text, by the runs of its sorted characters."""
    def bits(so_far: Column) -> Column:
        share = so_far["run"] / so_far["size"]
        return F.when(so_far["run"] == 0, so_far["bits"]).otherwise(so_far["bits"] - share * F.log2(share))

    def step(so_far: Column, char: Column) -> Column:
        same = char == so_far["char"]
        return F.struct(
            char.alias("char"), F.when(same, so_far["run"] + 1).otherwise(1).alias("run"), so_far["size"].alias("size"),
            F.when(same, so_far["bits"]).otherwise(bits(so_far)).alias("bits"),
        )

    start = F.struct(F.lit("").alias("char"), F.lit(0).alias("run"), F.length(text).alias("size"), F.lit(0.0).alias("bits"))
    return F.aggregate(F.array_sort(F.split(text, "")), start, step, bits)


def shannon_entropy(text: Column) -> Column:
    """Bits per character.

    Characters are summed in the order of their first occurrence, those of a text of ``LONG_CHARS`` and more in order
    of their codes, which takes no longer for many distinct ones.  The two sums differ by less than 1e-12 up to some
    hundred distinct characters, and by the rounding of so many terms beyond (5e-12 with 20,000).
    """
    size = F.length(text)

    def add(bits: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(text, char, F.lit("")))) / size
        return bits - share * F.log2(share)

    short = F.aggregate(distinct_chars(text), F.lit(0.0), add)
    return F.when(size == 0, F.lit(0.0)).when(size >= LONG_CHARS, _entropy_by_runs(text)).otherwise(short)


def _above(value: Column, halves: Column, scale: int) -> Column:
    """The exact sign of ``value - halves / (2 * scale)``: the value is split in two, so no product is rounded."""
    wide = value * F.lit(134217729.0)
    high = wide - (wide - value)
    return (high * F.lit(2.0 * scale) - halves) + (value - high) * F.lit(2.0 * scale)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fixed_point(value: Column, digits: int) -> Column:
    """A number from 0 on with ``digits`` decimals: the exact value of the double, rounded half to even."""
    scale = 10**digits

    def rounded(parts: Column) -> Column:
        value, near = parts["value"], parts["near"]
        odd = near % 2 == 1
        below, above = _above(value, 2 * near - 1, scale), _above(value, 2 * near + 1, scale)
        return F.when((below < 0) | ((below == 0) & odd), near - 1).when((above > 0) | ((above == 0) & odd), near + 1).otherwise(near)

    def written(number: Column) -> Column:
        rest = F.lpad((number % scale).cast("string"), digits, "0")
        return F.concat(F.floor(number / scale).cast("string"), F.lit("."), rest)

    parts = F.struct(value.alias("value"), F.floor(value * scale + 0.5).alias("near"))
    return _once(_once(parts, rounded), written)


def format_duration(seconds: Column) -> Column:
    rest = seconds % 60
    minutes = F.floor((seconds - rest) / 60).cast("string")
    return (
        F.when(seconds < 1, F.concat(fixed_point(seconds * 1000, 1), F.lit(" ms")))
        .when(seconds < 60, F.concat(fixed_point(seconds, 2), F.lit(" s")))
        .otherwise(F.concat(minutes, F.lit("m "), fixed_point(rest, 1), F.lit("s")))
    )


def html_escape(text: Column) -> Column:
    """The text with entities; most hold nothing to replace, so that is tested first, in one pass instead of five."""
    def escaped(text: Column) -> Column:
        done = text
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            done = F.replace(done, F.lit(char), F.lit(entity))
        return F.when(text.rlike("[&<>\"']"), done).otherwise(text)

    return _once(text, escaped)
