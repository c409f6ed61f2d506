"""From file bytes to text to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# How much of a file is sampled, which share of control bytes makes it binary.
SAMPLE_BYTES = 4096
BINARY_SHARE = 0.3
_CONTROL = r"[\x01-\x06\x0b\x0e-\x1a\x1c-\x1f\x7f]"


def is_binary(content: Column) -> Column:
    sample = F.substring(content, 1, SAMPLE_BYTES)
    latin = F.decode(sample, "ISO-8859-1")
    control = F.length(latin) - F.length(F.regexp_replace(latin, _CONTROL, ""))
    return F.contains(sample, F.lit(bytes(1))) | (control / F.greatest(F.length(sample), F.lit(1)) > BINARY_SHARE)


def decode_text(content: Column) -> Column:
    """UTF-8 with U+FFFD in place of malformed bytes."""
    return F.make_valid_utf8(content.cast("string"))


def split_lines(text: Column) -> Column:
    r"""Array of lines; ``\n``, ``\r\n`` and ``\r`` end a line, and no empty line follows the last end."""
    size = F.length(text)
    body = (
        F.when(text.endswith("\r\n"), F.left(text, size - 2))
        .when(text.endswith("\n") | text.endswith("\r"), F.left(text, size - 1))
        .otherwise(text)
    )
    # Most texts have no carriage return, and a plain separator is much cheaper to split at.
    return (
        F.when(size == 0, F.array().cast("array<string>"))
        .when(F.contains(text, F.lit("\r")), F.split(body, "\r\n?|\n"))
        .otherwise(F.split(body, "\n"))
    )


def line_count(text: Column) -> Column:
    """Number of lines without splitting the text: line ends, plus an unfinished last line."""
    ends = (
        F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
        + F.length(text) - F.length(F.replace(text, F.lit("\r"), F.lit("")))
        - F.length(text) + F.length(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    )
    unfinished = (F.length(text) > 0) & ~text.endswith("\n") & ~text.endswith("\r")
    return (ends + unfinished.cast("int")).cast("bigint")


def explode_lines(files: DataFrame) -> DataFrame:
    """``(path, line_number, line)`` of the text files in ``files(path, text)``."""
    lines = files.select("path", split_lines(F.col("text")).alias("lines"))
    return lines.select("path", F.posexplode(F.coalesce("lines", F.array().cast("array<string>"))).alias("at", "line")).select(
        "path", (F.col("at") + 1).alias("line_number"), "line"
    )
