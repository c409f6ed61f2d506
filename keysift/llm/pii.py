"""Format-preserving pseudonyms of personal numbers, dates and mail names by a keyed Feistel network, in SQL functions only.

A value is a list of symbols, each with its own radix: the digits of a card number, the octets of an address, the
two halves of a day number.  A round adds a keyed hash of one half of the list to the symbols of the other, each
modulo its radix, so any number of rounds is a permutation of the values of that format.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROUNDS = 10
HMAC_BLOCK, HMAC_PADS = 64, (0x36, 0x5C)  # fixed values of HMAC with SHA-256
FIRST_DAY, DAYS = "1900-01-01", (250, 292)  # the days up to 2099-11-12
LATE_DAYS = (2344, 1231)  # a format of their own: the days after those, up to 9999-12-31
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_START, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"

# No repeated group is unbounded, as Java matches those by recursion.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@[A-Za-z0-9][A-Za-z0-9.\-]{0,250}\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    # Three numbers with dots only, without +1, are a phone number only from 2 on.
    "phone": _START + r"(?:\+1[ .\-]?[0-9]{3}[ .\-]|(?:\+1[ .\-]?)?\([0-9]{3}\) ?|[0-9]{3}[ \-]|[2-9][0-9]{2}\.)[0-9]{3}[ .\-][0-9]{4}" + _END,
    "card": _START + r"(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}"
    r"|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})" + _END,
    "ip": r"(?<![0-9A-Za-z.])" + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + r"(?![0-9A-Za-z]|\.[0-9])",
    "iso_date": r"(?<![0-9A-Za-z\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])",
    "dot_date": r"(?<![0-9A-Za-z.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
}
ANY = "|".join(FORMATS.values())


def _longs(values) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda d: d.cast("long"))


def _part(text: Column, start: int, length: int) -> Column:
    return F.substring(text, start, length).cast("long")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, v: total + v)


def _luhn(digits: Column) -> Column:
    """Sum of a number's digits, every second one from the right doubled; the last digit is not doubled."""
    def value(digit: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return _total(F.transform(F.reverse(digits), value))


def _kind(value: Column) -> Column:
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(value.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"), "ip")
        .when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "iso_date")
        .when(value.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), "dot_date")
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(F.length(F.regexp_replace(value, "[^0-9]", "")) >= 13, "card")
        .otherwise("phone")
    )


def _day(value: Column, pattern: str) -> Column:
    """Days from ``FIRST_DAY``; null when there is no such day or it lies outside the range."""
    day = F.datediff(F.try_to_timestamp(value, F.lit(pattern)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    return F.when((day >= 0) & (day < DAYS[0] * DAYS[1] + LATE_DAYS[0] * LATE_DAYS[1]), day)


def _least(digit: Column, i: Column) -> Column:
    """The smallest digit of the format at a place of a phone number: area code and exchange keep to 0 and 1, or to 2 to 9."""
    return F.when(((i == 0) | (i == 3)) & (digit >= 2), 2).otherwise(0).cast("long")


def _local(value: Column) -> Column:
    return F.split(F.substring_index(value, "@", 1), "")


def _parsed(value: Column) -> Column:
    """``(value, kind, symbols, radices)``; symbols are null when the value does not pass its format's validation."""
    kind, digits = _kind(value), _digits(value)
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    day = F.when(kind == "iso_date", _day(value, "yyyy-MM-dd")).otherwise(_day(value, "dd.MM.yyyy"))
    late = day >= DAYS[0] * DAYS[1]
    from_, low = F.when(late, day - DAYS[0] * DAYS[1]).otherwise(day), F.when(late, LATE_DAYS[1]).otherwise(DAYS[1])
    number = F.slice(digits, F.size(digits) - 9, 10)
    local = _local(value)
    letters = F.transform(
        local,
        lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[a-z]$"), F.ascii(c) - 97)
        .when(c.rlike("^[A-Z]$"), F.ascii(c) - 65).otherwise(0).cast("long"),
    )
    alphabet = F.transform(
        local, lambda c: F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1).cast("long")
    )
    area, group, serial = _part(value, 1, 3), _part(value, 5, 2), _part(value, 8, 4)
    social = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    symbols = (
        F.when(kind == "email", letters)
        .when(kind == "ip", octets)
        .when((kind == "card") & (_luhn(digits) % 10 == 0), F.slice(digits, F.lit(1), F.size(digits) - 1))
        .when(kind == "phone", F.transform(number, lambda d, i: d - _least(d, i)))
        .when(kind.isin("iso_date", "dot_date") & day.isNotNull(),
              F.array(F.floor(from_ / low).cast("long"), (from_ % low).cast("long")))
        .when((kind == "ssn") & social, F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1))
    )
    radices = (
        F.when(kind == "email", alphabet)
        .when(kind == "ip", _longs([256] * 4))
        .when(kind == "card", F.transform(F.slice(digits, F.lit(1), F.size(digits) - 1), lambda _: F.lit(10).cast("long")))
        .when(kind == "phone", F.transform(number, lambda d, i: F.when((i != 0) & (i != 3), 10).when(d >= 2, 8).otherwise(2).cast("long")))
        .when(kind.isin("iso_date", "dot_date"), F.when(late, _longs(LATE_DAYS)).otherwise(_longs(DAYS)))
        .when(kind == "ssn", _longs([898, 99, 9999]))
    )
    # Dates are one kind of value, however they are written.
    tweak = F.when(kind.isin("iso_date", "dot_date"), "date").otherwise(kind)
    return F.struct(value.alias("value"), kind.alias("kind"), tweak.alias("tweak"), symbols.alias("symbols"), radices.alias("radices"))


def _permuted(symbols: Column, radices: Column, tweak: Column, pads: Column) -> Column:
    """The symbols after ``ROUNDS`` rounds, alternately of the first half by the second and back."""
    half = F.floor((F.size(symbols) + 1) / 2).cast("int")
    rest = F.size(symbols) - half

    def stream(round_: Column, other: Column, i: Column, radix: Column) -> Column:
        told = F.concat_ws("|", tweak, F.size(symbols).cast("string"), round_.cast("string"), i.cast("string"),
                           F.array_join(F.transform(other, lambda s: s.cast("string")), ","))
        inner = F.unhex(F.sha2(F.concat(pads["inner"], F.encode(told, "utf-8")), 256))
        return F.conv(F.substring(F.sha2(F.concat(pads["outer"], inner), 256), 1, 13), 16, 10).cast("long") % radix

    def mixed(own: Column, other: Column, sizes: Column, round_: Column) -> Column:
        return F.transform(own, lambda v, i: (v + stream(round_, other, i, F.get(sizes, i))) % F.get(sizes, i))

    def step(state: Column, round_: Column) -> Column:
        a, b = state["a"], state["b"]
        return F.when(
            round_ % 2 == 0, F.struct(mixed(a, b, F.slice(radices, F.lit(1), half), round_).alias("a"), b.alias("b"))
        ).otherwise(F.struct(a.alias("a"), mixed(b, a, F.slice(radices, half + 1, rest), round_).alias("b")))

    start = F.struct(F.slice(symbols, F.lit(1), half).alias("a"), F.slice(symbols, half + 1, rest).alias("b"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda state: F.concat(state["a"], state["b"]))


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its last digits replaced by ``digits``, other characters in place."""
    skip = F.length(F.regexp_replace(value, "[^0-9]", "")) - F.length(digits)

    def step(state: Column, c: Column) -> Column:
        at = state["at"]
        new = F.when(c.rlike("[0-9]") & (at >= skip), F.substring(digits, at - skip + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(state["text"], new).alias("text"), (at + c.rlike("[0-9]").cast("int")).alias("at"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    return F.aggregate(F.split(value, ""), start, step, lambda state: state["text"])


def _written(value: Column, kind: Column, symbols: Column, radices: Column) -> Column:
    """The permuted symbols in the format of the value."""
    digits = F.array_join(F.transform(symbols, lambda s: s.cast("string")), "")
    check = (10 - _luhn(F.concat(symbols, _longs([0]))) % 10) % 10
    number = F.zip_with(symbols, radices, lambda s, radix: s + F.when(radix == 8, 2).otherwise(0))
    low = F.get(radices, F.lit(1))
    begin = F.when(low == LATE_DAYS[1], DAYS[0] * DAYS[1]).otherwise(0)
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (begin + F.get(symbols, F.lit(0)) * low + F.get(symbols, F.lit(1))).cast("int"))
    area = F.get(symbols, F.lit(0)) + 1

    def padded(number: Column, width: int) -> Column:
        return F.lpad(number.cast("string"), width, "0")

    letters = F.zip_with(
        _local(value), symbols,
        lambda c, s: F.when(c.rlike("^[0-9]$"), F.char(s + 48)).when(c.rlike("^[a-z]$"), F.char(s + 97))
        .when(c.rlike("^[A-Z]$"), F.char(s + 65)).otherwise(c),
    )
    return (
        F.when(symbols.isNull(), value)
        .when(kind == "email", F.concat(F.array_join(letters, ""), F.lit("@"), F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.array_join(F.transform(symbols, lambda s: s.cast("string")), "."))
        .when(kind == "card", _refilled(value, F.concat(digits, check.cast("string"))))
        .when(kind == "phone", _refilled(value, F.array_join(F.transform(number, lambda s: s.cast("string")), "")))
        .when(kind == "iso_date", F.date_format(day, "yyyy-MM-dd"))
        .when(kind == "dot_date", F.date_format(day, "dd.MM.yyyy"))
        .when(kind == "ssn", F.concat_ws("-", padded(area + F.when(area >= 666, 1).otherwise(0), 3),
                                         padded(F.get(symbols, F.lit(1)) + 1, 2), padded(F.get(symbols, F.lit(2)) + 1, 4)))
    )


def key_pads(spark: SparkSession, key: str) -> Column:
    """``struct<inner, outer>``: the key as the two blocks that HMAC-SHA-256 begins its digests with.

    They are a table of one row that a subquery reads, and no literals, so plans do not show them.
    """
    secret = key.encode()
    block = (sha256(secret).digest() if len(secret) > HMAC_BLOCK else secret).ljust(HMAC_BLOCK, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in HMAC_PADS)
    return spark.sql(f"SELECT struct(inner, outer) FROM VALUES (X'{inner}', X'{outer}') AS pads(inner, outer)").scalar()


def pseudonyms(text: Column, pads: Column) -> Column:
    """``array<struct<value, kind, pseudonym>>``: the validated values in ``text`` in order; others have no pseudonym.

    ``pads`` is a column of ``key_pads``.
    """
    # Most texts hold neither a digit nor a mail address; one cheap look spares them the formats.
    found = F.when(text.rlike("[0-9@]") & text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    parsed = F.transform(found, _parsed)
    moved = F.transform(
        parsed,
        lambda p: F.struct(
            p["value"].alias("value"), p["kind"].alias("kind"), p["radices"].alias("radices"),
            F.when(p["symbols"].isNotNull(), _permuted(p["symbols"], p["radices"], p["tweak"], pads)).alias("symbols"),
        ),
    )
    return F.transform(
        moved,
        lambda m: F.struct(
            m["value"].alias("value"), m["kind"].alias("kind"),
            F.when(m["symbols"].isNotNull(), _written(m["value"], m["kind"], m["symbols"], m["radices"])).alias("pseudonym"),
        ),
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with each validated value in the text replaced by its pseudonym, and ``found`` with the replacements.

    Card numbers pass the Luhn test before and after; addresses, social security numbers and dates stay valid ones,
    from 1900 on; phone numbers are known by their shape, whatever the digits, and an area code or exchange that
    starts with 0 or 1 gets one that does, as do those from 2 on; a mail name keeps its letters, digits and marks in place, and its domain.  Equal values have
    equal pseudonyms in all documents, also where a number is written with other separators, and different values
    of one format have different ones.  Values that fail their validation, and everything else, stay as they are.

    A null text stays null and has no values; empty texts, repeated rows and empty tables are what they are.  A
    column ``found`` of the input is replaced; all others, whatever their names, are kept.  Texts of any length are
    worked whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Lambdas take no subquery, so the key is a column of its own while it is needed.
    pads = "pads"
    while pads in (c.lower() for c in docs.columns):
        pads += "_"
    rows = docs.withColumn(pads, key_pads(docs.sparkSession, key))
    rows = rows.withColumn("found", pseudonyms(text, F.col(pads))).drop(pads)
    between = F.split(text, ANY, -1)
    new = F.transform("found", lambda f: F.coalesce(f["pseudonym"], f["value"]))
    rebuilt = F.array_join(F.zip_with(between, new, lambda b, n: F.concat(b, F.coalesce(n, F.lit("")))), "")
    rows = rows.withColumn(text_col, F.when(F.size("found") > 0, rebuilt).otherwise(F.col(text_col)))
    return rows.withColumn("found", F.filter("found", lambda f: f["pseudonym"].isNotNull()))
