"""Bring Python-dialect patterns to Java's, so a rule means the same in Spark as in ``re``.

A pattern is parsed as Python parses it and written out again for Java.  Java's ``\\b \\s \\d \\w`` are ASCII or
differently Unicode-aware, its case folding is ASCII unless told, it treats more characters as line ends, has other
names for groups, and repeats a group by recursion, once per round.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

# What Python's str.isalnum / str.isspace accept, as Java character class members.
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BOUNDARY = "(?:(?<![{0}])(?=[{0}])|(?<=[{0}])(?![{0}]))"
_MEMBERS = {"WORD": (_WORD, "A-Za-z0-9_"), "SPACE": (_SPACE, r" \t-\r"), "DIGIT": (r"\p{Nd}", "0-9")}
_LETTERS = {re.I: "i", re.M: "m", re.S: "s", re.X: "x"}
_LOOK = {(op.ASSERT, 1): "?=", (op.ASSERT, -1): "?<=", (op.ASSERT_NOT, 1): "?!", (op.ASSERT_NOT, -1): "?<!"}
_LAZY = {op.MAX_REPEAT: "", op.MIN_REPEAT: "?", op.POSSESSIVE_REPEAT: "+"}
MOST_ROUNDS = 1000  # of a repeated group; a task's stack holds the recursion of so many

# Repeated groups of built-in rules in an equal form without a group to repeat: here, a run of host labels is a run
# of their characters that neither starts with a dot nor holds two in a row.
_FORMS = {
    r"(?:o\d+\.ingest\.)?(?:[a-z0-9\-]+\.)*sentry\.io/":
        r"(?![a-z0-9.\-]*\.\.)(?=[a-z0-9\-])(?:[a-z0-9.\-]*\.)?sentry\.io/",
}


class Untranslatable(ValueError):
    """The pattern holds what Java's regular expressions cannot express."""


def _literal(code: int) -> str:
    return chr(code) if chr(code).isascii() and chr(code).isalnum() else rf"\x{{{code:x}}}"


def _members(category, flags: int) -> tuple[str, bool]:
    """Class members of a category, and whether it is the complement of them."""
    name = str(category).removeprefix("CATEGORY_")
    return _MEMBERS[name.removeprefix("NOT_")][bool(flags & re.A)], name.startswith("NOT_")


def _one_of(items: list, flags: int) -> str:
    members, complements, negated = "", [], False
    for kind, value in items:
        if kind is op.NEGATE:
            negated = True
        elif kind is op.LITERAL:
            members += _literal(value)
        elif kind is op.RANGE:
            members += f"{_literal(value[0])}-{_literal(value[1])}"
        else:
            own, complement = _members(value, flags)
            if complement:
                complements.append(own)
            else:
                members += own
    if not complements:
        return f"[{'^' if negated else ''}{members}]"
    if negated:
        return "[" + "&&".join([*(f"[{c}]" for c in complements), *([f"[^{members}]"] if members else [])]) + "]"
    union = "".join(f"[^{c}]" for c in complements)
    return union if len(complements) == 1 and not members else f"[{members}{union}]"


def _at(place, flags: int) -> str:
    word = _MEMBERS["WORD"][bool(flags & re.A)]
    boundary = _BOUNDARY.format(word)
    several = "(?m:{})" if flags & re.M else "{}"
    return {
        op.AT_BEGINNING: several.format("^"), op.AT_END: several.format("$"), op.AT_BEGINNING_STRING: r"\A",
        op.AT_END_STRING: r"\z", op.AT_BOUNDARY: boundary, op.AT_NON_BOUNDARY: f"(?!{boundary})",
    }[place]


def _repeat(kind, least: int, most, body, flags: int) -> str:
    inner = _written(body, flags)
    simple = len(body) == 1 and body[0][0] in (op.LITERAL, op.NOT_LITERAL, op.IN, op.ANY)
    if not simple:
        inner = f"(?:{inner})"
        most = min(most, max(least, MOST_ROUNDS)) if most is op.MAXREPEAT or most > MOST_ROUNDS else most
    sign = {(0, 1): "?", (0, op.MAXREPEAT): "*", (1, op.MAXREPEAT): "+"}.get((least, most))
    if sign is None:
        sign = f"{{{least},}}" if most is op.MAXREPEAT else f"{{{least}}}" if least == most else f"{{{least},{most}}}"
    return inner + sign + _LAZY[kind]


def _group(number, add: int, drop: int, body, flags: int) -> str:
    inner = _written(body, (flags | add) & ~drop)
    on, off = ("".join(letter for flag, letter in _LETTERS.items() if flag & x and flag != re.X) for x in (add, drop))
    if on or off:
        inner = f"(?{on}{'-' if off else ''}{off}:{inner})"
    return inner if number is None and (on or off) else f"({inner})" if number is not None else f"(?:{inner})"


def _written(tree, flags: int) -> str:
    out = []
    for kind, value in tree:
        if kind is op.LITERAL:
            out.append(_literal(value))
        elif kind is op.NOT_LITERAL:
            out.append(f"[^{_literal(value)}]")
        elif kind is op.ANY:
            out.append("(?s:.)" if flags & re.S else ".")
        elif kind is op.IN:
            out.append(_one_of(value, flags))
        elif kind is op.AT:
            out.append(_at(value, flags))
        elif kind is op.BRANCH:
            out.append(f"(?:{'|'.join(_written(branch, flags) for branch in value[1])})")
        elif kind in _LAZY:
            out.append(_repeat(kind, *value, flags))
        elif kind is op.SUBPATTERN:
            out.append(_group(*value, flags))
        elif kind is op.ATOMIC_GROUP:
            out.append(f"(?>{_written(value, flags)})")
        elif (kind, value[0] if isinstance(value, tuple) else None) in _LOOK:
            out.append(f"({_LOOK[kind, value[0]]}{_written(value[1], flags)})")
        elif kind is op.GROUPREF:
            out.append(rf"(?:\{value})")
        elif kind is op.FAILURE:
            out.append("(?!)")
        else:
            raise Untranslatable(str(kind).lower())
    return "".join(out)


def _parsed(pattern: str):
    for form, equal in _FORMS.items():
        pattern = pattern.replace(form, equal)
    return parser.parse(pattern)


def _bodies(kind, value) -> list:
    """The patterns inside a part of a pattern."""
    if kind in _LAZY or kind is op.SUBPATTERN:
        return [value[-1]]
    if kind is op.BRANCH:
        return list(value[1])
    if kind is op.ATOMIC_GROUP:
        return [value]
    return [value[1]] if kind in (op.ASSERT, op.ASSERT_NOT) else []


def _bound(tree) -> int | None:
    bounds = []
    for kind, value in tree:
        if kind is op.GROUPREF_EXISTS:
            return 0
        if kind in _LAZY:
            least, most, body = value
            if not (len(body) == 1 and body[0][0] in (op.LITERAL, op.NOT_LITERAL, op.IN, op.ANY)):
                if least > MOST_ROUNDS:
                    return 0
                if most is op.MAXREPEAT or most > MOST_ROUNDS:
                    bounds.append(MOST_ROUNDS * max(1, body.getwidth()[0]))
        bounds += (b for b in map(_bound, _bodies(kind, value)) if b is not None)
    return min(bounds, default=None)


@lru_cache(maxsize=10_000)
def python_length(pattern: str) -> int | None:
    """How long a line must be for ``to_java`` to find less in it than ``re``; nothing if it never does.

    A group that Java may repeat ``MOST_ROUNDS`` times takes that many times its least width, so shorter lines end
    before the bound is met.  Zero for what Java cannot express.
    """
    return _bound(_parsed(pattern))


def to_java(pattern: str) -> str:
    """Java pattern that finds in a line what Python's ``re`` finds there, if it is shorter than ``python_length``.

    Groups keep their numbers.  A group that is repeated without bound is repeated ``MOST_ROUNDS`` times at most,
    as more would exhaust the stack of a task; a class of single characters is no group and has no such bound.
    """
    tree = _parsed(pattern)
    flags = tree.state.flags
    return "(?ud" + ("i" if flags & re.I else "") + ")" + _written(tree, flags)


def problem(spark: SparkSession, pattern: str) -> str | None:
    """Why a pattern cannot be a rule, or nothing; Spark folds the literal test on the driver, without a job."""
    try:
        re.compile(pattern)
        if python_length(pattern) == 0:  # left to ``re``
            return None
        spark.range(1).select(F.lit("").rlike(to_java(pattern))).collect()
    except re.error as error:
        return f"not a regular expression: {error}"
    except Untranslatable as error:
        return f"not expressible in Spark: {error}"
    except (PySparkException, AnalysisException) as error:
        return f"not expressible in Spark: {str(error).splitlines()[0][:200]}"
    return None


def compiles(spark: SparkSession, pattern: str) -> bool:
    return problem(spark, pattern) is None
