"""Cheap necessary conditions of the built-in rules.

A rule's expression runs on a line only if the line passes the rule's gates and holds one text of every group, so
that most lines are settled by a handful of substring tests inside generated code.  Each entry must hold for *every*
match of its rule; ``tests/test_detect.py`` compares scans with and without them.  A rule without an entry runs on
every line.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_letters, digits

from keysift.rules.catalog import ASSIGNMENT, BUILTIN_RULES, NAME_TAIL, Rule

# Gates are tested once per line and shared by the rules.
GATES: dict[str, tuple[str, ...]] = {
    "_": ("_",),
    "-": ("-",),
    "=": ("=",),
    "quote": ('"', "'", "`"),
    "assign": ("=", ":"),
    "://": ("://",),
}
# One more gate, `run`: this many characters in a row of those that tokens, paths and base64 text are made of.
# Spelled out one by one, because Java tests such a class with one table lookup.
RUN_CHARS = ascii_letters + digits + r"+/=_.\-"
RUN_LENGTH = 15
# Most lines pass no gate but "_" and "-": they are left alone before any rule is asked.  A line is looked at if it holds
# a run, one of FIRST_CHARS, which the other gates come to, or FIRST_TEXT, for rules that need none of these.
FIRST_GATES = frozenset({"run", "=", "quote", "assign", "://"})
FIRST_CHARS = "=:\"'`"
FIRST_TEXT = "PRIVATE KEY"


@dataclass(frozen=True)
class Anchor:
    gates: tuple[str, ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()
    folded: bool = False  # compare texts without regard to case
    shape: str | None = None  # a simpler pattern that matches wherever the rule's does
    headed: bool = False  # FIRST_TEXT or a run is in every match

    @property
    def first(self) -> bool:
        """Whether a line with a match is one of those that are looked at."""
        return self.headed or not FIRST_GATES.isdisjoint(self.gates)


def _needs(*gates: str, has: tuple = (), folded: bool = False, shape: str | None = None, headed: bool = False) -> Anchor:
    """``has`` lists the groups; a plain string is a group of one text."""
    return Anchor(gates, tuple((g,) if isinstance(g, str) else g for g in has), folded, shape, headed)


def _folded(*gates: str, has: tuple, shape: str | None = None) -> Anchor:
    return _needs(*gates, has=has, folded=True, shape=shape)


ANCHORS: dict[str, Anchor] = {
    "API-001": _needs("run", "-", has=("sk-",)),
    "API-002": _needs("run", "-", has=("sk-ant-api",)),
    "API-016": _needs("run", "_", has=("hf_",)),
    "API-017": _needs("run", has=("AIzaSy",)),
    "API-003": _needs("run", has=("AIza",)),
    "API-004": _needs("run", has=(("AKIA", "ABIA", "ACCA", "ASIA"),)),
    "API-005": _folded("run", "assign", has=("aws", "key")),
    "API-018": _folded("run", "=", has=("defaultendpointsprotocol=",)),
    "API-019": _folded("assign", "quote", has=("secret", ("azure", "aad", "msal"))),
    "API-020": _folded("run", "assign", "quote", has=("cloudflare",)),
    "API-021": _needs("run", "_", has=("dop_v1_",)),
    "API-015": _needs("run", "_", has=("sbp_",)),
    "API-022": _needs("://", has=(".firebase",)),
    "API-006": _needs("run", "_", has=(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),)),
    "API-007": _needs("run", "-", has=("glpat-",)),
    "API-023": _needs("run", "_", has=("npm_",)),
    "API-024": _needs("run", "-", has=("pypi-",)),
    "API-025": _needs("://", has=("@",)),
    "API-008": _needs("run", "_", has=(("_live_", "_test_"),)),
    "API-009": _needs("run", "_", has=(("appl_", "goog_", "amzn_", "rcb_"),)),
    "API-026": _needs("run", "_", has=("access_token$",)),
    "API-027": _needs("run", has=(("sq0atp", "sq0csp", "EAAA"),)),
    "API-014": _needs("run", has=("k.eyJ1I",)),
    "MAP-001": _folded("run", "assign", "quote", "-", has=(("mapkit", "yandex", "ymaps", "geocoder", "geosuggest"),)),
    "MAP-002": _folded("run", "_", has=("com.google.android.",)),
    "MAP-003": _folded(
        "run", "assign", "quote", has=(("2gis", "dgis", "heremaps", "here_maps", "here-maps", "hereapi", "mapy"),)
    ),
    "SDK-001": _needs("run", "://", has=("sentry.io/",)),
    "SDK-002": _folded("run", "assign", "quote", has=("onesignal",)),
    "SDK-003": _folded("run", "assign", "quote", has=(("amplitude", "mixpanel"),)),
    "SDK-004": _folded("assign", "quote", has=(("appsflyer", "adjust", "branch"), ("key", "token", "secret"))),
    "SDK-005": _folded("assign", "quote", has=(("appmetrica", "vk"),)),
    "API-010": _needs("run", has=(("xox", "hooks.slack.com/services/"),)),
    "API-011": _needs("run", "assign", shape=r":[a-zA-Z0-9_-]{35}"),
    "API-012": _needs("run", has=(("AC", "SK"),)),
    "API-013": _needs("run", has=("SG.",)),
    "API-028": _needs("run", shape=r"[MNO][a-zA-Z0-9_\-]{23,26}\.|/api/webhooks/"),
    "API-029": _needs("run", "assign", has=(":APA91b",)),
    "DB-001": _needs("://", has=("@",)),
    "DB-002": _folded("://", "=", has=("jdbc:", "password=")),
    "AUTH-001": _needs("run", has=(".eyJ",)),
    "AUTH-002": _folded("run", has=("bearer",)),
    "AUTH-003": _folded("run", has=("basic",)),
    "KEY-001": _needs("-", has=("PRIVATE KEY-----",), headed=True),
    "KEY-002": _needs("-", has=("-----BEGIN PRIVATE KEY-----",), headed=True),
    "KEY-003": _needs("-", has=(("-----BEGIN PGP PRIVATE KEY BLOCK-----", "ssh-rsa"),), headed=True),
    "SWIFT-002": _folded(
        "=",
        "quote",
        has=(
            (
                "ksecattrgeneric", "ksecvaluedata", "cryptokey", "encryptionkey", "hmacsecret",
                "initializationvector", "ivbytes",
            ),
        ),
    ),
    "IOS-001": _folded("assign", "_", has=(("asc_", "app_store_connect_", "fastlane_"),)),
    "IOS-002": _needs("quote", has=("#", "define")),
    "CONFIG-001": _folded(
        "_", "quote",
        has=(("git_url", "match_password", "apple_id", "app_identifier", "fastlane_password", "fastlane_session"),),
    ),
    "ANDROID-001": _folded("assign", has=(("store", "key"), ("password", "file", "alias"))),
    "ANDROID-002": _folded("=", has=(("key", "secret", "token", "password", "credential"),)),
    "ANDROID-003": _folded("quote", has=("buildconfigfield",)),
    "ANDROID-004": _folded("quote", "=", has=("</string>",)),
    "CONFIG-002": _folded("=", has=(("secret", "token", "key"),)),
    "CONFIG-003": _folded("=", has=(("key", "secret", "token", "passw", "credential"),)),
    "SWIFT-001": _folded(
        "assign", "quote", has=(("key", "secret", "token", "authorization", "credential", "pass"),),
        shape=rf"(?i:key|secret|token|authorization|credentials?|passphrase|password|passwd){NAME_TAIL}{ASSIGNMENT}[\"'`]",
    ),
}


# A rule's gates hold for its pattern, whatever id a user's rule may have.
_BY_PATTERN = {rule.pattern: ANCHORS[rule.id] for rule in BUILTIN_RULES if rule.id in ANCHORS}


def anchor(rule: Rule) -> Anchor:
    if rule.keywords:
        plain = all(word.isascii() for word in rule.keywords)  # others may fold to more than one character
        return _folded("assign", "quote", has=(tuple(word.lower() for word in rule.keywords),) if plain else ())
    return _BY_PATTERN.get(rule.pattern, Anchor())
