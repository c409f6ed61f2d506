"""Filter of page urls: rules on host and path, and decisions carried to aliases of a judged url."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from keysift.llm.graph import connected_components
from keysift.llm.shared import join_groups, settled

EXPRESSION_RULES = 500  # more than these are joined as a table, with the same results


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for a host with its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return _lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def plain_url(url: Column) -> Column:
    """The url without its scheme and with its host in lower case."""
    return F.concat(url_host(url), F.regexp_replace(_rest(url), r"^[^/?#]*", ""))


def canonical_url(url: Column) -> Column:
    """The plain url without fragment, tracking parameters and slashes at the end of a longer path; empty without host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    whole = F.concat(url_host(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(url_host(url) == "", "").otherwise(whole)


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` taken out."""
    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == ".", done).when(part == "..", shorter).otherwise(F.concat(done, F.array(part)))

    kept = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"/\.\.?$"), F.concat(kept, F.lit("/"))).otherwise(kept)


def _absolute(target: Column, url: Column) -> Column:
    """A link of the page at ``url`` as a whole url; null for one that leads to no host, as ``mailto:``."""
    rest = F.regexp_extract(target, r"[?#].*$", 0)
    own = F.regexp_extract(target, r"^[^?#]*", 0)
    page, query = url_path(url), F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    page = F.when(page == "", "/").otherwise(page)
    path = F.when(own == "", page).when(own.startswith("/"), own).otherwise(F.concat(F.regexp_replace(page, "[^/]*$", ""), own))
    rest = F.when(target.startswith("#"), F.concat(query, rest)).otherwise(rest)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(url_host(url) != "", F.concat(F.lit("http://"), url_host(url), _without_dots(path), rest))
    )


_CANONICAL = r"""(?is)\brel\s*=\s*(?:"(?:[^">]*\s)?canonical\b|'(?:[^'>]*\s)?canonical\b|canonical\b)"""


def page_links(url: Column, html: Column) -> Column:
    """Urls that a page names as its canonical form or refreshes to, of all its tags."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: t.rlike(_CANONICAL))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0))
    named = F.transform(tags, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    moved = F.transform(metas, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    targets = F.transform(F.concat(named, moved), lambda t: F.regexp_replace(t, "(?i)&amp;", "&"))
    return F.array_compact(F.transform(F.coalesce(targets, F.array().cast("array<string>")), lambda t: _absolute(t, url)))


def _in_order(rules: list[UrlRule]) -> list[UrlRule]:
    """The rules from the one that decides first: longer ones, of equally long ones those that allow."""
    return sorted(rules, key=lambda r: (-len(str(r)), r.verdict != "allow", str(r)))


def rule_for(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """``struct<rule, verdict>`` of the first of ``rules`` that fits, or null."""

    def fits(rule: UrlRule) -> Column:
        return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)

    told = (F.when(fits(r), F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in rules)
    return F.coalesce(*told, F.lit(None).cast("struct<rule: string, verdict: string>"))


def _grouped(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The distinct keys with their counts as ``n``, and the number of rows."""
    return settled(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "keys"), rows.count()


def _matched(rows: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``told``, one row for each of the keys, says, whatever share of them has one key."""
    counts, total = _grouped(rows, keys)
    return settled(join_groups(rows, settled(counts.join(told, keys), "told"), keys, "n", total).drop("n"), "matched")


def rules_by_join(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """``(host, path, by)`` of the distinct urls that one of ``rules`` fits: rule and verdict of the first that does.

    Hosts meet the hosts of rules by their endings, then paths meet the paths of those rules by their beginnings,
    of such lengths only as the rules of that host have.
    """
    named = [(r.host, r.path, i, str(r), r.verdict) for i, r in enumerate(rules)]
    table = urls.sparkSession.createDataFrame(named, "ending string, beginning string, place int, rule string, verdict string")
    first = F.min(F.struct("place", "rule", "verdict")).alias("first")
    table = settled(table.groupBy("ending", "beginning").agg(first), "rules")
    lengths = table.groupBy("ending").agg(F.collect_set(F.length("beginning")).alias("lengths"))
    deepest = max(r.host.count(".") for r in rules) + 1
    asked = settled(urls.select("host", "path").distinct(), "asked")
    labels = F.split("host", r"\.")
    # A host has few endings, at most as many as the host of a rule has labels.
    endings = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda k: F.array_join(F.slice(labels, -k, k), ".")
    )
    hosts = asked.select("host").distinct().select("host", F.explode(endings).alias("ending"))
    known = _matched(hosts, lengths, ["ending"]).groupBy("host").agg(F.collect_list(F.struct("ending", "lengths")).alias("known"))
    begun = (
        _matched(asked, known, ["host"]).select("host", "path", F.explode("known").alias("one"))
        .select("host", "path", F.col("one.ending").alias("ending"), F.explode("one.lengths").alias("length"))
        .filter(F.length("path") >= F.col("length"))
        .select("host", "path", "ending", F.substring("path", F.lit(1), F.col("length")).alias("beginning"))
    )
    found = _matched(settled(begun, "begun"), table, ["ending", "beginning"])
    best = found.groupBy("host", "path").agg(F.min("first").alias("first"))
    return settled(best.select("host", "path", F.struct("first.rule", "first.verdict").alias("by")), "ruled")


def _ruled(rows: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """``rows`` with ``by``, rule and verdict of the first of ``rules`` that fits their ``host`` and ``path``, or null."""
    if len(rules) <= EXPRESSION_RULES:
        return rows.withColumn("by", rule_for(F.col("host"), F.col("path"), rules))
    rows = settled(rows, "unruled")
    counts, total = _grouped(rows, ["host", "path"])
    told = settled(counts.join(rules_by_join(counts, rules), ["host", "path"]), "told")
    return join_groups(rows, told, ["host", "path"], "n", total, "left").drop("n")


def filter_urls(
    pages: DataFrame,
    rules: list[UrlRule],
    redirects: DataFrame | None = None,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row for each page: ``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``component``.

    A page that a rule fits has that rule's verdict.  Any other takes the verdict of its aliases: urls are joined
    by redirects (``redirects(source, target)``, and a refresh in the page), by the canonical link in the page and
    by their own canonical form, and connected components of those edges share decisions.  If a rule allows any
    url of the component, the page is allowed; else if a rule blocks one, it is blocked; else it gets ``default``.
    ``component`` is the smallest url of the component, null for a page without aliases.

    A null url, or one without ``://``, has an empty host and path and no aliases; null html has no links.
    Repeated rows are judged each; an empty table gives an empty result; extra columns are not read.  Urls and html of
    any length are read whole, and there may be any number of rules.
    """
    rules = _in_order(rules)
    url = F.col(url_col)
    judged = pages.select(
        F.col(id_col).alias("key"), F.coalesce(url_host(url), F.lit("")).alias("host"), F.coalesce(url_path(url), F.lit("")).alias("path"),
        plain_url(F.coalesce(url, F.lit(""))).alias("node"), canonical_url(F.coalesce(url, F.lit(""))).alias("canonical"),
        F.transform(page_links(url, F.col(html_col)),
                    lambda to: F.struct(plain_url(to).alias("node"), canonical_url(to).alias("canonical"))).alias("links"),
    )
    judged = settled(_ruled(judged, rules), "urls")
    # Rules are read off urls as they are given, so those stay nodes beside their canonical forms.
    links = judged.select("canonical", F.explode("links").alias("to"))
    edges = judged.filter("node != canonical").select(F.col("node").alias("a"), F.col("canonical").alias("b"))
    edges = edges.unionByName(links.select(F.col("canonical").alias("a"), F.col("to.canonical").alias("b")))
    edges = edges.unionByName(links.select(F.col("to.node").alias("a"), F.col("to.canonical").alias("b")))
    if redirects is not None:
        for side in ("source", "target"):
            edges = edges.unionByName(redirects.select(plain_url(F.col(side)).alias("a"), canonical_url(F.col(side)).alias("b")))
        edges = edges.unionByName(
            redirects.select(canonical_url(F.col("source")).alias("a"), canonical_url(F.col("target")).alias("b"))
        )
    members = settled(connected_components(edges.filter("a != '' AND b != ''")), "components")
    # A node is an url without its scheme, so its own host and path tell which rule fits it.
    at = F.concat(F.lit("x://"), F.col("node"))
    placed = members.select("component", url_host(at).alias("host"), url_path(at).alias("path"))
    ruled = _ruled(placed, rules).select("component", F.col("by.verdict").alias("said"))
    opinions = ruled.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"),
        F.when(F.max(F.col("said") == "allow"), "allow").when(F.max(F.col("said") == "block"), "block").alias("shared"),
    )
    told = join_groups(members, settled(opinions, "opinions"), ["component"], "size", members.count()).drop("size")
    asked = judged.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    told = settled(asked.join(told, "node"), "decisions")
    found = join_groups(judged, told, ["node"], "n", judged.count(), "left")
    return found.select(
        F.col("key").alias(id_col), "host", "path", F.col("by.rule").alias("rule"),
        F.coalesce(F.col("by.verdict"), F.col("shared"), F.lit(default)).alias("verdict"), "component",
    )
