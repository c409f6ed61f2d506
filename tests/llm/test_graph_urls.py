"""Connected components and the URL filter."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from keysift.llm import graph, shared, urls
from keysift.llm.graph import connected_components
from keysift.llm.urls import UrlRule, filter_urls, page_links

RULES = [UrlRule("allow", "com"), UrlRule("block", "bad.com", "/x/"), UrlRule("block", "net", "/es/"), UrlRule("allow", "ok.net", "/es/")]
PAGES = "page_id long, url string, html string, node int"


def brute(edges):
    up = {}

    def root(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {a: root(a) for a in list(up)}


def test_components(spark):
    draw = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(2000, i) for i in range(2001, 2400)]
    loose = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(140)]
    edges = [*chain, *star, *loose, (5000, 5000), (None, 1), (1, None), *loose[:20]]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["component"] for r in found} == brute(edges)


def test_rounds_are_dealt_to_few_tasks(spark, monkeypatch):
    """However many partitions the session shuffles to, a round over few edges is no more tasks than cores are worth."""
    options = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in options}
    parts = []

    def counted(df, label):
        parts.append((label, df.rdd.getNumPartitions()))
        return shared.settled(df, label)

    monkeypatch.setattr(graph, "settled", counted)
    try:
        for key, value in options.items():
            spark.conf.set(key, value)
        edges = [(i, i + 1) for i in range(40)]
        found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert {r["node"]: r["component"] for r in found} == brute(edges)
    assert len(parts) > 2 and max(n for _, n in parts[1:]) <= 4 * spark.sparkContext.defaultParallelism


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_join_alike(spark, monkeypatch):
    """Broadcast and shuffled keys give the rows of a plain join."""
    rows = spark.range(500).selectExpr("id", "if(id % 3 = 0, 1, id) AS key")
    groups = rows.groupBy("key").count().withColumnRenamed("count", "size")
    plain = sorted(map(tuple, rows.join(groups, "key").select("id", "size").collect()))
    for share in (1, 4, 1000):
        monkeypatch.setattr(shared, "HOT_SHARE", share)
        joined = shared.join_groups(rows, groups, ["key"], "size", 500)
        assert sorted(map(tuple, joined.select("id", "size").collect())) == plain


def judged(spark, pages, redirects=None):
    pages = spark.createDataFrame(pages, PAGES)
    moved = spark.createDataFrame(redirects, "source string, target string") if redirects else None
    return {r["page_id"]: r for r in filter_urls(pages, RULES, moved).collect()}


def test_rules(spark):
    found = judged(spark, [
        (1, "HTTP://A.Bad.COM/x/1?q#f", None, 1), (2, "http://bad.com/y", "", 1), (3, "http://notbad.com/x/", None, 1),
        (4, "http://ok.net/es/1", None, 1), (5, "http://w.net/es/1", None, 1), (6, "http://w.net/en", None, 1),
        (7, None, None, 1), (8, "no scheme/x", None, None), (9, "http://com?x", None, 1), (10, "x://y://z.net/es/", None, 1),
    ])
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in found.items()} == {
        1: ("a.bad.com", "/x/1", "bad.com/x/", "block"), 2: ("bad.com", "/y", "com/", "allow"),
        3: ("notbad.com", "/x/", "com/", "allow"), 4: ("ok.net", "/es/1", "ok.net/es/", "allow"),
        5: ("w.net", "/es/1", "net/es/", "block"), 6: ("w.net", "/en", None, "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("com", "", None, "allow"), 10: ("y:", "//z.net/es/", None, "allow"),
    }


def test_decisions_reach_aliases(spark):
    found = judged(
        spark,
        [
            (1, "http://a.org/x", None, 0),  # redirected to 2's page with a tracking parameter
            (2, "https://b.org/y/#top", '<LINK REL=canonical href="//c.net/es/z">', 0),  # names a blocked page
            (3, "http://b.org/y?utm_source=feed", "", 0),  # one canonical form with 2
            (4, "http://d.org/", "<meta http-equiv='refresh' content='0; URL=http://e.net/es/'>", 0),
            (5, "http://d.org", '<link rel="canonical" href="http://fine.com/">', 0),  # an allowed alias outranks it
            (6, "http://e.net/es/", None, 0),  # its own rule stays
            (7, "http://g.org/", '<link rel="canonical" href="/h">', 0),
            (7, "http://g.org/", '<link rel="canonical" href="/h">', 0),
        ],
        [("http://a.org/x", "http://b.org/y?utm_medium=z"), (None, "http://q.org/")],
    )
    assert {k: r["verdict"] for k, r in found.items()} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow"
    }
    assert found[1]["component"] == "a.org/x" and found[7]["component"] == "g.org/"


def test_empty_pages(spark):
    assert filter_urls(spark.createDataFrame([], PAGES), RULES).count() == 0


def test_page_links(spark):
    """Relative targets, entities, several values of rel, and all tags of a page."""
    base = "http://a.org/x/y?q=1#f"
    cases = [
        ("page2.html", "http://a.org/x/page2.html"), ("../a", "http://a.org/a"), ("../../../a/./b/..", "http://a.org/a/"),
        ("?x=1&amp;y=2", "http://a.org/x/y?x=1&y=2"), ("#g", "http://a.org/x/y?q=1#g"), ("/go?to=http://b.net", "http://a.org/go?to=http://b.net"),
        ("//c.net/z", "http://c.net/z"), ("https://d.org/?a&amp;b", "https://d.org/?a&b"), ("mailto:me@x.org", None),
    ]
    rows = [(i, base, f'<link rel="nofollow canonical" href="{target}">') for i, (target, _) in enumerate(cases)]
    rows.append((100, base, """<link rel=icon href=i><LINK href='1' rel='canonical'><link rel=canonical href=2>
        <meta http-equiv=refresh content="5"><meta http-equiv="refresh" content="0; url=3"><meta http-equiv=refresh content="0;url='/4'">"""))
    rows += [(101, "http://a.org", "<link rel=canonical href=b>"), (102, None, "<link rel=canonical href=b>"), (103, base, None)]
    pages = spark.createDataFrame(rows, "id int, url string, html string")
    found = {r["id"]: r["links"] for r in pages.select("id", page_links(F.col("url"), F.col("html")).alias("links")).collect()}
    assert [found[i] for i in range(len(cases))] == [[want] if want else [] for _, want in cases]
    assert found[100] == [f"http://a.org/x/{i}" for i in (1, 2, 3)] + ["http://a.org/4"]
    assert (found[101], found[102], found[103]) == (["http://a.org/b"], [], [])


def test_many_rules(spark):
    """Rules as a table decide as one after the other do, whatever shares of urls and rules one host has."""
    draw = random.Random(9)
    names = ["com", "a.com", "b.a.com", "net", "x.net", "", "c.b.a.com", "org."]
    paths = ["/", "/x", "/x/", "/x/y/z", "", "/é/"]
    rules = [urls.UrlRule(draw.choice(["allow", "block"]), draw.choice(names), draw.choice(paths)) for _ in range(60)]
    rules += [urls.UrlRule("block", "com", f"/many/{i}/") for i in range(700)] + [urls.UrlRule("block", "bad.io")]
    hosts = [*names, "d.c.b.a.com", "acom", "www.com", "com.net", "q.org", "q.org.", "..", "A.com"]
    pages = [
        (i, f"http://{draw.choice(hosts)}{draw.choice([*paths, '/many/5/q', '/many/699/', '/x/y', '/é/1'])}{draw.choice(['', '?q', '#f'])}", None, 0)
        for i in range(500)
    ]
    pages += [(500 + i, "http://www.com/x/", '<link rel=canonical href="//net/x/y/z">', 0) for i in range(300)]
    pages += [(1000, None, None, 0), (1001, "none", None, 0), (1002, "http://plain.io/", '<link rel=canonical href="//w.bad.io/1">', 0)]
    table = spark.createDataFrame(pages, PAGES)

    def judge(row):
        rest = (row["url"] or "").partition("://")[2].split("?")[0].split("#")[0]
        host, _, path = rest.partition("/")
        host, path = host.lower(), "/" + path if "/" in rest else ""
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = min(fit, key=lambda r: (-len(str(r)), r.verdict != "allow", str(r)), default=None)
        return best and (str(best), best.verdict)

    found = {r["page_id"]: r for r in filter_urls(table, rules).collect()}
    assert len(found) == len(pages)
    for row in table.collect():
        want, got = judge(row), found[row["page_id"]]
        assert (got["rule"], want and got["verdict"]) == (want or (None, None)), row
    assert (found[1002]["rule"], found[1002]["verdict"]) == (None, "block")
