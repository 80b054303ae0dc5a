import random

from cadenza.llm import url_filters
from cadenza.llm.components import components

SCHEMA = "page_id long, url string, html string"


def link(to):
    return f'<html><head><link rel="canonical" href="{to}"></head></html>'


def test_rules_and_aliases(spark):
    rows = [
        (1, "https://a.example.com/en/x", None),
        (2, "https://www.example.com/en/x", ""),
        (3, "https://a.example.org/p", link("https://b.net/fr/z")),  # alias of a blocked url
        (4, "https://a.example.org/q#top", link("/p")),  # alias of an alias
        (5, "https://c.org/", link("https://www.example.com/en/x")),  # alias of an allowed url
        (6, "https://d.org/", '<META http-equiv="Refresh" content="0; URL=https://e.net/es/1">'),
        (7, "https://e.net/es/1", link("https://shop.com/")),  # blocked itself; its group has an explicit allow
        (8, None, link("https://b.net/fr/z")),
        (9, "no scheme", link("https://b.net/fr/z")),
        (10, "HTTP://User@EXAMPLE.NET:80/es/?a#b", None),
        (11, "https://com", None),
        (3, "https://a.example.org/p", link("https://b.net/fr/z")),
        (None, "x://y.com/?://z", None),
    ]
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows, SCHEMA)).collect()]
    expected = [
        (1, "a.example.com", "/en/x", "example.com/en/", "block"),
        (2, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (3, "a.example.org", "/p", None, "block"),
        (4, "a.example.org", "/q", None, "block"),
        (5, "c.org", "/", None, "allow"),
        (6, "d.org", "/", None, "allow"),
        (7, "e.net", "/es/1", "net/es/", "block"),
        (8, "", "", None, "allow"),
        (9, "", "", None, "block"),
        (10, "user@example.net:80", "/es/", None, "allow"),
        (11, "com", "", None, "allow"),
        (3, "a.example.org", "/p", None, "block"),
        (None, "y.com", "/", "com/", "allow"),
    ]
    key = str
    assert sorted(out, key=key) == sorted(expected, key=key)


def test_empty_table_and_crawl_log(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert url_filters.judge(empty).count() == 0
    pages = spark.createDataFrame([(1, "https://a.org/", None)], SCHEMA)
    log = spark.createDataFrame([("https://A.org/#x", "https://b.net/fr/")], "u string, v string")
    assert url_filters.judge(pages, log).first().verdict == "block"


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(0, k) for k in range(500, 700)] + [(k, k + 1) for k in range(1000, 1100)] + [(None, 3), (7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_columns_named_as_the_result_are_replaced(spark):
    pages = spark.createDataFrame([(1, "http://www.net/es/x", "<p>", "mine", "my rule")], "page_id long, url string, html string, component string, rule string")
    got = url_filters.judge(pages).select("page_id", "component", "rule", "verdict").collect()
    assert [tuple(r) for r in got] == [(1, None, "net/es/", "block")]


def test_every_tag_counts_but_not_in_comments_and_scripts(spark):
    html = link("https://one.org/") + "<link rel='nofollow canonical' href='https://two.org/'><link rel=canonical>"
    html += '<meta http-equiv=refresh content="5;url=https://three.org/">' * 2
    hidden = f"<!-- {link('https://four.org/')} --><script>{link('https://five.org/')}</script>"
    pages = spark.createDataFrame([(1, "https://p.org/", html + hidden), (2, "https://q.org/", hidden)], SCHEMA)
    got = {(r.u, r.v) for r in url_filters.links(pages).collect()}
    assert got == {("https://p.org/", f"https://{x}.org/") for x in ("one", "two", "three")}


def test_components_of_a_hub_and_a_chain(spark):
    hub = spark.range(1, 60_001).selectExpr("0L AS u", "id AS v")
    chain = spark.range(100_000, 103_000).selectExpr("id AS u", "id + 1 AS v")
    got = components(hub.unionByName(chain)).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(0, 60_001), (100_000, 3_001)}


def test_decisions_reach_the_ends_of_hubs_and_chains(spark):
    """Verdicts over redirects alone: a blocked page behind a hub of 3,000 links and at the end of a chain of 400; an allowed one wins."""
    hub, chain, both = "https://hub.org/", "https://c0.org/", "https://both.org/"
    redirects = [(f"https://h{i}.org/", hub) for i in range(3000)] + [(hub, "https://x.net/es/1")]
    redirects += [(f"https://c{i}.org/", f"https://c{i + 1}.org/") for i in range(400)] + [("https://c400.org/", "https://y.net/fr/")]
    redirects += [(both, "https://z.net/es/"), (both, "https://shop.com/")]
    asked = [hub, "https://h17.org/", "https://H2999.org/#top", chain, "https://c399.org/", both, "https://z.net/es/", "https://alone.org/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(asked)], SCHEMA)
    got = url_filters.judge(pages, spark.createDataFrame(redirects, "u string, v string")).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "block", "block", "block", "block", "allow", "block", "allow"]
    assert got[6].rule == "net/es/" and got[5].rule is None
    long = "https://long.org/" + "p/" * 100_000
    pages = spark.createDataFrame([(1, long, None), (2, "https://a.net/fr/" + "q" * 100_000, None)], SCHEMA)
    assert [(r.host, len(r.path), r.verdict) for r in url_filters.judge(pages).orderBy("page_id").collect()] == [("long.org", 200_001, "allow"), ("a.net", 100_004, "block")]
