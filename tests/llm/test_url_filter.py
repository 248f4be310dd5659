"""Rules, links and ranks of hosts."""

import pytest
from pyspark.sql import functions as F

from jobquarry.llm import url_filter as uf


def test_hosts_paths_and_rules(spark):
    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/10": ("example.org", "/en/10", "example.org/en/1", "block"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://org": ("org", "", None, "allow"),
        "http://h.com/fr/#a": ("h.com", "/fr/", "com/fr/", "allow"),
        "http://h.com?/de/": ("h.com", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "no scheme/x": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(cases)], "page_id int, url string, html string, host string")
    rows = {r.page_id: r for r in uf.judged(pages).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    assert [tuple(rows[i])[1:] for i in range(len(cases))] == list(cases.values())
    assert uf.judged(pages.limit(0)).count() == 0


def test_ranks_equal_a_plain_walk(spark):
    links = [("a", "b", 3), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "a", 2), ("c", "e", 2)]
    edges = spark.createDataFrame(links, "src string, dst string, weight long")
    seeds = spark.createDataFrame([("a", 0.75), ("d", 0.25)], "host string, seed double")
    rank = {"a": 0.75, "d": 0.25}
    for _ in range(uf.ROUNDS):
        new = {}
        for s, d, w in links:
            total = sum(x for a, _, x in links if a == s)
            new[d] = new.get(d, 0) + 0.85 * rank.get(s, 0) * w / total
        # What did not move, that of "e" without links too, is back at the seeds.
        back = 1 - sum(new.values())
        rank = {h: new.get(h, 0) + back * {"a": 0.75, "d": 0.25}.get(h, 0) for h in {*new, "a", "d"}}
    got = {r.host: r["rank"] for r in uf.page_rank(edges, seeds).collect()}
    assert got == pytest.approx({k: v for k, v in rank.items()})
    assert sum(got.values()) == pytest.approx(1)


def test_hosts_below_one_domain_belong_together(spark):
    """The parent was not crawled; repeated rows and a very long page change nothing but weights."""
    pages = [
        (1, "http://one.evil.net/", "x" * 300_000 + "<a href='http://bad.com/de/1'>x</a>"),
        (2, "http://bad.com/de/1", ""), (2, "http://bad.com/de/1", ""),
        (3, "http://two.evil.net/", None), (4, "http://three.fine.net/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    edges = {(r.src, r.dst): r.weight for r in uf.host_edges(df).collect()}
    assert edges == {
        ("one.evil.net", "bad.com"): 1, ("one.evil.net", "evil.net"): 1, ("evil.net", "one.evil.net"): 1, ("two.evil.net", "evil.net"): 1,
        ("evil.net", "two.evil.net"): 1, ("three.fine.net", "fine.net"): 1, ("fine.net", "three.fine.net"): 1,
    }
    got = {r.page_id: r.verdict for r in uf.judged(df).select("row.page_id", "verdict").collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_distrust_comes_back_over_links_and_trust_goes_forward(spark):
    link = lambda *urls: "".join(f"<a href='{u}'>x</a>" for u in urls)
    pages = [
        (1, "http://good.org/", link("http://friend.net/", "//friend.net/2", "/own")),
        (2, "http://bad.com/de/1", ""),
        (3, "http://farm.net/", link("http://bad.com/de/1", "https://BAD.com/de/2")),
        (4, "http://feeder.net/", link("http://farm.net/")),
        (5, "http://friend.net/", None),
        (6, "http://alone.net/", link("/x")),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {r.page_id: r.verdict for r in uf.judged(df).select("row.page_id", "verdict").collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}
    edges = {(r.src, r.dst): r.weight for r in uf.host_edges(df.select("url", F.col("html"))).collect()}
    assert edges == {("good.org", "friend.net"): 2, ("farm.net", "bad.com"): 2, ("feeder.net", "farm.net"): 1}
