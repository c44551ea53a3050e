"""URL rules: the query's rules by hand, links by hand, groups against a plain search."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from lakesync.llm import url_rules as u

HTML = "<html><head>%s</head><body>text</body></html>"


def verdicts(spark, pages, rules=u.RULES, links=None):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r["page_id"]: r for r in u.judge_pages(frame, u.rule_table(spark, rules), links).collect()}


def test_rules_hosts_and_paths(spark):
    urls = [
        (1, "http://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        (2, "https://blog.example.org/en/12#x", "blog.example.org", "/en/12", "example.org/en/1", "block"),
        (3, "https://blog.example.org/en/2?a=http://x.com/de/", "blog.example.org", "/en/2", "org/", "allow"),
        (4, "http://org", "org", "", None, "allow"),
        (5, "http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        (6, "http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        (7, "http://a.com/DE/1", "a.com", "/DE/1", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "no scheme/es/", "", "", None, "allow"),
        (10, "", "", "", None, "allow"),
        (11, "http://a.net/de/", "a.net", "/de/", None, "allow"),
        (12, "HTTP://A.COM:80/de/", "a.com:80", "/de/", None, "allow"),
        (13, "http://ÄÖ.com/fr/é", "ÄÖ.com", "/fr/é", "com/fr/", "allow"),
        (14, "x://y://a.com/de/", "y:", "//a.com/de/", None, "allow"),
        (1, "http://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"),
    ]
    got = verdicts(spark, [(k, url, None) for k, url, *_ in urls])
    for k, _, *want in urls:
        assert [got[k][c] for c in ("host", "path", "rule", "verdict")] == want, k


def test_ties_go_to_allow(spark):
    rules = [("block", "b.c/x"), ("allow", "c/xyz"), ("allow", "c/"), ("block", "c/")]
    got = verdicts(spark, [(1, "http://b.c/xyz", None), (2, "http://q.c/", None)], rules)
    assert got[1]["verdict"] == "allow" and got[2]["verdict"] == "allow"


def test_links_carry_blocks_and_allow_goes_first(spark):
    canonical = HTML % "<LINK rel='x Canonical' href=\"%s\">"
    refresh = HTML % "<meta http-equiv=refresh content=\"0; URL='%s'\">"
    pages = [
        (1, "http://a.net/1", canonical % "https://a.com/de/9"),          # blocked address that is no page
        (2, "http://a.net/2?q=1", refresh % "/1"),                        # relative, one step further
        (3, "http://a.net/dir/3", refresh % "../1x"),                     # unknown address
        (4, "http://b.net/1", canonical % "http://a.com/de/8"),
        (5, "http://b.net/2", canonical % "http://b.net/1"),
        (6, "http://c.org/6", canonical % "http://b.net/2#top"),          # explicitly allowed, so is its group
        (7, "http://d.net/7", HTML % "<!-- <link rel=canonical href='http://a.com/de/9'> -->"),
        (8, "http://d.net/8", HTML % "<script>'<link rel=canonical href=\"http://a.com/de/9\">'</script>"),
        (9, "http://d.net/9", HTML % "<link rel=icon href='http://a.com/de/9'><meta name=refresh content='0;url=http://a.com/de/9'>"),
        (10, "http://a.com/de/8", None),                                  # its own rule stays
        (11, "HTTP://A.net/1#frag", None),                                # the address of page 1
        (12, "http://d.net/12", canonical % ""),
        (13, "http://a.net/x/y/13?z", canonical % "14"),
        (14, "http://a.net/x/y/14", canonical % "//a.com/de/&amp;"),
    ]
    got = {k: r["verdict"] for k, r in verdicts(spark, pages).items()}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 10, 11, 13, 14}


def test_groups_equal_a_plain_search(spark):
    rng = random.Random(5)
    nodes = [f"http://h{k}.{rng.choice(['net', 'net', 'net', 'org', 'com'])}/{rng.choice(['de', 'fr', 'x'])}/{k}" for k in range(150)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(90)] + [(nodes[0], n) for n in nodes[1:40]]  # a hub
    frame = spark.createDataFrame(edges, "a string, b string")
    got = verdicts(spark, [(k, n, None) for k, n in enumerate(nodes)], links=frame)
    near = {n: {n} for n in nodes}
    for a, b in edges:
        merged = near[a] | near[b]
        for n in merged:
            near[n] = merged
    own = lambda n: "allow" if ".org/" in n or ".com/fr/" in n else "block" if ".com/de/" in n else None
    for k, n in enumerate(nodes):
        said = {own(m) for m in near[n]}
        assert got[k]["verdict"] == (own(n) or ("allow" if "allow" in said else "block" if "block" in said else "allow"))


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables_and_clashing_columns(spark, n):
    frame = spark.createDataFrame([(1, "http://a.com/de/", "<p>", "x", "y", "z", "w")][:n],
                                  "page_id long, url string, html string, host string, address string, rule string, own string")
    got = u.judge_pages(frame, u.rule_table(spark, u.RULES))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and [r["verdict"] for r in got.collect()] == ["block"] * n


def test_stays_in_the_jvm(spark):
    plan = u.op12_url_rules(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_long_page(spark):
    page = HTML % ("<link rel=stylesheet " * 50_000 + "<link rel=canonical href=http://a.com/de/1>" + "<!-- " * 50_000)
    got = verdicts(spark, [(1, "http://a.net/1", page), (2, "http://a.net/2", "x" * 3_000_000)])
    assert got[1]["verdict"] == "block" and got[2]["verdict"] == "allow"
