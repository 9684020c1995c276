import random

import duckdb

from factloom.llm import queries
from factloom.llm.url_filter import judge_urls, links_of


def test_targets_are_resolved_against_the_page(spark):
    want = {
        "//a.net/x": "x://a.net/x", "/b": "x://h.org/b", "b.html": "x://h.org/d/b.html", "../b": "x://h.org/b", "./c/../e": "x://h.org/d/e",
        "../../../z": "x://h.org/z", "https://o.net/y": "https://o.net/y", "mailto:a@b": None, "#top": None,
    }
    for url, more in (("http://h.org/d/p?q=/r/", {}), ("http://h.org", {"b.html": "x://h.org/b.html"})):
        rows = [(k, url, f'<link rel="canonical" href="{to}">') for k, to in enumerate(want)]
        got = {r.dst for r in links_of(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        if not more:
            assert got == {x for x in want.values() if x}
        else:
            assert set(more.values()) <= got


def test_a_block_reaches_a_protocol_relative_alias(spark):
    pages = spark.createDataFrame([(1, "http://h.org/p", '<link rel="canonical" href="//a.net/x">')], "page_id long, url string, html string")
    assert judge_urls(pages, [("block", "net", "/")], links_of(pages)).first().verdict == "block"


def test_tags_are_read_as_attributes(spark):
    want = {
        '<link rel = "canonical" href="http://a b.net/x y">': "http://a b.net/x y", "<LINK REL='nofollow canonical' data-href='http://no.net/' HREF='http://a.net/x'>": "http://a.net/x",
        '<link href=http://a.net/q rel=canonical>': "http://a.net/q", '<link rel="canonicals" href="http://no.net/">': None,
        "<meta http-equiv=Refresh content='3; URL=http://a.net/r'>": "http://a.net/r", '<meta name="x" http-equiv="refresh" content="0;url=q.html">': "x://h.org/d/q.html", "<meta http-equiv='refresh' content='5'>": None,
    }
    rows = [(k, f"http://h.org/d/p?{k}", f"<p>{tag}</p>") for k, tag in enumerate(want)]
    got = {int(r.src.split("?")[1]): r.dst for r in links_of(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: to for k, to in enumerate(want.values()) if to}


def test_hosts_with_spaces_nulls_and_long_pages(spark):
    link = '<link rel="canonical" href="http://x y.net/p">'
    rows = [(1, "http://ok.org/a", link), (2, "http://x y.net/p", None), (None, "http://ok.org/b", "x" * 300_000 + link), (3, None, link), (4, "none", link)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = [("block", "x y.net", "/")]
    assert {(r.page_id, r.host, r.verdict) for r in judge_urls(pages, rules, links_of(pages)).collect()} == {(1, "ok.org", "block"), (2, "x y.net", "block"), (None, "ok.org", "block"), (3, "", "allow"), (4, "", "allow")}


def test_base_and_entities(spark):
    want = {
        '<base href="http://a.net/d/e"><link rel=canonical href="x.html">': "x://a.net/d/x.html", '<base target=_top><base href="/q/r"><link rel=canonical href="x">': "x://h.org/q/x", '<base href="mailto:a"><link rel=canonical href="x">': "x://h.org/d/x",
        '<base href=""><link rel=canonical href="/y">': "x://h.org/y", '<link rel=canonical href="http://a.net/p&amp;q">': "http://a.net/p&q", '<link rel=canonical href=" http://a.net/s&#x2F;t ">': "http://a.net/s/t", '<base href="//b.net"><link rel=canonical href="x/y">': "x://b.net/x/y",
    }
    rows = [(k, f"http://h.org/d/p?{k}", tag) for k, tag in enumerate(want)]
    got = {int(r.src.split("?")[1]): r.dst for r in links_of(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(want.values()))


def test_the_sql_says_the_same_over_planted_links(spark, tmp_path):
    rng = random.Random(7)
    hosts = ["h.org", "bad.net", "example.net", "www.example.com", "ok.io", "X.Net"]
    aims = ["//bad.net/x", "../e/z.html", "z.html", "/fr/a", "http://bad.net/p&amp;q", "http://example.net/en/1", "./a/../b", "#top", "mailto:a@b", "?q=1", "", "https://ok.io/y?z#f", "../../../up", "d/..", "http://www.example.com/de/k"]
    bases = ["", "", "", '<base href="http://bad.net/in/side">', '<base href="/other/">', "<base target=x>", '<base href="sub/">']
    rows = [(1, None, None), (2, "no scheme", '<link rel=canonical href="http://bad.net/">'), (3, "http://a.org", None), (None, "http://ok.io/y", None), (4, "http://ok.io/y", None), (4, "http://ok.io/y", None), (5, "http://bad.net/x", "")]
    for k in range(120):
        to = rng.choice(aims)
        tag = f'<link rel="canonical" href="{to}">' if rng.random() < 0.6 else f"<meta http-equiv='refresh' content='0; url={to}'>"
        rows.append((10 + k, f"http://{rng.choice(hosts)}/{rng.choice(['', 'fr/', 'de/', 'en/', 'd/e/'])}{rng.randrange(60)}", f"<p>{rng.choice(bases)}{tag}</p>"))
    rows += [(900 + k, f"http://many.io/{k}", '<link rel=canonical href="http://many.io/hub">') for k in range(80)] + [(990, "http://many.io/hub", '<link rel=canonical href="//bad.net/hub">')]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    want = c.sql(f"SELECT {', '.join(names)} FROM ({queries.SQL['op9_url_filter']})").fetchall()
    got = [tuple(r) for r in queries.op9_url_filter(spark, str(tmp_path)).select(names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == len(rows)
    assert all(r[4] == "block" for r in got if r[1] == "many.io") and {r[4] for r in got if r[1] == "ok.io"} == {"allow", "block"}
