"""URL rules, classes of aliases and odd urls, against a brute-force version."""

import random
import re

from pyspark.sql import functions as F

from millrace.llm import queries, url_blocks
from millrace.sources.tables import table

SCHEMA = "page_id long, url string, html string, host string, verdict int, node string"
RULES = [(*r,) for r in queries.URL_RULES]


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (m[1].translate(lower), m[2]) if m else ("", "")


def rule_for(url, rules):
    host, path = split(url)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def plain(url):
    host, path = split(url)
    return re.sub(r"^(www|m)\.(?=[^.]+\.)", "", host) + re.sub(r"(/index)?(\.html?)?/*$", "", path)


def brute(pages, rules, edges):
    edges = [(a, b) for a, b in edges if a and b and "://" in a]
    urls = {u for _, u in pages if u and "://" in u} | {u for e in edges for u in e}
    root = {plain(u): plain(u) for u in urls}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(plain(a))] = find(plain(b))
    held = {}
    for u in urls:
        if r := rule_for(u, rules):
            held.setdefault(find(plain(u)), set()).add(r[2])
    out = []
    for page, u in pages:
        r = rule_for(u, rules)
        verdict = r[2] if r else "allow"
        if not r and u and "://" in u and held.get(find(plain(u))) == {"block"}:
            verdict = "block"
        out.append((page, *split(u), r[0] + r[1] if r else None, verdict))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    pages = [(r.page_id, r.url) for r in table(spark, sf_dir, "pages").collect()]
    assert result(queries.op7_url_blocks(spark, sf_dir)) == brute(pages, RULES, [])


def test_links_redirects_and_odd_urls(spark):
    link = '<html><LINK href="{}" rel="canonical">'
    refresh = "<meta http-equiv=refresh content='0; url={}'>"
    rng = random.Random(4)
    hosts = ["a.net", "b.net", "www.a.net", "m.c.example.org", "x.com", "COM", "com", "notcom", "examplE.org", "org"]
    paths = ["", "/", "/de/1", "/fr/1", "/fr/1.html", "/en/12", "/en/2/", "/es/", "/q?x=://y", "#a://b", "/index.html"]
    pages, edges = [], []
    for i in range(300):
        url = f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '/' + str(rng.randrange(40))])}"
        target = f"https://{rng.choice(hosts)}{rng.choice(paths)}"
        html = rng.choice([None, "", "<p>", link.format(target), refresh.format(target)])
        pages.append((i, url, html))
        if html and "://" in html:
            edges.append((url, target))
    log = [("http://a.net/x", "http://y.com/de/9"), ("http://a.net/x", None), (None, "http://z.net/"), ("http://b.net/1", "http://a.net/x")]
    pages += [(900, None, None), (901, "", None), (902, "no scheme/de/", None), (903, "http://", None), (904, "http://a.net/x", None)]
    pages += [(905, "HTTP://B.net/1/?u=" + "z" * 50_000, "<p>" * 50_000), (905, "HTTP://B.net/1/", None), (None, "://x.com/de/", None)]
    df = spark.createDataFrame([(*p, "h", 1, "n") for p in pages], SCHEMA)
    got = url_blocks.judged(df, url_blocks.rule_table(spark, RULES), spark.createDataFrame(log, "url string, target string"))
    assert result(got) == brute([p[:2] for p in pages], RULES, edges + log)
    assert {r[0]: r[4] for r in result(got)}[904] == "block"


def test_empty_tables(spark):
    rules = url_blocks.rule_table(spark, RULES)
    assert url_blocks.judged(spark.createDataFrame([], SCHEMA), rules).count() == 0
    one = spark.createDataFrame([(1, "http://x.com/de/", None, "", 1, "")], SCHEMA)
    assert result(url_blocks.judged(one, rules.limit(0))) == [(1, "x.com", "/de/", None, "allow")]


def test_all_links_of_a_page_and_relative_ones(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    both = link.format("http://a.net/other") + refresh.format("http://x.com/de/1")
    pages = [
        (1, "http://a.net/both", both),
        (2, "http://x.com/q/old", link.format("/de/2")),
        (3, "http://b.net/scheme", refresh.format("//x.com/de/3")),
        (4, "http://x.com/q/r/up", refresh.format("../../de/4?u=1")),
        (5, "http://x.com/de/5", link.format("../fr/5")),
        (6, "http://c.net/mail", link.format("mailto:x@x.com/de/")),
        (7, "no scheme", link.format("/de/7")),
        (8, "http://x.com", refresh.format("de/8")),
        (9, "http://a.net/two", link.format("http://a.net/nine") + link.format("http://x.com/de/9")),
    ]
    df = spark.createDataFrame([(*p, "h", 1, "n") for p in pages], SCHEMA)
    got = {r[0]: r[4] for r in result(url_blocks.judged(df, url_blocks.rule_table(spark, RULES)))}
    blocked = {1, 2, 3, 4, 5, 8, 9}
    assert got == {i: "block" if i in blocked else "allow" for i in range(1, 10)}
    seen = df.where("page_id in (4, 5, 8)").withColumn("t", F.explode(url_blocks.link_targets(F.col("html"))))
    seen = seen.select("page_id", url_blocks.resolved(F.col("url"), F.col("t")).alias("t"))
    assert {r.page_id: r.t for r in seen.collect()} == {4: "http://x.com/de/4?u=1", 5: "http://x.com/fr/5", 8: "http://x.com/de/8"}
