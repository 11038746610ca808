import itertools
import re

import pandas as pd

from riskweave.llm import queries, url_filter as U

SF = "/root/testdata/sf0.01"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path, rules):
    fits = [(len(h) + len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD = [None, "", "no scheme", "http://", "http://NET/fr/x", "HTTP://A.Net?x=/es/", "a://b://c.com/x", "http://example.com/en/", "http://x.www.example.com/en/a#f",
       "http://notexample.com/en/", "http://net", "http://ÄB.net/es/", "http://com\n.net/fr/y"]


def test_rules_equal_plain_python(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    rows = [*zip(pages.page_id.tolist(), pages.url), *((10_000 + i, u) for i, u in enumerate(ODD)), (None, "http://a.com/"), (1, "http://x.org/a"), (1, "http://x.org/a")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = sorted((tuple(r) for r in U.judge(df, none, queries.URL_RULES).collect()), key=str)
    want = []
    for page, url in rows:
        host, path = split(url)
        found, verdict = rule(host, path, queries.URL_RULES)
        want.append((page, host, path, found, verdict or "allow"))
    assert got == sorted(want, key=str)
    assert U.judge(df.limit(0), none, queries.URL_RULES).collect() == []


def tokens(url):
    host, path = split(url)
    return {"host=" + x for x in host.split(".") if x} | {"path=" + re.sub(r"\d+", "9", x) for x in re.split(r"[/._-]+", path.lower()) if x}


def test_mined_combinations_equal_brute_force(spark):
    """Bad is ads on org; either alone is not."""
    rows = [(i, f"http://{a}.example.{b}/{c}/{i}") for i, (a, b, c, _) in enumerate(itertools.product(["ads", "news"], ["org", "net"], ["en", "fr"], range(10)))]
    bad = {i for i, u in rows if ".org/" in u and "//ads." in u and i % 10}
    labels = spark.createDataFrame([(i, i in bad) for i, _ in rows] + [(None, True), (3, None)], "page_id long, bad boolean")
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {tuple(r.antecedent): round(r.confidence, 9) for r in U.mine(df, labels, min_support=0.05, min_pages=4, min_confidence=0.6).collect()}
    items = sorted(set().union(*(tokens(u) for _, u in rows)))
    sure = {}
    for k in range(1, 6):
        for combo in itertools.combinations(items, k):
            held = [i for i, u in rows if set(combo) <= tokens(u)]
            hit = sum(i in bad for i in held)
            if held and hit >= max(0.05 * len(rows), 4) and hit / len(held) >= 0.6:
                sure[combo] = hit / len(held)
    assert got == {c: round(s, 9) for c, s in sure.items() if not any(set(d) < set(c) and sure[d] >= s for d in sure)}
    assert ("host=ads", "host=org") in got
    out = {r.page_id: r.verdict for r in U.judge(df, labels, [("allow", "net", "/")], min_support=0.05, min_pages=4, min_confidence=0.6).collect()}
    assert out == {i: "block" if "//ads." in u and ".org/" in u else "allow" for i, u in rows}


def test_default_support_finds_hosts_of_a_thousandth_of_the_pages(spark):
    """Three bad hosts of 30 pages each among 30,000; one bad name has many hosts that share a word."""
    from pyspark.sql import functions as F

    i = F.col("id")
    url = (F.when((i % 1000 == 1), F.format_string("http://casino-win%d.com/p/%d", i, i))
           .when(i % 1000 == 2, F.format_string("http://ads.track.net/p/%d", i))
           .when(i % 1000 == 3, F.format_string("http://free-bets.org/p/%d", i))
           .otherwise(F.format_string("http://site%d.%s/p/%d", i % 97, F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), (i % 3 + 1).cast("int")), i)))
    pages = spark.range(30_000).select(i.alias("page_id"), url.alias("url"))
    labels = spark.range(30_000).select(i.alias("page_id"), (i % 1000).isin(1, 2, 3).alias("bad"))
    out = U.judge(pages, labels, []).where("verdict = 'block'").select("page_id").collect()
    assert {r.page_id for r in out} == {k for k in range(30_000) if k % 1000 in (1, 2, 3)}


def test_support_is_not_rounded_up_past_the_wanted_pages(spark):
    """20 / n * n is above 20 for this n."""
    n = next(k for k in range(60, 500) if 20 / k * k > 20)
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 20 else 'good'}.com/{i}") for i in range(n)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 20) for i in range(n)], "page_id long, bad boolean")
    assert ["host=bad"] in [r.antecedent for r in U.mine(pages, labels).collect()]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    plan = U.judge(df, spark.createDataFrame([], "page_id long, bad boolean"), queries.URL_RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
