import math

import duckdb
import pytest

from tests.llm.helpers import clashing, rows_of
from tidewater.llm import oracle
from tidewater.llm.url_reputation import RULES, Rule, judge_urls, longest_rule, split_url


def judged(spark, urls, outcomes=(), **settings):
    pages = clashing(spark, urls, "page_id bigint, url string")
    labels = spark.createDataFrame(list(outcomes), "page_id bigint, bad int")
    return judge_urls(pages, labels, **settings)


@pytest.mark.parametrize("url, host, path, rule", [
    ("https://WWW.Example.COM/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/"),
    ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/"),
    ("http://badexample.com/en/", "badexample.com", "/en/", "com/"),
    ("http://example.com/EN/", "example.com", "/EN/", "com/"),
    ("http://example.com", "example.com", "", None),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/"),
    ("http://x.net?/fr/", "x.net", "", None),
    ("http://net/fr/a://b", "net", "/fr/a://b", "net/fr/"),
    ("example.com/en/", "", "", None),
    ("", "", "", None), (None, "", "", None),
    ("http://ÄB.Net/fr/é", "Äb.net", "/fr/é", "net/fr/"),
])
def test_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(url,)], "url string")
    h, p = split_url(df["url"])
    r = df.select(h.alias("h"), p.alias("p"), longest_rule(h, p).alias("r"))
    got = r.first()
    assert (got.h, got.p, got.r.text if got.r else None) == (host, path, rule)
    if rule:
        assert got.r.verdict == {x.text: x.verdict for x in RULES}[rule]


def test_reputation_shrinks_and_blocks(spark):
    urls, outcomes, n = [], [], 0
    for host, pages, bad in (("spam.a.org", 60, 57), ("good.a.org", 60, 1), ("new.a.org", 2, 2), ("one.b.org", 40, 0), ("two.b.org", 30, 1)):
        for k in range(pages):
            urls.append((n, f"http://{host}/p/{k}"))
            outcomes.append((n, int(k < bad)))
            n += 1
    urls += [(n, "http://spam.a.org/unlabelled"), (n + 1, None), (None, "http://spam.a.org/x"), (0, "http://spam.a.org/p/0")]
    outcomes += [(None, 1), (n, None)]
    rows = judged(spark, urls, outcomes).collect()
    verdict = {(r.host): r.verdict for r in rows}
    assert len(rows) == len(urls)
    assert verdict["spam.a.org"] == "block" and verdict["good.a.org"] == "allow" and verdict["one.b.org"] == "allow"
    rate = {r.host: r.bad_rate for r in rows}
    assert 57 / 60 > rate["spam.a.org"] > 0.8 and rate["good.a.org"] > 1 / 60 and 0 <= rate["one.b.org"] < 0.1
    assert 1 > rate["new.a.org"] > rate["good.a.org"]            # two pages say less than their domain and they do
    assert all(0 <= r.bad_lower <= r.bad_rate for r in rows if r.host)


def test_no_labels_no_pages_own_rules(spark):
    assert {r.verdict for r in judged(spark, [(1, "http://x.org/")]).collect()} == {"allow"}
    assert judged(spark, []).count() == 0
    rules = (Rule("block", "org", ""),)
    assert rows_of(judged(spark, [(1, "http://x.org"), (2, "http://x.de")], rules=rules), "page_id", "rule", "verdict") == [(1, "org", "block"), (2, None, "allow")]
    with pytest.raises(ValueError):
        longest_rule(None, None, [Rule("block", "a", "/")] * 1001)


def test_query_is_its_oracle(spark, scratch):
    urls = [(i, f"https://{'www.' * (i % 2)}h{i % 7}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'es', 'fr')[i % 4 % 3]}/{i}") for i in range(300)]
    labels = [(i, int(math.sin(i) > -0.3), int(i % 11 == 0)) for i in range(0, 300, 2)]
    from tidewater.llm.queries import QUERIES
    spark.createDataFrame(urls, "page_id bigint, url string").write.parquet(f"{scratch}/pages.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{scratch}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(oracle.OP5).fetchall(), key=repr)
    assert rows_of(QUERIES["op5_url_reputation"](spark, scratch), "page_id", "host", "path", "rule", "verdict") == want
