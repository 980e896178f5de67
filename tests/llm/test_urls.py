import random
import re

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import urls

URLS = [
    None, "", "no scheme", "http://", "http://Example.NET/en/x", "http://example.net/en", "https://a.example.net/en/?q", "x://example.net:80/en/", "http://notexample.com/de/1",
    "http://b.example.com/de/1", "http://b.example.com?/de/1", "http://b.example.org/fr/#a", "http://org/fr/", "http://net/", "http://net", "http://a.net?x", "a b://h/p\nq?r", "http://www.cheap-pills.example.com/en/1",
    "http://CASINO-WIN.example.org/fr/2", "http://x.casino-win.example.org/en/2", "http://É.org/fr/", "http://a://b/c",
]


def slow(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(at + under), at + under, v) for v, at, under in urls.RULES if (host == at or host.endswith("." + at)) and path.startswith(under)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if set(host.split(".")) & set(urls.LISTED_LABELS) else "allow"


def result(df):
    return [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.select("row.url", "host", "path", "rule", "verdict").collect()]


def test_urls(spark):
    frame = spark.createDataFrame([(u,) for u in URLS * 2], "url string").selectExpr("*", "1 as host", "'r' as rule", "2 as row")
    listed = urls.listed_hosts(frame)
    assert sorted(result(urls.filter_urls(frame, listed)), key=str) == sorted([(u, *slow(u)) for u in URLS * 2], key=str)
    assert urls.filter_urls(frame.limit(0), listed).collect() == []
    assert {r["verdict"] for r in urls.filter_urls(frame, listed.limit(0)).filter("rule is null").collect()} == {"allow"}


def test_query_on_real_pages(spark):
    d = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = urls.op8_url_filters(spark, d).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {i: slow(u) for i, u in pages.items()}
    assert any(r["rule"] is None and r["verdict"] == "block" for r in got)


@pytest.mark.parametrize("bits", [1.0, 4.0, 12.0])
def test_cascade_is_exact_over_its_universe(spark, bits):
    keys = spark.range(3000).select(F.concat(F.lit("host"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    levels = urls.build_cascade(keys, urls.CascadeParams(bits_per_key=bits, hashes=3))
    assert len(levels) > 1
    assert keys.filter(urls.in_cascade(F.col("key"), levels) != F.col("listed")).count() == 0


def listed_case(spark):
    """Urls over 900 hosts, and a list that no rule could guess: random hosts, some unknown, twice, null or in capitals."""
    rng = random.Random(7)
    hosts = [f"h{k}.example-{k % 13}.xyz" for k in range(900)]
    chosen = rng.sample(hosts, 300)
    pages = spark.createDataFrame([(f"http://{h}/p{k}",) for k, h in enumerate(hosts + rng.sample(hosts, 200))], "url string")
    names = [*chosen[:250], *(h.upper() for h in chosen[250:]), *chosen[:9], None, "never.seen"]
    return pages, spark.createDataFrame([(n, 1) for n in names], "name string, host long"), set(chosen)


@pytest.mark.parametrize("bits", [1 << 25, 1024])
def test_a_list_of_any_size_is_exact(spark, bits):
    """With few bits the list is parted into several cascades, and every url is still judged once."""
    pages, listed, chosen = listed_case(spark)
    got = urls.filter_urls(pages, listed, p=urls.CascadeParams(max_bits=bits)).collect()
    assert len(got) == pages.count() and all((r["verdict"] == "block") == r["listed"] == (r["host"] in chosen) for r in got)


def test_verdicts_come_from_the_cascade(spark, monkeypatch):
    pages, listed, _ = listed_case(spark)
    monkeypatch.setattr(urls, "in_cascade", lambda key, levels: F.lit(False))
    assert urls.filter_urls(pages, listed).filter("listed").count() == 0


def test_words_stand_in_no_plan(spark):
    pages, listed, _ = listed_case(spark)
    judged = urls.filter_urls(pages, listed)
    assert len(judged._jdf.queryExecution().toString()) < 200_000
    assert " Join" not in judged._jdf.queryExecution().optimizedPlan().toString()
