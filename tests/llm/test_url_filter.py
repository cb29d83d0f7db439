"""URL rules and the Bloom filter cascade against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from opinara.llm import queries, url_filter
from opinara.llm.queries import RULES

URLS = [
    "http://A.Example.org/en/1?x#y", "https://example.org/es/", "https://notexample.org/es/", "http://x.com", "http://x.com/fr", "http://x.com/fr/a/b",
    "http://com/de/", "x.org/y", "", None, "http:///path", "http://user@Q.net:80/p?://z", "http://m.ads-track.example.com/en/1", "ftp://free-bets.example.net#f",
    "http://x.com?/fr/", "http://É.org/ß", "//a.org/b", "a://b://c/d", "http://ads-track.example.com.evil.net/", "http://listed.net/page", "http://listed.net/page2",
]


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def verdict_by_hand(host, path, listed):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.text))
        return best.text, best.verdict
    labels = host.split(".") if host else []
    keys = {".".join(labels[i:]) for i in range(len(labels))} | ({host + path} if host and path.startswith("/") else set())
    return None, "block" if keys & set(listed) else "allow"


def test_judge(spark):
    listed = [*queries.LISTED, "listed.net/page", "not-in-the-corpus.net"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(0, URLS[0], "", ""), (None, URLS[1], "", "")], "page_id long, url string, host string, keys string")
    out = url_filter.judge(pages, RULES, spark.createDataFrame([(k,) for k in [*listed, None, listed[0]]], "key string")).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        url = URLS[1 if r.id is None else r.id]
        host, path = parts_by_hand(url)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *verdict_by_hand(host, path, listed)), url


@pytest.mark.parametrize("n", [0, 1, 700])
def test_cascade_is_exact_on_its_universe(spark, n):
    rng = random.Random(n)
    keys = [f"host{rng.random()}.net" for _ in range(3000)]
    universe = spark.createDataFrame([(k, i < n) for i, k in enumerate(keys)], "key string, listed boolean")
    cascade = url_filter.build_cascade(universe)
    assert cascade.member([k.encode() for k in keys]).tolist() == [i < n for i in range(len(keys))]
    assert n == 0 or len(cascade.levels) > 1


def test_size_is_checked(spark):
    universe = spark.range(5000).select(F.col("id").cast("string").alias("key"), F.lit(True).alias("listed"))
    with pytest.raises(ValueError):
        url_filter.build_cascade(universe, max_megabytes=0)


def test_a_long_list_is_taken_in_parts(spark):
    """More keys than the filters of one part hold: the same exact verdicts, part after part."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".net/")).alias("url"))
    listed = spark.range(0, 3000, 3).select(F.concat(F.lit("h"), F.col("id"), F.lit(".net")).alias("key"))
    out = url_filter.judge(pages, [], listed, max_megabytes=0.0008).collect()
    assert {(r.id, r.verdict) for r in out} == {(i, "allow" if i % 3 else "block") for i in range(3000)} and len(out) == 3000


def test_empty(spark):
    nothing = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(nothing, RULES, spark.createDataFrame([], "key string")).count() == 0


def test_query(spark, write_tables):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    out = queries.op9_url_cascade(spark, write_tables(pages=pages)).collect()
    for r in out:
        host, path = parts_by_hand(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *verdict_by_hand(host, path, queries.LISTED))
