import numpy as np
import pytest
from pyspark.sql import functions as F

from pipelake.llm import urlfilter as U
from pipelake.llm.queries import URL_RULES


def judged(spark, urls, listed=None, **options):
    listed = F.lit(False) if listed is None else listed
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    return {r.page_id: r for r in U.judge_urls(pages, URL_RULES, listed, **options).collect()}


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://A.Example.ORG/es/1?q#f", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.org", "x.org", "", None, "allow"),
        ("http://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
        ("http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("nourl", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("x\n://Ä.com#?", "Ä.com", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = judged(spark, [url])[0]
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_cascade_is_exact(spark):
    keys = [f"host{i}.net" for i in range(3000)]
    universe = spark.createDataFrame([(k, i % 7 == 0) for i, k in enumerate(keys)], "key string, listed boolean")
    levels = U.build_cascade(universe, first_bits=4.0)
    assert len(levels) > 2
    df, column = U.listed_by_cascade(universe, F.col("key"), universe)
    assert df.where(column != F.col("listed")).count() == 0


def test_parts_beyond_the_bound(spark):
    keys = [f"host{i}.net" for i in range(300)]
    universe = spark.createDataFrame([(k, i % 7 == 0) for i, k in enumerate(keys)], "key string, listed boolean")
    df, column = U.listed_by_cascade(universe.union(universe), F.col("key"), universe, max_bytes=64)
    assert df.count() == 600 and df.where(column != F.col("listed")).count() == 0
    found = judged(spark, ["http://a.net/", "http://b.net/", "http://a.net/x", None], F.col("key") == "a.net", max_bytes=64)
    assert [found[i].verdict for i in range(4)] == ["block", "allow", "block", "allow"]
    with pytest.raises(U.CascadeTooLarge):
        judged(spark, ["http://a.net/"], F.col("key") == "a.net", max_bytes=4)


def test_list_as_a_table_and_clashing_names(spark):
    listed = spark.createDataFrame([("a.net", 1), ("a.net", 2), ("unseen.net", 3), (None, 4)], "key string, listed int")
    pages = spark.createDataFrame([(1, "http://a.net/", "x"), (2, "http://b.net/", "y")], "page int, url string, `_key` string")
    pages = pages.selectExpr("*", "'z' AS _rule", "'b' AS _blocked", "'l' AS _listed_key", "'k' AS key", "'h' AS best", "7 AS listed")
    found = U.judge_urls(pages, URL_RULES, listed)
    assert found.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    assert sorted((r.page, r._key, r._rule, r.listed, r.verdict) for r in found.collect()) == [(1, "x", "z", 7, "block"), (2, "y", "z", 7, "allow")]


def test_listed_hosts_empty_lists_and_tables(spark):
    found = judged(spark, ["http://a.net/", "http://b.net/", "http://a.net/", None], F.col("key") == "a.net")
    assert [found[i].verdict for i in range(4)] == ["block", "allow", "block", "allow"]
    assert judged(spark, []) == {}
    assert isinstance(U.Level(np.zeros(2, np.uint64), 1).bits, int)
