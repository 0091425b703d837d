"""URL rules and the filter cascade."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from quizlens.llm import url_filters
from quizlens.llm.common import Scratch

URLS = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.COM/en/x?q#f"), (5, "x://www.example.com/en/"), (6, "x://com"), (7, "x://a.com/"),
        (8, "x://b.net/es/"), (9, "x://b.net/ES/"), (10, "x://casino.org?://"), (10, "x://casino.org?://"), (11, "x://spam.org/" + "p" * 50000),
        (12, "x://notexample.com/en/"), (None, "x://É.net/fr/a\nb"), (13, "://#")]


def test_rules_and_edge_rows(spark):
    df = spark.createDataFrame(URLS, "page_id int, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("row", F.lit(1))
    out = url_filters.url_filters(df, url_filters.spam_keys, url_filters.RULES).collect()
    got = {r.row.page_id: (r.host, r.path[:9], r.rule, r.verdict) for r in out}
    assert len(out) == len(URLS) and got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("a.example.com", "/en/x", "example.com/en/", "block"),
        5: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 6: ("com", "", None, "allow"), 7: ("a.com", "/", "com/", "allow"),
        8: ("b.net", "/es/", "net/es/", "block"), 9: ("b.net", "/ES/", None, "allow"), 10: ("casino.org", "", None, "block"),
        11: ("spam.org", "/pppppppp", None, "block"), 12: ("notexample.com", "/en/", "com/", "allow"), None: ("É.net", "/fr/a\nb", "net/fr/", "block"),
        13: ("", "", None, "allow")}
    assert url_filters.url_filters(df.limit(0), url_filters.spam_keys, url_filters.RULES).count() == 0


@pytest.mark.parametrize("max_bits", [url_filters.MAX_BITS, 256])
def test_membership_is_exact(spark, max_bits):
    """Over the whole universe, with one filter and with many."""
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = spark.range(0, 3000, 19).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    c = url_filters.Cascade(listed, universe, Scratch(spark), max_bits)
    assert (c.n_shards > 1) == (max_bits == 256) and max(map(len, c.shards)) > 1
    if max_bits == 256:  # one plan per shard: two of them suffice here
        c.shards, n = c.shards[:2], c.n_shards
        for i, levels in enumerate(c.shards):
            own = universe.where(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(n)) == i).withColumn("on", c._listed(F.col("key"), levels))
            assert all(r.on == (int(r.key[1:]) % 19 == 0) for r in own.collect())
    else:
        assert all(r.on == (int(r.key[1:]) % 19 == 0) for r in c.mark(universe, "key", "on").collect())


def test_query_has_levels_and_no_python(spark):
    df = url_filters.op5_url_filters(spark, SF_MID)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Join" not in plan
    assert df.where("listed").count() > 0


def test_positions_have_seeds_of_their_own(spark, monkeypatch):
    """Keys that share one 64-bit hash still get different bits."""
    real = F.xxhash64
    # all keys collide when hashed first; hashes of several columns are chained, as Spark does
    monkeypatch.setattr(url_filters.F, "xxhash64", lambda *c: real(F.lit(0) if "key" in str(c[0]) else c[0], *c[1:]))
    at = F.array(*url_filters._positions(F.col("key"), 1, 1 << 20))
    a, b = [r.at for r in spark.createDataFrame([("a",), ("b",)], "key string").select(at.alias("at")).collect()]
    assert len(set(a)) == len(set(b)) == url_filters.HASHES and not set(a) & set(b)
