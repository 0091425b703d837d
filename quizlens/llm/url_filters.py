"""URL rules and exact list membership by a cascade of Bloom filters (native)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, read, row_of
from .registry import register

HASHES = 4              #: bits per key
BITS_PER_KEY = 8        #: filter size, rounded up to a power of two
MAX_BITS = 1 << 26      #: largest filter (8 MB); longer lists are dealt over more filters

#: The contract's rules (fixed values): action, host and path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Hosts with one of these words stand on the query's list (fixed values).
SPAM_HOST = r"(^|[.-])(casino|pills|spam)([.-]|$)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or end. Both are empty for
    a null url or one without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; nulls if none does."""
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last fit wins
        h, p = text.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    # hashes chain: with the number first, each has a seed of its own over the key's bytes
    return [F.xxhash64(F.lit(level * HASHES + i), key).bitwiseAND(F.lit(bits - 1)) for i in range(HASHES)]


class Cascade:
    """Level 0 encodes the listed keys; level 1 the other keys of the universe
    that pass level 0; level 2 the listed keys that pass level 1; and so on
    until no key passes wrongly. The first level that a key fails tells whether
    it is listed, for every key of the universe.

    A filter is an array of 64-bit words, made by aggregates (``bit_or`` per
    word) and used as a scalar subquery, so tests run without a join. Its size
    is bounded by ``max_bits``: longer lists are dealt by hash over ``shards``
    cascades, and each shard's rows are read against theirs alone.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS):
        self.shards: list[list[tuple[DataFrame, int, int]]] = []
        keys = scratch.keep(universe.select("key").distinct().join(listed.select("key").distinct().withColumn("on", F.lit(True)), "key", "left")
                            .select("key", F.coalesce("on", F.lit(False)).alias("on")), "universe")
        n = keys.where("on").count()
        self.n_shards = max(1, -(-n * BITS_PER_KEY // max_bits))
        for shard in range(self.n_shards):
            own, levels = keys.where(self.shard(F.col("key")) == shard), []
            yes, no, level = own.where("on"), own.where("not on"), 0
            while (count := yes.count()) or not level:
                bits = min(max_bits, max(64, 1 << (count * BITS_PER_KEY - 1).bit_length()))
                levels.append((scratch.keep(self._filter(yes, level, bits), f"filter-{shard}-{level}"), level, bits))
                wrong = scratch.keep(no.where(self._passes(F.col("key"), levels[-1])), f"wrong-{shard}-{level}")
                yes, no, level = wrong, yes, level + 1
            self.shards.append(levels)

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.n_shards))

    @staticmethod
    def _filter(keys: DataFrame, level: int, bits: int) -> DataFrame:
        """One row: the words in order, words without a key included."""
        at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
        words = at.groupBy(F.shiftright("p", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        words = words.union(keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits")))
        words = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
        return words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits").alias("words"))

    @staticmethod
    def _passes(key: Column, level: tuple[DataFrame, int, int]) -> Column:
        table, number, bits = level
        out = F.lit(True)
        for p in _positions(key, number, bits):
            word = F.element_at(table.scalar(), (F.shiftright(p, 6) + 1).cast("int"))
            out = out & (F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out

    def _listed(self, key: Column, levels: list) -> Column:
        out = F.lit(len(levels) % 2 == 1)  # passes them all
        for i in reversed(range(len(levels))):
            out = F.when(self._passes(key, levels[i]), out).otherwise(F.lit(i % 2 == 1))
        return out

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """Adds boolean ``name``: the key is listed. Keys must be of the universe."""
        parts = [df if self.n_shards == 1 else df.where(self.shard(F.col(key)) == i) for i in range(self.n_shards)]
        parts = [p.withColumn(name, self._listed(F.col(key), levels)) for p, levels in zip(parts, self.shards)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out


def page_key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def url_filters(pages: DataFrame, listed: Callable[[DataFrame], DataFrame], rules: list[tuple[str, str]],
                url_col: str = "url", carry: list[str] | None = None, max_bits: int = MAX_BITS,
                scratch: Scratch | None = None) -> DataFrame:
    """``row`` (struct of ``carry``, all columns by default) of every page with
    ``host``, ``path``, ``rule`` and ``verdict`` (``allow`` or ``block``).

    The longest fitting rule decides; else the list does, exactly: ``listed``
    takes the distinct ``(host, path, key)`` of the pages, the key universe,
    and returns the keys to block. A null url, or one without ``://``, has the
    empty key. Nothing is shuffled but distinct keys. Repeated rows get equal
    verdicts; very long urls are ordinary keys; an empty table stays empty.
    """
    s = scratch or Scratch(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    d = pages.select(row_of(pages, carry).alias("row"), host.alias("host"), path.alias("path"))
    d = d.withColumn("key", page_key(F.col("host"), F.col("path")))
    universe = s.keep(d.select("host", "path", "key").distinct(), "keys")
    marked = Cascade(listed(universe), universe, s, max_bits).mark(d, "key", "listed")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return marked.select("row", "host", "path", rule.alias("rule"),
                         F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def spam_keys(universe: DataFrame) -> DataFrame:
    return universe.where(F.col("host").rlike(SPAM_HOST)).select("key")


_FIT = {rule: "(host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '/{1}')".format(*rule.split("/", 1)) for _, rule in RULES}
_LONGEST = sorted(RULES, key=lambda r: -len(r[1]))
SQL = f"""
with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
m as (select *, case {' '.join(f"when {_FIT[r]} then '{r}'" for _, r in _LONGEST)} end as rule,
             regexp_matches(host, '{SPAM_HOST}') as listed from p)
select page_id, host, path, rule, listed,
       case {' '.join(f"when rule = '{r}' then '{a}'" for a, r in RULES)} when listed then 'block' else 'allow' end as verdict
from m
"""


@register("op5_url_filters", SQL)
def op5_url_filters(spark, sf_dir):
    """One row per page: host, path, the rule that fits and the verdict."""
    return url_filters(read(spark, sf_dir, "pages"), spam_keys, RULES, carry=["page_id"]).select("row.page_id", "*").drop("row")
