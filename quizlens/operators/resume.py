"""Resuming, caching, upsert, first-wins dedup and sharding (J2-J4, J7,
P10-P12, U1-U4).

Order is data: every result row carries ``seq`` (file position), and
"first" / "latest" mean min / max ``seq`` - never the physical row order.
Each operator is an aggregation (``min_by`` / ``max_by`` with map-side
partial aggregation) or a join against a table holding one row per key, so
a key holding a third of all rows is pre-aggregated or split by AQE's
skew-join handling instead of landing whole in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import extract
from ..functions.text import MAX_TOKENS_TEXT

MERGE_KEYS = ("question_id", "question")


def dedup_first(df: DataFrame, key="question_id", order: str = "seq") -> DataFrame:
    """Keep the first row (min ``order``) per key. Unlike
    ``dropDuplicates`` the survivor is defined."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    return (df.groupBy(*keys).agg(F.min_by(row, F.col(order)).alias("_r"))
              .select(*keys, *[F.col("_r")[c].alias(c) for c in rest]))


def latest_per_key(df: DataFrame, key=MERGE_KEYS, order: str = "seq") -> DataFrame:
    """Last row (max ``order``) per key."""
    keys = list(key)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    return (df.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("_r"))
              .select(*keys, *[F.col("_r")[c].alias(c) for c in rest]))


def merge(old: DataFrame, new: DataFrame, keys=MERGE_KEYS, mode: str = "all",
          order: str = "seq") -> DataFrame:
    """Upsert ``new`` into ``old`` on ``keys``.

    ``mode='all'`` replaces every old row with an equal key (sequential API
    runner), ``mode='first'`` only the first one (concurrent runner). A
    replaced row keeps its old position (``seq``); keys absent from ``old``
    are appended with their own ``seq``. Within ``new`` the latest row per
    key wins.
    """
    keys = list(keys)
    vals = [c for c in old.columns if c not in keys and c != order]
    upd = latest_per_key(new.select(*keys, order, *vals), keys, order)
    upd = upd.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in vals], F.col(order).alias("_n_seq"))
    if mode == "all":
        return _upserted(old, upd, keys, vals, order)
    elif mode == "first":
        first = old.groupBy(*keys).agg(F.min(order).alias(order))
        first = first.select(*[F.col(c).alias(f"_k_{c}") for c in keys], order)
        target = upd.join(first, _same({c: f"_k_{c}" for c in keys})).drop(*[f"_k_{c}" for c in keys])   # one row per key on both sides
        on = keys + [order]                      # (key, seq) spreads a hot key
    else:
        raise ValueError("mode must be 'all' or 'first'")
    # null keys are equal, as in the grouping; the flag tells a matched row
    # apart from a match with null values
    target = target.withColumn("_m", F.lit(1)).drop("_n_seq")
    target = target.select(*[F.col(c).alias(f"_k_{c}") for c in on], *[c for c in target.columns if c not in on])
    j = old.join(target, _same({c: f"_k_{c}" for c in on}), "left")
    replaced = F.col("_m").isNotNull()
    kept = j.select(*keys, order, *[F.when(replaced, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
                                    for c in vals])
    there = old.select(*[F.col(c).alias(f"_k_{c}") for c in keys]).distinct()
    appended = (upd.join(there, _same({c: f"_k_{c}" for c in keys}), "left_anti")
                   .select(*keys, F.col("_n_seq").alias(order),
                           *[F.col(f"_n_{c}").alias(c) for c in vals]))
    return kept.unionByName(appended).select(*old.columns)


def _upserted(old: DataFrame, upd: DataFrame, keys: list, vals: list, order: str) -> DataFrame:
    """``old`` with the rows of every key of ``upd`` replaced, and the keys that
    it has not: one join that keeps both sides, as null keys are equal and the
    flags tell a missing row from one of nulls."""
    new = upd.withColumn("_m", F.lit(1)).withColumnsRenamed({c: f"_k_{c}" for c in keys})
    j = old.withColumn("_o", F.lit(1)).join(new, _same({c: f"_k_{c}" for c in keys}), "full")
    there, replaced = F.col("_o").isNotNull(), F.col("_m").isNotNull()
    out = {**{c: F.when(there, F.col(c)).otherwise(F.col(f"_k_{c}")) for c in keys}, order: F.when(there, F.col(order)).otherwise(F.col("_n_seq")),
           **{c: F.when(replaced, F.col(f"_n_{c}")).otherwise(F.col(c)) for c in vals}}
    return j.select(*[out[c].alias(c) for c in old.columns])


def _same(pairs: dict) -> Column:
    """Null-safe equality of column pairs."""
    return reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in pairs.items()))


def lookup_cached(questions: DataFrame, results: DataFrame, keys=MERGE_KEYS,
                  cascade: str = "l2") -> DataFrame:
    """J2 + E6: attach the first saved result with equal (id, question);
    the saved ``pred`` is ignored and re-extracted from the output."""
    keys = list(keys)
    first = dedup_first(results.select(*keys, "seq", "model_outputs"), keys, "seq")
    return (questions.join(first, keys, "left")
            .withColumn("cached", F.col("model_outputs").isNotNull())
            .withColumn("pred", extract("model_outputs", cascade)))


def rerun_candidates(results: DataFrame, max_tokens: bool = True,
                     unknown: bool = True) -> DataFrame:
    """Ids to run again - max-token aborts and/or missing
    predictions (a null output qualifies as unknown)."""
    mo = F.col("model_outputs")
    is_max = mo.eqNullSafe(F.lit(MAX_TOKENS_TEXT))
    is_unknown = F.col("pred").isNull() & ~is_max
    cond = F.lit(False)
    if max_tokens:
        cond = cond | is_max
    if unknown:
        cond = cond | is_unknown
    return (results.where(cond)
            .groupBy("question_id")
            .agg(F.max(is_max.cast("int")).alias("max_tokens"),
                 F.max(is_unknown.cast("int")).alias("unknown")))


def pending(questions: DataFrame, results: DataFrame, rerun_max_tokens: bool = False,
            rerun_unknown: bool = False) -> DataFrame:
    """Questions not processed yet, plus processed ones selected for a
    rerun; every other processed question is carried as done."""
    processed = results.select("question_id")
    todo = questions.join(processed, "question_id", "left_anti")
    if rerun_max_tokens or rerun_unknown:
        ids = rerun_candidates(results, rerun_max_tokens, rerun_unknown).select("question_id")
        todo = todo.unionByName(questions.join(ids, "question_id", "left_semi"))
    return todo


def resume_plan(questions: DataFrame, results: DataFrame, rerun_max_tokens: bool = False,
                rerun_unknown: bool = False) -> DataFrame:
    """All questions with ``state``: ``pending`` (no result, or selected
    for a rerun), else ``success`` or ``wrong`` by the first saved result; one
    without a prediction is wrong."""
    first = dedup_first(results.select("question_id", "seq", "pred", "answer"), "question_id", "seq")
    first = first.select("question_id", F.coalesce(F.col("pred") == F.col("answer"), F.lit(False)).alias("_right"))
    j = questions.join(first, "question_id", "left")
    again = F.lit(False)
    if rerun_max_tokens or rerun_unknown:
        ids = rerun_candidates(results, rerun_max_tokens, rerun_unknown).select("question_id", F.lit(True).alias("_again"))
        j, again = j.join(ids, "question_id", "left"), F.coalesce(F.col("_again"), F.lit(False))
    state = F.when(F.col("_right").isNull() | again, "pending").when(F.col("_right"), "success").otherwise("wrong")
    return j.withColumn("state", state).drop("_right", "_again")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables put together by column name; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_shards(parts: list[DataFrame], key="question_id", order: str = "seq", n_tasks: int | None = None) -> DataFrame:
    """U4: the results of all shards that have any, first row per key. ``n_tasks``:
    the rows are dealt over so many tasks by key before they are put in order, so
    that a task's memory is that of its part, not of a file's (None: each task
    first merges what it reads, for keys that hold very many rows)."""
    out = union_all(parts)
    dealt = out.repartition(n_tasks, *([key] if isinstance(key, str) else key)) if n_tasks else out
    return dedup_first(dealt, key, order).select(*out.columns)


def drop_failed(results: DataFrame) -> DataFrame:
    """A failed call leaves no row, so it is picked up again later."""
    return results.where(F.col("model_outputs").isNotNull())


def assign_shard(df: DataFrame, n: int, key: str = "question_id") -> DataFrame:
    """Shard id ``pmod(key, n)`` as a column."""
    return df.withColumn("shard", F.pmod(F.col(key), F.lit(n)).cast("int"))


def shard_coverage(expected: DataFrame, present: DataFrame, n: int,
                   key: str = "question_id") -> DataFrame:
    """U4: per shard, expected vs present (deduped) questions and what is
    missing; a rerun only needs the missing ones."""
    e = assign_shard(expected.select(key).distinct(), n, key)
    p = present.select(key).distinct().withColumn("_present", F.lit(1))
    j = e.join(p, key, "left")
    return j.groupBy("shard").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("_present").alias("present"),
        F.count_if(F.col("_present").isNull()).alias("missing")) \
        .withColumn("complete", (F.col("missing") == 0).cast("int"))
