"""Properties: results do not depend on how the input is partitioned, and
a key holding a third of all rows is split by the blocked scans."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quizlens.operators import resume as R
from quizlens.operators import scan
from quizlens.operators import score as S
from quizlens.operators.telemetry import tracked
from quizlens.sources import fixtures as fx


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_results_independent_of_partitioning(spark):
    q = fx.questions(spark, SF_SMALL)
    resp = fx.responses(spark, SF_SMALL, q).cache()
    saved = fx.saved_results(spark, SF_SMALL, q).cache()
    outs = []
    for n in (1, 3, 17):
        r = resp.repartition(n)
        s = saved.repartition(n, "seq")
        sc = S.score(S.with_prediction(S.attach_gold(r, q)), "uniform_options")
        outs.append((_rows(S.summary(sc)), _rows(R.dedup_first(s, "question_id", "seq")),
                     _rows(R.merge(s, s.withColumn("seq", F.col("seq") + 10**9).where(F.col("seq") % 2 == 0)))))
    assert outs[0] == outs[1] == outs[2]


def test_blocked_sum_of_a_hot_key(spark):
    rnd = random.Random(3)
    n = 3000
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 50), i, rnd.randrange(5)) for i in range(n)]  # key 0: a third
    df = spark.createDataFrame(rows, "k int, o long, v int")
    got = scan.running_sum(df, "k", "o", F.col("v"), "s", (), 100)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("k", "o", F.sum("v").over(w).alias("s"))
    assert _rows(got.select("k", "o", "s")) == _rows(exp)


def test_hot_question_is_split_over_tasks(spark):
    """A question with a third of all samples, all within one hour: the rows
    that the scan's own partitions hold, read off the frame it returns."""
    t0, rnd = dt.datetime(2024, 1, 1), random.Random(1)
    rows = [(i, 0 if i % 3 == 0 else rnd.randrange(1, 200), t0 + dt.timedelta(seconds=rnd.randrange(3600)), "update", 1) for i in range(9000)]
    df = spark.createDataFrame(rows, "event_id long, question_id long, ts timestamp_ntz, kind string, delta long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = [r["count"] for r in tracked(df, 8).where("question_id = 0").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(held) == 3000 and len(held) >= 6 and max(held) < 1200
    one = {r.event_id: (r.tokens, r.rate) for r in tracked(df, 8, block_windows=10**4).collect()}
    assert {r.event_id: (r.tokens, r.rate) for r in tracked(df, 8).collect()} == one


TELE = "event_id long, question_id long, ts timestamp_ntz, kind string, delta long"


def _tele(spark, rows):
    from datetime import datetime, timedelta
    return spark.createDataFrame([(i, q, datetime(2024, 1, 1) + timedelta(seconds=s), k, d) for i, (q, s, k, d) in enumerate(rows)], TELE)


def test_rate_is_since_the_first_sample_when_counts_fall(spark):
    """A server's count below the own one: growth since the first sample of the
    window (here 100 at 1 s), not since the least."""
    df = _tele(spark, [(1, 0, "reset", 0), (1, 1, "update", 100), (1, 2, "count", -60), (1, 3, "update", 5), (1, 5, "update", 75), (1, 9.5, "update", 20)])
    got = {r.event_id: (r.tokens, r.rate) for r in tracked(df, 8).collect()}
    assert got == {0: (0, 0.0), 1: (100, 0.0), 2: (40, 0.0), 3: (45, 0.0), 4: (120, 5.0), 5: (140, 95 / 6.5)}


def test_a_count_is_no_sign_of_life(spark):
    """Update at 1 s, count at 20 s, now 40 s: stalled; a count without a sample: not."""
    from quizlens.operators.telemetry import stall_flags
    df = _tele(spark, [(1, 0, "reset", 0), (1, 1, "update", 5), (1, 20, "count", 1), (2, 0, "reset", 0), (2, 1, "count", 7), (3, 39, "reset", 0), (3, 40, "update", 1)])
    assert {r.question_id: (r.samples, r.stalls, r.stalled_now) for r in stall_flags(df, 25).collect()} == {1: (1, 0, 1), 2: (0, 0, 0), 3: (1, 0, 0)}


def test_dense_window_takes_linear_time(spark):
    """100,000 samples of one question within one window."""
    import time

    def run(n):
        df = spark.range(n).select(F.col("id").alias("event_id"), F.lit(1).alias("question_id"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 70)
                                   .cast("timestamp_ntz").alias("ts"), F.lit("update").alias("kind"), F.lit(1).alias("delta"))
        t0 = time.time()
        last = tracked(df, 8).orderBy(F.desc("event_id")).first()
        assert abs(last.rate - 1e6 / 70) < 1e-6 and last.tokens == n
        return time.time() - t0

    run(1000)
    assert run(100_000) < 20
