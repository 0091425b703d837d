"""Streaming twins: the tracker equals the batch rolling rate across
restarts, and a question without new samples gets a stall alert once the
watermark passes its deadline."""

import glob
import datetime as dt
import tempfile

from pyspark.sql import functions as F

from quizlens.operators.telemetry import rolling_rate, stall_flags
from quizlens.streaming import tracker as TR
from quizlens.streaming.sinks import run_available

SCHEMA = "event_id long, question_id long, ts timestamp_ntz, kind string, delta long"


def _rows():
    t0 = dt.datetime(2024, 1, 1)
    s = lambda x: t0 + dt.timedelta(seconds=x)
    return [
        (1, 1, s(0), "reset", 0), (2, 1, s(1), "update", 10), (3, 1, s(3), "update", 10),
        (4, 1, s(5), "update", 0), (5, 1, s(31), "update", 5),
        (6, 2, s(0), "reset", 0), (7, 2, s(2), "update", 4),
        (8, 1, s(100), "reset", 0), (9, 1, s(101), "update", 3), (10, 1, s(102), "update", 3),
        (11, 3, s(400), "update", 1),       # sentinel: moves the watermark
    ]


def test_tracker_equals_batch_and_alerts(spark):
    base = tempfile.mkdtemp(prefix="quizlens-stream-")
    df = spark.createDataFrame(_rows(), SCHEMA)
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"
    # slices arrive in event-time order (an earlier slice never holds later rows)
    t = F.col("ts")
    slices = [t < F.lit("2024-01-01 00:00:10").cast("timestamp_ntz"),
              (t >= F.lit("2024-01-01 00:00:10").cast("timestamp_ntz"))
              & (t < F.lit("2024-01-01 00:03:20").cast("timestamp_ntz")),
              t >= F.lit("2024-01-01 00:03:20").cast("timestamp_ntz")]
    for i, c in enumerate(slices):
        df.where(c).write.parquet(f"{src}/s{i}")
        st = spark.readStream.schema(df.schema).parquet(f"{src}/*")
        run_available(TR.track_questions(st, window_s=8, stall_s=25, delay="1 second"), out, checkpoint=ck)
    got = spark.read.parquet(out)
    samples = {(r.event_id, r.tokens, round(r.rate, 9)) for r in got.where("kind not in ('stalled', 'late')").collect()}
    batch = {(r.event_id, r.tokens, round(r.rate, 9)) for r in rolling_rate(df, 8).collect()}
    assert samples == batch
    assert got.where("kind = 'late'").count() == 0
    alerts = sorted((r.question_id, r.episode, r.us - 1704067200 * 1000000) for r in got.where("kind = 'stalled'").collect())
    # question 1 is silent from 5 s to 31 s, from there to its restart, and after 102 s; question 2 after 2 s
    assert alerts == [(1, 1, 30_000_000), (1, 1, 56_000_000), (1, 2, 127_000_000), (2, 1, 27_000_000)]
    assert stall_flags(df, 25).where("question_id = 1").first()[1:] == (6, 2, 1)


def test_finished_and_counted_rows(spark):
    """Hand-made rows: a finished question is no sample, keeps no rate and
    never stalls; a server count adds tokens without changing the rate; rows
    after the end wait for the next reset."""
    t0 = dt.datetime(2024, 1, 1)
    s = lambda x: t0 + dt.timedelta(seconds=x)
    rows = [(1, 1, s(0), "reset", 0), (2, 1, s(1), "update", 10), (3, 1, s(3), "update", 30), (4, 1, s(4), "count", 500),
            (5, 1, s(5), "update", 10), (6, 1, s(6), "success", 99), (7, 1, s(90), "update", 5), (8, 2, s(0), "reset", 0),
            (9, 2, s(1), "update", 7), (10, 2, s(40), "wrong", 0), (11, 3, s(200), "reset", 0)]
    want = {1: (0, 0.0), 2: (10, 0.0), 3: (40, 15.0), 4: (540, 15.0), 5: (550, 135.0), 6: (550, 0.0), 7: (0, 0.0), 8: (0, 0.0), 9: (7, 0.0),
            10: (7, 0.0), 11: (0, 0.0)}
    df = spark.createDataFrame(rows, SCHEMA)
    for blocks in (1, 2, 1000):
        assert {r.event_id: (r.tokens, r.rate) for r in rolling_rate(df, 8, block_windows=blocks).collect()} == want
    flags = {r.question_id: (r.samples, r.stalls, r.stalled_now) for r in stall_flags(df, 25).collect()}
    assert flags == {1: (3, 0, 0), 2: (1, 1, 0), 3: (0, 0, 0)}
    src, out, ck = (f"{tempfile.mkdtemp(prefix='quizlens-rows-')}/{x}" for x in ("src", "out", "ck"))
    for i, cut in enumerate((rows[:3], rows[3:6], rows[6:])):
        spark.createDataFrame(cut, SCHEMA).write.parquet(f"{src}/s{i}")
        run_available(TR.track_questions(spark.readStream.schema(SCHEMA).parquet(f"{src}/*"), 8, stall_s=25, delay="300 seconds"), out, checkpoint=ck)
    got = spark.read.parquet(out)
    assert {r.event_id: (r.tokens, r.rate) for r in got.where("kind <> 'stalled'").collect()} == want
    assert [(r.question_id, r.us) for r in got.where("kind = 'stalled'").collect()] == [(2, 1704067226 * 1000000)]


def test_state_of_finished_questions_goes(spark):
    t0 = dt.datetime(2024, 1, 1)
    s = lambda x: t0 + dt.timedelta(seconds=x)
    src, out, ck = (f"{tempfile.mkdtemp(prefix='quizlens-keep-')}/{x}" for x in ("src", "out", "ck"))
    parts = [[(1, 1, s(0), "reset", 0), (2, 1, s(1), "success", 0)], [(3, 9, s(500), "update", 1)], [(4, 1, s(501), "reset", 0)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{src}/s{i}")
        run_available(TR.track_questions(spark.readStream.schema(SCHEMA).parquet(f"{src}/*"), 8, stall_s=25, delay="1 second", keep_s=60), out, checkpoint=ck)
    again = spark.read.parquet(out).where("event_id = 4").first()
    assert (again.episode, again.retries) == (1, 0)


def test_late_and_duplicate_rows(spark):
    """Deduplication drops a repeated delivery inside the watermark delay
    and a row older than the watermark."""
    base = tempfile.mkdtemp(prefix="quizlens-late-")
    t0 = dt.datetime(2024, 1, 1)
    s = lambda x: t0 + dt.timedelta(seconds=x)
    first = [(1, 1, s(0), "update", 1), (2, 1, s(10), "update", 1), (3, 2, s(100), "update", 1)]
    second = [(2, 1, s(10), "update", 1),          # duplicate of event 2 (within the delay)
              (4, 1, s(5), "update", 1),           # late: watermark is 100 s - 30 s = 70 s
              (5, 2, s(110), "update", 1)]
    src, ck, out = f"{base}/src", f"{base}/ck", f"{base}/dedup"
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{src}/s{i}")
        st = spark.readStream.schema(SCHEMA).parquet(f"{src}/*")
        run_available(TR.dedup_late(st, "event_id", delay="30 seconds").select("event_id"), out, checkpoint=ck)
    ids = sorted(r[0] for r in spark.read.parquet(out).collect())
    assert ids == [1, 2, 3, 5]


def test_tracker_reorders_within_the_watermark(spark):
    """Rows of one question arriving out of order (within the delay) give
    the batch result once the watermark has passed them."""
    base = tempfile.mkdtemp(prefix="quizlens-reorder-")
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    # arrival: later samples first, earlier ones in the next slice, then a
    # sentinel far ahead that moves the watermark past everything
    arrivals = [[r for r in rows if r[0] in (1, 3, 6)], [r for r in rows if r[0] in (2, 4, 7, 5)],
                [r for r in rows if r[0] in (8, 10, 9, 11)],
                [(99, 99, dt.datetime(2024, 1, 2), "update", 1)]]
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"
    for i, part in enumerate(arrivals):
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{src}/s{i}")
        st = spark.readStream.schema(SCHEMA).parquet(f"{src}/*")
        run_available(TR.track_questions(st, window_s=8, stall_s=25, delay="60 seconds", reorder=True),
                      out, checkpoint=ck)
    got = spark.read.parquet(out)
    samples = {(r.event_id, r.tokens, round(r.rate, 9)) for r in
               got.where("kind not in ('stalled', 'late') and question_id <> 99").collect()}
    batch = {(r.event_id, r.tokens, round(r.rate, 9)) for r in rolling_rate(df, 8).collect()}
    assert samples == batch
    assert got.where("kind = 'late'").count() == 0


def test_merge_batches_replay_after_a_failed_write(spark):
    """A batch that fails half way leaves the table as it was; replayed, it
    counts once."""
    from quizlens.streaming.sinks import merge_batch, read_merged
    table = f"{tempfile.mkdtemp(prefix='quizlens-merge-')}/t"
    row = "seq long, question_id long, question string, v string"
    read = lambda: sorted(tuple(r) for r in read_merged(spark, table, spark.createDataFrame([], row).schema).collect())
    assert read() == []
    merge_batch(spark, spark.createDataFrame([(1, 1, "a", "x"), (2, 2, None, "y")], row), table, 0)
    bad = spark.createDataFrame([(5, 2, None, "z")], row).withColumn("v", F.raise_error(F.lit("stopped")).cast("string"))
    try:
        merge_batch(spark, bad, table, 1)
        raise AssertionError("the batch did not fail")
    except Exception as e:
        assert "stopped" in str(e)
    assert read() == [(1, 1, "a", "x"), (2, 2, None, "y")]
    for _ in range(2):
        merge_batch(spark, spark.createDataFrame([(5, 2, None, "z"), (6, 3, "c", "n")], row), table, 1)
        assert read() == [(1, 1, "a", "x"), (2, 2, None, "z"), (6, 3, "c", "n")]


def _files_read(df):
    """Files that the executed plan's scans opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
            continue
        if "QueryStage" in p.getClass().getName():
            todo.append(p.plan())
            continue
        m = p.metrics().get("numFiles")
        if m.isDefined():
            total += m.get().value()
        kids = p.children()
        todo.extend(kids.apply(i) for i in range(kids.size()))
    return total


def test_merge_reads_the_buckets_of_its_keys(spark):
    from quizlens.streaming import sinks
    table = f"{tempfile.mkdtemp(prefix='quizlens-buckets-')}/t"
    row = "seq long, question_id long, question string, v string"
    keys = ("question_id", "question")
    full = spark.range(1000).select(F.col("id").alias("seq"), F.col("id").alias("question_id"), F.lit("q").alias("question"), F.lit("a").alias("v"))
    schema = spark.createDataFrame([], row).schema
    sinks.merge_batch(spark, full.coalesce(1), table, 0)
    whole = _files_read(sinks._read(spark, table, sinks._versions(spark, table)[1], schema, keys))
    few = _files_read(sinks._read(spark, table, sinks._versions(spark, table)[1], schema, keys, [3]))
    assert whole >= sinks.BUCKETS and 0 < few * 16 <= whole
    sinks.merge_batch(spark, spark.createDataFrame([(9000, 5, "q", "b"), (9001, 2000, "q", "n")], row), table, 1)
    got = {r.question_id: (r.seq, r.v) for r in sinks.read_merged(spark, table, schema).collect()}
    assert len(got) == 1001 and got[5] == (5, "b") and got[2000] == (9001, "n") and got[6] == (6, "a")


def test_compaction_failure_replay_and_purge(spark, monkeypatch):
    """A compaction that stops before its marker changes nothing; after a whole
    one the rows are the same, earlier batches stay done, later ones count."""
    from quizlens.streaming import sinks
    table = f"{tempfile.mkdtemp(prefix='quizlens-compact-')}/t"
    row = "seq long, question_id long, question string, v string"
    schema = spark.createDataFrame([], row).schema
    read = lambda: sorted((tuple(r) for r in sinks.read_merged(spark, table, schema).collect()), key=str)
    batches = [[(1, 1, "a", "x"), (2, 2, None, "y")], [(3, 2, None, "z"), (4, None, "n", "w")], [(5, 1, "a", None)]]
    df = [spark.createDataFrame(b, row) for b in batches]
    for i in (0, 1):
        sinks.merge_batch(spark, df[i], table, i)
    want = read()
    assert want == [(1, 1, "a", "x"), (2, 2, None, "z"), (4, None, "n", "w")]
    rows = sinks._rows
    monkeypatch.setattr(sinks, "_rows", lambda *a: rows(*a).withColumn("v", F.raise_error(F.lit("stopped")).cast("string")))
    try:
        sinks.compact(spark, table, schema)
        raise AssertionError("the compaction did not fail")
    except Exception as e:
        assert "stopped" in str(e)
    monkeypatch.setattr(sinks, "_rows", rows)
    assert read() == want and len(sinks._versions(spark, table)[1]) == 2
    sinks.merge_batch(spark, df[1], table, 1)  # replayed
    assert read() == want
    for _ in range(2):
        sinks.compact(spark, table, schema)
        assert read() == want and len(sinks._versions(spark, table)[1]) == 1
    assert sinks.purge(spark, table) == 2 and sinks.purge(spark, table) == 0 and read() == want
    for i in (0, 1, 2, 2):
        sinks.merge_batch(spark, df[i], table, i)
    assert read() == [(1, 1, "a", None), (2, 2, None, "z"), (4, None, "n", "w")]


def test_tracker_makes_one_frame_a_group(monkeypatch):
    """A question's few rows are handled as arrays: a frame more per group costs more than its rows."""
    import numpy as np
    import pandas as pd
    from quizlens.streaming import tracker

    class State:
        exists = hasTimedOut = False
        getCurrentWatermarkMs = lambda self: 2
        update = setTimeoutTimestamp = lambda self, x: None

    rows = pd.DataFrame({"event_id": [3, 1, 2], "question_id": 7, "kind": ["update", "reset", "update"], "delta": [5, 0, 4], "us": [9_000_000, 0, 8_000_000]})
    made, frame = [], pd.DataFrame
    monkeypatch.setattr(tracker.pd, "DataFrame", lambda *a, **k: made.append(1) or frame(*a, **k))
    monkeypatch.setattr(tracker.pd, "concat", lambda *a, **k: made.append(2))
    out = list(tracker._tracker(8, 0.5, 25, 100, False)((7,), iter([rows]), State()))
    assert made == [1] and len(out) == 1
    assert out[0]["event_id"].tolist() == [1, 2, 3] and out[0]["kind"].tolist() == ["late", "update", "update"]
    assert out[0]["tokens"].tolist() == [9, 4, 9] and np.all(out[0]["question_id"] == 7)


def test_a_version_has_few_files(spark):
    """Files of a version are about as many as its buckets, not buckets times tasks."""
    from quizlens.streaming import sinks
    table = f"{tempfile.mkdtemp(prefix='quizlens-files-')}/t"
    df = spark.range(4000).select(F.col("id").alias("seq"), F.col("id").alias("question_id"), F.lit("q").alias("question"), F.lit("a").alias("v"))
    sinks.merge_batch(spark, df.repartition(8), table, 0)
    assert len(glob.glob(f"{table}/data/*/*/*.parquet")) <= 2 * sinks.BUCKETS
    assert sinks.read_merged(spark, table, df.schema).count() == 4000
