"""Telemetry over token-count samples (W3-W6, A11 live counts).

Input: ``(event_id, question_id, ts, kind, delta)`` with kind ``reset`` |
``update`` | ``count`` | ``success`` | ``wrong`` (see ``tracked``).

Order within a question is (ts, event_id). The scan runs in time blocks with
a halo, so a question holding a third of all samples is still split over many
tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import printable
from ..session import checkpoint_dir

US = 1_000_000
# The live view's rolling-rate window and stall threshold are
# 8 s and 25 s, the minimum time span for a rate 0.05 s, and the age colour
# thresholds 30 / 90 / 180 s. The test telemetry is spaced in hours, so its
# queries pass 8 h and 25 h (``scale=3600``).
RATE_WINDOW_S = 8
STALL_S = 25
MIN_DT_S = 0.05
AGE_BUCKETS = ((30, "white"), (90, "yellow"), (180, "orange"))


def epoch_us(ts) -> Column:
    """Microseconds since 1970-01-01 for TIMESTAMP or TIMESTAMP_NTZ, without
    going through the session time zone."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            t.cast("timestamp_ntz"))


BLOCK_WINDOWS = 16      # length of a time block, in rate windows
ACTIVITY = ("update", "count")
FINISHED = ("success", "wrong")


def tracked(tele: DataFrame, window_s: float = RATE_WINDOW_S, min_dt_s: float = MIN_DT_S,
            block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Every telemetry row with its question's state after it: ``us``,
    ``episode`` (resets so far), ``live``, ``tokens``, ``rate`` and
    ``next_us`` (time of the question's next row that is no count).

    A reset starts an episode; ``success`` / ``wrong`` end it, which removes
    history, count and rate, so rows after it are not live until the next
    reset. Live ``update`` rows add to the count and are samples of the rate;
    live ``count`` rows add to the count without touching the rate. The rate
    is tokens/s over the samples of the last ``window_s`` seconds of the
    episode; with fewer than two, no time span (> ``min_dt_s``) or no growth
    the previous rate is kept (0 after a reset). Growth is since the first of
    those samples, so a server's count below the own one lowers the next rates.

    The first sample of a window is not looked for row by row: each sample also
    goes into the same sorted rows as a probe at its window's start, and one
    running pass from the end hands every probe the first sample after it. That
    is linear however many samples a window holds.

    Time is cut into blocks of a few rate windows, so the rows of one block of
    one question - not of one question - meet in a task. Each row goes once
    to its block, and the last window's rows also to the next one. Everything
    is computed inside a block relative to its start in one partitioning,
    which is checkpointed; one summary row per block then gives each block
    its start values, and one join adds them.
    """
    checkpoint_dir(tele.sparkSession)
    win = int(window_s * US)
    size = win * block_windows
    blk = F.floor(F.col("us") / size).cast("bigint")
    t = tele.select("event_id", "question_id", "ts", "kind", "delta", epoch_us("ts").alias("us"))
    own, halo = F.struct(blk.alias("blk"), F.lit(False).alias("halo")), F.struct((blk + 1).alias("blk"), F.lit(True).alias("halo"))
    t = t.select("*", F.inline(F.when(F.col("us") >= (blk + 1) * size - win, F.array(own, halo)).otherwise(F.array(own))))

    reset, sample = F.col("kind") == "reset", F.col("kind") == "update"
    steps = {"e": reset.cast("bigint"), "c": F.when(F.col("kind").isin(*ACTIVITY), F.col("delta")).otherwise(0),
             "f": F.col("kind").isin(*FINISHED).cast("bigint")}
    whole = Window.partitionBy("question_id", "blk")
    upto = whole.orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, v in steps.items():   # counted from the block's start: rows of the block before add up to 0
        t = t.withColumn(name, F.sum(v).over(upto) - F.coalesce(F.sum(F.when(F.col("halo"), v)).over(whole), F.lit(0)))
    t = t.withColumn("base", F.last(F.when(reset, F.struct("c", "f")), ignorenulls=True).over(upto))
    back = whole.orderBy(F.desc("us"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("next_us", F.last(F.when(F.col("kind") != "count", F.col("us")), ignorenulls=True).over(back))
    probes = F.when(sample & ~F.col("halo"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    t = t.select("*", F.explode(probes).alias("probe"))
    at = F.when(F.col("probe"), F.col("us") - win).otherwise(F.col("us"))
    of_episode = Window.partitionBy("question_id", "blk", "e")
    from_end = of_episode.orderBy(at.desc(), "probe", F.desc("us"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("first", F.last(F.when(sample & ~F.col("probe"), F.struct("us", "c")), ignorenulls=True).over(from_end))
    span, grown = (F.col("us") - F.col("first.us")).cast("double") / float(US), F.col("c") - F.col("first.c")
    t = t.withColumn("raw", F.when(F.col("probe") & (span > min_dt_s) & (grown > 0), grown.cast("double") / span)).drop("first")
    # a sample's probe comes just before it, so it finds its own rate
    t = t.withColumn("last_raw", F.last("raw", ignorenulls=True).over(
        of_episode.orderBy("us", "event_id", F.desc("probe")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.where(~F.col("halo") & ~F.col("probe")).drop("halo", "raw", "probe").checkpoint(eager=True)

    at = F.struct("us", "event_id")
    blocks = t.groupBy("question_id", "blk").agg(
        *[F.max_by(n, at).alias(f"sum_{n}") for n in steps], F.max_by("last_raw", at).alias("raw_end"),
        F.max_by("base", F.when(reset, at)).alias("base_end"), F.min(F.when(F.col("kind") != "count", F.col("us"))).alias("first_us"))
    order = Window.partitionBy("question_id").orderBy("blk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    for n in steps:
        blocks = blocks.withColumn(f"in_{n}", F.coalesce(F.sum(f"sum_{n}").over(before), F.lit(0)))
    seen = F.col("sum_e") > 0
    end = F.when(seen, F.struct((F.col("in_c") + F.col("base_end.c")).alias("c"), (F.col("in_f") + F.col("base_end.f")).alias("f")))
    blocks = (blocks.withColumn("base_in", F.last(end, ignorenulls=True).over(before))
              .withColumn("rate_in", F.last(F.when(seen, F.coalesce("raw_end", F.lit(0.0))).otherwise(F.col("raw_end")), ignorenulls=True).over(before))
              .withColumn("next_block_us", F.last("first_us", ignorenulls=True).over(
                  Window.partitionBy("question_id").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1))))
    r = t.join(blocks.select("question_id", "blk", "in_e", "in_c", "in_f", "base_in", "rate_in", "next_block_us"), ["question_id", "blk"])

    def since_reset(n):     # growth since the episode's start, in this block or in an earlier one
        return F.when(F.col("base").isNotNull(), F.col(n) - F.col(f"base.{n}")).otherwise(
            F.col(f"in_{n}") + F.col(n) - F.coalesce(F.col(f"base_in.{n}"), F.lit(0)))

    live = since_reset("f") - steps["f"] == 0
    rate = F.coalesce(F.col("last_raw"), F.when(F.col("e") == 0, F.col("rate_in")), F.lit(0.0))
    return r.select("event_id", "question_id", "ts", "us", "kind", (F.col("in_e") + F.col("e")).alias("episode"), live.alias("live"),
                    F.when(reset | ~live, F.lit(0)).otherwise(since_reset("c")).cast("bigint").alias("tokens"),
                    F.when(live & F.col("kind").isin(*ACTIVITY), rate).otherwise(F.lit(0.0)).alias("rate"),
                    F.coalesce("next_us", "next_block_us").alias("next_us"))


def rolling_rate(tele: DataFrame, window_s: float = RATE_WINDOW_S, min_dt_s: float = MIN_DT_S,
                 block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Episode, tokens and rate after every telemetry row (``tracked``)."""
    return tracked(tele, window_s, min_dt_s, block_windows).select(
        "event_id", "question_id", "ts", "kind", "episode", "tokens", "rate")


def stalls(tele: DataFrame, threshold_s: float = STALL_S, window_s: float = RATE_WINDOW_S) -> DataFrame:
    """Samples after which a live question was silent for more than
    ``threshold_s``: no further sample, reset or end came in that time. A
    count the server reports is no sign of life. ``next_us`` is null where no
    such row followed."""
    t = tracked(tele, window_s)
    quiet = F.col("next_us").isNull() | (F.col("next_us") - F.col("us") > int(threshold_s * US))
    return t.where(F.col("live") & (F.col("kind") == "update") & quiet).select("question_id", "episode", "us", "next_us")


def stall_flags(tele: DataFrame, threshold_s: float = STALL_S, now: Column | None = None,
                window_s: float = RATE_WINDOW_S) -> DataFrame:
    """Per question its samples, the silences longer than
    ``threshold_s`` while it was live, and whether it is stalled at ``now``
    (default: the latest ``ts``, as a scalar subquery). A finished question,
    or one without a sample since its reset, is not stalled."""
    thr = int(threshold_s * US)
    busy = F.col("live") & (F.col("kind") == "update")
    g = tracked(tele, window_s).groupBy("question_id").agg(
        F.count_if(busy).alias("samples"),
        F.count_if(busy & (F.col("next_us") - F.col("us") > thr)).alias("stalls"),
        F.max(F.when(busy & F.col("next_us").isNull(), F.col("us"))).alias("_last"))
    now_us = epoch_us(now) if now is not None else tele.select(F.max(epoch_us("ts"))).scalar()
    return g.select("question_id", "samples", "stalls",
                    F.coalesce(now_us - F.col("_last") > thr, F.lit(False)).cast("int").alias("stalled_now"))


def age_buckets(tele: DataFrame, scale: float = 1.0, now: Column | None = None) -> DataFrame:
    """Questions still active (a reset with no success / wrong after
    it) by age since their last (re)start: < 30 white, < 90 yellow, < 180
    orange, else red (seconds x ``scale``)."""
    us = epoch_us("ts")
    per_q = tele.groupBy("question_id").agg(
        F.max(F.when(F.col("kind") == "reset", us)).alias("_start"),
        F.max(F.when(F.col("kind").isin("success", "wrong"), us)).alias("_end"))
    now_us = epoch_us(now) if now is not None else tele.select(F.max(us)).scalar()
    active = per_q.where(F.col("_start").isNotNull()
                         & (F.col("_end").isNull() | (F.col("_end") < F.col("_start"))))
    age = (now_us - F.col("_start")).cast("double") / float(US)
    label = F.lit("red")
    for limit, name in reversed(AGE_BUCKETS):
        label = F.when(age < limit * scale, F.lit(name)).otherwise(label)
    return active.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("questions"))


def log_lines(tele: DataFrame) -> DataFrame:
    """Log messages ``[HH:MM:SS] Q<id> <kind> <delta>`` derived from the
    telemetry rows."""
    return tele.select("event_id", "ts", F.concat(
        F.lit("["), F.date_format("ts", "HH:mm:ss"), F.lit("] Q"), F.col("question_id").cast("string"),
        F.lit(" "), F.col("kind"), F.lit(" "), F.col("delta").cast("string")).alias("message"))


def log_tail(logs: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` messages (the ring keeps 50, the view shows 10),
    non-printable characters removed. A top-n (TakeOrderedAndProject), no
    global sort."""
    top = logs.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)
    return top.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
                      printable("message").alias("message"))


def question_state(tele: DataFrame, window_s: float = RATE_WINDOW_S, min_dt_s: float = MIN_DT_S) -> DataFrame:
    """ST1 / ST5 batch twin: the latest state of every question - episode,
    tokens and rate of its last row, status (``pending`` until the first
    reset, ``active`` after a reset, ``success`` / ``wrong`` once reported)
    and retries (resets after the first start). Pure aggregation over the
    rolling-rate rows (partial aggregation, no per-question sort)."""
    r = rolling_rate(tele, window_s, min_dt_s).withColumn("us", epoch_us("ts"))
    order = F.struct("us", "event_id")
    status_of = F.when(F.col("kind") == "reset", F.lit("active")).otherwise(F.col("kind"))
    g = r.groupBy("question_id").agg(
        F.max_by(F.struct("episode", "tokens", "rate"), order).alias("_last"),
        F.max_by(status_of, F.when(~F.col("kind").isin(*ACTIVITY), order)).alias("_status"),
        F.count_if(F.col("kind") == "reset").alias("_resets"))
    return g.select("question_id", F.col("_last.episode").alias("episode"), F.col("_last.tokens").alias("tokens"),
                    F.col("_last.rate").alias("rate"), F.coalesce("_status", F.lit("pending")).alias("status"),
                    F.greatest(F.col("_resets") - 1, F.lit(0)).cast("bigint").alias("retries"))


def live_totals(tele: DataFrame, window_s: float = RATE_WINDOW_S, min_dt_s: float = MIN_DT_S) -> DataFrame:
    """A12 / A11 (live header): questions by status, total tokens, the summed
    rate of the active questions and the elapsed time of the run. One
    aggregate over ``question_state`` rows (one per question)."""
    st = question_state(tele, window_s, min_dt_s)
    active = F.col("status") == "active"
    totals = st.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(active).alias("active"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "wrong").alias("wrong"),
        F.sum("tokens").cast("bigint").alias("tokens_total"),
        F.round(F.coalesce(F.sum(F.when(active, F.col("rate"))), F.lit(0.0)), 6).alias("rate_total"))
    span = tele.select(((F.max(epoch_us("ts")) - F.min(epoch_us("ts"))).cast("double") / float(US)))
    return totals.withColumn("elapsed_s", span.scalar()).withColumn(
        "accuracy", F.coalesce(F.try_divide(F.col("success") * 100.0, F.col("success") + F.col("wrong")),
                               F.lit(0.0)))


def throughput(tele: DataFrame, size_s: float = RATE_WINDOW_S, slide_s: float = 1.0) -> DataFrame:
    """ST9 batch twin: tokens and events per question in sliding windows of
    ``size_s`` moving by ``slide_s`` (aligned to the epoch), via
    ``F.window`` on a time-zone free event time."""
    t = tele.withColumn("_et", F.timestamp_micros(epoch_us("ts")))
    g = t.groupBy("question_id", F.window("_et", f"{int(size_s)} seconds", f"{int(slide_s)} seconds").alias("w")) \
         .agg(F.sum("delta").alias("tokens"), F.count(F.lit(1)).alias("events"))
    return g.select("question_id", F.unix_micros(F.col("w.start")).alias("start_us"), "tokens", "events")
