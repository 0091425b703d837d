"""Registered streaming queries (ST1-ST10) and the file round trip (S2,
S3, S6). Each one derives its input from the given tables, lands it in the
shared checkpoint folder as time-ordered slices, runs a Structured
Streaming query over them with ``availableNow`` (several micro-batches), and
returns the sink as a DataFrame. The oracle is the SQL of the batch twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import extract
from ..operators import score as S
from ..operators.resume import resume_plan
from ..sources import fixtures as fx
from ..sources.results import append_history, fresh_dir, read_categories, read_history, read_results, write_results
from ..streaming import tracker as TR
from ..streaming.sinks import live_board, merge_sink, read_merged, run_available
from . import sqlparts as X
from .fixture_sql import with_views
from .q_text import HOUR, TRACKED_SQL
from .registry import ORACLE, register


def run_in_slices(spark: SparkSession, df: DataFrame, conds, build, sink: str, mode: str = "append") -> str:
    """Land ``df`` slice by slice (each a new folder under one source
    glob) and, after each slice, restart the same streaming query from its
    checkpoint with ``availableNow`` - data arriving over time, with a
    restart between arrivals. ``build(read) -> DataFrame`` is the query;
    ``read()`` opens a stream over the source (twice for two sources)."""
    src, ck = fresh_dir(spark, "src"), fresh_dir(spark, "ckpt")

    def read():
        return spark.readStream.schema(df.schema).parquet(f"{src}/*")

    for i, c in enumerate(conds):
        df.where(c).write.parquet(f"{src}/s{i:04d}")
        run_available(build(read), sink, mode, checkpoint=ck)
    return sink


def _tele_conds():
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    day = 24 * HOUR * 1_000_000
    first = 1704067200 * 1_000_000          # 2024-01-01
    return [us < first + 10 * day, (us >= first + 10 * day) & (us < first + 20 * day), (us >= first + 20 * day) | us.isNull()]


@register("stream_rolling_rate", ORACLE["rolling_rate"])
def stream_rolling_rate(spark, sf):
    """ST1-ST4: the per-question state machine over the telemetry stream;
    its sample rows equal the batch rolling rate (W3)."""
    out = fresh_dir(spark, "tracker-out")
    run_in_slices(spark, fx.telemetry(spark, sf), _tele_conds(),
                  lambda read: TR.track_questions(read(), 8 * HOUR, stall_s=25 * HOUR, delay="30 hours", keep_s=24 * 3600 * HOUR), out)
    r = spark.read.parquet(out).where(~F.col("kind").isin("stalled", "late"))
    return r.select(F.col("event_id").cast("bigint"), "question_id", "kind", "episode", "tokens", "rate")


@register("stream_stalls", with_views(f"""
with {TRACKED_SQL}
select question_id, cast(episode as bigint) as episode, us + {25 * HOUR * 1_000_000} as us, cast(tokens as bigint) as tokens from tr
where live and kind = 'update' and (next_us - us > {25 * HOUR * 1_000_000} or next_us is null
  and (us + {25 * HOUR * 1_000_000}) // 1000 <= (select max(epoch_us(ts)) // 1000 from tele) - {30 * HOUR * 1000})""", "tele"))
def stream_stalls(spark, sf):
    """ST3: the alerts of the tracker - every silence of a live question
    longer than 25 h that a later row or the watermark reveals."""
    out = fresh_dir(spark, "tracker-out")
    run_in_slices(spark, fx.telemetry(spark, sf), _tele_conds(),
                  lambda read: TR.track_questions(read(), 8 * HOUR, stall_s=25 * HOUR, delay="30 hours", keep_s=24 * 3600 * HOUR), out)
    return spark.read.parquet(out).where("kind = 'stalled'").select("question_id", "episode", "us", "tokens")


@register("stream_sessions", with_views(f"""
with t as (select question_id, epoch_us(ts) as us, delta from tele),
l as (select *, case when us - lag(us) over (partition by question_id order by us) < {25 * HOUR * 1_000_000}
                     then 0 else 1 end as brk from t),
s as (select *, sum(brk) over (partition by question_id order by us rows between unbounded preceding and current row) as sid
      from l)
select question_id, min(us) as start_us, max(us) + {25 * HOUR * 1_000_000} as end_us, count(*) as events,
  cast(sum(delta) as bigint) as tokens
from s group by question_id, sid""", "tele"))
def stream_sessions(spark, sf):
    """ST9: activity sessions (a 25 h gap closes one) by session windows."""
    out = fresh_dir(spark, "sessions-out")
    run_in_slices(spark, fx.telemetry(spark, sf), _tele_conds(),
                  lambda read: TR.sessions(read(), gap="25 hours", delay="30 hours"), out, mode="complete")
    return spark.read.parquet(out)


@register("stream_dedup", with_views("select event_id, question_id, kind, delta from tele", "tele"))
def stream_dedup(spark, sf):
    """ST10: every telemetry row delivered twice (two sources over the same
    files); duplicates within the watermark delay are dropped."""
    out = fresh_dir(spark, "dedup-out")

    def build(read):
        both = read().unionByName(read())
        return TR.dedup_late(both, "event_id", delay="30 hours").select("event_id", "question_id", "kind", "delta")

    run_in_slices(spark, fx.telemetry(spark, sf), _tele_conds(), build, out)
    return spark.read.parquet(out)


@register("stream_live_board", with_views(f"""
with sc as (select r.model, q.category, case when {X.l2('r.model_outputs')} = q.answer then 1 else 0 end as hit
            from resp r join q on r.question_id = q.question_id)
select model, category, count(*) as finished, cast(sum(hit) as bigint) as success,
  count(*) - cast(sum(hit) as bigint) as wrong,
  coalesce(cast(sum(hit) as bigint) * 100.0::DOUBLE / nullif(count(*), 0), 0.0) as accuracy
from sc group by model, category""", "q", "resp"))
def stream_live_board(spark, sf):
    """ST8: responses arrive in three slices; the board is a streaming
    aggregation joined to the static question table."""
    out = fresh_dir(spark, "board-out")
    q = fx.questions(spark, sf)
    r = fx.responses(spark, sf, q).select("model", "question_id", "model_outputs")
    gold = q.select("question_id", "category", "answer", "answer_index", "options")

    def build(read):
        scored = S.score(read().join(gold, "question_id").withColumn("pred", extract("model_outputs", "l2")), "wrong")
        return live_board(scored)

    third = F.pmod(F.xxhash64("question_id"), F.lit(3))
    run_in_slices(spark, r, [third == i for i in range(3)],
                  build, out, mode="complete")
    return spark.read.parquet(out)


@register("stream_merge", with_views("""
with b as (select *, case when seq % 1000 = 1 then 1 when seq % 1000 = 2 then 2 else 3 end as batch from allsaved),
f as (select model, question_id, question, min(batch) as fb from b group by model, question_id, question),
g as (select b.model, b.question_id, b.question,
        max(b.seq) filter (where b.batch = f.fb) as pos,
        arg_max(struct_pack(category := b.category, answer := b.answer, pred := b.pred,
                            model_outputs := b.model_outputs), b.seq) as v
      from b join f on b.model = f.model and b.question_id = f.question_id and b.question = f.question
      group by b.model, b.question_id, b.question)
select pos as seq, model, question_id, question, v.category as category, v.answer as answer, v.pred as pred,
  v.model_outputs as model_outputs from g""", "allsaved"))
def stream_merge(spark, sf):
    """ST7: the saved results of all models arrive as first attempts, second
    attempts, then the rest, each as one file set and so one micro-batch of one
    stream, which starts again from its checkpoint after each; a replaced row
    keeps its position. The second batch ends in a compaction, on which the
    third one builds."""
    table, src, ck = fresh_dir(spark, "merged"), fresh_dir(spark, "saved-src"), fresh_dir(spark, "merge-ckpt")
    s, keys = fx.written(fx.all_saved(spark, sf), "all-saved"), ("model", "question_id", "question")
    att = F.col("seq") % 1000
    for i, cond in enumerate((att == 1, att == 2, att >= 3)):
        s.where(cond).write.parquet(f"{src}/s{i}")
        merge_sink(spark.readStream.schema(s.schema).parquet(f"{src}/*"), table, keys, checkpoint=ck, compact_after=1 if i == 1 else None)
    return read_merged(spark, table, s.schema, keys)


@register("read_categories", with_views("""
with size as (select category, count(*) as n from q where split = 'test' group by category),
big as (select category from size where n >= (select avg(n) from size))
select model, category, question_id, pred from res where category in (select category from big)""", "res"))
def read_categories_of_runs(spark, sf):
    """Result files of all models, written by category; those of the
    categories with at least the mean number of test questions are read back,
    pruned at run time by that table of categories."""
    base, res = fresh_dir(spark, "by-category"), fx.result_rows(spark, sf)
    write_results(res, base)
    size = fx.questions(spark, sf).where("split = 'test'").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    big = size.where(F.col("n") >= size.agg(F.avg("n")).scalar()).select("category")
    return read_categories(spark, base, big, res.schema).select("model", "category", "question_id", "pred")


@register("run_history", with_views("""
select model, 'CoT' as mode, 'all' as subjects, cast(count(*) as bigint) as n, cast(count(*) filter (where pred = answer) as bigint) as corr
from res group by model""", "res"))
def run_history(spark, sf):
    """One history row per model of the finished runs, appended by a run
    that is then retried, and read back: the retry replaces its own rows."""
    path = fresh_dir(spark, "history")
    rows = fx.result_rows(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("answer")).alias("corr"))
    rows = rows.select("model", F.lit("CoT").alias("mode"), F.lit("all").alias("subjects"), "n", "corr")
    for _ in range(2):
        append_history(rows, path, run_id="first")
    return read_history(spark, path, rows.schema)


@register("results_roundtrip", with_views(
    "select seq, question_id, question, options, answer, answer_index, cot_content, category, src, pred, model_outputs "
    "from res", "res"))
def results_roundtrip(spark, sf):
    """S6 + S2/S3: result rows written as a committed version of JSON lines
    partitioned by category, then read back (newest version)."""
    base = fresh_dir(spark, "results")
    res = fx.result_rows(spark, sf)
    write_results(res, base)
    back = read_results(spark, base)
    return back.select("seq", "question_id", "question", "options", "answer", "answer_index", "cot_content",
                       "category", "src", "pred", "model_outputs")


@register("resume_roundtrip", with_views("""
with f as (select * from saved qualify row_number() over (partition by question_id order by seq) = 1)
select q.question_id, case when f.question_id is null then 'pending' when f.pred = f.answer then 'success' else 'wrong' end as state
from q left join f on q.question_id = f.question_id where q.split = 'test'""", "saved"))
def resume_roundtrip(spark, sf):
    """S6 -> S3 -> J7 -> J3: an interrupted run's saved rows, written as
    result files, read back, and the run's state taken from them."""
    base = fresh_dir(spark, "resume")
    write_results(fx.saved_results(spark, sf), base)
    q = fx.questions(spark, sf).where("split = 'test'")
    return resume_plan(q, read_results(spark, base)).select("question_id", "state")


@register("stream_assemble", ORACLE["assemble_thinking"])
def stream_assemble(spark, sf):
    """ST6: chunks arrive in three slices of turns, a turn a minute; a request
    is emitted when it passes its budget or has been quiet for long. One chunk
    of another request, days later, ends the stream and is left out again."""
    from ..streaming.chunks import assemble_stream
    out = fresh_dir(spark, "assemble-out")
    seq, at = F.col("seq"), F.timestamp_seconds(F.lit(1704067200) + F.col("seq") * 60)
    c = fx.chunks(spark, sf).withColumn("et", at)
    end = (c.agg(F.max("et").alias("et")).select(F.lit(-1).cast("bigint").alias("request_id"), F.lit(0).cast("int").alias("seq"),
           F.lit("").alias("reasoning"), F.lit("").alias("content"), F.lit(None).cast("bigint").alias("usage_total_tokens"),
           (F.col("et") + F.expr("interval 9 days")).alias("et")))
    all_chunks = c.unionByName(end.withColumn("seq", F.col("seq").cast(c.schema["seq"].dataType)))
    real, last = F.col("request_id") >= 0, F.col("request_id") < 0
    run_in_slices(spark, all_chunks, [real & (seq <= 2), real & (seq > 2) & (seq <= 5), real & (seq > 5), last],
                  lambda read: assemble_stream(read(), 0, 300, True, delay="1 day", quiet=3600), out)
    return spark.read.parquet(out).where("request_id >= 0")


QUESTION_STATE_SQL = with_views(f"""
with rr as ({ORACLE["rolling_rate"]}),
t as (select rr.*, epoch_us(tele.ts) as us from rr join tele on rr.event_id = tele.event_id),
g as (select question_id,
        arg_max(struct_pack(episode := episode, tokens := tokens, rate := rate), struct_pack(us := us, e := event_id)) as l,
        arg_max(case when kind = 'reset' then 'active' else kind end, struct_pack(us := us, e := event_id))
          filter (where kind not in ('update', 'count')) as st,
        count(*) filter (where kind = 'reset') as resets
      from t group by question_id)
select question_id, l.episode as episode, l.tokens as tokens, l.rate as rate, coalesce(st, 'pending') as status,
  cast(greatest(resets - 1, 0) as bigint) as retries from g""", "tele")


@register("question_state", QUESTION_STATE_SQL)
def question_state(spark, sf):
    """ST1 / ST5 batch twin: latest state per question."""
    from ..operators.telemetry import question_state as qs
    return qs(fx.telemetry(spark, sf), window_s=8 * HOUR)


@register("stream_question_state", QUESTION_STATE_SQL)
def stream_question_state(spark, sf):
    """ST1 / ST5: latest tracker state per question after the stream."""
    out = fresh_dir(spark, "tracker-out")
    run_in_slices(spark, fx.telemetry(spark, sf), _tele_conds(),
                  lambda read: TR.track_questions(read(), 8 * HOUR, stall_s=25 * HOUR, delay="30 hours", keep_s=24 * 3600 * HOUR), out)
    return TR.latest_state(spark.read.parquet(out))


SLIDE_US = HOUR * 1_000_000
SIZE_SLIDES = 8


@register("stream_throughput", with_views(f"""
with t as (select question_id, epoch_us(ts) as us, delta from tele),
w as (select question_id, delta, (us // {SLIDE_US} - k) * {SLIDE_US} as start_us
      from t, range(0, {SIZE_SLIDES}) r(k))
select question_id, start_us, cast(sum(delta) as bigint) as tokens, count(*) as events
from w group by question_id, start_us""", "tele"))
def stream_throughput(spark, sf):
    """ST9: tokens per question in sliding 8 h windows moving by 1 h
    (8 s / 1 s in the live view) over the telemetry stream."""
    out = fresh_dir(spark, "throughput-out")
    run_in_slices(spark, fx.telemetry(spark, sf), _tele_conds(),
                  lambda read: TR.throughput_windows(read(), size="8 hours", slide="1 hour", delay="30 hours"),
                  out, mode="complete")
    return spark.read.parquet(out)


@register("live_totals", with_views(f"""
with qs as ({QUESTION_STATE_SQL}),
sp as (select (max(epoch_us(ts)) - min(epoch_us(ts)))::DOUBLE / 1000000.0 as elapsed_s from tele)
select count(*) as questions, count(*) filter (where status = 'active') as active,
  count(*) filter (where status = 'success') as success, count(*) filter (where status = 'wrong') as wrong,
  cast(sum(tokens) as bigint) as tokens_total,
  round(coalesce(sum(rate) filter (where status = 'active'), 0.0), 6) as rate_total,
  any_value(sp.elapsed_s) as elapsed_s,
  coalesce((count(*) filter (where status = 'success')) * 100.0::DOUBLE
           / nullif(count(*) filter (where status in ('success', 'wrong')), 0), 0.0) as accuracy
from qs, sp""", "tele"))
def live_totals(spark, sf):
    """The live header - counts by status, token and rate totals,
    elapsed time, live accuracy."""
    from ..operators.telemetry import live_totals as lt
    return lt(fx.telemetry(spark, sf), window_s=8 * HOUR)


@register("throughput_windows", ORACLE["stream_throughput"])
def throughput_windows(spark, sf):
    """ST9 batch twin: sliding 8 h / 1 h windows of tokens per question."""
    from ..operators.telemetry import throughput
    return throughput(fx.telemetry(spark, sf), size_s=8 * HOUR, slide_s=HOUR)
