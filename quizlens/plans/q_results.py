"""Registered queries: cleaning, selection, resume / cache / merge / dedup,
shards, attempts and result statistics (P*, J2-J4, J7, U*, A4, A9-A12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.extract import extract
from ..functions.text import output_status, run_key
from ..operators import clean as C
from ..operators import resume as R
from ..operators import score as S
from ..sources import fixtures as fx
from ..sources.array_files import file_label, write_result_files
from ..sources.results import RESULT_SCHEMA, fresh_dir, read_result_files, read_shards, write_results
from . import sqlparts as X
from .fixture_sql import with_views
from .registry import register


def _q(spark, sf):
    return fx.questions(spark, sf)


def _test(spark, sf):
    return _q(spark, sf).where(F.col("split") == "test")


def _exemplars(spark, sf):
    return _q(spark, sf).where(F.col("split") == "validation")


# ---------------------------------------------------------------- P*
@register("clean_options", with_views(
    "select question_id, list_filter(options, lambda o: o is distinct from 'N/A') as options from q", "q"))
def clean_options(spark, sf):
    return C.clean_options(_q(spark, sf)).select("question_id", "options")


@register("select_category", with_views(
    "select question_id, category, split from q where category = 'STANDARD'", "q"))
def select_category(spark, sf):
    return C.select_category(_q(spark, sf), "STANDARD").select("question_id", "category", "split")


@register("subjects_exact", with_views(
    "select question_id, category from q where split = 'test' and category in ('SMALL', 'PROMO')", "q"))
def subjects_exact(spark, sf):
    return C.select_subjects(_test(spark, sf), "SMALL,PROMO").select("question_id", "category")


@register("subjects_fuzzy", with_views("""
select question_id, category from q
where split = 'test' and (contains(replace(category, ' ', '_'), 'ALL')
   or contains(replace(category, ' ', '_'), 'ECONOMY') or contains(replace(category, ' ', '_'), 'SMALL'))""", "q"))
def subjects_fuzzy(spark, sf):
    # "ALL" also matches SMALL, which "SMALL" matches again: listed once
    return C.select_subjects(_test(spark, sf), "ALL,ECONOMY,SMALL", match="substring") \
        .select("question_id", "category")


@register("categories_first_seen", with_views("""
select category, min(question_id) as first_seq, count(*) as n from q where split = 'test'
group by category""", "q"))
def categories_first_seen(spark, sf):
    return C.categories_first_seen(_test(spark, sf))


_RES_COLS = ("question_id, coalesce(category, 'Unknown') as category, coalesce(question, 'No question text') as question, "
             "coalesce(options, []::VARCHAR[]) as options, coalesce(answer, 'Unknown') as answer, "
             "coalesce(pred, 'Unknown') as pred, coalesce(answer_index, 0) as answer_index, "
             "coalesce(cot_content, '') as cot_content, coalesce(model_outputs, '') as model_outputs, "
             "coalesce(src, 'Unknown') as src, seq, model")
FILLED_SQL = f"filled as (select {_RES_COLS} from res)"


@register("fill_defaults", with_views(f"with {FILLED_SQL} select * from filled", "res"))
def fill_defaults(spark, sf):
    return C.fill_defaults(fx.result_rows(spark, sf))


@register("wrong_answers", with_views(f"""
with {FILLED_SQL} select model, question_id, category, answer, pred, seq from filled where answer <> pred""", "res"))
def wrong_answers(spark, sf):
    return C.wrong_answers(fx.result_rows(spark, sf)).select("model", "question_id", "category", "answer", "pred", "seq")


FIND_ID = "18"


@register("find_by_id", with_views(f"""
with {FILLED_SQL}
select question_id, category, answer, pred, seq from filled
where answer <> pred and lower(cast(question_id as varchar)) = '{FIND_ID}'
order by seq limit 1""", "res"))
def find_by_id(spark, sf):
    w = C.wrong_answers(fx.result_rows(spark, sf))
    return C.find_by_id(w, FIND_ID).select("question_id", "category", "answer", "pred", "seq")


@register("rerun_candidates", with_views("""
select question_id,
  max(case when model_outputs = 'MaxTokensExceeded' then 1 else 0 end) as max_tokens,
  max(case when pred is null and model_outputs is distinct from 'MaxTokensExceeded' then 1 else 0 end) as unknown
from saved
where model_outputs is not distinct from 'MaxTokensExceeded'
   or (pred is null and model_outputs is distinct from 'MaxTokensExceeded')
group by question_id""", "saved"))
def rerun_candidates(spark, sf):
    return R.rerun_candidates(fx.saved_results(spark, sf))


@register("status_of_output", with_views(f"""
select model, {X.status('model_outputs')} as status, count(*) as n from resp group by all""", "q", "resp"))
def status_of_output(spark, sf):
    r = fx.responses(spark, sf)
    return r.groupBy("model", output_status("model_outputs").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@register("letter_index", with_views("""
select question_id, answer, answer_index,
  case when answer_index between 0 and 9 then substr('ABCDEFGHIJ', answer_index + 1, 1) end as answer_letter,
  case when length(answer) = 1 and position(answer in 'ABCDEFGHIJ') > 0
       then cast(position(answer in 'ABCDEFGHIJ') - 1 as int) end as letter_index
from q""", "q"))
def letter_index(spark, sf):
    return C.with_letters(_q(spark, sf)).select("question_id", "answer", "answer_index",
                                                "answer_letter", "letter_index")


@register("run_key", with_views("""
with m as (
  select 'org/' || r.model as model_path,
    array_to_string(list_sort(list_distinct(list(q.category))), ',') as subjects
  from resp r join q on r.question_id = q.question_id group by r.model)
select model_path, subjects,
  concat_ws('/', string_split(model_path, '/')[-1], 'CoT', replace(replace(subjects, ',', '-'), ' ', '_')) as result_dir,
  concat_ws('-', string_split(model_path, '/')[-1], 'CoT', replace(replace(subjects, ',', '-'), ' ', '_')) as file_prefix
from m""", "q", "resp"))
def run_key_q(spark, sf):
    q = _q(spark, sf)
    m = (fx.responses(spark, sf, q, gold=("category",))
         .groupBy(F.concat(F.lit("org/"), F.col("model")).alias("model_path"))
         .agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("subjects")))
    return m.select("model_path", "subjects", run_key("model_path", "subjects", "/").alias("result_dir"),
                    run_key("model_path", "subjects", "-").alias("file_prefix"))


# ---------------------------------------------------------------- J2-J4, J7
@register("cache_lookup", with_views(f"""
with first as (
  select question_id, question, model_outputs from saved
  qualify row_number() over (partition by question_id, question order by seq) = 1)
select t.question_id, f.model_outputs is not null as cached, {X.l2('f.model_outputs')} as pred
from q t left join first f on t.question_id = f.question_id and t.question = f.question
where t.split = 'test'""", "saved"))
def cache_lookup(spark, sf):
    return R.lookup_cached(_test(spark, sf), fx.saved_results(spark, sf)) \
        .select("question_id", "cached", "pred")


@register("pending_set", with_views("""
select question_id from q where split = 'test'
  and question_id not in (select question_id from saved)""", "saved"))
def pending_set(spark, sf):
    return R.pending(_test(spark, sf), fx.saved_results(spark, sf)).select("question_id")


@register("pending_rerun", with_views("""
select question_id from q where split = 'test' and (
  question_id not in (select question_id from saved)
  or question_id in (select question_id from saved where model_outputs = 'MaxTokensExceeded'
                     or (pred is null and model_outputs is distinct from 'MaxTokensExceeded')))""", "saved"))
def pending_rerun(spark, sf):
    return R.pending(_test(spark, sf), fx.saved_results(spark, sf), True, True).select("question_id")


def _new_run(spark, sf):
    """A later run (``model_1``): every answered question, re-extracted."""
    q = _q(spark, sf)
    r = fx.responses(spark, sf, q).where((F.col("model") == "model_1") & F.col("model_outputs").isNotNull())
    return (r.join(q.select("question_id", "question", "category", "answer"), "question_id")
             .select((F.lit(1_000_000_000) + F.col("question_id") * 1000 + F.col("attempt_mq")).alias("seq"),
                     "question_id", "question", "category", "answer",
                     extract("model_outputs", "l1").alias("pred"), "model_outputs"))


NEW_RUN_SQL = f"""
new as (
  select 1000000000 + r.question_id * 1000 + r.attempt_mq as seq, r.question_id, q.question, q.category, q.answer,
    {X.l1('r.model_outputs')} as pred, r.model_outputs
  from resp r join q on r.question_id = q.question_id
  where r.model = 'model_1' and r.model_outputs is not null),
upd as (select * from new qualify row_number() over (partition by question_id, question order by seq desc) = 1)"""


def _merge_sql(first: bool) -> str:
    cond = "and o.seq = f.min_seq" if first else ""
    fjoin = ("join (select question_id, question, min(seq) as min_seq from saved group by all) f "
             "on o.question_id = f.question_id and o.question = f.question") if first else ""
    pick = ", ".join(f"case when u.question_id is not null then u.{c} else o.{c} end as {c}"
                     for c in ("category", "answer", "pred", "model_outputs"))
    return with_views(f"""
with {NEW_RUN_SQL},
kept as (
  select o.seq, o.question_id, o.question, {pick}
  from saved o {fjoin}
  left join upd u on o.question_id = u.question_id and o.question = u.question {cond}),
appended as (
  select u.seq, u.question_id, u.question, u.category, u.answer, u.pred, u.model_outputs
  from upd u where not exists (select 1 from saved o where o.question_id = u.question_id and o.question = u.question))
select * from kept union all select * from appended""", "saved")


@register("merge_results", _merge_sql(False))
def merge_results(spark, sf):
    return R.merge(fx.saved_results(spark, sf), _new_run(spark, sf), mode="all")


@register("merge_first", _merge_sql(True))
def merge_first(spark, sf):
    return R.merge(fx.saved_results(spark, sf), _new_run(spark, sf), mode="first")


@register("dedup_first", with_views("""
select * from allsaved qualify row_number() over (partition by model, question_id order by seq) = 1""", "allsaved"))
def dedup_first(spark, sf):
    return R.dedup_first(fx.all_saved(spark, sf), ("model", "question_id"), "seq")


# ---------------------------------------------------------------- U3, U4
SHARDS = 50


@register("shard_assign", with_views(f"""
select question_id, cast(((question_id % {SHARDS}) + {SHARDS}) % {SHARDS} as int) as shard
from q where split = 'test'""", "q"))
def shard_assign(spark, sf):
    return R.assign_shard(_test(spark, sf).select("question_id"), SHARDS)


@register("shard_coverage", with_views(f"""
with e as (select distinct question_id, cast(((question_id % {SHARDS}) + {SHARDS}) % {SHARDS} as int) as shard
           from q where split = 'test'),
p as (select distinct question_id, 1 as present from saved)
select shard, count(*) as expected, count(p.present) as present,
  count(*) filter (where p.present is null) as missing,
  cast(count(*) filter (where p.present is null) = 0 as int) as complete
from e left join p on e.question_id = p.question_id group by shard""", "saved"))
def shard_coverage(spark, sf):
    return R.shard_coverage(_test(spark, sf), fx.saved_results(spark, sf), SHARDS)


# ---------------------------------------------------------------- S2-S4, U4: files
IDS_PER_FILE = 5000


@register("score_result_files", with_views(f"""
with x as (select model || '/' || category || '/' || cast(question_id // {IDS_PER_FILE} as varchar) as file, model, question_id, answer, answer_index, options,
             {X.l1('model_outputs')} as p1, {X.l2('model_outputs')} as p2 from res),
long as (
  select file, 'l1' as level, {X.credit('uniform10', pred='p1', seed='12345:l1', keys=('question_id',))} as credit from x
  union all
  select file, 'l2' as level, {X.credit('uniform10', pred='p2', seed='12345:l2', keys=('question_id',))} as credit from x)
select file, level, count(*) filter (where credit > 0) as succ, count(*) filter (where credit = 0) as fail,
  (count(*) filter (where credit > 0))::DOUBLE / count(*) as acc
from long group by file, level""", "res"))
def score_result_files(spark, sf):
    """All runs written as array files, read again in byte ranges
    and scored file by file at both levels."""
    path = fresh_dir(spark, "array-files")
    write_result_files(fx.result_rows(spark, sf), path, F.floor(F.col("question_id") / IDS_PER_FILE))
    good, _ = read_result_files(spark, path)
    good = good.withColumn("file", file_label(F.col("file_path")))
    return S.per_file_accuracy(good, by=("file",))


@register("quarantined_files", with_views(f"""
select model || '/' || category || '/' || cast(question_id // {IDS_PER_FILE} as varchar) as file, 'does not fit the schema' as reason,
  row_number() over (partition by model, category, question_id // {IDS_PER_FILE} order by seq) - 1 as seq
from res qualify question_id % 7 = 0""", "res"))
def quarantined_files(spark, sf):
    """S3: rows whose question id is a text that is no number go to quarantine, each alone."""
    path = fresh_dir(spark, "array-files")
    rows = fx.result_rows(spark, sf)
    line = F.to_json(F.struct(*rows.columns))
    odd = F.regexp_replace(line, r'"question_id":(\d+)', '"question_id":"q$1"')
    write_result_files(rows, path, F.floor(F.col("question_id") / IDS_PER_FILE), line=F.when(F.col("question_id") % 7 == 0, odd).otherwise(line))
    _, bad = read_result_files(spark, path)
    return bad.select(file_label(F.col("file_path")).alias("file"), "reason", "seq")


PROCESSES = 8


@register("read_shards", with_views(f"""
with s as (select *, cast(question_id % {PROCESSES} as int) as shard from saved),
e as (select distinct question_id, cast(question_id % {PROCESSES} as int) as shard from q where split = 'test'),
p as (select distinct question_id from s where shard not in (1, 2))
select e.shard, case e.shard when 1 then 'absent' when 2 then 'started' else 'committed' end as state,
  count(*) as expected, count(p.question_id) as present, count(*) - count(p.question_id) as missing
from e left join p on e.question_id = p.question_id group by e.shard""", "q", "saved"))
def read_shards_q(spark, sf):
    """U4, S3: shards of a run as they finish: one is absent, one has written
    rows but no commit; coverage is by what is committed."""
    base = fresh_dir(spark, "shards")
    saved = R.assign_shard(fx.saved_results(spark, sf), PROCESSES)
    for i in range(PROCESSES):
        own = saved.where(F.col("shard") == i).drop("shard")
        if i == 2:
            own.withColumn("_category", F.col("category")).write.partitionBy("_category").json(f"{base}/shard={i}/data/v=000000001-unfinished")
        elif i != 1:
            write_results(own, f"{base}/shard={i}")
    rows, states = read_shards(spark, base, PROCESSES, RESULT_SCHEMA)
    done = R.shard_coverage(_test(spark, sf), R.merge_shards([rows]), PROCESSES)
    return done.join(states, "shard").select("shard", "state", "expected", "present", "missing")


# ---------------------------------------------------------------- A9-A12, A4
def _scored_resp(spark, sf):
    q = C.clean_options(_q(spark, sf))
    r = fx.responses(spark, sf, q, gold=S.GOLD_COLUMNS)
    r = r.withColumn("model_outputs", F.when(F.col("tokens") % 40 == 7, "Killed by user").otherwise(F.col("model_outputs")))
    return S.score(S.with_prediction(S.attach_gold(r, q)), "wrong")


RETRY_WRONG, RETRY = 2, 2
# In words: answers (rows that are neither failed calls nor max-token aborts)
# number the answer attempts; the sequence ends at the first right answer or
# kill, at the RETRY-th max-token row of one answer attempt, or at the last allowed wrong
# answer.
RUNS_SQL = f"""
o as (select * replace (case when tokens % 40 = 7 then 'Killed by user' else model_outputs end as model_outputs) from resp),
s as (
  select r.model, r.question_id, r.attempt_mq as pos, r.model_outputs as mo, {X.l2('r.model_outputs')} as pred, q.answer
  from o r join q on r.question_id = q.question_id),
k as (select *, mo = 'MaxTokensExceeded' as full_, mo = 'Killed by user' as killed,
        mo is not null and mo not in ('MaxTokensExceeded', 'Killed by user') as answered,
        coalesce(mo not in ('MaxTokensExceeded', 'Killed by user') and pred = answer, false) as hit from s),
n as (select *, coalesce(count(*) filter (where answered) over (partition by model, question_id order by pos
        rows between unbounded preceding and 1 preceding), 0) as tries from k),
m as (select *, count(*) filter (where full_) over (partition by model, question_id, tries order by pos) as run from n),
e as (select model, question_id, min(pos) filter (where hit or killed or (full_ and run >= {RETRY}) or (answered and not hit and tries >= {RETRY_WRONG})) as fin
      from m group by model, question_id),
u as (select m.*, e.fin from m join e on m.model = e.model and m.question_id = e.question_id where e.fin is null or m.pos <= e.fin)"""


@register("best_of_n", with_views(f"""
with {RUNS_SQL},
g as (select model, question_id, count(*) as n_attempts,
        coalesce(any_value(fin), max(pos) filter (where answered), max(pos)) as final_attempt from u group by model, question_id)
select g.model, g.question_id, n_attempts, final_attempt, case when u.answered then u.pred end as final_pred,
  {X.status('u.mo')} as final_status, cast(u.hit as int) as correct
from g join u on g.model = u.model and g.question_id = u.question_id and g.final_attempt = u.pos""", "q", "resp"))
def best_of_n(spark, sf):
    return S.best_of_n(_scored_resp(spark, sf), RETRY_WRONG, RETRY)


@register("attempt_accounting", with_views(f"""
with {RUNS_SQL}
select model, question_id, count(*) as attempts, count(*) filter (where full_) as max_token_attempts,
  coalesce(max(cast(full_ and run >= {RETRY} as int)), 0) as aborted,
  cast(coalesce(sum(least(pow(2, run), 30)) filter (where full_ and run < {RETRY}), 0) as bigint) as wait_seconds
from u group by model, question_id""", "q", "resp"))
def attempt_accounting(spark, sf):
    return S.attempt_accounting(_scored_resp(spark, sf), RETRY_WRONG, RETRY)


@register("resume_plan", with_views("""
with f as (select * from saved qualify row_number() over (partition by question_id order by seq) = 1),
again as (select question_id from saved where model_outputs = 'MaxTokensExceeded' group by question_id)
select q.question_id, case when f.question_id is null or a.question_id is not null then 'pending'
  when f.pred = f.answer then 'success' else 'wrong' end as state
from q left join f on q.question_id = f.question_id left join again a on q.question_id = a.question_id
where q.split = 'test'""", "saved"))
def resume_plan(spark, sf):
    """Every question with its state when the run goes on."""
    return R.resume_plan(_test(spark, sf), fx.saved_results(spark, sf), rerun_max_tokens=True).select("question_id", "state")


@register("shard_merge", with_views("""
select * from allsaved qualify row_number() over (partition by model, question_id order by seq) = 1""", "allsaved"))
def shard_merge(spark, sf):
    """U1 + U4: results of shards, of which each question's shard wrote some
    rows and another one wrote some again, merged into one table."""
    s = R.assign_shard(fx.written(fx.all_saved(spark, sf), "all-saved"), 2)
    parts = [s.where(F.col("shard") == i).drop("shard") for i in range(2)]
    again = parts[0].where("seq % 2 = 0").select(*reversed(parts[0].columns))
    return R.merge_shards([*parts, again], ("model", "question_id"), n_tasks=fx.tasks(spark, sf))


@register("categories_union", with_views("""
select category, count(*) as n, min(question_id) as first_seq from q group by category""", "q"))
def categories_union(spark, sf):
    """U1 + P6: the splits put together, and the categories of the whole."""
    return C.categories_first_seen(R.union_all([_test(spark, sf), _exemplars(spark, sf)]))


@register("call_times", with_views("""
with c as (select model, tokens, tokens / 1000.0::DOUBLE as seconds from resp)
select model, count(*) as calls, round(sum(seconds), 6) as seconds, round(avg(seconds), 9) as mean_seconds, max(seconds) as max_seconds,
  round(sum(tokens) / sum(seconds), 6) as tokens_per_second from c group by model""", "q", "resp"))
def call_times(spark, sf):
    """Time statistics of calls (here a millisecond a token)."""
    c = fx.responses(spark, sf).select("model", "tokens", (F.col("tokens") / 1000.0).alias("seconds"))
    t = S.batch_times(c)
    return t.select("model", "calls", F.round("seconds", 6).alias("seconds"), F.round("mean_seconds", 9).alias("mean_seconds"), "max_seconds",
                    F.round("tokens_per_second", 6).alias("tokens_per_second"))


@register("status_counts", with_views("""
with f as (select * from saved qualify row_number() over (partition by question_id order by seq) = 1),
j as (select t.question_id, t.answer, t.category, r.pred as rp, r.question_id is not null as done
      from q t left join f r on t.question_id = r.question_id where t.split = 'test'),
g as (select category, count(*) as total,
        count(*) filter (where done and rp = answer) as success,
        count(*) filter (where done and (rp is null or rp <> answer)) as wrong
      from j group by category)
select category, total, success, wrong, total - success - wrong as pending,
  coalesce(success * 100.0::DOUBLE / nullif(success + wrong, 0), 0.0) as accuracy from g""", "saved"))
def status_counts(spark, sf):
    done = R.dedup_first(fx.saved_results(spark, sf), "question_id", "seq")
    return S.status_counts(_test(spark, sf), done)


@register("token_totals", with_views("""
select model, count(*) as requests, cast(sum(tokens) as bigint) as total_tokens, avg(tokens) as avg_tokens,
  min(tokens) as min_tokens, max(tokens) as max_tokens from resp group by model""", "q", "resp"))
def token_totals(spark, sf):
    return S.token_totals(fx.responses(spark, sf))


@register("token_quantiles", with_views("""
select model, count(tokens) as n, true as p50_within, true as p95_within from resp group by model""", "q", "resp"))
def token_quantiles(spark, sf):
    """Quantile sketches of every shard's token counts are stored, read back
    and merged per model; whether the exact rank of each merged quantile is within
    1 % of the asked one (the values themselves are approximate)."""
    path, r = fresh_dir(spark, "sketches"), fx.responses(spark, sf).select("model", "question_id", "tokens")
    S.quantile_sketches(R.assign_shard(r, 8), "tokens", ("model", "shard")).write.parquet(path)
    m = S.merged_quantiles(spark.read.parquet(path))
    shares = []
    for c in ("p50", "p95"):
        shares += [F.sum((F.col("tokens") < F.col(c)).cast("int")).alias(c + "_below"), F.sum((F.col("tokens") <= F.col(c)).cast("int")).alias(c + "_upto")]
    g = r.join(m, "model").groupBy("model", "n").agg(*shares)
    within = lambda c, p: (F.col(c + "_below") <= (p + 0.01) * F.col("n")) & (F.col(c + "_upto") >= (p - 0.01) * F.col("n"))
    return g.select("model", "n", within("p50", 0.5).alias("p50_within"), within("p95", 0.95).alias("p95_within"))


@register("wrong_stats", with_views(f"""
with {FILLED_SQL},
g as (select category, count(*) as total, count(*) filter (where answer is distinct from pred) as wrong
      from filled group by category
      union all
      select 'ALL', count(*), count(*) filter (where answer is distinct from pred) from filled)
select category, total, wrong, coalesce((total - wrong) * 100.0::DOUBLE / nullif(total, 0), 0.0) as accuracy
from g""", "res"))
def wrong_stats(spark, sf):
    return S.wrong_stats(C.fill_defaults(fx.result_rows(spark, sf)))
