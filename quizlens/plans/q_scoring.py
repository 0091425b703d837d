"""Registered queries: extraction, scoring and aggregation (E*, J5, A*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.extract import extract, register_extractor
from ..operators import clean as C
from ..operators import score as S
from ..operators.resume import dedup_first
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import sqlparts as X
from .fixture_sql import with_views
from .registry import register

SCORED_SQL = """
sc as (
  select r.model, r.style_id, r.mode, r.question_id, r.attempt, r.attempt_mq, r.model_outputs,
    q.category, q.answer, q.answer_index, q.n_opts, list_filter(q.options, lambda o: o is distinct from 'N/A') as options, {pred} as pred
  from resp r join q on r.question_id = q.question_id),
s as (select *, {credit} as credit from sc)"""


def _scored_sql(policy="wrong", pred=None):
    return SCORED_SQL.format(pred=pred or X.l2("r.model_outputs"), credit=X.credit(policy, keys=S.DRAW_KEYS))


def _scored(spark, sf, policy="wrong", cascade="l2", gold=S.GOLD_COLUMNS):
    q = C.clean_options(fx.questions(spark, sf))
    r = fx.responses(spark, sf, q, gold=gold)
    return S.score(S.with_prediction(S.attach_gold(r, q), cascade), policy)


# ---------------------------------------------------------------- flagship
@register("leaderboard_by_category", with_views(f"""
with x as (
  select r.model, q.category, q.answer, {X.l1('r.model_outputs')} as pred_l1,
         {X.l2('r.model_outputs')} as pred
  from resp r join q on r.question_id = q.question_id),
g as (
  select model, category, count(*) as n,
    cast(sum(case when pred = answer then 1 else 0 end) as bigint) as corr,
    count(*) filter (where pred_l1 = answer) as l1_corr,
    count(*) filter (where pred_l1 is null) as l1_null,
    count(*) filter (where pred is null) as l2_null
  from x group by model, category)
select model, category, n, corr, l1_corr, l1_null, l2_null, n - corr as wrong,
  corr::DOUBLE / n as acc,
  cast(rank() over (partition by category order by corr::DOUBLE / n desc) as bigint) as rank_in_category
from g""", "q", "resp"))
def leaderboard_by_category(spark, sf):
    q = fx.questions(spark, sf)
    return S.leaderboard_by_category(fx.responses(spark, sf, q, gold=S.GOLD_COLUMNS), q)


# ---------------------------------------------------------------- extraction
def _resp_extract(cascade):
    def fn(spark, sf):
        r = fx.responses(spark, sf)
        return r.select("model", "style_id", "question_id", "attempt",
                        extract("model_outputs", cascade).alias("pred"))
    return fn


for _name, _sql in (("l1", X.l1), ("l2", X.l2), ("last", X.last_cascade),
                    ("again", X.again), ("final", X.final)):
    register(f"extract_{_name}", with_views(
        f"select model, style_id, question_id, attempt, {_sql('model_outputs')} as pred from resp",
        "q", "resp"))(_resp_extract(_name))


@register("extract_docs", f"""
select doc_id, {X.l1('text')} as pred_l1, {X.again('text')} as pred_again,
  {X.final('text')} as pred_final, {X.l2('text')} as pred_l2, {X.last_cascade('text')} as pred_last
from documents""")
def extract_docs(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "text")
    t = F.col("text")
    return d.select("doc_id", extract(t, "l1").alias("pred_l1"), extract(t, "again").alias("pred_again"),
                    extract(t, "final").alias("pred_final"), extract(t, "l2").alias("pred_l2"),
                    extract(t, "last").alias("pred_last"))


@register("extract_conversations", f"""
select conv_id, turn, {X.l2('text')} as pred_l2, {X.last_cascade('text')} as pred_last
from conversations""")
def extract_conversations(spark, sf):
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", extract("text", "l2").alias("pred_l2"),
                    extract("text", "last").alias("pred_last"))


@register("extract_benchmark", f"""
select item_id, {X.l2('text')} as pred_l2, {X.last_cascade('text')} as pred_last from benchmark""")
def extract_benchmark(spark, sf):
    b = read_table(spark, sf, "benchmark", "item_id", "text")
    return b.select("item_id", extract("text", "l2").alias("pred_l2"),
                    extract("text", "last").alias("pred_last"))


# a user cascade given as data - an explicit "choice" cue, else the last
# parenthesised letter.
CUSTOM_STEPS = [(r"(?i)choice: ?\(?([A-J])\)?", 1, "first"), (r"\(([A-J])\)", 1, "last")]


@register("custom_extractor", with_views(f"""
select model, style_id, question_id, attempt,
  coalesce({X.first('model_outputs', CUSTOM_STEPS[0][0])}, {X.last('model_outputs', CUSTOM_STEPS[1][0])}) as pred
from resp""", "q", "resp"))
def custom_extractor(spark, sf):
    register_extractor("choice_then_paren", CUSTOM_STEPS)
    r = fx.responses(spark, sf)
    return r.select("model", "style_id", "question_id", "attempt",
                    extract("model_outputs", "choice_then_paren").alias("pred"))


# ---------------------------------------------------------------- summaries
def _summary_sql(policy):
    frac = policy.startswith("expected")
    corr = ("sum(credit)::DOUBLE / 720720" if frac else "cast(sum(case when credit = 720720 then 1 else 0 end) as bigint)")
    return with_views(f"""
with {_scored_sql(policy)},
g as (
  select model, category, count(*) as n, {corr} as corr from s group by model, category
  union all
  select model, 'total' as category, count(*) as n, {corr} as corr from s group by model)
select model, category, n, corr, n - corr as wrong, corr::DOUBLE / n as acc from g""", "q", "resp")


@register("summary_rollup", _summary_sql("wrong"))
def summary_rollup(spark, sf):
    return S.summary(_scored(spark, sf, "wrong"), ("model", "category"), "wrong")


for _p in ("uniform10", "uniform_options", "expected10", "expected_options", "unknown"):
    def _mk(p):
        def fn(spark, sf):
            return S.summary(_scored(spark, sf, p), ("model", "category"), p)
        return fn
    register(f"policy_{_p}", _summary_sql(_p))(_mk(_p))


@register("leaderboard", with_views(f"""
with {_scored_sql()},
g as (select model, count(*) as n, cast(sum(case when credit = 720720 then 1 else 0 end) as bigint) as corr
      from s group by model)
select model, n, corr, corr::DOUBLE / n as acc,
  cast(rank() over (order by corr::DOUBLE / n desc) as bigint) as rank from g""", "q", "resp"))
def leaderboard(spark, sf):
    return S.leaderboard(_scored(spark, sf))


@register("extractor_compare", with_views(f"""
with x as (
  select r.model, q.answer, {X.l1('r.model_outputs')} as pa, {X.l2('r.model_outputs')} as pb
  from resp r join q on r.question_id = q.question_id)
select model, count(*) as n,
  count(*) filter (where pa = answer) as l1_corr,
  count(*) filter (where pb = answer) as l2_corr,
  count(*) filter (where pa is null) as l1_null,
  count(*) filter (where pb is null) as l2_null,
  count(*) filter (where pa is not distinct from pb) as agree,
  count(*) filter (where coalesce(pa = answer, false) and not coalesce(pb = answer, false)) as flip_to_wrong,
  count(*) filter (where not coalesce(pa = answer, false) and coalesce(pb = answer, false)) as flip_to_right
from x group by model""", "q", "resp"))
def extractor_compare(spark, sf):
    q = fx.questions(spark, sf)
    return S.extractor_compare(fx.responses(spark, sf, q, gold=("category", "answer")))


@register("per_file_accuracy", with_views(f"""
with x as (
  select r.model, q.category, r.question_id, r.style_id, r.attempt, q.answer, q.answer_index, q.options,
         {X.l1('r.model_outputs')} as p1, {X.l2('r.model_outputs')} as p2
  from resp r join q on r.question_id = q.question_id),
long as (
  select model, category, 'l1' as level, {X.credit('uniform10', pred='p1', seed='12345:l1', keys=S.DRAW_KEYS)} as credit from x
  union all
  select model, category, 'l2' as level, {X.credit('uniform10', pred='p2', seed='12345:l2', keys=S.DRAW_KEYS)} as credit from x)
select model, category, level, count(*) filter (where credit > 0) as succ,
  count(*) filter (where credit = 0) as fail,
  (count(*) filter (where credit > 0))::DOUBLE / count(*) as acc
from long group by model, category, level""", "q", "resp"))
def per_file_accuracy(spark, sf):
    q = fx.questions(spark, sf)
    return S.per_file_accuracy(fx.responses(spark, sf, q, gold=S.GOLD_COLUMNS))


@register("style_sensitivity", with_views(f"""
with {_scored_sql()},
per as (select model, style_id, cast(sum(case when credit = 720720 then 1 else 0 end) as bigint)::DOUBLE / count(*) as acc
        from s group by model, style_id)
select model, count(*) as n_styles, min(acc) as min_acc, max(acc) as max_acc,
  max(acc) - min(acc) as spread, round(stddev_samp(acc), 6) as stddev_acc
from per group by model""", "q", "resp"))
def style_sensitivity(spark, sf):
    return S.style_sensitivity(_scored(spark, sf))


@register("mode_delta", with_views(f"""
with {_scored_sql()},
p as (select model,
  sum(case when mode = 'cot' and credit = 720720 then 1 else 0 end)::DOUBLE / nullif(count(*) filter (where mode = 'cot'), 0) as acc_cot,
  sum(case when mode = 'direct' and credit = 720720 then 1 else 0 end)::DOUBLE / nullif(count(*) filter (where mode = 'direct'), 0) as acc_direct
  from s group by model)
select model, acc_cot, acc_direct, acc_cot - acc_direct as delta from p""", "q", "resp"))
def mode_delta(spark, sf):
    return S.mode_delta(_scored(spark, sf))


@register("mode_delta_expected", with_views(f"""
with {_scored_sql("expected_options")},
p as (select model,
  (sum(credit) filter (where mode = 'cot'))::DOUBLE / 720720 / nullif(count(*) filter (where mode = 'cot'), 0) as acc_cot,
  (sum(credit) filter (where mode = 'direct'))::DOUBLE / 720720 / nullif(count(*) filter (where mode = 'direct'), 0) as acc_direct
  from s group by model)
select model, acc_cot, acc_direct, acc_cot - acc_direct as delta from p""", "q", "resp"))
def mode_delta_expected(spark, sf):
    """A8 with fractional credit for missing answers."""
    return S.mode_delta(_scored(spark, sf, "expected_options"), policy="expected_options")


@register("paired_drop", with_views(f"""
with {_scored_sql()},
a as (select model, cast(sum(case when credit = 720720 then 1 else 0 end) as bigint)::DOUBLE / count(*) as acc_first from s where n_opts <= 4 group by model),
b as (select model, cast(sum(case when credit = 720720 then 1 else 0 end) as bigint)::DOUBLE / count(*) as acc_second from s where n_opts > 4 group by model)
select coalesce(a.model, b.model) as model, acc_first, acc_second, acc_first - acc_second as drop
from a full join b on a.model = b.model""", "q", "resp"))
def paired_drop(spark, sf):
    """Questions of up to four options against those of more."""
    s = _scored(spark, sf, gold=(*S.GOLD_COLUMNS, "n_opts"))
    return S.paired_drop(s.where("n_opts <= 4"), s.where("n_opts > 4"))


@register("rescore_cached", with_views(f"""
with d as (
  select model, question_id, arg_min(struct_pack(seq := seq, question := question, answer := answer,
                                          pred := pred, model_outputs := model_outputs), seq) as r
  from allsaved group by model, question_id)
select model, question_id, r.seq as seq, r.pred as stored_pred, {X.l2('r.model_outputs')} as pred,
  cast(({X.l2('r.model_outputs')}) = r.answer as int) as hit
from d""", "allsaved"))
def rescore_cached(spark, sf):
    """Deduped saved results re-extracted; the stored pred is ignored."""
    d = dedup_first(fx.all_saved(spark, sf), ("model", "question_id"), "seq")
    p = extract("model_outputs", "l2")
    return d.select("model", "question_id", "seq", F.col("pred").alias("stored_pred"), p.alias("pred"),
                    (p == F.col("answer")).cast("int").alias("hit"))
