"""Registered queries: prompts (T*, J1, J6, L2), user functions (F1, F2),
reports (W1, W2, R*, S7, S9) and telemetry (W3-W6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import DEFAULT_COT, WS, format_block, format_inline, strip_bold, word_count
from ..functions.extract import extract
from ..operators import clean as C
from ..operators import prompts as P
from ..operators import report as RP
from ..operators import score as S
from ..operators import telemetry as T
from ..operators.generate import generate, stub_answerer, token_count_udf
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import sqlparts as X
from .fixture_sql import with_views
from .q_results import FILLED_SQL
from .registry import register


def lit(s: str) -> str:
    """A Python string as a DuckDB string expression (newlines via chr)."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


NOT_WS = "[^" + WS[1:-1] + "]+"


def words(t: str) -> str:
    return f"cast(len(regexp_extract_all({t}, '{NOT_WS}')) as bigint)"


def opts_sql(options: str, pre: str, post: str, after: str, letters: str = "ABCDEFGHIJ") -> str:
    return (f"array_to_string(list_transform({options}, lambda o, i: {lit(pre)} || substr('{letters}', i, 1) || "
            f"{lit(post)} || coalesce(o, 'None') || {lit(after)}), '')")


def inline_sql(question: str, options: str, cot: str | None) -> str:
    cot = f"coalesce({cot}, '')" if cot else "''"
    c1 = f"(case when {cot} = '' then {lit(DEFAULT_COT)} else {cot} end)"
    c2 = f"(case when starts_with({c1}, 'A: ') then substr({c1}, 4) else {c1} end)"
    tail = f"(case when {c2} = '' then 'Answer: ' else 'Answer: ' || {c2} || chr(10) || chr(10) end)"
    return f"('Question: ' || {question} || chr(10) || 'Options: ' || {opts_sql(options, '', '. ', chr(10))} || {tail})"


def block_sql(question: str, options: str, cot: str | None, with_answer: bool) -> str:
    head = (f"('Question:' || chr(10) || {question} || chr(10) || 'Options:' || chr(10) || "
            f"{opts_sql(options, '', '. ', chr(10), 'ABCDEFGHIJKLMNOP')})")
    if not with_answer:
        return f"({head} || {lit('Answer: ' + DEFAULT_COT)})"
    fixed = f"replace(coalesce({cot}, ''), {lit('A: ' + DEFAULT_COT)}, {lit('Answer: ' + DEFAULT_COT)})"
    return f"({head} || {fixed} || chr(10) || chr(10))"


CLEAN_Q = "cq as (select * replace (list_filter(options, lambda o: o is distinct from 'N/A') as options) from q)"
API_HEADER_SQL = (f"({lit(P.API_HEADER.split('{}')[0])} || category || {lit(P.API_HEADER.split('{}')[1])})")
LOCAL_HEADER_SQL = f"(replace({lit(P.LOCAL_HEADER_TEMPLATE)}, '{{$}}', category) || chr(10))"


def _cq(spark, sf):
    return C.clean_options(fx.questions(spark, sf))


# ---------------------------------------------------------------- T1, T2, T7
@register("prompt_inline", with_views(f"""
with {CLEAN_Q}
select question_id, {inline_sql('question', 'options', 'cot_content')} as exemplar_text,
  {inline_sql('question', 'options', None)} as target_text from cq""", "q"))
def prompt_inline(spark, sf):
    q = _cq(spark, sf)
    return q.select("question_id", format_inline("question", "options", "cot_content").alias("exemplar_text"),
                    format_inline("question", "options").alias("target_text"))


@register("prompt_block", with_views(f"""
with {CLEAN_Q}
select question_id, {block_sql('question', 'options', 'cot_content', True)} as exemplar_text,
  {block_sql('question', 'options', None, False)} as target_text from cq""", "q"))
def prompt_block(spark, sf):
    q = _cq(spark, sf)
    return q.select("question_id", format_block("question", "options", "cot_content").alias("exemplar_text"),
                    format_block("question", "options", with_answer=False).alias("target_text"))


@register("strip_bold", with_views(f"""
select model, style_id, question_id, attempt, replace(model_outputs, '**', '') as text,
  {X.l2("replace(model_outputs, '**', '')")} as pred from resp""", "q", "resp"))
def strip_bold_q(spark, sf):
    r = fx.responses(spark, sf)
    t = strip_bold("model_outputs")
    return r.select("model", "style_id", "question_id", "attempt", t.alias("text"), extract(t, "l2").alias("pred"))


# ---------------------------------------------------------------- T3, J1, L2
K_SHOTS = 5


def _fewshot_sql(style: str) -> str:
    k = "" if style == "api" else f"where rn <= {K_SHOTS}"      # the API runners take all exemplars
    render = (inline_sql("question", "options", "cot_content") if style == "api"
              else block_sql("question", "options", "cot_content", True))
    target = inline_sql("t.question", "t.options", None) if style == "api" else \
        block_sql("t.question", "t.options", None, False)
    header = API_HEADER_SQL if style == "api" else LOCAL_HEADER_SQL
    return with_views(f"""
with {CLEAN_Q},
ex as (select category, {render} as txt,
         row_number() over (partition by category order by question_id) as rn
       from cq where split = 'validation'),
pre as (select category, string_agg(txt, '' order by rn) as prefix, count(*) as n
        from ex {k} group by category)
select t.question_id, t.category,
  {header.replace('category', 't.category')} || coalesce(pre.prefix, '') || {target} as prompt,
  coalesce(pre.n, 0) as n_shots
from cq t left join pre on t.category = pre.category where t.split = 'test'""", "q")


def _fewshot(style, **kw):
    def fn(spark, sf):
        q = _cq(spark, sf)
        test, ex = q.where(F.col("split") == "test"), q.where(F.col("split") == "validation")
        return P.fewshot(test, ex, None if style == "api" else K_SHOTS, style, **kw)
    return fn


register("fewshot_prompt", _fewshot_sql("api"))(_fewshot("api"))
register("fewshot_local", _fewshot_sql("local"))(_fewshot("local"))


# ---------------------------------------------------------------- T4
def _kshot_sql(limit: int) -> str:
    render = block_sql("question", "options", "cot_content", True)
    target = block_sql("t.question", "t.options", None, False)
    return with_views(f"""
with {CLEAN_Q},
ex as (select category, {render} as txt,
         row_number() over (partition by category order by question_id) as rn
       from cq where split = 'validation'),
top as (select category, list(txt order by rn) as exs from ex where rn <= {K_SHOTS} group by category),
base as (select t.question_id, t.category, {LOCAL_HEADER_SQL.replace('category', 't.category')} as h,
           {target} as tt, coalesce(top.exs, []::VARCHAR[]) as exs
         from cq t left join top on t.category = top.category where t.split = 'test'),
cand as (select question_id, category, h, tt, exs, unnest(range(0, least({K_SHOTS}, len(exs)) + 1)) as k from base),
tok as (select *, h || array_to_string(exs[1:k], '') || tt as prompt from cand),
cnt as (select *, {words('prompt')} as tokens from tok),
g as (select question_id, category,
        arg_max(struct_pack(k := k, tokens := tokens, prompt := prompt), k) filter (where tokens < {limit}) as best
      from cnt group by question_id, category)
select question_id, category, cast(best.k as bigint) as k, best.tokens as tokens, best.prompt as prompt,
  best is null as overflow from g""", "q")


def _kshot(limit):
    def fn(spark, sf):
        q = _cq(spark, sf)
        test, ex = q.where(F.col("split") == "test"), q.where(F.col("split") == "validation")
        r = P.fit_kshot(test, ex, K_SHOTS, limit)
        return r.withColumn("k", F.col("k").cast("bigint"))
    return fn


register("kshot_budget", _kshot_sql(2048))(_kshot(2048))
register("kshot_budget_tight", _kshot_sql(200))(_kshot(200))


# ---------------------------------------------------------------- T5, J6
def _styles_sql() -> str:
    header = "null"
    for i, h in enumerate(P.STYLE_HEADERS):
        header = f"case when header_id = {i + 1} then replace({lit(h)}, '{{subject}}', category) else {header} end"
    body = "null"
    for i, (qpre, mid, marker, after, tail, cue) in enumerate(P.STYLE_FORMATS):
        pre_l, post_l = marker.split("{L}")
        b = (f"{lit(qpre)} || question || {lit(mid)} || {opts_sql('options', pre_l, post_l, after)} || "
             f"{lit(tail)} || {lit(cue)}")
        body = f"case when format_id = {i + 1} then {b} else {body} end"
    return with_views(f"""
with {CLEAN_Q},
g as (select question_id, category, question, options, unnest(range(1, 25)) as style_id from cq),
h as (select *, (style_id - 1) // 6 + 1 as header_id, (style_id - 1) % 6 + 1 as format_id from g)
select question_id, cast(style_id as int) as style_id, cast(header_id as int) as header_id,
  cast(format_id as int) as format_id, ({header}) || chr(10) || chr(10) || ({body}) as prompt from h""", "q")


@register("prompt_styles", _styles_sql())
def prompt_styles(spark, sf):
    return P.style_grid(_cq(spark, sf))


# ---------------------------------------------------------------- T6/F2, T8, F1
@register("token_count", f"select doc_id, {words('text')} as tokens from documents")
def token_count(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", word_count("text").alias("tokens"))


def _assemble_sql(max_tokens: int, save_thinking: bool) -> str:
    keep = "txt" if save_thinking else "coalesce(content, '')"
    return with_views(f"""
with c as (select *, case when usage_total_tokens is null then coalesce(reasoning, '') || coalesce(content, '') else '' end as txt from chunks),
d as (select *, {words('txt')} as delta, {keep} as keep from c),
ne as (select request_id, seq, keep, cast(sum(delta) over w as bigint) as run, row_number() over w as rn
       from d where txt <> ''
       window w as (partition by request_id order by seq rows between unbounded preceding and current row)),
u as (select request_id, arg_max(usage_total_tokens, seq) filter (where usage_total_tokens is not null) as usage from d group by request_id),
a as (select request_id, count(*) as n_all, max(run) as total,
        min(rn) filter (where run > {max_tokens}) as cut, arg_min(run, rn) filter (where run > {max_tokens}) as cut_run,
        string_agg(keep, '' order by seq) as body
      from ne group by request_id),
x as (select u.request_id, u.usage, coalesce(a.n_all, 0) as n_all, coalesce(a.total, 0) as total, a.cut, a.cut_run,
        coalesce(a.body, '') as body
      from u left join a on u.request_id = a.request_id)
select request_id, cast(coalesce(cut, n_all) as bigint) as n_chunks,
  cast(case when cut is not null then cut_run else total end as bigint) as est_tokens,
  case when cut is not null then 'max_tokens' when usage is null then 'missing_usage' else 'ok' end as status,
  case when cut is not null then 'MaxTokensExceeded' when usage is null then null else body end as response,
  case when cut is not null or usage is null then null else usage end as final_tokens
from x""", "chunks")


def _assemble(max_tokens, save_thinking):
    def fn(spark, sf):
        return P.assemble(fx.chunks(spark, sf), 0, max_tokens, save_thinking)
    return fn


register("assemble_response", _assemble_sql(32768, False))(_assemble(32768, False))
register("assemble_thinking", _assemble_sql(300, True))(_assemble(300, True))


@register("token_count_udf", f"select doc_id, {words('text')} as tokens from documents")
def token_count_udf_q(spark, sf):
    """a Python encoder as the counter (here Python's own word split)."""
    d = read_table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", token_count_udf("text", factory=lambda: str.split).alias("tokens"))


@register("generate_answers", f"""
with fs as ({_fewshot_sql('api')})
select question_id, 'The answer is (' || substr('ABCDEFGHIJ', length(prompt) % 10 + 1, 1) || ').' as response,
  substr('ABCDEFGHIJ', length(prompt) % 10 + 1, 1) as pred
from fs""")
def generate_answers(spark, sf):
    """a user function over batches of prompts (here a deterministic
    stand-in for a model), then L2 extraction of its answers. A category's
    exemplars come to a task once per block of questions."""
    prompts = _fewshot("api", block_size=256)(spark, sf)
    out = generate(prompts, stub_answerer, id_col="question_id")
    return out.select("question_id", "response", extract("response", "l2").alias("pred"))


# ---------------------------------------------------------------- W1, W2, R*
def _res(spark, sf):
    return fx.result_rows(spark, sf)


@register("running_accuracy", with_views("""
with h as (select model, question_id, category, seq, case when pred = answer then 1 else 0 end as hit from res)
select model, question_id, category, seq, count(*) over w as answered, cast(sum(hit) over w as bigint) as correct,
  cast(sum(hit) over w as bigint)::DOUBLE / count(*) over w as running_acc
from h window w as (partition by model, category order by seq rows between unbounded preceding and current row)""",
    "res"))
def running_accuracy(spark, sf):
    r = _res(spark, sf).withColumn("hit", F.coalesce((F.col("pred") == F.col("answer")).cast("int"), F.lit(0)))
    return RP.running_accuracy(r.select("model", "question_id", "category", "seq", "hit")) \
        .select("model", "question_id", "category", "seq", "answered", "correct", "running_acc")


@register("wrong_positions", with_views(f"""
with {FILLED_SQL}, w as (select * from filled where answer <> pred),
c as (select category as list_name, model, question_id, row_number() over (partition by category order by seq) as position,
        count(*) over (partition by category) as n from w
      union all
      select 'ALL', model, question_id, row_number() over (order by seq), count(*) over () from w)
select list_name, model, question_id, cast(position as bigint) as position, n,
  case when position = 1 and n > 1 then '[FIRST]' when position = n and n > 1 then '[LAST]'
       when n = 1 then '[ONLY ONE]' else '' end as mark,
  cast((position - 1) // 10 as bigint) as page
from c""", "res"))
def wrong_positions(spark, sf):
    w = C.wrong_answers(_res(spark, sf)).select("model", "question_id", "category", "seq")
    per_cat = RP.positions(w, ("category",)).withColumnRenamed("category", "list_name")
    overall = RP.positions(w.drop("category"), ()).withColumn("list_name", F.lit("ALL"))
    cols = ["list_name", "model", "question_id", "position", "n", "mark", "page"]
    return per_cat.select(*cols).unionByName(overall.select(*cols))


def _trunc_sql(c: str, n: int = 80) -> str:
    return f"(case when length({c}) > {n} then substr({c}, 1, {n}) || '...' else {c} end)"


@register("error_report", with_views(f"""
with {FILLED_SQL}
select category, cast(question_id as varchar) as question_id, src, answer, pred, answer_index, question,
  array_to_string(list_transform(options, lambda o, i: cast(i as varchar) || '. ' || coalesce(o, 'Empty option')), ' | ')
    as options_text,
  {_trunc_sql('cot_content')} as cot_short, {_trunc_sql('model_outputs')} as output_short
from filled where answer <> pred""", "res"))
def error_report(spark, sf):
    return RP.error_report(_res(spark, sf))


@register("category_menu", with_views(f"""
with {FILLED_SQL},
g as (select category, count(*) as total, count(*) filter (where answer is distinct from pred) as wrong
      from filled group by category
      union all
      select 'ALL', count(*), count(*) filter (where answer is distinct from pred) from filled)
select category, total, wrong,
  cast(wrong as varchar) || '/' || cast(total as varchar) || ' wrong (' ||
  case when total > 0 then {X.fixed_decimal('(total - wrong) * 100', 'total', 1)} else '0.0' end || '% accuracy)' as label
from g""", "res"))
def category_menu(spark, sf):
    return RP.category_menu(_res(spark, sf))


def _summary(spark, sf):
    q = fx.questions(spark, sf)
    sc = S.score(S.with_prediction(S.attach_gold(fx.responses(spark, sf, q, gold=S.GOLD_COLUMNS), q)), "wrong")
    return S.summary(sc, ("model", "category"), "wrong")


_SUMMARY_SQL = f"""
sc as (select r.model, q.category, q.answer, {X.l2('r.model_outputs')} as pred
       from resp r join q on r.question_id = q.question_id),
g as (select model, category, count(*) as n, cast(sum(case when pred = answer then 1 else 0 end) as bigint) as corr
      from sc group by model, category
      union all
      select model, 'total', count(*), cast(sum(case when pred = answer then 1 else 0 end) as bigint)
      from sc group by model),
summ as (select model, category, n, corr, n - corr as wrong, corr::DOUBLE / n as acc from g)"""


@register("summary_json", with_views(f"""
with {_SUMMARY_SQL}
select model, to_json(map_from_entries(list(struct_pack(k := category,
  v := struct_pack(corr := corr, wrong := wrong, acc := acc)) order by category)))::VARCHAR as summary_json
from summ group by model""", "q", "resp"))
def summary_json(spark, sf):
    return RP.summary_json(_summary(spark, sf))


@register("report_lines", with_views(f"""
with {_SUMMARY_SQL},
l as (select model, 0 as sec, category as k,
        'Average accuracy ' || {X.fixed_decimal('corr', 'corr + wrong', 4)} || ' - ' || category as line
      from summ where category <> 'total'
      union all
      select model, 1, '', 'Average accuracy: ' || {X.fixed_decimal('corr', 'corr + wrong', 4)}
      from summ where category = 'total')
select model, cast(row_number() over (partition by model order by sec, k) as bigint) as line_no, line from l""",
    "q", "resp"))
def report_lines(spark, sf):
    return RP.report_lines(_summary(spark, sf))


# ---------------------------------------------------------------- W3-W6
HOUR = 3600
# One row at a time in words: an episode starts at a reset and is over after a
# success or wrong row; a row counts while its episode is not over.
TRACKED_SQL = f"""
t as (select *, epoch_us(ts) as us from tele),
e as (select *, count(*) filter (where kind = 'reset') over o as episode, first_value(case when kind <> 'count' then us end ignore nulls) over (partition by question_id order by us, event_id rows between 1 following and unbounded following) as next_us
      from t window o as (partition by question_id order by us, event_id rows between unbounded preceding and current row)),
l as (select *, coalesce(count(*) filter (where kind in ('success', 'wrong')) over (partition by question_id, episode order by us, event_id
        rows between unbounded preceding and 1 preceding), 0) = 0 as live from e),
c as (select *, case when live and kind <> 'reset' then cast(coalesce(sum(case when kind in ('update', 'count') then delta end)
        over (partition by question_id, episode order by us, event_id rows between unbounded preceding and current row), 0) as bigint) else 0 end as tokens from l),
w as (select *, min(us) filter (where kind = 'update' and live) over f as us0, arg_min(tokens, (us, event_id)) filter (where kind = 'update' and live) over f as c0 from c
      window f as (partition by question_id, episode order by us range between {8 * HOUR * 1_000_000} preceding and current row)),
r as (select *, case when kind = 'update' and live and (us - us0)::DOUBLE / 1000000.0 > 0.05 and tokens - c0 > 0
        then (tokens - c0)::DOUBLE / ((us - us0)::DOUBLE / 1000000.0) end as raw from w),
tr as (select *, case when live and kind in ('update', 'count') then coalesce(last_value(raw ignore nulls)
        over (partition by question_id, episode order by us, event_id rows between unbounded preceding and current row), 0.0) else 0.0 end as rate from r)"""


@register("rolling_rate", with_views(f"""
with {TRACKED_SQL}
select event_id, question_id, kind, cast(episode as bigint) as episode, cast(tokens as bigint) as tokens, rate::DOUBLE as rate from tr""", "tele"))
def rolling_rate(spark, sf):
    r = T.rolling_rate(fx.telemetry(spark, sf), window_s=8 * HOUR)
    return r.select("event_id", "question_id", "kind", "episode", "tokens", "rate")


@register("stall_flags", with_views(f"""
with {TRACKED_SQL},
busy as (select *, live and kind = 'update' as b from tr)
select question_id, count(*) filter (where live and kind = 'update') as samples,
  count(*) filter (where b and next_us - us > {25 * HOUR * 1_000_000}) as stalls,
  cast(coalesce((select max(epoch_us(ts)) from tele) - max(us) filter (where b and next_us is null) > {25 * HOUR * 1_000_000}, false) as int) as stalled_now
from busy group by question_id""", "tele"))
def stall_flags(spark, sf):
    return T.stall_flags(fx.telemetry(spark, sf), threshold_s=25 * HOUR, window_s=8 * HOUR)


@register("age_buckets", with_views(f"""
with per as (select question_id, max(case when kind = 'reset' then epoch_us(ts) end) as st,
               max(case when kind in ('success', 'wrong') then epoch_us(ts) end) as en
             from tele group by question_id),
nw as (select max(epoch_us(ts)) as now_us from tele),
a as (select (nw.now_us - st)::DOUBLE / 1000000.0 as age from per, nw
      where st is not null and (en is null or en < st))
select case when age < {30 * HOUR} then 'white' when age < {90 * HOUR} then 'yellow'
            when age < {180 * HOUR} then 'orange' else 'red' end as bucket, count(*) as questions
from a group by all""", "tele"))
def age_buckets(spark, sf):
    return T.age_buckets(fx.telemetry(spark, sf), scale=HOUR)


@register("log_tail", with_views(f"""
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts_text,
  regexp_replace('[' || strftime(ts, '%H:%M:%S') || '] Q' || cast(question_id as varchar) || ' ' || kind || ' '
    || cast(delta as varchar), '{__import__('quizlens.functions.text', fromlist=['x']).NON_PRINTABLE}', '', 'g') as message
from tele order by ts desc, event_id desc limit 10""", "tele"))
def log_tail(spark, sf):
    return T.log_tail(T.log_lines(fx.telemetry(spark, sf)), 10)
