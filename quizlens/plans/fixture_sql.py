"""The derived input views of FIXTURES.md as DuckDB SQL, used to build the
oracle queries (``WITH q AS (...), resp AS (...) ...``)."""

from __future__ import annotations

FIXTURE_SQL = {
    "q": """
select p_partkey as question_id,
  concat('Which label fits the ', p_name, ' of ', p_brand, '?') as question,
  split(concat_ws(',', concat('alpha ', p_type), concat('beta ', p_type), concat('gamma ', p_type),
    case when p_partkey % 8 >= 1 then concat('delta ', p_type) else 'N/A' end,
    case when p_partkey % 8 >= 2 then concat('epsilon ', p_type) else 'N/A' end,
    case when p_partkey % 8 >= 3 then concat('zeta ', p_type) else 'N/A' end,
    case when p_partkey % 8 >= 4 then concat('eta ', p_type) else 'N/A' end,
    case when p_partkey % 8 >= 5 then concat('theta ', p_type) else 'N/A' end,
    case when p_partkey % 8 >= 6 then concat('iota ', p_type) else 'N/A' end,
    case when p_partkey % 8 >= 7 then concat('kappa ', p_type) else 'N/A' end), ',') as options,
  3 + p_partkey % 8 as n_opts,
  substr('ABCDEFGHIJ', cast(p_size % (3 + p_partkey % 8) as int) + 1, 1) as answer,
  cast(p_size % (3 + p_partkey % 8) as int) as answer_index,
  case when p_partkey % 3 = 0 then '' else concat('A: Let''s think step by step. Size ', cast(p_size as varchar(9)), ' decides. The answer is (',
    substr('ABCDEFGHIJ', cast(p_size % (3 + p_partkey % 8) as int) + 1, 1), ').') end as cot_content,
  p_type as category, p_brand as src,
  case when p_partkey % 20 = 0 then 'validation' else 'test' end as split
from part""",
    "resp": """
with b as (
  select concat('model_', cast(l_suppkey % 5 as varchar(9))) as model, l_suppkey % 24 as style_id,
    case when l_linestatus = 'O' then 'cot' else 'direct' end as mode, l_partkey as question_id,
    cast(l_quantity as int) % 8 as form, cast(floor(l_extendedprice) as bigint) as tokens,
    case when l_linenumber <= 4 then answer
         else substr('ABCDEFGHIJ', cast((cast(l_quantity as int) + l_linenumber) % 10 as int) + 1, 1) end as letter,
    l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_suppkey, l_linestatus
  from lineitem join q on l_partkey = question_id)
select model, style_id, mode, question_id,
  cast(row_number() over (partition by model, style_id, question_id
    order by l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_suppkey, l_linestatus) as bigint) as attempt,
  cast(row_number() over (partition by model, question_id
    order by l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_suppkey, l_linestatus) as bigint) as attempt_mq,
  case form when 0 then concat('The answer is (', letter, ').') when 1 then concat('Answer: ', letter)
    when 2 then concat('So the answer is ', letter) when 3 then concat('I pick ', letter, ' in the end')
    when 4 then concat('**The answer is (', letter, ')**') when 5 then 'I have no idea'
    when 6 then 'MaxTokensExceeded' else null end as model_outputs,
  tokens
from b""",
    "saved": """
select r.question_id * 1000 + r.attempt_mq as seq, r.question_id, q.question, q.category, q.answer,
  nullif(regexp_extract(r.model_outputs, 'answer is [(]?([A-J])', 1), '') as pred, r.model_outputs
from resp r join q on r.question_id = q.question_id
where r.model = 'model_0' and r.question_id % 3 = 0 and r.model_outputs is not null""",
    "tele": """
select event_id, user_id as question_id, cast(ts as timestamp) as ts,
  case event_type when 'signup' then 'reset' when 'purchase' then 'success' when 'error' then 'wrong' when 'view' then 'count' else 'update' end as kind,
  case when event_type = 'signup' then 0 else cast(round(value * 100) as bigint) end as delta
from events""",
    "chunks": """
select conv_id as request_id, turn as seq,
  case when role = 'assistant' then '' else text end as reasoning,
  case when role = 'assistant' then text else '' end as content,
  case when turn = max(turn) over (partition by conv_id) and conv_id % 7 <> 0 then cast(length(text) as bigint) end as usage_total_tokens
from conversations""",
    "allsaved": """
select (cast(string_split(r.model, '_')[-1] as bigint) * 1000000000 + r.question_id) * 1000 + r.attempt_mq as seq, r.model, r.question_id,
  q.question, q.category, q.answer, nullif(regexp_extract(r.model_outputs, 'answer is [(]?([A-J])', 1), '') as pred, r.model_outputs
from resp r join q on r.question_id = q.question_id
where r.model_outputs is not null""",
    "res": """
select s.model, s.question_id, s.seq, s.question, s.category, s.answer, s.pred, s.model_outputs,
  q.options, q.answer_index, q.cot_content, q.src
from allsaved s join q on s.question_id = q.question_id
qualify row_number() over (partition by s.model, s.question_id order by s.seq) = 1""",
}

_DEPS = {"q": [], "resp": ["q"], "saved": ["q", "resp"], "tele": [], "chunks": [],
         "allsaved": ["q", "resp"], "res": ["q", "allsaved"]}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of the named views (and what they need)."""
    order: list[str] = []

    def add(n):
        for d in _DEPS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} as ({FIXTURE_SQL[n]}\n)" for n in order)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
