"""DuckDB spellings of the extraction cascades and policies, for oracles.

The stand-alone-letter step is written in the forward form (no reversal,
no look-ahead): a greedy prefix ending in a non-word character, the
letter, and a suffix starting with one. RE2 runs it in linear time.
"""

from __future__ import annotations

from ..functions.policy import CREDIT_SCALE, DEFAULT_SEED
from ..functions.text import WS

SQL_E1 = r"answer is \(?([A-J])\)?"
SQL_E2 = r"(?m)^[^\n]*[aA]nswer:" + WS + r"*([A-J])"
SQL_COLON = r"[aA]nswer:" + WS + r"*([A-J])"
SQL_PORT = r"(?s)^(?:.*[^\p{L}\p{N}_])?([A-J])(?:[^\p{L}\p{N}_].*)?$"


def first(t: str, pattern: str, g: int = 1) -> str:
    return f"nullif(regexp_extract({t}, '{pattern}', {g}), '')"


def last(t: str, pattern: str, g: int = 1) -> str:
    return f"list_extract(regexp_extract_all({t}, '{pattern}', {g}), -1)"


def l1(t: str) -> str:
    return first(t, SQL_E1)


def again(t: str) -> str:
    return first(t, SQL_E2)


def final(t: str) -> str:
    return first(t, SQL_PORT)


def l2(t: str) -> str:
    return f"coalesce({l1(t)}, {again(t)}, {final(t)})"


def last_cascade(t: str) -> str:
    return f"coalesce({last(t, SQL_E1)}, {last(t, SQL_COLON)}, {final(t)})"


def draw(keys: list[str], n: str, seed: str = DEFAULT_SEED) -> str:
    ks = ", ".join(f"cast({k} as varchar)" for k in keys)
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {ks})), 1, 8))::BIGINT % ({n}))"


def credit(policy: str, pred: str = "pred", answer: str = "answer",
           answer_index: str = "answer_index", options: str = "options",
           keys=("model", "question_id"), seed: str = DEFAULT_SEED) -> str:
    S = CREDIT_SCALE
    keys = list(keys)
    nopt = f"len({options})"
    fills = {
        "wrong": "0",
        "uniform10": f"case when substr('ABCDEFGHIJ', cast({draw(keys, '10', seed)} as int) + 1, 1) = {answer} then {S} else 0 end",
        "uniform_options": f"case when {nopt} > 0 and {draw(keys, nopt, seed)} = {answer_index} then {S} else 0 end",
        "expected10": f"{S // 10}",
        "expected_options": f"case when {nopt} > 0 then cast(floor({S} / {nopt}) as bigint) else 0 end",
    }
    if policy == "unknown":
        return (f"(case when {pred} is null then (case when {answer} is null then {S} else 0 end) "
                f"when {answer} is null then 0 when {pred} = {answer} then {S} else 0 end)")
    return (f"(case when {pred} is null or {pred} = '' then {fills[policy]} "
            f"when {pred} = {answer} then {S} else 0 end)")


def fixed_decimal(num: str, den: str, digits: int) -> str:
    """DuckDB twin of report.fixed_decimal: exact half-to-even text."""
    S = 10 ** digits
    big = f"cast(({num}) * {S} as bigint)"
    d = f"({den})"
    r = f"({big} % {d})"
    q = f"(({big} - {r}) // {d})"
    v = f"({q} + case when 2 * {r} > {d} or (2 * {r} = {d} and {q} % 2 = 1) then 1 else 0 end)"
    return f"(cast({v} // {S} as varchar) || '.' || lpad(cast({v} % {S} as varchar), {digits}, '0'))"


def status(mo: str) -> str:
    return (f"(case when {mo} is null then 'failed' when {mo} = 'MaxTokensExceeded' then 'max_tokens' "
            f"when {mo} = 'Killed by user' then 'killed' when {mo} = 'Error' then 'error' else 'ok' end)")
