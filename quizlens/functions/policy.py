"""Missing-answer policies (A5) as native expressions.

The reference draws random letters from a seeded sequential generator;
such draws depend on call order and cannot be reproduced in parallel. Here a
draw is a pure function of the row: the first 32 bits of
``md5(seed|key1|key2...)`` modulo n. Never ``rand()``: a retried task must
produce the same draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LETTERS, _c

POLICIES = ("wrong", "uniform10", "uniform_options", "unknown", "expected10",
            "expected_options")
# Credit unit for the fractional "expected" policies: lcm(1..16), so 1/n of a
# point is an exact integer for every option count the letter maps allow and
# sums stay exact (no float-order dependence).
CREDIT_SCALE = 720720
DEFAULT_SEED = "12345"


def draw(seed: str, keys, n) -> Column:
    """Deterministic draw in [0, n): md5 of ``seed|k1|k2...``."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys]))
    m = F.lit(n) if isinstance(n, int) else _c(n)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % m


def missing(pred) -> Column:
    """The reference's ``not pred``: null or empty string."""
    p = _c(pred)
    return p.isNull() | (p == "")


def credit_units(pred, answer, answer_index, options, policy: str,
                 seed: str = DEFAULT_SEED, keys=("model", "question_id")) -> Column:
    """Credit of one response in units of 1/CREDIT_SCALE point."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; one of {POLICIES}")
    p, a = _c(pred), _c(answer)
    full = F.lit(CREDIT_SCALE).cast("bigint")
    zero = F.lit(0).cast("bigint")
    n_opts = F.size(_c(options))
    if policy == "wrong":
        fill = zero
    elif policy == "uniform10":
        fill = F.when(F.lit(LETTERS).substr(draw(seed, keys, 10) + 1, F.lit(1)) == a, full) \
            .otherwise(zero)
    elif policy == "uniform_options":
        fill = F.when((n_opts > 0) & (draw(seed, keys, n_opts) == _c(answer_index)), full) \
            .otherwise(zero)
    elif policy == "unknown":
        # null -> 'Unknown' on both sides: right only when the gold is null too
        fill = F.when(a.isNull(), full).otherwise(zero)
    elif policy == "expected10":
        fill = F.lit(CREDIT_SCALE // 10).cast("bigint")
    else:  # expected_options
        fill = F.when(n_opts > 0, (F.lit(CREDIT_SCALE) / n_opts).cast("bigint")).otherwise(zero)
    if policy == "unknown":
        hit = F.when(a.isNull(), zero).when(p == a, full).otherwise(zero)
        return F.when(p.isNull(), fill).otherwise(hit)
    return F.when(missing(p), fill).when(p == a, full).otherwise(zero)
