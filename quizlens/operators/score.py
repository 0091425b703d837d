"""Scoring and aggregation operators.

Every aggregate here is a plain ``groupBy``/``rollup`` of algebraic
functions (count, sum, min_by/max_by), so Spark runs a partial aggregate
before the shuffle: a hot key (one category or model holding a third of
the rows) is pre-aggregated map-side and never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import extract
from ..functions.policy import CREDIT_SCALE, DEFAULT_SEED, credit_units
from ..functions.text import MAX_TOKENS_TEXT, output_status

GOLD_COLUMNS = ("category", "answer", "answer_index", "options")


def attach_gold(responses: DataFrame, questions: DataFrame,
                columns=GOLD_COLUMNS) -> DataFrame:
    """Responses x questions on ``question_id`` (inner). The planner
    (AQE) picks broadcast or sort-merge from measured sizes. Responses that
    already carry the columns are returned as they are."""
    if set(columns) <= set(responses.columns):
        return responses
    return responses.join(questions.select("question_id", *columns), "question_id")


def with_prediction(df: DataFrame, cascade: str = "l2", text: str = "model_outputs",
                    out: str = "pred") -> DataFrame:
    return df.withColumn(out, extract(text, cascade))


DRAW_KEYS = ("model", "question_id", "style_id", "attempt")


def score(df: DataFrame, policy: str = "wrong", pred: str = "pred",
          seed: str = DEFAULT_SEED, keys=None) -> DataFrame:
    """A5: add ``credit`` (units of 1/CREDIT_SCALE) and ``hit`` (0/1).
    ``options`` are the cleaned ones (P1). Draws differ by row: their keys are
    those of ``DRAW_KEYS`` that ``df`` has, unless given."""
    keys = keys or [k for k in DRAW_KEYS if k in df.columns]
    units = credit_units(pred, "answer", "answer_index", "options", policy, seed, keys)
    return (df.withColumn("credit", units)
              .withColumn("hit", (F.col("credit") == CREDIT_SCALE).cast("int")))


def _fractional(policy: str) -> bool:
    return policy.startswith("expected")


def _counts(policy: str):
    """corr / wrong / n aggregate columns; integers unless the policy gives
    fractional credit."""
    n = F.count(F.lit(1))
    if _fractional(policy):
        corr = F.sum("credit").cast("double") / CREDIT_SCALE
    else:
        corr = F.sum("hit").cast("bigint")
    return n.alias("n"), corr.cast("double" if _fractional(policy) else "bigint").alias("corr")


def summary(scored: DataFrame, by=("model", "category"), policy: str = "wrong",
            total: bool = True, empty: str = "null") -> DataFrame:
    """A1 (+A2 when ``total``): corr / wrong / acc per group; with ``total``
    a ``rollup`` adds a micro-averaged ``total`` row per leading key.
    ``empty='zero'`` gives acc 0 instead of null for an empty group."""
    by = list(by)
    n, corr = _counts(policy)
    if total and by:
        g = scored.rollup(*by).agg(n, corr, *[F.grouping(c).alias(f"_g_{c}") for c in by])
        keep = F.lit(True)
        for c in by[:-1]:
            keep = keep & (F.col(f"_g_{c}") == 0)
        last = by[-1]
        g = (g.where(keep)
              .withColumn(last, F.when(F.col(f"_g_{last}") == 1, F.lit("total"))
                          .otherwise(F.col(last)))
              .drop(*[f"_g_{c}" for c in by]))
    else:
        g = scored.groupBy(*by).agg(n, corr)
    acc = F.try_divide(F.col("corr"), F.col("n").cast("double"))
    if empty == "zero":
        acc = F.coalesce(acc, F.lit(0.0))
    return g.select(*by, "n", "corr", (F.col("n") - F.col("corr")).alias("wrong"), acc.alias("acc"))


def leaderboard(scored: DataFrame, policy: str = "wrong") -> DataFrame:
    """Overall accuracy per model with its rank (1 = best)."""
    n, corr = _counts(policy)
    g = scored.groupBy("model").agg(n, corr).withColumn("acc", F.col("corr") / F.col("n"))
    # one row per model: a global window over a tiny, bounded input
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.col("acc").desc())).cast("bigint"))


def leaderboard_by_category(responses: DataFrame, questions: DataFrame,
                            policy: str = "wrong") -> DataFrame:
    """Flagship: responses x questions -> L2 extraction -> policy -> per
    (model, category) counts, L1/L2 comparison columns, and each model's
    rank within its category. Responses that already carry the gold columns
    are not joined again."""
    df = attach_gold(responses, questions)
    df = df.select("category", "answer", "answer_index", "options", *[k for k in DRAW_KEYS if k in df.columns], extract("model_outputs", "l1").alias("pred_l1"),
                   extract("model_outputs", "l2").alias("pred"))
    df = score(df, policy)
    g = df.groupBy("model", "category").agg(
        *_counts(policy),
        F.count_if(F.col("pred_l1") == F.col("answer")).alias("l1_corr"),
        F.count_if(F.col("pred_l1").isNull()).alias("l1_null"),
        F.count_if(F.col("pred").isNull()).alias("l2_null"))
    g = g.withColumn("wrong", F.col("n") - F.col("corr")) \
         .withColumn("acc", F.col("corr") / F.col("n"))
    # (model, category) groups are few; the rank window only sees them
    w = Window.partitionBy("category").orderBy(F.col("acc").desc())
    return g.withColumn("rank_in_category", F.rank().over(w).cast("bigint"))


def per_file_accuracy(results: DataFrame, levels=("l1", "l2"), by=("model", "category"),
                      seed: str = DEFAULT_SEED) -> DataFrame:
    """A3: succ / fail / acc per file (group) and extraction level, missing
    answers drawn uniformly from ten letters. One scan, both levels."""
    by = list(by)
    keys = [k for k in DRAW_KEYS if k in results.columns]
    base = results.select(*dict.fromkeys([*by, *keys, "answer", "answer_index", "options", "model_outputs"]))
    per_level = [
        F.struct(F.lit(lv).alias("level"),
                 credit_units(extract("model_outputs", lv), "answer", "answer_index", "options",
                              "uniform10", f"{seed}:{lv}", keys).alias("credit"))
        for lv in levels]
    long = base.select(*by, F.inline(F.array(*per_level)))
    g = long.groupBy(*by, "level").agg(
        F.count_if(F.col("credit") > 0).alias("succ"),
        F.count_if(F.col("credit") == 0).alias("fail"))
    return g.withColumn("acc", F.col("succ") / (F.col("succ") + F.col("fail")))


def extractor_compare(df: DataFrame, a: str = "l1", b: str = "l2", by=("model",)) -> DataFrame:
    """The same outputs under two cascades, side by side."""
    pa, pb, ans = extract("model_outputs", a), extract("model_outputs", b), F.col("answer")
    x = df.select(*by, "answer", pa.alias("pa"), pb.alias("pb"))
    ra, rb = F.col("pa") == ans, F.col("pb") == ans
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ra).alias(f"{a}_corr"),
        F.count_if(rb).alias(f"{b}_corr"),
        F.count_if(F.col("pa").isNull()).alias(f"{a}_null"),
        F.count_if(F.col("pb").isNull()).alias(f"{b}_null"),
        F.count_if(F.col("pa").eqNullSafe(F.col("pb"))).alias("agree"),
        F.count_if(F.coalesce(ra, F.lit(False)) & ~F.coalesce(rb, F.lit(False))).alias("flip_to_wrong"),
        F.count_if(~F.coalesce(ra, F.lit(False)) & F.coalesce(rb, F.lit(False))).alias("flip_to_right"))


def wrong_stats(results: DataFrame, by=("category",)) -> DataFrame:
    """A4: wrong / total / percent per category plus an ``ALL`` row; a row
    is wrong when answer and pred differ after defaults (null-safe)."""
    by = list(by)
    wrong = ~F.col("answer").eqNullSafe(F.col("pred"))
    g = results.rollup(*by).agg(F.count(F.lit(1)).alias("total"),
                                F.count_if(wrong).alias("wrong"),
                                F.grouping(by[-1]).alias("_g"))
    g = g.withColumn(by[-1], F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col(by[-1])))
    if len(by) > 1:
        g = g.where(F.col(by[0]).isNotNull())
    acc = F.coalesce(F.try_divide((F.col("total") - F.col("wrong")) * 100.0, F.col("total")),
                     F.lit(0.0))
    return g.select(*by, "total", "wrong", acc.alias("accuracy"))


def style_sensitivity(scored: DataFrame, policy: str = "wrong") -> DataFrame:
    """Accuracy per (model, style), then its spread per model."""
    n, corr = _counts(policy)
    per = scored.groupBy("model", "style_id").agg(n, corr).withColumn("acc", F.col("corr") / F.col("n"))
    return per.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_styles"),
        F.min("acc").alias("min_acc"), F.max("acc").alias("max_acc"),
        (F.max("acc") - F.min("acc")).alias("spread"),
        F.round(F.stddev_samp("acc"), 6).alias("stddev_acc"))


def mode_delta(scored: DataFrame, modes=("cot", "direct"), policy: str = "wrong") -> DataFrame:
    """Accuracy per mode pivoted, and the difference first - second."""
    n, corr = _counts(policy)
    a, b = modes
    p = scored.groupBy("model").pivot("mode", list(modes)).agg(F.try_divide(corr, n))
    return p.select("model", F.col(a).alias(f"acc_{a}"), F.col(b).alias(f"acc_{b}"),
                    (F.col(a) - F.col(b)).alias("delta"))


def paired_drop(first: DataFrame, second: DataFrame, policy: str = "wrong") -> DataFrame:
    """Every model's accuracy on two benchmarks and the drop from the
    first to the second; models without one of them have nulls."""
    n, corr = _counts(policy)
    acc = lambda df, name: df.groupBy("model").agg(n, corr).select("model", F.try_divide("corr", "n").alias(name))
    j = acc(first, "acc_first").join(acc(second, "acc_second"), "model", "full_outer")
    return j.withColumn("drop", F.col("acc_first") - F.col("acc_second"))


ATTEMPT_BLOCK = 1 << 14     #: attempts of a key that one group folds
_AT = "struct<at:bigint,code:string,pred:string>"


def _num(n) -> Column:
    return F.lit(n).cast("bigint")


def _run_state(run, wrong) -> Column:
    """What a block of attempts comes to: whether the sequence is over, the two
    counters it leaves with, what it adds up, its last answer and its last row."""
    return F.struct(F.lit(False).alias("over"), run.alias("run"), wrong.alias("wrong"), _num(0).alias("n"), _num(0).alias("max_tokens"),
                    _num(0).alias("wait"), F.lit(None).cast(_AT).alias("answer"), F.lit(None).cast(_AT).alias("last"))


def _attempt(retry_wrong: int, limit: int):
    """One attempt after another (an ``aggregate`` step)."""
    def step(a, r):
        full, failed, right, killed = (r["code"] == c for c in ("max_tokens", "failed", "right", "killed"))
        run = F.when(full, a["run"] + 1).when(failed, a["run"]).otherwise(_num(0))
        wrong = a["wrong"] + (~full & ~failed & ~right & ~killed).cast("bigint")
        over = right | killed | (run >= limit) | (wrong > retry_wrong)
        return F.when(a["over"], a).otherwise(F.struct(
            over.alias("over"), run.alias("run"), wrong.alias("wrong"), (a["n"] + 1).alias("n"), (a["max_tokens"] + full.cast("bigint")).alias("max_tokens"),
            (a["wait"] + F.when(full & ~over, F.least(F.pow(F.lit(2), run).cast("bigint"), _num(30))).otherwise(_num(0))).alias("wait"),
            F.when(full | failed, a["answer"]).otherwise(r).alias("answer"), r.alias("last")))
    return step


def _then(width: int):
    """A block's map after the blocks before it (an ``aggregate`` step): the map
    has one entry per pair of counters that the block can be entered with."""
    def step(a, m):
        b = F.get(m["map"], (a["run"] * width + a["wrong"]).cast("int"))
        return F.when(a["over"], a).otherwise(F.struct(
            b["over"].alias("over"), b["run"].alias("run"), b["wrong"].alias("wrong"), *[(a[c] + b[c]).alias(c) for c in ("n", "max_tokens", "wait")],
            F.coalesce(b["answer"], a["answer"]).alias("answer"), b["last"].alias("last")))
    return step


def attempt_runs(scored: DataFrame, retry_wrong: int = 0, retry: int = 1, key=("model", "question_id"),
                 order: str = "attempt_mq", block: int = ATTEMPT_BLOCK) -> DataFrame:
    """A9 + A10: what the retries of every key come to, attempts in ``order``
    (whole numbers).

    A max-token attempt repeats the same answer attempt; ``retry`` of them in
    one answer attempt (at least one) abort the key. A failed call (null
    output) is repeated without counting. A wrong answer starts a new answer
    attempt, ``retry_wrong`` times. A question that was killed stays so. The
    sequence ends with a right answer, a kill, an abort or the last allowed wrong
    answer; later rows do not count. ``final`` is the row it ended with, or else
    the last answer, or else the last row.

    The rules are an automaton with few states, ``retry * (retry_wrong + 1)``.
    Attempts are cut into blocks of ``block`` numbers of ``order``; each block is
    folded, without knowing the ones before it, into a map from every state to
    what it comes to (the first block needs one state only), and maps compose.
    So a key's attempts are spread over tasks, and the task that puts a key
    together sees one row per block. Only a letter code, position and prediction
    of each attempt are shuffled (no text). ``wait`` is the backoff: min(2^n, 30)
    s after the n-th max-token attempt that does not abort."""
    key, limit, width = list(key), max(retry, 1), max(retry_wrong, 0) + 1
    code = (F.when(F.col("model_outputs").isNull(), "failed").when(F.col("model_outputs") == MAX_TOKENS_TEXT, "max_tokens")
            .when(output_status("model_outputs") == "killed", "killed").when(F.col("hit") == 1, "right").otherwise(output_status("model_outputs")))
    at = F.col(order).cast("bigint")
    part = F.greatest(F.floor(at / F.lit(block)), F.lit(0)).cast("bigint")
    rows = scored.groupBy(*key, part.alias("_part")).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), code.alias("code"), F.col("pred").cast("string").alias("pred")))).alias("rows"))
    entries = F.sequence(_num(0), F.when(F.col("_part") == 0, 0).otherwise(limit * width - 1).cast("bigint"))
    step = _attempt(retry_wrong, limit)
    maps = F.transform(entries, lambda s: F.aggregate("rows", _run_state(F.floor(s / width).cast("bigint"), s % width), step))
    blocks = rows.select(*key, F.struct("_part", maps.alias("map")).alias("m")).groupBy(*key).agg(F.array_sort(F.collect_list("m")).alias("maps"))
    r = blocks.select(*key, F.aggregate("maps", _run_state(_num(0), _num(0)), _then(width)).alias("r")).select(*key, "r.*")
    return r.withColumn("final", F.when(F.col("over"), F.col("last")).otherwise(F.coalesce("answer", "last"))).drop("answer", "last")


def best_of_n(scored: DataFrame, retry_wrong: int = 0, retry: int = 1, key=("model", "question_id"),
              order: str = "attempt_mq") -> DataFrame:
    """The attempt that stands per key (see ``attempt_runs``): the right
    one, the killed or aborted one, or the last answer."""
    key = list(key)
    code = F.col("final.code")
    return attempt_runs(scored, retry_wrong, retry, key, order).select(
        *key, F.col("n").alias("n_attempts"), F.col("final.at").alias("final_attempt"),
        F.when(~code.isin("max_tokens", "failed", "killed"), F.col("final.pred")).alias("final_pred"),
        F.when(code == "right", F.lit("ok")).otherwise(code).alias("final_status"), (code == "right").cast("int").alias("correct"))


def attempt_accounting(scored: DataFrame, retry_wrong: int = 0, retry: int = 1, key=("model", "question_id"),
                       order: str = "attempt_mq") -> DataFrame:
    """A10: attempts made and max-token attempts per key, whether it was
    aborted, and the backoff waited."""
    key = list(key)
    return attempt_runs(scored, retry_wrong, retry, key, order).select(
        *key, F.col("n").alias("attempts"), F.col("max_tokens").alias("max_token_attempts"),
        (F.col("over") & (F.col("final.code") == "max_tokens")).cast("int").alias("aborted"), F.col("wait").alias("wait_seconds"))


def status_counts(questions: DataFrame, results: DataFrame, by=("category",)) -> DataFrame:
    """Success / wrong / pending per group and the live accuracy
    success / (success + wrong) * 100 (0 when nothing finished). ``results``
    holds one row per finished question (``question_id``, ``pred``); one
    without a prediction is wrong, pending is what has no row."""
    by = list(by)
    r = results.select("question_id", F.col("pred").alias("_pred"), F.lit(1).alias("_done"))
    j = questions.select("question_id", "answer", *by).join(r, "question_id", "left")
    g = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("_pred") == F.col("answer")).alias("success"),
        F.count_if(F.col("_done").isNotNull() & ~F.coalesce(F.col("_pred") == F.col("answer"), F.lit(False))).alias("wrong"))
    return g.select(*by, "total", "success", "wrong",
                    (F.col("total") - F.col("success") - F.col("wrong")).alias("pending"),
                    F.coalesce(F.try_divide(F.col("success") * 100.0, F.col("success") + F.col("wrong")),
                               F.lit(0.0)).alias("accuracy"))


def batch_times(calls: DataFrame, by=("model",)) -> DataFrame:
    """Per group, calls, seconds in total, per call and of the longest,
    and tokens/s, from ``calls`` with ``seconds`` and ``tokens`` of every call
    or batch."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"),
        F.max("seconds").alias("max_seconds"), F.try_divide(F.sum("tokens"), F.sum("seconds")).alias("tokens_per_second"))


def token_totals(responses: DataFrame, by=("model",), approx_quantiles: bool = False) -> DataFrame:
    """Token totals per group (sum, mean, min, max); with
    ``approx_quantiles`` also p50/p95 via bounded-memory sketches."""
    aggs = [F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("total_tokens"),
            F.avg("tokens").alias("avg_tokens"), F.min("tokens").alias("min_tokens"),
            F.max("tokens").alias("max_tokens")]
    if approx_quantiles:
        aggs.append(F.percentile_approx("tokens", [0.5, 0.95], 10000).alias("p50_p95"))
    return responses.groupBy(*by).agg(*aggs)


SKETCH_K = 1600     #: size of a quantile sketch; its rank error stays far below 1 %


def quantile_sketches(df: DataFrame, value: str, by=("model", "category"), k: int = SKETCH_K) -> DataFrame:
    """Per group ``n`` values that are not null and their ``sketch`` (KLL, a
    few KB whatever the group's size), to be stored beside a run's results and
    merged with those of other runs. A group without values has a null sketch."""
    v = F.col(value).cast("bigint")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.when(F.count(v) > 0, F.kll_sketch_agg_bigint(v, F.lit(k))).alias("sketch"))


def merged_quantiles(sketches: DataFrame, by=("model",), probs=(0.5, 0.95), k: int = SKETCH_K) -> DataFrame:
    """``quantile_sketches`` of any number of files or runs combined per
    group (map-side first): ``n`` and ``p50``, ``p95`` ... as bigint, each a
    value of the group whose rank is within 1 % of the asked one. Sketches are
    randomised, so a value may differ between runs within that bound."""
    g = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("_s"))
    return g.select(*by, "n", *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("_s", F.lit(float(p)))).alias(f"p{round(100 * p)}") for p in probs])
