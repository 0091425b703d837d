"""Merge / dedup / resume / policies / best-of-n goldens (FIXTURES.md)."""

from pyspark.sql import functions as F

from quizlens.operators import resume as R
from quizlens.operators import score as S
from quizlens.functions.policy import CREDIT_SCALE, credit_units

ROW = "seq long, question_id long, question string, v string"


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_merge_and_dedup(spark):
    old = spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "b", "y"), (3, 1, "a2", "z")], ROW)
    new = spark.createDataFrame([(10, 1, "a", "w")], ROW)
    merged = R.merge(old, new)
    assert _rows(merged, "seq", "question_id", "question", "v") == [(1, 1, "a", "w"), (2, 2, "b", "y"), (3, 1, "a2", "z")]
    deduped = R.dedup_first(merged, "question_id", "seq")
    assert _rows(deduped, "question_id", "question", "v") == [(1, "a", "w"), (2, "b", "y")]


def test_merge_all_vs_first(spark):
    old = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "a", "x2"), (3, 2, "b", "y")], ROW)
    new = spark.createDataFrame([(10, 1, "a", "w"), (11, 1, "a", "w2"), (12, 3, "c", "n")], ROW)
    assert _rows(R.merge(old, new, mode="all"), "seq", "v") == [(1, "w2"), (2, "w2"), (3, "y"), (12, "n")]
    assert _rows(R.merge(old, new, mode="first"), "seq", "v") == [(1, "w2"), (2, "x2"), (3, "y"), (12, "n")]


def test_merge_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "a", "x"), (2, 2, "b", "y")], ROW)
    new = spark.createDataFrame([(10, 1, "a", "w"), (11, 5, "e", "q")], ROW)
    once = R.merge(old, new)
    twice = R.merge(once, new)
    assert _rows(once, "seq", "question_id", "v") == _rows(twice, "seq", "question_id", "v")


def test_pending_sets(spark):
    saved = spark.createDataFrame(
        [(1, "The answer is (A).", "A"), (2, "MaxTokensExceeded", None), (3, "no idea", None)],
        "question_id long, model_outputs string, pred string")
    qs = spark.createDataFrame([(i,) for i in range(1, 5)], "question_id long")

    def ids(mx, un):
        return sorted(r[0] for r in R.pending(qs, saved, mx, un).collect())

    assert ids(False, False) == [4]
    assert ids(True, False) == [2, 4]
    assert ids(False, True) == [3, 4]
    assert ids(True, True) == [2, 3, 4]


def test_pending_union_done_is_everything(spark):
    saved = spark.createDataFrame([(1, "x", "A"), (3, "y", None)], "question_id long, model_outputs string, pred string")
    qs = spark.createDataFrame([(i,) for i in range(1, 7)], "question_id long")
    todo = {r[0] for r in R.pending(qs, saved).collect()}
    done = {r[0] for r in saved.collect()}
    assert todo | done == set(range(1, 7)) and not (todo & done)


def test_policies_on_missing_prediction(spark):
    df = spark.createDataFrame([("m", 7, None, "B", 1, ["a", "b", "c", "d"])],
                               "model string, question_id long, pred string, answer string, answer_index int, "
                               "options array<string>")
    def credit(p):
        return df.select(credit_units("pred", "answer", "answer_index", "options", p)).first()[0] / CREDIT_SCALE
    assert credit("wrong") == 0
    assert credit("expected_options") == 0.25
    assert credit("expected10") == 0.1
    for p in ("uniform10", "uniform_options"):
        a, b = credit(p), credit(p)
        assert a in (0, 1) and a == b       # reproducible, never rand()


def test_corr_plus_wrong_is_n(spark):
    from conftest import SF_SMALL
    from quizlens.sources import fixtures as fx
    q = fx.questions(spark, SF_SMALL)
    sc = S.score(S.with_prediction(S.attach_gold(fx.responses(spark, SF_SMALL, q), q)), "uniform_options")
    for r in S.summary(sc).collect():
        assert r["corr"] + r["wrong"] == r["n"]


def test_best_of_n(spark):
    rows = [("m", 1, 1, "C", "x", 0), ("m", 1, 2, "D", "x", 0), ("m", 1, 3, "B", "x", 1), ("m", 1, 4, "B", "x", 1)]
    df = spark.createDataFrame(rows, "model string, question_id long, attempt_mq long, pred string, "
                                     "model_outputs string, hit int")
    got = {n: S.best_of_n(df, n).select("final_pred", "final_attempt").first() for n in range(4)}
    assert (got[0][0], got[1][0], got[2][0], got[3][0]) == ("C", "D", "B", "B")
    assert got[2][1] == 3 and got[3][1] == 3


def test_best_of_n_max_token_abort(spark):
    rows = [("m", 1, 1, "C", "x", 0), ("m", 1, 2, None, "MaxTokensExceeded", 0), ("m", 1, 3, "B", "x", 1)]
    df = spark.createDataFrame(rows, "model string, question_id long, attempt_mq long, pred string, "
                                     "model_outputs string, hit int")
    r = S.best_of_n(df, 5).first()
    assert r["final_attempt"] == 2 and r["final_pred"] is None and r["final_status"] == "max_tokens"


RUN = "model string, question_id long, attempt_mq long, pred string, model_outputs string, hit int"


def _run(spark, outcomes, **kw):
    """m = max tokens, f = failed call, w = wrong answer, r = right answer, k = killed."""
    text = {"m": "MaxTokensExceeded", "f": None, "w": "x", "r": "x", "k": "Killed by user"}
    rows = [("m", 1, i, "B" if o == "r" else "C" if o == "w" else None, text[o], int(o == "r")) for i, o in enumerate(outcomes, 1)]
    df = spark.createDataFrame(rows, RUN)
    return S.best_of_n(df, **kw).first(), S.attempt_accounting(df, **kw).first()


def test_attempt_accounting_backoff(spark):
    best, acc = _run(spark, "m" * 7, retry=7)
    # waits before retries 1..6: 2 + 4 + 8 + 16 + 30 + 30
    assert (acc["wait_seconds"], acc["aborted"], best["final_status"]) == (90, 1, "max_tokens")
    best, acc = _run(spark, "mmm", retry=0)
    assert (acc["attempts"], acc["aborted"], acc["wait_seconds"]) == (1, 1, 0)
    assert _run(spark, "r")[1][2:] == (1, 0, 0, 0)


def test_max_token_counter_starts_again_with_every_answer_attempt(spark):
    best, acc = _run(spark, "mwmr", retry_wrong=1, retry=2)
    assert (acc["aborted"], acc["attempts"], acc["max_token_attempts"], acc["wait_seconds"]) == (0, 4, 2, 4)
    assert (best["final_pred"], best["final_attempt"], best["correct"]) == ("B", 4, 1)
    best, acc = _run(spark, "wmmr", retry_wrong=1, retry=2)
    assert (acc["aborted"], acc["attempts"], best["final_status"], best["final_pred"]) == (1, 3, "max_tokens", None)
    # rows after the end do not count; failed calls neither count nor end anything
    best, acc = _run(spark, "wwmmr", retry_wrong=1, retry=2)
    assert (acc["attempts"], acc["max_token_attempts"], best["final_attempt"], best["final_pred"]) == (2, 0, 2, "C")
    best, acc = _run(spark, "mffr", retry=2)
    assert (acc["attempts"], acc["aborted"], best["final_attempt"], best["correct"]) == (4, 0, 4, 1)
    best, acc = _run(spark, "ff")
    assert (best["final_status"], best["final_pred"], best["correct"]) == ("failed", None, 0)


def test_killed_question_stays_killed(spark):
    best, acc = _run(spark, "kr", retry_wrong=3)
    assert (best["correct"], best["final_status"], best["final_attempt"], best["final_pred"], acc["attempts"]) == (0, "killed", 1, None, 1)
    best, acc = _run(spark, "wmkr", retry_wrong=3, retry=3)
    assert (best["correct"], best["final_status"], best["final_attempt"], acc["attempts"], acc["aborted"], acc["wait_seconds"]) == (0, "killed", 3, 3, 0, 2)
    assert _run(spark, "rk")[0]["final_status"] == "ok"


def _walk(outcomes, retry_wrong, retry):
    """The loop in plain words: (final attempt, status, attempts, max-token attempts, wait)."""
    run = wrong = full = wait = n = 0
    answer = last = None
    for i, o in outcomes:
        n, last = n + 1, (i, o)
        if o in "mf":
            if o == "m":
                run, full = run + 1, full + 1
                if run >= max(retry, 1):
                    return i, "max_tokens", n, full, wait
                wait += min(2 ** run, 30)
            continue
        run, answer = 0, (i, o)
        if o in "rk":
            return i, {"r": "ok", "k": "killed"}[o], n, full, wait
        wrong += 1
        if wrong > retry_wrong:
            break
    i, o = answer or last
    return i, {"w": "ok", "m": "max_tokens", "f": "failed"}[o], n, full, wait


def test_blocks_of_attempts_compose(spark):
    """Any cut into blocks gives what the plain loop gives; gaps and missing blocks included."""
    import random
    rnd, text = random.Random(6), {"m": "MaxTokensExceeded", "f": None, "w": "x", "r": "x", "k": "Killed by user"}
    seqs = {q: [(i, rnd.choices("mfwrk", [6, 5, 4, .3, .2])[0]) for i in sorted(rnd.sample(range(60), rnd.randrange(1, 40)))] for q in range(120)}
    df = spark.createDataFrame([("m", q, i, "B" if o == "r" else "C", text[o], int(o == "r")) for q, s in seqs.items() for i, o in s], RUN).repartition(3)
    for retry_wrong, retry in ((0, 1), (2, 2), (5, 4)):
        want = {q: _walk(s, retry_wrong, retry) for q, s in seqs.items()}
        for block in (1, 7, 1 << 14):
            runs = S.attempt_runs(df, retry_wrong, retry, block=block).collect()
            got = {r.question_id: (r.final["at"], {"right": "ok"}.get(r.final["code"], r.final["code"]), r.n, r.max_tokens, r.wait) for r in runs}
            assert got == want, (retry_wrong, retry, block)


def test_hot_key_of_attempts_is_spread(spark):
    """A third of all attempts belong to one key; no task of the first step folds more than a block or two of them."""
    n = 60000
    df = spark.range(n).select(F.lit("m").alias("model"), F.when(F.col("id") < n // 3, 0).otherwise(F.col("id")).alias("question_id"), F.col("id").alias("attempt_mq"),
                               F.lit("C").alias("pred"), F.when(F.col("id") % 3 == 0, "MaxTokensExceeded").alias("model_outputs"), F.lit(0).alias("hit"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = (df.groupBy("model", "question_id", F.floor(F.col("attempt_mq") / 512).alias("p")).agg(F.count(F.lit(1)).alias("n"))
                .where("question_id = 0").groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect())
        assert len(held) >= 4 and max(r.n for r in held) < n // 6
        plan = S.attempt_runs(df, 3, 10 ** 6 // n, block=512)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 2 and "_groupingexpression" in plan.split("Exchange hashpartitioning")[2]   # first by key and block
    r = S.attempt_runs(df, 3, 16, block=512).where("question_id = 0").first()
    assert (r.n, r.over, r.final["code"]) == (46, True, "max_tokens")


def test_answered_without_prediction_is_wrong(spark):
    q = spark.createDataFrame([(1, "A", "law"), (2, "B", "law"), (3, "C", "law"), (4, "D", "law")], "question_id long, answer string, category string")
    res = spark.createDataFrame([(1, "A", "A", 1), (2, None, "B", 2), (3, "A", "C", 3)], "question_id long, pred string, answer string, seq long")
    r = S.status_counts(q, res).first()
    assert (r["success"], r["wrong"], r["pending"]) == (1, 2, 1)
    mo = res.withColumn("model_outputs", F.when(F.col("question_id") == 3, "MaxTokensExceeded").otherwise("x"))
    assert _rows(R.resume_plan(q, mo), "question_id", "state") == [(1, "success"), (2, "wrong"), (3, "wrong"), (4, "pending")]
    assert _rows(R.resume_plan(q, mo, rerun_max_tokens=True), "question_id", "state")[2] == (3, "pending")


def test_fractional_policy_reaches_every_summary(spark):
    df = spark.createDataFrame([("m", "cot", "law", 1, None, "B", 1, ["a", "b"])], "model string, mode string, category string, question_id long, "
                               "model_outputs string, answer string, answer_index int, options array<string>")
    sc = S.score(S.with_prediction(df), "expected10")
    assert S.mode_delta(sc, policy="expected10").first()["acc_cot"] == 0.1
    assert S.leaderboard_by_category(df, df, "expected10").first()["acc"] == 0.1


def test_draws_differ_by_style_and_attempt(spark):
    rows = [("m", 1, s, a, None, "B", 1, ["a", "b", "c", "d"]) for s in range(24) for a in range(20)]
    df = spark.createDataFrame(rows, "model string, question_id long, style_id int, attempt int, pred string, answer string, answer_index int, options array<string>")
    share = S.score(df, "uniform_options").agg(F.avg("hit")).first()[0]
    assert 0.15 < share < 0.35


def test_merge_null_key_is_replaced_once(spark):
    old = spark.createDataFrame([(1, 1, None, "x")], ROW)
    new = spark.createDataFrame([(10, 1, None, "w")], ROW)
    for mode in ("all", "first"):
        once = R.merge(old, new, mode=mode)
        assert _rows(once, "seq", "v") == _rows(R.merge(once, new, mode=mode), "seq", "v") == [(1, "w")]


def test_drop_failed_union_and_shards(spark):
    df = spark.createDataFrame([(1, 1, "x"), (2, 2, None)], "seq long, question_id long, model_outputs string")
    assert _rows(R.drop_failed(df), "question_id") == [(1,)]
    other = spark.createDataFrame([(1, 9)], "question_id long, seq long")
    assert _rows(R.merge_shards([df, other]), "seq", "question_id", "model_outputs") == [(1, 1, "x"), (2, 2, None)]


def test_strict_subjects_and_exemplars(spark):
    import pytest
    from pyspark.errors import PySparkException
    from quizlens.operators.clean import select_subjects
    from quizlens.operators.prompts import fewshot
    qs = spark.createDataFrame([(1, "law", "q", ["a", "b"], "", "test"), (2, "math", "q2", ["a"], "", "test"),
                                (3, "law", "e", ["a", "b"], "A: x", "validation")],
                               "question_id long, category string, question string, options array<string>, "
                               "cot_content string, split string")
    with pytest.raises(KeyError):
        select_subjects(qs, "law,chemistry")
    assert select_subjects(qs, "la", match="substring").count() == 2
    test, ex = qs.where("split = 'test'"), qs.where("split = 'validation'")
    shots = {r.question_id: r.n_shots for r in fewshot(test, ex, 5, "local").collect()}
    assert shots == {1: 1, 2: 0}          # zero-shot for a category without exemplars
    with pytest.raises(Exception) as e:
        fewshot(test, ex, 5, "api", strict=True).collect()
    assert "no exemplars for category math" in str(e.value) or isinstance(e.value, PySparkException)


def test_merged_quantiles_are_near_the_exact_ranks(spark):
    """A group with most of the rows, one of few rows, nulls, and a group
    without a value; sketches of several runs come together."""
    from quizlens.operators.score import merged_quantiles, quantile_sketches
    d = spark.range(60000).select(F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("model"), (F.col("id") % 5).alias("category"),
                                  F.pmod(F.xxhash64("id"), F.lit(10000)).alias("t"))
    none = spark.createDataFrame([("a", 9, None), ("c", 1, None)], "model string, category long, t long")
    first, second = quantile_sketches(d.where("id < 20000"), "t"), quantile_sketches(d.where("id >= 20000").union(none), "t")
    got = {r.model: r for r in merged_quantiles(first.union(second), probs=(0.5, 0.9)).collect()}
    assert got["c"].n == 0 and got["c"].p50 is None
    for m in "ab":
        values = sorted(r.t for r in d.where(F.col("model") == m).collect())
        assert got[m].n == len(values)
        for p, v in ((0.5, got[m].p50), (0.9, got[m].p90)):
            assert v in values and abs(sum(x <= v for x in values) / len(values) - p) <= 0.01


def test_shards_are_derived_once_and_dealt_by_size(spark, monkeypatch):
    """The saved rows are made once, by tasks as many as the rows ask for, and merged by as many."""
    from quizlens.plans import q_results
    from quizlens.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(fx, "ROWS_PER_TASK", n // 19)
    assert fx.tasks(spark, sf) in (19, 20)
    out = q_results.shard_merge(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and f", {fx.tasks(spark, sf)})" in plan
    rows = out.collect()
    assert len(rows) == len({(r.model, r.question_id) for r in rows}) > 100


def test_merge_reads_old_rows_once(spark):
    """Null keys are equal; replaced rows keep their place, even if replaced by nulls."""
    row = "seq long, question_id long, question string, v string"
    old = spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "a", "y"), (3, None, None, "n"), (4, 2, None, "z")], row)
    new = spark.createDataFrame([(9, 1, "a", None), (8, 1, "a", "w"), (10, None, None, "m"), (11, None, "k", None)], row)
    out = R.merge(old, new)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert {tuple(r) for r in out.collect()} == {(1, 1, "a", None), (2, 1, "a", None), (3, None, None, "m"), (4, 2, None, "z"), (11, None, "k", None)}
