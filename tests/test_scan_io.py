"""Blocked scans equal plain windows; result files round-trip and bad
files are quarantined."""

import json
import os
import re
import random
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from quizlens.operators import scan
from quizlens.sources.results import read_result_files, read_results, write_results


def _data(spark, n=400, keys=3, seed=7):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(keys), i * 3 + rnd.randrange(3), rnd.choice([None, rnd.randrange(10)])) for i in range(n)]
    return spark.createDataFrame(rows, "k int, o long, v int")


def test_running_sum_matches_window(spark):
    df = _data(spark)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp = {(r.k, r.o): r.s for r in df.select("k", "o", F.sum("v").over(w).alias("s")).collect()}
    for block in (1, 5, 64, 10_000):
        got = {(r.k, r.o): r.s for r in scan.running_sum(df, "k", "o", F.col("v"), "s", (), block).collect()}
        assert got == exp


def test_carry_forward_and_next_match_window(spark):
    df = _data(spark)
    wr = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp_cf = {(r.k, r.o): r.c for r in df.select("k", "o", F.last("v", True).over(wr).alias("c")).collect()}
    exp_nx = {(r.k, r.o): r.n for r in df.select("k", "o", F.lead("o").over(Window.partitionBy("k").orderBy("o"))
                                                 .alias("n")).collect()}
    for block in (1, 7, 100_000):
        cf = {(r.k, r.o): r.c for r in scan.carry_forward(df, "k", "o", F.col("v"), "c", (), block).collect()}
        nx = {(r.k, r.o): r.n for r in scan.next_value(df, "k", "o", "o", "n", (), block).collect()}
        assert cf == exp_cf and nx == exp_nx


def test_result_files_and_quarantine(spark):
    d = tempfile.mkdtemp(prefix="quizlens-results-")
    rows = [{"question_id": 1, "question": "q1", "options": ["a", "b"], "answer": "A", "answer_index": 0,
             "cot_content": "", "category": "law", "src": "s", "pred": "A", "model_outputs": "The answer is (A)"},
            {"question_id": 2, "question": "q2", "options": ["a", "b"], "answer": "B", "answer_index": 1,
             "cot_content": "", "category": "law", "src": "s", "pred": None, "model_outputs": "x"}]
    with open(os.path.join(d, "law_result.json"), "w") as f:
        json.dump(rows, f)
    with open(os.path.join(d, "math_result.json"), "w") as f:
        f.write('[{"question_id": 3, "question": ')          # broken
    with open(os.path.join(d, "bio_result.json"), "w") as f:
        json.dump({"question_id": 4}, f)                      # not an array
    good, bad = read_result_files(spark, os.path.join(d, "*_result.json*"))
    g = sorted((r.file_category, r.seq, r.question_id, r.pred) for r in good.collect())
    assert g == [("law", 0, 1, "A"), ("law", 1, 2, None)]
    reasons = sorted((os.path.basename(r.file_path), r.reason) for r in bad.collect())
    assert reasons == [("bio_result.json", "not a JSON array"), ("math_result.json", "malformed JSON")]


def test_versioned_results(spark):
    base = tempfile.mkdtemp(prefix="quizlens-versions-")
    df1 = spark.createDataFrame([(1, "law", "A")], "question_id long, category string, pred string")
    df2 = spark.createDataFrame([(1, "law", "B"), (2, "math", "C")], "question_id long, category string, pred string")
    write_results(df1, base)
    write_results(df2, base)
    back = sorted((r.question_id, r.category, r.pred) for r in read_results(spark, base).collect())
    assert back == [(1, "law", "B"), (2, "math", "C")]


def test_versions_survive_failures_and_keep_text(spark):
    base = tempfile.mkdtemp(prefix="quizlens-versions-")
    df = spark.createDataFrame([(7, 1, "01", "A")], "seq long, question_id long, category string, pred string")
    path = write_results(df, base)
    broken = df.select("*", F.raise_error(F.lit("stopped")).cast("string").alias("model_outputs"))
    try:
        write_results(broken, base)
        raise AssertionError("the write did not fail")
    except Exception as e:
        assert "stopped" in str(e)
    r = read_results(spark, base).first()
    assert (r.seq, r.question_id, r.category, r.pred) == (7, 1, "01", "A")
    with open(os.path.join(path, "_category=01", "part-x.json"), "w") as f:
        f.write('{"question_id": \n{"seq": 8, "question_id": 2, "category": "01"}\n')
    good, bad = read_results(spark, base, quarantine=True)
    assert sorted(x.question_id for x in good.collect()) == [1, 2] and [x[1] for x in bad.collect()] == ['{"question_id": ']
    try:
        read_results(spark, base).collect()
        raise AssertionError("a corrupt line was dropped")
    except Exception as e:
        assert "MALFORMED" in str(e) or "Malformed" in str(e)


def test_per_file_accuracy_of_result_files(spark):
    from quizlens.operators.score import per_file_accuracy
    d = tempfile.mkdtemp(prefix="quizlens-files-")
    row = lambda i, text: {"question_id": i, "options": ["a", "b"], "answer": "A", "answer_index": 0, "model_outputs": text}
    with open(f"{d}/law_result.json", "w") as f:
        json.dump([row(1, "answer is (A)"), row(2, "answer is (B)")], f)
    with open(f"{d}/law_result.jsonl", "w") as f:
        json.dump([row(1, "Answer: A")], f)
    good, _ = read_result_files(spark, f"{d}/*")
    assert {r.file_category for r in good.collect()} == {"law", "lawl"}
    got = {(os.path.basename(r.file_path), r.level): (r.succ, r.fail) for r in per_file_accuracy(good, by=("file_path",)).collect()}
    assert got[("law_result.json", "l2")] == (1, 1) and got[("law_result.jsonl", "l2")] == (1, 0) and len(got) == 4


def test_read_questions_has_a_fixed_schema(spark):
    from quizlens.sources.tables import read_questions
    d = tempfile.mkdtemp(prefix="quizlens-split-")
    with open(f"{d}/test.json", "w") as f:
        f.write(json.dumps({"question_id": 5, "question": "q", "options": ["a", "N/A", "b"], "answer": "B", "answer_index": 2, "cot_content": "", "category": "law", "src": "s"}))
    r = read_questions(spark, f"{d}/test.json", "json", "test").first()
    assert (r.question_id, r.options, r.split) == (5, ["a", "b"], "test")


def test_generation_fails_row_by_row(spark):
    from quizlens.operators.generate import generate, token_count_udf

    def f(prompts):
        if "bad" in prompts:
            raise ValueError("no bad prompts")
        return [p.upper() for p in prompts]
    df = spark.createDataFrame([(i, "bad" if i % 9 == 0 else "ok") for i in range(64)], "question_id long, prompt string").coalesce(1)
    got = {r.question_id: (r.response, r.error) for r in generate(df, f).collect()}
    assert all(got[i] == ((None, "ValueError: no bad prompts") if i % 9 == 0 else ("OK", None)) for i in range(64))
    assert [r[0] for r in spark.createDataFrame([("a b",), (None,)], "t string").select(token_count_udf("t", encode=list)).collect()] == [3, None]


def test_kshot_with_a_counter_that_is_not_additive(spark):
    from quizlens.operators.prompts import fit_kshot
    q = spark.createDataFrame([(1, "law", "q", ["a", "b"], ""), (2, None, "q", ["a"], "")],
                              "question_id long, category string, question string, options array<string>, cot_content string")
    ex = spark.createDataFrame([(9, "law", "e", ["a", "b"], "A: x")], q.schema)
    chars = lambda c: F.length(c).cast("bigint")
    whole = {r.question_id: (r.k, r.tokens) for r in fit_kshot(q, ex, 5, 10_000, counter=chars).collect()}
    assert set(whole) == {1, 2} and whole[1][0] == 1 and whole[2][0] == 0
    assert {r.question_id for r in fit_kshot(q, ex, 5, 10_000).collect()} == {1, 2}
    prompts = {r.question_id: len(r.prompt) for r in fit_kshot(q, ex, 5, 10_000, counter=chars).collect() if r.prompt}
    assert all(whole[i][1] == n for i, n in prompts.items())


def test_long_response_is_assembled_in_linear_time(spark):
    from quizlens.operators.prompts import assemble
    n = 100_000
    c = spark.range(n).select(F.lit(1).alias("request_id"), F.col("id").alias("seq"), F.lit("").alias("reasoning"), F.lit("a ").alias("content"),
                              F.when(F.col("id") == 10, F.lit(7)).cast("bigint").alias("usage_total_tokens"))
    r = assemble(c, max_tokens=10 * n).first()
    assert (r.status, r.n_chunks, r.est_tokens, r.final_tokens, len(r.response)) == ("ok", n - 1, n - 1, 7, 2 * (n - 1))
    assert assemble(c, max_tokens=500).first().n_chunks == 501


def test_summary_history_and_report_sinks(spark):
    from quizlens.operators.report import report_lines, summary_json
    from quizlens.sources.results import append_history, write_report, write_summary
    d = tempfile.mkdtemp(prefix="quizlens-sinks-")
    summ = spark.createDataFrame(
        [("m", "law", 3, 1, 2, 1 / 3), ("m", "math", 4, 2, 2, 0.5), ("m", "total", 7, 3, 4, 3 / 7)],
        "model string, category string, n long, corr long, wrong long, acc double")
    write_summary(summary_json(summ), f"{d}/summary")
    line = spark.read.text(f"{d}/summary").first()[0]
    model, js = line.split("\t")
    parsed = json.loads(js)
    assert model == "m" and list(parsed) == ["law", "math", "total"]
    assert parsed["total"] == {"corr": 3, "wrong": 4, "acc": 3 / 7}
    write_report(report_lines(summ), f"{d}/report")
    lines = [r[0] for r in spark.read.text(f"{d}/report").collect()]
    assert lines == ["Average accuracy 0.3333 - law", "Average accuracy 0.5000 - math",
                     "Average accuracy: 0.4286"]
    hist = spark.createDataFrame([("llama", "CoT", "all", "12-02_10-00", 0.5)],
                                 "model string, mode string, subjects string, time string, acc double")
    append_history(hist, f"{d}/history")
    append_history(hist, f"{d}/history")
    assert spark.read.csv(f"{d}/history").count() == 2


def test_fixed_decimal_rounds_half_to_even(spark):
    from quizlens.operators.report import fixed_decimal
    df = spark.createDataFrame([(1, 8), (3, 8), (5, 16), (2, 3), (0, 5), (7, 7)], "n long, d long")
    got = [r[0] for r in df.select(fixed_decimal("n", "d", 2)).collect()]
    assert got == ["0.12", "0.38", "0.31", "0.67", "0.00", "1.00"]


def test_read_categories_prunes(spark):
    from quizlens.sources.results import read_categories
    base = tempfile.mkdtemp(prefix="quizlens-categories-")
    rows = [(i, c, "A") for i, c in enumerate(["law", "math", "01", "", None, "law", "a/b=c d"])]
    df = spark.createDataFrame(rows, "question_id long, category string, pred string")
    write_results(df, base)
    ids = lambda d: sorted(r.question_id for r in d.collect())
    table = lambda *c: spark.createDataFrame([(x,) for x in c], "category string")
    for names, want in [(["law"], [0, 5]), (["01", "a/b=c d", "none"], [2, 6]), ([""], [3]), ([None], [4]), ([None, "math", ""], [1, 3, 4]), ([], [])]:
        assert ids(read_categories(spark, base, names)) == want
        assert ids(read_categories(spark, base, table(*names, *names))) == want
    plan = read_categories(spark, base, ["law"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_category", plan)
    plan = read_categories(spark, base, table("law", "x").where("category > 'b'"))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_history_counts_a_retried_run_once(spark):
    from quizlens.sources.results import append_history, read_history
    path = tempfile.mkdtemp(prefix="quizlens-history-") + "/h"
    row = "model string, mode string, subjects string, time string, acc double"
    hist = spark.createDataFrame([("llama, 7b", "CoT", "[all]", "12-02_10-00", 0.5)], row)
    for run in ("a/1", "a/1", "b"):
        append_history(hist, path, run)
    append_history(hist, path)
    got = read_history(spark, path, hist.schema).collect()
    assert len(got) == 3 and all(tuple(r) == tuple(hist.first()) for r in got)
