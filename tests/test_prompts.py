"""Prompt strings byte for byte (FIXTURES.md goldens and the style study's
worked example)."""

from pyspark.sql import functions as F

from quizlens.functions.text import format_block, format_inline, options_line, truncate
from quizlens.operators.prompts import API_HEADER, fewshot, style_grid


def _one(spark, col, q="Q1", options=("x", "y"), cot=None):
    df = spark.createDataFrame([(q, list(options), cot)], "question string, options array<string>, cot string")
    return df.select(col).first()[0]


def test_inline_default_cot(spark):
    got = _one(spark, format_inline("question", "options", "cot"), cot="")
    assert got == "Question: Q1\nOptions: A. x\nB. y\nAnswer: Let's think step by step.\n\n"


def test_inline_strips_one_prefix(spark):
    got = _one(spark, format_inline("question", "options", "cot"), cot="A: because. The answer is (B).")
    assert got == "Question: Q1\nOptions: A. x\nB. y\nAnswer: because. The answer is (B).\n\n"


def test_inline_bare_tail_only_for_exact_prefix(spark):
    got = _one(spark, format_inline("question", "options", "cot"), cot="A: ")
    assert got == "Question: Q1\nOptions: A. x\nB. y\nAnswer: "


def test_block_target_and_exemplar(spark):
    assert _one(spark, format_block("question", "options", with_answer=False)) == \
        "Question:\nQ1\nOptions:\nA. x\nB. y\nAnswer: Let's think step by step."
    assert _one(spark, format_block("question", "options", "cot"), cot="A: Let's think step by step. Z") == \
        "Question:\nQ1\nOptions:\nA. x\nB. y\nAnswer: Let's think step by step. Z\n\n"


def test_api_header():
    assert API_HEADER.format("law") == (
        "The following are multiple choice questions (with answers) about law. Think step by step and then "
        "output the answer in the format of \"The answer is (X)\" at the end.\n\n")


def test_options_line_and_truncate(spark):
    df = spark.createDataFrame([(["a", None], "x" * 81)], "o array<string>, t string")
    r = df.select(options_line("o"), truncate("t", 80), truncate(F.lit(None).cast("string"), 80)).first()
    assert r[0] == "1. a | 2. Empty option"
    assert r[1] == "x" * 80 + "..."
    assert r[2] == ""


Q = ("The quantum efficiency of a photon detector is 0.1. If 100 photons are sent into the detector, "
     "one after the other, the detector will detect photons")
OPTS = ["an average of 10 times, with an rms deviation of about 4",
        "an average of 10 times, with an rms deviation of about 3",
        "an average of 10 times, with an rms deviation of about 1",
        "an average of 10 times, with an rms deviation of about 0.1"]
BODY = {
    1: "Question: {q}\nOptions:\n(A) {0}\n(B) {1}\n(C) {2}\n(D) {3}\n\nCorrect Answer:",
    2: "**Question**: {q}\nOptions:\n(A) {0}\n(B) {1}\n(C) {2}\n(D) {3}\n\n**Correct Answer**:",
    3: "Q: {q}\nOptions:\n(A) {0}\n(B) {1}\n(C) {2}\n(D) {3}\n\nThe Best Choice: ",
    4: "Question:\n{q} A) {0}, B) {1}, C) {2}, D) {3}, \nThe most likely option is ",
    5: "Question: {q}\nOptions:\nA. {0}\nB. {1}\nC. {2}\nD. {3}\n\nYour choice: ",
    6: "**Question**: {q} (A) {0} (B) {1} (C) {2} (D) {3} \n**Answer**:",
}


def test_style_grid_worked_example(spark):
    df = spark.createDataFrame([(1, "physics", Q, OPTS)],
                               "question_id long, category string, question string, options array<string>")
    rows = {r["style_id"]: r["prompt"] for r in style_grid(df).collect()}
    assert len(rows) == 24
    header3 = "The following are multiple choice questions (with answers) about physics."
    for f, body in BODY.items():
        assert rows[2 * 6 + f] == header3 + "\n\n" + body.format(*OPTS, q=Q)


def test_header_template_from_file_equals_builtin(spark):
    import tempfile
    from conftest import SF_SMALL
    from quizlens.operators.clean import clean_options
    from quizlens.operators.prompts import LOCAL_HEADER_TEMPLATE, fewshot
    from quizlens.sources import fixtures as fx
    from quizlens.sources.results import header_template
    d = tempfile.mkdtemp(prefix="quizlens-tpl-")
    with open(f"{d}/initial_prompt.txt", "w") as f:
        f.write(LOCAL_HEADER_TEMPLATE)
    q = clean_options(fx.questions(spark, SF_SMALL))
    test, ex = q.where(F.col("split") == "test"), q.where(F.col("split") == "validation")
    a = {r.question_id: r.prompt for r in fewshot(test, ex, 5, "local").collect()}
    b = {r.question_id: r.prompt for r in
         fewshot(test, ex, 5, "local", template=header_template(spark, f"{d}/initial_prompt.txt")).collect()}
    assert a == b and all(p.startswith("The following are multiple choice questions") for p in a.values())


def test_question_without_category_has_a_prompt(spark):
    row = "question_id long, category string, question string, options array<string>, cot_content string, answer string"
    test = spark.createDataFrame([(1, None, Q, OPTS, "", "A")], row)
    ex = spark.createDataFrame([(2, None, Q, OPTS, "A: x", "A"), (3, "law", Q, OPTS, "A: x", "A")], row)
    for style in ("api", "local"):
        r = fewshot(test, ex, 5, style).first()
        assert r.n_shots == 0 and Q in r.prompt and "None" not in r.prompt.split(Q)[0]
    rows = style_grid(test).collect()
    assert len(rows) == 24 and all(Q in r.prompt for r in rows)


def test_blocks_make_the_same_prompts(spark):
    """Blocks carry a prefix once; the function gets the whole prompts of ``fewshot``, each of them once."""
    from quizlens.operators.generate import generate
    from quizlens.operators.prompts import fewshot
    cols = "question_id long, question string, options array<string>, cot_content string, category string"
    qs = spark.createDataFrame([(i % 90, f"question {i}", ["x", "y"], "", ("law", "art", "none", None)[i % 4]) for i in range(100)] + [(200, None, ["x"], "", "law")], cols)
    ex = spark.createDataFrame([(1000 + i, f"shown {i}", ["x", "y"], "A: so. The answer is (A).", ("law", "art")[i % 2]) for i in range(7)], cols)
    whole = sorted((r.question_id, r.prompt or "") for r in fewshot(qs, ex).collect())
    blocks = fewshot(qs, ex, block_size=10)
    assert blocks.count() < len(whole)
    out = generate(blocks, lambda ps: [p.upper().lower() and p for p in ps]).collect()
    assert sorted((r.question_id, r.response or "") for r in out) == whole
    assert [r.question_id for r in out if r.error] == [200]


def test_style_grid_spreads_questions(spark):
    """One file of few questions is dealt over all tasks before each becomes 24 prompts."""
    qs = spark.createDataFrame([(i, f"question {i}", ["x", "y"], "law") for i in range(80)], "question_id long, question string, options array<string>, category string").coalesce(1)
    g = style_grid(qs)
    assert g.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert g.groupBy("question_id").count().where("count = 24").count() == 80
