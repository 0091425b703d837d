"""Question / result clean-up, subject selection and predicates (P1-P9,
P14). All are projections and filters: narrow, no shuffle, pushed into the
scan where a predicate allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import letter_at, letter_index

# The browser's defaults for missing or null result fields.
RESULT_DEFAULTS = {
    "category": "Unknown",
    "question_id": "Unknown",
    "question": "No question text",
    "options": [],
    "answer": "Unknown",
    "pred": "Unknown",
    "answer_index": 0,
    "cot_content": "",
    "model_outputs": "",
    "src": "Unknown",
}


def clean_options(df: DataFrame, col: str = "options") -> DataFrame:
    """Drop ``N/A`` options, keep order; null entries stay (the
    reference compares with ``!=``, which keeps None)."""
    return df.withColumn(col, F.filter(col, lambda o: ~o.eqNullSafe(F.lit("N/A"))))


def select_category(df: DataFrame, category: str) -> DataFrame:
    """One category (an equality the parquet reader can push down)."""
    return df.where(F.col("category") == category)


def select_subjects(df: DataFrame, subjects, strict: bool = True,
                    match: str = "exact") -> DataFrame:
    """P4 / P5. ``subjects``: ``'all'``, a comma list or a list.

    exact: ``category IN (...)``; with ``strict`` an unknown name raises
    (the reference fails with KeyError). substring: an argument with spaces
    as ``_`` contained in the category with spaces as ``_``; a category
    matched by two arguments appears once (the reference would run it twice).
    """
    if isinstance(subjects, str):
        if subjects == "all":
            return df
        subjects = subjects.split(",")
    subjects = list(subjects)
    cat = F.col("category")
    if match == "exact":
        if strict:
            found = {r[0] for r in df.where(cat.isin(subjects)).select("category").distinct().collect()}
            missing = [s for s in subjects if s not in found]
            if missing:
                raise KeyError(f"unknown subjects: {missing}")
        return df.where(cat.isin(subjects))
    if match == "substring":
        norm = F.replace(cat, F.lit(" "), F.lit("_"))
        cond = F.lit(False)
        for s in subjects:
            cond = cond | F.contains(norm, F.lit(s.replace(" ", "_")))
        return df.where(cond)
    raise ValueError("match must be 'exact' or 'substring'")


def categories_first_seen(df: DataFrame, order: str = "question_id") -> DataFrame:
    """Distinct categories with their first position; sort by
    ``first_seq`` for first-seen order or by ``category`` (the local runner
    sorts)."""
    return df.groupBy("category").agg(F.min(order).alias("first_seq"),
                                      F.count(F.lit(1)).alias("n"))


def fill_defaults(df: DataFrame, defaults: dict = RESULT_DEFAULTS) -> DataFrame:
    """A missing or null field takes its default; a missing column is
    added. ``question_id`` keeps its type (its ``'Unknown'`` is applied only
    in report text)."""
    out = df
    for name, val in defaults.items():
        if name == "question_id":
            continue
        if name == "options":
            lit = F.array().cast("array<string>")
        else:
            lit = F.lit(val)
        if name in df.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), lit))
        else:
            out = out.withColumn(name, lit)
    return out


def wrong_answers(df: DataFrame, category: str | None = None) -> DataFrame:
    """Rows whose answer differs from pred after P7 (two nulls both
    become ``Unknown`` and count as right), for all or one category."""
    w = fill_defaults(df).where(F.col("answer") != F.col("pred"))
    return w if category in (None, "all") else w.where(F.col("category") == category)


def find_by_id(wrong: DataFrame, qid: str, order: str = "seq") -> DataFrame:
    """First wrong row whose id matches case-insensitively (top-1 is
    the feature: a TakeOrderedAndProject, no global sort)."""
    return (wrong.where(F.lower(F.col("question_id").cast("string")) == qid.strip().lower())
                 .orderBy(order).limit(1))


def with_letters(df: DataFrame) -> DataFrame:
    """Letter <-> 0-based index in both directions."""
    return df.withColumn("answer_letter", letter_at("answer_index")) \
             .withColumn("letter_index", letter_index("answer"))
