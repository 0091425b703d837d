"""Column builders for letters, prompt text, report text and statuses.

All of them are native Spark expressions (no Python per row), so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Option letters (API runners stop at J, the batch runner's
# map goes on to P), and the sentinel outputs written instead of a response.
LETTERS = "ABCDEFGHIJ"
LETTERS16 = "ABCDEFGHIJKLMNOP"
MAX_TOKENS_TEXT = "MaxTokensExceeded"
KILLED_TEXT = "Killed by user"
ERROR_TEXT = "Error"
DEFAULT_COT = "Let's think step by step."


def _python_whitespace_class() -> str:
    """Regex class equal to Python's ``\\s`` for str patterns, built from
    ``str.isspace`` so Java (Spark) and RE2 (DuckDB) agree with it; their own
    ``\\s`` differ (vertical tab, U+001C-U+001F, U+0085, U+00A0, ...)."""
    cps = [c for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    parts, start, prev = [], cps[0], cps[0]
    for c in cps[1:] + [None]:
        if c is not None and c == prev + 1:
            prev = c
            continue
        parts.append(f"\\x{{{start:x}}}" if start == prev else f"\\x{{{start:x}}}-\\x{{{prev:x}}}")
        if c is not None:
            start = prev = c
    return "[" + "".join(parts) + "]"


WS = _python_whitespace_class()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def letter_at(idx, letters: str = LETTERS) -> Column:
    """0-based option index -> letter (null past the end)."""
    i = _c(idx)
    return F.when((i >= 0) & (i < len(letters)), F.lit(letters).substr(i + 1, F.lit(1)))


def letter_index(letter, letters: str = LETTERS) -> Column:
    """Letter -> 0-based index; null for anything that is not one letter."""
    s = _c(letter)
    pos = F.position(s, F.lit(letters))
    return F.when((F.length(s) == 1) & (pos > 0), pos - 1).cast("int")


def _option_lines(options, letters: str, sep: str = ". ", end: str = "\n") -> Column:
    return F.array_join(
        F.transform(_c(options), lambda o, i: F.concat(
            letter_at(i, letters), F.lit(sep), F.coalesce(o, F.lit("None")), F.lit(end))), "")


def format_inline(question, options, cot=None) -> Column:
    """``Question: q\\nOptions: A. x\\n...Answer: cot\\n\\n``.

    An empty cot becomes the default reasoning cue, then one leading ``A: ``
    is removed; only a cot of exactly ``A: `` ends in a bare ``Answer: ``.
    """
    cot = F.coalesce(_c(cot), F.lit("")) if cot is not None else F.lit("")
    c1 = F.when(cot == "", F.lit(DEFAULT_COT)).otherwise(cot)
    c2 = F.when(c1.startswith("A: "), F.substring(c1, 4, 1 << 30)).otherwise(c1)
    tail = F.when(c2 == "", F.lit("Answer: ")).otherwise(F.concat(F.lit("Answer: "), c2, F.lit("\n\n")))
    return F.concat(F.lit("Question: "), _c(question), F.lit("\nOptions: "),
                    _option_lines(options, LETTERS), tail)


def format_block(question, options, cot=None, with_answer: bool = True) -> Column:
    """``Question:\\nq\\nOptions:\\nA. x\\n...`` then the exemplar's cot
    (its ``A: Let's think step by step.`` turned into ``Answer: ...``) and a
    blank line, or the bare cue for the target question."""
    head = F.concat(F.lit("Question:\n"), _c(question), F.lit("\nOptions:\n"),
                    _option_lines(options, LETTERS16))
    if not with_answer:
        return F.concat(head, F.lit("Answer: " + DEFAULT_COT))
    fixed = F.replace(F.coalesce(_c(cot), F.lit("")), F.lit("A: " + DEFAULT_COT),
                      F.lit("Answer: " + DEFAULT_COT))
    return F.concat(head, fixed, F.lit("\n\n"))


def options_line(options) -> Column:
    """R2: ``1. a | 2. b``; a null option reads ``Empty option``."""
    return F.array_join(F.transform(_c(options), lambda o, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), F.coalesce(o, F.lit("Empty option")))), " | ")


def truncate(text, n: int = 80, default: str = "") -> Column:
    """First ``n`` characters plus ``...`` when longer; null -> default."""
    t = F.coalesce(_c(text), F.lit(default))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def output_status(model_outputs) -> Column:
    """Sentinel outputs -> status; a null output is a failed call."""
    mo = _c(model_outputs)
    return (F.when(mo.isNull(), F.lit("failed"))
            .when(mo == MAX_TOKENS_TEXT, F.lit("max_tokens"))
            .when(mo == KILLED_TEXT, F.lit("killed"))
            .when(mo == ERROR_TEXT, F.lit("error"))
            .otherwise(F.lit("ok")))


def run_key(model, subjects, sep: str = "/") -> Column:
    """Model basename, ``CoT``, subjects with ``,``->``-`` and
    space->``_``, joined by ``/`` (result folder) or ``-`` (file prefix)."""
    base = F.element_at(F.split(_c(model), "/"), -1)
    subj = F.replace(F.replace(_c(subjects), F.lit(","), F.lit("-")), F.lit(" "), F.lit("_"))
    return F.concat_ws(sep, base, F.lit("CoT"), subj)


def word_count(text) -> Column:
    """T6 default token counter: runs of non-whitespace (Python's whitespace
    set). Additive over parts that end in whitespace."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")),
                                       F.lit("[^" + WS[1:-1] + "]+"), 0)).cast("bigint")


def strip_bold(text) -> Column:
    """Delete every ``**`` before extraction (API runner)."""
    return F.replace(_c(text), F.lit("**"), F.lit(""))


def _spaces_other_than_ascii() -> str:
    import unicodedata
    cps = [c for c in range(sys.maxunicode + 1)
           if c != 0x20 and unicodedata.category(chr(c)) == "Zs"]
    return "".join(f"\\x{{{c:x}}}" for c in cps)


# Python's str.isprintable() is False for categories C* and Z* except the
# ASCII space; the class is built from that rule.
NON_PRINTABLE = r"[\p{C}\p{Zl}\p{Zp}" + _spaces_other_than_ascii() + "]"


def printable(text) -> Column:
    """Drop the characters Python does not consider printable."""
    return F.regexp_replace(_c(text), NON_PRINTABLE, "")
