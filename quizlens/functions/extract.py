"""Answer extraction from free text (E1-E5) and user cascades.

A cascade is data: an ordered list of steps; the first step that finds a
letter wins. Each step compiles to one native regex expression, and the
cascade is a ``coalesce`` of them, which Spark evaluates lazily per row (the
later patterns run only when the earlier ones missed). No Python runs per
row.

Regex portability: Spark uses java.util.regex, the reference uses Python
``re``. ``\\s`` and ``\\b`` differ between them, so the patterns spell out
Python's classes explicitly (``WS``, the word class ``[\\p{L}\\p{N}_]``), and
``.`` (which in Java also stops at ``\\r``) is written ``[^\\n]``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, _c

# The answer patterns of the reference's cascades, written in
# the portable form described above.
#   level 1 / first pattern of the last-match cascade:  answer is \(?([A-J])\)?
#   "again" (first line with a hit, last hit on it):    .*[aA]nswer:\s*([A-J])
#   second pattern of the last-match cascade:            [aA]nswer:\s*([A-J])
#   "final" (last stand-alone letter, DOTALL):           \b[A-J]\b(?!.*\b[A-J]\b)
ANSWER_IS = r"answer is \(?([A-J])\)?"
ANSWER_COLON = r"[aA]nswer:" + WS + r"*([A-J])"
# Python's `.*` cannot cross "\n", so a search for `.*X` is a match anchored
# at the start of the first line holding X; anchoring with (?m)^ keeps the
# scan linear instead of retrying every start position. (?d): only "\n"
# ends a line, as in Python.
ANSWER_COLON_LINE = r"(?md)^[^\n]*" + ANSWER_COLON
WORD = r"\p{L}\p{N}_"
# The last stand-alone letter is the first one of the reversed text.
STANDALONE_REVERSED = r"(?:^|[^" + WORD + r"])([A-J])(?:[^" + WORD + r"]|$)"


@dataclass(frozen=True)
class Step:
    """One extraction step.

    pattern: Java regex. group: capture group to return.
    pick: ``first`` (leftmost match), ``last`` (last of the non-overlapping
    left-to-right matches, like ``re.findall(...)[-1]``) or ``reversed``
    (leftmost match of ``pattern`` on the reversed text; the group is
    reversed back) - a linear-time way to get a last match.
    """
    pattern: str
    group: int = 1
    pick: str = "first"

    def column(self, text: Column) -> Column:
        if self.pick == "first":
            hit = F.regexp_extract(text, self.pattern, self.group)
        elif self.pick == "last":
            hit = F.try_element_at(F.regexp_extract_all(text, F.lit(self.pattern), self.group),
                                   F.lit(-1))
        elif self.pick == "reversed":
            hit = F.reverse(F.regexp_extract(F.reverse(text), self.pattern, self.group))
        else:
            raise ValueError(f"unknown pick {self.pick!r}")
        return F.nullif(hit, F.lit(""))


E1 = Step(ANSWER_IS)
E2 = Step(ANSWER_COLON_LINE)
E3 = Step(STANDALONE_REVERSED, pick="reversed")

_CASCADES: dict[str, tuple[Step, ...]] = {
    "l1": (E1,),                                   # E1
    "again": (E2,),                                # E2 alone
    "final": (E3,),                                # E3 alone
    "l2": (E1, E2, E3),                            # E4
    "last": (Step(ANSWER_IS, pick="last"),         # E5
             Step(ANSWER_COLON, pick="last"),
             E3),
}


def register_extractor(name: str, steps) -> None:
    """register a cascade. ``steps`` are ``Step`` objects or tuples
    ``(pattern, group, pick)``."""
    norm = tuple(s if isinstance(s, Step) else Step(*s) for s in steps)
    for s in norm:
        Step.column(s, F.lit(""))  # validates ``pick`` eagerly
    _CASCADES[name] = norm


def cascades() -> list[str]:
    return sorted(_CASCADES)


def extract(text, cascade: str = "l2") -> Column:
    """Letter found by the named cascade, or null."""
    t = _c(text)
    cols = [s.column(t) for s in _CASCADES[cascade]]
    return cols[0] if len(cols) == 1 else F.coalesce(*cols)
