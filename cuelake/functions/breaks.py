"""Where a sentence or a paragraph ends between two cues: one table of rules for both forms.

The rules of a table are asked in order, and the first whose fact and limits hold decides; if none does,
the cues stay together. `decide` asks facts that are Python callables, `decided` facts that are columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


class BreakRule(NamedTuple):
    fact: str
    breaks: bool
    least_ms: float = -INF  # silence between the cues: at least, and below
    below_ms: float = INF
    span_ms: float = -INF  # length of the paragraph so far with the next cue, at least


# The order of the rules and their limits, and the endings they look for.
SENTENCE_RULES = [
    BreakRule("other speaker", True),
    BreakRule("turn mark", True),
    BreakRule("short", False, below_ms=5000),
    BreakRule("any", True, least_ms=3200),
    BreakRule("closed", True, least_ms=250),
    BreakRule("closed", False),
    BreakRule("korean closed", True, least_ms=450),
    BreakRule("capital follows", True, least_ms=800),
]
PARAGRAPH_RULES = [
    BreakRule("other speaker", True),
    BreakRule("turn mark", True),
    BreakRule("short", False, below_ms=5000),
    BreakRule("any", True, least_ms=2600),
    BreakRule("stop", True, least_ms=700),
    BreakRule("stop", True, span_ms=8000),
    BreakRule("any", True, span_ms=14000),
]
SHORT_KEY, MARKED_KEY = 6, 8  # key characters: at most for a short cue, more than for a marked one
KOREAN_SENTENCE_END = "(?:다|요|죠|니다|까요|세요)[.!?…]*$"
KOREAN_PARAGRAPH_END = "(?:다|요|죠|니다)\\.?$"
LOW_END, CAPITAL_START = "[a-z0-9)]$", "^[A-Z]"


def decide(rules: list[BreakRule], facts: dict[str, Callable[[], object]], elapsed: float, span: float = 0.0) -> bool:
    for rule in rules:
        if rule.least_ms <= elapsed < rule.below_ms and span >= rule.span_ms and facts[rule.fact]():
            return rule.breaks
    return False


def decided(rules: list[BreakRule], facts: dict[str, Column], elapsed: Column, span: Column | None = None) -> Column:
    def holds(rule: BreakRule) -> Column:
        limits = [
            elapsed >= rule.least_ms if rule.least_ms > -INF else None, elapsed < rule.below_ms if rule.below_ms < INF else None,
            span >= rule.span_ms if rule.span_ms > -INF else None,
        ]
        return reduce(lambda a, b: a & b, [x for x in limits if x is not None], facts[rule.fact])

    first, *others = rules
    return reduce(lambda done, rule: done.when(holds(rule), rule.breaks), others, F.when(holds(first), first.breaks)).otherwise(False)
