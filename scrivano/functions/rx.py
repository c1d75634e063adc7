"""Regular-expression helpers with one meaning on every engine.

Patterns spell out Unicode classes and use ``(?md)`` for line anchors, so that
``$`` stops at a newline only.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's ``\s`` is ASCII only.
SPACE = r"[\s\x{85}\p{Z}]"
#: Word characters as Unicode has them.
WORD = r"[\p{L}\p{N}_]"


def sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return sub(text, rf"^{SPACE}+|{SPACE}+\z", "")


def nospace(text: Column) -> Column:
    """Without any white space; a key for loose comparison."""
    return sub(text, rf"{SPACE}+", "")


class Step(NamedTuple):
    """A rewriting step: its name, pattern and replacement."""

    name: str
    pattern: str
    replacement: str = ""


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f mentions it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rewrite(text: Column, steps: Iterable[Step]) -> Column:
    """Apply steps in order."""
    return reduce(lambda t, s: sub(t, s.pattern, s.replacement), steps, text)


def rewrite_counted(text: Column, steps: Iterable[Step]) -> tuple[Column, dict[str, Column]]:
    """The rewritten text, and for each step the matches it met in its input."""
    counts = {}
    for s in steps:
        counts[s.name] = F.regexp_count(text, F.lit(s.pattern))
        text = sub(text, s.pattern, s.replacement)
    return text, counts


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def map_lines(text: Column, f) -> Column:
    """Apply f to each line."""
    return F.array_join(F.transform(lines(text), f), "\n")


def any_of(words: Iterable[str]) -> str:
    """A pattern for any of the words; a longer one goes before those it begins with."""
    return "|".join(rf"\Q{w}\E" for w in sorted(set(words), key=lambda w: (-len(w), w)))
