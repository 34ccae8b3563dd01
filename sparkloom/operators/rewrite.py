"""A program of ordered rewrites over texts, with look-ups in a vocabulary of any size.

Rules are data. A `Rewrite` replaces its matches; a `Mend` does so where words made from the match are
known, or are not. Rules that follow each other without a look-up share a phase with the first mends after
them. For each phase one pass lists the words that its mends ask for, one join finds out which of them
the vocabulary has, and a second pass rewrites. Patterns are compiled once in a worker; the vocabulary is
neither collected nor sent.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


@dataclass(frozen=True)
class Rewrite:
    pattern: str
    to: str  #: a template, as in `re.Match.expand`
    flags: int = 0


@dataclass(frozen=True)
class Mend:
    """known and unknown: templates of words (compared in small letters) that the vocabulary must and must
    not have. swap: letters to be replaced in the match before templates are filled, and in the result."""

    pattern: str
    to: str
    known: tuple[str, ...] = ()
    unknown: tuple[str, ...] = ()
    swap: tuple[tuple[str, str], ...] = ()
    flags: int = 0


Rule = Rewrite | Mend


@cache
def _compiled(pattern: str, flags: int) -> re.Pattern:
    return re.compile(pattern, flags)


def _swapped(rule: Mend, text: str) -> str:
    for a, b in rule.swap:
        text = text.replace(a, b)
    return text


def _asked(rule: Mend, m: re.Match) -> tuple[list[str], list[str]]:
    own = m[0].lower()
    fill = lambda t: own if t == "=" else _swapped(rule, m.expand(t)).lower()  # noqa: E731 "=": the match as it is
    return [fill(t) for t in rule.known], [fill(t) for t in rule.unknown]


def phases(rules: list[Rule]) -> list[list[Rule]]:
    """Cuts a program before each rewrite that follows a mend, and between mends: what a mend changes may
    be matched by the next, whose words are looked up after it."""
    out: list[list[Rule]] = []
    for r in rules:
        if not out or isinstance(out[-1][-1], Mend):
            out.append([])
        out[-1].append(r)
    return out


def plainly(phase: list[Rule], text: str) -> str:
    for r in phase:
        if isinstance(r, Rewrite):
            text = _compiled(r.pattern, r.flags).sub(r.to, text)
    return text


def questions(phase: list[Rule], text: str | None) -> list[str]:
    """The words that the phase's mend asks for, once its rewrites are done."""
    if not text or not isinstance(phase[-1], Mend):
        return []
    text, rule = plainly(phase, text), phase[-1]
    return sorted({w for m in _compiled(rule.pattern, rule.flags).finditer(text) for part in _asked(rule, m) for w in part})


def run_phase(phase: list[Rule], text: str | None, known: Callable[[str], bool]) -> str | None:
    if text is None:
        return None
    text, rule = plainly(phase, text), phase[-1]
    if isinstance(rule, Rewrite):
        return text

    def mended(m: re.Match) -> str:
        must, must_not = _asked(rule, m)
        holds = all(map(known, must)) and not any(map(known, must_not))
        return _swapped(rule, m.expand(rule.to)) if holds else m[0]

    return _compiled(rule.pattern, rule.flags).sub(mended, text)


def _functions(phase: list[Rule]):
    @F.pandas_udf("array<string>")
    def asked(text: pd.Series) -> pd.Series:
        return text.map(lambda t: questions(phase, t))

    @F.pandas_udf("string")
    def done(text: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([run_phase(phase, t, (set() if k is None else set(k)).__contains__) for t, k in zip(text, known)], dtype=object)

    return asked, done


def rewritten(rows: DataFrame, id: str, text: str, rules: list[Rule], vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """rows with `text` rewritten by all rules in order. id: one value a row. Null texts stay null."""
    words = vocabulary.select(F.lower(word).alias("_w")).distinct()
    for n, phase in enumerate(phases(rules)):
        asked, done = _functions(phase)
        if isinstance(phase[-1], Rewrite):
            rows = rows.withColumn(text, done(text, F.array().cast("array<string>")))
            continue
        own = rows.select(id, F.explode(asked(text)).alias("_w")).join(words, "_w", "left_semi").groupBy(id).agg(F.collect_list("_w").alias("_known"))
        rows = stored(rows.join(own, id, "left").withColumn(text, done(text, "_known")).drop("_known"), f"phase-{n}")
    return rows


#: Rules for texts that were scanned from typescript, none of them for one typeface.
GENERAL: list[Rule] = [
    Rewrite(r"[ \t]+", " "),
    Rewrite(r"[‘’]", "'"),
    Rewrite(r"[“”]", '"'),
    Rewrite(r" ([.,;:?!])(?=\s|$)", r"\1"),
    Rewrite(r"\b([0-9]*)[lI]([0-9]+)\b", r"\g<1>1\2"),
    Mend(r"\b([A-Za-z]+)- ([a-z]+)\b", r"\1\2", known=(r"\1\2",)),
    Mend(r"\b[A-Za-z]*(?:[A-Za-z]0|0[A-Za-z])[A-Za-z0]*\b", r"\g<0>", known=(r"\g<0>",), unknown=("=",), swap=(("0", "o"),)),
    Mend(r"\b[A-Za-z]*(?:[A-Za-z]1|1[A-Za-z])[A-Za-z1]*\b", r"\g<0>", known=(r"\g<0>",), unknown=("=",), swap=(("1", "l"),)),
    Mend(r"\b[a-z]*rn[a-z]*\b", r"\g<0>", known=(r"\g<0>",), unknown=("=",), swap=(("rn", "m"),)),
    Mend(r"\b([a-z]{2,}) ([a-z]{2,})\b(?! ?-)", r"\1\2", known=(r"\1\2",), unknown=(r"\1", r"\2")),
    Rewrite(r"\b([a-z]{3,}) \1\b", r"\1"),
]
