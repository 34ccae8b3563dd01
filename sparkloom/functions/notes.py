"""Notes on terms in texts: rules in order of priority, matches that do not overlap, families that collapse.

Rules are data. A rule takes its matches wherever no earlier rule has; of a family with several terms in
one text, the first alone stays, with the family's own note. The patterns of all rules are compiled
into one alternation as well, which passes over texts without any match in one scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """title and text may use groups of the pattern, as in `re.Match.expand`. when: the text must match it
    somewhere; only: the match itself must. family: collapses; weak: does not count as one of several."""

    pattern: str
    title: str
    text: str = ""
    ignore_case: bool = False
    when: str | None = None
    only: str | None = None
    family: str | None = None
    weak: bool = False


@dataclass(frozen=True)
class Family:
    name: str
    title: str
    text: str = ""
    least: int = 2


FOUND = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("from", T.IntegerType()), ("to", T.IntegerType()), ("title", T.StringType()), ("text", T.StringType()))]))


class Matcher:
    def __init__(self, rules: list[Rule], families: list[Family]):
        flags = lambda r: re.IGNORECASE if r.ignore_case else 0
        self.rules = [(r, re.compile(r.pattern, flags(r)), r.when and re.compile(r.when), r.only and re.compile(r.only)) for r in rules]
        ungrouped = [f"(?i:{r.pattern})" if r.ignore_case else f"(?:{r.pattern})" for r in rules if not re.search(r"\\[1-9]|\(\?P", r.pattern)]
        self.any = re.compile("|".join(ungrouped)) if len(ungrouped) == len(rules) and rules else None
        self.families = {f.name: f for f in families}

    def matches(self, text: str) -> list[tuple[int, int, Rule, re.Match]]:
        if not text or self.any and not self.any.search(text):
            return []
        taken, out = bytearray(len(text)), []
        for rule, pattern, when, only in self.rules:
            if when and not when.search(text):
                continue
            for m in pattern.finditer(text):
                a, z = m.span()
                if z > a and not any(taken[a:z]) and (not only or only.search(m[0])):
                    taken[a:z] = b"\1" * (z - a)
                    out.append((a, z, rule, m))
        return sorted(out, key=lambda x: x[0])

    def notes(self, text: str) -> list[dict]:
        found = self.matches(text)
        collapsed = {name for name, f in self.families.items() if sum(r.family == name and not r.weak for _, _, r, _ in found) >= f.least}
        out, seen = [], set()
        for a, z, rule, m in found:
            if rule.family in collapsed:
                if rule.family in seen:
                    continue
                seen.add(rule.family)
                f = self.families[rule.family]
                title, note = f.title, f.text
            else:
                title, note = m.expand(rule.title), m.expand(rule.text)
            out.append({"from": a, "to": z, "title": title, "text": note})
        return out


def notes(text: Column, rules: list[Rule], families: list[Family] = ()) -> Column:
    """Notes of a text in order: from, to (code points, end exclusive), title, text. Null has none."""

    @F.pandas_udf(FOUND)
    def found(column: pd.Series) -> pd.Series:
        matcher = Matcher(rules, list(families))
        return column.map(lambda t: matcher.notes(t or ""))

    return found(text)
