"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules are packed into one multiword Shift-And automaton: every pattern takes one bit for each of
its literals plus a start bit, `*` keeps the bit before it alive, `?` accepts any byte but the
separator. One pass over the bytes of a canonical URL moves all patterns at once. URLs are simulated
side by side in numpy, longest first, so that a few long URLs do not hold up the others.

The canonical URL is `.host`, one separator byte that UTF-8 never contains, then the path; so a rule
cannot mistake a path for a host. Rules whose host ends in a literal label can only fit URLs with that
last label, so each last label has an automaton of its rules and of those without one. A worker builds
an automaton once, when the first such URL comes; with very many rules fewer URLs run side by side.

Null URLs and those without `://` have an empty host and path. Of several rules that fit, the greatest
weight decides, then the first listed. No rows give no rows; repeated rows are each judged. Columns
host, path, rule and verdict are replaced if the table has them; all others stay.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SEP = 0xFF
STATE_WORDS = 1 << 21  #: of all URLs that run side by side


@dataclass(frozen=True)
class Rule:
    """A glob over host and path. Of several that match, the greatest weight decides, then the
    first listed. `name` is reported; None for rules that give a verdict only."""

    host: str
    path: str
    action: str
    weight: int
    name: str | None = None


def site_rule(action: str, host: str, path: str) -> Rule:
    """For a host and its subdomains, and all paths that start with `path`."""
    return Rule(f"*.{host}", f"{path}*", action, len(host) + len(path), host + path)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class ShiftAnd:
    """Rules packed into masks of 64-bit words."""

    def __init__(self, rules: list[Rule]):
        literal, anything, stays, bits = [], [], [], 0  # literal: bit and byte that moves into it
        self.starts, self.ends = [], []
        for r in rules:
            self.starts.append(bits)
            bits += 1
            for side, text in ((0, r.host), (1, r.path)):
                if side:
                    literal.append((bits, SEP))
                    bits += 1
                for c in text:
                    if c == "*":
                        stays.append(bits - 1)
                    elif c == "?":
                        anything.append(bits)
                        bits += 1
                    else:
                        for x in c.encode():
                            literal.append((bits, x))
                            bits += 1
            self.ends.append(bits - 1)
        self.words = max(1, -(-bits // 64))

        def mask(where, rows=()):
            out = np.zeros((256, self.words) if len(rows) else self.words, np.uint64)
            k = np.array(where, np.int64)
            np.bitwise_or.at(out, (np.array(rows), k // 64) if len(rows) else k // 64, np.uint64(1) << (k % 64).astype(np.uint64))
            return out

        self.first, self.stay = mask(self.starts), mask(stays)
        self.move = mask([k for k, _ in literal], [x for _, x in literal]) if literal else np.zeros((256, self.words), np.uint64)
        self.move[:SEP] |= mask(anything)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """For each text, the final state words."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[k]) for k in order])
        flat = np.frombuffer(b"".join(texts[k] for k in order), np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, int)
        state = np.repeat(self.first[None], len(texts), 0)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -step, "left"))  # texts longer than step
            c, s = flat[at[:n] + step], state[:n]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            # A star stays within its side: it does not pass the separator.
            state[:n] = (moved & self.move[c]) | np.where((c == SEP)[:, None], np.uint64(0), s & self.stay)
        out = np.empty_like(state)
        out[order] = state
        return out


class Judge:
    """Automata by the last label of the host."""

    def __init__(self, rules: list[Rule]):
        self.rules, self.built = rules, {}
        self.by_label: dict[str | None, list[int]] = defaultdict(list)
        for k, r in enumerate(rules):
            literal = r.host.replace("?", "*").rsplit("*", 1)[-1]
            self.by_label[literal.rsplit(".", 1)[1] if "." in literal else None].append(k)

    def best(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        """The number of the rule that decides, or -1."""
        labels = [h.rsplit(b".", 1)[-1].decode() for h in hosts]
        of = defaultdict(list)
        for k, x in enumerate(labels):
            of[x if x in self.by_label else None].append(k)
        out = np.full(len(hosts), -1)
        for label, where in of.items():
            if label not in self.built:
                own = sorted(self.by_label.get(label, []) + (self.by_label[None] if label is not None else []))
                self.built[label] = (own, ShiftAnd([self.rules[k] for k in own]))
            own, auto = self.built[label]
            step = max(1, STATE_WORDS // auto.words)
            order = sorted(range(len(own)), key=lambda j: (self.rules[own[j]].weight, -own[j]))
            for s in range(0, len(where), step):
                part = np.array(where[s : s + step])
                state = auto.run([b"." + hosts[k] + bytes([SEP]) + paths[k] for k in part.tolist()])
                for j in order:
                    end = auto.ends[j]
                    out[part[(state[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) == 1]] = own[j]
        return out


_BUILT: dict[str, Judge] = {}


def judge(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule (the deciding rule's name or null) and verdict."""
    sent = df.sparkSession.sparkContext.broadcast(rules)
    key = uuid.uuid4().hex  # of the automata that a worker keeps

    @F.arrow_udf("struct<rule:string,verdict:string>")
    def verdicts(host: pa.Array, path: pa.Array) -> pa.Array:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Judge(sent.value)
        own = sent.value
        best = _BUILT[key].best(host.cast(pa.binary()).to_pylist(), path.cast(pa.binary()).to_pylist())
        names, actions = [own[k].name if k >= 0 else None for k in best], [own[k].action if k >= 0 else default for k in best]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(actions, pa.string())], ["rule", "verdict"])

    said = fresh(df, "_verdict")
    out = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn(said, verdicts("host", "path"))
    return out.withColumns({"rule": F.col(f"{said}.rule"), "verdict": F.col(f"{said}.verdict")}).drop(said)
