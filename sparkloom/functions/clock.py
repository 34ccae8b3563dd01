"""Clock columns: elapsed times as seconds and as hhh:mm:ss."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(text: Column) -> Column:
    """ss, mm:ss or hhh:mm:ss, with a leading minus for times before zero; null if it is none."""
    bare = F.regexp_replace(text, "^-", "")
    total = F.aggregate(F.split(bare, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + F.coalesce(F.expr("try_cast(null as long)"), x.try_cast("long")))
    return F.when(bare.rlike(r"^\d+(:\d+){0,2}$"), F.when(text.startswith("-"), -total).otherwise(total))


def clock_text(s: Column) -> Column:
    """hhh:mm:ss, with a minus before zero."""
    a = F.abs(s.cast("long"))
    t = F.format_string("%03d:%02d:%02d", F.floor(a / 3600).cast("long"), F.floor(a / 60).cast("long") % 60, a % 60)
    return F.when(s < 0, F.concat(F.lit("-"), t)).otherwise(t)


def day_number(s: Column) -> Column:
    """Days count from one; times before zero are on day one."""
    return F.greatest(F.lit(1), F.floor(s / 86400) + 1).cast("int")


def hour_shifted(hour: Column, offset: int) -> Column:
    return F.pmod(hour + offset, F.lit(24))


def steps_corrected(spoken: Column, updates: list[tuple[float, float]]) -> Column:
    """A clock that was put forward: (reading, seconds to take off) in order of readings; all up to
    the first not reached apply."""
    out, taken = spoken, 0.0
    for reading, shift in updates:
        taken += shift
        out = F.when(spoken >= reading, spoken - taken).otherwise(out)
    return out


def stage_at(g: Column, stages: list[tuple[str, Column | None, Column | None, Column | None]], last: str) -> Column:
    """The first stage (name, from, until, condition) that covers a time: from inclusive, until not. A
    missing bound is open, a null one covers nothing. `last` if there is none, null for a null time."""

    def covers(start, end, applies):
        parts = [p for p in (applies, None if start is None else g >= start, None if end is None else g < end) if p is not None]
        return functools.reduce(Column.__and__, parts, F.lit(True))

    return F.when(g.isNotNull(), F.coalesce(*(F.when(covers(*rest), name) for name, *rest in stages), F.lit(last)))


# Seconds from lift-off to orbit, from the start of a descent to the landing, and after it.
INSERTION, DESCENT, LANDED = 690, 780, 60


def flight_stages(e: Callable[[str], Column]) -> list[tuple[str, Column | None, Column | None, Column | None]]:
    """Stages of a flight by the seconds of its events, of which those that did not come about are
    null: tli, loi, pericynthion, landing, liftoff, lm_jettison, undocking, redocking, tei, docking,
    eva_start, eva_end, cm_sep. `e` gives an event's column."""
    far, orbited, landed = (e(k).isNotNull() for k in ("tli", "loi", "landing"))
    there, down, near = far & orbited, far & orbited & landed, ~far
    return [
        ("launch", None, F.lit(INSERTION), None),
        ("earth-orbit", None, e("tli"), far),
        ("transit-to-moon", None, F.coalesce(e("loi"), e("pericynthion")), far),
        ("lunar-orbit", None, e("landing") - DESCENT, down),
        ("landing", None, e("landing") + LANDED, down),
        ("surface", None, e("liftoff"), down),
        ("ascent", None, e("lm_jettison"), down),
        ("earth-orbit", None, e("docking"), near),
        ("spacewalk", e("eva_start"), e("eva_end"), near),
        ("lm-solo", e("undocking"), e("redocking"), near | there),
        ("lunar-orbit", None, e("tei"), there),
        ("transit-to-earth", None, e("cm_sep"), far),
        ("earth-orbit", e("lm_jettison"), e("cm_sep"), near),
        ("earth-orbit-docked", None, e("cm_sep"), near),
    ]


def anniversary(launch: Column, seconds: Column, now: Column) -> Column:
    """Whole seconds since this year's anniversary of a launch, and years since the launch, while the
    anniversary's flight lasts (both ends included); else null. 29 February falls on 1 March."""
    day = F.date_add(F.make_date(F.year(now), F.month(launch), F.lit(1)), F.dayofmonth(launch) - 1)
    of_day = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t)).cast("int")
    since = F.datediff(now, day).cast("long") * 86400 + of_day(now) - of_day(launch)
    live = (seconds > 0) & since.between(0, seconds)
    return F.when(live, F.struct(since.alias("seconds"), (F.year(now) - F.year(launch)).alias("years")))
