"""Anchors from a count that is spoken: "T minus 15", "6 minutes, 10 seconds into the flight", "mark, eight
minutes". Words are rows; a phrase may cross rows, files and tasks.

Only words that can open or close such a phrase are looked at: words are numbered, each cue gets the words
around it by a join on numbers, and the phrase is read there. No tape is read as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .joins import interval_join
from .sequence import numbered
from .transcripts import NUMBERS

#: Words of a phrase before and after its cue, at most.
BACK, ON = 8, 9
#: The phrases, over words without marks and with numbers as digits; the longest count.
COUNTDOWN = r"\bt[ -]?minus (\d+)(?: (hours?|minutes?|seconds?))?(?: (\d+) (minutes?|seconds?))?(?: (\d+) seconds?)?"
INTO_FLIGHT = r"\b(?:at |mark )?(\d+) minutes?(?: (?:and )?(\d+) seconds?)? into the (?:flight|mission)"
MARK = r"\bmark (\d+) minutes?(?: (\d+) seconds?)?\b(?! into)"
HOUR, LAST_COUNT = 3600, 60
WHOLE, HALF = 1.0, 0.5


def as_said(token: Column) -> Column:
    """In lower case, without marks at its ends, number words (to sixty) as digits."""
    bare = F.regexp_replace(F.lower(token), r"^[.,!?;:-]+|[.,!?;:-]+$", "")
    digits = F.create_map(*[F.lit(x) for w, k in NUMBERS.items() if k <= 60 for x in (w, str(k))])
    return F.coalesce(F.try_element_at(digits, bare), bare)


def _seconds(n: Column, unit: Column) -> Column:
    return n.cast("long") * F.when(unit.startswith("hour"), 3600).when(unit.startswith("minute"), 60).otherwise(1)


def anchors(words: DataFrame, keys: list[str], width: float = 600, step: int = 1000) -> DataFrame:
    """words: keys, t, seq, token. keys, t (when the phrase begins), g (seconds from launch) and weight: a
    count to the second, or one that is marked, in full, one to the minute half. Counts of over an hour
    do not count. Null tokens are pauses and part phrases."""
    said = words.where("t is not null").select(*keys, F.col("t").cast("double").alias("t"), "seq", as_said(F.coalesce("token", F.lit("|"))).alias("w"))
    n = stored(numbered(said, keys, "t", ["seq"], width, "n"), "words")
    cues = n.where(F.col("w").rlike(r"^(?:t[ -]?)?minus$") | F.col("w").isin("into", "mark"))
    spans = cues.select(*keys, F.col("n").alias("cue"), F.col("w").alias("what"), (F.col("n") - BACK).alias("_from"), (F.col("n") + ON + 1).alias("_to"))
    near = interval_join(n, spans, keys, "n", "_from", "_to", step)
    around = near.groupBy(*keys, "cue", "what").agg(F.array_sort(F.collect_list(F.struct("n", "w", "t"))).alias("p"))
    own = F.struct((F.col("cue") - F.col("p")[0]["n"]).cast("int").alias("k"))["k"]  # place of the cue
    text = lambda a: F.array_join(F.transform(a, lambda x: x["w"]), " ")
    rows = around.withColumn("k", own)

    # Countdown: from the word before the cue (or the cue itself, where both are one word).
    begin = F.when(F.col("what") == "minus", F.col("k") - 1).otherwise(F.col("k"))
    down = rows.where(F.col("what").rlike("minus$") & (begin >= 0)).withColumn("b", begin).withColumn("s", text(F.slice("p", F.greatest(begin, F.lit(0)) + 1, 99)))
    down = down.where(F.col("s").rlike(f"^{COUNTDOWN}"))
    g = [F.regexp_extract("s", f"^{COUNTDOWN}", j) for j in range(1, 6)]
    count, timed = g[0].cast("long"), g[1] != ""
    left = F.when(~timed, count).otherwise(_seconds(g[0], g[1]) + F.when(g[2] != "", _seconds(g[2], g[3])).otherwise(0) + F.when(g[4] != "", g[4].cast("long")).otherwise(0))
    marked = (F.col("b") > 0) & (F.get("p", F.col("b") - 1)["w"] == "mark")
    exact = ~timed | (g[4] != "") | g[1].startswith("second") | g[3].startswith("second") | F.coalesce(marked, F.lit(False))
    short = F.when(timed, left <= HOUR).otherwise(left <= LAST_COUNT)
    counted = down.where(short).select(*keys, F.get("p", F.col("b"))["t"].alias("t"), (-left).alias("g"), F.when(exact, WHOLE).otherwise(HALF).alias("weight"))

    # Into the flight: what ends with the words after the cue.
    past = rows.where("what = 'into'").withColumn("s", text(F.slice("p", 1, F.col("k") + 3))).withColumn("m", F.regexp_extract("s", f"({INTO_FLIGHT})$", 1)).where("m <> ''")
    spoken = F.size(F.split("m", " "))
    into = past.select(*keys, F.get("p", F.col("k") + 3 - spoken)["t"].alias("t"), *_minutes(INTO_FLIGHT, "m"), F.lit(HALF).alias("less"))

    marks = rows.where("what = 'mark'").withColumn("s", text(F.slice("p", F.col("k") + 1, 99))).where(F.col("s").rlike(f"^{MARK}"))
    mark = marks.select(*keys, F.get("p", F.col("k"))["t"].alias("t"), *_minutes(f"^{MARK}", "s"), F.lit(WHOLE).alias("less"))
    up = into.unionByName(mark).where(F.col("g") <= HOUR).select(*keys, "t", "g", F.when(F.col("to_second"), WHOLE).otherwise(F.col("less")).alias("weight"))
    return counted.unionByName(up)


def _minutes(pattern: str, text: str) -> list[Column]:
    m, s = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return [(m.cast("long") * 60 + F.when(s != "", s.cast("long")).otherwise(0)).alias("g"), (s != "").alias("to_second")]
