"""Labels, codes, file names and printed times as columns. All run in the JVM but the two row filters,
which need a vocabulary, and names read by likeness."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits that letters stand for in readings of scans.
DIGITS = {
    "o": "0", "O": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "i": "1", "|": "1", "k": "4", "h": "4", "A": "4", "S": "5", "s": "5", "B": "8",
    "g": "9", "Z": "2", "z": "2", "b": "6", "G": "6", "T": "7", "[": "1", "]": "1", "t": "1", "(": "", ")": "",
}
# Letters that readings of scans take for each other.
TWINS = ["co", "uo", "ec", "li", "fp", "hb", "nu", "nh", "ao", "rn", "vy", "tf", "jl"]
# Titles and initials whose stop ends no sentence.
TITLES = r"(?:Dr|Mr|Mrs|Ms|St|Jr|Sr|Gen|Col|Lt|Capt|Gov|Sen|Rep|vs|[B-HJ-Z])\."


def unclear_marked(text: Column) -> Column:
    """Three dots or stars, marks of an unreadable place, as [unclear]; a fourth dot stays."""
    marked = F.regexp_replace(text, r"\s*(?:\.\s?){3}(\.?)|\s*\*{3}", " [unclear]$1")
    return F.regexp_replace(F.regexp_replace(marked, "^ ", ""), r"\[unclear\](\w)", "[unclear] $1")


def spoken(text: Column) -> Column:
    """Without notes in brackets, closed or not; white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]?", ""), r"\s+", " "))


def bare_name(name: Column) -> Column:
    """A speaker's name in lower case, without what is in parentheses or follows / , or -."""
    return F.trim(F.regexp_extract(F.regexp_replace(F.lower(F.trim(name)), r"\(.*?\)", ""), r"^[^/,-]*", 0))


def speaker_and_channel(label: Column) -> Column:
    """The speaker, and `onboard` if the label ends in that, else air-to-ground."""
    tail = r"(?i)\s*\((onboard|backup)\)\s*$"
    name = F.trim(F.rtrim(F.trim(F.regexp_replace(label, tail, "")), F.lit(": ")))
    onboard = F.lower(F.regexp_extract(label, tail, 1)) == "onboard"
    return F.struct(name.alias("speaker"), F.when(onboard, "onboard").otherwise("air-to-ground").alias("channel"))


def clip_channel(clip: Column) -> Column:
    """broadcast, onboard or air-to-ground, by the mark in a clip's name."""
    c = F.lower(clip)
    return F.when(F.contains(c, F.lit("pao")), "broadcast").when(c.rlike(r"ob$|ob\.|_ob"), "onboard").otherwise("air-to-ground")


def nearest_code(token: Column, codes: list[str]) -> Column:
    """The code of least edit distance, the first listed of equals, if at most half of it (one letter
    at least) differs; else '?'. What follows a hyphen is the craft; 24 is a misread M, I an L."""
    own = F.regexp_replace(F.regexp_extract(F.upper(token), "^[^-]*", 0), "[^A-Z0-9]", "")
    own = F.translate(F.replace(own, F.lit("24"), F.lit("M")), "I", "L")
    ranked = F.array_min(F.array(*(F.struct(F.levenshtein(own, F.lit(c)).alias("far"), F.lit(k).alias("k"), F.lit(c).alias("code"), F.lit(max(1, len(c) // 2)).alias("most")) for k, c in enumerate(codes))))
    return F.when((own != "") & (ranked["far"] <= ranked["most"]), ranked["code"]).otherwise("?")


#: How alike a misread word must be to a name, by its first character. Names have a capital,
#: or what scans make of one, or their capital is lost in a mark. Shorter words stand for no name.
ALIKE, SHORTEST = [("[A-Zlti]", 0.72), ("[^A-Za-z]", 0.8)], 4


def damaged_name(word: str, names: list[str]) -> str | None:
    """The name that a misread word stands for: the most alike, the first listed of equals, if it is alike
    enough (ALIKE). An underscore is a lost letter, which fits any letter of a name of the same length."""
    least = next((share for first, share in ALIKE if re.match(first, word)), None)
    read = re.sub("[^a-z_]", "", word.lower())
    whole = read.replace("_", "")
    if least is None or len(whole) < SHORTEST:
        return None
    shares = {}
    for name in names:
        low = name.lower()
        shares[name] = SequenceMatcher(None, whole, low).ratio()
        if len(low) == len(read) and whole != read:
            fits = len(low) - sum(r != n for r, n in zip(read, low) if r != "_")
            shares[name] = max(shares[name], fits / len(low))
    best = max(shares, key=shares.get, default=None)
    return best if best is not None and shares[best] >= least else None


def damaged_name_udf(names: list[str]):
    """damaged_name as a column function; the list of names is a parameter of a few entries."""

    @F.pandas_udf("string")
    def named(word: pd.Series) -> pd.Series:
        known = {w: damaged_name(w, names) for w in word.dropna().unique()}
        return word.map(lambda w: known.get(w))

    return named


def digits_meant(text: Column) -> Column:
    letters = sorted(DIGITS, key=lambda c: DIGITS[c] == "")  # those without a digit last: they go
    return F.translate(text, "".join(letters), "".join(DIGITS[c] for c in letters))


def _clock(digits: Column) -> Column:
    """Seconds of a time of eight digits, day to second; null beyond 23:59:59."""
    d, h, m, s = (F.substring(digits, k, 2).cast("int") for k in (1, 3, 5, 7))
    return F.when(digits.rlike("^[0-9]{8}$") & (h < 24) & (m < 60) & (s < 60), ((d * 24 + h) * 60 + m) * 60 + s)


def printed_clock(text: Column) -> Column:
    """Seconds of a printed time with misread digits, blanks and marks; null if it is none."""
    return _clock(F.regexp_replace(digits_meant(text), "[^0-9]", ""))


def printed_hour(text: Column) -> Column:
    """Seconds of a time of which day and hour are printed, and dashes or dots for the rest."""
    shape = r"^\s*(\S\S)\s*(\S\S)\s*(?:[-.]{2,}\s*){1,2}$"
    d, h = (digits_meant(F.regexp_extract(text, shape, k)) for k in (1, 2))
    whole = d.rlike("^[0-9]{2}$") & h.rlike("^[0-9]{2}$")
    return F.when(whole & (F.when(whole, h.cast("int")) < 24), (F.when(whole, d.cast("int")) * 24 + F.when(whole, h.cast("int"))) * 3600)


def smudged_clock(text: Column) -> Column:
    """Eight characters, with ? for one to three digits that are printed as _; else null."""
    own = F.translate(F.regexp_replace(digits_meant(text), "[^0-9_]", ""), "_", "?")
    return F.when((F.length(own) == 8) & F.regexp_count(own, F.lit(r"\?")).between(1, 3), own)


def file_clock(url: Column) -> Column:
    """The time in a file's name, as hhh:mm:ss: three numbers after underscores at its start, or seven
    digits; null for a count-down (_t-) or none."""
    name = F.substring_index(url, "/", -1)
    split = [F.regexp_extract(name, r"(?i)^[a-z0-9]+_([0-9]{3})_([0-9]{2})_([0-9]{2})", k) for k in (1, 2, 3)]
    run = F.regexp_extract(name, "([0-9]{7})", 1)
    joined = F.concat_ws(":", F.substring(run, 1, 3), F.substring(run, 4, 2), F.substring(run, 6, 2))
    return F.when(~F.contains(name, F.lit("_t-")), F.when(split[0] != "", F.concat_ws(":", *split)).when(run != "", joined))


def caption_date(text: Column) -> Column:
    """The day of "(16 July 1969)"; null for a range of days or none."""
    shape = r"\((\d{1,2})(?:\s*[-–]\s*(\d{1,2}))?\s+([A-Za-z]{3})[a-z]*\.?\s+(\d{4})\)"
    day, last, month, year = (F.regexp_extract(text, shape, k) for k in (1, 2, 3, 4))
    number = F.floor((F.position(F.lower(month), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3)
    return F.when((day != "") & (last == ""), F.try_to_date(F.concat_ws("-", year, number.cast("string"), day), "yyyy-M-d"))


def frame_number(frame: Column) -> Column:
    """The number at the end of a frame's name, before a letter for a further scan."""
    n = F.regexp_extract(frame, r"-(\d+)[A-Da-d]?$", 1)
    return F.when(n != "", n.cast("int"))


def disc_place(lat: Column, lon: Column) -> Column:
    """Where a place lies on a globe seen from above 0 N 0 E, in per cent from the upper left."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.struct((50 + 50 * F.cos(la) * F.sin(lo)).alias("x"), (50 - 50 * F.sin(la)).alias("y"))


def coordinates(lat: Column, lon: Column) -> Column:
    side = lambda v, plus, minus: F.concat(F.format_string("%.3f°", F.abs(v)), F.when(v >= 0, plus).otherwise(minus))
    return F.concat_ws(", ", side(lat, "N", "S"), side(lon, "E", "W"))


def ends_sentence(word: Column) -> Column:
    w = F.trim(word)
    return w.rlike(r"[.?!]$") & ~w.rlike(f"^{TITLES}$")


def scan_twins(a: Column, b: Column) -> Column:
    """Different words of one length whose letters differ only as scans confuse them."""
    x, y = F.lower(a), F.lower(b)
    alike = lambda p, q: (p == q) | F.concat(p, q).isin(*TWINS, *(t[::-1] for t in TWINS))
    pairs = F.zip_with(F.split(x, ""), F.split(y, ""), alike)
    return (F.length(x) == F.length(y)) & (x != y) & F.forall(pairs, lambda ok: ok)


def frame_kind(on_foot: Column, landed: Column, near: Column, described: Column, usual: Column, default: Column, orbital: list[str]) -> Column:
    """kind and like (the frame it is taken from) of a frame. One from a camera used on foot is of the
    surface, unless its neighbour (near: kind, frame) is of another kind; then an orbital neighbour
    counts; then what the description says, unless that is a surface no one stood on; then the usual
    kind of its roll; then the default."""
    own = F.coalesce(F.when((described != "surface") | landed, described), usual, default)
    kind = F.when(on_foot, F.coalesce(near["kind"], F.lit("surface"))).when(near["kind"].isin(orbital), near["kind"]).otherwise(own)
    return F.struct(kind.alias("kind"), F.when(on_foot | near["kind"].isin(orbital), near["frame"]).alias("like"))
