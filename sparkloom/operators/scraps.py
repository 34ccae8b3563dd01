"""Rows that are no words, judged by shapes and by a vocabulary that is joined, and notes taken out of rows.

Shapes are array functions over a row's words. Whether words are known is one join with the vocabulary,
of any size, on the words that could matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a word ends with beside itself, marks of a break, and shapes of parts of words that
#: say something: numbers, codes, acronyms, names, single words.
CONTRACTED = r"(?i)'(?:s|t|d|m|ll|re|ve)[^A-Za-z]*$"
BREAK = r"^[-. *?!()]+$"
SAYING = [r"\d[\d.,:+]*", r"[A-Z]+\d+[A-Z]*", r"[A-Z]{2,}", r"[A-Z][a-z]{2,}", r"[aAiI]"]
#: Letters of a word that speaks for itself; clumps of a row of scraps, and the share of them
#: that may be words.
SPEAKS, CLUMPS, WORDY = 4, 3, 0.4


def _letters(word: Column) -> Column:
    return F.regexp_replace(word, "[^A-Za-z]", "")


def _known(rows: DataFrame, id: str, words: Column, vocabulary: DataFrame, word: str, what: Column) -> DataFrame:
    """`what`, an aggregate over the known words of each row, with their `place`."""
    each = rows.select(id, F.posexplode(words).alias("place", "_w"))
    own = vocabulary.select(F.lower(word).alias("_w")).distinct()
    return each.join(own, "_w").groupBy(id).agg(what)


def with_scraps(rows: DataFrame, id: str, text: str, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """Adds `scraps`: no word in the row has four letters, is known (as it is or without a final s), or is
    of a shape that says something. Break marks alone are no scraps, nor is a single word of two letters
    or more with a capital. A null or blank text is scraps. id: one value a row."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, CONTRACTED, ""), "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    parts = lambda t: F.split(bare(t), "[-/]")
    shaped = rows.withColumn("_tokens", tokens)
    # Words are looked at one by one until one says something: of most rows, the first few.
    says = F.exists("_tokens", lambda t: F.length(_letters(bare(t))) >= SPEAKS) | F.exists("_tokens", lambda t: F.exists(parts(t), lambda p: p.rlike(f"^(?:{'|'.join(SAYING)})$")))
    alone = F.regexp_replace(F.get("_tokens", F.lit(0)), "^[^A-Za-z0-9]+", "")
    named = (F.size("_tokens") == 1) & alone.rlike("^[A-Z]") & (F.length(_letters(alone)) >= 2)
    marks = (F.size("_tokens") > 0) & F.trim(text).rlike(BREAK)
    judged = shaped.withColumn("_clean", F.coalesce(marks | named | says, F.lit(False)))
    sought = F.flatten(F.transform(F.filter(F.flatten(F.transform("_tokens", parts)), lambda p: p.rlike(r"^\p{L}{2,}$")), lambda p: F.array(F.lower(p), F.regexp_replace(F.lower(p), "s+$", ""))))
    # Only rows that nothing else makes clean are held against the vocabulary.
    known = _known(judged.where(~F.col("_clean")).select(id, "_tokens"), id, sought, vocabulary, word, F.lit(True).alias("_known"))
    return judged.join(known, id, "left").withColumn("scraps", ~F.col("_clean") & F.col("_known").isNull()).select(*rows.columns, "scraps")


def with_fold(rows: DataFrame, id: str, text: str, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """Adds `fold`: three clumps of letters or more, under two in five of them words and none of these of
    four letters, no digit, and no sentence of a known word at the start. A null text is no fold."""
    clumps = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z']+"), F.lit(0)), lambda c: F.length(c) >= 2)
    cut = rows.withColumn("_clumps", F.transform(clumps, lambda c: F.lower(c)))
    what = F.struct(F.count("*").alias("n"), F.max(F.length("_w")).alias("longest"), F.min("place").alias("first")).alias("_of")
    # Rows that cannot be folds are not held against the vocabulary.
    open_ = (F.size("_clumps") >= CLUMPS) & ~F.col(text).rlike(r"\d")
    known = _known(cut.where(open_).select(id, "_clumps"), id, F.col("_clumps"), vocabulary, word, what)
    n = F.coalesce("_of.n", F.lit(0))
    sentence = F.coalesce(F.col("_of.first") == 0, F.lit(False)) & F.col(text).rlike(r"^\W*[A-Za-z]+[.?!]")
    wordy = (n >= WORDY * F.size("_clumps")) | (F.coalesce("_of.longest", F.lit(0)) >= SPEAKS)
    fold = (F.size("_clumps") >= CLUMPS) & ~F.col(text).rlike(r"\d") & ~wordy & ~sentence
    return cut.join(known, id, "left").withColumn("fold", F.coalesce(fold, F.lit(False))).select(*rows.columns, "fold")


#: A tape's heading and a page's number as scans read them.
TAPE_MARK = r"\s+(?:['\"]?[IiFfl1|]['\"]?\s+)?[Tr]ap\W?e\s*[\w_]{1,4}/[\w_\]]{1,3}"
PAGE_MARK = r"\s+Page\s+\d{2,4}"


def without_headings(text: Column, heading: str = TAPE_MARK, page: str = PAGE_MARK) -> Column:
    """A line without headings that a scan ran into it: one at its end goes with page numbers around it
    and with scraps of two characters after it, one inside goes alone, and so does a number at the end."""
    at_end = rf"(?:{page})?{heading}(?:\s+\S{{1,2}})*(?:{page})?\s*$"
    return F.regexp_replace(text, rf"{at_end}|{page}\s*$|{heading}(?=\s)", "")


def _alike(read: Column, word: Column) -> Column:
    """A word in capitals (three letters in five) that is `word`, or differs from one of five letters or
    more in two at most."""
    letters = _letters(read)
    capitals = F.length(F.regexp_replace(letters, "[^A-Z]", ""))
    near = F.levenshtein(F.upper(letters), word, 2) >= 0  # -1 beyond the threshold
    return (letters != "") & (capitals >= 0.6 * F.length(letters)) & ((F.upper(letters) == word) | ((F.length(word) >= 5) & near))


def without_note(words: Column, note: list[str], most_extra: int = 2, least: int = 6) -> Column:
    """words (of a row, in order) without a note whose words, in capitals, stand among them in order, each
    perhaps misread: a struct of `words` and `noted`. A row of little else (`most_extra` further words)
    that has `least` of the note's words in any order is the note alone, and nothing is left of it. Null
    words stay null and are no note."""
    pattern = F.array(*[F.lit(w) for w in note])
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, w: Column) -> Column:
        found = (acc["k"] < len(note)) & F.coalesce(_alike(w, F.get(pattern, acc["k"])), F.lit(False))
        return F.struct(F.when(found, acc["k"] + 1).otherwise(acc["k"]).alias("k"), F.when(found, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(w))).alias("kept"))

    walked = F.aggregate(words, start, step)
    of_note = F.size(F.filter(words, lambda w: F.exists(pattern, lambda p: F.coalesce(_alike(w, p), F.lit(False)))))
    whole, alone = walked["k"] == len(note), (of_note >= least) & (F.size(words) <= of_note + most_extra)
    left = F.when(whole, walked["kept"]).when(alone, F.array().cast("array<string>")).otherwise(words)
    return F.struct(left.alias("words"), F.coalesce(whole | alone, F.lit(False)).alias("noted"))
