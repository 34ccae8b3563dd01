"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers.

Only DataFrame functions are used. Base entities (email, ip, card, phone) are found by regular
expressions; positions come from splitting the text at the matches. They and keys (long hexadecimal
strings, kind `key`) are the seeds. Any other token with a digit may be an identifier.

Lexical patterns are the word before a token, the two words before it, and the words on both sides;
digits in words count as zeros. Patterns and instances (the values seen) form a graph. Each round
scores a pattern by the share of its instances that are believed in; an instance is believed in as a
seed, or by what its *other* patterns are worth, so no pattern vouches for itself, and identifiers that
one pattern finds can make another one trusted in the next round. Patterns that end at `confident` or
above, with `support` believed instances, turn the unseen identifiers beside them into findings of
kind `id`. They need no length limit: tokens are compared by a hash.

Null text counts as empty. A text without entities has empty results; no rows give no rows. Repeated
rows are each reported; as instances values count once for each pattern. Ties in position go by kind
as listed. Offsets are code points, the end exclusive. Work and memory grow linearly with the entities
of a text. Other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fresh, stored

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["key", "id"]
#: Each is the leftmost non-overlapping pattern of its kind. Possessive repeats and the looks behind
#: only spare the engine starts and retreats that cannot succeed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap conditions without which a pattern cannot match.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: What may be an identifier: a token with a digit, of five characters or more.
IDENTIFIER = r"(?<![^\s\"'=:(\[<])(?=[A-Za-z@._%+/-]*+[0-9])[A-Za-z0-9@._%+/-]*[A-Za-z0-9]"
SHORTEST = 5
KEY = r"^(?=[0-9]*[a-f])[0-9a-f]{32,}+$"
BEFORE = r"(?:([\p{L}\p{N}]{1,24})[^\p{L}\p{N}]{1,4})?(?<![\p{L}\p{N}])([\p{L}\p{N}]{1,24})[^\p{L}\p{N}]{0,5}$"
AFTER = r"^[^\p{L}\p{N}]{0,5}([\p{L}\p{N}]{1,24})"
REACH = 64  #: characters of context that are looked at

ROUNDS, CONFIDENT, SUPPORT, PRIOR, TRUSTED = 4, 0.8, 3, 1.0, 0.5
PIECE = "struct<gap:string,value:string,next:string>"
SPAN = "struct<start:int,end:int,value:string,left:string,right:string>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def grouped(array: Column, size: int) -> Column:
    """The array in slices of `size`; not for empty ones."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / size).cast("int")), lambda k: F.slice(array, k * size + 1, size))


def matches(text: Column, pattern: str) -> Column:
    """Each match with the text between it and its neighbours, and the text after the last one."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def pairs(x):
        n = F.size(x["values"])
        own = F.arrays_zip(F.slice(x["gaps"], 1, n).alias("gap"), x["values"].alias("value"), F.slice(x["gaps"], 2, n).alias("next"))
        return F.struct(own.alias("pieces"), F.element_at(x["gaps"], -1).alias("rest"))

    return let(both, pairs)


def spans(text: Column, pattern: str, hint: str) -> Column:
    """Start, end and value of the matches, in order, and the texts at both sides up to the next
    match. Lengths are summed up in slices, as a sum over all would copy its array for each match."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        own = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["gap"], F.lit(REACH)).alias("left"), F.left(x["next"], F.lit(REACH)).alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    def placed(pieces):
        parts = F.transform(grouped(pieces, 128), lambda g: F.aggregate(g, F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        before = lambda ps: F.aggregate(ps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        moved = lambda s, by: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right"))
        return let(parts, lambda ps: F.flatten(F.zip_with(ps, before(ps), lambda p, by: F.transform(p["out"], lambda s: moved(s, by)))))

    found = let(matches(text, pattern)["pieces"], lambda p: F.when(F.size(p) > 0, placed(p)).otherwise(none))
    return F.when(text.rlike(hint), found).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.reverse(digits(value))
    at = F.sequence(F.lit(1), F.length(d))

    def weigh(k):
        x = F.substr(d, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(at, F.lit(0), lambda a, k: a + weigh(k)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":  # at most three digits after leading zeros, so any length of them is compared safely
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.lpad(F.right(p, F.lit(3)), 3, "0"), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(12, 19) & luhn(value)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


ENTITY = "struct<start:int,order:int,end:int,kind:string,value:string,left:string,right:string>"


def _of_kind(text: Column, kind: str, order: int) -> Column:
    good = F.filter(spans(text, PATTERNS[kind], HINTS[kind]), lambda s: valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), s["left"].alias("left"), s["right"].alias("right")))


def base_spans(text: Column) -> Column:
    """All valid base spans of all kinds, by start, then kind as listed."""
    return F.array_sort(F.concat(*(_of_kind(text, kind, order) for order, kind in enumerate(KINDS))))


def masked(text: Column, kind: str) -> Column:
    """The text with blanks in place of the valid matches of a kind."""
    blank = lambda p: F.concat(p["gap"], F.when(valid(kind, p["value"]), F.repeat(F.lit(" "), F.length(p["value"]))).otherwise(p["value"]))
    done = let(matches(text, PATTERNS[kind]), lambda m: F.concat(F.array_join(F.transform(m["pieces"], blank), ""), m["rest"]))
    return F.when(text.rlike(HINTS[kind]), done).otherwise(text)


def lexical(left: Column, right: Column) -> Column:
    """The patterns of a place: l, the word before; b, two words before; s, the words at both sides."""
    word = lambda text, pattern, k: F.regexp_replace(F.regexp_extract(F.lower(text), pattern, k), "[0-9]+", "0")
    words = F.struct(word(left, BEFORE, 1).alias("far"), word(left, BEFORE, 2).alias("near"), word(right, AFTER, 1).alias("next"))
    none = F.lit(None).cast("string")

    def named(w):
        l = F.when(w["near"] != "", F.concat(F.lit("l "), w["near"])).otherwise(none)
        b = F.when(w["far"] != "", F.concat(F.lit("b "), w["far"], F.lit(" "), w["near"])).otherwise(none)
        s = F.when((w["near"] != "") & (w["next"] != ""), F.concat(F.lit("s "), w["near"], F.lit(" _ "), w["next"])).otherwise(none)
        return F.filter(F.array(l, b, s), lambda x: x.isNotNull())

    return let(words, named)


def found(docs: DataFrame, key: str, text: str) -> DataFrame:
    """For each row: its key, a hash of its text, base spans, and all seeds and possible identifiers
    with a hash of their value and their patterns."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{ENTITY}>")
    rows = docs.select(F.col(key), F.xxhash64(t).alias("_hash"), t.alias("_text"))
    rows = rows.withColumn("base", F.when(F.col("_text").rlike("[0-9@]"), base_spans(F.col("_text"))).otherwise(none))
    # One column after the other: an expression inside another would be computed for each use.
    rows = rows.withColumn("_bare", F.when(F.size("base") > 0, F.col("_text")))
    for kind in KINDS:
        rows = rows.withColumn("_bare", masked(F.col("_bare"), kind))
    rows = rows.withColumn("_bare", F.coalesce("_bare", "_text"))
    rows = rows.withColumn("_others", F.filter(spans(F.col("_bare"), IDENTIFIER, "[0-9]"), lambda s: F.length(s["value"]) >= SHORTEST))
    seen = lambda s, kind: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind.alias("kind"), F.xxhash64(F.lower(s["value"])).alias("value"), lexical(s["left"], s["right"]).alias("patterns"))
    kind = lambda s: F.when(F.lower(s["value"]).rlike(KEY), F.lit("key"))
    all_ = F.concat(F.transform("base", lambda s: seen(s, s["kind"])), F.transform("_others", lambda s: seen(s, kind(s))))
    return rows.select(key, "_hash", F.transform("base", lambda s: s.dropFields("value", "left", "right")).alias("base"), all_.alias("seen"))


def confident_patterns(seen: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """seen: patterns, value, kind (null if not a seed). Returns pattern, score of those to trust."""
    edges = seen.select(F.explode("patterns").alias("pattern"), "value", F.col("kind").isNotNull().alias("seed"))
    edges = stored(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    believed, old = edges.withColumn("belief", F.col("seed").cast("double")), []
    for k in range(rounds):
        scores = believed.groupBy("pattern").agg((F.sum("belief") / (F.count("*") + PRIOR)).alias("score"), F.count_if(F.col("belief") >= TRUSTED).alias("support"))
        scores = stored(scores, "scores")
        drop_stored(*old)
        if k == rounds - 1:
            drop_stored(edges)
            return scores.where((F.col("score") >= confident) & (F.col("support") >= support)).select("pattern", "score")
        doubt = F.when((F.col("support") >= support) & (F.col("score") >= TRUSTED), F.log1p(-F.least("score", F.lit(0.99)))).otherwise(0.0)
        worth = edges.join(scores.select("pattern", doubt.alias("doubt")), "pattern")
        heard = worth.groupBy("value").agg(F.sum("doubt").alias("all"))
        belief = F.when(F.col("seed"), 1.0).otherwise(1 - F.exp(F.least(F.lit(0.0), F.col("all") - F.col("doubt"))))
        believed = stored(worth.join(heard, "value").select("pattern", "value", belief.alias("belief")), "beliefs")
        old = [scores, believed]


ALL = "array<struct<start:int,order:int,end:int,kind:string>>"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, _hash (xxhash64 of the text), base and all: arrays of start, order, end, kind."""
    rows = stored(found(docs, key, text), "entities").withColumn("_row", F.monotonically_increasing_id())
    seen = rows.select("_row", F.explode("seen").alias("s")).select("_row", "s.*")
    patterns = confident_patterns(seen)
    span = lambda k, kind: F.struct("start", F.lit(len(KINDS) + k).alias("order"), "end", F.lit(kind).alias("kind")).alias("span")
    new = seen.where("kind is null").select("_row", "start", "end", F.explode("patterns").alias("pattern")).join(patterns, "pattern").select("_row", span(1, "id"))
    by_row = new.unionAll(seen.where("kind = 'key'").select("_row", span(0, "key"))).groupBy("_row").agg(F.collect_set("span").alias("more"))  # at most the identifiers of one text
    out = rows.select(key, "_hash", "base", "_row").join(by_row, "_row", "left")
    return out.select(key, "_hash", F.col("base").cast(ALL).alias("base"), F.array_sort(F.concat(F.col("base").cast(ALL), F.coalesce(F.col("more").cast(ALL), F.array().cast(ALL)))).alias("all"))


def listed(array: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, all_: Column) -> Column:
    """The text with the spans, which are sorted, replaced by their kinds. Runs of 64 spans are
    rebuilt from the part of the text that they lie in, and joined."""
    runs = F.array().cast(f"array<struct<from:int,to:int,spans:{ALL}>>")
    last = lambda acc, g: F.greatest(acc["at"], F.array_max(F.transform(g, lambda s: s["end"])))
    placed = F.aggregate(grouped(all_, 64), F.struct(F.lit(0).alias("at"), runs.alias("out")), lambda acc, g: F.struct(last(acc, g).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), last(acc, g).alias("to"), g.alias("spans")))).alias("out")))

    def rebuilt(run):
        def step(own):
            def one(acc, s):
                skip = s["start"] < acc["at"]  # overlaps what was replaced
                put = F.concat(acc["out"], F.substr(own, acc["at"] - run["from"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(put).alias("out"))

            return F.aggregate(run["spans"], F.struct(run["from"].alias("at"), F.lit("").alias("out")), one, lambda acc: acc["out"])

        return let(F.substr(text, run["from"] + 1, run["to"] - run["from"]), step)

    return let(placed, lambda p: F.concat(F.array_join(F.transform(p["out"], rebuilt), ""), F.substr(text, p["at"] + 1, F.length(text))))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets; other columns stay."""
    spots = find(docs, key, text).where(F.size("all") > 0).groupBy(key, "_hash").agg(F.first("all").alias("all"))
    hashed, same, all_, k = (fresh(docs, c) for c in ("_hash", "_same", "_all", "_key"))
    spots = spots.select(F.col(key).alias(k), F.col("_hash").alias(same), F.col("all").alias(all_))
    t = F.col(text)
    rows = docs.withColumn(hashed, F.xxhash64(F.coalesce(t, F.lit(""))))
    joined = rows.join(spots.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(k)) & (F.col(hashed) == F.col(same)), "left")
    return joined.withColumn(text, F.when(F.col(all_).isNull(), t).otherwise(replaced(t, F.col(all_)))).select(*(joined[c] if c != text else F.col(text) for c in docs.columns))
