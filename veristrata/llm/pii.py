"""Personal data by fixed patterns, and by contextual patterns that these bootstrap.

Native: DataFrame functions only. Base spans come from four regular expressions with checks. They are the first seeds.
Strings that look like identifiers (CANDIDATE, of any length) and that hold no base span are candidates. Each seed and candidate has
lexical patterns: the one and two words before it, the one and two after it, the word on each side, and the two words around a wildcard.
Patterns and instances (distinct values) form a graph, which is scored in turns:

1. a pattern's confidence in a kind is Wilson's lower bound of the share of that kind among its decided instances. An instance is decided
   if it is a seed, or if its form rules the kind out (PLAUSIBLE); a pattern needs SUPPORT seeds and a confidence of TRUST;
2. a candidate is accepted by noisy or over its patterns of a kind that its form allows, from ACCEPT on;
3. accepted instances are seeds of the next turn, which induces new patterns and scores the old ones anew. It ends when none is accepted.

What is accepted adds spans of its kind wherever it stands. Scores are sums of integers, so that their order never matters.

The graph is aggregated by (pattern, value) before it is dealt, and its joins are salted, as one word may stand before a third of all
identifiers. Its size follows the number of identifiers, not of words.

Cases: null text counts as empty and has no spans; equal spans of two kinds are both kept; a candidate that two kinds accept alike gets the
first of KINDS, as do patterns; the edge of a text counts as a word; words of over 40 characters stand as their md5; an empty table gives an
empty result; repeated rows are searched each, and their values count once; long texts are searched whole (the patterns don't
backtrack over more than one run of digits). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize, salted_join

KINDS = ("email", "ip", "card", "phone")
_MAIL = "[A-Za-z0-9._%+-]"
#: The base patterns in a form that Java matches in linear time and without recursion: possessive runs, and starts only at the
#: beginning of a run or where the match before ended (a start inside a run can only match where its beginning does).
PATTERNS = {
    "email": rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
_AT = r"(?:\x20?+[\[({<]\x20?+(?:at|AT|@)\x20?+[\])}>]\x20?+|\x20@\x20|\x20(?:at|AT)\x20(?=[\p{L}\p{N}-]++\x20(?:dot|DOT)\x20)|@)"
_DOT = r"(?:\.|\x20?+[\[({<]\x20?+(?:dot|DOT|\.)\x20?+[\])}>]\x20?+|\x20(?:dot|DOT)\x20)"
#: What may be an identifier without being one by the base patterns: addresses however spelled, runs of digit groups.
CANDIDATE = (rf"(?<![\p{{L}}\p{{N}}._%+-])(?:[\p{{L}}\p{{N}}._%+-]++{_AT}[\p{{L}}\p{{N}}-]++(?:{_DOT}[\p{{L}}\p{{N}}-]++)*+"
             r"|[+(\[]?+[0-9]++(?:[().\[\]{}/-]{0,3}+\x20?+[().\[\]{}-]{0,2}+[0-9]++)*+)")
#: A text without this has no candidate; fewer digits are no identifier.
MAYBE, DIGITS = r"[0-9@]|[\[({<]\x20?(?:at|AT)|\x20(?:at|AT)\x20", 5
#: Least seeds of a pattern, least confidence in it and in an instance, square of the normal quantile of the bound.
SUPPORT, TRUST, ACCEPT, Z2 = 3, 0.7, 0.85, 1.0
#: Logarithms of doubts are added in units of 1 / GRAIN.
GRAIN = 1_000_000


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits (14 to 19) pass: from the right, each second digit doubled, digits of products summed."""
    total = F.lit(0)
    for k in range(19):
        d = F.ascii(F.substring(digits, F.length(digits) - k, F.lit(1))) - 48
        value = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2) if k % 2 else d
        total = total + F.when(F.length(digits) > k, value).otherwise(0)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.split(value, r"\.")
        short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(parts, lambda p: (F.length(short(p)) <= 3) & (F.substring(short(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        d = _digits(value)
        return F.length(d).between(14, 19) & _luhn(d)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    return _placed(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _placed(gaps: Column, hits: Column) -> Column:
    """Places of the hits between the gaps."""
    both = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """array<struct<start,rank,end,value>> of all kinds, sorted by start, then kind."""
    found = []
    for rank, kind in enumerate(KINDS):
        spans = F.when(F.regexp_like(text, F.lit(NEEDS[kind])), located(text, PATTERNS[kind])).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
        found.append(_checked(spans, kind, rank))
    return F.array_sort(F.concat(*found))


def _checked(spans: Column, kind: str, rank: int) -> Column:
    kept = F.filter(spans, lambda s: _valid(kind, s["value"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["value"].alias("value")))


def _word(word: Column) -> Column:
    """A word in lower case without marks at its ends and with digits as 0; the edge of a text is '^'."""
    plain = F.regexp_replace(F.translate(F.lower(word), "123456789", "000000000"), r"^[,.;:!?\"'()\[\]]+|[,.;:!?\"'()\[\]]+$", "")
    plain = F.when(word == "", "^").when(plain == "", word).otherwise(plain)
    return F.when(F.length(plain) > 40, F.md5(plain.cast("binary"))).otherwise(plain)


def _words(gap: Column, before: bool) -> Column:
    """array of the nearest word and the next one of the text between two hits."""
    text = F.reverse(gap) if before else gap
    found = [F.regexp_extract(text, r"^\s*(\S+)", 1), F.regexp_extract(text, r"^\s*\S+\s+(\S+)", 1)]
    return F.array(*[_word(F.reverse(w) if before else w) for w in found])


def plausible(value: Column) -> list[Column]:
    """For each kind, whether a string that its check need not pass may be one by its form."""
    digits = F.length(_digits(value))
    numeric = ~value.rlike(r"[\p{L}@]")
    parts = F.filter(F.split(value, "[^0-9]+"), lambda p: p != "")
    return [value.rlike(rf"{_AT}[\p{{L}}\p{{N}}-]+{_DOT}[\p{{L}}\p{{N}}]"), numeric & (F.size(parts) == 4) & value.rlike(r"\.") & F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255)),
            numeric & digits.between(13, 19) & ~value.rlike(r"[+/]"), numeric & digits.between(7, 15)]


def _patterns(s: Column) -> Column:
    """The lexical patterns of an occurrence: those with a word, as the edges of a text alone say nothing."""
    (l1, l2), (r1, r2) = (s["left"][0], s["left"][1]), (s["right"][0], s["right"][1])
    slot, any_ = F.lit("\x02"), F.lit("\x03")

    def pattern(parts: list[Column], *words: Column) -> Column:
        edges = F.lit(True)
        for w in words:
            edges = edges & (w == "^")
        return F.when(~edges, F.concat_ws("\x01", *parts))

    made = F.array(pattern([l1, slot], l1), pattern([l2, l1, slot], l2, l1), pattern([slot, r1], r1), pattern([slot, r1, r2], r1, r2), pattern([l1, slot, r1], l1, r1), pattern([l2, any_, slot], l2), pattern([slot, any_, r2], r2))
    return F.filter(made, lambda p: p.isNotNull())


def _confidence(labelled: DataFrame) -> DataFrame:
    """pattern, kind, doubt (the scaled logarithm of 1 - confidence) of trusted patterns, from (pattern, value, label or null, mask)."""
    held = [F.count_if(F.col("label") == k).alias(f"p{k}") for k in range(4)] + [F.count_if(F.when(F.col("label").isNotNull(), F.col("label") != k).otherwise(F.col("mask").bitwiseAND(1 << k) == 0)).alias(f"n{k}") for k in range(4)]
    sums = labelled.groupBy("pattern").agg(*held)

    def bound(k: int) -> Column:
        p, n = F.col(f"p{k}"), F.col(f"p{k}") + F.col(f"n{k}")
        share = p / n
        low = (share + Z2 / (2 * n) - F.sqrt(Z2 * (share * (1 - share) / n + Z2 / (4 * n * n)))) / (1 + Z2 / n)
        return F.when(p >= SUPPORT, F.round(low, 6)).otherwise(0.0)

    best = F.greatest(*[F.struct(bound(k).alias("confidence"), F.lit(-k).alias("kind")) for k in range(4)])
    trusted = sums.select("pattern", best.alias("best")).where(F.col("best.confidence") >= TRUST)
    return trusted.select("pattern", (-F.col("best.kind")).alias("kind"), F.round(F.ln(1 - F.col("best.confidence")) * GRAIN).cast("long").alias("doubt"))


def bootstrap(edges: DataFrame) -> DataFrame:
    """value, kind of accepted candidates, from (pattern, value, rank of the seed's kind or -1, mask of plausible kinds), a row per occurrence."""
    pairs = materialize(edges.groupBy("pattern", "value").agg(F.max("rank").alias("rank"), F.first("mask").alias("mask")), "pii-pairs")
    accepted, tables = None, [pairs]
    while True:
        label = F.when(F.col("rank") >= 0, F.col("rank"))
        if accepted is None:
            labelled = pairs.withColumn("label", label)
        else:
            labelled = salted_join(pairs, accepted, "value", "pattern", "left").withColumn("label", F.coalesce(label, "kind")).drop("kind")
        labelled = materialize(labelled, "pii-labelled")
        trusted = materialize(_confidence(labelled), "pii-trusted")
        open_ = salted_join(labelled.where("label is null and mask > 0").select("pattern", "value", "mask"), trusted, "pattern", "value")
        open_ = open_.where(F.expr("(mask >> kind) & 1 = 1"))
        doubts = open_.groupBy("value", "kind").agg(F.sum("doubt").alias("doubt")).where(F.col("doubt") <= F.lit(_doubt(ACCEPT)))
        new = doubts.groupBy("value").agg(F.min_by("kind", F.struct("doubt", "kind")).alias("kind"))
        found = materialize(new if accepted is None else accepted.unionByName(new), "pii-accepted")
        tables += [labelled, trusted]
        done = found.count() == (0 if accepted is None else accepted.count())
        if accepted is not None:
            tables.append(accepted)
        accepted = found
        if done:
            drop_tables(*tables)
            return accepted


def _doubt(confidence: float) -> int:
    import math

    return round(math.log(1 - confidence) * GRAIN)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans as arrays of (start, rank of the kind, end, value), for every row of docs."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    look = F.regexp_like("text", F.lit(MAYBE))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("gaps", F.when(look, F.split("text", CANDIDATE, -1)).otherwise(F.array(F.lit(""))))
    rows = rows.withColumn("hits", _placed(F.col("gaps"), F.when(look, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))))

    def seen(h: Column, k: Column) -> Column:
        inside = F.get(F.filter("base", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"])), F.lit(0))
        return F.struct(h["start"].alias("start"), h["end"].alias("end"), F.coalesce(inside["value"], h["value"]).alias("value"), F.coalesce(inside["rank"], F.lit(-1)).alias("rank"),
                        _words(F.get("gaps", k), True).alias("left"), _words(F.get("gaps", k + 1), False).alias("right"))

    likely = lambda s: (s["rank"] >= 0) | s["value"].contains("@") | s["value"].rlike(r"\p{L}") | (F.length(_digits(s["value"])) >= DIGITS)
    # the texts are read once; what is kept of them is the spans with their contexts
    found = rows.select("doc_id", "base", F.transform("hits", seen).alias("seen")).select("doc_id", "base", F.filter("seen", likely).alias("seen"))
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "pii-found")
    spots = found.select(F.explode("seen").alias("s")).select("s.value", "s.rank", F.explode(_patterns(F.col("s"))).alias("pattern"))
    mask = F.lit(0)
    for k, may in enumerate(plausible(F.col("value"))):
        mask = mask + F.when(may, 1 << k).otherwise(0)
    accepted = bootstrap(spots.select("pattern", "value", "rank", mask.alias("mask")))
    # documents with an accepted candidate; the others keep their base spans
    extra = found.select("row", F.explode(F.filter("seen", lambda s: s["rank"] < 0)).alias("s")).select("row", "s.start", "s.end", "s.value")
    extra = salted_join(extra, accepted, "value", "row").groupBy("row").agg(F.collect_list(F.struct("start", F.col("kind").alias("rank"), "end", "value")).alias("more"))
    out = found.join(extra, "row", "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")))).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: str, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")
