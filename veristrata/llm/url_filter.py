"""URL filters: domain and path rules, and a ratio of character language models for what no rule decides.

Native: DataFrame functions only. Two variable-order Markov models (contexts of 0 to ORDER characters, each order
smoothed by the one below) are counted over the hosts and paths of all URLs that the rules allow and block, but
for one fold. A URL's score is the difference of its log-likelihoods under the two, divided by its length. The
threshold is the cut of a histogram of scores on the fold left out that splits its two kinds best.

Hosts and paths are scored once for each different string, with the number of URLs as a weight when they are
counted, so that a host with a third of all URLs is one row; n-gram tables are pre-aggregated. Joins on n-grams, hosts and paths
are salted.

Cases: a null URL or one without '://' has an empty host and path, no rule, and the verdict of the model on two
empty strings; repeated rows are judged each; URLs of any length are used whole; an empty table gives an empty
result; a score that equals the cut is allowed, and of equally good cuts the one nearest 0 is taken; where the rules decide no URL of one kind, the threshold is 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, salted_join

#: (host and path, verdict); the longest that fits wins.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
ORDER = 4
SMOOTH = 2.0
FOLDS = 5
#: Of the calibration histogram: bins and half range of a score for each character.
BINS, RANGE = 400, 4.0
PAD, STOP = "\x02", "\x03"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _grams(strings: DataFrame) -> DataFrame:
    """One row for each character of each string, and for its end: the ORDER characters before and itself."""
    whole = F.concat(F.lit(PAD * (ORDER - 1)), F.col("kind"), F.col("string"), F.lit(STOP))
    at = F.explode(F.sequence(F.lit(1), F.length("string") + 1))
    rows = strings.withColumn("_whole", whole).withColumn("_at", at)
    return rows.withColumn("gram", F.substring(F.col("_whole"), F.col("_at"), F.lit(ORDER + 1))).drop("_whole", "_at")


def ratios(strings: DataFrame) -> DataFrame:
    """gram -> llr: log p(last character | those before) of the allowed less that of the blocked, for every gram of strings."""
    counts = materialize(_grams(strings).groupBy("gram").agg(F.sum("n_allow").alias("a"), F.sum("n_block").alias("b")), "url-grams")
    below, symbols = None, counts.select(F.substring("gram", ORDER + 1, 1).alias("c")).distinct().count() + 1
    for k in range(ORDER + 1):
        level = counts.groupBy(F.expr(f"substring(gram, {ORDER + 1 - k})").alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        if k == 0:
            sums = level.agg(F.sum("a").alias("ca"), F.sum("b").alias("cb")).first()
            total = {"a": float(sums.ca or 0), "b": float(sums.cb or 0)}
            for x in "ab":
                level = level.withColumn(f"p{x}", (F.col(x) + 1.0) / (F.lit(total[x]) + symbols))
        else:
            context = W.partitionBy(F.expr(f"substring(gram, 1, {k})"))
            level = level.withColumn("ca", F.sum("a").over(context)).withColumn("cb", F.sum("b").over(context)).withColumn("tail", F.expr("substring(gram, 2)"))
            level = level.join(below.withColumnsRenamed({"gram": "tail", "pa": "qa", "pb": "qb"}), "tail")
            for x in "ab":
                level = level.withColumn(f"p{x}", (F.col(x) + SMOOTH * F.col(f"q{x}")) / (F.col(f"c{x}") + SMOOTH))
        below = level.select("gram", "pa", "pb")
    return below.select("gram", (F.ln("pa") - F.ln("pb")).alias("llr"))


def threshold(scored: DataFrame) -> float:
    """The cut between bins of the score that has the best mean of both kinds' shares on the right side; ties: nearest 0."""
    step = 2 * RANGE / BINS
    bin_ = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + RANGE) / step)))
    rows = scored.groupBy(bin_.alias("bin")).agg(F.count_if(F.col("said") == "allow").alias("a"), F.count_if(F.col("said") == "block").alias("b")).collect()  # at most BINS rows
    n_allow, n_block = sum(r.a for r in rows), sum(r.b for r in rows)
    if not n_allow or not n_block:
        return 0.0
    best = (0.0, 0.0, 0.0)
    for k in range(BINS + 1):
        right = sum(r.a for r in rows if r.bin >= k) / n_allow + sum(r.b for r in rows if r.bin < k) / n_block
        cut = k * step - RANGE
        best = max(best, (round(right, 9), -abs(cut), cut))
    return best[2]


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score for every row of pages (page_id, url)."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("said", said).withColumn("fold", F.crc32(F.coalesce("url", F.lit("")).cast("binary")) % FOLDS == 0)
    learn = ~F.col("fold")
    # host and path in one pass: two rows for each URL, summed before they are dealt
    parts = rows.select(F.explode(F.array(F.struct(F.lit("\x04").alias("kind"), F.col("host").alias("string")), F.struct(F.lit("\x05").alias("kind"), F.col("path").alias("string")))).alias("s"), "said", learn.alias("learn"))
    strings = parts.groupBy("s.kind", "s.string").agg(F.count_if(F.col("learn") & (F.col("said") == "allow")).alias("n_allow"), F.count_if(F.col("learn") & (F.col("said") == "block")).alias("n_block"))
    strings = materialize(strings, "url-strings")
    sums = salted_join(_grams(strings.select("kind", "string")), ratios(strings), "gram", "string").groupBy("kind", "string").agg(F.sum("llr").alias("llr"))
    sums = materialize(sums, "url-sums")
    score_of = lambda kind, col: sums.where(F.col("kind") == kind).select(F.col("string").alias(col), F.col("llr").alias(f"llr_{col}"))
    scored = salted_join(salted_join(rows, score_of("\x04", "host"), "host", "page_id"), score_of("\x05", "path"), "path", "page_id")
    scored = scored.withColumn("score", (F.col("llr_host") + F.col("llr_path")) / (F.length("host") + F.length("path") + 2))
    cut = threshold(scored.where("fold and said is not null"))
    verdict = F.coalesce("said", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 9).alias("score"))
