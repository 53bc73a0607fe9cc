"""Statistics over groups: exact quantiles, robust bundles, correlation, distances between distributions, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions.exprs import ratio
from veristrata.operators import windows as N


def quantile(value: str | Column, q: float, weight: Column | None = None) -> Column:
    """Linear interpolation between order statistics (type 7); with a weight, of a histogram."""
    c = F.col(value) if isinstance(value, str) else value
    return F.percentile(c, F.lit(q)) if weight is None else F.percentile(c, F.lit(q), weight)


def robust_bundle(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, population deviation, quantiles, median absolute deviation and entropy of the values, per group.

    The second pass joins one row per group; entropy comes from counts per value.
    """
    first = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), *[quantile(value, q).alias(n) for n, q in (("p10", 0.1), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("p90", 0.9))], F.count(value).alias("n"))
    spread = df.join(first.select(*by, "median", "n"), by)
    mad = spread.groupBy(*by).agg(quantile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    p = F.col("c") / F.col("n")
    entropy = spread.where(F.col(value).isNotNull()).groupBy(*by, "n", value).agg(F.count("*").alias("c")).groupBy(*by).agg((-F.sum(p * F.log2(p))).alias("entropy"))
    return first.join(mad, by).join(entropy, by).withColumn("iqr", F.col("q75") - F.col("q25"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width counts; the last bin is closed, and a single value gets a range of one."""
    span = df.agg(F.min(value).cast("double").alias("lo0"), F.max(value).cast("double").alias("hi0"))
    flat = F.col("lo0") == F.col("hi0")
    span = span.select(F.when(flat, F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"), F.when(flat, F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # span is one row


def average_rank(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Ranks with ties at their mean: counts per value are summed over ranges of values, then joined back, so no group is one task."""
    counts = N.running_sums(df.groupBy(*by, value).agg(F.count("*").alias("_c")), by, value, {"_c": "_upto"})
    return df.join(counts.select(*by, value, (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias(out)), [*by, value])


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null where a side is constant, which its least and largest value tell: the deviation of a constant is not exactly 0 once partial sums are merged."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)  # rows that have both
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(constant, None).otherwise(F.covar_pop(x, y) / (F.nullif(F.stddev_pop(x), F.lit(0.0)) * F.nullif(F.stddev_pop(y), F.lit(0.0))))


def ks_distance(df: DataFrame, group: str, a, b, value: str) -> DataFrame:
    """Largest gap between the two groups' distribution functions, at distinct values."""
    counts = df.where(F.col(group).isin(a, b)).groupBy(value).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    cum = N.running_sums(counts.where(F.col(value).isNotNull()), [], value, {"na": "ca", "nb": "cb"}, {"na": "ta", "nb": "tb"})
    return cum.agg(F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("ks"))


def ks_to_all(df: DataFrame, by: list[str], group: str, number: int, value: str, qs: list[float] | None = None) -> DataFrame:
    """by, group (0 to number - 1), ks: largest gap between a group's distribution function and the one of all rows, at distinct values.

    With qs also `quantiles` of each group (type 7), from the same counts summed over ranges, so no task holds a group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("all_n"), *[F.count_if(F.col(group) == g).alias(f"n{g}") for g in range(number)])
    names = ["all_n", *[f"n{g}" for g in range(number)]]
    cum = N.running_sums(counts, by, value, {n: f"c_{n}" for n in names}, {n: f"t_{n}" for n in names})
    share = lambda n: ratio(F.col(f"c_{n}"), F.col(f"t_{n}"), None)
    at = lambda g, q: (F.col(f"t_n{g}") - 1) * F.lit(float(q))
    holds = lambda g, p: F.max(F.when((p < F.col(f"c_n{g}")) & (p >= F.col(f"c_n{g}") - F.col(f"n{g}")), F.col(value)))
    wanted = [(g, k, q) for g in range(number) for k, q in enumerate(qs or [])]
    ends = [holds(g, f(at(g, q))).alias(f"{e}{g}_{k}") for g, k, q in wanted for e, f in (("lo", F.floor), ("hi", F.ceil))]
    per = cum.groupBy(*by).agg(*[F.max(F.abs(share(f"n{g}") - share("all_n"))).alias(f"ks{g}") for g in range(number)], *[F.max(f"t_n{g}").alias(f"t_n{g}") for g in range(number)], *ends)

    def quantile_of(g: int, k: int, q: float) -> Column:
        lo, hi, p = F.col(f"lo{g}_{k}"), F.col(f"hi{g}_{k}"), at(g, q)
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    rows = [F.struct(F.col(f"ks{g}").alias("ks"), *([F.array(*[quantile_of(g, k, q) for k, q in enumerate(qs)]).alias("quantiles")] if qs else [])) for g in range(number)]
    return per.select(*by, F.posexplode(F.array(*rows)).alias(group, "_x")).select(*by, group, "_x.*")


def total_variation(df: DataFrame, group: str, category: str) -> DataFrame:
    """Half the summed difference between each group's shares of the categories and the overall shares."""
    cells = df.groupBy(group, category).agg(F.count("*").alias("n"))
    overall = cells.groupBy(category).agg(F.sum("n").alias("all_n"))
    sizes = cells.groupBy(group).agg(F.sum("n").alias("size"))
    every = sizes.withColumn("k", F.lit(1)).join(overall.withColumn("k", F.lit(1)), "k").drop("k")  # groups times categories
    total = F.sum("all_n").over(W.partitionBy(group))
    full = every.join(cells, [group, category], "left").withColumn("d", F.abs(F.coalesce("n", F.lit(0)) / F.col("size") - F.col("all_n") / total))
    return full.groupBy(group).agg((F.sum("d") * 0.5).alias("tv"))


def mean_difference(df: DataFrame, group: str, value: str) -> DataFrame:
    """Difference of group means from the overall mean, in overall deviations."""
    overall = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    per = df.groupBy(group).agg(F.avg(value).alias("gm"))
    return per.crossJoin(F.broadcast(overall)).select(group, ratio(F.col("gm") - F.col("m"), F.col("s"), None).alias("smd"))


def quantile_cuts(df: DataFrame, value: str, qs: list[float], many: str | None = None) -> DataFrame:
    """One row: the distinct cuts in order, type 7; `cuts` is empty if there are no values. A row counts `many` times, if that is given.

    Values are counted and summed over ranges, so no task holds all distinct values; only those at the wanted places go on.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg((F.sum(many) if many else F.count("*")).alias("c"))
    run = N.running_sums(counts, [], "v", {"c": "upto"}, {"c": "n"})
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    holds = lambda p: F.when((p < F.col("upto")) & (p >= F.col("upto") - F.col("c")), F.col("v"))
    ends = run.agg(F.max("n").alias("n"), *[F.max(holds(f(place(q)))).alias(f"{e}{k}") for k, q in enumerate(qs) for e, f in (("lo", F.floor), ("hi", F.ceil))])
    between = [(F.ceil(place(q)) - place(q)) * F.col(f"lo{k}") + (place(q) - F.floor(place(q))) * F.col(f"hi{k}") for k, q in enumerate(qs)]
    cuts = [F.when(F.col(f"lo{k}") == F.col(f"hi{k}"), F.col(f"lo{k}")).otherwise(b) for k, b in enumerate(between)]
    return ends.select(F.array_sort(F.array_distinct(F.array_compact(F.array(*cuts)))).alias("cuts"))
