"""Sequences: gap sessions, neighbours, ranks, budgets, samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seconds(ts: str) -> Column:
    """Seconds since the epoch of a timestamp without zone (the session's zone is UTC), as a double."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def gaps(df: DataFrame, by: list[str], ts: str, tie: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(ts, tie)
    s = seconds(ts)
    return df.withColumn("previous_gap", s - F.lag(s).over(w)).withColumn("next_gap", F.lead(s).over(w) - s)


def gap_sessions(df: DataFrame, by: list[str], ts: str, tie: str, limits: list[int]) -> DataFrame:
    """Sessions for each limit: a gap larger than the limit starts one, an equal gap does not.

    All limits share one sort: each has a running sum over the same window.
    """
    w = W.partitionBy(*by).orderBy(ts, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = gaps(df, by, ts, tie)
    for k, limit in enumerate(limits):
        rows = rows.withColumn(f"_s{k}", F.sum((F.coalesce("previous_gap", F.lit(0.0)) > limit).cast("int")).over(w))
    each = F.explode(F.array(*[F.struct(F.lit(limit).alias("limit_s"), F.col(f"_s{k}").alias("session")) for k, limit in enumerate(limits)]))
    return rows.select(*[c for c in rows.columns if not c.startswith("_s")], each.alias("_x")).select("*", "_x.*").drop("_x")


def numbered(df: DataFrame, by: list[str], order: list[Column], out: str, total: str, keep: list[str] | None = None) -> DataFrame:
    """df, or its columns `keep`, with the place (from 1) of a row in its group's order, and the group's size; no task holds a whole group.

    Rows are dealt by ranges of (group, order), sorted there, and written once with their place in the range, as ranges are drawn from samples; a
    group's places start behind its rows of earlier ranges. Nothing is dealt a second time.
    """
    from veristrata.operators.groups import _written

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(ranges, *[F.col(c) for c in by], *order).sortWithinPartitions(*[F.col(c) for c in by], *order)
    at = F.monotonically_increasing_id()  # the partition's number, then the row's in 33 bits
    names = keep or df.columns
    rows = _written(rows.withColumn("_at", at).select(*dict.fromkeys([*names, *by]), "_at"))
    rows = rows.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy(*by, "_range").agg(F.count("*").alias("_held"), F.min("_at").alias("_first"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))  # over one row for each range
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_held").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).withColumn(total, F.sum("_held").over(group)).drop("_held", "_first")
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    sizes = sizes.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by_{c}") for c in by], "_before", total)
    sizes = _written(sizes)  # a row for each range that a group lies in
    joined = rows.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, same)
    return joined.select(*names, total, (F.col("_before") + F.col("_at") + 1).alias(out))


def keys_at(df: DataFrame, by: str, value: str, ties: list[str], shares: list[float], descending: bool = False, least: int = 0, bins: int = 4096) -> list[tuple]:
    """(group, share, value, ties...) of the row at place max(least, ceil(share * size)) of each group's order by (value, ties); of the few groups and shares only.

    Values are counted in equal bins of each group's range; only the rows of a bin that holds such a place are put in order. Null values come as Spark sorts them:
    first, or last if descending.
    """
    spans = {r[0]: r for r in df.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).collect()}  # one row for each group
    scale = F.lit(0.0)
    low = F.lit(0.0)
    for g, r in spans.items():
        if r.lo is not None and r.hi > r.lo:
            scale, low = F.when(F.col(by) == g, (bins - 1) / (r.hi - r.lo)).otherwise(scale), F.when(F.col(by) == g, float(r.lo)).otherwise(low)
    at = F.coalesce(F.floor((F.col(value) - low) * F.when(F.col(value).isNull(), None).otherwise(scale)), F.lit(-1)).cast("int")
    binned = df.withColumn("_bin", at)
    held: dict = {}
    for r in binned.groupBy(by, "_bin").agg(F.count("*").alias("n")).collect():  # at most so many bins for each group
        held.setdefault(r[0], []).append((r["_bin"], r.n))
    wanted = []
    for g, r in spans.items():
        for share in shares:
            place = max(least, math.ceil(r.n * share))
            for b, n in sorted(held[g], reverse=descending):
                if place <= n:
                    wanted += [(g, b, share, place)] if place > 0 else []
                    break
                place -= n
    if not wanted:
        return []
    inside = F.lit(False)
    for g, b in {(g, b) for g, b, *_ in wanted}:
        inside = inside | ((F.col(by) == g) & (F.col("_bin") == b))
    placed = numbered(binned.where(inside).select(by, "_bin", value, *ties), [by, "_bin"], [F.desc(value) if descending else F.asc(value), *[F.asc(t) for t in ties]], "_place", "_of")
    asked = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(b).alias("b"), F.lit(float(s)).alias("s"), F.lit(p).cast("long").alias("p")) for g, b, s, p in wanted])
    found = placed.withColumn("_w", F.explode(F.filter(asked, lambda w: (w["g"] == F.col(by)) & (w["b"] == F.col("_bin")) & (w["p"] == F.col("_place")))))
    return [tuple(r) for r in found.select(by, "_w.s", value, *ties).collect()]  # one row for each group and share


def running_sums(df: DataFrame, by: list[str], value: str, sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """df, which has one row for each value of a group, with sums over the group's values up to this one, and totals of the group.

    As in `numbered`: sums run inside ranges of (group, value) and start behind earlier ranges, so no task holds a whole group.
    """
    from veristrata.operators.groups import _written

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _written(df.repartitionByRange(ranges, *[F.col(c) for c in by], F.col(value)).withColumn("_range", F.spark_partition_id()))
    totals = totals or {}
    held = rows.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_h{k}") for k, c in enumerate(sums)], *[F.sum(c).alias(f"_t{k}") for k, c in enumerate(totals)])
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))  # over one row for each range
    before = [F.coalesce(F.sum(f"_h{k}").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))]
    held = held.select(*by, "_range", *before, *[F.sum(f"_t{k}").over(group).alias(out) for k, out in enumerate(totals.values())])
    inside = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.join(held, [*by, "_range"])
    return out.select(*df.columns, *totals.values(), *[(F.col(f"_b{k}") + F.sum(c).over(inside)).alias(name) for k, (c, name) in enumerate(sums.items())])


def risk_rank(df: DataFrame, by: list[str], value: str, tie: str, descending: bool = False) -> DataFrame:
    """1 for the first, falling evenly to 0 for the last; null values have no rank. With descending, ties are reversed too."""
    order = [F.desc(value), F.desc(tie)] if descending else [F.asc(value), F.asc(tie)]
    placed = numbered(df.where(F.col(value).isNotNull()), by, order, "_r", "_n")
    return placed.withColumn("risk", 1 - (F.col("_r") - 1) / F.greatest(F.lit(1), F.col("_n") - 1)).drop("_r", "_n")


def budget_top(df: DataFrame, by: list[str], value: str, tie: str, share: float) -> DataFrame:
    """The max(1, ceil(n * share)) rows of each group with the largest values."""
    rows = numbered(df, by, [F.desc(value), F.asc(tie)], "_r", "_n")
    return rows.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).drop("_n", "_r")


def systematic_sample(df: DataFrame, by: list[str], order: list[str], number: int) -> DataFrame:
    """Evenly spaced rows of each group by an order, ends included; rounding is half to even."""
    rows = numbered(df, by, [F.asc(c) for c in order], "_r", "_n")
    at = F.transform(F.sequence(F.lit(0), F.lit(number - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / (number - 1)).cast("long"))
    return rows.where((F.col("_n") <= number) | F.array_contains(at, F.col("_r") - 1)).drop("_n", "_r")
