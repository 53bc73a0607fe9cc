"""Cluster bootstrap with draws from an integer generator, and penalised logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the generator: (a * x + c) mod m, used twice on a mixed seed.
LCG_A, LCG_C, LCG_M = 48271, 11, 2147483647


def draw(rep: Column, k: Column, clusters: int, seed: int = 7) -> Column:
    """Index of the cluster of draw k in a replicate."""
    x = (rep * 7919 + k * 104729 + seed) % LCG_M
    for _ in range(2):
        x = (x * LCG_A + LCG_C) % LCG_M
    return x % clusters


def cluster_bootstrap(clusters: DataFrame, number: int, replicates: int) -> DataFrame:
    """Interval of sum(top) / sum(bottom) over replicates; clusters has (cluster 0..number-1, top, bottom), a bounded table."""
    spark = clusters.sparkSession
    draws = spark.range(replicates * number).select(F.floor(F.col("id") / number).alias("rep"), (F.col("id") % number).alias("k"))
    draws = draws.select("rep", draw(F.col("rep"), F.col("k"), number).alias("cluster"))
    per = draws.join(clusters, "cluster").groupBy("rep").agg((F.sum("top") / F.sum("bottom")).alias("r"))
    return per.agg(F.round(F.percentile("r", F.lit(0.025)), 9).alias("low"), F.round(F.percentile("r", F.lit(0.5)), 9).alias("median"), F.round(F.percentile("r", F.lit(0.975)), 9).alias("high"), F.count("*").alias("replicates"))


def _standardised(df: DataFrame, features: list[str], label: str, *more: str) -> DataFrame:
    """Columns _0 (one), _1.. (the features in deviations from their means) and _y, and those named besides."""
    moments = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [((F.col(c) - moments[f"m_{c}"]) / (moments[f"s_{c}"] or 1.0)).alias(f"_{k + 1}") for k, c in enumerate(features)]
    return df.select(F.lit(1.0).alias("_0"), *scaled, F.col(label).cast("double").alias("_y"), *more)


def _newton(rows: DataFrame, size: int, replicates: int, penalty: float, turns: int) -> np.ndarray:
    """Coefficients of each replicate; rows has _0.., _y, _rep and the weight _w. Each turn is one aggregation for all replicates."""
    beta, ridge = np.zeros((replicates, size)), np.diag([0.0] + [penalty] * (size - 1))
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    for _ in range(turns):
        z = sum((F.col(f"_{k}") * F.get(F.array(*[F.lit(float(b)) for b in beta[:, k]]), F.col("_rep")) for k in range(size)), F.lit(0.0))
        p, w = F.col("_p"), F.col("_w")
        sums = rows.withColumn("_p", 1 / (1 + F.exp(-z))).groupBy("_rep").agg(*[F.sum(w * (p - F.col("_y")) * F.col(f"_{i}")).alias(f"g{i}") for i in range(size)], *[F.sum(w * p * (1 - p) * F.col(f"_{i}") * F.col(f"_{j}")).alias(f"h{i}_{j}") for i, j in pairs]).collect()  # one row for each replicate
        moved = 0.0
        for s in sums:
            h = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]) + ridge
            step = np.linalg.solve(h, np.array([s[f"g{i}"] for i in range(size)]) + ridge @ beta[s["_rep"]])
            beta[s["_rep"]] -= step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-10:
            break
    return beta


def newton_logistic(df: DataFrame, features: list[str], label: str, penalty: float = 1.0, turns: int = 12) -> dict[str, float]:
    """Coefficients of a logistic regression with an unpenalised intercept, on standardised inputs.

    Each Newton turn is one aggregation of the gradient and the Hessian; only those sums reach the driver.
    """
    rows = _standardised(df, features, label).select("*", F.lit(0).alias("_rep"), F.lit(1.0).alias("_w"))
    return dict(zip(["intercept", *features], _newton(rows, len(features) + 1, 1, penalty, turns)[0].tolist(), strict=True))


def logistic_stability(df: DataFrame, features: list[str], label: str, cluster: str, clusters: int, replicates: int = 20, penalty: float = 1.0, turns: int = 12) -> DataFrame:
    """feature, coefficient of all rows, and the share of replicates of resampled clusters (0 to clusters - 1) in which it has the same sign.

    How often a replicate draws a cluster is a broadcast table of clusters x replicates rows; rows are multiplied on the way into the
    partial sums, never in a shuffle.
    """
    spark = df.sparkSession
    rows = _standardised(df, features, label, F.col(cluster).cast("long").alias("_c"))
    full = _newton(rows.select("*", F.lit(0).alias("_rep"), F.lit(1.0).alias("_w")), len(features) + 1, 1, penalty, turns)[0]
    rep = F.floor(F.col("id") / clusters)
    drawn = spark.range(replicates * clusters).select(rep.cast("int").alias("_rep"), draw(rep, F.col("id") % clusters, clusters).alias("_c")).groupBy("_rep", "_c").agg(F.count("*").cast("double").alias("_w"))
    each = _newton(rows.join(F.broadcast(drawn), "_c"), len(features) + 1, replicates, penalty, turns)
    same = (np.sign(each) == np.sign(full)).mean(axis=0)
    return spark.createDataFrame([(n, float(round(full[k + 1], 6)), float(round(same[k + 1], 6))) for k, n in enumerate(features)], "feature string, coefficient double, same_sign double")
