"""Integrity checks: one PASS or FAIL row each, and a guard that raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit("unique " + ",".join(keys)).alias("check"), "violations")


def subset(df: DataFrame, other: DataFrame, key: str, other_key: str) -> DataFrame:
    left = df.select(F.col(key).alias("k")).distinct().join(other.select(F.col(other_key).alias("k")).distinct(), "k", "left_anti")
    return left.agg(F.count("*").alias("violations")).select(F.lit(f"{key} in {other_key}").alias("check"), "violations")


def holds(df: DataFrame, name: str, condition: str) -> DataFrame:
    return df.agg(F.count_if(~F.expr(condition)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def status(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def require(checks: DataFrame) -> None:
    """Raises with the names of failed checks."""
    failed = [r["check"] for r in checks.where("status = 'FAIL'").collect()]  # one row for each check
    if failed:
        raise ValueError("failed: " + "; ".join(failed))


def same_keys(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """base joined with other, one row of each for a key; raises where a side lacks a key or repeats one."""
    from veristrata.operators.groups import _written

    mine, its = [c for c in base.columns if c not in keys], [c for c in other.columns if c not in keys]
    blank = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    both = base.select(*keys, *mine, *blank(other, its), F.lit(0).alias("_side")).unionByName(other.select(*keys, *blank(base, mine), *its, F.lit(1).alias("_side")))
    of = lambda side, names: [F.max_by(c, F.when(F.col("_side") == side, 0).otherwise(-1)).alias(c) for c in names]
    both = _written(both.groupBy(*keys).agg(F.count_if(F.col("_side") == 0).alias("_a"), F.count_if(F.col("_side") == 1).alias("_b"), *of(0, mine), *of(1, its)))
    bad = both.where(" or ".join(["_a <> 1", "_b <> 1", *[f"{k} is null" for k in keys]]))
    if bad.take(1):
        raise ValueError(f"keys {keys} that one side lacks or repeats: {[r.asDict() for r in bad.select(*keys, '_a', '_b').limit(3).collect()]}")
    return both.select(*keys, *mine, *its)


def coverage(parts: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: rows of parts, keys in several parts, keys that parts lack, keys that only parts have."""
    held = parts.groupBy(key).agg(F.count("*").alias("_n"))
    both = held.join(whole.select(key).distinct().withColumn("_in", F.lit(True)), key, "full")
    return both.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n") > 1).alias("shared"), F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_in").isNull()).alias("extra"))


def reproduces(got: DataFrame, expected: DataFrame, key: str, value: str, rel: float = 1e-9) -> DataFrame:
    """key, got, expected, ok for every expected metric; one that is lacking is not ok."""
    both = expected.select(key, F.col(value).alias("expected")).join(got.select(key, F.col(value).alias("got")), key, "left")
    near = F.abs(F.col("got") - F.col("expected")) <= F.lit(rel) * F.greatest(F.abs("got"), F.abs("expected"), F.lit(1.0))
    return both.withColumn("ok", F.coalesce(near, F.lit(False)))


def frozen(files: DataFrame, expected: dict[str, str]) -> None:
    """Raises unless every named file (stem, sha256) is there with the hash it was frozen with; `expected` is a short list."""
    got = {r.stem: r.sha256 for r in files.where(F.col("stem").isin(list(expected))).select("stem", "sha256").collect()}  # one row for each name
    bad = sorted(name for name, digest in expected.items() if got.get(name) != digest)
    if bad:
        raise ValueError("changed or lacking: " + "; ".join(bad))
