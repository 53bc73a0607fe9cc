"""Groups and folds: components, duplicate groups, leakage, fold assignment."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _written(df: DataFrame) -> DataFrame:
    """df as Parquet in the folder that all executors share, read back; a temporary folder only where Spark runs in this process alone."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="veristrata-")
        spark.sparkContext.setCheckpointDir(where)
    path = f"{where.rstrip('/')}/groups-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str, b: str, turns: int = 100) -> DataFrame:
    """node, component (least node reachable), by least labels of neighbours with a jump to the label's label in each turn."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct()
    both = _written(both)
    labels = _written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).select(F.col("u").alias("node"), "label"))
    for _ in range(turns):
        near = both.join(labels.withColumnsRenamed({"node": "v", "label": "near"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = step.join(step.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left")
        moved = _written(jump.select("node", F.col("label").alias("was"), F.least("next", F.coalesce("far", "next")).alias("label")))
        if not moved.where("was <> label").take(1):
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")
    raise RuntimeError("components did not settle")


def assign_folds(groups: DataFrame, folds: int = 4) -> DataFrame:
    """Folds for groups (group_id, size): largest first, each to the fold with the least squared deviation from an even split.

    Each choice depends on those before, so it is one task; it gets one row per group and two numbers each.
    """

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "group_id"], ascending=[False, True])
        target, sizes, out = pdf["size"].sum() / folds, [0] * folds, []
        for n in pdf["size"]:
            cost = [sum(((s + (n if k == f else 0)) - target) ** 2 for k, s in enumerate(sizes)) for f in range(folds)]
            best = min(range(folds), key=lambda f: (cost[f], sizes[f], f))
            sizes[best] += n
            out.append(best + 1)
        return pd.DataFrame({"group_id": pdf["group_id"], "size": pdf["size"], "fold_id": out})

    return groups.select("group_id", "size", F.lit(1).alias("all")).groupBy("all").applyInPandas(task, "group_id long, size long, fold_id int")


def assign_vector_folds(tokens: DataFrame, weights: dict[str, float], folds: int = 4) -> DataFrame:
    """group_id, fold_id for groups given as counts of tokens (group_id, size, family, token, n).

    Groups come by falling size, then by falling rarity (their largest share of a token's total), then by id. Each goes to the fold where the
    weighted mean over families of squared deviations from an even split is least; ties to the smaller fold, then the first. Families
    without a weight count 1. Each choice depends on those before, so it is one task over one row for each group and token.
    """

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["family"] + ":" + pdf["token"]
        columns = {key: k for k, key in enumerate(sorted(set(keys)))}
        family_of = dict(zip(keys, pdf["family"], strict=True))
        families = [family_of[key] for key in columns]
        held = pd.Series(families).value_counts()
        vectors: dict[int, np.ndarray] = {}
        for group, key, n in zip(pdf["group_id"], keys, pdf["n"], strict=True):
            vectors.setdefault(group, np.zeros(len(columns)))[columns[key]] += n
        totals = sum(vectors.values())
        scale = np.array([weights.get(f, 1.0) / held[f] for f in families]) / np.maximum(1.0, totals / folds) ** 2
        size = pdf.groupby("group_id")["size"].max().to_dict()
        rarity = {g: round(float((v / np.maximum(1.0, totals)).max()), 12) for g, v in vectors.items()}
        sums, sizes, out = np.zeros((folds, len(columns))), [0] * folds, []
        for group in sorted(vectors, key=lambda g: (-size[g], -rarity[g], g)):
            # only the chosen fold's own term changes, so the comparison needs that difference alone
            change = (((sums + vectors[group] - totals / folds) ** 2 - (sums - totals / folds) ** 2) * scale).sum(axis=1)
            best = min(range(folds), key=lambda f: (round(float(change[f]), 12), sizes[f], f))
            sums[best] += vectors[group]
            sizes[best] += int(size[group])
            out.append((group, best + 1))
        return pd.DataFrame(out, columns=["group_id", "fold_id"])

    rows = tokens.select(F.col("group_id").cast("long").alias("group_id"), F.col("size").cast("long").alias("size"), "family", "token", F.col("n").cast("long").alias("n"))
    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(task, "group_id long, fold_id int")
