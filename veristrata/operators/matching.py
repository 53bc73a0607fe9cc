"""Matching of predicted to true boxes inside an image, and suppression, as folds over arrays.

All work on rows with arrays (one row per image), so that after the collection nothing is shuffled. The folds state the result; `kernels`
computes the same for a batch of images at a time, and leaves to the folds images that hold a null, NaN or a repeated index.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristrata.functions.exprs import iou
from veristrata.operators import kernels

MATCH = "array<struct<i:int,conf:double,j:int,iou:double>>"


def by_confidence(preds: Column, ties_last_first: bool = False) -> Column:
    """Predictions in falling confidence; equal ones by rising (or falling) index."""
    keyed = F.transform(preds, lambda p: F.struct((-p["conf"]).alias("k"), (-p["i"] if ties_last_first else p["i"]).alias("t"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _batched(kind: str, task, columns: list[Column], least: float | Column) -> Column:
    """task over Arrow batches of the columns and of least."""
    if len(columns) == 1:
        def run(a: pa.Array, n: pa.Array) -> pa.Array:
            return task(a, n)
    else:
        def run(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
            return task(a, b, n)
    run.__annotations__ = {k: pa.Array for k in run.__annotations__}
    return F.arrow_udf(run, kind)(*columns, (least if isinstance(least, Column) else F.lit(least)).cast("double"))


def greedy_match(preds: Column, gts: Column, least: float | Column = 0.5, high_index_wins: bool = True, ties_last_first: bool = False) -> Column:
    """greedy_fold, computed for a batch of images at a time."""
    fast = _batched(MATCH, lambda p, g, n: kernels.greedy(p, g, n, high_index_wins, ties_last_first), [preds, gts], least)
    return F.coalesce(fast, greedy_fold(preds, gts, least, high_index_wins, ties_last_first))


def greedy_fold(preds: Column, gts: Column, least: float | Column = 0.5, high_index_wins: bool = True, ties_last_first: bool = False) -> Column:
    """Each prediction by falling confidence takes the free true box with the largest overlap, if that is at least `least`.

    Equal overlaps go to the higher or the lower index. Returns (i, conf, j, iou) per prediction in that order; j is null
    where it matches nothing.
    """
    sign = 1 if high_index_wins else -1

    def step(acc: Column, p: Column) -> Column:
        free = F.filter(gts, lambda g: ~F.array_contains(acc["used"], g["j"]))
        best = F.array_max(F.transform(free, lambda g: F.struct(iou(g, p).alias("iou"), (g["j"] * sign).alias("t"))))

        def take(b: Column) -> Column:
            hit = b.isNotNull() & (b["iou"] >= least)
            j = F.when(hit, b["t"] * sign)
            row = F.struct(p["i"].alias("i"), p["conf"].alias("conf"), j.alias("j"), F.when(hit, b["iou"]).alias("iou"))
            return F.struct(F.when(hit, F.array_append(acc["used"], j)).otherwise(acc["used"]).alias("used"), F.array_append(acc["out"], row).alias("out"))

        return _let(best, take)

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(MATCH).alias("out"))
    return F.aggregate(by_confidence(preds, ties_last_first), start, step, lambda acc: acc["out"])


def global_match(a: Column, b: Column, least: float) -> Column:
    """global_fold, computed for a batch of images at a time."""
    return F.coalesce(_batched(PAIRED, kernels.paired, [a, b], least), global_fold(a, b, least))


PAIRED = "array<struct<iou:double,ai:int,bi:int>>"


def global_fold(a: Column, b: Column, least: float) -> Column:
    """One-to-one pairs of two arrays of indexed boxes (index i), best overlap first; overlaps must exceed 0 and reach least."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.named_struct(F.lit("iou"), iou(x, y), F.lit("ai"), x["i"], F.lit("bi"), y["i"]))))
    pairs = F.reverse(F.array_sort(F.filter(pairs, lambda p: (p["iou"] >= least) & (p["iou"] > 0))))

    def step(acc: Column, p: Column) -> Column:
        taken = F.exists(acc, lambda q: (q["ai"] == p["ai"]) | (q["bi"] == p["bi"]))
        return F.when(taken, acc).otherwise(F.array_append(acc, p))

    return F.aggregate(pairs, F.array().cast(PAIRED), step)


KEPT = "array<struct<i:int,conf:double,model:int,x0:double,y0:double,x1:double,y1:double,models:array<int>,suppressed:int>>"


def union_nms(preds: Column, least: float, cap: int = 300, by_model: bool = True) -> Column:
    """union_fold, computed for a batch of images at a time."""
    return F.coalesce(_batched(KEPT, lambda p, n: kernels.union(p, n, cap, by_model), [preds], least), union_fold(preds, least, cap, by_model))


def union_fold(preds: Column, least: float, cap: int = 300, by_model: bool = True) -> Column:
    """Suppression over all predictions: one goes if it overlaps a kept one by at least `least`; the first such kept one gains its model.

    The order is (falling confidence, model, index), or without by_model (falling confidence, index). Survivors carry the models that contributed and how many they suppressed.
    """
    keyed = F.transform(preds, lambda p: F.struct((-p["conf"]).alias("k"), (p["model"] if by_model else F.lit(0)).alias("m"), p["i"].alias("i"), p.alias("p")))

    def step(acc: Column, s: Column) -> Column:
        p = s["p"]
        first = F.coalesce(F.array_min(F.filter(F.transform(acc, lambda k, n: F.when(iou(k, p) >= least, n)), lambda n: n.isNotNull())), F.lit(-1))

        def take(at: Column) -> Column:
            new = F.struct(*[p[c].alias(c) for c in ("i", "conf", "model", "x0", "y0", "x1", "y1")], F.array(p["model"]).alias("models"), F.lit(0).alias("suppressed"))
            merged = F.transform(acc, lambda k, n: F.when(n == at, F.struct(*[k[c].alias(c) for c in ("i", "conf", "model", "x0", "y0", "x1", "y1")], F.array_sort(F.array_union(k["models"], F.array(p["model"]))).alias("models"), (k["suppressed"] + 1).alias("suppressed"))).otherwise(k))
            return F.when(at < 0, F.array_append(acc, new)).otherwise(merged)

        return _let(first, take)

    return F.slice(F.aggregate(F.array_sort(keyed), F.array().cast(KEPT), step), 1, cap)


AUDIT = "struct<kept:array<struct<i:int,x0:double,y0:double,x1:double,y1:double>>,out:array<struct<i:int,conf:double,by:int>>>"


def union_match(preds: Column, least: float, gts: Column) -> Column:
    """The greedy matching of what union suppression keeps, both for a batch of images at a time."""
    return F.coalesce(_batched(MATCH, kernels.union_greedy, [preds, gts], least), greedy_fold(union_fold(preds, least), gts))


AUDITED = "array<struct<i:int,conf:double,by:int>>"


def nms_audit(preds: Column, least: float) -> Column:
    """audit_fold, computed for a batch of images at a time."""
    return F.coalesce(_batched(AUDITED, kernels.audit, [preds], least), audit_fold(preds, least))


def audit_fold(preds: Column, least: float) -> Column:
    """(i, conf, by) for every prediction in falling confidence: `by` is the first kept one that overlaps it by at least `least`, null if it is kept."""
    def step(acc: Column, p: Column) -> Column:
        first = F.get(F.filter(acc["kept"], lambda k: iou(k, p) >= least), F.lit(0))["i"]

        def take(by: Column) -> Column:
            box = F.struct(*[p[c].alias(c) for c in ("i", "x0", "y0", "x1", "y1")])
            return F.struct(F.when(by.isNull(), F.array_append(acc["kept"], box)).otherwise(acc["kept"]).alias("kept"), F.array_append(acc["out"], F.struct(p["i"].alias("i"), p["conf"].alias("conf"), by.alias("by"))).alias("out"))

        return _let(first, take)

    return F.aggregate(by_confidence(preds), F.struct(F.array().alias("kept"), F.array().alias("out")).cast(AUDIT), step, lambda acc: acc["out"])


HITS = "array<struct<i:int,conf:double,hits:long>>"


def hits_fold(preds: Column, gts: Column, overlaps: list[float]) -> Column:
    """(i, conf, hits) of each prediction by falling (confidence, index): bit k of hits says that it takes a true box at overlaps[k]."""
    near = lambda p: F.reverse(F.array_sort(F.filter(F.transform(gts, lambda g: F.struct(iou(g, p).alias("iou"), g["j"].alias("j"))), lambda x: x["iou"] >= min(overlaps))))
    ready = F.transform(by_confidence(preds, True), lambda p: F.struct(p["i"].alias("i"), p["conf"].alias("conf"), near(p).alias("near")))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<long>").alias("out"))

    def one(least: Column, bit: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            free = F.filter(p["near"], lambda g: (g["iou"] >= least) & ~F.array_contains(acc["used"], g["j"]))
            used = F.when(F.size(free) > 0, F.array_append(acc["used"], F.get(free, F.lit(0))["j"])).otherwise(acc["used"])
            return F.struct(used.alias("used"), F.array_append(acc["out"], F.when(F.size(free) > 0, bit).otherwise(F.lit(0).cast("long"))).alias("out"))

        return F.aggregate(ready, start, step, lambda acc: acc["out"])

    each = F.array(*[F.struct(F.lit(float(t)).alias("least"), F.lit(1 << k).cast("long").alias("bit")) for k, t in enumerate(overlaps)])
    bits = F.aggregate(each, F.transform(ready, lambda p: F.lit(0).cast("long")), lambda acc, x: F.zip_with(acc, one(x["least"], x["bit"]), lambda a, b: a + b))
    return F.zip_with(ready, bits, lambda p, b: F.struct(p["i"].alias("i"), p["conf"].alias("conf"), b.alias("hits")))


def hits(preds: Column, gts: Column, overlaps: list[float]) -> Column:
    """hits_fold, computed for a batch of images at a time."""
    def run(p: pa.Array, g: pa.Array) -> pa.Array:
        return kernels.hits(p, g, overlaps)

    run.__annotations__ = {k: pa.Array for k in run.__annotations__}
    return F.coalesce(F.arrow_udf(run, HITS)(preds, gts), hits_fold(preds, gts, overlaps))


NEAREST = "array<struct<iou:double,conf:double>>"


def nearest(gts: Column, preds: Column) -> Column:
    """For each true box the largest (overlap, confidence) of all predictions; null without any. For a batch of images at a time, as the others."""
    def run(g: pa.Array, p: pa.Array) -> pa.Array:
        return kernels.nearest(g, p)

    run.__annotations__ = {k: pa.Array for k in run.__annotations__}
    fold = F.transform(gts, lambda g: F.array_max(F.transform(preds, lambda p: F.struct(iou(g, p).alias("iou"), p["conf"].alias("conf")))))
    return F.coalesce(F.arrow_udf(run, NEAREST)(gts, preds), fold)


def counted(images: DataFrame, columns: list[str], settings: list[tuple], names: str, task, first: str = "") -> DataFrame:
    """tp, fp, fn, rescued and lost by setting, after the columns `first`: task counts a batch of images under all settings, so tasks send one row for each setting and batch.

    names: the settings' columns and their types.
    """
    keys = [x.split()[0] for x in names.split(", ")]
    numbers = [*first.split(), "tp", "fp", "fn", "rescued", "lost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = task(*batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(k, *x) for k, x in enumerate(got)], strict=True)], names=["k", *numbers])

    out = images.select(*columns).mapInArrow(run, "k long, " + ", ".join(f"{n} long" for n in numbers)).groupBy("k").agg(*[F.sum(n).alias(n) for n in numbers])
    of = images.sparkSession.createDataFrame([(k, *s) for k, s in enumerate(settings)], "k long, " + names)
    return out.join(F.broadcast(of), "k").select(*keys, *numbers)  # one row for each setting


def matched(images: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """images with `match`, the greedy matching at the confidence floor."""
    return images.withColumn("match", greedy_match(F.col("preds"), F.col("gts"), least, **how))
