"""Detection metrics from matched images: sweeps, outcomes, error types, average precision, safety, routing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions.exprs import f1, iou, precision, ratio, recall


def grid(df: DataFrame, thresholds: list[float], name: str = "threshold") -> DataFrame:
    """Each row once for each threshold of a short list, without a join."""
    rows = F.array(*[F.struct(F.lit(k).alias("threshold_id"), F.lit(float(t)).alias(name)) for k, t in enumerate(thresholds)])
    return df.withColumn("_g", F.explode(rows)).select(*df.columns, "_g.*")


def sweep(images: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts and ratios per threshold. Greedy order is by confidence, so one matching at the floor serves all thresholds.

    Rows are reduced to counts per image before the grid, and to one row per threshold in each task before the shuffle.
    """
    per = images.select(F.size("gts").alias("n_gt"), F.transform("match", lambda m: F.struct(m["conf"].alias("conf"), m["j"].isNotNull().alias("hit"))).alias("m"))
    per = grid(per, thresholds)
    kept = lambda hit: F.size(F.filter("m", lambda m: (m["conf"] >= F.col("threshold")) & (m["hit"] == F.lit(hit))))
    out = per.groupBy("threshold_id", "threshold").agg(F.sum(kept(True)).alias("tp"), F.sum(kept(False)).alias("fp"), F.sum("n_gt").alias("n_gt"))
    return with_ratios(out.withColumn("fn", F.col("n_gt") - F.col("tp")).drop("n_gt"))


def with_ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": F.round(precision(tp, fp), 9), "recall": F.round(recall(tp, fn), 9), "f1": F.round(f1(tp, fp, fn), 9)})


def object_outcomes(images: DataFrame, report: float, sized: str | None = None) -> DataFrame:
    """One row per true box: TP, or the kind of miss from the best of all predictions at the report threshold; with `sized` its area under that name."""
    from veristrata.operators.matching import nearest

    side = lambda a, b: F.col(f"x.gts.{b}") - F.col(f"x.gts.{a}")
    extra = [(side("x0", "x1") * side("y0", "y1")).alias(sized)] if sized else []
    hits = F.map_from_entries(F.transform(F.filter("match", lambda m: m["j"].isNotNull() & (m["conf"] >= report)), lambda m: F.struct(m["j"], F.struct(m["conf"].alias("conf"), m["iou"].alias("iou")))))
    each = images.select("img", "fold_id", hits.alias("hits"), F.explode(F.arrays_zip("gts", nearest(F.col("gts"), F.col("preds")).alias("best"))).alias("x"))
    rows = each.select("img", "fold_id", F.col("x.gts.j").alias("gt_index"), F.try_element_at("hits", F.col("x.gts.j")).alias("hit"), F.col("x.best").alias("best"), *extra)
    none = F.col("best").isNull()
    kind = (F.when(F.col("hit").isNotNull(), "MATCHED").when(none, "NO_DETECTION").when((F.col("best.iou") >= 0.5) & (F.col("best.conf") < report), "LOW_CONFIDENCE")
            .when((F.col("best.conf") >= report) & (F.col("best.iou") >= 0.1), "LOCALIZATION_FAILURE").otherwise("NO_DETECTION"))
    return rows.select("img", "fold_id", "gt_index", F.when(F.col("hit").isNotNull(), "TP").otherwise("FN").alias("status"), kind.alias("error_type"),
                       F.coalesce("hit.conf", "best.conf").alias("confidence"), F.round(F.coalesce("hit.iou", "best.iou"), 9).alias("iou"), *([sized] if sized else []))


def false_positives(images: DataFrame, report: float) -> DataFrame:
    """One row per unmatched prediction at the report threshold, typed by its nearest true box."""
    rows = images.select("img", "fold_id", "gts", F.explode(F.filter("match", lambda m: m["j"].isNull() & (m["conf"] >= report))).alias("m"), "preds")
    pred = F.element_at(F.filter("preds", lambda p: p["i"] == F.col("m.i")), 1)
    rows = rows.withColumn("p", pred)
    near = F.coalesce(F.array_max(F.transform("gts", lambda g: iou(g, F.col("p")))), F.lit(0.0))
    kind = F.when(F.col("near") >= 0.5, "DUPLICATE_EXCESS").when(F.col("near") >= 0.1, "LOCALIZATION_FALSE_POSITIVE").otherwise("BACKGROUND_FALSE_POSITIVE")
    return rows.withColumn("near", near).select("img", "fold_id", F.col("m.i").alias("pred_index"), F.col("m.conf").alias("confidence"), F.round("near", 9).alias("nearest_iou"), kind.alias("fp_type"))


def average_precision(images: DataFrame, overlaps: list[float]) -> DataFrame:
    """101-point interpolated average precision per overlap threshold.

    Predictions of all images are ranked by (confidence, image, index), all falling. Each is one row with a bit for each overlap, dealt once by
    ranges of that order; running sums go over a range and start behind the sums of earlier ranges. Of rows with the same number of hits the
    first is the most precise, so only rows that hit go on.
    """
    from veristrata.operators.groups import _written
    from veristrata.operators.matching import hits

    many = len(overlaps)
    ready = images.select("img", F.size("gts").alias("n_gt"), hits(F.col("preds"), F.col("gts"), overlaps).alias("m"))
    rows = ready.select("img", "n_gt", F.posexplode_outer("m").alias("at", "m"))
    rows = rows.select("img", F.col("m.i").alias("i"), F.col("m.conf").alias("conf"), F.col("m.hits").alias("hits"), F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n_gt")).otherwise(0).alias("n_gt"))
    order = [F.desc("conf"), F.desc("img"), F.desc("i")]
    rows = rows.repartitionByRange(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("hits", "n_gt")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, held, total, true = TaskContext.get().partitionId(), np.zeros(many, np.int64), 0, 0

        def out(number: np.ndarray, bits: np.ndarray, upto: np.ndarray, true: int) -> pa.RecordBatch:
            size = number.size
            columns = [pa.array(np.full(size, spot), pa.int32()), pa.array(number), pa.array(bits), pa.array(np.full(size, true)), *[pa.array(upto[:, k]) for k in range(many)]]
            return pa.RecordBatch.from_arrays(columns, names=["range", "n", "hits", "n_gt", *[f"c{k}" for k in range(many)]])

        for batch in batches:
            true += int(batch.column(1).to_numpy().sum())
            bits = pc.drop_null(batch.column(0)).to_numpy()  # images without predictions
            upto = held + np.cumsum((bits[:, None] >> np.arange(many)) & 1, axis=0)
            at = np.flatnonzero(bits)
            yield out(total + 1 + at, bits[at], upto[at], 0)
            total += bits.size
            held = upto[-1] if bits.size else held
        yield out(np.array([total]), np.array([0]), held[None, :], true)  # the range's sums

    names = [f"c{k}" for k in range(many)]
    found = _written(rows.mapInArrow(summed, "range int, n long, hits long, n_gt long, " + ", ".join(f"{c} long" for c in names)))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    before = found.where("hits = 0").select(F.col("range"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", *names)], F.sum("n_gt").over(W.partitionBy(F.lit(1))).alias("_n_gt"))
    rows = found.where("hits <> 0").drop("n_gt").join(F.broadcast(before), "range")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("overlap_id"), F.when(F.col("hits").bitwiseAND(1 << k) != 0, F.col(c) + F.col(f"_{c}")).alias("tp")) for k, c in enumerate(names)]))
    rows = rows.select((F.col("n") + F.col("_n")).alias("n"), "_n_gt", each.alias("x")).select("n", "_n_gt", "x.*").where("tp is not null")
    # the best precision at or right of each of 101 recalls: a row counts for all points up to its own
    points = rows.groupBy("overlap_id", F.floor(ratio(F.col("tp"), F.col("_n_gt")) * 100 + 1e-9).cast("int").alias("point")).agg(F.max(F.col("tp") / F.col("n")).alias("p"))
    right = W.partitionBy("overlap_id").orderBy("point").rowsBetween(W.currentRow, W.unboundedFollowing)
    points = points.withColumn("p", F.max("p").over(right)).withColumn("before", F.lag("point", 1, -1).over(W.partitionBy("overlap_id").orderBy("point")))
    points = points.groupBy("overlap_id").agg((F.sum(F.col("p") * (F.col("point") - F.col("before"))) / 101.0).alias("ap"))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("overlap_id"), F.lit(float(t)).alias("overlap")) for k, t in enumerate(overlaps)]))
    asked = before.agg(F.sum("_n").alias("some"), F.max("_n_gt").alias("_n_gt")).where("_n_gt is not null").select(asked.alias("x")).select("x.*")
    return asked.join(points, "overlap_id", "left").select("overlap_id", "overlap", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def image_safety(images: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per image and threshold: true boxes, found ones, and unmatched predictions."""
    per = images.where(F.size("gts") > 0).select("img", F.size("gts").alias("n_gt"), F.transform("match", lambda m: F.struct(m["conf"].alias("conf"), m["j"].isNotNull().alias("hit"))).alias("m"))
    per = grid(per, thresholds)
    found = F.size(F.filter("m", lambda m: (m["conf"] >= F.col("threshold")) & m["hit"]))
    extra = F.size(F.filter("m", lambda m: (m["conf"] >= F.col("threshold")) & ~m["hit"]))
    return per.select("img", "n_gt", "threshold_id", "threshold", found.alias("found"), extra.alias("extra"))


def safety_summary(per_image: DataFrame, *by: str) -> DataFrame:
    f, n = F.col("found"), F.col("n_gt")
    return per_image.groupBy("threshold_id", "threshold", *by).agg(
        F.count("*").alias("images"), F.count_if(f > 0).alias("any_detected"), F.count_if(f == n).alias("all_detected"), F.count_if((f > 0) & (f < n)).alias("partial"),
        F.count_if(f == 0).alias("zero_detected"), F.sum(n - f).alias("missed"))


def routing(images: DataFrame, high: float, lows: list[float]) -> DataFrame:
    """DETECT, REINSPECT or PASS per image for each lower threshold, by the largest confidence; with counts of candidates."""
    top = images.select(F.size("gts").alias("n_gt"), F.coalesce(F.array_max(F.transform("preds", lambda p: p["conf"])), F.lit(-1.0)).alias("top"), F.transform("preds", lambda p: p["conf"]).alias("c"))
    per = grid(top, lows, "low")
    route = F.when(F.col("top") >= high, "DETECT").when(F.col("top") >= F.col("low"), "REINSPECT").otherwise("PASS")
    band = F.size(F.filter("c", lambda c: (c >= F.col("low")) & (c < high)))
    return per.withColumn("route", route).withColumn("band", band).groupBy("threshold_id", "low", "route").agg(F.count("*").alias("images"), F.sum("n_gt").alias("objects"), F.sum("band").alias("band_candidates"), F.count_if(F.col("n_gt") > 0).alias("images_with_gt"))


def no_rematch_sweep(objects: DataFrame, thresholds: list[float]) -> DataFrame:
    """Applies thresholds to the prediction that each object got at the floor, without matching again."""
    rows = grid(objects.select("confidence", "matched"), thresholds)
    found = F.col("matched") & (F.col("confidence") >= F.col("threshold"))
    return rows.groupBy("threshold_id", "threshold").agg(F.count_if(found).alias("tp"), F.count_if(~found).alias("fn"), F.count("*").alias("n")).withColumn("recall", F.round(ratio(F.col("tp"), F.col("n")), 9))
