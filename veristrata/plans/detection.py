"""Detection queries over the derived tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions.exprs import iou, labels_that_hold, ratio, tiles_along
from veristrata.operators import kernels as K
from veristrata.operators import matching as M
from veristrata.operators import metrics as X
from veristrata.plans import fixtures as FX

STEPS = [round(0.05 * k, 2) for k in range(20)]
LOWS = [0.1, 0.25, 0.4]
OVERLAPS = [0.5 + 0.05 * k for k in range(10)]
REPORT, HIGH = 0.25, 0.45

# ---------------------------------------------------------------- oracle parts
_IOU = """(greatest(0.0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0.0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))
 / greatest(1e-12, ({a}.x1-{a}.x0)*({a}.y1-{a}.y0) + ({b}.x1-{b}.x0)*({b}.y1-{b}.y0)
 - greatest(0.0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0.0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"""


def iou_sql(a: str, b: str) -> str:
    return _IOU.format(a=a, b=b)


def match_sql(sign: int = 1, least: str = "0.5", where: str = "", order: int = 1) -> str:
    """CTEs gl, pl and matched(img, fold_id, n_gt, m) with m a list of (i, conf, j, iou)."""
    return f"""{FX.FX},
gl AS (SELECT img, fold_id, list(struct_pack(j := gt_index, x0 := x0::DOUBLE, y0 := y0::DOUBLE, x1 := x1::DOUBLE, y1 := y1::DOUBLE) ORDER BY gt_index) AS gts FROM fx_gt GROUP BY img, fold_id),
pl AS (SELECT img, fold_id, list(struct_pack(k := -conf, t := {order} * pred_index, i := pred_index, conf := conf, x0 := x0::DOUBLE, y0 := y0::DOUBLE, x1 := x1::DOUBLE, y1 := y1::DOUBLE) ORDER BY conf DESC, {order} * pred_index) AS preds FROM fx_pred {where} GROUP BY img, fold_id),
im AS (SELECT coalesce(g.img, p.img) AS img, coalesce(g.fold_id, p.fold_id) AS fold_id, coalesce(g.gts, []) AS gts, coalesce(p.preds, []) AS preds FROM gl g FULL JOIN pl p ON g.img = p.img),
matched AS (SELECT img, fold_id, len(gts) AS n_gt, gts, preds, list_reduce(preds, lambda acc, p:
  list_transform([list_max(list_transform(list_filter(gts, lambda g: NOT list_contains(acc.used, g.j)), lambda g: struct_pack(iou := {iou_sql('g', 'p')}, t := {sign} * g.j)))],
    lambda b: struct_pack(used := CASE WHEN b IS NOT NULL AND b.iou >= {least} THEN list_append(acc.used, {sign} * b.t) ELSE acc.used END,
      m := list_append(acc.m, struct_pack(i := p.i, conf := p.conf, j := CASE WHEN b IS NOT NULL AND b.iou >= {least} THEN {sign} * b.t END, iou := CASE WHEN b IS NOT NULL AND b.iou >= {least} THEN b.iou END))))[1],
  struct_pack(used := []::INT[], m := []::STRUCT(i INT, conf DOUBLE, j INT, iou DOUBLE)[])).m AS m FROM im)"""


def grid_sql(values: list[float], name: str = "threshold") -> str:
    return "(VALUES " + ", ".join(f"({k}, CAST({float(v)!r} AS DOUBLE))" for k, v in enumerate(values)) + f") AS grid(threshold_id, {name})"


_RATIOS = """round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END, 9) AS recall,
round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 9) AS f1"""


def sweep_sql(sign: int) -> str:
    return f"""{match_sql(sign)},
c AS (SELECT threshold_id, threshold, CAST(sum(len(list_filter(m, lambda x: x.conf >= threshold AND x.j IS NOT NULL))) AS BIGINT) AS tp,
 CAST(sum(len(list_filter(m, lambda x: x.conf >= threshold AND x.j IS NULL))) AS BIGINT) AS fp, CAST(sum(n_gt) AS BIGINT) AS n_gt FROM matched, {grid_sql(STEPS)} GROUP BY ALL)
SELECT threshold_id, threshold, tp, fp, fn, {_RATIOS} FROM (SELECT *, n_gt - tp AS fn FROM c)"""


# ---------------------------------------------------------------- queries
def _matched(spark: SparkSession, d: str, model: int | None = None, **how) -> DataFrame:
    return M.matched(FX.images(spark, d, model), **how)


def det_sweep(spark, d):
    return X.sweep(_matched(spark, d), STEPS)


def det_sweep_alt_ties(spark, d):
    return X.sweep(_matched(spark, d, high_index_wins=False), STEPS)


def det_object_outcomes(spark, d):
    return X.object_outcomes(_matched(spark, d), REPORT)


def det_error_distribution(spark, d):
    rows = X.object_outcomes(_matched(spark, d), REPORT)
    return rows.groupingSets([["fold_id", "error_type"], ["error_type"]], "fold_id", "error_type").agg(F.count("*").alias("n")).select(F.coalesce(F.col("fold_id").cast("string"), F.lit("ALL")).alias("scope"), "error_type", "n")


def det_fp_types(spark, d):
    return X.false_positives(_matched(spark, d), REPORT).groupBy("fold_id", "fp_type").agg(F.count("*").alias("n"), F.count_distinct("img").alias("images"), F.round(F.avg("confidence"), 9).alias("mean_confidence"))


def det_map(spark, d):
    ap = X.average_precision(FX.images(spark, d), OVERLAPS)
    return ap.select("overlap_id", F.round("ap", 9).alias("ap"))


def det_ap50(spark, d):
    return X.average_precision(FX.images(spark, d), [0.5]).select(F.round("ap", 9).alias("ap50"))


def det_nms(spark, d):
    kept = FX.images(spark, d, 0).select("img", F.explode(M.union_nms(F.col("preds"), 0.5, by_model=False)).alias("k"))
    return kept.select("img", F.col("k.i").alias("pred_index"), F.col("k.suppressed").alias("suppressed"))


def det_union_nms(spark, d):
    kept = FX.images(spark, d).select("img", F.explode(M.union_nms(F.col("preds"), 0.5)).alias("k"))
    return kept.select("img", F.col("k.i").alias("pred_index"), F.array_join(F.transform("k.models", lambda m: m.cast("string")), ";").alias("models"))


def det_fusion_grid(spark, d):
    names = [(k, t) for k in range(3) for t in (0.5, 0.6, 0.7)]
    settings = [((0, 1) if k == 2 else (k,), t) for k, t in names]
    out = M.counted(FX.images(spark, d), ["preds", "gts"], names, "combination int, nms double", lambda p, g: K.fusion_counts(p, g, settings, float("-inf"), 0, False))
    return X.with_ratios(out.select("combination", "nms", "tp", "fp", "fn"))


def det_image_safety(spark, d):
    return X.safety_summary(X.image_safety(_matched(spark, d, high_index_wins=False), STEPS))


def det_safety_by_gt_count(spark, d):
    return X.safety_summary(X.image_safety(_matched(spark, d, high_index_wins=False), LOWS), "n_gt")


def det_single_object(spark, d):
    return X.safety_summary(X.image_safety(_matched(spark, d, high_index_wins=False), STEPS).where("n_gt = 1"))


def det_routing(spark, d):
    return X.routing(FX.images(spark, d), HIGH, LOWS)


def det_tradeoff(spark, d):
    s = X.sweep(_matched(spark, d), STEPS)
    base = s.where("threshold_id = 9").select(F.col("tp").alias("tp0"), F.col("fp").alias("fp0"))
    rows = s.crossJoin(F.broadcast(base))  # one row of a fixed grid
    return rows.select("threshold_id", (F.col("tp") - F.col("tp0")).alias("recovered"), (F.col("fp") - F.col("fp0")).alias("added_fp"), F.round(ratio(F.col("fp") - F.col("fp0"), F.col("tp") - F.col("tp0"), None), 9).alias("fp_per_recovered"))


def _at_floor(spark, d):
    rows = _matched(spark, d).select("img", "fold_id", "match", F.explode("gts").alias("g"))
    return rows.select("img", "fold_id", F.col("g.j").alias("gt_index"), F.try_element_at(F.filter("match", lambda m: m["j"] == F.col("g.j")), F.lit(1)).alias("hit"))


def det_no_rematch(spark, d):
    rows = _at_floor(spark, d).select(F.coalesce("hit.conf", F.lit(-1.0)).alias("confidence"), F.col("hit").isNotNull().alias("matched"))
    return X.no_rematch_sweep(rows, STEPS)


def det_fn_mechanism(spark, d):
    rows = X.object_outcomes(_matched(spark, d), REPORT).where("status = 'FN'")
    conf, over = F.coalesce("confidence", F.lit(-1.0)) >= REPORT, F.coalesce("iou", F.lit(0.0)) >= 0.5
    return rows.groupBy(F.when(conf, "CONF_OK").otherwise("CONF_LOW").alias("confidence_side"), F.when(over, "IOU_OK").otherwise("IOU_LOW").alias("overlap_side")).agg(F.count("*").alias("n"))


def det_export(spark, d):
    """Predictions above a floor, numbered after the filter, with the image's largest confidence before it."""
    rows = FX.images(spark, d).select("img", F.coalesce(F.array_max(F.transform("preds", lambda p: p["conf"])), F.lit(0.0)).alias("top"), F.posexplode(F.filter("preds", lambda p: p["conf"] >= 0.5)).alias("prediction_id", "p"))
    return rows.select("img", "prediction_id", "p.x0", "p.y0", "p.x1", "p.y1", F.col("p.conf").alias("confidence"), "top")


def det_candidates(spark, d):
    rows = FX.images(spark, d).select("img", "fold_id", F.posexplode("preds").alias("k", "p"))
    return rows.select(F.format_string("%d__b%03d", "img", "k").alias("candidate_id"), "fold_id", F.col("p.conf").alias("confidence"), ((F.col("p.x1") - F.col("p.x0")) * (F.col("p.y1") - F.col("p.y0"))).alias("area"))


def _strategy_hits(spark, d):
    """Per object, with its area: matched by model 0 alone, by model 1 alone, by both after union suppression."""
    images = FX.images(spark, d)
    for k in (0, 1):
        images = images.withColumn(f"m{k}", M.greedy_match(F.filter("preds", _of_model(k)), F.col("gts")))
    images = images.withColumn("m2", M.union_match(F.col("preds"), 0.5, F.col("gts")))
    rows = images.select("img", "fold_id", F.explode("gts").alias("g"), "m0", "m1", "m2")
    return rows.select("img", "fold_id", F.col("g.j").alias("gt_index"), ((F.col("g.x1") - F.col("g.x0")) * (F.col("g.y1") - F.col("g.y0"))).alias("area"), *[F.exists(f"m{k}", lambda m: m["j"].eqNullSafe(F.col("g.j"))).alias(f"s{k}") for k in range(3)])


def _of_model(k: int):
    return lambda p: p["model"] == k


def det_paired(spark, d):
    """Transitions of objects from strategy 0 to the others."""
    rows = _strategy_hits(spark, d)
    both = rows.select("s0", F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(f"s{k}").alias("after")) for k in (1, 2)])).alias("x"))
    return both.groupBy("x.strategy").agg(F.count_if(F.col("s0") & F.col("x.after")).alias("kept"), F.count_if(~F.col("s0") & F.col("x.after")).alias("rescued"), F.count_if(F.col("s0") & ~F.col("x.after")).alias("lost"), F.count_if(~F.col("s0") & ~F.col("x.after")).alias("missed"))


def det_rescue_overlap(spark, d):
    """Jaccard of the objects that two strategies rescue."""
    a, b = ~F.col("s0") & F.col("s1"), ~F.col("s0") & F.col("s2")
    out = _strategy_hits(spark, d).agg(F.count_if(a & b).alias("shared"), F.count_if(a | b).alias("either"), F.count_if(a & ~b).alias("only_1"), F.count_if(b & ~a).alias("only_2"))
    return out.withColumn("jaccard", F.round(ratio(F.col("shared"), F.col("either"), None), 9))


def det_winner_cells(spark, d):
    """Rate of each strategy per fold and image-size cell, with all strategies that tie for the best."""
    rows = _strategy_hits(spark, d).withColumn("cell", F.when(F.col("gt_index") < 2, "first").otherwise("later"))
    out = rows.groupBy("fold_id", "cell").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(f"s{k}").cast("double")), 6).alias(f"rate_{k}") for k in range(3)])
    best = F.greatest(*[f"rate_{k}" for k in range(3)])
    return out.withColumn("best", labels_that_hold({f"s{k}": F.abs(F.col(f"rate_{k}") - best) < 1e-9 for k in range(3)}, sep=";"))


def det_oracle_bound(spark, d):
    """Objects that any strategy finds."""
    any_ = F.col("s0") | F.col("s1") | F.col("s2")
    return _strategy_hits(spark, d).groupBy("fold_id").agg(F.count_if(any_).alias("tp"), F.count("*").alias("n")).withColumn("recall", F.round(ratio(F.col("tp"), F.col("n")), 9))


def fold_variation(spark, d):
    """Recall per fold at the report threshold, then mean, population deviation and range over folds."""
    per = X.object_outcomes(_matched(spark, d), REPORT).groupBy("fold_id").agg((F.count_if(F.col("status") == "TP") / F.count("*")).alias("recall"))
    return per.agg(F.round(F.avg("recall"), 9).alias("mean_recall"), F.round(F.stddev_pop("recall"), 9).alias("std_recall"), F.round(F.min("recall"), 9).alias("min_recall"), F.round(F.max("recall"), 9).alias("max_recall"))


def fold_subgroup_rollup(spark, d):
    """Counts per subgroup summed over folds, then divided."""
    rows = X.object_outcomes(_matched(spark, d), REPORT)
    flags = F.array(F.struct(F.lit("ALL").alias("name"), F.lit(True).alias("flag")), F.struct(F.lit("FIRST").alias("name"), (F.col("gt_index") == 0).alias("flag")), F.struct(F.lit("CROWDED").alias("name"), (F.col("gt_index") >= 4).alias("flag")))
    rows = rows.select("fold_id", "status", F.explode(F.filter(flags, lambda x: x["flag"])).alias("x"))
    per = rows.groupBy("fold_id", "x.name").agg(F.count_if(F.col("status") == "TP").alias("tp"), F.count("*").alias("n"))
    return per.groupBy(F.col("name").alias("subgroup")).agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("fold_id").cast("string"))), "|").alias("folds")).withColumn("recall", F.round(ratio(F.col("tp"), F.col("n")), 9))


def tile_grid(spark, d):
    sizes = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.lit(p).alias("patch"), F.lit(s).alias("stride")) for n, p, s in ((64, 24, 18), (64, 32, 24), (64, 64, 48), (20, 24, 18))])).alias("s")).select("s.*")
    out = sizes.withColumn("start", F.explode(F.expr("case when length <= patch then array(0) else array_distinct(concat(sequence(0, length - patch, stride), array(length - patch))) end")))
    return out.select("length", "patch", "start", (F.col("start") + F.least("patch", "length")).alias("end"))


def tile_coverage(spark, d):
    """Objects contained whole in, or cut by, tiles of two sizes, and in several tiles. Tiles are counted along each side, so an object stays one row."""
    each = []
    for patch, stride in ((24, 18), (32, 24)):
        (wx, mx, _), (wy, my, _) = tiles_along(F.col("x0"), F.col("x1"), patch, stride), tiles_along(F.col("y0"), F.col("y1"), patch, stride)
        each.append(F.struct(F.lit(patch).alias("patch"), (wx * wy).alias("whole"), (mx * my).alias("met")))
    per = FX.ground_truth(spark, d).select(F.explode(F.array(*each)).alias("t")).select("t.*").where("met > 0")
    return per.groupBy("patch").agg(F.count("*").alias("objects"), F.count_if(F.col("whole") > 0).alias("contained"), F.count_if(F.col("whole") == 0).alias("crossing"), F.count_if(F.col("whole") > 1).alias("duplicated"))


def consensus_boxes(spark, d):
    """Per image and true box: predictions that overlap it by half and agree with each other; median box of two or more."""
    rows = FX.images(spark, d).select("img", F.explode("gts").alias("g"), "preds")
    members = F.filter("preds", lambda p: iou(F.col("g"), p) >= 0.5)
    agree = F.filter(members, lambda p: F.size(F.filter(members, lambda q: (q["i"] != p["i"]) & (iou(p, q) >= 0.5))) > 0)
    rows = rows.select("img", F.col("g.j").alias("gt_index"), agree.alias("a")).where(F.size("a") >= 2)
    med = lambda c: _median(F.array_sort(F.transform("a", lambda p: p[c])))
    return rows.select("img", "gt_index", F.size("a").alias("members"), *[med(c).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round(med("conf"), 9).alias("conf"))


def _median(a):
    n = F.size(a)
    return (F.element_at(a, F.floor((n + 1) / 2).cast("int")) + F.element_at(a, F.floor(n / 2).cast("int") + 1)) / 2


def global_pairs(spark, d):
    """One-to-one pairs of the two models' boxes by falling overlap."""
    images = FX.images(spark, d)
    pairs = M.global_match(F.filter("preds", _of_model(0)), F.filter("preds", _of_model(1)), 0.5)
    rows = images.select("img", F.explode(pairs).alias("p"))
    return rows.select("img", F.col("p.ai").alias("a"), F.col("p.bi").alias("b"), F.round("p.iou", 9).alias("iou"))


def burden(spark, d):
    """Boxes per image in the band under the report threshold, images without any included."""
    per = FX.images(spark, d).select(F.size(F.filter("preds", lambda p: (p["conf"] >= 0.1) & (p["conf"] < REPORT))).alias("n"))
    return per.agg(F.round(F.avg("n"), 9).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.9)).alias("p90"), F.max("n").alias("max"), F.count_if(F.col("n") == 0).alias("zero"))


QUERIES = [det_sweep, det_sweep_alt_ties, det_object_outcomes, det_error_distribution, det_fp_types, det_ap50, det_map, det_nms, det_union_nms, det_fusion_grid, det_image_safety, det_safety_by_gt_count,
           det_single_object, det_routing, det_tradeoff, det_no_rematch, det_fn_mechanism, det_export, det_candidates, det_paired, det_rescue_overlap, det_winner_cells, det_oracle_bound, fold_variation,
           fold_subgroup_rollup, tile_grid, tile_coverage, consensus_boxes, global_pairs, burden]

_OUTCOMES = match_sql() + f""",
out_ AS (SELECT img, fold_id, g.j AS gt_index, list_filter(m, lambda x: x.j = g.j AND x.conf >= {REPORT})[1] AS hit,
  list_max(list_transform(preds, lambda p: struct_pack(iou := {iou_sql('g', 'p')}, conf := p.conf))) AS best FROM (SELECT *, unnest(gts) AS g FROM matched)),
outcomes AS (SELECT img, fold_id, gt_index, CASE WHEN hit IS NOT NULL THEN 'TP' ELSE 'FN' END AS status,
  CASE WHEN hit IS NOT NULL THEN 'MATCHED' WHEN best IS NULL THEN 'NO_DETECTION' WHEN best.iou >= 0.5 AND best.conf < {REPORT} THEN 'LOW_CONFIDENCE'
       WHEN best.conf >= {REPORT} AND best.iou >= 0.1 THEN 'LOCALIZATION_FAILURE' ELSE 'NO_DETECTION' END AS error_type,
  coalesce(hit.conf, best.conf) AS confidence, round(coalesce(hit.iou, best.iou), 9) AS iou FROM out_)"""
_SAFETY = match_sql(-1) + """,
per AS (SELECT img, n_gt, threshold_id, threshold, len(list_filter(m, lambda x: x.conf >= threshold AND x.j IS NOT NULL)) AS found FROM matched, {grid} WHERE n_gt > 0)
SELECT threshold_id, threshold{by}, count(*) AS images, count_if(found > 0)::BIGINT AS any_detected, count_if(found = n_gt)::BIGINT AS all_detected, count_if(found > 0 AND found < n_gt)::BIGINT AS partial,
 count_if(found = 0)::BIGINT AS zero_detected, sum(n_gt - found)::BIGINT AS missed FROM per {where} GROUP BY ALL"""


def _safety_sql(grid: list[float], by: str = "", where: str = "") -> str:
    return _SAFETY.replace("{grid}", grid_sql(grid)).replace("{by}", by).replace("{where}", where)


def _ap_sql(overlaps: list[float]) -> str:
    parts = []
    for k, t in enumerate(overlaps):
        parts.append(f"""SELECT {k} AS overlap_id, img, n_gt, m FROM ({match_sql(1, repr(t), order=-1)} SELECT img, n_gt, m FROM matched)""")
    return f"""WITH u AS ({' UNION ALL '.join(parts)}),
r AS (SELECT overlap_id, img, unnest(m) AS x FROM u), tot AS (SELECT overlap_id, sum(n_gt) AS n_gt FROM u GROUP BY 1),
k AS (SELECT overlap_id, sum(CASE WHEN x.j IS NOT NULL THEN 1 ELSE 0 END) OVER w AS tp, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY overlap_id ORDER BY x.conf DESC, img DESC, x.i DESC ROWS UNBOUNDED PRECEDING)),
q AS (SELECT overlap_id, CAST(floor(tp / n_gt::DOUBLE * 100 + 1e-9) AS INT) AS point, max(tp / n::DOUBLE) AS p FROM k JOIN tot USING (overlap_id) GROUP BY ALL),
z AS (SELECT DISTINCT overlap_id, i AS pos FROM tot, range(101) t(i)),
v AS (SELECT z.overlap_id, pos, coalesce(max(p), 0) AS p FROM z LEFT JOIN q ON q.overlap_id = z.overlap_id AND q.point >= z.pos GROUP BY ALL)
SELECT overlap_id, round(sum(p) / 101.0, 9) AS ap FROM v GROUP BY overlap_id"""


_NMS_FOLD = """list_reduce(preds, lambda acc, p: list_transform([coalesce(list_min(list_filter(list_transform(range(1, len(acc) + 1), lambda n: CASE WHEN {iou} >= {least} THEN n END), lambda n: n IS NOT NULL)), -1)],
  lambda pos: CASE WHEN pos < 0 THEN list_append(acc, struct_pack(i := p.i, conf := p.conf, model := p.model, x0 := p.x0, y0 := p.y0, x1 := p.x1, y1 := p.y1, models := [p.model], suppressed := 0))
  ELSE list_transform(range(1, len(acc) + 1), lambda n: struct_pack(i := acc[n].i, conf := acc[n].conf, model := acc[n].model, x0 := acc[n].x0, y0 := acc[n].y0, x1 := acc[n].x1, y1 := acc[n].y1,
     models := CASE WHEN n = pos THEN list_sort(list_distinct(list_append(acc[n].models, p.model))) ELSE acc[n].models END, suppressed := CASE WHEN n = pos THEN acc[n].suppressed + 1 ELSE acc[n].suppressed END)) END)[1],
  []::STRUCT(i INT, conf DOUBLE, model INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, models INT[], suppressed INT)[])"""


def _nms_sql(where: str, order: str, select: str) -> str:
    fold = _NMS_FOLD.format(iou=iou_sql("acc[n]", "p"), least="0.5")
    return f"""{FX.FX}, pl AS (SELECT img, list(struct_pack(i := pred_index, conf := conf, model := model, x0 := x0::DOUBLE, y0 := y0::DOUBLE, x1 := x1::DOUBLE, y1 := y1::DOUBLE) ORDER BY conf DESC, {order}) AS preds FROM fx_pred {where} GROUP BY img)
SELECT img, {select} FROM (SELECT img, unnest({fold}) AS k FROM pl)"""


ORACLES = {
    "det_sweep": sweep_sql(1),
    "det_sweep_alt_ties": sweep_sql(-1),
    "det_object_outcomes": _OUTCOMES + " SELECT * FROM outcomes",
    "det_error_distribution": _OUTCOMES + " SELECT coalesce(CAST(fold_id AS VARCHAR), 'ALL') AS scope, error_type, count(*) AS n FROM outcomes GROUP BY GROUPING SETS ((fold_id, error_type), (error_type))",
    "det_fp_types": match_sql() + f""", fp AS (SELECT img, fold_id, x.conf AS confidence, coalesce(list_max(list_transform(gts, lambda g: list_max(list_transform(list_filter(preds, lambda p: p.i = x.i), lambda p: {iou_sql('g', 'p')})))), 0.0) AS near
 FROM (SELECT *, unnest(m) AS x FROM matched) WHERE x.j IS NULL AND x.conf >= {REPORT})
SELECT fold_id, CASE WHEN near >= 0.5 THEN 'DUPLICATE_EXCESS' WHEN near >= 0.1 THEN 'LOCALIZATION_FALSE_POSITIVE' ELSE 'BACKGROUND_FALSE_POSITIVE' END AS fp_type, count(*) AS n, count(DISTINCT img) AS images, round(avg(confidence), 9) AS mean_confidence FROM fp GROUP BY ALL""",
    "det_ap50": "SELECT ap AS ap50 FROM (" + _ap_sql([0.5]) + ")",
    "det_map": _ap_sql(OVERLAPS),
    "det_nms": _nms_sql("WHERE model = 0", "pred_index", "k.i AS pred_index, k.suppressed AS suppressed"),
    "det_union_nms": _nms_sql("", "model, pred_index", "k.i AS pred_index, array_to_string(k.models, ';') AS models"),
    "det_image_safety": _safety_sql(STEPS),
    "det_safety_by_gt_count": _safety_sql(LOWS, ", n_gt::INT AS n_gt"),
    "det_single_object": _safety_sql(STEPS, where="WHERE n_gt = 1"),
    "det_routing": FX.FX + f""", t AS (SELECT coalesce(g.img, p.img) AS img, coalesce(n_gt, 0) AS n_gt, coalesce(top, -1.0) AS top, coalesce(c, []) AS c FROM (SELECT img, count(*) AS n_gt FROM fx_gt GROUP BY 1) g FULL JOIN (SELECT img, max(conf) AS top, list(conf) AS c FROM fx_pred GROUP BY 1) p ON g.img = p.img)
SELECT threshold_id, low, CASE WHEN top >= {HIGH} THEN 'DETECT' WHEN top >= low THEN 'REINSPECT' ELSE 'PASS' END AS route, count(*) AS images, sum(n_gt)::BIGINT AS objects, sum(len(list_filter(c, lambda x: x >= low AND x < {HIGH})))::BIGINT AS band_candidates, count_if(n_gt > 0)::BIGINT AS images_with_gt FROM t, {grid_sql(LOWS, 'low')} GROUP BY ALL""",
    "det_tradeoff": f"""WITH s AS ({sweep_sql(1)}), b AS (SELECT tp AS tp0, fp AS fp0 FROM s WHERE threshold_id = 9)
SELECT threshold_id, tp - tp0 AS recovered, fp - fp0 AS added_fp, round(CASE WHEN tp - tp0 = 0 THEN NULL ELSE (fp - fp0) / (tp - tp0)::DOUBLE END, 9) AS fp_per_recovered FROM s, b""",
    "det_no_rematch": match_sql() + f""", o AS (SELECT list_filter(m, lambda x: x.j = g.j)[1] AS hit FROM (SELECT *, unnest(gts) AS g FROM matched))
SELECT threshold_id, threshold, count_if(hit IS NOT NULL AND hit.conf >= threshold)::BIGINT AS tp, count_if(NOT (hit IS NOT NULL AND hit.conf >= threshold))::BIGINT AS fn, count(*) AS n, round(count_if(hit IS NOT NULL AND hit.conf >= threshold) / count(*)::DOUBLE, 9) AS recall FROM o, {grid_sql(STEPS)} GROUP BY ALL""",
    "det_fn_mechanism": _OUTCOMES + f" SELECT CASE WHEN coalesce(confidence, -1) >= {REPORT} THEN 'CONF_OK' ELSE 'CONF_LOW' END AS confidence_side, CASE WHEN coalesce(iou, 0) >= 0.5 THEN 'IOU_OK' ELSE 'IOU_LOW' END AS overlap_side, count(*) AS n FROM outcomes WHERE status = 'FN' GROUP BY ALL",
    "det_export": FX.FX + " SELECT img, CAST(row_number() OVER (PARTITION BY img ORDER BY pred_index) - 1 AS INT) AS prediction_id, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, conf AS confidence, top FROM (SELECT *, max(conf) OVER (PARTITION BY img) AS top FROM fx_pred) WHERE conf >= 0.5",
    "det_candidates": FX.FX + " SELECT format('{}__b{:03d}', img, pred_index) AS candidate_id, fold_id, conf AS confidence, ((x1 - x0) * (y1 - y0))::DOUBLE AS area FROM fx_pred",
    "fold_variation": _OUTCOMES + ", f AS (SELECT fold_id, count_if(status = 'TP') / count(*)::DOUBLE AS recall FROM outcomes GROUP BY 1) SELECT round(avg(recall), 9) AS mean_recall, round(stddev_pop(recall), 9) AS std_recall, round(min(recall), 9) AS min_recall, round(max(recall), 9) AS max_recall FROM f",
    "fold_subgroup_rollup": _OUTCOMES + """, g AS (SELECT 'ALL' AS subgroup, * FROM outcomes UNION ALL SELECT 'FIRST', * FROM outcomes WHERE gt_index = 0 UNION ALL SELECT 'CROWDED', * FROM outcomes WHERE gt_index >= 4)
SELECT subgroup, count_if(status = 'TP')::BIGINT AS tp, count(*) AS n, array_to_string(list_sort(list(DISTINCT CAST(fold_id AS VARCHAR))), '|') AS folds, round(count_if(status = 'TP') / count(*)::DOUBLE, 9) AS recall FROM g GROUP BY subgroup""",
    "tile_grid": """WITH s(length, patch, stride) AS (VALUES (64, 24, 18), (64, 32, 24), (64, 64, 48), (20, 24, 18)),
t AS (SELECT length, patch, unnest(CASE WHEN length <= patch THEN [0] ELSE list_distinct(list_concat(range(0, length - patch + 1, stride), [length - patch])) END) AS start FROM s)
SELECT length, patch, start::INT AS start, (start + least(patch, length))::INT AS "end" FROM t""",
    "tile_coverage": FX.FX + """, s(patch, stride) AS (VALUES (24, 18), (32, 24)), a AS (SELECT patch, unnest(list_distinct(list_concat(range(0, 64 - patch + 1, stride), [64 - patch]))) AS at FROM s),
t AS (SELECT a.patch, a.at AS x, b.at AS y FROM a JOIN a b ON a.patch = b.patch),
p AS (SELECT img, gt_index, patch, count_if(x0 >= x AND y0 >= y AND x1 <= x + patch AND y1 <= y + patch) AS whole, count_if(NOT (x0 >= x AND y0 >= y AND x1 <= x + patch AND y1 <= y + patch)) AS cut
 FROM fx_gt, t WHERE x0 < x + patch AND x1 > x AND y0 < y + patch AND y1 > y GROUP BY ALL)
SELECT patch, count(*) AS objects, count_if(whole > 0)::BIGINT AS contained, count_if(whole = 0 AND cut > 0)::BIGINT AS crossing, count_if(whole > 1)::BIGINT AS duplicated FROM p GROUP BY patch""",
    "burden": FX.FX + f", i AS (SELECT DISTINCT img FROM fx_obj), n AS (SELECT i.img, count_if(conf >= 0.1 AND conf < {REPORT})::INT AS n FROM i LEFT JOIN fx_pred p ON p.img = i.img GROUP BY i.img) SELECT round(avg(n), 9) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median, quantile_cont(n, 0.9)::DOUBLE AS p90, max(n) AS max, count_if(n = 0)::BIGINT AS zero FROM n",
    "consensus_boxes": FX.FX + f""", c AS (SELECT g.img, g.gt_index, p.pred_index, p.x0, p.y0, p.x1, p.y1, p.conf FROM fx_gt g JOIN fx_pred p ON g.img = p.img WHERE {iou_sql('g', 'p')} >= 0.5),
a AS (SELECT DISTINCT c.* FROM c JOIN c d ON c.img = d.img AND c.gt_index = d.gt_index AND c.pred_index <> d.pred_index WHERE {iou_sql('c', 'd')} >= 0.5)
SELECT img, gt_index, count(*)::INT AS members, quantile_cont(x0, 0.5)::DOUBLE AS x0, quantile_cont(y0, 0.5)::DOUBLE AS y0, quantile_cont(x1, 0.5)::DOUBLE AS x1, quantile_cont(y1, 0.5)::DOUBLE AS y1, round(quantile_cont(conf, 0.5), 9) AS conf FROM a GROUP BY ALL HAVING count(*) >= 2""",
}


def _strategies_sql(tail: str) -> str:
    """CTE hits(img, fold_id, gt_index, s0, s1, s2)."""
    def one(k: int) -> str:
        if k < 2:
            return f"({match_sql(where=f'WHERE model = {k}')} SELECT img, unnest(list_filter(list_transform(m, lambda x: x.j), lambda j: j IS NOT NULL)) AS j FROM matched)"
        fold = _NMS_FOLD.format(iou=iou_sql("acc[n]", "p"), least="0.5")
        kept = f"(SELECT img, unnest({fold}) AS k FROM (SELECT img, list(struct_pack(i := pred_index, conf := conf, model := model, x0 := x0::DOUBLE, y0 := y0::DOUBLE, x1 := x1::DOUBLE, y1 := y1::DOUBLE) ORDER BY conf DESC, model, pred_index) AS preds FROM fx_pred0 GROUP BY img))"
        text = match_sql().replace("fx_pred AS (", "fx_pred0 AS (")
        return "(" + text.replace(",\ngl AS", f",\nfx_pred AS (SELECT z.* FROM fx_pred0 z JOIN {kept} k ON z.img = k.img AND z.pred_index = k.k.i),\ngl AS", 1) + " SELECT img, unnest(list_filter(list_transform(m, lambda x: x.j), lambda j: j IS NOT NULL)) AS j FROM matched)"

    return f"""{FX.FX}, h0 AS {one(0)}, h1 AS {one(1)}, h2 AS {one(2)},
hits AS (SELECT g.img, g.fold_id, g.gt_index, h0.j IS NOT NULL AS s0, h1.j IS NOT NULL AS s1, h2.j IS NOT NULL AS s2 FROM fx_gt g LEFT JOIN h0 ON g.img = h0.img AND g.gt_index = h0.j LEFT JOIN h1 ON g.img = h1.img AND g.gt_index = h1.j LEFT JOIN h2 ON g.img = h2.img AND g.gt_index = h2.j)
{tail}"""


ORACLES |= {
    "det_paired": _strategies_sql("""SELECT k AS strategy, count_if(s0 AND a)::BIGINT AS kept, count_if(NOT s0 AND a)::BIGINT AS rescued, count_if(s0 AND NOT a)::BIGINT AS lost, count_if(NOT s0 AND NOT a)::BIGINT AS missed FROM (SELECT 1 AS k, s0, s1 AS a FROM hits UNION ALL SELECT 2, s0, s2 FROM hits) GROUP BY k"""),
    "det_rescue_overlap": _strategies_sql("""SELECT shared, either, only_1, only_2, round(CASE WHEN either = 0 THEN NULL ELSE shared / either::DOUBLE END, 9) AS jaccard FROM (SELECT count_if(NOT s0 AND s1 AND s2)::BIGINT AS shared, count_if(NOT s0 AND (s1 OR s2))::BIGINT AS either, count_if(NOT s0 AND s1 AND NOT s2)::BIGINT AS only_1, count_if(NOT s0 AND s2 AND NOT s1)::BIGINT AS only_2 FROM hits)"""),
    "det_oracle_bound": _strategies_sql("SELECT fold_id, count_if(s0 OR s1 OR s2)::BIGINT AS tp, count(*) AS n, round(count_if(s0 OR s1 OR s2) / count(*)::DOUBLE, 9) AS recall FROM hits GROUP BY fold_id"),
    "det_winner_cells": _strategies_sql("""SELECT *, array_to_string(list_filter([CASE WHEN abs(rate_0 - greatest(rate_0, rate_1, rate_2)) < 1e-9 THEN 's0' END, CASE WHEN abs(rate_1 - greatest(rate_0, rate_1, rate_2)) < 1e-9 THEN 's1' END, CASE WHEN abs(rate_2 - greatest(rate_0, rate_1, rate_2)) < 1e-9 THEN 's2' END], lambda x: x IS NOT NULL), ';') AS best FROM (
 SELECT fold_id, CASE WHEN gt_index < 2 THEN 'first' ELSE 'later' END AS cell, count(*) AS n, round(avg(s0::INT), 6) AS rate_0, round(avg(s1::INT), 6) AS rate_1, round(avg(s2::INT), 6) AS rate_2 FROM hits GROUP BY ALL)"""),
}
