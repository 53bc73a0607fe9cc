"""Further reference operators over the derived tables: geometry, bins, tiles, policies, routing signals, bootstraps, audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions.exprs import close, iou, labels_that_hold, ratio
from veristrata.operators import matching as M
from veristrata.operators import metrics as X
from veristrata.operators import resample as R
from veristrata.operators import stats as S
from veristrata.operators import windows as N
from veristrata.operators.groups import _written
from veristrata.operators.selection import best_epoch, gated_choice
from veristrata.plans import fixtures as FX
from veristrata.plans.detection import _NMS_FOLD, _OUTCOMES, _RATIOS, HIGH, REPORT, STEPS, _matched, iou_sql, match_sql, sweep_sql
from veristrata.plans.fixtures import read


def geometry_columns(spark, d):
    """Sizes, centres and edge distances of boxes on a 64 by 64 canvas, and their sides after scaling to three targets."""
    g = FX.ground_truth(spark, d)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    g = g.select("img", "gt_index", w.alias("w"), h.alias("h"), (w * h).alias("area"), F.round(w / h, 9).alias("aspect"), F.least(w, h).alias("min_side"), ((F.col("x0") + F.col("x1")) / 128.0).alias("cx"), F.least("x0", "y0", 64 - F.col("x1"), 64 - F.col("y1")).alias("edge"))
    return g.withColumn("target", F.explode(F.array(*[F.lit(t) for t in (32, 64, 128)]))).withColumn("scaled", F.col("min_side") * (F.col("target") / 64.0)).withColumn("below_8", F.col("scaled") < 8)


def box_transforms(spark, d):
    """Clip, expand about the centre, horizontal flip and its inverse, distance of the centre from the image's centre."""
    g = FX.ground_truth(spark, d)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    out = g.select("img", "gt_index", F.greatest(F.lit(0), F.least(F.lit(50), "x0")).alias("clip_x0"), F.floor(cx - (F.col("x1") - F.col("x0")) * 0.75).cast("long").alias("grown_x0"), F.ceil(cx + (F.col("x1") - F.col("x0")) * 0.75).cast("long").alias("grown_x1"),
                   (64 - F.col("x1")).alias("flip_x0"), (64 - F.col("x0")).alias("flip_x1"), F.round(F.hypot(cx - 32, cy - 32), 9).alias("from_centre"))
    return out.withColumn("back_x0", 64 - F.col("flip_x1"))


def candidate_geometry(spark, d):
    """Model 0 candidates against model 1 boxes of the image: overlap, containment of centres, distance in diagonals, area ratio."""
    p = FX.predictions(spark, d)
    a = p.where("model = 0").select("img", F.col("pred_index").alias("a"), F.struct("x0", "y0", "x1", "y1").alias("p"))
    b = p.where("model = 1").select("img", F.col("pred_index").alias("b"), F.struct("x0", "y0", "x1", "y1").alias("q"))
    c = lambda s: ((F.col(f"{s}.x0") + F.col(f"{s}.x1")) / 2, (F.col(f"{s}.y0") + F.col(f"{s}.y1")) / 2)
    px, py = c("p")
    qx, qy = c("q")
    j = a.join(b, "img")
    inside = (qx >= F.col("p.x0")) & (qx <= F.col("p.x1")) & (qy >= F.col("p.y0")) & (qy <= F.col("p.y1"))
    size = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    return j.where(inside).select("img", "a", "b", F.round(iou(F.col("p"), F.col("q")), 9).alias("iou"), F.round(F.hypot(px - qx, py - qy) / F.hypot(F.col("p.x1") - F.col("p.x0"), F.col("p.y1") - F.col("p.y0")), 9).alias("distance"), F.round(size("q") / size("p"), 9).alias("area_ratio"))


def nearest_candidate(spark, d):
    """For each object the prediction with the largest (overlap, confidence, -index)."""
    rows = FX.images(spark, d).select("img", F.explode("gts").alias("g"), "preds")
    best = F.array_max(F.transform("preds", lambda p: F.struct(iou(F.col("g"), p).alias("iou"), p["conf"].alias("conf"), (-p["i"]).alias("i"))))
    return rows.select("img", F.col("g.j").alias("gt_index"), best.alias("b")).select("img", "gt_index", (-F.col("b.i")).alias("pred_index"), F.round("b.iou", 9).alias("iou"), F.col("b.conf").alias("conf"))


def strategy_chain(spark, d):
    """Four strategies of one key joined one to one, with the number of different outcomes."""
    images = _matched(spark, d).where("img is not null").select("match", F.explode("gts").alias("g"))
    hit = F.get(F.filter("match", lambda m: m["j"] == F.col("g.j")), F.lit(0))["conf"]  # one matching at the floor serves all of them
    s = images.select(hit.alias("conf")).select(*[F.when(F.col("conf") >= cut, "TP").otherwise("FN").alias(name) for name, cut in (("base", REPORT), ("strict", 0.5), ("loose", 0.1), ("floor", 0.0))])
    return s.groupBy(F.size(F.array_distinct(F.array("base", "strict", "loose", "floor"))).alias("outcomes"), "base").agg(F.count("*").alias("n"))


def quintile_bins(spark, d):
    """Five bins by the first boundary that is at least the value."""
    o = read(spark, d, "orders").select("o_totalprice")
    cuts = S.quantile_cuts(o, "o_totalprice", [0.2, 0.4, 0.6, 0.8])
    return o.crossJoin(F.broadcast(cuts)).groupBy((F.size(F.filter("cuts", lambda c: F.col("o_totalprice") > c)) + 1).alias("quintile")).agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 2).alias("lo"))


def factor_table(spark, d):
    """Miss rates of quartile bins of a factor, with the bins of highest and lowest risk."""
    rows = X.object_outcomes(_matched(spark, d), REPORT, "area").where("img is not null").groupBy("area", "status", "fold_id").agg(F.count("*").alias("many"))
    rows = _written(rows)  # a row for each area, outcome and fold
    cuts = S.quantile_cuts(rows, "area", [0.25, 0.5, 0.75], "many")
    per = rows.crossJoin(F.broadcast(cuts)).groupBy(F.size(F.filter("cuts", lambda c: F.col("area") > c)).alias("bin")).agg(F.sum("many").alias("n"), F.sum(F.when(F.col("status") == "FN", F.col("many")).otherwise(0)).alias("misses"), F.min("area").alias("lo"), F.max("area").alias("hi"), F.count_distinct("fold_id").alias("folds"))
    per = per.withColumn("rate", F.round(ratio(F.col("misses"), F.col("n")), 9))
    top = per.agg(F.max_by("bin", F.struct("rate", "n", -F.col("bin"))).alias("high"), F.min_by("bin", F.struct("rate", -F.col("n"), F.col("bin"))).alias("low"))
    return per.crossJoin(F.broadcast(top)).withColumn("role", F.when(F.col("bin") == F.col("high"), "HIGH").when(F.col("bin") == F.col("low"), "LOW").otherwise("")).drop("high", "low")


def outcome_quantiles(spark, d):
    """Quartiles of confidence by error type."""
    rows = X.object_outcomes(_matched(spark, d), REPORT).where("confidence is not null")
    return rows.groupBy("error_type").agg(F.count("*").alias("n"), *[F.round(S.quantile("confidence", q), 9).alias(n) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))])


def worst_patterns(spark, d):
    """The four (fold, error type) groups with the most misses, with a priority by size."""
    per = X.object_outcomes(_matched(spark, d), REPORT).where("status = 'FN'").groupBy("fold_id", "error_type").agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("n"), "fold_id", "error_type").limit(4).withColumn("priority", F.when(F.col("n") >= 20, "HIGH").otherwise("LOW"))


def fp_concentration(spark, d):
    """Unmatched predictions per image over all images of a fold, images without any included."""
    images = _matched(spark, d)
    per = images.select("fold_id", F.size(F.filter("match", lambda m: m["j"].isNull() & (m["conf"] >= REPORT))).alias("fp"))
    return per.groupBy("fold_id").agg(F.count("*").alias("images"), F.sum("fp").alias("fp"), F.count_if(F.col("fp") > 0).alias("with_fp"), F.round(F.sum("fp") / F.count("*"), 9).alias("per_image"))


def gt_count_distribution(spark, d):
    return FX.images(spark, d).groupBy(F.size("gts").alias("n_gt")).agg(F.count("*").alias("images"))


def tile_labels(spark, d):
    """Objects in tiles of 32 with stride 24: local corners, retained share, and whether they are whole."""
    g = FX.ground_truth(spark, d).select("img", "gt_index", "x0", "y0", "x1", "y1", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 24, 32) for y in (0, 24, 32)])).alias("t"))
    cx0, cy0 = F.greatest("x0", "t.x"), F.greatest("y0", "t.y")
    cx1, cy1 = F.least(F.col("x1"), F.col("t.x") + 32), F.least(F.col("y1"), F.col("t.y") + 32)
    kept = (cx1 - cx0) * (cy1 - cy0) / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return g.where((cx1 > cx0) & (cy1 > cy0)).select("img", "gt_index", F.col("t.x").alias("tx"), F.col("t.y").alias("ty"), (cx0 - F.col("t.x")).alias("lx0"), (cy1 - F.col("t.y")).alias("ly1"), F.round(kept, 9).alias("retained"), (kept >= 1).alias("whole"))


def refine_policy(spark, d):
    """Model 0 candidates confirmed, refined or both by their best model 1 box."""
    rows = FX.images(spark, d).select("img", F.explode(F.filter("preds", lambda p: p["model"] == 0)).alias("p"), F.filter("preds", lambda q: q["model"] == 1).alias("local"))
    best = F.array_max(F.transform("local", lambda q: F.struct(iou(F.col("p"), q).alias("iou"), q["conf"].alias("conf"))))
    rows = rows.withColumn("b", best)
    hit = F.coalesce(F.col("b.iou") >= 0.3, F.lit(False))
    stronger = F.coalesce(F.col("b.conf") > F.col("p.conf"), F.lit(False))
    return rows.groupBy(F.when(hit & stronger, "BOTH").when(hit, "CONFIRM").when(F.col("b").isNull(), "NO_LOCAL").otherwise("KEEP").alias("action")).agg(F.count("*").alias("n"), F.round(F.avg("p.conf"), 9).alias("mean_conf"))


def rescue_trajectory(spark, d):
    """Status of each object at falling thresholds: first one that finds it, and whether the next agrees."""
    hit = lambda c: F.exists("match", lambda m: m["j"].eqNullSafe(F.col("g.j")) & (m["conf"] >= c))
    rows = _matched(spark, d).select("match", F.explode("gts").alias("g"))
    rows = rows.select(*[hit(c).alias(f"at_{k}") for k, c in enumerate((0.5, 0.25, 0.1))])
    first = F.when(F.col("at_0"), 0).when(F.col("at_1"), 1).when(F.col("at_2"), 2)
    stable = (F.col("at_0") == F.col("at_1")) & (F.col("at_1") == F.col("at_2"))
    return rows.groupBy(first.alias("first"), stable.alias("stable")).agg(F.count("*").alias("n"))


def routing_burden(spark, d):
    """Share of misses that lie in the riskiest images, by signal and budget."""
    per = _matched(spark, d).select("img", (F.size("gts") - F.size(F.filter("match", lambda m: m["j"].isNotNull() & (m["conf"] >= REPORT)))).alias("missed"), F.size("preds").cast("double").alias("count"), F.coalesce(1 - F.array_max(F.transform("preds", lambda p: p["conf"])), F.lit(1.0)).alias("doubt"))
    long = per.select("img", "missed", F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("v")) for n in ("count", "doubt")])).alias("s")).select("img", "missed", "s.*")
    ranked = N.numbered(long, ["signal"], [F.desc("v"), F.asc("img")], "r", "n")
    out = X.grid(ranked, [0.1, 0.2, 0.4], "budget")
    return out.groupBy("signal", "budget").agg(F.sum(F.when(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("budget"))), F.col("missed")).otherwise(0)).alias("covered"), F.sum("missed").alias("missed"))


def composite_risk(spark, d):
    """Mean of two rank scores and a piecewise confidence risk, per image."""
    per = FX.images(spark, d).select("img", F.size("preds").alias("count"), F.array_max(F.transform("preds", lambda p: p["conf"])).alias("top"))
    out = N.numbered(N.numbered(per, [], [F.desc("count"), F.asc("img")], "c", "n"), [], [F.asc_nulls_last("top"), F.asc("img")], "t", "_all")
    out = out.select("*", *[(1 - (F.col(c) - 1) / F.greatest(F.lit(1), F.col("n") - 1)).alias(r) for c, r in (("c", "r1"), ("t", "r2"))])
    piece = F.when(F.col("top").isNull() | (F.col("top") < 0.25), 1.0).when(F.col("top") < HIGH, 0.5).otherwise(0.0)
    return out.select("img", F.round((F.col("r1") + F.col("r2")) / 2, 9).alias("mean_rank"), F.greatest(piece, F.when(F.col("count") > 8, 0.75).otherwise(0.0)).alias("rule"))


def instability(spark, d):
    """Model 0 boxes against model 1 boxes paired one to one: unmatched ones count as overlap 0 and confidence 0."""
    images = FX.images(spark, d)
    pairs = M.global_match(F.filter("preds", lambda p: p["model"] == 0), F.filter("preds", lambda p: p["model"] == 1), 0.0)
    rows = images.select("img", "preds", pairs.alias("pairs"), F.explode(F.filter("preds", lambda p: p["model"] == 0)).alias("p"))
    pair = F.try_element_at(F.filter("pairs", lambda q: q["ai"] == F.col("p.i")), F.lit(1))
    rows = rows.select("img", F.col("p.conf").alias("conf"), pair.alias("q"), "preds")
    other = F.try_element_at(F.filter("preds", lambda r: r["i"] == F.col("q.bi")), F.lit(1))
    rows = rows.select("img", "conf", F.coalesce("q.iou", F.lit(0.0)).alias("iou"), F.coalesce(other["conf"], F.lit(0.0)).alias("conf2"))
    return rows.groupBy((F.col("img") % 10).alias("shard")).agg(F.count("*").alias("n"), F.count_if(F.col("iou") == 0).alias("unmatched"), F.round(F.avg("iou"), 6).alias("mean_iou"), F.round(F.avg(F.abs(F.col("conf") - F.col("conf2"))), 6).alias("mean_shift"))


def detect_reinspect_grid(spark, d):
    """Images by route for all pairs of two thresholds on the largest confidence."""
    top = FX.images(spark, d).select(F.coalesce(F.array_max(F.transform("preds", lambda p: p["conf"])), F.lit(-1.0)).alias("top"))
    g = F.explode(F.array(*[F.struct(F.lit(h).alias("high"), F.lit(lo).alias("low")) for h in (0.4, 0.45, 0.5) for lo in (0.1, 0.2, 0.25)]))
    rows = top.withColumn("g", g)
    return rows.groupBy("g.high", "g.low").agg(F.count_if(F.col("top") >= F.col("g.high")).alias("detect"), F.count_if((F.col("top") < F.col("g.high")) & (F.col("top") >= F.col("g.low"))).alias("reinspect"), F.count_if(F.col("top") < F.col("g.low")).alias("passed"))


def policy_invariance(spark, d):
    """Objects whose floor match changes between the two tie rules, and whether confidences agree within tolerance."""
    a = _matched(spark, d).select("img", F.explode("match").alias("m")).select("img", F.col("m.i").alias("i"), F.col("m.j").alias("ja"), F.col("m.iou").alias("ua"))
    b = _matched(spark, d, high_index_wins=False).select("img", F.explode("match").alias("m")).select("img", F.col("m.i").alias("i"), F.col("m.j").alias("jb"), F.col("m.iou").alias("ub"))
    j = a.join(b, ["img", "i"])
    return j.agg(F.count("*").alias("rows"), F.count_if(~F.col("ja").eqNullSafe(F.col("jb"))).alias("changed"), F.count_if(F.coalesce(close(F.col("ua"), F.col("ub")), F.lit(True))).alias("same_overlap"))


def best_configuration(spark, d):
    """The sweep row with the best F1, then recall, then lowest threshold; a fitness of precision and recall beside it."""
    s = X.sweep(_matched(spark, d), STEPS)
    best = s.agg(F.max_by(F.struct("threshold_id", "f1", "recall", "precision"), F.struct("f1", "recall", -F.col("threshold_id"))).alias("b"))
    return best.select("b.threshold_id", "b.f1", "b.recall", F.round(0.1 * F.col("b.precision") + 0.9 * F.col("b.recall"), 9).alias("fitness"))


def budget_reaches(spark, d):
    """The smallest threshold step at which precision reaches each goal."""
    s = X.sweep(_matched(spark, d), STEPS)
    goals = F.explode(F.array(*[F.lit(x) for x in (0.3, 0.36, 0.4)]))
    return s.withColumn("goal", goals).groupBy("goal").agg(F.min(F.when(F.col("precision") >= F.col("goal"), F.col("threshold_id"))).alias("first_step"))


def case_table(spark, d):
    """Misses with all conditions that hold for them, joined."""
    rows = X.object_outcomes(_matched(spark, d), REPORT).where("status = 'FN'")
    label = labels_that_hold({"FIRST": F.col("gt_index") == 0, "WEAK": F.coalesce(F.col("confidence") < 0.1, F.lit(False)), "FAR": F.coalesce(F.col("iou") < 0.1, F.lit(False))}, "OTHER")
    return rows.groupBy(label.alias("conditions")).agg(F.count("*").alias("n"))


def duplicate_collapse(spark, d):
    """One row per text: least id, how many sources, the other ids joined."""
    doc = read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"), F.count_distinct("source").alias("sources"))
    return doc.where(F.size("ids") > 1).select("sha", F.element_at("ids", 1).alias("canonical"), "sources", F.array_join(F.transform(F.slice("ids", F.lit(2), F.size("ids")), lambda x: x.cast("string")), ";").alias("others"))


def bootstrap_gap(spark, d):
    """Interval of the difference in miss rates of two bins over resampled clusters; replicates with an empty bin are left out."""
    rows = X.object_outcomes(_matched(spark, d), REPORT)
    per = rows.groupBy((F.col("img") % 60).alias("cluster")).agg(*[f.alias(n) for n, f in (("ha", F.count_if((F.col("gt_index") > 1) & (F.col("status") == "FN"))), ("hn", F.count_if(F.col("gt_index") > 1)), ("la", F.count_if((F.col("gt_index") <= 1) & (F.col("status") == "FN"))), ("ln", F.count_if(F.col("gt_index") <= 1)))])
    draws = spark.range(100 * 60).select(F.floor(F.col("id") / 60).alias("rep"), R.draw(F.floor(F.col("id") / 60), F.col("id") % 60, 60).alias("cluster"))
    per = draws.join(per, "cluster").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("ha", "hn", "la", "ln")]).where("hn > 0 and ln > 0").select((F.col("ha") / F.col("hn") - F.col("la") / F.col("ln")).alias("gap"))
    return per.agg(F.count("*").alias("replicates"), F.round(F.percentile("gap", F.lit(0.025)), 9).alias("low"), F.round(F.percentile("gap", F.lit(0.975)), 9).alias("high"))


def bootstrap_median(spark, d):
    """Interval of the median confidence over resampled clusters: values are weighted by how often their cluster is drawn."""
    rows = X.object_outcomes(_matched(spark, d), REPORT).where("confidence is not null").groupBy((F.col("img") % 60).alias("cluster"), "confidence").agg(F.count("*").alias("n"))
    draws = spark.range(40 * 60).select(F.floor(F.col("id") / 60).alias("rep"), R.draw(F.floor(F.col("id") / 60), F.col("id") % 60, 60).alias("cluster")).groupBy("rep", "cluster").agg(F.count("*").alias("times"))
    per = draws.join(rows, "cluster").groupBy("rep").agg(F.percentile("confidence", F.lit(0.5), F.col("times") * F.col("n")).alias("m"))
    return per.agg(F.round(F.percentile("m", F.lit(0.025)), 9).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 9).alias("high"))


def stable_shift(spark, d):
    """Two representations of one feature: median absolute difference, bias and rank correlation."""
    li = read(spark, d, "lineitem").select(F.lit(1).alias("g"), F.col("l_extendedprice").cast("double").alias("a"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("b"))
    r = S.average_rank(S.average_rank(li, ["g"], "a", "ra"), ["g"], "b", "rb")
    return r.agg(F.round(F.percentile(F.abs(F.col("a") - F.col("b")), F.lit(0.5)), 6).alias("median_abs"), F.round(F.avg(F.col("b") - F.col("a")), 4).alias("bias"), F.round(S.safe_corr(F.col("ra"), F.col("rb")), 6).alias("spearman"))


def scheme_selection(spark, d):
    """The largest number of folds up to 4 whose shares are even and whose (fold, priority) cells are all filled."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderpriority", F.explode(F.array(F.lit(3), F.lit(4), F.lit(5))).alias("folds"))
    cells = o.groupBy("folds", (F.col("o_custkey") % F.col("folds")).alias("fold"), "o_orderpriority").agg(F.count("*").alias("n"))
    shares = cells.groupBy("folds", "fold").agg(F.sum("n").alias("n"), F.count("*").alias("cells"))
    total = F.sum("n").over(W.partitionBy("folds"))
    per = shares.withColumn("off", F.abs(F.col("n") / total - 1 / F.col("folds"))).groupBy("folds").agg(F.max("off").alias("off"), F.min("cells").alias("cells"))
    return gated_choice(per, [F.col("off") <= 0.02, F.col("cells") == 5, F.col("folds") <= 4], [-F.col("folds")], "folds", 3)


def fitness_by_step(spark, d):
    """The sweep step with the best fitness of precision (as AP50) and recall (as mAP)."""
    return best_epoch(X.sweep(_matched(spark, d), STEPS), "precision", "recall", "threshold_id")


QUERIES = [scheme_selection, fitness_by_step, geometry_columns, box_transforms, candidate_geometry, nearest_candidate, strategy_chain, quintile_bins, factor_table, outcome_quantiles, worst_patterns, fp_concentration, gt_count_distribution, tile_labels,
           refine_policy, rescue_trajectory, routing_burden, composite_risk, instability, detect_reinspect_grid, policy_invariance, best_configuration, budget_reaches, case_table, duplicate_collapse, bootstrap_gap, bootstrap_median, stable_shift]

_TOP = FX.FX + ", i AS (SELECT DISTINCT img FROM fx_obj), t AS (SELECT i.img, count(p.conf) AS cnt, max(p.conf) AS top FROM i LEFT JOIN fx_pred p ON p.img = i.img GROUP BY i.img)"
_DRAW = f"(({R.LCG_A} * (({R.LCG_A} * ((i // 60 * 7919 + i % 60 * 104729 + 7) % {R.LCG_M}) + {R.LCG_C}) % {R.LCG_M}) + {R.LCG_C}) % {R.LCG_M}) % 60"
_STATUS = lambda c: f"CASE WHEN len(list_filter(m, lambda x: x.j = g.j AND x.conf >= {c})) > 0 THEN 'TP' ELSE 'FN' END"

ORACLES = {
    "scheme_selection": "WITH c AS (SELECT folds, o_custkey % folds AS fold, o_orderpriority, count(*) AS n FROM orders, (VALUES (3), (4), (5)) k(folds) GROUP BY ALL), s AS (SELECT folds, fold, sum(n) AS n, count(*) AS cells FROM c GROUP BY ALL), p AS (SELECT folds, abs(n / sum(n) OVER (PARTITION BY folds) - 1 / folds::DOUBLE) AS off, cells FROM s), q AS (SELECT folds, max(off) AS off, min(cells) AS cells FROM p GROUP BY folds) SELECT coalesce(max(folds) FILTER (WHERE off <= 0.02 AND cells = 5 AND folds <= 4), 3)::INT AS folds, count_if(off <= 0.02 AND cells = 5 AND folds <= 4)::BIGINT AS qualifying FROM q",
    "fitness_by_step": f"WITH s AS ({sweep_sql(1)}) SELECT threshold_id AS epoch, round(0.1::DOUBLE * precision + 0.9::DOUBLE * recall, 9) AS fitness FROM s ORDER BY fitness DESC, threshold_id LIMIT 1",
    "geometry_columns": FX.FX + """, b AS (SELECT img, gt_index, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) AS area, round((x1 - x0) / (y1 - y0)::DOUBLE, 9) AS aspect, least(x1 - x0, y1 - y0) AS min_side, (x0 + x1) / 128.0::DOUBLE AS cx, least(x0, y0, 64 - x1, 64 - y1) AS edge FROM fx_gt)
SELECT *, min_side * (target / 64.0::DOUBLE) AS scaled, min_side * (target / 64.0::DOUBLE) < 8 AS below_8 FROM b, (VALUES (32), (64), (128)) t(target)""",
    "box_transforms": FX.FX + " SELECT img, gt_index, greatest(0, least(50, x0)) AS clip_x0, floor((x0 + x1) / 2.0::DOUBLE - (x1 - x0) * 0.75::DOUBLE)::BIGINT AS grown_x0, ceil((x0 + x1) / 2.0::DOUBLE + (x1 - x0) * 0.75::DOUBLE)::BIGINT AS grown_x1, 64 - x1 AS flip_x0, 64 - x0 AS flip_x1, round(sqrt(((x0 + x1) / 2.0::DOUBLE - 32) ** 2 + ((y0 + y1) / 2.0::DOUBLE - 32) ** 2), 9) AS from_centre, x0 AS back_x0 FROM fx_gt",
    "candidate_geometry": FX.FX + f""", p0 AS MATERIALIZED (SELECT * FROM fx_pred WHERE model = 0), p1 AS MATERIALIZED (SELECT * FROM fx_pred WHERE model = 1), j AS (SELECT p.img, p.pred_index AS a, q.pred_index AS b, p.x0 AS px0, {iou_sql('p', 'q')} AS iou, (p.x0 + p.x1) / 2.0::DOUBLE AS px, (p.y0 + p.y1) / 2.0::DOUBLE AS py, (q.x0 + q.x1) / 2.0::DOUBLE AS qx, (q.y0 + q.y1) / 2.0::DOUBLE AS qy, p.x1 AS px1, p.y0 AS py0, p.y1 AS py1, ((q.x1 - q.x0) * (q.y1 - q.y0)) / ((p.x1 - p.x0) * (p.y1 - p.y0))::DOUBLE AS ar FROM p0 p JOIN p1 q ON p.img = q.img)
SELECT img, a, b, round(iou, 9) AS iou, round(sqrt((px - qx) ** 2 + (py - qy) ** 2) / sqrt(((px1 - px0) ** 2 + (py1 - py0) ** 2)::DOUBLE), 9) AS distance, round(ar, 9) AS area_ratio FROM j WHERE qx BETWEEN px0 AND px1 AND qy BETWEEN py0 AND py1""",
    "nearest_candidate": FX.FX + f" SELECT g.img, g.gt_index, p.pred_index, round({iou_sql('g', 'p')}, 9) AS iou, p.conf FROM fx_gt g LEFT JOIN fx_pred p ON g.img = p.img QUALIFY row_number() OVER (PARTITION BY g.img, g.gt_index ORDER BY {iou_sql('g', 'p')} DESC, p.conf DESC, p.pred_index) = 1",
    "strategy_chain": match_sql() + f", s AS (SELECT {_STATUS(0.25)} AS base, {_STATUS(0.5)} AS strict, {_STATUS(0.1)} AS loose, {_STATUS(0.0)} AS floor_ FROM (SELECT *, unnest(gts) AS g FROM matched)) SELECT len(list_distinct([base, strict, loose, floor_]))::INT AS outcomes, base, count(*) AS n FROM s GROUP BY ALL",
    "quintile_bins": "WITH c AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]))) AS cuts FROM orders) SELECT (len(list_filter(cuts, lambda x: o_totalprice > x)) + 1)::INT AS quintile, count(*) AS n, round(min(o_totalprice), 2) AS lo FROM orders, c GROUP BY 1",
    "factor_table": _OUTCOMES + """, r AS (SELECT o.*, ((x1 - x0) * (y1 - y0))::DOUBLE AS area FROM outcomes o JOIN fx_gt g ON o.img = g.img AND o.gt_index = g.gt_index), c AS (SELECT list_sort(list_distinct(quantile_cont(area, [0.25, 0.5, 0.75]))) AS cuts FROM r),
p AS (SELECT len(list_filter(cuts, lambda x: area > x))::INT AS bin, count(*) AS n, count_if(status = 'FN')::BIGINT AS misses, min(area) AS lo, max(area) AS hi, count(DISTINCT fold_id) AS folds FROM r, c GROUP BY 1), q AS (SELECT *, round(misses / n::DOUBLE, 9) AS rate FROM p)
SELECT *, CASE WHEN bin = (SELECT bin FROM q ORDER BY rate DESC, n DESC, bin LIMIT 1) THEN 'HIGH' WHEN bin = (SELECT bin FROM q ORDER BY rate, n DESC, bin LIMIT 1) THEN 'LOW' ELSE '' END AS role FROM q""",
    "outcome_quantiles": _OUTCOMES + " SELECT error_type, count(*) AS n, round(quantile_cont(confidence, 0.25), 9) AS q25, round(quantile_cont(confidence, 0.5), 9) AS median, round(quantile_cont(confidence, 0.75), 9) AS q75 FROM outcomes WHERE confidence IS NOT NULL GROUP BY 1",
    "worst_patterns": _OUTCOMES + " SELECT fold_id, error_type, count(*) AS n, CASE WHEN count(*) >= 20 THEN 'HIGH' ELSE 'LOW' END AS priority FROM outcomes WHERE status = 'FN' GROUP BY fold_id, error_type ORDER BY n DESC, fold_id, error_type LIMIT 4",
    "fp_concentration": match_sql() + f", p AS (SELECT fold_id, len(list_filter(m, lambda x: x.j IS NULL AND x.conf >= {REPORT})) AS fp FROM matched) SELECT fold_id, count(*) AS images, sum(fp)::BIGINT AS fp, count_if(fp > 0)::BIGINT AS with_fp, round(sum(fp) / count(*)::DOUBLE, 9) AS per_image FROM p GROUP BY fold_id",
    "gt_count_distribution": FX.FX + ", c AS (SELECT o.img, (SELECT count(*) FROM fx_gt g WHERE g.img = o.img)::INT AS n_gt FROM (SELECT DISTINCT img FROM fx_obj) o) SELECT n_gt, count(*) AS images FROM c GROUP BY n_gt",
    "tile_labels": FX.FX + """, t AS (SELECT a.x AS tx, b.x AS ty FROM (VALUES (0), (24), (32)) a(x), (VALUES (0), (24), (32)) b(x)), c AS (SELECT img, gt_index, tx, ty, greatest(x0, tx) AS cx0, greatest(y0, ty) AS cy0, least(x1, tx + 32) AS cx1, least(y1, ty + 32) AS cy1, (x1 - x0) * (y1 - y0) AS area FROM fx_gt, t)
SELECT img, gt_index, tx, ty, cx0 - tx AS lx0, cy1 - ty AS ly1, round((cx1 - cx0) * (cy1 - cy0) / area::DOUBLE, 9) AS retained, (cx1 - cx0) * (cy1 - cy0) / area::DOUBLE >= 1 AS whole FROM c WHERE cx1 > cx0 AND cy1 > cy0""",
    "refine_policy": FX.FX + f""", b AS (SELECT p.img, p.pred_index, p.conf, max(struct_pack(iou := {iou_sql('p', 'q')}, conf := q.conf)) FILTER (WHERE q.conf IS NOT NULL) AS b FROM fx_pred p LEFT JOIN fx_pred q ON p.img = q.img AND q.model = 1 WHERE p.model = 0 GROUP BY ALL)
SELECT CASE WHEN b.iou >= 0.3 AND b.conf > x.conf THEN 'BOTH' WHEN b.iou >= 0.3 THEN 'CONFIRM' WHEN b IS NULL THEN 'NO_LOCAL' ELSE 'KEEP' END AS action, count(*) AS n, round(avg(x.conf), 9) AS mean_conf FROM b x GROUP BY 1""",
    "rescue_trajectory": match_sql() + ", s AS (SELECT " + ", ".join(f"len(list_filter(m, lambda x: x.j = g.j AND x.conf >= {c})) > 0 AS at_{k}" for k, c in enumerate((0.5, 0.25, 0.1))) + " FROM (SELECT *, unnest(gts) AS g FROM matched)) SELECT CASE WHEN at_0 THEN 0 WHEN at_1 THEN 1 WHEN at_2 THEN 2 END AS \"first\", at_0 = at_1 AND at_1 = at_2 AS stable, count(*) AS n FROM s GROUP BY ALL",
    "routing_burden": match_sql() + f""", p AS (SELECT img, n_gt - len(list_filter(m, lambda x: x.j IS NOT NULL AND x.conf >= {REPORT})) AS missed, len(preds)::DOUBLE AS cnt, coalesce(1 - list_max(list_transform(preds, lambda x: x.conf)), 1.0) AS doubt FROM matched),
l AS (SELECT img, missed, 'count' AS signal, cnt AS v FROM p UNION ALL SELECT img, missed, 'doubt', doubt FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY v DESC, img) AS r, count(*) OVER (PARTITION BY signal) AS n FROM l)
SELECT signal, budget, sum(CASE WHEN r <= greatest(1, ceil(n * budget)) THEN missed ELSE 0 END)::BIGINT AS covered, sum(missed)::BIGINT AS missed FROM r, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.4::DOUBLE)) g(budget) GROUP BY ALL""",
    "composite_risk": _TOP + f""", r AS (SELECT img, cnt, top, 1 - (row_number() OVER (ORDER BY cnt DESC, img) - 1) / greatest(1, count(*) OVER () - 1)::DOUBLE AS r1, 1 - (row_number() OVER (ORDER BY top ASC NULLS LAST, img) - 1) / greatest(1, count(*) OVER () - 1)::DOUBLE AS r2 FROM t)
SELECT img, round((r1 + r2) / 2, 9) AS mean_rank, greatest(CASE WHEN top IS NULL OR top < 0.25 THEN 1.0::DOUBLE WHEN top < {HIGH} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN cnt > 8 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END) AS rule FROM r""",
    "detect_reinspect_grid": _TOP + ", g AS (SELECT h AS high, l AS low FROM (VALUES (0.4::DOUBLE), (0.45::DOUBLE), (0.5::DOUBLE)) a(h), (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.25::DOUBLE)) b(l)) SELECT high, low, count_if(coalesce(top, -1) >= high)::BIGINT AS detect, count_if(coalesce(top, -1) < high AND coalesce(top, -1) >= low)::BIGINT AS reinspect, count_if(coalesce(top, -1) < low)::BIGINT AS passed FROM t, g GROUP BY ALL",
    "policy_invariance": f"""WITH a AS (SELECT img, x.i, x.j AS ja, x.iou AS ua FROM (SELECT img, unnest(m) AS x FROM ({match_sql(1)} SELECT * FROM matched))), b AS (SELECT img, x.i, x.j AS jb, x.iou AS ub FROM (SELECT img, unnest(m) AS x FROM ({match_sql(-1)} SELECT * FROM matched)))
SELECT count(*) AS rows, count_if(ja IS DISTINCT FROM jb)::BIGINT AS changed, count_if(coalesce(abs(ua - ub) <= greatest(1e-9 * greatest(abs(ua), abs(ub)), 1e-12), true))::BIGINT AS same_overlap FROM a JOIN b ON a.img = b.img AND a.i = b.i""",
    "best_configuration": f"WITH s AS ({sweep_sql(1)}) SELECT threshold_id, f1, recall, round(0.1::DOUBLE * precision + 0.9::DOUBLE * recall, 9) AS fitness FROM s ORDER BY f1 DESC, recall DESC, threshold_id LIMIT 1",
    "budget_reaches": f"WITH s AS ({sweep_sql(1)}) SELECT goal, min(CASE WHEN precision >= goal THEN threshold_id END) AS first_step FROM s, (VALUES (0.3::DOUBLE), (0.36::DOUBLE), (0.4::DOUBLE)) g(goal) GROUP BY goal",
    "case_table": _OUTCOMES + ", l AS (SELECT list_filter([CASE WHEN gt_index = 0 THEN 'FIRST' END, CASE WHEN confidence < 0.1 THEN 'WEAK' END, CASE WHEN iou < 0.1 THEN 'FAR' END], lambda x: x IS NOT NULL) AS l FROM outcomes WHERE status = 'FN') SELECT CASE WHEN len(l) = 0 THEN 'OTHER' ELSE array_to_string(l, '|') END AS conditions, count(*) AS n FROM l GROUP BY 1",
    "duplicate_collapse": "SELECT sha256(text) AS sha, min(doc_id) AS canonical, count(DISTINCT source) AS sources, array_to_string(list_slice(list_sort(list(doc_id)), 2, count(*)), ';') AS others FROM documents GROUP BY 1 HAVING count(*) > 1",
    "bootstrap_gap": _OUTCOMES + f", c AS (SELECT img % 60 AS cluster, count_if(gt_index > 1 AND status = 'FN') AS ha, count_if(gt_index > 1) AS hn, count_if(gt_index <= 1 AND status = 'FN') AS la, count_if(gt_index <= 1) AS ln FROM outcomes GROUP BY 1), d AS (SELECT i // 60 AS rep, {_DRAW} AS cluster FROM range(100 * 60) t(i)), r AS (SELECT sum(ha) / sum(hn)::DOUBLE - sum(la) / sum(ln)::DOUBLE AS gap FROM d JOIN c USING (cluster) GROUP BY rep HAVING sum(hn) > 0 AND sum(ln) > 0) SELECT count(*) AS replicates, round(quantile_cont(gap, 0.025), 9) AS low, round(quantile_cont(gap, 0.975), 9) AS high FROM r",
    "bootstrap_median": _OUTCOMES + f", o AS (SELECT img % 60 AS cluster, confidence FROM outcomes WHERE confidence IS NOT NULL), d AS (SELECT i // 60 AS rep, {_DRAW} AS cluster FROM range(40 * 60) t(i)), r AS (SELECT quantile_cont(confidence, 0.5) AS m FROM d JOIN o USING (cluster) GROUP BY rep) SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM r",
    "stable_shift": "WITH l AS (SELECT l_extendedprice AS a, round(l_extendedprice * (1 - l_discount), 2) AS b FROM lineitem), r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM l) SELECT round(quantile_cont(abs(a - b), 0.5), 6) AS median_abs, round(avg(b - a), 4) AS bias, round(corr(ra, rb), 6) AS spearman FROM r",
}


def _fusion_sql() -> str:
    """The fusion grid: three member sets and three overlaps."""
    parts = []
    for k in range(3):
        for least in (0.5, 0.6, 0.7):
            fold = _NMS_FOLD.format(iou=iou_sql("acc[n]", "p"), least=str(least))
            where = "" if k == 2 else f"WHERE model = {k}"
            kept = f"(SELECT img, unnest({fold}) AS k FROM (SELECT img, list(struct_pack(i := pred_index, conf := conf, model := model, x0 := x0::DOUBLE, y0 := y0::DOUBLE, x1 := x1::DOUBLE, y1 := y1::DOUBLE) ORDER BY conf DESC, model, pred_index) AS preds FROM fx_pred0 {where} GROUP BY img))"
            text = match_sql().replace("fx_pred AS (", "fx_pred0 AS (").replace(",\ngl AS", f",\nfx_pred AS (SELECT z.* FROM fx_pred0 z JOIN {kept} k ON z.img = k.img AND z.pred_index = k.k.i),\ngl AS", 1)
            parts.append(f"SELECT {k} AS combination, {least}::DOUBLE AS nms, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM ({text} SELECT sum(len(list_filter(m, lambda x: x.j IS NOT NULL))) AS tp, sum(len(list_filter(m, lambda x: x.j IS NULL))) AS fp, sum(n_gt - len(list_filter(m, lambda x: x.j IS NOT NULL))) AS fn FROM matched)")
    return f"SELECT *, {_RATIOS} FROM ({' UNION ALL '.join(parts)})"


ORACLES["det_fusion_grid"] = _fusion_sql()
