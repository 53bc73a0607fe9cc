"""Local second looks at candidates, routing signals, fusion grids and resampled effects, each with its DuckDB SQL.

A candidate is a box of model 0; its local boxes are the image's other boxes, moved and weakened by one of three scales.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from veristrata.functions.exprs import iou
from veristrata.operators import kernels as B
from veristrata.operators import matching as M
from veristrata.operators import metrics as X
from veristrata.operators import windows as N
from veristrata.operators.groups import _written
from veristrata.plans import fixtures as FX
from veristrata.plans.detection import _RATIOS, REPORT, _of_model, _strategies_sql, iou_sql, match_sql

SIDES = ("x0", "y0", "x1", "y1")
SCALES = (0, 1, 2)
AGREE, LEAST = 0.5, 0.3
POLICIES = ("CONFIRM", "REFINE", "BOTH")
SETTINGS = [(s, least, p) for s in SCALES for least in (LEAST, 0.5) for p in POLICIES]
SIGNALS = ("confidence", "side", "instability")
PERCENTS = (10, 20, 30, 40, 50)
#: Which models a combination holds; the second model's odd boxes stand for a third model.
COMBINATIONS = {"A": (0,), "B": (1,), "C": (2,), "AB": (0, 1), "AC": (0, 2), "ABC": (0, 1, 2)}


def _q9(c):
    return F.round(c, 9)


def _found(match):
    """Indices of true boxes that a matching finds at the report threshold."""
    return F.transform(F.filter(match, lambda m: m["j"].isNotNull() & (m["conf"] >= REPORT)), lambda m: m["j"])


def _based(images):
    return images.withColumn("base", _found(M.greedy_match(F.filter("preds", _of_model(0)), F.col("gts"))))


# ---------------------------------------------------------------- local boxes
def _local(task, kind: str):
    """task over batches of `preds`: all that is asked of an image's local boxes, so that they are found once. A local box is the best of a scale by (overlap, confidence), then the first."""
    def run(p: pa.Array) -> pa.Array:
        return task(p)

    run.__annotations__ = {k: pa.Array for k in run.__annotations__}
    return F.explode(F.arrow_udf(run, f"array<struct<{kind}>>")(F.col("preds")))


def local_best(spark, d):
    """Each candidate's best local box at each scale."""
    rows = FX.images(spark, d).select("img", _local(lambda p: B.local_boxes(p, SCALES), "pred_index:int,scale:int,local_index:int,iou:double,conf:double,x0:double").alias("b"))
    return rows.select("img", "b.pred_index", "b.scale", "b.local_index", _q9(F.col("b.iou")).alias("iou"), _q9(F.col("b.conf")).alias("conf"), "b.x0")


def consensus_scales(spark, d):
    """Candidates confirmed by local boxes of two scales or more that overlap it and each other: median box, the larger of its confidence and the median one, spread of centres in diagonals."""
    kind = "pred_index:int,valid:int,agreeing:int,confirmed:boolean,pair_iou:double,x0:double,y0:double,x1:double,y1:double,conf:double,dispersion:double"
    rows = FX.images(spark, d).select("img", _local(lambda p: B.consensus(p, SCALES, LEAST, AGREE), kind).alias("c"))
    return rows.select("img", *[f"c.{n}" for n in ("pred_index", "valid", "agreeing", "confirmed")], _q9(F.col("c.pair_iou")).alias("pair_iou"), *[f"c.{n}" for n in SIDES], _q9(F.col("c.conf")).alias("conf"), _q9(F.col("c.dispersion")).alias("dispersion"))


def policy_summary(spark, d):
    """Every policy at every scale and overlap: metrics, and objects gained and lost against the candidates alone."""
    return X.with_ratios(M.counted(FX.images(spark, d), ["preds", "gts"], SETTINGS, "scale int, least double, policy string", lambda p, g: B.policy_counts(p, g, SCALES, SETTINGS, REPORT)))


def routing_reevaluated(spark, d):
    """Only the riskiest share of candidates, by one of three signals, gets a local box: how many, in how many images, and the metrics.

    The last key inside each share is found by counted bins; these 15 keys go to the tasks, so images are read again without a join by candidate.
    """
    images = FX.images(spark, d)
    keys = images.select("img", _local(lambda p: B.signals(p, SCALES), "i:int,v0:double,v1:double,v2:double").alias("c"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.col(f"c.v{k}").alias("v"), (F.col("img") * s).alias("img"), (F.col("c.i") * s).alias("i")) for k, s in enumerate((1, 1, -1))]))
    keys = _written(keys.select("img", "c"))
    cuts = N.keys_at(keys.select(each.alias("x")).select("x.*"), "signal", "v", ["img", "i"], [p / 100 for p in PERCENTS])
    cuts = sorted((signal, round(share * 100), key) for signal, share, *key in cuts)  # 15 rows
    asked, at, most = [(1, LEAST, "BOTH")] * len(cuts), [(s, key) for s, _, key in cuts], [(s, p) for s, p, _ in cuts]
    if not cuts:
        return X.with_ratios(spark.createDataFrame([], "signal int, percent int, routed long, images long, tp long, fp long, fn long, rescued long, lost long"))
    out = M.counted(images, ["img", "preds", "gts"], most, "signal int, percent int", lambda i, p, g: B.policy_counts(p, g, SCALES, asked, REPORT, i.to_numpy(zero_copy_only=False), at), "routed images")
    return X.with_ratios(out)


# ---------------------------------------------------------------- instability and composite risk
def _partners(view: str):
    """(candidate, overlap, box of the view) for the one-to-one pairs of the candidates `a` with a view."""
    return F.transform(M.global_match(F.col("a"), F.col(view), 0.0), lambda m: F.struct(m["ai"].alias("ai"), m["iou"].alias("iou"), F.get(F.filter(view, lambda b: b["i"] == m["bi"]), F.lit(0)).alias("b")))


def _anchors(spark, d):
    """Per candidate its partner in each of two other views of the image, paired one to one: the second model, and most candidates moved by two."""
    moved = F.transform(F.filter("preds", lambda p: (p["model"] == 0) & (p["i"] % 3 != 2)), lambda p: F.struct(p["i"].alias("i"), p["conf"].alias("conf"), p["model"].alias("model"), (p["x0"] + 2).alias("x0"), p["y0"].alias("y0"), (p["x1"] + 2).alias("x1"), p["y1"].alias("y1")))
    rows = FX.images(spark, d).select("img", F.filter("preds", _of_model(0)).alias("a"), F.filter("preds", _of_model(1)).alias("t0"), moved.alias("t1"))
    rows = rows.select("img", "a", *[_partners(f"t{k}").alias(f"m{k}") for k in (0, 1)])
    rows = rows.select("img", F.explode("a").alias("p"), "m0", "m1")
    return rows.select("img", "p", *[F.get(F.filter(f"m{k}", lambda m: m["ai"] == F.col("p.i")), F.lit(0)).alias(f"q{k}") for k in (0, 1)])


def _features(spark, d):
    side = lambda b: F.least(F.col(f"{b}.x1") - F.col(f"{b}.x0"), F.col(f"{b}.y1") - F.col(f"{b}.y0"))
    middle = lambda b, u, v: (F.col(f"{b}.{u}") + F.col(f"{b}.{v}")) / 2
    move = lambda b: F.hypot(middle("p", "x0", "x1") - middle(b, "x0", "x1"), middle("p", "y0", "y1") - middle(b, "y0", "y1"))
    mean = lambda v: sum(v[1:], v[0]) / len(v)
    std = lambda v: F.sqrt(mean([(x - mean(v)) * (x - mean(v)) for x in v]))
    or0 = lambda c: F.coalesce(c, F.lit(0.0))
    conf = [F.col("p.conf"), *[or0(F.col(f"q{k}.b.conf")) for k in (0, 1)]]
    size = [side("p"), *[or0(side(f"q{k}.b")) for k in (0, 1)]]
    far = [F.coalesce(move(f"q{k}.b"), F.hypot(F.col("p.x1") - F.col("p.x0"), F.col("p.y1") - F.col("p.y0"))) for k in (0, 1)]
    return _anchors(spark, d).select("img", "p", F.col("p.i").alias("pred_index"), _q9(std(conf)).alias("conf_std"), _q9(F.greatest(*conf) - F.least(*conf)).alias("conf_range"), _q9(mean([or0(F.col(f"q{k}.iou")) for k in (0, 1)])).alias("iou_consistency"),
                                     _q9(mean(far)).alias("displacement"), _q9(std(size) / F.greatest(mean(size), F.lit(1e-9))).alias("size_cv"), F.col("q0").isNotNull().alias("matched_0"), F.col("q1").isNotNull().alias("matched_1"))


def instability_features(spark, d):
    """How much a candidate's confidence, place and size vary over views; a view without it counts as confidence, overlap and size 0 and a shift by its diagonal."""
    return _features(spark, d).drop("p")


#: Ranked features of a candidate: name, and whether high values are risky.
RANKED = {"side": False, "edge": False, "area": False, "aspect": True, "conf_std": True, "conf_range": True, "iou_consistency": False, "displacement": True, "size_cv": True}


def _scores(spark, d):
    w, h = F.col("p.x1") - F.col("p.x0"), F.col("p.y1") - F.col("p.y0")
    f = _features(spark, d).withColumns({"side": F.least(w, h), "edge": F.least(F.col("p.x0"), F.col("p.y0"), 64 - F.col("p.x1"), 64 - F.col("p.y1")), "area": F.when(F.col("pred_index") % 5 != 0, w * h), "aspect": _q9(w / h), "conf": F.col("p.conf")})
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("byte").alias("feature"), (F.col(n) * (-1 if high else 1)).cast("double").alias("v"), F.when(F.lit(k == 0), F.col("conf")).alias("conf")) for k, (n, high) in enumerate(RANKED.items())]))
    long = f.select("img", "pred_index", each.alias("x")).select("img", "pred_index", "x.*")
    sign = F.when(F.col("feature").isin([k for k, high in enumerate(RANKED.values()) if high]), -1).otherwise(1)
    placed = N.numbered(long.withColumn("known", F.col("v").isNotNull()), ["feature", "known"], [F.asc("v"), (F.col("img") * sign).asc(), (F.col("pred_index") * sign).asc()], "r", "n", ["img", "pred_index", "feature", "known", "conf"])
    risk = F.when(F.col("known"), 1 - (F.col("r") - 1) / F.greatest(F.lit(1), F.col("n") - 1))
    per = placed.select("img", "pred_index", "feature", "conf", risk.alias("risk")).groupBy("img", "pred_index").agg(F.max("conf").alias("conf"), *[F.max(F.when(F.col("feature") == k, F.col("risk"))).alias(n) for k, n in enumerate(RANKED)])
    seen = F.array_compact(F.array("edge", "area", "aspect"))
    low = F.when(F.col("conf") < REPORT, F.col("conf") / REPORT).otherwise((1 - F.col("conf")) / (1 - REPORT))
    shaky = (F.col("conf_std") + F.col("conf_range") + F.col("iou_consistency") + F.col("displacement") + F.col("size_cv")) / 5
    per = per.select("img", "pred_index", _q9(low).alias("low"), _q9("side").alias("small"), _q9(F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)).alias("dim"), _q9(shaky).alias("shaky"))
    return per.select("*", F.greatest("low", "small").alias("low_or_small"), F.greatest("low", "shaky").alias("low_or_shaky"), F.greatest("low", "shaky", "dim").alias("any"))


RULES = ("low", "small", "dim", "shaky", "low_or_small", "low_or_shaky", "any")


def composite_scores(spark, d):
    """Risk of each candidate: closeness to the report threshold as a line to either side, ranks of its size, mean ranks of its visibility and instability, and the largest of several."""
    return _scores(spark, d)


def routing_coverage(spark, d):
    """For rules and budgets: routed candidates and images, misses in those images, misses whose own candidate is routed, and those that another strategy finds."""
    scores = _written(_scores(spark, d))
    long = scores.select("img", "pred_index", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(r).alias("v")) for k, r in enumerate(RULES)])).alias("x")).select("img", "pred_index", "x.*")
    budgets = [0.1, 0.2, 0.4]
    cuts = N.keys_at(long, "rule", "v", ["img", "pred_index"], budgets, descending=True, least=1)  # 21 keys: the last row inside each budget
    images = _based(FX.images(spark, d)).withColumn("alt", _found(M.union_match(F.col("preds"), 0.5, F.col("gts"))))
    own = lambda g: F.array_max(F.transform(F.filter("preds", _of_model(0)), lambda p: F.struct(iou(g, p).alias("iou"), (-p["i"]).alias("k"))))
    missed = F.transform(F.filter("gts", lambda g: ~F.array_contains("base", g["j"])), lambda g: F.struct(own(g)["k"].alias("k"), F.array_contains("alt", g["j"]).alias("saved")))
    misses = images.select("img", missed.alias("missed"))
    per = scores.groupBy("img").agg(F.collect_list(F.struct("pred_index", *RULES)).alias("cands")).join(misses, "img")  # an image's candidates
    low = lambda v: F.coalesce(v, F.lit(float("-inf")))

    def chosen(k: int, key: tuple):
        value, img, index = key
        value = float("-inf") if value is None else value
        inside = lambda c: (low(c[RULES[k]]) > value) | ((low(c[RULES[k]]) == value) & ((F.col("img") < img) | ((F.col("img") == img) & (c["pred_index"] <= index))))
        return F.transform(F.filter("cands", inside), lambda c: c["pred_index"])

    sets = F.array(*[F.struct(F.lit(RULES[k]).alias("rule"), F.lit(share).alias("budget"), chosen(k, key).alias("chosen")) for k, share, *key in cuts]) if cuts else F.expr("array(named_struct('rule', '', 'budget', 0D, 'chosen', cast(array() as array<int>)))")
    per = per.select("missed", F.explode(F.filter(sets, lambda x: F.size(x["chosen"]) > 0)).alias("x")).select("missed", "x.*")
    direct = F.filter("missed", lambda m: F.array_contains("chosen", -m["k"]))
    saved = lambda a: F.sum(F.size(F.filter(a, lambda m: m["saved"])))
    return per.groupBy("rule", "budget").agg(F.sum(F.size("chosen")).alias("routed"), F.count("*").alias("images"), F.sum(F.size("missed")).alias("covered"), saved("missed").alias("rescuable"), F.sum(F.size(direct)).alias("direct"), saved(direct).alias("direct_rescuable"))


def two_model_pairs(spark, d):
    """One-to-one pairs of the two models' boxes that overlap at all, best overlap first."""
    pairs = M.global_match(F.filter("preds", _of_model(0)), F.filter("preds", _of_model(1)), 0.0)
    rows = FX.images(spark, d).select("img", F.explode(pairs).alias("p"))
    return rows.select("img", F.col("p.ai").alias("a"), F.col("p.bi").alias("b"), _q9("p.iou").alias("iou"))


# ---------------------------------------------------------------- SQL
_D = ", ".join(f"{c}::DOUBLE AS {c}" for c in SIDES)
_VALUES = lambda rows: "(VALUES " + ", ".join(f"({', '.join(repr(v) if not isinstance(v, float) else f'{v!r}::DOUBLE' for v in r)})" for r in rows) + ")"
_BASE = FX.FX.replace("fx_gt AS (", "fx_gt0 AS (").replace("fx_pred AS (", "fx_pred0 AS (")
_LOCAL = _BASE + f""",
cand AS (SELECT img, fold_id, pred_index, conf, {_D} FROM fx_pred0 WHERE model = 0),
moved AS (SELECT img, pred_index, scale, conf * factor AS conf, x0::DOUBLE + scale AS x0, y0::DOUBLE AS y0, x1::DOUBLE + scale AS x1, y1::DOUBLE AS y1 FROM fx_pred0, {_VALUES([(s, 1 - s / 10) for s in SCALES])} t(scale, factor)),
loc AS MATERIALIZED (SELECT p.img, p.fold_id, p.pred_index, p.conf, p.x0, p.y0, p.x1, p.y1, s.scale, max(struct_pack(iou := {iou_sql('p', 'q')}, conf := q.conf, k := -q.pred_index, x0 := q.x0, y0 := q.y0, x1 := q.x1, y1 := q.y1)) FILTER (WHERE q.img IS NOT NULL) AS b
 FROM cand p CROSS JOIN {_VALUES([(s,) for s in SCALES])} s(scale) LEFT JOIN moved q ON q.img = p.img AND q.scale = s.scale AND q.pred_index <> p.pred_index GROUP BY ALL)"""


def _settled_sql(start: str, settings: int, preds: str, select: str, base: int = 99) -> str:
    """Matches predictions under many settings at once, with the setting in the image's number; setting 99 is the candidates alone. Gains and losses are against setting `base`."""
    rest = match_sql()
    rest = rest[rest.index(",\ngl AS"):]
    return f"""{start},
sets AS (SELECT range AS setting FROM range({settings}) UNION ALL SELECT 99),
fx_gt AS (SELECT g.img * 100 + s.setting AS img, fold_id, gt_index, x0, y0, x1, y1 FROM fx_gt0 g, sets s),
fx_pred AS ({preds} UNION ALL SELECT img * 100 + 99, fold_id, pred_index, conf, x0, y0, x1, y1 FROM fx_pred0 WHERE model = 0){rest},
f AS (SELECT img // 100 AS img, img % 100 AS setting, n_gt, list_transform(list_filter(m, lambda x: x.j IS NOT NULL AND x.conf >= {REPORT}), lambda x: x.j) AS found, len(list_filter(m, lambda x: x.conf >= {REPORT})) AS shown FROM matched),
e AS (SELECT f.setting, sum(len(f.found))::BIGINT AS tp, sum(f.shown - len(f.found))::BIGINT AS fp, sum(f.n_gt - len(f.found))::BIGINT AS fn, sum(len(list_filter(f.found, lambda j: NOT list_contains(coalesce(b.found, []), j))))::BIGINT AS rescued, sum(len(list_filter(coalesce(b.found, []), lambda j: NOT list_contains(f.found, j))))::BIGINT AS lost
 FROM f LEFT JOIN f b ON f.img = b.img AND b.setting = {base} WHERE f.setting < 99 GROUP BY f.setting)
{select}"""


_TAKE = lambda c, cond: f"CASE WHEN {cond} THEN b.{c} ELSE l.{c} END AS {c}"
_SHAKY = """shaky AS (SELECT img, pred_index, conf, least(x1 - x0, y1 - y0) AS side, CASE WHEN count(b) < 3 THEN 1.0 ELSE round(1 - list_median(flatten(list_transform(list(b ORDER BY scale), lambda a, i: list_transform(list(b ORDER BY scale)[i + 1:], lambda z: """ + iou_sql("a", "z") + """)))), 9) END AS v FROM loc GROUP BY img, pred_index, conf, x0, y0, x1, y1)"""
_VIEWS = FX.FX + f""",
a AS (SELECT img, pred_index, conf, {_D} FROM fx_pred WHERE model = 0),
t AS (SELECT 0 AS k, img, pred_index, conf, {_D} FROM fx_pred WHERE model = 1 UNION ALL SELECT 1, img, pred_index, conf, x0 + 2, y0, x1 + 2, y1 FROM a WHERE pred_index % 3 <> 2),
o AS (SELECT p.img, q.k, p.pred_index AS ai, q.pred_index AS bi, {iou_sql('p', 'q')} AS iou FROM a p JOIN t q ON p.img = q.img),
gm AS (SELECT img, k, unnest(list_reduce(list(struct_pack(iou := iou, ai := ai, bi := bi) ORDER BY iou DESC, ai DESC, bi DESC), lambda acc, x: CASE WHEN len(list_filter(acc, lambda z: z.ai = x.ai OR z.bi = x.bi)) > 0 THEN acc ELSE list_append(acc, x) END, []::STRUCT(iou DOUBLE, ai INT, bi INT)[])) AS m FROM o WHERE iou > 0 GROUP BY img, k)"""
_FEATURES = _VIEWS + """,
q AS (SELECT a.img, a.pred_index, any_value(a) AS p, list(struct_pack(k := gm.k, iou := gm.m.iou, conf := t.conf, side := least(t.x1 - t.x0, t.y1 - t.y0), far := sqrt(((a.x0 + a.x1) / 2 - (t.x0 + t.x1) / 2) ** 2 + ((a.y0 + a.y1) / 2 - (t.y0 + t.y1) / 2) ** 2))) FILTER (WHERE gm.k IS NOT NULL) AS l
 FROM a LEFT JOIN gm ON gm.img = a.img AND gm.m.ai = a.pred_index LEFT JOIN t ON t.img = a.img AND t.k = gm.k AND t.pred_index = gm.m.bi GROUP BY a.img, a.pred_index),
v AS (SELECT img, pred_index, p, [p.conf, """ + ", ".join(f"coalesce(list_filter(l, lambda x: x.k = {k})[1].conf, 0)" for k in (0, 1)) + "] AS c, [least(p.x1 - p.x0, p.y1 - p.y0), " + ", ".join(f"coalesce(list_filter(l, lambda x: x.k = {k})[1].side, 0)" for k in (0, 1)) + """] AS s,
 [""" + ", ".join(f"coalesce(list_filter(l, lambda x: x.k = {k})[1].far, sqrt((p.x1 - p.x0) ** 2 + (p.y1 - p.y0) ** 2))" for k in (0, 1)) + "] AS far, [" + ", ".join(f"coalesce(list_filter(l, lambda x: x.k = {k})[1].iou, 0)" for k in (0, 1)) + "] AS u, " + ", ".join(f"len(list_filter(coalesce(l, []), lambda x: x.k = {k})) > 0 AS matched_{k}" for k in (0, 1)) + """ FROM q),
feat AS (SELECT img, pred_index, p, round(list_aggregate(c, 'stddev_pop'), 9) AS conf_std, round(list_max(c) - list_min(c), 9) AS conf_range, round(list_avg(u), 9) AS iou_consistency, round(list_avg(far), 9) AS displacement, round(list_aggregate(s, 'stddev_pop') / greatest(list_avg(s), 1e-9), 9) AS size_cv, matched_0, matched_1 FROM v)"""
_SIGN = {n: "-" if high else "" for n, high in RANKED.items()}
_SCORES = _FEATURES + """,
w AS (SELECT *, least(p.x1 - p.x0, p.y1 - p.y0) AS side, least(p.x0, p.y0, 64 - p.x1, 64 - p.y1) AS edge, CASE WHEN pred_index % 5 <> 0 THEN (p.x1 - p.x0) * (p.y1 - p.y0) END AS area, round((p.x1 - p.x0) / (p.y1 - p.y0), 9) AS aspect FROM feat),
rk AS (SELECT img, pred_index, p.conf AS conf, """ + ", ".join(f"CASE WHEN {n} IS NOT NULL THEN 1 - (row_number() OVER (ORDER BY {s}{n} NULLS LAST, {s}img, {s}pred_index) - 1) / greatest(1, count({n}) OVER () - 1)::DOUBLE END AS {n}" for n, s in _SIGN.items()) + f""" FROM w),
sc AS (SELECT img, pred_index, round(CASE WHEN conf < {REPORT} THEN conf / {REPORT}::DOUBLE ELSE (1 - conf) / {1 - REPORT}::DOUBLE END, 9) AS low, round(side, 9) AS small, round(list_avg(list_filter([edge, area, aspect], lambda x: x IS NOT NULL)), 9) AS dim, round((conf_std + conf_range + iou_consistency + displacement + size_cv) / 5, 9) AS shaky FROM rk),
scores AS (SELECT *, greatest(low, small) AS low_or_small, greatest(low, shaky) AS low_or_shaky, greatest(low, shaky, dim) AS "any" FROM sc)"""

QUERIES = [local_best, consensus_scales, policy_summary, routing_reevaluated, instability_features, composite_scores, routing_coverage, two_model_pairs]
ORACLES = {
    "local_best": _LOCAL + " SELECT img, pred_index, scale, -b.k AS local_index, round(b.iou, 9) AS iou, round(b.conf, 9) AS conf, b.x0 AS x0 FROM loc",
    "consensus_scales": _LOCAL + f""", v AS (SELECT img, pred_index, conf, x0, y0, x1, y1, coalesce(list(struct_pack(s := scale, conf := b.conf, x0 := b.x0, y0 := b.y0, x1 := b.x1, y1 := b.y1) ORDER BY scale) FILTER (WHERE b.iou >= {LEAST}), []) AS valid FROM loc GROUP BY img, pred_index, conf, x0, y0, x1, y1),
c AS (SELECT *, list_filter(valid, lambda a: len(list_filter(valid, lambda z: z.s <> a.s AND {iou_sql('a', 'z')} >= {AGREE})) > 0) AS agree, flatten(list_transform(valid, lambda a: list_transform(list_filter(valid, lambda z: z.s > a.s), lambda z: {iou_sql('a', 'z')}))) AS pairs FROM v),
m AS (SELECT *, len(agree) >= 2 AS ok, {', '.join(f'list_median(list_transform(agree, lambda b: b.{k})) AS m_{k}' for k in ('conf', *SIDES))}, list_median(list_transform(agree, lambda b: (b.x0 + b.x1) / 2)) AS mx, list_median(list_transform(agree, lambda b: (b.y0 + b.y1) / 2)) AS my FROM c)
SELECT img, pred_index, len(valid)::INT AS valid, len(agree)::INT AS agreeing, ok AS confirmed, round(coalesce(list_median(pairs), 0), 9) AS pair_iou, {', '.join(f'CASE WHEN ok THEN m_{k} ELSE {k} END AS {k}' for k in SIDES)}, round(CASE WHEN ok THEN greatest(conf, m_conf) ELSE conf END, 9) AS conf,
 round(CASE WHEN ok THEN list_max(list_transform(agree, lambda b: sqrt(((b.x0 + b.x1) / 2 - mx) ** 2 + ((b.y0 + b.y1) / 2 - my) ** 2))) / greatest(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 1e-12) END, 9) AS dispersion FROM m""",
    "policy_summary": _settled_sql(_LOCAL + f", grid AS (SELECT * FROM {_VALUES([(k, s, least, p) for k, (s, least, p) in enumerate(SETTINGS)])} g(setting, scale, least, policy))", len(SETTINGS),
        f"SELECT l.img * 100 + g.setting AS img, l.fold_id, l.pred_index, CASE WHEN b.iou >= g.least AND g.policy IN ('CONFIRM', 'BOTH') THEN greatest(l.conf, b.conf) ELSE l.conf END AS conf, {', '.join(_TAKE(c, chr(98) + '.iou >= g.least AND g.policy IN (' + repr('REFINE') + ', ' + repr('BOTH') + ')') for c in SIDES)} FROM loc l JOIN grid g ON l.scale = g.scale",
        f"SELECT scale, least, policy, tp, fp, fn, rescued, lost, {_RATIOS} FROM e JOIN grid USING (setting)"),
    "routing_reevaluated": _settled_sql(_LOCAL + f""", {_SHAKY},
long AS (SELECT 0 AS signal, img, pred_index, conf AS v, img AS k1, pred_index AS k2 FROM shaky UNION ALL SELECT 1, img, pred_index, side, img, pred_index FROM shaky UNION ALL SELECT 2, img, pred_index, -v, -img, -pred_index FROM shaky),
placed AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY v, k1, k2) AS r, count(*) OVER (PARTITION BY signal) AS n FROM long),
routes AS MATERIALIZED (SELECT signal, percent, (signal * 5 + percent / 10 - 1)::INT AS setting, img, pred_index, r <= ceil(n * percent / 100) AS routed FROM placed, {_VALUES([(float(p),) for p in PERCENTS])} t(percent))""", 15,
        f"SELECT l.img * 100 + g.setting AS img, l.fold_id, l.pred_index, CASE WHEN b.iou >= {LEAST} AND routed THEN greatest(l.conf, b.conf) ELSE l.conf END AS conf, {', '.join(_TAKE(c, f'b.iou >= {LEAST} AND routed') for c in SIDES)} FROM loc l JOIN routes g ON l.scale = 1 AND l.img = g.img AND l.pred_index = g.pred_index",
        f"SELECT signal, percent, routed, images, tp, fp, fn, rescued, lost, {_RATIOS} FROM e JOIN (SELECT setting, signal, percent::INT AS percent, count_if(routed)::BIGINT AS routed, count(DISTINCT CASE WHEN routed THEN img END) AS images FROM routes GROUP BY ALL) USING (setting)"),
    "instability_features": _FEATURES + " SELECT * EXCLUDE (p) FROM feat",
    "composite_scores": _SCORES + " SELECT * FROM scores",
    "routing_coverage": _strategies_sql(_SCORES[len(FX.FX):] + f""",
missed AS (SELECT g.img, g.gt_index, h.s2 AS saved, -max(struct_pack(iou := {iou_sql('g', 'p')}, k := -p.pred_index)).k AS own FROM fx_gt g JOIN hits h ON g.img = h.img AND g.gt_index = h.gt_index LEFT JOIN (SELECT * FROM fx_pred WHERE model = 0) p ON p.img = g.img WHERE NOT h.s0 GROUP BY ALL),
ranked AS (SELECT rule, img, pred_index, row_number() OVER (PARTITION BY rule ORDER BY v DESC, img, pred_index) AS r, count(*) OVER (PARTITION BY rule) AS n FROM ({' UNION ALL '.join(f"SELECT '{x}' AS rule, img, pred_index, {chr(34)}{x}{chr(34)} AS v FROM scores" for x in RULES)})),
sel AS MATERIALIZED (SELECT rule, budget, img, pred_index FROM ranked, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.4::DOUBLE)) b(budget) WHERE r <= greatest(1, ceil(n * budget))),
per AS (SELECT rule, budget, img, count(*) AS n, list(pred_index) AS chosen FROM sel GROUP BY ALL)
SELECT rule, budget, sum(n)::BIGINT AS routed, count(*) AS images, sum(covered)::BIGINT AS covered, sum(rescuable)::BIGINT AS rescuable, sum(direct)::BIGINT AS direct, sum(direct_rescuable)::BIGINT AS direct_rescuable FROM
 (SELECT rule, budget, img, n, count(m.img) AS covered, count_if(m.saved) AS rescuable, count_if(list_contains(chosen, m.own)) AS direct, count_if(m.saved AND list_contains(chosen, m.own)) AS direct_rescuable FROM per LEFT JOIN missed m USING (img) GROUP BY rule, budget, img, n) GROUP BY rule, budget""").replace("list_transform(m, lambda x: x.j)", f"list_transform(list_filter(m, lambda x: x.conf >= {REPORT}), lambda x: x.j)"),
    # two queries of the detection plans that pair boxes one to one
    "global_pairs": _VIEWS.replace("WHERE iou > 0 GROUP", "WHERE iou >= 0.5 GROUP") + " SELECT img, m.ai AS a, m.bi AS b, round(m.iou, 9) AS iou FROM gm WHERE k = 0",
    "instability": _VIEWS + ", r AS (SELECT a.img, a.conf, coalesce(g.m.iou, 0) AS iou, coalesce(t.conf, 0) AS conf2 FROM a LEFT JOIN (SELECT * FROM gm WHERE k = 0) g ON g.img = a.img AND g.m.ai = a.pred_index LEFT JOIN t ON t.k = 0 AND t.img = a.img AND t.pred_index = g.m.bi) SELECT img % 10 AS shard, count(*) AS n, count_if(iou = 0)::BIGINT AS unmatched, round(avg(iou), 6) AS mean_iou, round(avg(abs(conf - conf2)), 6) AS mean_shift FROM r GROUP BY 1",
    "two_model_pairs": _VIEWS + " SELECT img, m.ai AS a, m.bi AS b, round(m.iou, 9) AS iou FROM gm WHERE k = 0",
}
