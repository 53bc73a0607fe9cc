"""Fusion grids, audits of suppression, strategy cells, resampled effects, fold balance, tiles and geometry, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.functions.exprs import iou, labels_that_hold, ratio, tile_starts, tiles_along
from veristrata.operators import checks as K
from veristrata.operators import groups as G
from veristrata.operators import kernels as B
from veristrata.operators import matching as M
from veristrata.operators import metrics as X
from veristrata.operators import resample as R
from veristrata.operators import stats as S
from veristrata.operators import windows as N
from veristrata.plans import fixtures as FX
from veristrata.plans.detection import _NMS_FOLD, _OUTCOMES, _RATIOS, REPORT, _matched, _of_model, _strategies_sql, _strategy_hits, iou_sql, match_sql
from veristrata.plans.extended import _DRAW
from veristrata.plans.fixtures import read
from veristrata.plans.policies import _BASE, _VALUES, COMBINATIONS, SIDES, _q9, _settled_sql

OVERLAPS = (0.5, 0.6, 0.7)
FUSIONS = [(name, least) for least in OVERLAPS for name in COMBINATIONS]
LIMITS = (600, 3600, 21600)


# ---------------------------------------------------------------- fusion
def fusion_grid_paired(spark, d):
    """Six combinations of three models at three overlaps: metrics, and objects gained and lost against the first model alone at 0.7."""
    settings = [(COMBINATIONS[n], least) for n, least in FUSIONS]
    base = FUSIONS.index(("A", 0.7))
    return X.with_ratios(M.counted(FX.images(spark, d), ["preds", "gts"], FUSIONS, "combination string, nms double", lambda p, g: B.fusion_counts(p, g, settings, REPORT, base, True)))


def fused_contributors(spark, d):
    """For each true box the models behind the fused prediction that finds it, with confidence and overlap; empty and 0 where none does."""
    rows = FX.images(spark, d).withColumn("fused", M.union_nms(F.col("preds"), 0.5))
    rows = rows.withColumn("match", M.union_match(F.col("preds"), 0.5, F.col("gts"))).select("img", F.explode("gts").alias("g"), "fused", "match")
    rows = rows.withColumn("m", F.get(F.filter("match", lambda m: (m["j"] == F.col("g.j")) & (m["conf"] >= REPORT)), F.lit(0)))
    models = F.get(F.filter("fused", lambda k: k["i"] == F.col("m.i")), F.lit(0))["models"]
    return rows.select("img", F.col("g.j").alias("gt_index"), F.coalesce(F.array_join(F.transform(models, lambda m: m.cast("string")), ";"), F.lit("")).alias("contributors"), F.coalesce("m.conf", F.lit(0.0)).alias("confidence"), _q9(F.coalesce("m.iou", F.lit(0.0))).alias("iou"))


def nms_audit(spark, d):
    """Every prediction with whether suppression keeps it and the first kept one that suppresses it."""
    rows = FX.images(spark, d).select("img", F.explode(M.nms_audit(F.col("preds"), 0.5)).alias("a"))
    return rows.select("img", F.col("a.i").alias("pred_index"), F.col("a.by").isNull().alias("kept"), F.col("a.by").alias("suppressed_by"))


def capped_union(spark, d):
    """Suppression that keeps at most three boxes of an image, the most confident."""
    kept = FX.images(spark, d).select("img", M.union_nms(F.col("preds"), 0.5, cap=3).alias("k"))
    return kept.select("img", F.size("k").alias("kept"), F.array_join(F.transform("k", lambda k: k["i"].cast("string")), ";").alias("indices")).where("kept > 0")


# ---------------------------------------------------------------- strategies
def strategy_matrix(spark, d):
    """Per object: found by all, by none, an advantage of the first strategy, rescues by the others and how many."""
    h = _strategy_hits(spark, d)
    r1, r2 = ~F.col("s0") & F.col("s1"), ~F.col("s0") & F.col("s2")
    return h.select("img", "gt_index", (F.col("s0") & F.col("s1") & F.col("s2")).alias("all_success"), (~F.col("s0") & ~F.col("s1") & ~F.col("s2")).alias("all_fail"), (F.col("s0") & (~F.col("s1") | ~F.col("s2"))).alias("base_advantage"),
                    (r1 | r2).alias("alternative_rescue"), r1.alias("rescue_1"), r2.alias("rescue_2"), (r1.cast("int") + r2.cast("int")).alias("rescues"))


def strategy_cells(spark, d):
    """Strategies by two bands of objects: counts, rates, differences, rescues, the best with ties, objects gained, and how far the evidence goes."""
    h = _strategy_hits(spark, d).where("img is not null")
    cell = F.concat_ws(" | ", F.when(F.col("area") <= 56, "small").otherwise("not_small"), F.when(F.col("gt_index") < 2, "first").otherwise("later"))
    out = h.groupBy("fold_id", cell.alias("cell")).agg(F.count("*").alias("n"), *[F.count_if(F.col(f"s{k}")).alias(f"tp_{k}") for k in range(3)], *[F.count_if(~F.col("s0") & F.col(f"s{k}")).alias(f"rescue_{k}") for k in (1, 2)])
    out = out.select("*", *[_q9(F.col(f"tp_{k}") / F.col("n")).alias(f"rate_{k}") for k in range(3)])
    top, gain = F.greatest("tp_0", "tp_1", "tp_2"), F.greatest("tp_1", "tp_2") - F.col("tp_0")
    note = F.when(F.col("n") < 5, "insufficient").when(gain <= 0, "no gain").when(gain <= 2, "1 to 2 objects").when(gain < 5, "3 to 4 objects").otherwise("pattern")
    return out.select("*", *[_q9(F.col(f"rate_{k}") - F.col("rate_0")).alias(f"minus_{k}") for k in (1, 2)], labels_that_hold({f"s{k}": F.col(f"tp_{k}") == top for k in range(3)}, sep=";").alias("best"), gain.alias("gain"), note.alias("note"))


# ---------------------------------------------------------------- resampled effects
def _drawn(spark, replicates: int, clusters: int = 60):
    """rep, cluster, times: how often a replicate draws a cluster."""
    rep = F.floor(F.col("id") / clusters)
    return spark.range(replicates * clusters).select(rep.alias("rep"), R.draw(rep, F.col("id") % clusters, clusters).alias("cluster")).groupBy("rep", "cluster").agg(F.count("*").alias("times"))


def _interval(c: str):
    return [F.round(F.percentile(c, F.lit(0.025)), 9).alias(f"{c}_low"), F.round(F.percentile(c, F.lit(0.975)), 9).alias(f"{c}_high")]


def bootstrap_effects(spark, d):
    """Intervals over resampled clusters of the difference in miss rates of two bins and of their corrected risk ratio; replicates with an empty bin are left out."""
    rows = X.object_outcomes(_matched(spark, d), REPORT)
    high, miss = F.col("gt_index") > 1, F.col("status") == "FN"
    per = rows.groupBy((F.col("img") % 60).alias("cluster")).agg(F.count_if(high & miss).alias("ha"), F.count_if(high).alias("hn"), F.count_if(~high & miss).alias("la"), F.count_if(~high).alias("ln"))
    per = _drawn(spark, 100).join(F.broadcast(per), "cluster").groupBy("rep").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in ("ha", "hn", "la", "ln")]).where("hn > 0 and ln > 0")  # 60 rows
    per = per.select((F.col("ha") / F.col("hn") - F.col("la") / F.col("ln")).alias("gap"), (((F.col("ha") + 0.5) / (F.col("hn") + 1)) / ((F.col("la") + 0.5) / (F.col("ln") + 1))).alias("risk"))
    return per.agg(F.count("*").alias("replicates"), *_interval("gap"), *_interval("risk"))


def bootstrap_median_difference(spark, d):
    """Interval over resampled clusters of the difference between the median confidence of misses and of found objects; replicates that lack either are left out."""
    rows = X.object_outcomes(_matched(spark, d), REPORT).where("confidence is not null")
    rows = rows.groupBy((F.col("img") % 60).alias("cluster"), "status", "confidence").agg(F.count("*").alias("n"))
    per = _drawn(spark, 40).join(rows, "cluster").withColumn("w", F.col("times") * F.col("n"))
    median = lambda s: F.percentile(F.when(F.col("status") == s, F.col("confidence")), F.lit(0.5), F.when(F.col("status") == s, F.col("w")).otherwise(1))
    per = per.groupBy("rep").agg((median("FN") - median("TP")).alias("difference")).where("difference is not null")
    return per.agg(F.count("*").alias("replicates"), *_interval("difference"))


def outcome_differences(spark, d):
    """Sizes of objects by outcome, all misses as one more group: quantiles, and the middle's distance from that of found ones."""
    rows = X.object_outcomes(_matched(spark, d), REPORT, "area").where("img is not null")
    named = F.when(F.col("status") == "TP", "TP").when(F.col("error_type") == "LOCALIZATION_FAILURE", F.col("error_type")).otherwise(F.concat(F.col("error_type"), F.lit("_FN")))
    groups = F.array_compact(F.array(named, F.when(F.col("status") == "FN", "FN_ALL")))
    per = rows.select("area", F.explode(groups).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"), *[_q9(S.quantile("area", q)).alias(n) for n, q in (("q05", 0.05), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q95", 0.95))])
    found = per.where("outcome = 'TP'").agg(F.max("median").alias("of_found"))
    return per.crossJoin(F.broadcast(found)).select("*", _q9(F.col("median") - F.col("of_found")).alias("difference"), _q9(F.col("q75") - F.col("q25")).alias("iqr")).drop("of_found")  # one row


def case_rows(spark, d):
    """Each miss with all conditions that hold for it and how many; an easy one holds none and is large."""
    rows = X.object_outcomes(_matched(spark, d), REPORT, "area").where("status = 'FN' and img is not null").withColumn("area", F.col("area").cast("int"))
    flags = {"small": F.col("area") <= 49, "later": F.col("gt_index") > 1, "weak": F.coalesce(F.col("confidence") < 0.1, F.lit(False)), "far": F.coalesce(F.col("iou") < 0.1, F.lit(False))}
    rows = rows.withColumn("held", F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items()])))
    rows = rows.withColumn("held", F.when((F.size("held") == 0) & (F.col("area") > 64), F.array(F.lit("easy"))).otherwise(F.col("held")))
    placed = N.numbered(rows.withColumn("count", F.size("held")), [], [F.desc("count"), F.asc("area"), F.asc("img"), F.asc("gt_index")], "place", "of")
    return placed.select("img", "gt_index", "fold_id", "error_type", "area", F.when(F.col("count") == 0, "other").otherwise(F.array_join("held", "|")).alias("conditions"), "count", "place")


def top_cases(spark, d):
    """The twelve first misses: most conditions, then the smallest."""
    return case_rows(spark, d).where("place <= 12")


# ---------------------------------------------------------------- sessions, copies, folds
def isolated_sessions(spark, d):
    """Gap sessions of a user's day; events without a usable time are sessions of their own."""
    e = read(spark, d, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), (F.col("event_id") % 17 == 0).alias("isolated"))
    timed = N.gap_sessions(e.where(~F.col("isolated")), ["user_id", "day"], "ts", "event_id", list(LIMITS)).groupBy("limit_s", "user_id", "day", "session").agg(F.count("*").alias("size")).select("limit_s", "size", F.lit(False).alias("isolated"))
    alone = X.grid(e.where("isolated").select("isolated"), [float(x) for x in LIMITS], "limit_s").select(F.col("limit_s").cast("int").alias("limit_s"), F.lit(1).cast("long").alias("size"), "isolated")
    return timed.unionByName(alone).groupBy("limit_s").agg(F.count("*").alias("sessions"), F.count_if("isolated").alias("isolated"), F.count_if(F.col("size") == 1).alias("single"), F.max("size").alias("largest"), F.sum("size").alias("events"))


def hash_conflicts(spark, d):
    """Documents of one name (length and language): collapsed if all bytes agree, blocked if they differ."""
    doc = read(spark, d, "documents").select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    per = doc.groupBy("lang", "chars", "sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).groupBy("lang", "chars").agg(F.sum("n").alias("files"), F.count("*").alias("hashes"), F.min("first").alias("first"))
    status = F.when(F.col("hashes") > 1, "BLOCKED").when(F.col("files") > 1, "COLLAPSED").otherwise("UNIQUE")
    return per.select("lang", "chars", "files", status.alias("status"), F.when(F.col("hashes") == 1, F.col("first")).alias("canonical"), F.when(F.col("hashes") > 1, F.col("hashes")).otherwise(1).alias("logical"))


def logistic_stability(spark, d):
    """Penalised logistic coefficients of three features, and how often their signs hold over resampled clusters."""
    li = read(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_orderkey") % 60).alias("cluster"))
    return R.logistic_stability(li, ["quantity", "discount", "tax"], "y", "cluster", 60)


FEATURES = ("l_quantity", "l_discount", "l_tax", "l_extendedprice")


def object_balance(spark, d):
    """Four folds against all rows, by feature: quantiles, standardised difference of means, largest gap of the distribution functions."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in FEATURES]))
    long = read(spark, d, "lineitem").select((F.col("l_orderkey") % 4).cast("int").alias("fold"), each.alias("x")).select("fold", "x.*")
    whole = long.groupBy("feature").agg(F.avg("v").alias("overall_mean"), F.stddev_pop("v").alias("overall_std"))
    per = long.groupBy("feature", "fold").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    places = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    ks = S.ks_to_all(long, ["feature"], "fold", 4, "v", list(places.values()))
    ks = ks.select("feature", "fold", "ks", *[F.round(F.col("quantiles")[k], 6).alias(n) for k, n in enumerate(places)])
    out = per.join(F.broadcast(whole), "feature").join(F.broadcast(ks), ["feature", "fold"])  # a row for each feature, and for each of its folds
    return out.select("feature", "fold", "n", F.round("mean", 5).alias("mean"), "q10", "q25", "median", "q75", "q90", F.round(ratio(F.col("mean") - F.col("overall_mean"), F.col("overall_std")), 6).alias("smd"), _q9("ks").alias("ks"))


#: Weights of the families of tokens.
WEIGHTS = {"sample": 5.0, "priority": 2.0, "status": 1.5}


def vector_folds(spark, d):
    """Folds for groups of customers such that orders, their priorities and statuses are even, the rarest and largest groups first."""
    o = read(spark, d, "orders").withColumn("group_id", F.col("o_custkey") % 130)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), t.alias("token")) for f, t in (("sample", F.lit("ALL")), ("priority", F.col("o_orderpriority")), ("status", F.col("o_orderstatus")))]))
    tokens = o.select("group_id", each.alias("x")).groupBy("group_id", "x.family", "x.token").agg(F.count("*").alias("n"))
    size = tokens.where("family = 'sample'").select("group_id", F.col("n").alias("size"))
    return G.assign_vector_folds(tokens.join(size, "group_id"), WEIGHTS)


# ---------------------------------------------------------------- tiles
def _tiles(patch: int, stride: int):
    starts = tile_starts(F.lit(64), patch, stride)
    return F.flatten(F.transform(starts, lambda x: F.transform(starts, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def tile_audit(spark, d):
    """Objects in the tiles that meet them: local and normalised corners, retained share, whole or cut, and whether any tile holds the object whole."""
    gt = FX.ground_truth(spark, d).withColumn("t", F.explode(_tiles(32, 24)))
    lo = lambda c, t: F.greatest(F.col(c), F.col(f"t.{t}")) - F.col(f"t.{t}")
    hi = lambda c, t: F.least(F.col(c), F.col(f"t.{t}") + 32) - F.col(f"t.{t}")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    rows = gt.select("img", "gt_index", F.col("t.x").alias("tx"), F.col("t.y").alias("ty"), area.alias("area"), lo("x0", "x").alias("lx0"), lo("y0", "y").alias("ly0"), hi("x1", "x").alias("lx1"), hi("y1", "y").alias("ly1")).where("lx1 > lx0 and ly1 > ly0")
    kept = (F.col("lx1") - F.col("lx0")) * (F.col("ly1") - F.col("ly0"))
    rows = rows.select("*", _q9(kept / F.col("area")).alias("retained"), (kept == F.col("area")).alias("whole"), *[_q9((F.col(a) + F.col(b)) / 64).alias(n) for n, a, b in (("ncx", "lx0", "lx1"), ("ncy", "ly0", "ly1"))])
    return rows.drop("area")


def _held(p: int, s: int):
    """How many tiles hold a box whole, and how many there are."""
    (x, _, n), (y, _, m) = tiles_along(F.col("x0"), F.col("x1"), p, s), tiles_along(F.col("y0"), F.col("y1"), p, s)
    return x * y, n * m


def tile_checks(spark, d):
    """Objects that no tile of three sizes holds whole: a set of tiles passes if there are none."""
    flags = FX.ground_truth(spark, d).select(*[(_held(p, s)[0] > 0).alias(f"tiles_{p}_{s}") for p, s in ((24, 12), (32, 24), (12, 12))])
    return K.status(*[K.holds(flags, c, c) for c in flags.columns])


def coverage_grid(spark, d):
    """Tile size, overlap and subgroup: share of objects held whole, by none and by several tiles, mean number of such tiles, tiles of an image."""
    later = (F.col("gt_index") > 1).alias("later")
    gt = FX.ground_truth(spark, d).groupBy(*SIDES, later).agg(F.count("*").alias("many"))  # equal boxes are one row
    settings = [(p, o, *_held(p, max(1, round(p * (1 - o))))) for p in (16, 24, 32) for o in (0.0, 0.25, 0.5)]
    held = [F.struct(F.lit(p).alias("patch"), F.lit(o).alias("overlap"), F.lit(n).alias("tiles"), h.alias("held")) for p, o, h, n in settings]
    groups = F.array_compact(F.array(F.lit("ALL"), F.when((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= 56, "SMALL"), F.when(F.col("later"), "LATER")))
    rows = gt.select("many", groups.alias("groups"), F.explode(F.array(*held)).alias("h")).select("many", F.explode("groups").alias("subgroup"), "h.*")
    share = lambda c: _q9(F.sum(c.cast("int") * F.col("many")) / F.sum("many"))
    return rows.groupBy("patch", "overlap", "subgroup").agg(F.sum("many").alias("objects"), share(F.col("held") >= 1).alias("contained"), share(F.col("held") == 0).alias("crossing"), share(F.col("held") >= 2).alias("duplicate"), share(F.col("held")).alias("mean_held"), F.max("tiles").alias("tiles"))


def tile_remap(spark, d):
    """Boxes seen in tiles, each a little to the left in tiles of the right side, moved to the image, cut at its edge and fused: found, kept, and copies that went."""
    rows = FX.images(spark, d, 0).withColumn("tiles", F.transform(_tiles(32, 24), lambda t, k: F.struct(k.alias("k"), t["x"].alias("x"), t["y"].alias("y"))))
    inside = lambda t: F.filter("preds", lambda p: (p["x0"] >= t["x"]) & (p["y0"] >= t["y"]) & (p["x1"] <= t["x"] + 32) & (p["y1"] <= t["y"] + 32))
    cut = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(64.0), v))
    local = F.flatten(F.transform("tiles", lambda t: F.transform(inside(t), lambda p: F.struct((t["k"] * 1000 + p["i"]).cast("int").alias("i"), p["conf"].alias("conf"), t["x"].alias("tx"), t["y"].alias("ty"), (p["x0"] - t["x"] - F.when(t["x"] > 0, 1).otherwise(0)).alias("x0"), (p["y0"] - t["y"]).alias("y0"), (p["x1"] - t["x"] - F.when(t["x"] > 0, 1).otherwise(0)).alias("x1"), (p["y1"] - t["y"]).alias("y1")))))
    rows = rows.withColumn("local", local)
    source = F.transform("local", lambda p: F.struct(p["i"].alias("i"), p["conf"].alias("conf"), cut(p["x0"] + p["tx"]).alias("x0"), cut(p["y0"] + p["ty"]).alias("y0"), cut(p["x1"] + p["tx"]).alias("x1"), cut(p["y1"] + p["ty"]).alias("y1")))
    rows = rows.withColumn("audit", M.nms_audit(source, 0.6)).select("img", F.explode(F.filter(F.array("audit"), lambda a: F.size(a) > 0)).alias("audit"))
    kept = F.filter("audit", lambda a: a["by"].isNull())
    return rows.select("img", F.size("audit").alias("found"), F.size(kept).alias("kept"), F.array_join(F.transform(kept, lambda a: a["i"].cast("string")), ";").alias("indices"))


# ---------------------------------------------------------------- geometry
def letterbox(spark, d):
    """Sides of boxes of a 64 by 64 image in squares of six sizes, and four limits."""
    g = FX.ground_truth(spark, d).withColumn("target", F.explode(F.array(*[F.lit(t) for t in (16, 24, 32, 48, 64, 96)])))
    scale = F.col("target") / 64
    side = lambda a, b: (F.col(b) - F.col(a)) * scale
    rows = g.select("img", "gt_index", "target", _q9(side("x0", "x1")).alias("width"), _q9(side("y0", "y1")).alias("height"))
    return rows.withColumn("least", F.least("width", "height")).select("*", *[(F.col("least") < n).alias(f"below_{n}") for n in (2, 4, 8, 16)])


def inverse_augments(spark, d):
    """Boxes taken back from a mirrored image and from one scaled to 0.9 and padded: the same as before, but for cuts at the edge."""
    g = FX.ground_truth(spark, d)
    pad = F.lit(3)
    seen = {c: F.round(F.col(c) * 0.9 + pad) for c in SIDES}
    back = lambda c: _q9(F.greatest(F.lit(0.0), F.least(F.lit(64.0), (seen[c] - pad) / 0.9)))
    return g.select("img", "gt_index", (64 - (64 - F.col("x0"))).alias("flip_x0"), (64 - (64 - F.col("x1"))).alias("flip_x1"), *[back(c).alias(f"scale_{c}") for c in SIDES])


def edge_distances(spark, d):
    """Of each true box: distance to the nearest of four marks and of the image's centre, inside or outside, from the box's boundary."""
    g = FX.ground_truth(spark, d)
    out = lambda x, y: F.hypot(F.greatest(F.col("x0") - x, F.lit(0), x - (F.col("x1") - 1)).cast("double"), F.greatest(F.col("y0") - y, F.lit(0), y - (F.col("y1") - 1)).cast("double"))
    cx, cy = F.lit(32), F.lit(32)
    inside = (cx >= F.col("x0")) & (cx < F.col("x1")) & (cy >= F.col("y0")) & (cy < F.col("y1"))
    depth = F.least(cx - F.col("x0"), F.col("x1") - 1 - cx, cy - F.col("y0"), F.col("y1") - 1 - cy)
    return g.select("img", "gt_index", _q9(F.least(*[out(F.lit(x), F.lit(y)) for x, y in ((8, 8), (8, 56), (56, 8), (56, 56))])).alias("to_mark"), _q9(F.when(inside, depth).otherwise(out(cx, cy))).alias("to_boundary"), inside.alias("inside"))


def local_geometry(spark, d):
    """Pairs of boxes of the two models in an image that overlap: overlap, centres inside each other, distance of centres in diagonals, ratio of areas."""
    images = FX.images(spark, d).select("img", F.explode(F.filter("preds", _of_model(0))).alias("p"), F.filter("preds", _of_model(1)).alias("l"))
    rows = images.select("img", "p", F.explode("l").alias("q")).withColumn("iou", iou(F.col("p"), F.col("q"))).where("iou > 0")
    mid = lambda b: ((F.col(f"{b}.x0") + F.col(f"{b}.x1")) / 2, (F.col(f"{b}.y0") + F.col(f"{b}.y1")) / 2)
    holds = lambda b, c: (c[0] >= F.col(f"{b}.x0")) & (c[0] <= F.col(f"{b}.x1")) & (c[1] >= F.col(f"{b}.y0")) & (c[1] <= F.col(f"{b}.y1"))
    size = lambda b: (F.col(f"{b}.x1") - F.col(f"{b}.x0")) * (F.col(f"{b}.y1") - F.col(f"{b}.y0"))
    (px, py), (qx, qy) = mid("p"), mid("q")
    return rows.select("img", F.col("p.i").alias("a"), F.col("q.i").alias("b"), _q9("iou").alias("iou"), holds("p", (qx, qy)).alias("b_in_a"), holds("q", (px, py)).alias("a_in_b"),
                       _q9(F.hypot(px - qx, py - qy) / F.hypot(F.col("p.x1") - F.col("p.x0"), F.col("p.y1") - F.col("p.y0"))).alias("distance"), _q9(size("q") / size("p")).alias("area_ratio"))


QUERIES = [fusion_grid_paired, fused_contributors, nms_audit, capped_union, strategy_matrix, strategy_cells, bootstrap_effects, bootstrap_median_difference, outcome_differences, case_rows, top_cases, isolated_sessions, hash_conflicts, object_balance, vector_folds, logistic_stability,
           tile_audit, tile_checks, coverage_grid, tile_remap, letterbox, inverse_augments, edge_distances, local_geometry]

_REST = match_sql()[match_sql().index(",\ngl AS"):]
_FOLD = lambda least: _NMS_FOLD.format(iou=iou_sql("acc[n]", "p"), least=least)
_STRUCT = "struct_pack(i := pred_index, conf := conf, model := {m}, x0 := x0::DOUBLE, y0 := y0::DOUBLE, x1 := x1::DOUBLE, y1 := y1::DOUBLE)"
_FUSED = f", fused AS (SELECT img, fold_id, unnest({_FOLD('0.5')}) AS k FROM (SELECT img, fold_id, list({_STRUCT.format(m='model')} ORDER BY conf DESC, model, pred_index) AS preds FROM fx_pred0 GROUP BY img, fold_id)), fx_gt AS (SELECT * FROM fx_gt0), fx_pred AS (SELECT img, fold_id, k.i AS pred_index, k.conf AS conf, k.x0 AS x0, k.y0 AS y0, k.x1 AS x1, k.y1 AS y1 FROM fused)"
_AREAS = "area AS (SELECT img, gt_index, (x1 - x0) * (y1 - y0) AS area FROM fx_gt)"
_AUDIT = lambda least: f"""list_reduce(preds, lambda acc, p: list_transform([list_filter(acc.kept, lambda k: {iou_sql('k', 'p')} >= {least})[1].i], lambda w: struct_pack(kept := CASE WHEN w IS NULL THEN list_append(acc.kept, struct_pack(i := p.i, x0 := p.x0, y0 := p.y0, x1 := p.x1, y1 := p.y1)) ELSE acc.kept END, audit := list_append(acc.audit, struct_pack(i := p.i, w := w))))[1],
 struct_pack(kept := []::STRUCT(i INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[], audit := []::STRUCT(i INT, w INT)[])).audit"""  # noqa: E731
_TILE = lambda p, s: f"(SELECT x, y FROM {_VALUES([(x,) for x in _starts(p, s)])} a(x), {_VALUES([(x,) for x in _starts(p, s)])} b(y))"
_WHOLE = lambda p: f"x0 >= t.x AND y0 >= t.y AND x1 <= t.x + {p} AND y1 <= t.y + {p}"


def _starts(patch: int, stride: int) -> list[int]:
    return sorted({*range(0, 64 - patch + 1, stride), 64 - patch})


ORACLES = {
    "fusion_grid_paired": _settled_sql(_BASE + f""", grid AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{n}', {least}::DOUBLE, {list(COMBINATIONS[n])})" for k, (n, least) in enumerate(FUSIONS))}) g(setting, combination, nms, members)),
mem AS (SELECT * EXCLUDE (model), CASE WHEN model = 1 AND pred_index % 2 = 1 THEN 2 ELSE model END AS model FROM fx_pred0),
pn AS (SELECT img * 100 + setting AS img, fold_id, nms, list({_STRUCT.format(m='model')} ORDER BY conf DESC, model, pred_index) AS preds FROM mem JOIN grid ON list_contains(members, model) GROUP BY ALL),
fused AS (SELECT img, fold_id, unnest({_FOLD('nms')}) AS k FROM pn)""", len(FUSIONS), "SELECT img, fold_id, k.i AS pred_index, k.conf AS conf, k.x0 AS x0, k.y0 AS y0, k.x1 AS x1, k.y1 AS y1 FROM fused", f"SELECT combination, nms, tp, fp, fn, rescued, lost, {_RATIOS} FROM e JOIN grid USING (setting)", FUSIONS.index(("A", 0.7))),
    "fused_contributors": _BASE + _FUSED + _REST + f""", o AS (SELECT img, g.j AS gt_index, list_filter(m, lambda x: x.j = g.j AND x.conf >= {REPORT})[1] AS h FROM (SELECT *, unnest(gts) AS g FROM matched))
SELECT o.img, gt_index, coalesce(array_to_string(f.k.models, ';'), '') AS contributors, coalesce(h.conf, 0) AS confidence, round(coalesce(h.iou, 0), 9) AS iou FROM o LEFT JOIN fused f ON f.img = o.img AND f.k.i = h.i""",
    "nms_audit": FX.FX + f", pl AS (SELECT img, list({_STRUCT.format(m='model')} ORDER BY conf DESC, pred_index) AS preds FROM fx_pred GROUP BY img) SELECT img, a.i AS pred_index, a.w IS NULL AS kept, a.w AS suppressed_by FROM (SELECT img, unnest({_AUDIT('0.5')}) AS a FROM pl)",
    "capped_union": FX.FX + f", pl AS (SELECT img, list({_STRUCT.format(m='model')} ORDER BY conf DESC, model, pred_index) AS preds FROM fx_pred GROUP BY img), k AS (SELECT img, ({_FOLD('0.5')})[1:3] AS k FROM pl) SELECT img, len(k)::INT AS kept, array_to_string(list_transform(k, lambda x: x.i), ';') AS indices FROM k",
    "strategy_matrix": _strategies_sql("SELECT img, gt_index, s0 AND s1 AND s2 AS all_success, NOT s0 AND NOT s1 AND NOT s2 AS all_fail, s0 AND NOT (s1 AND s2) AS base_advantage, NOT s0 AND (s1 OR s2) AS alternative_rescue, NOT s0 AND s1 AS rescue_1, NOT s0 AND s2 AS rescue_2, (NOT s0 AND s1)::INT + (NOT s0 AND s2)::INT AS rescues FROM hits"),
    "strategy_cells": _strategies_sql(f""", {_AREAS}, c AS (SELECT fold_id, CASE WHEN area <= 56 THEN 'small' ELSE 'not_small' END || ' | ' || CASE WHEN gt_index < 2 THEN 'first' ELSE 'later' END AS cell, count(*) AS n, {', '.join(f'count_if(s{k})::BIGINT AS tp_{k}' for k in range(3))}, {', '.join(f'count_if(NOT s0 AND s{k})::BIGINT AS rescue_{k}' for k in (1, 2))} FROM hits JOIN area USING (img, gt_index) GROUP BY ALL),
r AS (SELECT *, {', '.join(f'round(tp_{k} / n::DOUBLE, 9) AS rate_{k}' for k in range(3))}, greatest(tp_0, tp_1, tp_2) AS top, greatest(tp_1, tp_2) - tp_0 AS gain FROM c)
SELECT * EXCLUDE (top), {', '.join(f'round(rate_{k} - rate_0, 9) AS minus_{k}' for k in (1, 2))}, array_to_string(list_filter([{', '.join(f"CASE WHEN tp_{k} = top THEN 's{k}' END" for k in range(3))}], lambda x: x IS NOT NULL), ';') AS best,
 CASE WHEN n < 5 THEN 'insufficient' WHEN gain <= 0 THEN 'no gain' WHEN gain <= 2 THEN '1 to 2 objects' WHEN gain < 5 THEN '3 to 4 objects' ELSE 'pattern' END AS note FROM r"""),
    "bootstrap_effects": _OUTCOMES + f""", c AS (SELECT img % 60 AS cluster, count_if(gt_index > 1 AND status = 'FN') AS ha, count_if(gt_index > 1) AS hn, count_if(gt_index <= 1 AND status = 'FN') AS la, count_if(gt_index <= 1) AS ln FROM outcomes GROUP BY 1), d AS (SELECT i // 60 AS rep, {_DRAW} AS cluster FROM range(100 * 60) t(i)),
s AS (SELECT sum(ha)::DOUBLE AS ha, sum(hn)::DOUBLE AS hn, sum(la)::DOUBLE AS la, sum(ln)::DOUBLE AS ln FROM d JOIN c USING (cluster) GROUP BY rep HAVING sum(hn) > 0 AND sum(ln) > 0), r AS (SELECT ha / hn - la / ln AS gap, ((ha + 0.5) / (hn + 1)) / ((la + 0.5) / (ln + 1)) AS risk FROM s)
SELECT count(*) AS replicates, round(quantile_cont(gap, 0.025), 9) AS gap_low, round(quantile_cont(gap, 0.975), 9) AS gap_high, round(quantile_cont(risk, 0.025), 9) AS risk_low, round(quantile_cont(risk, 0.975), 9) AS risk_high FROM r""",
    "bootstrap_median_difference": _OUTCOMES + f""", o AS (SELECT img % 60 AS cluster, status, confidence FROM outcomes WHERE confidence IS NOT NULL), d AS (SELECT i // 60 AS rep, {_DRAW} AS cluster FROM range(40 * 60) t(i)),
r AS (SELECT quantile_cont(confidence, 0.5) FILTER (WHERE status = 'FN') - quantile_cont(confidence, 0.5) FILTER (WHERE status = 'TP') AS difference FROM d JOIN o USING (cluster) GROUP BY rep) SELECT count(difference) AS replicates, round(quantile_cont(difference, 0.025), 9) AS difference_low, round(quantile_cont(difference, 0.975), 9) AS difference_high FROM r""",
    "outcome_differences": _OUTCOMES + f""", {_AREAS}, r AS (SELECT area::DOUBLE AS area, unnest(list_filter([CASE WHEN status = 'TP' THEN 'TP' WHEN error_type = 'LOCALIZATION_FAILURE' THEN error_type ELSE error_type || '_FN' END, CASE WHEN status = 'FN' THEN 'FN_ALL' END], lambda x: x IS NOT NULL)) AS outcome FROM outcomes JOIN area USING (img, gt_index)),
p AS (SELECT outcome, count(*) AS n, {', '.join(f'round(quantile_cont(area, {q}), 9) AS {n}' for n, q in (('q05', 0.05), ('q25', 0.25), ('median', 0.5), ('q75', 0.75), ('q95', 0.95)))} FROM r GROUP BY outcome) SELECT *, round(median - (SELECT median FROM p WHERE outcome = 'TP'), 9) AS difference, round(q75 - q25, 9) AS iqr FROM p""",
    "case_rows": _OUTCOMES + f""", {_AREAS}, r AS (SELECT *, list_filter([CASE WHEN area <= 49 THEN 'small' END, CASE WHEN gt_index > 1 THEN 'later' END, CASE WHEN confidence < 0.1 THEN 'weak' END, CASE WHEN iou < 0.1 THEN 'far' END], lambda x: x IS NOT NULL) AS l FROM outcomes JOIN area USING (img, gt_index) WHERE status = 'FN'),
h AS (SELECT *, CASE WHEN len(l) = 0 AND area > 64 THEN ['easy'] ELSE l END AS held FROM r)
SELECT img, gt_index, fold_id, error_type, area, CASE WHEN len(held) = 0 THEN 'other' ELSE array_to_string(held, '|') END AS conditions, len(held)::INT AS "count", row_number() OVER (ORDER BY len(held) DESC, area, img, gt_index) AS place FROM h""",
    "isolated_sessions": f"""WITH e AS (SELECT event_id, user_id, ts, ts::DATE AS day, event_id % 17 = 0 AS isolated FROM events), g AS (SELECT user_id, day, event_id, ts, date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 AS gap FROM e WHERE NOT isolated WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)),
s AS (SELECT limit_s, user_id, day, sum(CASE WHEN gap > limit_s THEN 1 ELSE 0 END) OVER (PARTITION BY limit_s, user_id, day ORDER BY ts, event_id) AS session FROM g, {_VALUES([(x,) for x in LIMITS])} t(limit_s)), z AS (SELECT limit_s, count(*) AS size, false AS isolated FROM s GROUP BY limit_s, user_id, day, session UNION ALL SELECT limit_s, 1, true FROM e, {_VALUES([(x,) for x in LIMITS])} t(limit_s) WHERE isolated)
SELECT limit_s, count(*) AS sessions, count_if(isolated)::BIGINT AS isolated, count_if(size = 1)::BIGINT AS single, max(size) AS largest, sum(size)::BIGINT AS events FROM z GROUP BY limit_s""",
    "hash_conflicts": "WITH x AS (SELECT lang, length(coalesce(text, ''))::INT AS chars, count(*) AS files, count(DISTINCT coalesce(text, '')) AS hashes, min(doc_id) AS f FROM documents GROUP BY ALL) SELECT lang, chars, files, CASE WHEN hashes > 1 THEN 'BLOCKED' WHEN files > 1 THEN 'COLLAPSED' ELSE 'UNIQUE' END AS status, CASE WHEN hashes = 1 THEN f END AS canonical, CASE WHEN hashes > 1 THEN hashes ELSE 1 END AS logical FROM x",
    "object_balance": f"""WITH l AS (SELECT (l_orderkey % 4)::INT AS fold, unnest([{', '.join(f"struct_pack(f := '{f}', v := {f}::DOUBLE)" for f in FEATURES)}]) AS x FROM lineitem), k AS (SELECT fold, x.f AS feature, x.v AS v FROM l), o AS (SELECT feature, avg(v) AS om, stddev_pop(v) AS os FROM k GROUP BY feature),
c AS (SELECT feature, v, count(*) AS c_all, {', '.join(f'count_if(fold = {g}) AS c{g}' for g in range(4))} FROM k GROUP BY feature, v), cum AS (SELECT feature, {', '.join(f'sum({n}) OVER (PARTITION BY feature ORDER BY v) / sum({n}) OVER (PARTITION BY feature)::DOUBLE AS {n}' for n in ('c_all', 'c0', 'c1', 'c2', 'c3'))} FROM c),
ks AS (SELECT feature, fold, max(abs(s - c_all)) AS ks FROM (SELECT feature, c_all, unnest([0, 1, 2, 3]) AS fold, unnest([c0, c1, c2, c3]) AS s FROM cum) GROUP BY feature, fold)
SELECT k.feature, k.fold, count(v) AS n, round(avg(v), 5) AS mean, {', '.join(f'round(quantile_cont(v, {q}), 6) AS {n}' for n, q in (('q10', 0.1), ('q25', 0.25), ('median', 0.5), ('q75', 0.75), ('q90', 0.9)))}, round((avg(v) - any_value(om)) / any_value(os), 6) AS smd, round(any_value(ks), 9) AS ks FROM k JOIN o USING (feature) JOIN ks ON ks.feature = k.feature AND ks.fold = k.fold GROUP BY k.feature, k.fold""",
    "tile_audit": FX.FX + f""", c AS (SELECT img, gt_index, t.x AS tx, t.y AS ty, (x1 - x0) * (y1 - y0) AS area, greatest(x0, t.x) - t.x AS lx0, greatest(y0, t.y) - t.y AS ly0, least(x1, t.x + 32) - t.x AS lx1, least(y1, t.y + 32) - t.y AS ly1 FROM fx_gt, {_TILE(32, 24)} t)
SELECT * EXCLUDE (area), round((lx1 - lx0) * (ly1 - ly0) / area::DOUBLE, 9) AS retained, (lx1 - lx0) * (ly1 - ly0) = area AS whole, round((lx0 + lx1) / 64::DOUBLE, 9) AS ncx, round((ly0 + ly1) / 64::DOUBLE, 9) AS ncy FROM c WHERE lx1 > lx0 AND ly1 > ly0""",
    "tile_checks": FX.FX + ", v AS (" + " UNION ALL ".join(f"SELECT 'tiles_{p}_{s}' AS \"check\", count_if(NOT EXISTS (SELECT 1 FROM {_TILE(p, s)} t WHERE {_WHOLE(p)}))::BIGINT AS violations FROM fx_gt" for p, s in ((24, 12), (32, 24), (12, 12))) + ") SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v",
    "coverage_grid": FX.FX + ", h AS (" + " UNION ALL ".join(f"SELECT img, gt_index, any_value((x1 - x0) * (y1 - y0)) AS area, {p} AS patch, {o}::DOUBLE AS overlap, count(*)::INT AS tiles, count_if({_WHOLE(p)}) AS held FROM fx_gt, {_TILE(p, max(1, round(p * (1 - o))))} t GROUP BY img, gt_index" for p in (16, 24, 32) for o in (0.0, 0.25, 0.5)) + """),
g AS (SELECT *, unnest(list_filter(['ALL', CASE WHEN area <= 56 THEN 'SMALL' END, CASE WHEN gt_index > 1 THEN 'LATER' END], lambda x: x IS NOT NULL)) AS subgroup FROM h)
SELECT patch, overlap, subgroup, count(*) AS objects, round(avg((held >= 1)::INT), 9) AS contained, round(avg((held = 0)::INT), 9) AS crossing, round(avg((held >= 2)::INT), 9) AS duplicate, round(avg(held), 9) AS mean_held, max(tiles) AS tiles FROM g GROUP BY ALL""",
    "tile_remap": FX.FX + f""", tl AS (SELECT x, y, (row_number() OVER (ORDER BY x, y) - 1)::INT AS k FROM {_TILE(32, 24)}), s AS (SELECT img, t.k * 1000 + pred_index AS i, conf, CASE WHEN t.x > 0 THEN 1 ELSE 0 END AS o, x0, y0, x1, y1 FROM fx_pred, tl t WHERE model = 0 AND {_WHOLE(32)}),
pl AS (SELECT img, list(struct_pack(i := i::INT, conf := conf, x0 := greatest(0, least(64, x0 - o))::DOUBLE, y0 := greatest(0, least(64, y0))::DOUBLE, x1 := greatest(0, least(64, x1 - o))::DOUBLE, y1 := greatest(0, least(64, y1))::DOUBLE) ORDER BY conf DESC, i) AS preds FROM s GROUP BY img), a AS (SELECT img, {_AUDIT('0.6')} AS a FROM pl)
SELECT img, len(a)::INT AS found, len(list_filter(a, lambda x: x.w IS NULL))::INT AS kept, array_to_string(list_transform(list_filter(a, lambda x: x.w IS NULL), lambda x: x.i), ';') AS indices FROM a""",
    "letterbox": FX.FX + ", s AS (SELECT img, gt_index, target, round((x1 - x0) * (target / 64::DOUBLE), 9) AS width, round((y1 - y0) * (target / 64::DOUBLE), 9) AS height FROM fx_gt, (VALUES (16), (24), (32), (48), (64), (96)) t(target)) SELECT *, least(width, height) AS least, " + ", ".join(f"least(width, height) < {n} AS below_{n}" for n in (2, 4, 8, 16)) + " FROM s",
    "inverse_augments": FX.FX + " SELECT img, gt_index, x0 AS flip_x0, x1 AS flip_x1, " + ", ".join(f"round(greatest(0.0::DOUBLE, least(64.0::DOUBLE, (round({c} * 0.9::DOUBLE + 3) - 3) / 0.9::DOUBLE)), 9) AS scale_{c}" for c in SIDES) + " FROM fx_gt",
    "edge_distances": FX.FX + ", m AS (SELECT g.*, min(sqrt(greatest(x0 - x, 0, x - (x1 - 1)) ** 2 + greatest(y0 - y, 0, y - (y1 - 1)) ** 2)) AS near FROM fx_gt g, (VALUES (8, 8), (8, 56), (56, 8), (56, 56)) p(x, y) GROUP BY ALL), c AS (SELECT *, 32 >= x0 AND 32 < x1 AND 32 >= y0 AND 32 < y1 AS inside FROM m) SELECT img, gt_index, round(near, 9) AS to_mark, round(CASE WHEN inside THEN least(32 - x0, x1 - 33, 32 - y0, y1 - 33)::DOUBLE ELSE sqrt(greatest(x0 - 32, 0, 33 - x1) ** 2 + greatest(y0 - 32, 0, 33 - y1) ** 2) END, 9) AS to_boundary, inside FROM c",
    "local_geometry": FX.FX + f""", j AS (SELECT p.img, p.pred_index AS a, q.pred_index AS b, {iou_sql('p', 'q')} AS iou, (p.x0 + p.x1) / 2.0::DOUBLE AS px, (p.y0 + p.y1) / 2.0::DOUBLE AS py, (q.x0 + q.x1) / 2.0::DOUBLE AS qx, (q.y0 + q.y1) / 2.0::DOUBLE AS qy, p, q FROM fx_pred p JOIN fx_pred q ON p.img = q.img AND p.model = 0 AND q.model = 1)
SELECT img, a, b, round(iou, 9) AS iou, qx BETWEEN p.x0 AND p.x1 AND qy BETWEEN p.y0 AND p.y1 AS b_in_a, px BETWEEN q.x0 AND q.x1 AND py BETWEEN q.y0 AND q.y1 AS a_in_b, round(sqrt((px - qx) ** 2 + (py - qy) ** 2) / sqrt(((p.x1 - p.x0) ** 2 + (p.y1 - p.y0) ** 2)::DOUBLE), 9) AS distance, round((q.x1 - q.x0) * (q.y1 - q.y0) / ((p.x1 - p.x0) * (p.y1 - p.y0))::DOUBLE, 9) AS area_ratio FROM j WHERE iou > 0""",
}
ORACLES["top_cases"] = f"SELECT * FROM ({ORACLES['case_rows']}) WHERE place <= 12"
