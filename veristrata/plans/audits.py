"""Audits, comparisons and case tables over the derived tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions.exprs import iou, ratio
from veristrata.operators import checks as K
from veristrata.operators import metrics as X
from veristrata.operators import stats as S
from veristrata.operators import windows as N
from veristrata.operators.groups import _written
from veristrata.plans import fixtures as FX
from veristrata.plans.detection import _OUTCOMES, OVERLAPS, REPORT, STEPS, _ap_sql, _matched, _strategies_sql, _strategy_hits, grid_sql, iou_sql, match_sql, sweep_sql
from veristrata.plans.fixtures import read


def _q9(c):
    return F.round(c, 9)


def _gt_area(spark, d):
    return FX.ground_truth(spark, d).select("img", "gt_index", "fold_id", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


# ---------------------------------------------------------------- metrics
def det_map_mean(spark, d):
    """The mean of average precision at ten overlaps, and the one at 0.5."""
    ap = X.average_precision(FX.images(spark, d), OVERLAPS)
    return ap.agg(_q9(F.avg("ap")).alias("map50_95"), _q9(F.max(F.when(F.col("overlap_id") == 0, F.col("ap")))).alias("ap50"))


def size_band_recall(spark, d):
    """Recall of three size bands at three thresholds."""
    per = _matched(spark, d).select("img", F.explode("gts").alias("g"), "match")
    hit = F.array_max(F.transform(F.filter("match", lambda m: m["j"] == F.col("g.j")), lambda m: m["conf"]))
    area = (F.col("g.x1") - F.col("g.x0")) * (F.col("g.y1") - F.col("g.y0"))
    band = F.when(area < 56, "SMALL").when(area < 80, "MEDIUM").otherwise("LARGE")
    rows = X.grid(per.select(band.alias("band"), hit.alias("conf")), [0.1, REPORT, 0.5])
    found = F.count_if(F.col("conf") >= F.col("threshold"))
    return rows.groupBy("band", "threshold_id", "threshold").agg(F.count("*").alias("n"), found.alias("tp"), _q9(ratio(found, F.count("*"))).alias("recall"))


def pareto_steps(spark, d):
    """Steps of the sweep in order of misses, then false positives, then threshold, and whether another step is no worse in both and better in one."""
    s = _written(X.sweep(_matched(spark, d), STEPS).select("threshold_id", "fn", "fp"))  # both sides of the join read it
    a, b = s.alias("a"), s.alias("b")  # one row for each step
    better = (F.col("b.fn") <= F.col("a.fn")) & (F.col("b.fp") <= F.col("a.fp")) & ((F.col("b.fn") < F.col("a.fn")) | (F.col("b.fp") < F.col("a.fp")))
    out = a.join(b, better, "left").groupBy("a.threshold_id", "a.fn", "a.fp").agg((F.count("b.fn") > 0).alias("dominated"))
    return out.withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("fn", "fp", F.desc("threshold_id"))))


def strategy_comparison(spark, d):
    """Per strategy: recall in all and in two subgroups; objects rescued, rescued by it alone, and lost against the first one."""
    h = _strategy_hits(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), F.col(f"s{k}").alias("hit"), *[F.col(f"s{j}").alias(f"o{i}") for i, j in enumerate([x for x in (1, 2) if x != k])][:1]) for k in (1, 2)])).alias("x")
    h = h.select("gt_index", "s0", each).select("gt_index", "s0", "x.*")
    share = lambda c: _q9(ratio(F.count_if(F.col("hit") & c), F.count_if(c)))
    return h.groupBy("strategy").agg(share(F.lit(True)).alias("recall"), share(F.col("gt_index") == 0).alias("recall_first"), share(F.col("gt_index") > 1).alias("recall_later"),
                                     F.count_if(F.col("hit") & ~F.col("s0")).alias("rescued"), F.count_if(F.col("hit") & ~F.col("s0") & ~F.col("o0")).alias("alone"), F.count_if(~F.col("hit") & F.col("s0")).alias("lost"))


def rescue_overlap_pairs(spark, d):
    """Jaccard index of the rescued objects for every pair of strategies; null where both rescue nothing."""
    h = _strategy_hits(spark, d)
    missed = X.grid(h.select((~F.col("s0") & F.col("s1")).alias("r1"), (~F.col("s0") & F.col("s2")).alias("r2"), (~F.col("s0") & (F.col("s1") | F.col("s2"))).alias("r3")), [0.0])
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{a}").alias("x"), F.col(f"r{b}").alias("y")) for a, b in ((1, 2), (1, 3), (2, 3))])).alias("p")
    both, either = F.count_if(F.col("x") & F.col("y")), F.count_if(F.col("x") | F.col("y"))
    return missed.select(pairs).select("p.*").groupBy("a", "b").agg(both.alias("shared"), either.alias("either"), _q9(ratio(both, either, None)).alias("jaccard"))


def paired_subgroups(spark, d):
    """Transitions from the first strategy to the last, in all and in two subgroups, with the change of recall."""
    h = _strategy_hits(spark, d)
    groups = F.explode(F.filter(F.array(F.lit("ALL"), F.when(F.col("gt_index") == 0, "FIRST"), F.when(F.col("gt_index") > 1, "LATER")), lambda x: x.isNotNull())).alias("subgroup")
    was, now = F.col("s0"), F.col("s2")
    return h.select("s0", "s2", groups).groupBy("subgroup").agg(F.count_if(was & now).alias("kept"), F.count_if(~was & now).alias("rescued"), F.count_if(was & ~now).alias("lost"), F.count_if(~was & ~now).alias("missed"),
                                                               _q9(F.avg(now.cast("int")) - F.avg(was.cast("int"))).alias("change"))


# ---------------------------------------------------------------- case tables
def localisation_failures(spark, d):
    """Misses that a prediction touches at the report threshold, with their boxes' areas, worst overlap first."""
    rows = X.object_outcomes(_matched(spark, d), REPORT, "area").where("error_type = 'LOCALIZATION_FAILURE' and img is not null")
    return rows.select("img", "gt_index", "fold_id", "confidence", "iou", F.col("area").cast("int").alias("area"))


def final_association(spark, d):
    """For every true box the prediction that it is judged by, even if missed: the matched one, else the nearest, ties to the first index."""
    per = _matched(spark, d).select("img", F.explode("gts").alias("g"), "match", "preds")
    hit = F.get(F.filter("match", lambda m: (m["j"] == F.col("g.j")) & (m["conf"] >= REPORT)), F.lit(0))
    near = F.array_max(F.transform("preds", lambda p: F.struct(iou(F.col("g"), p).alias("iou"), (-p["i"]).alias("k"), p["conf"].alias("conf"))))
    out = per.select("img", F.col("g.j").alias("gt_index"), hit.alias("h"), near.alias("n"))
    return out.select("img", "gt_index", F.col("h").isNotNull().alias("matched"), F.coalesce("h.i", -F.col("n.k")).alias("pred_index"), _q9(F.coalesce("h.iou", "n.iou")).alias("iou"), F.coalesce("h.conf", "n.conf").alias("confidence"))


def nearest_by_confidence(spark, d):
    """For every prediction of model 1 the one of model 0 with the largest overlap; then the least difference of confidence; then the first."""
    base = F.filter("preds", lambda p: p["model"] == 0)
    per = FX.images(spark, d).select("img", base.alias("base"), F.explode(F.filter("preds", lambda p: p["model"] == 1)).alias("c"))
    best = F.array_max(F.transform("base", lambda p: F.struct(iou(p, F.col("c")).alias("iou"), (-F.round(F.abs(p["conf"] - F.col("c.conf")), 9)).alias("near"), (-p["i"]).alias("k"))))
    return per.select("img", F.col("c.i").alias("candidate"), best.alias("b")).select("img", "candidate", (-F.col("b.k")).alias("base"), _q9("b.iou").alias("iou"), (-F.col("b.near")).alias("difference"))


def residual_cases(spark, d):
    """Misses at the least threshold with their boxes, smallest first; one row each is asserted."""
    rows = _matched(spark, d).where("img is not null")  # one row for each image: its boxes are all there, so an index can repeat only here
    once = F.when(F.size("gts") == F.size(F.array_distinct(F.transform("gts", lambda g: g["j"]))), F.col("gts")).otherwise(F.raise_error(F.format_string("image %d repeats a box", "img")))
    miss = F.filter(once, lambda g: ~F.exists("match", lambda m: m["j"].eqNullSafe(g["j"])))
    rows = rows.select("img", "fold_id", F.explode(miss).alias("g"))
    area = ((F.col("g.x1") - F.col("g.x0")) * (F.col("g.y1") - F.col("g.y0"))).cast("int")
    return N.numbered(rows.select("img", F.col("g.j").alias("gt_index"), "fold_id", area.alias("area")), [], [F.asc("area"), F.asc("img"), F.asc("gt_index")], "place", "of")


def before_after(spark, d):
    """Best overlap of every true box by method against the first one: median change and share improved, by method and subgroup."""
    per = FX.images(spark, d).select(F.explode("gts").alias("g"), "preds")
    best = lambda keep: F.coalesce(F.array_max(F.transform(F.filter("preds", keep), lambda p: iou(F.col("g"), p))), F.lit(0.0))
    rows = per.select(F.col("g.j").alias("j"), best(lambda p: p["model"] == 0).alias("base"), F.array(F.struct(F.lit("model_1").alias("method"), best(lambda p: p["model"] == 1).alias("v")), F.struct(F.lit("both").alias("method"), best(lambda p: p["model"] >= 0).alias("v"))).alias("x"))
    rows = rows.select("j", "base", F.explode("x").alias("x")).select("x.method", F.when(F.col("j") == 0, "FIRST").otherwise("LATER").alias("subgroup"), _q9(F.col("x.v") - F.col("base")).alias("change"))
    return rows.groupBy("method", "subgroup").agg(F.count("*").alias("n"), _q9(F.percentile("change", F.lit(0.5))).alias("median"), _q9(F.avg((F.col("change") > 0).cast("int"))).alias("improved"))


def group_medians(spark, d):
    """Medians of a group packed as JSON, members joined by ';'."""
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    packed = F.to_json(F.struct(F.percentile(F.col("c_custkey") % 100, F.lit(0.5)).alias("key"), F.percentile(F.length("c_mktsegment"), F.lit(0.5)).alias("segment")))
    return c.groupBy("n_name").agg(packed.alias("medians"), F.array_join(F.transform(F.array_sort(F.collect_set(F.col("c_custkey") % 10)), lambda x: x.cast("string")), ";").alias("members"))


def crop_scales(spark, d):
    """Shorter sides in crops of four sizes scaled to 640, with two limits."""
    side = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    rows = FX.ground_truth(spark, d).select("img", "gt_index", side.alias("side"), F.explode(F.array(*[F.lit(s) for s in (96, 128, 160, 192)])).alias("size"))
    shown = F.col("side") * 640 / F.col("size")
    return rows.select("img", "gt_index", "size", _q9(F.lit(640.0) / F.col("size")).alias("magnification"), _q9(shown).alias("shown"), (shown >= 32).alias("at_least_32"), (shown >= 48).alias("at_least_48"))


def small_object_screen(spark, d):
    """Boxes at or under the first quartile of area against the others: misses, and the difference of their rates."""
    rows = X.object_outcomes(_matched(spark, d), REPORT).join(_gt_area(spark, d).drop("fold_id"), ["img", "gt_index"])
    cut = rows.agg(F.percentile("area", F.lit(0.25)).alias("cut"))
    part = F.when(F.col("area") <= F.col("cut"), "SMALL").otherwise("REST")
    return rows.crossJoin(F.broadcast(cut)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FN").alias("misses"), _q9(F.avg((F.col("status") == "FN").cast("int"))).alias("rate"), F.min("area").alias("least"))


# ---------------------------------------------------------------- statistics
def qcut_bins(spark, d):
    """Quartiles by distinct edges; a value at an edge falls in the lower bin, the least one in the first."""
    rows = read(spark, d, "lineitem").select(F.least("l_linenumber", F.lit(3)).alias("v"))
    cuts = S.quantile_cuts(rows, "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    inner = F.slice("cuts", F.lit(2), F.greatest(F.size("cuts") - 2, F.lit(0)))
    return rows.crossJoin(F.broadcast(cuts)).groupBy(F.size(F.filter(inner, lambda c: F.col("v") > c)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def feature_spearman(spark, d):
    """Rank correlation of four features with an outcome, each without its own nulls."""
    li = read(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_tax")], F.nullif(F.col("l_discount").cast("double"), F.lit(0.0)).alias("l_discount"), F.when(F.col("l_linenumber") < 5, F.col("l_linenumber").cast("double")).alias("l_linenumber"))
    long = li.unpivot("y", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "feature", "v").where("v is not null")
    ranked = S.average_rank(S.average_rank(long, ["feature"], "v", "rv"), ["feature"], "y", "ry")
    return ranked.groupBy("feature").agg(F.count("*").alias("n"), F.round(S.safe_corr(F.col("rv"), F.col("ry")), 6).alias("spearman"))


def stability_worst(spark, d):
    """Two representations of one feature: middle, spread, tail and largest difference, and the five rows that differ most."""
    li = read(spark, d, "orders").select("o_orderkey", F.round(F.abs(F.col("o_totalprice").cast("double") * 0.01 - F.floor(F.col("o_totalprice").cast("double") * 0.01)), 6).alias("d"))
    q = lambda x: F.percentile("d", F.lit(x))
    worst = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("k"), "o_orderkey"))), 1, 5), lambda s: s["o_orderkey"].cast("string")), ";")
    top = N.budget_top(li.withColumn("all", F.lit(1)), ["all"], "d", "o_orderkey", 0.001).agg(worst.alias("worst"))
    return li.agg(F.round(q(0.5), 6).alias("median"), F.round(q(0.75) - q(0.25), 6).alias("iqr"), F.round(q(0.95), 6).alias("p95"), F.max("d").alias("largest")).crossJoin(top)


def common_gaps(spark, d):
    """The eight most common gaps between a user's events, in minutes; ties to the smaller gap."""
    gaps = N.gaps(read(spark, d, "events"), ["user_id"], "ts", "event_id").where("previous_gap is not null")
    return gaps.groupBy(F.floor(F.col("previous_gap") / 60).alias("minutes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "minutes").limit(8)


# ---------------------------------------------------------------- audits
def compared_runs(spark, d):
    """Outcomes of two runs by object; an object that one run lacks is an error."""
    a = X.object_outcomes(_matched(spark, d, 0), REPORT).select("img", "gt_index", F.col("status").alias("base"))
    b = X.object_outcomes(_matched(spark, d), REPORT).select("img", "gt_index", F.col("status").alias("candidate"))
    return K.same_keys(a, b, ["img", "gt_index"]).groupBy("base", "candidate").agg(F.count("*").alias("n"))


def same_group_pairs(spark, d):
    """Pairs of neighbours by whether both sides are in one group."""
    c = read(spark, d, "customer")
    pairs = c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    group = c.select("c_custkey", (F.col("c_nationkey") % 4).alias("g"))
    both = pairs.join(group.toDF("a", "ga"), "a").join(group.toDF("b", "gb"), "b")
    return both.groupBy((F.col("ga") == F.col("gb")).alias("same")).agg(F.count("*").alias("n"))


def content_matches(spark, d):
    """Copies (odd ids) with the first original (even ids) of the same language and bytes."""
    doc = read(spark, d, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    raw = doc.where("doc_id % 2 = 0").groupBy("lang", "sha").agg(F.min("doc_id").alias("original"))
    return doc.where("doc_id % 2 = 1").join(raw, ["lang", "sha"]).select("doc_id", "original")


def nested_subsets(spark, d):
    """A chain of subsets: sizes, and members that the next one lacks."""
    c = read(spark, d, "customer").select("c_custkey")
    keys = [15, 50, 100, 400]
    flags = c.select(*[(F.col("c_custkey") <= k).alias(f"s{k}") for k in keys], F.col("c_custkey").isNotNull().alias("s_all"))
    names = [f"s{k}" for k in keys] + ["s_all"]
    sums = flags.agg(*[F.struct(F.lit(a).alias("subset"), F.count_if(F.col(a)).alias("members"), F.count_if(F.col(a) & ~F.col(b)).alias("outside")).alias(a) for a, b in zip(names, names[1:], strict=False)])
    return sums.select(F.explode(F.array(*names[:-1])).alias("x")).select("x.*")


def data_roles(spark, d):
    """Documents by role and status: texts in both roles conflict, later copies are left out, the rest is allowed."""
    doc = read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.when(F.col("doc_id") % 5 == 0, "TEST").otherwise("TRAIN").alias("role"))
    per = doc.groupBy("sha").agg(F.count_distinct("role").alias("roles"), F.min("doc_id").alias("first"))
    status = F.when(F.col("roles") > 1, "CONFLICT").when(F.col("doc_id") > F.col("first"), "COPY").otherwise("ALLOWED")
    return doc.join(per, "sha").groupBy("role", status.alias("status")).agg(F.count("*").alias("n"))


def label_conflicts(spark, d):
    """Texts whose copies differ in label or source: the labels, the ids and the sources, each joined in order."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(F.sha2("text", 256).alias("sha"), "doc_id", "quality", "source")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ";")
    bad = rows.groupBy("sha").agg(F.count_distinct("quality").alias("k"), F.count_distinct("source").alias("s")).where("k > 1 or s > 1").select("sha")
    return rows.join(bad, "sha").groupBy("sha").agg(joined("quality").alias("labels"), joined("doc_id").alias("ids"), joined("source").alias("sources"))


def recipe_equality(spark, d):
    """Whether all folds were made by one recipe."""
    per = read(spark, d, "orders").groupBy((F.col("o_orderkey") % 4).alias("fold")).agg(F.struct(F.min("o_orderpriority"), F.max("o_orderpriority"), F.count_distinct("o_orderpriority")).alias("recipe"))
    return per.agg(F.count("*").alias("folds"), F.count_distinct("recipe").alias("recipes"), (F.count_distinct("recipe") == 1).alias("equal"))


def expected_metrics(spark, d):
    """Metrics of the sweep against those that the outcomes of objects give."""
    got = X.sweep(_matched(spark, d), [REPORT]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("tp", "fn", "recall")])).alias("x")).select("x.*")
    o = X.object_outcomes(_matched(spark, d), REPORT).agg(F.count_if(F.col("status") == "TP").alias("tp"), F.count_if(F.col("status") == "FN").alias("fn"))
    o = o.select("tp", "fn", _q9(ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"))
    want = o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("tp", "fn", "recall")])).alias("x")).select("x.*")
    return K.reproduces(got, want, "metric", "value")


def exact_coverage(spark, d):
    """Whether four folds are disjoint and hold all images and nothing else."""
    o = read(spark, d, "orders")
    parts = o.select("o_orderkey", (F.col("o_orderkey") % 4).alias("fold"))
    return K.coverage(parts, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


def input_equality(spark, d):
    """Whether two models saw the same images: those of one alone, of both, and with as many boxes."""
    p = FX.predictions(spark, d).groupBy("img").agg(F.count_if(F.col("model") == 0).alias("a"), F.count_if(F.col("model") == 1).alias("b"))
    return p.agg(F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("only_0"), F.count_if((F.col("b") > 0) & (F.col("a") == 0)).alias("only_1"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("both"), F.count_if(F.col("a") == F.col("b")).alias("as_many"))


def candidate_scales(spark, d):
    """Candidates by how many scales they came with, repeats of (image, box, scale), and empty cells that became null."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.nullif(F.trim(F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag"))), F.lit("")).alias("scale"))
    per = rows.groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("candidate")).agg(F.count_distinct("scale").alias("scales"), (F.count("scale") - F.count_distinct("scale")).alias("repeats"), F.count_if(F.col("scale").isNull()).alias("empty"))
    return per.groupBy("scales").agg(F.count("*").alias("candidates"), F.sum("repeats").alias("repeats"), F.sum("empty").alias("empty"))


def materialised(spark, d):
    """Documents by what their copy in the labels shows: no label, size that differs, or as it should be; by fold."""
    doc = read(spark, d, "documents").select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) == F.coalesce("n_chars", F.lit(0))).alias("same"), (F.col("doc_id") % 4).alias("fold"))
    both = doc.join(read(spark, d, "labels").select("doc_id", F.lit(True).alias("found")), "doc_id", "left")
    status = F.when(F.col("found").isNull(), "NO_LABEL").when(~F.col("same"), "SIZE").otherwise("OK")
    return both.groupBy("fold", status.alias("status")).agg(F.count("*").alias("n"))


def source_resolution(spark, d):
    """For each kind of experiment the rows that it reads, and whether they cover every customer with an order."""
    c, o = read(spark, d, "customer").select("c_custkey", "c_mktsegment"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    both = c.join(o.withColumn("needed", F.lit(True)), "c_custkey", "left").select("c_mktsegment", F.coalesce("needed", F.lit(False)).alias("needed"))
    kinds = F.explode(F.array(F.lit("ALL"), F.when(F.col("c_mktsegment") < "C", "EARLY").otherwise("LATE"))).alias("kind")
    return both.select("needed", kinds).groupBy("kind").agg(F.count("*").alias("rows"), F.count_if("needed").alias("needed"), (F.count("*") == F.count_if("needed")).alias("all_needed"))


def approved_sample(spark, d):
    """Checks of an approved sample: unique keys, all eligible, names that are safe as folders."""
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("name"))
    return K.status(K.unique_key(s, "s_suppkey"), K.holds(s, "eligible", "s_suppkey > 0"), K.holds(s, "safe name", "name rlike '^[A-Za-z0-9_-]+$'"))


def fold_lists(spark, d):
    """(fold, partition, image) of four folds: an image is in the test list of its own fold and in the training lists of the others."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("img"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("fold"))
    return o.select("fold", F.when(F.col("img") % 4 + 1 == F.col("fold"), "test").otherwise("train").alias("partition"), "img")


def tile_manifest(spark, d):
    """One row for each tile of an image with a true box in it: name, place, boxes whole and cut."""
    tiles = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (0, 24, 32) for y in (0, 24, 32)])).alias("t")
    g = FX.ground_truth(spark, d).select("img", "x0", "y0", "x1", "y1", tiles).select("*", "t.x", "t.y")
    touch = (F.col("x0") < F.col("x") + 32) & (F.col("x1") > F.col("x")) & (F.col("y0") < F.col("y") + 32) & (F.col("y1") > F.col("y"))
    whole = (F.col("x0") >= F.col("x")) & (F.col("y0") >= F.col("y")) & (F.col("x1") <= F.col("x") + 32) & (F.col("y1") <= F.col("y") + 32)
    return g.where(touch).groupBy("img", "x", "y").agg(F.count_if(whole).alias("whole"), F.count_if(~whole).alias("cut")).withColumn("name", F.format_string("%d__x%03d_y%03d", "img", "x", "y"))


QUERIES = [det_map_mean, size_band_recall, pareto_steps, strategy_comparison, rescue_overlap_pairs, paired_subgroups, localisation_failures, final_association, nearest_by_confidence, residual_cases, before_after, group_medians, crop_scales,
           small_object_screen, qcut_bins, feature_spearman, stability_worst, common_gaps, compared_runs, same_group_pairs, content_matches, nested_subsets, data_roles, label_conflicts, recipe_equality, expected_metrics, exact_coverage,
           input_equality, candidate_scales, materialised, source_resolution, approved_sample, fold_lists, tile_manifest]

_AREA = "area AS (SELECT img, gt_index, (x1 - x0) * (y1 - y0) AS area FROM fx_gt)"
_SHARE = lambda hit, where: f"round(CASE WHEN count_if({where}) = 0 THEN 0.0 ELSE count_if({hit} AND {where}) / count_if({where})::DOUBLE END, 9)"
ORACLES = {
    "det_map_mean": f"SELECT round(avg(ap), 9) AS map50_95, round(max(CASE WHEN overlap_id = 0 THEN ap END), 9) AS ap50 FROM ({_ap_sql(OVERLAPS)})",
    "size_band_recall": match_sql() + f""", r AS (SELECT CASE WHEN (g.x1 - g.x0) * (g.y1 - g.y0) < 56 THEN 'SMALL' WHEN (g.x1 - g.x0) * (g.y1 - g.y0) < 80 THEN 'MEDIUM' ELSE 'LARGE' END AS band, list_max(list_transform(list_filter(m, lambda x: x.j = g.j), lambda x: x.conf)) AS conf FROM (SELECT *, unnest(gts) AS g FROM matched))
SELECT band, threshold_id, threshold, count(*) AS n, count_if(conf >= threshold)::BIGINT AS tp, round(count_if(conf >= threshold) / count(*)::DOUBLE, 9) AS recall FROM r, {grid_sql([0.1, REPORT, 0.5])} GROUP BY ALL""",
    "pareto_steps": f"WITH s AS ({sweep_sql(1)}) SELECT threshold_id, fn, fp, EXISTS (SELECT 1 FROM s b WHERE b.fn <= a.fn AND b.fp <= a.fp AND (b.fn < a.fn OR b.fp < a.fp)) AS dominated, row_number() OVER (ORDER BY fn, fp, threshold_id DESC) AS place FROM s a",
    "strategy_comparison": _strategies_sql(f"""SELECT strategy, {_SHARE('hit', 'true')} AS recall, {_SHARE('hit', 'gt_index = 0')} AS recall_first, {_SHARE('hit', 'gt_index > 1')} AS recall_later, count_if(hit AND NOT s0)::BIGINT AS rescued, count_if(hit AND NOT s0 AND NOT other)::BIGINT AS alone, count_if(NOT hit AND s0)::BIGINT AS lost
FROM (SELECT 1 AS strategy, gt_index, s0, s1 AS hit, s2 AS other FROM hits UNION ALL SELECT 2, gt_index, s0, s2, s1 FROM hits) GROUP BY strategy"""),
    "rescue_overlap_pairs": _strategies_sql(""", r AS (SELECT NOT s0 AND s1 AS r1, NOT s0 AND s2 AS r2, NOT s0 AND (s1 OR s2) AS r3 FROM hits), p AS (SELECT 1 AS a, 2 AS b, r1 AS x, r2 AS y FROM r UNION ALL SELECT 1, 3, r1, r3 FROM r UNION ALL SELECT 2, 3, r2, r3 FROM r)
SELECT a, b, count_if(x AND y)::BIGINT AS shared, count_if(x OR y)::BIGINT AS either, round(count_if(x AND y) / nullif(count_if(x OR y), 0)::DOUBLE, 9) AS jaccard FROM p GROUP BY a, b"""),
    "paired_subgroups": _strategies_sql(""", g AS (SELECT 'ALL' AS subgroup, * FROM hits UNION ALL SELECT 'FIRST', * FROM hits WHERE gt_index = 0 UNION ALL SELECT 'LATER', * FROM hits WHERE gt_index > 1)
SELECT subgroup, count_if(s0 AND s2)::BIGINT AS kept, count_if(NOT s0 AND s2)::BIGINT AS rescued, count_if(s0 AND NOT s2)::BIGINT AS lost, count_if(NOT s0 AND NOT s2)::BIGINT AS missed, round(avg(s2::INT) - avg(s0::INT), 9) AS change FROM g GROUP BY subgroup"""),
    "localisation_failures": _OUTCOMES + f", {_AREA} SELECT img, gt_index, fold_id, confidence, iou, area FROM outcomes JOIN area USING (img, gt_index) WHERE error_type = 'LOCALIZATION_FAILURE'",
    "final_association": match_sql() + f""", o AS (SELECT img, g.j AS gt_index, list_filter(m, lambda x: x.j = g.j AND x.conf >= {REPORT})[1] AS h, list_max(list_transform(preds, lambda p: struct_pack(iou := {iou_sql('g', 'p')}, k := -p.i, conf := p.conf))) AS n FROM (SELECT *, unnest(gts) AS g FROM matched))
SELECT img, gt_index, h IS NOT NULL AS matched, coalesce(h.i, -n.k) AS pred_index, round(coalesce(h.iou, n.iou), 9) AS iou, coalesce(h.conf, n.conf) AS confidence FROM o""",
    "nearest_by_confidence": FX.FX + f" SELECT c.img, c.pred_index AS candidate, p.pred_index AS base, round({iou_sql('p', 'c')}, 9) AS iou, round(abs(p.conf - c.conf), 9) AS difference FROM fx_pred c JOIN fx_pred p ON c.img = p.img AND c.model = 1 AND p.model = 0 QUALIFY row_number() OVER (PARTITION BY c.img, c.pred_index ORDER BY {iou_sql('p', 'c')} DESC, round(abs(p.conf - c.conf), 9), p.pred_index) = 1",
    "residual_cases": match_sql() + f", {_AREA}, s AS (SELECT img, fold_id, g.j AS gt_index FROM (SELECT *, unnest(gts) AS g FROM matched) WHERE len(list_filter(m, lambda x: x.j = g.j)) = 0) SELECT img, gt_index, fold_id, area, row_number() OVER (ORDER BY area, img, gt_index) AS place, count(*) OVER () AS of FROM s JOIN area USING (img, gt_index)",
    "before_after": FX.FX + f""", b AS (SELECT g.img, g.gt_index, coalesce(max({iou_sql('g', 'p')}) FILTER (WHERE p.model = 0), 0) AS base, coalesce(max({iou_sql('g', 'p')}) FILTER (WHERE p.model = 1), 0) AS one, coalesce(max({iou_sql('g', 'p')}), 0) AS two FROM fx_gt g LEFT JOIN fx_pred p ON g.img = p.img GROUP BY ALL),
l AS (SELECT 'model_1' AS method, gt_index, round(one - base, 9) AS change FROM b UNION ALL SELECT 'both', gt_index, round(two - base, 9) FROM b)
SELECT method, CASE WHEN gt_index = 0 THEN 'FIRST' ELSE 'LATER' END AS subgroup, count(*) AS n, round(quantile_cont(change, 0.5), 9) AS median, round(avg((change > 0)::INT), 9) AS improved FROM l GROUP BY ALL""",
    "group_medians": "SELECT n_name, json_object('key', quantile_cont((c_custkey % 100)::DOUBLE, 0.5), 'segment', quantile_cont(length(c_mktsegment)::DOUBLE, 0.5))::VARCHAR AS medians, array_to_string(list_sort(list(DISTINCT c_custkey % 10)), ';') AS members FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "crop_scales": FX.FX + ", s AS (SELECT img, gt_index, least(x1 - x0, y1 - y0) AS side, size FROM fx_gt, (VALUES (96), (128), (160), (192)) t(size)) SELECT img, gt_index, size, round(640::DOUBLE / size, 9) AS magnification, round(side * 640 / size::DOUBLE, 9) AS shown, side * 640 / size::DOUBLE >= 32 AS at_least_32, side * 640 / size::DOUBLE >= 48 AS at_least_48 FROM s",
    "small_object_screen": _OUTCOMES + f", {_AREA}, r AS (SELECT * FROM outcomes JOIN area USING (img, gt_index)), c AS (SELECT quantile_cont(area, 0.25) AS cut FROM r) SELECT CASE WHEN area <= cut THEN 'SMALL' ELSE 'REST' END AS part, count(*) AS n, count_if(status = 'FN')::BIGINT AS misses, round(avg((status = 'FN')::INT), 9) AS rate, min(area) AS least FROM r, c GROUP BY 1",
    "qcut_bins": "WITH r AS (SELECT least(l_linenumber, 3) AS v FROM lineitem), c AS (SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.25, 0.5, 0.75, 1]))) AS cuts FROM r) SELECT len(list_filter(cuts[2:len(cuts) - 1], lambda x: v > x))::INT AS bin, count(*) AS n, min(v) AS lo, max(v) AS hi FROM r, c GROUP BY 1",
    "feature_spearman": """WITH l AS (SELECT (l_returnflag = 'R')::INT AS y, unnest([struct_pack(f := 'l_quantity', v := l_quantity::DOUBLE), struct_pack(f := 'l_discount', v := nullif(l_discount::DOUBLE, 0)), struct_pack(f := 'l_tax', v := l_tax::DOUBLE), struct_pack(f := 'l_linenumber', v := CASE WHEN l_linenumber < 5 THEN l_linenumber::DOUBLE END)]) AS x FROM lineitem),
k AS (SELECT x.f AS feature, x.v AS v, y FROM l WHERE x.v IS NOT NULL), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM k)
SELECT feature, count(*) AS n, round(corr(rv, ry), 6) AS spearman FROM r GROUP BY feature""",
    "stability_worst": """WITH l AS (SELECT o_orderkey, round(abs(o_totalprice::DOUBLE * 0.01::DOUBLE - floor(o_totalprice::DOUBLE * 0.01::DOUBLE)), 6) AS d FROM orders), t AS (SELECT o_orderkey, d FROM l ORDER BY d DESC, o_orderkey LIMIT (SELECT least(5, greatest(1, ceil(count(*) * 0.001)))::BIGINT FROM l))
SELECT round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 6) AS iqr, round(quantile_cont(d, 0.95), 6) AS p95, max(d) AS largest, (SELECT string_agg(o_orderkey::VARCHAR, ';' ORDER BY d DESC, o_orderkey) FROM t) AS worst FROM l""",
    "common_gaps": "WITH g AS (SELECT date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6 AS gap FROM events) SELECT floor(gap / 60)::BIGINT AS minutes, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1 ORDER BY n DESC, minutes LIMIT 8",
    "compared_runs": f"WITH a AS ({match_sql(where='WHERE model = 0')} SELECT img, g.j AS gt_index, CASE WHEN len(list_filter(m, lambda x: x.j = g.j AND x.conf >= {REPORT})) > 0 THEN 'TP' ELSE 'FN' END AS base FROM (SELECT *, unnest(gts) AS g FROM matched)), b AS ({_OUTCOMES} SELECT img, gt_index, status AS candidate FROM outcomes) SELECT base, candidate, count(*) AS n FROM a JOIN b USING (img, gt_index) GROUP BY ALL",
    "same_group_pairs": "SELECT a.c_nationkey % 4 = b.c_nationkey % 4 AS same, count(*) AS n FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 GROUP BY 1",
    "content_matches": "SELECT x.doc_id, min(y.doc_id) AS original FROM documents x JOIN documents y ON x.lang = y.lang AND coalesce(x.text, '') = coalesce(y.text, '') WHERE x.doc_id % 2 = 1 AND y.doc_id % 2 = 0 GROUP BY x.doc_id",
    "nested_subsets": "SELECT 's' || k AS subset, count_if(c_custkey <= k)::BIGINT AS members, count_if(c_custkey <= k AND c_custkey > n)::BIGINT AS outside FROM customer, (VALUES (15, 50), (50, 100), (100, 400), (400, 1000000000)) t(k, n) GROUP BY k",
    "data_roles": "WITH r AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 5 = 0 THEN 'TEST' ELSE 'TRAIN' END AS role FROM documents), p AS (SELECT t, count(DISTINCT role) AS roles, min(doc_id) AS f FROM r GROUP BY t) SELECT role, CASE WHEN roles > 1 THEN 'CONFLICT' WHEN doc_id > f THEN 'COPY' ELSE 'ALLOWED' END AS status, count(*) AS n FROM r JOIN p USING (t) GROUP BY ALL",
    "approved_sample": "SELECT unnest(['unique s_suppkey', 'eligible', 'safe name']) AS \"check\", unnest([count(*) - count(DISTINCT s_suppkey), count_if(s_suppkey <= 0), count_if(NOT regexp_full_match(s_suppkey::VARCHAR, '[A-Za-z0-9_-]+'))])::BIGINT AS violations, unnest([CASE WHEN count(*) = count(DISTINCT s_suppkey) THEN 'PASS' ELSE 'FAIL' END, CASE WHEN count_if(s_suppkey <= 0) = 0 THEN 'PASS' ELSE 'FAIL' END, 'PASS']) AS status FROM supplier",
    "label_conflicts": "WITH r AS (SELECT sha256(text) AS sha, doc_id, quality, source FROM documents JOIN labels USING (doc_id)) SELECT sha, array_to_string(list_sort(list(DISTINCT quality)), ';') AS labels, array_to_string(list_sort(list(DISTINCT doc_id)), ';') AS ids, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources FROM r GROUP BY sha HAVING count(DISTINCT quality) > 1 OR count(DISTINCT source) > 1",
    "recipe_equality": "WITH p AS (SELECT o_orderkey % 4 AS fold, struct_pack(a := min(o_orderpriority), b := max(o_orderpriority), c := count(DISTINCT o_orderpriority)) AS r FROM orders GROUP BY 1) SELECT count(*) AS folds, count(DISTINCT r) AS recipes, count(DISTINCT r) = 1 AS equal FROM p",
    "expected_metrics": _OUTCOMES + ", o AS (SELECT count_if(status = 'TP')::DOUBLE AS tp, count_if(status = 'FN')::DOUBLE AS fn FROM outcomes) SELECT x.metric, x.v AS expected, x.v AS got, true AS ok FROM (SELECT unnest([struct_pack(metric := 'tp', v := tp), struct_pack(metric := 'fn', v := fn), struct_pack(metric := 'recall', v := round(tp / (tp + fn), 9))]) AS x FROM o)",
    "exact_coverage": "WITH w AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), p AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT coalesce(sum(p.n), 0)::BIGINT AS rows, count_if(p.n > 1)::BIGINT AS shared, count_if(p.k IS NULL)::BIGINT AS missing, count_if(w.k IS NULL)::BIGINT AS extra FROM p FULL JOIN w ON p.k = w.k",
    "input_equality": FX.FX + ", p AS (SELECT img, count_if(model = 0) AS a, count_if(model = 1) AS b FROM fx_pred GROUP BY img) SELECT count_if(a > 0 AND b = 0)::BIGINT AS only_0, count_if(b > 0 AND a = 0)::BIGINT AS only_1, count_if(a > 0 AND b > 0)::BIGINT AS both, count_if(a = b)::BIGINT AS as_many FROM p",
    "candidate_scales": "WITH r AS (SELECT l_orderkey, l_linenumber % 2 AS c, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS s FROM lineitem), p AS (SELECT count(DISTINCT s) AS scales, count(s) - count(DISTINCT s) AS repeats, count(*) - count(s) AS empty FROM r GROUP BY l_orderkey, c) SELECT scales, count(*) AS candidates, sum(repeats)::BIGINT AS repeats, sum(empty)::BIGINT AS empty FROM p GROUP BY scales",
    "materialised": "SELECT x.doc_id % 4 AS fold, CASE WHEN l.doc_id IS NULL THEN 'NO_LABEL' WHEN coalesce(length(x.text), 0) <> coalesce(x.n_chars, 0) THEN 'SIZE' ELSE 'OK' END AS status, count(*) AS n FROM documents x LEFT JOIN labels l ON x.doc_id = l.doc_id GROUP BY ALL",
    "source_resolution": "WITH b AS (SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders) AS needed FROM customer), k AS (SELECT 'ALL' AS kind, needed FROM b UNION ALL SELECT CASE WHEN c_mktsegment < 'C' THEN 'EARLY' ELSE 'LATE' END, needed FROM b) SELECT kind, count(*) AS rows, count_if(needed)::BIGINT AS needed, count(*) = count_if(needed) AS all_needed FROM k GROUP BY kind",
    "fold_lists": "SELECT fold, CASE WHEN o_orderkey % 4 + 1 = fold THEN 'test' ELSE 'train' END AS partition, o_orderkey AS img FROM orders, (VALUES (1), (2), (3), (4)) t(fold)",
    "tile_manifest": FX.FX + ", t AS (SELECT a.v AS x, b.v AS y FROM (VALUES (0), (24), (32)) a(v), (VALUES (0), (24), (32)) b(v)) SELECT img, x, y, count_if(x0 >= x AND y0 >= y AND x1 <= x + 32 AND y1 <= y + 32)::BIGINT AS whole, count_if(NOT (x0 >= x AND y0 >= y AND x1 <= x + 32 AND y1 <= y + 32))::BIGINT AS cut, format('{}__x{:03d}_y{:03d}', img, x, y) AS name FROM fx_gt, t WHERE x0 < x + 32 AND x1 > x AND y0 < y + 32 AND y1 > y GROUP BY img, x, y",
}
