"""Relational and statistical queries over the input tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions.exprs import corrected_odds_ratio, corrected_risk_ratio, labels_that_hold, ratio, right_closed_bin
from veristrata.operators import checks as K
from veristrata.operators import groups as G
from veristrata.operators import resample as R
from veristrata.operators import stats as S
from veristrata.operators import windows as N
from veristrata.plans.detection import _OUTCOMES, REPORT, _matched
from veristrata.operators import metrics as X
from veristrata.plans.fixtures import read

LIMITS = [3600, 21600, 36000, 86400, 172800]


def _q9(c: str):
    return F.round(c, 9).alias(c)


# ---------------------------------------------------------------- joins
def star_features(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, n = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"), F.countDistinct("o_orderkey").alias("orders"))


def left_row_max(spark, d):
    """Documents with their labels if any; the larger of two flags, nulls skipped."""
    doc, lab = read(spark, d, "documents").select("doc_id", "lang"), read(spark, d, "labels")
    return doc.join(lab, "doc_id", "left").select("doc_id", "lang", F.greatest("quality", "toxic").alias("flag"), F.col("quality").isNotNull().alias("labelled"))


def outer_audit(spark, d):
    """Orders and documents by id: in both, left only, right only."""
    a, b = read(spark, d, "documents").select(F.col("doc_id").alias("a")), read(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("b"))
    side = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").otherwise("both")
    return a.join(b, F.col("a") == F.col("b"), "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def semi_allow(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def anti_legacy(spark, d):
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def named_conditions(spark, d):
    """Overlapping named groups; names without rows stay with 0."""
    li = read(spark, d, "lineitem")
    flags = {"bulk": F.col("l_quantity") > 40, "returned": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") >= 0.05, "impossible": F.col("l_quantity") < 0}
    counts = li.agg(*[F.count_if(c).alias(n) for n, c in flags.items()], *[F.sum(F.when(c, F.col("l_quantity"))).cast("long").alias(f"q_{n}") for n, c in flags.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n"), F.coalesce(F.col(f"q_{n}"), F.lit(0)).alias("quantity")) for n in flags])).alias("x")).select("x.*")


def case_labels(spark, d):
    """Each line's conditions joined into one label."""
    li = read(spark, d, "lineitem")
    label = labels_that_hold({"BULK": F.col("l_quantity") > 40, "RETURNED": F.col("l_returnflag") == "R", "DISCOUNTED": F.col("l_discount") >= 0.05})
    return li.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def joint_coverage(spark, d):
    """Cells of two conditions per fold, cells without rows included, with a note on their size."""
    o = read(spark, d, "orders").select((F.col("o_orderkey") % 4 + 1).alias("fold"), (F.col("o_totalprice") > 200000).alias("dear"), (F.col("o_orderstatus") == "P").alias("partial"))
    cells = o.groupBy("fold").agg(*[F.count_if((F.col("dear") == F.lit(a)) & (F.col("partial") == F.lit(b))).alias(f"{a}|{b}") for a in (True, False) for b in (True, False)])
    out = cells.select("fold", F.explode(F.array(*[F.struct(F.lit(a).alias("dear"), F.lit(b).alias("partial"), F.col(f"{a}|{b}").alias("n")) for a in (True, False) for b in (True, False)])).alias("x")).select("fold", "x.*")
    return out.withColumn("note", F.when(F.col("n") == 0, "EMPTY").when(F.col("n") < 5, "SPARSE").when(F.col("n") < 30, "LIMITED").otherwise("ADEQUATE"))


# ---------------------------------------------------------------- bins and statistics
def quantile_bins(spark, d):
    li = read(spark, d, "lineitem").select("l_extendedprice", "l_quantity")
    cuts = S.quantile_cuts(li, "l_extendedprice", [0.25, 0.5, 0.75])  # one row
    return li.crossJoin(F.broadcast(cuts)).groupBy(right_closed_bin(F.col("l_extendedprice"), F.col("cuts")).alias("bin")).agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


def decile_detectability(spark, d):
    """Recall per decile of the true box's area; equal cuts collapse and empty bins are renumbered."""
    rows = X.object_outcomes(_matched(spark, d), REPORT).withColumn("v", F.col("gt_index").cast("double"))
    cuts = S.quantile_cuts(rows, "v", [k / 10 for k in range(1, 10)])
    per = rows.crossJoin(F.broadcast(cuts)).groupBy(right_closed_bin(F.col("v"), F.col("cuts")).alias("raw")).agg(F.count_if(F.col("status") == "TP").alias("tp"), F.count("*").alias("n"))
    return per.select(F.dense_rank().over(W.orderBy("raw")).cast("int").alias("bin"), "tp", "n", F.round(ratio(F.col("tp"), F.col("n")), 9).alias("recall"))


def adjacent_contrast(spark, d):
    per = decile_detectability(spark, d)
    w = W.orderBy("bin")
    return per.select("bin", F.lead("bin").over(w).alias("next_bin"), F.round(F.lead("recall").over(w) - F.col("recall"), 9).alias("change")).where("next_bin is not null")


def robust_stats(spark, d):
    out = S.robust_bundle(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.select("l_returnflag", "n", *[_q9(c) for c in ("mean", "std", "p10", "q25", "median", "q75", "p90", "mad", "iqr", "entropy")])


def weighted_quantile(spark, d):
    counts = read(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("v")).agg(F.count("*").alias("c"))
    return counts.agg(*[F.round(S.quantile("v", q, F.col("c")), 9).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95)])


def hist1d(spark, d):
    return S.histogram(read(spark, d, "lineitem"), "l_extendedprice", 20)


def hist2d(spark, d):
    e = read(spark, d, "lineitem")
    at = lambda c, lo, hi, n: F.least(F.lit(n - 1), F.floor((F.col(c) - lo) / (hi - lo) * n).cast("int"))
    return e.groupBy(at("l_quantity", 0, 50, 5).alias("x"), at("l_discount", 0.0, 0.1, 4).alias("y")).agg(F.count("*").alias("n"))


def pearson_spearman(spark, d):
    li = read(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("a"), F.col("l_extendedprice").cast("double").alias("b"), F.lit(1.0).alias("c"))
    r = S.average_rank(S.average_rank(li, ["l_returnflag"], "a", "ra"), ["l_returnflag"], "b", "rb")
    return r.groupBy("l_returnflag").agg(*[F.round(S.safe_corr(F.col(x), F.col(y)), 6).alias(n) for n, x, y in (("pearson", "a", "b"), ("spearman", "ra", "rb"), ("constant", "a", "c"))])


def ks_by_group(spark, d):
    return S.ks_distance(read(spark, d, "lineitem"), "l_returnflag", "A", "R", "l_quantity").select(_q9("ks"))


def tv_by_group(spark, d):
    return S.total_variation(read(spark, d, "events"), "user_id", "event_type").select("user_id", _q9("tv"))


def smd_by_group(spark, d):
    return S.mean_difference(read(spark, d, "orders"), "o_orderpriority", "o_totalprice").select("o_orderpriority", F.round("smd", 6).alias("smd"))


def risk_ratio(spark, d):
    li = read(spark, d, "lineitem")
    c = li.agg(F.count_if((F.col("l_quantity") > 25) & (F.col("l_returnflag") == "R")).alias("a"), F.count_if(F.col("l_quantity") > 25).alias("na"), F.count_if((F.col("l_quantity") <= 25) & (F.col("l_returnflag") == "R")).alias("b"), F.count_if(F.col("l_quantity") <= 25).alias("nb"))
    args = [F.col(x) for x in ("a", "na", "b", "nb")]
    return c.select("a", "na", "b", "nb", F.round(corrected_risk_ratio(*args), 9).alias("rr"), F.round(corrected_odds_ratio(*args), 9).alias("odds"))


def rollup_scopes(spark, d):
    o = read(spark, d, "orders")
    out = o.groupingSets([["o_orderstatus"], ["o_orderpriority"], ["o_orderstatus", "o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return out.select(F.coalesce("o_orderstatus", F.lit("ALL")).alias("status"), F.coalesce("o_orderpriority", F.lit("ALL")).alias("priority"), "n", F.col("level").cast("long").alias("level"))


def pivot_scales(spark, d):
    out = read(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))
    return out.select("l_linestatus", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("A", "N", "R")])


def best_with_ties(spark, d):
    """Per nation: all market segments with the largest number of customers, joined in order."""
    c = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return c.groupBy("c_nationkey").agg(F.max("n").alias("top"), F.collect_list(F.struct("c_mktsegment", "n")).alias("all")).select("c_nationkey", "top", F.array_join(F.array_sort(F.transform(F.filter("all", lambda x: x["n"] == F.col("top")), lambda x: x["c_mktsegment"])), ";").alias("best"))


def group_string_agg(spark, d):
    c = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return c.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "c_mktsegment", F.col("n").cast("string")))), "; ").alias("packed"))


def most_common(spark, d):
    c = read(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return c.groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("n", "o_orderpriority")).alias("priority"), F.max("n").alias("n"))


def zero_filled_rate(spark, d):
    """Orders per customer over all customers of a nation, customers without orders included."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return c.join(per, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.count("n").alias("with_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.count("*"), 9).alias("rate"))


def imbalance(spark, d):
    doc = read(spark, d, "documents")
    long = doc.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("lang", "source")])).alias("x")).select("x.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return long.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("dimension")), 9))


# ---------------------------------------------------------------- sequences
def gap_sessions(spark, d):
    out = N.gap_sessions(read(spark, d, "events"), ["user_id"], "ts", "event_id", LIMITS)
    return out.select("event_id", "user_id", "limit_s", F.concat_ws("_", F.col("user_id").cast("string"), F.col("session").cast("string")).alias("session_id"), F.round("previous_gap", 6).alias("previous_gap"), F.round("next_gap", 6).alias("next_gap"))


def _session_sizes(spark, d):
    return N.gap_sessions(read(spark, d, "events"), ["user_id"], "ts", "event_id", LIMITS).groupBy("limit_s", "user_id", "session").agg(F.count("*").alias("size"))


def session_summary(spark, d):
    return _session_sizes(spark, d).groupBy("limit_s").agg(F.count("*").alias("sessions"), F.count_if(F.col("size") == 1).alias("single"), F.max("size").alias("largest"), F.round(F.avg("size"), 9).alias("mean_size"), F.percentile("size", F.lit(0.5)).alias("median_size"))


def session_concentration(spark, d):
    """Share of events in the five largest sessions of each limit."""
    w = W.partitionBy("limit_s").orderBy(F.desc("size"), "user_id", "session")
    rows = _session_sizes(spark, d).withColumn("rank", F.row_number().over(w))
    total = rows.groupBy("limit_s").agg(F.sum("size").alias("all"), F.sum(F.when(F.col("rank") <= 5, F.col("size"))).alias("top"))
    return total.select("limit_s", F.round(F.col("top") / F.col("all"), 9).alias("top5_share"))


def cross_fold_gaps(spark, d):
    """Neighbours in time of one user that lie in different folds, by gap."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = N.gaps(read(spark, d, "events").withColumn("fold", F.col("event_id") % 4), ["user_id"], "ts", "event_id").withColumn("before", F.lag("fold").over(w)).where("before is not null and before <> fold")
    return e.agg(F.count("*").alias("pairs"), *[F.count_if(F.col("previous_gap") <= x).alias(f"within_{x}") for x in LIMITS])


def risk_rank(spark, d):
    out = N.risk_rank(read(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", descending=True)
    return out.select("o_orderkey", F.round("risk", 9).alias("risk"))


def budget_topk(spark, d):
    return N.budget_top(read(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey", 0.01).select("o_orderkey", "o_orderpriority")


def stratified_sample(spark, d):
    return N.systematic_sample(read(spark, d, "orders"), ["o_orderpriority"], ["o_totalprice", "o_orderkey"], 9).select("o_orderkey", "o_orderpriority")


def latest_dates_holdout(spark, d):
    o = read(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    last = o.select("day").distinct().orderBy(F.desc("day")).limit(5)
    return o.join(F.broadcast(last), "day", "left_semi").select("o_orderkey", F.col("day").cast("string").alias("day"))


def leave_one_out(spark, d):
    """Mean of all other groups and the group's distance from it."""
    per = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    w = W.partitionBy(F.lit(1))  # one row for each priority
    return per.select("o_orderpriority", F.round((F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n")), 4).alias("others"), F.round(F.col("s") / F.col("n"), 4).alias("own"))


# ---------------------------------------------------------------- sets, duplicates, groups
def set_audit(spark, d):
    """Sizes of intersection, differences and union of two id sets."""
    a = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).withColumn("b", F.lit(1))
    j = a.join(b, "k", "full")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count("*").alias("either"))


def oversample(spark, d):
    """Labelled good documents appear twice outside fold 1."""
    doc = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4 + 1).alias("fold"))
    good = read(spark, d, "labels").where("quality = 0").select("doc_id")
    again = doc.where("fold <> 1").join(good, "doc_id", "left_semi").withColumn("occurrence", F.lit(1))
    return doc.withColumn("occurrence", F.lit(0)).unionByName(again)


def exact_duplicates(spark, d):
    """Texts that occur more than once: how often, and the least id."""
    doc = read(spark, d, "documents").select(F.sha2("text", 256).alias("sha"), "doc_id")
    g = doc.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("canonical")).where("n > 1")
    return g


ROWS, COLUMNS, RANGES = 16, 17, 9


def _difference_hash(text):
    """256 bits of a text taken as an image of 16 by 17 by the nearest of its letters: whether a letter's code is above the next one's."""
    at = lambda k: F.ascii(F.substring(text, F.floor(F.lit(k) * F.length(text) / (ROWS * COLUMNS)).cast("int") + 1, F.lit(1)))
    grid = F.array(*[at(k) for k in range(ROWS * COLUMNS)])
    places = F.array(*[F.lit(r * COLUMNS + c) for r in range(ROWS) for c in range(COLUMNS - 1)])
    return grid, lambda g: F.array_join(F.transform(places, lambda k: F.when(F.get(g, k) > F.get(g, k + 1), "1").otherwise("0")), "")


def _hashes(spark, d):
    """doc_id, hash of documents of at least 272 letters."""
    grid, bits = _difference_hash(F.col("text"))
    rows = read(spark, d, "documents").where(F.length("text") >= ROWS * COLUMNS).select("doc_id", grid.alias("g"))
    return rows.select("doc_id", bits(F.col("g")).alias("hash"))


def near_duplicate_pairs(spark, d, most: int = 8):
    """Texts whose difference hashes of 256 bits differ in at most 8 places: each one with the least id of its hash, and pairs of those.

    Different hashes that are near share one of nine bit ranges (by the pigeonhole principle no pair is missed), and a pair counts in the
    first range that it shares, so nothing is compared with everything and a group of equal hashes never makes pairs.
    """
    rows = G._written(_hashes(spark, d))
    one = rows.groupBy("hash").agg(F.min("doc_id").alias("rep"))
    member = rows.join(one, "hash").where("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(0).cast("long").alias("distance"))
    cut = [round(256 * k / RANGES) for k in range(RANGES + 1)]
    words = [F.conv(F.substring("hash", 64 * k + 1, 64), 2, -10).cast("long").alias(f"w{k}") for k in range(4)]
    parts = F.array(*[F.substring("hash", lo + 1, hi - lo) for lo, hi in zip(cut, cut[1:], strict=False)])
    split = one.select("rep", *words, parts.alias("parts")).select("*", F.posexplode("parts").alias("part", "bits"))
    a, b = split.alias("a"), split.alias("b")
    pairs = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.rep") < F.col("b.rep")))
    first = F.array_position(F.zip_with("a.parts", "b.parts", lambda x, y: x == y), True) == F.col("a.part") + 1
    distance = sum((F.bit_count(F.col(f"a.w{k}").bitwiseXOR(F.col(f"b.w{k}"))) for k in range(4)), F.lit(0))
    near = pairs.where(first).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), distance.cast("long").alias("distance")).where(F.col("distance") <= most)
    return near.unionByName(member)


def extreme_pairs(spark, d):
    """The six closest and the six farthest near pairs."""
    rows = G._written(near_duplicate_pairs(spark, d))
    close = rows.orderBy("distance", "a", "b").limit(6).withColumn("side", F.lit("CLOSEST"))
    return close.unionByName(rows.orderBy(F.desc("distance"), "a", "b").limit(6).withColumn("side", F.lit("FARTHEST")))


def components(spark, d):
    return G.components(near_duplicate_pairs(spark, d), "a", "b")


def leakage_audit(spark, d):
    """Components and duplicate groups that are split over folds."""
    groups = components(spark, d).withColumn("fold", F.col("node") % 4)
    per = groups.groupBy("component").agg(F.count_distinct("fold").alias("folds"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("components"), F.count_if(F.col("folds") > 1).alias("split"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


def fold_balance(spark, d):
    return S.total_variation(read(spark, d, "events").withColumn("fold", F.col("user_id") % 4), "fold", "event_type").select("fold", _q9("tv"))


def fold_assignment(spark, d):
    per = read(spark, d, "events").groupBy(F.col("user_id").alias("group_id")).agg(F.count("*").alias("size"))
    return G.assign_folds(per)


def token_vectors(spark, d):
    """Per customer group: number of orders by priority, long form."""
    return read(spark, d, "orders").groupBy((F.col("o_custkey") % 130).alias("component"), F.col("o_orderpriority").alias("token")).agg(F.count("*").alias("n"))


def bootstrap_recall(spark, d):
    per = X.object_outcomes(_matched(spark, d), REPORT).groupBy((F.col("img") % 130).alias("cluster")).agg(F.count_if(F.col("status") == "TP").alias("top"), F.count("*").alias("bottom"))
    return R.cluster_bootstrap(per, 130, 200)


def logistic_factors(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    beta = R.newton_logistic(li, ["quantity", "discount"], "y")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in beta.items()], "name string, coefficient double")


def integrity_checks(spark, d):
    o, li, c = read(spark, d, "orders"), read(spark, d, "lineitem"), read(spark, d, "customer")
    return K.status(K.unique_key(o, "o_orderkey"), K.unique_key(li, "l_orderkey", "l_linenumber"), K.subset(o, c, "o_custkey", "c_custkey"), K.holds(li, "discount range", "l_discount between 0 and 0.1"))


def nested_json(spark, d):
    """A JSON cell decoded: blank or null is an empty map."""
    e = read(spark, d, "events").select("event_type", F.coalesce(F.from_json("props", "map<string,bigint>"), F.expr("map()").cast("map<string,bigint>")).alias("m"))
    return e.groupBy("event_type").agg(F.sum(F.size("m")).alias("keys"), F.sum(F.coalesce(F.try_element_at("m", F.lit("k")), F.lit(0))).alias("total"))


QUERIES = [star_features, left_row_max, outer_audit, semi_allow, anti_legacy, named_conditions, case_labels, joint_coverage, quantile_bins, decile_detectability, adjacent_contrast, robust_stats, weighted_quantile, hist1d, hist2d,
           pearson_spearman, ks_by_group, tv_by_group, smd_by_group, risk_ratio, rollup_scopes, pivot_scales, best_with_ties, group_string_agg, most_common, zero_filled_rate, imbalance, gap_sessions, session_summary,
           session_concentration, cross_fold_gaps, risk_rank, budget_topk, stratified_sample, latest_dates_holdout, leave_one_out, set_audit, oversample, exact_duplicates, near_duplicate_pairs, extreme_pairs, components, leakage_audit,
           fold_balance, fold_assignment, token_vectors, bootstrap_recall, logistic_factors, integrity_checks, nested_json]

_LABEL = "list_filter([CASE WHEN l_quantity > 40 THEN 'BULK' END, CASE WHEN l_returnflag = 'R' THEN 'RETURNED' END, CASE WHEN l_discount >= 0.05 THEN 'DISCOUNTED' END], lambda x: x IS NOT NULL)"
_DECILES = _OUTCOMES + """, v AS (SELECT *, gt_index::DOUBLE AS v FROM outcomes), cuts AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS cuts FROM v),
raw AS (SELECT len(list_filter(cuts, lambda c: v > c)) AS raw, count_if(status = 'TP')::BIGINT AS tp, count(*) AS n FROM v, cuts GROUP BY 1),
bins AS (SELECT dense_rank() OVER (ORDER BY raw)::INT AS bin, tp, n, round(tp / n::DOUBLE, 9) AS recall FROM raw)"""
_SESS = "WITH g AS (SELECT *, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS previous_gap, lead(epoch_us(ts) / 1e6) OVER w - epoch_us(ts) / 1e6 AS next_gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),\n l(limit_s) AS (VALUES " + ", ".join(f"({x})" for x in LIMITS) + "),\n s AS (SELECT *, sum(CASE WHEN coalesce(previous_gap, 0) > limit_s THEN 1 ELSE 0 END) OVER (PARTITION BY limit_s, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g, l)"
_SIZES = _SESS + ", z AS (SELECT limit_s, user_id, session, count(*) AS size FROM s GROUP BY ALL)"
_BITS = """WITH RECURSIVE h AS (SELECT doc_id, array_to_string(list_transform(range(256), lambda n: CASE WHEN
 ord(substring(text, (floor((n // 16 * 17 + n % 16) * length(text) / 272::DOUBLE))::INT + 1, 1)) > ord(substring(text, (floor((n // 16 * 17 + n % 16 + 1) * length(text) / 272::DOUBLE))::INT + 1, 1)) THEN '1' ELSE '0' END), '') AS hash FROM documents WHERE length(text) >= 272),
one AS (SELECT hash, min(doc_id) AS rep FROM h GROUP BY hash),
near AS (SELECT x.rep AS a, y.rep AS b, hamming(x.hash, y.hash) AS distance FROM one x JOIN one y ON x.rep < y.rep WHERE hamming(x.hash, y.hash) <= 8
 UNION ALL SELECT rep, doc_id, 0 FROM h JOIN one USING (hash) WHERE doc_id > rep)"""
_CC = _BITS.replace("WITH h", "WITH RECURSIVE h", 1) + ", e AS (SELECT a AS u, b AS v FROM near UNION SELECT b, a FROM near), cc(node, root) AS (SELECT u, u FROM e UNION SELECT e.v, cc.root FROM cc JOIN e ON cc.node = e.u), comp AS (SELECT node, min(root) AS component FROM cc GROUP BY node)"
_TV = "WITH c AS (SELECT {g} AS grp, event_type, count(*) AS n FROM events GROUP BY ALL), o AS (SELECT event_type, sum(n) AS all_n FROM c GROUP BY 1), s AS (SELECT grp, sum(n) AS size FROM c GROUP BY 1) SELECT s.grp AS {name}, round(0.5 * sum(abs(coalesce(c.n, 0) / s.size - o.all_n / (SELECT sum(n) FROM c))), 9) AS tv FROM s CROSS JOIN o LEFT JOIN c ON c.grp = s.grp AND c.event_type = o.event_type GROUP BY s.grp"

ORACLES = {
    "star_features": "SELECT n_name, c_mktsegment, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "left_row_max": "SELECT d.doc_id, lang, greatest(quality, toxic) AS flag, quality IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "outer_audit": "SELECT CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n FROM documents d FULL JOIN (SELECT * FROM labels WHERE toxic = 0) l ON d.doc_id = l.doc_id GROUP BY 1",
    "semi_allow": "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang",
    "anti_legacy": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "named_conditions": "SELECT n.name, count(l.q) AS n, coalesce(sum(l.q), 0)::BIGINT AS quantity FROM (VALUES ('bulk'), ('returned'), ('discounted'), ('impossible')) n(name) LEFT JOIN (SELECT 'bulk' AS name, l_quantity AS q FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'returned', l_quantity FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'discounted', l_quantity FROM lineitem WHERE l_discount >= 0.05 UNION ALL SELECT 'impossible', l_quantity FROM lineitem WHERE l_quantity < 0) l ON n.name = l.name GROUP BY n.name",
    "case_labels": f"SELECT CASE WHEN len({_LABEL}) = 0 THEN 'NONE' ELSE array_to_string({_LABEL}, '|') END AS label, count(*) AS n FROM lineitem GROUP BY 1",
    "joint_coverage": "WITH o AS (SELECT o_orderkey % 4 + 1 AS fold, o_totalprice > 200000 AS dear, o_orderstatus = 'P' AS partial FROM orders), f AS (SELECT DISTINCT fold FROM o), b(x) AS (VALUES (true), (false)), c AS (SELECT f.fold, b.x AS dear, c.x AS partial, count(o.fold) AS n FROM f CROSS JOIN b CROSS JOIN b c LEFT JOIN o ON o.fold = f.fold AND o.dear = b.x AND o.partial = c.x GROUP BY ALL) SELECT *, CASE WHEN n = 0 THEN 'EMPTY' WHEN n < 5 THEN 'SPARSE' WHEN n < 30 THEN 'LIMITED' ELSE 'ADEQUATE' END AS note FROM c",
    "quantile_bins": "WITH c AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]))) AS cuts FROM lineitem) SELECT len(list_filter(cuts, lambda x: l_extendedprice > x))::INT AS bin, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem, c GROUP BY 1",
    "decile_detectability": _DECILES + " SELECT * FROM bins",
    "adjacent_contrast": _DECILES + " SELECT * FROM (SELECT bin, lead(bin) OVER (ORDER BY bin) AS next_bin, round(lead(recall) OVER (ORDER BY bin) - recall, 9) AS change FROM bins) WHERE next_bin IS NOT NULL",
    "robust_stats": "WITH f AS (SELECT l_returnflag, count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q75, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1), m AS (SELECT l_returnflag, quantile_cont(abs(l_quantity - median), 0.5) AS mad FROM lineitem JOIN f USING (l_returnflag) GROUP BY 1), c AS (SELECT l_returnflag, l_quantity, count(*) AS c FROM lineitem GROUP BY ALL), e AS (SELECT l_returnflag, -sum(c / n::DOUBLE * log2(c / n::DOUBLE)) AS entropy FROM c JOIN f USING (l_returnflag) GROUP BY 1) SELECT l_returnflag, n, round(mean, 9) AS mean, round(std, 9) AS std, round(p10, 9) AS p10, round(q25, 9) AS q25, round(median, 9) AS median, round(q75, 9) AS q75, round(p90, 9) AS p90, round(mad, 9) AS mad, round(q75 - q25, 9) AS iqr, round(entropy, 9) AS entropy FROM f JOIN m USING (l_returnflag) JOIN e USING (l_returnflag)",
    "weighted_quantile": "SELECT round(quantile_cont(l_quantity, 0.05), 9)::DOUBLE AS q5, round(quantile_cont(l_quantity, 0.5), 9)::DOUBLE AS q50, round(quantile_cont(l_quantity, 0.95), 9)::DOUBLE AS q95 FROM lineitem",
    "hist1d": "WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(19, floor((l_extendedprice - lo) / (hi - lo) * 20)::INT) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1",
    "hist2d": "SELECT least(4, floor((l_quantity - 0) / 50 * 5)::INT) AS x, least(3, floor((l_discount - 0.0::DOUBLE) / 0.1::DOUBLE * 4)::INT) AS y, count(*) AS n FROM lineitem GROUP BY ALL",
    "pearson_spearman": "WITH r AS (SELECT l_returnflag, l_quantity AS a, l_extendedprice AS b, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS rb FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, CAST(NULL AS DOUBLE) AS \"constant\" FROM r GROUP BY 1",
    "ks_by_group": "WITH c AS (SELECT l_quantity AS v, count_if(l_returnflag = 'A') AS na, count_if(l_returnflag = 'R') AS nb FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), k AS (SELECT sum(na) OVER w / (SELECT sum(na) FROM c) AS fa, sum(nb) OVER w / (SELECT sum(nb) FROM c) AS fb FROM c WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)) SELECT round(max(abs(fa - fb)), 9) AS ks FROM k",
    "tv_by_group": _TV.format(g="user_id", name="user_id"),
    "fold_balance": _TV.format(g="user_id % 4", name="fold"),
    "smd_by_group": "SELECT o_orderpriority, round((avg(o_totalprice) - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS smd FROM orders GROUP BY 1",
    "risk_ratio": "WITH c AS (SELECT count_if(l_quantity > 25 AND l_returnflag = 'R')::BIGINT AS a, count_if(l_quantity > 25)::BIGINT AS na, count_if(l_quantity <= 25 AND l_returnflag = 'R')::BIGINT AS b, count_if(l_quantity <= 25)::BIGINT AS nb FROM lineitem) SELECT a, na, b, nb, round(((a + 0.5::DOUBLE) / (na + 1.0::DOUBLE)) / ((b + 0.5::DOUBLE) / (nb + 1.0::DOUBLE)), 9) AS rr, round(((a + 0.5::DOUBLE) * (nb - b + 0.5::DOUBLE)) / ((na - a + 0.5::DOUBLE) * (b + 0.5::DOUBLE)), 9) AS odds FROM c",
    "rollup_scopes": "SELECT coalesce(o_orderstatus, 'ALL') AS status, coalesce(o_orderpriority, 'ALL') AS priority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())",
    "pivot_scales": "SELECT l_linestatus, count_if(l_returnflag = 'A')::BIGINT AS \"A\", count_if(l_returnflag = 'N')::BIGINT AS \"N\", count_if(l_returnflag = 'R')::BIGINT AS \"R\" FROM lineitem GROUP BY 1",
    "best_with_ties": "WITH k AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment), c AS (SELECT *, max(n) OVER (PARTITION BY c_nationkey) AS top FROM k) SELECT c_nationkey, max(top) AS top, string_agg(c_mktsegment, ';' ORDER BY c_mktsegment) AS best FROM c WHERE n = top GROUP BY 1",
    "group_string_agg": "WITH c AS (SELECT c_nationkey, c_mktsegment || '=' || count(*) AS s FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT c_nationkey, string_agg(s, '; ' ORDER BY s) AS packed FROM c GROUP BY 1",
    "most_common": "WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority AS priority, n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority DESC) = 1",
    "zero_filled_rate": "WITH p AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_nationkey, count(*) AS customers, count(n) AS with_orders, coalesce(sum(n), 0)::BIGINT AS orders, round(coalesce(sum(n), 0) / count(*)::DOUBLE, 9) AS rate FROM customer LEFT JOIN p ON c_custkey = o_custkey GROUP BY 1",
    "imbalance": "WITH u AS (SELECT 'lang' AS dimension, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents), c AS (SELECT dimension, value, count(*) AS n FROM u GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY dimension), 9) AS share FROM c",
    "gap_sessions": _SESS + " SELECT event_id, user_id, limit_s, user_id || '_' || session AS session_id, round(previous_gap, 6) AS previous_gap, round(next_gap, 6) AS next_gap FROM s",
    "session_summary": _SIZES + " SELECT limit_s, count(*) AS sessions, count_if(size = 1)::BIGINT AS single, max(size) AS largest, round(avg(size), 9) AS mean_size, quantile_cont(size, 0.5)::DOUBLE AS median_size FROM z GROUP BY 1",
    "session_concentration": _SIZES + ", r AS (SELECT *, row_number() OVER (PARTITION BY limit_s ORDER BY size DESC, user_id, session) AS rank FROM z) SELECT limit_s, round(sum(CASE WHEN rank <= 5 THEN size END) / sum(size)::DOUBLE, 9) AS top5_share FROM r GROUP BY 1",
    "cross_fold_gaps": "WITH g AS (SELECT event_id % 4 AS fold, lag(event_id % 4) OVER w AS before, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT count(*) AS pairs, " + ", ".join(f"count_if(gap <= {x})::BIGINT AS within_{x}" for x in LIMITS) + " FROM g WHERE before IS NOT NULL AND before <> fold",
    "risk_rank": "SELECT o_orderkey, round(1 - (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey DESC) - 1) / greatest(1, count(*) OVER (PARTITION BY o_orderpriority) - 1)::DOUBLE, 9) AS risk FROM orders WHERE o_totalprice IS NOT NULL",
    "budget_topk": "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= greatest(1, ceil(count(*) OVER (PARTITION BY o_orderpriority) * 0.01))",
    "stratified_sample": "WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, o_orderpriority FROM r WHERE n <= 9 OR list_contains(list_transform(range(9), lambda i: round_even(i * (n - 1) / 8.0::DOUBLE, 0)::BIGINT), r)",
    "latest_dates_holdout": "SELECT o_orderkey, CAST(o_orderdate::DATE AS VARCHAR) AS day FROM orders WHERE o_orderdate::DATE IN (SELECT DISTINCT o_orderdate::DATE AS x FROM orders ORDER BY x DESC LIMIT 5)",
    "leave_one_out": "WITH p AS (SELECT o_orderpriority, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderpriority, round((sum(s) OVER () - s) / (sum(n) OVER () - n), 4) AS others, round(s / n, 4) AS own FROM p",
    "set_audit": "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT count_if(a.k IS NOT NULL AND b.k IS NOT NULL)::BIGINT AS both, count_if(b.k IS NULL)::BIGINT AS only_a, count_if(a.k IS NULL)::BIGINT AS only_b, count(*) AS either FROM a FULL JOIN b ON a.k = b.k",
    "oversample": "SELECT doc_id, doc_id % 4 + 1 AS fold, 0 AS occurrence FROM documents UNION ALL SELECT doc_id, doc_id % 4 + 1, 1 FROM documents WHERE doc_id % 4 + 1 <> 1 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "exact_duplicates": "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS canonical FROM documents GROUP BY 1 HAVING count(*) > 1",
    "extreme_pairs": _BITS + ", n AS (SELECT * FROM near) SELECT * FROM (SELECT *, 'CLOSEST' AS side FROM n ORDER BY distance, a, b LIMIT 6) UNION ALL SELECT * FROM (SELECT *, 'FARTHEST' AS side FROM n ORDER BY distance DESC, a, b LIMIT 6)",
    "near_duplicate_pairs": _BITS + " SELECT * FROM near",
    "components": _CC + " SELECT node, component FROM comp",
    "leakage_audit": _CC + ", g AS (SELECT component, count(DISTINCT node % 4) AS folds, count(*) AS n FROM comp GROUP BY 1) SELECT count(*) AS components, coalesce(count_if(folds > 1), 0)::BIGINT AS split, coalesce(sum(n), 0)::BIGINT AS members FROM g",
    "token_vectors": "SELECT o_custkey % 130 AS component, o_orderpriority AS token, count(*) AS n FROM orders GROUP BY ALL",
    "bootstrap_recall": _OUTCOMES + f", c AS (SELECT img % 130 AS cluster, count_if(status = 'TP') AS top, count(*) AS bottom FROM outcomes GROUP BY 1), d AS (SELECT i // 130 AS rep, (({R.LCG_A} * (({R.LCG_A} * ((i // 130 * 7919 + i % 130 * 104729 + 7) % {R.LCG_M}) + {R.LCG_C}) % {R.LCG_M}) + {R.LCG_C}) % {R.LCG_M}) % 130 AS cluster FROM range(200 * 130) t(i)), r AS (SELECT rep, sum(top) / sum(bottom)::DOUBLE AS r FROM d JOIN c USING (cluster) GROUP BY rep) SELECT round(quantile_cont(r, 0.025), 9) AS low, round(quantile_cont(r, 0.5), 9) AS median, round(quantile_cont(r, 0.975), 9) AS high, count(*) AS replicates FROM r",
    "integrity_checks": "WITH c AS (SELECT 'unique o_orderkey' AS \"check\", (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS violations UNION ALL SELECT 'unique l_orderkey,l_linenumber', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) UNION ALL SELECT 'o_custkey in c_custkey', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'discount range', (SELECT count(*) FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.1))) SELECT *, CASE WHEN violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c",
    "nested_json": "SELECT event_type, sum(len(json_keys(props)))::BIGINT AS keys, sum(coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0))::BIGINT AS total FROM events GROUP BY 1",
}
