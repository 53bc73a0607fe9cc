"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Documents are leaves' rows of a tree domain > language > source. A node's capacity is the sum of its leaves'
tokens times the most epochs allowed. A budget enters at the root and goes down level by level: each parent's
budget is split among its children in proportion to their weights, no child gets more than its capacity, and
what a full child leaves goes to its siblings (water filling in closed form over the order capacity / weight).
A parent never gets more than its children can take, so a shortage passes to an ancestor's other branches only
when all siblings are full. Each leaf then takes whole documents in a seeded order, epoch after epoch, while
the running token sum stays within its budget.

Running sums are two-level: sums of buckets of the seeded hash, then sums inside a bucket, so that no task
holds a whole leaf. Buckets follow the row count.

Cases: null lang or source is the value '' and null text has no tokens; a document without tokens is taken
with any leaf that has a budget at its place in the order; rows of one doc_id count as rows of their own and get one line of the plan; a weight missing from the table is 1; non-positive
weights give nothing; an empty table gives an empty result; other columns of the input pass through `mix`
and are ignored by `plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shielded

#: Production parameters. A domain is the last digit of the source's number in groups; weights name nodes of the tree.
SEED = "mix-1"
MAX_EPOCHS = 2
BUDGET_FRACTION = 0.6
ROWS_PER_BUCKET = 20_000
DOMAIN_WEIGHTS = {"web": 0.5, "code": 0.2, "books": 0.3}
LANG_WEIGHTS = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}


def token_count(text: Column) -> Column:
    """Words between white space."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def domain_of(source: Column) -> Column:
    """Domain of a source named by a number: numbers 0 to 6 of ten are web, 7 and 8 code, 9 books; others web."""
    d = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1)
    return F.when(d.isin("7", "8"), "code").when(d == "9", "books").otherwise("web")


def _weight(table: dict[str, float], key: Column) -> Column:
    out = F.lit(1.0)
    for k, v in table.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out


def water_fill(nodes: DataFrame, parent: list[str], child: list[str], budget: str, cap: str, weight: str, out: str) -> DataFrame:
    """Split each parent's budget among its children: min(cap, level * weight), with one level per parent.

    In the order of cap / weight, a prefix of children is full. Child k is full if the level that would
    spend the rest on it and all later ones reaches its ratio; the first child that isn't sets the level of the others.
    """
    ok = F.col(weight) > 0
    order = W.partitionBy(*parent).orderBy(F.col("_ratio"), *child)
    n = nodes.withColumn("_ratio", F.when(ok, F.col(cap) / F.col(weight)))
    n = n.withColumn("_ratio", F.when(ok, F.col("_ratio")).otherwise(F.lit(-1.0)))
    n = n.withColumn("_w", F.when(ok, F.col(weight)).otherwise(F.lit(0.0))).withColumn("_c", F.when(ok, F.col(cap)).otherwise(F.lit(0.0)))
    n = n.withColumn("_before", F.coalesce(F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    n = n.withColumn("_rest", F.coalesce(F.sum("_w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)), F.lit(0.0)))
    n = n.withColumn("_level", F.when(F.col("_rest") > 0, (F.col(budget) - F.col("_before")) / F.col("_rest")))
    n = n.withColumn("_full", F.coalesce(F.col("_level") >= F.col("_ratio"), F.lit(True)))
    n = n.withColumn("_first", F.max(F.when(~F.col("_full"), F.col("_level"))).over(W.partitionBy(*parent)))
    value = F.when(F.col("_full"), F.col("_c")).otherwise(F.greatest(F.lit(0.0), F.least(F.col("_c"), F.col("_first") * F.col("_w"))))
    return n.withColumn(out, value).drop("_ratio", "_w", "_c", "_before", "_rest", "_level", "_full", "_first")


def leaf_budgets(leaves: DataFrame, budget_fraction: float, max_epochs: int, domain_weights: dict, lang_weights: dict, source_weights: dict) -> DataFrame:
    """domain, lang, source, tokens -> the same with capacity and budget; one row per leaf."""
    leaves = leaves.withColumn("cap", F.col("tokens") * F.lit(float(max_epochs)))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap_l"))
    domains = langs.groupBy("domain").agg(F.sum("cap_l").alias("cap_d"))
    root = domains.agg((F.sum("cap_d") * F.lit(budget_fraction / max_epochs)).alias("root"))
    domains = domains.crossJoin(F.broadcast(root)).withColumn("w_d", _weight(domain_weights, F.col("domain"))).withColumn("top", F.lit(0))
    domains = water_fill(domains, ["top"], ["domain"], "root", "cap_d", "w_d", "budget_d")
    langs = langs.join(domains.select("domain", "budget_d"), "domain").withColumn("w_l", _weight(lang_weights, F.col("lang")))
    langs = water_fill(langs, ["domain"], ["lang"], "budget_d", "cap_l", "w_l", "budget_l")
    leaves = leaves.join(langs.select("domain", "lang", "budget_l"), ["domain", "lang"]).withColumn("w_s", _weight(source_weights, F.col("source")))
    leaves = water_fill(leaves, ["domain", "lang"], ["source"], "budget_l", "cap", "w_s", "budget")
    return leaves.select("domain", "lang", "source", "tokens", "cap", F.floor("budget").cast("long").alias("budget"))


def plan(docs: DataFrame, seed: str = SEED, budget_fraction: float = BUDGET_FRACTION, max_epochs: int = MAX_EPOCHS, domain_weights: dict = DOMAIN_WEIGHTS,
         lang_weights: dict = LANG_WEIGHTS, source_weights: dict | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, domain, lang, source, n_tokens, leaf_budget, copies (epochs in which it is taken)."""
    rows = docs.select("doc_id", domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), token_count(F.col("text")).alias("n_tokens"))
    rows = materialize(rows, "mix-rows")  # texts are read once, for their counts
    leaf = ["domain", "lang", "source"]
    sums = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    budgets = leaf_budgets(sums, budget_fraction, max_epochs, domain_weights, lang_weights, source_weights or {}).join(sums.select(*leaf, "rows"), leaf)
    # one running sum per epoch: epochs before the last are whole, the last one with a budget is a prefix
    spent = F.explode(F.sequence(F.lit(1), F.lit(max_epochs))).alias("epoch")
    shares = budgets.select(*leaf, "rows", "tokens", F.col("budget").alias("leaf_budget"), spent)
    shares = shares.withColumn("left", F.col("leaf_budget") - (F.col("epoch") - 1) * F.col("tokens"))
    shares = shares.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(rows_per_bucket))))
    dealt = rows.join(shares, leaf)
    dealt = dealt.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    dealt = dealt.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets") / F.lit(4294967296)))
    group = [*leaf, "epoch", "bucket"]
    buckets = dealt.groupBy(*group).agg(F.sum("n_tokens").alias("bucket_tokens"))
    before = F.coalesce(F.sum("bucket_tokens").over(W.partitionBy(*leaf, "epoch").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("before", before).drop("bucket_tokens")
    dealt = dealt.join(buckets, group)
    running = F.col("before") + F.sum("n_tokens").over(W.partitionBy(*group).orderBy("key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow))
    dealt = dealt.withColumn("taken", (running <= F.col("left")) & (F.col("left") > 0))
    return dealt.groupBy("doc_id", *leaf, "n_tokens", "leaf_budget").agg(F.sum(F.col("taken").cast("long")).alias("copies"), F.count("*").alias("_n")).drop("_n")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """Rows of docs as often as the plan takes them, all columns. Rows of one doc_id share its copies, in the order of their texts."""
    return shielded(docs, lambda d: _mix(d, **parameters))


def _mix(docs: DataFrame, **parameters) -> DataFrame:
    taken = plan(docs, **parameters).where("copies > 0").groupBy(F.col("doc_id").alias("_vs_id")).agg(F.sum("copies").alias("_vs_copies"))
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(taken["_vs_id"]))
    rows = W.partitionBy("_vs_id")
    share = F.floor((F.col("_vs_copies") + F.count("*").over(rows) - F.row_number().over(rows.orderBy(F.length("text"), "text"))) / F.count("*").over(rows))
    joined = joined.withColumn("_vs_share", share.cast("long")).where("_vs_share > 0")
    return joined.withColumn("_vs_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_vs_share")))).select(docs.columns)
