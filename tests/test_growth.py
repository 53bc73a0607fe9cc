"""Plans that once grew faster than their tables: rows are dealt once, and no group, object or value becomes a task."""

import random

import pytest
from pyspark.sql import functions as F

from veristrata.operators import metrics as X
from veristrata.operators import stats as S
from veristrata.operators import windows as N
from veristrata.plans import registry

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["strategy_chain", "strategy_cells", "strategy_matrix", "pareto_steps", "localisation_failures", "tile_remap", "local_best", "consensus_scales"])
def test_objects_are_dealt_by_image_alone(spark, name):
    """They were joined by object, with an exchange for either side."""
    text = plan(registry.queries()[name](spark, DIR))
    assert text.count("hashpartitioning(l_orderkey") <= 1 and "hashpartitioning(img" not in text


@pytest.mark.parametrize("name", ["tile_coverage", "coverage_grid"])
def test_tiles_of_an_object_are_no_rows(spark, name):
    """An object's tiles were rows, grouped by object, or an array for each setting."""
    text = plan(registry.queries()[name](spark, DIR))
    assert "transform(" not in text and "hashpartitioning(img" not in text


@pytest.mark.parametrize("name", ["fusion_grid_paired", "det_fusion_grid", "policy_summary"])
def test_settings_are_no_rows(spark, name):
    """Each image was a row for each setting."""
    text = plan(registry.queries()[name](spark, DIR))
    assert "MapInArrow" in text and "Generate" not in text


def test_correlation_with_a_constant_is_null_whatever_the_partitions(spark):
    for rows in (49, 98, 103, 107):
        df = spark.range(0, rows * 4, 1, 4).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.when(F.col("id") % 2 == 0, F.col("id")).cast("double").alias("half"))
        assert df.agg(S.safe_corr(F.col("x"), F.col("y")).alias("r")).first().r is None
        assert df.agg(S.safe_corr(F.col("x"), F.col("half")).alias("r")).first().r == pytest.approx(1.0)


def test_average_precision_deals_a_prediction_once(spark):
    """By plain ranking, with ties of confidence over images, images without boxes, and an overlap that nothing reaches."""
    rng = random.Random(3)
    box = lambda: (lambda x, y: (x, y, x + rng.randint(3, 5), y + rng.randint(3, 5)))(rng.randint(0, 4), rng.randint(0, 4))
    images = [(k, [(j, *map(float, box())) for j in range(rng.randint(0, 3))], [(i, rng.randint(0, 5) / 5, *map(float, box())) for i in range(rng.randint(0, 5))]) for k in range(120)]
    df = spark.createDataFrame(images, "img long, gts array<struct<j:int,x0:double,y0:double,x1:double,y1:double>>, preds array<struct<i:int,conf:double,x0:double,y0:double,x1:double,y1:double>>")

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        s = max(0, w) * max(0, h)
        return s / max(1e-12, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - s)

    def plain(least):
        rows = []
        for k, gts, preds in images:
            used = set()
            for p in sorted(preds, key=lambda p: (-p[1], -p[0])):
                best = max(((iou(g[1:], p[2:]), g[0]) for g in gts if g[0] not in used), default=(0, 0))
                if gts and best[0] >= least:
                    used.add(best[1])
                rows.append((p[1], k, p[0], bool(gts) and best[0] >= least))
        tp, best, total = 0, [0.0] * 101, sum(len(g) for _, g, _ in images)
        for n, (*_, hit) in enumerate(sorted(rows, reverse=True), 1):
            tp += hit
            for point in range(int(tp / total * 100 + 1e-9) + 1):
                best[point] = max(best[point], tp / n)
        return sum(best) / 101

    got = {r.overlap: r.ap for r in X.average_precision(df, [0.5, 0.3, 1.1]).collect()}
    assert got == {t: pytest.approx(plain(t)) for t in (0.5, 0.3, 1.1)}


def test_quantiles_of_groups_come_from_counts(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randint(0, 2), rng.choice([None, *[rng.randint(0, 9) / 2] * 9])) for _ in range(400)]
    df = spark.createDataFrame(rows, "f string, g int, v double").repartition(3)
    got = {(r.f, r.g): r.quantiles for r in S.ks_to_all(df, ["f"], "g", 3, "v", [0.1, 0.5, 0.9]).collect()}
    want = df.where("v is not null").groupBy("f", "g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")).collect()
    assert got == {(r.f, r.g): pytest.approx(r.q) for r in want}


def test_numbered_rows_are_dealt_once(spark):
    """Places came from a window over each range, which dealt and sorted all rows again."""
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    text = plan(N.numbered(df, ["g"], [F.desc("id")], "place", "of"))
    assert "Window" not in text.split("BroadcastExchange")[0]


def test_keys_at_places_are_those_of_the_whole_order(spark, monkeypatch):
    """Only rows of the bins that hold a place are put in order; all rows were."""
    rng = random.Random(6)
    rows = [(g, rng.choice([None, 0.0, 0.5, rng.random()]), rng.randint(0, 9), k) for k in range(900) for g in (rng.choice("ab"),)] + [("c", 1.0, 1, 5), ("d", None, 1, 6)]
    df = spark.createDataFrame(rows, "g string, v double, img int, i int").repartition(4)
    put, numbered = [], N.numbered
    monkeypatch.setattr(N, "numbered", lambda rows, *a: put.append(rows.count()) or numbered(rows, *a))
    for descending in (False, True):
        got = sorted(N.keys_at(df, "g", "v", ["img", "i"], [0.1, 0.6, 0.95], descending, least=1), key=repr)
        want = []
        for g in "abcd":
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: ((r[1] is None, -(r[1] or 0)) if descending else (r[1] is not None, r[1] or 0), r[2], r[3]))
            want += [(g, s, *mine[max(1, -int(-len(mine) * s // 1)) - 1][1:]) for s in (0.1, 0.6, 0.95)]
        assert got == sorted(want, key=repr)
    assert max(put) < len(rows) and N.keys_at(df.limit(0), "g", "v", ["img", "i"], [0.5]) == []
