"""The batch kernels against the folds that state the result, on random boxes with ties, nulls and repeats."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veristrata.functions.exprs import iou
from veristrata.operators import kernels as K
from veristrata.operators import matching as M
from veristrata.plans import fixtures as FX

IMAGE = "img long, gts array<struct<j:int,x0:double,y0:double,x1:double,y1:double>>, preds array<struct<i:int,conf:double,model:int,x0:double,y0:double,x1:double,y1:double>>"


@pytest.fixture(scope="module")
def images(spark):
    rng = random.Random(5)
    box = lambda: (lambda x, y: (x, y, x + rng.randint(2, 5), y + rng.randint(2, 5)))(rng.randint(0, 5), rng.randint(0, 5))
    rows = []
    for k in range(400):
        gts = [(j, *map(float, box())) for j in range(rng.randint(0, 6))]
        preds = [(i, rng.randint(0, 4) / 4, rng.randint(0, 2), *map(float, box())) for i in range(rng.randint(0, 9))]
        if k % 50 == 1 and preds:
            preds[0] = (0, None, *preds[0][2:])
        if k % 50 == 2 and preds:
            preds[-1] = (*preds[-1][:4], None, *preds[-1][5:])
        if k % 50 == 3 and preds:
            preds[-1] = (*preds[-1][:3], float("nan"), *preds[-1][4:])
        if k % 50 == 4 and len(gts) > 1:
            gts[1] = (0, *gts[1][1:])
        rows.append((k, None if k == 7 else gts, None if k == 8 else preds))
    return spark.createDataFrame(rows, IMAGE).repartition(3).cache()


of = lambda k: F.filter("preds", lambda p: p["model"] == k)
CASES = {
    "greedy": lambda w: (M.greedy_match if w else M.greedy_fold)(F.col("preds"), F.col("gts")),
    "greedy_low": lambda w: (M.greedy_match if w else M.greedy_fold)(F.col("preds"), F.col("gts"), 0.3, high_index_wins=False, ties_last_first=True),
    "greedy_column": lambda w: (M.greedy_match if w else M.greedy_fold)(F.col("preds"), F.col("gts"), F.col("img") % 4 / 5),
    "union": lambda w: (M.union_nms if w else M.union_fold)(F.col("preds"), 0.3),
    "capped": lambda w: (M.union_nms if w else M.union_fold)(F.col("preds"), 0.5, cap=2, by_model=False),
    "audit": lambda w: (M.nms_audit if w else M.audit_fold)(F.col("preds"), 0.4),
    "pairs": lambda w: (M.global_match if w else M.global_fold)(of(0), of(1), 0.0),
    "fused": lambda w: M.union_match(F.col("preds"), 0.5, F.col("gts")) if w else M.greedy_fold(M.union_fold(F.col("preds"), 0.5), F.col("gts")),
    "hits": lambda w: (M.hits if w else M.hits_fold)(F.col("preds"), F.col("gts"), [0.5, 0.3, 0.8]),
    "nearest": lambda w: M.nearest(F.col("gts"), F.col("preds")) if w else F.transform("gts", lambda g: F.array_max(F.transform("preds", lambda p: F.struct(iou(g, p).alias("iou"), p["conf"].alias("conf"))))),
}


@pytest.mark.parametrize("name", CASES)
def test_kernels_equal_folds(images, name):
    got, want = ({r.img: str(r.x) for r in images.select("img", CASES[name](w).alias("x")).collect()} for w in (True, False))
    assert got == want


def test_empty_batches():
    """Batches without boxes, or without images."""
    box = [(s, pa.float64()) for s in K.SIDES]
    p, g = pa.list_(pa.struct([("i", pa.int32()), ("conf", pa.float64()), ("model", pa.int32()), *box])), pa.list_(pa.struct([("j", pa.int32()), *box]))
    for rows in ([], [[], None]):
        preds, gts = pa.array(rows, p), pa.array(rows, g)
        assert K.fusion_counts(preds, gts, [((0,), 0.5)], 0.25, 0, True) == K.policy_counts(preds, gts, (0, 1), [(1, 0.3, "BOTH")], 0.25) == [(0, 0, 0, 0, 0)]
        for out in (K.local_boxes(preds, (0, 1)), K.consensus(preds, (0, 1), 0.3, 0.5), K.signals(preds, (0, 1)), K.hits(preds, gts, [0.5])):
            assert len(out) == len(rows)


def test_rounding_is_sparks(spark):
    values = [0.1234567885, 0.1234567895, 0.5000000005, -0.1234567885, 1 / 3, 0.0, 1.0, 2.5e-10, 5e-10, *[k / 997 for k in range(500)]]
    want = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 9).alias("v")).collect()]
    assert K.rounded(np.array(values)).tolist() == want


def test_plain_images_never_reach_the_fold(images):
    """What was slow before: the fold runs for images with nulls or repeats only."""
    plan = images.select(M.greedy_match(F.col("preds"), F.col("gts")).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_images_are_dealt_once(spark):
    """True boxes and predictions were dealt and collected apart, and dealt again by image."""
    df = FX.images(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
