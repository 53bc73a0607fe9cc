"""Hand-written cases for the tie rules, suppression chains, bins, gaps, sources, pixels and checks."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.functions import exprs as E
from veristrata.functions import pixels as P
from veristrata.operators import checks as K
from veristrata.operators import groups as G
from veristrata.operators import matching as M
from veristrata.operators import metrics as X
from veristrata.operators import resample as R
from veristrata.operators import stats as S
from veristrata.operators import windows as N
from veristrata.sources import tables as T

IMAGE = "img long, fold_id int, gts array<struct<j:int,x0:double,y0:double,x1:double,y1:double>>, preds array<struct<i:int,conf:double,model:int,x0:double,y0:double,x1:double,y1:double>>"


def image(spark, gts, preds):
    return spark.createDataFrame([(1, 1, [(k, *map(float, b)) for k, b in enumerate(gts)], [(k, c, m, *map(float, b)) for k, (c, m, b) in enumerate(preds)])], IMAGE)


def test_equal_overlap_goes_to_the_declared_index(spark):
    df = image(spark, [(0, 0, 10, 10), (0, 0, 10, 10)], [(0.9, 0, (0, 0, 10, 10))])
    assert M.matched(df).first().match[0].j == 1
    assert M.matched(df, high_index_wins=False).first().match[0].j == 0


def test_confidence_ties_follow_the_declared_order(spark):
    df = image(spark, [(0, 0, 10, 10)], [(0.5, 0, (0, 0, 10, 8)), (0.5, 0, (0, 0, 10, 10))])
    assert [m.i for m in M.matched(df).first().match] == [0, 1]
    assert [m.i for m in M.matched(df, ties_last_first=True).first().match] == [1, 0]


def test_consumed_object_is_a_localisation_failure(spark):
    df = image(spark, [(0, 0, 10, 10), (0, 0, 10, 9)], [(0.9, 0, (0, 0, 10, 9.4))])
    kinds = {r.gt_index: r.error_type for r in X.object_outcomes(M.matched(df), 0.25).collect()}
    assert sorted(kinds.values()) == ["LOCALIZATION_FAILURE", "MATCHED"]


def test_suppression_chain_keeps_the_third(spark):
    df = image(spark, [], [(0.9, 0, (0, 0, 10, 10)), (0.8, 1, (3, 0, 13, 10)), (0.7, 0, (6, 0, 16, 10))])
    kept = df.select(M.union_nms(F.col("preds"), 0.5).alias("k")).first().k
    assert [(k.i, k.models, k.suppressed) for k in kept] == [(0, [0, 1], 1), (2, [0], 0)]


def test_global_match_is_one_to_one(spark):
    df = image(spark, [], [(0.9, 0, (0, 0, 10, 10)), (0.8, 0, (0, 0, 10, 9)), (0.7, 1, (0, 0, 10, 10))])
    pairs = df.select(M.global_match(F.slice("preds", 1, 2), F.slice("preds", 3, 1), 0.5).alias("p")).first().p
    assert [(p.ai, p.bi) for p in pairs] == [(0, 2)]


def test_gap_equal_to_the_limit_stays(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', TIMESTAMP_NTZ'2024-01-01 00:00:00'), (2, 'a', TIMESTAMP_NTZ'2024-01-01 00:00:10'), (3, 'a', TIMESTAMP_NTZ'2024-01-01 00:00:20.000001') t(id, u, ts)")
    got = {r.id: r.session for r in N.gap_sessions(rows, ["u"], "ts", "id", [10]).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_right_closed_bins_and_collapsed_cuts(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 2, 9)], "v double")
    cuts = S.quantile_cuts(df, "v", [0.25, 0.5, 0.75])
    got = [r.b for r in df.crossJoin(cuts).select(E.right_closed_bin(F.col("v"), F.col("cuts")).alias("b")).collect()]
    assert got == [0, 0, 0, 0, 2, 2]


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(S.safe_corr(F.col("a"), F.col("b")).alias("r")).first().r is None


def test_ratio_of_nothing(spark):
    r = spark.range(1).select(E.ratio(F.lit(0), F.lit(0)).alias("a"), E.ratio(F.lit(0), F.lit(0), None).alias("b")).first()
    assert (r.a, r.b) == (0.0, None)


def test_tile_starts(spark):
    r = spark.range(1).select(E.tile_starts(F.lit(64), 24, 18).alias("a"), E.tile_starts(F.lit(20), 24, 18).alias("b")).first()
    assert (r.a, r.b) == ([0, 18, 36, 40], [0])


def test_components_and_folds(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (7, 8)], "a long, b long")
    got = {r.node: r.component for r in G.components(links, "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    groups = spark.createDataFrame([(k, n) for k, n in enumerate([9, 7, 5, 5, 3, 1])], "group_id long, size long")
    sizes = {r.fold_id: r.s for r in G.assign_folds(groups, 2).groupBy("fold_id").agg(F.sum("size").alias("s")).collect()}
    assert sorted(sizes.values()) == [15, 15]


def test_logistic_matches_a_direct_solution(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.3)))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    got = R.newton_logistic(df, ["a", "b"], "y")
    z = np.c_[np.ones(300), (x - x.mean(0)) / x.std(0)]
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([0, 1, 1]), z.T @ (p - y) + np.diag([0, 1, 1]) @ beta)
    assert np.allclose([got["intercept"], got["a"], got["b"]], beta, atol=1e-6)


def test_csv_json_and_labels(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿stem,boxes,v\nx,\"[[1,2,3,4]]\",NaN\ny,,1.5\nz,\"{}\",\n".encode())
    df = T.read_csv(spark, str(tmp_path / "a.csv"), "stem string, boxes string, v double")
    rows = {r.stem: (r.b, r.v) for r in df.select("stem", T.json_boxes(F.col("boxes")).alias("b"), "v").collect()}
    assert rows == {"x": ([[1.0, 2.0, 3.0, 4.0]], None), "y": ([], 1.5), "z": ([], None)}
    T.write_csv(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        T.write_csv(df, str(tmp_path / "out"))
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/s1.txt").write_text("0 0.5 0.5 0.5 0.25\n1 0.9 0.5 0.5 0.5\n0 x 1\n")
    labels = T.read_labels(spark, str(tmp_path / "labels"))
    got = [(r.five_fields, r.finite, r.class_ok, r.inside) for r in labels.orderBy("object_id").collect()]
    assert got == [(True, True, True, True), (True, True, False, False), (False, False, True, False)]
    box = T.corners(labels.where("object_id = 0"), F.lit(100), F.lit(40)).first()
    assert (box.x0, box.y0, box.x1, box.y1) == (25.0, 15.0, 75.0, 25.0)
    parts = spark.createDataFrame([("M1_0042_20240131_101530(7)",)], "n string").select(*[c.alias(k) for k, c in T.file_name_parts(F.col("n")).items()]).first()
    assert (parts.prefix, parts.date, parts.time, parts.opaque, str(parts.timestamp)) == ("M1", "20240131", "101530", "7", "2024-01-31 10:15:30")


def bmp(image):
    h, w = image.shape
    stride = (w + 3) // 4 * 4
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256))
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = image[::-1]
    head = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", head + rows.size, 0, 0, head) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 0, 0, 256, 0) + palette + rows.tobytes()


def test_pixels(spark, tmp_path):
    image = np.zeros((20, 30), np.uint8)
    image[5:12, 8:20] = 200
    (tmp_path / "a.bmp").write_bytes(bmp(image))
    assert (P.decode_bmp(bmp(image)) == image).all()
    files = T.files(spark, str(tmp_path), "*.bmp")
    w, h = T.image_size(F.col("content"))
    assert tuple(files.select(w.alias("w"), h.alias("h")).first()) == (30, 20)
    row = P.image_statistics(files).first()
    assert (row.width, row.height, row.median, len(row.dhash)) == (30, 20, 0.0, 4)
    assert P.largest_component(image > P.otsu(image)).sum() == 7 * 12
    assert P.box_mean(P.integral(image), 8, 5, 20, 12) == 200
    assert P.gradient(image).max() > 0 and P.contrast(image, (8, 5, 20, 12), 3)["mean_difference"] == 200


def test_checks(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 2.0)], "k long, v double")
    status = K.status(K.unique_key(df, "k"), K.holds(df, "range", "v between 0 and 1"), K.subset(df, df, "k", "k"))
    assert {r["check"]: r["status"] for r in status.collect()} == {"unique k": "FAIL", "range": "FAIL", "k in k": "PASS"}
    with pytest.raises(ValueError, match="unique k"):
        K.require(status)


def test_box_expressions(spark):
    df = spark.createDataFrame([(" TRUE ", "1e400", ""), ("no", "7", "b")], "t string, n string, s string")
    got = [tuple(r) for r in df.select(E.is_true(F.col("t")).alias("a"), E.number(F.col("n")).alias("b"), E.first_filled(F.col("s"), F.lit("z")).alias("c")).collect()]
    assert got == [(True, None, "z"), (False, 7.0, "b")]


def test_optimizer_updates():
    from veristrata.operators.selection import optimizer_updates

    got = optimizer_updates(376, 8, 3, warmup_epochs=0)
    assert got == {"batches_per_epoch": 47, "micro_batches": 141, "warmup": 0, "updates": 17}
    assert optimizer_updates(376, 8, 3)["updates"] > 17


def test_repair_and_enhancement_kernels():
    image = np.full((12, 12), 50, np.uint8)
    mask = np.zeros((12, 12), bool)
    mask[4:6, 4:6] = True
    image[mask] = 255
    assert (P.repair_median(image, mask) == 50).all() and (P.repair_directions(image, mask) == 50).all()
    rgb = np.stack([image, np.full_like(image, 10), np.full_like(image, 10)], axis=2)
    assert (P.chromatic_mask(rgb) == mask).all()
    assert P.replicated_crop(image, -2, -2, 2, 2).shape == (4, 4)
    ramp = np.arange(144, dtype=np.uint8).reshape(12, 12)
    assert P.tile_equalise(ramp, 12).max() == 255 and P.percentile_window(ramp).min() == 0
    assert P.edge_centroid(np.ones((12, 12)), mask) == (4.5, 4.5) and P.edge_centroid(np.zeros((12, 12)), mask) is None
