"""Pixel kernels, label checks and fold assignment against plain forms."""

import math
import statistics
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristrata.functions import pixels as P
from veristrata.operators import checks as K
from veristrata.operators import groups as G
from veristrata.operators import resample as R
from veristrata.operators import stats as S
from veristrata.operators import windows as N
from veristrata.sources import tables as T

RNG = np.random.default_rng(4)


def test_marks_are_components_with_a_rectangle_test():
    mask = np.zeros((20, 20), bool)
    mask[2:10, 3:12] = True
    mask[3:9, 4:11] = False
    mask[10, 12] = True  # touches the frame's corner
    mask[15:18, 15:18] = True
    got = P.marks(mask)
    assert [m["size"] for m in got] == [31, 9] and [m["rectangle"] for m in got] == [True, False]
    assert got[0]["box"] == (3, 2, 13, 11) and got[1]["fill"] == 1.0
    assert P.marks(np.zeros((3, 3), bool)) == []


def test_palette_statistics_equal_those_of_the_image():
    luma, index = np.array([10, 200, 10, 77, 0]), RNG.integers(0, 4, 501)
    got = P.palette_statistics(luma, np.bincount(index, minlength=5))
    pixels = luma[index].astype(float)
    assert got["mean"] == pytest.approx(pixels.mean()) and got["std"] == pytest.approx(pixels.std())
    assert [got["q5"], got["q50"], got["q95"]] == pytest.approx(list(np.percentile(pixels, [5, 50, 95])))


def test_sobel_against_sums():
    image = RNG.integers(0, 256, (7, 9))
    got = P.sobel(image)
    at = lambda y, x: float(image[6 - abs(6 - abs(y)), 8 - abs(8 - abs(x))])
    for y in range(7):
        for x in range(9):
            gx = sum(w * (at(y + d, x + 1) - at(y + d, x - 1)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(w * (at(y + 1, x + d) - at(y - 1, x + d)) for d, w in ((-1, 1), (0, 2), (1, 1)))
            assert got[y, x] == pytest.approx(math.hypot(gx, gy) / 8)


def test_surroundings_and_local_features():
    image = RNG.integers(90, 110, (40, 40))
    image[10:16, 12:20] = 30
    mask = np.zeros(image.shape, bool)
    mask[8, 10:14] = True
    box, other = (12, 10, 20, 16), (20, 10, 23, 12)
    around, counts = P.surroundings(image.shape, box, 2.0, mask, [other])
    plain = [(x, y) for y in range(7, 19) for x in range(8, 24) if not (12 <= x < 20 and 10 <= y < 16)]
    assert counts["candidates"] == len(plain) and counts["masked"] == 4 and counts["in_others"] == 6
    assert {(x, y) for x, y in plain if not mask[y, x] and not (20 <= x < 23 and 10 <= y < 12)} == {(int(x), int(y)) for y, x in zip(*np.nonzero(around))}
    got = P.local_features(image, box, 2.0, mask, [other])
    outer = [float(image[y, x]) for y, x in zip(*np.nonzero(around))]
    middle = statistics.median(outer)
    mad = statistics.median(abs(v - middle) for v in outer)
    assert got["signed_median"] == 30 - middle and got["cnr_robust"] == pytest.approx(abs(30 - middle) / (1.4826 * mad + 1e-6)) and got["object_entropy"] == 0
    assert math.isnan(P.local_features(image, box, 1.0)["signed_mean"])
    seen = P.box_visibility(image, (12.0, 10.0, 20.0, 16.0), [other])
    assert seen["valid"] and seen["contrast"] > 50 and not P.box_visibility(image, (50.0, 50.0, 50.0, 50.0))["valid"]


def test_outline_of_a_closed_dark_component():
    image = np.full((40, 40), 220, np.uint8)
    image[8:32, 8:32] = 40
    image[15:20, 15:20] = 220  # a hole
    image[20, 8:32] = 220  # a thin gap
    none = np.zeros(image.shape, bool)
    whole, at = P.dark_component(image, none, closed=True)
    assert 40 <= at < 220 and whole[20, 10] and not whole[17, 17]
    part, _ = P.dark_component(image, none)
    assert part.sum() < whole.sum() and P.component_overlap(part, whole) == part.sum() / whole.sum() and math.isnan(P.component_overlap(none, none))
    assert P.component_quality(whole)["failures"] == [] and P.component_quality(none)["failures"] == ["empty"]
    assert "border" in P.component_quality(np.ones((40, 40), bool))["failures"]
    edge = P.outline(whole)
    assert edge[8, 8] and edge[31, 20] and not edge[14, 17] and edge.sum() == 4 * 24 - 4


def test_close_against_a_plain_form():
    mask = RNG.random((12, 14)) < 0.3
    wide = {(y + a, x + b) for y, x in zip(*np.nonzero(mask)) for a in (-1, 0, 1) for b in (-1, 0, 1)}
    want = [[0 < y < 11 and 0 < x < 13 and all((y + a, x + b) in wide for a in (-1, 0, 1) for b in (-1, 0, 1)) for x in range(14)] for y in range(12)]
    assert (P.close3(mask) == np.array(want)).all()


def test_repairs_have_a_reach():
    image = np.arange(225).reshape(15, 15).astype(np.uint8)
    mask = np.zeros(image.shape, bool)
    mask[4:11, 4:11] = True  # the middle is four from the rim
    assert P.repair_median(image, mask)[7, 7] == np.rint(np.median(image[3:12, 3:12][~mask[3:12, 3:12]]))
    mask[1:14, 1:14] = True
    assert P.repair_median(image, mask)[7, 7] == image[7, 7] and P.repair_directions(image, mask)[7, 7] == image[7, 7]
    assert P.repair_directions(image, mask)[7, 3] == image[7, 0]


def test_shrunk_image_keeps_places():
    image = RNG.integers(0, 256, (40, 60)).astype(np.uint8)
    image[18:22, 28:32] = 255
    got, left, top = P.shrunk(image)
    assert got.shape == image.shape and (left, top) == (3, 2) and got[20, 30] == 255
    assert (got[top : top + 36, left - 1] == got[top : top + 36, left + 1]).all()
    flat, _, _ = P.shrunk(np.full((10, 10), 7, np.uint8))
    assert (flat == 7).all()


def test_ring_sensitivity_and_choice():
    image = RNG.integers(98, 103, (60, 60))
    image[25:35, 25:35] = 20
    rows = P.ring_sensitivity(image, (25, 25, 35, 35), (1.2, 2.0, 3.0))
    assert [r["valid"] for r in rows] == [12 * 12 - 100, 300, 800] and rows[1]["from_reference"] == 0 and [r["reliable"] for r in rows] == [False, True, True]
    assert P.choose_ring(rows) == 2.0 and P.choose_ring(rows[:1]) == 1.2
    assert P.ring_sensitivity(image, (0, 0, 10, 10), (2.0,))[0]["clipped"] > 0.4


def test_repair_effects_and_changed_histograms():
    image = RNG.integers(98, 103, (30, 30)).astype(np.uint8)
    mask = np.zeros(image.shape, bool)
    mask[10, 5:20] = True
    marked = np.where(mask, 255, image).astype(np.uint8)
    fixed = P.repair_median(marked, mask)
    got = P.repair_effects(marked, fixed, mask)
    assert got["changed_outside"] == 0 and got["leak_before"] == 1 and got["leak_after"] == 0 and got["gradient_shift"] > 10
    region = np.zeros(image.shape, bool)
    region[5:15, 8:30] = True
    counts = P.updated_histogram(np.bincount(marked[region], minlength=256), marked, fixed, mask, region)
    assert (counts == np.bincount(fixed[region], minlength=256)).all()


def test_frozen_files(spark):
    files = spark.createDataFrame([("a", "11"), ("b", "22")], "stem string, sha256 string")
    K.frozen(files, {"a": "11"})
    with pytest.raises(ValueError, match="b; c"):
        K.frozen(files, {"a": "11", "b": "23", "c": "1"})


def bmp(image):
    h, w = image.shape
    rows = b"".join(bytes(r) + b"\0" * (-w % 4) for r in image[::-1])
    table = b"".join(bytes([k, k, k, 0]) for k in range(256))
    head = 54 + len(table)
    return b"BM" + struct.pack("<IHHI", head + len(rows), 0, 0, head) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, len(rows), 0, 0, 256, 0) + table + rows


def test_boundary_audit(spark):
    good, bad = np.full((40, 40), 220, np.uint8), np.full((40, 40), 220, np.uint8)
    good[8:32, 8:32] = 40
    bad[0:4, 0:4] = 40
    df = spark.createDataFrame([("good", bytearray(bmp(good))), ("bad", bytearray(bmp(bad)))], "path string, content binary")
    got = {r.path: r for r in P.boundary_audit(df).collect()}
    assert got["good"].passes and got["good"].overlap == 1.0 and got["good"].outline == 92
    assert not got["bad"].passes and "area" in got["bad"].failures


def test_label_status_and_date_conflicts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n0 0.9 0.5 0.4 0.2\n")
    (tmp_path / "b.txt").write_text("0 0.5 0.5 0.2 0.2\n")
    (tmp_path / "c.txt").write_text("0 0.5 0.5 0 0.2\n0 0.1\n")
    got = {r.stem: (r.objects, r.invalid, r.out_of_bounds, r.status) for r in T.label_status(T.read_labels(spark, str(tmp_path))).collect()}
    assert got == {"a": (2, False, True, "REVIEW"), "b": (1, False, False, "OK"), "c": (2, True, False, "REVIEW")}
    paths = spark.createDataFrame([("m/SN1_20240101_x/001_20240101_101010(1)",), ("m/SN1_20240101_x/001_20240102_101010(1)",), ("m/x/001_20240102_101010(1)",)], "p string")
    assert [r.c for r in paths.select(T.date_conflict(F.col("p")).alias("c")).collect()] == [False, True, False]


def plain_folds(vectors, sizes, family, weights, folds):
    """Every fold's whole cost, as the sum over families of the mean squared deviation of their tokens."""
    totals = {}
    for v in vectors.values():
        for t, n in v.items():
            totals[t] = totals.get(t, 0) + n
    rarity = {g: round(max(n / max(1, totals[t]) for t, n in v.items()), 12) for g, v in vectors.items()}
    held, size, out = [{} for _ in range(folds)], [0] * folds, {}
    for g in sorted(vectors, key=lambda g: (-sizes[g], -rarity[g], g)):
        def cost(f):
            score = 0.0
            for name in set(family.values()):
                tokens = [t for t in totals if family[t] == name]
                score += weights.get(name, 1.0) / len(tokens) * sum(((held[k].get(t, 0) + (vectors[g].get(t, 0) if k == f else 0) - totals[t] / folds) / max(1.0, totals[t] / folds)) ** 2 for t in tokens for k in range(folds))
            return score
        costs = [cost(f) for f in range(folds)]
        least = min(costs)
        best = min((f for f in range(folds) if costs[f] <= least + 1e-9), key=lambda f: (size[f], f))
        out[g] = best + 1
        size[best] += sizes[g]
        for t, n in vectors[g].items():
            held[best][t] = held[best].get(t, 0) + n
    return out


def test_vector_folds_against_a_plain_form(spark):
    rng = np.random.default_rng(9)
    rows, vectors, sizes, family = [], {}, {}, {}
    for g in range(30):
        sizes[g] = int(rng.integers(1, 9))
        for name, token in [("sample", "ALL"), *(("m", f"t{k}") for k in rng.choice(5, 2, replace=False)), ("d", f"t{int(rng.integers(3))}")]:
            n = sizes[g] if name == "sample" else int(rng.integers(1, 6))
            rows.append((g, sizes[g], name, token, n))
            vectors.setdefault(g, {})[f"{name}:{token}"] = n
            family[f"{name}:{token}"] = name
    weights = {"sample": 5.0, "m": 2.0}
    df = spark.createDataFrame(rows, "group_id long, size long, family string, token string, n long")
    got = {r.group_id: r.fold_id for r in G.assign_vector_folds(df, weights, 3).collect()}
    assert got == plain_folds(vectors, sizes, family, weights, 3)


def test_running_sums_and_cuts_of_empty_and_tied_values(spark):
    df = spark.createDataFrame([("a", float(v % 7), 1 + v % 3) for v in range(60)], "g string, v double, n int").groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = sorted((r.v, r.n, r.upto, r.total) for r in N.running_sums(df, ["g"], "v", {"n": "upto"}, {"n": "total"}).collect())
    upto = 0
    for _, n, seen, total in got:
        upto += n
        assert seen == upto and total == sum(r[1] for r in got)
    values = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (None,), (10.0,)], "v double")
    assert S.quantile_cuts(values, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).first().cuts == pytest.approx([1.0, 1.5, 7.6, 10.0])
    assert S.quantile_cuts(values.limit(0), "v", [0.5]).first().cuts == []


def test_logistic_stability_against_refits(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(240, 2)), rng.integers(0, 6, 240)
    y = (rng.random(240) < 1 / (1 + np.exp(-(1.2 * x[:, 0] + 0.05 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(k), int(g)) for (a, b), k, g in zip(x, y, c, strict=True)], "a double, b double, y int, c int")
    got = {r.feature: (r.coefficient, r.same_sign) for r in R.logistic_stability(df, ["a", "b"], "y", "c", 6, 8).collect()}
    z = np.c_[np.ones(240), (x - x.mean(0)) / x.std(0)]

    def refit(w):
        beta, ridge = np.zeros(3), np.diag([0.0, 1.0, 1.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-z @ beta))
            beta = beta - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ beta)
        return beta

    def drawn(rep, k):
        v = (rep * 7919 + k * 104729 + 7) % R.LCG_M
        for _ in range(2):
            v = (v * R.LCG_A + R.LCG_C) % R.LCG_M
        return v % 6

    full = refit(np.ones(240))
    each = [refit(np.bincount([drawn(rep, k) for k in range(6)], minlength=6)[c].astype(float)) for rep in range(8)]
    for k, name in ((1, "a"), (2, "b")):
        assert got[name] == pytest.approx((full[k], np.mean([np.sign(e[k]) == np.sign(full[k]) for e in each])), abs=1e-5)


def test_fold_assignment_against_a_plain_form(spark):
    sizes = {g: int(n) for g, n in enumerate(np.random.default_rng(6).integers(1, 30, 25))}
    held, want = [0, 0, 0, 0], {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        cost = [sum((held[k] + sizes[g] * (k == f) - sum(sizes.values()) / 4) ** 2 for k in range(4)) for f in range(4)]
        best = min(range(4), key=lambda f: (cost[f], held[f], f))
        held[best] += sizes[g]
        want[g] = best + 1
    df = spark.createDataFrame(list(sizes.items()), "group_id long, size long")
    assert {r.group_id: r.fold_id for r in G.assign_folds(df).collect()} == want
