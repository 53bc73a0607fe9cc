"""Near pairs on planted texts, checks that raise, ranks over ranges, sinks, pixel transforms, the shipped package."""

import random
import subprocess
import sys
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import veristrata
from veristrata.functions import pixels as P
from veristrata.operators import checks as K
from veristrata.operators import windows as N
from veristrata.plans import analytics
from veristrata.sources import tables as T


def bits(text):
    grid = [ord(text[int(k * len(text) / 272)]) for k in range(272)]
    return [grid[r * 17 + c] > grid[r * 17 + c + 1] for r in range(16) for c in range(16)]


def test_near_pairs_of_planted_texts(spark, tmp_path):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghij") for _ in range(400)) for _ in range(6)]
    for k in range(6):
        for changes in (0, 1, 2, 4, 9):
            t = list(texts[k])
            for _ in range(changes):
                t[r.randrange(400)] = r.choice("abcdefghij")
            texts.append("".join(t))
    spark.createDataFrame(list(enumerate(texts + ["short"])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hashes = [bits(t) for t in texts]
    first = {}
    for k, h in enumerate(hashes):
        first.setdefault(tuple(h), k)
    want = {(first[tuple(h)], k, 0) for k, h in enumerate(hashes) if first[tuple(h)] < k}
    reps = sorted(first.values())
    for a in reps:
        for b in reps:
            distance = sum(x != y for x, y in zip(hashes[a], hashes[b], strict=True))
            if a < b and distance <= 8:
                want.add((a, b, distance))
    assert any(0 < d <= 8 for *_, d in want)
    assert {tuple(x) for x in analytics.near_duplicate_pairs(spark, str(tmp_path)).collect()} == want


def test_same_keys_raises(spark):
    a, b = spark.range(3).select("id", F.lit(1).alias("x")), spark.range(3).select("id", F.lit(2).alias("y"))
    assert K.same_keys(a, b, ["id"]).count() == 3
    for bad in (b.where("id > 0"), b.union(b)):
        with pytest.raises(ValueError):
            K.same_keys(a, bad, ["id"])


def test_coverage_and_expectations(spark):
    parts, whole = spark.createDataFrame([(1,), (1,), (2,), (9,)], "k long"), spark.createDataFrame([(1,), (2,), (3,)], "k long")
    assert tuple(K.coverage(parts, whole, "k").first()) == (4, 1, 1, 1)
    want = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "m string, v double")
    got = spark.createDataFrame([("a", 1.0 + 1e-12), ("b", 2.1)], "m string, v double")
    assert {r.m: r.ok for r in K.reproduces(got, want, "m", "v").collect()} == {"a": True, "b": False, "c": False}


def test_places_over_ranges(spark):
    r = random.Random(2)
    rows = [(k, r.choice("ab"), r.choice([1.0, 1.0, 2.0, 3.0, None])) for k in range(500)]
    got = N.numbered(spark.createDataFrame(rows, "id long, g string, v double").repartition(5), ["g"], [F.asc_nulls_last("v"), F.asc("id")], "place", "of").collect()
    for g in "ab":
        mine = sorted((x for x in rows if x[1] == g), key=lambda x: (x[2] is None, x[2] or 0, x[0]))
        assert {x.id: (x.place, x.of) for x in got if x.g == g} == {x[0]: (k + 1, len(mine)) for k, x in enumerate(mine)}
    assert N.numbered(spark.createDataFrame([], "id long, g string, v double"), [], [F.asc("v")], "place", "of").collect() == []


def test_sinks(spark, tmp_path):
    lists = spark.createDataFrame([(1, "train", "b"), (1, "train", "a"), (1, "test", "c"), (2, "train", "c")], "fold int, partition string, name string")
    T.write_fold_lists(lists, f"{tmp_path}/lists")
    back = spark.read.text(f"{tmp_path}/lists")
    assert sorted((r.fold, r.partition, r.value) for r in back.collect()) == [(1, "test", "c"), (1, "train", "a"), (1, "train", "b"), (2, "train", "c")]
    said = {r.fold: r.document for r in T.fold_documents(lists, ["gun", "50% off"]).collect()}
    assert said[2] == "train: fold=2/partition=train\nval: fold=2/partition=test\nnames:\n  0: gun\n  1: 50% off"
    (tmp_path / "doc.json").write_text('{\n "a": 1,\n "b": [1, 2]\n}')
    doc = T.read_document(spark, f"{tmp_path}/doc.json", "a long, b array<long>")
    assert tuple(doc.first()) == (1, [1, 2])
    T.write_document(doc, f"{tmp_path}/out")
    assert tuple(spark.read.json(f"{tmp_path}/out").first()) == (1, [1, 2])
    with pytest.raises(ValueError):
        T.write_manifest(lists, f"{tmp_path}/manifest", "name")
    T.write_manifest(lists.dropDuplicates(["name"]), f"{tmp_path}/manifest", "name")
    assert spark.read.option("header", True).csv(f"{tmp_path}/manifest").count() == 3


def test_transforms():
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (24, 20)).astype(np.uint8)
    for name in P.TRANSFORMS:
        out = P.transformed(image, name)
        assert out.shape == image.shape and out.dtype == np.uint8
    with pytest.raises(KeyError):
        P.transformed(image, "none")
    assert (P.median_filter(image)[5, 7] == np.median(image[4:7, 6:9]).astype(np.uint8)) and (P.gamma(image, 1.0) == image).all()
    flat = np.full((9, 9), 100, np.uint8)
    assert np.allclose(P.blur(flat), 100) and (P.sharpen(flat) == flat).all()
    assert P.complexity(flat) == {"entropy": 0.0, "edges": 0.0, "std": 0.0}
    halves = np.repeat([[0, 255]], 8, axis=0).repeat(4, axis=1).astype(np.uint8)
    assert P.complexity(halves)["entropy"] == 1.0
    region, hidden = np.ones((10, 10), bool), np.zeros((10, 10), bool)
    hidden[:3] = True
    assert P.usable(region, hidden)
    hidden[:4] = True
    assert not P.usable(region, hidden) and not P.usable(region[:5, :5], hidden[5:, 5:])


def test_the_package_works_from_a_zip(spark, tmp_path):
    veristrata.ship(spark)
    veristrata.ship(spark)
    shipped = [f for f in spark.sparkContext._python_includes if f.startswith("veristrata")]
    assert shipped == ["veristrata.zip"]
    from pyspark import SparkFiles

    with zipfile.ZipFile(SparkFiles.get("veristrata.zip")) as z:
        assert "veristrata/plans/audits.py" in z.namelist()
    code = f"import sys; sys.path.insert(0, {SparkFiles.get('veristrata.zip')!r}); import veristrata.functions.pixels as p; assert '.zip' in p.__file__"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
