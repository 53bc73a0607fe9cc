"""Cases of several operators: clashing names, unequal texts behind one digest, very long texts, empty tables, worker caches."""

import hashlib
import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veristrata.llm import exact_dedup, jaccard_join, mixing, token_counts, wordhash
from veristrata.llm.queries import tokenizer_path

CLASH = "doc_id long, text string, lang string, source string, _vs_id string, _vs_digest long, _vs_row long, _vs_copies long, run string, digest string, node long"


def clash(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", "a", 1, 2, 3, "r", "d", 4) for i, t in rows], CLASH)


ROWS = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z"), (None, None), (None, ""), (4, "x y z"), (4, "other words here"), (4, "other words here")]


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, jaccard_join.drop_similar, mixing.mix])
def test_stages_keep_clashing_columns(spark, stage):
    docs = clash(spark, ROWS)
    got = stage(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    assert stage(clash(spark, [])).collect() == []


def test_mix_without_counts_and_weights(spark):
    docs = clash(spark, [(k, "one two three " * (k + 1)) for k in range(20)]).drop("_vs_id")
    assert mixing.mix(docs, source_weights={"src1": 0.0}).collect() == []
    assert mixing.mix(docs, budget_fraction=2.0, max_epochs=2).count() == 40
    long = clash(spark, [(1, "w " * 400_000)])
    assert mixing.plan(long).first().n_tokens == 400_000


def plain(rows):
    out = []
    for i, t in rows:
        ids = [j for j, u in rows if (u or "") == (t or "")]
        top = max(ids, key=lambda j: -1 if j is None else j)
        out.append((str(i), str(top), len(ids)))
    return sorted(out)


def test_unequal_texts_of_one_digest_end_to_end(spark, monkeypatch):
    """Runs whose digests are made equal: the rows come back once each, by their texts."""
    rows = [(1, "ab"), (2, "ac"), (3, "ab"), (4, "q"), (5, "ac")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    same = hashlib.sha256(b"same").digest()
    real = exact_dedup.build_runs

    def runs(docs, keep_largest=True, bits=0):
        got = real(docs, keep_largest, bits).toPandas()
        split = got["digest"].map(bytes).isin([hashlib.sha256(t.encode()).digest() for t in ("ab", "ac")])
        got.loc[got["digest"].map(bytes) == hashlib.sha256(b"ac").digest(), "variant"] = 1
        got.loc[split, "digest"] = [same] * int(split.sum())
        return spark.createDataFrame(got.astype(object).where(got.notna(), None), exact_dedup.RUN_SCHEMA)

    monkeypatch.setattr(exact_dedup, "build_runs", runs)
    monkeypatch.setattr(exact_dedup, "_with_digest", lambda d: d.withColumn("digest", F.when(F.col("text").isin("ab", "ac"), F.lit(same)).otherwise(F.unhex(F.sha2(F.col("text").cast("binary"), 256)))))
    got = exact_dedup.exact_dedup(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == plain(rows)


def test_exact_dedup_of_many_runs(spark, monkeypatch):
    r = random.Random(7)
    rows = [(k if k % 9 else None, r.choice("abcdefgh") * r.randint(0, 3) if k % 5 else "z" * 300_000) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_dedup.exact_dedup(docs).collect()
    assert sorted((str(x.doc_id), str(x.keep_id), x.group_size) for x in got) == plain(rows)


def test_token_table_and_caches(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    pre = token_counts.PreTokens(path)
    lib = Tokenizer.from_file(path)
    texts = ["word " * 300_000, "héllo wörld\n\n  x" * 50, "", None, "日本語 🎉 <|endoftext|> x", "'s 12's  a"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_bytes long")
    table = token_counts.frequent_lengths(docs, path, rows=500)
    assert len(table) <= 500 and " word" in table
    assert all(n == len(lib.encode(t, add_special_tokens=False).ids) for t, n in table.items())
    assert all(pre.find(t) == [t] for t in pre.whole_entries()[:2000])
    for _ in range(2):
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
        assert got == {k: len(lib.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    assert token_counts.token_counts(docs.limit(0), path).collect() == []


def test_heavy_shingles_are_the_most_frequent(spark):
    """Of 70 shingles 30 stand in 40 texts each, the others in 8; however they fall on 16 shards, none of the 30 is lost."""
    starts = [" ".join(f"w{k}x{j}" for j in range(5)) for k in range(70)]
    rows = [(k, f"{t} end{k}x{n}") for k, t in enumerate(starts) for n in range(40 if k < 30 else 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    top = [int(x[0] >> np.uint64(24)) for x in jaccard_join.shingle_sets(*wordhash.buffers(pa.array(starts)))]

    def got(most):
        return jaccard_join._unpack(np.frombuffer(jaccard_join.heavy_shingles(docs, 5, 16, 3, most), np.uint8), 5).tolist()

    assert got(1000) == sorted(top)
    assert got(30) == sorted(top[:30])
    assert set(top[:30]) <= set(got(50)) <= set(top) and len(got(50)) <= 50
    assert jaccard_join.heavy_shingles(docs.limit(0), 5, 16, 3) == b""


def test_heavy_shingles_on_the_driver(spark):
    """The driver holds the 5 bytes of a heavy shingle, and no tables beside them."""
    docs = spark.range(300).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 1003), i -> concat(id, 'x', i)), ' ') AS text")
    tracemalloc.start()
    try:
        found = jaccard_join.heavy_shingles(docs, 5, 16, 1, 1 << 20)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 5 * 300_000 and peak < 4 * len(found)


def test_id_filter_is_merged_before_the_driver(spark):
    """All tasks' ids in one filter, put together by slices."""
    chosen = spark.range(0, 40_000, 7).toDF("doc_id").repartition(9)
    ids = np.arange(0, 40_000, 7)
    held = jaccard_join._id_filter(chosen)
    assert (held == exact_dedup.Bloom.build(exact_dedup.id_keys(ids).ravel(), held.size * 8)).all()
    assert not jaccard_join._id_filter(chosen.limit(0)).any()


def _exploded_broadcasts(df):
    """Broadcasts of a plan that have exploded rows below them."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [m.start() if (m := re.search("[A-Za-z]", x)) else 0 for x in lines]
    below = {k: list(itertools.takewhile(lambda j: depth[j] > depth[k], range(k + 1, len(lines)))) for k, x in enumerate(lines) if "BroadcastExchange" in x}
    return [lines[k] for k, js in below.items() if any("Generate explode" in lines[j] for j in js)]


def test_rows_that_are_multiplied_are_not_broadcast(spark, monkeypatch):
    """Spark does not count the copies of a salted row or of a tile's row, so a broadcast of them has no bound on the driver."""
    plans, write = [], jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, tag: plans.append((tag, _exploded_broadcasts(df))) or write(df, tag))
    node_sets = [np.arange(8, dtype=np.uint64) + np.uint64(k // 4) for k in range(12)]  # 4 nodes of each set; sets overlap by 7 of 9 or 6 of 10
    sets = write(spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(node_sets)], "node long, blob binary"), "test")
    hot = write(spark.createDataFrame([(5, k) for k in range(12)] + [(6, k) for k in range(3, 9)], "g long, node long"), "test")
    groups = write(spark.createDataFrame([(k, k // 4 * 4) for k in range(12)], "node long, component long"), "test")
    links = jaccard_join._rest(hot, groups, sets, 75, 3).collect()
    assert {tuple(sorted((x.a // 4, x.b // 4))) for x in links} == {(0, 1), (1, 2)}
    assert {"jac-open", "jac-rest"} <= {tag for tag, _ in plans}
    assert _exploded_broadcasts(jaccard_join._probes(hot, groups, 2)) == []
    assert [x for x in plans if x[1]] == []


def test_id_filter_leaves_the_driver(spark, monkeypatch):
    """The filter on wanted ids is destroyed once the sets are written."""
    held, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: held.append(send(value)) or held[-1])
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "g h")], "doc_id long, text string")
    nodes = [(i, jaccard_join.node_of(s, 1)[0]) for i, s in zip((1, 2), jaccard_join.shingle_sets(*wordhash.buffers(pa.array(["a b c d e f", "g h"]))), strict=True)]
    sets = jaccard_join._sets_of(docs, spark.createDataFrame(nodes, "doc_id long, node long"), 5, 1)
    assert {x.node for x in sets.collect()} == {n for _, n in nodes}
    assert len(held) == 1 and not held[0]._jbroadcast.isValid()


def test_pre_tokens_of_all_documents_are_counted(spark, monkeypatch):
    """One that is frequent only late in a partition is in the table; words are split as whole texts are."""
    path = tokenizer_path("byte_bpe_50k.json")
    pre = token_counts.PreTokens(path)
    r = random.Random(3)
    marks = ["a", "Zß", "'s", "'", " ", "  ", "\n", "\t\n", "12", "日本", "!?", "\u3000", "\u00a0", "\x85", "\x1c", "<|endoftext|>", "e\u0301"]
    texts = ["first words " * 3] * 300 + ["".join(r.choice(marks) for _ in range(40)) for _ in range(300)] + ["zzqlate"] * 3000 + [None, "", " \n "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = Counter(t for x in texts for t in pre.split(x or "")[0])
    monkeypatch.setattr(token_counts, "HELD_WORDS", 50)
    assert {x.t: x.n for x in token_counts.pre_token_counts(docs, path).collect()} == want
    top = token_counts.frequent_lengths(docs, path, rows=6)
    least = min(n for t, n in want.items() if t in top)
    assert "zzqlate" in top and all(t in top for t, n in want.items() if n > least)


def test_sketches_never_lose_a_pair():
    """Similar pairs pass the sieve whatever their sizes; pairs of unrelated sets do not, so their sets are not sent."""
    rng = np.random.default_rng(7)
    passed = 0
    for n in (1, 3, 40, 700):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.r_[a[: int(n * rng.uniform(0.5, 1))], rng.integers(0, 1 << 63, rng.integers(0, n // 3 + 1)).astype(np.uint64)])
            far = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            look = lambda s: np.frombuffer(jaccard_join.sketch(s), np.uint8)
            both = jaccard_join.most_overlap(look(a), a.size, look(b), b.size)
            assert jaccard_join.overlap(a, b) <= both <= min(a.size, b.size)
            most = jaccard_join.most_overlap(look(a), a.size, look(far), far.size)
            passed += n >= 40 and 100 * most >= 75 * (a.size + far.size - most)
    assert passed == 0


def test_a_set_is_not_sent_for_every_256_others(spark, monkeypatch):
    """Tiles hold bytes, not a fixed number of sets: the sets of a cluster were sent once for each 256 others, with the square of its size."""
    rng = np.random.default_rng(3)
    sent = []
    frame = type(spark.range(0))
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, *a: (sent.append(df.count()) if "side" in df.columns else None, plain(df, *a))[1])
    hot = spark.createDataFrame([(1, n) for n in range(600)], "g long, node long")
    groups = spark.createDataFrame([], "node long, component long")
    sets = spark.createDataFrame([(n, np.sort(rng.integers(0, 1 << 62, 4).astype(np.uint64)).tobytes()) for n in range(600)], "node long, blob binary")
    jaccard_join._rest(hot, groups, sets, 75, None)
    assert sent and sent[0] <= 2 * 600
