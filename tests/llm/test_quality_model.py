"""The quality classifier against plain forms of its updates and scores, and its cases."""

import math
import random

import numpy as np
import pytest

from veristrata.llm import quality as Q


def rows_of(seed: int, number: int, share: float = 0.5):
    rng = random.Random(seed)
    out = []
    for _ in range(number):
        label = int(rng.random() < share)
        slots = sorted(rng.sample(range(0, 40), 6) + [100 + label * 10 + rng.randrange(3)])
        out.append((np.array([*slots, 1 << Q.BITS]), np.array([*[rng.uniform(0.1, 1.0) for _ in slots], 0.3]), label))
    return out


def plain(rows, turns):
    """Follow the regularised leader, one slot at a time."""
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= Q.L1:
            return 0.0
        return -(z[k] - math.copysign(Q.L1, z[k])) / ((Q.BETA + math.sqrt(n[k])) / Q.ALPHA + Q.L2)

    for _ in range(turns):
        for slots, values, label in rows:
            w = {k: weight(k) for k in slots}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in zip(slots, values))))
            for k, v in zip(slots, values):
                g = (p - label) * v
                old = n.get(k, 0.0)
                n[k] = old + g * g
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n[k]) - math.sqrt(old)) / Q.ALPHA * w[k]
    return {k: weight(k) for k in z}


def test_updates_against_a_plain_form():
    rows = rows_of(3, 60)
    want, got = plain(rows, Q.passes(rows)), Q.fit(rows)
    assert all(got[k] == pytest.approx(w, abs=1e-6) for k, w in want.items())
    assert np.count_nonzero(got) == sum(w != 0 for w in want.values())


def test_passes_follow_the_training_rows():
    assert Q.passes(rows_of(1, 40)) > Q.EPOCHS
    assert Q.passes([(s, v, 1) for s, v, _ in rows_of(1, 40)]) == Q.EPOCHS
    assert Q.passes([]) == Q.EPOCHS
    many = rows_of(2, 30) * (Q.UPDATES // 60)
    assert Q.passes(many) == Q.EPOCHS


def test_few_and_uneven_labels_use_the_threshold(monkeypatch):
    rows = rows_of(5, 400, share=0.85)
    train, rest = rows[:200], rows[200:]

    def rejected():
        w = Q.fit(train)
        return sum(1 / (1 + math.exp(-float(w[s] @ v))) < Q.THRESHOLD for s, v, y in rest if not y), sum(1 / (1 + math.exp(-float(w[s] @ v))) < Q.THRESHOLD for s, v, y in rest if y)

    bad, good = rejected()
    monkeypatch.setattr(Q, "UPDATES", 0)
    assert bad > rejected()[0] and bad >= 0.6 * sum(not y for _, _, y in rest) and good <= 0.03 * len(rest)


def test_scores_are_dot_products_in_any_batch(spark):
    texts = ["the cat sat on the mat", "the mat sat on the cat", "cat sat", "", "spam " * 50_000, "The, Cat! sat 99", "ein Haus am See, am See"]
    raw, offsets = Q._arrays(texts)
    together = list(Q.features(raw, offsets))
    for text, (slots, values) in zip(texts, together):
        (alone,) = Q.features(*Q._arrays([text]))
        assert np.array_equal(alone[0], slots) and np.allclose(alone[1], values)
        assert values[-1] == 0.3 and math.isclose(float((values[:-1] ** 2).sum()), 1.0 if text else 0.0, abs_tol=1e-9)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(7)], "doc_id long, quality int")
    w = Q.train(docs, labels)
    if w is None:
        pytest.skip("the folds hold one label alone")
    got = {r.doc_id: r.score for r in Q.quality_scores(docs, labels).collect()}
    for k, (slots, values) in enumerate(together):
        assert got[k] == pytest.approx(1 / (1 + math.exp(-sum(float(w[s]) * v for s, v in zip(slots, values)))), abs=1e-6)


def test_empty_table_and_repeated_rows(spark):
    labels = spark.createDataFrame([(k, int(k < 20)) for k in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(k, "good text here" if k < 20 else "zz zz zz zz") for k in range(40)] + [(1, "good text here")] * 2 + [(None, None)], "doc_id long, text string")
    out = Q.quality_scores(docs, labels).collect()
    assert len(out) == 43 and len({r.score for r in out if r.doc_id == 1}) == 1
    assert Q.quality_scores(docs.limit(0), labels).collect() == []
