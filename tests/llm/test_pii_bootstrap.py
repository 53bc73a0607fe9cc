"""Bootstrapped contextual extraction on planted forms: precision and recall, turns, what forms rule out, hostile texts."""

import random
import time

from pyspark.sql import functions as F

from veristrata.llm import pii

DOCS = "doc_id long, text string, value string, kind string, row long, seen string"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "v", "k", 1, "s") for k, t in enumerate(texts)], DOCS)


def added(spark, texts):
    """{doc: [(kind, text of the span)]} of spans beside the base ones."""
    got = pii.find_pii(docs(spark, texts)).select("doc_id", F.array_except("spans", "base").alias("more")).collect()
    return {r.doc_id: [(pii.KINDS[s.rank], texts[r.doc_id][s.start : s.end]) for s in r.more] for r in got}


def name(r):
    return "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(3))


def planted(seed):
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    filler = lambda: " ".join(name(r) for _ in range(r.randint(2, 6)))
    texts, truth = [], {}

    def add(text, *want):
        truth[len(texts)] = list(want)
        texts.append(text)

    for _ in range(60):
        add(f"{filler()} please call me on +1 ({digits(3)}) {digits(3)}-{digits(4)} {filler()}")
        add(f"{filler()} write to me at {name(r)}@{name(r)}.com today {filler()}")
        add(f"{filler()} the server listens under {r.randint(1, 255)}.{r.randint(1, 255)}.0.{r.randint(1, 255)} port {filler()}")
    for turn in range(40):
        phone = r.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])
        add(f"{filler()} please call me on {phone} {filler()}", ("phone", phone))
        mail = r.choice([f"{name(r)} [at] {name(r)} [dot] com", f"{name(r)}(at){name(r)}.com", f"{name(r)} @ {name(r)}.org"])
        add(f"{filler()} write to me at {mail} today {filler()}", ("email", mail))
        ip = f"{r.randint(1, 255)}.[{r.randint(1, 255)}].0.{r.randint(1, 255)}"
        add(f"{filler()} the server listens under {ip} port {filler()}", ("ip", ip))
        add(f"{filler()} the order number {digits(10)} was {filler()}")  # nothing personal
        add(f"{filler()} release 10.0.{r.randint(256, 999)}.{r.randint(256, 999)} of {filler()}")
        if turn % 5 == 0:
            add(f"{filler()} the server listens under 10.0.{r.randint(256, 999)}.{r.randint(256, 999)} port")
    return texts, truth


def test_precision_and_recall_on_planted_forms(spark):
    texts, truth = planted(1)
    got = added(spark, texts)
    found = sum(len(set(got[k]) & set(truth[k])) for k in truth)
    assert found >= 0.95 * sum(map(len, truth.values()))
    assert found >= 0.98 * sum(map(len, got.values()))


def test_discovered_values_induce_patterns(spark):
    r = random.Random(2)
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    late = [f"{digits(3)} {digits(3)} {digits(4)}" for _ in range(20)]
    texts = [f"{name(r)} call me on +1 ({digits(3)}) {digits(3)}-{digits(4)} {name(r)}" for _ in range(30)]
    texts += [f"{name(r)} call me on {p} {name(r)}" for p in late]  # found in the first turn
    texts += [f"{name(r)} hotline {p} {name(r)}" for p in late]  # these bear a pattern that no seed has
    texts += [f"{name(r)} hotline {digits(3)} {digits(3)} {digits(4)} {name(r)}"]
    got = added(spark, texts)
    assert got[len(texts) - 1] and got[len(texts) - 1][0][0] == "phone"
    assert all(got[k] for k in range(30, len(texts)))


def test_mixed_contexts_are_not_trusted(spark):
    r = random.Random(3)
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    texts = [f"the {x} " for _ in range(30) for x in (f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{name(r)}@{name(r)}.com", f"1.2.3.{r.randint(1, 255)}")] + [f"the {digits(10)} " for _ in range(20)]
    assert not any(added(spark, texts).values())


def test_cases(spark):
    texts = ["", " ", None, "call +1 234 567 8901", "call +1 234 567 8901", "1.2.3.4 " * 3000, "x" * 200_000, "1-2" * 40_000, "( [ { at " * 20_000, "a [at] " * 20_000, "a.b" * 40_000, "+" * 50_000, "9 " * 50_000]
    start = time.time()
    got = pii.find_pii(docs(spark, texts)).select("doc_id", F.size("base").alias("b")).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts))) and time.time() - start < 120
    assert {r.doc_id: r.b for r in got}[5] == 3000
    assert pii.find_pii(docs(spark, [])).collect() == []


def test_ties_between_kinds(spark):
    """14 digits after a word that stands before as many cards as phones: neither kind is trusted; after one kind's word, that kind."""
    r = random.Random(5)

    def card():
        head = "".join(r.choice("123456789") for _ in range(15))
        luhn = lambda s: sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(s))) % 10 == 0
        return next(head + d for d in "0123456789" if luhn(head + d))

    texts = [f"{name(r)} number {card()} {name(r)}" for _ in range(20)] + [f"{name(r)} number +1 (234) 567-89{k:02} {name(r)}" for k in range(20)] + [f"{name(r)} number 11111111111111 {name(r)}"]
    assert added(spark, texts)[40] == []
