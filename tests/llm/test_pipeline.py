"""The pipeline's stages on small rows: columns stay, decisions take effect, the last stage returns one row per copy; whole runs against plain steps."""

import hashlib
import random
import re
from collections import Counter

import sentencepiece as spm

import corpus_pipeline
from veristrata.llm import exact_dedup, jaccard_join, mixing, quality
from veristrata.llm.queries import tokenizer_path

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources", "SentencePiece"]
    steps = [f for _, f in corpus_pipeline.STAGES]
    good = steps[0](spark, docs, DIR).cache()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted}
    unique = steps[1](spark, good, DIR).cache()
    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in exact_dedup.exact_dedup(good).collect() if r.kept}
    apart = steps[2](spark, unique, DIR).cache()
    assert {r.doc_id for r in apart.collect()} == {r.doc_id for r in jaccard_join.jaccard_components(unique).collect() if r.doc_id == r.component_id}
    mixed = steps[3](spark, apart, DIR).cache()
    assert mixed.count() == sum(r.copies for r in mixing.plan(apart).collect())
    for stage in (good, unique, apart, mixed):
        assert stage.columns == docs.columns
    assert steps[4](spark, mixed, DIR).count() == mixed.count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, _vs_row string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def by_plain_steps(rows):
    """Exact copies (the largest id stays), then groups linked by similar shingle sets (the smallest id stays)."""
    largest = {}
    for r in rows:
        largest[r[1] or ""] = max(largest.get(r[1] or "", r[0]), r[0])
    kept = {(i, t or "") for t, i in largest.items()}
    sets = {i: shingles(t) for i, t in kept}
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    return {i for i in sets if group[i] == i}


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_whole_runs_against_plain_steps(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["river", "Stone", "winter", "lamp", "harbour", "quiet", "seven", "glass", "over", "meadow"]) + str(rng.randrange(40)) for _ in range(n))
    texts = [prose(rng.randrange(20, 60)) for _ in range(30)]
    near = [t + " and one more" for t in texts[:8]]
    rows = [(k, t) for k, t in enumerate([*texts, *near, *texts[5:12], "", None, "Short words", prose(30_000)])]
    rows += [(200 + k, "zz " * rng.randrange(10, 30)) for k in range(20)] + [rows[3], rows[3]]
    rows = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or ""), 7, "x") for i, t in rows]
    write(spark, tmp_path, rows, [(i, int(i < 200), 0) for i in sorted({r[0] for r in rows})])
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    accepted = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted}
    assert len(accepted) >= 30
    good = sorted({r for r in rows if r[0] in accepted}, key=repr)
    left = by_plain_steps(good)
    apart = spark.createDataFrame([r for r in good if r[0] in left], SCHEMA)
    want = Counter()
    for r in mixing.plan(apart).select("doc_id", "copies").collect():
        want[r.doc_id] += r.copies
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # a row that is repeated is an exact copy, of which one row stays
    assert Counter(r.doc_id for r in out) == +want
    library, text = spm.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model")), {r[0]: r[1] or "" for r in rows}
    for r in out:
        ids = library.encode(text[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
