"""The registered queries of the training-data operators against their DuckDB SQL, on the driver's smallest tables and on planted ones."""

import os
import random

import duckdb
import numpy as np
import pytest

from veristrata.llm import queries as Q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = Q.queries()[name](spark, folder)
    said = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(said.fetchall(), key=repr)
    return got


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, name):
    assert same(spark, DIR, name)


def test_linked_vectors_match_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + rng.normal(size=16) * 0.08 * (k % 3)).tolist(), 0) for k in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = same(spark, str(tmp_path), "op7_embedding_dedup")
    assert sum(r[1] for r in got) > 300


def test_linked_documents_match_sql(spark, tmp_path):
    r = random.Random(8)
    base = [[r.choice("abcdefghijklmnop") * 2 for _ in range(r.randint(3, 120))] for _ in range(25)]
    rows = []
    for k in range(150):
        w = list(base[k % 25])
        for _ in range(k // 25):
            w[r.randrange(len(w))] = r.choice("abcdefghijklmnop") * 3
        rows.append((k, " ".join(w), "en", f"src{k % 10}", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op3_exact_dedup", "op8_jaccard_join", "op9_mixing"):
        same(spark, str(tmp_path), name)
