import zlib

import numpy as np
import pyarrow as pa

from seqloom.llm import queries
from seqloom.llm.classifier import DIM, FEATURES, ROWS, context_vectors, contexts, fit_network, index_vectors, keep_quality, pooled, row_of, score_quality, train_quality
from seqloom.llm.textkit import words


def test_held_out_accuracy(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op10_quality_classifier(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    right = [r["predicted"] == labels[r["doc_id"]] for r in got if r["doc_id"] in labels and r["held_out"]]
    assert len(right) > 5 and np.mean(right) > 0.85


def brute_contexts(texts):
    w = words(pa.array(texts, pa.string()))
    index, table, row, doc = index_vectors(w.hash).astype(int), {}, row_of(w.hash), w.doc
    for i in range(row.size):
        own = table.setdefault(int(row[i]), np.zeros(DIM, int))
        for k in (-2, -1, 1, 2):
            if 0 <= i + k < row.size and doc[i + k] == doc[i]:
                own += index[i + k]
    return table


def test_contexts_against_brute_force(spark):
    texts = ["a b c a b", "x", "", "b c d e f g", None, "two a", "a a a"]
    want = brute_contexts(texts)
    rows, sums = contexts(words(pa.array(texts, pa.string())))
    assert {r: tuple(v) for r, v in zip(rows.tolist(), sums.tolist())} == {r: tuple(v.tolist()) for r, v in want.items()}
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for most, fan in ((120_000, 256), (2, 256), (1, 2)):
        got = context_vectors(df, "text", most, fan)
        assert got.shape == (ROWS, DIM) and set(np.flatnonzero(got.any(1)).tolist()) == {r for r, v in want.items() if v.any()}
        for r, v in want.items():
            assert np.abs(got[r] - 127 * v / max(np.linalg.norm(v), 1e-9)).max() <= 0.5


def test_index_vectors_are_sparse_and_independent():
    v = index_vectors(np.arange(4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(float)
    assert abs((v != 0).mean() - 0.25) < 0.01 and abs(v.mean()) < 0.01
    assert np.abs(np.corrcoef(v.T) - np.eye(DIM)).max() < 0.08


def test_pooling_against_brute_force():
    rng = np.random.default_rng(1)
    v = rng.integers(-127, 128, (ROWS, DIM)).astype(np.int8)
    col = pa.array(["one two two three!!", "", None, "é " * 700, "x"], pa.string())
    x, w = pooled(col, v), words(col)
    assert x.shape == (5, FEATURES)
    for d in range(5):
        own = v[row_of(w.hash[w.first[d] : w.first[d + 1]])] / 127
        assert np.allclose(x[d, :DIM], own.mean(0) if len(own) else 0, atol=1e-5)
        assert np.allclose(x[d, DIM:], (own[1:] * own[:-1]).mean(0) if len(own) > 1 else 0, atol=1e-5)


def test_temperature_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(np.float32)
    m = fit_network(x, y)
    p = 1 / (1 + np.exp(-m.logits(x) / m.temperature))
    for lo in np.arange(0, 1, 0.25):
        own = (p >= lo) & (p < lo + 0.25)
        assert abs(p[own].mean() - y[own].mean()) < 0.08
    assert 0.25 <= m.temperature <= 8


def test_edges(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "BAD!! JUNK!!", 9) for i in range(60)] + [(None, "x", 9), (70, None, 9), (70, "", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (61, None), (3, 1)], "doc_id long, quality int")
    m = train_quality(docs, labels)
    got = score_quality(docs, m).collect()
    assert len(got) == 63 and all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    kept = keep_quality(docs, m)
    assert kept.columns == docs.columns and kept.where("doc_id % 2 = 0 and doc_id < 60").isEmpty()
    assert score_quality(docs.limit(0), m).count() == 0
    empty = train_quality(docs, labels.limit(0))
    assert len({r["score"] for r in score_quality(docs, empty).collect()}) == 1
    train_quality(docs.limit(0), labels)


def test_held_out_labels_are_never_learnt(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = train_quality(docs, labels), train_quality(docs, other)
    assert np.array_equal(a.model.w1, b.model.w1) and a.model.temperature == b.model.temperature


def test_one_id_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "x y")], "doc_id long, text string")
    m = train_quality(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), fold=0, max_train=2)
    assert score_quality(docs, m).count() == 301


def test_very_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, 1, 1, 1), (2, "ok fine", 2, 2, 2), (2, "ok fine", 2, 2, 2)], "doc_id long, text string, y int, i int, t int")
    m = train_quality(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), fold=0)
    assert score_quality(docs, m).count() == 3 and keep_quality(docs, m, threshold=0.0).count() == 3 and keep_quality(docs, m).columns == docs.columns
