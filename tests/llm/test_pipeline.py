"""The pipeline against its stages done by hand on the driver."""
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import classifier, mixing

from .test_jaccard import brute as components
from .test_repetition import brute as rules


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = classifier.train_quality(docs, labels)
    score = {r["doc_id"]: r["predicted"] for r in classifier.score_quality(docs, model).collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if score[r["doc_id"]] == 1}
    rows = {i: r for i, r in rows.items() if rules(r["text"])["kept"]}
    first = {i for i, _, c in components([(i, r["text"]) for i, r in rows.items()]) if i == c}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [i for i in first if not any(x in rows[i]["text"] for x in items)]
    plan = mixing.plan_mix(docs.where(F.col("doc_id").isin(clean))).collect()
    want = sorted(r["doc_id"] for r in plan if r["selected"])
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == want


def test_stages(spark, sf_dir):
    assert len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = docs.limit(0)
    odd = docs.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")).limit(3)
    for _, stage in corpus_pipeline.STAGES:
        for part in (empty, odd):
            out = stage(spark, part, sf_dir)
            out.collect()
            assert out.columns == docs.columns


def test_repeated_rows_clashing_columns_and_long_texts(spark, sf_dir):
    """Every stage keeps all columns, judges repeated rows alike and reads a long text whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    long = docs.limit(1).select(F.lit(1_000_001).cast("long").alias("doc_id"), F.expr("array_join(transform(sequence(1, 40000), x -> concat('word', cast(x * 7919 % 40009 as string))), ' ')").alias("text"), "lang", "source", "n_chars")
    rows = docs.unionByName(docs).unionByName(long)
    for name in ("join_drop", "mix_topic", "mix_tokens", "score", "t", "i", "leaked"):
        rows = rows.withColumn(name, F.lit("own"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns
        got = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("size")).collect()
        assert {r["n"] for r in got if r["doc_id"] < 60} == {2}, name
        assert all(r["size"] > 300_000 for r in got if r["doc_id"] == 1_000_001)


def test_entry_without_the_subpackage(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "op1_chat_formatting" in entry.queries()
    gone = [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("seqloom.llm")]
    for m in gone:
        monkeypatch.delitem(sys.modules, m)
    find = importlib.machinery.PathFinder.find_spec
    monkeypatch.setattr(importlib.machinery.PathFinder, "find_spec", lambda name, *a: None if name == "corpus_pipeline" or name.startswith("seqloom.llm") else find(name, *a))
    names = entry.queries()
    assert names and not any(n.startswith("op1_") or n == "pipeline" for n in names) and set(entry.oracle_sql()) <= set(names)
