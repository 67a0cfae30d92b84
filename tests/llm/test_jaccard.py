import itertools
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import queries
from seqloom.llm.components import components
from seqloom.llm.jaccard import Join, jaccard_components, keep_first, least_shared, need, prefix_length, shingle_sets
from seqloom.llm.shared import BitFilter, xxhash64_long

SCHEMA = "doc_id long, text string, n_shingles string"


def shingles(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for (i, a), (k, b) in itertools.combinations(sets, 2):
        both = len(a & b)
        if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
            x, y = find(i), find(k)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed):
    """Copies, chains of near copies, shared passages, short and empty texts."""
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**6, n)]
    passages = [fresh(40) for _ in range(3)]
    rows = []
    for _ in range(12):
        base = fresh(int(rng.integers(20, 120))) + passages[int(rng.integers(3))]
        for _ in range(int(rng.integers(1, 9))):
            base = list(base)
            for _ in range(int(rng.integers(0, 5))):
                base[int(rng.integers(len(base)))] = f"e{rng.integers(10**6)}"
            rows.append(" ".join(base[: len(base) - int(rng.integers(0, 12))]))
        rows.append(rows[-1].upper())
    rows += ["", None, "a b", "A  b", "a b c d e", "   ", "same", "x"]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)]


def answer(df, **join):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df, join=Join(**join)).collect())


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
        want = brute(rows)
        assert answer(df) == want
        assert answer(df, sample_every=1, sample_least=2, chunk=2, partners=1, long_list=2) == want
        assert answer(df, sample_every=1, sample_least=1, chunk=5, partners=3, long_list=1) == want


def test_common_passage_in_short_texts(spark):
    """Most texts are little more than one passage: long lists of members that are no links, beside some that are."""
    rng = np.random.default_rng(4)
    passage = [f"p{k}" for k in range(12)]
    rows = [(i, " ".join([f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(0, 12)))] + passage + [f"z{x}" for x in rng.integers(0, 40, int(rng.integers(0, 3)))])) for i in range(500)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    want = brute(rows)
    assert answer(df) == want
    assert answer(df, chunk=40, partners=7, sample_every=1, long_list=20) == want


def test_filter_lets_all_entries_through(spark):
    ids = [0, 1, -1, 2**62, -(2**63), 12345678901]
    df = spark.createDataFrame([(x,) for x in ids], "i long").select(F.xxhash64("i").alias("h"))
    assert sorted(r["h"] for r in df.collect()) == sorted(xxhash64_long(np.array(ids)).view(np.int64).tolist())
    got, other = BitFilter.of(df, len(ids)), xxhash64_long(np.arange(1000, 3000))
    assert got.has(xxhash64_long(np.array(ids))).all() and got.has(other).mean() < 0.01
    assert BitFilter.of(df, BitFilter.ENTRIES + 1).has(other).all()


def test_pipeline_form_and_edges(spark):
    rows = [(5, "one two three four five six"), (2, "one two three four five six"), (9, None), (None, "one two three four five six"), (7, "other"), (7, "other")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_components(df).collect()}
    assert got == {(5, 2), (2, 2), (9, 9), (None, None), (7, 7)}
    assert sorted(str(r["doc_id"]) for r in keep_first(df).collect()) == ["2", "7", "7", "9", "None"]
    assert jaccard_components(df.limit(0)).count() == 0 and keep_first(df).columns == df.columns


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op7_jaccard_join(spark, sf_dir).collect())
    assert got == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\x1c", max_size=40), max_size=6))
def test_set_sizes(texts):
    got = shingle_sets(pa.array([*texts, None], pa.string()), 5)
    assert [s.size for s in got] == [len(shingles(t)) for t in [*texts, None]]
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert len(np.intersect1d(got[a], got[b])) == len(shingles(texts[a]) & shingles(texts[b]))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1))
def test_bounds_hold(a, b):
    both, n, m = len(a & b), len(a), len(b)
    if 100 * both >= 75 * (n + m - both):
        assert both >= need(n, m, 75)
        x, y = sorted(a)[: prefix_length(n, 75)], sorted(b)[: prefix_length(m, 75)]
        seen = sorted(set(x) & set(y))
        assert len(seen) >= max(1, int(least_shared(n, m, 75)))
        rest = [min(n - x.index(h), m - y.index(h)) for h in seen]
        assert rest[0] >= need(n, m, 75)  # of the first that they share
        assert all(min(x.index(h), y.index(h)) + r >= need(n, m, 75) for h, r in zip(seen, rest))
        assert len(seen) + rest[-1] - 1 >= need(n, m, 75)


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f g", "x", "p"), (2, "a b c d e f g", "y", "q"), (3, "other words", "z", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, join_drop string, component_id string")
    assert sorted(tuple(r) for r in keep_first(df).collect()) == [rows[0], rows[2]]


def test_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    df = spark.createDataFrame([(1, long, ""), (2, long + " tail", ""), (3, "w1 w2", "")], SCHEMA)
    assert answer(df) == [(1, 199_996, 1), (2, 199_997, 1), (3, 1, 3)]


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
