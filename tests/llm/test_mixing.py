import itertools

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import queries
from seqloom.llm.mixing import AXES, DIM, EVERY, Mix, _tagged, nearest, plan_mix, rake, rake_by_spark, sample_mix, text_vectors, topic_centres


def brute(cells, tokens, mix):
    """Cell by cell, in plain loops."""
    total = sum(tokens)
    x = [t * mix.keep for t in tokens]
    wants = []
    for j, axis in enumerate(AXES):
        share = {}
        for c, t in zip(cells, tokens):
            share[c[j]] = share.get(c[j], 0) + t / total
        given = mix.targets.get(axis)
        raw = {k: given.get(k, 0) if given else v ** mix.power[axis] if v else 0 for k, v in share.items()}
        wants.append({k: v / sum(raw.values()) * total * mix.keep for k, v in raw.items()})
    for sweep in range(mix.sweeps):
        old = x
        for j, want in enumerate(wants):
            now = {}
            for c, v in zip(cells, x):
                now[c[j]] = now.get(c[j], 0) + v
            x = [v * (want[c[j]] / now[c[j]] if now[c[j]] > 0 else 0) for c, v in zip(cells, x)]
        x = [min(a, b) for a, b in zip(x, tokens)]
        if sweep % EVERY == EVERY - 1 and max(abs(a - b) for a, b in zip(x, old)) <= mix.tolerance * max(total, 1):
            break
    return x


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    cells = list(itertools.product(["a", "b", None], ["en", "fr"], range(3)))
    return cells, rng.integers(0, 1000, len(cells)).astype(float)


@pytest.mark.parametrize("mix", [Mix(sweeps=60), Mix(keep=0.9, sweeps=60), Mix(sweeps=40, targets={"lang": {"en": 0.5, "fr": 0.5}})])
def test_rake(spark, table, mix):
    cells, tokens = table
    x = rake(cells, tokens, mix)
    assert np.allclose(x, brute(cells, tokens, mix), rtol=1e-6, atol=1e-5)
    assert (x <= tokens + 1e-9).all()


@pytest.mark.parametrize("mix", [Mix(sweeps=6), Mix(sweeps=2, targets={"source": {None: 0.5, "a": 0.5}})])
def test_rake_by_spark(spark, table, mix):
    cells, tokens = table
    df = spark.createDataFrame([(*c, float(t)) for c, t in zip(cells, tokens)], "source string, lang string, topic int, tokens double")
    got = {(r["source"], r["lang"], r["topic"]): r["x"] for r in rake_by_spark(df, mix).collect()}
    assert np.allclose([got[c] for c in cells], rake(cells, tokens, mix), rtol=1e-9)


def test_marginals_are_met(table):
    cells, tokens = table
    mix = Mix(keep=0.2, sweeps=500)
    x = rake(cells, tokens, mix)
    for j, axis in enumerate(AXES):
        have, got = {}, {}
        for c, t, v in zip(cells, tokens, x):
            have[c[j]], got[c[j]] = have.get(c[j], 0) + t, got.get(c[j], 0) + v
        raw = {k: (v / tokens.sum()) ** mix.power[axis] for k, v in have.items()}
        for k in raw:
            assert abs(got[k] / x.sum() - raw[k] / sum(raw.values())) < 1e-3


def test_text_vectors():
    v, n = text_vectors(pa.array(["", None, "a b", "longword longword other", "longword", "longword x"], pa.string()))
    assert n.tolist() == [0, 0, 2, 3, 1, 2] and not v[:3].any() and (v[4] == v[5]).all()
    assert (np.abs(v[4]) == 22).all() and abs(np.linalg.norm(v[3] / 127.0) - 1) < 0.05
    assert nearest(v[:3], np.eye(8, DIM)).tolist() == [0, 0, 0]


def test_topics_are_clusters(spark):
    """Against k-means in plain numpy, and for any partitions; texts of one vocabulary share a topic."""
    rng = np.random.default_rng(7)
    groups = [[f"subject{g}word{k}" for k in range(30)] for g in range(4)]
    texts = [" ".join(rng.choice(groups[i % 4], 40)) for i in range(200)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    mix = Mix(topics=6)
    got = [topic_centres(_tagged(df.repartition(k), "text", mix), mix) for k in (1, 5)]
    assert (got[0] == got[1]).all()
    v = text_vectors(pa.array(texts, pa.string()))[0].astype(float)
    c = np.eye(6, DIM)
    for _ in range(mix.rounds):
        own = (v @ c.T).argmax(1)
        for k in range(6):
            total = v[own == k].sum(0)
            c[k] = total / np.linalg.norm(total) if np.linalg.norm(total) > 0 else c[k]
    assert np.allclose(got[0], c)
    topic = nearest(v[:200], got[0])
    assert np.mean([np.bincount(topic[g::4]).max() / 50 for g in range(4)]) > 0.8


def test_query_and_sample(spark, sf_dir):
    plan = queries.op8_mixing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(plan) == docs.count()
    kept = {r["doc_id"] for r in sample_mix(docs).collect()}
    assert kept == {r["doc_id"] for r in plan if r["selected"]}
    cells, tokens = {}, {}
    for r in plan:
        key = (r["source"], r["lang"], r["topic"])
        cells.setdefault(key, r["probability"])
        assert cells[key] == r["probability"]
        tokens[key] = tokens.get(key, 0) + r["n_tokens"]
    names = sorted(cells)
    x = brute(names, [float(tokens[k]) for k in names], Mix())
    assert np.allclose([cells[k] * tokens[k] for k in names], x, rtol=1e-4, atol=1e-2)
    expect = sum(r["probability"] * r["n_tokens"] for r in plan)
    assert abs(expect - 0.5 * sum(r["n_tokens"] for r in plan)) < 0.1 * expect


def test_edges(spark):
    rows = [(1, "some words here", None, "en", 1.0), (1, "some words here", None, "en", 1.0), (2, None, "s", None, 1.0), (3, "", "s", "en", 1.0), (None, "more words", "t", "fr", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, weight double")
    plan = plan_mix(df).collect()
    assert len(plan) == 5 and len({r["selected"] for r in plan if r["doc_id"] == 1}) == 1
    assert plan_mix(df.limit(0)).count() == 0 and sample_mix(df).columns == df.columns and sample_mix(df.limit(0)).count() == 0
    assert all(not r["selected"] for r in plan if r["doc_id"] in (2, 3))


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, "plain words in here", "s", "en", "x", "y"), (2, "longer words " * 100_000, "s", "fr", "x", "y"), (2, "more words", "t", "fr", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, mix_tokens string, mix_topic string")
    kept = sample_mix(df, Mix(keep=1.0, power={}))
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == sorted(rows)
    assert plan_mix(df.withColumnRenamed("mix_topic", "probability")).count() == 3
