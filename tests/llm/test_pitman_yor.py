import math
import re
import zlib
from collections import Counter

import numpy as np

from seqloom.llm import queries
from seqloom.llm.pitman_yor import BITS, LetterModel, Settings, letter_cells, score_texts, seat, uniform


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def check_base(rows, got, fold=7, out=2):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % fold == out for i, _ in rows}
    c = Counter(t for i, x in rows if not held[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held[i], len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for i, x in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op9_lm_scoring(spark, sf_dir).collect()
    check_base(rows, got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_chunks_and_ranges_do_not_matter(spark):
    rows = [(i, " ".join(f"w{i * k % 17}x" for k in range(i % 50))) for i in range(80)] + [(90, None), (91, ""), (None, "w1x w2x"), (4, "w1x"), (95, "Straße \x1c a\x00b " * 50)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    a, b = score_texts(df).collect(), score_texts(df.repartition(7), settings=Settings(chunk_words=100, range_bytes=300)).collect()
    check_base(rows, a)
    key = lambda r: (str(r["doc_id"]), r["n_tokens"])
    a, b = sorted(a, key=key), sorted(b, key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and all(abs(x["score"] - y["score"]) < 1e-3 for x, y in zip(a, b))
    assert all(abs(r["perplexity"] - 10 ** (-r["score"] / r["n_tokens"])) < 1e-6 * r["perplexity"] for r in a)
    assert score_texts(df.limit(0)).count() == 0
    assert len(score_texts(df.where("doc_id = 5")).collect()) == 1


def test_letters_sum_to_one():
    words = [b"then", b"that", b"the", b"other", "für".encode(), b""]
    size = np.array([len(w) for w in words])
    cells, count = np.unique(letter_cells(np.frombuffer(b"".join(words), np.uint8), size), return_counts=True)
    m = LetterModel(cells, count, Settings())
    for ctx in (0, int(cells[3] >> 8), 12345, (1 << sum(BITS)) - 1):
        assert abs(m.cell_probability(np.array([ctx << 8 | b for b in range(256)])).sum() - 1) < 1e-9
    known, other = m.word_log(np.frombuffer(b"thezqx", np.uint8), np.array([3, 3]))
    assert known > other


def test_cells_of_words():
    got = letter_cells(np.frombuffer(b"abc", np.uint8), np.array([2, 0, 1]))
    ctx = lambda *back: sum((b & ((1 << w) - 1)) << s for b, w, s in zip(back, BITS, np.cumsum((0, *BITS))))
    assert got.tolist() == [ctx() << 8 | 97, ctx(97) << 8 | 98, ctx(98, 97) << 8 | 32, ctx() << 8 | 32, ctx() << 8 | 99, ctx(99) << 8 | 32]


def test_seating():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 50, 3000] * 200)
    draw = uniform(np.arange(c.size, dtype=np.uint64), 1)
    some = draw(np.arange(c.size), 3)
    assert abs(some.mean() - 0.5) < 0.05 and (some < 1).all() and not (some == draw(np.arange(c.size), 4)).any()
    t = seat(c, np.full(c.size, 0.3), 1.0, 0.5, 10.0, draw)
    assert (t[c == 0] == 0).all() and (t[c == 1] == 1).all() and ((t <= c) & (t >= (c > 0))).all()
    exact = []
    for _ in range(400):
        k, own = 1, 1
        while k < 50:
            a = (1 + 0.5 * 10) * 0.3
            own += rng.random() < a / (a + k - 0.5 * own)
            k += 1
        exact.append(own)
    assert abs(t[c == 50].mean() - np.mean(exact)) < 0.6
    assert (seat(c, np.full(c.size, 0.0), 1.0, 0.5, 10.0, draw) == np.minimum(c, 1)).all()


def test_contexts_are_words_not_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"a{k} b{k}" for k in rng.integers(0, 400, 100))) for i in range(120)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert got
    # half the words follow from the one before; a class of six preceding words leaves six to choose from
    limit = math.log10(1 / 400) + math.log10(0.5)
    assert sum(r["score"] for r in got) / sum((r["n_tokens"] - 1) / 2 for r in got) > limit - 0.15


def test_probabilities_sum_to_one():
    """After any context the words of the training texts and the one other outcome have all the probability."""
    from seqloom.llm.pitman_yor import Sums, Totals, Vocabulary, predictive

    rng = np.random.default_rng(5)
    n, known = 30, 0.4
    p0 = rng.random(n)
    p0 *= known / p0.sum()
    count = rng.integers(0, 9, (n, 2))  # words by context; each word has been seen
    count[:, 0] += count.sum(1) == 0
    t2 = np.minimum(count, rng.integers(1, 4, (n, 2)))
    c1 = t2.sum(1)
    t1 = np.minimum(c1, rng.integers(1, 3, n))
    v = Vocabulary(None, np.ones(n, int), np.full(n, 2), np.zeros(n, np.uint32), np.zeros(2, np.uint64), np.tile([0, 1], n), count.ravel())
    totals, sums = Totals(int(count.sum()), n, 0.6, 0.7, 2 * n, None), Sums(float(c1.sum()), float(t1.sum()), known)
    p = predictive(v, np.log(p0), t2.ravel(), t1, count.sum(0), t2.sum(0), totals, sums, Settings()).reshape(n, 2)
    fall = (1 + 0.6 * t1.sum()) / (1 + c1.sum())
    other = (1 + 0.7 * t2.sum(0)) / (1 + count.sum(0)) * fall * (1 - known)
    assert np.allclose(p.sum(0) + other, 1)


def test_very_long_text(spark):
    rows = [(1, "word other " * 150_000), (2, "word other"), (3, "word")]
    got = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string"), settings=Settings(fold=0)).collect()}
    assert got[1]["n_tokens"] == 300_001 and got[1]["train_tokens"] == 300_001 + 3 + 2
    assert got[1]["perplexity"] < 1.1 < got[3]["perplexity"]
