import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import queries
from seqloom.llm.decontam import Index, Settings, drop_leaks, find_leaks, split_item
from seqloom.llm.textkit import NON_ALNUM, words

S = Settings()
VOCAB = [f"w{i}" for i in range(400)]


def text(rng, n, common=("the", "of", "a")):
    return " ".join(rng.choice(VOCAB) if rng.random() < 0.6 else rng.choice(common) for _ in range(n))


def brute(index, doc):
    """Best scaled BM25 by item over every passage, each segment scored in full."""
    w = words(pa.array([doc], pa.string()), lower=True, sep=NON_ALNUM).hash
    best = {}
    for a in range(0, max(len(w), 1), S.segment):
        have = set(w[a : a + 2 * S.segment].tolist())
        score = np.zeros(len(index.seg_item))
        for t, s, v in zip(index.post_term, index.post_seg, index.weight):
            if int(index.vocab[t]) in have:
                score[s] += v
        for s, v in enumerate(score):
            if v >= S.threshold - 1e-6:
                i = int(index.seg_item[s])
                best[i] = max(best.get(i, 0), float(v))
    return best


def test_pruning_loses_nothing():
    rng = np.random.default_rng(5)
    items = [text(rng, int(n)) for n in rng.integers(5, 130, 40)] + ["", None]
    index = Index(list(range(len(items))), items, S)
    docs = []
    for k in range(30):
        i = int(rng.integers(0, 40))
        own = items[i].split()
        docs.append(text(rng, int(rng.integers(0, 150))) + " " + " ".join(own[: max(1, int(len(own) * rng.random() * 1.5))]) + " " + text(rng, int(rng.integers(0, 150))))
    found = {}
    for d, i, score, *_ in index.search(pa.array([*docs, "", None], pa.string())):
        found.setdefault(d, {})[i] = score
    assert found
    for d, doc in enumerate(docs):
        want = brute(index, doc)
        assert found.get(d, {}).keys() == want.keys()
        assert all(abs(found[d][i] - v) < 1e-4 for i, v in want.items())


def test_scores_are_bm25_shares():
    index = Index([1, 2], ["alpha beta gamma.", "alpha delta epsilon."], S)
    seg, score, _ = index.matches(np.arange(index.vocab.size))
    assert seg.tolist() == [0, 1] and score.round(5).tolist() == [1, 1]


def test_blocks_are_skipped():
    """A block that cannot reach the threshold is never read, though it holds postings of the passage's terms."""
    rng = np.random.default_rng(9)
    items = [" ".join(f"v{x}" for x in rng.zipf(1.3, 40) % 5000) for _ in range(200)]
    index = Index(list(range(200)), items, S)
    terms = np.unique(np.searchsorted(index.vocab, words(pa.array([items[7]]), lower=True, sep=NON_ALNUM).hash))
    every = sum(index.run_start[index.first[t + 1]] - index.run_start[index.first[t]] for t in terms)
    seg, score, read = index.matches(terms)
    assert 7 in index.seg_item[seg] and 0 < read < every / 2


def test_scattered_words_are_no_leak(spark):
    """Question and answer stand in the text, but far from the passage that was retrieved: no copy of the item."""
    rng = np.random.default_rng(10)
    fresh = lambda n, k: [f"{k}{x}" for x in rng.integers(0, 10**6, n)]
    item = fresh(30, "q") + ["end."] + fresh(20, "a")
    grams = [item[k : k + 3] for k in range(0, 48, 3)]
    far = " ".join(" ".join([*g, *fresh(400, "x")]) for g in grams)
    near = " ".join([*fresh(300, "y"), *item, *fresh(300, "z")])
    docs = spark.createDataFrame([(1, far), (2, near)], "doc_id long, text string")
    got = find_leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).where("leaked").collect()
    assert [r["doc_id"] for r in got] == [2]


def test_very_long_text_and_clashing_columns(spark):
    rng = np.random.default_rng(11)
    item = text(rng, 60)
    docs = spark.createDataFrame([(1, text(rng, 60_000) + " " + item + " " + text(rng, 60_000), "a", "b"), (2, "short", "a", "b"), (2, "short", "a", "b")], "doc_id long, text string, item_id string, leaked string")
    items = spark.createDataFrame([(1, item, 9)], "item_id long, text string, doc_id int")
    assert [(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).where("leaked").collect()] == [(1, 1)]
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2, 2]


@pytest.mark.parametrize("item, q, a", [("One two three. Four five six.", "One two three. ", "Four five six."), ("one two three four five six", "one two three four", "five six"), ("", "", "")])
def test_split(item, q, a):
    assert split_item(item) == (q, a)


def test_leaks_and_edges(spark):
    rng = np.random.default_rng(6)
    item = text(rng, 40)
    half = " ".join(item.split()[:18])
    rows = [(1, text(rng, 300) + " " + item + " " + text(rng, 200), 0.5), (2, text(rng, 300), 0.5), (3, None, 0.5), (4, "", 0.5), (5, item.upper().replace(" ", " ; "), 0.5), (5, item, 0.5), (6, text(rng, 100) + half + text(rng, 100), 0.5), (None, item, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, item)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["item_id"]) for r in find_leaks(docs, items).where("leaked").collect())
    assert got == sorted((d, i) for d in (1, 5, 5, 0) for i in (7, 10))
    assert sorted(str(r["doc_id"]) for r in drop_leaks(docs, items).collect()) == ["2", "3", "4", "6"]
    blocks = Settings(max_items=1)
    assert sorted(((r["doc_id"] or 0), r["item_id"]) for r in find_leaks(docs, items, settings=blocks).where("leaked").collect()) == got
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0 and drop_leaks(docs, items.limit(0)).count() == 8


def test_query(spark, sf_dir):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontamination(spark, sf_dir).collect()}
    assert got == {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}


def test_blocks_share_statistics(spark):
    rng = np.random.default_rng(8)
    items = spark.createDataFrame([(i, text(rng, int(n))) for i, n in enumerate(rng.integers(5, 130, 30))] + [(99, None)], "item_id long, text string")
    docs = spark.createDataFrame([(r["item_id"], " ".join((r["text"] or "").split()[: 8 + r["item_id"]])) for r in items.collect()], "doc_id long, text string")
    one, many = (sorted((r["doc_id"], r["item_id"], round(r["score"], 5)) for r in find_leaks(docs, items, settings=s).collect()) for s in (S, Settings(max_items=10)))
    assert one and one == many
