import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import queries
from seqloom.llm.tokens import Chunk, Cutter, _load, _unpack_places, count_pieces, count_tokens, cut_chunks, piece_counts, sorted_pieces
from seqloom.llm.textkit import unpack


def spec(name=queries.TOKENIZER):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def tok():
    return _load(spec())


@pytest.fixture(scope="module")
def cutter():
    return Cutter(spec())


def library(tok, texts):
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def counted(cutter, texts):
    """Sums of the pieces of each text's pre-tokens."""
    out = []
    for t in texts:
        parts, found = cutter.cut(t)
        own = [x for p in parts for x in p]
        out.append(found + int(piece_counts(cutter.tok, cutter.plain, own).sum()))
    return out


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_against_library(cutter, tok, texts):
    assert counted(cutter, texts) == library(tok, texts)


TEXTS = ["", " ", "\n\n  x", "it's I'LL 'tis", "a<|endoftext|>b <|endoftext|> c", "<|endoftext|>", "日本語 ﷽ ㍿", "1234567 ١٢", "a\u00a0b\u2003c\u200bd", "x" * 5000]


def test_fixed_cases(cutter, tok):
    assert counted(cutter, TEXTS) == library(tok, TEXTS)


def test_long_texts_in_parts(tok):
    small = Cutter(spec(), part=7)
    texts = ["one  two three's  four 5 six\n\nseven eight's nine", "é a b c d e f g h i j k l m", "nospacesatallinthistext", "a b<|endoftext|>c d e f g h i"]
    assert counted(small, texts) == library(tok, texts)
    assert sum(1 for _ in small.cut(texts[0])[0]) > 1


def test_chunk_has_frequencies(cutter):
    c = Chunk(most=3)
    c.add(pa.array([1, 2, 3]), ["a b a a", "", "b b c a"], cutter)
    c.add(pa.array([4]), [" b" * 5], cutter)
    n, m, size, place, count, words = c.row()
    size = unpack(size, np.uint32, n).astype(np.int64)
    place, count, words, got, at = _unpack_places(place, size), unpack(count, np.uint32, m), words.to_pylist(), [], 0
    for k in size.tolist():
        got.append({words[p]: int(x) for p, x in zip(place[at : at + k], count[at : at + k])})
        at += k
    assert got == [{"a": 1, " a": 2, " b": 1}, {}, {"b": 1, " b": 1, " c": 1, " a": 1}, {" b": 5}]


def test_each_pre_token_is_counted_once(spark, tok):
    asked = []
    count = lambda own: (asked.extend(own), np.array([len(x) for x in own]))[1]
    got = list(sorted_pieces(iter([["a", "a", "bb"], ["bb", "bb"], [], ["bb", "ccc"], ["ccc", "d"]]), count))
    assert asked == ["a", "bb", "ccc", "d"] and [g.tolist() for g in got] == [[1, 1, 2], [2, 2], [], [2, 3], [3, 1]]
    df = spark.createDataFrame([(i, f"some words and more {i % 3}") for i in range(60)], "doc_id long, text string").repartition(6)
    words = cut_chunks(df, spec(), "doc_id", "text", 20).select(F.col("chunk").alias("home"), F.posexplode("words").alias("k", "word"))
    words = spark.createDataFrame(words.collect(), words.schema)
    found = count_pieces(words, spec()).join(words, ["home", "k"]).collect()
    assert len(found) == words.count() > 40 and len({r["word"] for r in found}) == 7
    assert all(r["pieces"] == library(tok, [r["word"]])[0] for r in found)


def test_other_kind_of_tokenizer(spark):
    texts = ["Hello  There's ÉA 123!", None, "a<|endoftext|>b", "A \n B's"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    other = spec("word_bpe_49k.json")
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, other).collect()}
    assert got == dict(enumerate(library(_load(other), [t or "" for t in texts])))
    with pytest.raises(ValueError):
        Cutter('{"pre_tokenizer": null}')


def test_edges(spark):
    df = spark.createDataFrame([(1, "é", 5), (1, "é", 5), (None, None, 5), (3, "a " * 3000, 5)], "doc_id long, text string, n_tokens long")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(df, spec()).collect())
    assert got[0] == (0, 0, 0, False) and got[1] == got[2] and got[1][1] == 2 and got[3][3] is True
    assert count_tokens(df.limit(0), spec()).count() == 0
    assert sorted(r["n_tokens"] for r in count_tokens(df, spec(), chunk_bytes=1).collect()) == sorted(g[2] for g in got)


def test_query(spark, sf_dir, tok):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op2_token_counts(spark, sf_dir).collect()
    want = dict(zip(rows, library(tok, list(rows.values()))))
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want
    assert all(r["n_bytes"] == len(rows[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
