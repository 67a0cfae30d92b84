import hashlib

import pytest
from pyspark.sql import functions as F

from seqloom.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_query_and_sql(spark, duck, same, sf_dir):
    same(queries.op1_chat_formatting(spark, sf_dir).toPandas(), duck.sql(queries.OP1_SQL).df())


def test_main_path_is_native(spark, sf_dir):
    plan = queries.op1_chat_formatting(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "<\\\\|", "<<||", "a\n<|im_end|>\n<|im_start|>user\nb", "<|im_end|>\n", "|", "<"])
def test_escape_is_reversible(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b")).first()
    assert r["b"] == text and "<|" not in r["e"]


def test_examples_and_edges(spark):
    rows = [(1, 2, "assistant", "yes <|im_end|>", "x"), (1, 1, "user", "q", "x"), (1, 3, "user", None, "x"), (1, 4, "assistant", "é!", "x"), (1, 4, "assistant", "é!", "x"), (2, 0, None, "only", "x"), (None, None, "a\n%3C<", "t", "x"), (3, 1, "assistant", "", "x")]
    f = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    ex = {}
    for r in chat.prefix_targets(f).select("*", chat.loss_text().alias("loss")).orderBy("conv_id", "example").collect():
        ex.setdefault(r["conv_id"], []).append(r)
    assert [r["loss"] for r in ex[1]] == ["yes <|im_end|>", "é!", "é!"] and [r["loss"] for r in ex[3]] == [""] and 2 not in ex
    assert ex[1][0]["text"].startswith("<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nyes")
    assert all(ex[1][1]["text"].startswith(ex[1][0]["text"]) for _ in (0,))
    turns = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in f.select("conv_id", chat.parse_turns(F.col("formatted")).alias("t")).collect()}
    assert turns[1] == [("user", "q"), ("assistant", "yes <|im_end|>"), ("user", ""), ("assistant", "é!"), ("assistant", "é!")]
    assert turns[None] == [("a\n%3C<", "t")] and turns[2] == [("", "only")]
    assert chat.prefix_targets(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_digest_by_hand(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    got = {r["conv_id"]: r for r in queries.op1_chat_formatting(spark, sf_dir).collect()}
    for c in {r["conv_id"] for r in rows}:
        own = [r for r in rows if r["conv_id"] == c]
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r['role']}\n{r['text']}\n" for r in own).encode()).hexdigest()
        loss = "".join(r["text"] for r in own if r["role"] == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-1]["loss_chars"] == len("<|im_end|><|im_start|>assistant ok")


def test_very_long_text_and_clashing_columns(spark):
    from seqloom.llm import chat

    big = "x<|im_end|>" * 100_000
    df = spark.createDataFrame([(1, 0, "user", big, "a", "b"), (1, 1, "assistant", big, "a", "b")], "conv_id long, turn long, role string, text string, formatted string, targets string")
    formatted = chat.format_conversations(df)
    r = chat.prefix_targets(formatted).select(chat.loss_text().alias("loss"), F.length("text").alias("n")).collect()
    assert len(r) == 1 and r[0]["loss"] == big and r[0]["n"] > 2 * len(big)
    assert [tuple(t) for t in formatted.select(chat.parse_turns(F.col("formatted")).alias("t")).first()["t"]] == [("user", big), ("assistant", big)]
