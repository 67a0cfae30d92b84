import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import queries
from seqloom.llm.repetition import RepetitionRules, keep_by_rules, measure, repetition_report

RULES = RepetitionRules()


def brute(text):
    text = text or ""
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    words = [m[0] for m in found]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    seen, dup, dup_chars, chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            chars += len(line)
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + len(line)
            seen.add(line)
    out |= {"n_dup_lines": dup, "dup_line_chars": dup_chars}
    grams = lambda k: [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    count = Counter(grams(3))
    out["n_repeat_words"] = len({i + d for i, g in enumerate(grams(3)) if count[g] > 1 for d in range(3)})
    base = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    bad = dup_chars > RULES.lines * chars or out["n_symbols"] > RULES.symbols * max(len(words), 1)
    for k, share in RULES.duplicate.items():
        before, cover = set(), set()
        for i, g in enumerate(grams(k)):
            if g in before:
                cover |= set(range(i, i + k))
            before.add(g)
        out[f"dup_{k}gram_chars"] = sum(len(words[i]) for i in cover)
        bad |= out[f"dup_{k}gram_chars"] > share * out["word_chars"]
    return out | {"base_failed": base, "kept": not base and not bad}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t#\x0b\x1c", max_size=200), max_size=6))
def test_against_brute_force(texts):
    m = measure(pa.array([*texts, None], pa.string()), RULES)
    for i, t in enumerate([*texts, None]):
        assert {k: v[i] for k, v in m.items()} == brute(t), t


def test_query_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op6_quality_rules(spark, sf_dir).collect():
        want = brute(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    df = spark.createDataFrame([(1, long, 1), (2, None, 1), (3, "", 1), (1, long, 1), (None, "x " * 100, 1)], "doc_id long, text string, kept int")
    got = repetition_report(df).collect()
    assert len(got) == 5 and sum(r["kept"] for r in got) == 2
    assert keep_by_rules(df).collect() == [r for r in df.collect() if r["text"] == long]
    assert repetition_report(df.limit(0)).count() == 0 and keep_by_rules(df.limit(0)).columns == df.columns
