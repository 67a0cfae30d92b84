"""Every registered engine query against its SQL, or for rows where there is none."""
import pytest

from seqloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, same, sf_dir, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", ["accuracy_summary", "accuracy_sensitive"])
def test_search_recall(spark, sf_dir, name):
    r = QUERIES[name](spark, sf_dir).first()
    assert r["gold_hits"] > 0 and r["accuracy"] >= 0.9


def test_ratio(spark, sf_dir):
    assert QUERIES["compression_ratio"](spark, sf_dir).first()["ratio"] <= 95


def test_links_per_fragment(spark, sf_dir):
    rows = QUERIES["links_per_fragment"](spark, sf_dir).collect()
    assert rows and min(r["n_links"] for r in rows) >= 1


def test_windows_cover_whole_sequences(spark, sf_dir):
    from seqloom.functions import kernels
    from seqloom.plans.queries import sequences

    got = {r["seq_id"]: r for r in QUERIES["align_windows"](spark, sf_dir).collect()}
    rows = sequences(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(r["residues"])
        assert got[r["seq_id"]]["n_pairs"] == len(range(0, n - 25, 50))
    short = min((r for r in rows if len(r["residues"]) >= 100), key=lambda r: len(r["residues"]))
    x = short["residues"].encode()
    assert got[short["seq_id"]]["identity"] == sum(kernels.identity(*kernels.align_global(x[a : a + 25], x[a + 25 : a + 50])) for a in range(0, len(x) - 25, 50))


def test_searches(spark, sf_dir):
    for name in ("translated_search", "iterated_search"):
        rows = QUERIES[name](spark, sf_dir).collect()
        assert rows and all(r["evalue"] <= 10 and r["aln_length"] > 0 for r in rows)
