import random

import numpy as np

from seqloom.operators import align as A
from seqloom.operators import kmers

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def some(rng, n):
    return "".join(rng.choices(LETTERS, k=n))


def test_unwanted_keys_make_no_rows(spark):
    """Of 60,000 k-mers of targets only those of the query, and some that share a slot by chance, become rows."""
    rng = random.Random(1)
    query = some(rng, 300)
    targets = spark.createDataFrame([(i, some(rng, 500) + query[i : i + 100] + some(rng, 400)) for i in range(60)], "subject_id long, residues string")
    queries = spark.createDataFrame([("q", query)], "query_id string, residues string")
    for k in (8, 12, 20):
        own = kmers.kmer_keys(queries, "query_id", "residues", k, short=0)
        rows = kmers.kmer_keys(targets, "subject_id", "residues", k, short=0, wanted=kmers.key_table(own))
        every = kmers.kmer_keys(targets, "subject_id", "residues", k, short=0)
        found, wanted = (x.join(own.select("key1", "key2"), ["key1", "key2"], "left_semi").count() for x in (rows, every))
        assert found == wanted >= 60 * (101 - k)
        assert rows.count() < found + 100 and every.count() == 60 * (1001 - k)


def test_no_wanted_keys(spark):
    none = spark.createDataFrame([], "query_id string, residues string")
    own = kmers.kmer_keys(none, "query_id", "residues", 6, short=0)
    targets = spark.createDataFrame([(0, "ACDEFGHIKL")], "subject_id long, residues string")
    assert kmers.kmer_keys(targets, "subject_id", "residues", 6, wanted=kmers.key_table(own)).count() == 0


def test_many_alignments_as_one_by_one(monkeypatch):
    """Pairs of many lengths and diagonals in tables of any size; low scores are left out before they are traced."""
    rng = random.Random(2)
    a, items = A.Aligner(), []
    for _ in range(150):
        query = some(rng, rng.randrange(1, 90))
        at = rng.randrange(0, 60)
        subject = some(rng, at) + query[: rng.randrange(90)] + some(rng, rng.randrange(3)) + query[rng.randrange(90) :] + "A"
        items.append((A.profile_rows(query.encode()), subject.encode(), at + rng.randrange(-30, 31), query.encode()))
    one = [A.align_local(rows, subject, d, a, query) for rows, subject, d, query in items]
    assert sum(x is not None for x in one) > 100
    for cells in (1, 20_000, 1 << 21):
        monkeypatch.setattr(A, "_CELLS", cells)
        assert A.align_many(items, a) == one
        assert A.align_many(items, a, lambda score, length: score >= 60) == [x if x and x[0] >= 60 else None for x in one]


def test_one_stage_search_builds_no_database(spark, sf_dir, monkeypatch):
    from seqloom.plans import queries as Q

    size = Q.database_size(spark, sf_dir)
    monkeypatch.setattr(Q, "documents_db", lambda *a: (_ for _ in ()).throw(AssertionError("a database was built")))
    seen = []
    monkeypatch.setattr(Q.S, "search_one_stage", lambda q, t, db_size, s: seen.append(db_size))
    Q.one_stage_search(spark, sf_dir)
    assert seen == [size]


def test_scores_of_many_as_tables_to_trace(monkeypatch):
    """Scores by anti-diagonals are those of the traced alignments: any diagonal, bands that leave the subject on either
    side, gaps, profiles, scores too large for small numbers, one pair or many."""
    rng = random.Random(3)
    for a in (A.Aligner(), A.Aligner(diagonal_band=2, gap_open=4), A.Aligner(diagonal_band=1, gap_extend=3)):
        groups, wanted = [], []
        for length, n, times in ((1, 3, 1), (7, 20, 1), (60, 40, 1), (200, 30, 1), (60, 20, 50)):
            query = some(rng, length)
            rows = A.profile_rows(query.encode()) * times
            at = [rng.randrange(0, 60) for _ in range(n)]
            subjects = [(some(rng, i) + query[: rng.randrange(length + 1)] + some(rng, rng.randrange(4)) + query[rng.randrange(length) :] + some(rng, rng.randrange(9))).encode() for i in at]
            diagonal = np.array([i + rng.randrange(-12, 13) for i in at])
            off = np.concatenate([[0], np.cumsum([len(x) for x in subjects])])
            strips = A.stretches(np.frombuffer(b"".join(subjects), np.uint8), off, np.arange(n), diagonal, length, a)
            want = [(A.align_local(rows, x, int(d), a) or [0])[0] for x, d in zip(subjects, diagonal)]
            groups.append((rows, strips))
            wanted.append(want)
        for beside in (1, 25, 1 << 11):
            monkeypatch.setattr(A, "_BESIDE", beside)
            assert [x.tolist() for x in A.band_scores(groups, a)] == wanted


def test_queries_in_tasks_as_joined_seeds(spark, monkeypatch):
    """Targets that pass by the queries give the hits of joined seeds, however small the batches are."""
    rng = random.Random(4)
    words = [some(rng, rng.randrange(3, 9)) for _ in range(40)]
    prose = lambda n: "".join(rng.choices(words, k=n))
    texts = [prose(40) for _ in range(6)] + ["", "ACD", "A" * 90]
    queries = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(texts)] + [("none", None)], "query_id string, residues string")
    rows = [(i, prose(rng.randrange(0, 150)) + rng.choice(texts)[rng.randrange(9) :] + prose(rng.randrange(9))) for i in range(60)]
    targets = spark.createDataFrame([*rows, (60, None), (61, ""), (62, "A" * 300)], "subject_id long, residues string")
    for a in (A.Aligner(seed=6), A.Aligner(seed=8, top=40.0), A.Aligner(seed=15, min_seeds=3)):
        got = []
        for queries_held, pairs, waiting in ((-1, 1, 1), (1 << 22, 1 << 21, 1 << 24), (1 << 22, 50, 5000)):
            monkeypatch.setattr(A, "_QUERIES", queries_held)
            monkeypatch.setattr(A.SeedIndex, "PAIRS", pairs)
            monkeypatch.setattr(A, "_WAITING", waiting)
            got.append(sorted(map(tuple, A.align(queries, targets, 10_000, a).drop("mismatches", "gap_opens", "aln_length", "perc_identity").collect())))
        assert got[0] and all(x == got[0] for x in got[1:])


def test_no_target_is_shuffled_for_each_query(spark):
    """One long target near many queries used to be sent once a pair: 400 pairs of 60,000 letters."""
    rng = random.Random(6)
    parts = [some(rng, 150) for _ in range(400)]
    queries = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(parts)], "query_id string, residues string")
    targets = spark.createDataFrame([(0, "".join(parts))], "subject_id long, residues string")
    held = [(f"q{i}", x.encode()) for i, x in enumerate(parts)]
    a = A.Aligner(seed=8)
    plan = A.align_beside(held, targets, 60_000, a)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    rows = A.align(queries, targets, 60_000, a).collect()
    assert {r["query_id"] for r in rows} == {f"q{i}" for i in range(400)}
    assert all(r["s_start"] == 150 * int(r["query_id"][1:]) + 1 for r in rows if r["aln_length"] == 150)
