import gzip

import pytest
from pyspark.sql import functions as F

from seqloom.functions import exprs
from seqloom.functions.tables import SEQUENCES
from seqloom.operators import compress as C
from seqloom.operators import kmers, links, sets
from seqloom.operators.align import Aligner, align
from seqloom.plans import search as S
from seqloom.plans.store import Database
from seqloom.sources import compressed_csv, fasta, hits
from seqloom.sources.params import DatabaseParams
from seqloom.streaming.append import append_stream, rates

BASE = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVVHSLAKWKRQTLGQHDFSAGEGLYTHMKALRPDEDRLSPLHSVYVDQWDWE"


def proteins():
    near = BASE[:50] + "WW" + BASE[52:80] + BASE[83:]
    return [(0, "a", BASE), (1, "b", BASE), (2, "c, \"q\"", near), (3, "d", BASE[::-1]), (4, "e", ""), (5, "f", "A" * 70 + BASE[20:90]), (6, "g", BASE[:9]), (7, "h", BASE[::-1][:90] + BASE[30:])]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(proteins(), SEQUENCES)


@pytest.mark.parametrize("params, buckets", [(C.Params(), 1), (C.Params(), 3), (C.FAST, None), (C.FAST, 5), (C.Params(ext_seed=4, step=4, wildcard="N"), 1)])
def test_round_trip(spark, seqs, params, buckets):
    raw = C.compress_buckets(C.assign_buckets(seqs, params, buckets), params)
    compressed, coarse = C.number_fragments(raw, 10)
    back = {r["seq_id"]: (r["name"], r["residues"]) for r in links.decompress(compressed, coarse).collect()}
    assert back == {i: (n, r) for i, n, r in proteins()}
    ids = sorted(r[0] for r in coarse.select("coarse_id").collect())
    assert ids == list(range(10, 10 + len(ids)))
    again = C.number_fragments(C.compress_buckets(C.assign_buckets(seqs, params, buckets), params), 10)[0]
    assert compressed.orderBy("seq_id").collect() == again.orderBy("seq_id").collect()


def test_one_bucket_finds_copies(seqs):
    p = C.Params()
    compressed, coarse = C.number_fragments(C.compress_buckets(C.assign_buckets(seqs, p, 1), p))
    rows = {r["seq_id"]: r["links"] for r in compressed.collect()}
    assert len(rows[1]) == 1 and rows[1][0]["diff"] == "" and rows[1][0]["coarse_id"] == 0
    n = {r["coarse_id"]: r["n_links"] for r in links.links_per_coarse(coarse, compressed).collect()}
    assert n[0] >= 3 and min(n.values()) >= 1
    assert links.compression_ratio(seqs, coarse).first()["ratio"] < 75


def test_reduced_alphabet(spark):
    rows = [(i, n, "".join(c for c in r if c not in "O")) for i, n, r in proteins()]
    df = spark.createDataFrame(rows, SEQUENCES)
    compressed, coarse = C.compress_reduced(df, buckets=1)
    want = {r["seq_id"]: r["x"] for r in df.select("seq_id", exprs.reduce_alphabet(F.col("residues")).alias("x")).collect()}
    assert {r["seq_id"]: r["residues"] for r in links.decompress(compressed, coarse).collect()} == want


def test_renderers(spark):
    df = spark.createDataFrame([("n", [(1, 2, 3, "s0A"), (4, 0, 9, "")])], "name string, links array<struct<coarse_id: long, c_start: int, c_end: int, diff: string>>")
    r = df.select(exprs.render_compressed(F.col("name"), F.col("links")).alias("a"), exprs.render_mod(exprs.parse_script(F.lit("s3AB"))[0]).alias("b")).first()
    assert tuple(r) == ("> n\n1 (2, 3) s0A\n4 (0, 9) ", "s (3, 5) AB")


def test_unknown_fragment_is_an_error(spark):
    bad = spark.createDataFrame([(0, "x", [(9, 0, 1, "")])], "seq_id long, name string, links array<struct<coarse_id: long, c_start: int, c_end: int, diff: string>>")
    with pytest.raises(Exception, match="no such fragment"):
        links.decompress(bad, spark.createDataFrame([(0, "A")], "coarse_id long, residues string")).collect()


def test_kmers_of_short_and_long(spark):
    df = spark.createDataFrame([(0, "ABCDEF"), (1, "ABCDEFG"), (2, ""), (3, "ABCDEFGHIK" * 40)], "id long, residues string")
    assert kmers.kmers(df, "id", "residues", 6).where("id < 3").count() == 1
    assert kmers.kmers(df, "id", "residues", 6, short=0).where("id < 3").count() == 3
    got = {(r["res_ind"], r["kmer"]) for r in kmers.kmers(df.where("id = 3"), "id", "residues", 6).collect()}
    text = "ABCDEFGHIK" * 40
    assert got == {(i, text[i : i + 6]) for i in range(394)}
    assert kmers.kmers(df.where("id = 3"), "id", "residues", 6, step=4).count() == 99


def test_seed_candidates(spark):
    c = spark.createDataFrame([(0, BASE)], "coarse_id long, residues string")
    q = spark.createDataFrame([("q", BASE[40:60])], "query_id string, residues string")
    found = kmers.seed_candidates(q, kmers.seed_index(c), c, 6, 4).collect()
    assert {r["res_ind"] - r["q_ind"] for r in found} == {40} and len(found) == 11


def test_params():
    p = DatabaseParams(db_size=7, read_only=False)
    assert DatabaseParams.parse("# c\n\n" + p.text()) == p and len(p.items()) == 17
    with pytest.raises(ValueError):
        p.merged(map_seed_size=5)
    with pytest.raises(ValueError):
        DatabaseParams.parse("Nope:1")


def test_store(spark, seqs, tmp_path):
    path = str(tmp_path / "db")
    db = Database.create(spark, path, seqs, DatabaseParams(read_only=False, save_plain=True, save_compressed=True), fast=False)
    records = spark.read.text(f"{path}/compressed.csv")
    assert records.count() == 8 and list((tmp_path / "db" / "compressed.csv").glob("*.gz"))
    assert {r["x"][0] for r in records.select(compressed_csv.parse_record(F.col("value")).alias("x")).collect()} == {n for _, n, _ in proteins()}
    assert db.decoded().count() == 8 and db.decoded().is_cached
    with pytest.raises(Exception, match="(?i)exist"):
        Database.create(spark, path, seqs)
    more = spark.createDataFrame([(0, "z", BASE[:100]), (1, "y", BASE)], SEQUENCES)
    db.append(more)
    got = {r["seq_id"]: r["residues"] for r in Database.open(spark, path).sequences().collect()}
    assert got == {**{i: r for i, _, r in proteins()}, 8: BASE[:100], 9: BASE}
    assert Database.open(spark, path).params.db_size == sum(len(r) for _, _, r in proteins()) + 100 + len(BASE)
    assert db.seeds.count() > 0 and db.lookup(spark.createDataFrame([(9,)], "seq_id long")).first()["residues"] == BASE
    one = spark.createDataFrame([(0,)], "coarse_id long")
    assert db.fragments(one).count() == 1 and db.fragment_links(one).count() >= 1
    db.compact(1)
    assert Database.open(spark, path).sequences().count() == 10
    assert db.vacuum() == 2 and db.vacuum() == 0 and Database.open(spark, path).sequences().count() == 10
    closed = Database.create(spark, str(tmp_path / "ro"), seqs)
    with pytest.raises(PermissionError):
        closed.append(more)
    assert closed.seeds.count() > 0


def test_append_uses_stored_fragments(spark, tmp_path):
    """What is stored is linked to, not stored again: the appended copies add next to nothing."""
    import random

    rng = random.Random(1)
    base = [(i, f"s{i}", "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(400))) for i in range(20)]
    near = [(i, f"t{i}", r[:150] + "W" + r[151:300] + r[302:]) for i, _, r in base]
    db = Database.create(spark, str(tmp_path / "db"), spark.createDataFrame(base, SEQUENCES), DatabaseParams(read_only=False))
    before = db.coarse.count()
    db.append(spark.createDataFrame(near, SEQUENCES))
    size = db.coarse.agg(F.sum(F.length("residues"))).first()[0]
    assert before == 20 and size < 1.1 * 20 * 400
    assert {r["seq_id"]: r["residues"] for r in db.sequences().collect()} == {**{i: r for i, _, r in base}, **{20 + i: r for i, _, r in near}}


def test_failed_append_changes_nothing(spark, seqs, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    db = Database.create(spark, path, seqs, DatabaseParams(read_only=False))
    monkeypatch.setattr(Database, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    more = spark.createDataFrame([(0, "z", BASE[:100])], SEQUENCES)
    with pytest.raises(OSError):
        Database.open(spark, path).append(more, mark=3)
    assert Database.open(spark, path).sequences().count() == 8
    monkeypatch.undo()
    db = Database.open(spark, path).append(more, mark=3)
    assert db.append(more, mark=3).sequences().count() == 9 and Database.open(spark, path).params.db_size == sum(len(r) for _, _, r in proteins()) + 100


def test_near_copies_share_a_bucket(spark):
    import random

    rng = random.Random(2)
    fresh = lambda n: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n))
    rows = []
    for g in range(30):
        base = fresh(500)
        for k in range(4):
            at = rng.randrange(500)
            rows.append((len(rows), str(g), base[:at] + fresh(3) + base[at:]))
    df = spark.createDataFrame(rows, SEQUENCES)
    p = C.FAST
    got = C.assign_buckets(df, p, 16).select("seq_id", "bucket").collect()
    bucket = {r["seq_id"]: r["bucket"] for r in got}
    assert sum(len({bucket[4 * g + k] for k in range(4)}) == 1 for g in range(30)) >= 27
    compressed, coarse = C.number_fragments(C.compress_buckets(C.assign_buckets(df, p, 16), p))
    assert links.compression_ratio(df, coarse).first()["ratio"] <= 60
    assert {r["seq_id"]: r["residues"] for r in links.decompress(compressed, coarse).collect()} == {i: r for i, _, r in rows}


def test_vectorised_kmers_and_frames():
    import random

    import numpy as np
    import pyarrow as pa

    from seqloom.functions import arrays
    from seqloom.functions.alphabet import AMINO, codons

    rng = random.Random(3)
    rows = ["".join(rng.choice("AAAAABCX*") for _ in range(rng.randrange(30))) for _ in range(60)] + [None, ""]
    data, off = arrays.letters(pa.array(rows, pa.string()))
    for w in (2, 3, 5):
        got, at = arrays.near_run(data, off, w), 0
        for r in rows:
            for o in range(len(r or "")):
                part = r[max(o - w, 0) : min(len(r), o + w)]
                assert got[at] == any(part[i : i + w] == part[i] * w for i in range(len(part) - w + 1)), (r, o, w)
                at += 1
    text = "ACDEFGHIKLMNPQRSTVWYABCZ"
    letters, _ = arrays.letters(pa.array([text + "*A"]))
    one, two = arrays.keys(letters, np.array([0, 1, 2]), 24)
    number = lambda x: sum(AMINO.index(c) * 23 ** (len(x) - 1 - i) for i, c in enumerate(x))
    assert (one[0], two[0]) == (number(text[:13]), number(text[13:])) and one[1] == one[2] == -1
    bases = ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 31, 60)]
    table, pair = codons(), dict(zip("ACGTN", "TGCAN"))
    for r, got in zip(bases, arrays.six_frames(pa.array(bases)).to_pylist()):
        back = "".join(pair[c] for c in reversed(r))
        want = []
        for f in range(3):
            for s in (r, back):
                cut = [s[i : i + 3] for i in range(f, len(s) - 2, 3)]
                want.append("".join("X" if "N" in c else table[c].replace("_", "") for c in cut))
        assert got == want
    with pytest.raises(ValueError):
        arrays.six_frames(pa.array(["ACZ"]))


def test_fasta_splits(spark, tmp_path):
    """A file of many splits gives the same rows as one of a single split, in the same order."""
    want = [(i, f"name {i} > x", "ACDEFGHIKL"[: 1 + i % 10] * 3) for i in range(3000)]
    text = "; a comment\n\n" + "".join(f">{n}\r\n{r[:10]}\n{r[10:]}\n" for _, n, r in want)
    (tmp_path / "big.fa").write_text(text)
    (tmp_path / "more.fa").write_text(">last\nAAA")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "9000")
        df = fasta.read_fasta(spark, [str(tmp_path / "big.fa"), str(tmp_path / "more.fa")])
        assert spark.read.option("lineSep", "\n>").text(str(tmp_path / "big.fa")).rdd.getNumPartitions() > 3
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set(key, before)
    assert got == [*want, (3000, "last", "AAA")]


def test_xml_file(spark, tmp_path):
    hsp = "<Hsp><Hsp_num>1</Hsp_num><Hsp_evalue>0.5</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>9</Hsp_query-to><Hsp_hit-from>3</Hsp_hit-from><Hsp_hit-to>20</Hsp_hit-to></Hsp>"
    one = lambda q: f"<Iteration><Iteration_query-def>{q}</Iteration_query-def><Iteration_hits><Hit><Hit_num>1</Hit_num><Hit_accession>7</Hit_accession><Hit_hsps>{hsp}</Hit_hsps></Hit></Iteration_hits></Iteration>"
    text = "<?xml version='1.0'?>\n<BlastOutput><BlastOutput_iterations>" + one("q1") + "\n" + one("q2") + "</BlastOutput_iterations></BlastOutput>"
    (tmp_path / "x.xml").write_text(text)
    want = sorted(tuple(r) for r in hits.parse_xml(spark.createDataFrame([(text,)], "x string"), "x").collect())
    assert len(want) == 2 and sorted(tuple(r) for r in hits.read_xml(spark, str(tmp_path / "x.xml")).collect()) == want


def test_dumps_and_compressed_sink(spark, tmp_path):
    own = spark.createDataFrame([(3, "n", [(1, 0, 5, "s1A"), (2, 3, 4, "")])], "seq_id long, name string, links array<struct<coarse_id: long, c_start: int, c_end: int, diff: string>>")
    compressed_csv.write_links_csv(own, str(tmp_path / "l"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["1,3,0,5", "2,3,3,4"]
    compressed_csv.write_seeds_csv(spark.createDataFrame([(5, 1, 2)], "kmer_hash long, coarse_id long, res_ind int"), str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s")).first()[0] == "5,1,2"
    seqs = spark.createDataFrame([(0, "a", "ACD"), (1, "b", "EF")], SEQUENCES)
    fasta.write_fasta(seqs, str(tmp_path / "f"), compression="gzip")
    assert list((tmp_path / "f").glob("*.gz")) and sorted(tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "f")).collect()) == [(0, "a", "ACD"), (1, "b", "EF")]


def test_every_band_is_a_hit(spark):
    q = spark.createDataFrame([("q", BASE)], "query_id string, residues string")
    t = spark.createDataFrame([("t", BASE[:55] + "W" * 90 + BASE[60:])], "subject_id string, residues string")
    got = align(q, t, 300, Aligner()).collect()
    assert {(r["q_start"] < 10, r["q_end"] > 100) for r in got} >= {(True, False), (False, True)}


def test_stream_append(spark, seqs, tmp_path):
    db = Database.create(spark, str(tmp_path / "db"), seqs, DatabaseParams(read_only=False))
    src = str(tmp_path / "in")
    spark.createDataFrame([("s", BASE), ("t", BASE[:60])], "name string, residues string").write.parquet(src)
    seen = []
    for _ in range(2):  # the second run finds nothing new
        query = append_stream(spark.readStream.schema("name string, residues string").parquet(src), db, str(tmp_path / "cp"))
        query.awaitTermination(120)
        seen.append([n for _, n, rate in rates(query) if rate > 0])
    assert seen == [[2], []]
    got = Database.open(spark, db.path).sequences().where("seq_id >= 8").orderBy("seq_id").collect()
    assert [(r["seq_id"], r["name"], r["residues"]) for r in got] == [(8, "s", BASE), (9, "t", BASE[:60])]


def test_search(spark, seqs):
    p = C.Params()
    compressed, coarse = C.number_fragments(C.compress_buckets(C.assign_buckets(seqs, p, 1), p))
    q = spark.createDataFrame([("self", BASE), ("part", BASE[10:70]), ("none", "WCWCWCWCWC" * 3)], "query_id string, residues string")
    size = sum(len(r) for _, _, r in proteins())
    two = S.search(q, compressed, coarse, size).collect()
    one = S.search_one_stage(q, seqs, size).collect()
    assert {(r["query_id"], r["subject_id"]) for r in two} <= {(r["query_id"], r["subject_id"]) for r in one}
    best = max((r for r in two if r["query_id"] == "self"), key=lambda r: (r["bit_score"], -int(r["subject_id"])))
    assert best["subject_id"] == "0" and best["perc_identity"] == 100 and (best["q_start"], best["q_end"], best["s_start"], best["s_end"]) == (1, 120, 1, 120) or len(BASE) != 120 and best["perc_identity"] == 100
    assert not [r for r in two if r["query_id"] == "none"]
    assert abs(best["evalue"] / (len(BASE) * size * 2.0 ** -best["bit_score"]) - 1) < 1e-9
    again = S.search_iterated(q, compressed, coarse, size, 2).collect()
    assert {r["query_id"] for r in again} == {r["query_id"] for r in two}


def test_gapped_alignment(spark):
    t = spark.createDataFrame([("t", BASE[:60] + BASE[64:])], "subject_id string, residues string")
    r = align(spark.createDataFrame([("q", BASE)], "query_id string, residues string"), t, 120, Aligner()).first()
    assert (r["gap_opens"], r["aln_length"], r["mismatches"], r["q_start"], r["q_end"], r["s_end"]) == (1, len(BASE), 0, 1, len(BASE), len(BASE) - 4)


def test_translated(spark):
    back = {"M": "ATG", "K": "AAA", "T": "ACT", "A": "GCT", "Y": "TAT", "I": "ATT", "Q": "CAA", "R": "CGT", "S": "TCT", "F": "TTT", "V": "GTT", "H": "CAT", "L": "CTT", "E": "GAA", "G": "GGT", "P": "CCT", "D": "GAT", "N": "AAT", "W": "TGG"}
    dna = "".join(back[c] for c in BASE)
    q = spark.createDataFrame([("n", "A" + dna)], "query_id string, residues string")
    p = C.Params()
    s = spark.createDataFrame([(0, "x", BASE)], SEQUENCES)
    compressed, coarse = C.number_fragments(C.compress_buckets(C.assign_buckets(s, p, 1), p))
    r = S.search_translated(q, compressed, coarse, len(BASE)).collect()
    assert max(r, key=lambda x: x["bit_score"])["query_id"] == "n/2"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("\n>one > two, \"x\"\nab\nCJ*\n>\nACGT\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">last\nO\n\nU\n")
    (tmp_path / "c.fa").write_text("")
    got = fasta.read_fasta(spark, [str(tmp_path / n) for n in ("a.fa", "b.fa.gz", "c.fa")]).orderBy("seq_id").collect()
    assert [tuple(r) for r in got] == [(0, 'one > two, "x"', "ABCX"), (1, "", "ACGT"), (2, "last", "XX")]


def test_tabular(spark, tmp_path):
    lines = spark.createDataFrame([(" q 3 99.5 10 0 0 1 10 9 1 0e+00 50.1 extra",), ("",), ("short line",)], "value string")
    good = hits.parse_tabular(lines, strict=False).collect()
    assert len(good) == 1 and good[0]["evalue"] == 0 and good[0]["s_start"] == 9
    with pytest.raises(Exception, match="bad hit line"):
        hits.parse_tabular(lines).collect()
    hits.write_tabular(hits.parse_tabular(lines, strict=False), str(tmp_path / "h"))
    assert hits.read_tabular(spark, str(tmp_path / "h")).collect() == good


def test_csv_records(spark):
    kind = "name string, links array<struct<coarse_id: long, c_start: int, c_end: int, diff: string>>"
    rows = [('a, "b"', [(1, 0, 5, "s1A"), (2, 3, 4, "")]), ("", []), ("n", [(3, 1, 2, "")])]
    df = spark.createDataFrame(rows, kind)
    got = df.select(compressed_csv.parse_record(compressed_csv.record_of(F.col("name"), F.col("links"))).alias("r")).select("r.*").collect()
    assert [(r["name"], [tuple(x) for x in r["links"]]) for r in got] == rows
    for bad in ("n,1,2", "n,x,2,3,"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "v string").select(compressed_csv.parse_record(F.col("v")).alias("r")).collect()


def test_sets(spark):
    gold = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a")], "query_id string, subject_id string")
    found = spark.createDataFrame([("q", "a"), ("r", "a"), ("r", "z")], "query_id string, subject_id string")
    r = sets.accuracy(gold, found).first()
    assert (r["queries"], r["gold_hits"], r["misses"], r["perfect"], r["over_90"], r["over_80"]) == (2, 3, 1, 1, 1, 1)
    assert abs(r["accuracy"] - 2 / 3) < 1e-12 and sets.common_queries(gold, found).count() == 2
    assert sets.sample_records(gold, 2, "subject_id").count() == 2
