import pytest
from pyspark.sql import functions as F

from seqloom.functions import exprs


@pytest.fixture(scope="module")
def one(spark):
    return lambda *cols: spark.range(1).select(*cols).first()


def test_hash_and_back(one):
    r = one(exprs.hash_kmer(F.lit("ABCD"), 0, 4).alias("a"), exprs.hash_kmer(F.lit("AAAA"), 0, 4).alias("b"), exprs.hash_kmer(F.lit("xABCD"), 1, 4).alias("c"), exprs.hash_kmer(F.lit("AJCD"), 0, 4).alias("d"))
    assert tuple(r) == (578, 0, 578, -1)
    assert one(exprs.unhash_kmer(F.lit(578), 4).alias("x"))[0] == "ABCD"
    with pytest.raises(ValueError):
        exprs.hash_kmer(F.lit("A"), 0, 14)


def test_residues(one):
    assert one(exprs.residues_of_text(F.lit("a-j o9U x")).alias("x"))[0] == "AXXXX"
    assert one(exprs.residues_of_text(F.lit(None).cast("string")).alias("x"))[0] == ""
    assert one(exprs.normalize(F.lit("ab*C")).alias("x"))[0] == "ABC"


def test_digits(one):
    r = one(*(exprs.amino_digit(F.lit(c)).alias(f"d{i}") for i, c in enumerate(("A", "Z", "J", ""))), exprs.amino_letter(F.lit(22)).alias("x"), exprs.amino_letter(F.lit(-1)).alias("y"))
    assert tuple(r) == (0, 22, -1, -1, "Z", "")


def test_six_frames(one):
    got = one(exprs.six_frames(F.lit("ATGTAANAC")).alias("x"))[0]
    assert len(got) == 6 and got[0] == "MX" and got[1] == "XLH"  # the stop is left out
    assert one(exprs.six_frames(F.lit("AT")).alias("x"))[0] == [""] * 6


def test_low_complexity(one):
    at = lambda s, o, w: one(exprs.low_complexity_at(F.lit(s), F.lit(o), w).alias("x"))[0]
    assert at("ABBBC", 2, 3) and not at("ABBC", 2, 3) and not at("ABBC", 2, 0) and at("ABBC", 2, 1) and at("BBC", 1, 2)


def test_scripts(one):
    src, diff, out = "GTTCACTTATGTATTCATATGATTTTGGCAA", "s6Gd1--s7ATi2TTs4A", "GTTCACGTGTATATTTATATAATTTTGGCAA"
    r = one(exprs.apply_script(F.lit(src), F.lit(diff)).alias("a"), exprs.render_script(exprs.parse_script(F.lit(diff))).alias("b"), exprs.apply_script(F.lit(src), F.lit("")).alias("c"))
    assert tuple(r) == (out, diff, src)
    with pytest.raises(Exception, match="bad edit script"):
        one(exprs.apply_script(F.lit("AAA"), F.lit("sA")).alias("x"))


@pytest.mark.parametrize("make, text", [
    (lambda: exprs.complement(F.lit("ACGZ")), "nucleotide"), (lambda: exprs.reduce_alphabet(F.lit("O")), "alphabet"),
    (lambda: exprs.seq_identity(F.lit("A"), F.lit("")), "unequal"), (lambda: exprs.subsequence(F.lit("ABC"), F.lit(2), F.lit(2)), "range"),
])
def test_errors(one, make, text):
    with pytest.raises(Exception, match=text):
        one(make().alias("x"))


def test_identity_and_misc(one):
    r = one(exprs.seq_identity(F.lit("AAB"), F.lit("AAC")).alias("a"), exprs.seq_identity(F.lit(""), F.lit("")).alias("b"), exprs.repetitive(F.lit("AA")).alias("c"), exprs.repetitive(F.lit("A")).alias("d"), exprs.subsequence(F.lit("ABCD"), F.lit(1), F.lit(3)).alias("e"), exprs.translate_codon(F.lit("TAA")).alias("f"))
    assert tuple(r) == (66, 0, True, False, "BC", "_")


def test_fasta_record(one):
    r = one(exprs.fasta_record(F.lit("n"), F.lit("AB"), space=True).alias("a"), exprs.fasta_record(F.lit("n"), F.lit("AB"), asterisk=True).alias("b"), exprs.fasta_record(F.lit("n"), F.lit("AB"), offset=F.lit(3)).alias("c"))
    assert tuple(r) == ("> n\nAB", ">n\nAB*", ">n (3, 2)\nAB")


@pytest.mark.parametrize("hit, link, keep", [((5, 9), (9, 12), True), ((5, 9), (1, 5), True), ((5, 9), (10, 12), False), ((5, 9), (1, 4), False)])
def test_overlap_is_closed(one, hit, link, keep):
    assert one(exprs.interval_overlap(*map(F.lit, (*hit, *link))).alias("x"))[0] is keep
