"""Column expressions: residues, k-mers, translation, predicates and edit scripts, inside the JVM but for two Arrow UDFs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays
from .alphabet import AMINO, IGNORED, REDUCED, codons

#: The alphabet's digits as numbers of that base are written.
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"[: len(AMINO)]


def residues_of_text(text: Column) -> Column:
    """Letters only, upper-cased, ignored letters masked: any text as residues.

    An Arrow UDF, since a regular expression goes through a text letter by letter, twice; not deterministic by name, so
    that no filter on its result makes Spark evaluate it again."""
    return F.arrow_udf(arrays.by_slice(arrays.residues, arrays.pa.string()), "string").asNondeterministic()(text)


def normalize(residues: Column) -> Column:
    return F.upper(F.regexp_replace(residues, r"\*", ""))


def mask_ignored(residues: Column) -> Column:
    """Masks after upper-casing, so that lower-case letters don't slip through."""
    return F.translate(residues, IGNORED, "X" * len(IGNORED))


def subsequence(residues: Column, start: Column, end: Column) -> Column:
    """Half-open [start, end); anything else is an error."""
    bad = (start < 0) | (start >= end) | (end > F.length(residues))
    return F.when(bad, F.raise_error(F.lit("subsequence out of range"))).otherwise(F.substring(residues, start + 1, end - start))


def seq_identity(a: Column, b: Column) -> Column:
    """Floor percent of equal positions; 0 for two empty strings; an error for unequal lengths."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("sequences of unequal length"))).when(F.length(a) == 0, F.lit(0)).otherwise(F.floor(same * 100 / F.length(a)).cast("int"))


def same_positions(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda n, x: n + x)


def amino_digit(letter: Column) -> Column:
    """Rank in the alphabet, -1 if absent."""
    return F.when(letter == "", F.lit(-1)).otherwise(F.instr(F.lit(AMINO), letter) - 1)


def amino_letter(digit: Column) -> Column:
    """The letter of a rank; empty if there is none."""
    return F.when((digit >= 0) & (digit < len(AMINO)), F.substring(F.lit(AMINO), digit.cast("int") + 1, F.lit(1))).otherwise("")


def hash_kmer(residues: Column, at, k: int) -> Column:
    """Base-23 number of the k letters from 0-based ``at``; -1 if one is outside the alphabet. Thirteen letters fill
    a long."""
    if k > 13:
        raise ValueError("a number of more than 13 letters does not fit")
    at = at if isinstance(at, Column) else F.lit(at)
    part = F.substring(residues, at + 1, F.lit(k))
    number = F.conv(F.translate(part, AMINO, _DIGITS), len(AMINO), 10).cast("long")
    return F.when(part.rlike(f"^[{AMINO}]{{{k}}}$"), number).otherwise(F.lit(-1).cast("long"))


def unhash_kmer(number: Column, k: int) -> Column:
    return F.translate(F.lpad(F.lower(F.conv(number.cast("string"), 10, len(AMINO))), k, "0"), _DIGITS, AMINO)


def reduce_alphabet(residues: Column) -> Column:
    """Four letters and N; a letter of no class is an error."""
    source, target = "".join(REDUCED.values()), "".join(k * len(v) for k, v in REDUCED.items())
    bad = residues.rlike(f"[^{source}]")
    return F.when(bad, F.raise_error(F.lit("letter outside the reduced alphabet"))).otherwise(F.translate(residues, source, target))


def translate_codon(codon: Column) -> Column:
    """Amino acid; X for any N, _ for a stop, empty for anything unknown."""
    table = F.create_map(*(F.lit(x) for pair in codons().items() for x in pair))
    return F.when(codon.contains("N"), "X").otherwise(F.coalesce(F.element_at(table, codon), F.lit("")))


def complement(bases: Column) -> Column:
    bad = bases.rlike("[^ACGTN]")
    return F.when(bad, F.raise_error(F.lit("not a nucleotide"))).otherwise(F.translate(bases, "ACGTN", "TGCAN"))


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def six_frames(bases: Column) -> Column:
    """Six proteins, forward and reverse of frames 0, 1, 2 in turn; stops are left out, short input gives empty ones.

    An Arrow UDF: whole columns at a time, where an expression would look up each codon by itself.
    """
    return F.arrow_udf(arrays.six_frames_by_slice, "array<string>")(bases)


def gapped_length(aligned: Column) -> Column:
    return F.length(F.replace(aligned, F.lit("-"), F.lit("")))


def repetitive(residues: Column) -> Column:
    return (F.length(residues) > 1) & (residues == F.repeat(F.substring(residues, 1, 1), F.length(residues)))


def fasta_record(name: Column, residues: Column, space: bool = False, asterisk: bool = False, offset: Column | None = None) -> Column:
    head = F.concat(F.lit("> " if space else ">"), F.coalesce(name, F.lit("")))
    if offset is not None:
        head = F.concat(head, F.when(offset != 0, F.format_string(" (%d, %d)", offset.cast("long"), F.length(residues))).otherwise(""))
    return F.concat(head, F.lit("\n"), residues, F.lit("*" if asterisk else ""))


def render_link(link: Column) -> Column:
    """A link to a fragment as text."""
    return F.format_string("%d (%d, %d) %s", link["coarse_id"], link["c_start"], link["c_end"], link["diff"])


def render_inverse_link(org_seq_id: Column, c_start: Column, c_end: Column) -> Column:
    return F.format_string("%d (%d, %d)", org_seq_id, c_start, c_end)


def render_compressed(name: Column, links: Column) -> Column:
    """A compressed sequence as text: its name, then a line a link."""
    return F.concat_ws("\n", F.array(F.concat(F.lit("> "), name)), F.transform(links, render_link))


def render_mod(mod: Column) -> Column:
    return F.format_string("%s (%d, %d) %s", mod["kind"], mod["start"], mod["end"], mod["residues"])


# --- predicates -------------------------------------------------------------------------------------------------

def run_pattern(w: int, letters: str = AMINO) -> str:
    """A pattern for ``w`` (two at least) equal letters in a row, without back-references."""
    return "|".join(f"{c}{{{max(w, 2)},}}" for c in letters)


def low_complexity_at(residues: Column, offset: Column, w: int) -> Column:
    """Whether some run of ``w`` equal letters lies within ``w`` of ``offset`` on either side."""
    if w < 1:
        return F.lit(False)
    start = F.greatest(offset - w, F.lit(0))
    return F.substring(residues, start + 1, F.least(F.length(residues), offset + w) - start).rlike(run_pattern(w))


def interval_overlap(hit_start: Column, hit_end: Column, start: Column, end: Column) -> Column:
    """Closed at both ends."""
    return ~((hit_end < start) | (hit_start > end))


# --- edit scripts -----------------------------------------------------------------------------------------------

_OPS = r"([sid])(\d+)([A-Z-]*)"


def check_script(diff: Column) -> Column:
    """The script itself, or an error if it is not operations with a number and residues each."""
    return F.when(diff.rlike(rf"^(?:[sid]\d+[A-Z-]*)*$"), diff).otherwise(F.raise_error(F.concat(F.lit("bad edit script: "), diff)))


def parse_script(diff: Column) -> Column:
    """Array of (kind, start, end, residues); numbers in a script count from the operation before."""
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,residues:string>>)")

    def add(done, op):
        start = F.coalesce(F.try_element_at(done, F.lit(-1))["start"], F.lit(0)) + op["delta"]
        return F.concat(done, F.array(F.struct(op["kind"].alias("kind"), start.alias("start"), (start + op["size"]).alias("end"), op["residues"].alias("residues"))))

    return F.aggregate(_ops(diff), empty, add)


def _ops(diff: Column) -> Column:
    """Array of (kind, delta, residues, size): operations as they are written."""
    diff = check_script(diff)
    kind, delta, residues = (F.regexp_extract_all(diff, F.lit(_OPS), F.lit(g)) for g in (1, 2, 3))
    pairs = F.zip_with(kind, delta, lambda a, b: F.struct(a.alias("kind"), b.cast("int").alias("delta")))
    return F.zip_with(pairs, residues, lambda p, r: F.struct(p["kind"].alias("kind"), p["delta"].alias("delta"), r.alias("residues"), F.when(p["kind"] == "i", F.lit(0)).otherwise(F.length(r)).alias("size")))


def render_script(mods: Column) -> Column:
    """The canonical text of parsed operations."""
    before = F.concat(F.array(F.lit(0)), F.transform(mods, lambda m: m["start"]))
    return F.array_join(F.zip_with(mods, F.slice(before, 1, F.size(mods)), lambda m, b: F.concat(m["kind"], (m["start"] - b).cast("string"), m["residues"])), "")


def apply_script(source: Column, diff: Column) -> Column:
    """``source`` edited: copied up to each operation, which adds its residues or skips what it covers."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("last"), F.lit(0).alias("start"))

    def edit(s, op):
        start = s["start"] + op["delta"]
        kept = F.substring(source, s["last"] + 1, start - s["last"])
        return F.struct(F.concat(s["out"], kept, F.when(op["kind"] == "d", "").otherwise(op["residues"])).alias("out"), (start + op["size"]).alias("last"), start.alias("start"))

    done = F.aggregate(_ops(diff), begin, edit)
    edited = F.concat(done["out"], F.substring(source, done["last"] + 1, F.lit(2**31 - 1)))
    return F.when(diff == "", source).otherwise(edited)
