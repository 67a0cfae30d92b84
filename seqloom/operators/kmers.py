"""K-mers, the seed index and candidate joins."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays

TILE = 64


def positions(df: DataFrame, id_col: str, residues_col: str, k: int, step: int = 1, short: int = 1, pad: int = 0) -> DataFrame:
    """``id, res_ind, tile, at``: every start of a k-mer, with a short stretch of residues (``pad`` more on either side)
    in which it stands at 0-based ``at``.

    With ``short`` 1 the last k-mer is left out, as an index of fragments has it. Rows carry a tile, never the whole
    sequence, so the work grows with the length and not with its square.
    """
    width = TILE * step
    last = F.length("residues") - (k + short)
    rows = df.select(df[id_col].alias(id_col), F.col(residues_col).alias("residues")).where(last >= 0)
    rows = rows.select(id_col, "residues", last.alias("last"), F.explode(F.sequence(F.lit(0), last, F.lit(width))).alias("first"))
    from_ = F.greatest(F.col("first") - pad, F.lit(0))
    rows = rows.select(id_col, "last", "first", from_.alias("from_"), F.substring("residues", from_ + 1, F.col("first") - from_ + (width + k + pad)).alias("tile"))
    rows = rows.select(id_col, "from_", "tile", F.explode(F.sequence("first", F.least(F.col("first") + (width - 1), F.col("last")), F.lit(step))).alias("res_ind"))
    return rows.select(id_col, "res_ind", "tile", (F.col("res_ind") - F.col("from_")).alias("at"))


#: Letters of a tile that goes to Python; a longer sequence is several.
WIDE = 1 << 20


def _tiles(df: DataFrame, id_col: str, residues_col: str, k: int, step: int, short: int, pad: int) -> DataFrame:
    """``id, first, from_, n, tile``: stretches with the ``n`` starts of k-mers from ``first`` on."""
    width = WIDE * step
    last = F.length("residues") - (k + short)
    rows = df.select(df[id_col].alias(id_col), F.col(residues_col).alias("residues")).where(last >= 0)
    rows = rows.select(id_col, "residues", last.alias("last"), F.explode(F.sequence(F.lit(0), last, F.lit(width))).alias("first"))
    from_ = F.greatest(F.col("first") - pad, F.lit(0))
    n = F.floor((F.least(F.col("first") + (width - 1), F.col("last")) - F.col("first")) / step) + 1
    return rows.select(id_col, "first", from_.alias("from_"), n.alias("n"), F.substring("residues", from_ + 1, F.col("first") - from_ + (width + k + pad)).alias("tile"))


def _starts(b: pa.RecordBatch, step: int, low: int, wildcard: str | None, k: int) -> tuple:
    """(letters, place of each start in them, its row, its position in the sequence)."""
    data, off = arrays.letters(b.column("tile"))
    first, from_, n = (b.column(c).to_numpy().astype(np.int64) for c in ("first", "from_", "n"))
    row = np.repeat(np.arange(n.size), n)
    pos = first[row] + step * (np.arange(row.size) - (np.cumsum(n) - n)[row])
    at = off[row] + pos - from_[row]
    keep = np.ones(at.size, bool)
    if low:
        keep &= ~arrays.near_run(data, off, low)[at]
    if wildcard:
        wild = np.concatenate([[0], np.cumsum(data == ord(wildcard))])
        keep &= wild[at + k] == wild[at]
    return data, at[keep], row[keep], pos[keep]


#: Bits of a table that says which keys may be wanted: 1 MB.
_SLOTS = 23


def key_slots(one: np.ndarray | None = None, two: np.ndarray | None = None):
    """Places of keys in such a table; without keys its size."""
    if one is None:
        return 1 << _SLOTS
    x = one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= two.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def key_table(keys: DataFrame) -> bytes:
    """A table of hashed keys of ``keys(key1, key2)``, of one size however many there are: what it lacks is none of them."""
    def run(batches):
        bits = np.zeros(1 << _SLOTS, bool)
        for b in batches:
            bits[key_slots(b.column("key1").to_numpy(), b.column("key2").to_numpy())] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << _SLOTS - 3, np.uint8)
    for r in keys.select("key1", "key2").mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def kmer_keys(df: DataFrame, id_col: str, residues_col: str, k: int, step: int = 1, short: int = 1, low: int = 0, wildcard: str | None = None, text: bool = False, wanted: bytes | None = None) -> DataFrame:
    """``id, res_ind, key1, key2`` (and ``kmer``) of every k-mer of letters in the alphabet, 26 at most; two keys tell
    it exactly, and up to 13 letters ``key1`` is its number. ``low``: not beside a run of that many equal letters.
    ``wanted``: a ``key_table``, of whose keys none is left out; most others are, before they become rows.

    With ``short`` 1 the last k-mer is left out, as an index of fragments has it.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        table = None if wanted is None else np.unpackbits(np.frombuffer(wanted, np.uint8)).view(bool)
        for b in arrays.bounded(batches, "tile"):
            data, at, row, pos = _starts(b, step, low, wildcard, k)
            one, two = arrays.keys(data, at, k)
            good = np.flatnonzero(one >= 0 if table is None else (one >= 0) & table[key_slots(one, two)])
            cols = [b.column(id_col).take(pa.array(row[good])), pa.array(pos[good].astype(np.int32)), pa.array(one[good]), pa.array(two[good])]
            yield pa.RecordBatch.from_arrays([*cols, arrays.texts(data, at[good], k)] if text else cols, names=names)

    names = [id_col, "res_ind", "key1", "key2", *(["kmer"] if text else [])]
    return _tiles(df, id_col, residues_col, k, step, short, low).mapInArrow(run, f"{id_col} {kind}, res_ind int, key1 long, key2 long" + (", kmer string" if text else ""))


def kmers(df: DataFrame, id_col: str, residues_col: str, k: int, step: int = 1, short: int = 1, skip_wildcard: str | None = None) -> DataFrame:
    """``id, res_ind, kmer, kmer_hash``: one row a k-mer. Beyond 13 letters the hash is xxHash."""
    rows = kmer_keys(df, id_col, residues_col, k, step, short, wildcard=skip_wildcard, text=True)
    return rows.select(id_col, "res_ind", "kmer", (F.col("key1") if k <= arrays.LONG else F.xxhash64("kmer")).alias("kmer_hash"))


def seed_index(coarse: DataFrame, k: int = 6, low_complexity: int = 6, id_col: str = "coarse_id", residues_col: str = "residues") -> DataFrame:
    """``kmer_hash, coarse_id, res_ind`` of every k-mer that is not beside a run of ``low_complexity`` equal letters."""
    rows = kmer_keys(coarse, id_col, residues_col, k, low=low_complexity)
    return rows.select(F.col("key1").alias("kmer_hash"), F.col(id_col).alias("coarse_id"), "res_ind")


def count_seeds(coarse: DataFrame, k: int = 6, low_complexity: int = 6, id_col: str = "coarse_id", residues_col: str = "residues", most: int = 4_000_000) -> DataFrame:
    """``kmer_hash, n_seeds, first_id, first_ind`` without a row a seed: counts and first places are made a batch at a
    time before anything is shuffled."""
    def run(batches):
        def emit(parts):
            h, i, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((pos, i, h))
            h = h[order]
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if h.size else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h[cut]), pa.array(np.diff(np.append(cut, h.size))), pa.array(i[order][cut]), pa.array(pos[order][cut])], names=["kmer_hash", "n", "i", "pos"])

        held, size = [], 0
        for b in arrays.bounded(batches, "tile"):
            data, at, row, pos = _starts(b, 1, low_complexity, None, k)
            h = arrays.numbers(data, at, k)
            good = h >= 0
            held.append((h[good], b.column(id_col).to_numpy().astype(np.int64)[row[good]], pos[good]))
            size += h.size
            if size >= most:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    rows = _tiles(coarse, id_col, residues_col, k, 1, 1, low_complexity).mapInArrow(run, "kmer_hash long, n long, i long, pos long")
    return rows.groupBy("kmer_hash").agg(F.sum("n").alias("n_seeds"), F.min("i").alias("first_id"), F.min_by("pos", "i").alias("first_ind"))


def seed_counts(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("kmer_hash").agg(F.count("*").alias("n_seeds"), F.min(F.struct("coarse_id", "res_ind")).alias("first"))


def seed_lists(seeds: DataFrame, block: int = 4096) -> DataFrame:
    """Location lists by k-mer in blocks of one sequence range each, so a frequent k-mer is never one value."""
    rows = seeds.withColumn("list_block", F.floor(F.col("coarse_id") / block))
    return rows.groupBy("kmer_hash", "list_block").agg(F.sort_array(F.collect_list(F.struct("coarse_id", "res_ind"))).alias("locations"))


def seed_candidates(queries: DataFrame, seeds: DataFrame | None, coarse: DataFrame, k: int = 6, ext: int = 0) -> DataFrame:
    """Query k-mers joined to seed locations that fit and whose next ``ext`` residues are equal.

    ``queries(query_id, residues)`` and ``coarse(coarse_id, residues)``. With an extension the join key is the whole
    k + ext letters, which cuts hot k-mers down before any pair is made. ``seeds`` None: all k-mers are seeds.
    """
    own = kmer_keys(queries, "query_id", "residues", k + ext, short=0)
    q = own.select("query_id", F.col("res_ind").alias("q_ind"), F.col("key1").alias("q1"), F.col("key2").alias("q2"))
    c = kmer_keys(coarse, "coarse_id", "residues", k + ext, wanted=key_table(own))  # strict: none at the very end
    found = q.join(c, (F.col("q1") == F.col("key1")) & (F.col("q2") == F.col("key2"))).select("query_id", "q_ind", "coarse_id", "res_ind")
    return found.join(seeds.select("coarse_id", "res_ind"), ["coarse_id", "res_ind"], "left_semi") if seeds is not None else found
