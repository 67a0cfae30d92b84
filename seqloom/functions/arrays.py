"""Vectorised work on Arrow columns of residues (numpy, no Python loop over letters)."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .alphabet import AMINO, IGNORED, codons

#: Letters of a k-mer that a number holds; a key is two numbers.
LONG = 13
_DIGIT = np.full(256, -1, np.int64)
_DIGIT[np.frombuffer(AMINO.encode(), np.uint8)] = np.arange(len(AMINO))


def letters(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def strings_of(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings laid end to end, of the given sizes."""
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(size.size, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def bounded(batches, column: str, most: int = 1 << 20):
    """Cut record batches so that each holds about ``most`` bytes of ``column`` at most (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - 1).clip(0) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        for a, e in zip(cuts, cuts[1:]):
            if e > a:
                yield b.slice(a, e - a)


_RESIDUE = np.zeros(256, np.uint8)  # of each byte of a text; 0: none
for _c in range(26):
    _RESIDUE[[ord("A") + _c, ord("a") + _c]] = ord("X") if chr(ord("A") + _c) in IGNORED else ord("A") + _c


def residues(col) -> pa.Array:
    """The letters of each text, upper-cased, ignored ones masked; null is empty."""
    data, off = letters(col)
    out = _RESIDUE[data]
    kept = out > 0
    before = np.concatenate([[0], np.cumsum(kept)])
    return strings_of(out[kept], np.diff(before[off]))


def by_slice(kernel, kind: pa.DataType):
    """``kernel`` on slices of a column, so that what numpy makes beside it stays small."""
    def run(col: pa.Array) -> pa.Array:
        parts = [kernel(b.column(0)) for b in bounded([pa.RecordBatch.from_arrays([col], names=["s"])], "s")]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


# --- k-mers -----------------------------------------------------------------------------------------------------

def near_run(data: np.ndarray, off: np.ndarray, w: int) -> np.ndarray:
    """Of each letter, whether some run of ``w`` (two at least) equal ones lies within ``w`` of it on either side, in
    the same sequence."""
    need, n = max(w, 2), data.size
    row = np.repeat(np.arange(off.size - 1), np.diff(off))
    same = np.zeros(n + 1, np.int64)
    if n > 1:
        same[1:n] = (data[1:] == data[:-1]) & (row[1:] == row[:-1])
    total = np.cumsum(same)
    start = np.zeros(n + 1, np.int64)  # a run of ``need`` starts here
    if n >= need:
        start[: n - need + 1] = total[need - 1 : n] - total[: n - need + 1] == need - 1
    before = np.concatenate([[0], np.cumsum(start)])
    at = np.arange(n)
    lo = np.maximum(at - w, off[row])
    hi = np.minimum(at + w, off[row + 1]) - need
    return (hi >= lo) & (before[np.maximum(hi + 1, 0)] > before[lo])


def numbers(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Base-23 number of the ``k`` letters from each place; -1 if one is outside the alphabet."""
    out, bad = np.zeros(at.size, np.int64), np.zeros(at.size, bool)
    digit = _DIGIT[data]
    for i in range(k):
        d = digit[at + i]
        bad |= d < 0
        out = out * len(AMINO) + d
    return np.where(bad, -1, out)


def keys(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell the ``k`` letters (26 at most) from each place; -1 if one is outside the alphabet."""
    if k > 2 * LONG:
        raise ValueError(f"a key holds {2 * LONG} letters")
    one = numbers(data, at, min(k, LONG))
    two = numbers(data, at + LONG, k - LONG) if k > LONG else np.zeros(at.size, np.int64)
    bad = (one < 0) | (two < 0)
    return np.where(bad, -1, one), np.where(bad, -1, two)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """``numbers`` of every place with ``k`` letters (13 at most) from it, by doubling."""
    digit = _DIGIT[data]
    out, width = digit, 1
    for bit in bin(k)[3:]:
        out = out[: max(out.size - width, 0)] * len(AMINO) ** width + out[width:]
        width *= 2
        if bit == "1":
            out = out[: max(out.size - 1, 0)] * len(AMINO) + digit[width:]
            width += 1
    bad = np.concatenate([[0], np.cumsum(digit < 0)])
    return np.where(bad[k:] == bad[: max(bad.size - k, 0)], out, -1) if bad[-1] else out


def rolling_keys(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``keys`` of every place with ``k`` letters from it."""
    if k > 2 * LONG:
        raise ValueError(f"a key holds {2 * LONG} letters")
    one = rolling(data, min(k, LONG))
    if k <= LONG:
        return one, np.zeros(one.size, np.int64)
    two = rolling(data[LONG:], k - LONG)
    one = one[: two.size]
    bad = (one < 0) | (two < 0)
    return np.where(bad, -1, one), np.where(bad, -1, two)


def texts(data: np.ndarray, at: np.ndarray, k: int) -> pa.Array:
    """The ``k`` letters from each place."""
    return strings_of(data[at[:, None] + np.arange(k)].ravel(), np.full(at.size, k, np.int64))


# --- translation ------------------------------------------------------------------------------------------------

_BASES = "TCAGN"
_BASE = np.full(256, -1, np.int64)
_BASE[np.frombuffer(_BASES.encode(), np.uint8)] = np.arange(5)
_COMPLEMENT = np.array([_BASES.index(c) for c in "AGTCN"])


def _amino_table() -> np.ndarray:
    """Amino acid of each codon number; X with an N; 0 for a stop."""
    out = np.full((5, 5, 5), ord("X"), np.uint8)
    for c, a in codons().items():
        out[tuple(_BASES.index(x) for x in c)] = 0 if a == "_" else ord(a)
    return out.ravel()


_AMINO = _amino_table()


def six_frames(col) -> pa.Array:
    """Six proteins of each sequence: frames 0, 1, 2, forward and reverse of each in turn; stops are left out, short
    input gives empty ones; anything but bases and N is an error."""
    data, off = letters(col)
    base, n = _BASE[data], off.size - 1
    if (base < 0).any():
        raise ValueError("not a nucleotide")
    back = _COMPLEMENT[base]
    out = []
    for frame in range(3):
        size = np.maximum(np.diff(off) - frame, 0) // 3
        row = np.repeat(np.arange(n), size)
        inner = 3 * (np.arange(row.size) - (np.cumsum(size) - size)[row]) + frame
        for forward in (True, False):
            at = off[row] + inner if forward else off[row + 1] - 1 - inner
            code = np.zeros(row.size, np.int64)
            for i in range(3):
                code = 5 * code + (base[at + i] if forward else back[at - i])
            amino = _AMINO[code]
            kept = amino > 0
            out.append(strings_of(amino[kept], np.bincount(row[kept], minlength=n)))
    order = (np.arange(6)[None, :] * n + np.arange(n)[:, None]).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 6, pa.int32()), pa.concat_arrays(out).take(pa.array(order)))


six_frames_by_slice = by_slice(six_frames, pa.list_(pa.string()))
