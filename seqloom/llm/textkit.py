"""Vectorised word and n-gram hashing over Arrow string columns (numpy, no Python loop over words).

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D unless another separator table is given. A null
text counts as empty. Memory is a small multiple of ``MAX_BYTES`` or of the longest single text.
"""
from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte but letters and digits separates.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = np.asarray(x, np.uint64).copy()
    x += _BASE
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)


def strings(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def trim() -> None:
    """Give freed memory back to the system: a worker that is reused or waits then holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, column: str, max_bytes: int = MAX_BYTES):
    """Cut record batches so that each holds about ``max_bytes`` of text at most (one text at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - 1).clip(0) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        trim()


def pack(a: np.ndarray) -> bytes:
    """Compressed, first bytes of all values first."""
    a = np.ascontiguousarray(a).ravel()
    return pa.compress(a.view(np.uint8).reshape(a.size, -1).T.tobytes(), codec="zstd", asbytes=True) if a.size else b""


def unpack(b: bytes, dtype, n: int) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(b, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).ravel()


def pack_steps(a: np.ndarray) -> bytes:
    """As ``pack``, for unsigned values that mostly rise."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_steps(b: bytes, dtype, n: int) -> np.ndarray:
    return np.cumsum(unpack(b, dtype, n), dtype=dtype)


def by_slice(work, kind: pa.DataType):
    """``work`` (a string array to an array of ``kind``) as the body of an Arrow UDF, on slices of bounded size."""
    def run(col: pa.Array) -> pa.Array:
        parts = [work(b.column(0)) for b in slices([pa.RecordBatch.from_arrays([col], names=["t"])], "t")]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run


@dataclass
class Words:
    data: np.ndarray  # bytes, lower-cased if asked for
    off: np.ndarray  # of texts
    starts: np.ndarray  # of words
    ends: np.ndarray
    first: np.ndarray  # words before each text, n + 1
    hash: np.ndarray | None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.first.size - 1, dtype=np.int64), self.counts)


def spans(data, off, sep):
    n = data.size
    word = ~sep[data]
    brk = np.zeros(n + 1, bool)
    brk[off] = True
    prev = np.zeros(n, bool)
    prev[1:] = word[:-1]
    prev &= ~brk[:n]
    st = word & ~prev
    nxt = np.zeros(n, bool)
    nxt[:-1] = word[1:]
    nxt &= ~brk[1:]
    return word, st, np.flatnonzero(st), np.flatnonzero(word & ~nxt) + 1


def span_hash(data, inside, st, starts, ends) -> np.ndarray:
    """64-bit hash of each span: position-weighted byte sums, then mixed with the length."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    pos = np.arange(data.size, dtype=np.int32 if data.size < 1 << 31 else np.int64)
    pos -= starts.astype(pos.dtype)[np.maximum(np.cumsum(st, dtype=np.int32) - 1, 0)]
    np.maximum(pos, 0, out=pos)
    pos[~inside] = 0
    weight = mix(np.arange(int(pos.max()) + 1, dtype=np.uint64)) | np.uint64(1)
    c = _BYTE[data]
    c *= weight[pos]
    c[~inside] = 0
    return mix(np.add.reduceat(c, starts) + (ends - starts).astype(np.uint64))


def words(col, lower: bool = False, sep: np.ndarray = SPACE, hashed: bool = True) -> Words:
    data, off = strings(col)
    if lower:
        data = LOWER[data]
    word, st, starts, ends = spans(data, off, sep)
    h = span_hash(data, word, st, starts, ends) if hashed else None
    return Words(data, off, starts, ends, np.searchsorted(starts, off), h)


def ngrams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rolling hash, text index) of every ``k``-word window that lies within one text, in order."""
    m = h.size - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(m, np.uint64)
    for i in range(k):
        g *= _BASE
        g += h[i : i + m]
    doc = np.repeat(np.arange(first.size - 1, dtype=np.int64), np.diff(first))
    ok = doc[:m] == doc[k - 1 :]
    return mix(g[ok]), doc[:m][ok]


def crc_rows(ids) -> np.ndarray:
    """crc32 of each id as text; a null id counts as empty text."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if x is None else str(x).encode()) for x in ids.to_pylist()), np.int64, len(ids))
