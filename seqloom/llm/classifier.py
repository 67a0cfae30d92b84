"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature."""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffles_freed
from .textkit import by_slice, crc_rows, mix, pack, slices, trim, unpack, words

#: Rows of the table of context vectors: a word's row is given by 20 bits of its hash, so the table is 32 MB whatever
#: the corpus. Words that share a row add up, and the frequent one rules it.
ROWS = 1 << 20
DIM = 32
FEATURES = 2 * DIM
WINDOW = 2
#: The table is summed in this many pieces.
PIECES = 64


def row_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Sparse ternary index vectors of words, from all bits of their hashes: a quarter of the places is not zero."""
    bits = lambda x: np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1)
    one, two = bits(mix(hashes ^ np.uint64(1 << 61))), bits(mix(hashes ^ np.uint64(1 << 62)))
    return (one[:, :DIM] & one[:, DIM:] & 1).astype(np.int8) * (1 - 2 * two[:, :DIM].astype(np.int8))


def contexts(w) -> tuple[np.ndarray, np.ndarray]:
    """(rows in order, sums of index vectors of the words up to WINDOW away in the same text) of a slice's words."""
    own, number = np.unique(w.hash, return_inverse=True)
    vector, doc = index_vectors(own)[number], w.doc
    near = np.zeros_like(vector)
    for k in range(1, min(WINDOW, number.size - 1) + 1):
        other = doc[k:] != doc[:-k]
        for to, part in ((near[k:], vector[:-k].copy()), (near[:-k], vector[k:].copy())):
            part[other] = 0
            to += part
    return _added(row_of(w.hash), near)


def _added(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not rows.size:
        return np.zeros(0, np.int64), np.zeros((0, DIM), np.int32)
    order = np.argsort(rows, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) > 0]))
    return rows[order[cut]], np.add.reduceat(values[order], cut, axis=0, dtype=np.int32)


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers near zero, place by place, the sign in the lowest bit so that upper bytes are zero."""
    a = a.T.astype(np.int64)
    return pack((a << 1 ^ a >> 63).view(np.uint64))


def _unpack(b: bytes, n: int) -> np.ndarray:
    u = unpack(b, np.uint64, n * DIM)
    return ((u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)).reshape(DIM, n).T


def _piece(k: int, rows: np.ndarray, sums: np.ndarray) -> list[pa.Array]:
    packed = _pack(sums)
    return [pa.array([k]), pa.array([zlib.crc32(packed)]), pa.array([rows.astype(np.uint16).tobytes()], pa.binary()), pa.array([packed], pa.binary())]


def _total(table: pa.Table) -> np.ndarray:
    total = np.zeros((ROWS // PIECES, DIM), np.int64)
    for r, v in zip(table.column("rows"), table.column("sums")):
        at = np.frombuffer(r.as_py(), np.uint16)
        total[at] += _unpack(v.as_py(), at.size)
    return total


def context_vectors(df: DataFrame, text_col: str, most: int = 100_000, fan: int = 256) -> np.ndarray:
    """Context vectors of unit length (int8, 127 is one) learnt from all texts of ``df``. A task holds sums of about
    ``most`` rows of the table at a time; each of its pieces is summed in a tree, about ``fan`` parts at a time, as deep
    as the corpus needs; the driver gets the table."""
    size, names = ROWS // PIECES, ["k", "slot", "rows", "sums"]

    def emit(held):
        rows, sums = _added(np.concatenate([r for r, _ in held]), np.concatenate([v for _, v in held]))
        cut = np.searchsorted(rows, np.arange(PIECES + 1) * size)
        for k in np.flatnonzero(np.diff(cut)).tolist():
            a, e = cut[k], cut[k + 1]
            yield pa.RecordBatch.from_arrays(_piece(k, rows[a:e] - k * size, sums[a:e]), names=names)

    def run(batches):
        held, n = [], 0
        for b in slices(batches, "t"):
            held.append(contexts(words(b.column("t"))))
            n += held[-1][0].size
            if n > most:
                held = [_added(np.concatenate([r for r, _ in held]), np.concatenate([v for _, v in held]))]
                n = held[0][0].size
                if n > most // 2:
                    yield from emit(held)
                    held, n = [], 0
        if held:
            yield from emit(held)
        del held
        trim()

    def some(table: pa.Table) -> pa.Table:
        total = _total(table)
        rows = np.flatnonzero(total.any(1))
        out = pa.Table.from_arrays(_piece(table.column("k")[0].as_py(), rows, total[rows]), names=names)
        del total
        trim()
        return out

    def every(table: pa.Table) -> pa.Table:
        total = _total(table)
        length = np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
        out = pa.table({"k": [table.column("k")[0].as_py()], "v": pa.array([np.rint(127 * total / length).astype(np.int8).tobytes()], pa.binary())})
        del total, length
        trim()
        return out

    schema = "k long, slot long, rows binary, sums binary"
    texts = df.select(df[text_col].cast("string").alias("t"))
    sums = texts.mapInArrow(run, schema)
    # parts of a piece: about one for as much text as has ``most`` distinct words
    parts = (texts.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0) // (16 * most) + 1
    while parts > fan:
        parts = -(-parts // fan)
        sums = sums.groupBy("k", F.pmod("slot", F.lit(parts)).alias("s")).applyInArrow(some, schema)
    out = np.zeros((PIECES, size, DIM), np.int8)
    with shuffles_freed(df.sparkSession):
        for r in sums.groupBy("k").applyInArrow(every, "k long, v binary").collect():
            out[r["k"]] = np.frombuffer(bytes(r["v"]), np.int8).reshape(size, DIM)
    return out.reshape(ROWS, DIM)


def pooled(col, vectors: np.ndarray) -> np.ndarray:
    """A text's features: the mean context vector of its words, and the mean product, place by place, of neighbouring
    words' vectors (which tells how alike they are); zeros without words."""
    w = words(col)
    out = np.zeros((w.counts.size, FEATURES), np.float32)
    full = np.flatnonzero(w.counts)
    if full.size:
        own = vectors[row_of(w.hash)]
        out[full, :DIM] = np.add.reduceat(own, w.first[full], axis=0, dtype=np.int64) / (127 * w.counts[full, None])
        near = np.zeros(own.shape, np.int16)  # of each word with the one before it in its text
        near[1:] = own[1:] * own[:-1].astype(np.int16)
        near[w.first[full]] = 0
        out[full, DIM:] = np.add.reduceat(near, w.first[full], axis=0, dtype=np.int64) / (127**2 * np.maximum(w.counts[full, None] - 1, 1))
    return out


@dataclass
class QualityModel:
    """The network. Word vectors travel apart from it."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, col, vectors: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1 for each text."""
        z = self.logits(pooled(col, vectors)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> QualityModel:
    """Train with Adam on 4/5 of the rows, choose the temperature on the rest (all rows if there are under 20)."""
    n, rng = len(y), np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if n else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    p = [a.astype(np.float32) for a in p]
    rate = (y.sum() + 0.5) / (n + 1) if n else 0.5
    p[3][0] = np.log(rate / (1 - rate))
    order = rng.permutation(n)
    held = order[: n // 5] if n >= 20 else order
    train = order[n // 5 :] if n >= 20 else order
    z = ((x - mean) / scale).astype(np.float32)
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    if not 0 < y.sum() < n:  # nothing to tell apart: the prior alone
        p[2][:] = 0
        epochs = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]).astype(np.float32) / len(rows)
            dh = d[:, None] * p[2] * (1 - h * h)
            t += 1
            for i, g in enumerate((z[rows].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    model = QualityModel(mean, scale, *p[:3], float(p[3][0]), 1.0)
    if len(held):
        z = model.logits(x[held])
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(y[held] > 0, -z, z) / g).mean() for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


class Quality:
    """Word vectors (a broadcast of 32 MB, whatever the input) and the network that goes with them."""

    def __init__(self, vectors, model: QualityModel):
        self.vectors, self.model = vectors, model

    def score(self, col) -> np.ndarray:
        return self.model.score(col, self.vectors.value)

    def release(self) -> None:
        self.vectors.unpersist()


def train_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 5, held_out: int = 0, max_train: int = 20_000) -> Quality:
    """Word vectors from all texts; network from ``max_train`` labelled rows at most, by hash of the id.

    Rows whose crc32 of the id as text is ``held_out`` modulo ``fold`` are never learnt from (``fold`` 0: all are
    learnt from). Null labels and ids are passed over; of several labels of an id the smallest counts, of several
    texts of an id one; null and empty texts have a vector of zeros; texts of any length are read whole; with no or
    one label class the score is the prior; an empty table gives that, too. The driver gets the table of vectors, the
    sample of ids and a row of features for each of them.
    """
    vectors = df.sparkSession.sparkContext.broadcast(context_vectors(df, text_col))
    own = labels.select(labels[id_col].alias("i"), labels[label_col].cast("int").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.min("y").alias("y"))
    if fold:
        own = own.where(F.crc32(F.col("i").cast("string")) % fold != held_out)
    sample = own.orderBy(F.xxhash64("i"), "i").limit(max_train)
    rows = df.select(df[id_col].alias("j"), df[text_col].cast("string").alias("t")).join(F.broadcast(sample), F.col("i") == F.col("j"))

    def run(batches):
        for b in slices(batches, "t"):
            x = pooled(b.column("t"), vectors.value)
            yield pa.RecordBatch.from_arrays([b.column("j"), b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["i", "y", "x"])

    got = rows.select("j", "y", "t").mapInArrow(run, f"i {dict(df.dtypes)[id_col]}, y int, x binary")
    got = got.groupBy("i", "y").agg(F.min("x").alias("x")).toArrow().to_pylist()
    got.sort(key=lambda r: (r["i"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float32).reshape(len(got), FEATURES)
    return Quality(vectors, fit_network(x, np.array([r["y"] == 1 for r in got], np.float32)))


def score_quality(df: DataFrame, quality: Quality, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, fold: int = 5, held_out: int = 0) -> DataFrame:
    """One row per row of ``df``: id, held_out, score, predicted.

    Null and empty texts get the score of no words; repeated rows score alike; an empty table gives an empty table;
    labels and other columns never enter the score.
    """
    def run(batches):
        for b in slices(batches, "t"):
            s = quality.score(b.column("t"))
            out = crc_rows(b.column("i")) % fold == held_out if fold else np.zeros(len(s), bool)
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(out), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return df.select(df[id_col].alias("i"), df[text_col].cast("string").alias("t")).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, held_out boolean, score double, predicted int")


def keep_quality(df: DataFrame, quality: Quality, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` that the model does not reject, with all their columns, in one narrow pass.

    Only texts go to Python. Null and empty texts are judged as texts without words; repeated rows alike; an empty
    table stays empty; columns of any name pass through.
    """
    keep = F.arrow_udf(by_slice(lambda t: pa.array(quality.score(t) >= threshold), pa.bool_()), "boolean")
    return df.where(keep(df[text_col].cast("string")))
