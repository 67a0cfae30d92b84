"""Mixing sources to target weights: token counts raked to source, language and topic marginals, then sampling."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .shared import discard, fresh_name, materialize
from .textkit import by_slice, slices, words
from .textkit import mix as mixed

AXES = ("source", "lang", "topic")
DIM = 32  # of texts' vectors
EVERY = 5  # sweeps between looks at whether they still change anything


@dataclass(frozen=True)
class Mix:
    """``power``: an axis's target shares are its shares in the input to this power (1: as they are, 0: uniform);
    ``targets`` gives shares by value instead. ``keep``: share of all tokens to expect in the sample."""

    keep: float = 0.5
    power: dict[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.7, "topic": 0.5})
    targets: dict[str, dict] = field(default_factory=dict)
    topics: int = 8  # clusters of texts, 32 at most
    rounds: int = 5  # of clustering
    sweeps: int = 200
    tolerance: float = 1e-9
    seed: int = 8
    max_cells: int = 100_000  # more cells than this are raked by Spark instead of the driver


def text_vectors(col) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the direction (int8, 127 is one) of the sum of its words' signs, words of five bytes or more, each
    with 32 signs from its hash (zeros without such words); and its number of words."""
    w = words(col)
    long = np.flatnonzero(w.ends - w.starts >= 5)
    signs = 1 - 2 * np.unpackbits(mixed(w.hash[long] ^ np.uint64(1 << 59)).view(np.uint8).reshape(-1, 8)[:, : DIM // 8], axis=1).astype(np.int8)
    out, doc = np.zeros((w.counts.size, DIM)), w.doc[long]
    if doc.size:
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[cut]] = np.add.reduceat(signs, cut, axis=0, dtype=np.int64)
    length = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return np.rint(127 * out / length).astype(np.int8), w.counts


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre most like each vector (the first of ties; 0 for zeros)."""
    return (vectors.astype(np.float64) @ centres.T).argmax(1).astype(np.int32)


def _unpacked(b) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("vector").to_pylist()), np.int8).reshape(-1, DIM)


def topic_centres(tagged: DataFrame, mix: Mix) -> np.ndarray:
    """Spherical k-means over all rows' ``vector``: ``rounds`` passes over a narrow table. A task sends the whole-number
    sums of each cluster, so the result is the same for any partitions. The first clusters are by the largest of the
    first places."""
    centres = np.eye(mix.topics, DIM)
    for _ in range(mix.rounds):
        def sums(batches, centres=centres):
            total = np.zeros((mix.topics, DIM), np.int64)
            for b in batches:
                v = _unpacked(b)
                np.add.at(total, nearest(v, centres), v.astype(np.int64))
            at = np.arange(mix.topics * DIM)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "total"])

        rows = tagged.select("vector").mapInArrow(sums, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()
        total = np.zeros(mix.topics * DIM)
        for r in rows:
            total[r["at"]] = r["total"]
        total = total.reshape(mix.topics, DIM)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 0, total / np.maximum(length, 1e-9), centres)
    return centres


def targets_of(shares: dict, axis: str, mix: Mix) -> dict:
    given = mix.targets.get(axis)
    raw = {k: given.get(k, 0.0) if given else v ** mix.power.get(axis, 1.0) if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raw.values())
    return {k: v / total if total else 0.0 for k, v in raw.items()}


def rake(cells: list[tuple], tokens: np.ndarray, mix: Mix) -> np.ndarray:
    """Expected tokens to keep of each cell (source, lang, topic): iterative proportional fitting of ``tokens`` to
    the target marginals, no cell above what it has. Cells that no sample can fill pass their share to the rest."""
    total = float(tokens.sum())
    x = tokens * mix.keep
    axes = []
    for j, axis in enumerate(AXES):
        values = sorted({c[j] for c in cells}, key=lambda v: (v is None, str(v)))
        number = {v: i for i, v in enumerate(values)}
        code = np.array([number[c[j]] for c in cells], int)
        have = np.bincount(code, tokens, len(values))
        share = targets_of({v: h / total for v, h in zip(values, have)}, axis, mix) if total else {}
        axes.append((code, np.array([share.get(v, 0.0) for v in values]) * total * mix.keep))
    for sweep in range(mix.sweeps):
        before = x
        for code, want in axes:
            now = np.bincount(code, x, want.size)
            x = x * np.divide(want, now, out=np.zeros(want.size), where=now > 0)[code]
        x = np.minimum(x, tokens)
        if sweep % EVERY == EVERY - 1 and np.abs(x - before).max(initial=0) <= mix.tolerance * max(total, 1):
            break
    return x


def rake_by_spark(cells: DataFrame, mix: Mix) -> DataFrame:
    """The same sweeps over a table ``source, lang, topic, tokens`` of any size, written to the shared folder after each."""
    first = None
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cells = cells.withColumn("x", F.col("tokens") * F.lit(mix.keep))
    wants = []
    for axis in AXES:
        have = cells.groupBy(axis).agg((F.sum("tokens") / F.lit(float(max(total, 1)))).alias("share"))
        given = mix.targets.get(axis)
        if given:
            raw = F.lit(0.0)
            for k, v in given.items():
                raw = F.when(F.col(axis).eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(raw)
            have = have.withColumn("raw", raw)
        else:
            have = have.withColumn("raw", F.when(F.col("share") > 0, F.pow("share", F.lit(mix.power.get(axis, 1.0)))).otherwise(0.0))
        scale = have.agg(F.sum("raw")).first()[0] or 0
        wants.append(materialize(have.select(F.col(axis).alias("key"), (F.col("raw") / F.lit(scale or 1.0) * F.lit(total * mix.keep)).alias("want")), "mix-want"))
    for sweep in range(mix.sweeps):
        cells = cells.withColumn("old", F.col("x"))
        for axis, want in zip(AXES, wants):
            now = cells.groupBy(F.col(axis).alias("key2")).agg(F.sum("x").alias("now"))
            scale = want.join(now, F.col("key").eqNullSafe(F.col("key2"))).select("key", F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(0.0).alias("scale"))
            cells = cells.join(scale, F.col(axis).eqNullSafe(F.col("key")), "left").withColumn("x", F.col("x") * F.col("scale")).drop("key", "scale")
        cells = cells.withColumn("x", F.least("x", "tokens"))
        cells = materialize(cells, "mix-cells")
        if first is not None:
            discard(first)
        first = cells
        if sweep % EVERY == EVERY - 1 and (cells.agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0] or 0) <= mix.tolerance * max(total, 1):
            break
    return cells.select(*AXES, "tokens", "x")


def _tagged(df: DataFrame, text_col: str, mix: Mix) -> DataFrame:
    """``df`` without the text, but with ``mix_tokens`` and ``vector``."""
    keep = [c for c in df.columns if c != text_col]

    def run(batches):
        for b in slices(batches, text_col):
            v, n = text_vectors(b.column(text_col))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n.astype(np.int64)), pa.array([x.tobytes() for x in v], pa.binary())], names=[*keep, "mix_tokens", "vector"])

    return df.mapInArrow(run, StructType([*(f for f in df.schema.fields if f.name != text_col), StructField("mix_tokens", LongType()), StructField("vector", BinaryType())]))


def _with_topics(tagged: DataFrame, centres: np.ndarray) -> DataFrame:
    """``mix_topic`` in place of ``vector``."""
    topic = F.arrow_udf(lambda v: pa.array(nearest(np.frombuffer(b"".join(v.to_pylist()), np.int8).reshape(-1, DIM), centres)), "int")
    return tagged.withColumn("mix_topic", topic("vector")).drop("vector")


def cell_weights(cells: DataFrame, mix: Mix) -> tuple[DataFrame, bool]:
    """(``source, lang, topic, weight, probability`` by cell, whether that is small). weight: kept over own share."""
    cells = materialize(cells, "mix-cells")
    small = cells.count() <= mix.max_cells
    if small:
        rows = sorted(cells.collect(), key=str)
        tokens = np.array([r["tokens"] for r in rows], float)
        x = rake([tuple(r[a] for a in AXES) for r in rows], tokens, mix)
        p = np.divide(x, tokens, out=np.zeros(x.size), where=tokens > 0).clip(0, 1)
        schema = ", ".join(f"{a} {dict(cells.dtypes)[a]}" for a in AXES)
        table = cells.sparkSession.createDataFrame([(*(r[a] for a in AXES), float(v)) for r, v in zip(rows, p)], f"{schema}, probability double")
    else:
        table = rake_by_spark(cells, mix).select(*AXES, F.when(F.col("tokens") > 0, F.least(F.col("x") / F.col("tokens"), F.lit(1.0))).otherwise(0.0).alias("probability"))
    return table.withColumn("weight", F.col("probability") / F.lit(mix.keep)), small


def _with_probability(tagged: DataFrame, weights: DataFrame, small: bool, source, lang, topic, names: list[str]) -> DataFrame:
    """Add weight and probability of each row's cell under ``names``."""
    keys = [fresh_name(tagged, f"mix_key_{a}") for a in AXES]
    w = weights.select(*(F.col(a).alias(k) for a, k in zip(AXES, keys)), *(F.col(c).alias(n) for c, n in zip(("weight", "probability"), names)))
    w = F.broadcast(w) if small else w  # at most Mix.max_cells rows
    on = source.eqNullSafe(F.col(keys[0])) & lang.eqNullSafe(F.col(keys[1])) & (topic == F.col(keys[2]))
    return tagged.join(w, on, "left").drop(*keys)


def _chosen(id_column, probability, mix: Mix):
    """A uniform number from the id's hash, below the probability; the same on every run."""
    u = (F.pmod(F.xxhash64(id_column, F.lit(mix.seed)), F.lit(1 << 53)) / F.lit(float(1 << 53)))
    return F.coalesce(u < probability, F.lit(False))


def _prepared(df: DataFrame, columns: list, text_col: str, mix: Mix) -> tuple[DataFrame, np.ndarray, DataFrame, bool]:
    """(table of ``columns`` with source, lang, tokens and topic, centres, cell weights, whether these are few)."""
    tagged = materialize(_tagged(df.select(*columns, df[text_col].cast("string").alias("mix_text")), "mix_text", mix), "mix-documents")
    centres = topic_centres(tagged, mix)
    tagged = _with_topics(tagged, centres)
    cells = tagged.groupBy("source", "lang", F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens"))
    return tagged, centres, *cell_weights(cells, mix)


def plan_mix(df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``df``: id, source, lang, topic, n_tokens, weight, probability, selected.

    Null source and language are values of their own; null and empty texts have topic 0 and no tokens, and follow
    their cell; a cell without tokens has probability 0; rows with one id share a draw; an empty table gives an
    empty table; texts of any length are read whole; other columns are ignored.
    """
    own = [df[id_col].alias("mix_id"), df[source_col].alias("source"), df[lang_col].alias("lang")]
    tagged, _, weights, small = _prepared(df, own, text_col, mix)
    out = _with_probability(tagged, weights, small, F.col("source"), F.col("lang"), F.col("mix_topic"), ["weight", "probability"])
    return out.select(F.col("mix_id").alias(id_col), "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), "weight", "probability", _chosen(F.col("mix_id"), F.col("probability"), mix).alias("selected"))


def sample_mix(df: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The sampled rows of ``df`` with all their columns: those that ``plan_mix`` selects.

    Only texts go to Python. Nulls, ties, repeated rows, empty tables and long texts are as there; columns of any
    name pass through.
    """
    tagged, centres, weights, small = _prepared(df, [df[source_col].alias("source"), df[lang_col].alias("lang")], text_col, mix)
    names = []
    for name in ("mix_topic", "mix_weight", "mix_probability"):
        names.append(fresh_name(df, name))
    topic = F.arrow_udf(by_slice(lambda t: pa.array(nearest(text_vectors(t)[0], centres)), pa.int32()), "int")
    rows = df.withColumn(names[0], topic(df[text_col].cast("string")))
    out = _with_probability(rows, weights, small, rows[source_col], rows[lang_col], rows[names[0]], names[1:])
    return out.where(_chosen(F.col(id_col), F.col(names[2]), mix)).select(*df.columns)
