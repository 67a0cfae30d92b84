"""URL filters: host and path rules, and boosted trees on lexical features where no rule fits."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textkit import slices, strings

FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "entropy", "n_params", "has_fragment", "hyphens", "last_label_rate", "last_two_rate")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # fits the host and its subdomains
    path: str  # the path starts with it

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for text without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda g: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", g)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def apply_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def suffixes(host: Column) -> tuple[Column, Column]:
    """(last label, last two labels)."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def smoothed(blocked, n, prior: float):
    """Share of blocked urls, with five more at the prior; the prior where there are none."""
    return (blocked + 5 * prior) / (n + 5)


def features(url, host, path, rates: np.ndarray) -> np.ndarray:
    """A row of FEATURES per url (Arrow string columns; ``rates`` are the last two)."""
    data, off = strings(url)
    n, size = off.size - 1, np.diff(off)
    row = np.repeat(np.arange(n), size)

    def count(mask):
        return np.bincount(row[mask], minlength=n)

    freq = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
    entropy = -(freq * np.log2(np.where(freq > 0, freq, 1))).sum(1)
    pdata, poff = strings(path)
    hdata, hoff = strings(host)
    depth = np.bincount(np.repeat(np.arange(n), np.diff(poff))[pdata == 47], minlength=n)
    labels = np.bincount(np.repeat(np.arange(n), np.diff(hoff))[hdata == 46], minlength=n) + 1
    params = count(data == 38) + count(data == 61)
    return np.column_stack([size, np.diff(hoff), np.diff(poff), depth, labels, count((data >= 48) & (data <= 57)) / np.maximum(size, 1), entropy, params, count(data == 35) > 0, count(data == 45), rates]).astype(float)


class BoostedTrees:
    """Gradient-boosted regression trees for a logistic loss, on quantile bins, in numpy."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges, self.forest, self.base = [], [], 0.0

    def _binned(self, x):
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(rate / (1 - rate)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        b, f = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.trees if 0 < y.sum() < len(y) else 0):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            tree = self._grow(b, g, h, np.arange(len(y)), self.depth)
            self.forest.append(tree)
            f += self._walk(tree, b)
        return self

    def best_split(self, b, g, h, rows):
        """(gain, feature, bin): the first of the best splits ``bin <= x``."""
        best = (1e-9, -1, -1)
        tg, th = g[rows].sum(), h[rows].sum()
        for j in range(b.shape[1]):
            k = len(self.edges[j]) + 1
            gl = np.cumsum(np.bincount(b[rows, j], g[rows], k))[:-1]
            hl = np.cumsum(np.bincount(b[rows, j], h[rows], k))[:-1]
            gain = gl**2 / (hl + self.least) + (tg - gl) ** 2 / (th - hl + self.least) - tg**2 / (th + self.least)
            if gain.size and gain.max() > best[0] + 1e-12:
                best = (float(gain.max()), j, int(gain.argmax()))
        return best

    def _grow(self, b, g, h, rows, depth):
        gain, j, cut = self.best_split(b, g, h, rows) if depth else (0, -1, -1)
        if j < 0:
            return float(self.rate * g[rows].sum() / (h[rows].sum() + self.least))
        left = b[rows, j] <= cut
        return (j, cut, self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1))

    def _walk(self, node, b):
        if not isinstance(node, tuple):
            return np.full(len(b), node)
        j, cut, left, right = node
        return np.where(b[:, j] <= cut, self._walk(left, b), self._walk(right, b)) if len(b) else np.zeros(0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.base)
        for tree in self.forest:
            f += self._walk(tree, b)
        return 1 / (1 + np.exp(-f))


_COUNTS = ("k1", "n1", "k2", "n2")


def _rates(b, prior: float, own=None) -> np.ndarray:
    """Rates of the last label and of the last two from their counts; without counts of two, that of one. ``own``:
    labels of the urls themselves, to be left out."""
    k1, n1, k2, n2 = (np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in _COUNTS)
    if own is not None:
        k1, n1, k2, n2 = k1 - own, n1 - 1, k2 - own, n2 - 1
        return np.column_stack([smoothed(k1, n1, prior), smoothed(k2, n2, prior)])
    one = smoothed(k1, n1, prior)
    return np.column_stack([one, np.where(n2 > 0, smoothed(k2, n2, prior), one)])


@dataclass
class UrlModel:
    trees: BoostedTrees
    prior: float

    def blocked(self, b) -> np.ndarray:
        """Probability for each row of a batch with ``url, host, path`` and the counts of its suffixes."""
        return self.trees.predict(features(b.column("url"), b.column("host"), b.column("path"), _rates(b, self.prior)))


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """``suffix, blocked, n`` over all distinct labelled urls (``host, block``); any number of suffixes."""
    one, two = suffixes(F.col("host"))
    rows = labelled.select(F.explode(F.array_distinct(F.array(one, two))).alias("suffix"), "block")
    return rows.groupBy("suffix").agg(F.sum("block").alias("blocked"), F.count("*").alias("n"))


def with_counts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Add the counts of both suffixes of ``host`` (null: none)."""
    for k, suffix in enumerate(suffixes(F.col("host")), 1):
        own = counts.select(F.col("suffix").alias(f"s{k}"), F.col("blocked").alias(f"k{k}"), F.col("n").alias(f"n{k}"))
        rows = rows.join(own, suffix == F.col(f"s{k}"), "left").drop(f"s{k}")
    return rows


def train_url_model(labelled: DataFrame, counts: DataFrame, max_rows: int = 20_000) -> UrlModel:
    """Fit on distinct ``url, host, path, block`` rows: a sample of ``max_rows`` urls at most, by hash of the url.

    Suffix rates are those of all labelled urls, without the url itself, so that a suffix seen once says nothing of
    itself; the prior is that of all labelled urls, too.
    """
    total = labelled.agg(F.sum("block").alias("k"), F.count("*").alias("n")).first()
    prior = float(((total["k"] or 0) + 0.5) / (total["n"] + 1))
    rows = with_counts(labelled.orderBy(F.xxhash64("url"), "url").limit(max_rows), counts).orderBy("url").toArrow()
    y = rows.column("block").to_numpy().astype(float)
    x = features(rows.column("url"), rows.column("host"), rows.column("path"), _rates(rows.combine_chunks().to_batches()[0], prior, y)) if y.size else np.zeros((0, len(FEATURES)))
    return UrlModel(BoostedTrees().fit(x, y), prior)


def judge_urls(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, max_rows: int = 20_000) -> DataFrame:
    """One row per row of ``df``: id, host, path, rule, verdict, block_probability.

    A rule's verdict stands; elsewhere the trees, trained on the distinct urls that rules label, block from
    ``threshold`` on. Without labelled urls the prior decides (allow). Null and empty urls have empty host and path;
    very long ones are read whole; repeated rows get the same verdict and count once in training; an empty table
    gives an empty table; other columns are ignored.
    """
    host, path = split_url(df[url_col])
    rows = df.select(df[id_col].alias("id"), F.coalesce(df[url_col].cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    labelled = rows.where("verdict is not null").groupBy("url", "host", "path").agg(F.max((F.col("verdict") == "block").cast("int")).alias("block"))
    labelled = materialize(labelled, "url-labelled")
    counts = materialize(suffix_counts(labelled), "url-suffixes")
    model = train_url_model(labelled, counts, max_rows)

    def run(batches):
        for b in slices(batches, "url"):
            p = model.blocked(b)
            by_model = np.where(p >= threshold, "block", "allow").tolist()
            verdict = [v or m for v, m in zip(b.column("verdict").to_pylist(), by_model)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("host"), b.column("path"), b.column("rule"), pa.array(verdict, pa.string()), pa.array(p)], names=names)

    names = [id_col, "host", "path", "rule", "verdict", "block_probability"]
    return with_counts(rows, counts).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, host string, path string, rule string, verdict string, block_probability double")
