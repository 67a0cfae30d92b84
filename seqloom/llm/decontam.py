"""Benchmark decontamination: BM25 over test items with block-max pruning, then question and answer overlap."""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shared
from .textkit import NON_ALNUM, by_slice, ngrams, slices, words


@dataclass(frozen=True)
class Settings:
    """``threshold``: share of a segment's own BM25 score that a passage must reach. ``overlap``: share of a
    part's ``gram``-word runs that must stand round the retrieved passages, for the question and the answer alike."""

    threshold: float = 0.5
    overlap: float = 0.5
    gram: int = 3
    segment: int = 48  # words of an indexed piece of an item; passages are twice as long, half overlapping
    block: int = 16  # segments whose impacts share one maximum
    k1: float = 1.2
    b: float = 0.75
    max_items: int = 4096  # an index of more is built and searched in blocks of items
    max_chars: int = 8 << 20


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the last sentence answers if it has three words and leaves half the text, else the last third of the words does."""
    cut = [m.end() for m in re.finditer(r"[.!?:]\s+", text)]
    for c in reversed(cut):
        tail = text[c:].split()
        if len(tail) >= 3:
            if 2 * c >= len(text):
                return text[:c], text[c:]
            break
    w = text.split()
    at = len(w) - max(1, len(w) // 3)
    return " ".join(w[:at]), " ".join(w[at:])


def _cuts(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if ids.size else np.zeros(0, np.int64)


def segments(w, n: int, s: Settings) -> tuple[list, list]:
    """(word hashes, item) of runs of words of ``n`` whole items, each given as a question and an answer."""
    seg, seg_item = [], []
    for i in range(n):
        h = w.hash[w.first[2 * i] : w.first[2 * i + 2]]
        for a in range(0, h.size, s.segment):
            piece = h[a : a + s.segment]
            if a and piece.size < s.segment // 2:  # a short rest joins the piece before, from its end
                piece = h[max(0, h.size - s.segment) :]
            seg.append(piece)
            seg_item.append(i)
    return seg, seg_item


@dataclass
class Statistics:
    """Of the segments of all items: their number, mean length, and how many have each term (sorted hashes)."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    def of(self, vocab: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, vocab)]


class Index:
    """Inverted index of item segments with impacts scaled to each segment's own score. ``stats``: of all items, where
    this is one block of them."""

    def __init__(self, ids: list, texts: list[str], s: Settings, stats: Statistics | None = None):
        self.s, self.ids = s, ids
        parts = [split_item(t or "") for t in texts]
        w = words(pa.array([p for pair in parts for p in pair], pa.string()), lower=True, sep=NON_ALNUM)
        self.grams = []
        for i in range(2 * len(ids)):
            h = w.hash[w.first[i] : w.first[i + 1]]
            k = min(s.gram, h.size)
            self.grams.append(np.unique(ngrams(h, np.array([0, h.size]), k)[0]) if k else np.zeros(0, np.uint64))
        self.part_words = w.counts
        seg, seg_item = segments(w, len(ids), s)
        self.seg_item, n = np.array(seg_item, np.int64), len(seg)
        length = np.array([p.size for p in seg], float)
        flat, owner = (np.concatenate(seg), np.repeat(np.arange(n), length.astype(int))) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.vocab, term = np.unique(flat, return_inverse=True)
        key, tf = np.unique(term * max(n, 1) + owner, return_counts=True)
        self.post_term, self.post_seg = key // max(n, 1), key % max(n, 1)
        if stats is None:
            stats = Statistics(n, length.mean() if n else 1, self.vocab, np.bincount(self.post_term, minlength=self.vocab.size))
        df = stats.of(self.vocab)
        idf = np.log(1 + (stats.n - df + 0.5) / (df + 0.5))
        norm = s.k1 * (1 - s.b + s.b * length / max(stats.mean, 1e-9))
        weight = idf[self.post_term] * tf * (s.k1 + 1) / (tf + norm[self.post_seg])
        own = np.bincount(self.post_seg, weight, n)
        self.weight = (weight / own[self.post_seg]).astype(np.float32) if n else weight
        # postings come by term and segment, so by term and block: runs of them with their maxima
        block = self.post_seg // s.block
        cut = _cuts(self.post_term * (n // s.block + 1) + block)
        self.run_block, self.run_start = block[cut], np.append(cut, self.post_seg.size)
        self.run_max = np.maximum.reduceat(self.weight, cut) if cut.size else np.zeros(0, np.float32)
        self.first = np.searchsorted(self.post_term[cut], np.arange(self.vocab.size + 1))
        self.top = np.maximum.reduceat(self.run_max, self.first[:-1]) if cut.size else np.zeros(self.vocab.size, np.float32)
        self.n_blocks = -(-n // s.block)

    def matches(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(segments from the threshold on, their scaled BM25, postings read) for a set of distinct terms: blocks whose
        maxima cannot reach the threshold are skipped, and only postings in the others are read."""
        least = self.s.threshold - 1e-6
        runs = _ranges(self.first[terms], self.first[terms + 1])
        live = np.bincount(self.run_block[runs], self.run_max[runs], self.n_blocks) >= least
        if not live.any():
            return np.zeros(0, np.int64), np.zeros(0), 0
        runs = runs[live[self.run_block[runs]]]
        at = _ranges(self.run_start[runs], self.run_start[runs + 1])
        seg, number = np.unique(self.post_seg[at], return_inverse=True)
        score = np.bincount(number, self.weight[at], seg.size)
        good = score >= least
        return seg[good], score[good], at.size

    def search(self, col) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of each item that some passage retrieves; overlaps are
        the best of a stretch of retrieved passages with an item's length of words round it."""
        s, found = self.s, {}
        if not self.vocab.size:
            return []
        w = words(col, lower=True, sep=NON_ALNUM)
        doc = w.doc
        at = np.minimum(np.searchsorted(self.vocab, w.hash), self.vocab.size - 1)
        hit = np.flatnonzero(self.vocab[at] == w.hash)
        halves = -(-w.counts // s.segment)
        base = np.concatenate([[0], np.cumsum(halves)])
        half = base[doc[hit]] + (hit - w.first[doc[hit]]) // s.segment
        key = np.unique(half * self.vocab.size + at[hit])
        half, term = key // self.vocab.size, key % self.vocab.size
        total = np.bincount(half, self.top[term], base[-1] + 1)
        owner = np.repeat(np.arange(w.counts.size), halves)
        nxt = np.zeros(base[-1], bool)
        nxt[:-1] = owner[1:] == owner[:-1]
        # terms' maxima first (WAND), then block maxima, then postings
        likely = np.flatnonzero(total[:-1] + np.where(nxt, total[1:], 0) >= s.threshold - 1e-6)
        start = np.searchsorted(half, np.arange(base[-1] + 1))
        for p in likely:
            for g, score in zip(*self.matches(np.unique(term[start[p] : start[p + 1 + nxt[p]]]))[:2]):
                best = found.setdefault((int(owner[p]), int(self.seg_item[g])), [0.0, []])
                best[0] = max(best[0], float(score))
                best[1].append(int(p - base[owner[p]]) * s.segment)
        out, grams = [], {}
        for (d, i), (score, passages) in sorted(found.items()):
            own, h = slice(2 * i, 2 * i + 2), w.hash[w.first[d] : w.first[d + 1]]
            length = int(self.part_words[own].sum())
            share = []
            for a, e in _stretches(sorted(set(passages)), 2 * s.segment, length, h.size):
                part = []
                for n, want in zip(self.part_words[own], self.grams[own]):
                    k = max(1, min(s.gram, int(n)))
                    if (d, k) not in grams:
                        grams[d, k] = ngrams(h, np.array([0, h.size]), k)[0]
                    part.append(float(np.isin(want, grams[d, k][a : max(a, e - k + 1)]).mean()) if want.size else 1.0)
                share.append(part)
            out.append((d, i, score, *max(share, key=lambda x: (min(x), sum(x)))))
        return out


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, end to end."""
    size = end - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _stretches(starts: list[int], width: int, margin: int, n: int) -> list[tuple[int, int]]:
    """Word ranges from ``margin`` before each start to ``margin`` behind its passage, joined where they meet."""
    out = []
    for a in starts:
        a, e = max(0, a - margin), min(n, a + width + margin)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def count_segments(rows: DataFrame, s: Settings) -> Statistics:
    """Counted by Spark; the driver gets one row a distinct term of the items."""
    def run(batches):
        for b in slices(batches, "t"):
            w = words(pa.array([p for t in b.column("t").to_pylist() for p in split_item(t or "")], pa.string()), lower=True, sep=NON_ALNUM)
            seg, _ = segments(w, b.num_rows, s)
            term, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(p) for p in seg)]), return_counts=True)
            sums = [len(seg), sum(p.size for p in seg)]
            kind, value = np.repeat([0, 1, 2], [term.size, 1, 1]), np.concatenate([df, sums])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(np.concatenate([term.view(np.int64), [0, 0]])), pa.array(value, pa.int64())], names=["kind", "term", "n"])

    got = rows.select("t").mapInArrow(run, "kind int, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).toArrow()
    kind, term, n = (got.column(c).to_numpy() for c in ("kind", "term", "n"))
    count, size = int(n[kind == 1].sum()), int(n[kind == 2].sum())
    own = np.ascontiguousarray(term[kind == 0]).view(np.uint64)
    order = np.argsort(own)
    return Statistics(count, size / max(count, 1), own[order], n[kind == 0][order])


def build_indexes(items: DataFrame, s: Settings, id_col: str, text_col: str) -> list[Index]:
    """One index for each block of items, of a bounded number of items and characters each; scores are those of a
    single index, as all blocks have the statistics of all items."""
    rows = items.select(items[id_col].alias("i"), F.coalesce(items[text_col].cast("string"), F.lit("")).alias("t"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // s.max_items), -(-chars // s.max_chars))
    out, stats = [], count_segments(rows, s) if blocks > 1 else None
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else rows
        got = sorted(((r["i"], r["t"]) for r in own.collect()), key=str)
        out.append(Index([r[0] for r in got], [r[1] for r in got], s, stats))
    return out


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(text id, item id, score, question_overlap, answer_overlap, leaked) for every item that a text retrieves.

    All passages of whole texts are queries. Null and empty texts and items match nothing; ties all count; repeated
    texts and items match each for themselves; an empty table gives an empty table; other columns are ignored.
    BM25 statistics are those of all items.
    """
    rows = df.select(df[id_col].alias("i"), df[text_col].cast("string").alias("t"))
    kinds = dict(df.dtypes)[id_col], dict(items.dtypes)[item_id_col]
    names = [id_col, item_id_col if item_id_col != id_col else "item_" + item_id_col, "score", "question_overlap", "answer_overlap", "leaked"]

    def searched(index):
        shared = Shared(df.sparkSession, index)  # bounded by Settings.max_items and max_chars

        def run(batches):
            item_type = pa.infer_type(shared.value.ids) if shared.value.ids else pa.int64()
            for b in slices(batches, "t"):
                got = shared.value.search(b.column("t"))
                own = np.array([g[0] for g in got], np.int64)
                cols = [pa.array([g[k] for g in got], pa.float64()) for k in (2, 3, 4)]
                leaked = pa.array([min(g[3:]) >= settings.overlap for g in got], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(own)), pa.array([shared.value.ids[g[1]] for g in got], item_type), *cols, leaked], names=names)

        return rows.mapInArrow(run, f"{names[0]} {kinds[0]}, {names[1]} {kinds[1]}, score double, question_overlap double, answer_overlap double, leaked boolean")

    return reduce(DataFrame.unionAll, [searched(i) for i in build_indexes(items, settings, item_id_col, item_text_col)])


def drop_leaks(df: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``df`` in which no item leaks, with all their columns, in one narrow pass a block of items.

    Only texts go to Python. Null and empty texts stay, as do all rows where there are no items; ties and repeated rows
    are judged alike; an empty table stays empty; columns of any name pass through.
    """
    def keep(index: Shared):
        def work(t: pa.Array) -> pa.Array:
            out = np.ones(len(t), bool)
            out[[g[0] for g in index.value.search(t) if min(g[3:]) >= settings.overlap]] = False
            return pa.array(out)

        return F.arrow_udf(by_slice(work, pa.bool_()), "boolean")(df[text_col].cast("string"))

    for index in build_indexes(items, settings, item_id_col, item_text_col):
        df = df.where(keep(Shared(df.sparkSession, index)))
    return df
