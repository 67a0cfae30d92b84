"""Quality rules: characters covered by repeated n-grams and lines (rolling hashes in numpy)."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SPACE, by_slice, mix, slices, span_hash, spans, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Largest allowed shares; published thresholds for web text.

    ``duplicate``: n -> share of word characters inside n-word windows that repeat an earlier one.
    ``lines``: share of characters in lines equal to an earlier one. ``symbols``: symbols per word.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    duplicate: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    lines: float = 0.20
    symbols: float = 0.10


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _again(key: np.ndarray) -> np.ndarray:
    """Mask of the entries that equal an earlier one."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(key.size, bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def _cover(size: int, starts: np.ndarray, k: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return np.cumsum(edge[:-1]) > 0


def _twice(key: np.ndarray) -> np.ndarray:
    """Mask of the entries that occur at least twice."""
    if key.size < 2:
        return np.zeros(key.size, bool)
    s = np.sort(key)
    dup = s[1:][s[1:] == s[:-1]]
    if not dup.size:
        return np.zeros(key.size, bool)
    at = np.searchsorted(dup, key)
    return dup[np.minimum(at, dup.size - 1)] == key


def measure(col, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Counts and shares for each text of a string column."""
    w = words(col)
    n = w.off.size - 1
    doc, nw = w.doc, w.counts
    lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    chars = lead[w.ends] - lead[w.starts]
    word_chars = np.bincount(doc, chars, n).astype(np.int64)
    sym = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
    out = {"n_words": nw, "word_chars": word_chars, "n_symbols": sym[w.off[1:]] - sym[w.off[:-1]]}

    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(77))[doc]
    # A window can only repeat if every shorter window in it repeats, so candidates shrink with n.
    cand = np.arange(doc.size)
    ratio = {}
    for k in sorted({3, *rules.duplicate}):
        cand = cand[cand + k - 1 < doc.size]
        cand = cand[doc[cand] == doc[cand + k - 1]]
        g = np.zeros(cand.size, np.uint64)
        for i in range(k):
            g = g * np.uint64(0x9E3779B97F4A7C15) + w.hash[cand + i]
        key = mix(g) ^ salt[cand]
        twice = _twice(key)
        cand, key = cand[twice], key[twice]
        if k == 3:
            cover = _cover(doc.size, cand, k)
            out["n_repeat_words"] = np.bincount(doc[cover], minlength=n)
        if k in rules.duplicate:
            cover = _cover(doc.size, cand[_again(key)], k)
            ratio[k] = np.bincount(doc[cover], chars[cover], n)
    # lines: \n-split, with a word, equal to an earlier line of the same text
    line, st, starts, ends = spans(w.data, w.off, np.arange(256) == 10)
    held = np.concatenate([[0], np.cumsum(~SPACE[w.data])])
    full = held[ends] > held[starts]
    h = span_hash(w.data, line, st, starts, ends)[full]
    ldoc = (np.searchsorted(w.off, starts, "right") - 1)[full]
    lchars = (lead[ends] - lead[starts])[full]
    again = _again(h ^ mix(np.arange(n, dtype=np.uint64) + np.uint64(77))[ldoc])
    out["n_dup_lines"] = np.bincount(ldoc[again], minlength=n)
    out["dup_line_chars"] = np.bincount(ldoc[again], lchars[again], n).astype(np.int64)
    line_chars = np.bincount(ldoc, lchars, n)

    base = (nw < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * nw)
    bad = out["dup_line_chars"] > rules.lines * line_chars
    bad |= out["n_symbols"] > rules.symbols * np.maximum(nw, 1)
    for k, share in rules.duplicate.items():
        bad |= ratio[k] > share * word_chars
        out[f"dup_{k}gram_chars"] = ratio[k].astype(np.int64)
    out["base_failed"] = base
    out["kept"] = ~base & ~bad
    return out


def repetition_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per row of ``df``: id, counts, covered characters and the verdict ``kept``.

    Null and empty texts have no words and fail the base rule; repeated rows are judged alike, each for itself;
    an empty table gives an empty table; other columns are ignored. Texts are read whole, however long.
    """
    extra = ["dup_line_chars", *(f"dup_{k}gram_chars" for k in rules.duplicate)]
    numbers = [*COLUMNS, *extra]
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, " + ", ".join(f"{c} long" for c in numbers) + ", base_failed boolean, kept boolean"

    def run(batches):
        for b in slices(batches, "t"):
            m = measure(b.column("t"), rules)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[c], pa.int64()) for c in numbers), pa.array(m["base_failed"]), pa.array(m["kept"])], names=[id_col, *numbers, "base_failed", "kept"])

    return df.select(df[id_col].alias("i"), df[text_col].cast("string").alias("t")).mapInArrow(run, schema)


def keep_by_rules(df: DataFrame, text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of ``df`` whose text passes, with all their columns, in one narrow pass.

    Only texts go to Python. Null and empty texts fail; repeated rows are judged alike; an empty table stays empty;
    columns of any name pass through.
    """
    keep = F.arrow_udf(by_slice(lambda t: pa.array(measure(t, rules)["kept"]), pa.bool_()), "boolean")
    return df.where(keep(df[text_col].cast("string")))
