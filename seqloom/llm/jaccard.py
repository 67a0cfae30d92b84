"""N-gram Jaccard join: sparse products of document by shingle incidence, in blocks, with size-derived bounds.

Exact, in two products. Shingles have one global order (hash; those frequent in a sample of documents last), and two
sets that are similar enough share a shingle among the first ``n - ceil(t n) + 1`` of each. Documents with equal sets
are one class. (1) The product with each list's smallest id: the likeliest such partner of each class is checked,
which links large groups of near copies at once. (2) Only where a list still holds several linked groups do members of
different groups meet, in blocks of two chunks of a list: a pair is counted where what stands before and behind the
shingle in both orders can make it a link. Counts are accumulated over all blocks, pairs whose count and rest stay
below the bounds that their sizes set are discarded, and what is left is checked with whole sets.

Shingles are known by 64-bit hashes, as are sets by 128-bit sums of them.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import BitFilter, Shared, discard, fresh_name, materialize, xxhash64_long
from .textkit import mix, ngrams, slices, trim, words


@dataclass(frozen=True)
class Join:
    """Links where 100 * intersection >= ``percent`` * union. One document in ``sample_every`` is looked through for
    frequent shingles, which only sets the order (speed, never the result). A list is cut into chunks of about
    ``chunk`` members, and a set's partners into blocks of about ``partners``; no task holds more than two chunks. In
    lists of more than ``long_list`` members pairs are counted by stricter rules (speed, never the result)."""

    words: int = 5
    percent: int = 75
    sample_every: int = 16
    sample_least: int = 3
    long_list: int = 256
    chunk: int = 1024
    partners: int = 256


def shingle_sets(col, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word runs, lower-cased; a shorter text is one run."""
    w = words(col, lower=True)
    g, doc = ngrams(w.hash, w.first, k)
    at = np.searchsorted(doc, np.arange(w.counts.size + 1))
    out = []
    for i, n in enumerate(w.counts.tolist()):
        if n >= k:
            out.append(np.unique(g[at[i] : at[i + 1]]))
        elif n:
            out.append(mix(ngrams(w.hash[w.first[i] : w.first[i + 1]], np.array([0, n]), n)[0] + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_length(n, percent: int):
    return n - -(-n * percent // 100) + 1


def need(n: int, m: int, percent: int):
    """Smallest intersection of sets of ``n`` and ``m`` that links them."""
    return -(-percent * (n + m) // (100 + percent))


def _filter_of(hashes: DataFrame, n: int) -> Shared:
    return Shared(hashes.sparkSession, BitFilter.of(hashes, n))


def _frequent(df: DataFrame, j: Join) -> Shared:
    """Filter of the shingles that at least ``sample_least`` documents of the sample hold, or twice as many, and so on,
    until the filter has room. A shingle that it holds by chance is ordered like a frequent one everywhere, so the
    order stays one order."""
    rows = df.where(F.pmod(F.xxhash64("i"), F.lit(j.sample_every)) == 0).select("t")

    def run(batches):
        for b in slices(batches, "t"):
            sets = shingle_sets(b.column("t"), j.words)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    least = j.sample_least
    hot = materialize(rows.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= least), "join-frequent")
    while (n := hot.where(F.col("count") >= least).count()) > BitFilter.ENTRIES:
        least *= 2
    out = _filter_of(hot.where(F.col("count") >= least).select("h"), n)
    discard(hot)
    return out


def _signatures(df: DataFrame, frequent: Shared, j: Join) -> DataFrame:
    """``i, n, s1, s2, prefix``: size, 128-bit sum of the set, and its first shingles in the global order."""
    def run(batches):
        for b in slices(batches, "t"):
            sets = shingle_sets(b.column("t"), j.words)
            n = np.array([s.size for s in sets], np.int64)
            flat = np.concatenate(sets)
            hot = frequent.value.has(flat)
            cut = np.concatenate([[0], np.cumsum(n)])
            sums = [np.array([m[a:e].sum() for a, e in zip(cut, cut[1:])], np.uint64).view(np.int64) for m in (mix(flat), mix(flat ^ np.uint64(0x5851F42D4C957F2D)))]
            prefix = []
            for s, a, e in zip(sets, cut, cut[1:]):
                h = hot[a:e]
                p = prefix_length(e - a, j.percent) if e > a else 0
                prefix.append((np.concatenate([s[~h], s[h]]) if h.any() else s)[:p])
            size = np.array([p.size for p in prefix])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(prefix).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), lists], names=["i", "n", "s1", "s2", "prefix"])

    return df.mapInArrow(run, "i long, n long, s1 long, s2 long, prefix array<long>")


def _entries(classes: DataFrame, shared: Shared) -> DataFrame:
    """``h, rep, n, pos`` of the listed shingles that the filter lets through."""
    def run(batches):
        for b in batches:
            rep, n, lists = b.column("rep"), b.column("n").to_numpy(), b.column("prefix")
            off = lists.offsets.to_numpy()
            h = lists.values.to_numpy()[off[0] : off[-1]]
            row = np.repeat(np.arange(n.size), np.diff(off))
            pos = np.arange(h.size) - (off[:-1] - off[0])[row]
            keep = np.flatnonzero(shared.value.has(h.view(np.uint64)))
            row = row[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h[keep]), rep.take(pa.array(row)), pa.array(n[row]), pa.array(pos[keep], pa.int64())], names=["h", "rep", "n", "pos"])
        trim()

    return classes.select("rep", "n", "prefix").mapInArrow(run, "h long, rep long, n long, pos long")


def _whole_sets(df: DataFrame, ids: Shared, j: Join) -> DataFrame:
    """``i, s`` (8 bytes a shingle) for the texts whose id the filter lets through."""
    def run(batches):
        for whole in batches:
            i = whole.column("i")
            keep = ids.value.has(xxhash64_long(i.fill_null(0).to_numpy())) & i.is_valid().to_numpy(zero_copy_only=False)
            for b in slices([whole.filter(pa.array(keep))], "t"):
                sets = [s.tobytes() for s in shingle_sets(b.column("t"), j.words)]
                yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(sets, pa.binary())], names=["i", "s"])

    return df.mapInArrow(run, "i long, s binary")


def _member(sorted_array: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not sorted_array.size:
        return np.zeros(x.size, bool)
    at = np.minimum(np.searchsorted(sorted_array, x), sorted_array.size - 1)
    return sorted_array[at] == x


def _sets_of(col) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all sets end to end, offsets) of a binary column."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), np.uint64), (off - off[0]) // 8


def _check(df: DataFrame, pairs: DataFrame, j: Join) -> DataFrame:
    """The pairs ``a, b`` that are links, by whole sets: a block is ``b``'s set, then those of some of its partners,
    one after another, so that a task holds one set and a batch."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("i")).distinct().select(F.xxhash64("i").alias("h"))
    wanted = _filter_of(ids, ids.count())
    sets = materialize(_whole_sets(df, wanted, j), "join-sets")
    wanted.release()
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / j.partners).alias("blocks"))
    blocks = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"))
    heads = many.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    left = blocks.join(sets, F.col("a") == F.col("i")).select("b", "block", F.lit(1).alias("side"), "a", "s")
    right = heads.join(sets, F.col("b") == F.col("i")).select("b", "block", F.lit(0).alias("side"), F.lit(None).cast("long").alias("a"), "s")
    key = ["b", "block"]

    def run(batches):
        now, own = None, []  # the block, its first sets (equal ids have several)
        for t in batches:
            flat, off = _sets_of(t.column("s"))
            b, block, side = (t.column(c).to_numpy() for c in ("b", "block", "side"))
            cuts = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1]), [True]]))
            good = []
            for s, e in zip(cuts.tolist(), cuts[1:].tolist()):
                if (b[s], block[s]) != now:
                    now, own = (b[s], block[s]), []
                if side[s] == 0:
                    own += [flat[off[k] : off[k + 1]].copy() for k in range(s, e)]
                    continue
                n, part, link = np.diff(off[s : e + 1]), flat[off[s] : off[e]], np.zeros(e - s, bool)
                for x in own:
                    hits = np.concatenate([[0], np.cumsum(_member(x, part))])
                    both = hits[off[s + 1 : e + 1] - off[s]] - hits[off[s:e] - off[s]]
                    link |= 100 * both >= j.percent * (n + x.size - both)
                good.append(s + np.flatnonzero(link))
            found = pa.array(np.concatenate([np.zeros(0, np.int64), *good]))
            yield pa.RecordBatch.from_arrays([t.column("a").take(found), t.column("b").take(found)], names=["a", "b"])
        trim()

    rows = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "side")
    links = materialize(rows.mapInArrow(run, "a long, b long").distinct(), "join-links")
    discard(sets)
    return links


_MEMBER = ("rep", "n", "pos", "label")
_PAIR = ("a", "b", "la", "lb", "na", "nb", "ka", "kb", "c", "pa", "pb")


def least_shared(n, m, percent: int):
    """How many shingles two sets that link share within their prefixes, at least: what they need in common, less
    what can stand behind the prefix that ends first."""
    rest = lambda k: k - prefix_length(k, percent)
    return need(n, m, percent) - np.maximum(rest(n), rest(m))


def _met(m: dict, x: np.ndarray, y: np.ndarray, percent: int) -> tuple:
    """Of pairs of members of a list (numbers ``x``, ``y``) those of different groups that this shingle and what
    stands before and behind it in both orders can make a link: columns of ``_PAIR``.

    In a long list only those pairs meet that long lists alone can link (others share a shorter list, too), and only
    where the shingle can be the first that they share. So each link is met once at least.
    """
    n, pos, label = m["n"], m["pos"], m["label"]
    keep = label[x] != label[y]
    x, y = x[keep], y[keep]
    least, rest = need(n[x], n[y], percent), np.minimum(n[x] - pos[x], n[y] - pos[y])
    ok = np.minimum(pos[x], pos[y]) + rest >= least
    if m["long"].any():
        ok &= ~m["long"][x] | ((rest >= least) & (np.minimum(m["n_long"][x], m["n_long"][y]) >= least_shared(n[x], n[y], percent)))
    x, y = x[ok], y[ok]
    swap = m["rep"][x] > m["rep"][y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    both = [m[c][k] for c in ("rep", "label", "n", "n_long") for k in (x, y)]
    return *both, np.ones(x.size, np.int64), pos[x], pos[y]


def _list_pairs(m: dict, first: np.ndarray, percent: int, small: int = 32, block: int = 1 << 18):
    """Column tuples of all pairs within the lists that start at ``first`` (the last entry is the end); in a block of
    two chunks only their pairs across."""
    size = np.diff(first)
    few = np.repeat(size <= small, size)
    home = np.repeat(np.arange(size.size), size)
    across = m["ci"] != m["cj"]
    for d in range(1, min(small, int(size.max(initial=0)))):
        x = np.flatnonzero(few[:-d] & (home[:-d] == home[d:])) if d < few.size else np.zeros(0, np.int64)
        x = x[~across[x] | (m["chunk"][x] != m["chunk"][x + d])]
        yield _met(m, x, x + d, percent)
    for s, e in zip(first[:-1][size > small].tolist(), first[1:][size > small].tolist()):
        left, right = np.arange(s, e), np.arange(s, e)
        if across[s]:
            left, right = left[m["chunk"][s:e] == m["ci"][s]], right[m["chunk"][s:e] == m["cj"][s]]
        step = max(1, block // max(right.size, 1))
        for a in range(0, left.size, step):
            x, y = np.repeat(left[a : a + step], right.size), np.tile(right, left[a : a + step].size)
            if not across[s]:
                x, y = x[x < y], y[x < y]
            yield _met(m, x, y, percent)


def _summed(parts: list[tuple]) -> tuple:
    """One row for each pair: counts added, last places."""
    cols = [np.concatenate(x) for x in zip(*parts)]
    if not cols[0].size:
        return tuple(cols)
    key = (0, 1, 4, 5)
    order = np.lexsort([cols[k] for k in key])
    cols = [c[order] for c in cols]
    at = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in key])]))
    return (*(c[at] for c in cols[:8]), np.add.reduceat(cols[8], at), np.maximum.reduceat(cols[9], at), np.maximum.reduceat(cols[10], at))


def _cross_pairs(own: DataFrame, j: Join) -> DataFrame:
    """``_PAIR`` of members of different groups in ``own(h, rep, n, pos, label)`` that share ``c`` shingles up to places
    ``pa`` and ``pb`` of their orders, and can link.

    Rows come sorted by block; a task holds one block (two chunks of a list at most) and a batch.
    """
    lists = own.groupBy(F.col("h").alias("h2")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("k")).where("lo <> hi")
    lists = lists.select("h2", F.ceil(F.col("k") / j.chunk).alias("chunks"), (F.col("k") > j.long_list).alias("long"))
    mixed = materialize(own.join(lists, F.col("h") == F.col("h2")).select("h", *_MEMBER, "chunks", "long"), "join-mixed")
    n_long = mixed.where("long").groupBy(F.col("rep").alias("r2")).agg(F.count("*").alias("n_long"))
    rows = mixed.join(n_long, F.col("rep") == F.col("r2"), "left").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("h", F.least("chunk", "o").alias("ci"), F.greatest("chunk", "o").alias("cj"), "chunk", "long", *_MEMBER, F.coalesce("n_long", F.lit(0)).alias("n_long"))
    key = ["h", "ci", "cj"]
    names = [*key, "chunk", "long", *_MEMBER, "n_long"]

    def run(batches):
        def batch(parts):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _summed(parts)], names=list(_PAIR))

        def pairs(m, first):
            held, size = [], 0
            for part in _list_pairs(m, first, j.percent):
                held.append(part)
                size += part[0].size
                if size > 200_000:
                    yield batch(held)
                    held, size = [], 0
            if size:
                yield batch(held)

        rest = None
        for b in batches:
            m = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            if rest is not None:
                m = {c: np.concatenate([rest[c], m[c]]) for c in names}
            if not m["h"].size:
                continue
            new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([m[c][1:] != m[c][:-1] for c in key])]))
            yield from pairs(m, new)
            rest = {c: m[c][new[-1] :] for c in names}
        if rest is not None:
            yield from pairs(rest, np.array([0, rest["h"].size]))
        trim()

    found = rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, ", ".join(f"{k} long" for k in _PAIR))
    found = found.groupBy(*_PAIR[:8]).agg(F.sum("c").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    # in prefixes: what was counted, and the long lists' part; in all: at most what stands behind the last one counted, too
    seen = F.col("c") + F.least("ka", "kb")
    most = seen + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
    n, m = F.col("na"), F.col("nb")
    rest = lambda k: F.ceil(k * F.lit(j.percent) / F.lit(100)) - 1
    least = F.ceil(F.lit(j.percent) * (n + m) / F.lit(100 + j.percent))
    out = materialize(found.where((seen >= least - F.greatest(rest(n), rest(m))) & (most >= least)), "join-pairs")
    discard(mixed)
    return out


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Null texts and texts without words have no shingles and are linked with nothing. Equal ids are one document,
    linked as any of its texts is; a null id has no links and a null component. Repeated rows and ties link as any
    equal sets do; an empty table gives an empty table; other columns are ignored. Ids are cast to long.
    """
    j, percent = join, join.percent
    rows = df.select(df[id_col].cast("long").alias("i"), df[text_col].cast("string").alias("t"))
    frequent = _frequent(rows, j)
    signed = materialize(_signatures(rows, frequent, j), "join-signatures")
    frequent.release()
    classes = signed.where("n > 0 and i is not null").groupBy("n", "s1", "s2").agg(F.min("i").alias("rep"), F.first("prefix").alias("prefix"))
    classes = materialize(classes, "join-classes")

    # lists of two classes or more, each with its smallest id; partial sums meet a frequent shingle in every task first
    heads = classes.select("rep", "n", F.explode("prefix").alias("h")).groupBy("h").agg(F.min("rep").alias("head"), F.min_by("n", "rep").alias("head_n"), F.max("rep").alias("last"))
    heads = materialize(heads.where("head <> last").select(F.col("h").alias("h2"), "head", "head_n"), "join-heads")
    shared = _filter_of(heads.select("h2"), heads.count())
    lists = materialize(_entries(classes, shared).join(heads, F.col("h") == F.col("h2")).select("h", "rep", "n", "pos", "head", "head_n"), "join-lists")
    shared.release()
    discard(heads)

    # the first product: each class with the head that it shares most lists with, if they promise a link; a link that
    # is passed over here is found below
    star = lists.where(F.col("rep") != F.col("head")).groupBy("rep", "head", "n", "head_n").agg(F.count("*").alias("c"))
    fits = F.least("n", "head_n") * 100 >= F.greatest("n", "head_n") * percent
    likely = F.col("c") >= F.lit(percent) * (F.col("n") + F.col("head_n")) / F.lit(100 + percent) - F.lit(percent / 100) * F.least("n", "head_n")
    star = star.where(fits & likely).groupBy("rep").agg(F.max_by("head", F.struct("c", "head")).alias("b"))
    star = materialize(star.select(F.col("rep").alias("a"), "b"), "join-pairs")
    first = _check(rows, star, j)

    own = lists.select("h", *_MEMBER[:3]).join(components(first), F.col("rep") == F.col("node"), "left").select("h", *_MEMBER[:3], F.coalesce("label", "rep").alias("label"))
    own = materialize(own, "join-members")
    discard(star, lists)
    pairs = _cross_pairs(own, j)
    discard(own)
    # of each two groups the likeliest pair first; the others only if that leaves them apart
    best = pairs.groupBy(F.least("la", "lb").alias("u"), F.greatest("la", "lb").alias("v")).agg(F.max_by(F.struct("a", "b"), F.struct("c", "a", "b")).alias("p"))
    best = materialize(best.select("p.a", "p.b"), "join-best")
    second = _check(rows, best, j)
    merged = materialize(_merge_groups(pairs, second), "join-rest")
    links = first.unionByName(second).unionByName(_check(rows, merged, j))
    discard(pairs, best, merged)

    labels = components(links)
    keys = ["n", "s1", "s2"]
    named = classes.select(*keys, "rep").join(labels, F.col("rep") == F.col("node"), "left").select(*(F.col(k).alias("c_" + k) for k in keys), F.coalesce("label", "rep").alias("component_id"))
    out = signed.select("i", *keys).join(named, [F.col(k) == F.col("c_" + k) for k in keys], "left")
    return out.select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("i").isNotNull(), F.coalesce("component_id", "i")).alias("component_id"))


def _merge_groups(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose groups the links (pairs, too) leave apart."""
    joined = links.join(pairs, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    now = components(joined)
    at = lambda c, to: now.select(F.col("node").alias("node_" + c), F.col("label").alias(to))
    named = pairs.join(at("a", "ga"), F.col("la") == F.col("node_a"), "left").join(at("b", "gb"), F.col("lb") == F.col("node_b"), "left")
    return named.where(F.coalesce("ga", "la") != F.coalesce("gb", "lb")).select("a", "b")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """The rows of ``df`` that are the smallest id of their component, with all their columns; null ids stay.

    Of rows that share the smallest id all stay. Nulls, ties, empty tables and long texts are as in
    ``jaccard_components``; columns of any name pass through.
    """
    found, name = jaccard_components(df, id_col, text_col, join), fresh_name(df, "join_drop")
    drop = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return df.join(drop, df[id_col].cast("long") == drop[name], "left_anti")
