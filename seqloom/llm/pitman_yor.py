"""Language-model scoring with a hierarchical Pitman-Yor model.

Each preceding word (known by 40 bits of its hash) is a context with a restaurant of its own; all of them share the
restaurant of words as their parent; a word's first table there asks its letters, which sit in restaurants for
contexts of up to three letters, where a context's parent is the context without its oldest letter. Seatings are
drawn by blocked sweeps: all customers of a dish leave their restaurant and sit down again one after another, given
the tables of everyone else as the sweep before left them. A block is drawn in sequence, not from its exact
conditional, and restaurants move at the same time, so this is a parallel approximation of Gibbs sampling.
Predictive probabilities are averaged over several chains. Outcomes are the V words of the training texts (the end of
a text is one) and one more, any other word: what letters give to all unseen words together.

Draws are hashes of the word, its context, the sweep and the customer, so the model does not depend on chunks, ranges
or partitions.

Data flow: texts are cut into chunks (a stream of word numbers, and the chunk's distinct pairs of context and word);
the pairs meet by hash range of the word, where they get corpus counts and seats. A restaurant's customers and tables
lie in many ranges of words: after each sweep they meet by hash range of the context, and the sums go back to the
ranges that asked. Probabilities go back to their chunks and are summed by text. No task holds more than a chunk or a
range, no token is shuffled but in its chunk's stream, a frequent pair is one entry a chunk, and the driver gets only
the letter model and three sums a range and chain. A chunk has a row for each range that holds one of its words: never
more than it has distinct words.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shared, discard, materialize, materialize_by
from .textkit import crc_rows, mix, pack, pack_steps, slices, span_hash, trim, unpack, unpack_steps, words

#: Bits kept of the last, second last and third last letter: 2 ** 17 contexts at most.
BITS = (7, 5, 5)
END = 0x20  # of a word; no letter of a word
START = 0  # stands before a word
BEGIN = np.uint64(0)  # context at the start of a text; else the first 40 bits of the preceding word's hash
#: Steps of log10 of a probability that are sent back to a chunk: 1 / 2048.
STEP = 2048
_PAIR = np.int64(32)  # a pair is word number << 32 | context number


@dataclass(frozen=True)
class Settings:
    fold: int = 7
    held_out: int = 2
    chunk_words: int = 800_000
    range_bytes: int = 10 << 20  # bytes of text behind each hash range
    sweeps: int = 12  # of the letters' restaurants
    rounds: int = 3  # sweeps of words and contexts, each given the seats of the one before
    samples: int = 3
    theta: float = 1.0
    seed: int = 9


# --- chunks ---------------------------------------------------------------------------------------------------

def letters_hash(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words laid end to end; an empty word is the end of a text."""
    out = np.full(size.size, mix(np.array([1 << 50], np.uint64))[0], np.uint64)
    full = size > 0
    starts = (np.cumsum(size) - size)[full]
    if starts.size:
        st = np.zeros(data.size, bool)
        st[starts] = True
        out[full] = span_hash(data, np.ones(data.size, bool), st, starts, starts + size[full])
    return out


def take_letters(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the given spans, end to end."""
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return data[at]


def pairs_of(word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """word << 32 | context for each token of texts of the given sizes: 0 at a text's start, else 1 + preceding word."""
    before = np.zeros(word.size, np.int64)
    before[1:] = word[:-1]
    before[1:] += 1
    before[np.cumsum(size) - size] = 0
    return word << _PAIR | before


class Chunk:
    """Distinct context and word pairs of some texts, with training counts, and the texts as word numbers."""

    def __init__(self):
        self.ids, self.held, self.len, self.n = [], [], [], 0
        self.hash, self.letters, self.size, self.stream = [], [], [], []

    def add(self, ids, col, held: np.ndarray) -> None:
        w = words(col, lower=True)
        # after each text's words, its end: an empty span at the end of the text
        at = w.first[1:]
        starts = np.insert(w.starts, at, w.off[1:])
        ends = np.insert(w.ends, at, w.off[1:])
        h = np.insert(w.hash, at, letters_hash(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0])
        own, first, word = np.unique(h, return_index=True, return_inverse=True)
        size = ends[first] - starts[first]
        self.ids.append(ids)
        self.held.append(held)
        self.len.append(w.counts + 1)
        self.hash.append(own)
        self.size.append(size)
        self.letters.append(take_letters(w.data, starts[first], size))
        self.stream.append(word.astype(np.uint32))
        self.n += h.size

    def rows(self, ranges: int):
        """The vocabulary of each range, then the texts under part -1, as rows of PART without the chunk."""
        own, at, number = np.unique(np.concatenate(self.hash), return_index=True, return_inverse=True)
        base, stream = 0, []
        for h, word in zip(self.hash, self.stream):
            stream.append(number[base : base + h.size][word].astype(np.uint32))
            base += h.size
        stream, length, held = np.concatenate(stream), np.concatenate(self.len), np.concatenate(self.held)
        self.stream = self.hash = []
        pairs, inverse = np.unique(pairs_of(stream.astype(np.int64), length), return_inverse=True)
        total = np.bincount(inverse, np.repeat(~held, length), pairs.size).astype(np.int64)
        del inverse
        size, data = np.concatenate(self.size), np.concatenate(self.letters)
        offset = np.cumsum(size) - size
        word, before = pairs >> _PAIR, pairs & 0xFFFFFFFF
        part, context = range_of(own, ranges), np.concatenate([[BEGIN], own >> np.uint64(24)])
        for p in np.unique(part):
            a, b = np.searchsorted(part, [p, p + 1])
            i, j = np.searchsorted(word, [a, b])
            used, local = np.unique(before[i:j], return_inverse=True)
            # places of contexts follow their bits, as words' numbers follow their hashes
            v = Vocabulary(take_letters(data, offset[at[a:b]], size[at[a:b]]), size[at[a:b]], np.bincount(word[i:j] - a, minlength=b - a), np.zeros(b - a, np.uint32), context[used], local, total[i:j])
            yield int(p), *v.row()
        yield -1, length.size, stream.size, own.size, pack(stream), pack(length.astype(np.uint32)), pack(held.astype(np.uint8)), b"", b""


def range_of(key: np.ndarray, ranges: int, bits: int = 64) -> np.ndarray:
    """By the upper bits of the hash, so a word's pairs share a range and ranges follow the order of keys."""
    return ((key >> np.uint64(bits - 32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


PART = "part int, chunk long, n long, m long, k long, a binary, b binary, c binary, d binary, e binary"


def part_batch(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 5]
    return pa.table({x.split()[0]: pa.array([r[k] for r in rows], t) for k, (x, t) in enumerate(zip(PART.split(", "), kinds))})


def cut_chunks(df: DataFrame, id_col: str, text_col: str, ranges: int, s: Settings) -> DataFrame:
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        def emit(chunk):
            number = uuid.uuid4().int >> 65
            rows = [(r[0], number, *r[1:]) for r in chunk.rows(ranges)]
            ids = pa.concat_arrays(chunk.ids)
            lists = pa.ListArray.from_arrays(pa.array([0] * len(rows) + [len(ids)], pa.int32()), ids)
            out = part_batch(rows).append_column("ids", lists).append_column("texts", pa.array([int(r[0] < 0) for r in rows], pa.int32()))
            trim()
            return out.combine_chunks().to_batches()[0]

        chunk = Chunk()
        for b in slices(batches, "t"):
            ids = b.column("i")
            held = crc_rows(ids) % s.fold == s.held_out if s.fold else np.zeros(len(ids), bool)
            chunk.add(ids, b.column("t"), held)
            if chunk.n >= s.chunk_words:
                yield emit(chunk)
                chunk = Chunk()
        if chunk.ids:
            yield emit(chunk)

    rows = df.select(df[id_col].alias("i"), df[text_col].cast("string").alias("t"))
    return rows.mapInArrow(run, f"{PART}, ids array<{kind}>, texts int")


# --- pairs by hash range --------------------------------------------------------------------------------------

@dataclass
class Vocabulary:
    """The words of a range end to end, their contexts in order of hash, and pairs in order of word and context."""

    data: np.ndarray
    size: np.ndarray
    pairs: np.ndarray  # of each word
    salt: np.ndarray  # of each word, 32 bits of its hash; zeros in a chunk
    contexts: np.ndarray
    context: np.ndarray  # of each pair, its place in ``contexts``
    count: np.ndarray

    @classmethod
    def of(cls, row, kind=np.int64) -> Vocabulary:
        """Of a row of PART, pairs as numbers of ``kind``; without letters where these were left out."""
        n, m = row["n"], row["m"]
        size, pairs, salt = unpack(row["b"], np.uint32, 3 * n).reshape(3, n)
        data = np.zeros(0, np.uint8) if row["a"] is None else unpack(row["a"], np.uint8, int(size.sum()))
        return cls(data, size.astype(np.int64), pairs.astype(np.int64), salt, unpack_steps(row["c"], np.uint64, row["k"]), unpack_steps(row["d"], np.uint32, m).astype(kind), unpack(row["e"], np.uint32, m).astype(kind))

    def row(self) -> tuple:
        sizes = np.concatenate([self.size.astype(np.uint32), self.pairs.astype(np.uint32), self.salt])
        return self.size.size, self.count.size, self.contexts.size, pack(self.data), pack(sizes), pack_steps(self.contexts), pack_steps(self.context.astype(np.uint32)), pack(self.count.astype(np.uint32))

    @property
    def word(self) -> np.ndarray:
        return np.repeat(np.arange(self.size.size), self.pairs)

    @property
    def word_count(self) -> np.ndarray:
        return np.bincount(self.word, self.count, self.size.size).astype(np.int64)


def merge_ranges(store: DataFrame) -> DataFrame:
    """One row a range with its words and pairs (chunk null), and one for each chunk with its words' and pairs' numbers."""
    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        part, every = rows[0]["part"], []
        for r in rows:
            every.append(Vocabulary.of(r, np.uint32))
            for c in "abcde":
                del r[c]
        hashes = np.concatenate([letters_hash(v.data, v.size) for v in every])
        own, at, number = np.unique(hashes, return_index=True, return_inverse=True)
        contexts, place = np.unique(np.concatenate([v.contexts for v in every]), return_inverse=True)
        w, c, n, keys = 0, 0, 0, np.zeros(sum(v.count.size for v in every), np.int64)
        for v in every:
            keys[n : n + v.count.size] = number[w + v.word] << _PAIR | place[c + v.context]
            w, c, n = w + v.size.size, c + v.contexts.size, n + v.count.size
            v.context = v.contexts = None
        del place
        pairs, inverse = np.unique(keys, return_inverse=True)
        inverse = inverse.astype(np.uint32)
        del keys
        total = np.bincount(inverse, np.concatenate([v.count for v in every]), pairs.size).astype(np.int64)
        size, data = np.concatenate([v.size for v in every]), np.concatenate([v.data for v in every])
        offset = np.cumsum(size) - size
        merged = Vocabulary(take_letters(data, offset[at], size[at]), size[at], np.bincount(pairs >> _PAIR, minlength=own.size), own.astype(np.uint32), contexts, pairs & 0xFFFFFFFF, total)
        cut, ends = np.cumsum([0, *(v.count.size for v in every)]), np.cumsum([0, *(v.size.size for v in every)])
        out = [(part, None, *merged.row())]
        out += [(part, r["chunk"], r["n"], r["m"], 0, pack_steps(inverse[a:b]), pack_steps(number[x:y].astype(np.uint32)), *[None] * 3) for r, a, b, x, y in zip(rows, cut, cut[1:], ends, ends[1:])]
        del every, inverse, merged
        trim()
        return part_batch(out)

    return store.drop("ids").groupBy("part").applyInArrow(merge, PART)


#: Values of ``k`` in rows that are no vocabulary.
ASK, ANSWER, SEATS, SUMS = -1, -2, -3, -4


def ask(part: int, v: Vocabulary, tables: list[np.ndarray], ranges: int) -> list[tuple]:
    """To each range of contexts: a range of words' contexts, their customers there and their tables in each chain."""
    n = v.contexts.size
    sums = np.array([np.bincount(v.context, x, n) for x in (v.count, *tables)]).astype(np.uint32)
    to = range_of(v.contexts, ranges, 40)
    edge = [*_starts(to), n]
    return [(int(to[i]), part, j - i, 0, ASK, pack_steps(v.contexts[i:j]), pack(sums[:, i:j]), *[None] * 3) for i, j in zip(edge, edge[1:])]


def _starts(x: np.ndarray) -> list[int]:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist() if x.size else []


def answer(chains: int):
    """To each range of words: customers and tables of its contexts in all ranges."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        _, place = np.unique(np.concatenate([unpack_steps(r["a"], np.uint64, r["n"]) for r in rows]), return_inverse=True)
        sums = np.concatenate([unpack(r["b"], np.uint32, (1 + chains) * r["n"]).reshape(1 + chains, -1) for r in rows], axis=1)
        total = np.array([np.bincount(place, x)[place] for x in sums]).astype(np.int64)
        cut = np.cumsum([0, *(r["n"] for r in rows)])
        return part_batch([(r["chunk"], r["part"], r["n"], 0, ANSWER, None, pack(total[:, a:b]), *[None] * 3) for r, a, b in zip(rows, cut, cut[1:])])

    return run


def seats_row(part: int, log0: np.ndarray, pairs: list[np.ndarray], tops: list[np.ndarray]) -> tuple:
    """Tables of pairs and of words in each chain, and the words' letters."""
    return part, None, log0.size, pairs[0].size, SEATS, pack(log0.astype(np.float32)), pack(np.array(pairs, np.uint32)), pack(np.array(tops, np.uint32)), None, None


def gathered(rows: list[dict], chains: int):
    """(vocabulary, log0, tables of pairs, of words, customers of contexts, tables of contexts) of a range of words."""
    v = Vocabulary.of(next(r for r in rows if r["k"] > 0))
    seats = next(r for r in rows if r["k"] == SEATS)
    got = sorted((r for r in rows if r["k"] == ANSWER), key=lambda r: r["chunk"])
    total = np.concatenate([unpack(r["b"], np.int64, (1 + chains) * r["n"]).reshape(1 + chains, -1) for r in got], axis=1)
    n, m = seats["n"], seats["m"]
    t2 = unpack(seats["b"], np.uint32, chains * m).astype(np.int64).reshape(chains, m)
    t1 = unpack(seats["c"], np.uint32, chains * n).astype(np.int64).reshape(chains, n)
    return v, unpack(seats["a"], np.float32, n).astype(float), t2, t1, total[0], total[1:]


# --- letters --------------------------------------------------------------------------------------------------

def letter_cells(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """context << 8 | letter for every letter and end of words laid end to end."""
    ends = np.cumsum(size)
    seq = np.insert(data, ends, END).astype(np.int64)
    begin = np.zeros(seq.size, np.int64)
    first = ends - size + np.arange(size.size)
    begin[first] = first
    pos = np.arange(seq.size) - np.maximum.accumulate(begin)
    ctx, shift = np.zeros(seq.size, np.int64), 0
    for k, bits in enumerate(BITS, 1):
        back = np.zeros(seq.size, np.int64)
        back[k:] = seq[:-k] if k < seq.size else 0
        back[pos < k] = START
        ctx |= (back & ((1 << bits) - 1)) << shift
        shift += bits
    return ctx << 8 | seq


def uniform(keys: np.ndarray, turn: int):
    """Draws for ``seat``: numbers in [0, 1) from each dish's key, the turn and the customer."""
    salt = mix(np.array([turn], np.uint64))[0]
    return lambda dishes, k: (mix(keys[dishes] ^ salt ^ mix(np.array([k << 8], np.uint64))[0]) >> np.uint64(11)) / float(1 << 53)


def seat(c: np.ndarray, p0: np.ndarray, theta: np.ndarray, d: float, tables: np.ndarray, draw, grow: bool = False) -> np.ndarray:
    """Tables of each dish after its ``c`` customers sit down one after another: a new table is opened with
    odds (theta + d * tables) * p0 against customers so far - d * own tables. From the 200th on, customers come in
    groups of a hundredth of those before, which open the expected number of tables, rounded up or down by chance.
    ``draw(dishes, k)``: uniform numbers. ``grow``: ``tables`` are those of other dishes, own ones are added."""
    t = np.minimum(c, 1).astype(np.int64)
    a, more = (theta + d * tables) * p0, d * p0 if grow else np.zeros(c.size)
    alive, k = np.flatnonzero(c > 1), 1
    while alive.size:
        step = max(1, k // 100)
        m = np.minimum(step, c[alive] - k)
        new = a[alive] + more[alive] * t[alive]
        prob = new / (new + np.maximum(k - d * t[alive], 1e-9))
        t[alive] += np.floor(m * np.clip(prob, 0, 1) + draw(alive, k)).astype(np.int64)
        k += step
        alive = alive[c[alive] > k]
    return np.minimum(t, c)


class LetterModel:
    """Restaurants for contexts of 0 to 3 letters over 256 bytes."""

    def __init__(self, key: np.ndarray, count: np.ndarray, s: Settings):
        """``key``: sorted distinct cells of the longest contexts, ``count``: their customers."""
        shifts = np.cumsum((0, *BITS))
        self.keys, up, ctx = [key], [], []
        for level in range(len(BITS), 0, -1):  # a parent's context keeps the lower bits
            k = self.keys[-1]
            parent = ((k >> 8) & ((1 << int(shifts[level - 1])) - 1)) << 8 | (k & 255)
            own, inverse = np.unique(parent, return_inverse=True)
            self.keys.append(own)
            up.append(inverse)
        n = len(self.keys)
        for k in self.keys:
            rooms, room = np.unique(k >> 8, return_inverse=True)
            ctx.append((rooms, room))
        self.rooms = [c[0] for c in ctx]
        d, theta = (0.75, 0.7, 0.6, 0.3), (1.0, 1.0, 1.0, 1.0)
        t = [np.minimum(count, 1)]
        customers = [count]
        for j in range(1, n):
            customers.append(np.bincount(up[j - 1], t[j - 1], self.keys[j].size).astype(np.int64))
            t.append(np.minimum(customers[j], 1))
        self.samples = []
        for sweep in range(s.sweeps):
            prob, back = [None] * n, [None] * n
            for j in range(n - 1, -1, -1):  # root first
                base = prob[j + 1][up[j]] if j + 1 < n else np.full(self.keys[j].size, 1 / 256)
                room, m = ctx[j][1], ctx[j][0].size
                all_c, all_t = np.bincount(room, customers[j], m), np.bincount(room, t[j], m)
                back[j] = (theta[j] + d[j] * all_t) / (theta[j] + all_c)
                prob[j] = (customers[j] - d[j] * t[j]) / (theta[j] + all_c)[room] + back[j][room] * base
            if sweep >= s.sweeps - s.samples:
                self.samples.append([((customers[j] - d[j] * t[j]) / (theta[j] + np.bincount(ctx[j][1], customers[j], ctx[j][0].size))[ctx[j][1]], back[j]) for j in range(n)])
            for j in range(n):
                base = prob[j + 1][up[j]] if j + 1 < n else np.full(self.keys[j].size, 1 / 256)
                room = ctx[j][1]
                t[j] = seat(customers[j], base, theta[j], d[j], np.bincount(room, t[j], ctx[j][0].size)[room], uniform(mix(self.keys[j].astype(np.uint64)), s.seed << 16 | sweep << 4 | j))
                if j + 1 < n:
                    customers[j + 1] = np.bincount(up[j], t[j], self.keys[j + 1].size).astype(np.int64)
                    t[j + 1] = np.minimum(np.maximum(t[j + 1], np.minimum(customers[j + 1], 1)), customers[j + 1])

    def cell_probability(self, cells: np.ndarray) -> np.ndarray:
        """Predictive probability of each cell, averaged over the kept seatings."""
        shifts, out = np.cumsum((0, *BITS)), np.zeros(cells.size)
        for sample in self.samples:
            p = np.full(cells.size, 1 / 256)
            for j in range(len(self.keys) - 1, -1, -1):
                ctx = (cells >> 8) & ((1 << int(shifts[len(BITS) - j])) - 1)
                key = ctx << 8 | (cells & 255)
                share, back = sample[j]
                if not self.keys[j].size:
                    continue
                room = np.minimum(np.searchsorted(self.rooms[j], ctx), self.rooms[j].size - 1)
                known = self.rooms[j][room] == ctx
                at = np.minimum(np.searchsorted(self.keys[j], key), self.keys[j].size - 1)
                own = np.where(self.keys[j][at] == key, share[at], 0.0)
                p = np.where(known, own + back[room] * p, p)
            out += p
        return out / max(len(self.samples), 1)

    def word_log(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Natural log probability of each word's letters and end."""
        if not size.size:
            return np.zeros(0)
        cells = letter_cells(data, size)
        distinct, inverse = np.unique(cells, return_inverse=True)
        p = np.log(self.cell_probability(distinct))[inverse]
        return np.add.reduceat(p, np.cumsum(size + 1) - (size + 1))


# --- the model ------------------------------------------------------------------------------------------------

def discount(once: float, twice: float) -> float:
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once + twice else 0.5


@dataclass
class Totals:
    tokens: int  # N
    types: int  # V
    d_word: float
    d_pair: float
    pairs: int  # distinct pairs
    model: LetterModel


@dataclass
class Sums:
    """Of the restaurant of words in one chain: customers, tables, letters' share of all known words."""

    customers: float
    word_tables: float
    known: float


def sit(v: Vocabulary, log0, t2, t1, all_t, n: Totals, sums: Sums, s: Settings, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables of pairs, tables of words) of the next sweep. A pair's customers leave, and their tables leave the
    restaurant of words; they sit down again given all others, then the words' customers do."""
    word, p0, salt = v.word, np.exp(log0), v.salt.astype(np.uint64)
    c1 = np.bincount(word, t2, v.size.size).astype(np.int64)
    left = c1[word] - t2
    fall = (s.theta + n.d_word * sums.word_tables) / (s.theta + sums.customers - t2)
    parent = np.maximum(left - n.d_word * np.minimum(t1[word], left), 0) / (s.theta + sums.customers - t2) + fall * p0[word]
    draw = uniform(mix(v.contexts)[v.context] ^ salt[word], turn)
    t2 = seat(v.count, parent, s.theta, n.d_pair, all_t[v.context] - t2, draw, grow=True)
    c1 = np.bincount(word, t2, v.size.size).astype(np.int64)
    return t2, seat(c1, p0, s.theta, n.d_word, sums.word_tables - t1, uniform(mix(salt), turn), grow=True)


def predictive(v: Vocabulary, log0, t2, t1, all_c, all_t, n: Totals, sums: Sums, s: Settings) -> np.ndarray:
    """Probability of each pair's word in its context; words without customers share one outcome."""
    c1 = np.bincount(v.word, t2, v.size.size)
    fall = (s.theta + n.d_word * sums.word_tables) / (s.theta + sums.customers)
    word = np.maximum(c1 - n.d_word * t1, 0) / (s.theta + sums.customers) + fall * np.exp(log0)
    word = np.where(v.word_count > 0, word, fall * max(1 - sums.known, 1e-12))
    all_c, all_t = all_c[v.context], all_t[v.context]
    return np.maximum(v.count - n.d_pair * t2, 0) / (s.theta + all_c) + (s.theta + n.d_pair * all_t) / (s.theta + all_c) * word[v.word]


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity
    (10 to the power of -score / n_tokens).

    Rows whose crc32 of the id as text is ``held_out`` modulo ``fold`` are scored but not learnt from (``fold`` 0:
    none). Null and empty texts are one end token; a null id counts as empty text; repeated rows count each; an
    empty table gives an empty table; texts of any length are read whole; with nothing to learn from, every token is
    unseen. Other columns are ignored.
    """
    s = settings
    kind = dict(df.dtypes)[id_col]
    size = df.agg(F.sum(F.octet_length(df[text_col].cast("string")).cast("long"))).first()[0] or 0
    ranges = max(4, -(-size // s.range_bytes))
    pairs, texts = materialize_by(cut_chunks(df, id_col, text_col, ranges, s), "lm-chunks", "texts", [0, 1])
    merged = materialize(merge_ranges(pairs), "lm-ranges")
    discard(pairs)
    vocabulary = merged.where("chunk is null")

    def tally(batches):
        """Sums under negative keys (words, then pairs), letter cells of known words under the others."""
        for batch in batches:
            for row in batch.to_pylist():
                v = Vocabulary.of(row)
                count = v.word_count
                known = count > 0
                offset = np.cumsum(v.size) - v.size
                cells, c = np.unique(letter_cells(take_letters(v.data, offset[known], v.size[known]), v.size[known]), return_counts=True) if known.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                sums = [count.sum(), known.sum(), (count == 1).sum(), (count == 2).sum(), (v.count == 1).sum(), (v.count == 2).sum(), (v.count > 0).sum()]
                keys = np.concatenate([-1 - np.arange(len(sums)), cells])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate([sums, c]).astype(np.int64))], names=["cell", "n"])

    cells = vocabulary.mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    key, value = cells.column("cell").to_numpy(), cells.column("n").to_numpy()
    sums = np.zeros(7)
    sums[-1 - key[key < 0]] = value[key < 0]
    order = np.argsort(key[key >= 0])
    letters = LetterModel(key[key >= 0][order], value[key >= 0][order].astype(np.int64), s)
    n = Totals(int(sums[0]), int(sums[1]), discount(*sums[2:4]), discount(*sums[4:6]), int(sums[6]), letters)
    shared = Shared(df.sparkSession, n)
    chains = s.samples

    def first(batches):
        """One table for each dish everywhere."""
        for batch in batches:
            for row in batch.to_pylist():
                v = Vocabulary.of(row)
                t2 = np.minimum(v.count, 1)
                t1 = np.minimum(np.bincount(v.word, t2, v.size.size), 1)
                log0 = shared.value.model.word_log(v.data, v.size).astype(np.float32).astype(float)
                known = float(np.exp(log0)[v.word_count > 0].sum())
                sums = np.array([[t2.sum(), t1.sum(), known]] * chains, float)
                yield part_batch([seats_row(row["part"], log0, [t2] * chains, [t1] * chains), (row["part"], None, 0, 0, SUMS, pack(sums), *[None] * 4), *ask(row["part"], v, [t2] * chains, ranges)]).combine_chunks().to_batches()[0]
                trim()

    def totals(seats: DataFrame) -> list[Sums]:
        got = sorted((r["part"], bytes(r["a"])) for r in seats.where(f"k = {SUMS}").select("part", "a").toLocalIterator())
        return [Sums(*(float(x) for x in row)) for row in sum((unpack(a, np.float64, 3 * chains).reshape(chains, 3) for _, a in got), np.zeros((chains, 3)))]

    def asked(seats: DataFrame) -> DataFrame:
        """The seats of each range of words, and what its contexts have in all ranges."""
        return seats.where(f"k = {SEATS}").unionByName(seats.where(f"k = {ASK}").groupBy("part").applyInArrow(answer(chains), PART))

    pairs_only = vocabulary.withColumn("a", F.lit(None).cast("binary"))
    seats = materialize(vocabulary.mapInArrow(first, PART), "lm-seats")
    state = totals(seats)

    def sweeper(turn: int, state: list[Sums]):
        def sweep(table: pa.Table) -> pa.Table:
            rows = table.to_pylist()
            part = rows[0]["part"]
            v, log0, t2, t1, _, all_t = gathered(rows, chains)
            new = [sit(v, log0, t2[k], t1[k], all_t[k], shared.value, state[k], s, s.seed << 16 | turn << 8 | k) for k in range(chains)]
            known = np.exp(log0)[v.word_count > 0].sum()
            sums = np.array([[a.sum(), b.sum(), known] for a, b in new], float)
            trim()
            return part_batch([seats_row(part, log0, [a for a, _ in new], [b for _, b in new]), (part, None, 0, 0, SUMS, pack(sums), *[None] * 4), *ask(part, v, [a for a, _ in new], ranges)])

        return sweep

    for turn in range(s.rounds):
        before, seats = seats, materialize(pairs_only.unionByName(asked(seats)).groupBy("part").applyInArrow(sweeper(turn, state), PART), "lm-seats")
        discard(before)
        state = totals(seats)

    def back(table: pa.Table) -> pa.Table:
        """What the last seating means for each chunk's pairs."""
        rows, n = table.to_pylist(), shared.value
        v, log0, t2, t1, all_c, all_t = gathered(rows, chains)
        p = sum(predictive(v, log0, t2[k], t1[k], all_c, all_t[k], n, state[k], s) for k in range(chains))
        log = np.rint(np.clip(-np.log10(np.maximum(p / chains, 1e-300)), 0, 65535 / STEP) * STEP).astype(np.uint16)
        count = v.word_count.astype(np.uint32)
        out = []
        for r in rows:
            if r["chunk"] is not None and r["k"] == 0:
                out.append((r["part"], r["chunk"], r["n"], r["m"], 0, pack(log[unpack_steps(r["a"], np.uint32, r["m"])]), pack(count[unpack_steps(r["b"], np.uint32, r["n"])]), *[None] * 3))
        del v, t2, p, rows
        trim()
        return part_batch(out)

    rest = merged.where("chunk is not null").unionByName(pairs_only).unionByName(asked(seats))
    returned = rest.groupBy("part").applyInArrow(back, PART)

    def finish(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        rows = sorted(table.drop_columns("ids").to_pylist(), key=lambda r: r["part"])
        own, rest, n = rows[0], rows[1:], shared.value
        log = np.concatenate([unpack(r["a"], np.uint16, r["m"]) for r in rest]).astype(np.float64) / -STEP
        count = np.concatenate([unpack(r["b"], np.uint32, r["n"]) for r in rest])
        docs = own["n"]
        stream, size, held = unpack(own["a"], np.uint32, own["m"]).astype(np.int64), unpack(own["b"], np.uint32, docs).astype(np.int64), unpack(own["c"], np.uint8, docs)
        cut, base = np.cumsum(size) - size, np.log10((count.astype(np.float64) + 1) / (n.tokens + n.types + 1))
        score = np.add.reduceat(log[np.unique(pairs_of(stream, size), return_inverse=True)[1]], cut)
        out = pa.table({id_col: ids.flatten(), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(size), "n_known": pa.array(np.add.reduceat((count > 0)[stream].astype(np.int64), cut)), "train_tokens": pa.array(np.full(docs, n.tokens, np.int64)), "base_score": pa.array(np.add.reduceat(base[stream], cut)), "score": pa.array(score), "perplexity": pa.array(10 ** (-score / size))})
        del rows, rest, log, stream
        trim()
        return out

    rows = texts.unionByName(returned.withColumn("ids", F.lit(None).cast(f"array<{kind}>")))
    return rows.groupBy("chunk").applyInArrow(finish, f"{id_col} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
