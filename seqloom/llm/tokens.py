"""Token counts: pieces are counted once per distinct pre-token of the corpus, joined to documents' pre-token
frequencies, and summed; no ids are kept.

Frequencies are kept by chunk, some documents each: a chunk has a list of its distinct pre-tokens and, for each of its
documents, their places in that list and how often they occur. Entries of all lists meet by pre-token, where each
distinct one is cut into pieces once; the counts join the frequencies of their chunks, which add up their documents.
"""
from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, materialize_by
from .textkit import pack, slices, trim, unpack

# The byte-level pre-tokenizer's pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these code points the library itself cuts a text, as Unicode tables of two libraries can differ.
_PLAIN = regex.compile(r"[\x00-ɏ‐-‧]*")
#: A space before which any text can be cut without changing its pre-tokens: between a letter and a letter.
_SAFE = regex.compile(r"(?<=[a-zA-Z])(?= [a-zA-Z])")


def _load(tokenizer_json: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_level(spec: dict) -> bool:
    """Whether the pre-tokenizer is the plain byte-level one, whose pre-tokens are pieces of the text itself."""
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")


class Cutter:
    """Cuts texts into pre-tokens, and special strings out of them before that."""

    def __init__(self, tokenizer_json: str, part: int = 1 << 20):
        spec = json.loads(tokenizer_json)
        if not spec.get("pre_tokenizer"):
            raise ValueError("this tokenizer has no pre-tokenizer, so its pieces cannot be counted by pre-token")
        self.tok, self.plain, self.part = _load(tokenizer_json), byte_level(spec), part
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PRE_TOKEN)

    def _cut(self, text: str) -> list[str]:
        if not self.plain:
            text = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
            return [x for x, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        if _PLAIN.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def _parts(self, text: str) -> Iterator[str]:
        """A very long text in parts whose pre-tokens are its own."""
        at = 0
        while self.plain and len(text) - at > self.part and (m := _SAFE.search(text, at + self.part)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def cut(self, text: str) -> tuple[Iterator[list[str]], int]:
        """(lists of pre-tokens, number of special strings) of a text."""
        found = len(self.special.findall(text)) if self.special else 0
        rest = self.special.split(text) if found else [text]
        return (self._cut(part) for own in rest for part in self._parts(own)), found


def piece_counts(tok, plain: bool, pre_tokens: list[str]) -> np.ndarray:
    """Number of pieces of each distinct pre-token."""
    if plain:
        return np.fromiter(map(len, tok.encode_batch(pre_tokens, add_special_tokens=False)), np.int64, len(pre_tokens))
    return np.fromiter((len(tok.model.tokenize(x)) for x in pre_tokens), np.int64, len(pre_tokens))


def _frequencies(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (document << 32 | place) and their counts."""
    if n is None:
        return np.unique(key, return_counts=True)
    own, inverse = np.unique(key, return_inverse=True)
    return own, np.bincount(inverse, n, own.size).astype(np.int64)


class Chunk:
    """Frequencies of pre-tokens in some documents."""

    def __init__(self, most: int = 200_000):
        self.ids, self.n_bytes, self.special, self.bytes, self.most = [], [], [], 0, most
        self.words, self.keys, self.counts = [], [], []
        self._flat, self._doc, self._len = [], [], []

    def add(self, ids: pa.Array, texts: list[str], cutter: Cutter) -> None:
        self.ids.append(ids)
        for t in texts:
            size, (parts, found) = len(t.encode()), cutter.cut(t)
            for own in parts:
                self._flat += own
                self._doc.append(len(self.n_bytes))
                self._len.append(len(own))
                if len(self._flat) > self.most:
                    self._settle()
            self.n_bytes.append(size)
            self.special.append(found)
            self.bytes += size

    def _settle(self) -> None:
        if self._flat:
            coded = pa.array(self._flat, pa.string()).dictionary_encode()
            key = np.repeat(np.array(self._doc, np.int64), self._len) << 32 | coded.indices.to_numpy()
            own, n = _frequencies(key)
            self.words.append(coded.dictionary)
            self.keys.append(own)
            self.counts.append(n)
        self._flat, self._doc, self._len = [], [], []

    def row(self) -> tuple:
        """(documents, entries, entries by document, places, counts, pre-tokens)."""
        self._settle()
        base, every = np.cumsum([0, *map(len, self.words)]), pa.concat_arrays([pa.array([], pa.string()), *self.words]).dictionary_encode()
        place = every.indices.to_numpy().astype(np.int64)
        keys = [k & ~np.int64(0xFFFFFFFF) | place[b + (k & 0xFFFFFFFF)] for b, k in zip(base, self.keys)]
        none = np.zeros(0, np.int64)
        own, n = _frequencies(np.concatenate([none, *keys]), np.concatenate([none, *self.counts]))
        size = np.bincount(own >> 32, minlength=len(self.n_bytes))
        return size.size, own.size, pack(size.astype(np.uint32)), _pack_places(own & 0xFFFFFFFF, size), pack(n.astype(np.uint32)), every.dictionary


def _pack_places(place: np.ndarray, size: np.ndarray) -> bytes:
    """Places rise within a document, so steps are packed; each document starts anew."""
    step = np.diff(place, prepend=0)
    first = (np.cumsum(size) - size)[size > 0]
    step[first] = place[first]
    return pack(step.astype(np.uint32))


def _unpack_places(b: bytes, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(unpack(b, np.uint32, int(size.sum())).astype(np.int64))
    own = np.cumsum(size) - size
    before = np.where(own > 0, total[np.maximum(own, 1) - 1], 0) if total.size else own
    return total - np.repeat(before, size)


#: Of rows of chunks: list of distinct pre-tokens, or frequencies.
WORDS, DOCUMENTS = 0, 1


def cut_chunks(df: DataFrame, tokenizer_json: str, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Two rows a chunk: ``kind, chunk, words``, and ``kind, chunk, ids, n_bytes, special, n, m, size, place, count``."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)  # one file of fixed size
    kind = dict(df.dtypes)[id_col]
    schema = f"kind int, chunk long, words array<string>, ids array<{kind}>, n_bytes array<long>, special array<long>, n long, m long, size binary, place binary, count binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        def emit(c: Chunk):
            n, m, size, place, count, words = c.row()
            two = lambda values, first: pa.ListArray.from_arrays(pa.array([0, len(values) * first, len(values)], pa.int32()), values)
            number, ids = uuid.uuid4().int >> 65, pa.concat_arrays(c.ids)
            lists = [two(words, 1), two(ids, 0), two(pa.array(c.n_bytes, pa.int64()), 0), two(pa.array(c.special, pa.int64()), 0)]
            cols = [pa.array([WORDS, DOCUMENTS], pa.int32()), pa.array([number] * 2), *lists, *(pa.array([0, x], pa.int64()) for x in (n, m)), *(pa.array([b"", x], pa.binary()) for x in (size, place, count))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        cutter, chunk = Cutter(shared.value), Chunk()
        for b in slices(batches, "t"):
            chunk.add(b.column("i"), [x or "" for x in b.column("t").to_pylist()], cutter)
            if chunk.bytes >= chunk_bytes:
                yield emit(chunk)
                chunk = Chunk()
        if chunk.ids:
            yield emit(chunk)
        del chunk
        trim()

    rows = df.select(df[id_col].alias("i"), df[text_col].cast("string").alias("t"))
    return rows.mapInArrow(run, schema)


def sorted_pieces(batches: Iterator[list[str]], count) -> Iterator[np.ndarray]:
    """Pieces of each word of batches that come in order of words; ``count`` gets each distinct word once."""
    last, pieces = None, 0
    for own in batches:
        coded = pa.array(own, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        known = bool(distinct) and distinct[0] == last
        n = np.concatenate([[pieces][: int(known)], count(distinct[int(known) :])]).astype(np.int64)
        if distinct:
            last, pieces = distinct[-1], int(n[-1])
        yield n[coded.indices.to_numpy()]


def count_pieces(words: DataFrame, tokenizer_json: str) -> DataFrame:
    """``home, k, pieces`` of ``words(home, k, word)``: equal pre-tokens of all chunks meet and are cut into pieces once."""
    shared = words.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches):
        tok, plain = _load(shared.value), byte_level(json.loads(shared.value))
        kept = []

        def texts():
            for b in slices(batches, "word"):
                kept.append(b)
                yield b.column("word").to_pylist()

        for n in sorted_pieces(texts(), lambda own: piece_counts(tok, plain, own)):
            b = kept.pop()
            yield pa.RecordBatch.from_arrays([b.column("home"), b.column("k"), pa.array(n.astype(np.int32))], names=["home", "k", "pieces"])

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, "home long, k int, pieces int")


def count_tokens(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, chunk_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null texts are empty (0 tokens); texts are counted whole, very long ones in parts; repeated rows count alike; an
    empty table gives an empty table; other columns are ignored. Special strings in a text count as the library's
    default has it. A tokenizer without a pre-tokenizer is an error. A chunk has about ``chunk_bytes`` of text.
    """
    lists, chunks = materialize_by(cut_chunks(df, tokenizer_json, id_col, text_col, chunk_bytes), "token-chunks", "kind", [WORDS, DOCUMENTS])
    words = lists.select(F.col("chunk").alias("home"), F.posexplode("words").alias("k", "word"))
    found = materialize(count_pieces(words, tokenizer_json), "token-pieces")
    discard(lists)
    kind = dict(df.dtypes)[id_col]

    def add(own: pa.Table, found: pa.Table) -> pa.Table:
        r = own.drop_columns("ids").to_pylist()[0]
        ids = own.column("ids").combine_chunks().flatten()
        pieces = np.zeros(found.num_rows, np.int64)
        pieces[found.column("k").to_numpy()] = found.column("pieces").to_numpy()
        size = unpack(r["size"], np.uint32, r["n"]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(pieces[_unpack_places(r["place"], size)] * unpack(r["count"], np.uint32, r["m"]).astype(np.int64))])
        n = np.array(r["special"], np.int64) + total[np.cumsum(size)] - total[np.cumsum(size) - size]
        trim()
        return pa.table({id_col: ids, "n_bytes": pa.array(r["n_bytes"], pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    rows = chunks.drop("words").groupBy("chunk").cogroup(found.groupBy("home"))
    return rows.applyInArrow(add, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
