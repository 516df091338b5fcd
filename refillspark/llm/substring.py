"""Substring dedup by recompression.

Every round of the parse names maximal runs of a symbol and then pairs of neighbours, a left one and
a right one by a bit of its name. Names are keyed hashes, so all tasks give equal symbols equal names
without an exchange. A symbol's name and place depend on a few words around it only; wherever these
words occur, the same symbol stands inside. Each window of words is filed under one
symbol of the highest round that its own words decide, the one with the least name; neighbouring
windows mostly share it. One Spark round finds the symbols that more than one part of the corpus
has, a second compares the windows that are filed under them (128-bit names of all their words), and
the documents get back which of their windows also start earlier.
"""

from __future__ import annotations

import hashlib
from functools import cached_property, lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package

_ROUNDS = 2
_FAR = np.int64(1) << 60
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd number and of its inverse, mod 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grown(self, n: int) -> _Powers:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n + n // 4, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))
        return self


@lru_cache(maxsize=1)
def _powers() -> list[_Powers]:
    """The bases of two independent names of word sequences."""
    rng = np.random.Generator(np.random.PCG64(20))
    return [_Powers(int(rng.integers(1, 1 << 62)) * 2 + 1) for _ in range(2)]


#: Keys of the two hashes of a word's bytes.
_WORD_KEYS = ("recompression one", "recompression two")


def _word_digests(words: np.ndarray) -> np.ndarray:
    """A row of two 64-bit numbers for each word: SipHash of its bytes by two keys of 16 bytes."""
    return np.stack([hash_array(words, hash_key=key[-16:], categorize=False) for key in _WORD_KEYS], axis=1)


def _least(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each range, the place of its least value (the first of them)."""
    best = [np.arange(len(values))]
    reach = np.frexp(end - start)[1] - 1  # floor(log2(length))
    for j in range(int(reach.max(initial=0))):
        a, b = best[-1][: -(1 << j)], best[-1][1 << j :]
        best.append(np.where(values[b] < values[a], b, a))
    out = np.empty(len(start), dtype=np.int64)
    for j, table in enumerate(best):
        own = np.flatnonzero(reach == j)
        a, b = table[start[own]], table[end[own] - (1 << j)]
        out[own] = np.where(values[b] < values[a], b, a)
    return out


class Chunk:
    """The words of some documents in a fixed order, and names of what they hold."""

    def __init__(self, ids: list[int | None], texts: list[str | None], window: int):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids = [ids[i] for i in order]
        self.texts = [(texts[i] or "").encode() for i in order]
        # Rows with one id are ordered by their texts: the copy number tells them apart. Rows without
        # an id lie in several chunks; a number from the text orders them, and equal texts meet here.
        self.copies = [0] * len(order)
        for i in range(len(order)):
            if self.ids[i] is None:
                self.copies[i] = int.from_bytes(hashlib.blake2b(self.texts[i], digest_size=8).digest(), "little", signed=True)
            elif i and self.ids[i] == self.ids[i - 1]:
                self.copies[i] = self.copies[i - 1] + 1
        self.window = window
        data = np.frombuffer(b" ".join(self.texts) + b" ", dtype=np.uint8)
        space = _SPACE[data]
        before = np.concatenate([[True], space[:-1]])
        self.data = data
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(space & ~before)
        text_ends = np.cumsum([len(t) + 1 for t in self.texts])
        self.doc_ends = np.searchsorted(self.starts, text_ends)  # words before the end of each document
        self.doc = np.repeat(np.arange(len(order)), np.diff(self.doc_ends, prepend=0))
        self.last = self.doc_ends[self.doc]  # of each word, the end of its document
        self.windows = np.flatnonzero(np.arange(len(self.starts)) + window <= self.last)

    @cached_property
    def word_names(self) -> np.ndarray:
        """Both names of each word."""
        lengths = self.ends - self.starts
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        bare = self.data[~_SPACE[self.data]]  # words without what separates them
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(bare)]).dictionary_encode()
        return _word_digests(words.dictionary.to_numpy(zero_copy_only=False))[words.indices.to_numpy()] if len(lengths) else np.zeros((0, 2), np.uint64)

    def span_names(self, which: int) -> SpanNames:
        return SpanNames(np.ascontiguousarray(self.word_names[:, which]), _powers()[which])

    def filed(self, spans: SpanNames) -> tuple[np.ndarray, np.ndarray]:
        """Of each window, the name it is filed under and the word where that begins."""
        n, size = len(self.windows), self.window
        key, at = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
        name = spans.words
        start = np.arange(len(name), dtype=np.int64)
        end = start + 1
        low, high = start, end  # the words that decide a symbol
        doc = self.doc
        for level in range(1, _ROUNDS + 1):
            # Runs. Whether one ends where it does is up to the symbols beside it, or to the document's end.
            same = np.concatenate([[False], (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])]) if len(name) else np.zeros(0, bool)
            first = np.flatnonzero(~same)
            last = np.concatenate([first[1:], [len(name)]]) - 1 if len(name) else first
            length = last - first + 1
            name_r = np.where(length == 1, name[first], _mix(name[first] + length.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
            has_left = np.concatenate([[False], doc[first[1:]] == doc[last[:-1]]]) if len(first) else np.zeros(0, bool)
            has_right = np.concatenate([has_left[1:], [False]]) if len(first) else has_left
            low_r = np.where(has_left, low[np.maximum(first - 1, 0)], -_FAR)
            high_r = np.where(has_right, high[np.minimum(last + 1, max(len(name) - 1, 0))], _FAR)
            name, start, end, low, high, doc = name_r, start[first], end[last], low_r, high_r, doc[first]
            # Pairs of a left symbol and a right one.
            right = (_mix(name + _U(level)) & _U(1)).astype(bool)
            follows = np.concatenate([doc[1:] == doc[:-1], [False]]) if len(doc) else np.zeros(0, bool)
            opens = follows & ~right & np.concatenate([right[1:], [False]]) if len(doc) else follows
            closes = np.concatenate([[False], opens[:-1]]) if len(doc) else opens
            left_of = np.concatenate([[-_FAR], low[:-1]]) if len(doc) else low
            right_of = np.concatenate([high[1:], [_FAR]]) if len(doc) else high
            left_of = np.where(np.concatenate([[False], follows[:-1]]) if len(doc) else follows, left_of, -_FAR)
            right_of = np.where(follows, right_of, _FAR)
            low_p = np.where(right & ~closes, left_of, low)
            high_p = np.where(opens, right_of, np.where(~right, right_of, high))
            keep = ~closes
            next_name = np.concatenate([name[1:], np.zeros(1, np.uint64)]) if len(name) else name
            next_end = np.concatenate([end[1:], np.zeros(1, np.int64)]) if len(end) else end
            name_p = np.where(opens, _mix(_mix(name) + next_name * _U(0xD6E8FEB86659FD93) + _U(level)), name)
            end_p = np.where(opens, next_end, end)
            name, start, end, low, high, doc = name_p[keep], start[keep], end_p[keep], low_p[keep], high_p[keep], doc[keep]
            usable = (low > -_FAR) & (high < _FAR) & (high - low <= size)
            lows, highs = low[usable], high[usable]
            if len(lows) == 0:
                continue
            names = spans(lows, highs) + _U(level)
            left, beyond = np.searchsorted(lows, self.windows), np.searchsorted(highs, self.windows + size, side="right")
            fits = np.flatnonzero(beyond > left)
            k = _least(_mix(names), left[fits], beyond[fits])
            key[fits], at[fits] = names[k], lows[k]
        rest = at < 0  # no symbol is decided within: filed under all of its words
        key[rest] = spans(self.windows[rest], self.windows[rest] + size)
        at[rest] = self.windows[rest]
        return key, at

    def local_firsts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both names of each window, and the place of the first equal window in this chunk."""
        one, two = (self.span_names(i)(self.windows, self.windows + self.window) for i in range(2))
        order = np.lexsort((two, one))
        differs = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]) if len(order) else np.zeros(0, bool)
        first = np.empty(len(order), dtype=np.int64)
        first[order] = order[np.flatnonzero(differs)][np.cumsum(differs) - 1] if len(order) else order
        return one, two, first


class SpanNames:
    """Names of word sequences, from prefix sums of digests that are spread by powers of an odd base.

    For so few words as a window has, sums of differing digests hardly cancel, whatever their order;
    windows are equal where two independent names are.
    """

    def __init__(self, words: np.ndarray, powers: _Powers):
        self.words = words
        self.powers = powers.grown(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers.up[: len(words)])])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.powers.down[start] + (end - start).astype(np.uint64))


def _chunk(table: pa.Table, window: int) -> Chunk:
    return Chunk(table.column("id").to_pylist(), table.column("text").to_pylist(), window)


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, chunk_bytes: int = 1 << 20, keep_text: bool = False
) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256)`` of every document, with ``keep_text`` also ``kept``.

    A word goes if a window of ``window`` consecutive words covers it whose word sequence also
    starts earlier: in a document with a smaller id, or earlier in the same one. All windows are
    judged on the input. Null texts have no words. Documents with a null id come after all others
    (ordered among themselves by a digest of the text); rows that share an id are ordered by text, and equal ones
    count as one after the other. Other columns are not read.

    Documents are dealt into chunks of about ``chunk_bytes`` by their ids, those without one by
    their texts. What a chunk repeats
    within itself is settled there, so that a passage that many documents share reaches the
    shuffle once a chunk.
    """
    spark = docs.sparkSession
    ship_package(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-n_bytes // chunk_bytes))
    dealt = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    rows = rows.withColumn("chunk", F.pmod(dealt, F.lit(n_chunks)).cast("long"))

    def anchors(table: pa.Table) -> pa.Table:
        chunk = _chunk(table, window)
        keys = np.unique(chunk.filed(chunk.span_names(0))[0]).view(np.int64)
        return pa.table({"key": keys, "chunk": np.full(len(keys), table.column("chunk")[0].as_py(), np.int64)})

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _chunk(left, window)
        key, _ = chunk.filed(chunk.span_names(0))
        shared = np.isin(key, right.column("key").to_numpy().view(np.uint64))
        one, two, first = chunk.local_firsts()
        at = np.flatnonzero(shared & (first == np.arange(len(first))))
        doc = chunk.doc[chunk.windows[at]].tolist()
        return pa.table(
            {
                "one": one[at].view(np.int64),
                "two": two[at].view(np.int64),
                "chunk": np.full(len(at), left.column("chunk")[0].as_py() if left.num_rows else 0, np.int64),
                "id": pa.array([chunk.ids[d] for d in doc], left.schema.field("id").type),
                "copy": pa.array([chunk.copies[d] for d in doc], pa.int64()),
                "at": at.astype(np.int32),
            }
        )

    def kept(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _chunk(left, window)
        _, _, first = chunk.local_firsts()
        again = first != np.arange(len(first))
        again[right.column("at").to_numpy()] = True
        again |= again[first]
        cover = np.zeros(len(chunk.starts) + window + 1, dtype=np.int64)
        np.add.at(cover, chunk.windows[again], 1)
        np.add.at(cover, chunk.windows[again] + window, -1)
        stays = np.cumsum(cover)[: len(chunk.starts)] == 0
        n_words, n_removed, digests, texts = [], [], [], []
        start = 0
        for text, end in zip(chunk.texts, chunk.doc_ends.tolist()):
            own = stays[start:end]
            words = text.split()
            left_over = b" ".join(words if own.all() else compress(words, own))
            n_words.append(end - start)
            n_removed.append(int(end - start - own.sum()))
            digests.append(hashlib.sha256(left_over).hexdigest())
            if keep_text:
                texts.append(left_over.decode())
            start = end
        out = {"id": pa.array(chunk.ids, left.schema.field("id").type), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(texts, pa.string())} if keep_text else {}))

    # Keys that more than one chunk has, chunk by chunk.
    keys = rows.groupBy("chunk").applyInArrow(anchors, "key long, chunk long")
    shared = keys.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "chunk")
    shape = f"one long, two long, chunk long, id {id_type}, copy long, at int"
    met = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(candidates, shape)
    order = Window.partitionBy("one", "two").orderBy(F.col("id").asc_nulls_last(), "copy", "at")
    later = met.withColumn("n", F.row_number().over(order)).where("n > 1").select("chunk", "at")
    shape = f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    out = rows.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(kept, shape)
    return out.withColumnRenamed("id", id_col)
