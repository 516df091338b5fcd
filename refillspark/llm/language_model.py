"""Language model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) P(word | class, context). A word's class is a hash of its last
two code points. Features of a context are the word before, the two before, and the words two and
three before (skips), hashed to rows of weights. Within a class every known word is a leaf of a
Huffman tree by counts, and each fork of its path has weights by the word before; one more leaf stands for
all other words of the class, unknown ones as one, which share it by their counts. So all words
together have probability 1, and without weights each has what its count gives it.

Tasks take gradient steps over their shares of the corpus, and after each round their weights are
averaged, each row by how often a task saw its feature.
"""

from __future__ import annotations

import copy
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship_package, slices, stored
from .learning import shared

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The token after the last word; no word has white space in it.
_END = b"\n"
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_ODD, _CLIP = np.uint32(0x9E3779B1), 6.0
#: Tokens that are scored together, and words of a task's memo.
_STEP, _MEMO = 16384, 400_000
#: Parts in which tasks hand over a table of weights.
_BLOCKS = 32


def tokens(text: str | None) -> list[bytes]:
    """Words of a text (null: none), A-Z in lower case, and the end."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes are split at \x20 and \x09-\x0D
    words.append(_END)
    return words


def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, as ``tokens`` has them without the ends, and how many each text has."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(texts)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    # A text without words is split into one empty word.
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        words, sizes = words.filter(pc.greater(pc.binary_length(words), 0)), np.where(empty, 0, sizes)
    return words.dictionary_encode(), sizes


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:] if word.isascii() else word.decode()[-2:].encode()) % classes


def _class_column(word: str, classes: int) -> Column:
    return F.pmod(F.crc32(F.right(F.col(word), F.lit(2)).cast("binary")), F.lit(classes)).cast("int")


@dataclass
class Shape:
    """Classes (even), words of a class's tree (None: all known ones), the bits of a feature's row, and those of a fork's."""

    classes: int = 16
    heads: int | None = None
    bits: int = 14
    fork_bits: int = 20


def _tree(masses: list[float], first: int) -> tuple[list[tuple[list[int], list[int]]], list[float]]:
    """Of each leaf of a Huffman tree its forks, numbered from ``first``, and the sides taken (1 or 0); of each fork the log odds of side 1."""
    heap = [(m, i) for i, m in enumerate(masses)]
    heapq.heapify(heap)
    up: list[tuple[int, int]] = [(-1, 0)] * (2 * len(masses) - 1)
    odds: list[float] = []
    while len(heap) > 1:
        (a, i), (b, k) = heapq.heappop(heap), heapq.heappop(heap)
        fork = len(masses) + len(odds)
        up[i], up[k] = (fork, 0), (fork, 1)
        odds.append(float(np.log(b / a)))
        heapq.heappush(heap, (a + b, fork))
    paths = []
    for leaf in range(len(masses)):
        forks, sides = [], []
        at, side = up[leaf]
        while at >= 0:
            forks.append(first + at - len(masses))
            sides.append(side)
            at, side = up[at]
        paths.append((forks, sides))
    return paths, odds


class Model:
    """Counts of the corpus that the model starts from, and its weights.

    ``known`` has ``(word, n)`` of the most frequent words, n their tokens in training; ``mass`` the
    sum of n + 1 over each class's words and its unknown one.
    """

    def __init__(self, shape: Shape, known: list[tuple[bytes, int]], mass: np.ndarray):
        if shape.classes % 2:
            raise ValueError("classes have to be even")
        self.shape, self.known, self.mass = shape, known, mass
        # Leaves: the known words of each class, the frequent ones first, then one a class for all its other words.
        leaf_of: dict[bytes, int] = {}
        own: list[list[tuple[bytes, int]]] = [[] for _ in range(shape.classes)]
        for word, n in sorted(known, key=lambda x: (-x[1], x[0])):
            c = class_of(word, shape.classes)
            if n and (shape.heads is None or len(own[c]) < shape.heads):
                own[c].append((word, n))
        paths, rests, odds, share = [], [], [], []
        for c, words in enumerate(own):
            rest = mass[c] - sum(n + 1 for _, n in words)  # 1 at least, that of the unknown word
            found, more = _tree([*(n + 1.0 for _, n in words), rest], len(odds))
            odds += more
            leaf_of.update((word, len(paths) + i) for i, (word, _) in enumerate(words))
            paths += found[:-1]
            share += [n + 1.0 for _, n in words]
            rests.append((found[-1], rest))
        self.rest_leaf = len(paths)  # that of class 0
        paths += [path for path, _ in rests]
        # Of the known words and, last, of any other one: leaf (-1: its class's last) and count.
        self.names = pa.array([word for word, _ in known], pa.binary()).cast(pa.string())
        self.leaves = np.array([*(leaf_of.get(word, -1) for word, _ in known), -1], dtype=np.int64)
        self.counts = np.array([*(n for _, n in known), -1], dtype=np.int64)
        self.share = np.log([*share, *(m for _, m in rests)])
        self.lengths = np.array([len(forks) for forks, _ in paths], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.forks = np.array([f for forks, _ in paths for f in forks], dtype=np.int32)
        self.sides = np.array([2 * x - 1 for _, sides in paths for x in sides], dtype=np.float32)  # 1 or -1
        self.odds = np.array(odds, dtype=np.float32)
        self.prior = np.log(mass / mass.sum()).astype(np.float32)
        # Weights of features by class, and of features at forks; beside each the sum of squared gradients.
        self.tables = [np.zeros((1 << shape.bits, shape.classes), np.float32), np.zeros((1 << shape.fork_bits, 1), np.float32)]
        self.squares = [np.full_like(t, 0.1) for t in self.tables]


class Words(dict):
    """Words by number: what the model has to know of each lies in arrays."""

    def __init__(self, model: Model, names: pa.Array | None = None):
        super().__init__()
        self.model, self.names = model, pa.array([], pa.string()) if names is None else names
        self.columns = self._looked_up(self.names)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        more = pa.array([word.decode()])
        self.names = pa.concat_arrays([self.names, more])
        self.columns = [np.concatenate(x) for x in zip(self.columns, self._looked_up(more))]
        return number

    def _looked_up(self, names: pa.Array) -> list[np.ndarray]:
        """Hash, class, leaf and count (-1: not among the known) of each word."""
        m = self.model
        data = np.frombuffer(b"".join(names.cast(pa.binary()).to_pylist()), np.uint8).astype(np.uint64)
        lengths = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        powers = np.cumprod(np.full(int(lengths.max(initial=0)), _MIX[0]))
        hashes = np.add.reduceat((data + np.uint64(1)) * powers.take(np.arange(len(data)) - np.repeat(starts, lengths)), starts) if len(names) else np.zeros(0, np.uint64)
        tails = pc.utf8_slice_codeunits(names, start=-2).dictionary_encode()
        of_tail = np.array([class_of(t.encode(), m.shape.classes) for t in tails.dictionary.to_pylist()], dtype=np.int64)
        classes = of_tail.take(tails.indices.to_numpy(zero_copy_only=False)) if len(names) else np.zeros(0, np.int64)
        at = pc.fill_null(pc.index_in(names, value_set=m.names), len(m.names)).to_numpy(zero_copy_only=False)
        leaves = m.leaves.take(at)
        return [hashes, classes, np.where(leaves < 0, m.rest_leaf + classes, leaves), m.counts.take(at)]


def _contexts(hashes: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Hashed features of each token: word before, two before, skip of one, skip of two; 0 stands before a text."""
    before = []
    for k in (1, 2, 3):
        b = np.zeros_like(hashes)
        b[k:] = hashes[:-k]
        b[places < k] = 0
        before.append(b)
    one, two, three = before
    return [one * _MIX[0] + np.uint64(1), (one * _MIX[1] ^ (two * _MIX[2] + np.uint64(7))) * _MIX[3], two * _MIX[4] + np.uint64(3), three * _MIX[5] + np.uint64(5)]


def _rows(feature: np.ndarray, bits: int) -> np.ndarray:
    return (((feature ^ (feature >> np.uint64(32))) * _MIX[1]) >> np.uint64(64 - bits)).astype(np.int32)


#: Of the features the one that also speaks at forks: the word before.
_WITHIN = 0


class Steps:
    """One pass over texts: log probabilities, and gradient steps if asked for."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words(model)
        self.ones = np.ones(model.shape.classes, np.float32)
        self.fork_keys = (np.arange(1, len(model.odds) + 1, dtype=np.uint64) * _MIX[2] >> np.uint64(32)).astype(np.uint32)

    def encoded(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the tokens of all texts, their places in their texts, and the texts' lengths."""
        words, sizes = split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        self.words = Words(self.model, pa.concat_arrays([words.dictionary, pa.array([_END.decode()])]))
        sizes = sizes + 1
        ends = np.cumsum(sizes)
        numbers = np.full(sizes.sum(), len(words.dictionary))
        is_word = np.ones(len(numbers), dtype=bool)
        is_word[ends - 1] = False
        numbers[is_word] = words.indices.to_numpy(zero_copy_only=False)
        places = np.arange(len(numbers)) - np.repeat(ends - sizes, sizes)
        return numbers, places, sizes

    def run(self, numbers: np.ndarray, places: np.ndarray, rate: float = 0.0, seen: list[np.ndarray] | None = None) -> np.ndarray:
        """Of each token the natural log probability less log(n + 1); with a ``rate`` the weights move along the gradient.

        ``seen`` counts, for each table, how often each row was used.
        """
        m = self.model
        hashes, classes, leaves, _ = self.words.columns
        features = _contexts(hashes[numbers], places)
        out, forked = np.zeros(len(numbers)), []
        by_class, by_fork = m.tables[0], m.tables[1][:, 0]
        for a in range(0, len(numbers), _STEP):
            part = slice(a, a + _STEP)
            own, leaf = classes[numbers[part]], leaves[numbers[part]]
            at = np.arange(len(own))
            rows = [_rows(f[part], m.shape.bits) for f in features]
            chances = by_class.take(rows[0], axis=0)
            for r in rows[1:]:
                chances += by_class.take(r, axis=0)
            chances += m.prior
            said = chances[at, own]
            np.exp(chances, out=chances)
            total = chances @ self.ones
            # The forks of all tokens, one after the other; the log odds of the side that was taken.
            lengths = m.lengths[leaf]
            ends = np.cumsum(lengths)
            token = np.repeat(at, lengths)
            place = (m.starts[leaf] - ends + lengths).take(token)
            place += np.arange(len(place))
            forks = m.forks.take(place)
            keys, sides = self.fork_keys.take(forks), m.sides.take(place)
            within = self._fork_rows(features[_WITHIN][part], token, keys)
            odds = m.odds.take(forks)
            odds += by_fork.take(within)
            odds *= sides
            missed = np.exp(-odds)
            taken = missed + np.float32(1)
            sums = np.concatenate([[0.0], np.cumsum(np.log(taken), dtype=np.float64)])
            out[part] = said - np.log(total) - (sums[ends] - sums[ends - lengths]) - m.share[leaf]
            if rate:
                chances /= -total[:, None]
                chances[at, own] += 1
                for r in rows:
                    self._move(r, chances, rate, seen)
                missed /= taken
                missed *= sides
                forked.append(within)
                self._move_forks(within, missed, rate)
        if seen is not None and forked:
            seen[1] += np.bincount(np.concatenate(forked), minlength=len(seen[1]))
        return out

    def _fork_rows(self, feature: np.ndarray, token: np.ndarray, keys: np.ndarray) -> np.ndarray:
        mixed = ((feature ^ (feature >> np.uint64(32))) * _MIX[1] >> np.uint64(32)).astype(np.uint32).take(token)
        mixed ^= keys
        mixed *= _ODD
        mixed >>= np.uint32(32 - self.model.shape.fork_bits)
        return mixed.astype(np.intp)

    def _move_forks(self, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
        # A row that comes several times is set to the same value each time.
        squares, table = self.model.squares[1][:, 0], self.model.tables[1][:, 0]
        sums = np.bincount(rows, gradient, len(table)).take(rows).astype(np.float32)
        new = squares.take(rows)
        new += sums * sums
        squares[rows] = new
        sums *= np.float32(rate)
        sums /= np.sqrt(new, out=new)
        sums += table.take(rows)
        table[rows] = np.clip(sums, -_CLIP, _CLIP, out=sums)

    def _move(self, rows: np.ndarray, gradient: np.ndarray, rate: float, seen: list[np.ndarray] | None) -> None:
        order = np.argsort(rows.astype(np.uint16) if self.model.shape.bits <= 16 else rows, kind="stable")
        ordered = rows[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        # Two columns add up as one complex number: numpy takes half the steps.
        at, sums = ordered[starts], np.add.reduceat(gradient.view(np.complex64).take(order, axis=0), starts, axis=0).view(np.float32)
        table, squares = self.model.tables[0], self.model.squares[0]
        new = squares.take(at, axis=0) + sums * sums
        squares[at] = new
        table[at] = np.clip(table.take(at, axis=0) + rate * sums / np.sqrt(new), -_CLIP, _CLIP)
        if seen is not None:
            seen[0][at] += np.diff(np.append(starts, len(rows)))


def _pieces(model: Model, seen: list[np.ndarray]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """What a task hands over: of each block of rows its use, its weights times that, and its new squares."""
    for table in (0, 1):
        step = max(1, len(seen[table]) // _BLOCKS)
        for b, a in enumerate(range(0, len(seen[table]), step)):
            part = slice(a, a + step)
            n = seen[table][part].astype(np.float32)
            if n.any():
                yield 2 * b + table, n.tobytes(), (model.tables[table][part] * n[:, None]).tobytes(), (model.squares[table][part] - np.float32(0.1)).tobytes()


_PIECE = "block int, seen binary, weights binary, squares binary"


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["block", "seen", "weights", "squares"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pieces by block, one after the other: no more memory than the model takes, whatever the number of tasks."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            new = [np.frombuffer(row[c], np.float32).astype(np.float64) for c in ("seen", "weights", "squares")]
            old = sums.setdefault(row["block"], new)
            if old is not new:
                for o, x in zip(old, new):
                    o += x
    for block, parts in sums.items():
        yield _record([(block, *(p.astype(np.float32).tobytes() for p in parts))])


def _trained(rows: DataFrame, model: Model, rate: float, tasks: int, slice_bytes: int) -> Model:
    """The model after one round over ``rows (text)``."""
    given = shared(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = given.value
        own = copy.copy(base)
        own.tables = [t.copy() for t in base.tables]
        first = [s.copy() for s in base.squares]
        own.squares = [s.copy() for s in first]
        steps, seen = Steps(own), [np.zeros(len(t), dtype=np.int64) for t in own.tables]
        for batch in slices(batches, "text", slice_bytes):
            numbers, places, _ = steps.encoded(batch.column("text"))
            steps.run(numbers, places, rate, seen)
        own.squares = [s - f + np.float32(0.1) for s, f in zip(own.squares, first)]
        for piece in _pieces(own, seen):
            yield _record([piece])

    pieces = map_arrow(rows.coalesce(tasks), run, _PIECE)
    merged = map_arrow(pieces.repartition(2 * _BLOCKS, "block"), _merged, _PIECE)
    for r in merged.toLocalIterator():  # as much as the model
        table = r.block % 2
        step = max(1, len(model.tables[table]) // _BLOCKS)
        part = slice(r.block // 2 * step, (r.block // 2 + 1) * step)
        n = np.frombuffer(r.seen, np.float32)
        wide = model.tables[table].shape[1]
        weights = np.frombuffer(r.weights, np.float32).reshape(-1, wide) / np.maximum(n, 1)[:, None]
        model.tables[table][part] = np.where(n[:, None] > 0, weights, model.tables[table][part])
        model.squares[table][part] += np.frombuffer(r.squares, np.float32).reshape(-1, wide)
    given.unpersist()
    return model


def _counted(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Partial counts ``(word, n, learnt)``; handed over whenever there are many words."""

    def out() -> pa.RecordBatch:
        words = list(counts)
        learnt = [counts[w] - held[w] for w in words]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in words], pa.int64()), pa.array(learnt, pa.int64())], names=["word", "n", "learnt"])

    counts, held = Counter(), Counter()
    for batch in slices(batches, "text", slice_bytes):
        words, sizes = split(batch.column("text"))
        distinct, at = words.dictionary.cast(pa.binary()).to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        counts.update(dict(zip(distinct, np.bincount(at, minlength=len(distinct)).tolist())))
        counts[_END] += len(sizes)
        out_of = ~batch.column("learns").to_numpy(zero_copy_only=False)
        if out_of.any():
            of_held = np.bincount(at[np.repeat(out_of, sizes)], minlength=len(distinct))
            held.update({distinct[i]: int(of_held[i]) for i in np.flatnonzero(of_held)})
            held[_END] += int(out_of.sum())
        if len(counts) > _MEMO:
            yield out()
            counts, held = Counter(), Counter()
    if counts:
        yield out()


def fit(rows: DataFrame, *, shape: Shape, most_known: int, rounds: int, rate: float, share_tokens: int, slice_bytes: int) -> tuple[Model, DataFrame, int, int]:
    """The model of ``rows (id, text, fold, learns)``, the words' counts ``(word, n, learnt)``, N and V."""
    spark = rows.sparkSession
    counts = map_arrow(rows.select("text", "learns"), partial(_counted, slice_bytes=slice_bytes), "word string, n long, learnt long")
    counts = stored(counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt")), "words")
    learnt = counts.where("learnt > 0")
    masses = learnt.groupBy(_class_column("word", shape.classes).alias("c")).agg(F.sum(F.col("learnt") + 1).alias("mass"), F.sum("learnt").alias("n"), F.count("*").alias("v")).collect()
    mass = np.ones(shape.classes)
    for r in masses:
        mass[r.c] += r.mass
    n_tokens, n_words = sum(r.n for r in masses), sum(r.v for r in masses)
    # The most frequent words, by levels of their logarithm: at most most_known of them.
    level = F.floor(F.log2("n") * 16).cast("int")
    least, room = None, most_known
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        room -= r["count"]
        if room < 0:
            break
        least = r.level
    known = [] if least is None else [(r.word.encode(), r.learnt) for r in counts.where(level >= least).select("word", "learnt").collect()]
    model = Model(shape, known, mass)
    tasks = max(spark.sparkContext.defaultParallelism, n_tokens // share_tokens)
    for i in range(rounds):
        part = rows.where(F.col("learns") & (F.pmod(F.floor(F.col("fold") / 7), F.lit(rounds)) == i)).select("text")
        model = _trained(part, model, rate, tasks, slice_bytes)
    return model, counts, n_tokens, n_words


def language_model_scores(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    held_fold: int = 2,
    shape: Shape | None = None,
    most_known: int = 65_536,
    rounds: int = 2,
    rate: float = 0.15,
    share_tokens: int = 8_000_000,
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    Tokens are the words of the text with A-Z in lower case, and one end. Rows whose ``crc32(id as
    text) mod folds`` is ``held_fold`` are held out; all others are learnt from, each in one of
    ``rounds``, and all count. ``base_score`` is the sum over tokens of log10((c + 1) / (N + V + 1)),
    c the token's count, N all tokens and V the distinct ones of the rows learnt from; ``n_known``
    counts tokens with c > 0 and ``train_tokens`` is N. ``score`` is the model's log10 probability.

    Null texts count as empty: one end. Null ids are neither held out nor learnt from; repeated rows
    are rows like others. Without rows to learn from every class is as likely as any other. The
    ``most_known`` most frequent words and the weights, whose sizes don't depend on the input, are
    broadcast; counts of the other words are joined, and none of these is frequent. A task of a
    round takes about ``share_tokens`` tokens. Tasks hold a text, its tokens and the weights.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shape = shape or Shape()
    fold = F.crc32(F.col(id_col).cast("string").cast("binary"))
    held = F.pmod(fold, F.lit(folds)) == held_fold
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), fold.alias("fold"), F.coalesce(held, F.lit(False)).alias("held_out"), F.coalesce(~held, F.lit(False)).alias("learns"))
    model, counts, n_tokens, n_words = fit(rows, shape=shape, most_known=most_known, rounds=rounds, rate=rate, share_tokens=share_tokens, slice_bytes=slice_bytes)
    given = shared(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps(given.value)
        for batch in slices(batches, "text", slice_bytes):
            numbers, places, sizes = steps.encoded(batch.column("text"))
            logs = steps.run(numbers, places)
            counts = steps.words.columns[3][numbers]
            known = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + 1.0), 0.0)
            starts = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, starts) for x in (logs / np.log(10), known, (counts > 0).astype(np.int64))]
            # The other words of each text, and how often it has them.
            texts = np.repeat(np.arange(len(sizes)), sizes)
            rest, times = np.unique((texts * len(steps.words.names) + numbers)[counts < 0], return_counts=True)
            of_text, of_word = np.divmod(rest, len(steps.words.names))
            names = steps.words.names.take(pa.array(of_word))
            ends = pa.array(np.searchsorted(of_text, np.arange(len(sizes) + 1)).astype(np.int32))
            arrays = [batch.column("id"), batch.column("held_out"), pa.array(sizes), pa.array(sums[2]), pa.array(sums[1]), pa.array(sums[0]), pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(times))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "held_out", "n_tokens", "n_known", "known", "logs", "words", "times"])

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = map_arrow(rows.select("id", "text", "held_out"), run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, known double, logs double, words array<string>, times array<bigint>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    entries = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("e")).select("row", F.col("e.words").alias("word"), F.col("e.times").alias("times"))
    joined = entries.join(counts.where("learnt > 0").select("word", "learnt"), "word")
    rest = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("learnt") + 1.0)).alias("rest"), F.sum("times").alias("rest_known"))
    out = scored.drop("words", "times").join(rest, "row", "left").withColumn("all", F.col("known") + F.coalesce("rest", F.lit(0.0)))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("all") - F.col("n_tokens") * float(np.log10(n_tokens + n_words + 1))).alias("base_score"), (F.col("all") + F.col("logs")).alias("score"),
    )
