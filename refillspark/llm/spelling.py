"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart are at most one edit apart when
reduced, so each word looks up all one-edit variants of its reduced form among the reduced words;
what meets is verified on the words themselves. Reduced variants are never spelled out: a
polynomial hash of each comes from hashes of the prefixes and suffixes of the reduced word, in
constant time whatever its length.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, spread, stored

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Rows of a batch of keys.
_ROWS = 200_000


def _lowered(run: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does that for ASCII, and faster."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _UPPER.lower()))


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, drop_every: int = 0) -> DataFrame:
    """``(word, n)``: maximal runs of letters of all texts, with at least so many code points and occurrences.

    Letters are A-Z, a-z and U+00C0 to U+00FF; A-Z become lower case. With ``drop_every``, h is the
    crc32 of ``<id>:<run>``, and a run whose h it divides loses its code point h % length. Null
    texts have no words; a null id is an empty one. Counts are combined before the shuffle.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit("[A-Za-z\\u00C0-\\u00FF]+"), F.lit(0))).alias("run")
    )
    words = runs.where(F.length("run") >= least_length).select("id", _lowered(F.col("run")).alias("word"))
    if drop_every:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = F.pmod(F.col("h"), F.length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        words = words.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    for i in range(1, n):
        out[i] = out[i - 1] * _BASE
    return out


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    h = (h ^ np.uint64(length * 0x9E37 + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


class Reduced:
    """Keys of words of one length: of their reduced forms and of these forms' one-edit variants."""

    def __init__(self, words: list[str], symbols: int):
        self.length, self.symbols = len(words[0]), symbols
        # Of each symbol a value for the hash; of each letter its symbol.
        self.values = np.array([zlib.crc32(bytes([a, 1])) << 32 | zlib.crc32(bytes([a, 2])) for a in range(symbols)], dtype=np.uint64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), self.length)
        used, back = np.unique(codes, return_inverse=True)
        kinds = np.array([zlib.crc32(chr(c).encode("utf-8", "surrogatepass")) % symbols for c in used.tolist()], dtype=np.int64)
        self.forms = kinds[back.reshape(codes.shape)]
        own = self.values[self.forms]
        self.powers = _powers(self.length + 2)
        self.before = np.zeros((len(words), self.length + 1), dtype=np.uint64)  # hashes of prefixes
        self.after = np.zeros((len(words), self.length + 1), dtype=np.uint64)  # hashes of suffixes
        for i in range(self.length):
            self.before[:, i + 1] = self.before[:, i] * _BASE + own[:, i]
            j = self.length - 1 - i
            self.after[:, j] = self.after[:, j + 1] + own[:, j] * self.powers[i]

    def keys(self) -> np.ndarray:
        return _mixed(self.before[:, -1], self.length)

    def variants(self, from_: int, to: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(places of words, keys)`` of the variants at positions from ``from_`` before ``to``; each variant comes once.

        Of equal symbols in a row the first is deleted, a symbol is replaced by the others only,
        and none is inserted behind its like; the form itself counts as the variant at position 0.
        """
        n, p = self.length, self.powers
        if from_ == 0:
            yield np.arange(len(self.forms)), self.keys()
        at = np.arange(from_, min(to, n))
        if len(at):
            head, tail, own = self.before[:, at], self.after[:, at + 1], self.forms[:, at]
            first = np.ones(own.shape, dtype=bool)
            first[:, 1:] = own[:, 1:] != own[:, :-1]
            if from_:
                first[:, 0] = own[:, 0] != self.forms[:, from_ - 1]
            yield np.nonzero(first)[0], _mixed((head * p[n - 1 - at] + tail)[first], n - 1)
            for a, value in enumerate(self.values):
                other = own != a
                yield np.nonzero(other)[0], _mixed((head * p[n - at] + value * p[n - 1 - at] + tail)[other], n)
        at = np.arange(from_, min(to, n + 1))
        head, tail = self.before[:, at], self.after[:, at]
        ahead = np.full((len(self.forms), len(at)), -1)
        ahead[:, at > 0] = self.forms[:, at[at > 0] - 1]
        for a, value in enumerate(self.values):
            new = ahead != a
            yield np.nonzero(new)[0], _mixed((head * p[n + 1 - at] + value * p[n - at] + tail)[new], n + 1)


def _keyed(words: DataFrame, symbols: int, neighbourhood: bool) -> DataFrame:
    """``(key, word)``: of each word's reduced form, or of all variants of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length = defaultdict(list)
            for i, word in enumerate(batch.column("word").to_pylist()):
                by_length[len(word)].append((i, word))
            for length, found in by_length.items():
                wide = max(1, _ROWS // max(1, 2 * symbols * (length + 1)))
                for start in range(0, len(found), wide):
                    part = found[start : start + wide]
                    reduced, place = Reduced([w for _, w in part], symbols), np.array([i for i, _ in part])
                    step = max(1, _ROWS // (2 * symbols * len(part)))
                    steps = ((a, a + step) for a in range(0, length + 1, step))
                    for at, keys in ((x for s in steps for x in reduced.variants(*s)) if neighbourhood else [(np.arange(len(part)), reduced.keys())]):
                        taken = pa.array(place[at])
                        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("carried").take(taken)], names=["key", "carried"])

    return map_arrow(words, run, f"key long, carried {words.schema['carried'].dataType.simpleString()}")


def near_words(words: DataFrame, *, symbols: int = 6, most_carried: int = 64) -> DataFrame:
    """``(word, near, near_n)`` of the distinct words of ``(word, n)``: each pair one inserted, deleted or replaced code point apart, both ways.

    Words of up to ``most_carried`` code points travel with the keys; longer ones are named by a
    hash there and looked up before they are verified, since a word has as many variants as it
    has code points times twice the symbols. Empty words have neighbours like others; null words
    take no part.
    """
    words = spread(words.where("word is not null"))
    long = F.length("word")
    short = words.where(long <= most_carried).withColumn("carried", F.col("word"))
    one_edit = lambda a, b: F.levenshtein(a, b, 1) == 1
    known = _keyed(short, symbols, False).select("key", F.col("carried").alias("near"))
    found = _keyed(short, symbols, True).withColumnRenamed("carried", "word").join(known, "key").where(one_edit(F.col("word"), F.col("near")))
    # The pairs with a longer word, by names.
    rest = words.where(long >= most_carried).withColumn("carried", F.xxhash64("word"))
    names = rest.select("carried", "word")
    met = _keyed(rest, symbols, True).withColumnRenamed("carried", "a").join(_keyed(rest, symbols, False).withColumnRenamed("carried", "b"), "key").where("a <> b").select("a", "b").distinct()
    met = met.join(names.withColumnRenamed("carried", "a"), "a").join(names.select(F.col("carried").alias("b"), F.col("word").alias("near")), "b")
    met = met.where((F.greatest(F.length("word"), F.length("near")) > most_carried) & one_edit(F.col("word"), F.col("near")))
    pairs = found.select("word", "near").union(met.select("word", "near"))
    return pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def spelling_variants(words: DataFrame, *, ratio: int = 5, symbols: int = 6) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each row of ``(word, n)``, whose words are distinct.

    A word's form is its near word with the largest n (ties: the smallest in code-point order), if
    that is at least ``ratio`` (2 or more) times its own; its root is where the forms end, the word
    itself if it has none. Counts grow along forms, so there are no rings, and so many rounds of
    pointer jumping as the largest count needs reach every root. No words: no rows.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")).where("word is not null and n is not null"), "words")
    near = near_words(words, symbols=symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    formed = words.join(near, "word", "left").withColumn("best_n", -F.col("best.minus"))
    takes = F.col("best_n") >= ratio * F.col("n")
    formed = stored(
        formed.select("word", F.when(takes, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best_n")).alias("form_n")), "forms"
    )
    most = words.agg(F.max("n").alias("most")).first().most or 1
    longest = 1 + int(math.log(max(most, 1), ratio))
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(longest + 1)))):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        roots = roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
