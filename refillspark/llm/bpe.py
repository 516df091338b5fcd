"""Byte-level BPE encoding and decoding from a rank file.

Bytes become Latin-1 characters, so that one pyahocorasick automaton over the vocabulary finds the
longest token at each place. The encoder takes it, or the longest shorter one that may stand after
the token before it, and steps back where none can. Two tokens may be neighbours if the merges of
their joined bytes give just those two, which their own merges show; that is memoised. The sequence whose neighbours all may
stand together is unique and is what the merges give. A place from which no token led on is never
tried again, and each search sees no more than the longest token's length, so the work is linear in
the length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices
from .tokens import public_vocabulary, split_at_spaces

_MOST_PAIRS = 200_000  # and so memory that a worker keeps


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BytePairCoder:
    """Encodes single pieces and decodes ids by ``ranks``; pieces come from the split pattern."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.prefix: dict[int, int | None] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """The merges themselves, for pairs of tokens: the lowest rank first, leftmost on ties."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins into this one; None for a single byte."""
        if rank not in self.split:
            token = self.token[rank]
            if len(token) == 1:
                self.split[rank] = None
            else:
                del self.ranks[token]
                left, right = self.merged(token)
                self.ranks[token] = rank
                self.split[rank] = self.ranks[left], self.ranks[right]
        return self.split[rank]

    def compatible(self, left: int, right: int) -> bool:
        pair = left << 32 | right  # less than half of a tuple's memory
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= _MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Back through the merges: at each time the tokens at the two sides of the border must not be
        ones that a merge across it joins before either grows further (the left one first on ties)."""
        left_until = right_until = 1 << 60
        while True:
            across = self.ranks.get(self.token[left] + self.token[right], 1 << 60)
            if across < left_until and across <= right_until and across < 1 << 60:
                return False
            of_left, of_right = self.halves(left), self.halves(right)
            if of_left and (not of_right or left > right):
                left_until, left = left, of_left[1]
            elif of_right:
                right_until, right = right, of_right[0]
            else:
                return True

    def shorter(self, rank: int) -> int | None:
        """The longest other token that this one begins with; None for a single byte."""
        if rank not in self.prefix:
            token = self.token[rank]
            self.prefix[rank] = next((r for n in range(len(token) - 1, 0, -1) if (r := self.ranks.get(token[:n])) is not None), None)
        return self.prefix[rank]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, size = piece.decode("latin-1"), self.size
        dead = bytearray(len(text) + 1)
        taken: list[int] = []
        at = 0
        while at < len(text):
            _, rank = next(self.automaton.iter_long(text[at : at + self.longest]))
            while dead[at + size[rank]] or taken and not self.compatible(taken[-1], rank):
                rank = self.shorter(rank)
                while rank is None:
                    dead[at] = 1
                    last = taken.pop()
                    at -= size[last]
                    rank = self.shorter(last)
            taken.append(rank)
            at += size[rank]
        return taken

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class _Worker:
    """What a Python worker keeps: the coder, and the parts of texts that it has met more than once."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.coder = BytePairCoder(read_ranks(path))
        self.pieces = regex.compile(pattern).findall
        self.seen: dict[str, list[int]] = {}
        self.of_piece: dict[str, list[int]] = {}

    def ids(self, text: str, most_kept: int = 0) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            found = self.of_piece.get(piece)
            if found is None:
                found = self.coder.encode(piece.encode())
                if most_kept and len(piece) < 64:
                    if len(self.of_piece) >= most_kept:
                        self.of_piece.clear()
                    self.of_piece[piece] = found
            out += found
        return out


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str) -> _Worker:
    return _Worker(path, pattern)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _coded(texts: pa.Array, worker: _Worker, most_seen: int) -> Iterator[tuple[int, str, bytes]]:
    """Of each text: how many ids, the ids joined by spaces, and the bytes that decoding them gives."""
    heads, parts, ends = split_at_spaces(texts)
    which = parts.indices.to_numpy()
    names = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
    # Words come again, numbers and junk don't: what occurs once here would fill the memory for nothing.
    again = (np.bincount(which, minlength=len(names)) > 1).tolist()
    known, joined, plain = [], [], []
    for part, keep in zip(names, again):
        found = worker.seen.get(part)
        if found is None:
            ids = worker.ids(" " + part, most_seen if keep else 0)
            found = (len(ids), " ".join(map(str, ids)), worker.coder.decode(ids))
            if keep and len(part) < 64:
                if len(worker.seen) >= most_seen:
                    worker.seen.clear()
                worker.seen[part] = found
        known.append(found[0])
        joined.append(found[1])
        plain.append(found[2])
    numbers = np.array(known, dtype=np.int64)
    start = 0
    for head, end in zip(heads, ends.tolist()):
        own = which[start:end]
        start = end
        first = worker.ids(head)
        places = own.tolist()
        ids = [*map(str, first), *map(joined.__getitem__, places)]
        decoded = worker.coder.decode(first) + b"".join(map(plain.__getitem__, places))
        yield len(first) + int(numbers[own].sum()), " ".join(ids), decoded


def encode_texts(
    docs: DataFrame,
    path: str | None = None,
    pattern: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "digests",
    slice_bytes: int = 1 << 20,
    most_seen: int = 100_000,
) -> DataFrame:
    """Every whole text encoded by the ranks in ``path``, and the ids decoded again.

    ``keep="digests"``: ``(id, n_tokens, ids_sha256, decoded_sha256)``; ``keep="ids"``:
    ``(id, n_tokens, ids ARRAY<INT>, decoded)``. Special tokens don't exist: their strings are
    ordinary text. Matches of ``pattern`` are encoded separately; texts are cut beforehand before
    a space that follows something else, which no match can span. Null and empty texts have 0
    tokens and decode to nothing; repeated rows and null ids give a row each; other columns are
    not read. Memory is bounded by the slice, the longest text and ``most_seen``, the words and the
    pieces of them that a worker remembers.
    """
    path = path or public_vocabulary("byte_bpe_50k.tiktoken")
    pattern = pattern or split_pattern()
    digests = keep == "digests"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(path, pattern)
        for batch in slices(batches, "text", slice_bytes):
            texts = pc.fill_null(batch.column("text"), "")
            n, first, second = [], [], []
            for count, ids, decoded in _coded(texts, worker, most_seen):
                n.append(count)
                if digests:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(decoded).hexdigest())
                else:
                    first.append([int(x) for x in ids.split()])
                    second.append(decoded.decode(errors="replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())],
                names=["id", "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return map_arrow(rows, run, f"id {id_type}, n_tokens long, {shape}").withColumnRenamed("id", id_col)
