"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

#: A space after anything but white space: a byte-level pre-tokenizer never joins the two sides,
#: and it looks neither behind nor, from text that ends so, ahead.
_SAFE_CUT = re.compile(r"(?<=\S) ")
#: Texts without this are cut at every space (white space as Python and Unicode have it).
_SPACE_AFTER_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuttable(path: str) -> bool:
    """Whether texts may be cut at spaces: byte-level regex splitting without a normalizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    plain = all(not t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")) and not any(" " in t["content"] for t in spec.get("added_tokens", []))
    return (
        spec.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and plain
        and not (spec.get("post_processor") or {}).get("special_tokens")
        and not spec.get("truncation")
        and not spec.get("padding")
    )


class _Library:
    """The library's batch encoder for one vocabulary file, as lengths."""

    def __init__(self, path: str):
        self.cuttable = False
        self.seen: dict[str, int] = {}  # lengths of parts that this worker has met
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in self.model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.lengths = lambda texts: [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        if _cuttable(path):
            vocabulary = self.model.get_vocab(with_added_tokens=True)
            self.token_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            # A byte-level token has a character for each byte; an added one stands for its own text.
            added = {t.content for t in self.model.get_added_tokens_decoder().values()}
            for token, i in vocabulary.items():
                self.token_bytes[i] = len(token.encode()) if token in added else len(token)
            self.cuttable = True

    def spaced(self, parts: list[str], batch_bytes: int) -> Iterator[int]:
        """Lengths of ``" " + part``; parts don't end in white space, so runs of them go in as one text."""
        start = size = 0
        for i, part in enumerate(parts):
            size += len(part) + 1
            if size >= batch_bytes or i + 1 == len(parts):
                run = parts[start : i + 1]
                [encoded] = self.model.encode_batch_fast([" " + " ".join(run)], add_special_tokens=False)
                token_ends = np.cumsum(self.token_bytes[np.array(encoded.ids, dtype=np.int64)])
                part_ends = np.cumsum([len(x.encode()) + 1 for x in run])
                yield from np.diff(np.searchsorted(token_ends, part_ends, side="right"), prepend=0).tolist()
                start, size = i + 1, 0


@lru_cache(maxsize=4)
def _library(path: str) -> _Library:
    return _Library(path)


def split_at_spaces(texts: pa.Array) -> tuple[list[str], pa.DictionaryArray, np.ndarray]:
    """The first part of each text, the other parts of all texts as a dictionary array, and their ends by text."""
    odd = pc.match_substring_regex(texts, _SPACE_AFTER_SPACE)
    cut = pc.split_pattern(texts, " ")
    if pc.any(odd).as_py():
        cut = pa.array([_SAFE_CUT.split(t.as_py()) if o else c.as_py() for t, c, o in zip(texts, cut, odd.to_pylist())], cut.type)
    n = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    values = cut.flatten()
    others = np.ones(len(values), dtype=bool)
    others[first] = False
    return values.take(pa.array(first)).to_numpy(zero_copy_only=False).tolist(), values.filter(pa.array(others)).dictionary_encode(), np.cumsum(n - 1)


def _count(texts: pa.Array, path: str, batch_bytes: int, most_seen: int) -> np.ndarray:
    library = _library(path)
    if not library.cuttable:
        return np.array(library.lengths(texts.to_numpy(zero_copy_only=False).tolist()), dtype=np.int64)
    seen = library.seen
    if len(seen) > most_seen:
        seen.clear()
    heads, parts, ends = split_at_spaces(texts)
    names = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
    new = [x for x in names if x not in seen]
    plain = [x for x in new if x and not x[-1].isspace()]
    seen.update(zip(plain, library.spaced(plain, batch_bytes)))
    if len(plain) < len(new):
        rest = [x for x in new if not x or x[-1].isspace()]
        seen.update(zip(rest, library.lengths([" " + x for x in rest])))
    by_name = np.fromiter(map(seen.__getitem__, names), dtype=np.int64, count=len(names))
    sums = np.concatenate([[0], np.cumsum(by_name[parts.indices.to_numpy()])])
    return np.array(library.lengths(heads), dtype=np.int64) + sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def count_tokens(
    docs: DataFrame,
    path: str | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    batch_bytes: int = 4 << 20,
    most_seen: int = 1_000_000,
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every whole text, by the library of the vocabulary file.

    ``path`` names a tokenizers ``.json`` or a sentencepiece ``.model`` that every executor can
    read. Rows go through in slices of about ``batch_bytes``; for byte-level vocabularies long
    texts are cut before a space that follows something else, where no token can span, and each
    distinct part is encoded once a slice (a worker remembers up to ``most_seen`` of them).
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids give a row each;
    other columns are not read. A text without a safe place to cut is encoded whole.
    """
    path = path or public_vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", batch_bytes):
            texts = pc.fill_null(batch.column("text"), "")
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            n_tokens = _count(texts, path, batch_bytes, most_seen)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), n_bytes, pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = map_arrow(rows, run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
