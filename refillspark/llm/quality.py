"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have low rank: each feature has a weight and a short vector, and the sum over
all pairs is half of (the square of the sum less the sum of squares), in time linear in the features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship_package, slices
from .learning import sampled_labels, shared

_BITS = 18
_N_STATS = 17
_RANK = 8


def statistics(text: str, n_chars: int | None) -> np.ndarray:
    """Structure of a text, and its length as the metadata give it; each roughly between 0 and 1."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    n = max(1, len(data))
    kinds = np.bincount(data, minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n_words = max(1, len(words))
    upper, lower, digits = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    symbols = sum(int(kinds[ord(c)]) for c in "#$%&*@^~_=+<>{}[]\\/")
    return np.array(
        [
            upper / max(1, upper + lower),
            digits / n,
            symbols / n * 5,
            kinds[ord("|")] / n_words,
            kinds[ord("!")] / n_words,
            (kinds[ord(",")] + kinds[ord(";")]) / n_words,
            (kinds[ord(".")] + kinds[ord("?")]) / n_words,
            1 - len(set(words)) / n_words,
            1 - len(set(lines)) / max(1, len(lines)),
            sum(w.isupper() for w in words) / n_words,
            sum(not w[-1].isalnum() for w in words) / n_words,
            sum(not any(c.isalpha() for c in w) for w in words) / n_words,
            min(1.0, len(text) / n_words / 20),
            min(1.0, len(lines) / n_words * 10),
            kinds[128:].sum() / n,
            np.log1p(len(words)) / 12,
            np.log1p(len(text) if n_chars is None else max(0, n_chars)) / 14,
        ]
    )


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed distinct words of equal weight, then the statistics."""
    words = {zlib.crc32(w.encode()) >> (32 - _BITS) for w in text.lower().split()}
    index = np.array(sorted(words), dtype=np.int64)
    value = np.full(len(index), 1 / np.sqrt(max(1, len(index))))
    return np.concatenate([index, (1 << _BITS) + np.arange(_N_STATS)]), np.concatenate([value, statistics(text, n_chars)])


class FactorisationMachine:
    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        sums, squares = self._sums(index, value)
        return float(self.bias + self.weights[index] @ value + 0.5 * (sums @ sums - squares))

    def _sums(self, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, float]:
        scaled = self.vectors[index] * value[:, None]
        return scaled.sum(axis=0), float((scaled * scaled).sum())

    def score(self, text: str, n_chars: int | None) -> float:
        margin = self.margin(*features(text, n_chars))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = 5, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        """Adaptive stochastic gradients of the logistic loss; classes weigh the same in all."""
        rng = np.random.default_rng(seed)
        n = (1 << _BITS) + _N_STATS
        model = cls(0.0, np.zeros(n, dtype=np.float32), (rng.standard_normal((n, _RANK)) * 0.02).astype(np.float32))
        seen_w, seen_v, seen_b = np.full(n, 1e-3, np.float32), np.full((n, _RANK), 1e-3, np.float32), 1e-3
        ones = max(1, int(labels.sum()))
        weight = {1: len(labels) / 2 / ones, 0: len(labels) / 2 / max(1, len(labels) - ones)}
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                index, value = rows[i]
                sums, squares = model._sums(index, value)
                margin = model.bias + float(model.weights[index] @ value) + 0.5 * float(sums @ sums - squares)
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[i]) * weight[int(labels[i])]
                of_w = g * value + decay * model.weights[index]
                own = model.vectors[index]
                of_v = g * (value[:, None] * sums - own * (value**2)[:, None]) + decay * own
                seen_w[index] += of_w**2
                seen_v[index] += of_v**2
                seen_b += g * g
                model.weights[index] -= rate * of_w / np.sqrt(seen_w[index])
                model.vectors[index] -= rate * of_v / np.sqrt(seen_v[index])
                model.bias -= rate * g / np.sqrt(seen_b)
        return model


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str = "n_chars",
    label_col: str = "quality",
    folds: int = 5,
    held_fold: int = 0,
    threshold: float = 0.3,
    most_rows: int = 6_000,
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row.

    Rows whose ``crc32(id as text) mod folds`` is ``held_fold`` are held out. Of the other labelled
    rows those with the ``most_rows`` smallest hashes of their ids are learnt from: that bounds the
    model's memory and time, whatever the corpus. Null texts count as empty, a null length as the
    text's own; null ids are never held out nor learnt from. Without labels of both classes every
    score is 0.5. Ids, languages, sources and labels are no inputs of a score; other columns are
    not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    length = F.col(length_col).cast("long") if length_col in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), length.alias("n_chars"))
    sample = sampled_labels(rows, labels, id_col=id_col, label_col=label_col, learn=fold != held_fold, most_rows=most_rows)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        y = np.array(table.column("label").to_pylist())
        found = [features(t or "", n) for t, n in zip(table.column("text").to_pylist(), table.column("n_chars").to_pylist())]
        model = FactorisationMachine.fit(found, y) if 0 < y.sum() < len(y) else FactorisationMachine(0.0, np.zeros((1 << _BITS) + _N_STATS, np.float32), np.zeros(((1 << _BITS) + _N_STATS, _RANK), np.float32))
        used = np.flatnonzero(model.weights)
        packed = [used.astype("<i4").tobytes(), model.weights[used].astype("<f4").tobytes(), model.vectors[used].astype("<f4").tobytes()]
        return pa.table({"bias": [float(model.bias)], "used": [packed[0]], "weights": [packed[1]], "vectors": [packed[2]]})

    fitted = sample.groupBy("all").applyInArrow(fit, "bias double, used binary, weights binary, vectors binary").first()
    model = shared(spark, tuple(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in fitted) if fitted else (0.0, b"", b"", b""))
    unpacked: list[FactorisationMachine] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not unpacked:
            bias, used, weights, vectors = model.value
            at, n = np.frombuffer(used, "<i4"), (1 << _BITS) + _N_STATS
            whole = FactorisationMachine(bias, np.zeros(n, np.float32), np.zeros((n, _RANK), np.float32))
            whole.weights[at] = np.frombuffer(weights, "<f4")
            whole.vectors[at] = np.frombuffer(vectors, "<f4").reshape(-1, _RANK)
            unpacked.append(whole)
        for batch in slices(batches, "text", slice_bytes):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            scores = [unpacked[0].score(t, n) for t, n in zip(texts, batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    scored = map_arrow(rows, run, f"id {id_type}, score double").withColumnRenamed("id", id_col)
    return scored.select(
        id_col, F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
