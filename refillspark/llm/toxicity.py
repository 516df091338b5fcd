"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Each n-gram that a text has counts by the logarithm of how much likelier toxic texts have it; the
scaled features have unit length together, and logistic regression learns their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ship_package, slices
from .learning import sampled_labels, shared

_BITS = 20
_LENGTHS = (4, 5)
_PIECE = 1 << 20  # characters of a text that are hashed at a time


def grams(text: str) -> np.ndarray:
    """Hashed character n-grams that the text has, each once; white space counts as a space, A-Z as a-z."""
    data = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    data = np.where((data >= 65) & (data <= 90), data + 32, np.where((data >= 9) & (data <= 13), 32, data))
    data = np.concatenate([[32], data, [32]]).astype(np.uint64)
    found = []
    for n in _LENGTHS:
        for start in range(0, len(data) - n + 1, _PIECE):
            part = data[start : start + _PIECE + n - 1]
            size = len(part) - n + 1
            h = np.full(size, n, dtype=np.uint64)
            for j in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ part[j : j + size]
            found.append(np.unique((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)))
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.zeros(0, np.int32)


class RatioClassifier:
    """``scaled``: weight times log-count ratio of each feature; ``squared``: the ratio's square."""

    def __init__(self, bias: float, scaled: np.ndarray, squared: np.ndarray):
        self.bias, self.scaled, self.squared = bias, scaled, squared

    def score(self, text: str) -> float:
        found = grams(text)
        length = np.sqrt(float(self.squared[found].sum(dtype=np.float64)))
        margin = self.bias + float(self.scaled[found].sum(dtype=np.float64)) / length if length else self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, *, epochs: int = 5, rate: float = 0.5, decay: float = 1e-4, least: int = 3, seed: int = 7) -> RatioClassifier:
        """``least``: texts that must have an n-gram for it to count."""
        counts = np.zeros((2, 1 << _BITS))
        for found, label in zip(rows, labels):
            counts[label, found] += 1
        ones = int(labels.sum())
        zeros = len(labels) - ones
        ratio = np.log((counts[1] + 1) / (ones + 2)) - np.log((counts[0] + 1) / (zeros + 2))
        ratio[counts.sum(axis=0) < least] = 0
        weights, seen = np.zeros(1 << _BITS), np.full(1 << _BITS, 1e-6)
        bias, rng = float(np.log(ones / zeros)), np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                found = rows[i]
                value = ratio[found]
                length = np.sqrt((value * value).sum())
                if not length:
                    continue
                value = value / length
                margin = bias + float(weights[found] @ value)
                g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[i]) * (2.0 if labels[i] else 1.0)
                step = g * value + decay * weights[found]
                seen[found] += step * step
                weights[found] -= rate * step / np.sqrt(seen[found])
                bias -= 0.05 * g
        return cls(bias, (weights * ratio).astype(np.float32), (ratio * ratio).astype(np.float32))


def _scored(
    docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, folds: int, held_fold: int, most_rows: int
) -> tuple[object, list[RatioClassifier]]:
    spark = docs.sparkSession
    ship_package(spark)
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = sampled_labels(rows, labels, id_col=id_col, label_col=label_col, learn=fold != held_fold, most_rows=most_rows)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        y = np.array(table.column("label").to_pylist())
        none = np.zeros(1 << _BITS, np.float32)
        found = [grams(t or "") for t in table.column("text").to_pylist()]
        model = RatioClassifier.fit(found, y) if 0 < y.sum() < len(y) else RatioClassifier(0.0, none, none)
        used = np.flatnonzero(model.squared)
        packed = [used.astype("<i4").tobytes(), model.scaled[used].astype("<f4").tobytes(), model.squared[used].astype("<f4").tobytes()]
        return pa.table({"bias": [float(model.bias)], "used": [packed[0]], "scaled": [packed[1]], "squared": [packed[2]]})

    fitted = sample.groupBy("all").applyInArrow(fit, "bias double, used binary, scaled binary, squared binary").first()
    return shared(spark, tuple(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in fitted) if fitted else (0.0, b"", b"", b"")), []


def _unpack(packed: tuple, unpacked: list[RatioClassifier]) -> RatioClassifier:
    if not unpacked:
        bias, used, scaled, squared = packed
        at = np.frombuffer(used, "<i4")
        model = RatioClassifier(bias, np.zeros(1 << _BITS, np.float32), np.zeros(1 << _BITS, np.float32))
        model.scaled[at] = np.frombuffer(scaled, "<f4")
        model.squared[at] = np.frombuffer(squared, "<f4")
        unpacked.append(model)
    return unpacked[0]


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 3,
    held_fold: int = 1,
    threshold: float = 0.7,
    most_rows: int = 6_000,
    slice_bytes: int = 4 << 20,
) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row, from its whole text only.

    Rows whose ``crc32(id as text) mod folds`` is ``held_fold`` are held out. Of the other labelled
    rows those with the ``most_rows`` smallest hashes of their ids are learnt from: that bounds the
    model's memory and time, whatever the corpus. Null texts count as empty and get the score of
    the bias alone; null ids are never held out nor learnt from; repeated rows give a row each.
    Without labels of both classes every score is 0.5. Other columns are not read.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    model, unpacked = _scored(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, held_fold=held_fold, most_rows=most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = _unpack(model.value, unpacked)
        for batch in slices(batches, "text", slice_bytes):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            scores = [classifier.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = map_arrow(rows, run, f"id {id_type}, score double").withColumnRenamed("id", id_col)
    return scored.select(
        id_col, F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_civil(
    docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = 0.7, slice_bytes: int = 4 << 20, **options
) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, without a shuffle.

    Scores are those of ``toxicity_scores``: null and empty texts get that of the bias alone, rows
    with one text the same; without labels of both classes every row stays. Rows keep all their
    columns; an empty table gives none.
    """
    options = {"id_col": "doc_id", "label_col": "toxic", "folds": 3, "held_fold": 1, "most_rows": 6_000} | options
    model, unpacked = _scored(docs, labels, text_col=text_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = _unpack(model.value, unpacked)
        for batch in slices(batches, text_col, slice_bytes):
            texts = pc.fill_null(batch.column(text_col), "").to_pylist()
            yield batch.filter(pa.array([classifier.score(t) < threshold for t in texts], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
