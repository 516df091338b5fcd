"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation over blocks.

A dimension is a term; a vector's integer weight in it is a posting. Candidates are dealt into
shelves of a few blocks, which hold their postings by term; every query goes to every shelf as a row
of its own, after the shelf's candidates. Each query and block get a dense array of scores, into
which the query scatters its weighted postings; the best of a block are selected by partition, and
the best of blocks and shelves are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored

#: Blocks of candidates in a shelf at most: with 4,096 vectors of 64 dimensions each, some 50 MB of postings.
MOST_BLOCKS = 16


def _postings(weights: np.ndarray) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """Of each term: the places of the candidates that have it (a slice, if nearly all do), and their weights."""
    found = {}
    for t in range(weights.shape[1]):
        at = np.flatnonzero(weights[:, t])
        if len(at):
            where = slice(None) if 2 * len(at) > len(weights) else at
            found[t] = where, weights[where, t].copy()
    return found


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids; all, if there are fewer."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class _Block:
    """Candidates of a block: their rows, ids and postings."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        self.rows, self.ids, self.postings = rows, ids, _postings(weights)

    def search(self, own: int, query: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
        """``(id, score)`` of the best for a query, whose own row is left out."""
        scores = np.zeros(len(self.ids), dtype=np.int64)
        for term in np.flatnonzero(query).tolist():
            if term in self.postings:
                at, weight = self.postings[term]
                scores[at] += query[term] * weight
        others = np.flatnonzero(self.rows != own)
        for at in others[_best(scores[others], self.ids[others], k)].tolist():
            yield int(self.ids[at]), int(scores[at])


def top_k(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_where: str = "id % 100 = 0",
    k: int = 10,
    scale: int = 1024,
    candidate_block: int = 4096,
    query_block: int = 256,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of each row that ``query_where`` names.

    Components x become floor(scale * x), x as double; the score is their integer inner product,
    and vectors of different lengths meet in the terms both have. Candidates are all rows but the
    query's own; ties go to the smaller id. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part. Rows that share an id are rows like others:
    each is a candidate, and each that is a query gets its own k (numbered 1 to k for each of them).
    An empty table gives no rows. No score, in part or whole, is larger than the largest squared
    length of a vector; where that reaches 2^62 the search is an error, not a wrapped score. A task
    keeps the postings of one shelf, at most ``MOST_BLOCKS`` blocks of ``candidate_block`` rows, and
    reads queries as they come, ``query_block`` at a time; nothing is gathered in the driver.
    """
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null").where(finite)
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "vectors")
    # A block's number comes from a count of rows by hash, so that blocks have about the size asked for.
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    n_rows, n_queries, largest = rows.agg(F.count("*"), F.count_if(F.expr(query_where)), F.max(square)).first()
    if (largest or 0.0) >= 2.0**62:
        raise ValueError("a vector is too long for scores of 64 bits")
    n_blocks = -(-n_rows // candidate_block) or 1
    # A few shelves a core, so that they can be dealt evenly; more blocks in each spare copies of the queries.
    n_shelves = -(-n_blocks // min(MOST_BLOCKS, max(1, n_blocks // (3 * vectors.sparkSession.sparkContext.defaultParallelism))))
    # Components are below 2^31 where squared lengths are below 2^62.
    rows = rows.select("row", "id", F.col("v").cast("array<int>").alias("v"))
    candidates = rows.select(F.pmod(F.xxhash64("row"), F.lit(n_shelves)).cast("int").alias("shelf"), F.lit(False).alias("asks"), "row", "id", "v")
    asks = rows.where(query_where).select(F.explode(F.sequence(F.lit(0), F.lit(n_shelves - 1))).alias("shelf"), F.lit(True).alias("asks"), "row", "id", "v")
    met = candidates.union(asks).repartitionById(n_shelves, "shelf").sortWithinPartitions("shelf", "asks")

    def unpack(part: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, ids, lists = (pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in (part.column(n) for n in ("row", "id", "v")))
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        weights = np.zeros((len(ids), max([0, *lengths.tolist()])), dtype=np.int64)
        row = np.repeat(np.arange(len(ids)), lengths)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        weights[row, column] = flat
        return own.to_numpy(), ids.to_numpy(), weights

    def stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
        """Consecutive rows of one shelf and kind."""
        shelf, asks = batch.column("shelf").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(shelf) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if end > start:
                yield int(shelf[start]), bool(asks[start]), batch.slice(start, end - start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting, blocks = None, [], []
        for batch in batches:
            for shelf, asks, part in stretches(batch):
                if shelf != last:
                    last, waiting, blocks = shelf, [], []
                if not asks:
                    waiting.append(part)
                    continue
                if waiting:
                    whole, waiting = pa.Table.from_batches(waiting), []
                    blocks = [_Block(*unpack(whole.slice(at, candidate_block))) for at in range(0, whole.num_rows, candidate_block)]
                for at in range(0, part.num_rows, query_block):
                    found = []
                    for own, query, vector in zip(*unpack(part.slice(at, query_block))):
                        best = [x for block in blocks for x in block.search(own, vector, k)]
                        found += [(int(own), int(query), *x) for x in sorted(best, key=lambda x: (-x[1], x[0]))[:k]]
                    columns = zip(*found) if found else ([], [], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["row", "query_id", "vec_id", "score"])

    found = map_arrow(met, run, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
