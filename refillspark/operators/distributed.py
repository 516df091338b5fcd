"""Places in a global order without one task that sees all rows.

Groups and buckets may be null: rows with a null key are a group, or a bucket, of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_with_nulls(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys meet null keys; ``rows`` keeps its columns, and ``other`` adds those that aren't keys."""
    theirs = other.select(*(F.col(c).alias(f"{c}_theirs_") for c in on), *(c for c in other.columns if c not in on))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_theirs_")) for c in on]
    if how in ("left_semi", "left_anti"):
        return rows.join(theirs, same, how)
    return rows.join(theirs, same, how).drop(*(f"{c}_theirs_" for c in on))


def dealt(rows: DataFrame, key: str, n: int, each: int = 250_000) -> DataFrame:
    """About ``n`` rows in parts of some ``each`` by a key, so that what a task sorts doesn't grow with the rows.

    Adaptive execution merges a shuffle's parts by their compressed bytes, and rows that compress
    well take many times as much in a sort; a number of parts that is given stays. Few rows are
    left to it.
    """
    spark = rows.sparkSession
    parts = math.ceil(n / each)
    if parts <= spark.sparkContext.defaultParallelism:
        return rows
    # Not below the session's number: what is joined with them then comes into as many parts.
    return rows.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def running_totals(rows: DataFrame, bucket: Column, order: list, totals: dict[str, Column], by: str | None = None, inclusive: bool = False, down: bool = False) -> DataFrame:
    """Adds, for each name, the sum of a column over the rows before this one (with ``inclusive`` this one too), within ``by``.

    ``bucket`` doesn't decrease along ``order`` (with ``down``: doesn't increase). Sums run within a
    bucket; what comes before it is a running sum over one row a bucket, so no task sees a whole group.
    """
    group = [by] if by else []
    rows = rows.withColumn("bucket_", bucket)
    own = rows.groupBy(*group, "bucket_").agg(*(F.sum(c).alias(f"{n}_own") for n, c in totals.items()))
    place = F.desc("bucket_") if down else F.asc("bucket_")
    over = Window.partitionBy(*(group or [F.lit(0)])).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select(*group, "bucket_", *(F.coalesce(F.sum(f"{n}_own").over(over), F.lit(0)).alias(f"{n}_before") for n in totals))
    within = Window.partitionBy(*group, "bucket_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.withColumns({f"{n}_within": F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in totals.items()}).transform(join_with_nulls, offsets, [*group, "bucket_"])
    out = out.withColumns({n: F.col(f"{n}_before") + F.col(f"{n}_within") for n in totals})
    return out.drop("bucket_", *(f"{n}_{x}" for n in totals for x in ("before", "within")))


def running_count(rows: DataFrame, bucket_col: str, order: list[str], name: str, by: str | None = None) -> DataFrame:
    """Adds each row's place (from 1) in the order of ``bucket_col`` and then ``order``, within ``by``.

    Rows are numbered within a bucket; what comes before it is a running sum over one row a bucket.
    """
    group = [by] if by else []
    counts = rows.groupBy(*group, bucket_col).agg(F.count("*").alias("own"))
    before = F.sum("own").over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*group, bucket_col, F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*group, bucket_col).orderBy(*order))
    out = join_with_nulls(rows.withColumn("within", within), offsets, [*group, bucket_col])
    return out.withColumn(name, F.col("before") + F.col("within")).drop("before", "within")


def order_statistics(rows: DataFrame, targets: Sequence[tuple[str, int]], most: int = 10_000) -> list[float]:
    """The values at given ranks (from 0) among the non-null values of columns: exact, in passes.

    Each pass brackets every open rank by approximate percentiles (sketches of bounded size), counts
    what lies below, on and between the two ends, and goes on inside the bracket, where one part in
    some thousands is left. A bracket with at most ``most`` values is sorted. No aggregate's buffer
    grows with the rows. Ranks have to be below the number of values.
    """
    value = [F.col(c).cast("double") for c, _ in targets]
    found: list[float | None] = [None] * len(targets)
    # Of each open target: the open interval it lies in, its rank there and the values there.
    sizes = rows.agg(*(F.count(v) for v in value)).first()
    todo = {i: (-math.inf, math.inf, rank, sizes[i]) for i, (_, rank) in enumerate(targets)}
    inside = lambda i: F.when((value[i] > todo[i][0]) & (value[i] < todo[i][1]), value[i])
    unbounded = lambda i: F.when(value[i].isNotNull() & ~F.isnan(value[i]), value[i])
    first = True
    while todo:
        of = {i: unbounded(i) if first else inside(i) for i in todo}
        small = [i for i in todo if todo[i][3] <= most]
        if small:
            for i, values in zip(small, rows.agg(*(F.sort_array(F.collect_list(of[i])) for i in small)).first()):
                found[i] = values[todo[i][2]]
                del todo[i]
            continue
        shares = [[max(0.0, (rank + 0.5) / n - 5e-4), min(1.0, (rank + 0.5) / n + 5e-4)] for _, _, rank, n in todo.values()]
        ends = dict(zip(todo, rows.agg(*(F.percentile_approx(of[i], p, 10_000) for i, p in zip(todo, shares))).first()))
        counts = []
        for i in todo:
            a, b = ends[i]
            counts += [F.count_if(of[i] < a), F.count_if(of[i] == a), F.count_if((of[i] > a) & (of[i] < b)), F.count_if((of[i] == b) & F.lit(a != b))]
        counted = rows.agg(*counts).first()
        for place, i in enumerate(list(todo)):
            (low, high, rank, n), (a, b) = todo[i], ends[i]
            steps = [(low, a), (a, a), (a, b), (b, b), (b, high)]
            for (lo, hi), size in zip(steps, (*counted[4 * place : 4 * place + 4], n)):
                if rank < size:
                    break
                rank -= size
            if lo == hi:
                found[i] = float(lo)
                del todo[i]
            else:
                todo[i] = (lo, hi, rank, n - sum(counted[4 * place : 4 * place + 4]) if (lo, hi) == (b, high) else size)
        first = False
    return found


def quantiles(rows: DataFrame, columns: Sequence[str], at: Sequence[float], most: int = 10_000) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of several columns; None for a column without values."""
    sizes = dict(zip(columns, rows.agg(*(F.count(F.col(c).cast("double")) for c in columns)).first()))
    places = [(c, p * (sizes[c] - 1)) for c in columns if sizes[c] for p in at]
    targets = sorted({(c, k) for c, x in places for k in (math.floor(x), math.ceil(x))})
    value = dict(zip(targets, order_statistics(rows, targets, most))) if targets else {}
    between = lambda c, x: value[c, math.floor(x)] + (value[c, math.ceil(x)] - value[c, math.floor(x)]) * (x - math.floor(x))
    return {c: [between(c, p * (sizes[c] - 1)) if sizes[c] else None for p in at] for c in columns}
