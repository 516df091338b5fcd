"""Metrics as aggregates over distinct scores: a row for each group, undefined values null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import kept
from .distributed import join_with_nulls, quantiles, running_totals


def _six(c: Column) -> Column:
    return F.round(c, 6)


def _bucket(score: str) -> Column:
    """Buckets in the order of the scores; probabilities fall into some four thousand."""
    return F.floor(F.col(score) * 4096)


def _by_score(rows: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """Positives and negatives of each distinct score; what windows see no longer grows with the rows of a score."""
    return rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(by, score).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )


def roc_auc(rows: DataFrame, by: str, score: str = "risk", label: str = "event") -> DataFrame:
    """Rank statistic with half credit for ties; null for a single class."""
    steps = running_totals(_by_score(rows, by, score, label), _bucket(score), [score], {"below": F.col("neg")}, by)
    auc = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))
    return steps.groupBy(by).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("n_events"), _six(auc).alias("auc"))


def average_precision(rows: DataFrame, by: str, score: str = "risk", label: str = "event") -> DataFrame:
    """With the no-skill baseline (prevalence) and the lift over it."""
    sums = {"hits": F.col("pos"), "seen": F.col("pos") + F.col("neg")}
    steps = running_totals(_by_score(rows, by, score, label), _bucket(score), [F.desc(score)], sums, by, inclusive=True, down=True)
    total = steps.groupBy(by).agg(
        (F.sum(F.col("pos") * F.col("hits") / F.col("seen")) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap"), (F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("base")
    )
    return total.select(by, _six(F.col("ap")).alias("average_precision"), _six(F.col("base")).alias("baseline"), _six(F.col("ap") / F.nullif(F.col("base"), F.lit(0.0))).alias("lift"))


def f1_at(rows: DataFrame, threshold: float = 0.35, score: str = "risk", label: str = "event", fold: str = "fold") -> DataFrame:
    """Mean and population deviation over folds of F1; 0 where nothing is predicted or true."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    counts = rows.groupBy(fold).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return counts.withColumn("f1", f1).agg(_six(F.avg("f1")).alias("f1_mean"), _six(F.stddev_pop("f1")).alias("f1_std"))


def auc_by_group(rows: DataFrame, by: str, least: int = 50) -> DataFrame:
    found = roc_auc(rows, by)
    note = F.when(F.col("n") < least, F.lit(f"n<{least}")).when(F.col("auc").isNull(), "single-class slice")
    return found.select(by, "n", "n_events", F.when(note.isNull(), F.col("auc")).alias("auc"), note.alias("note"))


def _counted(r: np.ndarray, t: np.ndarray, k: np.ndarray, apart: np.ndarray | None = None) -> float:
    """Twice the credit of all pairs in which one has the earlier time: 2 for the higher score, 1 for an equal one.

    Merge counting, in m log(m) steps; with ``apart`` only pairs whose ``apart`` differs count (it must not decrease with time).
    """
    order = np.lexsort((r, t))
    r, t, k = r[order], t[order], k[order].astype(np.float64)
    # Blocks by halves of the distinct times: pairs of two halves are counted by ranks.
    step = t if apart is None else apart[order]
    starts = np.concatenate([np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]])), [len(r)]]) if len(r) else np.zeros(1, int)
    total, todo = 0.0, [(0, len(starts) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        m = (a + b) // 2
        early, late = slice(starts[a], starts[m]), slice(starts[m], starts[b])
        by_score = np.argsort(r[late], kind="stable")
        sums = np.concatenate([[0.0], np.cumsum(k[late][by_score])])
        scores = r[late][by_score]
        total += float(k[early] @ (sums[np.searchsorted(scores, r[early], "left")] + sums[np.searchsorted(scores, r[early], "right")]))
        todo += [(a, m), (m, b)]
    return total


_CUTS = 63


def _striped(e: DataFrame, value: str, stripe: str, most: int) -> DataFrame:
    """Adds a number that rises with ``value`` within ``g``; rows that share one are at most ``most``, or all have one value.

    A stripe with more rows is cut at its own approximate quantiles, whose sketches have a bounded
    size; a value at a cut becomes a stripe of its own, so each round leaves a sixtieth or so.
    """
    e = e.withColumn(stripe, F.lit(0).cast("long"))
    shares = [i / (_CUTS + 1) for i in range(1, _CUTS + 1)]
    while True:
        found = e.groupBy("g", stripe).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("highest"), F.percentile_approx(value, shares, 2000).alias("cuts"))
        large = kept(found.where((F.col("n") > most) & (F.col("least") < F.col("highest"))).select("g", stripe, "cuts"), "cuts")
        if large.isEmpty():
            return e
        place = F.size(F.filter("cuts", lambda x: x < F.col(value))) + F.size(F.filter("cuts", lambda x: x <= F.col(value)))
        cut = join_with_nulls(e, F.broadcast(large), ["g", stripe], "left")  # at most (rows / most) stripes are large
        e = kept(cut.withColumn(stripe, F.col(stripe) * (2 * _CUTS + 1) + F.when(F.col("cuts").isNotNull(), place).otherwise(0)).drop("cuts"), "stripes")


def _striped_pairs(e: DataFrame, of_stripe, shape: str) -> DataFrame:
    """``(g, credit)``: parts of twice the credit of all pairs of ``e (g, r, t, k, rc, tc)``."""
    cells = kept(e.groupBy("g", "rc", "tc").agg(F.sum("k").cast("double").alias("k")), "cells")
    rows, columns = cells.select("g", "rc").distinct(), cells.select("g", "tc").distinct()
    grid = join_with_nulls(join_with_nulls(rows, columns, ["g"]), cells, ["g", "rc", "tc"], "left").fillna(0.0, ["k"])
    lower = F.sum("k").over(Window.partitionBy("g", "tc").orderBy("rc").rowsBetween(Window.unboundedPreceding, -1))
    later = F.sum("lower").over(Window.partitionBy("g", "rc").orderBy(F.desc("tc")).rowsBetween(Window.unboundedPreceding, -1))
    parts = grid.withColumn("lower", F.coalesce(lower, F.lit(0.0))).withColumn("later", F.coalesce(later, F.lit(0.0))).groupBy("g").agg(F.sum(2 * F.col("k") * F.col("later")).alias("credit"))

    def several(value: str, stripe: str) -> DataFrame:
        ends = e.groupBy("g", stripe).agg(F.min(value).alias("least"), F.max(value).alias("highest")).where("least < highest").select("g", stripe)
        return join_with_nulls(e, ends, ["g", stripe], "left_semi")

    parts = parts.union(several("t", "tc").groupBy("g", "tc").applyInArrow(of_stripe(False), f"g {shape}, credit double"))
    parts = parts.union(several("r", "rc").groupBy("g", "rc").applyInArrow(of_stripe(True), f"g {shape}, credit double"))
    single = e.groupBy("g", "rc").agg(F.min("r").alias("least"), F.max("r").alias("highest")).where("least = highest").select("g", "rc")
    squares = join_with_nulls(cells, single, ["g", "rc"], "left_semi").groupBy("g", "rc").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"))
    return parts.union(squares.select("g", ((F.col("all") * F.col("all") - F.col("same")) / 2).alias("credit")))


def _ordered_pairs(e: DataFrame, most: int | None = None) -> DataFrame:
    """``(g, good2, pairs2)`` of distinct events ``e (g, r, t, k)``: the credit of pairs of different times, and their number.

    Scores and times are cut into stripes of at most ``most`` rows (or of one value). Pairs that
    differ in both stripes are counted by running sums over the grid of stripes. Pairs in one stripe
    of times, and those in one stripe of scores but different stripes of times, are counted in
    tasks that hold that stripe only; a stripe of one time has no such pairs, and for one of a
    single score sums do. By default a stripe has 200,000 rows, or three times the root of all, so
    that neither stripes nor their grid outgrow the rows.
    """
    e = kept(e, "events")
    n = e.count()
    most = most or max(200_000, int(3 * n**0.5))
    shape = e.schema["g"].dataType.simpleString()

    def of_stripe(apart: bool):
        def run(part: pa.Table) -> pa.Table:
            r, t, k, tc = (part.column(c).to_numpy() for c in ("r", "t", "k", "tc"))
            return pa.table({"g": part.column("g").slice(0, 1), "credit": [_counted(r, t, k, tc if apart else None)]})

        return run

    if n <= most:  # one stripe
        parts = e.withColumn("tc", F.lit(0)).groupBy("g").applyInArrow(of_stripe(False), f"g {shape}, credit double")
    else:
        parts = _striped_pairs(_striped(_striped(e, "r", "rc", most), "t", "tc", most), of_stripe, shape)
    good = parts.groupBy("g").agg((F.sum("credit") / 2).alias("good2"))
    # Pairs of different times: all pairs less those of one time.
    times = e.groupBy("g", "t").agg(F.sum("k").cast("double").alias("k"))
    pairs = times.groupBy("g").agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs2"))
    return join_with_nulls(good, pairs, ["g"])


def c_index(rows: DataFrame, by: str, risk: str = "risk", time: str = "time", event: str = "event", most: int | None = None) -> DataFrame:
    """Concordance: an event is comparable with whoever has a later time, and with whoever is censored.

    Against the censored only ranks count; among events see ``_ordered_pairs``.
    """
    known = rows.where(f"{risk} is not null and {time} is not null and {event} is not null")
    r = known.groupBy(by, risk).agg(F.sum(event).alias("ev"), F.sum(1 - F.col(event)).alias("cens"))
    ranked = running_totals(r, _bucket(risk), [risk], {"below": F.col("cens")}, by).groupBy(by).agg(
        F.sum(F.col("ev") * (F.col("below") + F.col("cens") / 2)).alias("good"), (F.sum("ev") * F.sum("cens")).alias("pairs")
    )
    e = known.where(f"{event} = 1").groupBy(F.col(by).alias("g"), F.col(risk).cast("double").alias("r"), F.col(time).cast("double").alias("t")).agg(F.count("*").alias("k"))
    out = join_with_nulls(ranked, _ordered_pairs(e, most).withColumnRenamed("g", by), [by], "left")
    good, pairs = F.col("good") + F.coalesce("good2", F.lit(0.0)), F.col("pairs") + F.coalesce("pairs2", F.lit(0))
    return out.select(by, _six(good / F.nullif(pairs, F.lit(0))).alias("c_index"))


def calibration_report(rows: DataFrame, by: str, least: int = 30) -> DataFrame:
    """Overall and for each group: size, events, c-index, AUC, and whether the group can be relied on."""
    each = rows.select("risk", "event", "time", F.explode(F.array(F.lit("overall"), F.col(by))).alias("group"))
    out = roc_auc(each, "group").join(c_index(each, "group"), "group", "left")
    reliable = (F.col("n") >= least) & (F.col("n_events") > 0) & (F.col("n_events") < F.col("n"))
    return out.select("group", "n", "n_events", "c_index", "auc", reliable.cast("int").alias("reliable"))


def selection_parity(eligible: DataFrame, capped: DataFrame, by: str, least_ratio: float = 0.8) -> DataFrame:
    """Selection rates by group, the ratio of the least to the most, and whether it is too small."""
    chosen = capped.select("pid", F.lit(1).alias("chosen")).distinct()
    rates = eligible.join(chosen, "pid", "left").groupBy(by).agg(F.count("*").alias("eligible_n"), F.count("chosen").alias("capped_n"))
    rates = rates.withColumn("rate", F.col("capped_n") / F.col("eligible_n"))
    ends = rates.agg(F.min("rate").alias("lo"), F.max("rate").alias("hi"))
    ratio = F.coalesce(F.col("lo") / F.nullif(F.col("hi"), F.lit(0.0)), F.lit(1.0))
    return rates.join(F.broadcast(ends)).select(by, "eligible_n", "capped_n", _six(F.col("rate")).alias("rate"), _six(ratio).alias("min_max_ratio"), (ratio < least_ratio).cast("int").alias("flagged"))


def action_distribution(capped: DataFrame, by: str) -> DataFrame:
    counts = capped.groupBy(by, "action").agg(F.count("*").alias("n"))
    return counts.select(by, "action", _six(F.col("n") / F.sum("n").over(Window.partitionBy(by))).alias("share"))


def stratify(rows: DataFrame, by: str, known: DataFrame, metrics: dict[str, Column], least: int = 15) -> DataFrame:
    """Every known stratum has a row; small ones have no values but say so."""
    found = rows.groupBy(by).agg(F.count("*").alias("n"), *(m.alias(k) for k, m in metrics.items()))
    out = F.broadcast(known).join(found, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= least
    return out.select(by, "n", *(F.when(enough, F.col(k)).alias(k) for k in metrics), F.when(enough, "ok").otherwise("insufficient_sample").alias("status"))


def time_quantiles(rows: DataFrame, at: tuple[float, ...] = (0.25, 0.5, 0.75), time: str = "time") -> DataFrame:
    """Distinct quantile horizons of the times below the longest observed one; none if there are no such times."""
    below = rows.join(F.broadcast(rows.agg(F.max(time).alias("most_"))), F.col(time) < F.col("most_")).select(time)
    found = {h for h in quantiles(below, [time], at)[time] if h is not None}
    return rows.sparkSession.createDataFrame([(float(h),) for h in sorted(found)], "horizon double")


def _stays(rows: DataFrame, censoring: bool) -> DataFrame:
    """``(time, log, zero)``: of each time the logarithm of the share that stays there, or ``zero`` = 1 if none does.

    Of events among those at risk; with ``censoring`` of the censored among those at risk who have no event at that time.
    """
    times = rows.where("time is not null and event is not null").groupBy(F.col("time").cast("double").alias("time")).agg(F.count("*").alias("n"), F.sum(F.col("event").cast("long")).alias("ev"))
    times = running_totals(times, F.floor("time"), [F.desc("time")], {"at_risk": F.col("n")}, inclusive=True, down=True)
    goes, risk = (F.col("n") - F.col("ev"), F.col("at_risk") - F.col("ev")) if censoring else (F.col("ev"), F.col("at_risk"))
    share = F.when(goes > 0, 1 - goes / risk).otherwise(1.0)
    return times.select("time", F.when(share > 0, F.log(share)).otherwise(0.0).alias("log"), (share <= 0).cast("int").alias("zero"))


def _curve_at(steps: DataFrame, times: DataFrame) -> DataFrame:
    """``(time, s)``: the product of the steps up to and at each of ``times``: both are merged in their order, so no step meets more than its place."""
    both = steps.withColumn("asks", F.lit(0)).unionByName(times.select(F.col("time").cast("double").alias("time"), F.lit(0.0).alias("log"), F.lit(0).alias("zero"), F.lit(1).alias("asks")).distinct())
    sums = running_totals(both, F.floor("time"), ["time", "asks"], {"log_s": F.col("log"), "zeros": F.col("zero")}, inclusive=True)
    return sums.where("asks = 1").select("time", F.when(F.col("zeros") > 0, 0.0).otherwise(F.exp("log_s")).alias("s"))


def dynamic_auc(rows: DataFrame, horizons: list[float], train: DataFrame | None = None) -> DataFrame:
    """``(horizon, auc, mean_auc)``: cumulative/dynamic AUC at each horizon, events weighted by the inverse chance of not being censored.

    That chance is the product, over times up to the event's, of the share of ``train (time,
    event)`` that stays: of those at risk without an event then, the ones not censored. Without
    ``train`` it comes from the rows themselves. ``mean_auc``, the same in each row, weighs the AUCs by
    the survival of the rows that is lost between horizons. An AUC is null without cases, without
    controls, or if a case has no chance left; the mean is null if an AUC is.
    """
    rows = rows.where("time is not null and event is not null and risk is not null").withColumn("time", F.col("time").cast("double"))
    stays = lambda of, censoring: kept(_stays(of, censoring), "curve")  # noqa: E731  a row a time, used twice by each running sum
    chance = kept(_curve_at(stays(rows if train is None else train, True), rows.where("event = 1").select("time")), "chance")
    each = rows.join(chance, "time", "left").withColumn("horizon", F.explode(F.array(*(F.lit(float(h)) for h in horizons))))
    case = (F.col("time") <= F.col("horizon")) & (F.col("event") == 1)
    steps = each.groupBy("horizon", "risk").agg(
        F.sum(F.when(case & (F.col("s") > 0), 1 / F.col("s")).otherwise(0.0)).alias("w"), F.count_if(case & (F.col("s") <= 0)).alias("hopeless"), F.count_if(F.col("time") > F.col("horizon")).alias("ctrl")
    )
    steps = running_totals(kept(steps, "steps"), _bucket("risk"), ["risk"], {"below": F.col("ctrl")}, "horizon")
    auc = F.sum(F.col("w") * (F.col("below") + F.col("ctrl") / 2)) / F.nullif(F.sum("w") * F.sum("ctrl"), F.lit(0.0))
    found = steps.groupBy("horizon").agg(F.when(F.sum("hopeless") == 0, auc).alias("auc"))
    asked = rows.sparkSession.createDataFrame([(float(h),) for h in sorted(set(horizons))], "horizon double")
    curve = _curve_at(stays(rows, False), asked.withColumnRenamed("horizon", "time")).withColumnRenamed("time", "horizon")
    found = asked.join(found, "horizon", "left").join(curve, "horizon")
    lost = F.lag("s", 1, 1.0).over(Window.partitionBy(F.lit(0)).orderBy("horizon")) - F.col("s")  # a row a horizon
    found = found.withColumn("lost", lost)
    mean = F.when(F.count("auc") == F.count("*"), F.when(F.count("*") == 1, F.max("auc")).otherwise(F.sum(F.col("auc") * F.col("lost")) / F.nullif(1 - F.min("s"), F.lit(0.0))))
    return found.join(F.broadcast(found.agg(mean.alias("mean")))).select("horizon", _six(F.col("auc")).alias("auc"), _six(F.col("mean")).alias("mean_auc"))  # one row
