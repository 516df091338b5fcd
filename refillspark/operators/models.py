"""Risk models by Spark ML: impute, fit, score out of fold, and explain trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .distributed import quantiles


def impute_with_indicator(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact medians for what is missing, and a flag that it was; a column without values becomes 0."""
    out = df
    for c, (median,) in quantiles(df, columns, [0.5]).items():
        out = out.withColumn(f"{c}_missing", F.col(c).isNull().cast("int"))
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0 if median is None else median)))
    return out


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``weight``: the rows over twice the rows of the class."""
    counts = df.groupBy(label).agg(F.count("*").alias("own"))
    total = df.agg(F.count("*").alias("rows"))
    weights = counts.join(F.broadcast(total)).select(label, (F.col("rows") / (2 * F.col("own"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


def fit_logistic(df: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(balanced_weights(df, label))


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, iterations: int = 20, depth: int = 4, seed: int = 7) -> PipelineModel:
    """Boosted trees that stop early on a fifth of the rows, chosen by a hash of the id."""
    held = F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(5)) == 0
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="features"),
        GBTClassifier(featuresCol="features", labelCol=label, maxIter=iterations, maxDepth=depth, seed=seed, validationIndicatorCol="held"),
    ]
    return Pipeline(stages=stages).fit(df.withColumn("held", held))


def fit_random_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 5, seed: int = 7) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="features"),
        RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return Pipeline(stages=stages).fit(balanced_weights(df, label))


def score_holdout(model: PipelineModel, panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(pid, score)`` by a frozen model; a missing feature is an error, further columns are ignored."""
    if missing := [c for c in features if c not in panel.columns]:
        raise ValueError(f"the panel lacks {', '.join(missing)}")
    scored = model.transform(panel.select("pid", *features))
    return scored.select("pid", F.round(vector_to_array("probability")[1], 6).alias("score"))


def out_of_fold_scores(df: DataFrame, features: Sequence[str], label: str, fit: Callable[..., PipelineModel], k: int = 5) -> DataFrame:
    """Each row scored by a model that hasn't seen it; ``df`` has a ``fold``."""
    out = None
    for i in range(k):
        model = fit(df.where(F.col("fold") != i), features, label)
        part = score_holdout(model, df.where(F.col("fold") == i), features).withColumn("fold", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out


def fit_aft_survival(df: DataFrame, features: Sequence[str], time: str = "time", event: str = "event") -> PipelineModel:
    """Accelerated failure times; refuses data without events. A higher risk is a shorter predicted time."""
    if df.where(F.col(event) == 1).isEmpty():
        raise ValueError("no events to fit on")
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="features"),
        AFTSurvivalRegression(featuresCol="features", labelCol=time, censorCol="event_double"),
    ]
    return Pipeline(stages=stages).fit(df.withColumn("event_double", F.col(event).cast("double")))


# ---- tree attributions --------------------------------------------------------------------------


def _leaves(node, path: dict, out: list) -> None:
    """(path, value) of each leaf; a path has, by feature, its conditions and the share of rows that took it."""
    if node.getClass().getSimpleName() == "LeafNode":
        out.append((path, node.prediction()))
        return
    split = node.split()
    feature, threshold = split.featureIndex(), split.threshold()
    whole = node.impurityStats().count()
    for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
        conditions, share = path.get(feature, ((), 1.0))
        _leaves(child, path | {feature: (conditions + ((threshold, left),), share * child.impurityStats().count() / whole)}, out)


def _attribute(x: np.ndarray, leaves: list, n_features: int) -> tuple[np.ndarray, float]:
    """Shapley values of each row for one tree: a leaf is a product game over the features on its path.

    A feature's weight over the sets of the others is the integral, from 0 to 1, of the product of
    their mixtures of share and condition; a Gauss rule of half as many points as features is exact.
    """
    values, base = np.zeros((len(x), n_features)), 0.0
    for path, value in leaves:
        if not path:
            base += value
            continue
        features = list(path)
        met = np.array([np.all([(x[:, f] <= t) == left for t, left in path[f][0]], axis=0) for f in features], dtype=float)
        share = np.array([[path[f][1]] for f in features])
        base += value * float(share.prod())
        points, weights = np.polynomial.legendre.leggauss((len(features) + 1) // 2)
        total = np.zeros_like(met)
        for point, weight in zip((points + 1) / 2, weights / 2):
            mixed = share + (met - share) * point
            ones = np.ones_like(mixed[:1])
            before = np.cumprod(np.concatenate([ones, mixed[:-1]]), axis=0)
            after = np.cumprod(np.concatenate([ones, mixed[:0:-1]]), axis=0)[::-1]
            total += weight * before * after
        values[:, features] += value * (total * (met - share)).T
    return values, base


def tree_attribution(df: DataFrame, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """``(pid, margin, base, <feature>_attr...)``: additive, margin = base + their sum.

    The margin is the weighted sum of the trees' predictions. The trees (whose size the depth bounds)
    go to the executors; rows are scored in batches.
    """
    ensemble = model.stages[-1]
    trees = []
    for tree, weight in zip(ensemble.trees, ensemble.treeWeights):
        leaves: list = []
        _leaves(tree._java_obj.rootNode(), {}, leaves)
        trees.append((weight, leaves))
    names = list(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            total, base = np.zeros((len(x), len(names))), 0.0
            for weight, leaves in trees:
                values, mean = _attribute(x, leaves, len(names))
                total, base = total + weight * values, base + weight * mean
            out = pd.DataFrame({"pid": batch["pid"], "margin": base + total.sum(axis=1), "base": base})
            yield out.assign(**{f"{n}_attr": total[:, i] for i, n in enumerate(names)})

    shape = "pid long, margin double, base double, " + ", ".join(f"{n}_attr double" for n in names)
    return df.select("pid", *names).mapInPandas(run, shape)
