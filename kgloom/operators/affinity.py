"""Affinity regression on concatenated vectors, with bootstrap uncertainty."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.metrics import regression, uncertainty


def features(pairs: DataFrame, drugs: DataFrame, proteins: DataFrame) -> DataFrame:
    """pairs(drug, protein, ...) with the two embeddings side by side as one vector."""
    side = lambda d, n: d.select(F.col("id").alias(n), F.col("embedding").cast("array<double>").alias(f"__{n}"))
    rows = pairs.join(side(drugs, "drug"), "drug").join(side(proteins, "protein"), "protein")
    return rows.withColumn("features", array_to_vector(F.concat("__drug", "__protein"))).drop("__drug", "__protein")


def fit(train: DataFrame, label: str = "affinity", reg: float = 0.01, weight: str | None = None):
    model = LinearRegression(featuresCol="features", labelCol=label, regParam=reg, predictionCol="yhat", solver="normal")
    return (model.setWeightCol(weight) if weight else model).fit(train)


def evaluate(model, rows: DataFrame, label: str = "affinity") -> DataFrame:
    return regression(model.transform(rows), label, "yhat")


def _poisson(keys: tuple[str, ...], seed: int) -> Column:
    """A Poisson number of mean one from a hash of the keys: how many steps of its distribution lie below the hash's place in [0, 1)."""
    place = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)
    share, below, steps = math.exp(-1), 0.0, []
    for k in range(12):
        below += share / math.factorial(k)
        steps.append((place >= below).cast("double"))
    return sum(steps[1:], steps[0])


def bootstrap(train: DataFrame, rows: DataFrame, keys: tuple[str, ...], replicas: int = 5, label: str = "affinity", seed: int = 0) -> DataFrame:
    """Mean, 5 % and 95 % quantile of the predictions of models fitted on resampled rows.

    How often a row is drawn is a Poisson number (mean one) that follows from a hash of its keys, so it doesn't depend on partitions.
    """
    out = None
    for i in range(replicas):
        part = fit(train.withColumn("__w", _poisson(keys, seed + i)).where("__w > 0"), label, weight="__w").transform(rows).select(*keys, F.col("yhat").alias("value"))
        out = part if out is None else out.unionByName(part)
    return uncertainty(out, *keys)
