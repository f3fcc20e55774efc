"""A non-linear affinity model with sampled uncertainty: one network for each bootstrap replica, all trained in the same jobs.

A replica draws each row a Poisson number of times, by a hash of the row's keys. In a round every task trains all replicas on its own
rows from the shared weights, in mini-batches, and sends their weights back times the draws that they saw; the driver holds the mean, weighted
by them. So the number of jobs follows from the rounds alone, and what a task sends from the weights. The weights follow the partitioning of
the rows: the same files and splits give the same model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.affinity import _poisson
from kgloom.operators.quantiles import quantiles


@dataclass(frozen=True)
class Net:
    """rows of flat weights, one for each replica; hidden units; means and spreads that inputs and label are scaled by."""

    flat: np.ndarray
    hidden: int
    mean: np.ndarray
    spread: np.ndarray
    label_mean: float
    label_spread: float


def unpack(flat: np.ndarray, width: int, hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First layer, its bias, second layer, its bias, each with the replica first."""
    r, cut = len(flat), np.cumsum([width * hidden, hidden, hidden])
    a, b, c, d = np.split(flat, cut, axis=1)
    return a.reshape(r, width, hidden), b, c, d[:, 0]


def outputs(flat: np.ndarray, x: np.ndarray, hidden: int) -> np.ndarray:
    """Predictions, replicas by rows."""
    a, b, c, d = unpack(flat, x.shape[1], hidden)
    return np.einsum("rnh,rh->rn", np.tanh(np.einsum("nw,rwh->rnh", x, a) + b[:, None]), c) + d[:, None]


def loss_and_gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray, draws: np.ndarray, hidden: int, decay: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Half the mean squared error of each replica over its draws (replicas by rows), with weight decay, and its gradient."""
    a, b, c, d = unpack(flat, x.shape[1], hidden)
    n = np.maximum(draws.sum(axis=1), 1e-12)
    h = np.tanh(np.einsum("nw,rwh->rnh", x, a) + b[:, None])
    e = np.einsum("rnh,rh->rn", h, c) + d[:, None] - y
    g = draws * e / n[:, None]
    back = g[:, :, None] * c[:, None] * (1 - h * h)
    parts = [np.einsum("nw,rnh->rwh", x, back).reshape(len(flat), -1), back.sum(axis=1), np.einsum("rn,rnh->rh", g, h), g.sum(axis=1)[:, None]]
    return 0.5 * (draws * e * e).sum(axis=1) / n + 0.5 * decay * (flat * flat).sum(axis=1), np.concatenate(parts, axis=1) + decay * flat


def _adam(flat: np.ndarray, x: np.ndarray, y: np.ndarray, draws: np.ndarray, hidden: int, rate: float, decay: float, epochs: int, batch: int, rng: np.random.Generator) -> np.ndarray:
    """Weights after some epochs of mini-batches."""
    flat, m, w, t = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows, t = order[at : at + batch], t + 1
            g = loss_and_gradient(flat, x[rows], y[rows], draws[:, rows], hidden, decay)[1]
            m, w = 0.9 * m + 0.1 * g, 0.999 * w + 0.001 * g * g
            flat -= rate * (m / (1 - 0.9**t)) / (np.sqrt(w / (1 - 0.999**t)) + 1e-8)
    return flat


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def moments(rows: DataFrame, features: str, label: str) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Mean and spread of every input and of the label, as grouped sums."""
    first = rows.select(F.size(features).alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit")
    x = lambda k: F.col(features)[k].cast("double")
    r = rows.agg(*[f(x(k)).alias(f"{n}{k}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for k in range(first.d)], F.avg(label).alias("ym"), F.stddev_pop(label).alias("ys")).first()
    mean, spread = (np.array([r[f"{n}{k}"] for k in range(first.d)]) for n in "ms")
    return mean, np.where(spread > 0, spread, 1.0), float(r.ym), float(r.ys) or 1.0


def fit(rows: DataFrame, keys: tuple[str, ...], features: str = "features", label: str = "affinity", replicas: int = 8, hidden: int = 16, rounds: int = 8, epochs: int = 4, rate: float = 0.01, decay: float = 1e-4, batch: int = 256, seed: int = 0, held_rows: int = 65_536) -> Net:
    """Networks of rows(keys..., features: array, label); rows with a null label or features don't count.

    A task takes its rows `held_rows` at a time; each portion goes on from the weights of the one before.
    """
    known = rows.where(F.col(label).isNotNull() & F.col(features).isNotNull())
    mean, spread, label_mean, label_spread = moments(known, features, label)
    width, rng = len(mean), np.random.default_rng(seed)
    size = width * hidden + 2 * hidden + 1
    flat = rng.normal(size=(replicas, size)) / np.sqrt(width)
    draws = F.array(*[_poisson(keys, seed + k) for k in range(replicas)])
    ready = known.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), draws.alias("draws"))
    for turn in range(rounds):
        start = flat

        def each(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            mine, seen, held = start, np.zeros(replicas), []

            def learn(mine: np.ndarray) -> np.ndarray:
                x, y, d = (np.concatenate(c) for c in zip(*held))
                held.clear()
                seen[:] += d.sum(axis=0)
                return _adam(mine, (x - mean) / spread, (y - label_mean) / label_spread, d.T, hidden, rate / (1 + turn / 2), decay, epochs, batch, np.random.default_rng([seed, turn, len(x)]))

            for b in batches:
                if b.num_rows:
                    held.append((_matrix(b.column("x")), b.column("y").to_numpy(), _matrix(b.column("draws"))))
                if sum(len(h[1]) for h in held) >= held_rows:
                    mine = learn(mine)
            if held:
                mine = learn(mine)
            if seen.sum():
                k, at = np.indices(mine.shape)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(at.ravel(), pa.int32()), pa.array((mine * seen[:, None]).ravel()), pa.array(np.repeat(seen, size))], names=["replica", "at", "w", "n"])

        flat = start.copy()
        for r in ready.mapInArrow(each, "replica int, at int, w double, n double").groupBy("replica", "at").agg((F.sum("w") / F.sum("n")).alias("w"), F.sum("n").alias("n")).where("n > 0").collect():
            flat[r.replica, r.at] = r.w
    return Net(flat, hidden, mean, spread, label_mean, label_spread)


def samples(net: Net, rows: DataFrame, keys: tuple[str, ...], features: str = "features") -> DataFrame:
    """keys..., replica, value: the prediction of every replica for every row with features."""
    ready = rows.where(F.col(features).isNotNull()).select(*keys, F.col(features).cast("array<double>").alias("__x"))
    kinds = dict(ready.dtypes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = outputs(net.flat, (_matrix(b.column("__x")) - net.mean) / net.spread, net.hidden).T * net.label_spread + net.label_mean
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(np.ascontiguousarray(y).ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), lists], names=[*keys, "values"])

    out = ready.mapInArrow(each, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", values array<double>")
    return out.select(*keys, F.posexplode("values").alias("replica", "value"))


def predict(net: Net, rows: DataFrame, keys: tuple[str, ...], features: str = "features", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """keys..., mean, lcb, ucb: mean and quantiles over the replicas of each distinct key."""
    drawn = samples(net, rows, keys, features)
    mean = drawn.groupBy(*keys).agg(F.avg("value").alias("mean"), F.sort_array(F.collect_list("value")).alias("all"))  # as many as there are replicas, for each row of a key

    def at(q: float):
        place = (F.size("all") - 1) * F.lit(q)
        below = F.floor(place).cast("int")
        a, b = F.element_at("all", below + 1), F.element_at("all", F.least(below + 2, F.size("all")))
        return a + (place - below) * (b - a)

    return mean.select(*keys, "mean", at(low).alias("lcb"), at(high).alias("ucb"))


def error_quantiles(net: Net, rows: DataFrame, keys: tuple[str, ...], features: str = "features", label: str = "affinity", qs: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """q, value: quantiles of the absolute error of the mean prediction."""
    both = predict(net, rows, keys, features).join(rows.select(*keys, F.col(label).alias("__y")), list(keys))
    return quantiles(both.withColumn("__e", F.abs(F.col("mean") - F.col("__y"))), "__e", list(qs))
