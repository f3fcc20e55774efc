"""Tri-linear knowledge-graph embedding: scores, exact partition function, log-probabilities. Training is in `kge_train`.

Node embeddings are array columns re, im; a relation has its own re, im. Scores are squares, so
they are never negative and their sum over all head x tail pairs has a closed form in Gram
matrices: the cost is linear in heads plus tails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.vectors import dot, doubles
from kgloom.schema import product, small


def inner(u_re: Column, u_im: Column, r_re: Column, r_im: Column, v_re: Column, v_im: Column) -> Column:
    """The signed tri-linear form."""
    return dot(u_re, r_re, v_re) + dot(u_im, r_re, v_im) + dot(u_re, r_im, v_im) - dot(u_im, r_im, v_re)


def phi(*args: Column) -> Column:
    s = inner(*args)
    return s * s


def score_pairs(pairs: DataFrame, heads: DataFrame, tails: DataFrame, relation: DataFrame) -> DataFrame:
    """pairs(head, tail) with their score; heads and tails are (id, re, im), relation is one row (re, im)."""
    side = lambda d, n, p: d.select(F.col("id").alias(n), doubles("re").alias(f"{p}_re"), doubles("im").alias(f"{p}_im"))
    rows = pairs.join(side(heads, "head", "u"), "head").join(side(tails, "tail", "v"), "tail")
    rows = rows.crossJoin(F.broadcast(relation.select(doubles("re").alias("r_re"), doubles("im").alias("r_im"))))
    return rows.withColumn("score", phi(*[F.col(c) for c in ("u_re", "u_im", "r_re", "r_im", "v_re", "v_im")])).drop("u_re", "u_im", "r_re", "r_im", "v_re", "v_im")


def score_grid(heads: DataFrame, tails: DataFrame, relation: DataFrame, task_pairs: int = 5_000_000) -> DataFrame:
    """head, tail, score of all pairs of heads and tails, both (id, re, im); relation is one row (re, im). Ids are distinct.

    The sums of score_pairs() in its order, written out number by number, over a product of rows that carry their vectors: no pair is joined or shuffled.
    """
    r = relation.select(doubles("re").alias("re"), doubles("im").alias("im")).first()
    d = len(r.re or ()) if r else 0
    if not d or len(r.im or ()) != d:  # no relation, or none that fits
        return score_pairs(product(heads.select(F.col("id").alias("head")), tails.select(F.col("id").alias("tail"))), heads, tails, relation)
    at = lambda c, k: F.get(F.when(F.size(c) == d, doubles(c)), F.lit(k))
    weighted = {"a": ("re", r.re), "b": ("im", r.re), "c": ("re", r.im), "e": ("im", r.im)}
    left = heads.select(F.col("id").alias("head"), *[(at(c, k) * F.lit(w[k])).alias(f"_{n}{k}") for n, (c, w) in weighted.items() for k in range(d)])
    right = tails.select(F.col("id").alias("tail"), *[at(c, k).alias(f"_{c}{k}") for c in ("re", "im") for k in range(d)])
    tasks = max(1, -(-heads.count() * tails.count() // task_pairs))
    pairs = F.broadcast(left).crossJoin(right.repartition(tasks)) if small(left) else product(left, right, tasks)
    form = lambda n, c: sum((F.col(f"_{n}{k}") * F.col(f"_{c}{k}") for k in range(d)), F.lit(0.0))
    s = form("a", "re") + form("b", "im") + form("c", "im") - form("e", "re")
    return pairs.select("head", "tail", s.alias("_s")).select("head", "tail", (F.col("_s") * F.col("_s")).alias("score"))


def top_tails(heads: DataFrame, tails: DataFrame, relation: DataFrame, k: int, block_rows: int = 2000) -> DataFrame:
    """head, tail, score, rank: of all tails the k best of each head, ties by the smaller id.

    Blocks of heads meet blocks of tails in a matrix product. Each keeps k per head, all that tie with the k-th included, so the ranking is exact.
    """
    n = [max(1, -(-d.count() // block_rows)) for d in (heads, tails)]
    vec = F.concat(doubles("re"), doubles("im")).alias("v")
    own = lambda j: F.pmod(F.xxhash64("id"), F.lit(n[j])).cast("int")
    every = lambda j: F.explode(F.sequence(F.lit(0), F.lit(n[j] - 1)))
    left = heads.select("id", vec, own(0).alias("a"), F.lit(0).alias("side")).withColumn("b", every(1))
    right = tails.select("id", vec, own(1).alias("b"), F.lit(1).alias("side")).withColumn("a", every(0))
    rows = left.unionByName(right).crossJoin(F.broadcast(relation.select(doubles("re").alias("r_re"), doubles("im").alias("r_im"))))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf[pdf.side == s].sort_values("id") for s in (0, 1))
        if not len(x) or not len(y):
            return pd.DataFrame({"head": [], "tail": [], "score": []})
        re, im = np.asarray(pdf.r_re.iloc[0]), np.asarray(pdf.r_im.iloc[0])
        m = np.block([[np.diag(re), np.diag(im)], [-np.diag(im), np.diag(re)]])
        c = (np.stack(x.v.to_numpy()) @ m @ np.stack(y.v.to_numpy()).T) ** 2
        least = np.partition(c, -min(k, c.shape[1]), axis=1)[:, -min(k, c.shape[1])]
        i, j = np.nonzero(c >= least[:, None] * (1 - 1e-9))
        return pd.DataFrame({"head": x.id.to_numpy()[i], "tail": y.id.to_numpy()[j], "score": c[i, j]})

    found = rows.groupBy("a", "b").applyInPandas(product, "head long, tail long, score double")
    best = Window.partitionBy("head").orderBy(F.desc(F.round("score", 12)), "tail")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _side_gram(nodes: DataFrame) -> DataFrame:
    """i, j, s: the Gram matrix of [re, im] of the nodes, a partial one per partition, then a sum."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.hstack([np.stack(pdf.re.to_numpy()), np.stack(pdf.im.to_numpy())])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    return nodes.select(doubles("re").alias("re"), doubles("im").alias("im")).mapInPandas(each, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def partition_function(heads: DataFrame, tails: DataFrame, relation: DataFrame) -> DataFrame:
    """One row, z: the sum of scores over all head x tail pairs.

    With x = [u_re, u_im] and y = [v_re, v_im], the tri-linear form is x'My, where M has the relation on its
    four diagonals; the sum of its squares is the sum over all i, j, k, l of (X'X)ij Mik (Y'Y)kl Mjl. Each index of
    x meets two of y, so the Gram entries are joined through M alone.
    """
    d = F.size("re")
    r = relation.select(doubles("re").alias("re"), doubles("im").alias("im"))
    at = r.select(d.alias("d"), F.posexplode(F.arrays_zip("re", "im")).alias("k", "w"))
    # rows of M: (i, k, m) with i an index of x, k of y
    m = at.select(F.explode(F.array(
        F.struct(F.col("k").alias("i"), F.col("k").alias("k"), F.col("w.re").alias("m")),
        F.struct((F.col("k") + F.col("d")).alias("i"), (F.col("k") + F.col("d")).alias("k"), F.col("w.re").alias("m")),
        F.struct(F.col("k").alias("i"), (F.col("k") + F.col("d")).alias("k"), F.col("w.im").alias("m")),
        F.struct((F.col("k") + F.col("d")).alias("i"), F.col("k").alias("k"), (-F.col("w.im")).alias("m")),
    )).alias("e")).select("e.*")
    gx, gy = _side_gram(heads), _side_gram(tails).select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("s").alias("t"))
    left = gx.join(m, "i").select("j", "k", (F.col("s") * F.col("m")).alias("s"))
    both = left.join(m.select(F.col("i").alias("j"), F.col("k").alias("l"), F.col("m").alias("m2")), "j").groupBy("k", "l").agg(F.sum(F.col("s") * F.col("m2")).alias("s"))
    return both.join(gy, ["k", "l"]).agg(F.sum(F.col("s") * F.col("t")).alias("z"))


def log_prob(scored: DataFrame, z: DataFrame, n_heads: int, n_tails: int) -> DataFrame:
    """scored with log_prob = log(score + 1 / (heads * tails)) - log(1 + z)."""
    return scored.crossJoin(F.broadcast(z)).withColumn("log_prob", F.log(F.col("score") + 1.0 / (n_heads * n_tails)) - F.log1p("z")).drop("z")


class EarlyStop:
    """Keeps the best state, ties to the later one; says stop after more than `patience` turns without a strictly better one, so a plateau ends."""

    def __init__(self, patience: int):
        self.patience, self.best, self.state, self.waited = patience, float("inf"), None, 0

    def update(self, loss: float, state) -> bool:
        self.waited = 0 if loss < self.best else self.waited + 1
        if loss <= self.best:
            self.best, self.state = loss, state
        return self.waited > self.patience


def random_search(space: dict[str, list], n: int, seed: int = 0) -> list[dict]:
    """n hyper-parameter choices, each value drawn from its list."""
    rng = np.random.default_rng(seed)
    return [{k: v[int(rng.integers(len(v)))] for k, v in space.items()} for _ in range(n)]
