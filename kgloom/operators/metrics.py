"""Ranking and calibration metrics over prediction tables: head, score, prob, y (0 or 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators.scan import running_sums

#: Ranks up to which hits are counted.
TOPS = (1, 3, 10, 100)


def score_steps(preds: DataFrame, head: str = "head", score: str = "score", y: str = "y") -> DataFrame:
    """head, score, p, n: positives and negatives at each distinct score; then tp, fp from the highest score down.

    Rows are counted by (head, score) before any sum runs, so those run over distinct scores.
    """
    counts = preds.groupBy(F.col(head).alias("head"), F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("n")
    )
    return running(counts)


def running(counts: DataFrame) -> DataFrame:
    """counts(head, score, p, n) with tp, fp: the sums of a head's p and n from its highest score down; a hot head is split across tasks."""
    return running_sums(counts, ["head"], "score", {"tp": "p", "fp": "n"}, descending=True)


def auroc(steps: DataFrame) -> DataFrame:
    """head, auroc: the share of (positive, negative) pairs in order, ties half. Heads need both kinds."""
    out = steps.groupBy("head").agg(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.where("p > 0 AND n > 0").select("head", (F.col("s") / (F.col("p") * F.col("n"))).alias("auroc"))


def average_precision(steps: DataFrame) -> DataFrame:
    """head, ap: precision at each step of recall, weighted by the step."""
    out = steps.groupBy("head").agg(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"), F.sum("p").alias("p"))
    return out.where("p > 0").select("head", (F.col("s") / F.col("p")).alias("ap"))


def brier(preds: DataFrame, head: str = "head", prob: str = "prob", y: str = "y") -> DataFrame:
    """head, brier, for heads with positives."""
    out = preds.groupBy(F.col(head).alias("head")).agg(F.avg(F.pow(F.col(prob) - F.col(y), 2)).alias("brier"), F.max(y).alias("any"))
    return out.where(F.col("any") == 1).select("head", "brier")


def ranks(steps: DataFrame) -> DataFrame:
    """head, score, p, rank: of the p positives at a score, one more than the negatives at or above it."""
    return steps.where("p > 0").select("head", "score", "p", (F.col("fp") + 1).alias("rank"))


def sampled_ranks(preds: DataFrame, head: str = "head", score: str = "score", y: str = "y") -> DataFrame:
    """As ranks(); heads without negatives of their own are ranked among all negatives.

    Such heads meet the negatives' distinct scores, counted once, in a merged descending run, which is split across tasks.
    """
    steps = score_steps(preds, head, score, y)
    own = steps.groupBy("head").agg(F.sum("n").alias("own"))
    steps = steps.join(own, "head")
    with_own = ranks(steps.where("own > 0"))
    negatives = steps.where("n > 0").groupBy("score").agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("p"))
    lacking = steps.where("own = 0").groupBy("score").agg(F.lit(0).cast("long").alias("n"), F.sum("p").alias("p"))
    merged = running(negatives.unionByName(lacking).groupBy("score").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).withColumn("head", F.lit(0)))
    borrowed = steps.where("own = 0").select("head", "score", "p").join(merged.select("score", (F.col("fp") + 1).alias("rank")), "score")
    return with_own.unionByName(borrowed)


def mrr_and_tops(ranked: DataFrame, tops: tuple[int, ...] = TOPS) -> DataFrame:
    """One row: MRR, the share of positives ranked within each top, and the number of positives."""
    total = F.sum("p")
    share = lambda k: F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("p"))), F.lit(0)) / total
    return ranked.agg((F.sum(F.col("p") / F.col("rank")) / total).alias("mrr"), *[share(k).alias(f"top{k}") for k in tops], total.alias("positives"))


def best_rank_mrr(ranked: DataFrame) -> DataFrame:
    """One row: MRR by the best-ranked positive of each head."""
    return ranked.groupBy("head").agg(F.min("rank").alias("rank")).agg(F.avg(1 / F.col("rank")).alias("best_mrr"))


def ece(preds: DataFrame, bins: int = 10, prob: str = "prob", y: str = "y") -> DataFrame:
    """One row: expected calibration error over bins [k/n, (k+1)/n).

    A probability of exactly 1 lies in no bin but counts in the total. Edges are compared as k * (1/n) in doubles:
    multiplying the probability by n would move some edges.
    """
    p = F.col(prob)
    edges = F.array(*[F.lit(i * (1 / bins)) for i in range(1, bins)])
    own = F.when((p >= 0) & (p < 1), F.size(F.filter(edges, lambda e: e <= p)))
    each = preds.groupBy(own.alias("bin")).agg(F.count("*").alias("c"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    inside = F.when(F.col("bin").isNotNull(), F.col("c") * F.abs(F.col("conf") - F.col("acc"))).otherwise(0.0)
    return each.agg((F.sum(inside) / F.sum("c")).alias("ece"))


def regression(df: DataFrame, y: str, yhat: str, eps: float = 1e-8) -> DataFrame:
    """One row: pearson, r2, mse, mae, rmse."""
    a, b = F.col(y), F.col(yhat)
    sums = df.where(a.isNotNull() & b.isNotNull()).agg(
        F.corr(y, yhat).alias("pearson"), F.avg(F.pow(a - b, 2)).alias("mse"), F.avg(F.abs(a - b)).alias("mae"), F.var_pop(y).alias("v")
    )
    return sums.select("pearson", (1 - F.col("mse") / (F.col("v") + eps)).alias("r2"), "mse", "mae", F.sqrt("mse").alias("rmse"))


def uncertainty(samples: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """Mean, 5 % and 95 % quantile over each key's samples."""
    q = lambda x: F.percentile(value, F.lit(x))
    return samples.groupBy(*keys).agg(F.avg(value).alias("mean"), q(0.05).alias("lcb"), q(0.95).alias("ucb"))


def evaluate(preds: DataFrame, method: str = "all", bins: int = 10) -> DataFrame:
    """One row of all metrics. Ranks use the score, calibration the probability."""
    if method not in ("all", "negatives"):
        raise ValueError(f"unknown method {method}")
    steps, by_prob = score_steps(preds), score_steps(preds, score="prob")
    ranked = ranks(steps) if method == "all" else sampled_ranks(preds)
    parts = [
        mrr_and_tops(ranked),
        auroc(by_prob).agg(F.avg("auroc").alias("avg_auc")),
        average_precision(by_prob).agg(F.avg("ap").alias("avg_ap")),
        brier(preds).agg(F.avg("brier").alias("avg_brier")),
        ece(preds, bins),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out
