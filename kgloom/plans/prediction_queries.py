"""Queries over predictions: the degree-product scorer on the supplier x part grid, and quality labels by document length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators import aggregate, errorrate, graph, metrics
from kgloom.plans.graph_queries import SPLIT, flag_counts, folded
from kgloom.schema import product, with_constants
from kgloom.storage import table


def degree_steps(split: DataFrame, heads: DataFrame, tails: DataFrame) -> DataFrame:
    """head, score, p, n, tp, fp of the full head x tail grid under score = degree(head) * degree(tail) over training edges.

    The score of a head depends on a tail through its degree alone, so the grid is never made: heads meet the
    distinct tail degrees with their numbers of tails, and only known pairs are looked up one by one to take
    positives out of the negatives. The cost is heads x degrees plus edges, not heads x tails.
    """
    train = split.where("split = 'train'")
    hd = heads.join(train.groupBy("head").agg(F.count("*").alias("hd")), "head", "left").na.fill(0, ["hd"])
    td = tails.join(train.groupBy("tail").agg(F.count("*").alias("td")), "tail", "left").na.fill(0, ["td"])
    degrees = td.groupBy("td").agg(F.count("*").alias("tails"))
    grid = product(hd, degrees).select("head", (F.col("hd") * F.col("td")).alias("score"), F.col("tails").alias("all"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("known"))
    pairs = split.join(hd, "head").join(td, "tail")
    pairs = pairs.select("head", (F.col("hd") * F.col("td")).alias("score"), F.lit(0).cast("long").alias("all"), (F.col("split") == "test").cast("long").alias("p"), F.lit(1).cast("long").alias("known"))
    counts = grid.unionByName(pairs).groupBy("head", "score").agg(F.sum("p").alias("p"), (F.sum("all") - F.sum("known")).alias("n"))
    return metrics.running(counts)


def _grid(spark, d):
    split = graph.split_of_fold(folded(spark, d), 0)
    return degree_steps(split, table(spark, d, "supplier").select(F.col("s_suppkey").alias("head")), table(spark, d, "part").select(F.col("p_partkey").alias("tail")))


def linkpred_eval(spark, d):
    """Flagship: filtered target edges, stable folds, training degrees, ranks of all test edges in the full grid."""
    ranked = metrics.ranks(_grid(spark, d))
    out = metrics.mrr_and_tops(ranked)
    return out.select(*[F.round(c, 8).alias(c) for c in ("mrr", "top1", "top3", "top10", "top100")], "positives")


def grid_auroc(spark, d):
    return metrics.auroc(_grid(spark, d)).select("head", F.round("auroc", 8).alias("auroc"))


def grid_predict(spark, d):
    """The whole grid with score, scaled probability and flags, summed up by head.

    A sum of products of degrees over all tails is a product of sums, so no pair is made: heads meet one row of totals.
    """
    split = graph.split_of_fold(folded(spark, d), 0)
    train = split.where("split = 'train'")
    hd = table(spark, d, "supplier").select(F.col("s_suppkey").alias("head")).join(train.groupBy("head").agg(F.count("*").alias("hd")), "head", "left").na.fill(0, ["hd"])
    td = table(spark, d, "part").select(F.col("p_partkey").alias("tail")).join(train.groupBy("tail").agg(F.count("*").alias("td")), "tail", "left").na.fill(0, ["td"])
    ends = hd.agg(F.min("hd").alias("h0"), F.max("hd").alias("h1")).crossJoin(td.agg(F.min("td").alias("t0"), F.max("td").alias("t1"), F.sum("td").alias("sum"), F.count("*").alias("tails")))
    rows = with_constants(hd.join(flag_counts(split), "head", "left"), ends)
    lo, hi = F.col("h0") * F.col("t0"), F.col("h1") * F.col("t1")
    total = (F.col("hd") * F.col("sum")).cast("double")
    known = {c: F.coalesce(c, F.lit(0)) for c in ("train", "valid", "test")}
    return rows.select("head", F.round((total / F.col("tails") - lo) / (hi - lo), 8).alias("prob"), total.alias("score"), *[x.alias(c) for c, x in known.items()], (F.col("tails") - sum(known.values())).alias("negatives"))


def label_preds(spark, d):
    """head, score, prob, y: documents by source, scored by length."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.join(labels, "doc_id").select("doc_id", F.col("source").alias("head"), F.floor(F.col("n_chars") / 100).alias("score"), F.col("quality").alias("y"))
    return aggregate.min_max(rows, "score")


def minmax_scale(spark, d):
    return label_preds(spark, d).select("doc_id", F.round("prob", 8).alias("prob"))


def auroc_by_head(spark, d):
    return metrics.auroc(metrics.score_steps(label_preds(spark, d), score="prob")).select("head", F.round("auroc", 8).alias("auroc"))


def ap_by_head(spark, d):
    return metrics.average_precision(metrics.score_steps(label_preds(spark, d), score="prob")).select("head", F.round("ap", 8).alias("ap"))


def brier_by_head(spark, d):
    return metrics.brier(label_preds(spark, d)).select("head", F.round("brier", 8).alias("brier"))


def mrr_topk(spark, d):
    out = metrics.mrr_and_tops(metrics.ranks(metrics.score_steps(label_preds(spark, d)))).drop("positives")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


def sampled_mrr(spark, d):
    """As mrr_topk, after the negatives of some heads are gone, so these are ranked among all negatives."""
    preds = label_preds(spark, d).where("NOT (y = 0 AND head IN ('src1', 'src4', 'src7'))")
    out = metrics.mrr_and_tops(metrics.sampled_ranks(preds)).drop("positives")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


def best_rank_mrr(spark, d):
    return metrics.best_rank_mrr(metrics.ranks(metrics.score_steps(label_preds(spark, d)))).select(F.round("best_mrr", 8).alias("best_mrr"))


def ece(spark, d):
    return metrics.ece(label_preds(spark, d)).select(F.round("ece", 8).alias("ece"))


def evaluate_all(spark, d):
    out = metrics.evaluate(label_preds(spark, d)).drop("positives")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


def regression_metrics(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("yhat"))
    out = metrics.regression(rows, "y", "yhat")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def curve_preds(spark, d):
    """drug, protein, fold, score, test, negatives: lineitem rows as predictions of four folds."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("drug"), F.col("l_partkey").alias("protein"), (F.col("l_orderkey") % 4).cast("int").alias("fold"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("score"), (F.col("l_returnflag") == "R").alias("test"), (F.col("l_returnflag") == "N").alias("negatives")
    )


CURVE_N = 250


def confusion_curve(spark, d):
    """The curve of every fold."""
    out = errorrate.curve(curve_preds(spark, d), CURVE_N, by=["fold"])
    return out.select("fold", F.col("i").cast("long").alias("i"), "tp", "fn", "fp", "tn", *[F.round(r, 8).alias(r) for r in errorrate.RATES])


def error_rate_interp(spark, d):
    """Rates of the predictions of every fold from its own curve, by drug."""
    means = [F.round(F.avg(f"{r}_est"), 6).alias(f"{r}_est") for r in errorrate.RATES]
    return errorrate.error_rates(curve_preds(spark, d), CURVE_N, by=["fold"]).groupBy("fold", "drug").agg(F.count("*").alias("n"), *means)


def fold_aggregate_lists(spark, d):
    per_fold = curve_preds(spark, d).groupBy("drug", "protein", "fold").agg(F.max("score").alias("score"))
    out = aggregate.over_folds(per_fold, values=("score",), min_folds=2)
    return out.select("drug", "protein", F.array_join(F.transform("score", lambda x: F.floor(x * 1000).cast("string")), ",").alias("scores"), F.floor(F.col("score_mean") * 1000 + 1e-4).alias("score_mean"), "in_n_folds")


def fold_summary(spark, d):
    return aggregate.summary(curve_preds(spark, d))


def quantile_flags(spark, d):
    rows = aggregate.quantile_flags(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return rows.where("is_weak OR is_strong").select("o_orderkey", "is_weak", "is_strong")


def uncertainty_quantiles(spark, d):
    out = metrics.uncertainty(table(spark, d, "events"), "user_id", "event_type")
    return out.select("user_id", "event_type", *[F.round(c, 6).alias(c) for c in ("mean", "lcb", "ucb")])


def score_order(spark, d):
    """Top predictions of each drug by score: places after a descending sort."""
    w = Window.partitionBy("drug").orderBy(F.desc("score"), "protein", "fold", "line")
    rows = curve_preds(spark, d).withColumn("line", F.lit(0)).groupBy("drug", "protein", "fold", "line").agg(F.max("score").alias("score"))
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("drug", "protein", "fold", F.round("score", 6).alias("score"), "place")


_STEPS = f"""
    WITH sp AS ({SPLIT}), hd AS (SELECT s_suppkey AS head, count(sp.tail) AS hd FROM supplier LEFT JOIN sp ON sp.head = s_suppkey AND split = 'train' GROUP BY s_suppkey),
    td AS (SELECT p_partkey AS tail, count(sp.head) AS td FROM part LEFT JOIN sp ON sp.tail = p_partkey AND split = 'train' GROUP BY p_partkey),
    g AS (SELECT hd.head, td.tail, hd * td AS score, split FROM hd CROSS JOIN td LEFT JOIN sp ON sp.head = hd.head AND sp.tail = td.tail),
    c AS (SELECT head, score, count(*) FILTER (WHERE split = 'test') AS p, count(*) FILTER (WHERE split IS NULL) AS n FROM g GROUP BY head, score),
    s AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM c WINDOW w AS (PARTITION BY head ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""
_TOPS = "round(sum(p / rank) / sum(p), 8) AS mrr, " + ", ".join(f"round(coalesce(sum(CASE WHEN rank <= {k} THEN p END), 0) / sum(p), 8) AS top{k}" for k in metrics.TOPS)
_LABELS = """
    l AS (SELECT doc_id, source AS head, CAST(floor(n_chars / 100) AS BIGINT) AS score, quality AS y FROM documents JOIN labels USING (doc_id)),
    preds AS (SELECT *, (score - (SELECT min(score) FROM l)) / ((SELECT max(score) FROM l) - (SELECT min(score) FROM l)) AS prob FROM l)
"""
_LSTEPS = f"""
    WITH {_LABELS}, c AS (SELECT head, score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS n FROM preds GROUP BY head, score),
    s AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM c WINDOW w AS (PARTITION BY head ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""
_AUC = "round(sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p) * sum(n)), 8) AS auroc FROM s GROUP BY head HAVING sum(p) > 0 AND sum(n) > 0"
_PREDS = "SELECT l_suppkey AS drug, l_partkey AS protein, CAST(l_orderkey % 4 AS INTEGER) AS fold, l_extendedprice / l_quantity AS score, l_returnflag = 'R' AS test, l_returnflag = 'N' AS negatives FROM lineitem"
_CURVE = f"""
    WITH f AS ({_PREDS}), e AS (SELECT fold, min(score) AS lo, max(score) AS hi FROM f GROUP BY fold),
    t AS (SELECT fold, i, CASE WHEN i = {CURVE_N - 1} THEN hi ELSE lo + i * ((hi - lo) / {CURVE_N - 1}) END AS t, lo, hi FROM e, (SELECT unnest(range({CURVE_N})) AS i)),
    k AS (SELECT t.fold, i, t, lo, hi, count(*) FILTER (WHERE test AND score >= t) AS tp, count(*) FILTER (WHERE test AND score < t) AS fn, count(*) FILTER (WHERE negatives AND score >= t) AS fp, count(*) FILTER (WHERE negatives AND score < t) AS tn FROM t JOIN f ON f.fold = t.fold GROUP BY ALL),
    r AS (SELECT *, CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END AS fnr, CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr, CASE WHEN fp + tn > 0 THEN 1 - fp / (fp + tn) ELSE 0 END AS tnr, CASE WHEN fn + tp > 0 THEN 1 - fn / (fn + tp) ELSE 0 END AS tpr FROM k)
"""
_BETWEEN = ", ".join(f"greatest(0, least(1, a.{r} + CASE WHEN b.t > a.t THEN (score - a.t) / (b.t - a.t) ELSE 0 END * (coalesce(b.{r}, a.{r}) - a.{r}))) AS {r}_est" for r in errorrate.RATES)
_EVAL = {
    "auc": "(SELECT avg(v) FROM (SELECT sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS v FROM s GROUP BY head HAVING sum(p) > 0 AND sum(n) > 0))",
    "ap": "(SELECT avg(v) FROM (SELECT sum(p * tp / (tp + fp)) / sum(p) AS v FROM s GROUP BY head HAVING sum(p) > 0))",
    "brier": "(SELECT avg(v) FROM (SELECT avg((prob - y) ** 2) AS v FROM preds GROUP BY head HAVING max(y) = 1))",
}
_ECE = "SELECT sum(CASE WHEN bin < 10 THEN c * abs(conf - acc) ELSE 0 END) / sum(c) AS ece FROM (SELECT bin, count(*) AS c, avg(prob) AS conf, avg(y) AS acc FROM (SELECT prob, y, CASE WHEN prob >= 1 THEN 10 ELSE (SELECT count(*) FROM (SELECT unnest(range(1, 10)) AS k) WHERE k * 0.1::DOUBLE <= prob) END AS bin FROM preds) GROUP BY bin)"

QUERIES = {
    f.__name__: f
    for f in (
        linkpred_eval, grid_auroc, grid_predict, minmax_scale, auroc_by_head, ap_by_head, brier_by_head, mrr_topk, sampled_mrr, best_rank_mrr, ece, evaluate_all, regression_metrics,
        confusion_curve, error_rate_interp, fold_aggregate_lists, fold_summary, quantile_flags, uncertainty_quantiles, score_order,
    )
}
#: Names under which the same queries were registered before.
QUERIES |= {f"{k}_all": QUERIES[k] for k in ("confusion_curve", "error_rate_interp")}

ORACLE_SQL = {
    "linkpred_eval": f"{_STEPS}, r AS (SELECT p, fp + 1 AS rank FROM s WHERE p > 0) SELECT {_TOPS}, CAST(sum(p) AS BIGINT) AS positives FROM r",
    "grid_auroc": f"{_STEPS} SELECT head, {_AUC}",
    "grid_predict": f"""{_STEPS}, b AS (SELECT min(score)::DOUBLE AS lo, max(score)::DOUBLE AS hi FROM g)
        SELECT head, round(avg((score - lo) / (hi - lo)), 8) AS prob, CAST(sum(score) AS DOUBLE) AS score, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'valid') AS valid, count(*) FILTER (WHERE split = 'test') AS test, count(*) FILTER (WHERE split IS NULL) AS negatives FROM g, b GROUP BY head""",
    "minmax_scale": f"WITH {_LABELS} SELECT doc_id, round(prob, 8) AS prob FROM preds",
    "auroc_by_head": f"{_LSTEPS} SELECT head, {_AUC}",
    "ap_by_head": f"{_LSTEPS} SELECT head, round(sum(p * tp / (tp + fp)) / sum(p), 8) AS ap FROM s GROUP BY head HAVING sum(p) > 0",
    "brier_by_head": f"WITH {_LABELS} SELECT head, round(avg((prob - y) ** 2), 8) AS brier FROM preds GROUP BY head HAVING max(y) = 1",
    "mrr_topk": f"{_LSTEPS}, r AS (SELECT p, fp + 1 AS rank FROM s WHERE p > 0) SELECT {_TOPS} FROM r",
    "sampled_mrr": f"""
        WITH {_LABELS}, q AS (SELECT * FROM preds WHERE NOT (y = 0 AND head IN ('src1', 'src4', 'src7'))),
        r AS (SELECT 1 AS p, 1 + CASE WHEN EXISTS (SELECT 1 FROM q n WHERE n.head = q.head AND n.y = 0) THEN (SELECT count(*) FROM q n WHERE n.head = q.head AND n.y = 0 AND n.score >= q.score) ELSE (SELECT count(*) FROM q n WHERE n.y = 0 AND n.score >= q.score) END AS rank FROM q WHERE y = 1)
        SELECT {_TOPS} FROM r""",
    "best_rank_mrr": f"{_LSTEPS} SELECT round(avg(1 / rank), 8) AS best_mrr FROM (SELECT head, min(fp + 1) AS rank FROM s WHERE p > 0 GROUP BY head)",
    "ece": f"WITH {_LABELS} SELECT round(ece, 8) AS ece FROM ({_ECE})",
    "evaluate_all": f"{_LSTEPS}, r AS (SELECT p, fp + 1 AS rank FROM s WHERE p > 0) SELECT {_TOPS}, round({_EVAL['auc']}, 8) AS avg_auc, round({_EVAL['ap']}, 8) AS avg_ap, round({_EVAL['brier']}, 8) AS avg_brier, round((SELECT ece FROM ({_ECE})), 8) AS ece FROM r",
    "regression_metrics": """
        WITH r AS (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5::DOUBLE AS yhat FROM lineitem)
        SELECT round(corr(y, yhat), 6) AS pearson, round(1 - avg((y - yhat) ** 2) / (var_pop(y) + 1e-8), 6) AS r2, round(avg((y - yhat) ** 2), 6) AS mse, round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat) ** 2)), 6) AS rmse FROM r""",
    "confusion_curve": f"{_CURVE} SELECT fold, i, tp, fn, fp, tn, round(fnr, 8) AS fnr, round(fpr, 8) AS fpr, round(tnr, 8) AS tnr, round(tpr, 8) AS tpr FROM r",
    "error_rate_interp": f"""{_CURVE}, x AS (SELECT f.*, least({CURVE_N - 1}, CAST(floor((score - lo) / (hi - lo) * {CURVE_N - 1}) AS BIGINT)) AS i FROM f JOIN e USING (fold)),
        v AS (SELECT x.fold, drug, {_BETWEEN} FROM x JOIN r a ON a.fold = x.fold AND a.i = x.i LEFT JOIN r b ON b.fold = x.fold AND b.i = x.i + 1)
        SELECT fold, drug, count(*) AS n, {', '.join(f'round(avg({r}_est), 6) AS {r}_est' for r in errorrate.RATES)} FROM v WHERE fnr_est >= 0.5 AND fpr_est <= 1 GROUP BY fold, drug""",
    "fold_aggregate_lists": f"""
        WITH m AS (SELECT drug, protein, fold, max(score) AS score FROM ({_PREDS}) GROUP BY ALL)
        SELECT drug, protein, string_agg(CAST(CAST(floor(score * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY fold) AS scores, CAST(floor(avg(score) * 1000 + 1e-4) AS BIGINT) AS score_mean, count(*) AS in_n_folds FROM m GROUP BY drug, protein HAVING count(*) >= 2""",
    "fold_summary": f"SELECT count(*) AS n_predictions, count(DISTINCT drug) AS n_unique_drugs, count(DISTINCT protein) AS n_unique_proteins FROM ({_PREDS})",
    "quantile_flags": "WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS w, quantile_cont(o_totalprice, 0.95) AS s FROM orders) SELECT o_orderkey, o_totalprice < w AS is_weak, o_totalprice > s AS is_strong FROM orders, q WHERE o_totalprice < w OR o_totalprice > s",
    "uncertainty_quantiles": "SELECT user_id, event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS lcb, round(quantile_cont(value, 0.95), 6) AS ucb FROM events GROUP BY user_id, event_type",
    "score_order": f"SELECT drug, protein, fold, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY score DESC, protein, fold) AS place FROM (SELECT drug, protein, fold, max(score) AS score FROM ({_PREDS}) GROUP BY ALL)) WHERE place <= 3",
}
ORACLE_SQL |= {f"{k}_all": ORACLE_SQL[k] for k in ("confusion_curve", "error_rate_interp")}
