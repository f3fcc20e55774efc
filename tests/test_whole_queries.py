"""Queries over whole tables, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom import schema
from kgloom.operators import errorrate, kge, similarity
from kgloom.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("q", [0.99, 0.5, 0.0])
def test_cosine_above_quantile_over_all_pairs(spark, q):
    x = np.random.default_rng(3).normal(size=(150, 4))
    x[20:40] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.triu_indices(150, 1)
    cos = (u @ u.T)[i, j]
    got = similarity.cosine_above_quantile(df, q, block_rows=40, bins=64).collect()
    want = cos > np.quantile(cos, q) + 1e-12
    assert {(r.i, r.j) for r in got if r.cos > np.quantile(cos, q) + 1e-12} == set(zip(i[want].tolist(), j[want].tolist()))
    assert all(r.cos > np.quantile(cos, q) - 1e-12 for r in got)


def test_top_tails_over_all_pairs(spark):
    rng = np.random.default_rng(5)
    u, v, r = rng.normal(size=(60, 6)), rng.normal(size=(70, 6)), rng.normal(size=6)
    side = lambda x: spark.createDataFrame([(i, a[:3].tolist(), a[3:].tolist()) for i, a in enumerate(x)], "id long, re array<double>, im array<double>")
    rel = spark.createDataFrame([(r[:3].tolist(), r[3:].tolist())], "re array<double>, im array<double>")
    s = (u[:, :3] * r[:3]) @ v[:, :3].T + (u[:, 3:] * r[:3]) @ v[:, 3:].T + (u[:, :3] * r[3:]) @ v[:, 3:].T - (u[:, 3:] * r[3:]) @ v[:, :3].T
    want = {(h, t) for h in range(60) for t in np.argsort(-(s[h] ** 2))[:4].tolist()}
    got = kge.top_tails(side(u), side(v), rel, 4, block_rows=25).collect()
    assert {(x.head, x.tail) for x in got} == want
    assert all(abs(x.score - s[x.head, x.tail] ** 2) < 1e-9 for x in got)


def test_whole_queries_use_all_rows(spark):
    q = registry.queries()
    n = spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    for name in ("trilinear_score_all", "log_prob_all"):
        out = q[name](spark, SMALL)
        assert out.count() == 10 * n and out.select("head").distinct().count() == n
    assert q["partition_function_all"](spark, SMALL).first().z > 0
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet").withColumn("fold", F.col("l_orderkey") % 4)
    want = {r.fold: (r.p, r.q) for r in li.groupBy("fold").agg(F.sum((F.col("l_returnflag") == "R").cast("long")).alias("p"), F.sum((F.col("l_returnflag") == "N").cast("long")).alias("q")).collect()}
    curve = q["confusion_curve_all"](spark, SMALL).collect()
    assert len(curve) == 1000 and {(r.fold, r.tp + r.fn, r.fp + r.tn) for r in curve} == {(k, *v) for k, v in want.items()}
    assert {r.fold for r in q["error_rate_interp_all"](spark, SMALL).collect()} == {0, 1, 2, 3}
    hops, some = q["khop_diffusion_all"](spark, SMALL), q["khop_diffusion"](spark, SMALL)
    assert hops.select("source").distinct().count() > some.select("source").distinct().count() and some.exceptAll(hops).count() == 0


def test_score_grid_joins_no_pair(spark):
    rng = np.random.default_rng(9)
    u, v, r = rng.normal(size=(12, 6)), rng.normal(size=(31, 6)), rng.normal(size=6)
    side = lambda x: spark.createDataFrame([(i, a[:3].tolist(), a[3:].tolist()) for i, a in enumerate(x)] + [(99, None, None)], "id long, re array<double>, im array<double>")
    rel = spark.createDataFrame([(r[:3].tolist(), r[3:].tolist())], "re array<double>, im array<double>")
    pairs = side(u).selectExpr("id AS head").crossJoin(side(v).selectExpr("id AS tail"))
    want, got = kge.score_pairs(pairs, side(u), side(v), rel), kge.score_grid(side(u), side(v), rel, 50)
    assert got.count() == 13 * 32 and want.select("head", "tail", "score").exceptAll(got).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_cosine_blocks_grow_with_the_table(spark):
    """Rows are repeated for as many blocks as there are: a bounded number until blocks are full."""
    df = spark.range(40_000).selectExpr("id", "array(1.0D, double(id % 7)) AS embedding")
    pairs = similarity._block_pairs(df, "id", "embedding", True, None)
    assert pairs.count() == 40_000 * 9 and similarity._block_rows(df, "embedding") == 5000


def test_quantile_between_two_steps(spark):
    """The quantile lies between the last pair of a step and the first of a later one."""
    x = [[1.0, 0.0], [1.0, 0.001], [0.0, 1.0]]
    df = spark.createDataFrame(list(enumerate(x)), "id long, embedding array<double>")
    for q, n in ((0.75, 1), (0.25, 2), (1.0, 0), (0.0, 2)):
        assert similarity.cosine_above_quantile(df, q, bins=64).count() == n


def test_pairs_of_orders_have_partitions_by_rows(spark, monkeypatch):
    """Whatever bytes adaptive execution would put together, a task has a bounded number of lines and pairs."""
    monkeypatch.setattr(schema, "TASK_ROWS", 1000)
    n = -(-spark.read.parquet(f"{SMALL}/lineitem.parquet").count() // 1000)
    out = registry.queries()["bool_partition_edges"](spark, SMALL)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f", {n}), REPARTITION_BY_NUM" in plan and f", {4 * n}), REPARTITION_BY_NUM" in plan


def test_predictions_are_not_dealt_by_fold(spark):
    """Four folds would be four tasks; curves and thresholds are tables of known size, which are broadcast."""
    preds = spark.range(4000).select((F.col("id") % 4).alias("fold"), (F.col("id") * 37 % 1009).cast("double").alias("score"), (F.col("id") % 3 == 0).alias("test"), (F.col("id") % 3 == 1).alias("negatives"))
    out = errorrate.error_rates(preds.repartition(5, "score"), 20, 0.0, 1.0, by=["fold"])
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 4000


def test_links_multiply_blocks_once(spark):
    out = registry.queries()["cosine_join_links"](spark, SMALL)
    assert out._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 1


def test_hops_read_written_edges(spark):
    """Each hop would filter and shuffle the lines again."""
    plan = registry.queries()["leave_one_out_paths"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan
