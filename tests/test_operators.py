"""Hand-computed fixtures and properties of the graph and prediction operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.functions.vectors import mean_pool, residues
from kgloom.operators import aggregate, diffusion, embed, errorrate, graph, kge, metrics, negatives, relations, similarity
from kgloom.schema import first_known, group_by_known, holds, null_safe_join, position, product


def rows(df, *order):
    return sorted((tuple(r[c] for c in order) if order else tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def edges_small(spark):
    data = [
        ("d1", "g1", "drug", "gene", "targets"), ("d1", "g1", "drug", "gene", "targets"), ("d2", "g1", "drug", "gene", "targets"), ("d2", "g2", "drug", "gene", "targets"), ("d3", None, "drug", "gene", "targets"), (None, "g9", "drug", "gene", "targets"),
        ("g1", "s1", "gene", "disease", "assoc_fwd"), ("g2", "s1", "gene", "disease", "assoc_fwd"), ("d1", "s1", "drug", "disease", "treats"), ("x", "x", "gene", "drug", "odd"),
    ]
    return spark.createDataFrame(data, "src string, dst string, src_type string, dst_type string, relation string")


def test_dictionary_and_index(edges_small):
    nodes, rels, indexed = graph.build(edges_small)
    assert rows(nodes, "node_type", "idx", "name") == [("disease", 0, "s1"), ("drug", 0, "d1"), ("drug", 1, "d2"), ("drug", 2, "x"), ("gene", 0, "g1"), ("gene", 1, "g2"), ("gene", 2, "x")]
    assert rows(rels, "rel_id", "relation") == [(0, "targets"), (1, "treats"), (2, "assoc_fwd"), (3, "odd")]
    assert indexed.count() == 7 and graph.indexed_edges(edges_small, nodes, rels, keep_duplicates=True).count() == 8
    back = indexed.join(rels, "rel_id").join(nodes.select(F.col("node_type").alias("src_type"), F.col("idx").alias("src_idx"), F.col("name").alias("src")), ["src_type", "src_idx"])
    assert rows(back.where("relation = 'targets'"), "src") == [("d1",), ("d2",), ("d2",)]
    stats = graph.graph_stats(nodes, indexed).first()
    assert (stats.n_node, stats.n_edge, stats.node_counts["gene"], stats.edge_counts[0]) == (7, 7, 3, 3)


def test_reverse_closure_and_flags(spark, edges_small):
    assert rows(relations.reversed_edges(edges_small.where("relation = 'assoc_fwd'")))[0] == ("s1", "g1", "disease", "gene", "assoc_rev")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "a long, b long")
    closed = relations.symmetric_closure(pairs, "a", "b")
    assert rows(closed) == [(1, 2), (2, 1), (3, 4), (4, 3)] == rows(relations.symmetric_closure(closed, "a", "b"))
    assert rows(relations.missing_reverse(pairs, "a", "b")) == [(3, 4)] and relations.missing_reverse(closed, "a", "b").count() == 0
    flags = spark.createDataFrame([(1, True, True), (2, None, True), (3, False, None)], "k int, s boolean, i boolean")
    assert rows(relations.flag_partition(flags, "s", "i"), "k", "relation") == [(1, "inhibits"), (1, "stimulates"), (2, "inhibits"), (3, "interacts")]


def test_null_traps(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("x", 3), (None, 4)], "k string, b int")
    assert sorted((r.a, r.b) for r in null_safe_join(a, b, ["k"], "inner").collect()) == [(1, 3), (2, 4)]
    assert group_by_known(a, "k").count().count() == 1
    assert relations.known_pairs_removed(a, b, ["k"]).count() == 0
    assert relations.known_pairs_removed(a, b.withColumn("e", F.when(F.col("b") == 3, 1)), ["k"], "e").count() == 1
    f = spark.createDataFrame([("g", 1, None, "p"), ("g", 2, 5, "q")], "k string, pos int, a int, b string")
    assert rows(f.groupBy("k").agg(first_known("a", "pos").alias("a"), first_known("b", "pos").alias("b"))) == [("g", 5, "p")]
    s = spark.createDataFrame([("MIR1",), (None,), ("TP53",)], "s string")
    assert relations.drop_prefix(s, "s", "MIR").count() == 2 and s.where(~holds(F.col("s") == "TP53")).count() == 2


def test_target_filter_is_inclusive(spark):
    df = spark.createDataFrame([("T1", "Kd", 1000.0, "="), ("T1", "Kd", 1000.1, "="), (None, "Ki", 1.0, "<"), ("T2", "Kd", 1.0, "="), ("T1", "Ki", 5.0, ">"), ("T1", "Kd", None, "=")], "tier string, kind string, v double, sign string")
    assert relations.target_filter(df, "tier", ["T1"], "kind", ["Kd", "Ki"], "v", 1000, "sign").count() == 1
    assert relations.target_filter(df, "tier", ["T1"], "kind", ["Kd", "Ki"], "v", 1000, "sign", default_tier="T1").count() == 2


def test_position_product_and_folds(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x long").repartition(5)
    assert all(r.pos == r.x for r in position(df, "x").collect())
    folded = graph.with_folds(df, ["x"], 10)
    assert {r["count"] for r in folded.groupBy("fold").count().collect()} == {10, 11}
    splits = graph.all_splits(folded, 10)
    per = {(r.of_fold, r.split): r["count"] for r in splits.groupBy("of_fold", "split").count().collect()}
    assert all(sum(per.get((k, s), 0) for s in ("train", "valid", "test")) == 101 for k in range(10))
    assert sum(per[k, "test"] for k in range(10)) == 101
    other = spark.range(30).withColumnRenamed("id", "y")
    assert product(df, other).count() == 3030


def test_product_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("kgloom.schema.small", lambda d, rows=0: False)
    a, b = spark.range(13).withColumnRenamed("id", "a"), spark.range(17).withColumnRenamed("id", "b")
    assert rows(product(a, b, blocks=4), "a", "b") == [(i, j) for i in range(13) for j in range(17)]


def brute_metrics(data):
    heads = {}
    for h, s, p, y in data:
        heads.setdefault(h, []).append((s, p, y))
    auc, ap, br, rk = {}, {}, {}, []
    for h, x in heads.items():
        pos, neg = [r for r in x if r[2]], [r for r in x if not r[2]]
        if not pos:
            continue
        if neg:
            auc[h] = sum((a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a in pos for b in neg) / len(pos) / len(neg)
        steps = sorted({r[1] for r in x}, reverse=True)
        prec = lambda t: sum(r[2] for r in x if r[1] >= t) / sum(r[1] >= t for r in x)
        ap[h] = sum(sum(r[2] for r in x if r[1] == t) / len(pos) * prec(t) for t in steps)
        br[h] = sum((r[1] - r[2]) ** 2 for r in x) / len(x)
        rk += [1 + sum(b[0] >= a[0] for b in neg) for a in pos]
    return auc, ap, br, rk


def test_metrics_with_ties(spark):
    rng = random.Random(0)
    data = [(h, float(rng.randint(0, 4)), rng.choice([0.0, 0.3, 0.6, 0.7, 1.0]), int(rng.random() < 0.4)) for h in range(6) for _ in range(12)] + [(9, 1.0, 0.5, 0)] * 3 + [(10, 1.0, 1.0, 1)]
    df = spark.createDataFrame(data, "head long, score double, prob double, y int")
    auc, ap, br, rk = brute_metrics(data)
    close = lambda d, n, want: {r["head"]: pytest.approx(r[n]) for r in d.collect()} == want
    by_prob = metrics.score_steps(df, score="prob")
    assert close(metrics.auroc(by_prob), "auroc", auc) and close(metrics.average_precision(by_prob), "ap", ap) and close(metrics.brier(df), "brier", br)
    m = metrics.mrr_and_tops(metrics.ranks(metrics.score_steps(df))).first()
    assert m.mrr == pytest.approx(np.mean([1 / r for r in rk])) and m.top3 == pytest.approx(np.mean([r <= 3 for r in rk]))
    p, y = np.array([r[2] for r in data]), np.array([r[3] for r in data])
    bins = np.digitize(p, [i * 0.1 for i in range(1, 10)] + [1.0])
    want = sum((bins == b).sum() * abs(p[bins == b].mean() - y[bins == b].mean()) for b in range(10) if (bins == b).any()) / len(p)
    assert metrics.ece(df).first().ece == pytest.approx(want)
    mono = df.withColumn("prob", F.exp("prob") - 3)
    assert rows(metrics.auroc(metrics.score_steps(mono, score="prob"))) == rows(metrics.auroc(by_prob))
    assert metrics.evaluate(df).first().avg_auc == pytest.approx(np.mean(list(auc.values())))
    with pytest.raises(ValueError):
        metrics.evaluate(df, "some")


def test_sampled_ranks_fall_back_to_all_negatives(spark):
    data = [(1, 5.0, 1), (1, 6.0, 0), (1, 5.0, 0), (2, 5.5, 1), (3, 9.0, 0)]
    df = spark.createDataFrame([(h, s, s / 10, y) for h, s, y in data], "head long, score double, prob double, y int")
    assert rows(metrics.sampled_ranks(df), "head", "rank") == [(1, 3), (2, 3)]


def test_error_rates_equal_interpolation(spark):
    rng = np.random.default_rng(1)
    score = np.concatenate([rng.normal(1, 1, 40), np.linspace(-2, 2, 21), rng.normal(0, 1, 40)]).round(2)
    test, neg = np.arange(101) < 40, np.arange(101) >= 61
    df = spark.createDataFrame(list(zip(score.tolist(), test.tolist(), neg.tolist())), "score double, test boolean, negatives boolean")
    n = 41
    t = np.linspace(score.min(), score.max(), n)
    got = errorrate.curve(df, n).orderBy("i").toPandas()
    t = got.t.to_numpy()
    fnr, fpr = np.array([(score[test] < x).mean() for x in t]), np.array([(score[neg] >= x).mean() for x in t])
    assert np.allclose(got.fnr, fnr) and np.allclose(got.fpr, fpr) and np.allclose(got.tpr + got.fnr, 1)
    assert (np.diff(got.fnr) >= 0).all() and (np.diff(got.fpr) <= 0).all()
    est = errorrate.estimate(df, errorrate.curve(df, n), n).toPandas()
    assert np.allclose(est.fnr_est, np.interp(est.score, t, fnr)) and np.allclose(est.fpr_est, np.interp(est.score, t, fpr))
    none = errorrate.curve(df.withColumn("test", F.lit(False)), 5).collect()
    assert {(r.fnr, r.tpr) for r in none} == {(0.0, 0.0)}


def test_fold_lists(spark):
    df = spark.createDataFrame([(1, 1, 2, 0.3), (1, 1, 0, 0.1), (2, 1, 1, 0.5), (None, 1, 0, 0.1)], "drug long, protein long, fold int, score double")
    got = aggregate.over_folds(df, values=("score",), min_folds=1).orderBy("drug").collect()
    assert [(list(r.score), round(r.score_mean, 6), r.in_n_folds) for r in got] == [([0.1, 0.3], 0.2, 2), ([0.5], 0.5, 1)]
    assert aggregate.over_folds(df, values=("score",), min_folds=2).count() == 1


def test_similarity_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)).round(1)
    x[7] = x[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if c[i, j] > 0.5}
    assert {(r.i, r.j) for r in similarity.cosine_above(df, 0.5, block_rows=17).collect()} == want
    knn = {(r.i, r["rank"]): r.j for r in similarity.cosine_knn(df, 3, block_rows=17).collect()}
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-round(c[i, j], 12), j))
        assert [knn[i, k] for k in (1, 2, 3)] == order[:3]
    g = np.zeros((5, 5))
    for r in similarity.gram(df).collect():
        g[r.i, r.j] = r.s
    assert np.allclose(g, x.T @ x)


def test_negatives_are_new_and_near(spark):
    pos = spark.createDataFrame([(i % 5, i * 3 % 11) for i in range(25)], "head long, tail long").distinct()
    known = set(rows(pos, "head", "tail"))
    for which in ("head", "tail", "both"):
        got = negatives.corrupted(pos, pos, 2, 5, 11, which).collect()
        assert got and all((r.neg_head, r.neg_tail) not in known for r in got)
        assert all((r.neg_head == r["head"]) or (r.neg_tail == r["tail"]) for r in got)
        assert which != "tail" or all(r.neg_head == r["head"] for r in got)
    assert len(got) <= 2 * len(known)


def test_partition_function(spark):
    rng = np.random.default_rng(4)
    d, n, m = 2, 3, 4
    u, v, r = rng.normal(size=(n, 2 * d)), rng.normal(size=(m, 2 * d)), rng.normal(size=2 * d)
    side = lambda x: spark.createDataFrame([(i, a[:d].tolist(), a[d:].tolist()) for i, a in enumerate(x)], "id long, re array<double>, im array<double>")
    rel = side(r[None]).drop("id")
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(m)], "head long, tail long")
    scored = kge.score_pairs(pairs, side(u), side(v), rel)
    z = kge.partition_function(side(u), side(v), rel).first().z
    assert z == pytest.approx(scored.agg(F.sum("score")).first()[0])
    lp = kge.log_prob(scored, kge.partition_function(side(u), side(v), rel), n, m).first()
    assert lp.log_prob == pytest.approx(math.log(lp.score + 1 / (n * m)) - math.log1p(z))


def test_early_stop():
    stop = kge.EarlyStop(1)
    assert [stop.update(x, i) for i, x in enumerate([3.0, 2.0, 2.0, 5.0, 1.0, 4.0, 4.0])] == [False, False, False, True, False, False, True] and stop.state == 4
    stop = kge.EarlyStop(1)
    assert [stop.update(x, i) for i, x in enumerate([2.0, 2.0, 2.0])] == [False, False, True] and stop.state == 2


def test_diffusion_and_attention(spark):
    e = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 0)], "src long, dst long")
    s = spark.createDataFrame([(0,)], "node long")
    assert rows(diffusion.khop(s, e, 2), "node", "value") == [(3, 2)] and rows(diffusion.khop(s, e, 4), "node", "value") == [(1, 2), (2, 2)]
    a = diffusion.attention(e.withColumn("logit", F.col("src") * 1.0))
    assert all(r.s == pytest.approx(1) for r in a.groupBy("dst").agg(F.sum("alpha").alias("s")).collect())
    nodes = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "node long, v array<double>")
    rel = spark.createDataFrame([(0, [[1.0, 0.0], [1.0, 1.0]])], "rel_id long, rows array<array<double>>")
    typed = spark.createDataFrame([(0, 0, 2), (0, 1, 2)], "rel_id long, src long, dst long")
    assert [list(r.value) for r in diffusion.bilinear_messages(nodes, typed, rel).collect()] == [[4.0, 10.0]]


def test_text_helpers(spark):
    df = spark.createDataFrame([(" mkU ",), ("",), (None,)], "s string").select(residues(F.col("s")).alias("r"))
    assert [r.r for r in df.collect()] == ["M K X", "X", "X"]
    p = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert list(p.select(mean_pool(F.col("t"), F.col("m"), 2).alias("p")).first().p) == [2.0, 3.0]
    texts = spark.createDataFrame([(1, "abc"), (2, " abc "), (3, ""), (4, None), (5, "X"), (6, "some longer text, some longer text")], "id long, t string")
    e = {r.id: list(r.embedding) for r in embed.hashed_embedding(texts, "id", "t", 16).collect()}
    assert e[1] == e[2] and e[3] == e[4] == e[5] and all(sum(x * x for x in v) == pytest.approx(1, abs=1e-5) for v in e.values()) and len(e[6]) == 16


def test_blocked_step_shuffles_no_message(spark):
    """Every message of a hop in cells of sources and destinations: the sums of step(), null names and absent ends included."""
    from kgloom.storage import materialize

    edges = spark.range(4000).selectExpr("concat('a', id % 60) AS src", "CASE WHEN id % 97 > 0 THEN concat('b', id % 211) END AS dst")
    state = materialize(spark.range(2000).selectExpr("concat('s', id % 40) AS source", "concat('a', id % 70) AS node", "id AS value"), "state")
    want, got = diffusion.step(state, edges), diffusion.blocked_step(state, edges, 5000)
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0 and got.count() > 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "HashAggregate" not in plan.split("FlatMapGroupsInArrow")[0] and "weight" not in edges.columns


def test_blocked_step_shuffles_states_and_edges_once(spark):
    """Rows that are shuffled don't grow with the pairs of blocks; far more messages than rows, sums beyond doubles, negative values, and few sums among many places."""
    from kgloom.storage import materialize

    store = spark.sparkContext._jsc.sc().statusStore()
    none, doubles_ = spark.sparkContext._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, doubles_, none)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    edges = materialize(spark.range(1200).selectExpr("concat('a', id % 40) AS src", "concat('b', id) AS dst"), "edges")
    for value in ("IF(id % 5 = 0, -id, id)", "IF(id % 5 = 0, -id, 9007199254740993 + id)"):
        state = materialize(spark.range(4800).selectExpr("CASE WHEN id % 1600 > 3 THEN concat('s', id % 1600) END AS source", "concat('a', id % 43) AS node", f"{value} AS value"), "state")
        want, sent = materialize(diffusion.step(state, edges), "want"), []
        for most in (4000, 400):
            before = shuffled()
            got = materialize(diffusion.blocked_step(state, edges, most), "got")
            sent.append(shuffled() - before)
            assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0 and got.count() > 100_000
        assert sent[1] < 1.2 * sent[0] and sent[1] < 4 * (4800 + 1200)


def test_hops_start_at_every_supplier(spark):
    """No supplier with a path of three hops is left out, by the query or its SQL."""
    from kgloom.plans import graph_queries as g

    d = "/root/testdata/sf0.001"
    want = g.target(spark, d).join(spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey AS head"), "head").select("head").distinct().count()
    assert g.khop_diffusion(spark, d).select("source").distinct().count() == want > 1 and "% 50" not in g.ORACLE_SQL["khop_diffusion"]
