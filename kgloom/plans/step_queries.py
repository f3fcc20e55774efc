"""Whole steps of the workflow, and filters that only they use, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.operators import diffusion, graph, relations
from kgloom.plans import workflow
from kgloom.plans.graph_queries import TARGET, target
from kgloom.plans.link_queries import _drawn_sql, _typed_pairs
from kgloom.plans.prediction_queries import _CURVE, _BETWEEN, CURVE_N, curve_preds
from kgloom.storage import table


def _assays(spark, d):
    """Line items as assays: returned ones have no tier."""
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("D"), F.col("l_suppkey").cast("string")).alias("inchikey"), F.concat(F.lit("G"), F.col("l_partkey").cast("string")).alias("gene_symbol"),
        F.when(F.col("l_linenumber") % 2 == 0, "Kd").otherwise("IC50").alias("assay_type"), F.col("l_quantity").alias("assay_value"), F.when(F.col("l_returnflag") != "R", F.concat(F.lit("TIER_"), "l_returnflag")).alias("tier"),
    )


def step_target(spark, d):
    """Metadata rows of the target relation; assays without a tier count as tier A."""
    return workflow.target_relation(_assays(spark, d), ("Kd",), 20.0, ("TIER_A",), "TIER_A")[0]


def step_association(spark, d):
    """Orders of customers as associations in both directions, evidence only for some, within a space of customers."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "direct").alias("evidence"))
    space = table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    return workflow.association_relation(rows, "o_orderkey", "o_custkey", "gene", "disease", "associates", "evidence", space)


def step_interactions(spark, d):
    """Interactions with flags and names that may be lists, counted by relation."""
    li = table(spark, d, "lineitem").where("l_linenumber <= 2")
    rows = li.select(F.concat_ws("|", F.col("l_partkey").cast("string"), F.lit("x")).alias("source"), F.col("l_suppkey").cast("string").alias("target"), (F.col("l_returnflag") == "R").alias("consensus_stimulation"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity") > 25).alias("consensus_inhibition"))
    return workflow.interaction_relations(rows).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("src").alias("n_src"))


def step_strong_binding(spark, d):
    """Edges of orders beyond both quantiles, names with a prefix left out."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("inchikey"), F.col("o_orderpriority").alias("gene_symbol"), F.col("o_totalprice").alias("kd_score"), (F.col("o_totalprice") - F.col("o_custkey") % 7).alias("kd_lcb"))
    return workflow.strong_binding_relation(rows, 0.9, 0.1, "1-")


def step_assemble(spark, d):
    """Triples of all folds by split, of a graph without a denied relation."""
    edges = relations.edges(target(spark, d), "head", "tail", "drug", "gene", "targets").unionByName(relations.with_reverse(relations.edges(table(spark, d, "part"), "p_partkey", "p_brand", "gene", "brand", "of_fwd")))
    return workflow.assemble(edges, k_folds=5, deny=["of_rev"])[2].groupBy("fold", "split", "head_type").agg(F.count("*").alias("n"))


def step_aggregate(spark, d):
    """Predictions of all folds put together, best mean first, with names."""
    preds = curve_preds(spark, d).groupBy("drug", "protein", "fold").agg(F.max("score").alias("score"), F.max("test").alias("test"), F.min("negatives").alias("negatives"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("drug"), "s_name")
    out = workflow.aggregate_folds(preds, [names], CURVE_N, 0.5, 1.0, 2)
    return out.select("drug", "protein", "s_name", "in_n_folds", F.floor(F.col("score_mean") * 1000 + 1e-4).alias("score_mean"), F.round("fnr_est_mean", 6).alias("fnr_est_mean"))


def step_novel(spark, d):
    """Predictions without a measured value; a missing key counts as a key."""
    key = F.when(F.col("l_partkey") % 10 > 0, F.col("l_partkey"))
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("drug"), key.alias("protein"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("assay_value"))
    return workflow.novel_predictions(li.select("drug", "protein").distinct(), li, ["drug", "protein"])


def step_evaluate(spark, d):
    preds = curve_preds(spark, d).where("score IS NOT NULL").withColumn("prob", F.col("score") / 10000)
    out = workflow.evaluate(preds.drop("fold", "protein"))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mrr", "top10", "avg_auc", "avg_brier")], "positives")


def drop_prefix(spark, d):
    return relations.drop_prefix(table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).alias("p_type")), "p_type", "STANDARD")


def binarized(spark, d):
    return relations.binarized(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value")), 100000.0)


def leave_one_out(spark, d):
    """Edges without those of the examples at hand: every tail divisible by 50."""
    known = target(spark, d)
    return graph.leave_one_out(known, known.where("tail % 50 = 0"), "head", "tail")


def bilinear_messages(spark, d):
    """One layer: two-number vectors of suppliers through a matrix to the parts they target."""
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.array(F.col("s_acctbal"), F.col("s_nationkey").cast("double")).alias("v"))
    edges = target(spark, d).select(F.lit(0).alias("rel_id"), F.col("head").alias("src"), F.col("tail").alias("dst"))
    matrix = spark.createDataFrame([(0, [[1.0, 0.5], [0.0, -2.0]])], "rel_id int, rows array<array<double>>")
    out = diffusion.bilinear_messages(nodes, edges, matrix)
    return out.select("node", F.round(F.col("value")[0], 4).alias("a"), F.round(F.col("value")[1], 4).alias("b"))


def mean_messages(spark, d):
    """The mean over incoming edges."""
    state = target(spark, d).select("head").distinct().select(F.lit(0).alias("source"), F.col("head").alias("node"), F.col("head").cast("double").alias("value"))
    edges = target(spark, d).select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    return diffusion.step(state, edges, "mean").select("node", F.round("value", 6).alias("value"))


LINES = ("1-URGENT", "2-HIGH")


def step_perturbations(spark, d):
    """Orders as signatures of customers in two cell lines, lines of orders as their values: edges of strong ones, both ways."""
    signatures = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("sig_id"), F.col("o_custkey").alias("pert_id"), F.col("o_orderpriority").alias("cell_iname"), F.when(F.col("o_orderkey") % 2 == 0, 10.0).otherwise(5.0).alias("pert_dose"),
        F.when(F.col("o_orderkey") % 5 < 4, 24.0).alias("pert_time"), (F.col("o_orderstatus") != "P").cast("int").alias("is_exemplar_sig"),
    )
    compounds = table(spark, d, "customer").select(F.col("c_custkey").alias("pert_id"), F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("inchi_key"))
    genes = table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene_symbol"))
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sig_id"), F.col("l_partkey").cast("string").alias("gene_id"), (F.col("l_quantity") - 30).alias("value"))
    return workflow.perturbation_relations(signatures, compounds, genes, cells, LINES)


def step_negatives(spark, d):
    """Nations of suppliers and sizes of parts: pairs and four negatives of each, scored by a sum of their numbers."""
    pairs = _typed_pairs(spark, d).where("relation = 0").select("head", "tail")
    out = workflow.predict_with_negatives(pairs, pairs, lambda rows: rows.withColumn("score", (F.col("head") * 2 + F.col("tail")).cast("double")), 4, 25, 50, "tail")
    return out.select("head", "tail", "y", F.round("prob", 8).alias("prob"))


QUERIES = {
    f.__name__: f
    for f in (
        step_target, step_association, step_interactions, step_strong_binding, step_assemble, step_aggregate, step_novel, step_evaluate, drop_prefix, binarized, leave_one_out, bilinear_messages, mean_messages, step_perturbations, step_negatives,
    )
}

_BOTH = "SELECT CAST(o_orderkey AS VARCHAR) AS o, CAST(o_custkey AS VARCHAR) AS c FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)"
_INTER = """
    WITH l AS (SELECT CAST(l_partkey AS VARCHAR) AS s, CAST(l_suppkey AS VARCHAR) AS t, l_returnflag = 'R' AS stim, coalesce(CASE WHEN l_linestatus = 'F' THEN l_quantity > 25 END, false) AS inhib FROM lineitem WHERE l_linenumber <= 2),
    e AS (SELECT s, t, 'stimulates' AS r FROM l WHERE stim UNION ALL SELECT s, t, 'inhibits' FROM l WHERE inhib UNION ALL SELECT s, t, 'interacts' FROM l WHERE NOT stim AND NOT inhib)
"""

_PERTURBED = f"""
    WITH s AS (SELECT o_custkey AS p, o_orderpriority AS c, min(o_orderkey) AS sig FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 < 4 AND o_orderstatus <> 'P' AND o_orderpriority IN {LINES} GROUP BY ALL),
    e AS (SELECT DISTINCT c_name AS d, 'G' || p_partkey AS g, c FROM s JOIN lineitem ON l_orderkey = sig JOIN customer ON c_custkey = p JOIN part ON p_partkey = l_partkey WHERE c_nationkey <> 3 AND l_quantity - 30 < -8)"""

ORACLE_SQL = {
    "step_negatives": f"""
        WITH p AS MATERIALIZED (SELECT DISTINCT CAST(0 AS BIGINT) AS relation, CAST(s_nationkey AS BIGINT) AS head, CAST(p_size - 1 AS BIGINT) AS tail
                FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND l_quantity <= 7),
            x AS (SELECT *, 50 - count(*) OVER (PARTITION BY relation, head) AS free_tail FROM p), w AS MATERIALIZED (SELECT *, least(4, free_tail) AS want_tail FROM x),
            {_drawn_sql(0, 'head', 'tail', 50)},
            a AS (SELECT head, tail, 1 AS y FROM p UNION ALL SELECT DISTINCT head, v, 0 FROM o0), s AS (SELECT *, (head * 2 + tail)::DOUBLE AS score FROM a)
        SELECT head, tail, y, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 8) AS prob FROM s""",
    "step_perturbations": f"""{_PERTURBED} SELECT d AS src, g AS dst, 'drug' AS src_type, 'gene' AS dst_type, c || '_lincs_perturbation_fwd' AS relation FROM e
        UNION ALL SELECT g, d, 'gene', 'drug', c || '_lincs_perturbation_rev' FROM e""",
    "step_target": "SELECT DISTINCT 'D' || l_suppkey AS inchikey, 'G' || l_partkey AS gene_symbol FROM lineitem WHERE l_linenumber % 2 = 0 AND l_quantity <= 20 AND l_returnflag IN ('A', 'R')",
    "step_association": f"SELECT o AS src, c AS dst, 'gene' AS src_type, 'disease' AS dst_type, 'associates_fwd' AS relation FROM ({_BOTH}) UNION ALL SELECT c, o, 'disease', 'gene', 'associates_rev' FROM ({_BOTH})",
    "step_interactions": f"{_INTER} SELECT r || '_fwd' AS relation, count(*) AS n, count(DISTINCT s) AS n_src FROM e GROUP BY r UNION ALL SELECT r || '_rev', count(*), count(DISTINCT t) FROM e GROUP BY r",
    "step_strong_binding": """
        WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS a, o_orderpriority AS b, o_totalprice AS s, o_totalprice - o_custkey % 7 AS l FROM orders WHERE NOT starts_with(o_orderpriority, '1-')),
        q AS (SELECT quantile_cont(s, 0.9) AS qs, quantile_cont(l, 0.9) AS ql FROM o), e AS (SELECT DISTINCT a, b FROM o, q WHERE s > qs AND l > ql)
        SELECT a AS src, b AS dst, 'drug' AS src_type, 'gene' AS dst_type, 'predicted_strong_binding_fwd' AS relation FROM e UNION ALL SELECT b, a, 'gene', 'drug', 'predicted_strong_binding_rev' FROM e""",
    "step_assemble": f"""
        WITH k AS ({TARGET}), n AS (SELECT (SELECT count(*) FROM k) AS n), p AS (SELECT count(DISTINCT (p_partkey, p_brand)) AS n FROM part),
        pos AS (SELECT unnest(range((SELECT n FROM n))) AS pos), f AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold)
        SELECT fold, CASE WHEN (pos * 7) % 5 = fold THEN 'test' WHEN (pos * 389) % 1000 < 75 THEN 'valid' ELSE 'train' END AS split, 'drug' AS head_type, count(*) AS n FROM pos, f GROUP BY ALL
        UNION ALL SELECT fold, 'train', 'gene', n FROM f, p""",
    "step_aggregate": f"""
        {_CURVE.replace('WITH f AS (', 'WITH f AS (SELECT drug, protein, fold, max(score) AS score, bool_or(test) AS test, bool_and(negatives) AS negatives FROM (').replace('), e AS (SELECT fold, min', ') GROUP BY ALL), e AS (SELECT fold, min', 1)},
        x AS (SELECT f.*, least({CURVE_N - 1}, CAST(floor((score - lo) / (hi - lo) * {CURVE_N - 1}) AS BIGINT)) AS i FROM f JOIN e USING (fold)),
        v AS (SELECT x.fold, drug, protein, score, {_BETWEEN} FROM x JOIN r a ON a.fold = x.fold AND a.i = x.i LEFT JOIN r b ON b.fold = x.fold AND b.i = x.i + 1)
        SELECT drug, protein, s_name, count(*) AS in_n_folds, CAST(floor(avg(score) * 1000 + 1e-4) AS BIGINT) AS score_mean, round(avg(fnr_est), 6) AS fnr_est_mean FROM v LEFT JOIN supplier ON s_suppkey = drug WHERE fnr_est >= 0.5 AND fpr_est <= 1 GROUP BY drug, protein, s_name HAVING count(*) >= 2""",
    "step_novel": """
        WITH l AS (SELECT l_suppkey AS drug, CASE WHEN l_partkey % 10 > 0 THEN l_partkey END AS protein, l_discount > 0.05 AS known FROM lineitem)
        SELECT drug, protein FROM l GROUP BY drug, protein HAVING NOT bool_or(known)""",
    "step_evaluate": """
        WITH p AS (SELECT l_suppkey AS head, l_extendedprice / l_quantity AS score, l_extendedprice / l_quantity / 10000 AS prob, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem WHERE l_returnflag IN ('R', 'N')),
        c AS (SELECT head, score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM p GROUP BY ALL),
        s AS (SELECT *, sum(n) OVER w AS fp, sum(p) OVER w AS tp FROM c WINDOW w AS (PARTITION BY head ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
        a AS (SELECT sum(n * (tp - p / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auc FROM s GROUP BY head HAVING sum(p) > 0 AND sum(n) > 0), b AS (SELECT avg((prob - y) ** 2) AS brier FROM p GROUP BY head HAVING max(y) = 1)
        SELECT round(sum(p / (fp + 1)) / sum(p), 6) AS mrr, round(sum(CASE WHEN fp < 10 THEN p ELSE 0 END) / sum(p), 6) AS top10, round((SELECT avg(auc) FROM a), 6) AS avg_auc, round((SELECT avg(brier) FROM b), 6) AS avg_brier, CAST(sum(p) AS BIGINT) AS positives FROM s WHERE p > 0""",
    "drop_prefix": "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS p_type FROM part WHERE p_partkey % 5 = 0 OR NOT starts_with(p_type, 'STANDARD')",
    "binarized": "SELECT o_orderkey, CAST(o_totalprice > 100000 AS INTEGER) AS value FROM orders",
    "leave_one_out": f"SELECT head, tail FROM ({TARGET}) WHERE tail % 50 <> 0",
    "bilinear_messages": f"SELECT tail AS node, round(sum(s_acctbal + 0.5::DOUBLE * s_nationkey), 4) AS a, round(sum(-2.0::DOUBLE * s_nationkey), 4) AS b FROM ({TARGET}) JOIN supplier ON s_suppkey = head GROUP BY tail",
    "mean_messages": f"SELECT tail AS node, round(avg(head), 6) AS value FROM ({TARGET}) GROUP BY tail",
}
