"""Queries of similarity joins below all pairs, and of paths without an example's own edge."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions.vectors import doubles
from kgloom.operators import diffusion, exact_negatives, simjoin
from kgloom.plans.graph_queries import TARGET, target
from kgloom.storage import table

NEAR, DIRECTION, LINKED = 4, 0.97, 0.35


def _directions(spark, d):
    """The first four numbers of every vector: directions that do lie near each other."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice(doubles("embedding"), 1, NEAR).alias("embedding"))


def cosine_join(spark, d):
    """All pairs of directions whose cosine is over the threshold, by pivots."""
    return simjoin.all_pairs(simjoin.exact_join(_directions(spark, d), DIRECTION)).select("i", "j", F.round("cos", 8).alias("cos"))


def cosine_join_links(spark, d):
    """The class and the number of links of every vector, by pivots; whole vectors."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    join = simjoin.exact_join(rows, LINKED)
    ends = join.pairs.select(F.explode(F.array("i", "j")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n"))
    return join.members.join(ends, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n", F.lit(0)).alias("links"))


def cosine_join_recall(spark, d):
    """One row: pairs of directions, those found by random hyperplanes, their share, and the comparisons of both ways."""
    rows = _directions(spark, d)
    exact, near = simjoin.exact_join(rows, DIRECTION), simjoin.approximate_join(rows, DIRECTION, recall=0.97)
    counts = exact.pairs.agg(F.count("*").alias("pairs")).crossJoin(near.pairs.agg(F.count("*").alias("found")))
    made = exact.compared().withColumnRenamed("compared", "compared_by_pivots").crossJoin(near.compared().select(F.col("compared").alias("compared_by_hyperplanes")))
    return counts.withColumn("recall", F.round(F.col("found") / F.greatest("pairs", F.lit(1)), 4)).crossJoin(made)


def leave_one_out_paths(spark, d):
    """For every target pair, the paths of three hops from its supplier to its part that don't use the pair itself."""
    pairs = target(spark, d).select(F.concat(F.lit("s"), F.col("head").cast("string")).alias("head"), F.concat(F.lit("p"), F.col("tail").cast("string")).alias("tail"))
    own = pairs.select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    edges = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return diffusion.leave_one_out_hops(pairs, edges, own, 3, own_tail_only=True).select("head", "tail", "value")


QUERIES = {f.__name__: f for f in (cosine_join, cosine_join_links, cosine_join_recall, leave_one_out_paths)}

_V = "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"
ORACLE_SQL = {
    "cosine_join": f"WITH v AS MATERIALIZED (SELECT id, e[1:{NEAR}] AS e FROM ({_V})), c AS (SELECT a.id AS i, b.id AS j, list_cosine_similarity(a.e, b.e) AS cos FROM v a JOIN v b ON a.id < b.id) SELECT i, j, round(cos, 8) AS cos FROM c WHERE cos > {DIRECTION}",
    "cosine_join_links": f"""
        WITH v AS MATERIALIZED ({_V}), rep AS (SELECT e, min(id) AS rep FROM v GROUP BY e), m AS (SELECT id, rep FROM v JOIN rep USING (e)),
        u AS MATERIALIZED (SELECT rep AS id, e FROM rep), l AS (SELECT a.id AS rep, count(*) AS n FROM u a JOIN u b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) > {LINKED} GROUP BY a.id)
        SELECT id, m.rep AS class_id, coalesce(n, 0) AS links FROM m LEFT JOIN l ON l.rep = m.rep""",
    # three hops from a supplier to a part: supplier, part, supplier, part; only the first and the last step can be the pair's own
    "leave_one_out_paths": f"""
        WITH t AS MATERIALIZED ({TARGET}), w AS (SELECT x.head, z.tail, count(*) AS value FROM t x JOIN t y ON y.tail = x.tail JOIN t z ON z.head = y.head JOIN t own ON own.head = x.head AND own.tail = z.tail
            WHERE NOT (x.tail = z.tail) AND NOT (y.head = x.head) GROUP BY ALL)
        SELECT 's' || head AS head, 'p' || tail AS tail, value FROM w""",
}


def _typed_pairs(spark, d):
    """Two dense relations: nations of suppliers to sizes of parts, and the same for another quantity."""
    rows = table(spark, d, "lineitem").where("l_returnflag = 'A' AND l_quantity <= 8").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select((F.col("l_quantity") > 7).cast("long").alias("relation"), F.col("s_nationkey").cast("long").alias("head"), (F.col("p_size") - 1).cast("long").alias("tail")).distinct()


def negatives_exact(spark, d):
    """Ten typed negatives of each pair, or all there are."""
    sizes = spark.range(2).select(F.col("id").alias("relation"), F.lit(25).cast("long").alias("n_heads"), F.lit(50).cast("long").alias("n_tails"))
    rows = _typed_pairs(spark, d)
    return exact_negatives.corrupted_exactly(rows, rows, sizes, 10)


QUERIES["negatives_exact"] = negatives_exact


def _drawn_sql(side: int, fixed: str, moved: str, size: int) -> str:
    """The draws of one side in order, the unknown ones once each, or the unknown ones by rank where the draws don't do."""
    number = f"((p.head * 7919 + p.tail * 104729 + p.relation * 1299709 + c * 15485863 + {side * 49979687} + {42 * 32452843}) % 2147483647 * 48271) % 2147483647"
    return f"""
        f{side} AS (SELECT k.relation, k.fixed, v, row_number() OVER (PARTITION BY k.relation, k.fixed ORDER BY v) - 1 AS rank
            FROM (SELECT DISTINCT relation, {fixed} AS fixed FROM p) k, (SELECT unnest(range({size})) AS v) u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.relation = k.relation AND p.{fixed} = k.fixed AND p.{moved} = v)),
        d{side} AS (SELECT p.*, c, {number} % {size} AS v FROM (SELECT *, unnest(range(4 * want_{moved})) AS c FROM w) p WHERE want_{moved} > 0),
        e{side} AS (SELECT d.relation, d.head, d.tail, d.want_{moved} AS want, d.v, min(c) AS c FROM d{side} d ANTI JOIN p ON p.relation = d.relation AND p.{fixed} = d.{fixed} AND p.{moved} = d.v GROUP BY ALL),
        g{side} AS (SELECT * FROM e{side} QUALIFY row_number() OVER (PARTITION BY relation, head, tail ORDER BY c) <= want),
        h{side} AS (SELECT relation, head, tail, v FROM g{side} QUALIFY count(*) OVER (PARTITION BY relation, head, tail) = want),
        l{side} AS (SELECT p.*, c FROM (SELECT *, unnest(range(want_{moved})) AS c FROM w WHERE want_{moved} > 0) p ANTI JOIN h{side} USING (relation, head, tail)),
        r{side} AS (SELECT p.relation, p.head, p.tail, ({number.replace('c * 15485863', '0')} + c) % free_{moved} AS rank FROM l{side} p),
        o{side} AS (SELECT * FROM h{side} UNION ALL SELECT r.relation, r.head, r.tail, f.v FROM r{side} r JOIN f{side} f ON f.relation = r.relation AND f.fixed = r.{fixed} AND f.rank = r.rank)"""


ORACLE_SQL["negatives_exact"] = f"""
    WITH p AS MATERIALIZED (SELECT DISTINCT CAST(l_quantity > 7 AS BIGINT) AS relation, CAST(s_nationkey AS BIGINT) AS head, CAST(p_size - 1 AS BIGINT) AS tail
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' AND l_quantity <= 8),
        x AS (SELECT *, 50 - count(*) OVER (PARTITION BY relation, head) AS free_tail, 25 - count(*) OVER (PARTITION BY relation, tail) AS free_head FROM p),
        y AS (SELECT *, least(10 - least(5, free_head), free_tail) AS want_tail FROM x), w AS MATERIALIZED (SELECT *, least(10 - want_tail, free_head) AS want_head FROM y),
        {_drawn_sql(0, 'head', 'tail', 50)}, {_drawn_sql(1, 'tail', 'head', 25)}
    SELECT relation, head, tail, head AS neg_head, v AS neg_tail FROM o0 UNION ALL SELECT relation, head, tail, v, tail FROM o1"""
