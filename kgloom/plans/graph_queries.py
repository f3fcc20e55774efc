"""Queries over the typed graph that the tables hold: suppliers target parts; nations, regions, types and brands associate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import aggregate, diffusion, graph, negatives, relations
from kgloom.schema import first_known, parts_of, with_constants
from kgloom.storage import materialize, table

FLAGS, STATUS, MOST = ("A", "R"), ("F",), 25.0


def target(spark: SparkSession, d: str) -> DataFrame:
    """head, tail of the target relation."""
    rows = relations.target_filter(table(spark, d, "lineitem"), "l_returnflag", FLAGS, "l_linestatus", STATUS, "l_quantity", MOST)
    return rows.select(F.col("l_suppkey").alias("head"), F.col("l_partkey").alias("tail")).distinct()


TARGET = "SELECT DISTINCT l_suppkey AS head, l_partkey AS tail FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F') AND l_quantity <= 25"


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    t, e = (lambda n: table(spark, d, n)), relations.edges
    parts = [
        e(target(spark, d), "head", "tail", "supplier", "part", "targets"),
        e(t("supplier"), "s_suppkey", "s_nationkey", "supplier", "nation", "located_fwd"),
        e(t("nation"), "n_nationkey", "n_regionkey", "nation", "region", "within_fwd"),
        e(t("part"), "p_partkey", "p_type", "part", "type", "kind_fwd"),
        e(t("part"), "p_partkey", "p_brand", "part", "brand", "brand_fwd"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGES = f"""
    SELECT CAST(head AS VARCHAR) AS src, CAST(tail AS VARCHAR) AS dst, 'supplier' AS src_type, 'part' AS dst_type, 'targets' AS relation FROM ({TARGET})
    UNION ALL SELECT DISTINCT CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR), 'supplier', 'nation', 'located_fwd' FROM supplier
    UNION ALL SELECT DISTINCT CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR), 'nation', 'region', 'within_fwd' FROM nation
    UNION ALL SELECT DISTINCT CAST(p_partkey AS VARCHAR), p_type, 'part', 'type', 'kind_fwd' FROM part
    UNION ALL SELECT DISTINCT CAST(p_partkey AS VARCHAR), p_brand, 'part', 'brand', 'brand_fwd' FROM part
"""
NODES = f"""
    SELECT node_type, name, row_number() OVER (PARTITION BY node_type ORDER BY name) - 1 AS idx
    FROM (SELECT src_type AS node_type, src AS name FROM ({EDGES}) UNION SELECT dst_type, dst FROM ({EDGES}))
"""
RELATIONS = f"""
    SELECT src_type, relation, dst_type, row_number() OVER (ORDER BY src_type, relation, dst_type) - 1 AS rel_id
    FROM (SELECT DISTINCT src_type, relation, dst_type FROM ({EDGES}))
"""


def edges_target_filtered(spark, d):
    return target(spark, d)


def edges_reverse(spark, d):
    return relations.reversed_edges(graph_edges(spark, d).where("relation <> 'targets'"))


def edges_union_all(spark, d):
    return relations.with_reverse(graph_edges(spark, d)).groupBy("src_type", "relation", "dst_type").agg(F.count("*").alias("n"))


def edge_type_stats(spark, d):
    return graph.edge_type_stats(graph_edges(spark, d))


def node_dictionary(spark, d):
    return graph.node_dictionary(graph_edges(spark, d))


def relation_dictionary(spark, d):
    return graph.relation_dictionary(graph_edges(spark, d))


def edges_indexed(spark, d):
    return graph.build(graph_edges(spark, d))[2]


def graph_node_counts(spark, d):
    nodes, _, indexed = graph.build(graph_edges(spark, d))
    return graph.graph_stats(nodes, indexed).select("n_node", "n_edge", F.explode("node_counts").alias("node_type", "n"))


def semi_by_keyset(spark, d):
    keys = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("head"))
    return relations.keep_keys(target(spark, d), keys, "head")


def _known(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("head"), F.col("l_partkey").alias("tail"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("value"))
    return rows


def anti_known_pairs(spark, d):
    return relations.known_pairs_removed(target(spark, d), _known(spark, d), ["head", "tail"], "value")


def relation_denylist(spark, d):
    edges = relations.with_reverse(graph_edges(spark, d))
    kept = graph.select_relations(edges, ["kind_fwd"], ["region"], no_rev=True)
    return kept.groupBy("relation").agg(F.count("*").alias("n"))


def bool_partition_edges(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    parts = parts_of(rows)
    rows = rows.repartition(parts, "l_orderkey")
    one = rows.select("l_orderkey", F.col("l_partkey").alias("p1"), F.col("l_returnflag").alias("f1"))
    two = rows.select("l_orderkey", F.col("l_partkey").alias("p2"), F.col("l_returnflag").alias("f2"))
    pairs = one.join(two, "l_orderkey").where("p1 < p2")
    flags = pairs.repartition(4 * parts, "p1", "p2").groupBy("p1", "p2").agg(F.max((F.col("f1") == "R") & (F.col("f2") == "R")).alias("stim"), F.max((F.col("f1") == "A") | (F.col("f2") == "A")).alias("inhib"))
    return relations.flag_partition(flags, "stim", "inhib").groupBy("relation").agg(F.count("*").alias("n"))


def symmetric_closure(spark, d):
    return relations.symmetric_closure(table(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").cast("long").alias("b")), "a", "b")


def undirected_missing_reverse(spark, d):
    return relations.missing_reverse(target(spark, d), "head", "tail")


def first_per_group(spark, d):
    rows = table(spark, d, "events").withColumn("known", F.when(F.col("value") > 20, F.col("value")))
    order = F.struct("ts", "event_id")
    return rows.groupBy("event_type", "user_id").agg(first_known("known", order).alias("value"), first_known("props", order).alias("props"))


def signature_threshold_edges(spark, d):
    first = first_per_group(spark, d).select("event_type", "user_id", (F.col("value") - 100).alias("value"), F.get_json_object("props", "$.k").alias("gene"))
    return relations.signature_edges(first, 60.0, "+/-").select(F.col("user_id").cast("string").alias("src"), F.col("gene").alias("dst"), F.concat(F.col("event_type"), F.lit("_perturbation_fwd")).alias("relation"))


_FIRST = """
    SELECT event_type, user_id, arg_min(known, row(ts, event_id)) FILTER (WHERE known IS NOT NULL) AS value, arg_min(props, row(ts, event_id)) FILTER (WHERE props IS NOT NULL) AS props
    FROM (SELECT *, CASE WHEN value > 20 THEN value END AS known FROM events) GROUP BY event_type, user_id
"""


def folded(spark, d, k=10):
    return graph.with_folds(target(spark, d), ["head", "tail"], k)


FOLDED = f"SELECT head, tail, pos, CAST((pos * 7) % 10 AS INTEGER) AS fold FROM (SELECT *, row_number() OVER (ORDER BY head, tail) - 1 AS pos FROM ({TARGET}))"
SPLIT = f"SELECT *, CASE WHEN fold = 0 THEN 'test' WHEN (pos * 389) % 1000 < 75 THEN 'valid' ELSE 'train' END AS split FROM ({FOLDED})"


def fold_assignment(spark, d):
    return folded(spark, d)


def split_counts(spark, d):
    return graph.all_splits(folded(spark, d), 10).groupBy("of_fold", "split").agg(F.count("*").alias("n"))


def _triples(spark, d):
    nodes, rels, indexed = graph.build(graph_edges(spark, d))
    rel = rels.where("relation = 'targets'").first().rel_id
    own = materialize(indexed.where(F.col("rel_id") == rel).select(F.col("src_idx").alias("head"), F.col("dst_idx").alias("tail")), "target")
    split = graph.split_of_fold(graph.with_folds(own, ["head", "tail"], 10), 0).select(F.col("head").alias("src_idx"), F.col("tail").alias("dst_idx"), "split")
    return graph.triples(indexed, rels, rel, split), rels


def triple_splits(spark, d):
    triples, _ = _triples(spark, d)
    return triples.groupBy("split", "relation").agg(F.count("*").alias("n"))


def ablate_relation(spark, d):
    triples, _ = _triples(spark, d)
    return graph.ablate(graph.message_graph(triples), 1).groupBy("relation", "head_type", "tail_type").agg(F.count("*").alias("n"))


def flag_counts(split):
    """head, train, valid, test: the known pairs of each head by partition."""
    n = lambda s: F.sum((F.col("split") == s).cast("long")).alias(s)
    return split.groupBy("head").agg(n("train"), n("valid"), n("test"))


def pair_flags(spark, d):
    """The full supplier x part grid with its partition flags, counted by supplier: known pairs are counted, the others are what is left of the tails."""
    counts = flag_counts(graph.split_of_fold(folded(spark, d), 0))
    heads = table(spark, d, "supplier").select(F.col("s_suppkey").alias("head"))
    rows = with_constants(heads.join(counts, "head", "left"), table(spark, d, "part").agg(F.count("*").alias("tails")))
    known = {c: F.coalesce(c, F.lit(0)) for c in ("train", "valid", "test")}
    return rows.select("head", *[x.alias(f"n_{c}") for c, x in known.items()], (F.col("tails") - sum(known.values())).alias("n_none"))


def metadata_enrich(spark, d):
    rows = target(spark, d).groupBy("head").agg(F.count("*").alias("n"))
    meta = table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("head"), "s_name", "s_nationkey")
    return aggregate.enrich(rows, meta, "head")


def set_overlap(spark, d):
    r = relations.target_filter(table(spark, d, "lineitem"), "l_returnflag", ["R"], "l_linestatus", ["F"], "l_quantity", 10)
    a = relations.target_filter(table(spark, d, "lineitem"), "l_returnflag", ["A"], "l_linestatus", ["F"], "l_quantity", 10)
    return relations.overlap(r, a, ["l_partkey"])


def set_difference(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("tail"))
    return parts.exceptAll(target(spark, d).select("tail").distinct())


def novel_pairs_topk(spark, d):
    known = target(spark, d)
    hd = known.groupBy("head").agg(F.count("*").alias("hd"))
    td = known.groupBy("tail").agg(F.count("*").alias("td"))
    return negatives.top_by_degrees(hd, td, known, 50)


def negatives_hash(spark, d):
    sizes = with_constants(table(spark, d, "supplier").agg(F.count("*").alias("h")), table(spark, d, "part").agg(F.count("*").alias("t"))).first()
    known = target(spark, d)
    return negatives.corrupted(known, known, 2, sizes.h, sizes.t)


def _khop(spark, d, suppliers):
    e = graph_edges(spark, d).where("relation IN ('targets', 'brand_fwd')")
    named = e.select(F.concat_ws(":", "src_type", "src").alias("src"), F.concat_ws(":", "dst_type", "dst").alias("dst"))
    both = diffusion.undirected(named)
    sources = suppliers.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("node"))
    return diffusion.khop(sources, both, 3).withColumn("value", F.col("value").cast("long"))


def khop_diffusion(spark, d):
    """Path counts from every supplier, over the whole graph."""
    return _khop(spark, d, table(spark, d, "supplier"))


def khop_diffusion_all(spark, d):
    """Path counts from every supplier."""
    return _khop(spark, d, table(spark, d, "supplier"))


def source_counts(spark, d):
    return relations.source_summary(table(spark, d, "documents"), "source", "doc_id", "lang")


def edge_attention(spark, d):
    e = target(spark, d).select(F.col("head").alias("src"), F.col("tail").alias("dst"), (F.pmod(F.col("head") * 31 + F.col("tail") * 17, F.lit(13)) / 4.0).alias("logit"))
    return diffusion.attention(e).select("src", "dst", F.round("alpha", 8).alias("alpha"))


_NEG = f"""
    WITH k AS ({TARGET}), s AS (SELECT (SELECT count(*) FROM supplier) AS nh, (SELECT count(*) FROM part) AS nt),
    c AS (SELECT head, tail, c, nh, nt, (((head * 7919 + tail * 104729 + c * 15485863 + 42 * 32452843) % 2147483647) * 48271) % 2147483647 AS draw
          FROM k, s, (SELECT unnest(range(8)) AS c)),
    n AS (SELECT head, tail, c, CASE WHEN c % 2 = 0 THEN draw % nh ELSE head END AS neg_head, CASE WHEN c % 2 = 1 THEN draw % nt ELSE tail END AS neg_tail FROM c),
    f AS (SELECT head, tail, neg_head, neg_tail, min(c) AS c FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.head = neg_head AND k.tail = neg_tail) GROUP BY ALL)
    SELECT head, tail, neg_head, neg_tail FROM f QUALIFY row_number() OVER (PARTITION BY head, tail ORDER BY c) <= 2
"""
_REVERSED = "SELECT dst AS src, src AS dst, dst_type AS src_type, src_type AS dst_type, CASE WHEN relation LIKE '%\\_fwd' ESCAPE '\\' THEN left(relation, length(relation) - 4) ELSE relation END || '_rev' AS relation"
_INDEXED = f"""
    SELECT r.rel_id, a.idx AS src_idx, b.idx AS dst_idx FROM (SELECT DISTINCT * FROM ({EDGES})) e
    JOIN ({RELATIONS}) r USING (src_type, relation, dst_type)
    JOIN ({NODES}) a ON a.node_type = e.src_type AND a.name = e.src JOIN ({NODES}) b ON b.node_type = e.dst_type AND b.name = e.dst
"""
_TRIPLES = f"""
    WITH i AS ({_INDEXED}), r AS ({RELATIONS}), o AS (SELECT *, row_number() OVER (ORDER BY src_idx, dst_idx) - 1 AS pos FROM i JOIN r USING (rel_id) WHERE relation = 'targets'),
    t AS (SELECT i.rel_id, CASE WHEN o.pos IS NULL THEN 'train' WHEN (o.pos * 7) % 10 = 0 THEN 'test' WHEN (o.pos * 389) % 1000 < 75 THEN 'valid' ELSE 'train' END AS split
          FROM i LEFT JOIN o ON i.rel_id = o.rel_id AND i.src_idx = o.src_idx AND i.dst_idx = o.dst_idx)
"""

_HOPS = f"""
    WITH e AS (SELECT src_type || ':' || src AS src, dst_type || ':' || dst AS dst FROM ({EDGES}) WHERE relation IN ('targets', 'brand_fwd')), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    h1 AS (SELECT src AS source, dst AS node, count(*) AS v FROM b WHERE src IN (SELECT 'supplier:' || s_suppkey FROM supplier {{where}}) GROUP BY ALL),
    h2 AS (SELECT source, dst AS node, sum(v) AS v FROM h1 JOIN b ON node = src GROUP BY ALL)
    SELECT source, dst AS node, CAST(sum(v) AS BIGINT) AS value FROM h2 JOIN b ON node = src GROUP BY source, dst"""

QUERIES = {
    f.__name__: f
    for f in (
        edges_target_filtered, edges_reverse, edges_union_all, edge_type_stats, node_dictionary, relation_dictionary, edges_indexed, graph_node_counts, semi_by_keyset, anti_known_pairs,
        relation_denylist, bool_partition_edges, symmetric_closure, undirected_missing_reverse, first_per_group, signature_threshold_edges, fold_assignment, split_counts, triple_splits,
        ablate_relation, pair_flags, metadata_enrich, set_overlap, set_difference, novel_pairs_topk, negatives_hash, khop_diffusion, source_counts, edge_attention, khop_diffusion_all,
    )
}

ORACLE_SQL = {
    "edges_target_filtered": TARGET,
    "edges_reverse": f"{_REVERSED} FROM ({EDGES}) WHERE relation <> 'targets'",
    "edges_union_all": f"SELECT src_type, relation, dst_type, count(*) AS n FROM (SELECT * FROM ({EDGES}) UNION ALL {_REVERSED} FROM ({EDGES})) GROUP BY ALL",
    "edge_type_stats": f"SELECT src_type, relation, dst_type, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM ({EDGES}) GROUP BY ALL",
    "node_dictionary": NODES,
    "relation_dictionary": RELATIONS,
    "edges_indexed": _INDEXED,
    "graph_node_counts": f"WITH n AS ({NODES}) SELECT (SELECT count(*) FROM n) AS n_node, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({EDGES}))) AS n_edge, node_type, count(*) AS n FROM n GROUP BY node_type",
    "semi_by_keyset": f"SELECT head, tail FROM ({TARGET}) WHERE head IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)",
    "anti_known_pairs": f"SELECT head, tail FROM ({TARGET}) t WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = head AND l_partkey = tail AND l_discount > 0.05)",
    "relation_denylist": f"SELECT relation, count(*) AS n FROM (SELECT * FROM ({EDGES}) UNION ALL {_REVERSED} FROM ({EDGES})) WHERE relation <> 'kind_fwd' AND src_type <> 'region' AND dst_type <> 'region' AND NOT contains(relation, '_rev') GROUP BY relation",
    "bool_partition_edges": """
        WITH f AS (SELECT a.l_partkey AS p1, b.l_partkey AS p2, bool_or(a.l_returnflag = 'R' AND b.l_returnflag = 'R') AS s, bool_or(a.l_returnflag = 'A' OR b.l_returnflag = 'A') AS i
                   FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL)
        SELECT relation, count(*) AS n FROM (SELECT 'stimulates' AS relation FROM f WHERE s UNION ALL SELECT 'inhibits' FROM f WHERE i UNION ALL SELECT 'interacts' FROM f WHERE NOT s AND NOT i) GROUP BY relation""",
    "symmetric_closure": "SELECT c_custkey AS a, CAST(c_nationkey AS BIGINT) AS b FROM customer UNION SELECT CAST(c_nationkey AS BIGINT), c_custkey FROM customer",
    "undirected_missing_reverse": f"SELECT head, tail FROM ({TARGET}) t WHERE NOT EXISTS (SELECT 1 FROM ({TARGET}) r WHERE r.head = t.tail AND r.tail = t.head)",
    "first_per_group": _FIRST,
    "signature_threshold_edges": f"SELECT CAST(user_id AS VARCHAR) AS src, json_extract_string(props, '$.k') AS dst, event_type || '_perturbation_fwd' AS relation FROM ({_FIRST}) WHERE abs(value - 100) > 60",
    "fold_assignment": FOLDED,
    "split_counts": f"SELECT of_fold, split, count(*) AS n FROM (SELECT of_fold, CASE WHEN fold = of_fold THEN 'test' WHEN (pos * 389) % 1000 < 75 THEN 'valid' ELSE 'train' END AS split FROM ({FOLDED}), (SELECT CAST(unnest(range(10)) AS INTEGER) AS of_fold)) GROUP BY ALL",
    "triple_splits": f"{_TRIPLES} SELECT split, rel_id AS relation, count(*) AS n FROM t GROUP BY ALL",
    "ablate_relation": f"{_TRIPLES} SELECT rel_id AS relation, src_type AS head_type, dst_type AS tail_type, count(*) AS n FROM t JOIN r USING (rel_id) WHERE split = 'train' AND rel_id <> 1 GROUP BY ALL",
    "pair_flags": f"""
        SELECT s_suppkey AS head, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'valid') AS n_valid, count(*) FILTER (WHERE split = 'test') AS n_test, count(*) FILTER (WHERE split IS NULL) AS n_none
        FROM supplier CROSS JOIN part LEFT JOIN ({SPLIT}) s ON s.head = s_suppkey AND s.tail = p_partkey GROUP BY s_suppkey""",
    "metadata_enrich": f"SELECT head, n, s_name, s_nationkey FROM (SELECT head, count(*) AS n FROM ({TARGET}) GROUP BY head) LEFT JOIN (SELECT * FROM supplier WHERE s_nationkey < 20) ON head = s_suppkey",
    "set_overlap": """
        WITH r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity <= 10), a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity <= 10)
        SELECT (SELECT count(*) FROM r) AS n_left, (SELECT count(*) FROM a) AS n_right, (SELECT count(*) FROM (SELECT * FROM r INTERSECT SELECT * FROM a)) AS n_both""",
    "set_difference": f"SELECT p_partkey AS tail FROM part EXCEPT SELECT tail FROM ({TARGET})",
    "novel_pairs_topk": f"""
        WITH k AS ({TARGET}), h AS (SELECT head, count(*) AS hd FROM k GROUP BY head), t AS (SELECT tail, count(*) AS td FROM k GROUP BY tail)
        SELECT head, tail, hd * td AS score FROM h CROSS JOIN t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.head = h.head AND k.tail = t.tail) ORDER BY score DESC, head, tail LIMIT 50""",
    "negatives_hash": _NEG,
    "khop_diffusion": _HOPS.format(where=""),
    "khop_diffusion_all": _HOPS.format(where=""),
    "source_counts": "SELECT source, count(*) AS n_rows, count(DISTINCT doc_id) AS n_doc_id, count(DISTINCT lang) AS n_lang FROM documents WHERE source IS NOT NULL GROUP BY source",
    "edge_attention": f"""
        WITH e AS (SELECT head AS src, tail AS dst, ((head * 31 + tail * 17) % 13) / 4.0::DOUBLE AS logit FROM ({TARGET}))
        SELECT src, dst, round(exp(logit - max(logit) OVER w) / sum(exp(logit - m)) OVER w, 8) AS alpha FROM (SELECT *, max(logit) OVER (PARTITION BY dst) AS m FROM e) WINDOW w AS (PARTITION BY dst)""",
}
