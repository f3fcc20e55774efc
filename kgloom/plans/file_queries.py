"""Tables written by the sinks into the shared folder and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.operators import graph
from kgloom.plans.graph_queries import _TRIPLES, EDGES, _triples, graph_edges
from kgloom.plans.prediction_queries import _PREDS, curve_preds
from kgloom.sources import matrix, readers, sinks
from kgloom.storage import new_path, table


def relation_files(spark, d):
    """Two relation files as one table."""
    edges, paths = graph_edges(spark, d), [new_path(spark, "relation") for _ in range(2)]
    sinks.relation_csv(edges.where("relation = 'targets'"), paths[0])
    sinks.relation_csv(edges.where("relation <> 'targets'"), paths[1])
    return readers.relation_files(spark, paths)


def edge_store(spark, d):
    """Edges by edge type, counted from one relation's folder at a time."""
    path = new_path(spark, "edges")
    sinks.edge_store(graph_edges(spark, d), path)
    return spark.read.parquet(path).groupBy("src_type", "relation", "dst_type").agg(F.count("*").alias("n"))


def headered_csv(spark, d):
    path = new_path(spark, "csv")
    sinks.flat_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return readers.headered_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


def commented_csv(spark, d):
    path, nation = new_path(spark, "commented"), table(spark, d, "nation")
    rows = nation.select(F.concat_ws(",", "n_name", F.col("n_nationkey").cast("string"), F.lit("Region"), F.col("n_regionkey").cast("string")).alias("name"))
    sinks.name_list(rows.unionByName(nation.select(F.concat(F.lit("# about "), "n_name").alias("name"))), path)
    return readers.commented_csv(spark, path, readers.GENE_PATHWAY)


def tsv_files(spark, d):
    path = new_path(spark, "tsv")
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.option("sep", "\t").csv(path, header=True)
    return readers.tsv(spark, path, "s_suppkey long, s_name string")


def name_list(spark, d):
    path = new_path(spark, "names")
    sinks.name_list(table(spark, d, "part").select(F.concat(F.lit(" "), "p_name").alias("name")), path)
    return readers.lines(spark, path)


def fasta_files(spark, d):
    """Suppliers as FASTA records over several lines, some without a gene."""
    path = new_path(spark, "fasta")
    gene = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit(" GN=G"), F.col("s_nationkey").cast("string"))).otherwise("")
    lines = F.concat(F.lit(">sp|"), F.col("s_suppkey").cast("string"), F.lit(" a>b OS="), "s_name", F.lit(" OX=1"), gene, F.lit("\nMK"), F.col("s_suppkey").cast("string"), F.lit("\n\nLV"))
    sinks.name_list(table(spark, d, "supplier").select(lines.alias("name")), path)
    return readers.fasta(spark, path)


def dense_matrix_file(spark, d):
    """A text matrix of nations, with the names of its rows and columns."""
    paths = [new_path(spark, "matrix") for _ in range(3)]
    nation = table(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    sinks.name_list(nation.select(F.concat_ws(" ", (F.col("n_nationkey") % 3).cast("string"), (F.col("n_regionkey") % 2).cast("string"), F.lit("0.5")).alias("line")), paths[0])
    sinks.name_list(nation.select("n_name"), paths[1])
    sinks.name_list(spark.createDataFrame([("a",), ("b",), ("c",)], "name string").coalesce(1), paths[2])
    return readers.dense_matrix(spark, *paths).select("row_name", "col_name", "value")


def log_files(spark, d):
    """What the logs of runs say: a file for each of fifty runs, and the relations that it names."""
    path = new_path(spark, "logs")
    said = F.concat(F.lit("removed relation: "), F.concat_ws("-", "event_type", F.regexp_extract("props", r'"k":\s*(\d)', 1)))
    run = (F.col("user_id") % 50).alias("run")
    events = table(spark, d, "events").select(run, F.explode(F.array(F.lit("start"), F.concat(F.lit("index "), (F.col("user_id") % 50).cast("string")), said)).alias("value"))
    events.distinct().write.partitionBy("run").text(path)
    return readers.log_relations(spark, path, r"^index (\d+)", r"relation: (\S+)").select("idx", F.array_join("relations", ",").alias("relations"))


def fold_predictions(spark, d):
    """Predictions of four folds, a run in each folder."""
    root, preds = new_path(spark, "runs"), curve_preds(spark, d)
    for fold in range(4):
        sinks.flat_csv(preds.where(F.col("fold") == fold).drop("fold"), f"{root}/FOLD_{fold}/run{fold}/predictions.csv")
    rows = readers.fold_predictions(spark, root, "drug long, protein long, score double, test boolean, negatives boolean", [0, 1, 2, 3])
    return rows.groupBy("fold", "uid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("score"), F.sum(F.col("test").cast("long")).alias("test"))


def metric_files(spark, d):
    """Metrics appended run by run."""
    root = new_path(spark, "metrics")
    for k in range(3):
        row = table(spark, d, "orders").where(F.col("o_orderkey") % 3 == k).agg(F.count("*").alias("n"))
        sinks.append_metrics(row, f"{root}/run{k}/metrics.csv")
        sinks.append_metrics(row, f"{root}/run{k}/metrics.csv")
    rows = readers.metric_files(spark, f"{root}/*/metrics.csv", "n long")
    return rows.groupBy("n").agg(F.count("*").alias("times"))


def json_metrics(spark, d):
    path = new_path(spark, "json")
    sinks.json_metrics(table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), path)
    return spark.read.schema("o_orderstatus string, n long").json(path)


def official_split(spark, d):
    """Triples stored with their split, of the listed relations."""
    path, (triples, rels) = new_path(spark, "split"), _triples(spark, d)
    triples.write.parquet(path)
    wanted = [r.rel_id for r in rels.where("relation IN ('targets', 'kind_fwd')").collect()]
    return graph.of_relations(readers.official_split(spark, path), wanted).groupBy("split", "relation").agg(F.count("*").alias("n"))


def fold_store(spark, d):
    """Pairs by fold and split."""
    path, preds = new_path(spark, "folds"), curve_preds(spark, d)
    sinks.folds(preds.select("fold", F.when(F.col("test"), "test").otherwise("train").alias("split"), "drug", "protein"), path)
    return spark.read.parquet(path).groupBy("fold", "split").agg(F.count("*").alias("n"))


def value_folders(spark, d):
    path = new_path(spark, "values")
    sinks.by_value(table(spark, d, "part").select("p_partkey", "p_brand"), path, "p_brand")
    return spark.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("n"))


def flat_csv(spark, d):
    """Array columns as text."""
    path = new_path(spark, "flat")
    sinks.flat_csv(table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("suppliers")), path)
    return readers.headered_csv(spark, path, "s_nationkey int, suppliers string")


def slice_percent(spark, d):
    """The rows from 10 to 30 percent of all orders in order."""
    return readers.slice_percent(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 10, 30)


def first_hit(spark, d):
    """The first order of each customer in an offline table of answers."""
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("name"))
    return readers.first_hit(names, table(spark, d, "orders").select(F.col("o_custkey").alias("name"), "o_orderkey"), "name", "o_orderkey")


def signature_cells(spark, d):
    """Cells of a long matrix for chosen rows and columns."""
    cells = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sig_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("value"))
    some = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("sig_id"))
    return readers.signature_cells(cells, some, table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("gene_id"))).groupBy("sig_id").agg(F.count("*").alias("n"))


def matrix_part(spark, d):
    """Largest quantities of suppliers and parts as a matrix in blocks: the cells of rich suppliers and small parts."""
    path, lines = new_path(spark, "matrix"), table(spark, d, "lineitem")
    matrix.write_matrix(lines, path, "l_suppkey", "l_partkey", "l_quantity")
    rows, columns = table(spark, d, "supplier").where("s_acctbal > 5000").select("s_suppkey"), table(spark, d, "part").where("p_size < 10").select("p_partkey")
    out = matrix.read_matrix(spark, path, rows, columns)
    return out.select(F.col("row").cast("long").alias("supplier"), F.col("column").cast("long").alias("part"), F.col("value").cast("double").alias("quantity"))


QUERIES = {
    f.__name__: f
    for f in (
        relation_files, edge_store, headered_csv, commented_csv, tsv_files, name_list, fasta_files, dense_matrix_file, log_files, fold_predictions, metric_files, json_metrics, official_split, fold_store,
        value_folders, flat_csv, slice_percent, first_hit, signature_cells, matrix_part,
    )
}

ORACLE_SQL = {
    "relation_files": EDGES,
    "edge_store": f"SELECT src_type, relation, dst_type, count(*) AS n FROM ({EDGES}) GROUP BY ALL",
    "headered_csv": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "commented_csv": "SELECT n_name AS GeneSymbol, CAST(n_nationkey AS VARCHAR) AS GeneID, 'Region' AS PathwayName, CAST(n_regionkey AS VARCHAR) AS PathwayID FROM nation",
    "tsv_files": "SELECT s_suppkey, s_name FROM supplier",
    "name_list": "SELECT trim(p_name) AS name FROM part WHERE trim(p_name) <> ''",
    "fasta_files": "SELECT 'sp|' || s_suppkey AS id, s_name AS organism, CASE WHEN s_suppkey % 3 > 0 THEN 'G' || s_nationkey END AS gene_name, 'MK' || s_suppkey || 'LV' AS sequence FROM supplier",
    "dense_matrix_file": "SELECT * FROM (SELECT n_name AS row_name, unnest(['a', 'b', 'c']) AS col_name, unnest([n_nationkey % 3, n_regionkey % 2, 0.5]::DOUBLE[]) AS value FROM nation) WHERE value <> 0",
    "log_files": "SELECT CAST(run AS VARCHAR) AS idx, string_agg(DISTINCT r, ',' ORDER BY r) AS relations FROM (SELECT user_id % 50 AS run, event_type || '-' || regexp_extract(props, '\"k\":\\s*(\\d)', 1) AS r FROM events) GROUP BY run",
    "fold_predictions": f"SELECT fold, 'run' || fold AS uid, count(*) AS n, round(sum(score), 3) AS score, CAST(sum(CAST(test AS INTEGER)) AS BIGINT) AS test FROM ({_PREDS}) GROUP BY fold",
    "metric_files": "SELECT n, count(*) AS times FROM (SELECT count(*) AS n, unnest([1, 2]) AS twice FROM orders GROUP BY o_orderkey % 3) GROUP BY n",
    "json_metrics": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "official_split": f"{_TRIPLES} SELECT split, rel_id AS relation, count(*) AS n FROM t JOIN r USING (rel_id) WHERE relation IN ('targets', 'kind_fwd') GROUP BY ALL",
    "fold_store": f"SELECT fold, CASE WHEN test THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM ({_PREDS}) GROUP BY ALL",
    "value_folders": "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand",
    "flat_csv": "SELECT s_nationkey, '[' || string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) || ']' AS suppliers FROM supplier GROUP BY s_nationkey",
    "slice_percent": "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders) WHERE pos >= floor(n * 0.1) AND pos < floor(n * 0.3)",
    "first_hit": "SELECT c_custkey AS name, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "matrix_part": "SELECT l_suppkey AS supplier, l_partkey AS part, CAST(max(l_quantity) AS DOUBLE) AS quantity FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY ALL",
    "signature_cells": "SELECT l_suppkey AS sig_id, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY l_suppkey",
}
