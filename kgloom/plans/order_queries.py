"""Queries of running sums and quantiles that are split across tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.operators.quantiles import quantiles
from kgloom.operators.scan import running_sums
from kgloom.storage import table


def running_quantity(spark, d):
    """For every line of an order, what was shipped under its flag up to its day: three groups that hold all rows."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", F.col("l_quantity").cast("long").alias("q"), F.lit(1).alias("one"))
    out = running_sums(rows, ["l_returnflag"], "l_shipdate", {"quantity": "q", "lines": "one"})
    return out.select("l_orderkey", "l_linenumber", "quantity", F.col("lines").cast("long").alias("lines"))


def price_quantiles(spark, d):
    """Exact quantiles of prices for each supplier, and of all suppliers together as supplier -1."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice")
    whole = quantiles(rows, "l_extendedprice", [0.05, 0.5, 0.95]).select(F.lit(-1).cast("long").alias("l_suppkey"), "q", "value")
    out = quantiles(rows, "l_extendedprice", [0.05, 0.5, 0.95], ["l_suppkey"]).unionByName(whole)
    return out.select("l_suppkey", "q", F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (running_quantity, price_quantiles)}

ORACLE_SQL = {
    "running_quantity": """
        SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS quantity, count(*) OVER w AS lines
        FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate)""",
    "price_quantiles": """
        WITH q AS (SELECT unnest([0.05, 0.5, 0.95])::DOUBLE AS q)
        SELECT l_suppkey, q, round(CASE q WHEN 0.05 THEN quantile_cont(l_extendedprice, 0.05) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.95) END, 4)::DOUBLE AS value FROM lineitem, q GROUP BY l_suppkey, q
        UNION ALL SELECT -1, q, round(CASE q WHEN 0.05 THEN quantile_cont(l_extendedprice, 0.05) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.95) END, 4)::DOUBLE FROM lineitem, q GROUP BY q""",
}
