import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom import schema
from kgloom.operators import quantiles, scan


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rng = np.random.default_rng(1)
    rows = [(("hot" if rng.random() < 0.6 else None if rng.random() < 0.3 else f"g{rng.integers(5)}"), int(rng.integers(40)), int(rng.integers(-5, 9)) if rng.random() < 0.9 else None) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, at long, x long").repartition(9)
    got = scan.running_sums(df.withColumn("one", F.lit(1)), ["g"], "at", {"upto": "x", "n": "one"}, descending)
    totals = defaultdict(lambda: [0, 0])
    for g, at in {(g, at) for g, at, _ in rows}:
        for g2, at2, x2 in rows:
            if g2 == g and (at2 >= at if descending else at2 <= at):
                totals[g, at][0] += x2 or 0
                totals[g, at][1] += 1
    out = got.collect()
    assert len(out) == len(rows) and all([r.upto, r.n] == totals[r.g, r.at] for r in out)


def test_quantiles_equal_percentile(spark, monkeypatch):
    rng = np.random.default_rng(2)
    values = {"wide": np.concatenate([np.exp(rng.normal(size=900) * 40), -np.exp(rng.normal(size=300) * 40), [0.0, -0.0, 1e308, -1e308, 5e-324]]), "ties": rng.integers(0, 3, 1500).astype(float), "near": 1 + rng.random(1500) * 1e-12, "one": np.array([7.0]), None: rng.normal(size=400)}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("none", None), ("none", float("nan")), ("ties", None), ("wide", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    qs = [0.0, 0.05, 0.5, 0.731, 0.95, 1.0]
    for few in (1000, 3):
        monkeypatch.setattr(quantiles, "FEW", few)
        got = {(r.k, r.q): r.value for r in quantiles.quantiles(df, "x", qs, ["k"]).collect()}
        assert set(got) == {(k, q) for k in values for q in qs}
        for k, v in values.items():
            for q in qs:
                s, at = np.sort(v), q * (len(v) - 1)
                want = s[math.floor(at)] * (1 - (at - math.floor(at))) + s[math.ceil(at)] * (at - math.floor(at)) if at % 1 else s[int(at)]
                assert got[k, q] == want, (k, q)
    whole = [r.value for r in quantiles.quantiles(df.where("k = 'near'"), "x", [0.25, 0.5]).orderBy("q").collect()]
    assert whole == list(df.where("k = 'near'").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5)))).first()[0]) or np.allclose(whole, np.quantile(values["near"], [0.25, 0.5]), rtol=1e-15)


def test_quantiles_of_nothing(spark):
    assert quantiles.quantiles(spark.createDataFrame([], "x double"), "x", [0.5]).count() == 0
    assert quantiles.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]).count() == 0


def test_parts_follow_the_rows(spark, monkeypatch):
    """Partitions that adaptive execution put together are dealt out again, and the windows keep their number."""
    monkeypatch.setattr(schema, "TASK_ROWS", 100)
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.col("id") % 700).alias("at"), F.lit(1).alias("one"))
    got = scan.running_sums(df, ["g"], "at", {"n": "one"})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 20), REPARTITION" in plan
    rows = got.collect()
    assert len(rows) == 2000 and all(r.n == sum(1 for i in range(2000) if i % 2 == r.g and i % 700 <= r["at"]) for r in rows)
