import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.operators import affinity, affinity_net as an


def test_gradient():
    rng = np.random.default_rng(0)
    x, y, draws, hidden = rng.normal(size=(7, 3)), rng.normal(size=7), rng.poisson(1, size=(2, 7)).astype(float), 4
    flat = rng.normal(size=(2, 3 * hidden + 2 * hidden + 1))
    g = an.loss_and_gradient(flat, x, y, draws, hidden, 0.01)[1]
    for r in range(2):
        for k in range(flat.shape[1]):
            two = []
            for h in (1e-6, -1e-6):
                moved = flat.copy()
                moved[r, k] += h
                two.append(an.loss_and_gradient(moved, x, y, draws, hidden, 0.01)[0][r])
            assert g[r, k] == pytest.approx((two[0] - two[1]) / 2e-6, abs=1e-7)


@pytest.fixture(scope="module")
def curved(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + 0.05 * rng.normal(size=3000)
    rows = [(i, i % 7, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))] + [(9000, 1, None, 1.0), (9001, 1, [0.0] * 4, None)]
    return spark.createDataFrame(rows, "drug long, protein long, features array<double>, affinity double").repartition(4)


def test_better_than_linear_and_quantiles(curved):
    train, held = curved.where("drug % 5 > 0 OR drug >= 9000"), curved.where("drug % 5 = 0 AND drug < 9000")
    net = an.fit(train, ("drug", "protein"), replicas=6, hidden=24, rounds=6, epochs=6)
    out = an.predict(net, held, ("drug", "protein")).join(held, ["drug", "protein"])
    mse = out.agg(F.avg(F.pow(F.col("mean") - F.col("affinity"), 2))).first()[0]
    from pyspark.ml.functions import array_to_vector

    vectors = lambda d: d.where("features IS NOT NULL AND affinity IS NOT NULL").withColumn("features", array_to_vector("features"))
    linear = affinity.evaluate(affinity.fit(vectors(train)), vectors(held)).first().mse
    assert mse < 0.4 * linear
    drawn = {}
    for r in an.samples(net, held, ("drug", "protein")).collect():
        drawn.setdefault(r.drug, []).append(r.value)
    for r in out.collect():
        assert len(drawn[r.drug]) == 6 and r.mean == pytest.approx(np.mean(drawn[r.drug]))
        assert [r.lcb, r.ucb] == pytest.approx(np.quantile(drawn[r.drug], [0.05, 0.95]))
        assert r.lcb <= r.ucb and len(set(drawn[r.drug])) > 1
    errors = {r.q: r.value for r in an.error_quantiles(net, held, ("drug", "protein")).collect()}
    assert 0 < errors[0.5] < errors[0.9]


def test_the_same_partitions_give_the_same_model(curved):
    one, two = (an.fit(curved, ("drug", "protein"), replicas=2, rounds=1, epochs=1) for _ in range(2))
    assert np.allclose(one.flat, two.flat, rtol=1e-9)


def test_nothing_to_fit(spark):
    with pytest.raises(ValueError):
        an.fit(spark.createDataFrame([], "drug long, features array<double>, affinity double"), ("drug",))
