import numpy as np
import pytest

from kgloom.operators import simjoin


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty clusters on the sphere, noise, copies, and vectors without a direction."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = np.vstack([centres[rng.integers(0, 40, 900)] + 0.18 * rng.normal(size=(900, 16)), rng.normal(size=(100, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[3].tolist()) for i in range(30)] + [(6000, (x[8] * 1.0).tolist())]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 16)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)


def brute(df, threshold):
    rows = [(r.id, np.array(r.embedding)) for r in df.collect() if r.embedding and np.any(r.embedding)]
    ids, x = np.array([i for i, _ in rows]), np.stack([v / np.linalg.norm(v) for _, v in rows])
    c = x @ x.T
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(*np.nonzero(np.triu(c > threshold, 1)))}


@pytest.mark.parametrize("threshold", [0.97, 0.8, 0.3])
def test_exact_join_finds_all(clustered, threshold, monkeypatch):
    monkeypatch.setattr(simjoin, "HOMES", 90)
    monkeypatch.setattr(simjoin, "VISITORS", 130)
    join = simjoin.exact_join(clustered, threshold, pivots=24)
    got = [(r.i, r.j) for r in simjoin.all_pairs(join).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(clustered, threshold)
    counts = join.compared().first()
    assert counts.n == 1000 and counts.all_pairs == 1000 * 999 // 2
    if threshold == 0.97:
        assert counts.compared < counts.all_pairs / 2


def test_classes_hold_the_copies(clustered):
    members = simjoin.exact_join(clustered, 0.9).members
    assert {r.id for r in members.where("rep = 3").collect()} == {3, *range(5000, 5030)} and members.count() == 1031


def test_approximate_join_recall(clustered):
    want = brute(clustered, 0.85)
    join = simjoin.approximate_join(clustered, 0.85, recall=0.95, bits=8)
    got = {(r.i, r.j) for r in simjoin.all_pairs(join).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 1000
    counts = join.compared().first()
    assert simjoin.bands_for(0.85, 0.95, 8) * counts.n < counts.compared


def test_joins_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    for join in (simjoin.exact_join(empty, 0.8), simjoin.approximate_join(empty, 0.8)):
        assert join.pairs.count() == 0 and join.members.count() == 0 and join.compared().first().compared == 0
