from collections import Counter, defaultdict

import pytest

from kgloom.operators import exact_negatives as en


@pytest.mark.parametrize("which", ["tail", "head", "both"])
def test_every_positive_gets_all_it_can(spark, which):
    # head 0 knows all tails but one, head 1 all, head 2 half of them, head 3 one; relation 1 has other sizes
    links = [(0, 0, t) for t in range(39)] + [(0, 1, t) for t in range(40)] + [(0, 2, t) for t in range(0, 40, 2)] + [(0, 3, 5)] + [(1, 0, t) for t in range(6)]
    positives = links + [(0, 3, 5), (1, 7, 2)] * 2
    sizes = {0: (4, 40), 1: (9, 7)}
    frame = lambda x: spark.createDataFrame(x, "relation long, head long, tail long")
    got = en.corrupted_exactly(frame(positives + [(0, None, 1)]), frame(links), spark.createDataFrame([(r, *s) for r, s in sizes.items()], "relation long, n_heads long, n_tails long"), 6, which).collect()
    known = set(links) | set(positives)
    tails, heads = Counter((r, h) for r, h, _ in known), Counter((r, t) for r, _, t in known)
    found = defaultdict(list)
    for r in got:
        assert (r.relation, r.neg_head, r.neg_tail) not in known and (r.neg_head == r.head) != (r.neg_tail == r.tail)
        assert 0 <= r.neg_head < sizes[r.relation][0] and 0 <= r.neg_tail < sizes[r.relation][1]
        found[r.relation, r.head, r.tail].append((r.neg_head, r.neg_tail))
    for r, h, t in known:
        free = {"tail": sizes[r][1] - tails[r, h], "head": sizes[r][0] - heads[r, t]}
        there = sum(free.values()) if which == "both" else free[which]
        mine = found[r, h, t]
        assert len(mine) == len(set(mine)) == min(6, there), (r, h, t)
        if which == "both":  # halves, where both sides have enough
            assert sum(a != h for a, _ in mine) == min(max(3, 6 - free["tail"]), free["head"])
    if which == "tail":
        assert {tail for _, tail in found[0, 0, 3]} == {39}


def test_ranks_in_the_complement(spark):
    known = [(0, 1, v) for v in (0, 1, 5, 9)] + [(0, 2, 3)]
    asked = [(0, 1, r) for r in range(7)] + [(0, 2, r) for r in range(5)]
    got = en.by_rank(spark.createDataFrame(asked, "relation long, fixed long, rank long"), spark.createDataFrame(known + known[:2], "relation long, fixed long, value long"))
    want = {(1, r): v for r, v in enumerate([2, 3, 4, 6, 7, 8, 10])} | {(2, r): v for r, v in enumerate([0, 1, 2, 4, 5])}
    assert {(r.fixed, r.rank): r.value for r in got.collect()} == want


def test_no_positives(spark):
    none = spark.createDataFrame([], "relation long, head long, tail long")
    sizes = spark.createDataFrame([(0, 3, 3)], "relation long, n_heads long, n_tails long")
    assert en.corrupted_exactly(none, none, sizes, 2).count() == 0
