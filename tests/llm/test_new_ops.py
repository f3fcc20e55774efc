import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from kgloom.llm import collocations, mixing, registry, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- whitening


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) * np.linspace(0.2, 3, 20)
    rows = [(i, [float(np.float32(c)) for c in v], i) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[i][1], 0) for i in range(40)] + [rows[7], rows[7], (None, rows[9][1], 1)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] + rows[0][1][1:], 1), (2003, [float("nan")] + rows[0][1][1:], 1), (2004, [float("inf")] + rows[0][1][1:], 1), (2005, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long").repartition(5)


def test_whitening_matches_exact_arithmetic(vectors):
    got = whitening.whiten(vectors).collect()
    rows = [(r.vec_id, r.embedding) for r in vectors.collect() if (r.vec_id is None or r.vec_id < 2000)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), 20
    s = [sum(v[k] for v in fit) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit), n**3)) for j in range(d)] for i in range(d)])
    values, q = np.linalg.eigh(cov)
    values, q = values[::-1], q[:, ::-1]
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    want = Counter()
    for (i, _), v in zip(rows, x):
        want[i, sum((n * a - b) ** 2 for a, b in zip(v, s))] += 16
    assert Counter((r.vec_id, r.deviation) for r in got) == want
    assert all(str(r.deviation) == r.deviation_digits for r in got)
    for r in got:
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-12
    first = {i: v for (i, _), v in zip(rows, x)}
    for k in range(16):
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        theirs = {i: sum((v[j] - s[j] / n) * q[j, k] for j in range(d)) / math.sqrt(values[k]) for i, v in first.items()}
        sign = 1 if sum(mine[i] * theirs[i] for i in mine) > 0 else -1
        assert max(abs(mine[i] - sign * theirs[i]) for i in mine) < 1e-8


def test_whitening_edge_cases(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0)] * 4
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in huge} == {None} or all(str(r.deviation) == r.deviation_digits or r.deviation is None for r in huge)
    top = 2**61
    xs = [top + 1_000_000, -top + 1_000_000, 1_000_000]
    exact = {i + 1: (3 * x - sum(xs)) ** 2 + (3 * y - 384) ** 2 for i, (x, y) in enumerate(zip(xs, (0, 64, 320)))}
    assert {r.vec_id: int(r.deviation_digits) for r in huge} == exact


def test_digit_products_are_exact():
    rng = np.random.default_rng(0)
    for bits in (10, 25, 45, 61):
        z = rng.integers(-(1 << bits), 1 << bits, size=(50, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j])) for j in range(4)] for i in range(4)]
        assert whitening.exact_gram(z).tolist() == want
        assert whitening.deviations(z, 7, [3, -5, 2**40, 0]) == [sum((7 * int(a) - s) ** 2 for a, s in zip(r, [3, -5, 2**40, 0])) for r in z]


def test_eigenvectors_of_a_graded_matrix():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    want = 10.0 ** -np.arange(12)
    values, vectors = whitening.eigen(q @ np.diag(want) @ q.T)
    assert np.allclose(values[:10], want[:10], rtol=1e-4) and np.abs(vectors.T @ vectors - np.eye(12)).max() < 1e-14


# --- mixing


def water(totals):
    order = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, held, open_ = 1.5 * sum(totals.values()), {}, set(order)
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 2 * totals[s]}
        if not over:
            return held | {s: left * weight[s] / whole for s in open_}
        held |= {s: 2 * totals[s] for s in over}
        left -= sum(2 * totals[s] for s in over)
        open_ -= over
    return held


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(4)
    rows = []
    for k, (name, n) in enumerate([("hot", 700), ("b", 60), ("C", 50), ("é", 200), (None, 40), ("tiny", 1), ("blank", 3), ("twins", 300)]):
        for i in range(n):
            words = 0 if name == "blank" else 17 if name == "twins" else int(rng.lognormvariate(3, 1.2)) + 1
            rows.append((len(rows) if i % 50 else None, " \t".join(["w x"] * words) if words else (None, "", " \n")[i % 3], name, k))
    rows += [rows[5], rows[5], (1, "very long " * 20_000, "hot", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(4)


def test_mixing_meets_its_targets(sources):
    got = mixing.mix(sources).collect()
    rows = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in sources.collect()]
    assert Counter((r.id, r["size"], r.source) for r in got) == Counter(rows)
    totals, taken, largest = Counter(), Counter(), Counter()
    for _, size, s in rows:
        totals[s] += size
        largest[s] = max(largest[s], size)
    want = water(totals)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken == r.copies * r["size"] <= 2 * r["size"] and r.source_size == totals[r.source]
        assert abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source])
    assert abs(sum(want.values()) - 1.5 * sum(totals.values())) < 1e-6 * sum(totals.values())
    for s in totals:  # what lacks is less than the smallest document that could still change
        assert abs(taken[s] - want[s]) <= {"twins": 17, "tiny": largest["tiny"]}.get(s, 2), s
    again = mixing.mix(sources.repartition(3)).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_mixing_rates_solve_the_dual(spark, sources):
    sizes = sources.select("source", mixing.n_words(sources["text"]).alias("size"))
    table = mixing.with_targets(sizes)
    placed = sizes.join(table.selectExpr("source AS s", "src"), sizes["source"].eqNullSafe(mixing.F.col("s")))
    classes = placed.groupBy("src", "size").agg(mixing.F.count("*").alias("n"))
    lam = {r.src: r.lam for r in mixing.balance(classes, table.where("total > 0")).collect()}
    target = {r.src: (r.target, r.total) for r in table.collect()}
    words = Counter()
    for r in classes.collect():
        if r["size"]:
            words[r.src] += r.n * r["size"] * (2 if lam[r.src] is None else min(2, math.exp(lam[r.src] * r["size"])))
    for src, (t, total) in target.items():
        assert abs(words[src] - t) <= 1e-8 * max(1, t)
        assert total == 0 or (lam[src] is None) == (t >= 2 * total)


def test_mixing_of_nothing_and_without_python(spark, sources):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert sorted((r.id, r["size"], r.target, r.taken) for r in blank) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    plan = mixing.mix(sources)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- collocations


def brute_phrases(rows, least, max_words, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if 2 <= len(g) <= max_words and a >= least}
        best, longer = [], Counter()
        for h, b in found.items():
            for k in range(2, len(h)):
                for i in range(len(h) - k + 1):
                    longer[h[i : i + k]] = max(longer[h[i : i + k]], b)
        for g, a in found.items():
            score, _, l, r = min((1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            if 100 * longer[g] < 50 * a:
                best.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(9)
    words = "of the The stone river bread üBER light 日本 a b under 𝔘 again".split(" ")
    rows = [(i, rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words[: 4 + i % 9]) + rng.choice([" ", " ", "\t ", ", ", ".", "\n", "\r\n", "! "]) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    rows += [(None, None, None), (1, "en", ""), (2, "en", " \t"), (3, "en", ".,;"), (4, "xx", "one two"), (5, "en", "the stone " * 30_000), (5, "en", "the stone " * 30_000)]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, lang string, text string, score long").repartition(3)


@pytest.mark.parametrize("least,max_words,top", [(10, 3, 2000), (2, 4, 50), (3, 2, 7)])
def test_collocations_match_brute_force(prose, least, max_words, top):
    want = brute_phrases([(r.lang, r.text) for r in prose.collect()], least, max_words, top)
    got = collocations.collocations(prose, least=least, max_words=max_words, top=top).collect()
    assert sorted(map(tuple, got)) == want and len(want) > 20


def test_collocations_with_a_full_bit_table(prose, monkeypatch):
    want = sorted(map(tuple, collocations.collocations(prose).collect()))
    monkeypatch.setattr(collocations, "bit_table", lambda grams: np.full(collocations.BITS // 8, 255, np.uint8))
    assert sorted(map(tuple, collocations.collocations(prose).collect())) == want


def test_collocation_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    rows = [("en", 1, "a", big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big - 1)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).collect()
    assert [r.score for r in got] == [1_000_000 * (big - 1) ** 2 // (2 * big * big)]


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0


def test_new_queries_run(spark):
    d = "/root/testdata/sf0.001"
    assert registry.op11_embedding_whitening(spark, d).columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    mixed = registry.op12_source_mixing(spark, d)
    assert [c for c, _ in mixed.dtypes[:5]] == ["doc_id", "size", "source_size", "target", "taken"] and [t for _, t in mixed.dtypes[:5]] == ["bigint", "bigint", "bigint", "double", "bigint"]
    assert registry.op13_phrase_collocations(spark, d).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
