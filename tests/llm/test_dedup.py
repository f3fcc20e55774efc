import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from kgloom.llm import common, components, exact_dedup, line_dedup, simhash


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is not None, i or 0))
    out = {}
    for k, g in groups.items():
        best = min(g)
        keep = best[2] if best[1] else None
        for _, known, i in g:
            i = i if known else None
            out[i] = (keep, len(g), i == keep, hashlib.sha256(k.encode()).hexdigest())
    return out


def test_exact_dedup_matches_brute_force(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = exact_dedup.exact_dedup(odd_docs).collect()
    want = brute_exact(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == want[r.doc_id]


def test_exact_dedup_tree_shape_does_not_matter(odd_docs):
    a = sorted(map(str, exact_dedup.exact_dedup(odd_docs, leaves=64, fan_in=2).collect()))
    assert a == sorted(map(str, exact_dedup.exact_dedup(odd_docs, leaves=1).collect()))


def test_exact_dedup_empty_and_stage(no_docs, odd_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    kept = exact_dedup.keep_first_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [re.sub(r"\s", "", r.text or "") for r in kept.dropDuplicates(["doc_id"]).collect()]
    assert len(texts) == len(set(texts))


def test_stage_keeps_one_of_repeated_rows(spark):
    rows = [(2, "a b", "x"), (2, "a b", "w"), (2, "ab", "x"), (3, "other", "x"), (3, "other", "x"), (3, "else", "x"), (None, "ab", "x"), (None, "lone", "x"), (None, "lone", "x"), (5, None, None), (5, None, None)]
    kept = exact_dedup.keep_first_copies(spark.createDataFrame(rows, "doc_id long, text string, y string").repartition(3)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(2, "a b", "w"), (3, "other", "x"), (3, "else", "x"), (None, "lone", "x"), (5, None, None)], key=str)


def test_exact_dedup_plan_has_no_python(odd_docs):
    plan = exact_dedup.exact_dedup(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(odd_docs):
    docs = odd_docs.where("doc_id IS NOT NULL")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_near_duplicates_with_null_id_and_empty(odd_docs, no_docs):
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count()
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one_each(odd_docs).columns == odd_docs.columns


def test_links_connect_all_close_fingerprints(spark):
    """Clouds of fingerprints around centres, at all distances up to 6: components equal brute force."""
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = dict(enumerate(sorted(fps)))
    back = {v: k for k, v in fps.items()}
    signed = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps.values()], "fp long")
    links = [(back[r.a % 2**64], back[r.b % 2**64]) for r in simhash.links(signed).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in links)
    parts = components.components(spark.createDataFrame(links, "u long, v long"), 1000).collect()
    found = {i: i for i in fps} | {r.node: r.component for r in parts}
    assert found == brute_components(fps)


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "u long, v long"), 100).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def brute_lines(rows):
    first, marks = {}, defaultdict(set)
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (t or "").split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip(" "):
                if w in first and first[w] != (i, p):
                    marks[i] |= {p, p + 1, p + 2}
                first.setdefault(w, (i, p))
    return {i: "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in marks[i]) for i, t in rows}


def test_line_dedup_matches_brute_force(odd_docs, no_docs, spark):
    block = "alpha\nbeta\ngamma\ndelta"
    more = spark.createDataFrame([(100, f"x\n{block}\ny"), (101, f"{block}\nz\n{block}"), (102, "q\nq\nq\nq\nq"), (103, "\n\n\n\n"), (104, f"beta\ngamma\ndelta\n{block}")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").distinct().union(more)
    want = brute_lines([(r.doc_id, r.text) for r in docs.collect()])
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.text == want[r.doc_id]
        assert r.n_lines - r.n_removed == len(r.text.split("\n")) or r.text == ""
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_stages_decide_by_row(spark):
    """Rows of one id, or of none, with unrelated texts don't share a decision; copies without an id don't stay twice."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a + "  "), (None, a), (None, b), (None, c), (None, c), (7, d), (8, d), (8, e), (None, "  " + d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for stage in (exact_dedup.keep_first_copies, simhash.keep_one_each):
        kept = sorted((str(r.doc_id), re.sub("[ ]+", " ", r.text).strip()) for r in stage(docs).collect())
        longest = "None" if stage is exact_dedup.keep_first_copies else "7"
        assert kept == sorted([("1", a), ("None", b), ("None", c), (longest, d), ("8", e)])


def test_rows_without_an_id_link_components(spark):
    near = [(5, 0), (None, 0b111), (9, 0b111111)]
    fps = spark.createDataFrame(near, "id long, fp long")
    assert {r.group for r in simhash.groups(fps).collect()} == {0}


def test_line_marks_apply_to_their_own_row(spark):
    block = "alpha\nbeta\ngamma"
    rows = [(1, block), (2, f"{block}\nend"), (2, "other\nlines\nstand\nhere"), (3, f"p\nq\nr\n{block[:5]}"), (3, "p\nq\nr\nelse"), (None, "k\nl\nm"), (None, "k\nl\nm")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert ("2", "end") in got and ("2", "other\nlines\nstand\nhere") in got
    assert sorted(t.count("p\nq\nr") for i, t in got if i == "3") == [0, 1]
    assert sorted(t for i, t in got if i == "None") == ["", "k\nl\nm"]


def test_long_lists_of_rows_are_joined(odd_docs, monkeypatch):
    sent = sorted(map(str, exact_dedup.keep_first_copies(odd_docs).collect())), sorted(map(str, simhash.keep_one_each(odd_docs).collect()))
    monkeypatch.setattr(common, "SEND_ROWS", 0)
    assert (sorted(map(str, exact_dedup.keep_first_copies(odd_docs).collect())), sorted(map(str, simhash.keep_one_each(odd_docs).collect()))) == sent
