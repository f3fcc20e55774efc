"""The pipeline against a plain Python version of its five stages, over repeated and missing ids."""

import random
import re
from collections import Counter, defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from kgloom.llm import decontamination, language_id
from kgloom.llm.registry import TOKENIZER
from test_dedup import brute_fingerprint

SMALL = "/root/testdata/sf0.001"


def one_row_each(groups, order):
    """Of each group the best row; one of rows that are equal to it."""
    return [min(rows, key=order) for rows in groups]


def near_groups(rows):
    marks = [brute_fingerprint(t) for _, t in rows]
    left, out = set(range(len(rows))), []
    while left:
        group, todo = [], [left.pop()]
        while todo:
            a = todo.pop()
            group.append(rows[a])
            near = {b for b in left if (marks[a] ^ marks[b]).bit_count() <= 3}
            left -= near
            todo += near
        out.append(group)
    return out


def brute_pipeline(docs, items, dictionaries):
    label = language_id.Classifier(dictionaries)
    rows = [r for r in docs if label.classify(r[1])[1] >= language_id.NARROW]
    same = defaultdict(list)
    for i, t in rows:
        same[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t))
    rows = one_row_each(same.values(), lambda r: (-len(r[1] or ""), r[0] is not None, r[0] or 0))
    rows = one_row_each(near_groups(rows), lambda r: (r[0] is None, r[0] or 0))
    wanted = [decontamination.normalized(t) for t in items]
    found = lambda t: any(w in t or decontamination.myers(w, t)[0] <= decontamination.budget(len(w)) for w in wanted)
    rows = [r for r in rows if not found(decontamination.normalized(r[1]))]
    tool = Tokenizer.from_file(TOKENIZER)
    out = Counter()
    for i, t in rows:
        ids = tool.encode(t, add_special_tokens=False).ids
        out[i, len(ids), tuple(ids), tool.decode(ids, skip_special_tokens=False)] += 1
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 70 AND n_chars < 6000")
    rows = [tuple(r) for r in docs.collect()]
    at = docs.columns.index("doc_id"), docs.columns.index("text")
    put = lambda r, i, t: tuple(i if k == at[0] else t if k == at[1] else x for k, x in enumerate(r))
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(6).collect()]
    rng, a, b = random.Random(1), *rows[3:5]
    text = rows[5][at[1]]
    rows += [rows[8], rows[8], put(a, a[at[0]], rows[9][at[1]] + " more words of its own here"), put(b, None, b[at[1]] + "  "), put(b, None, text + " a b"), put(b, None, None), put(b, 900, ""), put(b, 901, "12345 !!")]
    rows += [put(b, None, " ".join(rng.sample(text.split(), 20))) for _ in range(2)] + [put(b, 902, text[:200] + " " + items[0].upper() + " end"), put(b, None, "x " + items[1][:30] + "q" + items[1][30:])]
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(6).write.parquet(str(tmp_path / "benchmark.parquet"))
    written = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = brute_pipeline([(r[at[0]], r[at[1]]) for r in rows], items, language_id.fit(written))
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and 20 < sum(got.values()) < len(rows) - 6


def test_stages_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_arrow_memory_is_given_back_after_each_batch(monkeypatch):
    import pyarrow as pa

    from kgloom.llm import bpe, common

    calls = []
    pool = type("Pool", (), {"release_unused": lambda self: calls.append(1)})()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    batches = [pa.RecordBatch.from_pydict({"x": [k]}) for k in range(3)]
    assert list(common.released(lambda b: b)(iter(batches))) == batches and len(calls) == 3
    assert bpe.KNOWN_WORDS <= 100_000
