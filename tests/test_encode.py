import numpy as np
import pyarrow as pa
import pytest

from kgloom.operators import encode


@pytest.fixture(scope="module")
def sequences(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "".join(chr(65 + int(c)) for c in rng.integers(0, 26, int(rng.integers(1, 180))))) for i in range(300)] + [(900, None), (901, "  "), (902, "é𝔘日"), (903, "Q" * 5000), (5, "AGAIN")]
    return rows, spark.createDataFrame(rows, "id long, s string").repartition(4)


def plain(rows, encoder, size, overlap):
    found = {}
    for i, s in rows:
        t, parts = encode.code_points((s or "").strip(" ") or "X"), []
        for c, at in enumerate(range(0, max(1, len(t) - overlap), size - overlap)):
            x = t[at : at + size]
            parts.append((len(x) - (overlap if c else 0), encoder(x[None, :], np.ones((1, len(x)), bool))[0]))
        found.setdefault(i, []).extend(parts)
    return {i: sum(n * v for n, v in p) / sum(n for n, _ in p) for i, p in found.items()}


def neighbours():
    """An encoder for which neighbours matter, so chunk borders do."""

    def run(tokens, mask):
        x = np.where(mask, np.sin(tokens * 0.37), 0)
        y = np.tanh(x + np.pad(x, ((0, 0), (1, 0)))[:, :-1] + np.pad(x, ((0, 0), (0, 1)))[:, 1:]) * mask
        n = mask.sum(axis=1)
        return np.stack([y.sum(axis=1) / n, (y * y).sum(axis=1) / n], axis=1)

    return run


@pytest.mark.parametrize("budget,by_length", [(4096, True), (64, True), (4096, False)])
def test_equals_one_at_a_time(sequences, budget, by_length):
    rows, df = sequences
    got, report = encode.encode(df, "id", "s", neighbours(), 2, max_tokens=128, overlap=16, budget=budget, by_length=by_length)
    want = plain(rows, neighbours(), 128, 16)
    found = {r.id: np.array(r.embedding) for r in got.collect()}
    assert set(found) == set(want) and all(np.allclose(found[i], want[i], atol=1e-12) for i in want)
    r = report.first()
    assert r.used == sum(len(range(0, max(1, n - 16), 112)) * 16 - 16 + n for n in (len(encode.code_points((s or "").strip(" ") or "X")) for _, s in rows))
    assert r.not_finite == 0 and r.slots >= r.used


def test_sorting_by_length_saves_padding(sequences):
    share = lambda by: encode.encode(sequences[1], "id", "s", encode.wave_encoder(2), 2, max_tokens=128, overlap=16, budget=4096, by_length=by)[1].first().padding
    assert share(True) < 0.15 < share(False)


def test_packing():
    sizes = np.array([1, 2, 3, 3, 50, 2])
    assert encode.packed(sizes, 9) == [(0, 3), (3, 4), (4, 5), (5, 6)] and encode.packed(sizes[:0], 9) == []
    with pytest.raises(ValueError):
        encode.chunks(None, "id", "s", max_tokens=4, overlap=4)


def test_texts_are_cut_in_slices():
    """A batch of long texts is never in tokens as a whole."""
    texts = pa.array(["A" * 5000] * 9 + ["", "B" * 20_000])
    got = list(encode.cut(texts, encode.code_points, 512, 64, 12_000))
    assert len(got) == 4 and all(sum(map(len, g[3])) < 30_000 for g in got)
    assert [k for g in got for k in g[0]] == sorted(k for g in got for k in g[0]) and sum(w for g in got for w in g[2]) == 65_000


def test_chunks_are_not_shuffled(sequences):
    """Sorting by length takes no exchange, and so no second run of the tokenizer to find its ranges."""
    parts = encode.chunks(sequences[1], "id", "s", max_tokens=128, overlap=16)
    plan = encode.encoded_chunks(parts, encode.wave_encoder(2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == sequences[1]._jdf.queryExecution().executedPlan().toString().count("Exchange")
