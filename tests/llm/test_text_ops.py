import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgloom.llm import bpe, decontamination, language_id, masked_lm, token_files
from kgloom.llm.registry import TOKENIZER


@pytest.fixture(scope="module")
def tool():
    return Tokenizer.from_file(TOKENIZER)


def encoded(words, texts):
    out = []
    for n, x in words.encode(pa.array(texts, pa.string())):
        ends = np.cumsum(n)
        out += [x[e - k : e].tolist() for e, k in zip(ends.tolist(), n.tolist())]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aehilnorst' .,!0-9éñßÀ\n\t\x85\xa0\x1c"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_encoders_equal_the_library(texts):
    tool = Tokenizer.from_file(TOKENIZER)
    want = [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]
    assert encoded(bpe.trie_words(TOKENIZER), texts) == want
    assert encoded(bpe.library_words(TOKENIZER), texts) == want


def test_trie_on_every_token_and_repetitions(tool):
    names = [tool.id_to_token(i).removesuffix("</w>") for i in range(0, 49406, 7)]
    texts = names + ["ha" * n for n in range(1, 80)] + ["l" * n for n in range(1, 80)] + ["x" * 50_000]
    assert encoded(bpe.trie_words(TOKENIZER), texts) == [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]


def test_codec_columns(odd_docs, no_docs, tool):
    rows = bpe.with_codes(odd_docs, TOKENIZER).collect()
    for r in rows:
        want = tool.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == tool.decode(want, skip_special_tokens=False)
    assert bpe.with_codes(no_docs, TOKENIZER).count() == 0


def test_re_pair_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 3000):
        symbols = rng.integers(0, 6, n).astype(np.uint32)
        symbols[rng.random(n) < 0.02] = 9
        rules, packed = token_files.re_pair(symbols, 10)
        g = token_files.Grammar(rules, 10)
        want = symbols.copy()
        want[want == 9] = token_files.END_ID
        assert (g.expand(packed) == want).all()
        assert len(packed) < 0.7 * n or n < 10
        ends = np.concatenate(([0], np.flatnonzero(packed == 9) + 1))
        assert g.lengths(packed, ends).tolist() == np.diff(np.concatenate(([0], np.flatnonzero(symbols == 9) + 1))).tolist()


def test_re_pair_leaves_no_pair_worth_a_rule_standing_alone():
    """Long repeated passages end as few symbols; rules are used; partial expansion equals the whole one."""
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 500, 300).astype(np.uint32)
    symbols = np.concatenate([x for _ in range(20) for x in (passage, rng.integers(0, 500, 5).astype(np.uint32), np.array([999], np.uint32))])
    rules, packed = token_files.re_pair(symbols, 1000)
    assert len(packed) < 20 * 8
    whole = token_files.Grammar(rules, 1000)
    width = whole.width[1000:].astype(np.uint32)
    full = whole.expand(packed)
    assert (token_files.expand_some(packed, rules, 1000) == full).all()
    for begin, end in ((0, None), (0, 1), (299, 307), (5, 5), (-3, None), (6000, 9999), (10**6, None)):
        total, part = token_files.part_of(packed, rules, width, 1000, begin, end)
        assert total == len(symbols) and (part == full[begin:end]).all()


def test_columns_alone_equal_both_at_once(odd_docs):
    rows = bpe.with_codes(odd_docs, TOKENIZER).select("text", "ids", "decoded", bpe.encode(F.col("text"), TOKENIZER).alias("a"), bpe.decode(F.col("ids"), TOKENIZER).alias("b")).collect()
    assert rows and all(r.ids == r.a and r.decoded == r.b for r in rows)


def pairs_left(symbols, end):
    """The number of places that don't overlap of each pair, by a plain walk."""
    count, last = Counter(), {}
    for i, pair in enumerate(zip(symbols.tolist(), symbols.tolist()[1:])):
        if end not in pair and last.get(pair) != i - 1:
            count[pair] += 1
            last[pair] = i
        elif last.get(pair) == i - 1:
            last[pair] = -2  # the next place of a run is free again
    return count


def test_re_pair_goes_on_to_the_last_pair():
    rng = np.random.default_rng(4)
    run, two = np.full(20_000, 7, np.uint32), np.tile(np.array([3, 4], np.uint32), 1000)
    mixed = np.concatenate([np.full(int(n), int(k), np.uint32) for n, k in zip(rng.integers(1, 30, 400), rng.integers(0, 3, 400))])
    zipf = np.minimum(rng.zipf(1.3, 60_000), 900).astype(np.uint32)
    ends = zipf.copy()
    ends[rng.random(len(ends)) < 0.01] = 999
    for symbols in (run, two, mixed, zipf, ends):
        rules, packed = token_files.re_pair(symbols, 1000)
        assert max(pairs_left(packed, 999).values(), default=0) < token_files.LEAST_COUNT
        want = np.where(symbols == 999, np.uint32(token_files.END_ID), symbols)
        assert (token_files.Grammar(rules, 1000).expand(packed) == want).all()
    assert len(token_files.re_pair(run, 1000)[0]) <= 15 and len(token_files.re_pair(run, 1000)[1]) < 12
    assert len(token_files.re_pair(two, 1000)[1]) < 12


def test_token_files_random_access(spark, odd_docs, tmp_path, monkeypatch):
    """Some documents, and ranges of them, are read without a look at the symbols of any other, and without the other shards."""
    monkeypatch.setattr(token_files, "SHARD_IDS", 2000)
    rows = token_files.shards(odd_docs, TOKENIZER, shard_ids=2000)
    out = str(tmp_path / "some")
    rows.write.parquet(out)
    every = {(r.doc_id, r.start): (r.n_tokens, r.ids) for r in token_files.read(spark, out).collect()}
    wanted = [None, 4, 7, 14, 10**9]
    got = token_files.read_documents(spark, out, wanted).collect()
    assert {(r.doc_id, r.start): (r.n_tokens, r.ids) for r in got} == {k: v for k, v in every.items() if k[0] in wanted} and got
    part = token_files.read_documents(spark, out, [5, 14], 3, 11).collect()
    assert {(r.doc_id, r.start): (r.n_tokens, r.ids) for r in part} == {k: (n, x[12:44]) for k, (n, x) in every.items() if k[0] in (5, 14)}

    def spoil(batches):  # the symbols of all documents but 14 lead to no rule at all
        for b in batches:
            for r in b.to_pylist():
                cuts, symbols = np.frombuffer(r["symbol_start"], np.uint32), np.frombuffer(r["symbols"], np.uint32).copy()
                for n, i in enumerate(r["doc_ids"]):
                    if i != 14:
                        symbols[cuts[n] : cuts[n + 1]] = np.where(symbols[cuts[n] : cuts[n + 1]] >= r["base"], r["base"], 7)
                yield pa.RecordBatch.from_pylist([r | {"symbols": symbols.tobytes(), "rule_length": np.frombuffer(r["rule_length"], np.uint32).tobytes()}], schema=b.schema)

    files = spark.read.parquet(out)
    files.mapInArrow(spoil, files.schema).write.parquet(str(tmp_path / "spoilt"))
    bad = token_files.read_documents(spark, str(tmp_path / "spoilt"), [14]).collect()
    assert [(r.n_tokens, r.ids) for r in bad] == [v for k, v in every.items() if k[0] == 14]
    plan = token_files.read_documents(spark, out, [14])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(last,14)" in plan and "LessThanOrEqual(first,14)" in plan


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    spec = json.loads(open(TOKENIZER, encoding="utf-8").read())
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "ByteLevel"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        for make in (bpe.TrieEncoder, bpe.LibraryEncoder):
            with pytest.raises(ValueError):
                make(str(path))


def test_codec_keeps_columns_of_the_same_names(spark, tool):
    docs = spark.createDataFrame([("stone river", 5, "x"), (None, None, None)], "decoded string, IDS int, _ids string")
    rows = bpe.with_codes(docs, TOKENIZER, "decoded").collect()
    assert rows[0].asDict() == {"_decoded": "stone river", "__IDS": 5, "_ids": "x", "ids": (ids := tool.encode("stone river").ids), "decoded": tool.decode(ids)}
    assert (rows[1].decoded, list(rows[1].ids)) == ("", [])


def test_token_files_round_trip(spark, odd_docs, no_docs, tool, tmp_path):
    token_files.write(odd_docs, str(tmp_path / "a"), TOKENIZER)
    got = sorted(token_files.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.read_checksums(spark, str(tmp_path / "a")).collect()}
    want = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd_docs.collect())
    start = 0
    assert len(got) == len(want)
    for r, (_, _, text) in zip(got, want):
        ids = tool.encode(text, add_special_tokens=False).ids + [1]
        data = np.array(ids, "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), data) and sums[r.doc_id, start] == zlib.crc32(data)
        start += len(ids)
    token_files.write(no_docs, str(tmp_path / "b"), TOKENIZER)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=20), st.text("abc", max_size=40))
def test_myers_equals_dynamic_programming(item, text):
    assert decontamination.myers(item, text)[0] == min(distance(item, text), len(item))


def test_decontamination_matches_brute_force(spark, odd_docs):
    rng = random.Random(4)
    letters = "abcdefghij klmnop"
    items = [(i, "".join(rng.choice(letters) for _ in range(60 + 7 * i)).strip()) for i in range(6)] + [(90, None), (91, "short"), (92, "")]
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for n, (i, t) in enumerate(items[:6]):
        for edits in (0, 2, 3, 6, 9):
            x = list(t)
            for _ in range(edits):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([[], ["q"], [x[at], "z"]])
            docs.append((1000 + 10 * n + edits, "before it " + "".join(x).upper() + ", after it"))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contaminated(frame, bench).collect()}
    want = {}
    for d, t in docs:
        if t and len(t) < 1000:
            for i, x in items[:6]:
                x = decontamination.normalized(x)
                k = distance(x, decontamination.normalized(t))
                if k <= decontamination.budget(len(x)):
                    want[d, i] = k
    assert got == want and want
    kept = {r.doc_id for r in decontamination.drop_contaminated(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.contaminated(frame, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(frame, bench.limit(0)).count() == len(docs)


def test_language_id(spark, odd_docs, no_docs):
    rng = random.Random(1)
    words = {"en": "the house and river stone with under light".split(), "fr": "maison et rivière pierre avec sous lumière été".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang) for i in range(120) for lang in [("en", "fr")[i % 2]]]
    rows += [(1000, None, "en"), (1001, "123 !!", "fr"), (1002, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= got[i].score <= 1
        if i < 1000:
            assert got[i].lang_pred == lang and not got[i].rejected
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].rejected
    assert got[1002].lang_pred == "en"
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 2
    assert language_id.identify(odd_docs).count() == odd_docs.count()
    assert language_id.identify(no_docs).count() == 0


def test_language_id_of_repeated_and_missing_ids(spark):
    """Rows that repeat an id, or have none, are learnt from where they may be; clashing columns don't matter."""
    docs = spark.createDataFrame(
        [(1, "the house and river", "en", 1, "a")] * 3 + [(1, None, "en", 2, "b"), (1, "no language here", None, 3, "c"), (None, "la maison et la rivière", "fr", 4, None), (None, None, None, None, None), (4, "das haus und der fluss", "de", 5, "d")],
        "doc_id long, text string, lang string, rank int, _id string",
    )
    got = language_id.identify(docs).collect()
    assert len(got) == 8 and {r.lang_pred for r in got} <= {"en", "fr", "de", "und"}
    dictionaries = language_id.fit(docs)
    assert b"rivi" in dictionaries["fr"] and dictionaries["en"].count(b"the house") == 3
    many = docs.where("lang = 'en'").crossJoin(spark.range(50).select())
    assert language_id.training_sample(language_id.training_rows(many, "doc_id", "text", "lang"), 7).count() == 7
    assert language_id.keep_identified(docs).columns == docs.columns


def test_language_id_equals_brute_force(spark):
    """The sample, the dictionaries and each decision, worked out without Spark."""
    import xxhash
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    place = lambda i: xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    train = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    langs = sorted({r.lang for r in train}, key=lambda x: (-sum(r.lang == x for r in train), x))
    squeeze = {}
    for lang in langs:
        best = sorted((r for r in train if r.lang == lang), key=lambda r: (signed(place(r.doc_id)), r.doc_id))[:240]
        content = b"\n".join(reversed([r.text[:1920].lower().encode()[:480] for r in best]))
        squeeze[lang] = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    right = 0
    for r in rows:
        data = (r.text or "").lower().encode()
        totals = {lang: sum(len(z.compress(data[i : i + 2000])) for i in range(0, len(data), 2000)) for lang, z in squeeze.items()}
        best, second = sorted(totals.values())[:2]
        g = got[r.doc_id]
        if not any(c.isalpha() for c in r.text or ""):
            assert g.lang_pred == "und"
            continue
        assert g.lang_pred == min(langs, key=lambda x: (totals[x], langs.index(x))) and abs(g.score - (1 - best / second)) < 1e-12
        assert g.rejected == (g.score < 0.001)
        right += g.lang_pred == r.lang
    assert right > 0.9 * sum(r.lang is not None for r in rows)


def test_masked_lm(spark, odd_docs, no_docs):
    got = masked_lm.score(odd_docs, rounds=1).collect()
    assert len(got) == odd_docs.count()
    words = {r.doc_id: len((r.text or "").lower().split()) for r in odd_docs.where("doc_id < 4 OR doc_id > 4").collect()}
    for r in got:
        assert (r.mean_log_prob is None) == (r.n_words == 0) and r.log_prob <= 0
        assert r.doc_id not in words or r.n_words == words[r.doc_id]
    same = [r.log_prob for r in got if r.doc_id in (7, 9)]
    assert len(same) == 4 and max(same) - min(same) < 1e-9
    assert masked_lm.score(no_docs, rounds=1).count() == 0


def small_model(base=3, hidden=4, seed=0):
    rng = np.random.default_rng(seed)
    known = masked_lm.Vocabulary([f"w{i}" for i in range(base**3 - 3)], rng.integers(1, 9, base**3 - 3), 5, 11)
    model = masked_lm.Model(known, base=base, hidden=hidden)
    model.weights = rng.normal(0, 0.5, model.weights.shape).astype(np.float64)
    return model, rng


def brute_log_prob(model, around, word):
    """Of one word between four others, from the definition."""
    base, at, w = model.base, model.at, model.weights
    h = np.tanh(w[at["bias"]] + sum(model.signs[k] * w[c] for k, c in enumerate(around)))
    total = model.rare_share if word == masked_lm.RARE else 0.0
    first, second = word // base**2, word // base
    for name, level, low, digit in (("first", 0, 0, first), ("second", 1, first * base, second - first * base), ("third", 2, second * base, word - second * base)):
        z = w[at[name] + low : at[name] + low + base] @ h + model.shares[level][low // base]
        total += z[digit] - np.log(np.exp(z).sum())
    return total


def test_language_model_equals_brute_force_and_sums_to_one():
    model, rng = small_model()
    lengths, codes = np.array([0, 5, 1, 0, 3]), rng.integers(0, 25, 9).astype(np.uint16)
    want, pad = [], model.size
    for text in np.split(codes, np.cumsum(lengths)[:-1]):
        whole = [pad, pad, *text.tolist(), pad, pad]
        want.append(sum(brute_log_prob(model, [whole[i], whole[i + 1], whole[i + 3], whole[i + 4]], int(c)) for i, c in enumerate(text)))
    assert np.allclose(model.score(lengths, codes), want, atol=1e-4)
    around = [3, 7, 27, 1]
    rare = np.exp(brute_log_prob(model, around, 0)) * 5  # five rare words have a share each
    assert abs(sum(np.exp(brute_log_prob(model, around, w)) for w in range(1, 25)) + rare - 1) < 1e-6


def test_language_model_gradient():
    """Numerical differences over every weight that a batch touches."""
    model, rng = small_model()
    codes = rng.integers(0, 25, 12).astype(np.uint16)
    padded, place = model.window(np.array([7, 5]), codes)
    words, around = padded[place], [padded[place + s] for s in masked_lm.PLACES]
    loss = lambda: -model.batch(words, around, False).mean()
    found = np.zeros_like(model.weights)
    for low, groups, _, g in model.batch(words, around, True):
        np.add.at(found, low + groups[:, None] * g.shape[1] + np.arange(g.shape[1]), g)
    for i in np.ndindex(model.weights.shape):
        old = model.weights[i]
        model.weights[i] = old + 1e-4
        up = loss()
        model.weights[i] = old - 1e-4
        down = loss()
        model.weights[i] = old
        assert abs((up - down) / 2e-4 - found[i]) < 1e-5


def test_language_model_beats_the_shares_of_words_on_other_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"]).repartition(2, "doc_id")
    train, held = docs.where("doc_id % 10 < 9"), docs.where("doc_id % 10 = 9")
    known, weights = masked_lm.fit(train)
    lengths, codes = masked_lm.lengths_and_codes(masked_lm.coded(held, known).toArrow().column("codes").combine_chunks())
    plain, trained = (masked_lm.Model(known, w).score(lengths, codes).sum() / len(codes) for w in (None, weights))
    counts = np.concatenate(([known.rare_count + 1], known.counts))
    share = np.log(counts / counts.sum())
    assert abs(plain - (share[codes] - np.log(max(1, known.rare_kinds)) * (codes == 0)).mean()) < 1e-3  # untrained, it says the shares
    assert trained > plain + 0.1


def test_language_model_counts_and_codes_every_word(spark):
    long = "x" * 70
    docs = spark.createDataFrame([(1, f"A a b {long} c"), (2, f"a B {long} {long}y\tq"), (3, None)], "doc_id long, text string")
    known = masked_lm.vocabulary(docs, size=3)
    assert known.words == ["a", "b"] and known.counts.tolist() == [3, 2] and (known.rare_kinds, known.rare_count) == (4, 5)
    rows = {r.doc_id: np.frombuffer(r.codes, "<u2").tolist() for r in masked_lm.coded(docs, known, "text", ["doc_id"]).collect()}
    assert rows == {1: [1, 1, 2, 0, 0], 2: [1, 2, 0, 0, 0], 3: []}


def test_language_model_trains_on_every_position(monkeypatch):
    """Each position is a target once a round, the last text of a slice as well as the first."""
    rng = np.random.default_rng(2)
    lengths, codes = np.array([40_000, 0, 1, 700]), rng.integers(0, 50, 40_701).astype(np.uint16)
    model = masked_lm.Model(masked_lm.Vocabulary([], np.zeros(0, np.int64)))
    trainer, met = masked_lm.Trainer(model, 0.1), []
    monkeypatch.setattr(trainer, "step", lambda words, around: met.append(np.stack([words, *around])))
    trainer.train(lengths, codes, rng)
    padded, place = model.window(lengths, codes)
    want = np.stack([padded[place], *(padded[place + s] for s in masked_lm.PLACES)])
    assert np.array_equal(np.unique(np.concatenate(met, axis=1), axis=1, return_counts=True)[1], np.unique(want, axis=1, return_counts=True)[1])
    assert sum(x.shape[1] for x in met) == 40_701


def test_short_items_match_as_whole_words():
    find = decontamination.Matcher([(1, "E = mc2"), (2, "Paris"), (3, "?!"), (4, "the quick brown fox jumps over")])
    assert find.matches("e=mc2") == [(1, 0, 5)]
    assert find.matches("so E=MC2, in Paris") == [(1, 0, 8), (2, 0, 17)]
    assert find.matches("parisian comparis paris!") == [(2, 0, 23)]
    assert find.matches("pariss e = mc3 ? !") == [] and find.matches("") == []
    assert [m[:2] for m in find.matches("the quick brown fax jumps over paris")] == [(2, 0), (4, 1)]
