"""Phrase collocation mining: count all n-grams per language, score by their weakest cut, drop what a longer phrase covers.

All 1..max_n-grams become rows (language, phrase, number), one level after the other, and Spark sums them by key. A phrase
can occur LEAST times only if its parts do, so the level above is exploded only where both parts, one word shorter, may be frequent.
"May be" is a test of one bit in a table of BITS bits, built from the frequent phrases of the level below: its size is fixed, it never says no
to a frequent phrase, and where it says yes in vain the exact count decides. Tasks work on slices of SLICE bytes of text (a longer text
is a slice of its own), cut into words by Arrow and counted by numpy before rows leave them. Scores
are computed in decimals of 38 digits, with integer division.

Defined results: null texts are empty; a null language is `und`, one with the language of that name; pieces and languages without words have no rows; counts are over all
rows, repeated ones and rows without an id too; of equal scores of cuts the earliest counts; ties in the ranking go to the more frequent, then to the smaller
phrase in byte order, so ranks are unique; an empty table gives an empty result; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import materialize, split_join

#: What ends a piece, and what separates words in it.
STOPS, BLANKS = "[.,;:!?\n-\r]", "[ \t]+"
LEAST, MAX_WORDS, TOP, COVERED = 10, 3, 2000, 50
#: Bits of the table of frequent phrases (16 MB), and bytes of text that a task counts at once.
BITS, SLICE = 1 << 27, 6 << 20
#: A language's phrases are ranked in so many shares first, of which the best go on.
SHARES = 32
GRAMS = "lang string, phrase string, f long"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Languages and texts, about SLICE bytes at a time."""
    for batch in batches:
        lang, text = batch.column("lang"), batch.column("text")
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
            yield lang.slice(at, to - at), text.slice(at, to - at)
            at = to


def _words(lang: pa.Array, text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str]]:
    """The distinct words, the code of each word in order (-1 between pieces), the code of its language, and the languages."""
    lists = pc.split_pattern_regex(pc.replace_substring_regex(pc.ascii_lower(text), STOPS, " \n "), BLANKS)
    langs, words = lang.dictionary_encode(), lists.flatten().dictionary_encode()
    codes, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int32), words.dictionary
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    own = np.repeat(langs.indices.to_numpy(zero_copy_only=False), sizes)
    starts = np.cumsum(sizes)[:-1]
    empty, mark = (pc.equal(names, x).to_numpy(zero_copy_only=False)[codes] for x in ("", "\n"))
    codes[mark] = -1
    codes, own, empty = np.insert(codes, starts, -1), np.insert(own, starts, 0), np.insert(empty, starts, False)
    return names, codes[~empty], own[~empty], langs.dictionary.to_pylist()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _word_hash(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def places(hashes: list[np.ndarray]) -> np.ndarray:
    """The bit of each row: hashes of the language and of the words, in order."""
    h = np.zeros(len(hashes[0]), np.uint64)
    for x in hashes:
        h = _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + x)
    return (h >> np.uint64(7)) % np.uint64(BITS)


def _grams(names: pa.Array, codes: np.ndarray, own: np.ndarray, langs: list[str], n: int, frequent: np.ndarray | None) -> pa.RecordBatch | None:
    """The n-grams of one slice with their numbers; those both of whose parts may be frequent, if the table is given."""
    size = len(codes) - n + 1
    if size <= 0:
        return None
    at = np.flatnonzero(np.logical_and.reduce([codes[k : k + size] >= 0 for k in range(n)]))
    if frequent is not None and len(at):
        word, lang = _word_hash(names.to_pylist()), _word_hash(langs)
        there = np.flatnonzero(np.logical_and.reduce([codes[k : k + size + 1] >= 0 for k in range(n - 1)]))
        p = places([lang[own[there]]] + [word[codes[there + k]] for k in range(n - 1)])
        maybe = np.zeros(size + 1, bool)  # the (n-1)-gram at each place
        maybe[there] = frequent[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1
        at = at[maybe[at] & maybe[at + 1]]
    if not len(at):
        return None
    keys = ["lang", *[f"w{k}" for k in range(n)]]
    rows = pa.table([own[at], *[codes[at + k] for k in range(n)]], names=keys).group_by(keys, use_threads=False).aggregate([([], "count_all")]).combine_chunks()
    column = lambda c: rows[c].chunk(0) if rows[c].num_chunks else pa.array([], rows[c].type)
    words = [names.take(column(k)) for k in keys[1:]]
    phrase = pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(column("lang")), phrase, column("count_all")], names=["lang", "phrase", "f"])


def level(texts: DataFrame, n: int, frequent: np.ndarray | None) -> DataFrame:
    """lang, phrase, f: the number of each n-gram of texts(lang, text); at n = 1 also of the empty phrase, that is of all words."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _slices(batches):
            names, codes, own, langs = _words(lang, text)
            if n == 1:
                total = np.bincount(own[codes >= 0], minlength=len(langs))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([""] * len(langs), pa.string()), pa.array(total.astype(np.int64))], names=["lang", "phrase", "f"])
            found = _grams(names, codes, own, langs, n, shared.value)
            if found is not None:
                yield found

    # slices are counted already, so summing them again before the shuffle would gain little: a phrase has a row for each slice at most
    return texts.mapInArrow(each, GRAMS).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def bit_table(grams: DataFrame) -> np.ndarray:
    """BITS bits as bytes, with those of grams(lang, phrase) set. Spark joins the bits of 64-bit words; at most BITS / 64 words reach the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column("lang").dictionary_encode()
            lists = pc.split_pattern(batch.column("phrase"), " ")
            words = lists.flatten().dictionary_encode()
            n = len(words) // batch.num_rows
            codes = words.indices.to_numpy(zero_copy_only=False).reshape(-1, n)
            word, lang = _word_hash(words.dictionary.to_pylist()), _word_hash(langs.dictionary.to_pylist())
            p = places([lang[langs.indices.to_numpy(zero_copy_only=False)]] + [word[codes[:, k]] for k in range(n)])
            bit = (np.uint64(1) << (p & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array(bit)], names=["at", "bits"])

    rows = grams.select("lang", "phrase").mapInArrow(each, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, np.int64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint8)


def frequencies(docs: DataFrame, lang_col: str, text_col: str, least: int = LEAST, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, words, phrase, f of all phrases of at most max_words words that occur `least` times or more; words 0 is the number of all words."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("text <> ''")
    out, bits = None, None
    for n in range(1, max_words + 1):
        found = level(texts, n, bits).where((F.col("f") >= least) | (F.col("phrase") == ""))
        found = materialize(found.select("lang", F.when(F.col("phrase") == "", 0).otherwise(n).alias("words"), "phrase", "f"), "phrases")
        out = found if out is None else out.unionByName(found)
        if n < max_words:
            bits = bit_table(found.where("words > 0"))
    return out


def _by_phrase(df: DataFrame) -> DataFrame:
    """df with the key that its phrases are joined by; hot phrases can be split, see split_join()."""
    return df.withColumn("key", F.xxhash64("lang", "phrase"))


def scored(freq: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of every phrase of two words or more, by its weakest cut."""
    word = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = freq.where("words > 1").select("lang", "words", F.col("phrase").alias("whole"), F.col("f").alias("a"), word.alias("w"), cut.alias("k"))
    part = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cuts = cuts.withColumns({"phrase": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("words") - F.col("k"))}).drop("w")
    parts = _by_phrase(freq.where("words > 0").select("lang", "phrase", "f"))
    left = split_join(_by_phrase(cuts), parts.withColumnRenamed("f", "l"), ["key", "lang", "phrase"]).drop("key", "phrase").withColumnRenamed("rest", "phrase")
    both = split_join(_by_phrase(left), parts.withColumnRenamed("f", "r"), ["key", "lang", "phrase"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    both = both.withColumns({"_top": F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a"), "_under": wide("l") * wide("r")})
    worst = both.groupBy("lang", "words", F.col("whole").alias("phrase"), "a").agg(F.min(F.struct(F.expr("_top div _under").alias("score"), "k", "l", "r")).alias("m"))
    return worst.select("lang", "words", "phrase", "a", "m.l", "m.r", "m.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """The candidates without those that lie in a longer one with at least `covered` percent of their number.

    One-word extensions decide: a longer phrase with that number contains an extension with at least that number.
    """
    word = F.split("phrase", " ")
    ends = F.explode(F.array(F.array_join(F.slice(word, 1, F.col("words") - 1), " "), F.array_join(F.slice(word, 2, F.col("words") - 1), " ")))
    longer = candidates.where("words > 2").select("lang", F.col("a").alias("f"), ends.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    near = split_join(_by_phrase(candidates), _by_phrase(longer), ["key", "lang", "phrase"], "left")
    return near.where(F.col("f").isNull() | (F.col("f") * 100 < F.col("a") * covered)).drop("key", "f")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    freq = frequencies(docs, lang_col, text_col, least, max_words)
    candidates = materialize(scored(freq), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = uncovered(candidates).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    shares = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = freq.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
