"""Masked pseudo-likelihood scores from a small bidirectional window network, trained in numpy.

Words are lower-cased and cut at ASCII white space. Spark counts them all; the most frequent ones, as many as the codes of
three digits allow, have a code of their own, by rank. The network sees the words at the two places before and the
two after a position, never the word there, and predicts it as its three digits in turn: the first among all, the
second among words with that first digit, the third among words with those two. Each digit, and so each word, has a vector of its own
there, so what it says of a word depends on both sides all the way down; without training it says the word's share in the corpus.
A document's score is the sum over all its positions of the log-probability of the word given both sides.

All words beyond the codes are one code, `rare`, of which each such word has an equal share: the probabilities of all words
of the corpus sum to one.

What is gathered from the corpus grows with it: the count of every word, the codes of all texts (a table written once, so that
texts are cut only twice), and in each round the vectors that every partition has trained on every position of
all its documents, in shuffled batches. Vectors are averaged, each by the positions it was trained on, in two grouped
sums. The model itself is bounded: VOCABULARY vectors of HIDDEN numbers for each side, which is what the driver gets.

Defined results: null text, and text without words, has no positions: log_prob 0 and no mean;
positions beyond either end of a text are a code of their own; words of more than LONGEST bytes are rare; words that an
earlier fit() didn't count are rare, too; equally frequent words are ranked by themselves; an empty corpus gives a model
of rare words only; repeated rows get equal scores; other columns of the input don't matter. Training follows the partitioning of
the input: the same files with the same split give the same weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import drop_table, materialize

#: Digits go up to this; so many codes there are.
BASE = 40
VOCABULARY = BASE**3
RARE = 0
LONGEST = 64
HIDDEN = 16
#: Where the words around a position are.
PLACES = (-2, -1, 1, 2)
ROUNDS = 2
RATE = 0.4
BATCH = 1 << 15
#: Words that are worked on together within a batch.
CHUNK = 1 << 13
SLICE_BYTES = 8_000_000
#: Vectors in a row of what partitions give, and groups in which rows of a block are summed first.
BLOCK, SALT = 1024, 32


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.DictionaryArray]]:
    """(words of each text, the words one after the other), for a slice of the texts at a time."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    place = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b == a:
            continue
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.slice(a, b - a)))
        words = lists.flatten()
        full = pc.greater(pc.binary_length(words), 0)
        ends = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        yield np.diff(ends), words.filter(full).dictionary_encode()


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: how often each word occurs in the corpus. Words of more than LONGEST bytes are known by a hash."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, coded in words_of(b.column(0)):
                names = coded.dictionary
                long = pc.greater(pc.binary_length(names), LONGEST)
                if pc.any(long).as_py():
                    names = pa.array([f" {xxhash.xxh64_hexdigest(w)}" if is_long else w for w, is_long in zip(names.to_pylist(), long.to_pylist())], pa.string())
                n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(names))
                yield pa.RecordBatch.from_arrays([names, pa.array(n)], ["word", "n"])

    return docs.select(text_col).mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The words with a code of their own, most frequent first (code 1 on), their counts, and how many others occur how often."""

    def __init__(self, words: list[str], counts: np.ndarray, rare_kinds: int = 0, rare_count: int = 0):
        self.words, self.counts, self.rare_kinds, self.rare_count = words, counts, rare_kinds, rare_count

    def codes(self, words: pa.DictionaryArray) -> np.ndarray:
        found = pc.index_in(words.dictionary, value_set=pa.array(self.words, pa.string()))
        own = (pc.fill_null(found, -1).to_numpy(zero_copy_only=False) + 1).astype(np.uint16)
        return own[words.indices.to_numpy(zero_copy_only=False)]


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = VOCABULARY) -> Vocabulary:
    """Counts all words. The driver gets at most `size` of them, none longer than LONGEST bytes, and two sums."""
    counts = materialize(word_counts(docs, text_col), "word-counts")
    own = ~F.col("word").startswith(" ")
    best = counts.where(own).orderBy(F.desc("n"), "word").limit(size - 1).toArrow()
    total = counts.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    drop_table(counts)
    n = best["n"].to_numpy().astype(np.int64)
    return Vocabulary(best["word"].to_pylist(), n, total.kinds - len(n), total.n - int(n.sum()))


def coded(docs: DataFrame, known: Vocabulary, text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """codes: the codes of the words of each text as little-endian unsigned 16-bit integers; after the columns to keep."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kept = docs.select(*keep).schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for lengths, words in words_of(b.column(len(keep))):
                data = shared.value.codes(words)
                ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32) * 2
                codes = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(lengths)) for c in b.columns[: len(keep)]), codes], [*keep, "codes"])
                at += len(lengths)

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "codes binary"])
    return docs.select(*keep, text_col).mapInArrow(each, kinds)


def lengths_and_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2, np.frombuffer(b"".join(column.to_pylist()), "<u2")


class Model:
    """The network. All vectors are rows of one matrix: of the words around (the last one: beyond the text), of first digits, of second ones, of words, and one of the hidden layer."""

    def __init__(self, known: Vocabulary, weights: np.ndarray | None = None, base: int = BASE, hidden: int = HIDDEN):
        self.base, self.size, self.hidden = base, base**3, hidden
        counts = np.zeros(self.size)
        counts[RARE], counts[1 : len(known.counts) + 1] = known.rare_count + 1, known.counts
        self.rare_share = -np.log(max(1, known.rare_kinds))
        groups = counts.reshape(-1, base).sum(axis=1)
        self.shares = []
        with np.errstate(divide="ignore", invalid="ignore"):
            for c in (groups.reshape(-1, base).sum(axis=1)[None], groups.reshape(-1, base), counts.reshape(-1, base)):
                self.shares.append(np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32))
        cuts = np.cumsum([0, self.size + 1, base, base**2, self.size, 1])
        self.at = dict(zip(("around", "first", "second", "third", "bias"), cuts.tolist()))
        self.rows = int(cuts[-1])
        rng = np.random.default_rng(1)
        #: What tells the places around a position apart.
        self.signs = np.where(rng.random((len(PLACES), hidden)) < 0.5, -1, 1).astype(np.float32)
        if weights is None:
            weights = np.zeros((self.rows, hidden), np.float32)
            weights[: self.size + 1] = rng.normal(0, 0.1, (self.size + 1, hidden))
        self.weights = weights

    def window(self, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes with two places beyond the text before, between and after texts, and where the words are among them."""
        place = np.arange(len(codes)) + 2 * (np.repeat(np.arange(len(lengths)), lengths) + 1)
        out = np.full(len(codes) + 2 * (len(lengths) + 1), self.size, np.uint16)
        out[place] = codes
        return out, place

    def digits(self, words: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """(which vectors, the group, the digit) of each digit of the words."""
        words = words.astype(np.int64)
        pair, third = np.divmod(words, self.base)
        first, second = np.divmod(pair, self.base)
        return [("first", np.zeros_like(first), first), ("second", first, second), ("third", pair, third)]

    def hidden_layer(self, around: list[np.ndarray]) -> np.ndarray:
        n = len(around[0])
        out, own = np.empty((n, self.hidden), self.weights.dtype), np.empty((n, self.hidden), self.weights.dtype)
        out[:] = self.weights[self.at["bias"]]
        for k, codes in enumerate(around):
            np.take(self.weights, codes, axis=0, out=own, mode="clip")
            own *= self.signs[k]
            out += own
        return np.tanh(out, out=out)

    def groups(self, name: str) -> np.ndarray:
        """The vectors of one kind of digit, by group."""
        low = self.at[name]
        return self.weights[low : low + {"first": self.base, "second": self.base**2, "third": self.size}[name]].reshape(-1, self.base, self.hidden)

    def batch(self, words: np.ndarray, around: list[np.ndarray], gradient: bool) -> np.ndarray | list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The log-probability of each word; or, if asked, the gradient of the mean of its negative.

        A gradient is (where its vectors begin, which of them in groups of as many as the third has, of how many words, sums).
        """
        order = np.argsort(words, kind="stable")  # short integers are sorted by radix; words of a group lie together
        words, around = words[order], [x[order] for x in around]
        hidden, n, base, out = self.hidden_layer(around), len(words), self.base, []
        logs, back = np.zeros(n, np.float64), np.zeros_like(hidden)
        z, each = np.empty((n, base), self.weights.dtype), np.arange(n)
        ones = np.ones(base, z.dtype)
        for level, (name, group, digit) in enumerate(self.digits(words)):
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            found, vectors = group[first], self.groups(name)
            ends = np.append(first[1:], n)
            sums = np.empty((len(found), base, self.hidden), self.weights.dtype)
            runs = list(zip(first.tolist(), ends.tolist(), found.tolist(), sums))
            # neighbouring groups of about CHUNK words at a time, which stay in the processor's cache
            cuts = np.flatnonzero(np.concatenate(([True], first[1:] // CHUNK != first[:-1] // CHUNK))).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(runs)]):
                low, high = runs[i][0], runs[j - 1][1]
                for a, b, g, _ in runs[i:j]:
                    np.dot(hidden[a:b], vectors[g].T, out=z[a:b])
                some = z[low:high]
                some += self.shares[level].take(group[low:high], axis=0)
                np.exp(some, out=some)
                total, at = some @ ones, (each[: high - low], digit[low:high])
                if not gradient:
                    logs[low:high] += np.log(some[at] / total)
                    continue
                some *= (1 / total)[:, None]
                some[at] -= 1
                for a, b, g, x in runs[i:j]:
                    back[a:b] += z[a:b] @ vectors[g]
                    np.dot(z[a:b].T, hidden[a:b], out=x)
            if gradient:
                out.append((self.at[name], found, ends - first, sums / n))
        if not gradient:
            logs += np.where(words == RARE, self.rare_share, 0)
            result = np.empty_like(logs)
            result[order] = logs
            return result
        back *= (1 - hidden * hidden) / n
        out.append((self.at["bias"], np.zeros(1, np.int64), np.array([n]), back.sum(axis=0)[None, None]))
        flat = np.concatenate(around)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        values = (back * self.signs[:, None]).reshape(-1, self.hidden).take(order, axis=0)
        out.append((self.at["around"], flat[first].astype(np.int64), np.diff(np.append(first, len(flat))), np.add.reduceat(values, first, axis=0)[:, None]))
        return out

    def score(self, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The summed log-probability of each text."""
        padded, place = self.window(lengths, codes)
        found = [self.batch(padded[p], [padded[p + s] for s in PLACES], False) for p in np.split(place, range(BATCH, len(place), BATCH))] if len(place) else [np.zeros(0)]
        total = np.concatenate(([0], np.cumsum(np.concatenate(found))))
        ends = np.cumsum(lengths)
        return total[ends] - total[ends - lengths]


class Trainer:
    """Steps by the gradient, each vector at a rate that falls with the squares of its gradients so far."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate = model, rate
        self.squares, self.seen = np.full(model.rows, 1e-6, np.float32), np.zeros(model.rows, np.float64)

    def step(self, words: np.ndarray, around: list[np.ndarray]) -> None:
        for low, groups, n, g in self.model.batch(words, around, True):
            many, width, hidden = g.shape
            last = low + (len(self.seen) - low) // width * width
            weights, squares, seen = self.model.weights[low:last].reshape(-1, width, hidden), self.squares[low:last].reshape(-1, width), self.seen[low:last].reshape(-1, width)
            squares[groups] += np.einsum("gwh,gwh->gw", g, g) / hidden
            g *= (self.rate / np.sqrt(squares[groups]))[:, :, None]
            weights[groups] -= g
            seen[groups] += n[:, None]

    def train(self, lengths: np.ndarray, codes: np.ndarray, rng: np.random.Generator) -> None:
        """Steps over all positions of some texts in shuffled batches."""
        padded, place = self.model.window(lengths, codes)
        place = rng.permutation(place)
        for a in range(0, len(place), BATCH):
            some = place[a : a + BATCH]
            self.step(padded[some], [padded[some + s] for s in PLACES])


def train_round(codes: DataFrame, known: Vocabulary, weights: np.ndarray | None, turn: int) -> np.ndarray:
    """The vectors after each partition has trained them on every position of all its texts, averaged by the positions each was trained on."""
    start = Model(known, weights).weights
    shared = codes.sparkSession.sparkContext.broadcast((known, start))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = shared.value
        model, part = Model(known, start.copy()), TaskContext.get().partitionId()
        trainer, rng = Trainer(model, RATE / (turn + 1)), np.random.default_rng([turn, part])
        for b in batches:
            lengths, x = lengths_and_codes(b.column(0))
            trainer.train(lengths, x, rng)
        for block in range(0, model.rows, BLOCK):
            rows = np.flatnonzero(trainer.seen[block : block + BLOCK]) + block
            if len(rows):
                n = trainer.seen[rows]
                moved = (model.weights[rows] - start[rows]) * n[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part % SALT]), *(pa.array([x.tobytes()], pa.binary()) for x in (rows.astype(np.int32), n, moved.astype(np.float32)))], ["block", "salt", "rows", "n", "moved"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        """The sums of the same rows of a block."""
        block, n, moved = int(pdf.block.iloc[0]), np.zeros(BLOCK), np.zeros((BLOCK, HIDDEN))
        for rows, some, by in zip(pdf.rows, pdf.n, pdf.moved):
            at = np.frombuffer(rows, np.int32) - block
            n[at] += np.frombuffer(some, np.float64)
            moved[at] += np.frombuffer(by, np.float32).reshape(-1, HIDDEN)
        at = np.flatnonzero(n)
        return pd.DataFrame({"block": [block], "salt": [0], "rows": [(at + block).astype(np.int32).tobytes()], "n": [n[at].tobytes()], "moved": [moved[at].astype(np.float32).tobytes()]})

    kinds = "block long, salt long, rows binary, n binary, moved binary"
    found = codes.select("codes").mapInArrow(each, kinds).groupBy("block", "salt").applyInPandas(summed, kinds).groupBy("block").applyInPandas(summed, kinds).toArrow()
    out = start.copy()
    for r in found.to_pylist():
        rows, n = np.frombuffer(r["rows"], np.int32), np.frombuffer(r["n"], np.float64)
        out[rows] += np.frombuffer(r["moved"], np.float32).reshape(-1, HIDDEN) / n[:, None].astype(np.float32)
    shared.unpersist()
    return out


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and vectors."""
    known = vocabulary(docs, text_col)
    codes = materialize(coded(docs, known, text_col), "codes")
    weights = trained(codes, known, rounds)
    drop_table(codes)
    return known, weights


def trained(codes: DataFrame, known: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    weights = Model(known).weights
    for turn in range(rounds):
        weights = train_round(codes, known, weights, turn)
    return weights


def scored(codes: DataFrame, known: Vocabulary, weights: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, log_prob (natural, summed), mean_log_prob of the rows of coded()."""
    shared = codes.sparkSession.sparkContext.broadcast((known, weights))  # bounded by VOCABULARY, whatever the corpus

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            lengths, x = lengths_and_codes(b.column(1))
            total = model.score(lengths, x)
            mean = pa.array(total / np.maximum(lengths, 1), mask=lengths == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths), pa.array(total), mean], ["doc_id", "n_words", "log_prob", "mean_log_prob"])

    return codes.select(id_col, "codes").mapInArrow(each, f"doc_id {dict(codes.dtypes)[id_col]}, n_words long, log_prob double, mean_log_prob double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob by a model of the documents themselves: one row per document."""
    known = vocabulary(docs, text_col)
    codes = materialize(coded(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), known, "text", ["doc_id"]), "codes")
    return scored(codes, known, trained(codes, known, rounds))
