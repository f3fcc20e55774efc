"""Token-id files, compressed by a Re-Pair grammar per shard, with random access by document.

Documents are range-partitioned and sorted by id, encoded, and an end id is appended to each.
A shard holds the ids of neighbouring documents. Its grammar is found in rounds: all pairs of
neighbouring symbols are counted, the frequent ones that no more frequent pair overlaps are each
replaced by a new nonterminal, and the pair becomes its rule; rounds go on until no pair has LEAST_COUNT places that don't overlap. Pairs never cross the
end of a document.

File format (Parquet, one row per shard, so Spark writes and prunes it like any table):

    part, shard        int     range partition, number of the shard in it; both ascend with doc ids
    tokens             long    ids in the shard
    before             long    ids in the earlier shards of its part
    first, last        (the id column's own type) least and greatest id, by which readers leave shards out
    nulls              int      documents without an id
    doc_ids            array<long>  (the id column's own type)
    symbol_start       binary  uint32[documents + 1]: where each document's symbols start
    symbols            binary  uint32: ids, nonterminals from `base` on, `base - 1` for the end id
    rules              binary  uint32[rules, 2]: the pair of nonterminal base + i
    rule_length        binary  uint32[rules]: ids that nonterminal base + i expands to
    base               int

read_documents() reads some documents, or a range of the ids of each: it leaves out shards by `first` and `last`, finds the symbols that
reach into the range by the expansion lengths, and expands those alone. The other readers expand whole shards.

Defined results: null text is empty and has just the end id; null ids come first; rows that
repeat an id are ordered by text; an empty table gives no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm.bpe import gather, library_words

END_ID = 1
SHARD_IDS = 1 << 20
#: A pair must occur this often in a shard; a rule costs three numbers.
LEAST_COUNT = 4
_SLOTS = 20


def _alternate(places: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Which places may be replaced together as far as a pair overlaps itself: in a run of equal symbols every second one."""
    follows = np.zeros(len(places), bool)
    follows[1:] = equal[1:] & equal[:-1] & (places[1:] == places[:-1] + 1)
    at = np.arange(len(places))
    return ~follows | ((at - np.maximum.accumulate(np.where(follows, 0, at))) % 2 == 0)


def _winners(places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of overlapping places those with the greater rank, of equal ones the first."""
    overlaps = places[1:] == places[:-1] + 1
    best = np.ones(len(places), bool)
    best[1:] &= ~overlaps | (rank[1:] > rank[:-1])
    best[:-1] &= ~overlaps | (rank[:-1] >= rank[1:])
    return best


def re_pair(symbols: np.ndarray, base: int, least_count: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """The grammar (rules, compressed symbols) of uint32 symbols; base - 1 marks ends and is never replaced.

    A pair's count is that of its places that don't overlap: every second one of a run. A round replaces, of overlapping places, those of the
    more frequent pair, so at least the most frequent pair of all is replaced wherever it stands; the rounds end when no pair has
    least_count places left. Counts are by hash slots first, and by the pairs themselves once those find no more; only places of pairs that
    may still be frequent are looked at: a pair of old symbols never gets more frequent again, and pairs with a new symbol stand beside its places.
    """
    rules: list[np.ndarray] = []
    made, end, exact = 0, base - 1, False
    places = np.flatnonzero((symbols[:-1] != end) & (symbols[1:] != end)) if len(symbols) > 1 else np.zeros(0, np.int64)
    while len(places):
        a, b = symbols[places], symbols[places + 1]
        alone = _alternate(places, a == b)
        if exact:
            key = a.astype(np.uint64) << np.uint64(32) | b
            pairs, slot = np.unique(key, return_inverse=True)
            count = np.bincount(slot[alone], minlength=len(pairs))[slot]
        else:
            bits = min(_SLOTS, len(places).bit_length() + 2)
            slot = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
            count = np.bincount(slot[alone], minlength=1 << bits)[slot]
        often = count >= least_count
        # the more frequent of overlapping pairs goes first, of equals the one with the greater slot, so that a long repeated passage shrinks everywhere
        rank = (count << 32 | slot)[often & alone]
        at = places[often & alone]
        places = places[often]
        at = at[_winners(at, rank)]
        key = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1]
        pairs, which, times = np.unique(key, return_inverse=True, return_counts=True)
        good = times >= least_count
        taken = good[which]
        at, which = at[taken], (np.cumsum(good) - 1)[which[taken]]
        if not len(at):
            if exact:
                break
            exact = True
            continue
        exact = exact or len(at) < len(symbols) >> 10
        pairs = pairs[good]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        touched = np.zeros(len(symbols) + 1, bool)
        touched[at], touched[at + 1], touched[at - 1] = True, True, True  # at - 1 of the first place is the spare last one
        places = places[~touched[places]]
        symbols = symbols.copy()
        symbols[at] = (base + made + which).astype(np.uint32)
        symbols = symbols[keep]
        made += len(pairs)
        places -= np.searchsorted(at, places)
        at = at - np.arange(len(at))
        beside = np.concatenate([at, at - 1])
        beside = beside[(beside >= 0) & (beside + 1 < len(symbols))]
        beside = beside[(symbols[beside] != end) & (symbols[beside + 1] != end)]
        places = np.union1d(places, beside) if exact else np.flatnonzero(_marked(len(symbols), places, beside))
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), symbols


def _marked(size: int, *places: np.ndarray) -> np.ndarray:
    out = np.zeros(size, bool)
    for p in places:
        out[p] = True
    return out


def expand_some(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of some symbols, by the rules they lead to alone."""
    out = symbols
    while (big := out >= base).any():
        start = np.cumsum(1 + big) - 1 - big
        new = np.empty(len(out) + int(big.sum()), np.uint32)
        new[start[~big]] = out[~big]
        pair = rules[out[big] - base]
        new[start[big]], new[start[big] + 1] = pair[:, 0], pair[:, 1]
        out = new
    return np.where(out == base - 1, np.uint32(END_ID), out).astype(np.uint32)


def part_of(symbols: np.ndarray, rules: np.ndarray, rule_length: np.ndarray, base: int, begin: int, end: int | None) -> tuple[int, np.ndarray]:
    """The number of ids that the symbols stand for, and those from begin to end; only symbols that reach into that range are expanded."""
    width = np.ones(len(symbols), np.int64)
    big = symbols >= base
    width[big] = rule_length[symbols[big] - base]
    last = np.cumsum(width)
    total = int(last[-1]) if len(last) else 0
    begin, end, _ = slice(begin, end).indices(total)
    if begin >= end:
        return total, np.zeros(0, np.uint32)
    i, j = int(np.searchsorted(last, begin, "right")), int(np.searchsorted(last, end, "left")) + 1
    skipped = int(last[i] - width[i])
    return total, expand_some(symbols[i:j], rules, base)[begin - skipped : end - skipped]


class Grammar:
    """Expands symbols: the expansions of all rules lie flat, one after the other."""

    def __init__(self, rules: np.ndarray, base: int):
        self.base = base
        size = base + len(rules)
        self.width, self.start = np.ones(size, np.int64), np.zeros(size, np.int64)
        self.start[:base] = np.arange(base)
        flat = [np.arange(base, dtype=np.uint32)]
        flat[0][base - 1] = END_ID
        self.flat = flat[0]
        done = 0
        while done < len(rules):
            # a batch of rules that use only symbols before the batch
            high = np.maximum.accumulate(rules[done:].max(axis=1))
            n = int(np.searchsorted(high, base + done))
            n = max(n, 1)
            batch = rules[done : done + n]
            out, _ = gather(self.flat, self.start, self.width, batch.ravel())
            width = self.width[batch].sum(axis=1)
            where = slice(base + done, base + done + n)
            self.width[where] = width
            self.start[where] = len(self.flat) + np.cumsum(width) - width
            self.flat = np.concatenate([self.flat, out])
            done += n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.start, self.width, symbols)[0]

    def lengths(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Ids in each document, from the expansion lengths alone."""
        return np.diff(np.concatenate(([0], np.cumsum(self.width[symbols])))[starts])


def _pack(part: int, shard: int, before: int, ids: list, lengths: list[np.ndarray], tokens: list[np.ndarray], base: int, id_type: pa.DataType) -> pa.RecordBatch:
    n, flat = np.concatenate(lengths), np.concatenate(tokens)
    ends = np.cumsum(n + 1)
    symbols = np.full(len(flat) + len(n), base - 1, np.uint32)
    body = np.ones(len(symbols), bool)
    body[ends - 1] = False
    symbols[body] = flat
    rules, packed = re_pair(symbols, base)
    known = [i for i in ids if i is not None]
    ends_of_ids = [pa.array([f(known) if known else None], id_type) for f in (min, max)]
    starts = np.concatenate(([0], np.flatnonzero(packed == base - 1) + 1)).astype(np.uint32)
    lengths_of_rules = Grammar(rules, base).width[base:].astype(np.uint32)
    column = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(symbols)], pa.int64()), pa.array([before], pa.int64()), *ends_of_ids, pa.array([len(ids) - len(known)], pa.int32()), pa.array([ids], pa.list_(id_type)), column(starts), column(packed), column(rules), column(lengths_of_rules), pa.array([base], pa.int32())],
        ["part", "shard", "tokens", "before", "first", "last", "nulls", "doc_ids", "symbol_start", "symbols", "rules", "rule_length", "base"],
    )


def shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shards of all documents in ascending order of their ids, as in the file format."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, shard = library_words(path), TaskContext.get().partitionId(), 0
        base = len(words.encoder.final) + 1
        ids, lengths, tokens, size, before, kind = [], [], [], 0, 0, None
        for b in batches:
            kind, at = b.column(0).type, 0
            own = b.column(0).to_pylist()
            for n, x in words.encode(b.column(1)):
                ids += own[at : at + len(n)]
                at += len(n)
                lengths.append(n)
                tokens.append(x)
                size += len(x) + len(n)
                if size >= shard_ids:
                    yield _pack(part, shard, before, ids, lengths, tokens, base, kind)
                    shard, before = shard + 1, before + size
                    ids, lengths, tokens, size = [], [], [], 0
        if ids:
            yield _pack(part, shard, before, ids, lengths, tokens, base, kind)

    kind = rows.dtypes[0][1]
    return rows.mapInArrow(pack, f"part int, shard int, tokens long, before long, first {kind}, last {kind}, nulls int, doc_ids array<{kind}>, symbol_start binary, symbols binary, rules binary, rule_length binary, base int")


def write(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    shards(docs, path, id_col, text_col).write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(out)


def _with_start(files: DataFrame) -> DataFrame:
    """The shards with `start`, the ids before each: those before its part, and those before it in its part.

    The sums over parts have one row per range partition, however many shards there are, so they are sent to all tasks.
    """
    parts = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    earlier = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    return files.join(F.broadcast(earlier), "part").withColumn("start", F.col("earlier") + F.col("before"))


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian uint32, end id included) of every document."""
    return _documents(spark.read.parquet(out), "ids", lambda x: x.astype("<u4").tobytes(), "binary", pa.binary())


def read_checksums(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: as read(), with the checksum of the ids in place of the ids."""
    return _documents(spark.read.parquet(out), "ids_crc32", lambda x: zlib.crc32(x.astype("<u4").tobytes()), "long", pa.int64())


def read_documents(spark: SparkSession, out: str, ids: list, begin: int = 0, end: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, as in read()) of the documents with such ids, None among them; of each the ids from begin to end.

    start and n_tokens are those of the whole document. The list is meant for a handful of documents, as it is part of the plan.
    """
    files, wanted = spark.read.parquet(out), set(ids)
    known = sorted(i for i in wanted if i is not None)
    hit = F.col("nulls") > 0 if None in wanted else F.lit(False)
    if known:
        inside = F.exists(F.array(*map(F.lit, known)), lambda i: (F.col("first") <= i) & (i <= F.col("last")))
        hit = hit | (F.col("first") <= known[-1]) & (F.col("last") >= known[0]) & inside
    id_kind = dict(files.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    rows = _with_start(files).where(hit).select("start", "doc_ids", "symbol_start", "symbols", "rules", "rule_length", "base")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                start, own, base = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(6)[i].as_py()
                cuts, symbols, rules, widths = (np.frombuffer(b.column(k)[i].as_py(), np.uint32) for k in (2, 3, 4, 5))
                rules = rules.reshape(-1, 2)
                big = symbols >= base
                width = np.ones(len(symbols), np.int64)
                width[big] = widths[symbols[big] - base]
                before = np.concatenate(([0], np.cumsum(width)))
                at = [n for n, x in enumerate(own) if x in wanted]
                found = [part_of(symbols[cuts[n] : cuts[n + 1]], rules, widths, base, begin, end) for n in at]
                columns = [b.column(1)[i].values.take(pa.array(at, pa.int64())), pa.array([start + int(before[cuts[n]]) for n in at], pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for _, x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(unpack, f"doc_id {id_kind}, start long, n_tokens long, ids binary")


def _documents(files: DataFrame, name: str, make, kind: str, arrow: pa.DataType) -> DataFrame:
    id_kind = dict(files.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    rows = _with_start(files).select("start", "doc_ids", "symbol_start", "symbols", "rules", "base")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                start, starts, symbols, rules, base = (b.column(k)[i].as_py() for k in (0, 2, 3, 4, 5))
                symbols, starts = np.frombuffer(symbols, np.uint32), np.frombuffer(starts, np.uint32).astype(np.int64)
                g = Grammar(np.frombuffer(rules, np.uint32).reshape(-1, 2), base)
                n = g.lengths(symbols, starts)
                ids, ends = g.expand(symbols), np.cumsum(n)
                found = [make(ids[a:z]) for a, z in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(1)[i].values, pa.array(start + ends - n), pa.array(n), pa.array(found, arrow)], ["doc_id", "start", "n_tokens", name])

    return rows.mapInArrow(unpack, f"doc_id {id_kind}, start long, n_tokens long, {name} {kind}")
