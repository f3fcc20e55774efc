"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a document passage by up to k = max(1, m * RATE) edits.
It is split into k + 1 pieces; k edits touch at most k of them, so any passage within the budget
holds one piece unchanged. All pieces form one automaton that finds exact piece hits in each
document; around each hit, Myers' bit-parallel distance verifies the item against the document.

Items and documents are compared lower-cased, with every run of other ASCII characters than
letters and digits as one space. Items go to the tasks in blocks of at most BLOCK_CHARS, so what
is sent is bounded; each block is a pass over the documents.

Defined results: null text is empty; items shorter than MIN_CHARS after normalisation
match without edits and as whole words only; those without letters or digits match nothing; repeated items and repeated documents each give their rows; an
empty benchmark or an empty table gives no rows; a tie of places goes to the first one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import released
from pyspark.sql.pandas.types import to_arrow_type

RATE = 0.05
MIN_CHARS = 24
BLOCK_CHARS = 4_000_000
_KEEP = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))


def normalized(text: str | None) -> str:
    return b" ".join((text or "").lower().encode().translate(_KEEP).split()).decode()


def budget(chars: int, rate: float = RATE) -> int:
    return max(1, int(chars * rate))


def myers(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of the item to any substring of the text, and the end of the first such substring."""
    m = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp, hn = minus | (full & ~(xh | plus)), plus & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full  # a match may start anywhere: row 0 stays 0
        plus, minus = hn | (full & ~(xv | hp)), hp & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds items within their budgets in texts."""

    def __init__(self, items: Iterable[tuple[object, str]], rate: float = RATE):
        self.items = [(i, t, budget(len(t), rate) if len(t) >= MIN_CHARS else 0) for i, t in ((i, normalized(t)) for i, t in items) if t]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            cuts = [len(t) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((n, a))
        self.find = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.find.add_word(piece, (len(piece), places))
        if pieces:
            self.find.make_automaton()

    def matches(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item id, distance, end of the passage in the normalised text) of each item found, best place."""
        if not self.items:
            return []
        doc = normalized(text)
        spans: dict[int, list[list[int]]] = {}
        whole: dict[int, int] = {}
        for end, (size, places) in self.find.iter(doc):
            for n, at in places:
                _, t, k = self.items[n]
                if not k:  # a short item: its first place between word ends
                    if n not in whole and doc[max(0, end - size) : end - size + 1] in ("", " ") and doc[end + 1 : end + 2] in ("", " "):
                        whole[n] = end + 1
                    continue
                low = end + 1 - size - at - k
                high = low + len(t) + 2 * k
                known = spans.setdefault(n, [])
                if known and low <= known[-1][1]:  # hits that belong together are verified once
                    known[-1] = [min(low, known[-1][0]), max(high, known[-1][1])]
                else:
                    known.append([low, high])
        out = [(self.items[n][0], 0, end) for n, end in sorted(whole.items())]
        for n, found in sorted(spans.items()):
            i, t, k = self.items[n]
            best = min((d, max(a, 0) + end) for a, b in found for d, end in [myers(t, doc[max(a, 0) : b])])
            if best[0] <= k:
                out.append((i, *best))
        return out


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size, one after the other."""
    block, size = [], 0
    for r in items.select(item_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(r[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, passage_end: a row for each document and item within the item's budget."""
    doc_kind, item_kind = docs.select(id_col).dtypes[0][1], benchmark.select(item_col).dtypes[0][1]
    schema = f"doc_id {doc_kind}, item_id {item_kind}, distance int, passage_end int"
    item_arrow = to_arrow_type(benchmark.schema[item_col].dataType)
    rows = docs.select(id_col, text_col).where(F.col(text_col).isNotNull())
    parts = []
    for block in item_blocks(benchmark, item_col, item_text_col):

        def each(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block)
            for b in batches:
                own, found = b.column(0), [(n, *m) for n, t in enumerate(b.column(1)) for m in matcher.matches(t.as_py())]
                n, item, distance, end = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([own.take(pa.array(n, pa.int64())), pa.array(item, item_arrow), pa.array(distance, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "item_id", "distance", "passage_end"])

        parts.append(rows.mapInArrow(released(each), schema))
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no item is found; all columns as they were."""
    for block in item_blocks(benchmark, item_col, item_text_col):
        docs = docs.where(_clean(block)(F.col(text_col)))
    return docs


def _clean(block: list[tuple[object, str]]):
    """text -> whether none of the items is found in it."""
    made: list[Matcher] = []

    def clean(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Matcher(block))
        return pa.array([not made[0].matches(t.as_py()) for t in texts], pa.bool_())

    return F.arrow_udf(clean, "boolean")
