"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius 3 meet half-way. Half the radius is one and a half bits: every
fingerprint emits all variants with at most one bit flipped, and the remaining half step is a
wildcard: one of three bit blocks is blanked out of the key. Whatever the three differing bits
are, blanking the block with most of them leaves at most two, and one flip on either side
makes the keys equal. The variants are shuffled by key and sorted there by Spark, which spills if it must; Python sees them in
order, a batch at a time, and verifies fingerprints with equal keys by their distance.

Only distinct fingerprints take part, so copies never meet. A key that many fingerprints share
gives a spanning forest of its verified links, not all pairs; no link between different
components is lost.

Defined results: null text is empty; no word gives fingerprint zero, which links like any other;
fewer than three words are one shingle; rows without an id link like any other, and where a component has no other
rows its id is null; rows that repeat an id are linked by their fingerprints alone; of a component the stage keeps the row with the
smallest id, null ids last, and rows equal in id and text share a decision; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import materialize, released, split_join, with_marks, without_rows
from kgloom.llm.components import components

RADIUS = 3
BLOCKS = (22, 21, 21)
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit SimHash of the 3-word shingles; bytes.lower() and split() are ASCII only."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= 3:
        return _hash(b" ".join(words))  # one shingle: its own majority
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-3])).tolist()
    hashes = np.fromiter(map(_hash, map(joined.__getitem__, map(slice, starts, (ends[2:] - 1).tolist()))), np.uint64, len(words) - 2)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BIT for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    found = np.fromiter((fingerprint((t.as_py() or "").encode()) for t in texts), np.uint64, len(texts))
    return pa.array(found.view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: list[str] = ()) -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long) of every row, then x and y, its marks, if there are any."""
    names = list("xy"[: len(marks)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _fingerprints(b.column(1)), *b.columns[2:]], ["id", "fp", *names])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(id_col, text_col, *marks).mapInArrow(released(each), ", ".join([f"id {kind}", "fp long", *["x long", "y int"][: len(marks)]]))


def variants(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(bits to flip, bits to keep) of each variant, as signed longs. Flips lie in kept bits."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    assert radius == 3 and sum(BLOCKS) == 64
    out, low = [], 0
    for width in BLOCKS:
        keep = (2**64 - 1) ^ (((1 << width) - 1) << low)
        low += width
        out += [(signed(f), signed(keep)) for f in [0, *(1 << i for i in range(64) if keep >> i & 1)]]
    return out


def _forest(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect whatever is within RADIUS among distinct fingerprints, fewer than their number."""
    left = fps
    while len(left) > 1:
        reach, left = [left[0]], left[1:]
        while reach and len(left):
            at = reach.pop()
            near = np.bitwise_count(left ^ at) <= RADIUS
            for x in left[near]:
                yield int(at), int(x)
                reach.append(x)
            left = left[~near]


def _pairs(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Verified links among fingerprints with equal keys, both sorted by key and then fingerprint; smaller ones first."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    a = first[size == 2]
    near = np.bitwise_count(fp[a] ^ fp[a + 1]) <= RADIUS
    found = [np.stack([fp[a][near], fp[a + 1][near]], axis=1)]
    for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        if edges := list(_forest(fp[i : i + n])):
            found.append(np.array(edges, np.uint64))
    both = np.concatenate(found)
    return np.stack([both.min(axis=1), both.max(axis=1)], axis=1) if len(both) else both


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links among the fingerprints that share a key. All rows of a key are in this partition, one after the other.

    Besides a batch, only the rows of its last key are held, as the next batch may have more of them.
    """
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in _with_end(batches):
        if b is not None:
            key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            ready = int(np.searchsorted(key, key[-1])) if len(key) else 0
        else:
            ready = len(key)
        if ready:
            found = np.unique(_pairs(key[:ready], fp[:ready]), axis=0).view(np.int64)
            key, fp = key[ready:], fp[ready:]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], ["a", "b"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and None after the last one."""
    yield from batches
    yield None


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect the distinct fingerprints fps(fp) as all pairs within RADIUS would."""
    table = F.array(*[F.struct(F.lit(f).alias("flip"), F.lit(k).alias("keep")) for f, k in variants()])
    keys = fps.select("fp", F.explode(table).alias("x")).select(F.col("fp").bitwiseXOR(F.col("x.flip")).bitwiseAND(F.col("x.keep")).alias("key"), "fp")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(released(_meet), "a long, b long").distinct()


def groups(fps: DataFrame) -> DataFrame:
    """fp, group (the smallest fingerprint reachable), least (smallest id of the fingerprint): fingerprints with copies or links."""
    first = fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    parts = components(links(first.select("fp")).select(F.col("a").alias("u"), F.col("b").alias("v")), fps.count())
    return first.join(parts, first.fp == parts.node, "left").where("copies > 1 OR component IS NOT NULL").select("fp", F.coalesce("component", "fp").alias("group"), "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable), one row per document."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    found = materialize(groups(fps), "groups")
    reached = split_join(found.select("fp", "group"), found.groupBy("group").agg(F.min("least").alias("reached")), ["group"]).drop("group")
    return split_join(fps, reached, ["fp"], "left").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("reached", "id").alias("component_id")
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the first of each near-duplicate group; all columns as they were."""
    docs, marks = with_marks(docs, id_col, text_col)
    fps = materialize(fingerprints(docs, id_col, text_col, marks), "fingerprints")
    members = materialize(split_join(fps, groups(fps).drop("least"), ["fp"]), "members")
    row = F.struct(F.col("id").isNull().alias("unknown"), "id", "x", "y")
    gone = split_join(members, members.groupBy("group").agg(F.min(row).alias("best")), ["group"]).where(~row.eqNullSafe(F.col("best")))
    return without_rows(docs, marks, gone, id_col)
