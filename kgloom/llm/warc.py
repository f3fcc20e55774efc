"""WARC files and a Merkle fixity audit of their replicas.

Files are compressed as the format advises: each record is a gzip member of its own, so its bytes can be found, checked and
read at their offset alone. Spark's text sink writes them; what it puts after each record is an empty gzip member, so a
file is a plain .warc.gz to any tool. Files are filled in the order of the input, without a shuffle, up to near FILE_BYTES.

For the audit, each file is read once. Its leaves are the ranges of offsets of its records, each with the SHA-256 of the bytes
there; FAN_OUT neighbours make a node, whose hash covers the ranges and hashes below it, up to one root. The nodes
of all files are written as a table by level. Two replicas are compared at the roots; only below nodes that differ are the
children read and compared, so a sound file costs one comparison. Records below the last nodes that differ
are matched by their ids, in order of offset where an id repeats, so a record that is missing in one replica doesn't
make those after it differ.

A member that can't be read (a damaged header, body or checksum) is one range up to the next member that can. Its id is what
its sound beginning says, or else that of the other replica's record at the same offset.

Defined results: null html or url is empty; an empty table gives no files and nothing to audit; a record in one replica
only is `missing` or `extra`; a record with other bytes is `corrupt`; one with the same bytes at another offset is `moved`, all
others are `intact`; repeated pages are records of their own; null ids are written as an empty id; other columns of the
input, whatever their names, don't matter.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm.common import drop_table, materialize

FILE_BYTES = 16_000_000
FAN_OUT = 16
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_MAGIC = b"\x1f\x8b\x08"
#: What follows each record.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_CHUNK = 8192
NODES = "shard long, level int, n long, low long, high long, hash binary, record_id string, root boolean"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """record_id, value: one WARC resource record per page."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    own = F.concat(F.lit("<urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(">"))
    head = [
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: "),
        own,
        F.lit("\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", ""),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
        F.lit("\r\n\r\n"),
    ]
    return pages.select(own.alias("record_id"), F.concat(*head).cast("binary").alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", stored: Callable[[str, bytes], bytes | None] | None = None) -> None:
    """Write the pages as WARC files in their order, each near FILE_BYTES: path/shard=<number>/.

    `stored`, if given, says what the storage makes of the bytes of a record with such an id; nothing for a lost one.
    """
    size = pages.agg(F.sum(F.octet_length(html_col)).alias("bytes"), F.count("*").alias("n")).first()
    per_file = max(1, FILE_BYTES * size.n // max(1, size.bytes or 0)) if size.n else 1
    place = F.monotonically_increasing_id()
    shard = F.shiftleft(F.shiftright(place, 33), 33) + F.floor(place.bitwiseAND((1 << 33) - 1) / per_file)
    rows = records(pages, id_col, url_col, html_col).select(shard.alias("shard"), place.alias("place"), "record_id", "value")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [gzip.compress(v.as_py(), LEVEL, mtime=0) for v in b.column(3)]
            if stored:
                data = [stored(i, x) for i, x in zip(b.column(2).to_pylist(), data)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["shard", "place", "value"])

    out = rows.mapInArrow(members, "shard long, place long, value binary").where("value IS NOT NULL")
    out = out.sortWithinPartitions("shard", "place").select("shard", F.col("value").cast("string").alias("value"))
    out.write.partitionBy("shard").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _member(data: memoryview, at: int, chunk: int = _CHUNK) -> tuple[bytes, int]:
    """What the gzip member at an offset holds, and its end, or -1 if it isn't sound: then as much of it as can be read."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < len(data):
            out.append(z.decompress(data[pos : pos + chunk]))
            pos += chunk
    except zlib.error:
        return b"".join(out), -1
    return b"".join(out), min(pos, len(data)) - len(z.unused_data) if z.eof else -1


def members(data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """(offset, length, content, whether it is sound) of each record of a file; empty members aren't records."""
    view, at = memoryview(data), 0
    while at < len(data):
        content, end = _member(view, at)
        if end >= 0 and (not content or content.startswith(b"WARC/")):
            if content:
                yield at, end - at, content, True
            at = end
            continue
        end = at
        while True:  # the next place where a sound member begins
            end = data.find(_MAGIC, end + 1)
            if end < 0:
                end = len(data)
                break
            after, stop = _member(view, end)
            if stop >= 0 and (not after or after.startswith(b"WARC/")):
                break
        yield at, end - at, _member(view, at, 32)[0], False
        at = end


def fields(content: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the payload of a record. A length that isn't a number gives all there is."""
    head, _, body = content.partition(_END)
    given = dict((k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
    size = given.get("Content-Length", "")
    return given, body[: int(size)] if size.isascii() and size.isdigit() else body.removesuffix(_END)


def record_id(content: bytes) -> str | None:
    head, found, _ = content.partition(_END)
    lines = head.split(b"\r\n")
    for line in lines if found else lines[:-1]:  # the last line of a piece may be cut
        name, _, value = line.partition(b":")
        if name.strip() == b"WARC-Record-ID":
            return value.strip().decode("utf-8", "replace")
    return None


def file_nodes(data: bytes, fan_out: int = FAN_OUT) -> list[tuple[int, int, int, int, bytes, str | None, bool]]:
    """(level, n, low, high, hash, record id, whether it is the root) of the Merkle tree of a file, leaves first."""
    level = [(o, o + n, hashlib.sha256(memoryview(data)[o : o + n]).digest(), record_id(content)) for o, n, content, _ in members(data)]
    out, height = [], 0
    while level:
        out += [(height, n, low, high, digest, own, len(level) == 1) for n, (low, high, digest, own) in enumerate(level)]
        if len(level) == 1:
            break
        groups = [level[i : i + fan_out] for i in range(0, len(level), fan_out)]
        level = [(g[0][0], g[-1][1], hashlib.sha256(b"".join(low.to_bytes(8, "big") + high.to_bytes(8, "big") + digest for low, high, digest, _ in g)).digest(), None) for g in groups]
        height += 1
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    """shard, content: one row per file, as Spark's reader for whole files gives them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"), "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, offset, record_id, url, html of every sound record."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1)):
                found = [(o, *fields(content)) for o, _, content, sound in members(data.as_py()) if sound]
                columns = [[shard] * len(found), [o for o, _, _ in found], *([h.get(k) for _, h, _ in found] for k in ("WARC-Record-ID", "WARC-Target-URI")), [p.decode("utf-8", "replace") for _, _, p in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["shard", "offset", "record_id", "url", "html"])

    return _files(spark, path).mapInArrow(each, "shard long, offset long, record_id string, url string, html string")


def tree(spark: SparkSession, path: str) -> DataFrame:
    """The nodes (NODES) of the Merkle trees of all files, as a table written by level."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_())
    names = [x.split()[0] for x in NODES.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1)):
                found = [(shard, *x) for x in file_nodes(data.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names)

    return materialize(_files(spark, path).mapInArrow(each, NODES), "merkle", ["level"])


def _candidates(nodes: DataFrame, level: int, suspects: DataFrame | None) -> DataFrame:
    """The nodes of a level that must be compared: children of nodes that differ, and roots."""
    own = nodes.where(F.col("level") == level)
    if suspects is None:
        return own.where("root")
    below = own.withColumn("_up", F.floor(F.col("n") / FAN_OUT)).join(suspects.select("shard", F.col("n").alias("_up")), ["shard", "_up"], "left_semi").drop("_up")
    return below.where("NOT root").unionByName(own.where("root").select(*below.columns))


def _with_ids(leaves: DataFrame, others: DataFrame) -> DataFrame:
    """Ranges without an id take that of the other replica's record at the same offset."""
    known = others.where("record_id IS NOT NULL").select(F.col("shard").alias("_shard"), F.col("low").alias("_low"), F.col("record_id").alias("_id"))
    found = leaves.join(known, (F.col("shard") == F.col("_shard")) & (F.col("low") == F.col("_low")) & F.col("record_id").isNull(), "left")
    return found.withColumn("record_id", F.coalesce("record_id", "_id")).drop("_shard", "_low", "_id")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """shard, record_id, low (offset with us, null if extra), at, size (where it lies in the replica), replica_hash, status of all records that differ; both are tree() tables."""
    tops = [t.where("root").agg(F.max("level")).first()[0] for t in (ours, theirs)]
    suspects, written = None, []
    for level in range(max((t for t in tops if t is not None), default=0), 0, -1):
        a, b = (_candidates(t, level, suspects).select("shard", "n", F.struct("low", "high", "hash").alias(c)) for t, c in ((ours, "a"), (theirs, "b")))
        suspects = materialize(a.join(b, ["shard", "n"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("shard", "n"), "suspects")
        written.append(suspects)
    a, b = (_candidates(t, 0, suspects).select("shard", "low", (F.col("high") - F.col("low")).alias("size"), "hash", "record_id") for t in (ours, theirs))
    a, b = _with_ids(a, b), _with_ids(b, a)
    nth = F.row_number().over(Window.partitionBy("shard", "name").orderBy("low"))
    # where neither replica says an id, the offset stands for it
    named = lambda d: d.withColumn("name", F.coalesce("record_id", F.concat(F.lit("@"), F.col("low").cast("string")))).withColumn("nth", nth)
    a = named(a).select("shard", "name", "nth", "low", "record_id", "hash", F.lit(True).alias("_a"))
    b = named(b).select("shard", "name", "nth", F.col("low").alias("at"), "size", F.col("hash").alias("replica_hash"), F.col("record_id").alias("_id"), F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("hash") != F.col("replica_hash"), "corrupt").when(F.col("low") != F.col("at"), "moved")
    found = a.join(b, ["shard", "name", "nth"], "full").withColumn("status", status).where("status IS NOT NULL")
    found = materialize(found.select("shard", F.coalesce("record_id", "_id").alias("record_id"), "low", "at", "size", "replica_hash", "status"), "differences")
    for table in written:
        drop_table(table)
    return found


def fixity(spark: SparkSession, path: str, replica: str) -> DataFrame:
    """shard, offset, length, record_id, hash, status of every record of the files, and of those that only the replica has."""
    ours, theirs = tree(spark, path), tree(spark, replica)
    found = audit(ours, theirs)
    drop_table(theirs)
    leaves = ours.where("level = 0").select("shard", F.col("low").alias("offset"), (F.col("high") - F.col("low")).alias("length"), "record_id", "hash")
    known = found.where("low IS NOT NULL").select("shard", F.col("low").alias("offset"), "status")
    extra = found.where("low IS NULL").select("shard", F.col("at").alias("offset"), F.col("size").alias("length"), "record_id", F.col("replica_hash").alias("hash"), "status")
    return leaves.join(known, ["shard", "offset"], "left").withColumn("status", F.coalesce("status", F.lit("intact"))).unionByName(extra)
