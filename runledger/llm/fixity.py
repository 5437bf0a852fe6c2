"""Merkle fixity audit of web archive replicas.

A replica is a set of WARC files, each a sequence of records at ascending offsets. Every record
is hashed; the records of an offset range are hashed together in order, ``FANOUT`` ranges make
the next larger one up to the file, and files are joined likewise up to the replica's root. Two
replicas are compared from the root down: only the children of nodes that differ are looked at,
so an intact replica costs one comparison and a damaged record one path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from runledger.llm.common import stored

FILE_BYTES = 1 << 28  # a file ends with the record that reaches this
RANGE_BYTES = 1 << 16
FANOUT = 16
_FILE_LEVEL = 3  # RANGE_BYTES * FANOUT ** 3 == FILE_BYTES
_FILES_PER_TASK = 1 << 20


def record(url: Column, html: Column) -> Column:
    """A page as the bytes of a WARC resource record; nulls are empty."""
    url, html = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, html, F.lit("\r\n\r\n")), "UTF-8")


def archive(pages: DataFrame) -> DataFrame:
    """page_id, url, file, offset, length, content: the pages as records of files, in order of id.

    Files are cut inside a task by size, so no file grows with the data. Equal pages are records
    of their own at offsets of their own.
    """
    rows = pages.select("page_id", "url", record(F.col("url"), F.col("html")).alias("content"))
    rows = rows.withColumn("digest", F.xxhash64("url", "content")).repartitionByRange("page_id", "digest").sortWithinPartitions("page_id", "digest").drop("digest")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at = TaskContext.get().partitionId() * _FILES_PER_TASK, 0
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column("content")).to_numpy(zero_copy_only=False).astype(np.int64)
            files, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for k, length in enumerate(lengths.tolist()):
                if at >= FILE_BYTES:
                    file, at = file + 1, 0
                files[k], offsets[k] = file, at
                at += length
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(files), pa.array(offsets), pa.array(lengths), batch.column("content")],
                ["page_id", "url", "file", "offset", "length", "content"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(place, f"page_id {kind}, url string, file long, offset long, length long, content binary")


def leaves(records: DataFrame) -> DataFrame:
    """page_id, file, offset, length and sha256 of each record."""
    return records.select("page_id", "file", "offset", "length", F.sha2("content", 256).alias("sha256"))


def _parent(level: int) -> list[Column]:
    """The node a node of the level below belongs to, as its file (or group of files) and its range."""
    if level == 0:
        return [F.col("file"), F.floor(F.col("offset") / RANGE_BYTES).alias("range")]
    if level <= _FILE_LEVEL:
        return [F.col("file"), F.floor(F.col("range") / FANOUT).alias("range")]
    return [F.floor(F.col("file") / FANOUT).alias("file"), F.lit(0).cast("long").alias("range")]


class Tree:
    """The nodes of a replica, one table per level: file, range, hash. The last level is the root."""

    def __init__(self, records: DataFrame):
        self.leaves = stored(leaves(records), "fixity-leaves")
        nodes = self.leaves.select("file", "offset", F.concat_ws(":", "offset", "length", "sha256").alias("hash"))
        self.levels: list[DataFrame] = []
        while True:
            level = len(self.levels)
            order = F.col("offset") if level == 0 else F.struct(F.col("file").alias("f"), F.col("range").alias("r"))
            children = nodes.select(*_parent(level), order.alias("order"), "hash")
            # A node has FANOUT children at most, a range as many records as fit in it.
            content = F.array_join(F.array_sort(F.collect_list(F.struct("order", "hash")))["hash"], ",")
            nodes = stored(children.groupBy("file", "range").agg(F.sha2(content, 256).alias("hash")), f"fixity-level-{level}")
            self.levels.append(nodes)
            if level > _FILE_LEVEL and nodes.limit(2).count() < 2:
                return


def _differing(one: DataFrame, two: DataFrame, keys: list[str], value: str) -> DataFrame:
    both = one.withColumnRenamed(value, "one").join(two.withColumnRenamed(value, "two"), keys, "full_outer")
    return both.where(~F.col("one").eqNullSafe(F.col("two")))


def audit(one: Tree, two: Tree) -> DataFrame:
    """page_id, file, offset, length, kind, sha256_one, sha256_two of each record that differs.

    ``kind`` is changed, missing (only in the first) or added (only in the second). Two equal or
    two empty replicas give no rows, an empty one gives all records of the other. Nulls in pages
    are empty texts; repeated pages are separate records.
    """
    top = max(len(one.levels), len(two.levels))
    for tree in (one, two):  # a replica of fewer files has further roots above its own
        while len(tree.levels) < top:
            tree.levels.append(stored(tree.levels[-1].select(*_parent(len(tree.levels)), F.sha2("hash", 256).alias("hash")), "fixity-root"))
    wrong = None
    for level in range(top - 1, -1, -1):
        a, b = one.levels[level], two.levels[level]
        if wrong is not None:
            inside = lambda nodes: _below(nodes, level + 1, wrong)  # noqa: B023, E731
            a, b = inside(a), inside(b)
        wrong = stored(_differing(a, b, ["file", "range"], "hash").select("file", "range"), f"fixity-wrong-{level}")
        if wrong.isEmpty():
            break
    a, b = _below(one.leaves, 0, wrong), _below(two.leaves, 0, wrong)
    pack = lambda leaves: leaves.select("file", "offset", F.struct("page_id", "length", "sha256").alias("is"))
    found = _differing(pack(a), pack(b), ["file", "offset"], "is")
    kind = F.when(F.col("two").isNull(), "missing").when(F.col("one").isNull(), "added").otherwise("changed")
    either = lambda name: F.coalesce(F.col(f"one.{name}"), F.col(f"two.{name}")).alias(name)
    return found.select(
        either("page_id"), "file", "offset", either("length"), kind.alias("kind"),
        F.col("one.sha256").alias("sha256_one"), F.col("two.sha256").alias("sha256_two"),
    )


def _below(nodes: DataFrame, parent_level: int, wrong: DataFrame) -> DataFrame:
    """The nodes whose parent is among those that differ."""
    file, range_ = _parent(parent_level)
    keyed = nodes.withColumns({"__file": file, "__range": range_})
    mark = wrong.select(F.col("file").alias("__file"), F.col("range").alias("__range"))
    return keyed.join(mark, ["__file", "__range"], "left_semi").select(*nodes.columns)


def decayed(records: DataFrame, lost: str, flipped: str) -> DataFrame:
    """A replica with damage that depends on the urls' digests: some records lost, some with their first letter changed."""
    mark = F.substring(F.md5(F.coalesce(F.col("url"), F.lit(""))), 1, 2)
    bad = F.concat(F.lit("X").cast("binary"), F.substring("content", 2, 1 << 30))
    return records.where(mark != lost).withColumn("content", F.when(mark == flipped, bad).otherwise(F.col("content")))


def audit_of_pages(pages: DataFrame) -> DataFrame:
    """Archive the pages twice, with different damage to the two replicas, and audit one against the other."""
    records = stored(archive(pages), "warc-records")
    return audit(Tree(decayed(records, "00", "01")), Tree(decayed(records, "02", "03")))


ORACLE_SQL = """
with records as (
    select page_id, substr(md5(coalesce(url, '')), 1, 2) as mark,
        'ARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
        || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
        || octet_length(encode(coalesce(html, '')))::varchar || chr(13) || chr(10) || chr(13) || chr(10)
        || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as rest
    from pages)
select page_id, octet_length(encode('W' || rest))::bigint as length,
    case mark when '00' then 'added' when '02' then 'missing' else 'changed' end as kind,
    case mark when '00' then null when '01' then sha256('X' || rest) else sha256('W' || rest) end as sha256_one,
    case mark when '02' then null when '03' then sha256('X' || rest) else sha256('W' || rest) end as sha256_two
from records where mark in ('00', '01', '02', '03')
"""
