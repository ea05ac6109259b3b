"""Exact dedup (operator 13) by Grace hashing.

Texts are equal if they are identical once each run of white space is one space. The digest of a text is told in the result but
decides nothing: complete contents are compared.

1. Every task reads its rows through an open-addressing table and writes them to spill files in the shared folder: the first row of
   a content with the text, its copies as links to that row. So a content that a third of all rows have leaves each task once.
2. First rows are dealt into buckets by a hash of the content, as many as their size asks for. What a bucket weighs is known from the
   spill files before it is read. A bucket that fits is one table, which links its rows to the first one of the same content.
3. Buckets that don't fit are dealt again to tasks of even size, go through tables there (copies meet) and to new spill files, and these are
   partitioned by another hash, and so on. After ``MAX_LEVELS`` a bucket is read in the order of its hashes, and its table forgets all contents of
   other hashes: it holds one content at a time.
4. Links lead each row to its group. A group is counted and its smallest ``doc_id`` found by sums per first row, then per group.

Cases: a null text is the empty text. A row without ``doc_id`` is kept only if none of its group has one, and then ``keep_id`` is null; of
rows with the same smallest ``doc_id`` exactly one is kept. Repeated rows are copies. Texts are compared whole at any length; one that is
larger than a table is alone in it. An empty table gives an empty result. Other columns, whatever their names, are no part of
``exact_duplicates`` and stay as they are in ``keep_first``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import batches_of, saved, text_of

#: Bytes of content that a table holds at most, besides its last one.
TABLE_BYTES = 64 << 20
#: Levels of partitioning before buckets are read in order of their hashes.
MAX_LEVELS = 6


class ContentTable:
    """Open addressing with linear probing: from complete contents to the id that came first with each."""

    def __init__(self, slots: int = 1024) -> None:
        self.slots, self.hashes, self.contents, self.ids, self.bytes = array("q", [-1]) * slots, [], [], [], 0

    def put(self, h: int, content: bytes, own: int) -> int:
        """The id of the same content, which is ``own`` if it is new."""
        if 2 * len(self.ids) >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return self.ids[k]
            at = (at + 1) & mask
        self.slots[at] = len(self.ids)
        self.hashes.append(h)
        self.contents.append(content)
        self.ids.append(own)
        self.bytes += len(content)
        return own

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def normalised(text: Column) -> Column:
    """Each run of white space as one space; a single space is no match, so little is copied."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _linked(batch: pa.RecordBatch, to: list[int]) -> pa.RecordBatch:
    """The batch with ``to``; copies lose their text."""
    first = pc.equal(batch["id"], pa.array(to, pa.int64()))
    columns = [pc.if_else(first, batch[c], None) if c == "text" else batch[c] for c in batch.schema.names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(to, pa.int64())], [*batch.schema.names, "to"])


def _merge(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[pa.RecordBatch]:
    """A task's rows through one table after the other; a full table is forgotten, and equal rows after it meet in a bucket."""
    table = ContentTable()
    for batch in batches:
        to = []
        for own, h, content in zip(batch["id"].to_pylist(), batch["h"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if table.bytes > table_bytes:
                table = ContentTable()
            to.append(table.put(h, content, own))
        yield _linked(batch, to)


def _bucket(rows: pa.Table) -> pa.Table:
    """All rows of one bucket through one table."""
    table, out = ContentTable(), []
    for batch in rows.to_batches():
        out += [table.put(h, content, own) for own, h, content in zip(batch["id"].to_pylist(), batch["h"].to_pylist(), batch["text"].to_pylist(), strict=True)]
    return pa.table({"id": rows["id"], "to": pa.array(out, pa.int64())})


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their hashes, through a table of the contents of one hash."""
    table, last = ContentTable(16), None
    for batch in batches:
        out = []
        for own, h, content in zip(batch["id"].to_pylist(), batch["h"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if h != last:
                table, last = ContentTable(16), h
            out.append(table.put(h, content, own))
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out, pa.int64())], ["id", "to"])


def _spilled(rows: DataFrame, columns: str, table_bytes: int) -> DataFrame:
    """``rows`` through the tables of their tasks, as spill files."""
    return saved(batches_of(rows).mapInArrow(partial(_merge, table_bytes=table_bytes), f"{columns}, to long"))


def _links(rows: DataFrame, table_bytes: int, level: int = 0) -> DataFrame:
    """``id, to``: for every row ``(id, h, size, text)`` the row that stands for its content."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-4 * total // table_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(level)), F.lit(n)))
    heavy = rows.groupBy("bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n")).filter((F.col("size") > table_bytes) & (F.col("n") > 1)).select("bucket")
    heavy = saved(heavy)
    if heavy.isEmpty():
        return rows.groupBy("bucket").applyInArrow(_bucket, "id long, to long")
    fit = rows.join(heavy, "bucket", "left_anti").groupBy("bucket").applyInArrow(_bucket, "id long, to long")
    rest = rows.join(heavy, "bucket", "left_semi")
    if level + 1 >= MAX_LEVELS:
        return fit.unionByName(rest.repartition("bucket").sortWithinPartitions("h").select("id", "h", "text").mapInArrow(_ordered, "id long, to long"))
    spill = _spilled(rest.select("id", "h", "size", "text").hint("rebalance"), "id long, h long, size long, text binary", table_bytes)
    deeper = _links(spill.filter("text IS NOT NULL").drop("to"), table_bytes, level + 1).select(F.col("id").alias("to"), F.col("to").alias("root"))
    return fit.unionByName(spill.select("id", "to").join(deeper, "to").select("id", F.col("root").alias("to")))


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, a row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.encode(normalised(text_of()), "UTF-8").alias("text"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("id"), F.unhex(F.sha2("text", 256)).alias("sha"), F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("size"), "text")
    spill = _spilled(rows, f"doc_id {kind}, id long, sha binary, h long, size long, text binary", table_bytes)
    roots = saved(_links(spill.filter("text IS NOT NULL").select("id", "h", "size", "text"), table_bytes))

    members = spill.select("doc_id", "id", "sha", "to")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id"))
    firsts = members.groupBy("to").agg(least.alias("least"), F.count("*").alias("n"))
    firsts = firsts.join(roots.select(F.col("id").alias("to"), F.col("to").alias("root")), "to")
    groups = firsts.groupBy("root").agg(F.min("least").alias("best"), F.sum("n").alias("group_size"))
    found = members.join(firsts.select("to", "root").join(groups, "root"), "to")
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("id") == F.col("best.id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which ``exact_duplicates`` keeps one of each group."""
    kept = exact_duplicates(docs, table_bytes).filter("kept").select(F.col("doc_id").alias("__ql_id"), F.col("text_sha256").alias("__ql_sha"))
    rows = docs.withColumn("__ql_own", F.sha2(F.encode(normalised(text_of()), "UTF-8"), 256))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__ql_id")) & (F.col("__ql_own") == F.col("__ql_sha")), "left_semi")
    return rows.dropDuplicates(["doc_id", "__ql_own"]).drop("__ql_own")
