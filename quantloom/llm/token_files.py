"""Token-ID / binary output (operator 1).

Ids are renumbered by falling corpus frequency, so that common ids are small, and written in a byte-aligned
variable-length code: one to four data bytes an id, and apart from them control bytes, which hold four two-bit
lengths each. Reading looks the four lengths of a control byte up in a numpy table and gathers the data bytes,
without a loop over ids.

On disk a token file set is two Parquet folders, which any store that Spark writes can hold and whose commit
protocol survives lost executors: ``ranks`` (``rank, id``) and ``blocks``, one row per block of consecutive documents:

* ``part, block`` - position of the block; documents ascend over ``(part, block)`` and within it
* ``before``, ``n_ids`` - ids of the blocks of the same part before this one, and of this one
* ``doc_ids`` (int64), ``counts`` (uint32) - little-endian arrays, an entry per document; ``no_id`` (uint8) marks null ids
* ``control``, ``data`` - the code of the block's ids

Cases: a null text is the empty text, whose document holds the end id alone. Rows with a null ``doc_id`` come first.
Repeated rows are kept, next to each other. An empty table gives empty folders. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import batches_of, shared_folder, text_of
from quantloom.llm.tokens import encoder

#: Lengths, 1 to 4 bytes, of the four ids that a control byte describes.
LENGTHS = (np.arange(256)[:, None] >> (2 * np.arange(4)) & 3).astype(np.int64) + 1
#: Ids after which a block is closed. A document is never divided over blocks.
BLOCK_IDS = 1 << 17
BLOCKS = "part int, block int, before long, n_ids long, doc_ids binary, no_id binary, counts binary, control binary, data binary"


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    if not len(values):
        return b"", b""
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four = np.zeros((len(values) + 3) // 4 * 4, dtype=np.uint8)
    four[: len(values)] = extra
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    kept = np.arange(4) <= extra[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values that ``pack`` has written."""
    if not n:
        return np.zeros(0, dtype="<u4")
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    held = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    out = held[starts].astype(np.uint32)
    for k in range(1, int(lengths.max())):
        out |= np.where(lengths > k, held[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out.astype("<u4")


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text and ``end_id``, as little-endian unsigned 16-bit integers
    where the vocabulary allows it, else 32-bit ones."""
    width = "<u2" if _vocabulary(path, end_id) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id).encode
        for b in batches:
            ids = [np.frombuffer(encode(x), dtype="<u4").astype(width).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return batches_of(rows).mapInArrow(run, "doc_id long, ids binary")


def _vocabulary(path: str, end_id: int) -> int:
    return max(encoder(path, end_id).tokenizer.get_vocab_size(), end_id + 1)


def count_ids(ids: DataFrame, size: int) -> DataFrame:
    """``id, n``: how often each id comes. Each task counts its own rows first; the result has at most
    one row per entry of the vocabulary."""
    width = "<u2" if size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, dtype=np.int64)
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=width), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 1) -> None:
    """Encode every document of ``docs`` and write the file set to ``folder``, in ascending ``doc_id`` order.

    The texts are tokenized once, into ``folder/ids``. The frequency table has at most as many rows as the
    vocabulary and is all that the driver sees.
    """
    spark, size = docs.sparkSession, _vocabulary(path, end_id)
    width = "<u2" if size <= 1 << 16 else "<u4"
    tokenize(docs, path, end_id).write.parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")
    counted = {r["id"]: r["n"] for r in count_ids(ids, size).collect()}  # at most ``size`` rows
    order = np.array(sorted(range(size), key=lambda x: (-counted.get(x, 0), x)), dtype=np.int64)
    rank = np.empty(size, dtype="<u4")
    rank[order] = np.arange(size)
    spark.createDataFrame(list(enumerate(order.tolist())), "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, held, n_held = TaskContext.get().partitionId(), 0, 0, [], 0

        def closed() -> pa.RecordBatch:
            values = [rank[np.frombuffer(x, dtype=width)] for _, x in held]
            control, data = pack(np.concatenate(values))
            row = {
                "part": part, "block": block, "before": before, "n_ids": n_held,
                "doc_ids": np.array([d or 0 for d, _ in held], dtype="<i8").tobytes(),
                "no_id": np.array([d is None for d, _ in held], dtype=np.uint8).tobytes(),
                "counts": np.array([len(v) for v in values], dtype="<u4").tobytes(),
                "control": control, "data": data,
            }
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((doc, x))
                n_held += len(x) // np.dtype(width).itemsize
                if n_held >= BLOCK_IDS:
                    yield closed()
                    block, before, held, n_held = block + 1, before + n_held, [], 0
        if held:
            yield closed()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = ids.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    batches_of(ordered).mapInArrow(blocks, BLOCKS).write.parquet(f"{folder}/blocks")


_BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), *((x, pa.binary()) for x in ("doc_ids", "no_id", "counts", "control", "data"))])


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids array<long>``) of every document, from the files.

    ``start`` counts the ids of all documents before it. Only a sum per part, of which there are as many as
    partitions written, passes through the driver.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()  # as long as the vocabulary
    order = np.array([r["id"] for r in ranks], dtype="<u4")
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row per part
    base, so_far = {}, 0
    for r in totals:
        base[r["part"]] = so_far
        so_far += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                counts = np.frombuffer(row["counts"], dtype="<u4").astype(np.int64)
                ids = order[unpack(row["control"], row["data"], int(counts.sum()))]
                ends = np.cumsum(counts)
                each = np.split(ids, ends[:-1])
                docs = np.ma.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=np.frombuffer(row["no_id"], dtype=np.uint8))
                out = [
                    pa.array(docs.data, pa.int64(), mask=np.ma.getmaskarray(docs)),
                    pa.array(base[row["part"]] + row["before"] + ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([x.tolist() for x in each], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return batches_of(blocks).mapInArrow(run, schema)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared one of the cluster."""
    return f"{shared_folder(spark)}/token_files/{uuid.uuid4().hex}"
