"""SimHash near-dedup (operator 6).

Every text gets a 64-bit SimHash of its word shingles, and fingerprints that differ in at most ``max_bits`` bits are
linked. Candidates come from pigeonring filtering. The 64 bits, seen as a ring, are divided into ``max_bits + 1`` segments.
If two fingerprints differ in at most ``max_bits`` bits, then some segment starts a chain in which, for every length l,
the first l segments together differ in at most l - 1 bits: its proportional budget. So the first segment is equal and the
second differs by at most one bit, which an equality join on both finds when one side lists its second
segment's one-bit variants; the budgets of longer chains are then checked in turn, before the full distance.

Large groups of near copies have very many links. They are therefore linked in two steps. First, fingerprints that agree
outside one segment are gathered (at most ``2^13`` or so distinct values, the size of a segment) and a spanning forest of
their links is emitted. Then the join takes only keys on which different components of the first step meet, and leaves
out pairs of one component. Links within a component change nothing, so the components are exact.

Cases: a null text is the empty text and its fingerprint is zero, which is linked like any other. A text of fewer words
than a shingle has one shingle, of all its words. Equal fingerprints belong together. Repeated rows stay, each with the
same component. Rows with a null ``doc_id`` get a component too; ``component_id`` is null only where all its
``doc_id`` are. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import batches_of, saved, text_of
from quantloom.llm.components import components

SEED = 42
#: A to Z in lower case; every other byte as it is.
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Shingles that are counted at a time, so that very long texts need little memory.
BLOCK = 1 << 16


def fingerprint(text: str, shingle_words: int) -> int:
    """SimHash of a whole text as an unsigned 64-bit integer: a bit is 1 if set in over half the shingles' hashes."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # of bytes: at space, tab, \\n, \\v, \\f, \\r
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - shingle_words + 1, 1)
    first, last = starts[:n].tolist(), ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """``doc_id, h, fp``: the fingerprint of every row's whole text, as a signed 64-bit integer; ``h`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x, shingle_words) for x in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found.view(np.int64))], ["doc_id", "h", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    return batches_of(rows).mapInArrow(run, "doc_id long, h long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """Start and width of the ``max_bits + 1`` segments of the ring, as even as can be."""
    n = max_bits + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(width: int) -> int:
    return (1 << width) - 1


def _ring_mask(segment: tuple[int, int]) -> int:
    return _mask(segment[1]) << segment[0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _part(fp: Column, segment: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, segment[0]).bitwiseAND(F.lit(_mask(segment[1])))


def _forest(groups: DataFrame, max_bits: int) -> DataFrame:
    """Links ``a, b`` that span each group's graph of fingerprints at most ``max_bits`` apart. Groups are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for values in batch.column(0).to_pylist():
                fps = np.array(values, dtype=np.int64).view(np.uint64)
                todo, reached = np.ones(len(fps), dtype=bool), []
                while todo.any():
                    if not reached:
                        k = int(todo.argmax())
                        todo[k] = False
                    else:
                        k = reached.pop()
                    near = np.flatnonzero(todo & (np.bitwise_count(fps ^ fps[k]) <= max_bits))
                    todo[near] = False
                    reached.extend(near.tolist())
                    out_a.extend([values[k]] * len(near))
                    out_b.extend(values[j] for j in near)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return batches_of(groups).mapInArrow(run, "a long, b long")


def link_fingerprints(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """``fp, root`` for the fingerprints of ``distinct (fp)`` that have links; ``root`` names their component."""
    ring = segments(max_bits)
    fp = F.col("fp")

    # fingerprints that agree outside one segment
    outside = F.array(*(F.struct(F.lit(i).alias("i"), fp.bitwiseAND(F.lit(_signed(~_ring_mask(r) & _mask(64)))).alias("rest")) for i, r in enumerate(ring)))
    alike = distinct.select("fp", F.explode(outside).alias("k")).groupBy("k").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    near = saved(components(_forest(alike.select("fps"), max_bits)))
    known = saved(distinct.join(near.select(F.col("node").alias("fp"), F.col("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))

    # chains that start at segment i: equal there, and at most one bit apart in the next
    plain, asking = [], []
    for i in range(len(ring)):
        own, after = ring[i], ring[(i + 1) % len(ring)]
        key = F.shiftleft(_part(fp, own).bitwiseOR(F.shiftleft(_part(fp, after), own[1])), 6).bitwiseOR(F.lit(i))
        plain.append(F.struct(key.alias("key"), F.lit(False).alias("asks")))
        flips = [0, *(1 << (6 + own[1] + bit) for bit in range(after[1]))]
        asking.extend(F.struct(key.bitwiseXOR(F.lit(x).cast("long")).alias("key"), F.lit(True).alias("asks")) for x in flips)
    # a small table has few partitions, and what is made of it here is some 75 times as large
    spread = known.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = spread.select("fp", "root", F.explode(F.array(*plain, *asking)).alias("k")).select("fp", "root", "k.key", "k.asks")
    here = Window.partitionBy("key")
    mixed = saved(keyed.withColumns({"lo": F.min("root").over(here), "hi": F.max("root").over(here)}).filter("lo <> hi").drop("lo", "hi"))

    a = mixed.filter("asks").select("key", F.col("fp").alias("x"), F.col("root").alias("a"))
    b = mixed.filter("NOT asks").select("key", F.col("fp").alias("y"), F.col("root").alias("b"))
    apart = F.col("x").bitwiseXOR(F.col("y"))
    chain = F.lit(False)
    for i in range(len(ring)):
        budget, bits = F.lit(True), _ring_mask(ring[i])
        for l in range(1, len(ring)):  # the first l + 1 segments from i on
            bits |= _ring_mask(ring[(i + l) % len(ring)])
            budget = budget & (F.bit_count(apart.bitwiseAND(F.lit(_signed(bits)))) <= l)
        chain = chain | ((F.col("key").bitwiseAND(F.lit(63)) == i) & budget)
    links = a.join(b, "key").filter((F.col("a") != F.col("b")) & (F.col("x") < F.col("y")) & chain & (F.bit_count(apart) <= max_bits))
    over = components(links.select("a", "b"))
    return known.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, h, fp, component_id`` for every row of ``docs``; ``component_id`` is the component's smallest ``doc_id``."""
    return _grouped(docs, shingle_words, max_bits).select("doc_id", "h", "fp", "component_id")


def _grouped(docs: DataFrame, shingle_words: int, max_bits: int) -> DataFrame:
    """``doc_id, h, fp, component_id, root`` for every row of ``docs``."""
    rows = saved(fingerprints(docs, shingle_words))
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = saved(distinct.join(link_fingerprints(distinct.select("fp"), max_bits), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "h", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle_words: int = 5, max_bits: int = 4) -> DataFrame:
    """One row of each group of near copies, the one of the smallest ``doc_id`` (of several texts under this one, of the
    smallest hash). Texts that are not alike all stay, also under one ``doc_id``; rows without a ``doc_id`` stay. All
    columns of ``docs`` stay, in order."""
    named = docs.filter("doc_id IS NOT NULL")
    kept = _grouped(named, shingle_words, max_bits).groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("kept"))
    kept = kept.select(F.col("kept.doc_id").alias("__ql_id"), F.col("kept.h").alias("__ql_h"))
    rows = named.withColumns({"__ql_own": F.col("doc_id").cast("long"), "__ql_text": F.xxhash64(text_of())})
    first = rows.join(kept, (F.col("__ql_own") == F.col("__ql_id")) & (F.col("__ql_text") == F.col("__ql_h"))).dropDuplicates(["__ql_own", "__ql_text"])
    return first.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))
