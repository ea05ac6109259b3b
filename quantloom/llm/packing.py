"""Best-fit packing (operator 9).

Pieces of at most ``capacity`` tokens go into sequences of that capacity by a configuration linear program over the
length histogram. A configuration is a multiset of lengths that fits one sequence, and the program asks for the
fewest sequences that cover every length's demand. Lengths are grouped into at most ``classes`` classes, each as
long as its longest member. Multiplicative weights solve the program: every class has a price that falls exponentially
with how far it is covered, and the dearest configuration at these prices, found by knapsack dynamic
programming, is used next. The fractional counts are rounded down; what is left, and pieces too short to matter to
the program, go where they fit best.

The histogram has at most ``capacity`` rows and the plan a bounded number of slots, however many documents there are: a
slot says that the pieces of one length with ranks ``first .. first + n - 1`` go to the sequences ``sequence,
sequence + 1, ...`` at one offset. Pieces are ranked by counting within partitions first, so no length, however
common, is gathered in one task.

Cases: a null text is the empty text, whose one piece is the end id alone. A very long text is cut into full pieces and a
rest. Repeated rows are packed like any other; ties between pieces of one length need no rule, for these are
interchangeable. An empty table gives an empty result. ``pack_documents`` ignores other columns, and ``pack_pieces`` keeps
them, whatever their names; columns ``sequence_id`` and ``offset`` are replaced.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import batches_of, cut, text_of
from quantloom.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Tokenize whole texts and cut only those of more than ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32``.

    A null text is the empty text, whose one piece holds the end id. Repeated rows are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id).encode
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut_out = ids[at : at + 4 * capacity]
                    out.append((doc, k, k * capacity, len(cut_out) // 4, zlib.crc32(cut_out)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return batches_of(rows).mapInArrow(run, PIECES)


def best_configuration(price: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each class in a configuration of greatest total price: unbounded knapsack by dynamic programming.

    ``size`` ascends. Classes that a shorter one matches in price cannot improve a configuration and are left out.
    """
    kept = np.flatnonzero(price > np.concatenate([[0.0], np.maximum.accumulate(price)[:-1]]))
    small, worth = size[kept], price[kept]
    total, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(small, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        total[c] = total[c - 1]
        if k := fits[c]:
            options = total[c - small[:k]] + worth[:k]
            j = int(options.argmax())
            if options[j] > total[c]:
                total[c], chosen[c] = options[j], j
    counts, c = np.zeros(len(size), dtype=np.int64), capacity
    while c > 0:
        if chosen[c] < 0:
            c -= 1
        else:
            counts[kept[chosen[c]]] += 1
            c -= int(small[chosen[c]])
    return counts


def solve_configurations(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, step: float = 0.25) -> list[tuple[np.ndarray, float]]:
    """Configurations and how many sequences of each cover every class's demand, by multiplicative weights.

    Ends after ``rounds`` pricing rounds at the latest; what is not covered by then is left to best fit.
    """
    covered, used = np.zeros(len(size)), {}
    target = np.log(len(size) + 1) / step
    for _ in range(rounds):
        if not len(size) or covered.min() >= target:
            break
        price = np.exp(-step * (covered - covered.min())) / demand
        counts = best_configuration(price, size, capacity)
        some = counts > 0
        times = float((demand[some] / counts[some]).min())
        covered += times * counts / demand
        key = counts.tobytes()
        used[key] = (counts, used.get(key, (counts, 0.0))[1] + times)
    scale = max(float(np.median(covered)), 1e-9) if len(size) else 1.0
    return sorted(((c, n / scale) for c, n in used.values()), key=lambda x: -x[1])


def plan(histogram: dict[int, int], capacity: int = 4096, classes: int = 128, units: int = 512, rounds: int = 1000) -> np.ndarray:
    """Slots ``length, first, n, sequence, offset`` that place every piece of a length histogram.

    The program knows sizes in steps of a share of the capacity, one in ``units``, rounded up, and leaves lengths of
    under a 32nd of the capacity to best fit.
    """
    unit = max(1, capacity // units)
    lengths = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[x] for x in lengths], dtype=np.int64)
    taken, slots, sequence = np.zeros(len(lengths), dtype=np.int64), [], 0
    free: dict[int, list[tuple[int, int]]] = {}  # by room left: runs of sequences alike, as first and count
    gaps: list[int] = []  # the keys of ``free``, ascending

    def add_free(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in free:
                free[gap] = []
                bisect.insort(gaps, gap)
            free[gap].append((first, n))

    def put(i: int, n: int, first: int, offset: int) -> None:
        slots.append((lengths[i], taken[i], n, first, offset))
        taken[i] += n
        left[i] -= n

    large = np.flatnonzero(lengths * 32 >= capacity)
    if len(large):
        share = np.minimum(np.cumsum(left[large]) * classes // max(int(left[large].sum()), 1), classes - 1)
        groups = [large[share == g] for g in np.unique(share)]
        size = np.array([-(-int(lengths[g].max()) // unit) for g in groups], dtype=np.int64)
        size = np.minimum(size, capacity // unit)
        demand = np.array([left[g].sum() for g in groups], dtype=np.float64)
        for counts, fraction in solve_configurations(size, demand, capacity // unit, rounds):
            times = int(fraction)
            while times > 0:
                # each slot takes the longest lengths left of its class; a run ends where one of them runs out
                picks: list[int] = []
                need: dict[int, int] = {}
                for g in np.flatnonzero(counts)[::-1]:
                    for _ in range(int(counts[g])):
                        i = next((int(x) for x in groups[g][::-1] if left[x] > need.get(int(x), 0)), -1)
                        if i >= 0:
                            picks.append(i)
                            need[i] = need.get(i, 0) + 1
                if len(picks) < counts.sum():
                    break
                run = min(times, min(int(left[i]) // k for i, k in need.items()))
                at = 0
                for i in picks:
                    put(i, run, sequence, at)
                    at += int(lengths[i])
                add_free(capacity - at, sequence, run)
                sequence += run
                times -= run
    for i in range(len(lengths) - 1, -1, -1):
        size_i = int(lengths[i])
        while left[i] > 0:
            k = bisect.bisect_left(gaps, size_i)
            if k == len(gaps):
                opened = -(-int(left[i]) // (capacity // size_i))
                add_free(capacity, sequence, opened)
                sequence += opened
                continue
            gap = gaps[k]
            first, n = free[gap].pop()
            if not free[gap]:
                del free[gap], gaps[k]
            run = min(n, int(left[i]))
            put(i, run, first, capacity - gap)
            add_free(gap, first + run, n - run)
            add_free(gap - size_i, first, run)
    return np.array(slots, dtype=np.int64).reshape(-1, 5)


def pack_pieces(found: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens; sequences fill without gaps from 0.

    Other columns stay.
    """
    found = cut(found.drop("sequence_id", "offset"))  # partitions must hold the same rows each time they are counted
    counted = found.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    slots = plan({r["length"]: r["n"] for r in counted}, capacity)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    keys = (slots[:, 0] << 44) + slots[:, 1]

    rows = found.withColumn("__ql_part", F.spark_partition_id())
    here = Window.partitionBy("__ql_part", "length")
    bases = rows.groupBy("__ql_part", "length").agg(F.count("*").alias("n"))
    bases = bases.withColumn("__ql_first", F.sum("n").over(Window.partitionBy("length").orderBy("__ql_part")) - F.col("n")).drop("n")
    ranked = rows.withColumn("__ql_nth", F.row_number().over(here.orderBy("doc_id", "piece"))).join(bases, ["__ql_part", "length"])
    ranked = ranked.withColumn("__ql_rank", F.col("__ql_first") + F.col("__ql_nth") - 1).select(*found.columns, "__ql_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "__ql_rank"))
            at = slots[np.searchsorted(keys, (length << 44) + rank, side="right") - 1] if len(rank) else np.zeros((0, 5), dtype=np.int64)
            columns = [c for c, name in zip(b.columns, b.schema.names, strict=True) if name != "__ql_rank"]
            names = [name for name in b.schema.names if name != "__ql_rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])], [*names, "sequence_id", "offset"])

    schema = found.schema.add("sequence_id", "long").add("offset", "long")
    return batches_of(ranked).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Tokenize, cut and pack whole documents: a row per piece, with its place."""
    return pack_pieces(pieces(docs, path, end_id, capacity), capacity)
