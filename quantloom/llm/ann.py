"""Approximate nearest neighbours by learned partitions (operator 10).

A bounded sample of the vectors gives a neighbour graph. The graph is divided into parts of balanced size with few
edges cut, and a small classifier learns the part of a vector from the vector alone. Every vector is indexed
in its most probable part; a query goes to its most probable parts until a share of its probability is covered, the mass,
and the vectors there are ranked by their exact inner product in double precision.

The number of parts follows the number of vectors (one for each ``per_part``) up to ``max_parts``. The mass is not guessed: a part of the sample
that the classifier has not seen asks for its neighbours in that same part, and the mass is the least one by which ``recall``
of these are found. Vectors with structure thus need few parts, and vectors without need most of them.

Copies of one vector can be very many. They are told apart only by ``vec_id``, so of equal vectors the ``k + 1`` smallest
``vec_id`` can be answers and no others: these are kept per distinct vector, which bounds what a hot vector costs, and
distinct vectors are what parts hold. Vectors and queries of a part are packed into blocks of bounded size, and a block of queries meets a
block of vectors in one row of a join, so no task gathers a whole part on either side.

Cases: null or zero vectors and those that hold null or non-finite components take no part, nor do vectors of another
length than the most common one, nor rows with a null ``vec_id``. Rows that repeat a ``vec_id`` are candidates like any other; a query is asked
once per ``vec_id``, with the smallest of its vectors. Fewer vectors than two parts need are one part. Scores are sums of
products in the order of components, whatever block they are in; where one overflows it is what double arithmetic gives, and
one that is not a number ranks last, as minus infinity. Ties go to the smaller ``vec_id``. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import batches_of, saved

#: Vectors and queries of a block, about.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512


@dataclass(frozen=True)
class Router:
    """A two-layer classifier from vectors to parts, and the share of a query's probability that its parts have to cover."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        z = np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Indices of the ``degree`` nearest other sample vectors of each, by inner product, in blocks."""
    out = np.empty((len(x), degree), dtype=np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 12, slack: float = 1.1) -> np.ndarray:
    """Divide the graph's nodes into ``parts`` of at most ``slack`` times the mean size, with few edges between them.

    Starts from nearest seeds and then moves nodes, in sweeps, to the part in which most of their neighbours
    are, as long as that part has room.
    """
    n, room = len(x), int(np.ceil(slack * len(x) / parts))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    seeds = unit[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, dtype=np.int64)
    for _ in range(8):
        near = unit @ seeds.T
        size = np.zeros(parts, dtype=np.int64)
        for i in np.argsort(-near.max(axis=1), kind="stable"):
            for p in np.argsort(-near[i], kind="stable"):
                if size[p] < room:
                    part[i] = p
                    size[p] += 1
                    break
        sums = np.zeros_like(seeds)
        np.add.at(sums, part, unit)
        seeds = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    around = [np.concatenate([graph[i], np.array(back[i], dtype=np.int64)]) for i in range(n)]
    size = np.bincount(part, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[around[i]], minlength=parts).astype(float)
            votes[(size >= room) & (np.arange(parts) != part[i])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[i]]:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def fit_router(x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, epochs: int = 40, rate: float = 3e-3) -> Router:
    """Train the classifier with cross-entropy, by Adam on small batches."""
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).astype(np.float32)
    shapes = [(unit.shape[1], hidden), (hidden,), (hidden, parts), (parts,)]
    w = [rng.normal(0, np.sqrt(2 / s[0]), s).astype(np.float32) if len(s) == 2 else np.zeros(s, np.float32) for s in shapes]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(unit))
        for at in range(0, len(order), 256):
            own = order[at : at + 256]
            a, y = unit[own], part[own]
            h = np.maximum(a @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            g = np.exp(z - z.max(axis=1, keepdims=True))
            g /= g.sum(axis=1, keepdims=True)
            g[np.arange(len(y)), y] -= 1
            g /= len(y)
            back = (g @ w[2].T) * (h > 0)
            t += 1
            for k, d in enumerate((a.T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(*(a.astype(np.float64) for a in w))


def covering_mass(router: Router, x: np.ndarray, recall: float, near: int = 20) -> float:
    """The least mass by which ``recall`` of the ``near`` nearest neighbours of ``x`` among themselves are found."""
    p = router.probabilities(x)
    part, order = p.argmax(axis=1), np.argsort(-p, axis=1, kind="stable")
    ranked = np.take_along_axis(p, order, axis=1)
    before = np.empty_like(p)
    np.put_along_axis(before, order, np.cumsum(ranked, axis=1) - ranked, axis=1)
    wanted = neighbour_graph(x, min(near, len(x) - 1))
    return float(np.nextafter(np.quantile(np.take_along_axis(before, part[wanted], axis=1), recall), 2.0))


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v array<double>`` of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.filter("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def fit(distinct: DataFrame, n: int, max_sample: int = 8192, per_part: int = 96, max_parts: int = 256, degree: int = 10, recall: float = 0.95, seed: int = 7) -> Router | None:
    """Learn parts from at most ``max_sample`` of the ``n`` distinct vectors, chosen by a hash. None where one part does.

    A quarter of the sample is kept from the classifier and sets the mass.
    """
    taken = distinct.orderBy(F.xxhash64("v"), "v").select("v").limit(max_sample).collect()
    x = np.array([r["v"] for r in taken])
    parts = min(max_parts, n // per_part, len(x) // 24)
    if parts < 2:
        return None
    rng, unseen = np.random.default_rng(seed), np.arange(len(x)) % 4 == 3
    own = x[~unseen]
    part = balanced_parts(own, neighbour_graph(own, degree), parts, rng)
    router = fit_router(own, part, parts, rng)
    return replace(router, mass=covering_mass(router, x[unseen], recall))


def _routed(rows: DataFrame, router: Router | None, sizes: dict[int, int] | None = None, least: int = 0) -> DataFrame:
    """``rows`` with ``part``: the most probable one. With the ``sizes`` of parts, as many rows as parts to search: those that cover the
    mass, and more if these hold fewer than ``least`` vectors."""
    fields = rows.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if router is None:
                at, part = np.arange(n), np.zeros(n, dtype=np.int64)
            else:
                p = router.probabilities(_matrix(b.column(b.schema.get_field_index("v"))))
                if sizes is not None:
                    order = np.argsort(-p, axis=1, kind="stable")
                    ranked, held = np.take_along_axis(p, order, axis=1), np.array([sizes.get(x, 0) for x in range(p.shape[1])])[order]
                    at, k = np.nonzero((np.cumsum(ranked, axis=1) - ranked < router.mass) | (np.cumsum(held, axis=1) - held < least))
                    part = order[at, k]
                else:
                    at, part = np.arange(n), p.argmax(axis=1)
            taken = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part, pa.int64())], [*fields, "part"])

    schema = type(rows.schema)(list(rows.schema.fields)).add("part", "long")
    return batches_of(rows).mapInArrow(run, schema)


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``q`` and ``x``, added up in the order of components."""
    found = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            found += q[:, j] * x[:, j]
    return np.where(np.isnan(found), -np.inf, found)


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each of the ``sizes``, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, near``: the best ``k`` of a block's vectors for each query of the other block, for each row of ``pairs (asked, held)``.

    A matrix product finds whatever can be among them, up to its rounding, and scores in one fixed order decide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, held in zip(batch.column(0), batch.column(1), strict=True):
                own, rows = asked.values, held.values
                queries, wanted = own.field("query_id").to_numpy(), _matrix(own.field("v"))
                x, copies = _matrix(rows.field("v")), rows.field("ids")
                offsets = copies.offsets.to_numpy()
                every, sizes, offsets = copies.flatten().to_numpy(), np.diff(offsets), offsets[:-1] - offsets[0]
                with np.errstate(over="ignore", invalid="ignore"):
                    rough = wanted @ x.T
                    slack = 1e-12 * np.abs(x).max(axis=1).sum() / len(x) * np.abs(wanted).sum(axis=1) + 1e-300
                rough = np.where(np.isnan(rough), np.inf, rough)
                near = min(k + 1, len(x))
                least = np.partition(rough, len(x) - near, axis=1)[:, len(x) - near] - slack
                qi, xi = np.nonzero(~(rough < least[:, None]))
                score = scores(wanted[qi], x[xi])
                times = sizes[xi]
                qi, score, id_at = np.repeat(qi, times), np.repeat(score, times), np.repeat(offsets[xi], times) + _counting(times)
                ids = every[id_at]
                other = ids != queries[qi]
                qi, score, ids = qi[other], score[other], ids[other]
                order = np.lexsort((ids, -score, qi))
                order = order[_counting(np.bincount(qi, minlength=len(queries))) < k]
                yield pa.RecordBatch.from_arrays([pa.array(queries[qi[order]]), pa.array(ids[order]), pa.array(score[order])], ["query_id", "vec_id", "near"])

    return batches_of(pairs).mapInArrow(run, "query_id long, vec_id long, near double")


def _sizes(rows: DataFrame) -> dict[int, int]:
    """Rows of every part: one number for each."""
    return {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}


def _blocks(rows: DataFrame, sizes: dict[int, int], size: int, content: list[str], name: str, key: str) -> DataFrame:
    """``part, name``: the rows of every part in arrays of about ``size``."""
    several = {p: -(-n // size) for p, n in sizes.items() if n > size}
    n = F.lit(1).cast("long")
    if several:
        n = F.coalesce(F.map_from_entries(F.array(*(F.struct(F.lit(p).cast("long"), F.lit(k).cast("long")) for p, k in several.items())))[F.col("part")], n)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(key), n))
    return dealt.groupBy("part", "block").agg(F.collect_list(F.struct(*content)).alias(name)).drop("block")


def search(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, router: Router | None | str = "fit", **fitting) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that the SQL condition ``queries`` picks, the ``k`` nearest others found.

    ``fitting`` are parameters of ``fit``.
    """
    rows = saved(usable(vectors))
    # of equal vectors only the k + 1 smallest ids can be answers: take them within slices of the copies first
    copy = Window.partitionBy("v", "slice").orderBy("vec_id")
    few = rows.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("nth", F.row_number().over(copy)).filter(F.col("nth") <= k + 1)
    distinct = saved(few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids")))
    if router == "fit":
        router = fit(distinct, distinct.count(), **fitting)
    indexed = saved(_routed(distinct, router))
    sizes = _sizes(indexed)
    held = _blocks(indexed, sizes, BLOCK_ROWS, ["v", "ids"], "held", "v")
    asked = rows.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumnRenamed("vec_id", "query_id")
    asked = saved(_routed(asked, router, sizes, k + 1))
    asked = _blocks(asked, _sizes(asked), BLOCK_QUERIES, ["query_id", "v"], "asked", "query_id")
    found = _nearest(asked.join(held, "part").select("asked", "held"), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return first.select("query_id", "rank", "vec_id", F.col("near").alias("score"))
