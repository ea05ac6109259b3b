"""Conversation prefix trie (operator 11): ternary search trees per range shard, merged along their boundaries.

1. The distinct turns ``(role, text)`` are a dictionary whose ids follow the order of role and text. A conversation is a list of ids.
2. Equal conversations are one path with their number, their smallest id and the digest of their ids. Paths are sorted and dealt by
   ranges, so also the conversations of a very common first turn are spread. A task cuts its sorted paths into shards of bounded size.
3. A shard is a ternary search tree, balanced as its paths are inserted from the median on. Its trie nodes are visited children
   first without recursion; members, least member, children, leaves and savings go from a node to the one above it.
4. Only nodes on a shard's first and last path can be in another shard too. They are not told yet: the two paths go on, as records with what
   complete subtrees have brought to each of their nodes. These records are far fewer, and are sharded like paths, until they fit one tree.
5. A node's row names its parent's least member. Where the parent was complete later, a join by a digest of the prefix (blake2, 128 bits) finds it.

Cases: a null role or text is empty. Turns go by ``turn`` (nulls first), then role, then text; repeated rows are turns of their own. Rows without
``conv_id`` belong to no conversation and are left out. Texts of any length are compared whole, by SHA-256. A conversation is one list of
numbers, whatever its length. An empty table gives an empty result, without a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from quantloom.llm.common import saved

#: Nodes of a shard at most, if its paths are ``LEAST_PATHS`` or more.
SHARD_TURNS = 20_000
LEAST_PATHS = 16

_PATH = ("ids", "words", "n", "least", "kids", "leaves", "saved")
_ROW = ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_SCHEMA = StructType(
    [StructField(c, LongType()) for c in _ROW] + [StructField("ends_sha256", StringType()), StructField("own", BinaryType()), StructField("above", BinaryType())]
    + [StructField(c, ArrayType(LongType())) for c in _PATH] + [StructField("ends", ArrayType(StringType()))]
)
_ARROW = pa.schema(
    [(c, pa.int64()) for c in _ROW] + [("ends_sha256", pa.string()), ("own", pa.binary()), ("above", pa.binary())] + [(c, pa.list_(pa.int64())) for c in _PATH] + [("ends", pa.list_(pa.string()))]
)
_NO_ENDS = hashlib.sha256(b"").hexdigest()


class Tree:
    """A ternary search tree of paths; its trie nodes are numbered as they are made, parents before children."""

    def __init__(self) -> None:
        self.key, self.low, self.high, self.eq, self.up, self.depth, self.word = [0], [-1], [-1], [-1], [-1], [0], [0]
        self.n, self.least, self.kids, self.leaves, self.saved, self.ends = [0], [None], [0], [0], [0], [None]

    def _node(self, key: int, up: int, word: int) -> int:
        self.key.append(key)
        self.up.append(up)
        self.word.append(word)
        self.depth.append(self.depth[up] + 1)
        for x in (self.low, self.high, self.eq):
            x.append(-1)
        for x in (self.n, self.kids, self.leaves, self.saved):
            x.append(0)
        self.least.append(None)
        self.ends.append(None)
        return len(self.key) - 1

    def child(self, v: int, key: int, word: int) -> int:
        """The child of ``v`` by ``key``, made if it isn't there."""
        t = self.eq[v]
        if t < 0:
            self.eq[v] = t = self._node(key, v, word)
            return t
        while key != self.key[t]:
            side = self.low if key < self.key[t] else self.high
            if side[t] < 0:
                side[t] = new = self._node(key, v, word)
                return new
            t = side[t]
        return t

    def insert(self, path: dict) -> None:
        v = 0
        for d, brought in enumerate(path["least"]):
            if d:
                v = self.child(v, path["ids"][d - 1], path["words"][d - 1])
            if brought is not None:
                self.n[v] += path["n"][d]
                self.least[v] = brought if self.least[v] is None else min(self.least[v], brought)
                self.kids[v] += path["kids"][d]
                self.leaves[v] += path["leaves"][d]
                self.saved[v] += path["saved"][d]
                self.ends[v] = path["ends"][d] or self.ends[v]

    def along(self, path: dict) -> list[int]:
        out = [0]
        for key, word in zip(path["ids"], path["words"], strict=True):
            out.append(self.child(out[-1], key, word))
        return out


def build(paths: list[dict]) -> Tree:
    """The tree of sorted paths, inserted from the median on."""
    tree, todo = Tree(), [(0, len(paths))]
    while todo:
        a, b = todo.pop()
        if a < b:
            middle = (a + b) // 2
            tree.insert(paths[middle])
            todo += [(a, middle), (middle + 1, b)]
    return tree


def _shard(paths: list[dict], whole: bool, first_level: bool) -> Iterator[dict]:
    """Rows of the complete nodes of a shard, and its boundary paths unless it is the ``whole``."""
    t = build(paths)
    edges = [] if whole else [t.along(paths[0]), t.along(paths[-1])]
    edge = {v for e in edges for v in e}
    for v in range(len(t.key) - 1, -1, -1):  # children have larger numbers than their parents
        if v in edge:
            continue
        if not t.kids[v]:
            t.leaves[v] = 1
        t.saved[v] += (t.n[v] - 1) * t.word[v]
        if v:
            p = t.up[v]
            t.n[p] += t.n[v]
            t.least[p] = t.least[v] if t.least[p] is None else min(t.least[p], t.least[v])
            t.kids[p] += 1
            t.leaves[p] += t.leaves[v]
            t.saved[p] += t.saved[v]

    names = {0: b""}

    def name(v: int) -> bytes:
        todo = []
        while v not in names:
            todo.append(v)
            v = t.up[v]
        for v in reversed(todo):
            names[v] = hashlib.blake2b(names[t.up[v]] + t.key[v].to_bytes(8, "big", signed=True), digest_size=16).digest()
        return names[v]

    for v in range(len(t.key)):
        if v not in edge:
            late = v > 0 and t.up[v] in edge
            yield {
                "depth": t.depth[v], "conv_id": t.least[v], "parent_conv_id": None if late or not v else t.least[t.up[v]], "n_convs": t.n[v], "n_children": t.kids[v], "n_leaves": t.leaves[v],
                "saved_tokens": t.saved[v], "ends_sha256": t.ends[v] or _NO_ENDS, "own": None if first_level else name(v), "above": name(t.up[v]) if late else None,
            }
    told: set[int] = set()
    for e, path in zip(edges, (paths[0], paths[-1]), strict=False):
        if not told.issuperset(e):
            new = [v not in told for v in e]
            yield {"ids": path["ids"], "words": path["words"], "least": [t.least[v] if x else None for v, x in zip(e, new, strict=True)], "ends": [t.ends[v] if x else None for v, x in zip(e, new, strict=True)]} | {
                c: [values[v] if x else 0 for v, x in zip(e, new, strict=True)] for c, values in (("n", t.n), ("kids", t.kids), ("leaves", t.leaves), ("saved", t.saved))
            }
            told.update(e)


def _shards(batches: Iterator[pa.RecordBatch], whole: bool, first_level: bool, shard_turns: int) -> Iterator[pa.RecordBatch]:
    """Sorted paths in shards of bounded size, each one's rows in batches."""
    paths: list[dict] = []
    turns = 0

    def rows() -> Iterator[pa.RecordBatch]:
        out = []
        for r in _shard(paths, whole, first_level):
            out.append(r)
            if len(out) == 4096:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    for batch in batches:
        for path in batch.to_pylist():
            paths.append(path)
            turns += 1 + len(path["ids"])
            if not whole and turns >= shard_turns and len(paths) >= LEAST_PATHS:
                yield from rows()
                paths, turns = [], 0
    if paths:
        yield from rows()


def in_order(rows: DataFrame) -> DataFrame:
    """``conv_id, ids, words``: each conversation's turns as ids of the dictionary and their numbers of words."""
    rows = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.encode(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256)))
    turns = rows.select("sha", "role", "text").distinct().repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    dictionary = saved(turns.select("sha", F.monotonically_increasing_id().alias("id"), words.alias("words")))
    turn = F.struct("turn", "id", "words")
    listed = rows.select("conv_id", "turn", "sha").join(dictionary, "sha").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return listed.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation with its first ``h`` turns replaced by those of the one whose id is the next multiple of ``every`` below;
    ``h`` is a digest of the id, below ``heads``."""
    known = conversations.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), *(F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in ("ids", "words")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = conversations.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(known, "base", "left")
    none = F.array().cast("array<bigint>")
    return both.select("conv_id", *(F.concat(F.slice(F.coalesce(f"head_{c}", none), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c), F.lit(1)))).alias(c) for c in ("ids", "words")))


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie of ``conversations (conv_id, ids, words)``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    ends = F.sha2(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").cast("binary"), 256)
    same = conversations.groupBy("ids", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), ends.alias("ends"))
    at_end = lambda c, rest: F.concat(F.array_repeat(rest, F.size("ids")), F.array(c))
    zero, none = F.lit(0).cast("long"), F.lit(None)
    paths = saved(same.select("ids", "words", at_end(F.col("n"), zero).alias("n"), at_end(F.col("least"), none.cast("long")).alias("least"), *(at_end(zero, zero).alias(c) for c in ("kids", "leaves", "saved")), at_end(F.col("ends"), none.cast("string")).alias("ends")))
    found, level = [], 0
    while True:
        turns, n = paths.agg(F.sum(F.size("ids") + 1), F.count("*")).first()
        whole = not n or turns <= shard_turns or n <= LEAST_PATHS
        dealt = paths.coalesce(1) if whole else paths.repartitionByRange(-(-turns // shard_turns), "ids")
        made = saved(dealt.sortWithinPartitions("ids").select(*_PATH, "ends").mapInArrow(partial(_shards, whole=whole, first_level=not level, shard_turns=shard_turns), _SCHEMA))
        found.append(made.filter("depth IS NOT NULL").select(*_ROW, "ends_sha256", "own", "above"))
        if whole:
            break
        paths, level = made.filter("depth IS NULL").select(*_PATH, "ends"), level + 1
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    if level:  # the parents of some nodes were complete later
        late = nodes.filter("own IS NOT NULL")
        root = F.broadcast(late.filter("depth = 0").select(F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("root_conv")))  # one row
        named = late.filter("depth > 0").select(F.col("own").alias("above"), F.col("conv_id").alias("late_conv"))
        under, rest = nodes.filter("above IS NOT NULL AND depth > 1"), nodes.filter("above IS NULL OR depth <= 1")
        under = under.join(named, "above").withColumn("parent_conv_id", F.col("late_conv")).select(*_ROW, "ends_sha256")
        rest = rest.join(root, "depth", "left").withColumn("parent_conv_id", F.when(F.col("above").isNotNull(), F.col("root_conv")).otherwise(F.col("parent_conv_id"))).select(*_ROW, "ends_sha256")
        nodes = rest.unionByName(under)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
