"""Conversation structure repair (operator 12) by a checkpointed dynamic program.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. The program runs over the machine of that pattern, whose four states are: nothing yet,
after system, after user, after assistant. A row can be kept (0), be given the role that the state asks for (2) or be deleted (3; blank rows and
duplicates must be); an empty turn can be inserted anywhere (2); a truncated row that stays costs 1 more.

Costs to the end are vectors of four numbers, computed from the last row back. Only those at every ``sqrt(n)``-th row are stored; walking forward, the vectors
of one block at a time are computed again from the checkpoint at its end, and the least letter among the edits that keep the cost is taken. Letters at a row and
state lead to one state each, so the letters taken one by one are the ASCII-least of the cheapest audits.

Rows never meet as whole conversations for this. They are sorted over all tasks, and a conversation is cut into pieces of at most ``PIECE``
rows, of which only a symbol a row goes into the program. A conversation of many pieces is solved piece by piece: the cost between all
states of each piece (min-plus matrices), a pass back over these for the costs at its end, the state after each piece for every state before it, and
a pass forward over those. Only ``digest`` gathers conversations, as it tells one hash of each.

Cases: null roles and texts are one space, and so is a null ``conv_id`` or ``turn`` in the text that decides the damage. Rows go by ``turn`` (nulls first), then role,
then text. Rows with a null ``conv_id`` are one conversation. Roles whose first letter is none of s, u, a can't be kept. Repeated rows are duplicates. Texts
are whole at any length. A conversation of which damage leaves nothing has no edits. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import saved

#: A piece's rows at most, as a power of two.
PIECE_BITS = 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: State after a role's initial, by state: nothing yet, after system, after user, after assistant.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that can be inserted or given, by state.
NEXT = ("u", "u", "a", "u")
FAR = 1 << 40
LEGAL = ("su", "ua", "au")


def _with_inserts(row: list[int]) -> tuple[int, ...]:
    """Costs by state if turns can be inserted before; two of them lead to every state that more lead to."""
    for _ in range(2):
        row = [min(row[q], INSERT + row[STEP[q][NEXT[q]]]) for q in range(4)]
    return tuple(row)


#: Costs after the last row: nothing or a closed pair needs no more.
AT_END = _with_inserts([0, FAR, FAR, 0])


def _choices(symbol: str, q: int, after: tuple[int, ...]) -> Iterator[tuple[int, str, int]]:
    """``cost to the end, letter, state`` of what consumes a row in state ``q``, by letter."""
    yield DELETE + after[q], "D", q
    if symbol != "d":
        more, own = TRUNCATED * symbol.isupper(), symbol.lower()
        if own in STEP[q]:
            yield KEEP + more + after[STEP[q][own]], "K", STEP[q][own]
        yield REROLE + more + after[STEP[q][NEXT[q]]], "R", STEP[q][NEXT[q]]


@lru_cache(maxsize=1 << 14)
def _before(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those after it, less their least, and that least."""
    row = _with_inserts([min(c for c, _, _ in _choices(symbol, q, after)) for q in range(4)])
    low = min(row)
    return tuple(min(x - low, FAR) for x in row), low


@lru_cache(maxsize=1 << 14)
def _edits(symbol: str, after: tuple[int, ...], q: int) -> tuple[str, int, int]:
    """Edits up to and with a row, two letters each (the second one is the role of R and I), the state then, and their cost."""
    row, low = _before(symbol, after)
    code, spent = "", 0
    while True:
        best = {letter: to for cost, letter, to in _choices(symbol, q, after) if cost == row[q] + low}
        if "D" not in best and INSERT + row[STEP[q][NEXT[q]]] == row[q]:
            code, spent, q = code + "I" + NEXT[q], spent + INSERT, STEP[q][NEXT[q]]
            continue
        letter = min(best)
        more = TRUNCATED * symbol.isupper() * (letter != "D")
        return code + letter + (NEXT[q] if letter == "R" else "-"), best[letter], spent + more + {"D": DELETE, "K": KEEP, "R": REROLE}[letter]


def costs_before(symbols: str, after: tuple[int, ...], keep: int | None = None) -> tuple[list[tuple[int, ...]], int]:
    """Costs before the first of ``symbols``, less a number, and that number; ``keep``: the stored vectors, those after every ``keep``-th row."""
    stored, total, n = [], 0, len(symbols)
    for i in range(n - 1, -1, -1):
        if keep and ((i + 1) % keep == 0 or i == n - 1):
            stored.append(after)
        after, low = _before(symbols[i], after)
        total += low
    return (stored[::-1] if keep else [after]), total


def solve(symbols: str, q: int = 0, after: tuple[int, ...] = AT_END) -> tuple[list[str], int, int]:
    """Edits of each row, state after the last one, and cost; vectors are kept at checkpoints, and of one block at a time."""
    size = max(1, math.isqrt(len(symbols)))
    stored, _ = costs_before(symbols, after, size)
    codes, spent = [], 0
    for k, end in enumerate(stored):
        block = symbols[k * size : (k + 1) * size]
        inner = [end]
        for symbol in block[:0:-1]:
            inner.append(_before(symbol, inner[-1])[0])
        for symbol, then in zip(block, reversed(inner), strict=True):
            code, q, cost = _edits(symbol, then, q)
            codes.append(code)
            spent += cost
    return codes, q, spent


def closing(q: int) -> str:
    """Inserts after the last row."""
    code = ""
    while q in (1, 2):
        code, q = code + "I" + NEXT[q], STEP[q][NEXT[q]]
    return code


def matrix(symbols: str) -> list[int]:
    """Least cost from each state before the rows to each state after them, row by row."""
    columns = []
    for to in range(4):
        (v,), low = costs_before(symbols, tuple(0 if q == to else FAR for q in range(4)))
        columns.append([min(x + low, FAR) for x in v])
    return [columns[to][q] for q in range(4) for to in range(4)]


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by a digest of conversation and turn."""
    space = F.lit(" ")
    fault = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, at``: ``at`` follows the order of conversations and their rows over all tasks; ``conv`` is the id as text, empty for null."""
    keys = ["conv_id", "turn", "role", "text"]
    rows = rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return saved(rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn", "role", "text", F.monotonically_increasing_id().alias("at")))


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv, at, turn, fault, initial``: each row's first fault, and its role's initial (x for any other than s, u, a)."""
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    sha = F.unhex(F.sha2(F.encode(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), "UTF-8"), 256))
    initial = F.substring("role", 1, 1)
    own = rows.select("conv", "turn", "at", sha.alias("sha"), last.alias("last"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"))
    first = own.groupBy("conv", "sha").agg(F.min("at").alias("first"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return own.join(first, ["conv", "sha"]).select("conv", "at", "turn", fault.alias("fault"), "initial")


def pieces(faults: DataFrame, bits: int = PIECE_BITS) -> DataFrame:
    """``conv, start, symbols, initials``: rows of a conversation that follow each other, bounded in number; ``start`` is the first one's ``at``."""
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    listed = faults.groupBy("conv", F.shiftright("at", bits).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("at", symbol.alias("symbol"), "initial"))).alias("rows"))
    return listed.select("conv", F.get("rows", F.lit(0))["at"].alias("start"), F.array_join("rows.symbol", "").alias("symbols"), F.array_join("rows.initial", "").alias("initials"))


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for own in batches:
        yield own[["conv", "start", "initials"]].assign(matrix=[matrix(s) for s in own["symbols"]])


def _back(own: pd.DataFrame) -> pd.DataFrame:
    """Costs at the end of each piece of a conversation, from the matrices, and the initial before it."""
    own = own.sort_values("start", ignore_index=True)
    after, ends = AT_END, []
    for m in reversed(own["matrix"].tolist()):
        ends.append(list(after))
        after = tuple(min(int(m[4 * q + to]) + after[to] for to in range(4)) for q in range(4))
    before = ["", *(s[-1] for s in own["initials"])][: len(own)]
    return own[["start"]].assign(after=ends[::-1], before=before, closes=own.index == len(own) - 1)


def _maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for own in batches:
        yield own[["conv", "start"]].assign(to=[[solve(s, q, tuple(map(int, after)))[1] for q in range(4)] for s, after in zip(own["symbols"], own["after"], strict=True)])


def _forward(own: pd.DataFrame) -> pd.DataFrame:
    """The state before each piece, from the state that each one leads to."""
    own = own.sort_values("start", ignore_index=True)
    q, states = 0, []
    for to in own["to"].tolist():
        states.append(q)
        q = int(to[q])
    return own[["start"]].assign(state=states)


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for own in batches:
        out = []
        for symbols, initials, after, state, before, closes in zip(own["symbols"], own["initials"], own["after"], own["state"], own["before"], own["closes"], strict=True):
            codes, q, cost = solve(symbols, int(state), tuple(map(int, after)))
            if closes and (end := closing(q)):
                codes[-1] += end
                cost += INSERT * len(end) // 2
            line = before + initials
            out.append((codes, cost, sum(a + b not in LEGAL for a, b in zip(line, line[1:], strict=False))))
        yield own[["conv", "start"]].assign(codes=[x[0] for x in out], cost=[x[1] for x in out], illegal=[x[2] for x in out])


def solve_pieces(cut: DataFrame) -> DataFrame:
    """``conv, start, codes, cost, illegal``: the edits of the rows of each of ``pieces``, which are a stored table."""
    n = saved(cut.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1"))
    alone = cut.join(n, "conv", "left_anti").withColumns({"after": F.lit(list(AT_END)).cast("array<bigint>"), "state": F.lit(0).cast("long"), "before": F.lit(""), "closes": F.lit(True)})
    columns = ["conv", "start", "symbols", "initials", "after", "state", "before", "closes"]
    rows = alone.select(*columns)
    if not n.isEmpty():
        many = cut.join(n, "conv", "left_semi")
        costs = many.mapInPandas(_matrices, "conv string, start long, initials string, matrix array<bigint>").groupBy("conv").applyInPandas(_back, "start long, after array<bigint>, before string, closes boolean")
        many = saved(many.join(costs, "start"))
        states = many.mapInPandas(_maps, "conv string, start long, to array<bigint>").groupBy("conv").applyInPandas(_forward, "start long, state long")
        rows = rows.unionByName(many.join(states, "start").select(*columns))
    return rows.mapInPandas(_solved, "conv string, start long, codes array<string>, cost long, illegal long")


def repair(rows: DataFrame, bits: int = PIECE_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three stored tables of ``rows (conv_id, turn, role, text)``: the rows in order with their ``fault``, the ``edits`` of each, and
    the repaired ``lines`` it leaves; and each piece's cost and illegal neighbours."""
    ordered = in_order(rows)
    faults = saved(with_faults(ordered))
    solved = saved(solve_pieces(saved(pieces(faults, bits))))
    codes = solved.select("start", F.posexplode("codes").alias("k", "code")).select((F.col("start") + F.col("k")).alias("at"), F.regexp_extract_all("code", F.lit("(..)"), F.lit(1)).alias("code"))
    role = lambda x: F.when(F.endswith(x, F.lit("u")), "user").otherwise("assistant")
    line = lambda x: (
        F.when(F.startswith(x, F.lit("I")), F.concat(role(x), F.lit(":"))).when(F.startswith(x, F.lit("R")), F.concat(role(x), F.lit(":"), "text")).otherwise(F.concat("role", F.lit(":"), "text"))
    )
    lines = F.transform(F.filter("code", lambda x: ~F.startswith(x, F.lit("D"))), line)
    edits = F.array_join(F.transform("code", lambda x: F.substring(x, 1, 1)), "")
    edited = ordered.join(codes, "at").select("conv", "at", "turn", "role", "text", edits.alias("edits"), lines.alias("lines"))
    return edited, faults, solved


def digest(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows`` before damage: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    edited, faults, solved = repair(damage(rows))
    turns = faults.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.count("*").alias("n")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    counts = faults.groupBy("conv").agg(*(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")))
    costs = solved.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    listed = F.sort_array(F.collect_list(F.struct("at", "edits", "lines")))
    texts = edited.groupBy("conv").agg(listed.alias("rows")).select(
        "conv", F.array_join("rows.edits", "").alias("audit"), F.sha2(F.encode(F.array_join(F.flatten("rows.lines"), "\n"), "UTF-8"), 256).alias("repaired_sha256")
    )
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    found = ids.join(turns, "conv", "left").join(counts, "conv", "left").join(costs, "conv", "left").join(texts, "conv", "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
