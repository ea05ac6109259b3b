"""Exact dedup, the conversation trie and conversation repair against brute force, in small tables and shards that force every branch."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from quantloom.llm import conversation_repair, conversation_trie, exact_dedup, queries

SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_conversation_repair", "op13_exact_dedup"])
def test_registered_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = queries.QUERIES[name](spark, data)
    theirs = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(found.columns)
    key = lambda row: [(x is None, str(x)) for x in row]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key) == sorted(theirs.fetchall(), key=key)


# --- 13: exact dedup

LONG = "word " * 30_000
COPIES = (
    [(k, "the same  text\n") for k in range(40)] + [(100, "the same text "), (101, "the same\ttext\r\n"), (102, "the same text"), (103, None), (104, ""), (105, " "), (106, "\n\t "), (107, LONG), (108, LONG + "x"), (109, LONG)]
    + [(None, "no id"), (None, "no id"), (None, "the same text "), (110, "twice"), (110, "twice"), (-5, "twice"), (111, "Ünïcode 日本\x85 é"), (112, "Ünïcode 日本\x85 é"), (113, "Ünïcode 日本\x85\xa0é")]
    + [(200 + k, f"text number {k % 30}") for k in range(90)]
)


def groups_by_hand(rows):
    texts = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, texts, strict=True):
        groups[t].append(i)
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[t]), SHA(t)))
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("table_bytes", [64 << 20, 400, 40])
def test_exact_duplicates_at_every_level(spark, table_bytes):
    rows = spark.createDataFrame([(i, t, 1, 2, "b", "x") for i, t in COPIES], "doc_id long, text string, keep_id int, id int, bucket string, sha string").repartition(5)
    found = exact_dedup.exact_duplicates(rows, table_bytes).collect()
    wanted, n = groups_by_hand(COPIES)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=str) == wanted
    kept = [r for r in found if r["kept"]]
    assert len(kept) == n and all(r["doc_id"] == r["keep_id"] for r in kept)
    whole = exact_dedup.keep_first(rows, table_bytes)
    assert whole.columns == rows.columns and whole.count() == n
    assert sorted(str(r["doc_id"]) for r in whole.collect()) == sorted(str(r["doc_id"]) for r in kept)


def test_copies_beyond_the_last_level(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_LEVELS", 1)
    found = exact_dedup.exact_duplicates(spark.createDataFrame(COPIES, "doc_id long, text string").repartition(4), 40)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found.collect()), key=str) == groups_by_hand(COPIES)[0]


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.keep_first(none).count() == 0


def test_tables_compare_contents_not_hashes():
    table = exact_dedup.ContentTable(2)
    assert [table.put(7, x, k) for k, x in enumerate([b"a", b"b", b"a", b"", b"b", b""])] == [0, 1, 0, 3, 1, 3]
    assert [table.put(h, b"%d" % h, h) for h in (*range(500), *range(500))] == [*range(500), *range(500)]


# --- 11: the trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    whole = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - c % 20, [])[:h] + x[h:])
    members = defaultdict(list)
    for c, x in whole.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall("[^ \t-\r]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in who if len(whole[c]) == len(p))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids[p], sum(not kids[q] for q in below), saved, SHA(ends)))
    return sorted(out, key=str)


def talk(seed, n=120, roles=("user", "assistant", None), texts=("a", "a b", "c  d e", None, "", "é\n日本 x")):
    r = random.Random(seed)
    return [(c, r.choice([None, k, k]), r.choice(roles), r.choice(texts[: 1 + seed % 6])) for c in range(0, 3 * n, r.choice([1, 3])) for k in range(r.choice([1, 2, 3, 5]))]


@pytest.mark.parametrize(("seed", "shard_turns"), [(1, 20_000), (2, 40), (5, 40), (4, 12)])
def test_trie_in_shards_of_any_size(spark, seed, shard_turns):
    rows = [*talk(seed), (None, 0, "user", "nobody's"), (900, 0, "user", "a " * 20_000), (901, 0, "user", "a " * 20_000), *[(920 + c, k, "user", "b") for c in range(60) for k in range(c % 9)]]
    df = spark.createDataFrame([(*x, 1, "i") for x in rows], "conv_id long, turn long, role string, text string, words int, ids string").repartition(4)
    found = conversation_trie.prefix_trie(conversation_trie.rebuilt(conversation_trie.in_order(df)), shard_turns)
    assert sorted((tuple(r) for r in found.collect()), key=str) == trie_by_hand(rows)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_one_long_conversation_and_none(spark):
    rows = [(c, k, "user", str(k)) for c in (7, 8) for k in range(3000 + c)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversation_trie.prefix_trie(conversation_trie.rebuilt(conversation_trie.in_order(df)), 50)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in (7, 8)}
    lengths = [3000 + c - h[c] for c in (7, 8)]  # their first turns are told to be those of conversation 0, which isn't there
    assert found.count() == 1 + (max(lengths) if h[7] == h[8] else sum(lengths))
    assert found.filter("depth = 0").first()["n_convs"] == 2
    none = conversation_trie.prefix_trie(conversation_trie.rebuilt(conversation_trie.in_order(df.filter("false"))))
    assert none.count() == 0


# --- 12: repair

PATTERN = re.compile("(s?(ua)+)?")


def repairs_by_hand(symbols):
    """Cost and least audit of all edits with up to five inserts, by trying roles of every row and places of inserts."""
    best = None
    options = []
    for x in symbols:
        own = [("D", "", 3)]
        if x != "d":
            more = x.isupper()
            own += [("K", x.lower(), more)] * (x.lower() in "sua") + [("R", "u", 2 + more), ("R", "a", 2 + more)]
        options.append(own)
    for choice in product(*options):
        # inserts go where the machine needs them; all places are tried
        stack = [("", "", sum(c[2] for c in choice), 0)]
        while stack:
            audit, roles, cost, k = stack.pop()
            if best and cost > best[0]:
                continue
            if k == len(choice):
                if PATTERN.fullmatch(roles):
                    best = min(best or (cost, audit), (cost, audit))
            else:
                stack.append((audit + choice[k][0], roles + choice[k][1], cost, k + 1))
            if audit.count("I") < 5 and len(roles) < 2 * len(choice) + 4:
                stack += [(audit + "I", roles + role, cost + 2, k) for role in "ua" if not (roles and roles[-1] == role) and not (role == "a" and roles[-1:] != "u")]
    return best


@pytest.mark.parametrize("seed", range(8))
def test_least_cost_and_least_audit(seed):
    r = random.Random(seed)
    for _ in range(12):
        symbols = "".join(r.choice("suaxdSUA") for _ in range(r.randint(0, 4)))
        codes, q, cost = conversation_repair.solve(symbols)
        end = conversation_repair.closing(q)
        audit = "".join(c[::2] for c in codes) + end[::2]
        assert (cost + len(end), audit) == repairs_by_hand(symbols), symbols


def test_pieces_join_to_the_whole():
    r = random.Random(3)
    for _ in range(40):
        symbols = "".join(r.choice("suuaaxdUA") for _ in range(r.randint(2, 60)))
        parts, at = [], 0
        while at < len(symbols):
            n = r.randint(1, 9)
            parts.append(symbols[at : at + n])
            at += n
        after, ends = conversation_repair.AT_END, []
        for p in reversed(parts):
            ends.append(after)
            m = conversation_repair.matrix(p)
            after = tuple(min(m[4 * q + to] + after[to] for to in range(4)) for q in range(4))
        codes, q, cost = [], 0, 0
        for p, end in zip(parts, reversed(ends), strict=True):
            own, q, spent = conversation_repair.solve(p, q, end)
            codes, cost = codes + own, cost + spent
        assert (codes, q, cost) == conversation_repair.solve(symbols)


def digest_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c]
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
            own[c] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = []
    for c, found in own.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        counts, seen, symbols = defaultdict(int), set(), ""
        for _, role, text in found:
            words = re.findall("[^ \t-\r]", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            first = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "d" if fault in ("blank", "duplicate") else first.upper() if fault else first
        turns = {x[0] for x in found} - {None}
        codes, q, cost = conversation_repair.solve(symbols)
        end = conversation_repair.closing(q)
        lines = []
        for (_, role, text), code in zip(found, codes, strict=True):
            for letter, to in zip(code[::2], code[1::2], strict=True):
                name = {"u": "user", "a": "assistant"}.get(to, role)
                lines += [] if letter == "D" else [f"{name}:" + ("" if letter == "I" else text)]
        lines += [{"u": "user:", "a": "assistant:"}[x] for x in end[1::2]]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:], strict=False)]
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost + len(end), "".join(x[::2] for x in codes) + end[::2], SHA("\n".join(lines))))
    return sorted(out, key=str)


def faulty(seed):
    r = random.Random(seed)
    texts = ["One. ", "Two", "Three!\n", "", " \t", None, "é 日本?", "One. ", "long " * 5000 + "."]
    rows = [(c, r.choice([None, k, k, k + 2]), r.choice(["user", "assistant", "assistant", "system", "tool", None, "ünknown"]), r.choice(texts)) for c in [*range(60), None, 2**60 + 1] for k in range(r.choice([1, 2, 4, 8]))]
    return rows + [(500, k, "user" if k % 2 else "assistant", f"turn {k % 70}.") for k in range(400)] + rows[:5]


@pytest.mark.parametrize("bits", [2, 12])
def test_repaired_conversations(spark, monkeypatch, bits):
    rows = faulty(bits)
    df = spark.createDataFrame([(*x, "c", 0) for x in rows], "conv_id long, turn long, role string, text string, conv string, at int").repartition(3)
    whole = conversation_repair.repair
    monkeypatch.setattr(conversation_repair, "repair", lambda x: whole(x, bits))
    assert sorted((tuple(r) for r in conversation_repair.digest(df).collect()), key=str) == digest_by_hand(rows)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.digest(none).count() == 0
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x")], none.schema)
    assert [tuple(r) for r in conversation_repair.digest(df).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", SHA(""))]
    assert conversation_repair.damage(df).select(F.count("*")).first()[0] == 0
