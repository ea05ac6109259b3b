"""Corpus operators against libraries, brute force and round trips, on small rows: nulls, empties, ties, repeats, clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.llm import ann, chat, common, fingerprints, line_dedup, packing, pii, queries, sentencepiece_fst, simhash, token_files, tokens, toxicity
from quantloom.llm.components import components

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly boxed up vintage jars of honey mead".split()


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Hard rows, with columns whose names operators use inside."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(1, base), (2, near), (3, base), (3, base), (4, None), (5, ""), (6, "one"), (7, prose(2, 4000)), (None, prose(3)), (None, None), (8, "Ünïcode é ﬁ 日本 🎉 \t x\r\ny"), (9, prose(4) + "\n" + prose(5) + "\n" + prose(4))]
    return spark.createDataFrame([(i, t, "l", "s", 1, 2, 3, "k", "r") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp long, h long, key string, root string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


# --- 1: token files


def test_parts_give_the_ids_of_whole_texts():
    own, library, r = tokens.PartEncoder(tokens.default_path(), 1, max_known=50), tokenizer(), random.Random(5)
    letters = [chr(c) for c in [*range(1, 0x180), 0x301, 0x3A3, 0x3C3, 0x130, 0x410, 0x4E00, 0x1F600, 0x200B, 0x2028]] + list("'sStdmlrve <|>\n\t") * 12 + ["<|endoftext|>", "'ll"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 12)))
        assert own.encode(text) == np.array([*library.encode(text, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1], list(range(0, 70000, 7))])
def test_codes_round_trip(values):
    assert token_files.unpack(*token_files.pack(np.array(values, dtype=np.uint32)), len(values)).tolist() == values


def test_token_files_read_back(spark, docs, none):
    library = tokenizer()
    for df in (docs, none):
        folder = token_files.scratch_folder(spark)
        token_files.write_token_files(df, folder, tokens.default_path())
        found = sorted(tuple(r) for r in token_files.read_token_files(spark, folder).select("start", "n_tokens", "ids_crc32", "doc_id").collect())
        start, wanted = 0, []
        for r in sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
            ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
            wanted.append((r["doc_id"], len(ids), crc(ids)))
            start += len(ids)
        assert sorted((d is not None, d, n, c) for _, n, c, d in found) == sorted((d is not None, d, n, c) for d, n, c in wanted)
        assert [x[0] for x in found] == [0, *np.cumsum([x[1] for x in found]).tolist()][: len(found)] and (not found or found[-1][0] + found[-1][1] == start)
        ids = [x[3] for x in found]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


# --- 2: fingerprints


def shingles(text, n=5):
    w = [x for x in re.split("[ \t\n\x0b\f\r]+", text.lower()) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints_estimate_and_follow(spark, docs, none):
    rows = fingerprints.compare_with_next(docs, 3)
    a, b = F.col("sketch"), F.col("edited_sketch")
    found = rows.withColumns({"near": fingerprints.resemblance(a, b), "within": fingerprints.containment(a, b), "size": fingerprints.distinct_shingles(a)}).collect()
    ordered = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    assert len(found) == len(ordered)
    known = {}
    for k, (i, t) in enumerate(ordered):
        following, half = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        known.setdefault(i, []).append((t, t[: len(t) - half] + following[:half]))
    for r in found:
        digests = {hashlib.sha256(e.encode()).hexdigest(): (t, e) for t, e in known[r["doc_id"]]}
        if r["doc_id"] not in (None, 1):  # rows without an id follow 1 in no given order
            t, e = digests[r["edited_sha256"]]
            x, y = shingles(t), shingles(e)
            assert abs(r["near"] - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.12 and abs(r["size"] - len(x)) <= 0.2 * len(x)
            assert abs(r["within"] - (len(x & y) / len(x) if x else 1.0)) < 0.2
    assert fingerprints.compare_with_next(none, 3).count() == 0


def test_sketches_of_parts_merge(spark):
    text = prose(9, 900)
    w = text.split()
    parts = spark.createDataFrame([(1, " ".join(w[:500])), (1, " ".join(w[496:]))], "k int, text string").withColumn("fingerprint", fingerprints.sketch(F.col("text"), 32))
    whole = spark.createDataFrame([(text,)], "text string").select(fingerprints.sketch(F.col("text"), 32).alias("f")).first()["f"]
    assert fingerprints.merge_sketches(parts, ["k"], 32).first()["fingerprint"] == whole


# --- 3: SentencePiece


def test_transducer_equals_the_library(spark, docs, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, r = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(2)
    with open(path, "rb") as f:
        fst = sentencepiece_fst.Transducer(f.read(), max_known=100)
    letters = list("aaabbeeeinnnssttth   \n\t.,'’é▁<s>0x0A><") + ["the", "ing", "tion", " the", "日本", "🎉", "\x00", "ﬁ", "<0x0A>", "</s>"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        ids = library.encode(text)
        assert np.frombuffer(fst.encode(text), dtype="<u4").tolist() == ids and fst.decode(ids) == library.decode(ids)
    found = sentencepiece_fst.encode_documents(docs, path)
    assert Counter(r["ids_crc32"] for r in found.collect()) == Counter(crc(library.encode(r["text"] or "")) for r in docs.collect())
    assert found.filter("NOT round_trip").count() == 0 and sentencepiece_fst.encode_documents(none, path).count() == 0


def message(*fields):
    """A protocol buffer message of (number, bytes, int or float)."""
    import struct

    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


@pytest.mark.parametrize("by_bytes", [True, False])
@pytest.mark.parametrize("rule, one_space", [("", 0), ("", 1), ("nmt_nfkc", 1), ("nfkc", 0)])
def test_unigram_and_normaliser_equal_the_library(by_bytes, rule, one_space):
    """Models written by hand: overlapping pieces whose weights decide, rules and spaces."""
    import sentencepiece

    r = random.Random(4)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if by_bytes else [])
    spell = ["▁", "a", "b", "c", "d", "▁a", "ab", "bc", "abc", "cd", "bcd", "▁ab", "da", "dd", "abab", "ca", "cab", "fi", "▁b▁", "1"]
    pieces += [(p, -1.0 - len(p) * 1.37 - r.random() * 3, 1) for p in spell]
    charsmap = b""
    if rule:
        charsmap = dict(sentencepiece_fst._fields(dict(sentencepiece_fst._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]))[2]
    model = b"".join(message((1, message((1, p.encode()), (2, score), (3, kind)))) for p, score, kind in pieces)
    model += message((2, message((3, 1), (35, int(by_bytes)))), (3, message((1, b"own"), (2, charsmap), (3, 1), (4, one_space), (5, 1))))
    library, fst = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_fst.Transducer(model, max_known=50)
    letters = list("aaabbbcccddd   ") + ["  ", "ﬁ", "①", "x", "é", "e\u0301", "日", "\t", "　"]
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        ids = library.encode(text)
        assert np.frombuffer(fst.encode(text), dtype="<u4").tolist() == ids, text
        assert fst.decode(ids) == library.decode(ids), text


# --- 4: toxicity


def test_toxicity_learns_folds_and_spares(spark, docs):
    rows = [(k, prose(k, 40) + (" you stupid moron" if k % 4 == 0 else "")) for k in range(200)]
    rows += [(1000, "you stup1d mоrоn"), (1001, "a stupidmoron"), (1002, "put it in the trash can"), (1003, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.learn(df, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, model).collect()}
    assert all(got[k] == int(k % 4 == 0) for k in range(200)) and got[1000] == 1 and got[1001] == 1 and got[1003] == 0
    spared = toxicity.Matcher(toxicity.Model({"trash": 3.0}, ("trash can",), None))
    assert spared.measure("the trash can")[0] == 0 and spared.measure("you trash")[0] == 3.0
    kept = toxicity.reject_toxic(df, model)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if not v}
    empty = toxicity.learn(docs, labels.filter("false"))
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {0.0} and toxicity.reject_toxic(docs, empty).count() == docs.count()


def plain_measure(text, model):
    """The weight of a text by trying every term at every place."""
    folded = toxicity.fold(text)
    word = lambda k: 0 <= k < len(folded) and folded[k].isalnum()
    spans = [(a, a + len(p)) for p in map(toxicity.fold, model.exceptions) for a in range(len(folded)) if folded.startswith(p, a) and not word(a - 1) and not word(a + len(p))]
    total = 0.0
    for a in range(len(folded)):
        best = (0.0, 0)
        for term, weight in model.terms.items():
            key = term.rstrip(" ")
            if not word(a - 1) and folded.startswith(key, a) and (term == key or not word(a + len(key))) and weight > best[0]:
                best = (weight, a + len(key))
        if best[0] and not any(x <= a and best[1] <= y for x, y in spans):
            total += best[0]
    return total


def test_matcher_equals_trying_every_term():
    r = random.Random(6)
    model = toxicity.Model({"bad": 2.0, "badly ": 3.0, "foo ": 1.5, "ugiy": 4.0}, ("bad luck", "foo bar"), None)
    parts = ["bad", "badly", "b4d", "bаd", "foo", "foobar", "bar", "ugly", "UGLY", "luck", "not", "zzz", "bad luck", "foo bar", ".", ","]
    matcher = toxicity.Matcher(model)
    for _ in range(2000):
        text = r.choice([" ", "  ", "-"]).join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert matcher.measure(text)[0] == pytest.approx(plain_measure(text, model)), text


def test_exceptions_lower_the_score(spark):
    rows = [(k, prose(k, 40) + (" you trash" if k % 4 == 0 else "")) for k in range(200)] + [(1000, "the trash can"), (1001, "you trash " * 3 + prose(3, 20000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    scores = lambda **more: {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.learn(df, labels, **more)).collect()}
    assert scores()[1000] < 0.5 <= scores(exceptions=())[1000]


def test_toxicity_of_held_out_labels(spark):
    """The registered query against labels it has not learned from."""
    folder = "/root/testdata/sf0.1"
    found = queries.op4_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", "toxic").dropna().toPandas()
    assert set(found.toxic) == {0, 1} and (found.predicted == found.toxic).mean() > 0.95
    pos, neg = found.score[found.toxic == 1].to_numpy(), found.score[found.toxic == 0].to_numpy()
    assert ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2) > 0.95


# --- 5: line dedup


def union(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(k) for k in range(n)]


def line_blocks(line):
    """Levels, and by block the number of features and the majority of their hashes' lowest 28 bits, counted one by one."""
    import math

    import xxhash

    level = lambda n, least: max(0, math.floor(math.log2(max(n, 1) / least)))
    hashes = lambda found: [xxhash.xxh64_intdigest(f.encode(), seed=42) for f in found]
    words = set(line.split(" "))
    grams = {"_" + line[i : i + 4] for i in range(len(line) - 3)} if len(words) < 24 else None
    k, m = level(len(words), 3), level(len(words), 4.25) if grams is None else level(len(grams), 2)
    blocks = {}
    for j in range(15):
        own, depth, found = (j, k, words) if j < 7 else (j - 7, m, words if grams is None else grams)
        classes = 1 << depth
        inside = [x for x in hashes(found) if (x >> 28 + 4 * (own // classes)) % classes == own % classes]
        blocks[j] = len(inside), sum(1 << b for b in range(28) if 2 * sum(x >> b & 1 for x in inside) > len(inside))
    return (k, m if grams is None else 100 + m), blocks


def normal_line(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def close_lines(every, similarity=0.8):
    """All pairs of lines of enough edit similarity by characters, as DuckDB counts them; no gates."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE l (line VARCHAR)")
    con.executemany("INSERT INTO l VALUES (?)", [[x] for x in every])
    far = f"levenshtein(a.line, b.line) <= floor({1 - similarity:.6f} * greatest(length(a.line), length(b.line)) + 1e-9)"
    return set(con.sql(f"SELECT a.line, b.line FROM l a JOIN l b ON a.line <> b.line AND {far}").fetchall())


def lost_lines(texts, near):
    """Brute force: what each text loses if lines for which ``near`` holds are linked."""
    occurrences = {}
    for d, t in texts.items():
        for p, line in enumerate(t.split("\n")):
            if normal_line(line):
                occurrences.setdefault(normal_line(line), []).append((d, p))
    every = list(occurrences)
    roots, groups, lost = union(len(every), [(a, b) for a, b in combinations(range(len(every)), 2) if near(every[a], every[b])]), {}, {}
    for k, root in enumerate(roots):
        groups.setdefault(root, []).extend(occurrences[every[k]])
    for places in groups.values():
        for d, p in sorted(places)[1:]:
            lost.setdefault(d, []).append(p)
    return {d: sorted(lost.get(d, [])) for d in texts}


def test_line_dedup_equals_brute_force(spark, docs, none):
    r, texts = random.Random(3), {}
    base = [prose(100 + k, 30) for k in range(12)] + [prose(200, 500)]
    for d in range(60):
        own = []
        for _ in range(r.randint(1, 4)):
            w = r.choice(base).split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = "edit%d" % r.randint(0, 40)
            own.append(" ".join(w) if r.random() < 0.9 else prose(r.random(), 20))
        texts[d] = "\n".join(own)
    texts[60], texts[61] = " ".join(["word%d" % (k % 900) for k in range(2500)]), "!!!\n\n" + base[0].upper()
    texts[62] = texts[60].replace("word77 ", "other ") + "\nto be or\nto be  or!"
    close = close_lines({normal_line(x) for t in texts.values() for x in t.split("\n")} - {""})
    expected = lost_lines(texts, lambda a, b: (a, b) in close)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: set(r["removed"]) for r in line_dedup.dedup_lines(df.withColumn("removed", F.lit("x")), removed="removed").collect()}
    assert all(found[d] <= set(expected[d]) for d in texts)
    assert sum(map(len, found.values())) >= 0.95 * sum(map(len, expected.values()))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.filter("text IS NULL").count() == 2
    nine = out.filter("doc_id = 9").first()["text"]
    assert nine == prose(4) + "\n" + prose(5)
    assert line_dedup.dedup_lines(docs, drop_empty=True).filter("doc_id = 2").count() == 0
    assert line_dedup.dedup_lines(none).count() == 0


def test_blocks_of_lines_of_any_length(spark):
    """The summed lanes against majorities counted one by one."""
    r, texts = random.Random(12), ["a bc def", "aaaa", "ab", "", "word " * 2555, "same " * 511, "ab " * 3000 + "abcd"]
    texts += [" ".join("w%d" % r.randrange(10 ** r.randint(1, 6)) + "xyz" for _ in range(n)) for n in (1, 2, 3, 9, 23, 24, 60, 300, 600, 1500, 9000)]
    texts.append("\n".join(texts))
    found = line_dedup.lines(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    lines = {(k, p): normal_line(x) for k, t in enumerate(texts) for p, x in enumerate(t.split("\n")) if normal_line(x)}
    assert sorted((x["doc_id"], x["pos"]) for x in found) == sorted(lines)
    for x in found:
        levels, own = line_blocks(lines[x["doc_id"], x["pos"]])
        assert (x["k"], x["m"]) == levels
        if max(n for n, _ in own.values()) < 16:  # more than a lane counts: rare, and alike for equal sets
            for j, (n, bits) in own.items():
                assert x["held"] >> 4 * j & 15 == n
                assert sum((x[f"r{i}"] >> 4 * j & 15) << 4 * i for i in range(7)) == bits


def _letter(r, word):
    k = r.randrange(len(word))
    return word[:k] + r.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != word[k]]) + word[k + 1 :]


def test_planted_lines_of_every_kind_are_found(spark):
    """Letters wrong in several words, at every length, in short words and in a script without spaces: nine in ten go."""
    r, count = random.Random(21), 60
    word = lambda n=None: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n or r.choice([3, 5, 7, 8, 9, 10])))
    vocabulary = [word() for _ in range(4000)]
    kinds = [(12, 1), (12, 2), (14, 3), (30, 3), (60, 6)]
    rows, planted = [], {}
    for kind in [*kinds, "short", "unspaced"]:
        for _ in range(count):
            if kind == "unspaced":
                w = [chr(0x4E00 + int(3000 * r.random() ** 2)) for _ in range(40)]
                first, second = "".join(w), "".join([*w[:20], "\u9fa0", *w[21:]])
            else:
                n, wrong = (15, 1) if kind == "short" else kind
                w = [word(3) if kind == "short" else r.choice(vocabulary) for _ in range(n)]
                at = set(r.sample(range(n), wrong))
                first, second = " ".join(w), " ".join(_letter(r, x) if i in at else x for i, x in enumerate(w))
            planted[len(rows) + 1] = kind
            rows += [(len(rows), first), (len(rows) + 1, second)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [x["doc_id"] for x in line_dedup.dedup_lines(df, removed="removed").filter("size(removed) > 0").collect()]
    assert set(found) <= set(planted)
    for kind in set(planted.values()):
        assert sum(planted[d] == kind for d in found) >= 0.9 * count, kind


def test_near_lines_under_keys_that_many_unlike_lines_share(spark):
    """Three hundred lines with the same words in their middle, of which each third one has a near copy."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    common, rows, copies = "in the course of this and that year", [], set()
    for k in range(300):
        w = [word() for _ in range(14)]
        rows.append((len(rows), " ".join([*w[:7], common, *w[7:]])))
        if k % 3 == 0:
            copies.add(len(rows))
            rows.append((len(rows), " ".join([*w[:7], common, *w[7:13], word()])))
    found = {x["doc_id"] for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), removed="removed").filter("size(removed) > 0").collect()}
    assert found <= copies and len(found) >= 0.95 * len(copies)


def test_lines_under_one_key_are_all_compared(spark, monkeypatch):
    """Every line under one key alone, over tens of unlike groups, in parts: what brute force over all pairs takes goes, and nothing else."""
    monkeypatch.setattr(line_dedup, "_keys", lambda: F.array(F.lit(1).cast("long")))
    monkeypatch.setattr(line_dedup, "CELL", 20, raising=False)
    r = random.Random(17)
    texts = {k: prose(5000 + k, r.choice([6, 12, 40])) for k in range(90)}
    for k in range(90, 150):
        x = list(texts[r.randrange(k)])
        for _ in range(int(r.choice([0.05, 0.15, 0.19]) * len(x))):
            x[r.randrange(len(x))] = r.choice("xyz")
        texts[k] = "".join(x)
    close = close_lines({normal_line(x) for x in texts.values()})
    expected = lost_lines(texts, lambda a, b: (a, b) in close)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {x["doc_id"]: x["removed"] for x in line_dedup.dedup_lines(df, removed="removed").collect()}
    assert found == expected and sum(map(len, found.values())) >= 40


def test_edit_distance_of_two_lines(spark):
    r, rows = random.Random(18), []
    for _ in range(400):
        a = "".join(r.choice("abcé\u4e2d\U0001f600") for _ in range(r.choice([0, 1, 3, 20, 150])))
        b = list(a)
        for _ in range(r.randint(0, 12)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = r.choice(["", "a", "x"])
        rows.append((a, "".join(b) if r.random() < 0.8 else a[::-1]))
    for x in spark.createDataFrame(rows, "a string, b string").withColumn("d", F.levenshtein("a", "b")).collect():
        assert [line_dedup.within(x["a"], x["b"], k) for k in range(30)] == [x["d"] <= k for k in range(30)]


def test_line_dedup_compares_lines_where_they_are_joined(spark, monkeypatch):
    """The texts of two lines are not shuffled together once more, and near copies go all the same."""
    plans, write = [], line_dedup.saved
    keep = lambda df: plans.append(df._jdf.queryExecution().toString()) or write(df)
    monkeypatch.setattr(line_dedup, "saved", keep)
    monkeypatch.setattr("quantloom.llm.components.saved", keep)
    rows = [(k, prose(3000 + k % 40, 40) + (" other" if k >= 40 else "")) for k in range(60)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), removed="removed")
    assert {x["doc_id"] for x in out.filter("size(removed) > 0").collect()} == set(range(40, 60))
    assert any("MapInArrow" in x for x in plans) and not any("REPARTITION_BY" in x for x in plans)


def test_line_dedup_takes_little_disk(spark, monkeypatch):
    """Lines compared by slices give the same, and no table of texts or keys stays on the disk."""
    rows = [(k, prose(4000 + k % 40, 40) + (" other" if k >= 40 else "") + "\n" + prose(k, 25)) for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    once = {x["doc_id"]: x["removed"] for x in line_dedup.dedup_lines(df, removed="removed").collect()}
    written, plans, write = [], [], common.saved
    keep = lambda df, *codec: plans.append(df._jdf.queryExecution().toString()) or written.append(write(df, *codec)) or written[-1]
    monkeypatch.setattr(common, "saved", keep)
    monkeypatch.setattr(line_dedup, "saved", keep)
    monkeypatch.setattr("quantloom.llm.components.saved", keep)
    monkeypatch.setattr(line_dedup, "SLICED", 1, raising=False)
    monkeypatch.setattr(line_dedup, "CELL", 7)
    assert {x["doc_id"]: x["removed"] for x in line_dedup.dedup_lines(df, removed="removed").collect()} == once
    assert sum("MapInArrow" in x for x in plans) >= 3 * 9  # every two of three slices, in three rounds
    left = [x.columns for x in written if os.path.exists(re.sub("^file:/+", "/", x._ql_folders[0]))]
    assert len(left) < len(written) - 3 * 9 and not any({"line", "key"} & set(c) for c in left)


def test_line_dedup_finds_what_edit_similarity_alone_would(spark):
    """No gate here: the share of removals that brute force on edit similarity makes and the operator too."""
    r, texts = random.Random(8), {}
    for k in range(150):
        w = prose(1000 + k, r.choice([8, 15, 30, 60])).split(" ")
        texts[2 * k] = " ".join(w)
        for _ in range(max(1, len(w) // 20)):
            w[r.randrange(len(w))] = "edit%d" % r.randint(0, 40)
        texts[2 * k + 1] = " ".join(w)
    found = line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), removed="removed")
    found = {x["doc_id"] for x in found.filter("size(removed) > 0").collect()}
    assert found <= set(texts) and len(found & set(range(1, 300, 2))) >= 0.9 * 150 and not found & set(range(0, 300, 2))


def test_one_large_group_of_near_lines(spark):
    """Each of some thousand lines differs in one word from the first; all but that one go."""
    w = prose(77, 40).split(" ")
    rows = [(0, " ".join(w))] + [(k, " ".join([*w[: k % 40], f"other{k}", *w[k % 40 + 1 :]])) for k in range(1, 3000)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), drop_empty=True)
    assert [x["doc_id"] for x in out.collect()] == [0]


def test_documents_with_a_rest_are_not_dropped(spark):
    rests = {2: "abc", 3: "привет мир", 4: "42", 5: "!!!", 6: ""}
    df = spark.createDataFrame([(1, prose(1)), *((d, prose(1) + "\n" + x) for d, x in rests.items())], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, drop_empty=True).collect()}
    assert kept == {1: prose(1), 2: "abc", 3: "привет мир", 4: "42"}


# --- 6: SimHash


def test_links_equal_brute_force(spark):
    r, values = random.Random(4), []
    for _ in range(30):
        own = r.getrandbits(64)
        for _ in range(12):
            v = own
            for _ in range(r.randint(0, 6)):
                v ^= 1 << r.randrange(64)
            values.append(v)
    values = sorted(set(values))
    for bits in (2, 4):
        roots = union(len(values), [(a, b) for a, b in combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= bits])
        signed = [v - (1 << 64) if v >> 63 else v for v in values]
        found = {r["fp"]: r["root"] for r in simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"), bits).collect()}
        parts = lambda keys: {frozenset(i for i, k in enumerate(keys) if k == x) for x in set(keys)}
        assert parts([found.get(v, v) for v in signed]) == parts(roots)


def test_keep_one_of_repeated_ids(spark):
    """Wholly different texts under one id all stay; copies go, also under one id."""
    rows = [(3, prose(41)), (3, prose(42)), (3, prose(42)), (4, prose(41)), (5, prose(43)), (None, prose(43)), (None, prose(43))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect()) == sorted([(3, prose(41)), (3, prose(42)), (5, prose(43)), (0, prose(43)), (0, prose(43))])


def test_near_duplicates_of_hard_rows(spark, docs, none):
    found = simhash.near_duplicates(docs).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert len(found) == docs.count() and by[1] == by[3] and by[4] == by[5] == {(0, 4)} and len(by[None]) == 2
    import xxhash

    assert simhash.fingerprint("A b", 4) == xxhash.xxh64_intdigest("a b", seed=42)
    kept = simhash.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i in (1, 3, 4, 5)) == [1, 4] and ids.count(None) == 2
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(90, 91), (91, 90), (7, 7), (None, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {**{k: 0 for k in range(51)}, 90: 90, 91: 90}


# --- 7: chat


def test_chat_round_trip_and_order(spark):
    hard = ["", None, "</s>", "[\\INST] \\", "a [/ROLE][TEXT] <s", "\\\\[INST]\\", "x\ny 🎉", "[[INST]]<</s>>"]
    rows = [(c, k, role, hard[(c + k) % len(hard)]) for c in range(8) for k, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(100, 0, "assistant", "first"), (101, 0, "tool", "t"), (101, 1, None, "n"), (102, 0, "user", "a"), (102, 0, "user", "a"), (None, 0, "user", "q"), (103, None, "user", "late"), (104, 0, "[/ROLE]", "odd")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    found = chat.format_conversations(df).withColumn("formatted", chat.formatted_text(F.col("segments")))
    found = {r["conv_id"]: r for r in found.withColumns({"back": chat.read_turns(F.col("formatted")), "loss": chat.loss_text(F.col("segments"))}).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([(t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == c])
        assert [(x["role"], x["text"]) for x in found[c]["back"]] == [(x[2], x[3]) for x in own]
        assert found[c]["loss"] == "".join(x[3] for x in own if x[2] == "assistant")
    assert found[0]["valid"] and not found[100]["valid"] and found[100]["fault_turn"] == 0 and not found[102]["valid"] and found[102]["fault_turn"] == 1
    assert chat.format_conversations(df.filter("false")).count() == 0


# --- 8: PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_equal_the_patterns():
    r, pieces = random.Random(6), ["a.b@c.de", "@", "x@", "@y.z", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+1", " ", ".", "-", "é", "+49 30 1234567", "7", "0001.002.3.4", "%"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 8)))
        wanted = []
        for kind, p in PATTERNS.items():
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m.group())
                good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(d[::-1])) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
                if good:
                    wanted.append((kind, m.start(), m.end()))
        assert pii.base_spans(text) == sorted(wanted, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_terms_that_disclose_are_found_and_hidden(spark, docs, none):
    rows = [(k, f"{prose(k, 12)} write Zebulon at z.q@mail.example.com {prose(k + 50, 12)}") for k in range(4)] + [(k, prose(k, 30)) for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    held = {df.filter(f"doc_id = {k}").first()["text"][t["start"] : t["end"]] for k in range(4) for t in found[k]["terms"]}
    assert "Zebulon" in held and all(not found[k]["terms"] and not found[k]["spans"] for k in range(10, 60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("Zebulon" not in clean[k] and "[EMAIL]" in clean[k] and "@" not in clean[k] for k in range(4)) and clean[10] == prose(10, 30)
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and Counter(out.select("doc_id", "text").collect()) == Counter(docs.select("doc_id", "text").collect())
    assert pii.digest(pii.find_personal_data(docs)).count() == docs.count() and pii.sanitise(none).count() == 0


def test_terms_are_hidden_wherever_they_stand(spark):
    far = lambda k: prose(k, 40)
    rows = [(k, f"z.q@mail.example.com {far(k)}\n\n{far(k + 100)} Zebulon {far(k + 200)} Zebulon") for k in range(4)]
    df = spark.createDataFrame([*rows, (5, f"{far(5)} Zebulon"), *((k, far(k)) for k in range(10, 60))], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all(clean[k] == dict(rows)[k].replace("Zebulon", "[NAME]").replace("z.q@mail.example.com", "[EMAIL]") for k in range(4))
    assert clean[5] == f"{far(5)} [NAME]" and clean[10] == far(10)


def test_rare_entities_and_classes_prove_terms_beyond_chance(spark):
    word = lambda k: "".join(chr(97 + int(c)) for c in f"{k:05d}")
    own = lambda k: " ".join(f"own{word(8 * k + x)}" for x in range(8))
    texts = {k: f"{own(k)} common" for k in range(600)}
    texts |= {1: f"{own(1)} Zebulon a.b@one.example", 2: f"A.B@one.example {own(2)} Zebulon", 3: f"{own(3)} Lonely x@lonely.example"}
    texts |= {k: f"{own(k)} Acme u{k}@acme.example" for k in range(10, 14)} | {599: f"{own(599)} acme"}
    texts |= {20 + k: f"{own(20)} copied c@copy.example" for k in range(4)}
    texts |= {30 + k: f"{' '.join(own(300 + x) for x in range(10))} edit{word(k)} nearly n@copy.example" for k in range(4)}
    found = {r["doc_id"]: r["terms"] for r in pii.find_personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    held = {k: {texts[k][t["start"] : t["end"]] for t in v} for k, v in found.items() if v}
    assert held == {1: {"Zebulon"}, 2: {"Zebulon"}, **{k: {"Acme"} for k in range(10, 14)}, 599: {"acme"}}


# --- 9: packing


def test_plans_place_every_piece_once():
    r = random.Random(7)
    for capacity in (64, 512):
        histogram = Counter(r.choice([r.randint(1, capacity), r.randint(1, 9), capacity]) for _ in range(3000))
        slots = packing.plan(dict(histogram), capacity)
        filled, ranks = {}, {}
        for length, first, n, sequence, offset in slots.tolist():
            ranks.setdefault(length, []).extend(range(first, first + n))
            for k in range(n):
                filled.setdefault(sequence + k, []).append((offset, length))
        assert {x: sorted(v) == list(range(histogram[x])) for x, v in ranks.items()} == {x: True for x in histogram}
        for own in filled.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(filled) <= 1.03 * sum(k * v for k, v in histogram.items()) / capacity + 2
    assert len(packing.plan({}, 64)) == 0


def test_best_configuration_is_the_best():
    r = random.Random(8)
    for _ in range(30):
        size = np.array(sorted(r.sample(range(1, 20), 4)))
        price = np.array([r.random() for _ in size])
        best = max(sum(c * p for c, p in zip(cs, price, strict=True)) for cs in np.ndindex(*(21 // s + 1 for s in size)) if sum(c * s for c, s in zip(cs, size, strict=True)) <= 21)
        counts = packing.best_configuration(price, size, 21)
        assert counts @ size <= 21 and counts @ price == pytest.approx(best)


def test_documents_are_packed_whole(spark, docs, none):
    found = packing.pack_documents(docs, tokens.default_path(), capacity=256).toPandas().sort_values(["sequence_id", "offset"])
    assert (found.offset == found.groupby("sequence_id").length.cumsum() - found.length).all() and found.groupby("sequence_id").length.sum().max() <= 256
    library = tokenizer()
    wanted = Counter()
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            wanted[(r["doc_id"] or -1, k // 256, k, len(ids[k : k + 256]), crc(ids[k : k + 256]))] += 1
    columns = found[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-1).astype("int64")
    assert Counter(map(tuple, columns.itertuples(index=False))) == wanted
    assert packing.pack_documents(none, tokens.default_path()).count() == 0


# --- 10: nearest neighbours


def exact(rows, k):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            out[q] = [i for _, i in sorted((-float(np.dot(x, y)), i) for i, y in rows if i != q)[:k]]
    return out


def test_neighbours_are_exact_without_parts(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist()) for i in range(200)] + [(200 + i, [1.0] * 8) for i in range(60)]
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0] * 3), (None, [1.0] * 8), (904, [None] + [1.0] * 7), (905, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("part", F.lit(1))
    found = {}
    for x in ann.search(df, k=20, router=None).orderBy("query_id", "rank").collect():
        found.setdefault(x["query_id"], []).append(x["vec_id"])
    wanted = exact(rows, 20)
    assert found.keys() == wanted.keys() and all(len(v) == 20 for v in found.values())
    assert all(found[q] == wanted[q] for q in wanted)
    few = ann.search(df.filter("vec_id < 5"), k=20).collect()
    assert len(few) == 4 and ann.search(df.filter("false")).count() == 0
    parted = ann.search(df, k=20, per_part=10, recall=0.01)  # few parts by mass, yet never fewer than can be had
    assert {x["n"] for x in parted.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {20}


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_search(spark, size):
    """Production parameters on the given vectors, against brute force."""
    pdf = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").toPandas()
    x, ids = np.array(pdf.embedding.tolist(), dtype=float), pdf.vec_id.to_numpy()
    found, hits = queries.op10_nearest_neighbours(spark, f"/root/testdata/{size}").toPandas(), 0
    asked = ids[ids % 20 == 0]
    assert len(found) == 20 * len(asked)
    for q, own in found.groupby("query_id"):
        s = ann.scores(np.repeat(x[ids == q], len(x), axis=0), x)
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        own = own.sort_values("rank")
        assert own.score.tolist() == [s[ids == v][0] for v in own.vec_id] and own.score.is_monotonic_decreasing
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.9 * len(found)


def test_blocks_and_large_vectors(spark, monkeypatch):
    """Small blocks on both sides give what one block gives; overflow is as in double arithmetic, not-a-number last."""
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=4) * 3).round().tolist()) for i in range(1, 300)] + [(300, [1e308, 1e308, -1e308, 1.0]), (320, [1e200, 0.0, 0.0, 0.0]), (301, [1e200, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([x for x in rows if any(x[1])], "vec_id long, embedding array<double>").withColumns({"part": F.lit(1), "rank": F.lit(2)})
    whole = ann.search(df, router=None).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    assert ann.search(df, router=None).orderBy("query_id", "rank").collect() == whole
    first = next(x for x in whole if x["query_id"] == 320)
    assert (first["vec_id"], first["score"]) == (300, float("inf"))


def test_learned_parts_recall(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(24, 16))
    rows = [(i, (centres[i % 24] + 0.4 * r.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    distinct = df.select(F.col("embedding").alias("v"))
    router = ann.fit(distinct, distinct.count(), max_sample=2048, per_part=256)
    assert router is not None and len(router.b2) == 11
    found = ann.search(df, queries="vec_id % 100 = 0", k=20, router=router).toPandas()
    wanted = {q: v for q, v in exact(rows, 20).items() if q % 100 == 0}
    hits = sum(len(set(g.vec_id) & set(wanted[q])) for q, g in found.groupby("query_id"))
    assert hits / (20 * len(wanted)) >= 0.9
    x = np.array([v for _, v in rows])
    part = ann.balanced_parts(x[:1000], ann.neighbour_graph(x[:1000], 10), 8, np.random.default_rng(0))
    assert pd.Series(part).value_counts().max() <= np.ceil(1.1 * 1000 / 8)


# --- the pipeline


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen, now = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, data)
        now = spark.createDataFrame(out.toPandas().astype(object).where(lambda x: x.notna(), None), out.schema)
        if name != "best-fit packing":
            assert out.columns == docs.columns and now.count() <= seen
            seen = now.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert now.select("doc_id").distinct().count() == seen and {r["doc_id"] for r in now.collect()} <= set(texts)
    whole = corpus_pipeline.run(spark, data).select("doc_id", "piece", "length").collect()
    assert Counter(whole) == Counter(now.select("doc_id", "piece", "length").collect())
