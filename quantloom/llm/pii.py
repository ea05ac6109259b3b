"""PII (operator 8): patterns for direct identifiers, and information-theoretic sanitisation of what reveals them.

Emails, IP addresses, card and phone numbers are the protected entities. The terms of their documents are
weighed by how much they disclose: with p(x) the share of the corpus' documents that hold x, a term t discloses the entity
e by its pointwise mutual information PMI(t, e) = log2(p(t, e) / (p(t) p(e))), of at most the entity's own information
IC(e) = -log2 p(e). Terms are weighed over the whole document, however far from the entity. Terms with PMI of at least ``generalise`` times IC are replaced by their general class, and from
``remove`` times IC on they are removed. All counts are over all rows, and a term that discloses an entity is hidden wherever
it stands, also in documents without the entity.

Any text holds words that stand nowhere else, so a pair must not be chance. Of an entity's contexts (documents; copies
and near copies, by min-hashes of three terms in turn, are one) the first proposes its terms and the others prove them: with n contexts, k + 1 of which hold the term,
the expected number of terms that do so by chance, terms(e) times the tail of the hypergeometric law, has to be at most
``chance``. The tail is bounded by exp(-(n - 1) KL(k / (n - 1), p)), where p is the share of the other documents that
hold the term. One context thus proves nothing, and two prove a rare term in a large corpus. As most entities are rare, what they
have in common is weighed likewise: an entity's classes are its mail domain, network, issuer or area, and its kind.

A term is a run of three letters or more, in lower case, that overlaps no base span.

Base patterns take the leftmost non-overlapping matches of their kind and drop those that fail their check, with no retry:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 14 to 19 digits that pass the Luhn check
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 10 to 15 digits

They are searched in time linear in the text, whatever it holds. Positions count code points, ends are exclusive.

Cases: a null text is the empty text, which has no spans. Repeated rows get equal results; rows with a null ``doc_id`` are
searched too. An empty table gives an empty result. Other columns are ignored, or kept by ``sanitise``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import batches_of, cut, possible, text_of
from quantloom.llm.components import components

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){3,}+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
NOT_DIGIT = re.compile(r"[^0-9]")
#: Slots of the filters of terms; their size does not grow with the corpus.
SLOTS = 1 << 20
#: Places in a term's hash from which its slots are taken.
SHIFTS = (0, 24)
#: Copies of an entity's counts in the join with its terms.
SALTS = 32
#: Odd factors that put hashes in other orders.
TURNS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL:
            first -= 1
        if first < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", first, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in four):
                yield "ip", at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """All base spans, by start, then by kind as listed."""
    return sorted([*emails(text), *ips(text), *cards(text), *phones(text)], key=lambda x: (x[1], KINDS.index(x[0])))


def entity(kind: str, value: str) -> str:
    """One name for all ways to write an entity."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{NOT_DIGIT.sub('', value)}"


def classes(name: str) -> list[str]:
    """An entity and the classes it belongs to: mail domain, first three parts of an address, a card's issuer (six digits), a
    phone number without its last four digits; and its kind."""
    kind, value = name.split(":", 1)
    part = {"email": value.rpartition("@")[2], "ip": value.rpartition(".")[0], "card": value[:6], "phone": value[:-4]}[kind]
    return [name, f"{kind} of {part}", kind]


def terms_of(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """``(term, start, end)`` for every term of the whole text; ``spans`` are its base spans, by start."""
    k, done = 0, 0  # spans before k start before the term, and end at done at the latest
    for m in TERM.finditer(text):
        s, e = m.span()
        while k < len(spans) and spans[k][1] < e:
            done = max(done, spans[k][2])
            k += 1
        if s >= done:
            yield m.group().lower(), s, e


def distinct_terms(text: str, spans: list[Span]) -> set[str]:
    return {t for t, _, _ in terms_of(text, spans)} if spans else {w.lower() for w in set(TERM.findall(text))}


def min_hashes(terms: list[str]) -> list[int]:
    """The least of the hashes of three terms in turn, under each of the ``TURNS``."""
    import xxhash

    hashes = np.array([xxhash.xxh64_intdigest(" ".join(terms[k : k + 3])) for k in range(max(len(terms) - 2, 1))], dtype=np.uint64)
    return [int((hashes * np.uint64(x)).min() >> np.uint64(1)) for x in TURNS]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def search(docs: DataFrame) -> DataFrame:
    """``doc_id, h, spans, entities, terms, marks`` of every whole text: the base spans and, where there are any, their entities
    with their classes and the distinct terms.

    ``h`` is a hash of the text and ``marks`` are min-hashes of its terms in order, by which near copies are known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, names, terms, marks = [], [], [], []
            for text in b.column(2).to_pylist():
                own = base_spans(text)
                held = [t for t, _, _ in terms_of(text, own)] if own else []
                spans.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in own])
                names.append(sorted({c for k, s, e in own for c in classes(entity(k, text[s:e]))}))
                terms.append(sorted(set(held)))
                marks.append(min_hashes(held) if own else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int64()))],
                ["doc_id", "h", "spans", "entities", "terms", "marks"],
            )

    schema = "doc_id long, h long, spans array<struct<kind:string,start:long,end:long>>, entities array<string>, terms array<string>, marks array<long>"
    return batches_of(_texts(docs)).mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))


def _slots(terms: DataFrame) -> bytes:
    """A filter of ``terms (term)``: a byte per slot, two slots for each term."""
    slot = F.explode(F.array(*(F.pmod(F.shiftrightunsigned(F.xxhash64("term"), k), F.lit(SLOTS)).cast("int") for k in SHIFTS))).alias("slot")
    here = np.zeros(SLOTS, dtype=bool)
    here[terms.select(slot).distinct().toPandas()["slot"].to_numpy()] = True  # at most SLOTS numbers
    return here.tobytes()


class _Known(dict):
    """Whether a word can be among the terms of a filter."""

    def __init__(self, held: bytes):
        import xxhash

        self.held, self.digest = held, xxhash.xxh64_intdigest

    def __missing__(self, word: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        h = self.digest(word, 42)
        found = self[word] = all(self.held[h >> k & SLOTS - 1] for k in SHIFTS)
        return found


def document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n_term``: in how many documents each of ``terms (term)`` stands.

    Tasks leave out words that cannot be among the terms by a filter of ``SLOTS`` slots, and count before the shuffle;
    the join afterwards is exact.
    """
    held = _slots(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = _Known(held), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                n.update(w for w in distinct_terms(text, base_spans(text)) if known[w])
            if len(n) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["term", "n"])
                n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["term", "n"])

    counted = batches_of(docs.select(text_of().alias("text"))).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted.join(terms, "term", "left_semi")


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, h, term, start, end`` for every place where one of ``terms (term)``, or a word of the same slots, stands."""
    held = _slots(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(held)
        for b in batches:
            out = []
            for doc_id, h, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if any(known[w.lower()] for w in set(TERM.findall(text))):
                    out += [(doc_id, h, *x) for x in terms_of(text, base_spans(text)) if known[x[0]]]
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "h", "term", "start", "end"])

    return batches_of(_texts(docs)).mapInArrow(run, "doc_id long, h long, term string, start long, end long")


def contexts_of(found: DataFrame) -> DataFrame:
    """``ctx, entities, terms`` of the rows that hold entities; documents that share two min-hashes have one ``ctx``."""
    rows = found.filter(F.size("entities") > 0).select("entities", "terms", "marks", F.xxhash64("marks").alias("node"))
    keys = [F.xxhash64(F.lit(f"{i} {j}"), F.col("marks")[i], F.col("marks")[j]) for i, j in combinations(range(len(TURNS)), 2)]
    keyed = cut(rows.select("node", F.explode(F.array(*keys)).alias("key")).distinct())
    least = keyed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    roots = components(keyed.join(least, "key").select(F.col("node").alias("a"), "b"))
    return rows.join(roots, "node", "left").select(F.coalesce("root", "node").alias("ctx"), "entities", "terms")


def disclosing_terms(docs: DataFrame, found: DataFrame, generalise: float = 0.75, chance: float = 0.05) -> DataFrame:
    """``entity, term, share`` of the pairs beyond chance whose PMI is at least ``generalise`` of the entity's information."""
    entities = cut(contexts_of(found)).select("ctx", "terms", F.explode("entities").alias("entity"))
    counts = entities.groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct("ctx").alias("contexts"), F.sum(F.size("terms")).alias("n_proposed"))
    several = cut(counts.filter("contexts > 1"))  # one context proves nothing
    pairs = possible(entities, ["entity"], several, ["entity"]).select("entity", "ctx", F.explode("terms").alias("term"))
    pairs = cut(pairs.groupBy("entity", "term").agg(F.count_distinct("ctx").alias("support"), F.count("*").alias("n_both")).filter("support > 1"))
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("share"))
    total = float(found.count())
    # a kind has very many terms: its row is copied, so that its pairs need not meet in one task
    copies = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = document_counts(docs, pairs.select("term").distinct())
    both = pairs.join(counted, "term").withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(copies, ["entity", "salt"])
    information = F.greatest(F.log2(F.lit(total) / F.col("n_entity")), F.lit(1e-9))
    shared = F.log2(F.lit(total) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    n, q = F.col("contexts") - 1, (F.col("support") - 1) / (F.col("contexts") - 1)
    p = (F.col("n_term") - 1) / F.lit(max(total - 1, 1.0))
    parts = q * F.ln(q / p) + F.when(q < 1, (1 - q) * F.ln((1 - q) / (1 - p))).otherwise(0.0)
    proven = (q > p) & (F.ln("n_proposed") - n * parts <= F.lit(math.log(chance)))
    return cut(both.filter(proven).withColumn("share", shared / information).filter(F.col("share") >= generalise).select("entity", "term", "share"))


def find_personal_data(docs: DataFrame, generalise: float = 0.75, chance: float = 0.05) -> DataFrame:
    """``doc_id, h, spans, terms`` for every row: base spans, and ``terms (start, end, share)`` that disclose an entity."""
    found = cut(search(docs))
    shares = disclosing_terms(docs, found, generalise, chance).groupBy("term").agg(F.max("share").alias("share"))
    if shares.isEmpty():
        return found.select("doc_id", "h", "spans", _no_terms().alias("terms"))
    places = occurrences(docs, shares.select("term")).join(shares, "term").groupBy("doc_id", "h", "start", "end").agg(F.max("share").alias("share"))
    terms = places.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    a, b = found.alias("a"), terms.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h"))
    return a.join(b, same, "left").select("a.doc_id", "a.h", "a.spans", F.coalesce("b.terms", _no_terms()).alias("terms"))


def _no_terms() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<start:long,end:long,share:double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as one string."""
    written = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))
    base = F.array_join(F.transform("spans", lambda x: written(x["kind"], x)), ",")
    kind_of = lambda i: F.element_at(F.array(*map(F.lit, KINDS)), i)
    order = F.array(*map(F.lit, KINDS))
    every = F.sort_array(
        F.concat(
            F.transform("spans", lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).cast("int").alias("k"), x["end"].alias("end"))),
            F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("k"), x["end"].alias("end"))),
        )
    )
    n = {f"n_{k}": F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)") for k in KINDS[:4]}
    return found.select("doc_id", *(c.alias(k) for k, c in n.items()), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform(every, lambda x: written(kind_of(x["k"]), x)), ",").alias("spans"))


def rewrite(text: str, spans: list[Span], terms: list[tuple[int, int, float]], remove: float) -> str:
    """Replace spans by their kind and terms by their class, or by nothing from ``remove`` on."""
    marks = [(s, e, f"[{k.upper()}]") for k, s, e in spans]
    marks += [(s, e, "" if share >= remove else "[NAME]" if text[s].isupper() else "[WORD]") for s, e, share in terms]
    out, at = [], 0
    for s, e, new in sorted(marks):
        if s >= at:
            out += [text[at:s], new]
            at = e
        else:
            at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, generalise: float = 0.75, remove: float = 0.95, chance: float = 0.05) -> DataFrame:
    """``docs`` with personal data and what discloses it taken out of ``text``; null texts stay null. Only rows that hold
    disclosing terms take part in the join that brings these to their texts."""
    found = find_personal_data(docs, generalise, chance).filter(F.size("terms") > 0)
    terms = found.select(F.col("doc_id").alias("__ql_id"), F.col("h").alias("__ql_h"), F.col("terms").alias("__ql_terms")).dropDuplicates(["__ql_id", "__ql_h"])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__ql_id")) & (F.xxhash64(text_of()) == F.col("__ql_h"))
    joined = docs.join(terms, same, "left").select(*docs.columns, "__ql_terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = [
                x if x is None else rewrite(x, base_spans(x), [(t["start"], t["end"], t["share"]) for t in near or []], remove)
                for x, near in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)
            ]
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return batches_of(joined).mapInArrow(run, docs.schema)
