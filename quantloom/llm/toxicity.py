"""Toxicity (operator 4).

A weighted lexicon is matched by an Aho-Corasick automaton after folding: lower case, accents dropped, letters of other
alphabets that look alike and digits or signs that stand for letters replaced. Hits inside an exception phrase do not count.
The weights found are summed, also in proportion to the text's length, and a logistic curve turns both into a
score from 0 to 1.

Lexicon and curve are learned from labelled rows: a term is the start of a word, or a whole word, and its weight the
log-odds of toxic against clean labelled documents that hold it. ``max_labelled`` bounds the labelled rows of each
class that are learned from (chosen by a hash of ``doc_id``); scoring covers every row.

Cases: a null text is the empty text; texts without hits, the empty one among them, get the curve's lowest score; very long texts are matched whole.
Labels that are null or whose document is missing teach nothing; of several labels of a document the highest counts. Without
toxic labels the lexicon is empty and every score 0. Repeated rows get equal scores. Rows with a null ``doc_id`` are scored
and never learned from. Columns of ``docs`` stay as they are; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import batches_of, text_of

#: Letters that look alike, and digits and signs that stand for letters. "l", "1" and "|" all become "i".
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ł": "i", "ß": "ß",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "l": "i",
}
#: Phrases in which a hit is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "trash collection")
#: Lengths of word starts that can become terms.
STARTS = range(4, 9)
WORD = re.compile(r"\w+")


class _Folding(dict):
    """Translation table that folds a character when it is first seen; zero-width ones vanish."""

    def __missing__(self, code: int) -> str | None:
        char = chr(code)
        if unicodedata.category(char) in ("Cf", "Mn"):
            found = None
        else:
            plain = unicodedata.normalize("NFKD", char.lower())
            kept = "".join(x for x in plain if unicodedata.category(x) != "Mn") or char
            found = "".join(LOOKALIKES.get(x, x) for x in kept)
        self[code] = found
        return found


FOLDING = _Folding()


def fold(text: str) -> str:
    return text.translate(FOLDING)


@dataclass(frozen=True)
class Model:
    """Terms with weights (a term ending in a space is a whole word), exception phrases and the curve."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float] | None


class Matcher:
    """Sum of the weights of a text's hits; of terms that start at one place the heaviest counts."""

    def __init__(self, model: Model):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        words: dict[str, tuple[float, float]] = {}
        for term, weight in model.terms.items():
            key = term.rstrip(" ")
            start, whole = words.get(key, (0.0, 0.0))
            words[key] = (start, max(whole, weight)) if term.endswith(" ") else (max(start, weight), whole)
        for key in {fold(x) for x in model.exceptions} - words.keys():
            words[key] = (0.0, 0.0)
        phrases = {fold(x) for x in model.exceptions}
        for key, (start, whole) in words.items():
            self.automaton.add_word(key, (len(key), start, whole, key in phrases))
        self.empty = not words
        if words:
            self.automaton.make_automaton()

    def measure(self, text: str) -> tuple[float, int]:
        """Weight of all hits and number of words."""
        folded = fold(text)
        n = len(folded.split())
        if self.empty:
            return 0.0, n
        hits: dict[int, tuple[float, int]] = {}
        harmless: list[tuple[int, int]] = []
        for end, (size, start_weight, whole_weight, phrase) in self.automaton.iter(folded):
            at = end + 1 - size
            if at and folded[at - 1].isalnum():
                continue
            ends = end + 1 == len(folded) or not folded[end + 1].isalnum()
            weight = max(start_weight, whole_weight if ends else 0.0)
            if phrase and ends:
                harmless.append((at, end))
            if weight > hits.get(at, (0.0, 0))[0]:
                hits[at] = (weight, end)
        if harmless:
            hits = {at: x for at, x in hits.items() if not any(a <= at and x[1] <= b for a, b in harmless)}
        return sum(x[0] for x in hits.values()), n


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 20))], axis=1)


def fit_curve(weight: np.ndarray, words: np.ndarray, toxic: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float, float]:
    """Logistic regression on the summed weight and its density, by Newton steps."""
    x, y = _features(weight, words), toxic.astype(float)
    b = np.zeros(3)
    penalty = ridge * len(y) * np.diag([0.0, 1e-2, 1e-2]) + 1e-6 * np.eye(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
        b = b + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(b.tolist())


def choose_terms(counted: dict[str, tuple[int, int]], n_toxic: int, n_clean: int, max_terms: int, least_docs: int = 4, least_odds: float = 2.5, least_surprise: float = 25.0) -> dict[str, float]:
    """Terms that toxic documents hold significantly and much more often, with their log-odds; of word starts, the shortest."""
    found = {}
    rate = n_toxic / max(n_toxic + n_clean, 1)
    for term, (pos, neg) in counted.items():
        odds = float(np.log((pos + 0.5) / (n_toxic + 1)) - np.log((neg + 0.5) / (n_clean + 1)))
        expected = (pos + neg) * rate
        surprise = 2 * (pos * np.log(pos / expected) + (neg * np.log(neg / (pos + neg - expected)) if neg else 0.0)) if pos else 0.0
        if pos >= least_docs and odds >= least_odds and surprise >= least_surprise:
            found[term] = odds
    for term in sorted(found, key=lambda x: (len(x), x)):
        if any(found.get(term[:k], 0.0) >= found[term] - 1.5 for k in range(1, len(term.rstrip(" ")) + (term[-1] == " "))):
            del found[term]
    return dict(sorted(found.items(), key=lambda x: (-counted[x[0]][0], x[0]))[:max_terms])


def _terms_of(text: str) -> set[str]:
    words = set(WORD.findall(fold(text)))
    return {w[:k] for w in words for k in STARTS if len(w) >= k} | {w + " " for w in words if 3 <= len(w) <= 24}


def learn(docs: DataFrame, labels: DataFrame, held_out: bool = True, max_labelled: int = 6000, max_terms: int = 2000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Learn lexicon and curve from ``labels (doc_id, toxic)``; with ``held_out``, only from rows whose crc32 of ``doc_id`` mod 5 is not 0.

    At most ``max_labelled`` rows of each class are taken. Their ids are broadcast, so no text is shuffled; the driver gets
    terms that at least four toxic documents hold, and two numbers a row.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    if held_out:
        known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(max_labelled).unionByName(known.filter("toxic = 0").orderBy(*order).limit(max_labelled))
    chosen = chosen.select(F.col("doc_id").alias("labelled_id"), "toxic")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("text", "toxic")  # at most 2 * max_labelled ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y].update(_terms_of(text))
                n[y][""] += 1
        terms = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n[1][t] for t in terms], pa.int64()), pa.array([n[0][t] for t in terms], pa.int64())], ["term", "pos", "neg"])

    counted = batches_of(rows).mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counted = {r["term"]: (r["pos"], r["neg"]) for r in counted.filter("term = '' OR (pos >= 4 AND pos > neg)").collect()}
    n_toxic, n_clean = counted.pop("", (0, 0))
    terms = choose_terms(counted, n_toxic, n_clean, max_terms) if n_toxic else {}
    model = Model(terms, tuple(exceptions), None)
    if not terms:
        return model
    seen = _measured(rows, model, ["toxic"]).toPandas()  # at most 2 * max_labelled rows of three numbers
    return Model(terms, tuple(exceptions), fit_curve(seen.weight.to_numpy(), seen.words.to_numpy(), seen.toxic.to_numpy()))


def _measured(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, and ``weight, words`` of ``text``."""
    fields = [rows.schema[x] for x in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for b in batches:
            found = [matcher.measure(x) for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            own = [b.column(b.schema.get_field_index(x)) for x in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())], [*keep, "weight", "words"])

    schema = type(rows.schema)(fields).add("weight", "double").add("words", "long")
    return batches_of(rows.select(*keep, "text")).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted, weight, words`` for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = _measured(rows, model, ["doc_id"])
    if model.curve is None:
        value = F.lit(0.0)
    else:
        b0, b1, b2 = (F.lit(x) for x in model.curve)
        value = 1 / (1 + F.exp(-(b0 + b1 * F.log1p("weight") + b2 * F.log1p(100 * F.col("weight") / F.greatest("words", F.lit(20))))))
    return found.withColumn("score", value).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not predict to be toxic; all columns stay, in order."""
    if model.curve is None:
        return docs
    threshold = model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for b in batches:
            found = [matcher.measure(x or "") for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            if found:
                weight, words = np.array(found, dtype=float).T
                clean = _features(weight, words) @ np.array(threshold) < 0
                yield b.filter(pa.array(clean))

    return batches_of(docs).mapInArrow(run, docs.schema)
