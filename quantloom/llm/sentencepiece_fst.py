"""SentencePiece encoding and decoding (operator 3) as a weighted finite-state transducer.

A model file is compiled to transducers:

* the normaliser: rules that rewrite the longest match, over states that tell whether a space is owed (the space becomes U+2581,
  one is put in front, and repeated ones may vanish);
* the lexicon: a trie of the pieces' characters, from whose final states an arc leads back to the root, gives out the piece
  and weighs its negated score;
* byte fallback: for each character outside the pieces an arc from the root that gives out the characters' bytes, or the
  unknown piece, and weighs more than any piece.

They are composed with an input lazily, so only states that the input reaches are made, and the path of least weight in the
tropical semiring (minimum over paths, sum along them) gives the ids. Every arc leads forward in the input, so states are
relaxed in order of their position. Decoding reads the inverted transducer.

For a BPE model weights alone would not give what merging gives. There the lexicon's root is split into a state for each last
piece, and the arc to a next piece weighs infinity unless merging the two pieces' characters gives just these two pieces
back. A segmentation all of whose neighbours pass is the one that merging finds. The tests hold both kinds of
model, and the normaliser, against the library.

Two characters that stand side by side in no piece are never joined. So the input of a BPE model is cut there, which most of
all is at the starts and ends of words, and composed unit by unit; units that come again are looked up. That of another
model is composed whole. Texts of any length are whole
inputs; tables of known units are bounded.

Cases: a null text is the empty text and has no ids; decoding gives it back. A text with U+2581 itself decodes to a space
there, as in the library. Repeated rows get equal results, rows with a null ``doc_id`` too. An empty table gives
an empty result. Other columns are ignored. Models with user-defined pieces or with spaces at the ends of words are refused.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import batches_of, text_of

SPACE = "▁"
#: Piece types of a model file, fixed values of its format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
INFINITE = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class ModelFile:
    pieces: list[tuple[str, float, int]]
    kind: int
    dummy_prefix: bool
    byte_fallback: bool
    unknown: int
    rules: dict[str, str]
    one_space: bool


def read_rules(charsmap: bytes) -> dict[str, str]:
    """What a normaliser replaces by what: a double array, whose leaves point into a list of strings."""
    if not charsmap:
        return {}
    (size,) = struct.unpack_from("<I", charsmap)
    units, strings = struct.unpack_from(f"<{size // 4}I", charsmap, 4), charsmap[4 + size :]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    rules, todo = {}, [(offset(units[0]), b"")]
    while todo:
        at, key = todo.pop()
        for label in range(1, 256):
            if (at ^ label) < len(units) and (units[at ^ label] & 0x800000FF) == label:
                unit, here = units[at ^ label], key + bytes([label])
                below = (at ^ label) ^ offset(unit)
                if unit >> 8 & 1:
                    value = units[below] & 0x7FFFFFFF
                    rules[here.decode("utf-8")] = strings[value : strings.index(b"\0", value)].decode("utf-8")
                todo.append((below, here))
    return rules


def read_model(data: bytes) -> ModelFile:
    """Pieces, model type and normaliser of a SentencePiece model file."""
    pieces, kind, dummy, fallback, rules, one_space = [], 1, True, False, {}, True
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode("utf-8"), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            kind, fallback = own.get(3, 1), bool(own.get(35, 0))
            if own.get(24, 0):
                raise ValueError("spaces at the ends of words are not compiled")
        elif number == 3:
            own = dict(_fields(value))
            dummy, one_space, rules = bool(own.get(3, 1)), bool(own.get(4, 1)), read_rules(own.get(2, b""))
            if not own.get(5, 1):
                raise ValueError("only normalisers that escape white space are compiled")
    if any(p[2] == USER_DEFINED for p in pieces):
        raise ValueError("user-defined pieces are not compiled")
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    return ModelFile(pieces, kind, dummy, fallback, unknown, rules, one_space)


class Trie:
    """Arcs by character, ``step[state][character]``, and what its final states give out."""

    def __init__(self, entries: dict[str, object]):
        self.step: list[dict[str, int]] = [{}]
        self.final: list[object] = [None]
        for key, value in entries.items():
            state = 0
            for x in key:
                if x not in self.step[state]:
                    self.step[state][x] = len(self.step)
                    self.step.append({})
                    self.final.append(None)
                state = self.step[state][x]
            self.final[state] = value


class Normaliser:
    """Deterministic transducer: at each place the longest rule, else the character itself; then spaces by ``SPACES``.

    Spaces have three states: nothing given out yet, inside a word, and a space owed. With ``one_space`` a space only changes the
    state, and the next other character pays it.
    """

    def __init__(self, rules: dict[str, str], dummy_prefix: bool, one_space: bool):
        self.rules, self.dummy_prefix, self.one_space = Trie(rules), dummy_prefix, one_space
        self.plain = not rules and not one_space

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:  # one state, and an arc for the space beside the identity
            return (" " * self.dummy_prefix + text).replace(" ", SPACE)
        step, final, out, at = self.rules.step, self.rules.final, [], 0
        while at < len(text):
            state, end, new = 0, at + 1, text[at]
            for k in range(at, len(text)):
                state = step[state].get(text[k])
                if state is None:
                    break
                if final[state] is not None:
                    end, new = k + 1, final[state]
            out.append(new)
            at = end
        rewritten = "".join(out)
        if not self.one_space:
            return (" " * self.dummy_prefix + rewritten).replace(" ", SPACE) if rewritten else ""
        out, owed, begun = [], self.dummy_prefix, False
        for x in rewritten:
            if x == " ":
                owed = owed or begun
            else:
                out.append(SPACE + x if owed else x)
                owed, begun = False, True
        return "".join(out)


class Transducer:
    """Compiled model. ``max_known`` bounds the entries of each of its lookup tables."""

    UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def __init__(self, data: bytes, max_known: int = 400_000):
        model = read_model(data)
        self.bpe, self.unknown, self.by_bytes = model.kind == BPE, model.unknown, model.byte_fallback
        self.normalise = Normaliser(model.rules, model.dummy_prefix, model.one_space)
        self.strips = model.dummy_prefix or model.one_space
        self.arcs = {p: (i, -score) for i, (p, score, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.lexicon = Trie({p: (p, i, w) for p, (i, w) in self.arcs.items()})
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE} if model.byte_fallback else {}
        self.cuts_at_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.arcs)
        self.joined = {p[k : k + 2] for p in self.arcs for k in range(len(p) - 1)}
        self.worst = float(np.float32(max((w for _, w in self.arcs.values()), default=0.0) + 10.0))
        self.spoken = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in model.pieces]
        self.max_known = max_known
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.allowed: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short string: always the best-scored neighbours, the leftmost of equal ones."""
        parts = list(text)
        while True:
            best, at = INFINITE, -1
            for k in range(len(parts) - 1):
                arc = self.arcs.get(parts[k] + parts[k + 1])
                if arc is not None and arc[1] < best:
                    best, at = arc[1], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: str, b: str) -> bool:
        """Whether piece ``b`` may stand after ``a`` (at the start: after the empty string)."""
        key = (a, b)
        known = self.allowed.get(key)
        if known is None:
            known = self.merged(a + b) == [x for x in key if x]
            if len(self.allowed) >= self.max_known:
                self.allowed.clear()
            self.allowed[key] = known
        return known

    def shortest_path(self, unit: str) -> list[int]:
        """Ids of the path of least weight through the composition of a unit with lexicon and byte fallback.

        ``reached[i]`` has the composed states at place ``i`` of the unit, by the lexicon's state: the last piece of a BPE model,
        else the one root. Each holds its least weight, the place and state it is reached from, and the piece.
        """
        n, bpe, step, final, allowed = len(unit), self.bpe, self.lexicon.step, self.lexicon.final, self.allowed
        reached: list[dict[str, tuple[float, int, str, str]]] = [{} for _ in range(n + 1)]
        reached[0][""] = (0.0, -1, "", "")
        for i in range(n):
            own = reached[i]
            if not own:
                continue
            arcs, at = [], 0
            for j in range(i, n):
                at = step[at].get(unit[j])
                if at is None:
                    break
                if final[at] is not None:
                    arcs.append((j + 1, final[at][0], final[at][2]))
            if not arcs or arcs[0][0] > i + 1:
                arcs.append((i + 1, unit[i], self.worst))
            for state, (cost, _, _, _) in own.items():
                for end, piece, weight in arcs:
                    if bpe:
                        known = allowed.get((state, piece))
                        if known is False or known is None and not self.follows(state, piece):
                            continue  # an arc of infinite weight
                    # sums are rounded as the library's, which decides between segmentations of the same pieces
                    to, total = (piece, cost + weight) if bpe else ("", float(np.float32(cost + weight)))
                    if to not in reached[end] or total < reached[end][to][0]:
                        reached[end][to] = (total, i, state, piece)
        out: list[int] = []
        at, (state, best) = n, min(reached[n].items(), key=lambda x: x[1][0])
        while at > 0:
            _, before, state, piece = best
            if piece in self.arcs:
                out.append(self.arcs[piece][0])
            elif self.by_bytes:
                out.extend(self.bytes[b] for b in reversed(piece.encode("utf-8")))
            else:
                out.append(self.unknown)
            at, best = before, reached[before][state]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        normal = self.normalise(text)
        if not normal:
            return b""
        known, new = self.words.get, self._new_word
        if not self.bpe:  # sums from the start of the text decide, by their rounding, between segmentations of equal weight
            ids = np.array(self.shortest_path(normal), dtype="<u4").tobytes()
        else:
            words = self.UNITS.findall(normal) if self.cuts_at_spaces else [normal]
            ids = b"".join([new(w) if (ids := known(w)) is None else ids for w in words])
        if self.by_bytes:
            return ids
        found = np.frombuffer(ids, dtype="<u4")  # of unknown pieces side by side one is given out
        return found[~((found == self.unknown) & (np.concatenate([[-1], found[:-1]]) == self.unknown))].tobytes()

    def _new_word(self, word: str) -> bytes:
        joined, at, found = self.joined, 0, []
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in joined:
                found.append(self._unit(word[at:k]))
                at = k
        found.append(self._unit(word[at:]))
        ids = b"".join(found)
        if len(self.words) < self.max_known and len(word) <= 40:
            self.words[word] = ids
        return ids

    def _unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            ids = self.older.get(unit)
            if ids is None:
                ids = np.array(self.shortest_path(unit), dtype="<u4").tobytes()
            if len(unit) <= 40:
                if len(self.units) >= self.max_known:
                    self.older, self.units = self.units, {}
                self.units[unit] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        spoken = b"".join(map(self.spoken.__getitem__, ids))
        if self.strips and spoken.startswith(b" "):
            spoken = spoken[1:]
        return spoken.decode("utf-8", "replace")


_LOADED: dict[str, Transducer] = {}


def transducer(name: str, data: bytes) -> Transducer:
    if name not in _LOADED:
        _LOADED[name] = Transducer(data)
    return _LOADED[name]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, decoded_crc32, round_trip`` of every whole text, and ``ids array<long>`` on demand.

    ``decoded_crc32`` is taken of the decoded ids' UTF-8, and ``round_trip`` says whether they equal the text.
    """
    with open(path, "rb") as f:  # a model file on the driver; sent to tasks, as large as its vocabulary
        data = f.read()
    name = f"{path}:{zlib.crc32(data)}"
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(name, shared.value)
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                ids = fst.encode(text)
                values = np.frombuffer(ids, dtype="<u4").tolist()
                decoded = fst.decode(values)
                out.append((len(values), zlib.crc32(ids), zlib.crc32(decoded.encode("utf-8")), decoded == text, *([values] if with_ids else [])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), *([pa.list_(pa.int64())] if with_ids else [])]
            columns = list(zip(*out, strict=True)) or [[] for _ in types]
            names = ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip", "ids"][: len(types) + 1]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + ", ids array<long>" * with_ids
    return batches_of(rows).mapInArrow(run, schema)
