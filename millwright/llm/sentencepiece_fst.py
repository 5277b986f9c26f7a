"""SentencePiece encoding and decoding by composition of weighted transducers over the tropical semiring.

A model file compiles to four machines.

* The *normaliser* (:class:`Normaliser`) is a transducer with a state for the beginning, for the inside of a word and for pending spaces;
  its arcs write the word-boundary mark for spaces and the dummy prefix.
* The *piece* transducer (:class:`Pieces`) is the trie of all pieces: a state for each beginning of a piece, an arc for each character, and
  at the end of a piece an arc back to the root that writes the piece with its weight.
* *Byte fallback*: a character that is no piece has an arc from the root to the root that writes its UTF-8 bytes' ids.
* The *context* machine (:class:`Context`) has a state for each piece and, for a BPE model, an arc from piece to piece where the two side
  by side are what the merges would leave of them (weight 0; a missing arc is infinity, the semiring's zero). Its arcs are made
  when a composition first asks for them. A unigram model needs none: its weights are the pieces' negated scores.

A text is composed with the machines into a lattice of (place, last piece), whose arcs are relaxed in the order of their ends:
the least sum wins, the longer arc of equals. For BPE a prefix has just one path of finite weight, the merges' own result, as a
piece sequence is the encoding exactly if every two neighbours are stable under the merges; so a place has one last piece.

Where two neighbouring characters are together in no piece, every path passes that place and any two pieces may meet there: the lattice falls
apart, and its parts have shortest paths of their own. All parts of a batch that are new are composed side by side in numpy;
short parts' paths are kept and reused within a Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import slices

MARK = "▁"
_INFINITY = float("inf")
#: Piece types of the model file.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_KEPT_PARTS, _KEPT_LENGTH = 120_000, 48
#: Characters that are composed, and texts' characters that are encoded, at a time.
_AT_ONCE, _TEXT_AT_ONCE = 1 << 18, 1 << 21


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        field, wire = tag >> 3, tag & 7
        if wire == 0:
            yield field, number()
        else:
            size = number() if wire == 2 else 8 if wire == 1 else 4
            yield field, data[at : at + size]
            at += size


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Table:
    """Arcs by a 64-bit key (state and label): open addressing, looked up and filled many keys at a time."""

    def __init__(self, bits: int):
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.values, self.size = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; -1 where there is no arc."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are not yet there, each once."""
        if self.size + len(keys) > 0.6 * (self.mask + 1):  # arcs made on demand: begin again
            self.keys[:] = -1
            self.size = 0
        self.size += len(keys)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]  # of several keys for one slot the last is written
            self.values[slot[free]] = values[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask


class Normaliser:
    """States 0 (nothing written), 1 (in a word) and 2 (spaces pending); arcs by state and label: (next state, written before, label kept)."""

    SPACE, OTHER = 0, 1

    def __init__(self, dummy_prefix: bool, squeeze: bool):
        prefix = MARK if dummy_prefix else ""
        if squeeze:
            self.arcs = {(0, 0): (0, "", False), (0, 1): (1, prefix, True), (1, 0): (2, "", False), (1, 1): (1, "", True), (2, 0): (2, "", False), (2, 1): (1, MARK, True)}
        else:
            self.arcs = {(0, 0): (1, prefix + MARK, False), (0, 1): (1, prefix, True), (1, 0): (1, MARK, False), (1, 1): (1, "", True)}

    def __call__(self, text: str) -> str:
        """What the machine writes. State 1 copies other characters in a loop, so a run of them is taken at once.

        Where its arc for a space is a loop too (nothing is squeezed), all the rest is mapped character by character.
        """
        state, out, arcs = 0, [], self.arcs
        if arcs[1, 0][0] == 1 and text:
            state, before, kept = arcs[0, text[0] != " "]
            return before + (text[0] if kept else "") + text[1:].replace(" ", arcs[1, 0][1])
        for run in re.findall(" |[^ ]+", text):
            state, before, kept = arcs[state, run != " "]
            out.append(before + run if kept else before)
        return "".join(out)


class Pieces:
    """The trie of the pieces as arcs (state, character) -> state; state 0 is the root, ``ends`` a state's piece (0: none)."""

    def __init__(self, pieces: list[str]):
        arcs: dict[tuple[int, str], int] = {}
        ends = [0]
        for number, piece in enumerate(pieces, 1):
            state = 0
            for char in piece:
                following = arcs.setdefault((state, char), len(ends))
                if following == len(ends):
                    ends.append(0)
                state = following
            ends[state] = number
        self.ends = np.array(ends, np.int32)
        self.arcs = Table(max(4, (4 * len(arcs)).bit_length()))
        if arcs:
            keys = np.array([state << 21 | ord(char) for state, char in arcs], np.int64)
            self.arcs.put(keys, np.array(list(arcs.values()), np.int32))

    def compose(self, chars: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs (from place, to place, piece) of the lattice of several texts side by side; ``stops``: where each place's text ends."""
        starts, state, froms, tos, pieces = np.arange(len(chars)), np.zeros(len(chars), np.int64), [], [], []
        length = 0
        while len(starts):
            state = self.arcs.get(state << 21 | chars[starts + length]).astype(np.int64)
            going = state >= 0
            starts, state, length = starts[going], state[going], length + 1
            piece = self.ends[state]
            done = piece > 0
            froms.append(starts[done])
            tos.append(starts[done] + length)
            pieces.append(piece[done].astype(np.int64))
            going = starts + length < stops[starts]
            starts, state = starts[going], state[going]
        return np.concatenate(froms or [starts]), np.concatenate(tos or [starts]), np.concatenate(pieces or [starts])


class Context:
    """Which BPE piece may follow which; number 0 is the beginning of a text."""

    def __init__(self, pieces: list[str], scores: dict[str, float]):
        self.pieces, self.scores, self.arcs = ["", *pieces], scores, Table(21)

    def merged(self, text: str) -> list[str]:
        """What the merges leave of a short string: the best-scored neighbouring pair first, the leftmost of equals."""
        parts, get = list(text), self.scores.get
        scores = [get(a + b, -_INFINITY) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == -_INFINITY:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], -_INFINITY)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], -_INFINITY)
        return parts

    def weights(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """0 where there is an arc from left to right, else infinity; characters of the fallback follow and are followed by all."""
        known = np.flatnonzero((left < len(self.pieces)) & (right < len(self.pieces)))
        keys = left[known] << 32 | right[known]
        found = self.arcs.get(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            stable = []
            for key in new.tolist():
                a, b = self.pieces[key >> 32], self.pieces[key & 0xFFFFFFFF]
                stable.append(self.merged(a + b) == ([a, b] if a else [b]))
            stable = np.array(stable, np.int32)
            self.arcs.put(new, stable)
            missing = np.flatnonzero(found < 0)
            found[missing] = stable[np.searchsorted(new, keys[missing])]
        out = np.zeros(len(left))
        out[known[found == 0]] = _INFINITY
        return out


class Transducer:
    """The compiled machines of a model file; ``model`` is the file's bytes."""

    def __init__(self, model: bytes):
        pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]), p.get(3, _NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2):
            raise ValueError("this model's normaliser rewrites characters by a compiled table, which is not supported")
        if any(kind in (_USER, _UNUSED) for *_, kind in pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.bpe = trainer.get(3, 1) == 2
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.normaliser = Normaliser(self.dummy_prefix, bool(normaliser.get(4, 1)))
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        scores = {p: s for p, s, kind in pieces if kind == _NORMAL}
        names = list(ids)
        self.pieces, self.context = Pieces(names), Context(names, scores)
        self.first_fallback = len(names) + 1  # numbers from here on: a character of the fallback
        self._single = np.zeros(0x110000, bool)
        self._single[[ord(p) for p in names if len(p) == 1]] = True
        # weights by piece number; a BPE model's are in its context machine
        least = min(scores.values(), default=0.0)
        self.weights = np.zeros(len(names) + 1) if self.bpe else np.array([0.0, *(-scores[p] for p in names)])
        self.fallback_weight = 0.0 if self.bpe else 10.0 - least
        unknown = next((i for i, p in enumerate(pieces) if p[2] == _UNKNOWN), 0)
        byte_ids = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self._byte_arcs = [byte_ids.get(b, unknown) for b in range(256)] if byte_ids else None
        self._unknown = unknown.to_bytes(4, "little")
        self._written = [b"", *(i.to_bytes(4, "little") for i in ids.values())]  # a piece's id as int32
        self._fallen: dict[int, bytes] = {}
        pairs = {a << 21 | b for p in names for a, b in zip(map(ord, p), map(ord, p[1:]), strict=False)}
        self._together = np.zeros(1 << 22, bool)  # hashed: a pair that shares a place with another cuts less, never wrongly
        self._together[self._pair_place(np.array(sorted(pairs), np.int64))] = True
        # decoding: bytes by id
        self._out = [b"" if kind == _CONTROL else " ⁇ ".encode() if kind == _UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        for byte, i in byte_ids.items():
            self._out[i] = bytes([byte])
        self._kept: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    @staticmethod
    def _pair_place(pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def normalise(self, text: str) -> str:
        return self.normaliser(text)

    def parts(self, text: str) -> list[str]:
        """A normalised text, cut where no piece has the characters before and after the place together."""
        chars = _codes(text)
        cuts = (np.flatnonzero(~self._together[self._pair_place(chars[:-1] << 21 | chars[1:])]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def _fallback(self, number: int) -> bytes:
        """The ids that the byte machine writes for a character's UTF-8 bytes, an arc a byte."""
        code = number - self.first_fallback
        if code not in self._fallen:
            data = chr(code).encode("utf-8", "surrogatepass")
            self._fallen[code] = b"".join(self._byte_arcs[b].to_bytes(4, "little") for b in data) if self._byte_arcs else self._unknown
        return self._fallen[code]

    def shortest_paths(self, parts: list[str]) -> list[bytes]:
        """Ids (as int32) of the least path of each part's lattice."""
        lengths = np.array([len(p) for p in parts], np.int64)
        chars, begins = _codes("".join(parts)), np.cumsum(lengths) - lengths
        stops, first = np.repeat(begins + lengths, lengths), np.repeat(begins, lengths)
        froms, tos, pieces = self.pieces.compose(chars, stops)
        fallen = np.flatnonzero(~self._single[chars])
        weights = np.concatenate([self.weights[pieces], np.full(len(fallen), self.fallback_weight)])
        froms, tos, pieces = np.concatenate([froms, fallen]), np.concatenate([tos, fallen + 1]), np.concatenate([pieces, chars[fallen] + self.first_fallback])
        # places: part k's places are its characters' and one more, where its last arc ends; arcs in the order of their ends in a part, then of parts
        shift = np.repeat(np.arange(len(parts)), lengths)
        depth = tos - first[froms]
        order = np.lexsort((froms, tos, depth))
        depth, pieces, weights = depth[order], pieces[order], weights[order]
        tos, froms = tos[order] + shift[froms[order]], froms[order] + shift[froms[order]]
        cost, last, back = np.full(len(chars) + len(parts), _INFINITY), np.zeros(len(chars) + len(parts), np.int64), np.zeros(len(chars) + len(parts), np.int64)
        cost[begins + np.arange(len(parts))] = 0.0
        bounds = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2)) if len(depth) else []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            at, to, piece = froms[lo:hi], tos[lo:hi], pieces[lo:hi]
            total = cost[at] + weights[lo:hi]
            if self.bpe:
                open_ = np.flatnonzero(total < _INFINITY)
                total[open_] += self.context.weights(last[at[open_]], piece[open_])
            new = np.flatnonzero(np.diff(to, prepend=-1))
            least = np.minimum.reduceat(total, new)
            best = np.flatnonzero((total == np.repeat(least, np.diff(np.append(new, len(to))))) & (total < _INFINITY))[::-1]
            cost[to[best]], last[to[best]], back[to[best]] = total[best], piece[best], at[best]  # of equals the longest is written last
        out, written, fallback = [], self._written, self.first_fallback
        last, back = last.tolist(), back.tolist()
        for k, (begin, length) in enumerate(zip(begins.tolist(), lengths.tolist(), strict=True)):
            ids, place, begin = [], begin + k + length, begin + k
            while place > begin:
                number = last[place]
                ids.append(written[number] if number < fallback else self._fallback(number))
                place = back[place]
            ids.reverse()
            out.append(b"".join(ids))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids (as int32) of normalised texts."""
        cut = [self.parts(t) if t else [] for t in texts]
        kept, older, fresh = self._kept, self._older, []
        here: dict[str, bytes | None] = dict.fromkeys(chain.from_iterable(cut))
        for part in here:
            ids = kept.get(part)
            if ids is None:
                ids = older.get(part)
                if ids is None:
                    fresh.append(part)
                    continue
                kept[part] = ids
            here[part] = ids
        fresh.sort(key=len)
        low = total = 0
        for high, part in enumerate(fresh, 1):
            total += len(part)
            if total >= _AT_ONCE or high == len(fresh):
                here.update(zip(fresh[low:high], self.shortest_paths(fresh[low:high]), strict=True))
                low, total = high, 0
        out = [b"".join(map(here.__getitem__, parts)) for parts in cut]
        if len(kept) > _KEPT_PARTS:  # two generations: the used ones of the older come back
            self._older, self._kept = kept, {}
        self._kept.update((p, here[p]) for p in fresh if len(p) <= _KEPT_LENGTH)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Ids (int32) of a text; null and empty texts have none."""
        return np.frombuffer(self.encode_all([self.normalise(text or "")])[0], "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; byte pieces that form no valid UTF-8 become replacement characters."""
        text = b"".join(map(self._out.__getitem__, ids.tolist()))
        if self.dummy_prefix and text.startswith(b" "):
            text = text[1:]
        return text.decode("utf-8", "replace")


_MACHINES: dict[int, Transducer] = {}


def _machine(model: bytes) -> Transducer:
    """One compiled machine for each model and Python worker, so that kept paths serve later batches."""
    key = hash(model)
    if key not in _MACHINES:
        _MACHINES[key] = Transducer(model)
    return _MACHINES[key]


def read_model(spark: SparkSession, path: str) -> bytes:
    """A model file's bytes: from a local path, or through Spark for any other file system."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def _groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in groups of a bounded number of characters; a longer text is a group of its own."""
    some, total = [], 0
    for text in texts:
        some.append(text)
        total += len(text or "")
        if total >= _TEXT_AT_ONCE:
            yield some
            some, total = [], 0
    if some:
        yield some


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """One row per row of ``docs``: doc_id, token_ids (array of int), n_tokens, and round_trip: whether decoding the ids gives
    the normalised text again (a text's own boundary marks read as spaces). Null and empty texts have no tokens and round-trip.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared.value)
        for batch in slices(batches):
            ids, same = [], []
            for texts in _groups(batch.column(1).to_pylist()):
                normal = [machine.normalise(t or "") for t in texts]
                found = [np.frombuffer(x, "<i4") for x in machine.encode_all(normal)]
                ids += found
                for plain, x in zip(normal, found, strict=True):
                    plain = plain.replace(MARK, " ")
                    same.append(machine.decode(x) == (plain[1:] if machine.dummy_prefix else plain))
            lengths = np.array([len(x) for x in ids], np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            tokens = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), tokens, pa.array(lengths.astype(np.int64)), pa.array(same, pa.bool_())],
                names=["doc_id", "token_ids", "n_tokens", "round_trip"],
            )

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, token_ids array<int>, n_tokens long, round_trip boolean"
    )


def decode(tokens: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of each row's ``token_ids``; a null array gives a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared.value)
        for batch in slices(batches):
            texts = [None if ids is None else machine.decode(np.array(ids, np.int32)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(tokens.select("doc_id").dtypes)["doc_id"]
    return tokens.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {kind}, text string")
