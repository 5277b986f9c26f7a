"""Alignment of two tokenizers' tokens over the same texts, by windows between anchors before space-marked tokens.

Every text is tokenised whole by both. Where a token of each ends at the same byte and the next token of each begins with a space, the ends are an
anchor; anchors split documents into windows of token ids. The same windows (mostly a word) come again and again, so the alignment of one with up to
four tokens a side is kept by its two tuples of ids, each packed in one integer. The windows of a batch that are not known yet are aligned side by side.
Links of a document are counted in place by pair of ids; pair counts of the corpus are summed by Spark.

The byte-level tokenizer is read from its JSON file and run as ranked merges where the file's merges make ids in their order; otherwise (and for a text
on which that library fails) its own library encodes. Vocabulary files are read on the driver and shipped as bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import join_counted, remove, slices, written

#: The word pattern that byte-level pre-tokenisation stands for, and the mark of a piece that begins with a space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE_MARK = "▁"

#: A window of more tokens a side is aligned anew each time; with this many windows or links kept, a worker starts again.
LONGEST_KEPT, MOST_KEPT, MOST_LINKS = 4, 200_000, 4_000_000
_NONE = 0xFFFF
#: Documents aligned at a time.
BATCH = 200


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side(NamedTuple):
    """A tokenizer's tables by id: bytes, their number, and whether they begin with a space."""

    tokens: list[bytes]
    sizes: np.ndarray
    spaced: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Side:
        return Side(tokens, np.array([len(t) for t in tokens], np.int64), np.array([t[:1] == b" " for t in tokens]))


class ByteLevel:
    """Ids of texts by a byte-level BPE file; strings of special tokens are plain text."""

    def __init__(self, file: bytes):
        import tiktoken

        self._file, self._library = file, None
        data = json.loads(file)
        vocabulary, letters = data["model"]["vocab"], _byte_letters()
        special = {t["content"] for t in data["added_tokens"]}
        plain = {t: i for t, i in vocabulary.items() if t not in special}
        tokens = [b""] * (max([*vocabulary.values(), *(t["id"] for t in data["added_tokens"])]) + 1)
        for t, i in plain.items():
            tokens[i] = bytes(letters[c] for c in t)
        self.side = Side.of(tokens)
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in data["model"]["merges"]]
        ids = [vocabulary[m] for m in merges]
        simple = data["normalizer"] is None and data["pre_tokenizer"].get("type") == "ByteLevel" and not data["pre_tokenizer"].get("add_prefix_space")
        ranked = simple and all(a < b for a, b in zip(ids, ids[1:])) and len(plain) == 256 + len(ids) and min(ids, default=256) == 256
        self._ranks = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks={tokens[i]: i for i in plain.values()}, special_tokens={}) if ranked else None

    def encode(self, text: str) -> list[int]:
        if self._ranks is not None:
            try:
                return self._ranks.encode_ordinary(text)
            except BaseException as failed:  # a panic of the library is no Exception; an interrupt is not its failure
                if isinstance(failed, (KeyboardInterrupt, SystemExit, GeneratorExit, MemoryError)):
                    raise
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_buffer(self._file)
            self._library.encode_special_tokens = True
        return self._library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of texts by a SentencePiece model, which sets a space before a text itself."""

    def __init__(self, file: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=file)
        pieces = [(self._model.id_to_piece(i), self._model.is_byte(i)) for i in range(self._model.get_piece_size())]
        self.side = Side.of([bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE_MARK, " ").encode() for p, byte in pieces])

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1) if texts else []


class Aligner:
    """Aligns the tokens of texts by both tokenizers; one for each worker."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self._packs = max(len(self.a.side.tokens), len(self.b.side.tokens)) < _NONE
        self._width = len(self.b.side.tokens)
        numbers = [str(i) for i in range(max(len(self.a.side.tokens), self._width))]
        self._numbers, self._texts = len(numbers), [n + mark for mark in (",", "|", ";", "") for n in numbers]
        self._forget()

    def _forget(self) -> None:
        """Kept windows: numbers by key, and by number the groups written out and counted, and where its links lie in ``pairs``."""
        self.kept: dict[tuple[int, int], int] = {}
        self.written: list[str] = []
        self.groups, self.starts, self.sizes, self.pairs = (np.zeros(0, np.int64) for _ in range(4))

    def tokenised(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both id arrays of each text; None where it is null or empty or either one's bytes are not a space and the text."""
        places = [i for i, t in enumerate(texts) if t]
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
        ta, tb = self.a.side.tokens, self.b.side.tokens
        for i, b in zip(places, self.b.encode_all([texts[i] for i in places])):
            want = b" " + texts[i].encode()
            if b"".join([tb[x] for x in b]) != want:
                continue
            a = self.a.encode(" " + texts[i])
            if b"".join([ta[x] for x in a]) == want:
                out[i] = np.array(a, np.int64), np.array(b, np.int64)
        return out

    def _overlaps(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token of a its last overlapping token of b, their number, and whether both end together; both have the same bytes."""
        ends_a, ends_b = np.cumsum(self.a.side.sizes[a]), np.cumsum(self.b.side.sizes[b])
        last = np.searchsorted(ends_b, ends_a)
        shared = ends_b[last] == ends_a
        first = np.concatenate([[0], last[:-1] + shared[:-1]])
        return last, last - first + 1, shared

    def _add(self, a: np.ndarray, b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> None:
        """Align the windows that lie one after the other in a and b, the k-th up to stops[k], and number them on from the known ones."""
        last, count, shared = self._overlaps(a, b)
        from_a, from_b = (np.concatenate([[0], s[:-1]]) for s in (stops_a, stops_b))
        ends = np.cumsum(count)
        j = np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(last - count + 1, count)
        links = np.add.reduceat(count, from_a)
        self.starts = np.concatenate([self.starts, len(self.pairs) + np.cumsum(links) - links])
        self.sizes = np.concatenate([self.sizes, links])
        self.pairs = np.concatenate([self.pairs, np.repeat(a, count) * self._width + b[j]])
        self.groups = np.concatenate([self.groups, np.add.reduceat(shared.astype(np.int64), from_a)])
        # the tokens in the order they are written: a group's of a, then its of b, each with what follows it
        shared_b = np.zeros(len(b), bool)
        shared_b[last[shared]] = True
        before_a, before_b = (np.cumsum(x) - x for x in (shared.astype(np.int64), shared_b.astype(np.int64)))  # groups closed before a token
        bound_a, bound_b = np.flatnonzero(shared) + 1, np.flatnonzero(shared_b) + 1
        mark_a, mark_b = np.where(shared, 1, 0), np.where(shared_b, 2, 0)
        mark_b[stops_b - 1] = 3
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], bound_b])[before_a]] = mark_a * self._numbers + a
        order[np.arange(len(b)) + bound_a[before_b]] = mark_b * self._numbers + b
        tokens = [self._texts[x] for x in order.tolist()]
        self.written += ["".join(tokens[i:j]) for i, j in zip((from_a + from_b).tolist(), (stops_a + stops_b).tolist())]

    def _numbered(self, a: np.ndarray, b: np.ndarray, from_a: np.ndarray, n_a: np.ndarray, from_b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """The number of each window, those not known aligned first."""
        if len(self.written) > MOST_KEPT or len(self.pairs) > MOST_LINKS:
            self._forget()
        short = (n_a <= LONGEST_KEPT) & (n_b <= LONGEST_KEPT) if self._packs else np.zeros(len(n_a), bool)
        places, rest = np.flatnonzero(short), np.flatnonzero(~short)
        keys = []
        for ids, start, n in ((a, from_a[places], n_a[places]), (b, from_b[places], n_b[places])):
            key = np.zeros(len(start), np.int64)
            for k in range(LONGEST_KEPT):
                key = key << 16 | np.where(n > k, ids[np.minimum(start + k, len(ids) - 1)], _NONE)
            keys.append(np.unique(key, return_inverse=True))
        (left, in_left), (right, in_right) = keys
        _, first, where = np.unique(in_left * max(len(right), 1) + in_right, return_index=True, return_inverse=True)
        pairs = list(zip(left[in_left[first]].tolist(), right[in_right[first]].tolist()))
        known = np.array([self.kept.get(p, -1) for p in pairs], np.int64)
        new = np.flatnonzero(known < 0)
        known[new] = len(self.written) + np.arange(len(new))
        self.kept.update((pairs[x], n) for x, n in zip(new.tolist(), known[new].tolist()))
        numbers = np.empty(len(n_a), np.int64)
        numbers[places] = known[where]
        numbers[rest] = len(self.written) + len(new) + np.arange(len(rest))
        todo = np.concatenate([places[first[new]], rest])
        if len(todo):
            parts = [ids[_ranges(start[todo], n[todo])] for ids, start, n in ((a, from_a, n_a), (b, from_b, n_b))]
            self._add(*parts, np.cumsum(n_a[todo]), np.cumsum(n_b[todo]))
        return numbers

    def align(self, tokens: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, str, np.ndarray, np.ndarray]]:
        """For each document's two id arrays: numbers of groups and links, the groups written out, the distinct pairs (a << 32 | b), the links of each."""
        if not tokens:
            return []
        a, b = (np.concatenate(x) for x in zip(*tokens))
        last, _, shared = self._overlaps(a, b)
        i = np.flatnonzero(shared)
        j = last[i]
        # every document begins with a space, so its beginning follows an anchor as well
        anchor = self.a.side.spaced[a[np.minimum(i + 1, len(a) - 1)]] & self.b.side.spaced[b[np.minimum(j + 1, len(b) - 1)]]
        anchor[-1] = True
        to_a, to_b = i[anchor] + 1, j[anchor] + 1
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        numbers = self._numbered(a, b, from_a, to_a - from_a, from_b, to_b - from_b)
        stops = np.searchsorted(to_a, np.cumsum([len(x) for x, _ in tokens])) + 1  # windows up to each document's end
        sizes = self.sizes[numbers]
        owner = np.repeat(np.arange(len(tokens)), np.diff(stops, prepend=0))
        span = len(self.a.side.tokens) * self._width
        links = np.sort(np.repeat(owner, sizes) * span + self.pairs[_ranges(self.starts[numbers], sizes)])
        heads = np.flatnonzero(np.diff(links, prepend=-1))
        times, found = np.diff(heads, append=len(links)), links[heads]
        at = np.searchsorted(found, np.arange(len(tokens) + 1) * span)
        found %= span
        found = found // self._width << 32 | found % self._width
        groups, numbers, out, start = np.add.reduceat(self.groups[numbers], np.concatenate([[0], stops[:-1]])).tolist(), numbers.tolist(), [], 0
        for k, stop in enumerate(stops.tolist()):
            written = ";".join([self.written[x] for x in numbers[start:stop]])
            out.append((groups[k], int(times[at[k] : at[k + 1]].sum()), written, found[at[k] : at[k + 1]], times[at[k] : at[k + 1]]))
            start = stop
        return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[k] to starts[k] + sizes[k] - 1 of all k, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


_ALIGNERS: dict[bytes, Aligner] = {}


def _aligner(byte_level: bytes, pieces: bytes) -> Aligner:
    key = hashlib.sha256(byte_level + pieces).digest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(byte_level, pieces)
    return _ALIGNERS[key]


def read_vocabularies(spark: SparkSession, byte_level_path: str, pieces_path: str):
    """Both vocabulary files, read on the driver, as a broadcast variable."""
    return spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (byte_level_path, pieces_path)))


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair: bigint, n: bigint>>"


def alignments(docs: DataFrame, vocabularies) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``) and links (pair a << 32 | b, n times) of every row.

    A null or empty text, or one that either tokenizer does not give back byte by byte, has no tokens: zeros, an empty string and no links.
    Rows stay rows, ids null or repeated included; columns but doc_id and text are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*vocabularies.value)
        for batch in slices(batches, BATCH):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            tokens = aligner.tokenised(texts)
            made = iter(aligner.align([t for t in tokens if t]))
            rows, pairs, counts = [], [], []
            for own in tokens:
                if own is None:
                    rows.append((0, 0, 0, 0, "", 0))
                    continue
                groups, links, text, found, times = next(made)
                rows.append((len(own[0]), len(own[1]), groups, links, text, len(found)))
                pairs.append(found)
                counts.append(times)
            empty = np.zeros(0, np.int64)
            values = pa.StructArray.from_arrays([pa.array(np.concatenate([empty, *x])) for x in (pairs, counts)], names=["pair", "n"])
            columns = list(zip(*rows))
            offsets = pa.array(np.concatenate([[0], np.cumsum(columns[5])]).astype(np.int32))
            numbers = [pa.array(c, pa.int64()) for c in columns[:4]]
            yield pa.RecordBatch.from_arrays(
                [ids, *numbers, pa.array(columns[4], pa.string()), pa.ListArray.from_arrays(offsets, values)], names=re.findall(r"(\w+) (?:long|string|array)", SCHEMA)
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count, best: how many links of the corpus hold each pair, and whether no pair of the same b has more."""
    links = aligned.select(F.explode("links").alias("l")).select("l.pair", "l.n")
    counts = links.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_strength(docs: DataFrame, vocabularies, limit: int = 64 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row.

    Alignments are written once. Pair counts (no more than pairs of ids that texts of the corpus join) are broadcast where their counted size at 64 bytes a pair
    is within ``limit``; beyond it common pairs are broadcast and the rest is shuffled by pair.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    rows = alignments(docs, vocabularies).select(F.monotonically_increasing_id().alias("__row"), "*", digest.alias("groups_sha256")).drop("groups")
    aligned, path = written(rows, "alignments")
    counts, counts_path = written(pair_counts(aligned), "pair-counts")
    links = aligned.select("__row", F.explode("links").alias("l")).select("__row", "l.pair", "l.n")
    if counts.count() * 64 <= limit:
        joined = links.join(F.broadcast(counts), "pair")
    else:
        places = links.groupBy("pair").agg(F.count("*").alias("__count"))
        joined = join_counted(links, counts.join(places, "pair"), ["pair"], "__count")
    sums = joined.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    result = aligned.drop("links").join(sums, "__row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    )
    done, _ = written(result, "link-strength")
    remove(docs.sparkSession, path, counts_path)
    return done
