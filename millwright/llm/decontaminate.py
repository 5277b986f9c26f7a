"""Benchmark decontamination by SimHash over item-sized windows.

Words are lower-cased (A-Z), ASCII punctuation is taken out. A text contains an item if the weighted similarity of the item's
five-word shingles (the item itself where it is shorter) and those of some window of the item's length reaches 0.8: sum of
minima over sum of maxima of their counts. A text shorter than the item is one window; no window has words of two texts.

1. Windows that cannot reach 0.8 are refused first, by exact counts: a window that does holds 80 % of the item's shingles, so
   one of its rarest fifth and one more (pigeonhole), and enough of them in number. Nothing is lost here, at any place of a text.
2. Every other window gets ``FINGERPRINTS`` 64-bit SimHashes of its two-word shingles. Each is looked up in a multi-index of the
   items of the window's length: four blocks of 16 bits, up to two errors enumerated in a block, so *all* items within
   ``RADIUS`` 11 are found (pigeonhole: 11 errors in four blocks leave two or fewer in one).
   At similarity 0.8 the windows share 8 of 9 features, a bit differs with a probability of 0.152 and one SimHash is beyond the radius with
   0.26 (binomial); all twelve are with 1e-7.
3. What is found is verified on its words, the most promising window first; none that could be better is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import slices, text_batches
from millwright.llm.near_dedup import _BASE, _mix, word_hashes

#: Bits that a fingerprint may differ in, its blocks, and the independent fingerprints of a window; see the module's text for the miss rate.
RADIUS, BLOCKS, FINGERPRINTS = 11, 4, 12
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Words that are looked up or fingerprinted at a time: few enough to stay in the processor's cache.
_AT_ONCE = 6000
_SEEN = 1 << 20


@dataclass(frozen=True)
class Settings:
    shingle_words: int = 5
    similarity: float = 0.8
    items_at_once: int = 20_000


def normal_words(text: bytes | None) -> np.ndarray:
    return word_hashes((text or b"").translate(None, _PUNCTUATION))


def _pairs(words: np.ndarray) -> np.ndarray:
    return _mix(words[:-1] * np.uint64(0x100000001B3) + words[1:])


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one run."""
    size = min(size, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    out = np.full(n, _BASE + np.uint64(size))
    for k in range(size):
        out = _mix(out * np.uint64(0x100000001B3) + words[k : k + n])
    return out


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def fingerprints(features: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of ``size`` features; a tied bit is 0."""
    bits = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1)
    return _window_prints(_running(bits, size), size)


def _varied(features: np.ndarray, fingerprint: int) -> np.ndarray:
    """The features as an independent fingerprint hashes them."""
    return _mix(features + np.uint64(int(_BASE) * fingerprint & (1 << 64) - 1))


def _running(bits: np.ndarray, size: int) -> np.ndarray:
    """Running bit counts; differences of up to 255 survive the wrap-around of one byte."""
    kind = np.uint8 if size <= 255 else np.uint32
    out = np.zeros((len(bits) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


def _window_prints(running: np.ndarray, size: int) -> np.ndarray:
    counts = running[size:] - running[:-size]
    return np.packbits(counts > size // 2, axis=1).view(np.uint64).ravel()


class HammingIndex:
    """Fingerprints filed by each of their blocks: every pair within the radius agrees in some block up to ``RADIUS // BLOCKS`` bits."""

    WIDTH = 64 // BLOCKS
    MASKS = np.array([sum(1 << i for i in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(64 // BLOCKS), n)], np.uint64)

    def __init__(self, prints: np.ndarray):
        self.prints, self.files = prints, []
        for block in range(BLOCKS):
            values = self._block(prints, block)
            order = np.argsort(values, kind="stable")
            self.files.append((values[order], order))

    def _block(self, prints: np.ndarray, block: int) -> np.ndarray:
        return prints >> np.uint64(block * self.WIDTH) & np.uint64((1 << self.WIDTH) - 1)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (query, fingerprint) of all pairs within the radius; a pair may repeat."""
        found = []
        for block, (values, order) in enumerate(self.files):
            variants = (self._block(queries, block)[:, None] ^ self.MASKS).ravel()
            low, high = np.searchsorted(values, variants, "left"), np.searchsorted(values, variants, "right")
            hit = np.flatnonzero(high > low)
            counts = high[hit] - low[hit]
            query = np.repeat(hit // len(self.MASKS), counts)
            held = order[np.repeat(low[hit] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            close = np.bitwise_count(queries[query] ^ self.prints[held]) <= RADIUS
            found.append((query[close], held[close]))
        return np.concatenate([q for q, _ in found]), np.concatenate([h for _, h in found])


class Index:
    """Items with a multi-index of their fingerprints by length, and their rarest shingles by shingle size."""

    def __init__(self, items: list[tuple[int, bytes | None]], settings: Settings):
        self.settings = settings
        self.items = [(key, w, Counter(shingles(w, settings.shingle_words).tolist())) for key, w in ((k, normal_words(t)) for k, t in items) if len(w)]
        prints = np.array([self._prints(w) for _, w, _ in self.items], np.uint64).reshape(len(self.items), FINGERPRINTS)
        lengths = np.array([len(w) for _, w, _ in self.items], np.int64)
        self.sized = {int(n): (of := np.flatnonzero(lengths == n), [HammingIndex(prints[of, j]) for j in range(FINGERPRINTS)]) for n in np.unique(lengths)}
        self.shingles = [np.array(sorted(counts), np.uint64) for _, _, counts in self.items]
        spread = Counter(s for _, _, counts in self.items for s in counts)
        rare: dict[int, set[tuple[int, int]]] = {}
        for member, (_, words, counts) in enumerate(self.items):
            total = sum(counts.values())
            needed = max(1, int(np.ceil(settings.similarity * total - 1e-9)))
            by_rarity = sorted(counts.elements(), key=lambda s: (spread[s], s))
            rare.setdefault(min(settings.shingle_words, len(words)), set()).update((s, member) for s in by_rarity[: total - needed + 1])
        self.rare = {}
        for size, pairs in sorted(rare.items()):
            keys, members = (np.array(x, t) for x, t in zip(zip(*sorted(pairs), strict=True), (np.uint64, np.int64), strict=True))
            seen = np.zeros(_SEEN, bool)
            seen[keys & np.uint64(_SEEN - 1)] = True
            self.rare[size] = keys, members, seen

    @staticmethod
    def _prints(words: np.ndarray) -> list[int]:
        features = _pairs(words) if len(words) > 1 else words
        return [int(fingerprints(_varied(features, j), len(features))[0]) for j in range(FINGERPRINTS)]

    def _bounds(self, found: np.ndarray, member: int, words: int) -> np.ndarray:
        """An upper bound of the similarity of each window: ``found`` has the shingles of a stretch of so many words."""
        _, item, counts = self.items[member]
        keys = self.shingles[member]
        width = min(len(item), words) - min(self.settings.shingle_words, len(item)) + 1
        held = keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found
        running = np.concatenate([[0], np.cumsum(held)])
        inside = running[width:] - running[:-width]
        return inside / (sum(counts.values()) + width - np.minimum(inside, width))

    def _near(self, words: np.ndarray, starts: np.ndarray, length: int) -> dict[int, np.ndarray]:
        """For the items of one length, those of the (sorted) window starts that the multi-index finds near them."""
        members, indexes = self.sized[length]
        size = min(length, len(words))
        pairs = [np.empty((0, 2), np.int64)]
        at = 0
        while at < len(starts):
            until = int(np.searchsorted(starts, starts[at] + _AT_ONCE))
            piece = words[starts[at] : starts[until - 1] + size]
            features, span = (_pairs(piece), size - 1) if size > 1 else (piece, 1)
            part = starts[at:until]
            for j, index in enumerate(indexes):
                prints = fingerprints(_varied(features, j), span)[part - starts[at]]
                query, held = index.near(prints)
                pairs.append(np.unique(np.stack([members[held], part[query]], axis=1), axis=0))
                if len(members) == 1:  # one item of this length: a window that is found needs no further fingerprint
                    part = np.setdiff1d(part, part[query], assume_unique=True)
                if not len(part):
                    break
            at = until
        found = np.unique(np.concatenate(pairs), axis=0)
        return {int(m): found[found[:, 0] == m, 1] for m in np.unique(found[:, 0])}

    def _best(self, words: np.ndarray, near: Iterable[int], member: int) -> tuple[float, int]:
        """Highest similarity of the item and a window of its length that starts at one of ``near``, and the first such start.

        Windows that cannot reach the wanted similarity are not looked at; without any other it is -1.
        """
        _, item, counts = self.items[member]
        last = max(0, len(words) - len(item))
        starts = np.unique(np.clip(np.fromiter(near, np.int64), 0, last))
        size = min(self.settings.shingle_words, len(item))
        best = (-1.0, 0)
        if not len(starts) or len(words) < size:
            return best
        low = int(starts[0])
        stretch = words[low : int(starts[-1]) + len(item)]
        found = shingles(stretch, size)
        bounds = self._bounds(found, member, len(stretch))[starts - low]
        width = min(len(item), len(stretch)) - size + 1
        for k in np.lexsort((starts, -bounds)).tolist():
            start, bound = int(starts[k]), float(bounds[k])
            if bound < max(best[0], self.settings.similarity - 1e-9) or (bound == best[0] and start > best[1]):
                break
            got = weighted_similarity(counts, Counter(found[start - low : start - low + width].tolist()))
            if got > best[0] or (got == best[0] and start < best[1]):
                best = (got, start)
        return best

    def search(self, texts: list[bytes | None]) -> list[list[tuple[int, float, int]]]:
        """For each text, (item key, similarity, first word of the window) of its contaminating items, by key."""
        out: list[list[tuple[int, float, int]]] = [[] for _ in texts]
        words = [normal_words(t) for t in texts]
        i = 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (j == i or total + len(words[j]) <= _AT_ONCE):
                total += len(words[j])
                j += 1
            self._search(words[i:j], out, i)
            i = j
        return out

    def _search(self, words: list[np.ndarray], out: list, first: int) -> None:
        """Several texts side by side; shingles over a border are nobody's."""
        starts = np.cumsum([0, *map(len, words)])
        joined = np.concatenate(words)
        for size, (keys, members, seen) in self.rare.items():
            if len(joined) < size:
                continue
            found = shingles(joined, size)
            at = np.flatnonzero(seen[found & np.uint64(_SEEN - 1)])
            lo, hi = np.searchsorted(keys, found[at], "left"), np.searchsorted(keys, found[at], "right")
            text = np.searchsorted(starts, at, "right") - 1
            own = np.flatnonzero((hi > lo) & (at + size <= starts[text + 1]))
            ranges = sorted({(int(text[i]), int(lo[i]), int(hi[i])) for i in own})
            dense: dict[tuple[int, int], dict[int, np.ndarray]] = {}
            for k, member in sorted({(k, int(m)) for k, a, b in ranges for m in members[a:b]}):
                bounds = self._bounds(found[starts[k] : starts[k + 1] - size + 1], member, len(words[k]))
                windows = np.flatnonzero(bounds >= self.settings.similarity - 1e-9)
                if len(windows):
                    dense.setdefault((k, len(self.items[member][1])), {})[member] = windows
            for (k, length), windows in dense.items():
                for member, near in self._near(words[k], np.unique(np.concatenate(list(windows.values()))), length).items():
                    near = near[np.isin(near, windows.get(member, ()))]
                    similarity, start = self._best(words[k], near, member) if len(near) else (-1.0, 0)
                    if similarity >= self.settings.similarity:
                        out[first + k].append((self.items[member][0], similarity, start))
        for k in range(len(words)):
            out[first + k].sort()


def item_blocks(benchmark: DataFrame, settings: Settings) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of about ``items_at_once`` items, whose index (some kilobytes an item) every worker can hold."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    blocks = max(1, -(-items.count() // settings.items_at_once))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").toLocalIterator()
        yield [(r.item_id, r.text.encode("utf-8", "surrogatepass")) for r in rows]


def contamination(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row for each row of ``docs`` and item it contains: doc_id, item_id, similarity, start_word.

    All texts are searched for all items, the items in blocks. Null, empty and punctuation-only texts or items match
    nothing; a text shorter than an item is compared as one window. Repeated rows repeat their result.
    """
    settings = settings or Settings()
    found = None
    for items in item_blocks(benchmark, settings):
        found_here = _search_block(docs, items, settings)
        found = found_here if found is None else found.unionByName(found_here)
    return found


def _search_block(docs: DataFrame, items: list[tuple[int, bytes]], settings: Settings) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index(items, settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches):
            hits = [(row, *hit) for row, found in enumerate(index.search(text_batches(batch))) for hit in found]
            rows = pa.array([h[0] for h in hits], pa.int64())
            columns = [pa.array([h[k] for h in hits], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *columns], names=["doc_id", "item_id", "similarity", "start_word"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, similarity double, start_word long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs``, whole and with their columns, that contain no benchmark item."""
    settings = settings or Settings()
    at = docs.columns.index("text")
    for items in item_blocks(benchmark, settings):
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, settings))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches):
                yield batch.filter(pa.array([not found for found in index.search(text_batches(batch.select([at])))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
