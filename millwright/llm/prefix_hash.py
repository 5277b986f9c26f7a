"""Document fingerprints from prefix polynomial hashes.

The value of a text's first i code points is P[i] = sum over j < i of (c[j] + 1) * B^j modulo 2^31 - 1, for two bases B. A span's value
(P[j] - P[i]) * B^-i does not depend on its place, so the equality of any two spans takes a constant number of operations, and their longest
common extension a binary search over its length (:class:`PrefixHashes`).

A fingerprint is a bounded part of the prefix array: the length and both values of the whole, the prefix at up to 64 equal steps (a power of two),
and the prefix at up to 64 content-defined marks: places where the value of the twelve code points before them ends in enough zero bits.
Steps and marks of two texts are brought to the coarser of both, so spans between marks can be compared wherever they stand, and the common
beginning is found by binary search over the steps. Nothing but fingerprints is needed for :func:`likeness`.

Two texts of equal fingerprint are equal but for a chance of about n / 2^62 in the length n; a span between marks is
taken for another one with chance n / 2^31 at most, and only if the lengths are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prime, bases, code points of a window, the most steps and marks of a fingerprint, code points hashed at a time.
PRIME = (1 << 31) - 1
BASES = (911382323, 972663749)
INVERSES = tuple(pow(b, -1, PRIME) for b in BASES)
WINDOW, STEPS, MARKS, BLOCK = 12, 64, 64, 1 << 16

_TABLES: dict[int, list[np.ndarray]] = {}


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n at least of both bases and of both inverses; kept for the next text unless it is a giant's."""
    size = 1 << max(12, n.bit_length())
    if size not in _TABLES:
        made = []
        for base in BASES + INVERSES:
            row = np.ones(1, np.uint64)
            while len(row) < size:
                row = np.concatenate([row, row * np.uint64(pow(base, len(row), PRIME)) % np.uint64(PRIME)])
            made.append(row)
        if size > 4 * BLOCK:
            return made
        _TABLES[size] = made
    return _TABLES[size]


def _prefix(codes: np.ndarray, k: int, tables: list[np.ndarray]) -> np.ndarray:
    """P[0..n] of ``codes`` (each plus 1) for the k-th base; sums of fewer than 2^32 terms of 31 bits cannot overflow."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * tables[k][: len(codes)] % np.uint64(PRIME), out=out[1:])
    return out % np.uint64(PRIME)


def code_points(text: str | None) -> np.ndarray:
    """Code points plus 1, so that no span of zeros has the value 0."""
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class PrefixHashes:
    """Prefix arrays of one text, 16 bytes a code point: any span's value, equality of spans, longest common extensions."""

    def __init__(self, text: str | None):
        codes = code_points(text)
        self.n, self._tables = len(codes), _powers(len(codes))
        self._p = [_prefix(codes, k, self._tables) for k in (0, 1)]

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Both values of the code points from i up to j, whatever their place."""
        if not 0 <= i <= j <= self.n:
            raise IndexError(f"no span from {i} to {j} in {self.n} code points")
        return tuple((int(p[j]) - int(p[i])) * int(self._tables[2 + k][i]) % PRIME for k, p in enumerate(self._p))

    def equal(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        return self.span(i, i + length) == other.span(j, j + length)

    def common_extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """How many code points from i on here and from j on in ``other`` agree, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(i, other, j, middle) else (low, middle - 1)
        return low


class Fingerprint(NamedTuple):
    n: int
    whole: int
    steps: tuple[int, ...]
    level: int
    marks: tuple[tuple[int, int, int], ...]  # place, zero bits, prefix value for the first base

    @property
    def step(self) -> int:
        return _step(self.n)

    def __str__(self) -> str:
        places = [0, *[m[0] for m in self.marks]]
        marks = ",".join(f"{z:02d}{v:08x}{p - q:x}" for (p, z, v), q in zip(self.marks, places))
        return f"{self.n:x}.{self.whole:016x}.{''.join(f'{v:08x}' for v in self.steps)}.{self.level:x}.{marks}"

    @staticmethod
    def parse(written: str) -> Fingerprint:
        n, whole, steps, level, marks = written.split(".")
        found, place = [], 0
        for m in marks.split(",") if marks else []:
            place += int(m[10:], 16)
            found.append((place, int(m[:2]), int(m[2:10], 16)))
        return Fingerprint(int(n, 16), int(whole, 16), tuple(int(steps[i : i + 8], 16) for i in range(0, len(steps), 8)), int(level, 16), tuple(found))


def _step(n: int) -> int:
    """The least power of two of which ``n`` has at most STEPS multiples."""
    step = 1
    while n // step > STEPS:
        step *= 2
    return step


def fingerprint(text: str | None) -> Fingerprint:
    """Fingerprint of a whole text of any length (null as empty), hashed a block at a time.

    A level counts the zero bits a mark needs: the least one that leaves at most MARKS marks in the whole text.
    """
    codes = code_points(text)
    n, step = len(codes), _step(len(codes))
    tables = _powers(min(n, BLOCK + WINDOW))
    prime = np.uint64(PRIME)
    level, places, values, prefixes = 0, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    steps, low, whole, ends_in = [], 0, 0, [0, 0]  # whole: the prefix at ``low``, which lies a window before the block
    for start in range(0, n, BLOCK):
        high = min(n, start + BLOCK)
        p = _prefix(codes[low:high], 0, tables)
        other = int((codes[start:high] * tables[1][: high - start] % prime).sum())
        ends_in[1] = (ends_in[1] + other * pow(BASES[1], start, PRIME)) % PRIME
        skip = max(0, start + 1 - low - WINDOW)
        forth = p[WINDOW + skip : len(p) - (high == n)]  # no mark at the end of the text
        back = p[skip : skip + len(forth)]
        own = (forth + prime - back) * tables[2][skip : skip + len(back)] % prime  # a prefix array of the block alone gives spans as well
        if low:
            p = (np.uint64(whole) + np.uint64(pow(BASES[0], low, PRIME)) * p) % prime
        at = -(-(start + 1) // step) * step
        steps.append(p[at - low :: step])
        kept = np.flatnonzero(own & np.uint64((1 << level) - 1) == 0)
        places, values = np.concatenate([places, low + WINDOW + skip + kept]), np.concatenate([values, own[kept]])
        prefixes = np.concatenate([prefixes, p[WINDOW + skip + kept]])
        if len(places) > MARKS:
            free, left = np.arange(len(places)), values  # the marks that still have zero bits enough
            while len(free) > MARKS:
                level += 1
                keep = np.flatnonzero(left & np.uint64((1 << level) - 1) == 0) if level < 32 else []
                free, left = free[keep], left[keep]
            places, values, prefixes = places[free], values[free], prefixes[free]
        low_next = max(0, high - WINDOW)
        whole, ends_in[0], low = int(p[low_next - low]), int(p[-1]), low_next
    zeros = [(v & -v).bit_length() - 1 if v else 32 for v in values.tolist()]
    return Fingerprint(n, ends_in[0] << 31 | ends_in[1], tuple(np.concatenate(steps).tolist()) if steps else (), level, tuple(zip(places.tolist(), zeros, prefixes.tolist())))


def _common_beginning(a: Fingerprint, b: Fingerprint) -> int:
    """Code points of the common beginning, to the coarser step: binary search over the prefixes, of which equal ones precede unequal ones."""
    step = max(a.step, b.step)
    x, y = a.steps[step // a.step - 1 :: step // a.step], b.steps[step // b.step - 1 :: step // b.step]
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if x[middle - 1] == y[middle - 1] else (low, middle - 1)
    return low * step


def _cuts(f: Fingerprint, level: int) -> tuple[list[int], list[int], list[int]]:
    """Places, prefixes and inverse powers of the beginning, the marks of ``level`` and the end."""
    marks = [m for m in f.marks if m[1] >= level]
    places = [0, *[m[0] for m in marks], f.n]
    table = _powers(BLOCK)[2]
    powers = [int(table[p]) if p < BLOCK else pow(INVERSES[0], p, PRIME) for p in places]
    return places, [0, *[m[2] for m in marks], f.whole >> 31], powers


def _span(cuts: tuple[list[int], list[int], list[int]], i: int, j: int) -> tuple[int, int]:
    places, prefixes, powers = cuts
    return places[j] - places[i], (prefixes[j] - prefixes[i]) * powers[i] % PRIME


def _run(x, i: int, y, j: int, most: int) -> int:
    """The most spans from cut i of ``x`` and cut j of ``y`` on that enclose the same text; the first does. Each found extent is verified."""
    low, high = 1, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if _span(x, i, i + middle) == _span(y, j, j + middle) else (low, middle - 1)
    return low


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of both texts' code points in spans that the other has too, 0 to 1: the common beginning, and runs of spans between marks.

    Equal texts give 1 (two empty ones too), an empty and another one 0. Symmetric but for ties between repeated spans.
    """
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    lead, level = _common_beginning(a, b), max(a.level, b.level)
    x, y = _cuts(a, level), _cuts(b, level)
    where: dict[tuple[int, int], list[int]] = {}
    for j in range(len(y[0]) - 1):
        where.setdefault(_span(y, j, j + 1), []).append(j)
    taken = [False] * (len(y[0]) - 1)
    shared, i, m, n = 2 * lead, 0, len(x[0]) - 1, len(y[0]) - 1
    while i < m:
        best, at = 0, 0
        for j in where.get(_span(x, i, i + 1), ()):
            if not taken[j]:
                end = next((e for e in range(j, min(n, j + m - i)) if taken[e]), min(n, j + m - i))
                best, at = max((best, -at), (_run(x, i, y, j, end - j), -j))
                at = -at
        if best:
            taken[at : at + best] = [True] * best
            shared += max(0, x[0][i + best] - max(x[0][i], lead)) + max(0, y[0][at + best] - max(y[0][at], lead))
        i += max(best, 1)
    return min(1.0, shared / (a.n + b.n))


def fingerprints(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` of every whole text (null as empty); a column of that name is replaced."""
    docs = docs.drop("fingerprint")
    schema = docs.limit(0).withColumn("fingerprint", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([str(fingerprint(t)) for t in batch.column(batch.schema.get_field_index(column)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, schema)


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as many code points of the beginning of ``after``, or all."""
    tail = len(text) // 4
    return text[: len(text) - tail] + after[:tail]


def _part(starts: list[tuple[int, int]], wide: int = 64):
    """Number of the last of the sorted ``starts`` that is not above (__k, __h): a coarse step over every 64th, then a fine one."""
    k, h = (F.lit(list(x)) for x in zip(*starts))
    upto = lambda points: F.size(F.filter(points, lambda s: (s["k"] < F.col("__k")) | ((s["k"] == F.col("__k")) & (s["h"] <= F.col("__h")))))
    points = F.arrays_zip(k.alias("k"), h.alias("h"))
    coarse = F.greatest(upto(F.arrays_zip(F.lit([s[0] for s in starts[::wide]]).alias("k"), F.lit([s[1] for s in starts[::wide]]).alias("h"))) - 1, F.lit(0)) * wide
    return F.greatest(coarse + upto(F.slice(points, coarse + 1, wide)) - 1, F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next of every row, for the next row in ascending doc_id.

    Rows without doc_id come first and rows that repeat one are ordered by a hash of their text; after the last row comes the first. A null text is empty.
    The rows are dealt once by ranges of that order, whose first rows are found beforehand on ids and hashes only; each range also gets the
    first row of the range after it, so texts stream past in order, with two of them held at a time. Columns but doc_id and text are dropped.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"__k": F.coalesce("doc_id", F.lit(-(1 << 63))), "__h": F.xxhash64("text")})
    ranges = rows.select("__k", "__h").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "__k", "__h")
    found = ranges.groupBy(F.spark_partition_id()).agg(F.min(F.struct("__k", "__h")).alias("s")).select("s.*").collect()  # one a range
    schema = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not found:
        return spark.createDataFrame([], schema)
    starts = sorted((r[0], r[1]) for r in found)
    before = spark.createDataFrame([(*s, (i - 1) % len(starts)) for i, s in enumerate(starts)], "__k long, __h long, __part int")
    borders = rows.join(F.broadcast(before), ["__k", "__h"]).dropDuplicates(["__part"]).withColumn("__border", F.lit(True))
    dealt = rows.withColumns({"__part": _part(starts), "__border": F.lit(False)}).unionByName(borders)
    dealt = dealt.repartitionById(len(starts), "__part").sortWithinPartitions("__part", "__border", "__k", "__h").select("doc_id", "text", "__border")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, held = None, [], 0
        for batch in batches:
            for doc_id, text, border in zip(*(c.to_pylist() for c in batch.columns)):
                own = fingerprint(text)
                if last:
                    changed = edited(last[1], text)
                    other = fingerprint(changed)
                    out.append((last[0], len(last[1]), changed, str(last[2]), str(other), likeness(last[2], other), likeness(last[2], own)))
                    held += len(changed)
                last = None if border else (doc_id, text, own)
                if len(out) >= 1000 or held >= 1 << 22:
                    yield _batch(out, names)
                    out, held = [], 0
        if out:
            yield _batch(out, names)

    names = [c.split()[0] for c in schema.split(", ")]
    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
