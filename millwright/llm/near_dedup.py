"""MinHash near-duplicates through a multi-index Hamming join.

A text's signature has ``chunks * width`` b-bit MinHash values. Two signatures at a distance (values that differ) of at most
``chunks * (errors + 1) - 1`` agree in some chunk up to ``errors`` values (pigeonhole), so each signature is filed once for every
chunk and every choice of the values that may differ there: equal file keys find *every* pair within that distance. With
the defaults (10 chunks of 5 values, 1 error: 50 keys of 4 values) the guaranteed distance is 19 of 50. Beyond it pairs are
still found with high probability; a pair at similarity 0.8 is missed once in 600 000.

Equal shingle sets are one class and only class representatives are compared. In a file of many members not all pairs
are formed: members are first compared with one representative, confirmed links are joined to components, and only
members of different components are then compared, until every pair that shares a key is either in one component or
compared. No pair is given up, so components equal those of comparing all pairs.
A comparison first bounds the intersection from above by two bit maps of the sets (a bit of one that the other lacks is an
element the other lacks), inside the join; pairs that may reach the wanted similarity are confirmed on the full shingle
sets: 100 * intersection >= 80 * union.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import broadcast_if_small, remove, slices, text_batches, written
from millwright.llm.components import connected_components


@dataclass(frozen=True)
class NearDupConfig:
    shingle_words: int = 5
    percent: int = 80
    chunks: int = 10
    width: int = 5
    errors: int = 1
    bits: int = 16
    seed: int = 20240611

    @property
    def values(self) -> int:
        return self.chunks * self.width

    @property
    def distance(self) -> int:
        """The distance within which every pair is found."""
        return self.chunks * (self.errors + 1) - 1


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a text, A-Z lower-cased first (bytes.split has just these separators)."""
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, one without words has none."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, _BASE + np.uint64(min(words, len(h))))
    for k in range(min(words, len(h))):
        out = _mix(out * np.uint64(0x100000001B3) + h[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray, cfg: NearDupConfig) -> np.ndarray:
    """``cfg.values`` MinHash values of ``cfg.bits`` bits each."""
    rng = np.random.default_rng(cfg.seed)
    a = rng.integers(1, 2**32, cfg.values, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, cfg.values, dtype=np.uint64).astype(np.uint32)
    least = np.full(cfg.values, 0xFFFFFFFF, np.uint32)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 1024):
        x = (low[i : i + 1024, None] * a) ^ (high[i : i + 1024, None] + b)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(axis=0), out=least)
    return (_mix(least.astype(np.uint64)) & np.uint64((1 << cfg.bits) - 1)).astype(np.int32)


def signatures(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """doc_id, n_shingles, set_lo, set_hi (a 128-bit hash of the set), sig; one row per row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, lo, hi, sig = [], [], [], []
            for text in text_batches(batch):
                s = shingle_set(text, cfg.shingle_words)
                n.append(len(s))
                lo.append(int(_mix(s).sum(dtype=np.uint64).astype(np.int64)))
                hi.append(int(np.bitwise_xor.reduce(_mix(s ^ _BASE), initial=np.uint64(0)).astype(np.int64)))
                sig.append(signature(s, cfg) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "set_lo", "set_hi", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_lo long, set_hi long, sig array<int>"
    )


#: Longs of a set's bit map. Sets of some thousand elements fill it, and then the bound refuses less, never more.
MAP_LONGS = 64
#: Members of a crowded file that are compared with each other at a time.
SIDE = 2048
#: Pairs of a group that are held before they are passed on.
HELD = 1 << 17


def bit_map(shingles: np.ndarray) -> np.ndarray:
    """A set's elements hashed to one bit each, as longs."""
    flags = np.zeros(64 * MAP_LONGS, np.uint8)
    flags[_mix(shingles + _BASE) & np.uint64(64 * MAP_LONGS - 1)] = 1
    return np.packbits(flags).view(np.int64)


def shingle_sets(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """doc_id, n (elements), bits (see :func:`bit_map`) and shingles (array of long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, cfg.shingle_words) for t in text_batches(batch)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([bit_map(x) for x in sets], pa.list_(pa.int64())),
                    pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "bits", "shingles"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, bits array<long>, shingles array<long>"
    )


def may_link(percent: int) -> F.Column:
    """Whether sets with sizes na, nb and bit maps ba, bb can reach the similarity: no pair that does is refused."""
    def lacking(x: str, y: str) -> F.Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda t, k: t + k)

    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = F.least(F.col("na") - lacking("ba", "bb"), F.col("nb") - lacking("bb", "ba"))
    return fits & (100 * both >= percent * (F.col("na") + F.col("nb") - both))


def _linkable(part: np.ndarray, n: np.ndarray, side: np.ndarray, own: bool, bits: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different parts that :func:`may_link`, some HELD pairs at a time; with ``own`` within all rows, else between the two sides."""
    set_bits = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    lefts, rights, held = [], [], 0
    rows = np.arange(len(n)) if own else np.flatnonzero(side == 0)
    for i in rows.tolist():
        others = np.arange(i + 1, len(n)) if own else np.flatnonzero(side == 1)
        others = others[part[others] != part[i]]
        others = others[100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others])]
        if not len(others):
            continue
        shared = np.bitwise_count(bits[others] & bits[i]).sum(axis=1)
        both = np.minimum(n[i] - set_bits[i] + shared, n[others] - set_bits[others] + shared)
        others = others[100 * both >= percent * (n[i] + n[others] - both)]
        lefts.append(np.full(len(others), i))
        rights.append(others)
        held += len(others)
        if held >= HELD:
            yield np.concatenate(lefts), np.concatenate(rights)
            lefts, rights, held = [], [], 0
    if held:
        yield np.concatenate(lefts), np.concatenate(rights)


def _pairs_across_parts(side: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a file (key, doc, part, size), are in different parts and may link.

    A file of many members is dealt into sides of about SIDE members, and each two sides are one group: no group is unbounded.
    """
    sides = F.ceil(F.col("size") / SIDE).cast("int")
    mine = F.pmod(F.xxhash64("doc"), F.col("sides")).cast("int")
    dealt = side.withColumn("sides", sides).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.select(
        "key", F.least("mine", "other").alias("s0"), F.greatest("mine", "other").alias("s1"), (F.col("mine") > F.col("other")).cast("int").alias("second"), "doc", "part"
    ).join(sets.select(F.col("doc_id").alias("doc"), "n", "bits"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, s0, s1, second, doc, part, n = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "s0", "s1", "second", "doc", "part", "n"))
            bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, MAP_LONGS)
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(s0) != 0) | (np.diff(s1) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                for i, j in _linkable(part[lo:hi], n[lo:hi], second[lo:hi], s0[lo] == s1[lo], bits[lo:hi], percent):
                    x, y = doc[lo:hi][i], doc[lo:hi][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], names=["a", "b"])

        for batch in batches:  # sorted by group: the last group of what is held may go on in the next batch
            if not batch.num_rows:
                continue
            kept.append(batch)
            if sum(b.num_rows for b in kept) < 4 * SIDE:
                continue
            table = pa.Table.from_batches(kept)
            key, s0, s1 = (table.column(c).to_numpy() for c in ("key", "s0", "s1"))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(s0) != 0) | (np.diff(s1) != 0)) + 1
            if len(cuts):
                yield from found(table.slice(0, int(cuts[-1])))
                table = table.slice(int(cuts[-1]))
            kept = table.to_batches()
        if kept:
            yield from found(pa.Table.from_batches(kept))

    return dealt.repartition("key", "s0", "s1").sortWithinPartitions("key", "s0", "s1").mapInArrow(run, "a long, b long").distinct()


def file_keys(cfg: NearDupConfig) -> F.Column:
    """The keys of a signature ``sig``: for each chunk, each choice of values that may differ left out."""
    keys = []
    for chunk in range(cfg.chunks):
        for kept in combinations(range(cfg.width), cfg.width - cfg.errors):
            values = [F.col("sig")[chunk * cfg.width + i] for i in kept]
            keys.append(F.xxhash64(F.lit(len(keys)), *values))
    return F.array(*keys)


def _confirmed(pairs: DataFrame, sets: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """The pairs (a, b) whose full sets reach the wanted similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.select("a", "b").join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
        .where(100 * F.col("both") >= cfg.percent * (F.col("total") - F.col("both")))
        .select("a", "b")
    )


def near_duplicate_classes(docs: DataFrame, cfg: NearDupConfig | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and kept.

    component_id is the least doc_id reachable through links, the document's own id included; kept is doc_id = component_id.
    Null, empty and blank texts have an empty set and link with nothing. Rows that repeat a doc_id are one document with
    several texts: each row is returned, all in one component. A row with a null doc_id links with nothing and has a
    null component_id and kept = true. Other columns are ignored.
    """
    cfg = cfg or NearDupConfig()
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed, signed_path = written(signatures(docs, cfg), "signatures")
    real = signed.where(F.col("doc_id").isNotNull())
    # one representative for each distinct set; its members follow by the set's hash
    classes = (
        real.where("n_shingles > 0").groupBy("set_lo", "set_hi", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    )
    filed, filed_path = written(classes.select("rep", "sig"), "representatives")
    # 1. all files with more than one member: the least and the rest
    keyed = filed.select(F.col("rep").alias("doc"), F.explode(file_keys(cfg)).alias("key"))
    heads = keyed.groupBy("key").agg(F.min("doc").alias("head"), F.max("doc").alias("tail")).where("head < tail").select("key", "head")
    members, members_path = written(keyed.join(heads, "key"), "files")
    n_docs = members.agg(F.approx_count_distinct("doc")).first()[0]
    wanted = broadcast_if_small(members.select(F.col("doc").alias("doc_id")).distinct(), int(n_docs * 1.2) + 100)
    sets, sets_path = written(shingle_sets(docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), cfg), "sets")
    a_side = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    b_side = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    may = may_link(cfg.percent)

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        return _confirmed(pairs.join(a_side, "a").join(b_side, "b").where(may).select("a", "b"), sets, cfg)

    stars = members.where("doc > head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()
    links, links_path = written(compared(stars), "links")
    parts, parts_path = connected_components(links)
    # 2. files whose members are in different components: one hashed member against those of other components
    of = parts.select(F.col("node").alias("doc"), F.col("component").alias("part"))
    placed = members.select("key", "doc").join(of, "doc", "left").select("key", "doc", F.coalesce("part", "doc").alias("part"))
    picks = placed.groupBy("key").agg(
        F.min("part").alias("p0"), F.max("part").alias("p1"), F.count("*").alias("size"),
        F.min_by(F.struct("doc", "part"), F.xxhash64("doc", "key")).alias("pick"),
    ).where("p0 < p1 and size > 16").select("key", "pick")
    again = placed.join(picks, "key").where(F.col("part") != F.col("pick.part")).select(
        F.least("doc", "pick.doc").alias("a"), F.greatest("doc", "pick.doc").alias("b")
    ).distinct()
    links2, links2_path = written(links.unionByName(compared(again)), "links")
    remove(spark, parts_path, links_path)
    parts, parts_path = connected_components(links2)
    # 3. every pair that shares a file and is still in two components
    of = parts.select(F.col("node").alias("doc"), F.col("component").alias("part"))
    placed = members.select("key", "doc").join(of, "doc", "left").select("key", "doc", F.coalesce("part", "doc").alias("part"))
    split = placed.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.count("*").alias("size")).where("p0 < p1").select("key", "size")
    rest, rest_path = written(_pairs_across_parts(placed.join(split, "key"), sets, cfg.percent), "rest")
    # 4. an id with several sets joins their classes: a link from the id to each representative
    mark = F.xxhash64("set_lo", "set_hi", "n_shingles")
    several = real.groupBy("doc_id").agg(F.min(mark).alias("m0"), F.max(mark).alias("m1")).where("m0 < m1").select("doc_id")
    several, several_path = written(several, "several")
    n_several = several.count()
    shared = real.join(broadcast_if_small(several, n_several), "doc_id", "left_semi").select("doc_id", "set_lo", "set_hi", "n_shingles")
    shared = shared.join(classes.drop("sig"), ["set_lo", "set_hi", "n_shingles"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    links3 = links2.unionByName(_confirmed(rest, sets, cfg))
    links3, links3_path = written(links3.unionByName(shared) if n_several else links3, "links")
    remove(spark, parts_path, links2_path)
    parts, _ = connected_components(links3)
    remove(spark, links3_path, members_path, sets_path, filed_path, rest_path)
    # 5. members take their class's component, and an id with several sets its own in every row, an empty one included
    label = classes.drop("sig").join(parts, F.col("rep") == F.col("node"), "left").select(
        "set_lo", "set_hi", "n_shingles", F.coalesce("component", "rep").alias("part")
    )
    rows = signed.drop("sig").join(label, ["set_lo", "set_hi", "n_shingles"], "left")
    if n_several:
        own = several.join(parts, F.col("doc_id") == F.col("node")).select("doc_id", F.col("component").alias("own"))
        rows = rows.join(broadcast_if_small(own, n_several), "doc_id", "left").withColumn("part", F.coalesce("own", "part"))
    else:
        remove(spark, several_path)
    return rows.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("part", "doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, cfg: NearDupConfig | None = None) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicate rows, whole and with its columns: that with the least doc_id.

    Rows are compared, not ids: where a doc_id has several rows, each distinct text of it is a document of its own (numbered beyond
    the largest doc_id for the comparison), so no text goes that is not near one that stays. Rows without words or without a
    doc_id all stay; rows that repeat a doc_id and its text are one.
    """
    several, path = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__rows")).where("__rows > 1").select("doc_id"), "several")
    n = several.count()
    if not n:
        remove(docs.sparkSession, path)
        extra = near_duplicate_classes(docs, cfg).where(~F.col("kept")).select("doc_id")
        return docs.join(extra, "doc_id", "left_anti")
    several = broadcast_if_small(several, n)
    last = docs.agg(F.max("doc_id")).first()[0]
    numbered = docs.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    numbered, _ = written(numbered.withColumn("__row", F.lit(last) + 1 + F.monotonically_increasing_id()), "numbered")
    rows = docs.join(several, "doc_id", "left_anti").withColumn("__row", F.col("doc_id").cast("long")).unionByName(numbered)
    extra = near_duplicate_classes(rows.select(F.col("__row").alias("doc_id"), "text"), cfg).where(~F.col("kept")).select(F.col("doc_id").alias("__row"))
    return rows.join(extra, "__row", "left_anti").select(*docs.columns)
