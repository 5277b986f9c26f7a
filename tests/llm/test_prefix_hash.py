"""Fingerprints of prefix hashes against plain comparisons of characters."""

import hashlib
import random

import pytest

from millwright.llm import prefix_hash as P
from millwright.llm.queries import QUERIES
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"


def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r.doc_id, r.text or "") for r in rows)


def plain_extension(a, i, b, j):
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n


def test_spans_and_extensions_equal_plain_comparison():
    rng = random.Random(3)
    a = "".join(rng.choice("ab\0é🙂") for _ in range(900))
    b = a[:300] + "x" + a[350:] + a[:50]
    x, y = P.PrefixHashes(a), P.PrefixHashes(b)
    for _ in range(2000):
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        k = rng.randrange(min(len(a) - i, len(b) - j) + 1)
        assert x.equal(i, y, j, k) == (a[i : i + k] == b[j : j + k])
        assert x.common_extension(i, y, j) == plain_extension(a, i, b, j)
    assert x.common_extension(350, y, 301) == 550 and P.PrefixHashes(None).n == 0
    with pytest.raises(IndexError):
        x.span(5, 901)


def test_fingerprints_do_not_depend_on_blocks(spark, monkeypatch):
    for big in ("".join(t for _, t in texts(spark))[:40_000], "a" * 5000, "ab\n" * 3000, "x" * 12, "y" * 13):
        whole = P.fingerprint(big)
        for block in (997, 1000, 4096):
            monkeypatch.setattr(P, "BLOCK", block)
            assert P.fingerprint(big) == whole
        monkeypatch.setattr(P, "BLOCK", 1 << 16)
        assert P.Fingerprint.parse(str(whole)) == whole and len(whole.marks) <= P.MARKS and len(whole.steps) <= P.STEPS
        assert whole.steps == tuple(P.PrefixHashes(big).span(0, i)[0] for i in range(whole.step, len(big) + 1, whole.step))
        assert all(P.PrefixHashes(big).span(0, p)[0] == v for p, _, v in whole.marks)


def test_likeness_follows_the_shared_text(spark):
    rows = [t for _, t in texts(spark) if len(t) > 400]
    for a, b in zip(rows, rows[1:]):
        f = P.fingerprint(a)
        assert P.likeness(f, P.fingerprint(a)) == 1.0
        edit = P.edited(a, b)
        assert P.likeness(f, P.fingerprint(edit)) >= 2 * 0.75 * (len(a) - 1) / (len(a) + len(edit)) - 2 / 32
        moved = b[:100] + a + b[-100:]
        if len(set(a.split())) < 0.5 * len(a.split()):
            continue  # of a text that repeats a few words, only whole runs between marks are found elsewhere
        assert P.likeness(f, P.fingerprint(moved)) > 0.6 * 2 * len(a) / (len(a) + len(moved))
    other = "".join(random.Random(1).choice("ghijkl") for _ in range(3000))
    assert P.likeness(P.fingerprint(other), P.fingerprint("".join(random.Random(2).choice("mnopq") for _ in range(2000)))) == 0.0
    empty = P.fingerprint("")
    assert P.likeness(empty, P.fingerprint(None)) == 1.0 and P.likeness(empty, P.fingerprint("a")) == 0.0
    assert P.likeness(P.fingerprint("a" * 500), P.fingerprint("a" * 400 + "b" * 100)) > 0.75


def check(got, rows):
    """``rows``: (doc_id, text) in order; ``got``: result rows. Every row is held against its next one."""
    rows = [(i, t or "") for i, t in rows]
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        tail = len(t) // 4
        e = t[: len(t) - tail] + after[:tail]
        f, g, h = P.fingerprint(t), P.fingerprint(e), P.fingerprint(after)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), str(f), str(g), P.likeness(f, g), P.likeness(f, h)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_every_document_meets_its_next_one(spark):
    check(QUERIES["op11_prefix_hash_fingerprints"](spark, SF).collect(), texts(spark))


def test_odd_rows(spark):
    long = "\n".join(f"line {i} of many" for i in range(20_000))
    rows = [(None, "no id"), (1, None), (2, ""), (3, "abc"), (4, "abcd"), (5, long), (6, "퟿🙂é" * 9), (7, long)]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, fingerprint string, __part string, n_chars int").repartition(5)
    got = P.with_next(docs).select("doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    check([(r[0], r[1], hashlib.sha256(r[2].encode()).hexdigest(), *r[3:]) for r in got], rows)
    assert P.with_next(docs.limit(0)).count() == 0
    one = P.with_next(docs.where("doc_id = 4")).first()
    assert (one.edited_text, one.near_next) == ("abca", 1.0)
    # rows that repeat an id, and exact copies of rows: each is a row, ties in a fixed order
    twice = spark.createDataFrame([(9, t) for t in ("p" * 8, "q" * 8, "q" * 8, None)] * 3, "doc_id long, text string")
    first, again = (sorted(map(tuple, P.with_next(twice.repartition(n)).collect())) for n in (1, 4))
    assert first == again and len(first) == 12
    kept = P.fingerprints(docs)
    assert kept.columns == ["doc_id", "text", "__part", "n_chars", "fingerprint"] and {r.fingerprint for r in kept.where("doc_id in (5, 7)").collect()} == {str(P.fingerprint(long))}
