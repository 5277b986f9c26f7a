"""Training-data operators against plain versions, round trips and held-out accuracy on small fixtures."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from millwright.llm import chat_format, compaction, decontaminate, language_id, line_dedup, matroska, near_dedup, sentencepiece_fst, toxicity, warc
from millwright.llm.common import tokenizer_path
from millwright.llm.queries import ORACLES, QUERIES
from tests.oracle import DATA, compare

SF = f"{DATA}/sf0.001"
DOC = "doc_id long, text string, component_id string, extra int"
LONG = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) for i in range(4000))


def documents(spark, *rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOC)


def odd(spark):
    """Nulls, empty and blank texts, a very long text, repeated rows, a null id, and columns whose names clash."""
    return documents(spark, (1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "a b"), (5, "a b"), (None, "x y z"), (7, LONG))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLES[name], SF) == ""


def plain_components(rows, words, percent=80):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    base = " ".join(f"t{i}" for i in range(60)).split()
    near = [(10_000 + k, " ".join(base[:k] + [f"edit{k}"] + base[k + 1 :])) for k in range(40)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_dedup.near_duplicate_classes(docs, near_dedup.NearDupConfig(shingle_words=2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_rows(spark):
    got = near_dedup.near_duplicate_classes(odd(spark), near_dedup.NearDupConfig(shingle_words=2)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 8 and by[7].component_id == 4 and not by[7].kept and by[5].component_id == 5
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (1, 2, 3))
    assert by[None].component_id is None and by[None].kept
    assert near_dedup.near_duplicate_classes(odd(spark).limit(0)).count() == 0


def test_near_duplicates_join_the_texts_of_one_id(spark):
    a, b, c = (" ".join(f"{t}{i}" for i in range(30)) for t in "abc")
    rows = [(5, a), (5, b), (3, a), (4, b), (8, b), (6, c), (6, ""), (2, c), (9, None), (7, "alone here"), (7, "and here too")]
    got = near_dedup.near_duplicate_classes(documents(spark, *rows), near_dedup.NearDupConfig(shingle_words=2)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (4, 3), (8, 3), (6, 2), (2, 2), (9, 9), (7, 7)}
    assert {r.doc_id for r in got if r.kept} == {3, 2, 9, 7}


def test_no_text_goes_with_a_repeated_id(spark):
    x, y, z = (" ".join(f"{t}{i}" for i in range(30)) for t in "xyz")
    rows = [(3, x), (5, x), (5, y), (9, y), (7, z), (7, z), (8, None), (8, ""), (None, x)]
    docs = documents(spark, *rows)
    cfg = near_dedup.NearDupConfig(shingle_words=2)
    classes = near_dedup.near_duplicate_classes(docs, cfg).collect()
    assert {(r.doc_id, r.component_id) for r in classes} == {(3, 3), (5, 3), (9, 3), (7, 7), (8, 8), (None, None)}
    left = near_dedup.drop_near_duplicates(docs, cfg)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(3, x), (9, y), (7, z), (8, None), (8, ""), (None, x)], key=str)
    assert near_dedup.drop_near_duplicates(docs.limit(0), cfg).count() == 0


def test_common_keys_are_joined_whole_however_large(spark):
    from millwright.llm.common import join_counted

    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [("hot", 1)] * 2 + [(f"k{i % 50}", i) for i in range(500)] + [(None, 1)], "key string, n int")
    counted = rows.groupBy("key").count().withColumnRenamed("count", "rows").where("key <> 'k7'")
    want = sorted(map(tuple, rows.join(counted, "key").select("key", "n", "rows").collect()))
    for most, limit in ((1000, 64 << 20), (10, 64 << 20), (10, 0)):
        got = join_counted(rows, counted, ["key"], "rows", most=most, limit=limit)
        assert sorted(map(tuple, got.select("key", "n", "rows").collect())) == want


def test_unfinished_components_raise(spark):
    from millwright.llm.components import connected_components

    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(links, rounds=2)
    assert {r.component for r in connected_components(links)[0].collect()} == {0}


def test_crowded_files_equal_all_pairs(spark, monkeypatch):
    """Many sets that share a file without being near, on sides of a few members each."""
    monkeypatch.setattr(near_dedup, "SIDE", 8)
    monkeypatch.setattr(near_dedup, "HELD", 5)
    common = [f"c{i}" for i in range(40)]
    rows = [(k, " ".join(common + [f"own{k // 3}x{i}" for i in range(20)] + [f"edit{k}"])) for k in range(60)]
    got = near_dedup.near_duplicate_classes(documents(spark, *rows), near_dedup.NearDupConfig(shingle_words=2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows, 2)


def test_bit_map_bound_refuses_no_link():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (5, 150, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * len(a))], rng.integers(0, 2**63, max(1, n // 12), dtype=np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            bits = np.stack([near_dedup.bit_map(x).view(np.uint64) for x in (a, b)])
            found = list(near_dedup._linkable(np.array([0, 1]), np.array([len(a), len(b)]), np.zeros(2, int), True, bits, 80))
            assert [len(i) for i, _ in found] == [1]


def test_line_dedup_of_odd_rows(spark):
    got = {r.doc_id: r for r in line_dedup.drop_repeated_chunks(odd(spark)).collect()}
    assert got[1].text is None and got[2].text == "" and got[4].text == LONG
    assert got[7].removed_lines > 3900 and len(got[7].text) < len(LONG) / 10
    assert got[5].removed_chunks == 0 and got[None].text == "x y z" and got[1].component_id == "clash"
    assert line_dedup.drop_repeated_chunks(odd(spark).limit(0)).count() == 0


def test_repeated_passages_of_two_to_five_lines_go_whole(spark):
    def lines(tag, n):
        return [f"{tag} line {i} of its own" for i in range(n)]

    rows, passages = [], {}
    for k in range(40):
        passages[k] = lines(f"passage{k}", 2 + k % 4)
        rows.append((k, "\n".join(lines(f"a{k}", k % 5) + passages[k] + lines(f"b{k}", 3))))
        rows.append((100 + k, "\n".join(lines(f"c{k}", 1 + k % 3) + passages[k] + lines(f"d{k}", k % 4))))
    rows += [(200, "same\nsame\nsame\nsame\nsame"), (201, "x\ny"), (202, "x\ny\nz"), (203, "y\nz"), (204, "p\n\n\nq"), (205, "r\n\n\ns")]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_passages(documents(spark, *rows)).collect()}
    for k in range(40):
        assert got[k].removed_lines == 0 and got[k].text == dict(rows)[k]
        assert got[100 + k].text == "\n".join(lines(f"c{k}", 1 + k % 3) + lines(f"d{k}", k % 4)) and got[100 + k].removed_lines == 2 + k % 4
    assert got[200].text == "same\nsame" and got[202].text == "z" and got[203].text == "y\nz" and got[203].removed_lines == 0  # "y\nz" of 202 is not whole any more
    assert got[204].text == "p\n\n\nq" and got[205].text == "r\n\n\ns"
    assert {x for r in got.values() for x in r.text.split("\n")} >= {x for _, t in rows for x in t.split("\n")}
    odd_rows = {r.doc_id: r for r in line_dedup.drop_repeated_passages(odd(spark)).collect()}
    assert odd_rows[1].text is None and odd_rows[4].text == LONG and odd_rows[7].text == "" and odd_rows[7].removed_lines == 4000
    assert odd_rows[None].text == "x y z" and odd_rows[1].component_id == "clash"
    assert line_dedup.drop_repeated_passages(odd(spark).limit(0)).count() == 0


def test_overlapping_passages_keep_a_whole_copy(spark):
    """Random short lines in many overlapping runs: every two-line passage of the input that went from somewhere still stands whole elsewhere."""
    import random

    rng = random.Random(7)
    rows = [(1, "aa\nbb"), (2, "aa\nbb\ncc"), (3, "bb\ncc")]
    rows += [(10 + k, "\n".join(f"line {rng.randrange(25)}" for _ in range(rng.randrange(1, 9)))) for k in range(150)]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_passages(documents(spark, *rows)).collect()}
    assert (got[2].text, got[3].text) == ("cc", "bb\ncc")
    pairs = lambda text: list(zip(text.split("\n"), text.split("\n")[1:]))
    first, repeats = {}, []
    for i, text in rows:
        for at, pair in enumerate(pairs(text)):
            d, f = first.setdefault(pair, (i, at))
            if (d, f) != (i, at) and not (d == i and at == f + 1):
                repeats.append((i, at, (d, f)))
    touched = {(i, at + k) for i, at, _ in repeats for k in (0, 1)}
    gone = {(i, at + k) for i, at, (d, f) in repeats if not {(d, f), (d, f + 1)} & touched for k in (0, 1)}
    for i, text in rows:
        assert got[i].text == "\n".join(x for at, x in enumerate(text.split("\n")) if (i, at) not in gone)
    standing = {p for r in got.values() for p in pairs(r.text)}
    for i, at, (d, f) in repeats:
        if (i, at) in gone and (i, at + 1) in gone and not {(d, f), (d, f + 1)} & touched:
            assert pairs(dict(rows)[i])[at] in standing


def test_toxicity_held_out_and_odd_rows(spark):
    sf = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels, most_toxic=400, most_ordinary=800)
    known = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2)
    rows = toxicity.score(docs.join(known.select("doc_id"), "doc_id", "left_semi"), model).join(known, "doc_id").collect()
    hit = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert hit > 0.93, hit
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    odd_rows = toxicity.score(odd(spark), model).collect()
    assert len(odd_rows) == 8 and all(r.predicted == 0 for r in odd_rows)
    assert toxicity.fit([]).weights[0] < 0
    toxic_only = toxicity.fit([(b"a b c", 1)])
    assert {r.doc_id for r in toxicity.keep_clean(odd(spark), toxic_only).collect()} == {1, 2, 3}  # texts that say nothing stay
    assert toxicity.score(odd(spark).limit(0), model).count() == 0
    ties = [toxicity.ToxicityModel(b" the", b" the", (w, 0.0, 0.0, 0.0, 0.0, 0.0), 0.5) for w in (0.0, -1e-9)]
    assert [toxicity.score(odd(spark), m).first().predicted for m in ties] == [1, 0]


def test_rare_languages_are_learned(spark):
    rows = [(i, f"alpha beta gamma {i}", "aa") for i in range(4000)] + [(10_000 + i, f"xylo zugz wyq {i}", "zz") for i in range(12)] + [(20_000, None, "aa"), (20_001, "12", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_windows(docs, most_texts=300)
    langs = [lang for lang, _ in sample]
    assert 3 <= langs.count("zz") and langs.count("aa") <= 450
    got = language_id.identify(docs, language_id.fit(sample)).collect()
    assert all(r.lang_pred == ("aa" if r.doc_id < 10_000 else "zz") for r in got if r.doc_id < 20_000)
    assert language_id.training_windows(docs.limit(0)) == [] and language_id.classify(docs.limit(0)).count() == 0


def test_language_held_out_and_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    net = language_id.fit(language_id.training_windows(docs, 700))
    rows = language_id.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in test) / len(test) > 0.95
    got = language_id.identify(documents(spark, (1, None), (2, ""), (3, "123 !"), (4, "the and of"), (5, LONG)), net).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and got[3].lang_pred == "en"
    assert language_id.identify(odd(spark), None).where("lang_pred <> 'und'").count() == 0


def test_decontamination_finds_planted_items(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    some = [(r.item_id, r.text) for r in items.orderBy("item_id").limit(10).collect()]
    filler = " ".join(f"plain{i}" for i in range(300))
    rows = [(i, f"{filler} {t.encode().upper().decode()} {filler}") for i, t in some] + [(100, filler), (101, None), (102, ""), (103, some[0][1])]
    got = decontaminate.contamination(documents(spark, *rows), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(i, i) for i, _ in some} | {(103, some[0][0])}
    assert not {r.doc_id for r in got} & {100, 101, 102}
    kept = decontaminate.decontaminate(documents(spark, *rows), items)
    assert {r.doc_id for r in kept.collect()} == {100, 101, 102} and kept.columns == ["doc_id", "text", "component_id", "extra"]
    assert decontaminate.contamination(odd(spark), items.limit(0)).count() == 0


def test_decontamination_equals_all_windows():
    import pyarrow.parquet as pq

    clean = lambda text: text.encode().translate(None, decontaminate._PUNCTUATION).lower()
    items = [(r["item_id"], clean(r["text"])) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()[:30]]
    texts = [clean(r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist() if r["text"] and len(r["text"]) < 2000][:25]
    texts += [b" ".join([*t.split()[:60], item, *t.split()[:40]]) for t, (_, item) in zip(texts, items, strict=False)]
    got = searched(items, texts)
    assert got == pytest.approx(all_windows(items, texts)) and len(got) >= 25


@pytest.mark.parametrize("length", [60, 100, 200, 300])
def test_items_with_spread_edits_are_found(length):
    import random

    rng = random.Random(length)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(k, " ".join(word() for _ in range(length)).encode()) for k in range(60)]
    texts = []
    for _, item in items:
        words = item.split()
        for at in rng.sample(range(length), length // 45):
            words[at] = word().encode()
        texts.append(b" ".join([*(word().encode() for _ in range(rng.randrange(80))), *words, *(word().encode() for _ in range(50))]))
    want = {}
    for row, (key, item) in enumerate(items):  # each text has one item only: compared with that
        want |= {(row, key): s for (_, _), s in all_windows([(key, item)], [texts[row]]).items()}
    got = searched(items, texts)
    assert got == pytest.approx(want) and len(want) > 30


def test_multi_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    queries = np.array([int(p) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 16), replace=False)) for p in prints], np.uint64)
    query, held = decontaminate.HammingIndex(prints).near(queries)
    near = np.bitwise_count(queries[:, None] ^ prints) <= decontaminate.RADIUS
    assert set(zip(query.tolist(), held.tolist(), strict=True)) == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(near))), strict=True))


def all_windows(items, texts):
    """{(row, item key): highest similarity} where it reaches 0.8, from words and their runs alone."""
    from collections import Counter

    def runs(words, n):
        return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))

    found = {}
    for row, text in enumerate(texts):
        for key, item in items:
            w, m = text.decode().split(), item.decode().split()
            n = min(5, len(m))
            best = 0.0
            for i in range(max(1, len(w) - len(m) + 1)):
                a, b = runs(m, n), runs(w[i : i + len(m)], n)
                best = max(best, (a & b).total() / max(1, (a | b).total()))
            if best >= 0.8:
                found[row, key] = best
    return found


def searched(items, texts):
    index = decontaminate.Index(items, decontaminate.Settings())
    return {(row, key): similarity for row, hits in enumerate(index.search(texts)) for key, similarity, _ in hits}


def test_shortened_items_among_neighbours_are_found():
    import random

    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(k, " ".join(word() for _ in range(15 + k % 46)).encode()) for k in range(80)]
    texts = []
    for k, item in items:
        words = item.split()
        cut = rng.randrange(max(1, len(words) // 4))
        texts.append(b" ".join(words[: len(words) - cut] if k % 2 else words[cut:]))
        texts.append(" ".join(word() for _ in range(rng.randrange(1, 60))).encode())
        middle = len(words) // 2  # a longer text, a stretch of whose window is replaced
        texts.append(b" ".join([word().encode(), *words[:middle], *[word().encode() for _ in range(cut // 2)], *words[middle + cut // 2 :], word().encode()]))
    got, want = searched(items, texts), all_windows(items, texts)
    assert got == pytest.approx(want) and 80 < len(want) < 160


def test_items_of_one_to_four_words_are_found_inside_longer_texts():
    items = [(1, b"tungsten"), (2, b"blue whale"), (3, b"the treaty of"), (4, b"four score and seven"), (5, b"five words are one run"), (6, b"six words are two whole runs")]
    filler = " ".join(f"plain{i}" for i in range(200)).encode()
    texts = [t for _, item in items for t in (item, filler + b" " + item + b" " + filler, item.rsplit(b" ", 1)[0] + b" " + filler)] + [b"score four and seven", b"whale blue"]
    got, want = searched(items, texts), all_windows(items, texts)
    assert got == pytest.approx(want) and {(3 * k + 1, k + 1) for k in range(6)} <= set(want)


def test_sentencepiece_equals_library_and_round_trips(spark):
    import sentencepiece as sp

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece_fst.read_model(spark, path)
    library = sp.SentencePieceProcessor(model_proto=model)
    texts = ["", " ", "  two  spaces ", "日本語🙂", "a\x00b\n\n", "=====", "x" * 300, LONG[:3000], "naïve café ▁mark"]
    docs = documents(spark, *enumerate(texts), (99, None))
    got = {r.doc_id: r for r in sentencepiece_fst.encode(docs, model).collect()}
    assert all(got[i].token_ids == library.encode(t) for i, t in enumerate(texts)) and got[99].n_tokens == 0
    assert all(r.round_trip for r in got.values())
    sample = spark.read.parquet(f"{SF}/documents.parquet").limit(100)
    text = {r.doc_id: r.text for r in sample.collect()}
    for r in sentencepiece_fst.encode(sample, model).collect():
        assert r.token_ids == library.encode(text[r.doc_id]) and r.round_trip
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(sample, model), model).collect()
    assert all(r.text == text[r.doc_id] for r in back)


def test_sentencepiece_of_odd_rows(spark):
    model = sentencepiece_fst.read_model(spark, tokenizer_path("piece_bpe_32k.model"))
    got = sentencepiece_fst.encode(odd(spark), model).collect()
    assert len(got) == 8 and all(r.round_trip for r in got) and sum(r.n_tokens > 0 for r in got) == 6
    assert len({tuple(r.token_ids) for r in got if r.doc_id in (4, 7)}) == 1 and len({tuple(r.token_ids) for r in got if r.doc_id == 5}) == 1
    assert sentencepiece_fst.encode(odd(spark).limit(0), model).count() == 0


def proto(*pieces, bpe, dummy_prefix=1, squeeze=1):
    """A model file of (piece, score, type)."""
    import struct

    def field(number, wire, data):
        return bytes([number << 3 | wire]) + (bytes([len(data)]) + data if wire == 2 else data)

    out = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t]))) for p, s, t in pieces)
    return out + field(2, 2, field(3, 0, bytes([2 if bpe else 1]))) + field(3, 2, field(1, 2, b"identity") + field(3, 0, bytes([dummy_prefix])) + field(4, 0, bytes([squeeze])))


SMALL = [("<unk>", 0, 2), ("▁", -3.0, 1), ("a", -3.1, 1), ("b", -3.2, 1), ("ab", -4.0, 1), ("▁a", -4.1, 1), ("ba", -4.5, 1), ("aba", -6.0, 1), ("▁ab", -6.5, 1), ("bb", -5.0, 1)]


def test_unigram_paths_are_the_least_of_all():
    from functools import lru_cache

    machine = sentencepiece_fst.Transducer(proto(*SMALL, bpe=False))
    scores = {p: s for p, s, t in SMALL if t == 1}
    ids = {p: i for i, (p, _, _) in enumerate(SMALL)}

    @lru_cache(None)
    def least(text):
        if not text:
            return 0.0
        return min([-scores[text[:n]] + least(text[n:]) for n in range(1, 4) if text[:n] in scores] or [16.5 + least(text[1:])])

    import itertools

    for n in range(1, 7):
        for text in map("".join, itertools.product("ab c", repeat=n)):
            normal = machine.normalise(text)
            assert normal == ("▁" + "▁".join(text.split()) if text.split() else "")
            got = machine.encode(text).tolist()
            names = [SMALL[i][0] if i else "?" for i in got]
            assert sum(len(x) for x in names) == len(normal)
            assert sum(-scores[x] if x != "?" else 16.5 for x in names) == pytest.approx(least(normal), abs=1e-5)
            assert set(got) <= set(ids.values())


@pytest.mark.parametrize("squeeze", [0, 1])
def test_bpe_paths_are_what_the_merges_leave(squeeze):
    import itertools

    pieces = [("<unk>", 0, 2), *[(f"<0x{b:02X}>", 0, 6) for b in range(256)], *[(p, -k - 1.0, 1) for k, (p, _, t) in enumerate(SMALL) if t == 1]]
    machine = sentencepiece_fst.Transducer(proto(*pieces, bpe=True, squeeze=squeeze))
    names = [p for p, _, _ in pieces]
    for n in range(1, 7):
        for text in map("".join, itertools.product("ab é", repeat=n)):
            normal = machine.normalise(text)
            want = [i for part in machine.context.merged(normal) for i in ([names.index(part)] if part in names else [names.index(f"<0x{b:02X}>") for b in part.encode()])]
            assert machine.encode(text).tolist() == want
            assert machine.decode(machine.encode(text)) == normal.replace("▁", " ")[1:] or not normal


def test_matroska_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "é" * 300), (4, LONG), (5, LONG)]
    got = {r.doc_id: r for r in matroska.describe(matroska.store(documents(spark, *rows))).collect()}
    for i, text in rows:
        data = (text or "").encode()
        padded = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert got[4][1:] == got[5][1:]
    media = matroska.store(documents(spark, *rows))
    table = matroska.packets(media)
    assert table.groupBy("doc_id").agg(F.sum("byte_length").alias("n")).where("n % 576 <> 0").count() == 0
    assert matroska.cue_table(media).count() >= 5
    assert matroska.parse(b"garbage").packets == []


def test_matroska_live_layout_cues_and_keyframes():
    """Segment and clusters of unknown size, cue points with several positions, block groups with and without a reference."""
    m, unknown = matroska, b"\x01" + b"\xff" * 7
    blocks = lambda k: m._uint(m.CLUSTER_TIMESTAMP, k * 1000) + b"".join(m._simple_block(1, j, 1, bytes([k, j]) * 4) for j in range(50))
    cluster = m.CLUSTER.to_bytes(4, "big") + unknown
    group = lambda *more: m._element(m.BLOCK_GROUP, m._element(m.BLOCK, b"\x81\0\x07\0" + b"frame") + b"".join(more))
    position = lambda track, at: m._element(m.CUE_POSITIONS, m._uint(m.CUE_TRACK, track) + m._uint(m.CUE_CLUSTER, at))
    cues = m._element(m.CUES, m._element(m.CUE_POINT, m._uint(m.CUE_TIME, 5) + position(1, 10) + position(2, 20)))
    body = m._TRACKS + b"".join(cluster + blocks(k) for k in range(4)) + cluster + m._uint(m.CLUSTER_TIMESTAMP, 9) + group() + group(m._uint(m.REFERENCE_BLOCK, 3)) + cues
    movie = m.parse(m._HEAD + m.SEGMENT.to_bytes(4, "big") + unknown + body)
    assert not movie.errors and len(movie.packets) == 202
    assert [p.timestamp_ns // 1_000_000 for p in movie.packets[:200]] == [k * 1000 + j for k in range(4) for j in range(50)]
    assert [p.keyframe for p in movie.packets[-2:]] == [True, False]
    assert [(track, time) for time, track, _ in movie.cues] == [(1, 5_000_000), (2, 5_000_000)]


def test_matroska_packet_tables_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    stored = matroska.store(docs).collect()
    table = {}
    for r in matroska.packets(spark.createDataFrame(stored)).collect():
        table.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in stored:
        rows, text = sorted(table[r.doc_id], key=lambda p: p.packet), texts[r.doc_id]
        frames = max(1, -(-len(text) // 576))
        assert len(rows) == frames and b"".join(bytes(r.media)[p.byte_start : p.byte_start + p.byte_length] for p in rows) == text + b"\xff" * (frames * 576 - len(text))
        assert [p.timestamp_ns for p in rows] == [k * 576 * 125_000 for k in range(frames)]
    assert matroska.describe(matroska.store(docs.limit(0))).count() == 0
    nothing = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert matroska.packets(nothing).count() == 0 and matroska.describe(nothing).first().payload_bytes == 0


@pytest.mark.parametrize(("lacing", "head"), [(1, bytes([2, 3, 255, 1])), (3, bytes([2, 0x83, 0x60, 0xFC]))])
def test_matroska_lacing(lacing, head):
    sizes = [3, 256, 5] if lacing == 1 else None
    if lacing == 3:
        first, second = 3, 3 + 0x00FC - 0x1FFF
        at, got = matroska._lace_sizes(bytes([2, 0x83, 0x81 + 62 + 4]) + bytes(20), 0, 23, 3)
        assert (at, got) == (3, [3, 3 + (1 + 62 + 4) - 63, 23 - 3 - 3 - 7]) and second < first
    else:
        at, got = matroska._lace_sizes(head + bytes(264), 0, len(head) + 264, 1)
        assert (at, got) == (len(head), sizes)


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>one</p>"), (2, "http://b/ x", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "v", LONG), (5, "v", LONG), (None, "w", "<p>one</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = warc.archive_round_trip(df).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert by[1].record_type == "revisit" and by[1].refers_to == 2 and by[2].record_type == "response" and by[3].refers_to == 4 and by[None].record_type == "response"
    for i, _, html in pages:
        data = (html or "").encode()
        assert by[i].payload_bytes == len(data) and by[i].payload_digest == warc.payload_digest(data)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_chat_collapse(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", "z"), (4, 0, "user", "z"), (5, 0, None, None), (None, 0, "user", "q")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).collect()}
    assert set(got) == {2, 4, 5}
    assert got[2].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n" and got[4].n_turns == 1
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_warc_reader_gives_large_payloads_back(spark):
    rows = [(i, f"http://x/{i}", chr(97 + i) * 3_000_000) for i in range(7)] + [(9, "http://x/9", None), (10, "http://x/0", "a" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(warc.with_revisits(pages), compaction.new_path(spark, "warc"))
    got = {r.page_id: r for r in warc.read_records(warc.normalise_archives(archives), with_payload=True).collect()}
    assert len(got) == 9 and {i: bytes(got[i].payload).decode() for i in range(1, 7)} == {i: rows[i][2] for i in range(1, 7)}
    assert bytes(got[9].payload) == b"" and got[0].record_type == "revisit" and got[0].refers_to == 10 and got[0].payload_bytes == 3_000_000


def test_compaction_keeps_rows_and_versions(spark):
    tiers = compaction.Tiers(target_bytes=1 << 16, smallest_bytes=1 << 10, least_shards=3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(12)
    table, version = compaction.shard_and_compact(docs, tiers)
    assert version > 4 and table.manifest(version).count() < table.manifest(4).count() >= 24
    assert [table.manifest(v).count() for v in range(1, 5)] == sorted({table.manifest(v).count() for v in range(1, 5)})
    want = sorted(docs.select("doc_id", "text").collect())
    assert sorted(table.read(version).select("doc_id", "text").collect()) == want == sorted(table.read(4).select("doc_id", "text").collect())
    assert table.append(docs.limit(5)) == version + 1 and table.read().count() == len(want) + 5
    live = table.manifest(version)
    with pytest.raises(RuntimeError):
        table._commit(live, version)
    assert table.version() == version + 1
    empty, v = compaction.shard_and_compact(docs.limit(0), tiers)
    assert empty.read(v, docs.schema).count() == 0


def test_of_two_racing_writers_one_fails(spark):
    from concurrent.futures import ThreadPoolExecutor

    docs = odd(spark)
    table = compaction.ShardedTable(spark, compaction.new_path(spark, "table"))
    first = table.append(docs)
    live = [table.manifest(first), table.manifest(first).limit(1)]

    def commit(rows):
        try:
            return table._commit(rows, first)
        except RuntimeError as wrong:
            return str(wrong)

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(commit, live))
    assert sorted(map(str, got))[0] == str(first + 1) and "another writer" in sorted(map(str, got))[1]
    # an empty file is no version of this table's writers: what it stands for is unknown, so nothing is built on it or beside it
    fs, path = compaction._fs(spark, f"{table.folder}/manifests/v={first + 2}")
    fs.create(path, False).close()
    with pytest.raises(RuntimeError, match="empty"):
        table.append(docs.limit(1))
    whole, version = compaction.shard_and_compact(docs)
    assert sorted(map(str, whole.read(version).collect())) == sorted(map(str, docs.collect()))


def test_a_slow_writer_loses_and_its_rows_are_not_half_seen(spark, monkeypatch):
    from millwright import work

    docs, expose = odd(spark), work._expose
    table = compaction.ShardedTable(spark, compaction.new_path(spark, "table"))
    first = table.append(docs)

    def late(*args):
        monkeypatch.setattr(work, "_expose", expose)
        assert table.version() == first and table.append(docs.limit(1)) == first + 1  # another writer commits while this one has written its content only
        return expose(*args)

    monkeypatch.setattr(work, "_expose", late)
    with pytest.raises(RuntimeError, match="another writer"):
        table.append(docs)
    assert table.version() == first + 1 and table.read().count() == docs.count() + 1
    assert table.append(docs) == first + 2 and table.read().count() == 2 * docs.count() + 1  # tried again, nothing is lost


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = pipeline.drop_toxic(spark, docs, SF)
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in clean.select("doc_id").collect()}
    assert sum(labels.get(i, 1) for i in gone) > len(gone) * 0.6
    once = pipeline.drop_near_duplicates(spark, docs, SF)
    plain = plain_components([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert {r.doc_id for r in once.select("doc_id").collect()} == {i for i, (_, c) in plain.items() if i == c}
    assert tuple(once.columns) == tuple(pipeline.drop_repeated_passages(spark, docs, SF).columns) == pipeline.COLUMNS
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    final = pipeline.run(spark, SF).collect()
    assert len(final) <= clean.count()
    blank = {r.doc_id for r in docs.collect() if not (r.text or "").strip()}
    assert all(r.n_tokens > 0 or r.doc_id in blank for r in final)


def test_pipeline_drops_what_is_whole_elsewhere_and_keeps_blank_texts(spark):
    import corpus_pipeline as pipeline

    rows = [(1, "a one\nb two\nc three"), (2, "a one\nb two\nc three"), (3, "a one\nb two\nown words"), (4, ""), (5, " \n "), (6, None), (7, "\n\n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.drop_repeated_passages(spark, docs, SF).collect()}
    assert got == {1: (rows[0][1], 19), 3: ("own words", 9), 4: ("", 0), 5: (" \n ", 3), 6: (None, 0), 7: ("\n\n", 2)}
    assert pipeline.drop_repeated_passages(spark, docs.limit(0), SF).count() == 0


def test_repeated_pairs_come_from_chunks(spark):
    """Pairs inside repeated content-defined chunks and over their borders: the very pairs that occur more than once, however far a passage reaches."""
    from collections import Counter

    lines = lambda name, n: [f"{name} line {i} of it" for i in range(n)]
    texts = ["\n".join(lines(f"a{k % 5}", 3 + k % 4) + lines(f"b{k % 3}", 5) + lines(f"c{k}", k % 3)) for k in range(40)] + ["x\nx\nx\nx", "", "one", "\n\n\n"]
    parts = line_dedup._pairs(line_dedup.chunked(documents(spark, *enumerate(texts)).select(F.col("doc_id").alias("__id"), "text")))
    every = Counter(m for r in parts.collect() for m in r["__marks"] if m is not None)
    got = [r[0] for r in line_dedup._repeated_marks(parts).collect()]
    assert len(got) == len(set(got)) and set(got) == {m for m, n in every.items() if n > 1}
    inside = {m for r in parts.collect() for c in r["__chunks"] for m in r["__marks"][c["start"] : c["start"] + c["n"] - 1]}
    assert inside & set(got) and set(got) - inside
