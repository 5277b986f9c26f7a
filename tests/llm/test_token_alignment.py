"""Token alignment against a plain version that compares the byte ranges of all neighbouring tokens."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from millwright.llm import token_alignment as T
from millwright.llm.common import tokenizer_path
from millwright.llm.queries import QUERIES
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"
FILES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "▁ x", "  two  spaces ", "\n\t\r\n", "<|endoftext|> and <s> </s>", "naïve café 🙂🙂", "日本語のテキスト", "\0nul", "x" * 3000, " " * 700 + "x",
    "tab\tand nbsp", "１２ ﬁ", "á é", "don't won't", "word " * 500,
]


@pytest.fixture(scope="module")
def plain():
    """Ids by the libraries themselves and the bytes of each token."""
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    table = T._byte_letters()

    def ranges(ids, size):
        out, at = [], 0
        for i in ids:
            out.append((at, at + size(i)))
            at = out[-1][1]
        return out

    def of(text):
        if not text:
            return None
        x, y, want = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in x]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return None
        ra, rb = ranges(range(len(x)), lambda i: len(bytes_a[i])), ranges(range(len(y)), lambda i: len(bytes_b[i]))
        shared = sorted({e for _, e in ra} & {e for _, e in rb})
        links = Counter((i, j) for k, i in enumerate(x) for m, j in enumerate(y) if ra[k][0] < rb[m][1] and rb[m][0] < ra[k][1])
        parts, low = [], 0
        for high in shared:
            side = lambda ids, r: ",".join(str(i) for i, (s, e) in zip(ids, r) if low <= s and e <= high)  # noqa: B023, E731
            parts.append(f"{side(x, ra)}|{side(y, rb)}")
            low = high
        return len(x), len(y), len(shared), ";".join(parts), links

    return of


def want(rows, plain):
    made = [(i, plain(t)) for i, t in rows]
    counts = Counter()
    for _, m in made:
        if m:
            counts.update(m[4])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for i, m in made:
        if not m:
            out.append((i, 0, 0, 0, 0, "", 0, 0))
            continue
        x, y, groups, text, links = m
        best = sum(n for p, n in links.items() if counts[p] == most[p[1]])
        out.append((i, x, y, groups, sum(links.values()), hashlib.sha256(text.encode()).hexdigest(), best, sum(n * counts[p] for p, n in links.items())))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def test_query_equals_the_plain_version(spark, plain, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2500 or text is null")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_whitespace_anchor_alignment"](spark, str(tmp_path)).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == want([(r.doc_id, r.text) for r in docs.collect()], plain)


def test_odd_texts_and_both_joins(spark, plain):
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(ODD + ODD[8:10])]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, groups string, n_a int").repartition(3)
    vocabularies = T.read_vocabularies(spark, *FILES)
    expected = want(rows, plain)
    for limit in (64 << 20, 0):
        assert sorted(map(tuple, T.link_strength(docs, vocabularies, limit).select(*NAMES).collect()), key=repr) == expected
    assert T.link_strength(docs.limit(0), vocabularies).count() == 0
    nothing = T.link_strength(docs.where("text is null or text = ''"), vocabularies).collect()
    assert nothing and all(r.n_a == 0 and r.groups_sha256 == "" and r.count_sum == 0 for r in nothing)


def test_windows_are_kept_forgotten_and_the_same(monkeypatch, plain):
    files = [open(p, "rb").read() for p in FILES]
    aligner = T.Aligner(*files)
    assert aligner.a._ranks is not None
    texts = [t for t in ODD if t] * 2
    tokens = [t for t in aligner.tokenised(texts) if t]
    whole = aligner.align(tokens)
    monkeypatch.setattr(T, "MOST_KEPT", 3)
    again = [aligner.align([t])[0] for t in tokens]
    for x, y in zip(whole, again):
        assert x[:3] == y[:3] and x[3].tolist() == y[3].tolist() and x[4].tolist() == y[4].tolist()
    monkeypatch.setattr(aligner, "_packs", False)
    aligner._forget()
    assert [x[:3] for x in aligner.align(tokens)] == [x[:3] for x in whole] and not aligner.kept
    # where the file's ids are no ranks, its own library encodes
    monkeypatch.setattr(aligner.a, "_ranks", None)
    assert [x.tolist() for x, _ in aligner.tokenised(["don't stop", "naïve"])] == [x.tolist() for x, _ in T.Aligner(*files).tokenised(["don't stop", "naïve"])]
