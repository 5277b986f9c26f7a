"""Scores of the two classifiers recomputed plainly, a window at a time."""

import math
import random

import numpy as np
import zstandard as zstd

from millwright.llm import language_id, toxicity

TEXTS = ["", " ", "A", "Ab", "word " * 200, "Ünïcode " * 70, "x" * 700, "Mixed CASE and digits 123 " * 25, "z" * 256, "z" * 257, "tail" * 64 + "!"]


def test_pooled_responses_equal_a_plain_recomputation():
    shape = language_id.Shape(window=64, filters=3)
    net = language_id.ByteNet(["aa", "bb", "cc"], shape)
    rng = np.random.default_rng(2)
    net.bias = rng.normal(size=net.bias.shape).astype(np.float32)
    texts = [t.encode() for t in TEXTS if t]
    where, probability = language_id.predict(net, texts)
    for text, got, p in zip(texts, where, probability):
        lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in text)
        total, size = np.zeros(3), 0
        for at in range(0, len(lowered), shape.window):
            part = lowered[at : at + shape.window]
            padded = part + bytes(shape.window - len(part))
            pooled = []
            for table in net.filters:
                for f in range(shape.filters):
                    pooled.append(max(sum(float(table[k, padded[i + k], f]) for k in range(len(table))) for i in range(len(padded) - len(table) + 1)))
            z = [sum(max(0.0, x + float(b)) * float(w) for x, b, w in zip(pooled, net.bias, net.dense[:, c])) + float(net.offset[c]) for c in range(3)]
            log_sum = math.log(sum(math.exp(v - max(z)) for v in z)) + max(z)
            total += len(part) * np.array([v - log_sum for v in z])
            size += len(part)
        mean = total / size
        plain = np.exp(mean - mean.max())
        plain /= plain.sum()
        assert got == int(plain.argmax()) and abs(p - plain.max()) < 1e-3


def test_equal_scores_go_to_the_first_language():
    net = language_id.ByteNet(["aa", "bb"], language_id.Shape(window=32, filters=2))
    net.dense[:, 1] = net.dense[:, 0]
    where, probability = language_id.predict(net, [b"any text", b"Z" * 100])
    assert list(where) == [0, 0] and np.allclose(probability, 0.5)


def plain_windows(text):
    words = text.encode().lower().split()
    whole, out, at = b"".join(b" " + w for w in words), [], 0
    while at < len(whole):
        stop = whole.find(b" ", at + 1 + toxicity.WINDOW)
        stop = len(whole) if stop < 0 else stop
        out += [whole[i : min(i + 4 * toxicity.WINDOW, stop)] for i in range(at, stop, 4 * toxicity.WINDOW)]
        at = stop
    return out


def test_compressed_lengths_equal_a_plain_recomputation():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(80)]
    rows = [((" ".join(rng.choice(words) for _ in range(60)) + (" nastyword vileterm" * 3 if k % 5 == 0 else "")).encode(), int(k % 5 == 0)) for k in range(120)]
    model = toxicity.fit(rows)
    scorer = toxicity.Scorer(model)
    texts = [*TEXTS, *[r[0].decode() for r in rows[:20]], "nastyword vileterm", "a" * 2000 + " b " + "c d " * 100]
    params = zstd.ZstdCompressionParameters(compression_level=3, min_match=6, strategy=zstd.STRATEGY_GREEDY, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)

    def length(content, window):
        dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        return len(zstd.ZstdCompressor(dict_data=dictionary, compression_params=params).compress(window))

    for text, score in zip(texts, scorer.scores([t.encode() for t in texts])):
        parts = plain_windows(text)
        saved = [length(model.ordinary, w) - length(model.toxic, w) for w in parts] or [0]
        clear = sum(s >= 2 for s in saved)
        x = [1.0, min(max(saved), 8), min(math.log1p(clear), 4), min(math.log1p(sum(max(s, 0) for s in saved)), 5), math.log1p(len(parts)), clear / max(4, len(parts))]
        z = max(-30.0, min(30.0, sum(a * b for a, b in zip(x, model.weights))))
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-9
    assert scorer.scores([rows[0][0]])[0] > scorer.scores([rows[1][0]])[0]
