"""Language identification with a byte convolutional network.

A text is cut into fixed-length windows of bytes (A-Z lower-cased). Filters of several widths slide over each window; a filter's
response is a sum of one learned weight row for each byte under it, so a response needs look-ups and additions only.
Each filter keeps its largest response in the window (max pooling), a rectifier and a softmax layer follow. Training is
mini-batch Adam in numpy on windows of labelled texts. A text's probabilities are the normalised geometric mean of its windows', weighted
by their bytes; every byte of every text is in a window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import held_out, slices, text_batches

UNKNOWN = "und"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Windows scored at a time: responses of that many windows stay in the processor's cache.
_AT_ONCE = 48


@dataclass(frozen=True)
class Shape:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    epochs: int = 6
    batch: int = 32
    rate: float = 0.01
    seed: int = 11


class ByteNet:
    """Parameters and passes of the network; ``langs`` are its classes in order."""

    def __init__(self, langs: list[str], shape: Shape):
        rng = np.random.default_rng(shape.seed)
        self.langs, self.shape = langs, shape
        self.filters = [rng.normal(0, 0.5, (w, 256, shape.filters)).astype(np.float32) for w in shape.widths]
        self.bias = np.zeros(len(shape.widths) * shape.filters, np.float32)
        self.dense = rng.normal(0, 0.2, (len(self.bias), len(langs))).astype(np.float32)
        self.offset = np.zeros(len(langs), np.float32)

    def pooled(self, windows: np.ndarray, with_places: bool = False):
        """Largest response of each filter in each window (and where it is); windows is (n, bytes) uint8."""
        values, places = [], []
        for table in self.filters:
            width = len(table)
            span = windows.shape[1] - width + 1
            response = table[0][windows[:, :span]]
            for k in range(1, width):
                response += table[k][windows[:, k : k + span]]
            if with_places:
                where = response.argmax(axis=1)
                places.append(where)
                values.append(np.take_along_axis(response, where[:, None, :], axis=1)[:, 0])
            else:
                values.append(response.max(axis=1))
        x = np.concatenate(values, axis=1) + self.bias
        return (x, places) if with_places else x

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.pooled(windows[i : i + _AT_ONCE]) for i in range(0, len(windows), _AT_ONCE)])
        z = np.maximum(x, 0) @ self.dense + self.offset
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, windows: np.ndarray, labels: np.ndarray) -> None:
        rng = np.random.default_rng(self.shape.seed + 1)
        params = [*self.filters, self.bias, self.dense, self.offset]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, n_filters = 0, self.shape.filters
        for _ in range(self.shape.epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), self.shape.batch):
                rows = order[i : i + self.shape.batch]
                batch, y = windows[rows], labels[rows]
                x, places = self.pooled(batch, with_places=True)
                h = np.maximum(x, 0)
                z = h @ self.dense + self.offset
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                dx = (p @ self.dense.T) * (x > 0)
                grads = []
                for k, table in enumerate(self.filters):
                    g, d = np.zeros_like(table), dx[:, k * n_filters : (k + 1) * n_filters]
                    for j in range(len(table)):  # only the bytes under each filter's best place get a gradient
                        under = np.take_along_axis(batch, places[k] + j, axis=1)
                        np.add.at(g[j], (under, np.arange(n_filters)[None, :]), d)
                    grads.append(g)
                grads += [dx.sum(axis=0), h.T @ p, p.sum(axis=0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= self.shape.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def cut(text: bytes, window: int) -> np.ndarray:
    """A text's bytes as rows of ``window`` bytes, the last one filled up with zeros; at least one row."""
    rows = max(1, -(-len(text) // window))
    out = np.zeros(rows * window, np.uint8)
    out[: len(text)] = np.frombuffer(text.translate(_LOWER), np.uint8)
    return out.reshape(rows, window)


def predict(net: ByteNet, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers and probabilities of texts; equal probabilities go to the first class (languages in order of their names)."""
    window = net.shape.window
    parts = [cut(t, window) for t in texts]
    counts = np.array([len(p) for p in parts])
    logs = net.log_probabilities(np.concatenate(parts))
    weights = np.full(len(logs), window, np.float64)
    ends = np.cumsum(counts)
    weights[ends - 1] = [max(1, len(t) - (c - 1) * window) for t, c in zip(texts, counts, strict=True)]
    total = np.add.reduceat(logs * weights[:, None], ends - counts, axis=0)
    mean = total / np.add.reduceat(weights, ends - counts)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return best, p[np.arange(len(best)), best]


def training_windows(
    docs: DataFrame, most_texts: int = 3000, per_text: int = 3, window: int = 256, most_langs: int = 200
) -> list[tuple[str, bytes]]:
    """(lang, window) of a bounded sample of labelled texts with a letter, outside the held-out fold.

    Each of the ``most_langs`` commonest languages gives its first ``most_texts / languages`` texts by a hash of the id, so a rare
    one is learned too. ``per_text`` stretches of up to ``window`` characters of a text come from places spread over it by
    the same hash. A first scan reads labels only and sets, for each language, the hash below which twice the wanted texts
    are expected; so what the second one returns does not grow with the input.
    """
    text, size, hashed = F.col("text"), F.length("text"), F.xxhash64("doc_id")
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs)
    counts = {r.lang: r.n for r in counted.collect()}
    if not counts:
        return []
    each = max(1, most_texts // len(counts))
    below = [(lang, min(2**63 - 1, int(min(1.0, (2 * each + 50) / n) * 2**64) - 2**63)) for lang, n in sorted(counts.items())]
    below = docs.sparkSession.createDataFrame(below, "lang string, below long")
    shift = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.lit(1), F.floor(size / per_text) - window)) + 1
    stretches = F.array(*[F.substring(text, (shift + F.floor(size * k / per_text)).cast("int"), F.lit(window)) for k in range(per_text)])
    first = Window.partitionBy("lang").orderBy("hashed", "doc_id", "parts")
    rows = (
        known.join(F.broadcast(below), "lang").where((hashed <= F.col("below")) & text.rlike(r"\p{L}"))
        .select("doc_id", "lang", hashed.alias("hashed"), stretches.alias("parts"))
        .withColumn("place", F.row_number().over(first)).where(F.col("place") <= each).orderBy("lang", "place")
    )
    return [(r.lang, p.encode("utf-8", "surrogatepass")) for r in rows.collect() for p in r.parts if p]


def fit(samples: list[tuple[str, bytes]], shape: Shape | None = None) -> ByteNet | None:
    """A trained network, or None where there is nothing to learn from; repeated windows count once."""
    shape = shape or Shape()
    distinct = sorted(set(samples), key=lambda s: (zlib.crc32(s[1]), s))
    if not distinct:
        return None
    langs = sorted({lang for lang, _ in distinct})
    net = ByteNet(langs, shape)
    if len(langs) > 1:
        windows = np.concatenate([cut(t[: shape.window], shape.window)[:1] for _, t in distinct])
        net.train(windows, np.array([langs.index(lang) for lang, _ in distinct]))
    return net


def _groups(rows: Iterable[int], texts: list[bytes]) -> Iterator[list[int]]:
    """Rows in groups of at most 256 and of about four megabytes of text; a longer text is a group of its own."""
    some, total = [], 0
    for row in rows:
        if some and (len(some) == 256 or total + len(texts[row]) > 4 << 20):
            yield some
            some, total = [], 0
        some.append(row)
        total += len(texts[row])
    if some:
        yield some


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned. Columns other than
    doc_id and text are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores = np.array([UNKNOWN] * batch.num_rows, object), np.zeros(batch.num_rows)
            texts = text_batches(batch)
            known = np.flatnonzero(np.array(batch.column(2).to_pylist(), bool)) if net is not None else []
            for rows in _groups(known, texts):
                best, p = predict(net, [texts[r] for r in rows])
                langs[rows], scores[rows] = np.array(net.langs, object)[best], p
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")
    return docs.select("doc_id", "text", lettered).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def classify(docs: DataFrame, shape: Shape | None = None, **sample) -> DataFrame:
    """Fit on the labelled texts of ``docs`` outside the held-out fold, and predict every row; adds the fold flag held_out."""
    net = fit(training_windows(docs, window=(shape or Shape()).window, **sample), shape)
    return identify(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
