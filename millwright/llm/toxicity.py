"""Toxicity by compression distance: two zstandard dictionaries, one window at a time.

Both dictionaries are trained by the zstandard trainer, each on labelled text of its class. The *ordinary* one learns from windows
spread over the ordinary texts. The *toxic* one learns from the telling places of the toxic texts: a toxic text is mostly plain
prose, so a trainer that is given whole windows fills its dictionary with plain syllables. Which places are telling is
decided by a greedy cover: word beginnings that are far more common in toxic texts than in ordinary ones, until every toxic text
has two of them or no further one earns its place; the trainer sees the bytes at their occurrences. The trained toxic content
stands before the ordinary content in the toxic dictionary, so a window's two compressed lengths differ only where toxic content shortens it.
A text's saved bytes over all its windows go through a logistic calibration fitted on the same labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import held_out, slices, text_batches

#: Windows start at a space and end before the first space after this many bytes.
WINDOW = 56
_WINDOWS = re.compile(rb"(?s) .{%d,}?(?= )| .+" % WINDOW)
#: A window without spaces (junk, CJK) is cut at this length so that none is unbounded.
_LONGEST = 4 * WINDOW
STEM_BYTES = (9, 8, 7, 6, 5)
#: Sizes of the trained dictionaries, and the bytes of a telling place that the toxic one learns from.
ORDINARY_BYTES, TOXIC_BYTES, PLACE_BYTES = 8192, 768, 8
#: What ends a trained dictionary's entropy tables: the three first repeat offsets. Its content follows.
_TABLES_END = b"\1\0\0\0\4\0\0\0\x08\0\0\0"


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    threshold: float = 0.3


def normalise(text: bytes | None) -> bytes:
    """Lower-cased (A-Z) bytes with single spaces, one before each word."""
    words = (text or b"").lower().split()
    return b" " + b" ".join(words) if words else b""


def windows(text: bytes) -> list[bytes]:
    found = _WINDOWS.findall(text)
    if any(len(w) > _LONGEST for w in found):
        found = [w[i : i + _LONGEST] for w in found for i in range(0, len(w), _LONGEST)]
    return found


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(
        compression_level=3, min_match=6, strategy=zstd.STRATEGY_GREEDY, window_log=17,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=params)


def _trained(size: int, samples: list[bytes], segment: int, steps: int = 4) -> bytes:
    """The content of a dictionary of ``size`` bytes that zstandard trains on ``samples``."""
    try:
        made = zstd.train_dictionary(size, samples, k=segment, d=6, steps=steps).as_bytes()
    except zstd.ZstdError:  # too few samples to train on: their own bytes are the dictionary
        return b"".join(samples)[-size:] or b" the"
    return made[made.index(_TABLES_END) + len(_TABLES_END) :]


def _spread(parts: list[bytes], most: int) -> list[bytes]:
    """At most ``most`` of a text's windows, evenly spread over all of it."""
    return parts if len(parts) <= most else [parts[i * len(parts) // most] for i in range(most)]


class Scorer:
    """Compressed-length features and calibrated scores of texts; one per Python worker."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self._ordinary, self._toxic = _compressor(model.ordinary).compress, _compressor(model.toxic).compress

    def features(self, text: bytes | None) -> list[float]:
        parts = windows(normalise(text))
        ordinary, toxic = self._ordinary, self._toxic
        saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in parts] or [0])
        clear = int((saved >= 2).sum())
        return [1.0, min(float(saved.max()), 8.0), min(np.log1p(clear), 4.0), min(np.log1p(np.maximum(saved, 0).sum()), 5.0), np.log1p(len(parts)), clear / max(4, len(parts))]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], dtype=float).reshape(len(texts), -1)
        return 1.0 / (1.0 + np.exp(-np.clip(x @ np.array(self.model.weights), -30, 30)))


def _stems(text: bytes) -> set[bytes]:
    words = {b" " + w for w in set(text.split())}
    return {w[:n] for w in words for n in STEM_BYTES if len(w) >= n}


def _cover(toxic: list[bytes], ordinary: list[bytes], most: int = 256) -> list[bytes]:
    """Word beginnings that mark the toxic texts, most telling first; ties go to the longer and then the larger bytes."""
    sets = [_stems(t) for t in toxic]
    seen = Counter(s for x in sets for s in x)
    n1, n0 = len(toxic), max(1, len(ordinary))
    often = {s for s, c in seen.items() if c >= max(3, 0.01 * n1)}
    plain = Counter(s for t in ordinary for s in _stems(t) & often)
    usable = {s for s in often if seen[s] / n1 >= 4 * (plain[s] + 0.5) / n0}
    sets = [x & usable for x in sets]
    need, chosen = [2] * n1, []
    while len(chosen) < most:
        gain = Counter(s for x, k in zip(sets, need, strict=True) if k > 0 for s in x)
        best = max(gain, key=lambda s: (round(gain[s] / n1 - 2 * plain[s] / n0, 4), len(s), s), default=None)
        if best is None or gain[best] / n1 - 2 * plain[best] / n0 < 0.006:
            break
        chosen.append(best)
        for i, x in enumerate(sets):
            if best in x:
                need[i] -= 1
        sets = [{s for s in x if not (s.startswith(best) or best.startswith(s))} for x in sets]
    return chosen


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(rows: list[tuple[bytes, int]], threshold: float = 0.3, share: float | None = None, per_text: int = 64, most_windows: int = 40_000) -> ToxicityModel:
    """Train both dictionaries and the calibration on (text, 0/1) rows; repeated texts count once.

    The ordinary dictionary learns from at most ``per_text`` windows of each text, spread over the whole text, and from at
    most ``most_windows`` (about) of those, again evenly spread; the telling places of toxic texts are all used. ``share`` is the
    toxic share of all labelled rows, where the sample has another one: the calibration's first weight is set right by it.

    The dictionaries come from half of the texts and the calibration from the other half, so that the calibration sees
    windows the dictionaries were not cut from. With no toxic or no ordinary row every score is the share of toxic rows.
    """
    distinct = sorted({(normalise(t), int(y)) for t, y in rows})
    toxic, ordinary = [t for t, y in distinct if y], [t for t, y in distinct if not y]
    if not toxic or not ordinary:
        share = len(toxic) / len(distinct) if distinct else 0.0
        bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return ToxicityModel(b" the", b" the", (bias, 0.0, 0.0, 0.0, 0.0, 0.0), threshold)

    def dictionaries(bad: list[bytes], plain: list[bytes]) -> tuple[bytes, bytes]:
        samples = [w for t in plain for w in _spread(windows(t), per_text)]
        content = _trained(ORDINARY_BYTES, samples[:: max(1, len(samples) // most_windows)], 32)
        telling = tuple(_cover(bad, plain))
        places = [w[:PLACE_BYTES] for t in bad for w in (b" " + x for x in t.split()) if w.startswith(telling)] if telling else []
        return content, (_trained(TOXIC_BYTES, places, PLACE_BYTES) if places else b"") + content

    order = np.random.default_rng(7).permutation(len(distinct))
    halves = [[distinct[i] for i in order[k::2]] for k in (0, 1)]
    x, y = [], []
    for fit_on, judge_on in (halves, halves[::-1]):
        bad, plain = [t for t, v in fit_on if v], [t for t, v in fit_on if not v]
        if not bad or not plain:
            bad, plain = toxic, ordinary
        scorer = Scorer(ToxicityModel(*dictionaries(bad, plain), (0.0,) * 6))
        x += [scorer.features(t) for t, _ in judge_on]
        y += [v for _, v in judge_on]
    weights = _logistic(np.array(x), np.array(y, dtype=float))
    if share is not None and 0 < share < 1:
        weights[0] += np.log(share / (1 - share)) - np.log(len(toxic) / len(ordinary))
    return ToxicityModel(*dictionaries(toxic, ordinary), tuple(weights.tolist()), threshold)


def _known(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).distinct()


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_ordinary: int = 5000, longest: int = 65_536) -> list[tuple[bytes, int]]:
    """A bounded sample of labelled rows outside the held-out fold: the first of each class by a hash of the id.

    The ids are chosen from ``labels`` alone, so that one filtered scan of ``docs`` fetches the texts; texts of more than
    ``longest`` characters are left out of the sample (never of the scoring).
    """
    known, picked = _known(labels), None
    for value, most in ((1, most_toxic), (0, most_ordinary)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", "text").where((F.length("text") <= longest) & F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")
    return [(r.text.encode("utf-8", "surrogatepass"), r.toxic) for r in rows.select("text", "toxic").toLocalIterator()]


def train(docs: DataFrame, labels: DataFrame, **sample) -> ToxicityModel:
    """Fit on :func:`training_rows`, with the toxic share of all labelled rows outside the held-out fold."""
    return fit(training_rows(docs, labels, **sample), share=_known(labels).agg(F.avg("toxic")).first()[0])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1) and predicted (1 where score >= the model's threshold).

    Every byte of every text is in a window. A null or empty text has no window and gets the calibration's base score.
    Other columns of ``docs`` are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            scores = scorer.scores(text_batches(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= model.threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, whole and with their columns, that the model does not predict toxic; ``text`` must be a column.

    Null, empty and blank texts say nothing and are kept, whatever the base score.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            texts = text_batches(batch.select([at]))
            keep = (scorer.scores(texts) < model.threshold) | np.array([not (t or b"").split(None, 1) for t in texts], bool)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """Fit on ``labels`` (see :func:`training_rows`) and score every row of ``docs``; adds the fold flag held_out."""
    model = train(docs, labels, **sample)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
