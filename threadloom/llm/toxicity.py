"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. Every window of a text is compressed with
either; what the toxic dictionary saves more than the ordinary one speaks for toxicity. The largest savings of a
document, their mean and the number of windows are calibrated to a probability on labelled documents.

The fit uses at most ``FIT_DOCS`` labelled documents of each class, of at most ``FIT_BYTES`` bytes each, the ones with
the smallest hash of their id: a sample of fixed size, whatever the size of the corpus. Scoring reads whole texts, keeps
one window in memory at a time, and needs no shuffle. Null and empty texts get the score of a text without windows.
Repeated rows get equal scores. Without labels of both classes nothing can be learnt, and every score is 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import column, map_batches, record

FIT_DOCS = 3000
FIT_BYTES = 32_768
WINDOW = 64
STRIDE = 48
LEVEL = 9
MIN_MATCH = 4
ODDS = 30
STEM = 5
LEAST_PERCENT = 2
ORDINARY_DICT = 110_000
TOXIC_DICT = 8_192
TOP = 4
N_FEATURES = TOP + 3


@dataclass(frozen=True)
class Model:
    """Dictionaries, the weights of the calibration, and the saving above which a window counts as marked."""

    ordinary: bytes
    toxic: bytes
    mark: float
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def windows(text: bytes | None):
    """Overlapping windows of the lower-cased bytes; the last one is whatever is left."""
    text = (text or b"").lower()
    for start in range(0, max(len(text) - (WINDOW - STRIDE), 1) if text else 0, STRIDE):
        yield text[start : start + WINDOW]


class Savings:
    """Bytes that the toxic dictionary saves over the ordinary one, by window.

    The toxic dictionary stands in front of the ordinary one, so that what both can express costs the same either way.
    """

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.sizes = []
        for content in (ordinary, toxic + ordinary):
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            options = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=WINDOW, dict_size=len(content), min_match=MIN_MATCH,
                write_checksum=False, write_content_size=False, write_dict_id=False,
            )
            self.sizes.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=options).compress)

    def of(self, text: bytes | None) -> np.ndarray:
        plain, toxic = self.sizes
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], np.float64)


def features(savings: np.ndarray, mark: float) -> np.ndarray:
    """The largest savings, their mean, the share of marked windows, and the number of windows as a logarithm."""
    n = len(savings)
    out = np.zeros(N_FEATURES)
    if n:
        top = np.sort(savings)[::-1][:TOP]
        out[: len(top)] = top
        out[len(top) : TOP] = top[-1]
        out[TOP:] = savings.mean(), (savings >= mark).sum() / n, np.log1p(n)
    return out


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary, or the text itself as a raw one where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\0" * 8


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge-penalised logistic fit by Newton's method with halved steps; the intercept is last and not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * w @ penalty @ w)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        size = 1.0
        while (after := loss(w + size * step)) > now and size > 1e-6:
            size /= 2
        if after > now - 1e-9:
            break
        w, now = w + size * step, after
    return w


def _telling(bad: list[bytes], plain: list[bytes]) -> list[bytes]:
    """Words to train the toxic dictionary on: those in clearly more toxic than ordinary texts, once for each text.

    A word counts once a text. It is kept when it is in ``ODDS`` times as large a share of the toxic texts, and in at
    least ``LEAST_PERCENT`` of them, or when a stem of ``STEM`` bytes is; words of unseen endings share such stems.
    """
    def shares(texts: list[bytes]) -> Counter:
        seen: Counter = Counter()
        for text in texts:
            found = set(text.lower().split())
            seen.update(found | {w[:STEM] + b"*" for w in found if len(w) > STEM})
        return seen

    toxic, usual = shares(bad), shares(plain)
    least = max(3, len(bad) * LEAST_PERCENT / 100)
    ratio = max(len(plain), 1) / max(len(bad), 1)
    good = {w for w, n in toxic.items() if n >= least and n * ratio >= ODDS * (usual[w] + 1)}
    kept = (w for text in bad for w in set(text.lower().split()) if w in good or w[:STEM] + b"*" in good)
    return [b" " + w for w in kept]


def fit(ordinary: list[bytes], toxic: list[bytes]) -> Model:
    """Learn on texts of either class.

    Half of the texts train the dictionaries, the other half calibrates, so that a dictionary never meets its own
    training text there. The toxic dictionary is trained on words that toxic texts have far more often.
    """
    halves = [(texts[::2], texts[1::2]) for texts in (ordinary, toxic)]
    (plain, plain_held), (bad, bad_held) = halves
    base = _dictionary(ORDINARY_DICT, [w for t in plain for w in windows(t)])
    words = _telling(bad, plain)
    focused = _dictionary(TOXIC_DICT, words or [w for t in bad for w in windows(t)])
    both = Savings(base, focused)
    held = [both.of(t) for t in plain_held], [both.of(t) for t in bad_held]
    mark = max(float(np.quantile(np.concatenate([np.zeros(1), *held[0]]), 0.99)), 1.0)
    x = np.array([features(s, mark) for part in held for s in part])
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    return Model(base, focused, mark, centre, scale, _logistic((x - centre) / scale, y))


def fit_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[bytes], list[bytes]]:
    """The labelled texts to learn from: none held out, at most ``FIT_DOCS`` of a class."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where("_label in (0, 1)")
    marked = marked.where(~held_out("_id")).groupBy("_id").agg(F.max("_label").alias("_label"))
    sizes = docs.select(F.col(id_col).alias("_id"), F.octet_length(text_col).alias("_size")).where(F.col("_size").between(1, FIT_BYTES))
    known = sizes.select("_id").join(marked, "_id").distinct()
    by_hash = F.xxhash64("_id")
    few = {y: [r[0] for r in known.where(F.col("_label") == y).orderBy(by_hash, "_id").limit(FIT_DOCS).select("_id").collect()] for y in (0, 1)}
    chosen = docs.sparkSession.createDataFrame([(i, y) for y, ids in few.items() for i in ids], marked.schema)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = texts.where(F.octet_length("_text").between(1, FIT_BYTES)).groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    found = sorted(rows.select("_label", "_id", "_text").collect(), key=lambda r: (r[0], str(r[1])))
    return [r[2].encode() for r in found if r[0] == 0], [r[2].encode() for r in found if r[0] == 1]


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` from 0 to 1 appended; a column of that name is replaced."""
    texts = docs.drop("score")
    schema = T.StructType([*texts.schema.fields, T.StructField("score", T.DoubleType())])

    def work(batch: pa.RecordBatch):
        scores = np.zeros(batch.num_rows)
        if model is not None:
            savings = Savings(model.ordinary, model.toxic)
            for i, text in enumerate(column(batch, text_col)):
                x = (features(savings.of(text.encode() if text else b""), model.mark) - model.centre) / model.scale
                scores[i] = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
        yield record([*batch.schema.names, "score"], [*batch.columns, pa.array(scores)])

    return map_batches(texts, work, schema)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    ordinary, toxic = fit_sample(docs, labels, label_col, id_col, text_col)
    return fit(ordinary, toxic) if len(ordinary) > 1 and len(toxic) > 1 else None
