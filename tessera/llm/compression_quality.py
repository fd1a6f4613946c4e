"""Quality classifier that compares how well two zstandard dictionaries compress a text.

One dictionary is built from good labelled text, one from bad.  Every text is cut into blocks, each
block is compressed under both, and the size difference per byte becomes a logistic score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, training_sample


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and a logistic curve; a few hundred kB, whatever the corpus."""

    good: bytes
    bad: bytes
    slope: float
    offset: float
    block: int

    def scorer(self):
        """A function from text to score; make one in each task, compressors can't be sent."""
        gain = _gain(self.good, self.bad, self.block)

        def score(text: str | None) -> float:
            return _sigmoid(self.slope * gain(text or "") + self.offset)

        return score


def _sigmoid(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def _blocks(text: str, block: int) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + block] for i in range(0, len(data), block)]


def _gain(good: bytes, bad: bytes, block: int):
    """Bytes per byte of text that the good dictionary saves over the bad one; 0 for no text."""

    def under(dictionary: bytes):
        return zstandard.ZstdCompressor(
            level=3,
            dict_data=zstandard.ZstdCompressionDict(dictionary),
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        ).compress

    by_good, by_bad = under(good), under(bad)

    def gain(text: str) -> float:
        parts = _blocks(text, block)
        saved = sum(len(by_bad(p)) - len(by_good(p)) for p in parts)
        return saved / max(1, sum(map(len, parts)))

    return gain


def _dictionary(texts: list[str], block: int, size: int) -> bytes:
    """A dictionary of at most ``size`` bytes from all blocks; raw text where there is too little to train on."""
    samples = [part for text in texts for part in _blocks(text, block)]
    total = sum(map(len, samples))
    if len(samples) >= 16 and total > 10 * 1024:
        try:
            return zstandard.train_dictionary(min(size, total // 8), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a weak prior, which keeps separable data finite."""
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    prior = np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weights * (p - y)) + prior @ w
        hessian = (design * (weights * p * (1 - p))[:, None]).T @ design + prior
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 3,
    remainder: int = 1,
    sample_rows: int = 1500,
    block: int = 1024,
    dictionary_bytes: int = 112_640,
) -> CompressionModel:
    """Learn from the whole texts of at most ``sample_rows`` labelled documents of each class.

    The even half of the sample makes the dictionaries, the odd half fits the curve, so the curve
    sees texts that the dictionaries have not.  With no usable label of one class every text gets
    the score 0.5.
    """
    texts, y, weights = training_sample(docs, labels, "quality", folds, remainder, sample_rows)
    sides = {}
    for label in (0, 1):
        own = [(t, w) for t, k, w in zip(texts, y, weights, strict=True) if k == label]
        sides[label] = ([t for t, _ in own[::2]], own[1::2] or own)
    if not sides[0][0] or not sides[1][0]:
        return CompressionModel(b"\n" * 8, b"\n" * 8, 0.0, 0.0, block)
    good = _dictionary(sides[1][0], block, dictionary_bytes)
    bad = _dictionary(sides[0][0], block, dictionary_bytes)
    gain = _gain(good, bad, block)
    known = [(gain(t), label, w) for label in (0, 1) for t, w in sides[label][1]]
    slope, offset = _logistic(*np.array(known, dtype=float).T)
    return CompressionModel(good, bad, slope, offset, block)


def score_quality(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """``docs`` with one more column, ``quality_score`` (0 to 1, higher is better).

    Whole texts are compressed block by block, so a task holds one block of one text beside the
    dictionaries.  Null and empty texts save nothing and get the curve's value at 0.
    """
    # The model's size is set by dictionary_bytes, not by the data.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        one = shared.value.scorer()
        return pd.Series([one(t) for t in texts], dtype="float64")

    return docs.withColumn("quality_score", score(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **training) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Rows whose doc_id is null are never held out (they can't be labelled either).  Repeated rows
    stay repeated, empty tables give empty results, other columns are not read.
    """
    model = train(docs, labels, **training)
    folds, remainder = training.get("folds", 3), training.get("remainder", 1)
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        held_out("doc_id", folds, remainder).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= threshold).cast("int").alias("predicted"),
    )
