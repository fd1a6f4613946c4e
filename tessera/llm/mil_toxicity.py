"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A linear model gives every sentence a probability; the document's
probability is their noisy-or, so that one offending sentence is enough.  The model is trained from
document labels only and then points at the sentences that carry the score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import held_out, training_sample

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (3, 4, 5)
_CACHE = 400_000


@dataclass(frozen=True)
class MilModel:
    """Hashed weights of words and word beginnings, and the bias of a sentence."""

    weights: np.ndarray
    bias: float


class _Features(dict):
    """word -> hashed ids of the word and of its beginnings; emptied once it holds too many words."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _CACHE:
            self.clear()
        parts = [(word, 1), *((word[:n], n) for n in _BEGINNINGS)]
        self[word] = made = tuple(
            xxhash.xxh64_intdigest(p.encode("utf-8", "replace"), seed) % self.size for p, seed in parts
        )
        return made


def sentences(text: str) -> list[tuple[int, int]]:
    """``(start, end)`` of the stretches between ``. ! ?`` and line ends that hold a letter."""
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(m[0])]


def _bag(text: str, features: _Features) -> tuple[np.ndarray, np.ndarray, int]:
    """Feature ids of a text, for each the number of its sentence, and the number of sentences."""
    ids: list[int] = []
    owner: list[int] = []
    found = sentences(text)
    for k, (start, end) in enumerate(found):
        before = len(ids)
        for word in _WORD.findall(text[start:end].lower()):
            ids += features[word]
        owner += [k] * (len(ids) - before)
    return np.array(ids, dtype=np.int32), np.array(owner, dtype=np.int32), len(found)


def telling(bags: list[tuple], y: np.ndarray, importance: np.ndarray, size: int, least: int = 2, deviations: float = 3.0) -> np.ndarray:
    """Which features may get a weight: those in at least ``least`` toxic texts, and in more of them,
    by ``deviations`` standard deviations of a Poisson count, than their share of all texts lets expect.

    A toxic text's other words are as many as a small sample has labels, and would be learned by heart.
    """
    toxic, expected = np.zeros(size), np.zeros(size)
    share = (importance * y).sum() / importance.sum()
    for (ids, _, _), label, weight in zip(bags, y, importance, strict=True):
        own = np.unique(ids)
        toxic[own] += label
        expected[own] += weight * share
    scale = y.sum() / max(1e-9, (importance * y).sum())  # toxic texts count once each here
    expected *= scale
    return (toxic >= least) & (toxic - expected > deviations * np.sqrt(expected))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit(
    bags: list[tuple[np.ndarray, np.ndarray, int]],
    y: np.ndarray,
    importance: np.ndarray,
    size: int,
    epochs: int,
    sparsity: float = 1e-4,
    seed: int = 7,
) -> MilModel:
    """AdaGrad on the noisy-or likelihood: log(1 - P) is minus the sum of softplus(z) over sentences.

    Each step shrinks the weights by ``sparsity``, which leaves few words with a weight.
    """
    importance = importance / importance.mean()
    weights = np.zeros(size)
    squares = np.full(size, 1e-3)
    bias, bias_square = -5.0, 1e-3
    random = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = 0.25 / (1 + epoch / 4)
        for chosen in np.array_split(random.permutation(len(bags)), max(1, len(bags) // 64)):
            ids = np.concatenate([bags[i][0] for i in chosen])
            counts = [bags[i][2] for i in chosen]
            starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
            owner = np.concatenate([bags[i][1] + s for i, s in zip(chosen, starts, strict=True)])
            total = int(sum(counts))
            if not total:
                continue
            bag = np.repeat(np.arange(len(chosen)), counts)
            z = np.bincount(owner, weights=weights[ids], minlength=total) + bias
            clean = np.bincount(bag, weights=_softplus(z), minlength=len(chosen))
            p_any = -np.expm1(-clean)
            pull = np.where(y[chosen] > 0, -np.exp(-clean) / np.maximum(p_any, 1e-9), 1.0)
            pull = pull * importance[chosen]
            by_sentence = pull[bag] / (1 + np.exp(-np.clip(z, -50, 50))) / len(chosen)
            step = np.bincount(ids, weights=by_sentence[owner], minlength=size)
            squares += step * step
            pace = rate / np.sqrt(squares)
            weights -= pace * step
            weights = np.sign(weights) * np.maximum(0.0, np.abs(weights) - sparsity * pace)
            step_b = by_sentence.sum()
            bias_square += step_b * step_b
            bias -= rate * step_b / math.sqrt(bias_square)
    return MilModel(weights.astype(np.float32), float(bias))


def train(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 4,
    remainder: int = 2,
    sample_rows: int = 2000,
    size: int = 1 << 18,
    epochs: int = 10,
) -> MilModel:
    """Learn from at most ``sample_rows`` labelled documents of each class.

    Classes are weighted back to their shares among all labels.  With no usable label of one class
    the model calls nothing toxic.
    """
    texts, y, importance = training_sample(docs, labels, "toxic", folds, remainder, sample_rows)
    if not 0 < y.sum() < len(y):
        return MilModel(np.zeros(size, dtype=np.float32), -30.0)
    features = _Features(size)
    bags = [_bag(t, features) for t in texts]
    tells = telling(bags, y, importance, size)
    return fit([(ids[tells[ids]], owner[tells[ids]], n) for ids, owner, n in bags], y, importance, size, epochs)


def score_toxicity(docs: DataFrame, model: MilModel, locate: float = 0.3) -> DataFrame:
    """``docs`` with a struct column ``toxicity``: score, n_sentences, and the offending spans.

    ``spans`` lists the ``(start, end, score)`` of sentences whose own probability is at least
    ``locate``, in text order, as character positions.  Null and empty texts, and texts without a
    letter, have no sentence: score 0 and no spans.
    """
    # 4 bytes for each of `size` weights, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "score double, n_sentences long, spans array<struct<start:int,end:int,score:double>>"

    @F.pandas_udf(kind)
    def score(texts: pd.Series) -> pd.DataFrame:
        weights, bias = shared.value.weights, shared.value.bias
        features = _Features(len(weights))
        known: dict[str, float] = {}
        rows = []
        for text in texts:
            text = text or ""
            clean, spans = 0.0, []
            found = sentences(text)
            for start, end in found:
                z = bias
                for word in _WORD.findall(text[start:end].lower()):
                    w = known.get(word)
                    if w is None:
                        if len(known) >= _CACHE:
                            known.clear()
                        w = known[word] = float(weights[list(features[word])].sum())
                    z += w
                clean += max(z, 0.0) + math.log1p(math.exp(-abs(z)))
                p = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
                if p >= locate:
                    spans.append({"start": start, "end": end, "score": p})
            rows.append((-math.expm1(-clean), len(found), spans))
        return pd.DataFrame(rows, columns=["score", "n_sentences", "spans"])

    return docs.withColumn("toxicity", score(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **training) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_sentences, n_offending)`` for each row of ``docs``.

    Rows whose doc_id is null are never held out.  Repeated rows stay repeated, empty tables give
    empty results, other columns are not read.  Equal texts get equal scores.
    """
    model = train(docs, labels, **training)
    folds, remainder = training.get("folds", 4), training.get("remainder", 2)
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        held_out("doc_id", folds, remainder).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= threshold).cast("int").alias("predicted"),
        F.col("toxicity.n_sentences").alias("n_sentences"),
        F.size("toxicity.spans").cast("long").alias("n_offending"),
    )
