"""Labelled training rows: which rows may be learned from, and a bounded sample of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def held_out(id_col: str, folds: int, remainder: int) -> Column:
    return F.coalesce(fold(id_col, folds) == remainder, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, remainder: int, rows: int
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, classes (0 or 1) and weights of at most ``rows`` labelled ids of each class.

    Only ids outside the held-out fold are used.  A class's weight is the number of its labelled
    ids over the number sampled, so weighted shares are those of all labels.

    The sample is the ids with the smallest seeded hash, so it is the same for any partitioning.
    Ids with a null or with contradicting labels are left out; an id that occurs on several
    documents contributes each of them, up to ``2 * rows`` texts in all.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", folds) != remainder))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .filter("y = top")
        .select("doc_id", "y", F.xxhash64(F.lit(label), "doc_id").alias("dice"))
    )
    totals = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = ids.filter(F.col("y") == y).orderBy("dice", "doc_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * rows ids, so the broadcast is bounded by the parameter, and so is what comes back.
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(picked), "doc_id")
        .select("dice", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")
        .orderBy("dice", "doc_id", "text")
        .limit(2 * rows)
        .select("text", "y")
        .collect()
    )
    y = np.array([r["y"] for r in found], dtype=float)
    weights = np.array([totals[r["y"]] / min(rows, totals[r["y"]]) for r in found])
    return [r["text"] for r in found], y, weights
