"""Exact top-k inner products with vector-approximation files.

Every distinct vector is stored twice: exactly, and as one byte for each component, the cell it falls
into between minus and plus the vector's largest component.  A scan of the cells bounds each score
from both sides and finds a score that the k best reach for certain; a second scan lists the
vectors whose upper bound is not below it.  Of these, exact vectors are read in the order of their
upper bounds: first a few, then those whose bound is not below the kth exact score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import discard, materialize

_CELLS = 256
_LARGEST = (1 << 63) - 1


def usable(embedding: str) -> Column:
    """True for arrays whose components are all present and finite."""
    return F.coalesce(
        F.expr(f"forall({embedding}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('infinity'))"),
        F.lit(False),
    )


def quantised(embedding: str, scale: int = 1024) -> Column:
    """``floor(scale * x)`` with x as double, in doubles: beyond 2**52 a double is whole by itself."""
    y = f"double(x) * {scale}.0D"
    return F.expr(f"transform({embedding}, x -> IF(abs({y}) < 4503599627370496.0D, double(floor({y})), {y}))")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def store(vectors: DataFrame, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """``exact(no, v, ids)`` and ``cells(no, reach, code, sole)``: the distinct vectors of ``vectors(vec_id, v)``.

    Of equal vectors only the ``k + 1`` smallest ids, each at most ``k`` times, can be among the
    ``k`` best of a query that leaves its own id out; no task gathers the others.  ``sole`` is the id
    of a vector that has only one.
    """
    copies = vectors.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("v").orderBy("vec_id")
    copies = copies.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    times = F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "n"))), lambda x: F.array_repeat(x["vec_id"], F.least(x["n"], F.lit(k)).cast("int")))
    exact = copies.groupBy("v").agg(F.flatten(times).alias("ids"))
    exact = materialize(exact.select(F.monotonically_increasing_id().alias("no"), "v", "ids"), "exact")

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch["v"], width)
            reach = np.abs(rows).max(axis=1, initial=0)
            step = np.where(reach > 0, reach / (_CELLS / 2), 1.0)
            cells = np.clip(np.floor(rows / step[:, None] + _CELLS / 2), 0, _CELLS - 1).astype(np.uint8)
            codes = pa.array([c.tobytes() for c in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["no"], pa.array(reach), codes, batch["sole"]], names=["no", "reach", "code", "sole"])

    sole = F.when(F.array_min("ids") == F.array_max("ids"), F.col("ids")[0]).alias("sole")
    cells = exact.select("no", "v", sole).mapInArrow(approximate, "no long, reach double, code binary, sole long")
    return exact, materialize(cells, "cells")


class _Bounds:
    """Lower and upper bounds of the scores of a block of queries over batches of cells."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray):
        self.queries = queries
        self.sums, self.weights = queries.sum(axis=1), np.abs(queries).sum(axis=1)
        self.order = np.argsort(ids, kind="stable")
        self.sorted = ids[self.order]

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Arrays (queries, rows); a row whose only id is the query's own is bounded by minus infinity."""
        codes = np.frombuffer(b"".join(batch["code"].to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
        reach = batch["reach"].to_numpy()
        step = np.where(reach > 0, reach / (_CELLS / 2), 1.0)
        # A component lies in its cell, the largest ones on the rim of the last: half a step from the centre.
        centre = self.queries @ (codes.T + (0.5 - _CELLS / 2)) * step
        slack = np.outer(self.weights, step * 0.5 + reach * 1e-9) + 1e-6
        low, high = centre - slack, centre + slack
        sole = batch["sole"].fill_null(np.iinfo(np.int64).min).to_numpy()
        begin, end = np.searchsorted(self.sorted, sole, "left"), np.searchsorted(self.sorted, sole, "right")
        for row in np.flatnonzero(end > begin):
            own = self.order[begin[row] : end[row]]
            low[own, row] = high[own, row] = -np.inf
        return low, high


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products row by row, cut off at 64 bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        plain = np.einsum("ij,ij->i", queries, rows)
        exact = np.einsum("ij,ij->i", np.abs(queries), np.abs(rows)) < 1 << 53
    out = np.where(exact, plain, 0).astype(np.int64)
    for k in np.flatnonzero(~exact):
        score = sum(int(a) * int(b) for a, b in zip(queries[k], rows[k], strict=True))
        out[k] = max(-_LARGEST - 1, min(_LARGEST, score))
    return out


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, query_block: int = 4096
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` largest inner products of each query.

    Queries are the rows of ``vectors(vec_id, embedding)`` for which ``is_query`` holds, candidates
    all rows with another vec_id.  Components become ``floor(scale * x)``; scores are their exact
    inner products, ties go to the smaller vec_id, ranks start at 1.

    Vectors that are null, or hold a null or a non-finite component, and rows without vec_id take
    no part; nor do vectors that are no longer finite once scaled.  Vectors of different lengths are
    compared as if padded with zeros.  A query row that is repeated counts once; a repeated
    candidate row counts as often as it occurs.  Fewer than ``k`` candidates give fewer rows, an
    empty table gives none.  Scores beyond 64 bits count as the largest or smallest 64-bit number.

    Queries go to the tasks in blocks of about ``query_block``, whatever their number; a block is the
    only thing broadcast.  Candidates are stored once; a block scans their cells twice.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = base.filter(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", quantised("embedding", scale).alias("v"), "asks")
    base = base.filter(usable("v"))
    queries = materialize(base.filter("asks").select("vec_id", "v").distinct(), "queries")
    width, asking = base.agg(F.max(F.size("v"))).first()[0] or 0, queries.count()
    exact, cells = store(base.select("vec_id", "v"), width, k)
    blocks = max(1, -(-asking // query_block))
    found = None
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).orderBy("vec_id", "v").toArrow()
        rows = _matrix(own["v"].combine_chunks(), width) if len(own) else np.zeros((0, width))
        part = _block(exact, cells, own["vec_id"].to_numpy(), rows, k)
        part = part.withColumn("query_no", F.col("query_no") * blocks + b)
        if blocks > 1:
            part = materialize(part, "top")
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        discard(cells, exact)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _block(exact: DataFrame, cells: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """``(query_no, query_id, rank, vec_id, score)`` for one block of queries."""
    asked = exact.sparkSession.sparkContext.broadcast((ids, queries))

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's k largest lower bounds of each query."""
        bounds = _Bounds(*asked.value)
        best = np.full((len(asked.value[0]), k), -np.inf)
        for batch in batches:
            if len(batch):
                both = np.concatenate([best, bounds.of(batch)[0]], axis=1)
                best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(best))), pa.array(list(best), pa.list_(pa.float64()))], names=["query_no", "low"])

    lows = cells.mapInArrow(lowest, "query_no long, low array<double>")
    certain = lows.select("query_no", F.explode("low").alias("low")).withColumn(
        "place", F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("low")))
    )
    # One number for each query of the block.
    floor = certain.filter(F.col("place") == k).select("query_no", "low").toPandas()
    limits = np.full(len(ids), -np.inf)
    limits[floor["query_no"].to_numpy(dtype=np.int64)] = floor["low"]
    known = exact.sparkSession.sparkContext.broadcast(limits)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _Bounds(*asked.value)
        for batch in batches:
            if len(batch):
                high = bounds.of(batch)[1]
                q, row = np.nonzero((high >= known.value[:, None]) & (high > -np.inf))
                columns = [pa.array(q.astype(np.int64)), batch["no"].take(pa.array(row)), pa.array(high[q, row])]
                yield pa.RecordBatch.from_arrays(columns, names=["query_no", "no", "high"])

    order = Window.partitionBy("query_no").orderBy(F.desc("high"), "no")
    near = cells.mapInArrow(listed, "query_no long, no long, high double").withColumn("place", F.row_number().over(order))
    near = materialize(near, "near")

    def scored(wanted: DataFrame) -> DataFrame:
        """Exact vectors by number, and their scores; the query's own id is left out."""

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asking, q = asked.value
            for batch in batches:
                no = batch["query_no"].to_numpy()
                made = pa.array(_scores(q[no], _matrix(batch["v"], q.shape[1])))
                columns = [batch["query_no"], pa.array(asking[no]), made, batch["ids"]]
                yield pa.RecordBatch.from_arrays(columns, names=["query_no", "query_id", "score", "ids"])

        read = wanted.join(exact, "no").select("query_no", "v", "ids")
        done = read.mapInArrow(score, "query_no long, query_id long, score long, ids array<long>")
        return done.select("query_no", "query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")

    rank = F.row_number().over(Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id"))
    first = materialize(scored(near.filter(F.col("place") <= 2 * k)).withColumn("rank", rank).filter(F.col("rank") <= k), "first")
    # The kth exact score of each query: later vectors whose bound lies below it are not read.
    kth = first.filter(F.col("rank") == k).select("query_no", "score")
    later = near.filter(F.col("place") > 2 * k).join(kth, "query_no", "left").filter("score IS NULL OR high >= score")
    both = first.drop("rank").unionByName(scored(later.select("query_no", "no")))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k)
