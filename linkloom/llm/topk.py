"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query, in blocks of queries. No scores are kept:
each pass counts them into a histogram per query, the bin that holds the k-th highest score
becomes the range of the next, finer histogram, and when bins are one score wide the k-th
value is known. A last pass keeps what lies above it and the smallest ids among its ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Queries in a block, bins of a histogram and candidates scored at once: they bound a task's memory.
QUERIES, BINS, ROWS = 1024, 1024, 2048


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector): without null ids, null vectors and vectors that hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).filter(F.col("id").isNotNull() & v.isNotNull() & ~bad)


def _matrices(column, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * x) as doubles) by dimension."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = np.floor(column.values.to_numpy(zero_copy_only=False) * scale)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[offsets[rows][:, None] + np.arange(size)]


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every sum is below 2**53, else in 64-bit integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("inner products of these vectors may not fit 64 bits")
    return queries.astype(np.int64) @ rows.astype(np.int64).T


class _Block:
    """Queries of one block by dimension, with the range in which each query's k-th score lies."""

    def __init__(self, ids: np.ndarray, vectors: list[list[float]], scale: int):
        column = pa.array(vectors, pa.list_(pa.float64()))
        self.ids = ids
        self.by_size = {m.shape[1]: (rows, m) for rows, m in _matrices(column, scale)}
        self.low = np.zeros(len(ids), np.int64)
        self.width = np.ones(len(ids), np.int64)
        self.scale = scale

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query rows, candidate ids in order, scores, whether each is the query's own row)."""
        ids = batch.column(0).to_numpy()
        for rows, matrix in _matrices(batch.column(1), self.scale):
            if matrix.shape[1] not in self.by_size:
                continue
            mine, queries = self.by_size[matrix.shape[1]]
            order = np.argsort(ids[rows], kind="stable")
            rows, matrix = rows[order], matrix[order]
            for i in range(0, len(rows), ROWS):
                part = ids[rows[i : i + ROWS]]
                yield mine, part, _scores(queries, matrix[i : i + ROWS]), self.ids[mine][:, None] == part[None, :]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k candidates with the highest integer inner product for each query.

    A component x counts as floor(scale * x). Candidates are all usable rows of ``vectors``
    but those with the query's id; ties go to the smaller id; a query with fewer candidates
    gets all of them. Rows with a null id, a null vector, or null or non-finite components
    take no part, nor do candidates of another dimension than the query's. Of query rows
    with one id the least vector is asked; candidate rows that repeat an id each count.
    Returns query_id, rank (from 1), id, score. Empty tables give no rows; other columns of
    the inputs are not read, so their names never clash.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    candidates = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-asked.count() // (QUERIES * 3 // 4)))
    asked = scratch.save(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "queries")
    parts = []
    for b in range(blocks):
        rows = asked.filter(F.col("block") == b).orderBy("id").collect()  # QUERIES or about so many
        if rows:
            block = _Block(np.array([r["id"] for r in rows], np.int64), [r["vector"] for r in rows], scale)
            parts.append(scratch.save(_select(spark, candidates, block, k), f"block-{b}"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _select(spark, candidates: DataFrame, block: _Block, k: int) -> DataFrame:
    n = len(block.ids)
    shared = spark.sparkContext.broadcast(block)

    def extremes(batches):
        low, high, count = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int64)
        for batch in batches:
            for mine, _, scores, own in shared.value.scored(batch):
                count[mine] += (~own).sum(1)
                low[mine] = np.minimum(low[mine], np.where(own, low[mine][:, None], scores).min(1))
                high[mine] = np.maximum(high[mine], np.where(own, high[mine][:, None], scores).max(1))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (np.arange(n), low, high, count)], ["q", "low", "high", "n"])

    low, high, there = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in candidates.mapInArrow(extremes, "q long, low long, high long, n long").groupBy("q").agg(F.min("low"), F.max("high"), F.sum("n")).collect():
        low[r[0]], high[r[0]], there[r[0]] = r[1], r[2], r[3]
    want = np.minimum(there, k)  # rank, from the top, of the score that is looked for in [low, high]
    while (open_ := (want > 0) & (high > low)).any():
        width = np.maximum(1, -(-(high - low + 1) // BINS))
        ranges = spark.sparkContext.broadcast((low, high, width, open_))

        def count(batches, ranges=ranges):
            low, high, width, open_ = ranges.value
            seen = np.zeros(n * BINS, np.int64)
            for batch in batches:
                for mine, _, scores, own in shared.value.scored(batch):
                    inside = (scores >= low[mine][:, None]) & (scores <= high[mine][:, None]) & ~own & open_[mine][:, None]
                    q, c = np.nonzero(inside)
                    seen += np.bincount(mine[q] * BINS + (scores[q, c] - low[mine[q]]) // width[mine[q]], minlength=n * BINS)
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(some // BINS), pa.array(some % BINS), pa.array(seen[some])], ["q", "bin", "n"])

        histogram = candidates.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        wanted = F.broadcast(spark.createDataFrame([(int(i), int(want[i])) for i in np.flatnonzero(open_)], "q long, want long"))
        found = histogram.withColumn("upto", above).join(wanted, "q").filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
        for r in found.collect():  # a row for each query of the block
            q = r["q"]
            low[q] += r["bin"] * width[q]
            high[q] = min(high[q], low[q] + width[q] - 1)
            want[q] = r["want"] - (r["upto"] - r["n"])
    threshold = spark.sparkContext.broadcast((low, there))

    def keep(batches):
        low, there = threshold.value
        for batch in batches:
            for mine, ids, scores, own in shared.value.scored(batch):
                least = low[mine][:, None]
                tie = (scores == least) & ~own
                hit = ((scores > least) & ~own) | (tie & (np.cumsum(tie, 1) <= k))
                q, c = np.nonzero(hit & (there[mine] > 0)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.ids[mine[q]]), pa.array(ids[c]), pa.array(scores[q, c])], ["query_id", "id", "score"])

    # A batch leaves at most k ties a query and the fewer than k scores above them.
    kept = candidates.mapInArrow(keep, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
