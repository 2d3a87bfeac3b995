"""The most similar vector of another id, by matrix products in Arrow batches.

Left rows are dealt into chunks, and every right row goes to each chunk, after the chunk's left
rows and in order of its id. A product in single precision leaves only the pairs whose score may
be the highest; those are scored again with sums in order, as the SQL does, and rounded.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components in a chunk's left side, left and right rows of one product, and pairs scored again at once: they bound a task's memory.
VALUES, ROWS, COLS, PAIRS = 1 << 21, 4096, 2048, 1 << 16
#: Rows from which on another chunk is worth a task.
LEAST = 1024


def _matrices(column):
    """(rows, their vectors) by dimension; without null vectors and those that hold nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, values = column.offsets.to_numpy(), column.values
    nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    values = values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (nulls[offsets[1:]] == nulls[offsets[:-1]])
    for size in np.unique(sizes[whole]):
        rows = np.flatnonzero(whole & (sizes == size))
        yield rows, values[offsets[rows][:, None] + np.arange(size)]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the columns of both, each summed in order."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b):
        out += x * y
    return out


class _Vectors:
    """Vectors by column, squared norms, and unit vectors in single precision; odd: their scores need the exact sums."""

    def __init__(self, matrix: np.ndarray):
        with np.errstate(all="ignore"):
            self.columns = np.ascontiguousarray(matrix.T)
            self.squares = _dots(self.columns, self.columns)
            norm = np.sqrt(self.squares)
            self.odd = ~(np.isfinite(matrix).all(1) & (((norm > 1e-100) & (norm < 1e100)) | ~matrix.any(1)))
            unit = matrix / np.where(self.odd | (norm == 0), 1.0, norm)[:, None]
            self.unit = np.where(self.odd[:, None], 0.0, unit).astype(np.float32)


def _scores(a: _Vectors, rows: np.ndarray, b: _Vectors, cols: np.ndarray) -> np.ndarray:
    """Cosines rounded to six places, halves away from zero; 0 where a norm is 0."""
    with np.errstate(all="ignore"):
        x, y = a.squares[rows], b.squares[cols]
        norms = np.sqrt(x * y)
        norms = np.where((norms == 0) | np.isinf(norms), np.sqrt(x) * np.sqrt(y), norms)
        score = np.where(norms == 0, 0.0, _dots(a.columns[:, rows], b.columns[:, cols]) / norms)
        millions = np.abs(score) * 1e6
        whole = np.floor(millions)
        return np.copysign(whole + (millions - whole >= 0.5), score) / 1e6 + 0.0


class _Chunk:
    """Left rows with the best right row of each so far: score (null: -inf, nan: inf) and id."""

    def __init__(self, ids: list, column):
        self.ids = ids
        self.own = defaultdict(list)
        for i, x in enumerate(ids):
            self.own[x].append(i)
        self.sides = {m.shape[1]: (rows, _Vectors(m)) for rows, m in _matrices(column)}
        self.best = np.full(len(ids), -np.inf)
        self.found = np.full(len(ids), None, object)

    def meet(self, ids: list, column) -> None:
        """Right rows, in order of their ids from one call to the next."""
        for x in ids[: 2 if len(set(ids[:2])) == 2 else len(ids)]:  # for rows that nothing has a score with
            free = self.found == None  # noqa: E711
            if not free.any():
                break
            free[self.own.get(x, [])] = False
            self.found[free] = x
        names = np.empty(len(ids), object)
        names[:] = ids
        for at, matrix in _matrices(column):
            if matrix.shape[1] not in self.sides:
                continue
            rows, a = self.sides[matrix.shape[1]]
            place = np.full(len(self.ids), -1)
            place[rows] = np.arange(len(rows))
            for x in range(0, len(at), COLS):
                b = _Vectors(matrix[x : x + COLS])
                names_b = names[at[x : x + COLS]]
                own = [(place[i], j) for j, name in enumerate(names_b) for i in self.own.get(name, ()) if place[i] >= 0]
                own = np.array(own, np.int64).reshape(-1, 2)
                for y in range(0, len(rows), ROWS):
                    self._tile(rows, a, y, b, names_b, own)

    def _tile(self, rows: np.ndarray, a: _Vectors, y: int, b: _Vectors, names: np.ndarray, own: np.ndarray) -> None:
        unit, slack = a.unit[y : y + ROWS], (len(a.columns) + 8) * 2.0**-22  # four times what single precision can lose
        near = unit @ b.unit.T
        odd = a.odd[y : y + ROWS][:, None] | b.odd
        mine = own[(own[:, 0] >= y) & (own[:, 0] < y + ROWS)]
        near[mine[:, 0] - y, mine[:, 1]] = -3
        best = self.best[rows[y : y + ROWS]]
        # A later id must have a higher score, and the highest of this tile is off by the slack and the rounding.
        top = np.where(odd, -3, near).max(1) if odd.any() else near.max(1)
        least = np.maximum(top - 2e-6 - 2 * slack, np.where(np.isneginf(best), -2, best + 4e-7 - slack))
        least = np.where(np.isposinf(best), 9, np.maximum(least, -2)).astype(np.float32)[:, None]
        q, c = np.nonzero((near >= least) | (odd & (near > -2) & (least < 9)) if odd.any() else near >= least)
        for i in range(0, len(q), PAIRS):
            r, k = q[i : i + PAIRS], c[i : i + PAIRS]
            score = _scores(a, r + y, b, k)
            score = np.where(np.isnan(score), np.inf, score)
            order = np.lexsort((k, -score, r))
            first = order[np.concatenate([[True], np.diff(r[order]) > 0])]
            to = rows[r[first] + y]
            better = score[first] > self.best[to]
            self.best[to[better]] = score[first][better]
            self.found[to[better]] = names[k[first][better]]


def _tops(batches):
    """Batches of (chunk, side, id, vec), by chunk, then the left side, then the right one by id."""
    now, left, chunk = None, [], None

    def begun():
        return _Chunk([x for b in left for x in b.column(2).to_pylist()], pa.chunked_array([b.column(3) for b in left]))

    def ended():
        some = [i for i, x in enumerate(chunk.found) if x is not None]
        score = np.where(np.isposinf(chunk.best), np.nan, chunk.best)[some]
        kind = left[0].column(2).type
        return pa.RecordBatch.from_arrays([pa.array([chunk.ids[i] for i in some], kind), pa.array([chunk.found[i] for i in some], kind), pa.array(score, mask=np.isneginf(score))], ["l_id", "r_id", "score"])

    for whole in batches:
        chunks, sides = (whole.column(i).to_numpy() for i in (0, 1))
        cuts = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(sides) != 0)) + 1
        for x, y in zip([0, *cuts], [*cuts, len(chunks)]):
            if y == x:
                continue
            part = whole.slice(x, y - x)
            if chunks[x] != now:
                if chunk:
                    yield ended()
                now, left, chunk = chunks[x], [], None
            if sides[x] == 0:
                left.append(part)
            elif left:
                chunk = chunk or begun()
                chunk.meet(part.column(2).to_pylist(), part.column(3))
    if chunk:
        yield ended()


def top1(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id, score) of (id, vec): the highest cosine with another id, rounded to six places, ties to the smaller id.

    A score is null where a vector is null, holds a null or has another dimension, and counts below all others; one with a
    component that isn't finite is nan and counts above. Rows without an id take no part.
    """
    kinds = [d.schema["id"].dataType for d in (left, right)]
    a, b = (d.filter(F.col("id").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec")) for d in (left, right))
    n, size = a.agg(F.count("*"), F.max(F.size("vec"))).first()
    rows = max(LEAST, VALUES // max(size or 1, 1))
    chunks = max(1, -(-n // rows), min(a.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST)))
    dealt = a.select(F.pmod(F.xxhash64("id", "vec"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(0).alias("side"), "id", "vec")
    every = b.select(F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(1).alias("side"), "id", "vec")
    both = dealt.union(every).repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", "side", "id")
    kind = both.schema["id"].dataType.simpleString()
    found = both.mapInArrow(_tops, f"l_id {kind}, r_id {kind}, score double")
    less = F.when(F.isnan("score"), float("-inf")).otherwise(-F.col("score"))
    best = found.groupBy("l_id").agg(F.max("score").alias("score"), F.min(F.struct(F.col("score").isNull().alias("none"), less.alias("less"), "r_id")).alias("m"))
    return best.select(F.col("l_id").cast(kinds[0]).alias("l_id"), F.col("m.r_id").cast(kinds[1]).alias("r_id"), "score")
