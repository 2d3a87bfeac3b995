"""What the two operators that remove repeated passages share.

A window of ``size`` values names one of the k-grams inside it, the one with the least hash
(leftmost on ties). Its content alone decides which, so equal windows name equal k-grams,
and a window can only repeat if the k-gram that it names does. Few positions are named, and
so few rows are counted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import room, sliding_argmin

#: Bits of a marker: 8 MB at any size of corpus. More repeated values than bits only mean
#: that more windows go on to the next, exact step; no window is lost.
MARKER_BITS = 26


class Marker:
    """A bitmap that travels compressed: a broadcast is written to disk by every executor."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __getstate__(self) -> bytes:
        return zlib.compress(self.bits.tobytes(), 1)

    def __setstate__(self, state: bytes) -> None:
        self.bits = np.frombuffer(zlib.decompress(state), np.uint8)


def named(grams: np.ndarray, k: int, size: int, bounds: np.ndarray, total: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(named k-gram, first window start, last window start) of the runs of windows that name the same k-gram.

    grams: hashes of the k-grams at each start; bounds: where rows begin; among: windows to
    look at, by start, where not all that fit into their row.
    """
    if total < size:
        return (np.zeros(0, np.int64),) * 3
    n = total - size + 1
    ok = room(bounds, size, total)[:n]
    if among is not None:
        ok &= among[:n]
    at = sliding_argmin(grams[: total - k + 1], size - k + 1)
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    end = ok.copy()
    end[:-1] &= ~ok[1:] | (at[1:] != at[:-1])
    first, last = np.flatnonzero(begin), np.flatnonzero(end)
    return at[first], first, last


def mark(df: DataFrame, value: str) -> Marker:
    """A bitmap of bounded size that has a bit for each of the 64-bit hashes; others may share bits."""
    index = F.pmod(F.col(value), F.lit(1 << MARKER_BITS)) + 1  # the functions count values from 1
    rows = df.groupBy(F.bitmap_bucket_number(index).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(index)).alias("bits")).collect()
    out = np.zeros(1 << (MARKER_BITS - 3), np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Marker(out)


def marked(marker: Marker, hashes: np.ndarray) -> np.ndarray:
    index = (hashes & np.uint64((1 << MARKER_BITS) - 1)).astype(np.int64)
    return (marker.bits[index >> 3] >> (index & 7).astype(np.uint8)) & 1 > 0


def part_of(text: Column) -> Column:
    """Tells apart different texts under one id, so that spans found in one aren't cut from another."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def covered(starts: np.ndarray, ends: np.ndarray, total: int) -> np.ndarray:
    """Which of the positions lie in one of the spans."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def small(batches, text: int):
    """The batches in slices of at most CHUNK bytes of the text column, or one row."""
    from ._text import chunks

    for b in batches:
        for first, last, _, _ in chunks(b.column(text)):
            yield b.slice(first, last - first)


def cut_spans(docs: DataFrame, spans: DataFrame, bits: Marker, cut, schema: str) -> DataFrame:
    """``cut`` (batches of id, text and, where there can be spans, starts and ends, to batches of schema) over all documents.

    docs: id, text; spans: id, part, starts[, ends]. Only texts whose id is marked in bits are
    shuffled to meet their spans; the others are cut where they are read, by the same worker
    that tells them apart, so that a task never has two.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def with_mark(batches, wanted: bool):
        from ._text import mix

        for b in small(batches, 1):
            ids = b.column(0)
            hit = marked(shared.value, mix(ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64))) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(hit == wanted))

    def hits(batches):
        yield from with_mark(batches, True)

    def rest(batches):
        yield from cut(with_mark(batches, False))

    near = docs.mapInArrow(hits, "id long, text string").withColumn("part", part_of(F.col("text")))
    return near.join(spans, ["id", "part"], "left").drop("part").mapInArrow(cut, schema).unionByName(docs.mapInArrow(rest, schema))


def mark_ids(df: DataFrame) -> Marker:
    """The bitmap of the distinct ids of df, by their mixed value."""
    from ._text import mix, signed

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([signed(mix(b.column(0).to_numpy().view(np.uint64)))], ["h"])

    return mark(df.select("id").distinct().mapInArrow(hashed, "h long"), "h")
