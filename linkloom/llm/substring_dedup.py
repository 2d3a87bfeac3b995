"""Removal of word windows that earlier documents hold, found by level-wise doubling.

Level by level the length doubles up to the full window (13, 25 and 50 words for 50). At
each level a window stands for itself by the k-gram it names (see ``_repeats``), k being the
level's length. Only windows whose k-gram several documents hold are extended to twice the
length; the last level counts the whole windows that survived. No level drops a window that
repeats, and each reads all texts again, so no table of positions is carried along. Rows of
hot windows meet their first document by a broadcast of bounded size, all others by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import Marker, covered, cut_spans, mark, mark_ids, marked, named, part_of, runs, small
from ._scratch import Scratch
from ._text import Words, chunks, prefix_sums, room, signed, window_hashes

#: The shortest level.
LEAST = 12
#: A window is hot if it holds more than one in so many of the rows; there are fewer hot windows than this.
HOT = 10_000


def levels(size: int) -> list[int]:
    """Lengths that double up to ``size``: 13, 25, 50 for 50."""
    out = [size]
    while out[0] >= 2 * LEAST:
        out.insert(0, -(-out[0] // 2))
    return out


def _survivors(sums: np.ndarray, words: Words, size: int, lengths: list[int], markers: list[Marker]) -> np.ndarray | None:
    """By start, the windows whose named k-gram is marked at every level so far."""
    among = None
    for k, bits in zip(lengths, markers):
        grams = window_hashes(sums, k)
        at, first, last = named(grams, k, size, words.bounds, len(words), among)
        keep = marked(bits, grams[at])
        among = covered(first[keep], last[keep] + 1, len(words))
    return among


def repeated_words(docs: DataFrame, size: int = 50) -> DataFrame:
    """(id, part, start): starts, in words, of windows whose words also start in a document with a smaller id.

    docs: id long, text string. Rows with null ids take no part.
    """
    spark = docs.sparkSession
    own = docs.filter(F.col("id").isNotNull()).select("id", "text", part_of(F.col("text")).alias("part"))
    lengths, markers = levels(size), []
    for k in lengths[:-1]:
        shared = spark.sparkContext.broadcast(markers)

        def name(batches, k=k, shared=shared):
            for b in batches:
                ids = b.column(0).to_numpy()
                for first, last, data, offsets in chunks(b.column(1)):
                    words = Words(data, offsets)
                    if len(words) < size:
                        continue
                    sums = prefix_sums(words.hashes)
                    among = _survivors(sums, words, size, lengths, shared.value)
                    grams = window_hashes(sums, k)
                    at, _, _ = named(grams, k, size, words.bounds, len(words), among)
                    owner = ids[first + np.searchsorted(words.bounds, at, "right") - 1]
                    yield pa.RecordBatch.from_arrays([signed(grams[at]), pa.array(owner)], ["h", "id"])

        counted = own.mapInArrow(name, "h long, id long").groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"))
        markers = [*markers, mark(counted.filter("a < b"), "h")]
    shared = spark.sparkContext.broadcast(markers)

    def windows(batches):
        for b in batches:
            ids, parts = b.column(0).to_numpy(), b.column(2).to_numpy()
            for first, last, data, offsets in chunks(b.column(1)):
                words = Words(data, offsets)
                if len(words) < size:
                    continue
                sums = prefix_sums(words.hashes)
                among = _survivors(sums, words, size, lengths, shared.value)
                ok = room(words.bounds, size, len(words))
                at = np.flatnonzero(ok if among is None else ok & among)
                row = np.searchsorted(words.bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays([signed(window_hashes(sums, size)[at]), pa.array(ids[first + row]), pa.array(parts[first + row]), pa.array((at - words.bounds[row]).astype(np.int32))], ["h", "id", "part", "start"])

    found = own.mapInArrow(windows, "h long, id long, part long, start int")
    found = Scratch(spark, "substring").save(found, "windows")
    seen = found.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).filter("a < b")
    is_hot = F.col("n") > found.count() // HOT
    hot = F.broadcast(seen.filter(is_hot).select("h", "a"))
    cold = found.join(hot, "h", "left_anti").join(seen.filter(~is_hot).select("h", "a"), "h")
    return found.join(hot, "h").unionByName(cold).filter("a < id").select("id", "part", "start")


def remove_repeated_words(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word that lies in a window of ``size`` words which also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input. Returns id,
    n_words, n_removed, spans (array of start and end, in words, of the removed runs) and
    kept_text (kept words joined by one space). Null, empty and shorter texts lose nothing
    (null: no words). Rows that repeat an id are one document as far as order goes; rows with
    a null id are returned whole and lend no windows. Extra columns aren't read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = repeated_words(docs, size).groupBy("id", "part").agg(F.collect_list("start").alias("starts"))
    found = Scratch(spark, "substring").save(found, "starts")
    schema = "id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches):
        for b in small(batches, 1):
            starts = b.column(2) if b.num_columns > 2 else [None] * b.num_rows
            out = []
            for text, at in zip(b.column(1), starts):
                words = (text.as_py() or "").encode().split()
                if at is None or not at.is_valid:
                    out.append((len(words), 0, [], b" ".join(words).decode()))
                    continue
                at = at.values.to_numpy()
                gone = covered(at, np.minimum(at + size, len(words)), len(words))
                begin, end = runs(gone)
                kept, upto = [], 0
                for x, y in zip(begin.tolist(), end.tolist()):
                    kept += words[upto:x]
                    upto = y
                out.append((len(words), int(gone.sum()), [{"start": x, "end": y} for x, y in zip(begin.tolist(), end.tolist())], b" ".join(kept + words[upto:]).decode()))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], span), pa.array(cols[3], pa.string())], ["id", "n_words", "n_removed", "spans", "kept_text"])

    return cut_spans(docs, found, mark_ids(found), cut, schema)
