"""Removal of repeated byte strings by prefix-free parsing.

Triggers. A rolling hash over TRIGGER bytes is taken at every position; each string of
``size`` bytes is triggered by its least hash (leftmost on ties), which its content alone
decides. Consecutive strings with one trigger form a phrase: the bytes from the first such
string's start to the last one's end. Phrases overlap so that every string of ``size`` bytes
lies whole in exactly one phrase, and equal strings lie in phrases with equal triggers.

Dictionary and parse. The phrases are the dictionary; the parse is where in the corpus,
ordered by (document id, start), they stand. The parse is parsed again: runs of phrases are
cut after phrases whose hash is a multiple of RUN, and equal runs have one name. A run that
stands anywhere but at its first place repeats whole, and the first place of any string lies
in the first place of its run. So in highly repetitive text the dictionary only gets the
phrases of the distinct runs, and copies of a passage are short rows of the parse.

Suffix order. The dictionary is dealt out by trigger; each task sorts the suffixes of its
phrases to the depth of ``size`` bytes (prefix doubling: 8, 16, 32, ... bytes), which puts
equal strings side by side, and the parse says which of them starts first in the corpus. A
trigger with very many phrases isn't sorted in one task: its strings are dealt out one by
one instead. Two bitmaps of bounded size say which way a trigger goes; either gives the same
spans, so triggers that share a bit lose nothing.

Phrases whose trigger occurs once can't repeat; a bitmap of bounded size drops nearly all of
them before they are shuffled, and the sort drops the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import covered, cut_spans, mark, mark_ids, marked, named, part_of, runs, small
from ._scratch import Scratch
from ._text import byte_sums, chunks, prefix_sums, signed, span_hashes, window_hashes

TRIGGER = 32
#: A trigger with more phrases than this (a few MB of bytes) has its strings dealt out one by one.
PHRASES = 32_768
#: Phrases in a run, about.
RUN = 8
#: Bytes of dictionary sorted at once, more or less.
SORTED = 1 << 20


def _phrases(data: np.ndarray, offsets: np.ndarray, size: int):
    """(trigger hash, first string start, last string start) of a chunk's phrases."""
    if len(data) < size:
        return None
    k = min(TRIGGER, size)
    grams = window_hashes(byte_sums(data), k)
    at, first, last = named(grams, k, size, offsets, len(data))
    return grams[at], first, last


def suffix_ranks(data: np.ndarray, size: int) -> np.ndarray:
    """For every start with ``size`` bytes after it, the rank of those bytes among all such strings; equal: same rank.

    Prefix doubling over one string of bytes: ranks to depth d are paired with the ranks d
    further on, until depth ``size`` (the last step overlaps).
    """
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    depth = 1
    rank = data.astype(np.uint64)
    while 2 * depth <= min(8, size):  # up to 8 bytes as digits need no sort
        rank = (rank[:-depth] << np.uint64(8 * depth)) | rank[depth:]
        depth *= 2
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while depth < size:
        step = min(depth, size - depth)
        rank = np.unique(rank[: len(rank) - step] << 32 | rank[step:], return_inverse=True)[1].astype(np.int64)
        depth += step
    return rank[:n]


def repeated_bytes(docs: DataFrame, size: int = 100) -> DataFrame:
    """(id, part, start, end): spans, in bytes, covered by strings of ``size`` bytes that also start earlier.

    docs: id long, text string. Earlier: a smaller id, or the same id and a smaller start.
    Rows with null ids take no part. The spans of a document may overlap.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    own = docs.filter(F.col("id").isNotNull()).select("id", "text", part_of(F.col("text")).alias("part"))

    def triggers(batches):
        for b in batches:
            for _, _, data, offsets in chunks(b.column(1)):
                if (found := _phrases(data, offsets, size)) is not None:
                    value, count = np.unique(found[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([signed(value), pa.array(count)], ["trigger", "n"])

    counted = own.select("id", "text").mapInArrow(triggers, "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n"))
    shared = spark.sparkContext.broadcast(mark(counted.filter("n > 1"), "trigger"))

    def parse(batches):
        for b in batches:
            ids, parts = b.column(0).to_numpy(), b.column(2).to_numpy()
            for row, _, data, offsets in chunks(b.column(1)):
                if (found := _phrases(data, offsets, size)) is None:
                    continue
                trigger, first, last = found
                keep = marked(shared.value, trigger)
                trigger, first, last = trigger[keep], first[keep], last[keep]
                if not len(first):
                    continue
                name = span_hashes(byte_sums(data), first, last + size)
                # A run ends at a phrase of a certain hash, and where the next phrase isn't the next in the text.
                end = (name % np.uint64(RUN) == 0) | np.append(first[1:] != last[:-1] + 1, True)
                ends = np.flatnonzero(end)
                starts = np.concatenate([[0], ends[:-1] + 1])
                doc = np.searchsorted(offsets, first[starts], "right") - 1
                raw, upto = data.tobytes(), pa.array(np.append(starts, len(first)).astype(np.int32))
                begin = np.repeat(first[starts], ends - starts + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        signed(span_hashes(prefix_sums(name), starts, ends + 1)),
                        pa.array(ids[row + doc]), pa.array(parts[row + doc]), pa.array((first[starts] - offsets[doc]).astype(np.int64)),
                        pa.array([raw[x : y + size] for x, y in zip(first[starts].tolist(), last[ends].tolist())], pa.binary()),
                        pa.ListArray.from_arrays(upto, signed(trigger)), pa.ListArray.from_arrays(upto, pa.array((first - begin).astype(np.int32))), pa.ListArray.from_arrays(upto, pa.array((last - begin).astype(np.int32))),
                    ],
                    ["name", "id", "part", "start", "bytes", "triggers", "firsts", "lasts"],
                )

    parsed = own.mapInArrow(parse, "name long, id long, part long, start long, bytes binary, triggers array<long>, firsts array<int>, lasts array<int>")
    # Two hashes of its bytes and its length name a run.
    parsed = scratch.save(parsed.withColumn("check", F.xxhash64("bytes")).withColumn("n_bytes", F.octet_length("bytes")), "parse")
    name = ["name", "check", "n_bytes"]
    firsts = parsed.groupBy(*name).agg(F.min(F.struct("id", "part", "start")).alias("first"), F.count("*").alias("n"))
    firsts = scratch.save(firsts.select(*name, "n", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("id", "part", "start")]), "firsts")

    # Every other occurrence of a run repeats its first one whole.
    later = (F.col("id") > F.col("first_id")) | ((F.col("id") == F.col("first_id")) & (F.col("start") > F.col("first_start")))
    copies = parsed.select(*name, "id", "part", "start").join(firsts.filter("n > 1").drop("n", "first_part"), name)
    copies = scratch.save(copies.filter(later).select("id", "part", "start", (F.col("start") + F.col("n_bytes")).alias("end")), "copies")

    # The dictionary: the phrases of each run's first occurrence.
    place = firsts.select("name", "check", F.col("first_id").alias("id"), F.col("first_part").alias("part"), F.col("first_start").alias("start"))
    runs_ = parsed.join(place, ["name", "check", "id", "part", "start"])

    def phrases(batches):
        for b in batches:
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            raw = column["bytes"].to_pylist()
            sizes = np.diff(column["triggers"].offsets.to_numpy())
            of = np.repeat(np.arange(b.num_rows), sizes)
            first, last = (column[c].flatten().to_numpy() for c in ("firsts", "lasts"))
            yield pa.RecordBatch.from_arrays(
                [column["triggers"].flatten(), pa.array([raw[i][x : y + size] for i, x, y in zip(of.tolist(), first.tolist(), last.tolist())], pa.binary())]
                + [column["id"].take(pa.array(of)), column["part"].take(pa.array(of)), pa.array(column["start"].to_numpy()[of] + first)],
                ["trigger", "phrase", "id", "part", "start"],
            )

    dictionary = runs_.select("bytes", "triggers", "firsts", "lasts", "id", "part", "start").mapInArrow(phrases, "trigger long, phrase binary, id long, part long, start long")
    dictionary = scratch.save(dictionary, "dictionary")
    scratch.drop("parse", "firsts")
    several = scratch.save(dictionary.groupBy("trigger").agg(F.count("*").alias("phrases")).filter("phrases > 1"), "several")
    # A trigger goes one way whole, whatever bits it shares, so the phrases needn't meet their counts.
    some = spark.sparkContext.broadcast(mark(several, "trigger"))
    hot = spark.sparkContext.broadcast(mark(several.filter(F.col("phrases") > PHRASES), "trigger"))

    def ways(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        trigger = b.column(0).to_numpy().view(np.uint64)
        return marked(some.value, trigger), marked(hot.value, trigger)

    def sort(batches):
        for b in batches:
            repeated, single = ways(b)
            yield b.filter(pa.array(repeated & ~single))

    sorted_ = dictionary.mapInArrow(sort, dictionary.schema).repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_sorter(size), "id long, part long, start long, end long")

    def strings(batches):
        for b in batches:
            b = b.filter(pa.array(ways(b)[1]))
            ids, parts, starts = (b.column(i).to_numpy() for i in (2, 3, 4))
            for i, p in enumerate(b.column(1)):
                data = np.frombuffer(p.as_py(), np.uint8)
                h = window_hashes(byte_sums(data), size)
                n = len(h)
                yield pa.RecordBatch.from_arrays([signed(h), pa.array(np.full(n, ids[i])), pa.array(np.full(n, parts[i])), pa.array(starts[i] + np.arange(n))], ["h", "id", "part", "start"])

    single = dictionary.mapInArrow(strings, "h long, id long, part long, start long")
    single = scratch.save(single, "strings")
    earliest = single.groupBy("h").agg(F.min(F.struct("id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    earliest = earliest.select("h", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))
    single = single.join(earliest, "h").filter(later).select("id", "part", "start", (F.col("start") + size).alias("end"))
    return copies.unionByName(sorted_).unionByName(single)


def _spans(ids, parts, starts, ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, parts, starts, ends)], ["id", "part", "start", "end"])


def _sorted(phrases: list[bytes], place: np.ndarray, size: int):
    """Spans of the strings that stand earlier in one of the other phrases, by suffix order."""
    data = np.frombuffer(b"".join(phrases), np.uint8)
    lengths = np.array([len(p) for p in phrases])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    n = lengths - size + 1
    own = np.repeat(np.arange(len(phrases)), n)
    at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    rank = suffix_ranks(data, size)[bounds[own] + at]
    id_, start = place[own, 0], place[own, 2] + at
    order = np.lexsort((start, id_, rank))
    head = np.ones(len(order), bool)
    head[1:] = np.diff(rank[order]) > 0
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    repeat = (id_[order] > id_[first]) | (start[order] > start[first])
    where = np.sort(order[repeat])
    if len(where):
        split = np.flatnonzero((np.diff(where) != 1) | (np.diff(own[where]) != 0))
        a, b = where[np.concatenate([[0], split + 1])], where[np.concatenate([split, [len(where) - 1]])]
        yield _spans(id_[a], place[own[a], 1], start[a], start[b] + size)


def _sorter(size: int):
    """Sorts the dictionary, trigger by trigger, and returns what each phrase repeats of phrases that stand earlier."""

    def spans(phrases: list[bytes], place: np.ndarray):
        lengths = np.array([len(p) for p in phrases])
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        sums = byte_sums(np.frombuffer(b"".join(phrases), np.uint8))
        # A phrase that stands earlier repeats whole; the sort gets each phrase once.
        order = np.lexsort((place[:, 2], place[:, 0], span_hashes(sums, bounds[:-1], bounds[1:])))
        names = span_hashes(sums, bounds[:-1], bounds[1:])[order]
        head = np.concatenate([[True], names[1:] != names[:-1]])
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        later = (place[order, 0] != place[first, 0]) | (place[order, 2] != place[first, 2])
        own = order[later]
        if len(own):
            yield _spans(place[own, 0], place[own, 1], place[own, 2], place[own, 2] + lengths[own])
        # Phrases of which no string's hash comes twice can't repeat.
        kept = np.sort(order[head])
        n = lengths[kept] - size + 1
        before = np.cumsum(n) - n
        at = np.repeat(bounds[kept] - before, n)
        at += np.arange(len(at))
        hashes = window_hashes(sums, size)[at]
        del at
        ordered = np.sort(hashes)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        del ordered
        if not len(twice):
            return
        again = twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes
        some = kept[np.logical_or.reduceat(again, before)]
        del hashes, again, sums
        yield from _sorted([phrases[i] for i in some], place[some], size)

    def run(batches):
        last, phrases, places, held = None, [], [], 0
        for b in batches:
            key = b.column(0).to_numpy()
            place = np.stack([b.column(i).to_numpy() for i in (2, 3, 4)], 1)
            got = b.column(1).to_pylist()
            upto = 0
            for cut in [*(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]:
                if held >= SORTED and last != key[upto]:
                    yield from spans(phrases, np.concatenate(places))
                    phrases, places, held = [], [], 0
                phrases += got[upto:cut]
                places.append(place[upto:cut])
                last = key[upto]
                held += sum(map(len, got[upto:cut]))
                upto = cut
        if phrases:
            yield from spans(phrases, np.concatenate(places))

    return run


def remove_repeated_bytes(docs: DataFrame, size: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each byte covered by a string of ``size`` bytes that also starts earlier in the corpus.

    Texts are UTF-8 bytes (null: empty); matches never cross documents and are judged on the
    input. Returns id, n_bytes, n_removed, spans (array of start and end, in bytes, of the
    maximal removed runs) and kept (the remaining bytes concatenated; they may end inside a
    character). Texts shorter than ``size`` lose nothing by other documents. Rows that repeat
    an id are one document as far as order goes; rows with a null id are returned whole and
    lend nothing. Extra columns aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = repeated_bytes(docs, size).groupBy("id", "part").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    found = found.select("id", "part", F.col("found.start").alias("starts"), F.col("found.end").alias("ends"))
    found = Scratch(spark, "suffix").save(found, "spans")
    schema = "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for b in small(batches, 1):
            out = []
            for i, text in enumerate(b.column(1)):
                raw = (text.as_py() or "").encode()
                starts = b.column(2)[i] if b.num_columns > 2 else None
                if starts is None or not starts.is_valid:
                    out.append((len(raw), 0, [], raw))
                    continue
                gone = covered(starts.values.to_numpy(), b.column(3)[i].values.to_numpy(), len(raw))
                begin, end = runs(gone)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), [{"start": x, "end": y} for x, y in zip(begin.tolist(), end.tolist())], kept))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], span), pa.array(cols[3], pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])

    return cut_spans(docs, found, mark_ids(found), cut, schema)
