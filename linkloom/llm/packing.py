"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Design. One pass over the texts makes a narrow table of pieces (no ids are kept). Packing is
decided on the histogram of piece lengths, which has at most ``max_tokens`` rows at any size
of corpus: a bin is filled greedily with the longest piece that still fits, then its smallest
piece is replaced by the two unpacked pieces that fit the expanded gap more tightly, and the
finished pattern is repeated as often as the counts allow. Pieces then find their place by
their rank within their length; ranks come from salted windows, so a length that a third of
all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rank import rank_within
from ._scratch import Scratch
from ._text import _LOWER, Words, byte_sums, chunks, mix, span_hashes

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

#: Distinct words whose ids a Python worker remembers; a full cache starts anew (speed only).
REMEMBERED = 1_000_000
PIECE = "piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of white-space separated words under a word-level BPE tokenizer file, remembered by word hash.

    Words of plain Latin-1 letters, perhaps with one full stop or comma after them, go through an
    array-at-a-time merge loop over the file's own merge list; every other word goes to the
    ``tokenizers`` library. Both give the library's ids (tests compare them).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        shown = _shown_bytes()
        self.first = np.array([vocabulary[shown[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[shown[b] + suffix] for b in range(256)], np.int64)
        size = 1 << 18
        self.slot_key = np.zeros(size, np.uint64)
        self.slot_rank = np.full(size, len(pairs), np.int32)
        self.probes = 1
        for k, rank in zip(self.keys.tolist(), self.ranks.tolist()):
            at, n = (k * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 46, 1
            while self.slot_key[at]:
                at, n = (at + 1) & (size - 1), n + 1
            self.slot_key[at], self.slot_rank[at], self.probes = k, rank, max(self.probes, n)
        self.none = len(pairs)
        (self.full_stop,), (self.comma,) = (self.library.encode(x, add_special_tokens=False).ids for x in ".,")
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
        out = np.full(key.shape, self.none, np.int32)
        todo = np.arange(key.size)
        key, at, flat = key.ravel(), at.ravel(), out.ravel()
        for _ in range(self.probes):
            have = self.slot_key[at[todo]]
            hit = have == key[todo]
            flat[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (have != 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.slot_key) - 1)
        return flat.reshape(out.shape)

    def _merge(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (padded) and counts for rows of bytes, each one pre-token: the least-ranked, leftmost pair merges until none is left."""
        total, size = raw.shape
        sym = self.first[raw]
        sym[:, -1] = self.last[raw[:, -1]]
        lengths = np.full(total, size)
        if size == 1:
            return sym, lengths
        alive, s = np.arange(total), sym.copy()
        r = np.concatenate([self._rank(s[:, :-1], s[:, 1:]), np.full((total, 1), self.none, np.int32)], 1)
        column = np.arange(size)[None, :]
        while True:
            at = r.argmin(1)
            best = r[np.arange(len(r)), at]
            go = best < self.none
            if not go.all():
                sym[alive[~go]] = s[~go]
                alive, s, r, at, best = alive[go], s[go], r[go], at[go], best[go]
            if not len(alive):
                return sym, lengths
            rows = np.arange(len(alive))
            source = np.minimum(column + (column > at[:, None]), size - 1)
            source += rows[:, None] * size
            s, r = s.ravel()[source], r.ravel()[source]
            s[rows, at] = self.merged[best]
            n = lengths[alive] = lengths[alive] - 1
            r[column >= n[:, None] - 1] = self.none
            inner = np.flatnonzero(at < n - 1)
            r[inner, at[inner]] = self._rank(s[inner, at[inner]], s[inner, at[inner] + 1])
            inner = np.flatnonzero(at > 0)
            r[inner, at[inner] - 1] = self._rank(s[inner, at[inner] - 1], s[inner, at[inner]])

    def _new(self, data: np.ndarray, lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of distinct spans; plain ones are read from the lowered bytes."""
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.where(plain, ends - starts, 0)
        order = np.argsort(sizes, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
            if not len(own):
                continue
            if size := int(sizes[own[0]]):
                step = max(1, (1 << 20) // size)
                for part in (own[i : i + step] for i in range(0, len(own), step)):
                    ids, n = self._merge(lowered[starts[part][:, None] + np.arange(size)])
                    counts[part] = n
                    parts.append((part, ids[np.arange(size)[None, :] < n[:, None]]))
            else:
                raw = data.tobytes()
                words = [raw[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist())]
                got = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
                counts[own] = [len(x) for x in got]
                parts.append((own, np.array([i for x in got for i in x], np.int64)))
        where = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.uint32)
        for part, ids in parts:
            n = counts[part]
            flat[np.repeat(where[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's documents in order, and each document's first place among them.

        A word's ids depend on nothing outside the word: pre-tokens never span white space.
        """
        lowered, odd = _plain(data)
        words = Words(data, offsets, of=lowered)
        odd = np.concatenate([[0], np.cumsum(odd)])
        starts, ends = words.starts, words.ends
        stop = (ends - starts > 1) & ((data[ends - 1] == 0x2E) | (data[ends - 1] == 0x2C)) & (odd[ends - 1] == odd[starts])
        cores = ends - stop
        plain = odd[cores] == odd[starts]
        hashes = np.empty(len(starts), np.uint64)
        hashes[plain] = span_hashes(words.sums, starts[plain], cores[plain])
        if not plain.all():
            hashes[~plain] = mix(span_hashes(byte_sums(data), starts[~plain], cores[~plain]), 1)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == unique
        if not known.all():
            new = np.flatnonzero(~known)
            own = first[new]
            flat, counts = self._new(data, lowered, starts[own], cores[own], plain[own])
            self.where = np.insert(self.where, at[new], len(self.ids) + np.cumsum(counts) - counts)
            self.counts = np.insert(self.counts, at[new], counts)
            self.hashes = np.insert(self.hashes, at[new], unique[new])
            self.ids = np.concatenate([self.ids, flat])
            at = np.searchsorted(self.hashes, unique)
        counts = self.counts[at][back]
        total = counts + stop
        upto = np.concatenate([[0], np.cumsum(total)])
        ids = np.empty(upto[-1], np.uint32)
        inside = np.repeat(upto[:-1], counts) + (within := np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        ids[inside] = self.ids[np.repeat(self.where[at][back], counts) + within]
        ids[upto[1:][stop] - 1] = np.where(data[ends[stop] - 1] == 0x2E, self.full_stop, self.comma)
        return ids, upto[words.bounds]


def _plain(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and which bytes aren't part of a letter a-z, A-Z or U+00C0 to U+00FF (without U+00D7, U+00F7)."""
    lowered = _LOWER[data]
    odd = ~_ASCII_LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
    lead, second = lead[letter], second[letter]
    odd[lead] = odd[lead + 1] = False
    upper = lead[second <= 0x9E]
    lowered[upper + 1] += 0x20
    return lowered, odd


def _shown_bytes() -> list[str]:
    """The printable character by which byte-level vocabularies show each byte (a fixed public convention)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [shown[b] for b in range(256)]


_encoders: dict[str, WordIds] = {}


def pieces_of(batch: pa.RecordBatch, encoder: WordIds, max_tokens: int, end_id: int) -> Iterator[pa.RecordBatch]:
    ids_of_docs = batch.column(0)
    for first, last, data, offsets in chunks(batch.column(1)):
        ids, upto = encoder(data, offsets)
        end = np.array([end_id], "<u4")
        row, piece, start, length, crc = [], [], [], [], []
        for k in range(last - first):
            own = np.concatenate([ids[upto[k] : upto[k + 1]], end]).astype("<u4")
            for p, begin in enumerate(range(0, len(own), max_tokens)):
                part = own[begin : begin + max_tokens]
                row.append(first + k)
                piece.append(p)
                start.append(begin)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [ids_of_docs.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["id", "piece", "start", "length", "ids_crc32"],
        )


def tokenised_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and then ``end_id``, cut every ``max_tokens``.

    Null and empty texts are one piece that holds only ``end_id``. Repeated rows stay repeated.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def cut(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordIds(tokenizer))
        for batch in batches:
            yield from pieces_of(batch, encoder, max_tokens, end_id)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, f"id {kind}, {PIECE}")


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a bin, number of such bins) that use up every length of the histogram.

    The histogram has at most ``capacity`` lengths, so this is bounded work at any corpus size.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    sizes = sorted(left)
    patterns = []
    while sizes:
        used: dict[int, int] = {}
        items, gap = [], capacity
        free = lambda n: left[n] - used.get(n, 0)
        at = bisect.bisect_right(sizes, gap) - 1
        while at >= 0:
            n = sizes[at]
            if n > gap:
                at = bisect.bisect_right(sizes, gap, 0, at) - 1
            elif free(n) <= 0:
                at -= 1
            else:
                items.append(n)
                used[n] = used.get(n, 0) + 1
                gap -= n
        if gap and items:
            pair = _tighter_pair(sizes, free, items[-1], items[-1] + gap)
            if pair:
                used[items[-1]] -= 1
                items[-1:] = pair
                for n in pair:
                    used[n] = used.get(n, 0) + 1
        used = {n: c for n, c in used.items() if c}
        times = min(left[n] // c for n, c in used.items())
        patterns.append((items, times))
        for n, c in used.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
                sizes.pop(bisect.bisect_left(sizes, n))
    return patterns


def _tighter_pair(sizes: list[int], free, smallest: int, target: int) -> list[int] | None:
    """The two free lengths with the largest sum in (smallest, target]; the more even pair on ties."""
    low, high, best, found = 0, bisect.bisect_right(sizes, target) - 1, smallest, None
    while low <= high:
        if free(sizes[low]) <= 0:
            low += 1
        elif free(sizes[high]) <= 0:
            high -= 1
        elif (total := sizes[low] + sizes[high]) > target:
            high -= 1
        elif low == high and free(sizes[low]) < 2:
            break
        else:
            if total >= best and total > smallest:
                best, found = total, [sizes[high], sizes[low]]
            low += 1
    return found


def places(patterns: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """Per length, in order of rank: first rank, first sequence and offset of each run of equal bins."""
    runs, taken, sequence = [], {}, 0
    for items, times in patterns:
        offset = 0
        for n in items:
            runs.append((n, taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        sequence += times
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return {"key": table[:, 0] << 48 | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents by best-two-fit into sequences of at most ``max_tokens`` tokens.

    Returns one row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.
    Null or empty text: one piece with ``end_id`` alone. Repeated rows are packed each on its
    own. An empty table gives no rows. Other columns of ``docs`` are not read, so their names
    never clash. Null ids are kept as null.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(tokenised_pieces(docs, tokenizer, max_tokens, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = places(best_two_fit(histogram, max_tokens), max_tokens)
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    ranked = rank_within(pieces, "length", histogram, [F.col("id"), F.col("piece"), F.col("ids_crc32")])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank")
    shared = spark.sparkContext.broadcast(plan)  # at most a few runs for each of max_tokens lengths
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def place(batches):
        p = shared.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(p["key"], length << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p["sequence"][at] + rank - p["rank"][at]), pa.array(p["offset"][at])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"id {kind}, {PIECE}, sequence_id long, offset long")
