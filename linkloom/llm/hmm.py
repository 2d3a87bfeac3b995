"""A hidden Markov language model over whole corpora.

Vocabulary. Words are counted over all training documents. The HEAD most frequent ones are
classes of their own; every other word, known or not, belongs to one of TAIL classes by its
last bytes, and within its class has the probability (count + 1) / (class total + class
types + 1). So the model's tables have one size for any corpus, while the counts of rare
words stay in a table that is joined by shuffle. A document ends with a token of its own.

Training. Words are turned into class ids once. Expected counts of Baum-Welch are summed in
each partition over all training sequences and then across partitions; the M-step runs on
the driver over (HEAD + TAIL) * STATES numbers. The first parameters come from the counts of
the whole corpus and a keyed hash of the classes; every pass covers all training sequences,
and passes go on until one gains less than GAIN (log10 likelihood a token) over the one before.

Scoring. The scaled forward recursion gives each document's exact likelihood, many documents
side by side, one step at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._sums import summed
from ._text import Words, chunks, mix, signed

HEAD, TAIL, STATES = 1 << 16, 4096, 8
#: Passes at most, and the gain in log10 likelihood a token below which no further pass is made.
PASSES, GAIN = 14, 0.002
#: Tokens that are worked on side by side.
TOKENS = 1 << 19
#: Occurrences by which a class's states are drawn to those of all tokens: a rare word says little of its state.
PRIOR = 4.0
_CHUNK = 256


def _tail_class(words: Words) -> np.ndarray:
    """By the last three bytes of the lower-cased word."""
    low = words.data | np.where((words.data >= 0x41) & (words.data <= 0x5A), 0x20, 0).astype(np.uint8)
    size = words.ends - words.starts
    value = low[words.ends - 1].astype(np.uint64)
    for back in (2, 3):
        value = value << np.uint64(8) | np.where(size >= back, low[np.maximum(words.ends - back, 0)], 0).astype(np.uint64)
    return (mix(value, 5) % np.uint64(TAIL)).astype(np.int32)


def _counted(docs: DataFrame) -> DataFrame:
    """(h, tail, n): occurrences of each word by its hash."""

    def count(batches):
        held, size = [], 0
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                words = Words(data, offsets, lower=True)
                h, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
                held.append((h, _tail_class(words)[first], n))
                size += len(h)
                if size > 2_000_000:
                    held, size = [_summed(held)], 0
                    if len(held[0][0]) > 1_000_000:
                        yield _counts(held.pop())
        if held:
            yield _counts(_summed(held))

    return docs.select("text").mapInArrow(count, "h long, tail int, n long").groupBy("h", "tail").agg(F.sum("n").alias("n"))


def _summed(parts):
    h, tail, n = (np.concatenate(x) for x in zip(*parts))
    unique, first, back = np.unique(h, return_index=True, return_inverse=True)
    return unique, tail[first], np.bincount(back, n, len(unique)).astype(np.int64)


def _counts(part) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([signed(part[0]), pa.array(part[1], pa.int32()), pa.array(part[2].astype(np.int64))], ["h", "tail", "n"])


@dataclass
class Classes:
    """Sorted hashes and counts of the head, totals of the tail classes, and corpus totals."""

    hashes: np.ndarray
    counts: np.ndarray
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    end_count: int
    train_tokens: int
    types: int

    @property
    def size(self) -> int:
        return len(self.hashes) + 1 + TAIL

    @property
    def end(self) -> int:
        return len(self.hashes)

    def ids(self, words: Words) -> np.ndarray:
        h = words.hashes
        out = len(self.hashes) + 1 + _tail_class(words)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, at, out)
        return out.astype(np.int32)

    def weights(self) -> np.ndarray:
        """Add-one counts of all classes; a tail class has one type more, any unknown word."""
        return np.concatenate([self.counts + 1.0, [self.end_count + 1.0], self.tail_tokens + self.tail_types + 1.0])


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class by state
    before: float | None = None  # log10 likelihood of the model that this one was made from

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, corpus: np.ndarray) -> Model:
        """corpus: add-one counts of the classes. A state's emissions are the corpus distribution times
        (share of the class in the state) / (share of all tokens in the state), the former smoothed."""
        share = (emit.sum(0) + 1) / (emit.sum() + emit.shape[1])
        e = corpus[:, None] * (emit + PRIOR * share) / ((emit.sum(1, keepdims=True) + PRIOR) * share)
        return Model((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), e / e.sum(0))


class _Steps:
    """Sequences side by side: longest first, their tokens ordered by step."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        lengths = np.diff(bounds)
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        steps = int(lengths[0])
        self.active = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than t
        self.upto = np.concatenate([[0], np.cumsum(self.active)])
        t = np.repeat(np.arange(steps), self.active)
        self.row = np.arange(self.upto[-1]) - self.upto[t]
        self.ids = ids[bounds[:-1][self.order][self.row] + t]
        self.n = len(lengths)

    def forward(self, m: Model, keep: bool = True):
        e = m.emit[self.ids]
        scale = np.empty(len(e))
        alpha = np.empty_like(e) if keep else None
        for t in range(len(self.active)):
            x, y = self.upto[t], self.upto[t + 1]
            a = (m.start if t == 0 else a[: y - x] @ m.move) * e[x:y]
            c = a.sum(1)
            a /= c[:, None]
            scale[x:y] = c
            if keep:
                alpha[x:y] = a
        loglik = np.empty(self.n)
        loglik[self.order] = np.bincount(self.row, np.log10(scale), self.n)
        return e, alpha, scale, loglik

    def scaled(self, m: Model):
        """Emissions and scaled forward probabilities, both state by token in single precision, and scales."""
        e = np.ascontiguousarray(m.emit.astype(np.float32)[self.ids].T)
        start, move = m.start.astype(np.float32)[:, None], np.ascontiguousarray(m.move.T.astype(np.float32))
        scale, alpha, a = np.empty(e.shape[1], np.float32), np.empty_like(e), None
        for x, y in zip(self.upto[:-1].tolist(), self.upto[1:].tolist()):
            a = np.multiply(start if a is None else move @ a[:, : y - x], e[:, x:y], out=alpha[:, x:y])
            np.add.reduce(a, axis=0, out=scale[x:y])
            a *= 1 / scale[x:y]
        return e, alpha, scale

    def counts(self, m: Model, total: np.ndarray, start: np.ndarray, move: np.ndarray) -> float:
        """Adds the expected counts of one Baum-Welch pass; returns the log10 likelihood.

        Probabilities are in single precision, as each step is scaled; sums over all tokens are in double precision.
        """
        e, alpha, scale = self.scaled(m)
        loglik = float(np.log10(scale, dtype=np.float64).sum())
        e *= 1 / scale
        back = m.move.astype(np.float32)
        b = None
        pairs = np.zeros_like(move)
        for x, y in zip(self.upto[-2::-1].tolist(), self.upto[:0:-1].tolist()):
            if b is not None:
                n = b.shape[1]
                a = alpha[:, x : x + n]
                pairs += a @ b.T
                b = back @ b
                a *= b  # now the state's probability at this step
                e[:, x : x + n] *= b
            b = e[:, x:y]
        move += pairs * m.move
        start += alpha[:, : self.active[0]].sum(1, dtype=np.float64)
        for s in range(total.shape[1]):
            total[:, s] += np.bincount(self.ids, alpha[s], len(total))
        return loglik


def _runs(lengths: np.ndarray):
    """Rows in order of length, in groups of about TOKENS tokens."""
    order = np.argsort(lengths, kind="stable")
    upto = np.cumsum(lengths[order])
    first = 0
    while first < len(order):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + TOKENS, "right")))
        yield order[first:last]
        first = last


def _groups(column, size: int):
    """(rows, their ids, bounds) of groups of sequences, from a binary column of int32 ids."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    ids = np.frombuffer(column.buffers()[2], np.int32, count=int(offsets[-1]))
    lengths = np.diff(offsets)
    for rows in _runs(lengths):
        n = lengths[rows]
        bounds = np.concatenate([[0], np.cumsum(n)])
        yield rows, ids[np.repeat(offsets[rows] - bounds[:-1], n) + np.arange(bounds[-1])], bounds


def _head_count(counts: DataFrame) -> int:
    """The least count from which on there are at most HEAD words, from a histogram of count sizes.

    Sizes up to 64 are kept apart and larger ones in sixteenths of a power of two.
    """
    size = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.floor(F.log2("n") * 16) - 32)
    words, least = 0, 1
    for r in sorted(counts.groupBy(size.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["s"]):
        words += r["k"]
        if words > HEAD:
            break
        least = r["n"]
    else:
        return 1
    return least if words > r["k"] else 1 << 62  # not even the largest size fits


def _start(classes: Classes) -> Model:
    """First parameters, alike at any corpus size: half of a class's occurrences are in a state that its keyed
    hash chooses, the others in all states alike, and states tend to stay."""
    corpus = classes.weights()
    keys = np.concatenate([classes.hashes, np.arange(1 + TAIL, dtype=np.uint64)])
    emit = np.repeat(corpus[:, None] / (2 * STATES), STATES, axis=1)
    emit[np.arange(classes.size), (mix(keys, 7) % np.uint64(STATES)).astype(np.int64)] += corpus / 2
    stay = np.full((STATES, STATES), 1000.0) + np.eye(STATES) * 500_000
    return Model.from_counts(np.ones(STATES), stay, emit, corpus)


def _pass(encoded: DataFrame, m: Model, classes: Classes) -> Model:
    """One Baum-Welch pass over all training sequences; the new model knows the log10 likelihood of the old one."""
    shared = encoded.sparkSession.sparkContext.broadcast(m)
    size = classes.size

    def expect(batches):
        m = shared.value
        emit, start, move, loglik = np.zeros((size, STATES)), np.zeros(STATES), np.zeros((STATES, STATES)), 0.0
        for b in batches:
            for _, ids, bounds in _groups(b.column(0), size):
                loglik += _Steps(ids, bounds).counts(m, emit, start, move)
        parts = [(i, emit[i * _CHUNK : (i + 1) * _CHUNK]) for i in range(-(-size // _CHUNK))]
        parts = [(i, x.astype(np.float32).tobytes()) for i, x in [*parts, (-1, start), (-2, move), (-3, np.array([loglik]))]]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([x for _, x in parts], pa.binary())], ["chunk", "counts"])

    # Each task sends tables of one size, so there are no more tasks than cores.
    tasks = encoded.sparkSession.sparkContext.defaultParallelism
    parts = encoded.filter("train").select("ids").coalesce(tasks).mapInArrow(expect, "chunk long, counts binary")
    rows = summed(parts, np.float32, tasks)
    got = {r["chunk"]: np.frombuffer(bytes(r["counts"])) for r in rows.collect()}  # (HEAD + TAIL) * STATES numbers
    if not got:
        return m
    emit = np.concatenate([got[i] for i in range(-(-size // _CHUNK))]).reshape(size, STATES)
    new = Model.from_counts(got[-1], got[-2].reshape(STATES, STATES), emit, classes.weights())
    return replace(new, before=float(got[-3][0]))


def hmm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", passes: int = PASSES) -> DataFrame:
    """Trains on the rows where ``train`` holds and scores all rows.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score (log10 of the add-one
    unigram model) and score (log10 of the hidden Markov model). Tokens are the words
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and one end a row. Null texts are empty: their
    one token is the end. Rows with a null condition are held out. Repeated rows count and
    are scored each; an empty table gives no rows. Other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "hmm")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = scratch.save(_counted(own.filter("train")), "counts")
    head = counts.filter(F.col("n") >= _head_count(counts)).select("h", "n", "tail").collect()  # at most HEAD rows
    h = np.array([r["h"] for r in head], np.int64).view(np.uint64)
    order = np.argsort(h)
    n = np.array([r["n"] for r in head], np.int64)[order]
    tails = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()  # TAIL rows
    tokens, types = np.zeros(TAIL), np.zeros(TAIL)
    for r in tails:
        tokens[r["tail"]], types[r["tail"]] = r["n"], r["types"]
    all_words, all_types = int(tokens.sum()), int(types.sum())
    np.subtract.at(tokens, [r["tail"] for r in head], [r["n"] for r in head])
    np.subtract.at(types, [r["tail"] for r in head], 1)
    ends = own.filter("train").count()
    classes = Classes(h[order], n, tokens, types, ends, all_words + ends, all_types + (ends > 0))
    shared = spark.sparkContext.broadcast(classes)

    def encode(batches):
        c = shared.value
        for b in batches:
            for first, last, data, offsets in chunks(b.column(1)):
                words = Words(data, offsets, lower=True)
                ids = c.ids(words)
                tail = np.concatenate([[0], np.cumsum(ids > c.end)])[words.bounds]
                rare = words.hashes[ids > c.end].tobytes()
                ids = np.insert(ids, words.bounds[1:], c.end)
                bounds = (words.bounds + np.arange(len(words.bounds))) * 4
                raw = ids.astype(np.int32).tobytes()
                part = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2),
                        pa.array([raw[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()),
                        pa.array([rare[8 * x : 8 * y] for x, y in zip(tail[:-1].tolist(), tail[1:].tolist())], pa.binary()),
                    ],
                    ["id", "train", "ids", "rare"],
                )

    encoded = own.mapInArrow(encode, f"id {kind}, train boolean, ids binary, rare binary").withColumn("row", F.monotonically_increasing_id())
    encoded = scratch.save(encoded, "encoded")
    model = _start(classes)
    for _ in range(passes):
        last, model = model.before, _pass(encoded, model, classes)
        if last is not None and model.before - last < GAIN * classes.train_tokens:
            break
    trained = spark.sparkContext.broadcast((model, classes))

    def score(batches):
        m, c = trained.value
        log_head = np.concatenate([np.log10(c.counts + 1.0), [np.log10(c.end_count + 1.0)], np.zeros(TAIL)])
        within = np.concatenate([np.zeros(c.end + 1), -np.log10(c.tail_tokens + c.tail_types + 1.0)])
        known = np.concatenate([np.ones(c.end), [c.end_count > 0], np.zeros(TAIL)])
        for b in batches:
            out = np.zeros((4, b.num_rows))
            for rows, ids, bounds in _groups(b.column(1), c.size):
                steps = _Steps(ids, bounds)
                out[0, rows] = steps.forward(m, keep=False)[3] + np.add.reduceat(within[ids], bounds[:-1])
                out[1, rows] = np.add.reduceat(log_head[ids], bounds[:-1])
                out[2, rows] = np.add.reduceat(known[ids], bounds[:-1])
                out[3, rows] = np.diff(bounds)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0]), pa.array(out[1]), pa.array(out[2].astype(np.int64)), pa.array(out[3].astype(np.int64))], ["row", "hmm", "log_known", "n_head", "n_tokens"])

    def rare(batches):
        for b in batches:
            rows, values = b.column(0).to_numpy(), b.column(1).to_pylist()
            held = np.repeat(rows, [len(v) // 8 for v in values])
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.frombuffer(b"".join(values), np.int64))], ["row", "h"])

    scored = encoded.select("row", "ids").mapInArrow(score, "row long, hmm double, log_known double, n_head long, n_tokens long")
    # Words outside the head are rare, so no hash of theirs is a hot key.
    words = encoded.filter(F.octet_length("rare") > 0).select("row", "rare").mapInArrow(rare, "row long, h long")
    found = words.join(counts.select("h", "n"), "h", "left")
    found = found.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("log_rare"), F.count("n").alias("n_rare"))
    out = encoded.select("row", "id", "train").join(scored, "row").join(found, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    total = float(np.log10(classes.train_tokens + classes.types + 1.0))
    return out.select(
        "id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(classes.train_tokens).cast("long").alias("train_tokens"),
        (F.col("log_known") + log_rare - F.col("n_tokens") * total).alias("base_score"), (F.col("hmm") + log_rare).alias("score"),
    )
