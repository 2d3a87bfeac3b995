"""Toxicity by compression distance.

Two zstandard dictionaries are trained separately, one on windows of ordinary texts and one
on windows of toxic texts. A window of ten words is compressed with the ordinary dictionary
and again with the toxic dictionary before it; what the toxic dictionary saves is the
window's distance towards toxic text. (Toxic texts are mostly ordinary prose, so the toxic
dictionary alone is the worse one for nearly every window, and the difference of the two is
noise: the README has figures.) Windows with nothing in common with toxic text save nothing.
A text's score is a logistic calibration of how its windows' savings are spread; the decision
threshold is one on that calibrated score.

Fitting reads a bounded sample of labelled rows (TOXIC_ROWS and ORDINARY_ROWS, the first by
a hash of their id). The dictionaries are trained on windows from anywhere in these texts,
drawn by hash so that each kind has about TRAINING_BYTES. The calibration is cross-fitted:
the rows are split in FOLDS, and each fold's savings are taken with dictionaries trained on
the others. It is corrected for the true ratio of the labels, counted over all labelled
rows. The driver gets the drawn windows and five numbers a sampled row; texts stay on the
executors. Scoring reads every window of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Labelled rows that fitting reads at most.
TOXIC_ROWS, ORDINARY_ROWS = 3000, 6000
#: Bytes of windows that a dictionary is trained on, about, and parts of the cross-fitted calibration.
TRAINING_BYTES, FOLDS = 4 << 20, 5
WORDS, STEP = 10, 5
TOXIC_BYTES, ORDINARY_BYTES = 8192, 112_640
#: Bytes saved from which a window counts as a hit, and beyond which savings count alike.
HIT, MOST = 3, 12
THRESHOLD = 0.7


def windows(text: str | None) -> list[bytes]:
    """Lower-case windows of WORDS words, every STEP words, that together hold every word."""
    words = (text or "").lower().encode().split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, max(1, len(words) - STEP), STEP)]


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class ToxicityModel:
    """Both dictionaries and the calibration; without toxic or ordinary examples it scores the base rate."""

    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        5, source_size=128, dict_size=ORDINARY_BYTES + TOXIC_BYTES, min_match=4, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    if not content:
        return zstandard.ZstdCompressor(compression_params=params)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def savings(own: list[bytes], pair) -> np.ndarray:
    ordinary, toxic = pair
    a, b = ordinary.compress, toxic.compress
    return np.clip(np.array([len(a(w)) - len(b(w)) for w in own], np.float64), 0, MOST)


def features(own: list[bytes], pair) -> tuple[float, ...]:
    """Mean saving, mean of the three highest, share of hits, log of their number, and the highest; zeros without windows."""
    if not own:
        return (0.0,) * 5
    v = savings(own, pair)
    top = np.sort(v)[-3:]
    hits = int((v >= HIT).sum())
    return v.mean(), top.mean(), hits / len(v), np.log1p(hits), top[-1]


def _calibrated(x: np.ndarray, y: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights of a ridge logistic fit, its intercept moved to the true rate of y."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    share = y.mean()
    w[-1] += np.log(rate / (1 - rate)) - np.log(share / (1 - share))
    return mean, scale, w


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn_from: Column | None = None) -> ToxicityModel:
    """Learns from labelled rows, of which ``learn_from`` may rule some out (a condition on id_col).

    A label counts as toxic if any row of the id says 1; of several texts under one id the
    least is read. Null labels and ids without a text row are left out. If one of the kinds
    is missing, the model gives its base rate.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    own = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).filter(F.col(id_col).isNotNull() & F.col("y").isNotNull())
    if learn_from is not None:
        own = own.filter(learn_from)
    own = own.groupBy(F.col(id_col).alias("id")).agg((F.max("y") == 1).cast("int").alias("y"))
    order = [F.xxhash64("id"), F.col("id")]
    counts = own.agg(F.sum("y"), F.count("*")).first()
    n_toxic, n = int(counts[0] or 0), int(counts[1] or 0)
    rate = (n_toxic + 0.5) / (n + 1)
    base = ToxicityModel(b"", b"", (0.0,) * 5, (1.0,) * 5, (*(0.0,) * 5, float(np.log(rate / (1 - rate)))))
    if not n_toxic or n_toxic == n:
        return base
    chosen = own.filter("y = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(own.filter("y = 0").orderBy(*order).limit(ORDINARY_ROWS))
    chosen = scratch.save(chosen.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    sample = scratch.save(texts.groupBy("id", "y", "fold").agg(F.min("text").alias("text")), "sample")  # at most TOXIC_ROWS + ORDINARY_ROWS

    def split(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                cut = [windows(t) for t in part.column(2).to_pylist()]
                of = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in cut]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array([k for x in cut for k in range(len(x))], pa.int32()), pa.array([w for x in cut for w in x], pa.binary())], ["y", "fold", "at", "w"])

    drawn = sample.select("y", "fold", "text").mapInArrow(split, "y int, fold int, at int, w binary")
    drawn = scratch.save(drawn.withColumn("draw", F.pmod(F.xxhash64("w", "at"), F.lit(1 << 30)) / float(1 << 30)), "windows")
    share = {r["y"]: TRAINING_BYTES / max(r["n"], 1) for r in drawn.groupBy("y").agg(F.sum(F.octet_length("w")).alias("n")).collect()}
    if len(share) < 2:
        return base
    got = drawn.filter(F.col("draw") < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).select("y", "fold", "w").toArrow()  # about 2 * TRAINING_BYTES
    y, fold, w = got.column(0).to_numpy(), got.column(1).to_numpy(), got.column(2).combine_chunks()

    def trained(some: np.ndarray) -> tuple[bytes, bytes]:
        kinds = (sorted(w.filter(pa.array(some & (y == kind))).to_pylist()) for kind in (0, 1))
        return tuple(_trained(x, *how) if x else b"" for x, how in zip(kinds, ((ORDINARY_BYTES, 32), (TOXIC_BYTES, 16))))

    shared = spark.sparkContext.broadcast([trained(fold != k) for k in range(FOLDS)])

    def measure(batches):
        pairs = [ToxicityModel(*x, base.mean, base.scale, base.weights).compressors() for x in shared.value]
        for b in batches:
            rows = [features(windows(t), pairs[k]) for k, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in np.array(rows, np.float64).reshape(-1, 5).T)], ["id", "y", *"abcde"])

    kind = sample.schema["id"].dataType.simpleString()
    measured = sample.select("id", "y", "fold", "text").mapInArrow(measure, f"id {kind}, y int, a double, b double, c double, d double, e double").orderBy("id").toArrow()
    x = np.column_stack([measured.column(c).to_numpy() for c in "abcde"])
    mean, scale, weights = _calibrated(x, measured.column("y").to_numpy().astype(float), rate)
    return ToxicityModel(*trained(fold >= 0), tuple(mean), tuple(scale), tuple(weights))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_windows, n_hits) of every row: score is 0 to 1, higher for likelier toxic.

    Null and empty texts have no windows and get the score of a text that saves nothing.
    Repeated rows are scored each. Other columns aren't read. An empty table gives no rows.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        pair = model.compressors()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                split = [windows(t) for t in part.column(1).to_pylist()]
                x = np.array([features(own, pair) for own in split]).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(model.score(x)), pa.array([len(own) for own in split], pa.int64()), pa.array(np.rint(np.expm1(x[:, 3])).astype(np.int64))],
                    ["id", "score", "n_windows", "n_hits"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, f"id {kind}, score double, n_windows long, n_hits long")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns in order, whose text scores below the threshold; null texts are kept like empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches):
        model = shared.value
        pair = model.compressors()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                x = np.array([features(windows(t), pair) for t in part.column(at).to_pylist()]).reshape(-1, 5)
                yield part.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(keep, docs.schema)
