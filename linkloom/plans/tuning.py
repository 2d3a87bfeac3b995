"""Fitting of matchers: grids of parameters, the best point and the gate against overfitting.

truth is (event, truth), one row for each event; similarities are computed once for each set
of grams or vectors, and every threshold is counted on them. The first of equal points wins.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ensemble, similarity


def ngram_scores(events: DataFrame, series: DataFrame, n: int, threshold: float) -> DataFrame:
    """(event, predicted, score): the most similar series by Dice of n-grams, if at least the threshold."""
    sets = [d.select("id", T.char_ngrams(F.col("text"), n).alias("grams")) for d in (events, series)]
    pairs = similarity.set_similarity_pairs(*sets, "dice", Fraction(threshold).limit_denominator(1000))
    return similarity.top1(pairs, "l_id", F.desc("score"), F.col("r_id")).select(F.col("l_id").alias("event"), F.col("r_id").alias("predicted"), "score")


def ngram_grid(events: DataFrame, series: DataFrame, truth: DataFrame, sizes=(3, 4, 5), thresholds=(0.8, 0.7, 0.6)) -> DataFrame:
    """(place, n, threshold, tp, fp, fn, precision, recall, f1), the sizes in the outer loop."""
    points = [ensemble.grid(ngram_scores(events, series, n, min(thresholds)), truth, list(thresholds)).withColumn("n", F.lit(n)) for n in sizes]
    own = F.array_position(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("threshold"))
    outer = F.array_position(F.array(*[F.lit(n) for n in sizes]), F.col("n")) - 1
    return reduce(DataFrame.unionByName, points).withColumn("place", outer * len(thresholds) + own)


def tfidf_grid(events: DataFrame, series: DataFrame, truth: DataFrame, thresholds=(0.5, 0.6, 0.7, 0.8, 0.9), stop=T.STOP_WORDS) -> DataFrame:
    """(place, threshold, tp, fp, fn, ...): every similar series counts, not only the best."""
    pairs = similarity.tfidf_pairs(events, series, min(thresholds), stop)
    hits = pairs.select(F.col("l_id").alias("event"), F.col("r_id").alias("predicted"), F.round("score", 9).alias("score"))
    return counted_hits(hits, truth, list(thresholds))


def counted_hits(hits: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts of hits (event, predicted, score) at each threshold.

    Each hit counts on its own, and what is missed is the events less the hits: below 0 where
    events have several.
    """
    spark = hits.sparkSession
    points = F.broadcast(spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)], "place int, threshold double"))
    events = F.broadcast(truth.agg(F.count("*").alias("events")))
    right = F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False))
    rows = hits.join(truth, "event").join(points, F.col("score") >= F.col("threshold"))
    counts = rows.groupBy("place").agg(F.count_if(right).alias("tp"), F.count_if(~right).alias("fp"))
    out = points.join(counts, "place", "left").join(events).na.fill(0, ["tp", "fp"])
    return ensemble.with_scores(out.withColumn("fn", F.col("events") - F.col("tp") - F.col("fp")).drop("events"))


def span_accuracy(spans: DataFrame, truth: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of all spans (event, predicted) that a phrase matcher finds."""
    return counted_hits(spans.withColumn("score", F.lit(1.0)), truth, [1.0]).drop("place", "threshold")


def best_point(points: DataFrame) -> DataFrame:
    """The point with the highest f1, the first place on ties; one without f1 loses to any other."""
    return points.agg(F.max_by(F.struct(*points.columns), F.struct(F.coalesce("f1", F.lit(-1.0)), -F.col("place"))).alias("b")).select("b.*")


def fitted_ngram(events: DataFrame, series: DataFrame, truth: DataFrame, new_events: DataFrame, **grid) -> DataFrame:
    """(event, series) of new events by the best point of the grid; nothing if it reached a recall of 1."""
    point = best_point(ngram_grid(events, series, truth, **grid)).first()
    found = ngram_scores(new_events, series, point["n"], point["threshold"])
    return ensemble.gate(found.select("event", F.col("predicted").alias("series")), point["recall"])
