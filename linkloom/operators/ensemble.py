"""Votes, merged matches, confusion counts, threshold grids and the unmatched rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_of(matchers: dict[str, DataFrame]) -> DataFrame:
    """(event, series, found_by, seq): matches of all matchers, in the order of the matchers."""
    parts = [m.select("event", "series", F.lit(name).alias("found_by"), F.lit(i).alias("seq")) for i, (name, m) in enumerate(matchers.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vote(matches: DataFrame, required: int, distinct: bool = False) -> DataFrame:
    """(event, series, votes, found_by): pairs with enough votes; found_by joins the voters in order.

    A vote is a row, or with ``distinct`` a matcher.
    """
    merged = matches.groupBy("event", "series").agg(
        (F.count_distinct("found_by") if distinct else F.count("*")).alias("votes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "found_by"))), lambda x: x["found_by"]), "+").alias("found_by"),
    )
    return merged.filter(F.col("votes") >= required)


def vote_frequency(matches: DataFrame) -> DataFrame:
    """(votes, pairs)."""
    return matches.groupBy("event", "series").agg(F.count("*").alias("votes")).groupBy("votes").agg(F.count("*").alias("pairs"))


def remainder(events: DataFrame, matches: DataFrame, key: str = "event") -> DataFrame:
    return events.join(matches.select(key), key, "left_anti")


def union_missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left, and what of right has no row with its keys in left."""
    return left.unionByName(right.join(left.select(*keys), keys, "left_anti"))


def confusion(truth: Column, predicted: Column) -> list[Column]:
    """tp: predicted and right; fp: predicted and wrong; fn: not predicted."""
    return [
        F.count_if(predicted.isNotNull() & (predicted == truth)).alias("tp"),
        F.count_if(predicted.isNotNull() & ~F.coalesce(predicted == truth, F.lit(False))).alias("fp"),
        F.count_if(predicted.isNull()).alias("fn"),
    ]


def with_scores(df: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp and fn; null where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.try_divide(tp.cast("double"), tp + fp), F.try_divide(tp.cast("double"), tp + fn)
    return df.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.try_divide(2.0 * tp, 2 * tp + fp + fn), 6)})


def grid(scored: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) of the best match (event, predicted, score) at each threshold."""
    spark = scored.sparkSession
    points = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    rows = truth.join(scored, "event", "left").join(F.broadcast(points))
    hit = F.when(F.col("score") >= F.col("threshold"), F.col("predicted"))
    return with_scores(rows.groupBy("threshold").agg(*confusion(F.col("truth"), hit)))


def best_point(points: DataFrame, order: list[float]) -> DataFrame:
    """The point with the highest f1; the first of the order on ties."""
    place = F.array_position(F.array(*[F.lit(float(t)) for t in order]), F.col("threshold"))
    return points.agg(F.max_by(F.struct(*points.columns), F.struct(F.coalesce("f1", F.lit(-1.0)), -place)).alias("b")).select("b.*")


def gate(matches: DataFrame, recall: float | None) -> DataFrame:
    """No matches if fitting reached a recall of 1, a sign of overfitting."""
    return matches.limit(0) if recall == 1 else matches
