"""The linking pipeline: events without a series, an ensemble of matchers, votes and the rest."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import complete, ensemble, similarity


def title_table(df: DataFrame, key: str = "qid") -> DataFrame:
    """(id, text): key and title, else label."""
    return df.select(F.col(key).alias("id"), T.title_or_label(F.col("title"), F.col("label")).alias("text")).filter(F.col("text").isNotNull())


def exact(events: DataFrame, series: DataFrame) -> DataFrame:
    return events.join(series.select(F.col("id").alias("series"), "text"), "text").select(F.col("id").alias("event"), "series")


def phrase(events: DataFrame, series: DataFrame) -> DataFrame:
    """The first series title whose tokens stand in the event's title."""
    hits = similarity.phrase_pairs(events, series)
    return similarity.top1(hits, "l_id", F.col("start"), F.col("r_id")).select(F.col("l_id").alias("event"), F.col("r_id").alias("series"))


def ngram(events: DataFrame, series: DataFrame, n: int = 3, threshold: Fraction | float = Fraction(3, 5)) -> DataFrame:
    sets = [d.select("id", T.char_ngrams(F.col("text"), n).alias("grams")) for d in (events, series)]
    pairs = similarity.set_similarity_pairs(*sets, "dice", threshold)
    return similarity.top1(pairs, "l_id", F.desc("score"), F.col("r_id")).select(F.col("l_id").alias("event"), F.col("r_id").alias("series"))


def tfidf(events: DataFrame, series: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Every series at least that similar."""
    return similarity.tfidf_pairs(events, series, threshold, T.STOP_WORDS).select(F.col("l_id").alias("event"), F.col("r_id").alias("series"))


def embedding(events: DataFrame, series: DataFrame, model, threshold: float | None = 0.9) -> DataFrame:
    """The most similar series by mean word vectors of a fitted Word2Vec model."""
    vectors = [model.transform(d.select("id", T.content_words(F.col("text")).alias("words"))) for d in (events, series)]
    from pyspark.ml.functions import vector_to_array

    a, b = (v.select("id", vector_to_array(model.getOutputCol()).alias("vec")) for v in vectors)
    return similarity.cosine_top1(a, b, threshold).select(F.col("l_id").alias("event"), F.col("r_id").alias("series"))


def link(events: DataFrame, series: DataFrame, proxies: DataFrame | None = None, required: int = 2, model=None) -> dict[str, DataFrame]:
    """Matches by votes, their frequency and the events that are left.

    events and series follow linkloom.schema; only events without a series are matched.
    Proxies are series that are known by title only, each with a key of its own.
    """
    open_events = title_table(complete.without_parent(events))
    known = title_table(series)
    if proxies is not None:
        known = known.unionByName(title_table(proxies))
    matchers = {"exact": exact(open_events, known), "phrase": phrase(open_events, known), "ngram": ngram(open_events, known), "tfidf": tfidf(open_events, known)}
    if model is not None:
        matchers["embedding"] = embedding(open_events, known, model)
    found = ensemble.union_of(matchers)
    matches = ensemble.vote(found, required, distinct=True)
    return {"matches": matches, "votes": ensemble.vote_frequency(found), "rest": ensemble.remainder(open_events.withColumnRenamed("id", "event"), matches)}
