"""Candidate generation and similarity joins without cross joins.

Set joins use prefix filtering: a record's grams are ordered from rare to frequent, and only
as many of the rarest are joined as a qualifying partner can't avoid sharing. Containment
joins use a run of inner words of each pattern as a key. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import nearest

#: Rows of a side that is broadcast at most.
SMALL = 200_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """A hint only behind a count; larger sides are shuffled."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def top1(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


def containment_pairs(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(l_id, r_id) where texts.text (id, text) contains patterns.text (id, text), case-sensitive.

    A pattern's words other than the first and the last are whole words of any text that
    contains it, so the pattern's first inner run of three words is an equi-join key.
    Patterns of fewer than five words have no such run and are compared with all texts, if
    they are few, as a broadcast. Null texts and patterns match nothing; an empty pattern
    matches every text.
    """
    run = 3
    p = patterns.filter(F.col("text").isNotNull()).select(F.col("id").alias("r_id"), F.col("text").alias("pattern"), F.split("text", r"[\s]+").alias("w"))
    keyed = p.filter(F.size("w") >= run + 2).select("r_id", "pattern", F.xxhash64(F.array_join(F.slice("w", 2, run), " ")).alias("k"))
    short = p.filter(F.size("w") < run + 2).select("r_id", "pattern")
    t = texts.filter(F.col("text").isNotNull()).select(F.col("id").alias("l_id"), F.col("text").alias("body"))

    def runs(w: Column) -> Column:
        return F.when(F.size(w) >= run, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - run), lambda i: F.xxhash64(T.token_run(w, i, run)))))

    keyed_texts = t.select("l_id", F.explode(T.let(F.array_remove(F.split("body", r"[\s]+"), ""), runs)).alias("k"))
    hits = keyed_texts.join(broadcast_if_small(keyed), "k").select("l_id", "r_id", "pattern")
    found = hits.join(t, "l_id").filter(F.contains("body", "pattern")).select("l_id", "r_id")
    rest = t.join(broadcast_if_small(short), F.contains("body", "pattern")).select("l_id", "r_id")
    return found.unionByName(rest).distinct()


def _with_prefix(sets: DataFrame, df: DataFrame, ratio: Fraction) -> DataFrame:
    """Each record's rarest grams: all but ceil(ratio * size) - 1 of them."""
    rows = sets.select("id", F.size("grams").alias("n"), F.explode("grams").alias("g")).join(df, "g")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "g"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(float(ratio)) - 1e-9) + 1
    return rows.withColumn("rank", rank).filter(F.col("rank") <= keep).select("id", "n", "g")


def set_similarity_pairs(left: DataFrame, right: DataFrame, measure: str, threshold: Fraction | float) -> DataFrame:
    """(l_id, r_id, inter, l_n, r_n, score) of records (id, grams) with Dice or Jaccard at least the threshold.

    Records without grams never match. The threshold is compared in whole numbers, so exact
    ratios are not lost to rounding.
    """
    t = Fraction(threshold).limit_denominator(1000)
    if not 0 < t <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    ratio = t / (2 - t) if measure == "dice" else t  # of either size, at least shared
    left, right = (s.filter(F.size("grams") > 0).select("id", "grams") for s in (left, right))
    grams = left.select(F.explode("grams").alias("g")).unionByName(right.select(F.explode("grams").alias("g")))
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    lp = _with_prefix(left, df, ratio).select(F.col("id").alias("l_id"), F.col("n").alias("l_n"), "g")
    rp = _with_prefix(right, df, ratio).select(F.col("id").alias("r_id"), F.col("n").alias("r_n"), "g")
    sizes = (F.least("l_n", "r_n") * t.denominator * ratio.denominator >= F.greatest("l_n", "r_n") * t.denominator * ratio.numerator)
    pairs = lp.join(rp, "g").filter(sizes).select("l_id", "r_id").distinct()
    full = pairs.join(left.select(F.col("id").alias("l_id"), F.col("grams").alias("a")), "l_id").join(right.select(F.col("id").alias("r_id"), F.col("grams").alias("b")), "r_id")
    full = full.select("l_id", "r_id", F.size(F.array_intersect("a", "b")).alias("inter"), F.size("a").alias("l_n"), F.size("b").alias("r_n"))
    both = F.col("l_n") + F.col("r_n")
    whole = both if measure == "dice" else both - F.col("inter")
    times = 2 if measure == "dice" else 1
    return full.filter(F.col("inter") * times * t.denominator >= whole * t.numerator).withColumn("score", F.col("inter") * float(times) / whole)


def tfidf_weights(texts: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, w): term frequency times ln((1 + n) / (1 + df)) + 1, of unit length per id."""
    tf = texts.select("id", F.explode(T.terms(F.col("text"), stop)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = texts.agg(F.count("*").alias("n"))
    raw = tf.join(df, "term").join(F.broadcast(n)).withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("x") / F.col("norm")).alias("w"))


def tfidf_pairs(left: DataFrame, right: DataFrame, threshold: float, stop: tuple[str, ...] = ()) -> DataFrame:
    """(l_id, r_id, score) of pairs of (id, text) with TF-IDF cosine at least the threshold, idf over both sides."""
    sides = left.select(F.struct(F.lit(0).alias("side"), F.col("id")).alias("id"), "text").unionByName(right.select(F.struct(F.lit(1).alias("side"), F.col("id")).alias("id"), "text"))
    w = tfidf_weights(sides, stop)
    a = w.filter("id.side = 0").select(F.col("id.id").alias("l_id"), "term", F.col("w").alias("a"))
    b = w.filter("id.side = 1").select(F.col("id.id").alias("r_id"), "term", F.col("w").alias("b"))
    return a.join(b, "term").groupBy("l_id", "r_id").agg(F.sum(F.col("a") * F.col("b")).alias("score")).filter(F.round("score", 9) >= threshold)


def pair_tfidf(pairs: DataFrame, a: str, b: str, name: str = "score") -> DataFrame:
    """Adds the cosine of two text columns with idf fitted on the two alone: a term of both has idf 1, of one ln(3/2) + 1."""
    pairs = pairs.withColumns({"_ta": T.terms(F.col(a)), "_tb": T.terms(F.col(b))}).withColumn("_both", F.array_union("_ta", "_tb"))
    ta, tb, both = F.col("_ta"), F.col("_tb"), F.col("_both")
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t)).cast("double")
    idf = lambda t: F.when(F.array_contains(ta, t) & F.array_contains(tb, t), 1.0).otherwise(math.log(1.5) + 1)
    va, vb = F.transform(both, lambda t: count(ta, t) * idf(t)), F.transform(both, lambda t: count(tb, t) * idf(t))
    out = pairs.withColumns({"_va": va, "_vb": vb})
    return out.withColumn(name, T.cosine(F.col("_va"), F.col("_vb"))).drop("_ta", "_tb", "_both", "_va", "_vb")


#: Tokens by which phrases are looked up; longer ones are then compared whole.
PREFIX = 5


def phrase_pairs(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(l_id, r_id, start): token sequences of phrases (id, text) that stand in texts (id, text), case-sensitive.

    Phrases are found by their first PREFIX tokens, then compared whole. Repeated rows of phrases count once.
    """
    p = phrases.select(F.col("id").alias("r_id"), T.phrase_tokens(F.col("text")).alias("p")).filter(F.size("p") > 0)
    p = p.select("r_id", F.size("p").alias("size"), F.least(F.size("p"), F.lit(PREFIX)).alias("n"), F.array_join(F.slice("p", 1, PREFIX), "\u0001").alias("key"), F.array_join("p", "\u0001").alias("whole"))
    lengths = [r[0] for r in p.select("n").distinct().collect()]  # at most PREFIX
    own = texts.select(F.col("id").alias("l_id"), F.col("text"), F.xxhash64("text").alias("h"))
    if not lengths:
        return own.join(p, F.lit(False)).select("l_id", "r_id", F.lit(0).alias("start"))
    grams = T.let(T.phrase_tokens(F.col("text")), lambda t: F.concat(*[_grams(t, n) for n in lengths]))
    rows = own.select("l_id", "h", F.explode(grams).alias("g")).select("l_id", "h", "g.start", "g.n", "g.key")
    hits = rows.join(broadcast_if_small(p), ["n", "key"]).select(F.col("l_id").alias("c_id"), F.col("h").alias("c_h"), "r_id", "start", "size", "whole")
    hits = hits.distinct().groupBy("c_id", "c_h").agg(F.collect_list(F.struct("r_id", "start", "size", "whole")).alias("hits"))
    again = own.join(hits, F.col("l_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")))
    same = lambda t: F.filter("hits", lambda c: F.array_join(F.slice(t, c["start"] + 1, c["size"]), "\u0001") == c["whole"])
    found = again.select("l_id", F.explode(T.let(T.phrase_tokens(F.col("text")), same)).alias("c"))
    return found.select("l_id", "c.r_id", "c.start")


def _grams(t: Column, n: int) -> Column:
    def gram(i: Column) -> Column:
        return F.struct(i.alias("start"), F.lit(n).alias("n"), T.token_run(t, i, n, "\u0001").alias("key"))

    some = F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(0), F.size(t) - n), gram))
    return F.coalesce(some, F.array().cast("array<struct<start:int,n:int,key:string>>"))


def cosine_top1(left: DataFrame, right: DataFrame, threshold: float | None = None) -> DataFrame:
    """(l_id, r_id, score): for each (id, vec) of left the most similar of right, another id, ties to the smaller.

    Every left vector meets every right one, in matrix products.
    """
    out = nearest.top1(left, right)
    return out if threshold is None else out.filter(F.col("score") > threshold)


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """(key, pos, mean) of vectors (key, vec); empty vectors add nothing."""
    return vectors.select(key, F.posexplode("vec").alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("mean"))
