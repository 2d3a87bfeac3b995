"""Ranks within keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window ranks, about.
RANKED = 200_000


def rank_within(df: DataFrame, key: str, counts: dict[int, int], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds each row's rank, from 0 and gapless, within its key.

    counts: rows of each key, of which there are boundedly many. A key of more than RANKED
    rows is split into salts that are ranked apart; a salt's rows start after those of the
    salts before it.
    """
    hot = {k: c // RANKED + 1 for k, c in counts.items() if c > RANKED}
    salts = F.lit(1)
    if hot:
        of = F.create_map(*[x for k, n in hot.items() for x in (F.lit(k).cast("long"), F.lit(n))])
        salts = F.coalesce(F.try_element_at(of, F.col(key).cast("long")), F.lit(1))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), salts))
    within = salted.withColumn("_within", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1)
    if not hot:
        return within.withColumn(name, F.col("_within").cast("long")).drop("_salt", "_within")
    base = salted.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    base = base.select(key, "_salt", (F.sum("_n").over(Window.partitionBy(key).orderBy("_salt")) - F.col("_n")).alias("_base"))
    return within.join(base, [key, "_salt"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_salt", "_within", "_base")
