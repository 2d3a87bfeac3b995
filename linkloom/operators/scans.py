"""Scans of statements into events, series and proceedings.

A statement is a row (subject, property, value, lang); lang is null but for texts, and a
qualifier has a property name of its own. A scan shuffles the statements once: optional
properties are conditional aggregates, not joins, and of several values the least is taken,
so that runs agree. Null subjects and properties are left out; repeated statements count once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .complete import is_conference, is_workshop

# Properties and classes of the public knowledge base.
TITLE, INSTANCE_OF, SERIES_OF, PROCEEDINGS_OF, LABEL = "P1476", "P31", "P179", "P4745", "label"
VOLUME, ORDINAL, DESCRIBED_AT = "P179/P478", "P179/P1545", "P973"
PROCEEDINGS_CLASS, VOLUMES_SERIES = "Q1143604", "Q27230297"
CONFERENCE, WORKSHOP, CONFERENCE_SERIES, WORKSHOP_SERIES = "Q2020153", "Q40444998", "Q47258130", "Q47459256"
EVENT_FIELDS = {
    "start_time": "P580",
    "end_time": "P582",
    "country": "P17",
    "location": "P276",
    "official_website": "P856",
    "acronym": "P1813",
    "colocated_with": "P11633",
    "dblp_id": "P10692",
    "wikicfp_id": "P5124",
    "part_of_series": "P179",
    "ordinal": "P179/P1545",
}
SERIES_FIELDS = {"official_website": "P856", "acronym": "P1813", "dblp_id": "P8926", "wikicfp_id": "P5127"}
PROCEEDING_FIELDS = {"acronym": "P1813", "pub_date": "P577", "ceurws_url": "P973", "dblp_id": "P8978"}
KINDS = {"start_time": "timestamp", "end_time": "timestamp", "pub_date": "timestamp", "ordinal": "int", "volume_number": "int"}
IDS = ("country", "location", "colocated_with", "part_of_series")


def _all(prop: str, lang: str | None = None) -> Column:
    """The distinct values of a property in order."""
    own = F.col("property") == prop
    return F.array_sort(F.collect_set(F.when(own if lang is None else own & (F.col("lang") == lang), F.col("value"))))


def _least(prop: str) -> Column:
    return F.min(F.when(F.col("property") == prop, F.col("value")))


def typed(df: DataFrame) -> DataFrame:
    """Known columns as numbers, times and bare ids; what can't be read as such is null."""
    kinds = {c: F.col(c).try_cast(k) for c, k in KINDS.items() if c in df.columns}
    return df.withColumns(kinds | {c: T.parse_qid(F.col(c)) for c in IDS if c in df.columns})


def described(statements: DataFrame, fields: dict[str, str], lang: str = "en") -> DataFrame:
    """(qid, label, titles, instance_of, one column for each field) of each subject.

    The label and the titles are those in the language; without a label the id stands in.
    """
    wanted = [TITLE, INSTANCE_OF, LABEL, *fields.values()]
    label = F.min(F.when((F.col("property") == LABEL) & (F.col("lang") == lang), F.col("value")))
    rows = statements.filter(F.col("property").isin(*wanted) & F.col("subject").isNotNull()).groupBy(T.parse_qid(F.col("subject")).alias("qid"))
    kinds = F.array_distinct(F.transform(_all(INSTANCE_OF), lambda x: T.parse_qid(x)))
    out = rows.agg(label.alias("label"), _all(TITLE, lang).alias("titles"), kinds.alias("instance_of"), *[_least(p).alias(c) for c, p in fields.items()])
    return out.withColumn("label", F.coalesce("label", "qid"))


def volumes(statements: DataFrame) -> DataFrame:
    """(proceeding, event, volume_number, ceurws_url): proceedings of the volumes' series that have a number, one row for each event."""
    has = lambda prop, value: F.bool_or((F.col("property") == prop) & (T.parse_qid(F.col("value")) == value))
    props = (INSTANCE_OF, SERIES_OF, VOLUME, PROCEEDINGS_OF, DESCRIBED_AT)
    rows = statements.filter(F.col("property").isin(*props)).groupBy(T.parse_qid(F.col("subject")).alias("proceeding"))
    found = rows.agg(
        has(INSTANCE_OF, PROCEEDINGS_CLASS).alias("is_proceeding"), has(SERIES_OF, VOLUMES_SERIES).alias("is_volume"), _all(PROCEEDINGS_OF).alias("events"),
        _least(VOLUME).alias("volume_number"), _least(DESCRIBED_AT).alias("ceurws_url"),
    ).filter("proceeding IS NOT NULL AND is_proceeding AND is_volume AND volume_number IS NOT NULL")
    return found.select("proceeding", F.explode("events").alias("event"), "volume_number", "ceurws_url").withColumn("event", T.parse_qid(F.col("event")))


def event_scan(statements: DataFrame, lang: str = "en") -> DataFrame:
    """Events that a volume is of, with all their titles."""
    known = volumes(statements).groupBy(F.col("event").alias("qid")).agg(F.min("ceurws_url").alias("ceurws_url"))
    return known.join(_described_or_bare(known, statements, EVENT_FIELDS, lang), "qid")


def series_scan(statements: DataFrame, lang: str = "en") -> DataFrame:
    """Series of the events that a volume is of, with all their titles."""
    of = statements.filter(F.col("property") == SERIES_OF).select(T.parse_qid(F.col("subject")).alias("event"), T.parse_qid(F.col("value")).alias("qid"))
    known = of.join(volumes(statements).select("event"), "event", "left_semi").filter("qid IS NOT NULL").select("qid").distinct()
    return _described_or_bare(known, statements, SERIES_FIELDS, lang)


def _described_or_bare(known: DataFrame, statements: DataFrame, fields: dict[str, str], lang: str) -> DataFrame:
    """Known ids with what is stated of them; an id of which nothing is stated keeps a row."""
    out = known.select("qid").join(described(statements, fields, lang), "qid", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"label": F.coalesce("label", "qid"), "titles": F.coalesce("titles", none), "instance_of": F.coalesce("instance_of", none)})


def proceedings_scan(statements: DataFrame, lang: str = "en") -> DataFrame:
    """(qid, label, event, volume_number, title, ...): volumes with a title in the language; those without one are left out."""
    known = volumes(statements).select(F.col("proceeding").alias("qid"), "event", "volume_number")
    told = described(statements, PROCEEDING_FIELDS, lang).filter(F.size("titles") > 0).withColumn("title", F.get("titles", 0)).drop("titles", "instance_of")
    return typed(known.join(told, "qid"))


def all_of(scan: DataFrame) -> DataFrame:
    """The scan with one title, the least, or null."""
    return typed(scan.withColumn("title", F.get("titles", 0)).drop("titles"))


def conferences(scan: DataFrame, kind: str = CONFERENCE) -> DataFrame:
    """Items with a title that names a conference, or any where the item is an instance of the class, but no workshop; the title is the least of those."""
    instance = F.array_contains("instance_of", kind)
    return _tagged(scan, F.filter("titles", lambda t: is_conference(t, instance)), F.lit(False), "CONFERENCE")


def workshops(scan: DataFrame, kind: str = WORKSHOP) -> DataFrame:
    """Items with a title that names a workshop, and instances of the class, also without a title."""
    instance = F.array_contains("instance_of", kind)
    return _tagged(scan, F.filter("titles", lambda t: is_workshop(t, instance)), instance, "WORKSHOP")


def _tagged(scan: DataFrame, titles: Column, anyway: Column, tag: str) -> DataFrame:
    return all_of(scan.withColumn("titles", titles).filter((F.size("titles") > 0) | anyway)).withColumn("type", F.lit(tag))


def chained(**tables: DataFrame) -> DataFrame:
    """(kind, the columns that all tables have): tables of unlike shapes one after another."""
    first = next(iter(tables.values()))
    shared = [c for c in first.columns if all(c in t.columns for t in tables.values())]
    parts = [t.select(F.lit(kind).alias("kind"), *shared) for kind, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def head(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in a stated order, whose last columns should be a key."""
    return df.orderBy(*order).limit(n)


def matched_titles(matches: DataFrame, events: DataFrame, series: DataFrame) -> DataFrame:
    """(event_title, series_title) of a match log: full matches by the series' title or label, others by the name they carry.

    Matches without a title on either side, or with an empty one, are left out.
    """
    named = lambda df, of: df.select(F.col("qid").alias(f"{of}_qid"), T.title_or_label(F.col("title"), F.col("label")).alias(f"{of}_title"))
    full = matches.filter(F.col("series_kind") == "full").select("event_qid", "series_qid").join(named(series, "series"), "series_qid").select("event_qid", "series_title")
    other = matches.filter(F.col("series_kind") != "full").select("event_qid", F.col("series_name").alias("series_title"))
    out = full.unionByName(other).join(named(events, "event"), "event_qid").select("event_title", "series_title")
    return out.filter(reduce(and_, [F.coalesce(F.col(c) != "", F.lit(False)) for c in out.columns]))
