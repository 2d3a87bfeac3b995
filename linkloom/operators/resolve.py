"""Resolving page events and series to known series: ids, breadcrumbs, venue records and ranked rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .similarity import broadcast_if_small, top1


def children_by_prefix(series: DataFrame, events: DataFrame, boundary: bool = True) -> DataFrame:
    """(series_id, events): event ids below each series id; series without events keep an empty list.

    With a boundary, the id must go on after a slash (an equi join on the first two parts of
    the id); without, any id that begins with the series id counts.
    """
    if boundary:
        keyed = events.select(F.col("id").alias("event"), F.substring_index("id", "/", 2).alias("id")).filter(F.col("event") != F.col("id"))
        joined = series.select("id").join(keyed, "id", "left")
    else:
        e = events.select(F.col("id").alias("event"))
        joined = series.select("id").join(broadcast_if_small(e), F.startswith("event", "id") & (F.col("event") != F.col("id")), "left")
    return joined.groupBy(F.col("id").alias("series_id")).agg(F.array_sort(F.collect_list("event")).alias("events"))


def parents(events: DataFrame) -> DataFrame:
    """(id, pos, parent_id, parent_name): breadcrumb parents, else the id's stem, named by its last part."""
    fallback = F.array(F.struct(T.id_stem(F.col("id")).alias("dblp_id"), T.id_name(T.id_stem(F.col("id"))).alias("name")))
    found = F.when(F.size("parents") > 0, F.col("parents")).otherwise(fallback)
    return events.select("id", F.posexplode(found).alias("pos", "p")).select("id", "pos", F.col("p.dblp_id").alias("parent_id"), F.col("p.name").alias("parent_name"))


def _named(c: Column, word: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False))


def conference_series(parent_rows: DataFrame) -> DataFrame:
    """(id, parent_id): an only parent, else the first that is a prefix of the id; not if it is a workshop by name."""
    n = F.size(F.col("all"))
    grouped = parent_rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "parent_id", "parent_name"))).alias("all"))
    prefix = F.get(F.filter("all", lambda p: F.startswith(F.col("id"), p["parent_id"])), 0)
    best = F.when(n == 1, F.get("all", 0)).otherwise(prefix)
    out = grouped.select("id", best.alias("b")).filter(F.col("b").isNotNull())
    return out.filter(~(_named(F.col("b.parent_name"), "workshop") & ~_named(F.col("b.parent_name"), "conference"))).select("id", F.col("b.parent_id").alias("parent_id"))


def workshop_series(events: DataFrame, parent_rows: DataFrame, venue: DataFrame) -> DataFrame:
    """(id, parent_id, series_name, rule): a cascade for events (id, title, year).

    1: an only parent with 'workshop' in its name. 2: venue records (series_id, name,
    reference, years) of any parent whose name holds the title's x@y abbreviation and whose
    years hold the event's, if both are known. 3: an only workshop-named parent whose name
    or id holds the abbreviation.
    """
    shops = parent_rows.filter(_named(F.col("parent_name"), "workshop"))
    one = shops.groupBy("id").agg(F.count("*").alias("n"), F.min("parent_id").alias("parent_id")).filter("n = 1")
    one = one.select("id", "parent_id", F.lit(None).cast("string").alias("series_name"), F.lit(1).alias("rule"))
    abbreviated = events.withColumn("abbr", F.lower(T.at_abbreviation(F.col("title")))).filter(F.col("abbr").isNotNull()).select("id", "abbr", "year")
    near = abbreviated.join(parent_rows, "id").join(venue.withColumnRenamed("series_id", "parent_id").select("parent_id", "name", "reference", "years"), "parent_id")
    fits = F.contains(F.lower("name"), F.col("abbr")) & (F.col("year").isNull() | F.col("years").isNull() | T.in_year_range(F.col("year"), F.col("years")))
    two = top1(near.filter(fits), "id", F.col("pos"), F.col("name")).select("id", F.col("reference").alias("parent_id"), F.when(F.col("reference").isNull(), F.col("name")).alias("series_name"), F.lit(2).alias("rule"))
    held = abbreviated.join(shops, "id").filter(F.contains(F.lower("parent_name"), F.col("abbr")) | F.contains("parent_id", F.col("abbr")))
    three = held.groupBy("id").agg(F.count("*").alias("n"), F.min("parent_id").alias("parent_id")).filter("n = 1")
    three = three.select("id", "parent_id", F.lit(None).cast("string").alias("series_name"), F.lit(3).alias("rule"))
    return top1(one.unionByName(two).unionByName(three), "id", F.col("rule"))


def resolved_events(events: DataFrame, parent_rows: DataFrame, venue: DataFrame) -> DataFrame:
    """(id, parent_id, series_name): conferences and workshops each by their rules; other types aren't resolved."""
    typed = parent_rows.join(events.select("id", "type"), "id")
    conferences = conference_series(typed.filter(F.col("type") == "CONFERENCE").drop("type")).withColumn("series_name", F.lit(None).cast("string"))
    shops = workshop_series(events.filter(F.col("type") == "WORKSHOP"), typed.filter(F.col("type") == "WORKSHOP").drop("type"), venue)
    return conferences.select("id", "parent_id", "series_name").unionByName(shops.select("id", "parent_id", "series_name"))


#: Characters of the piece by which a name is looked up in texts; shorter names are looked up whole.
PIECE = 4


def first_holding(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, first): each of names (name) that a text of texts (text, first) contains, with the least first of those texts.

    A name is looked up by the piece of it that the fewest texts hold, then compared whole; a
    name with a piece that no text holds has none. Names under PIECE characters are pieces themselves.
    """
    names = names.filter(F.col("name").isNotNull()).select("name").distinct()
    texts = texts.filter(F.col("text").isNotNull()).groupBy("text").agg(F.min("first").alias("first"))
    pieces = texts.select("text", "first", F.explode(T.char_ngrams(F.col("text"), PIECE)).alias("piece"))
    held = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    asked = names.filter(F.length("name") >= PIECE).select("name", F.explode(T.char_ngrams(F.col("name"), PIECE)).alias("piece"))
    asked = asked.join(broadcast_if_small(held), "piece", "left")
    rarest = asked.groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("p")).filter("p.n > 0").select("name", F.col("p.piece").alias("piece"))
    found = rarest.join(pieces, "piece").filter(F.contains("text", "name")).select("name", "first")
    whole = F.concat(F.array(F.lit("")), *[T.char_ngrams(F.col("text"), n) for n in range(1, PIECE)])
    short = texts.select(F.explode(whole).alias("name"), "first").groupBy("name").agg(F.min("first").alias("first"))
    return found.groupBy("name").agg(F.min("first").alias("first")).unionByName(names.filter(F.length("name") < PIECE).join(short, "name"))


def series_by_rules(page_series: DataFrame, series: DataFrame) -> DataFrame:
    """(dblp_id, qid, rule): page series (dblp_id, name, abbreviation) and the first known series (qid, seq, dblp_id, title, label, acronym).

    0: equal ids. Else the first series in order with the name in its title, the
    abbreviation as its acronym, or the name in its label. Series without a seq come last.
    """
    first = F.struct(F.col("seq").isNull().alias("late"), "seq", "qid")

    def by(key: str, name: str) -> DataFrame:
        return series.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).agg(F.min(first).alias(f"by_{name}"))

    p = page_series.select("dblp_id", "name", "abbreviation").join(by("dblp_id", "dblp_id"), "dblp_id", "left")
    p = p.select("dblp_id", "by_dblp_id", *[F.when(F.col("by_dblp_id").isNull(), F.col(c)).alias(c) for c in ("name", "abbreviation")])
    texts = series.select(F.explode(F.array("title", "label")).alias("text"), first.alias("first"))
    named = first_holding(p.select("name"), texts).withColumnRenamed("first", "by_name")
    p = p.join(by("acronym", "abbreviation"), "abbreviation", "left").join(named, "name", "left")
    rule = F.when(F.col("by_dblp_id").isNull(), 1).otherwise(0)
    p = p.select("dblp_id", rule.alias("rule"), F.coalesce("by_dblp_id", F.least("by_abbreviation", "by_name")).alias("first")).filter(F.col("first").isNotNull())
    best = p.groupBy("dblp_id").agg(F.min(F.struct("rule", "first")).alias("m"))
    return best.select("dblp_id", F.col("m.first.qid").alias("qid"), F.col("m.rule").alias("rule"))


def page_matches(events: DataFrame, parent_rows: DataFrame, venue: DataFrame, page_series: DataFrame, series: DataFrame) -> DataFrame:
    """(id, dblp_id, series_name, series_qid, series_kind) of events that their pages resolve.

    full: the page's series is a known one; page: it isn't; string: only its name is known.
    """
    found = resolved_events(events, parent_rows, venue).withColumnRenamed("parent_id", "dblp_id")
    known = series_by_rules(page_series, series).select("dblp_id", F.col("qid").alias("series_qid"))
    kind = F.when(F.col("series_qid").isNotNull(), "full").when(F.col("dblp_id").isNotNull(), "page").otherwise("string")
    return found.join(known, "dblp_id", "left").withColumn("series_kind", kind)


def upgraded(matches: DataFrame, known: DataFrame) -> DataFrame:
    """Page matches (event_qid, dblp_id) with the known series' qid where there is one."""
    return matches.join(known.select("dblp_id", F.col("qid").alias("series_qid")), "dblp_id", "left").withColumn("series_kind", F.when(F.col("series_qid").isNotNull(), "full").otherwise("page"))


def followed(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """Pages (id, html) with the target page's content where targets (id, target) redirects them."""
    t = targets.filter(F.col("target").isNotNull()).join(pages.select(F.col("id").alias("target"), F.col("html").alias("_html")), "target").select("id", "_html")
    return pages.join(t, "id", "left").select("id", F.coalesce("_html", "html").alias("html"))


def read_through(ids: DataFrame, cached: DataFrame, fetched: DataFrame) -> DataFrame:
    """(id, html): the cached page unless it is missing or empty, else the fetched one."""
    c, f = cached.select("id", F.nullif("html", F.lit("")).alias("_c")), fetched.select("id", F.col("html").alias("_f"))
    return ids.join(c, "id", "left").join(f, "id", "left").select("id", F.coalesce("_c", "_f").alias("html"))


def same_time(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(id, ids): for each left id the right ids with the same times, null if there are none."""
    r = right.groupBy(*keys).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return left.join(r, keys, "left").select("id", "ids")


def titles_of(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, titles): the first title (by seq) of each of the row's ids, in their order."""
    first = titles.groupBy("id").agg(F.min_by("title", "seq").alias("title")).select(F.col("id").alias("of"), "title")
    out = rows.select("id", F.posexplode("ids").alias("pos", "of")).join(first, "of")
    return out.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("titles"))
