"""Types, attribute completion and patching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def is_conference(title: Column, instance_of: Column, word: str = "conference", not_word: str = "workshop") -> Column:
    """(names the word or is an instance) and doesn't name the other; null titles are dropped by three-valued logic."""
    low = F.lower(title)
    return (F.contains(low, F.lit(word)) | instance_of) & ~F.contains(low, F.lit(not_word))


def is_workshop(title: Column, instance_of: Column, word: str = "workshop") -> Column:
    return F.contains(F.lower(title), F.lit(word)) | instance_of


def resolved_type(conference: Column, workshop: Column) -> Column:
    """WORKSHOP wins over CONFERENCE; else UNKNOWN."""
    return F.when(workshop, "WORKSHOP").when(conference, "CONFERENCE").otherwise("UNKNOWN")


def without_parent(events: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Events whose part_of_series is null [and that no match has]."""
    out = events.filter(F.col("part_of_series").isNull())
    return out if matches is None else out.join(matches.select(F.col("event_qid").alias("qid")), "qid", "left_anti")


def uncompleted(items: DataFrame, attr: str, completions: DataFrame, key: str = "qid") -> DataFrame:
    """Items whose attribute is null and that have no completion of it; items without a key are left out."""
    done = completions.filter(F.col("attr") == attr).select(F.col("qid").alias(key))
    return items.filter(F.col(attr).isNull() & F.col(key).isNotNull()).join(done, key, "left_anti")


def last_completions(completions: DataFrame, attrs: list[str]) -> DataFrame:
    """(qid, one column for each attribute): the last completion by seq."""
    last = [F.max_by(F.when(F.col("attr") == a, F.col("value")), F.when(F.col("attr") == a, F.col("seq"))).alias(a) for a in attrs]
    return completions.groupBy("qid").agg(*last)


def patched(items: DataFrame, completions: DataFrame, attrs: list[str], key: str = "qid") -> DataFrame:
    """Items with their last completions, which override what was there; items themselves stay unchanged."""
    new = last_completions(completions, attrs).select(F.col("qid").alias(key), *[F.col(a).alias(f"_new_{a}") for a in attrs])
    kinds = dict(items.dtypes)
    out = items.join(new, key, "left")
    for a in attrs:
        out = out.withColumn(a, F.coalesce(F.col(f"_new_{a}").cast(kinds[a]), F.col(a)))
    return out.drop(*[f"_new_{a}" for a in attrs])


def completions_by_item(completions: DataFrame) -> DataFrame:
    """(qid, found): completions in order of seq."""
    return completions.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("seq", "attr", "value", "found_by"))).alias("found"))


def _open(items: DataFrame, attr: str, completions: DataFrame | None) -> DataFrame:
    """Items that still need the attribute; without a log of completions, those where it is null."""
    if completions is not None:
        return uncompleted(items, attr, completions)
    return items.filter(F.col(attr).isNull() & F.col("qid").isNotNull())


def complete_ordinals(items: DataFrame, completions: DataFrame | None = None) -> DataFrame:
    """Completion rows of ordinals read from the title, else the label, where none is set or logged."""
    found = T.free_ordinal(T.title_or_label(F.col("title"), F.col("label")))
    return _rows(_open(items, "ordinal", completions), "ordinal", found)


def complete_acronyms(items: DataFrame, completions: DataFrame | None = None) -> DataFrame:
    return _rows(_open(items, "acronym", completions), "acronym", T.acronym_of(F.col("label"), F.col("title")))


def complete_titles(items: DataFrame, payloads: DataFrame, pages: DataFrame | None = None, completions: DataFrame | None = None) -> DataFrame:
    """Titles of volumes that have none, by precedence: the JSON payload's keys (volume_number, payload), else the page's title (volume_number, title)."""
    attr = "ceurws_title"
    items = _open(items if attr in items.columns else items.withColumn(attr, F.lit(None).cast("string")), attr, completions)
    found = payloads.select("volume_number", T.json_title(F.col("payload")).alias("value"), F.lit(0).alias("place"))
    if pages is not None:
        found = found.unionByName(pages.select("volume_number", F.col("title").alias("value"), F.lit(1).alias("place")))
    found = found.filter(F.col("value").isNotNull()).groupBy("volume_number").agg(F.min(F.struct("place", "value"))["value"].alias("value"))
    out = items.select("qid", "volume_number").join(found, "volume_number")
    return _rows(out, attr, F.col("value"))


def in_language(items: DataFrame, labels: DataFrame, lang: str, key: str = "qid") -> DataFrame:
    """Items with their label in a language; the language stands in the join, so items without one stay."""
    own = labels.filter(F.col("lang") == lang).groupBy(key).agg(F.min("label").alias("label"))
    return items.join(own, key, "left")


def known_good(items: DataFrame, bad: DataFrame, key: str = "qid") -> DataFrame:
    """Items without those that are known to be wrong; items without a key stay."""
    return items.join(bad.select(key).distinct(), key, "left_anti")


def whole(items: DataFrame, attrs: list[str]) -> DataFrame:
    """Items that have all of the attributes."""
    return items.dropna(subset=attrs)


def title_pairs(matches: DataFrame, events: DataFrame, series: DataFrame) -> DataFrame:
    """(event_title, series_title) of matches (event_qid, series_qid), labels standing in for titles; pairs that lack one are left out."""
    named = lambda df, of: df.select(F.col("qid").alias(f"{of}_qid"), T.title_or_label(F.col("title"), F.col("label")).alias(f"{of}_title"))
    out = matches.join(named(events, "event"), "event_qid").join(named(series, "series"), "series_qid")
    return out.select("event_title", "series_title").dropna()


def _rows(items: DataFrame, attr: str, value: Column, found_by: str = "completion") -> DataFrame:
    out = items.select("qid", F.lit(attr).alias("attr"), value.cast("string").alias("value"), F.lit(found_by).alias("found_by"))
    return out.filter(F.col("value").isNotNull())


def annual_series(proceedings: DataFrame, events: DataFrame, synonyms: list[str]) -> DataFrame:
    """Distinct series of the events whose proceedings call themselves annual."""
    annual = proceedings.filter(T.contains_synonym(F.col("title"), synonyms)).select(F.col("event").alias("qid"))
    return events.join(annual, "qid", "left_semi").filter(F.col("part_of_series").isNotNull()).select("part_of_series").distinct()


def last_by(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(seq)).alias("r")).select("r.*")


def first_by(df: DataFrame, key: str, seq: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.col(seq)).alias("r")).select("r.*")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed; names that aren't there are left out."""
    return df.withColumnsRenamed(names)


def corrected(df: DataFrame, corrections: DataFrame, key: str, attr: str) -> DataFrame:
    """attr overwritten where the corrections table (key, attr) has the key."""
    new = corrections.select(key, F.col(attr).alias("_c"))
    return df.join(new, key, "left").withColumn(attr, F.coalesce("_c", attr)).drop("_c")


def has_columns(df: DataFrame, names: list[str]) -> bool:
    return set(names) <= set(df.columns)


def sampled(df: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """One value of each attribute for each group: the least, so that runs agree."""
    return df.groupBy(*keys).agg(*[F.min(a).alias(a) for a in attrs])


def concatenated(df: DataFrame, keys: list[str], attr: str, separator: str = " ") -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(attr)), separator).alias(attr))


def split_set(c: Column, prefix: str = "http://www.wikidata.org/entity/") -> Column:
    """Distinct ids of a space-joined list."""
    return F.array_distinct(F.transform(F.split(c, " "), lambda x: T.parse_qid(x, prefix)))


def hash_split(df: DataFrame, key: str, share: float = 0.3, buckets: int = 100, hashed: Column | None = None) -> DataFrame:
    """A deterministic test flag by the key's hash, or by another whole number."""
    number = F.xxhash64(key) if hashed is None else hashed
    return df.withColumn("is_test", F.pmod(number, F.lit(buckets)) < round(share * buckets))
