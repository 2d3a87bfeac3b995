"""Titles, ids, years and tokens: built-in functions only, null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character, spelled out so that Java, RE2 and Python agree on it.
WORD = r"[\p{L}\p{N}_]"
# English ordinals.
ORDINALS = {
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
    "eleventh": 11, "twelfth": 12, "thirteenth": 13, "fourteenth": 14, "fifteenth": 15, "sixteenth": 16, "seventeenth": 17,
    "eighteenth": 18, "nineteenth": 19, "twentieth": 20, "thirtieth": 30, "fortieth": 40, "fiftieth": 50, "sixtieth": 60,
    "seventieth": 70, "eightieth": 80, "ninetieth": 90, "hundredth": 100,
}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one (an empty match stays empty)."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def _int(c: Column) -> Column:
    return c.try_cast("int")


# Ids
def parse_qid(c: Column, prefix: str = "http://www.wikidata.org/entity/") -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def is_qid(c: Column) -> Column:
    return c.rlike("^Q[0-9]+")


def url_to_id(c: Column, base: str) -> Column:
    """Without the base, then without /index.html, then without .html."""
    c = F.when(c.startswith(base), F.substring(c, len(base) + 1, 1 << 30)).otherwise(c)
    return F.regexp_replace(F.regexp_replace(c, r"/index\.html$", ""), r"\.html$", "")


def clean_id(c: Column) -> Column:
    """Null for what isn't an id (a URL or a file name); without one slash at its end."""
    return F.when(~(c.startswith("https") | c.endswith(".html")), F.regexp_replace(c, "/$", ""))


def id_stem(c: Column) -> Column:
    return F.regexp_replace(c, "/[^/]*$", "")


def id_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def slashes(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def is_series_id(c: Column, prefix: str = "conf/") -> Column:
    return c.startswith(prefix) & (slashes(c) == 1)


def is_event_id(c: Column, prefix: str = "conf/") -> Column:
    return c.startswith(prefix) & (slashes(c) == 2)


# Titles
_VIRTUAL = r"(\[virtual(?: event)?\])"


def virtual_location(c: Column) -> Column:
    """(title, location): a bracketed virtual venue, cut from the title where it ends it."""
    found = extracted(c, _VIRTUAL)
    title = F.when(F.rtrim(c).endswith(found), F.rtrim(F.regexp_replace(F.rtrim(c), _VIRTUAL + "$", ""))).otherwise(c)
    return F.struct(F.coalesce(title, c).alias("title"), found.alias("location"))


def split_location(c: Column) -> Column:
    """(title, location) at the first colon, else at an only semicolon; later parts are dropped."""
    virtual = virtual_location(c)
    one = (F.length(c) - F.length(F.replace(c, F.lit(";"), F.lit("")))) == 1
    parts = F.when(c.contains(":"), F.split(c, ":")).when(virtual["location"].isNull() & one, F.split(c, ";"))
    title = F.when(parts.isNotNull(), F.rtrim(F.get(parts, 0))).otherwise(virtual["title"])
    location = F.when(parts.isNotNull(), F.trim(F.get(parts, 1))).otherwise(virtual["location"])
    return F.struct(title.alias("title"), location.alias("location"))


def year(c: Column) -> Column:
    """Four digits at the end, else the first four digits in a row."""
    return _int(F.coalesce(extracted(c, r"([0-9]{4})$"), extracted(c, r"([0-9]{4})")))


def is_realistic_year(c: Column, now: int) -> Column:
    return (c > 1900) & (c <= now)


def ordinal(c: Column) -> Column:
    return _int(extracted(c, r"^([0-9]+)(?:rd|nd|th|st|\.)"))


def event_from_title(c: Column) -> Column:
    """(title, year, location, ordinal); the title keeps its year."""
    split = split_location(c)
    return F.struct(split["title"].alias("title"), year(split["title"]).alias("year"), split["location"].alias("location"), ordinal(split["title"]).alias("ordinal"))


def events_from_header(c: Column) -> Column:
    """Events of a header that joins several titles by ' / ' before a year and a place they share."""
    split = split_location(c)
    shared = year(split["title"])
    stem = F.when(shared.isNotNull(), F.rtrim(F.regexp_replace(split["title"], r"[0-9]{4}$", ""))).otherwise(split["title"])
    full = lambda part: F.trim(F.concat_ws(" ", part, shared.cast("string")))
    return F.transform(F.split(stem, " / "), lambda p: F.struct(full(p).alias("title"), shared.alias("year"), split["location"].alias("location"), ordinal(p).alias("ordinal")))


def acronym(c: Column) -> Column:
    return extracted(c, r"\((.*?)\)")


def abbreviation(c: Column) -> Column:
    return extracted(c, rf"\(({WORD}{{1,20}})\)")


def at_abbreviation(c: Column) -> Column:
    return extracted(c, rf"({WORD}+)@{WORD}+")


def free_ordinal(c: Column) -> Column:
    """An ordinal anywhere: digits with a suffix, else an ordinal word up to hundredth."""
    words = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])
    tens = F.create_map(*[F.lit(x) for kv in TENS.items() for x in kv])
    low = F.lower(c)
    digits = _int(extracted(low, r"\b([0-9]+)(?:st|nd|rd|th)\b"))
    both = rf"\b({'|'.join(TENS)})[- ]({'|'.join(ORDINALS)})\b"
    pair = F.try_element_at(tens, extracted(low, both, 1)) + F.try_element_at(words, extracted(low, both, 2))
    word = F.try_element_at(words, extracted(low, rf"\b({'|'.join(ORDINALS)})\b"))
    return F.coalesce(digits, pair, word)


def relation_qualifier(c: Column) -> Column:
    return extracted(c, r"\(([^)]*)\)")


def discontinuation_year(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"as of ([0-9]{4}), this venue has been discontinued"), F.lit(1))
    return F.when(F.size(found) == 1, _int(F.get(found, 0)))


# Year ranges
def year_range(c: Column) -> Column:
    """(since, until, years) of a phrase like 'since 2001, 2003-2005, 2009'; null if it names no year."""
    since, until = _int(extracted(c, r"since ([0-9]{4})")), _int(extracted(c, r"until ([0-9]{4})"))
    spans = F.regexp_extract_all(c, F.lit(r"([0-9]{4}-[0-9]{4})"), F.lit(1))

    def spread(s: Column) -> Column:
        a, b = F.substring(s, 1, 4).cast("int"), F.substring(s, 6, 4).cast("int")
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    # Years that stand alone: not before a range's dash, spaces or not, and not right after one.
    single = F.transform(F.regexp_extract_all(c, F.lit(r"\b(?<!-)([0-9]{4})(?!\s*-\s*[0-9]{4}\b)"), F.lit(1)), lambda y: y.cast("int"))
    single = F.filter(single, lambda y: ~(F.coalesce(y == since, F.lit(False)) | F.coalesce(y == until, F.lit(False))))
    years = F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(spans, spread)), single)))
    out = F.struct(since.alias("since"), until.alias("until"), years.alias("years"))
    return F.when(since.isNotNull() | until.isNotNull() | (F.size(years) > 0), out)


def in_year_range(y: Column, r: Column) -> Column:
    return F.coalesce(r["since"] <= y, F.lit(True)) & F.coalesce(y <= r["until"], F.lit(True)) & ((F.size(r["years"]) == 0) | F.array_contains(r["years"], y))


# Tokens, sets and vectors
def clean_string(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", "")


def spaced(c: Column) -> Column:
    """Special characters become spaces, runs of spaces one."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"\s+"), "")


def content_words(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words of the cleaned string without stop words."""
    return F.filter(words(F.lower(clean_string(c))), lambda w: ~w.isin(*stop))


def terms(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case runs of two or more word characters, for TF-IDF."""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"({WORD}{{2,}})"), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def phrase_tokens(c: Column) -> Column:
    """Runs of word characters, and every other visible character on its own."""
    return F.regexp_extract_all(c, F.lit(rf"({WORD}+|[^\p{{L}}\p{{N}}_\s])"), F.lit(1))


def char_ngrams(c: Column, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(grams)).when(c.isNotNull(), F.array().cast("array<string>"))


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it.

    The optimiser puts expressions in the place of their names when it moves filters (also
    those that explode implies), and inside a loop over an array they would run each time.
    """
    return F.get(F.transform(F.array(value), lambda x: f(x)), 0)


def token_ngrams(tokens: Column, n: int) -> Column:
    def grams(t: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: token_run(t, i, n))
        return F.when(F.size(t) >= n, F.array_distinct(found)).when(t.isNotNull(), F.array().cast("array<string>"))

    return let(tokens, grams)


def token_run(tokens: Column, i: Column, n: int, separator: str = " ") -> Column:
    """n tokens from place i (from 0) on; slice() would copy the whole array for each run."""
    return F.concat_ws(separator, *[F.get(tokens, i + k) for k in range(n)])


def dice(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def contains_synonym(c: Column, synonyms: list[str]) -> Column:
    return c.rlike(rf"(?i)(?<!{WORD})(?:{'|'.join(synonyms)})(?!{WORD})")


def title_or_label(title: Column, label: Column) -> Column:
    return F.coalesce(title, label)


def acronym_of(label: Column, title: Column) -> Column:
    """The label's acronym unless it is empty, else the title's."""
    return F.coalesce(F.nullif(acronym(label), F.lit("")), acronym(title))


def json_title(payload: Column, keys: tuple[str, ...] = ("cvb.voltitle", "cvb.title")) -> Column:
    """The first of the dotted keys with a value that isn't empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, f"$['{k}']"), F.lit("")) for k in keys])
