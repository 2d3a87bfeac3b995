"""Registered queries of the library over the driver's tables, and their SQL twins.

Long texts play the events, ``benchmark`` passages and part names the series; the mapping
follows the roles each table can play. Every query reads whole tables.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import html as H
from .functions import text as T
from .operators import complete, ensemble, resolve, runs, scans, similarity
from .plans import learning, tuning
from .sources import tables
from .sources.tables import LITERAL_SERIES

FLAGSHIP = "containment_match"
QUERIES: dict = {}
ORACLES: dict = {}
W = r"[\p{L}\p{N}_]"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _texts(spark, sf, table="documents", key="doc_id", text="text"):
    return _read(spark, sf, table).select(F.col(key).alias("id"), F.col(text).alias("text"))


def _names(spark, sf):
    """Distinct part names with the least key."""
    return _read(spark, sf, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("id"))


_NAMES = "names AS (SELECT p_name AS text, min(p_partkey) AS id FROM part GROUP BY p_name)"


# Containment, exact titles, phrases
@query("""
SELECT doc_id, lang, item_id FROM (
  SELECT d.doc_id, d.lang, b.item_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY b.item_id) AS r
  FROM documents d JOIN benchmark b ON contains(d.text, b.text)) WHERE r = 1""")
def containment_match(spark, sf):
    """The first passage that each document contains."""
    pairs = similarity.containment_pairs(_texts(spark, sf), _texts(spark, sf, "benchmark", "item_id"))
    best = pairs.groupBy("l_id").agg(F.min("r_id").alias("item_id"))
    return best.join(_read(spark, sf, "documents").select(F.col("doc_id").alias("l_id"), "lang"), "l_id").select(F.col("l_id").alias("doc_id"), "lang", "item_id")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment_all_pairs(spark, sf):
    pairs = similarity.containment_pairs(_texts(spark, sf), _texts(spark, sf, "benchmark", "item_id"))
    return pairs.select(F.col("l_id").alias("doc_id"), F.col("r_id").alias("item_id"))


@query("SELECT d.lang, count(*) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.lang")
def containment_by_lang(spark, sf):
    pairs = similarity.containment_pairs(_texts(spark, sf), _texts(spark, sf, "benchmark", "item_id"))
    langs = _read(spark, sf, "documents").select(F.col("doc_id").alias("l_id"), "lang")
    return pairs.join(langs, "l_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 50) AND p_size <> 50")
def exact_title_semi(spark, sf):
    """All records whose title is also a title of the other set."""
    part = _read(spark, sf, "part")
    return part.filter("p_size <> 50").join(part.filter("p_size = 50").select("p_name"), "p_name", "left_semi").select("p_partkey", "p_name")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def unmatched_anti(spark, sf):
    pairs = similarity.containment_pairs(_texts(spark, sf), _texts(spark, sf, "benchmark", "item_id")).select(F.col("l_id").alias("doc_id"))
    return ensemble.remainder(_read(spark, sf, "documents").select("doc_id", "lang"), pairs, "doc_id")


_PHRASE = r"""
t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t FROM documents),
p AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS p FROM benchmark),
hits AS (
  SELECT doc_id, item_id, CAST(unnest(range(0, len(t) - len(p) + 1)) AS INTEGER) AS start, t, p FROM t, p WHERE len(p) > 0 AND len(t) >= len(p) AND list_has_all(t, p)),
phrases AS (SELECT doc_id, item_id, start FROM hits WHERE t[start + 1 : start + len(p)] = p)"""


def _phrases(spark, sf):
    return similarity.phrase_pairs(_texts(spark, sf), _texts(spark, sf, "benchmark", "item_id"))


@query(f"""WITH {_PHRASE}
SELECT doc_id, item_id, start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, item_id) AS r FROM phrases) WHERE r = 1""")
def phrase_match_top1(spark, sf):
    """The first known phrase in each text, as a token sequence."""
    return similarity.top1(_phrases(spark, sf), "l_id", F.col("start"), F.col("r_id")).select(F.col("l_id").alias("doc_id"), F.col("r_id").alias("item_id"), "start")


@query(f"""WITH {_PHRASE}
SELECT doc_id, item_id, start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start DESC, item_id DESC) AS r FROM phrases) WHERE r = 1""")
def phrase_match_last(spark, sf):
    return similarity.top1(_phrases(spark, sf), "l_id", F.desc("start"), F.desc("r_id")).select(F.col("l_id").alias("doc_id"), F.col("r_id").alias("item_id"), "start")


@query(rf"""WITH {_PHRASE}
SELECT phrases.doc_id, min(item_id) AS item_id FROM phrases JOIN documents USING (doc_id) WHERE regexp_matches(text, '\d') GROUP BY phrases.doc_id""")
def phrase_match_with_attribute(spark, sf):
    """The phrase matcher on the records that have the attribute."""
    some = _read(spark, sf, "documents").filter(F.col("text").rlike("[0-9]")).select(F.col("doc_id").alias("l_id"))
    return _phrases(spark, sf).join(some, "l_id", "left_semi").groupBy(F.col("l_id").alias("doc_id")).agg(F.min("r_id").alias("item_id"))


# Set similarity
_GRAMS = f"""{_NAMES},
g AS (SELECT id, list_distinct(list_transform(range(1, length(text) - 1), lambda i : substr(text, i, 3))) AS g FROM names),
pairs AS (SELECT a.id AS l_id, b.id AS r_id, len(list_intersect(a.g, b.g)) AS inter, len(a.g) AS l_n, len(b.g) AS r_n FROM g a JOIN g b ON a.id <> b.id)"""


def _gram_pairs(spark, sf, measure, threshold):
    sets = _names(spark, sf).select("id", T.char_ngrams(F.col("text"), 3).alias("grams"))
    return similarity.set_similarity_pairs(sets, sets, measure, threshold).filter("l_id <> r_id")


@query(f"""WITH {_GRAMS}
SELECT l_id, r_id, CAST(inter AS INTEGER) AS inter, round(2.0 * inter / (l_n + r_n), 6) AS score FROM pairs WHERE 10 * 2 * inter >= 6 * (l_n + r_n)""")
def ngram_dice_pairs(spark, sf):
    return _gram_pairs(spark, sf, "dice", Fraction(3, 5)).select("l_id", "r_id", "inter", F.round("score", 6).alias("score"))


@query(f"""WITH {_GRAMS}
SELECT l_id, r_id, round(s, 6) AS score FROM (
  SELECT *, 2.0 * inter / (l_n + r_n) AS s, row_number() OVER (PARTITION BY l_id ORDER BY 2.0 * inter / (l_n + r_n) DESC, r_id) AS r
  FROM pairs WHERE 10 * 2 * inter >= 6 * (l_n + r_n)) WHERE r = 1""")
def ngram_dice_top1(spark, sf):
    best = similarity.top1(_gram_pairs(spark, sf, "dice", Fraction(3, 5)), "l_id", F.desc("score"), F.col("r_id"))
    return best.select("l_id", "r_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_GRAMS}
SELECT l_id, r_id, round(inter / (l_n + r_n - inter), 6) AS score FROM pairs WHERE 5 * inter >= 2 * (l_n + r_n - inter)""")
def ngram_jaccard_pairs(spark, sf):
    return _gram_pairs(spark, sf, "jaccard", Fraction(2, 5)).select("l_id", "r_id", F.round("score", 6).alias("score"))


@query(r"""WITH w AS (
  SELECT doc_id AS id, list_filter(string_split_regex(text, '\s+'), lambda x : x <> '') AS w FROM documents),
g AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
e AS (SELECT id, unnest(g) AS t FROM g),
i AS (SELECT a.id AS l_id, b.id AS r_id, count(*) AS inter FROM e a JOIN e b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT l_id, r_id, round(inter / (len(x.g) + len(y.g) - inter), 6) AS score
FROM i JOIN g x ON x.id = l_id JOIN g y ON y.id = r_id WHERE 2 * inter >= len(x.g) + len(y.g) - inter""")
def word_trigram_jaccard(spark, sf):
    """Documents that share at least half of their word trigrams."""
    return runs.similar_texts(_texts(spark, sf), Fraction(1, 2)).select("l_id", "r_id", F.round("score", 6).alias("score"))


_POINTS = (0.8, 0.7, 0.6)


def _grid(spark, sf):
    """Truth: the least name of the same last word; prediction: the most similar name."""
    names = _names(spark, sf)
    kind = Window.partitionBy(F.substring_index("text", " ", -1)).orderBy("id")
    truth = names.select(F.col("id").alias("event"), F.first("id").over(kind).alias("truth"))
    best = similarity.top1(_gram_pairs(spark, sf, "dice", Fraction(1, 10)), "l_id", F.desc("score"), F.col("r_id"))
    return ensemble.grid(best.select(F.col("l_id").alias("event"), F.col("r_id").alias("predicted"), "score"), truth, list(_POINTS))


_GRID = f"""WITH {_GRAMS},
truth AS (SELECT id AS event, first_value(id) OVER (PARTITION BY split_part(text, ' ', 2) ORDER BY id) AS truth FROM names),
best AS (SELECT l_id AS event, r_id AS predicted, s FROM (
  SELECT *, 2.0 * inter / (l_n + r_n) AS s, row_number() OVER (PARTITION BY l_id ORDER BY 2.0 * inter / (l_n + r_n) DESC, r_id) AS r
  FROM pairs WHERE 20 * inter >= l_n + r_n) WHERE r = 1),
points AS (SELECT unnest([0.8, 0.7, 0.6])::DOUBLE AS threshold),
c AS (
  SELECT threshold, count(*) FILTER (s >= threshold AND predicted = truth) AS tp, count(*) FILTER (s >= threshold AND predicted <> truth) AS fp,
    count(*) FILTER (s IS NULL OR s < threshold) AS fn
  FROM points, truth LEFT JOIN best USING (event) GROUP BY threshold),
m AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c)"""


@query(f"{_GRID} SELECT * FROM m")
def ngram_dice_grid(spark, sf):
    return _grid(spark, sf)


@query(f"{_GRID} SELECT * FROM m ORDER BY coalesce(f1, -1) DESC, threshold DESC LIMIT 1")
def ngram_dice_best_point(spark, sf):
    return ensemble.best_point(_grid(spark, sf), list(_POINTS))


# TF-IDF
_TFIDF = r"""
sides AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
t AS (SELECT side, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM sides),
tf AS (SELECT side, id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT side, id, term, tf * (ln((1 + (SELECT count(*) FROM sides)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)),
w AS (SELECT side, id, term, x / sqrt(sum(x * x) OVER (PARTITION BY side, id)) AS w FROM x),
cos AS (SELECT a.id AS doc_id, b.id AS item_id, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b ON a.term = b.term AND a.side = 0 AND b.side = 1 GROUP BY 1, 2)"""


def _cosines(spark, sf, threshold):
    pairs = similarity.tfidf_pairs(_texts(spark, sf), _texts(spark, sf, "benchmark", "item_id"), threshold)
    return pairs.select(F.col("l_id").alias("doc_id"), F.col("r_id").alias("item_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_TFIDF} SELECT * FROM cos WHERE score >= 0.25")
def tfidf_pairs(spark, sf):
    return _cosines(spark, sf, 0.2).filter("score >= 0.25")


@query(f"WITH {_TFIDF} SELECT doc_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id DESC) AS r FROM cos) WHERE r = 1")
def tfidf_top1(spark, sf):
    """The most similar passage; the last one on ties."""
    return similarity.top1(_cosines(spark, sf, 0.0), "doc_id", F.desc("score"), F.desc("item_id"))


@query(r"""WITH p AS (SELECT d.doc_id, b.item_id, regexp_extract_all(lower(d.text), '[\p{L}\p{N}_]{2,}') AS a, regexp_extract_all(lower(b.text), '[\p{L}\p{N}_]{2,}') AS b
  FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
u AS (SELECT doc_id, item_id, unnest(list_distinct(list_concat(a, b))) AS t, a, b FROM p),
v AS (SELECT doc_id, item_id, len(list_filter(a, lambda x : x = t)) * i AS x, len(list_filter(b, lambda x : x = t)) * i AS y
  FROM (SELECT *, CASE WHEN list_contains(a, t) AND list_contains(b, t) THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS i FROM u))
SELECT doc_id, item_id, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS score FROM v GROUP BY ALL""")
def pairwise_tfidf(spark, sf):
    """Similarity of matched pairs, idf fitted on each pair alone."""
    texts, items = _texts(spark, sf), _texts(spark, sf, "benchmark", "item_id")
    pairs = similarity.containment_pairs(texts, items)
    full = pairs.join(texts.select(F.col("id").alias("l_id"), F.col("text").alias("a")), "l_id").join(items.select(F.col("id").alias("r_id"), F.col("text").alias("b")), "r_id")
    return similarity.pair_tfidf(full, "a", "b").select(F.col("l_id").alias("doc_id"), F.col("r_id").alias("item_id"), F.round("score", 6).alias("score"))


# Text functions
@query(rf"""SELECT doc_id,
  CASE WHEN regexp_matches(text, '\((.*?)\)') THEN regexp_extract(text, '\((.*?)\)', 1) END AS acronym,
  CASE WHEN regexp_matches(text, '\({W}{{1,20}}\)') THEN regexp_extract(text, '\(({W}{{1,20}})\)', 1) END AS abbreviation,
  CASE WHEN regexp_matches(text, '{W}+@{W}+') THEN regexp_extract(text, '({W}+)@{W}+', 1) END AS at_abbreviation
FROM documents""")
def extract_acronyms(spark, sf):
    t = F.col("text")
    return _read(spark, sf, "documents").select("doc_id", T.acronym(t).alias("acronym"), T.abbreviation(t).alias("abbreviation"), T.at_abbreviation(t).alias("at_abbreviation"))


@query(r"""SELECT doc_id, try_cast(coalesce(nullif(regexp_extract(text, '([0-9]{4})$', 1), ''), nullif(regexp_extract(text, '([0-9]{4})', 1), '')) AS INTEGER) AS year,
  try_cast(nullif(regexp_extract(text, '^([0-9]+)(?:rd|nd|th|st|\.)', 1), '') AS INTEGER) AS ordinal FROM documents""")
def extract_years(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", T.year(F.col("text")).alias("year"), T.ordinal(F.col("text")).alias("ordinal"))


_TITLES = "t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 40 || 'th ' || o_orderpriority || ' ' || year(o_orderdate) || ': Hall ' || o_custkey WHEN 1 THEN o_orderpriority || ' ' || year(o_orderdate) || '; City' WHEN 2 THEN o_orderpriority || ' ' || year(o_orderdate) || ' [virtual event]' ELSE o_custkey || '. ' || o_orderpriority END AS title FROM orders)"


def _titles(spark, sf):
    """Event titles in four shapes, made of the orders' fields."""
    o = _read(spark, sf, "orders")
    year, name, n = F.year("o_orderdate").cast("string"), F.col("o_orderpriority"), F.col("o_orderkey") % 4
    first = F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit("th "), name, F.lit(" "), year, F.lit(": Hall "), F.col("o_custkey").cast("string"))
    title = F.when(n == 0, first).when(n == 1, F.concat(name, F.lit(" "), year, F.lit("; City"))).when(n == 2, F.concat(name, F.lit(" "), year, F.lit(" [virtual event]")))
    return o.select(F.col("o_orderkey").alias("id"), title.otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(". "), name)).alias("title"))


@query(rf"""WITH {_TITLES},
s AS (SELECT id, CASE WHEN contains(title, ':') THEN rtrim(split_part(title, ':', 1)) WHEN contains(title, '[virtual') THEN rtrim(regexp_replace(title, '\[virtual(?: event)?\]$', ''))
    WHEN contains(title, ';') THEN rtrim(split_part(title, ';', 1)) ELSE title END AS title,
  CASE WHEN contains(title, ':') THEN trim(split_part(title, ':', 2)) WHEN contains(title, '[virtual') THEN '[virtual event]' WHEN contains(title, ';') THEN trim(split_part(title, ';', 2)) END AS location FROM t)
SELECT id, title, location, try_cast(coalesce(nullif(regexp_extract(title, '([0-9]{{4}})$', 1), ''), nullif(regexp_extract(title, '([0-9]{{4}})', 1), '')) AS INTEGER) AS year,
  try_cast(nullif(regexp_extract(title, '^([0-9]+)(?:rd|nd|th|st|\.)', 1), '') AS INTEGER) AS ordinal FROM s""")
def event_from_title(spark, sf):
    return _titles(spark, sf).select("id", T.event_from_title(F.col("title")).alias("e")).select("id", "e.title", "e.location", "e.year", "e.ordinal")


@query(r"""WITH t AS (SELECT o_orderkey AS id, year(o_orderdate) AS y, 1994 + o_custkey % 6 AS a, o_custkey % 2 = 0 AS spaced FROM orders),
r AS (SELECT *, CASE WHEN spaced THEN [1997, 1999] ELSE [1995, 1996, 1997, 1999] END AS ys FROM t)
SELECT id, CAST(a AS INTEGER) AS since, CAST(y AS INTEGER) AS year, array_to_string(list_filter(ys, lambda x : x <> a OR (NOT spaced AND x < 1998)), ' ') AS years,
  y >= a AND list_contains(list_filter(ys, lambda x : x <> a OR (NOT spaced AND x < 1998)), y) AS inside FROM r""")
def year_ranges(spark, sf):
    """Whether an order's year lies in a written range; of a range with spaces only the end counts."""
    o = _read(spark, sf, "orders")
    phrase = F.concat(F.lit("since "), (1994 + F.col("o_custkey") % 6).cast("string"), F.lit(", 1995"), F.when(F.col("o_custkey") % 2 == 0, " - ").otherwise("-"), F.lit("1997, 1999"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), T.year_range(phrase).alias("r"))
    return rows.select("id", F.col("r.since").alias("since"), "year", F.array_join(F.transform("r.years", lambda x: x.cast("string")), " ").alias("years"), T.in_year_range(F.col("year"), F.col("r")).alias("inside"))


@query(rf"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '/index\.html$', ''), '\.html$', '') AS id,
  regexp_replace(url, '/[^/]*$', '') AS stem, string_split(url, '/')[-1] AS name, CAST(length(url) - length(replace(url, '/', '')) AS INTEGER) AS slashes FROM pages""")
def page_ids(spark, sf):
    u = F.col("url")
    bare = F.when(u.startswith("https"), T.url_to_id(u, "https://")).otherwise(T.url_to_id(u, "http://"))
    return _read(spark, sf, "pages").select("page_id", bare.alias("id"), T.id_stem(u).alias("stem"), T.id_name(u).alias("name"), T.slashes(u).alias("slashes"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS spaced,
  CAST(len(list_filter(string_split_regex(lower(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]', '', 'g')), '\s+'), lambda x : x <> '' AND NOT list_contains({_STOP}, x))) AS INTEGER) AS n_words FROM documents""")
def normalised_text(spark, sf):
    t = F.col("text")
    return _read(spark, sf, "documents").select("doc_id", T.spaced(t).alias("spaced"), F.size(T.content_words(t)).alias("n_words"))


@query(r"SELECT page_id, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) <> '' AS has_headline, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS n_links FROM pages")
def html_structure(spark, sf):
    """Headline and links through the page parser."""
    p = _read(spark, sf, "pages").select("page_id", H.page(F.col("html")).alias("p"))
    return p.select("page_id", (F.coalesce(F.col("p.headline"), F.lit("")) != "").alias("has_headline"), F.size("p.links").alias("n_links"))


@query()
def html_extraction(spark, sf):
    """Title, headline, list items, links, breadcrumbs and header events of each page."""
    return _read(spark, sf, "pages").select("page_id", H.page(F.col("html")).alias("p")).select("page_id", "p.*")


def _crumb(id_, name) -> Column:
    link = F.concat(F.lit('<li><span><span><a href="https://dblp.org/db/'), id_, F.lit('">'), name, F.lit('</a><meta itemprop="position" content="3"></span></span></li>'))
    return F.concat(F.lit('<div id="breadcrumbs"><ul>'), link, F.lit("</ul></div>"))


@query("""WITH c AS (SELECT c_custkey AS k, 'conf/n' || c_nationkey || '/' || c_custkey AS id, 'conf/n' || c_nationkey AS stem, 'n' || c_nationkey AS short, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT id, (k % 40 + 1) || '. EV ' || (1990 + k % 30) AS title, CAST(1990 + k % 30 AS INTEGER) AS year, n_name AS location, CAST(k % 40 + 1 AS INTEGER) AS ordinal,
  stem AS parent_id, CASE WHEN k % 5 = 0 THEN short WHEN k % 7 = 0 THEN 'Workshop ' || n_name ELSE 'Meeting ' || n_name END AS parent_name,
  CASE WHEN k % 5 <> 0 AND k % 7 = 0 THEN NULL ELSE stem END AS series_id FROM c""")
def event_pages(spark, sf):
    """Events of synthetic pages, their breadcrumb parents and their conference series."""
    n = _read(spark, sf, "nation").select("n_nationkey", "n_name")
    c = _read(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k, stem = F.col("c_custkey"), F.concat(F.lit("conf/n"), F.col("c_nationkey").cast("string"))
    name = F.concat(F.when(k % 7 == 0, "Workshop ").otherwise("Meeting "), F.col("n_name"))
    id_ = F.concat(stem, F.lit("/"), k.cast("string"))
    title = F.concat((k % 40 + 1).cast("string"), F.lit(". EV "), (1990 + k % 30).cast("string"), F.lit(": "), F.col("n_name"))
    html = F.concat(F.when(k % 5 == 0, "").otherwise(_crumb(stem, name)), F.lit('<header id="headline" data-bhtkey="db/'), id_, F.lit('"><h1>'), title, F.lit("</h1></header><p>unclosed"))
    pages = c.select(H.page(html).alias("p"))
    events = pages.select(H.event(F.col("p")).alias("e"), F.col("p.parents").alias("parents")).select(F.col("e.dblp_id").alias("id"), "e.title", "e.year", "e.location", "e.ordinal", "parents")
    up = resolve.parents(events)
    found = resolve.conference_series(up).withColumnRenamed("parent_id", "series_id")
    return events.drop("parents").join(up.drop("pos"), "id").join(found, "id", "left")


@query("""SELECT 'conf/s' || s_suppkey AS dblp_id, s_name || ' (AB' || s_suppkey || ')' AS name, 'AB' || s_suppkey AS abbreviation, CAST(1990 + s_suppkey % 20 AS INTEGER) AS since,
  'conf/n' || s_nationkey AS part, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 2000 + s_suppkey % 9 ELSE 0 END AS INTEGER) AS discontinued, s_suppkey % 4 = 0 AS merged_into,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE '2001 2002 2003' END AS successor_years, 'name changed' AS qualifier, true AS open_access,
  '2nd A 2010@Rome|3rd B 2010@Rome|4th C ' || (2011 + s_suppkey % 5) || '@Oslo' AS events
FROM supplier WHERE s_suppkey % 5 <> 0""")
def series_pages(spark, sf):
    """Series of synthetic pages with their venue box and events; other pages give nothing."""
    k = F.col("s_suppkey")
    line = lambda label, *rest: F.concat(F.lit(f"<li><em>{label}"), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in rest], F.lit("</li>"))
    box = F.concat(
        line("access:", "</em> some or all publications openly available"), line("has part (since ", 1990 + k % 20, '):</em> <a href="https://dblp.org/db/conf/n', F.col("s_nationkey"), '/index.html">Part</a>'),
        line("related (name changed):", "</em> Old Name"), F.when(k % 3 == 0, line("status:", "</em> as of ", 2000 + k % 9, ", this venue has been discontinued")).otherwise(""),
        line("successor (", F.when(k % 4 == 0, "merged into").otherwise("2001-2003"), "):</em> Next"),
    )
    crumb = F.when(k % 5 == 0, F.lit("")).otherwise(F.lit('<div id="breadcrumbs"><ul><li><a href="https://dblp.org/db/conf/">Conferences</a></li></ul></div>'))
    head = F.concat(F.lit('<header id="headline" data-stream="conf/s'), k.cast("string"), F.lit('"><h1>'), F.col("s_name"), F.lit(" (AB"), k.cast("string"), F.lit(")</h1></header>"))
    main = F.concat(F.lit('<div id="main"><header class="h2"><h2>2nd A / 3rd B 2010: Rome</h2></header><header class="h2"><h2>4th C '), (2011 + k % 5).cast("string"), F.lit(": Oslo</h2></header></div>"))
    html = F.concat(crumb, head, F.lit('<div id="info-section"><ul>'), box, F.lit("</ul></div>"), main)
    s = _read(spark, sf, "supplier").select(H.page(html).alias("p")).select(H.series(F.col("p")).alias("s")).filter("s is not null")
    years = F.array_join(F.transform(F.get("s.venue.successor", 0)["years"]["years"], lambda y: y.cast("string")), " ")
    return s.select(
        "s.dblp_id", "s.name", "s.abbreviation", F.get("s.venue.has_part", 0)["years"]["since"].alias("since"), F.get("s.venue.has_part", 0)["reference"].alias("part"), F.coalesce("s.venue.discontinued", F.lit(0)).alias("discontinued"),
        F.get("s.venue.successor", 0)["merged_into"].alias("merged_into"), years.alias("successor_years"), F.get("s.venue.related", 0)["qualifier"].alias("qualifier"), "s.venue.open_access",
        F.array_join(F.transform("s.events", lambda e: F.concat(e["title"], F.lit("@"), e["location"])), "|").alias("events"),
    )


@query("""WITH t AS (SELECT c_custkey AS id, c_custkey % 30 + 1 AS n FROM customer)
SELECT id, CAST(n AS INTEGER) AS ordinal FROM t""")
def free_ordinals(spark, sf):
    """Ordinals in digits and in words."""
    words = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
    words += [f"twenty-{w}" for w in words[:9]] + ["thirtieth"]
    k = F.col("c_custkey")
    suffix = F.when((k % 30 + 1).isin(1, 21), "st").when((k % 30 + 1).isin(2, 22), "nd").when((k % 30 + 1).isin(3, 23), "rd").otherwise("th")
    said = F.when(k % 2 == 0, F.concat((k % 30 + 1).cast("string"), suffix)).otherwise(F.get(F.array(*map(F.lit, words)), (k % 30).cast("int")))
    return _read(spark, sf, "customer").select(k.alias("id"), T.free_ordinal(F.concat(F.lit("Proc. of the "), said, F.lit(" Meeting"))).alias("ordinal"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'conf/x' || c_nationkey END AS clean, 'Q' || c_custkey AS qid, 1880 + c_custkey % 200 > 1900 AND 1880 + c_custkey % 200 <= 2024 AS realistic,
  c_custkey % 2 = 0 AS is_series, c_custkey % 2 = 1 AS is_event FROM customer""")
def id_shapes(spark, sf):
    k, n = F.col("c_custkey"), F.concat(F.lit("conf/x"), F.col("c_nationkey").cast("string"))
    raw = F.when(k % 3 == 0, F.concat(F.lit("https://a.org/"), n)).otherwise(F.concat(n, F.when(k % 3 == 1, "/").otherwise("")))
    shape = F.when(k % 2 == 0, n).otherwise(F.concat(n, F.lit("/e")))
    qid = F.concat(F.when(k % 2 == 0, "http://www.wikidata.org/entity/Q").otherwise("Q"), k.cast("string"))
    return _read(spark, sf, "customer").select(k.alias("id"), T.clean_id(raw).alias("clean"), T.parse_qid(qid).alias("qid"), T.is_realistic_year(1880 + k % 200, 2024).alias("realistic"), T.is_series_id(shape).alias("is_series"), T.is_event_id(shape).alias("is_event"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part)
SELECT 'Q' || k AS qid, 'ordinal' AS attr, CAST(k % 9 + 4 AS VARCHAR) AS value FROM p WHERE k % 4 <> 0 AND k % 3 <> 0
UNION ALL SELECT 'Q' || k, 'acronym', CASE WHEN k % 6 = 1 THEN 'T' || k ELSE 'L' || k END FROM p WHERE k % 5 <> 0
UNION ALL SELECT 'Q' || k, 'ceurws_title', CASE WHEN k % 8 < 3 THEN 'json ' || k ELSE 'page ' || k END FROM p WHERE k % 7 <> 0 AND k % 8 < 6""")
def completed_attributes(spark, sf):
    """Ordinals, acronyms and volume titles of what has none and isn't logged as completed."""
    k = F.col("p_partkey")
    said, text = F.concat((k % 9 + 4).cast("string"), F.lit("th Meeting")), k.cast("string")
    items = _read(spark, sf, "part").select(
        F.concat(F.lit("Q"), text).alias("qid"), k.alias("volume_number"), F.when(k % 2 == 0, F.concat(said, F.lit(" (T"), text, F.lit(")"))).when(k % 6 == 1, F.concat(said, F.lit(" (T"), text, F.lit(")"))).alias("title"),
        F.when(k % 6 == 1, said).otherwise(F.concat(said, F.lit(" (L"), text, F.lit(")"))).alias("label"),
        F.when(k % 4 == 0, 1).alias("ordinal"), F.lit(None).cast("string").alias("acronym"), F.when(k % 7 == 0, "has one").alias("ceurws_title"), k,
    )
    log = items.filter("p_partkey % 3 = 0").select("qid", F.lit("ordinal").alias("attr")).unionByName(items.filter("p_partkey % 5 = 0").select("qid", F.lit("acronym").alias("attr")))
    payloads = items.filter("p_partkey % 8 < 4").select("volume_number", F.concat(F.lit('{"cvb.title": "'), F.when(k % 8 < 3, F.concat(F.lit("json "), text)).otherwise(""), F.lit('"}')).alias("payload"))
    pages = items.filter("p_partkey % 8 < 6").select("volume_number", F.concat(F.lit("page "), text).alias("title"))
    out = complete.complete_ordinals(items, log).unionByName(complete.complete_acronyms(items, log)).unionByName(complete.complete_titles(items, payloads, pages, log))
    return out.select("qid", "attr", "value")


_SERIES_ROWS = ", ".join(f"('Q0-{i}', '{t}')" for i, t in enumerate(LITERAL_SERIES))


@query(f"SELECT * FROM (VALUES {_SERIES_ROWS}) AS t(qid, title)")
def literal_series(spark, sf):
    """Proxy series of fixed titles."""
    return tables.literal_series(spark).select("qid", "title")


@query("""SELECT c_custkey AS qid, CASE WHEN s_suppkey IS NOT NULL AND c_custkey % 2 = 0 THEN s_name END AS label FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
WHERE c_custkey % 11 <> 0 AND c_mktsegment IS NOT NULL""")
def language_labels(spark, sf):
    """Labels in one language, without known bad items and such as lack a segment."""
    items = _read(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), "c_mktsegment")
    labels = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("label"), F.when(F.col("s_suppkey") % 2 == 0, "en").otherwise("de").alias("lang"))
    good = complete.known_good(complete.whole(items, ["c_mktsegment"]), items.filter("qid % 11 = 0"))
    return complete.in_language(good, labels, "en").select("qid", "label")


@query("""SELECT c_name AS event_title, CASE WHEN s_suppkey % 2 = 0 THEN 'T ' || s_name ELSE s_name END AS series_title FROM customer JOIN supplier ON s_suppkey = c_custkey % 50 WHERE c_custkey % 3 <> 0""")
def match_title_pairs(spark, sf):
    """Titles of matched pairs, labels where there is no title."""
    c, s = _read(spark, sf, "customer"), _read(spark, sf, "supplier")
    events = c.select(F.col("c_custkey").alias("qid"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("title"), F.lit(None).cast("string").alias("label"))
    series = s.select(F.col("s_suppkey").alias("qid"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("T "), F.col("s_name"))).alias("title"), F.col("s_name").alias("label"))
    return complete.title_pairs(c.select(F.col("c_custkey").alias("event_qid"), (F.col("c_custkey") % 50).alias("series_qid")), events, series)


@query("SELECT o_orderkey AS qid FROM orders WHERE o_custkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def needs_parent(spark, sf):
    """Items without a parent that no match has."""
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey")).alias("part_of_series"))
    return complete.without_parent(o, _read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("event_qid"))).select("qid")


@query("""SELECT p.page_id AS id, length(coalesce(t.html, CASE WHEN p.page_id % 3 = 0 THEN 'fetched' ELSE p.html END)) AS n FROM pages p LEFT JOIN pages t ON t.page_id = p.page_id + 1 AND p.page_id % 7 = 0 AND t.page_id % 3 <> 0""")
def cached_pages(spark, sf):
    """Pages from the cache, else as fetched; then redirects are followed to cached pages."""
    p = _read(spark, sf, "pages").select(F.col("page_id").alias("id"), "html")
    cached = p.select("id", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("html")).alias("html"))
    read = resolve.read_through(p.select("id"), cached, p.select("id", F.lit("fetched").alias("html")))
    targets = p.select("id", F.when((F.col("id") % 7 == 0) & ((F.col("id") + 1) % 3 != 0), F.col("id") + 1).alias("target"))
    return resolve.followed(read, targets).select("id", F.length("html").cast("long").alias("n"))


@query("""WITH e AS (SELECT c_custkey AS k, 'conf/w/' || c_custkey AS id FROM customer)
SELECT id, CASE WHEN k % 3 = 0 THEN 'conf/only' WHEN k % 3 = 1 THEN 'conf/swat' ELSE 'conf/abc' END AS parent_id, CAST(k % 3 + 1 AS INTEGER) AS rule FROM e WHERE NOT (k % 3 = 1 AND 1990 + k % 20 < 1995)""")
def workshop_resolution(spark, sf):
    """Workshops by their only workshop parent, by a venue record in force, and by a parent named like their abbreviation."""
    k = F.col("c_custkey")
    c = _read(spark, sf, "customer").select(k, F.concat(F.lit("conf/w/"), k.cast("string")).alias("id"))
    title = F.when(k % 3 == 0, "S").when(k % 3 == 1, "SWAT@VENUE").otherwise("ABC@X")
    events = c.select("id", title.alias("title"), (1990 + k % 20).cast("int").alias("year"))
    row = lambda id_, name: F.struct(F.lit(id_).alias("dblp_id"), F.lit(name).alias("name"))
    several = F.array(row("conf/abc", "Workshop ABC"), row("conf/q", "Workshop Q"))
    up = resolve.parents(c.select("id", F.when(k % 3 == 0, F.array(row("conf/only", "A Workshop"))).when(k % 3 == 1, F.array(row("conf/venue", "Venue"))).otherwise(several).alias("parents")))
    since = F.struct(F.lit(1995).alias("since"), F.lit(None).cast("int").alias("until"), F.array().cast("array<int>").alias("years"))
    venue = _read(spark, sf, "region").filter("r_regionkey = 0").select(F.lit("conf/venue").alias("series_id"), F.lit("SWAT Workshop").alias("name"), F.lit("conf/swat").alias("reference"), since.alias("years"))
    return resolve.workshop_series(events, up, venue).select("id", "parent_id", "rule")


# Types, completion, patches
@query("""WITH f AS (SELECT p_partkey, p_name, p_type = 'ECONOMY' AS i, p_brand = 'Brand#1' AS j FROM part)
SELECT p_partkey, CASE WHEN contains(p_name, 'widget') OR j THEN 'WORKSHOP' WHEN (contains(p_name, 'ring') OR i) AND NOT contains(p_name, 'widget') THEN 'CONFERENCE' ELSE 'UNKNOWN' END AS type FROM f""")
def type_classification(spark, sf):
    p, name = _read(spark, sf, "part"), F.col("p_name")
    a = complete.is_conference(name, F.col("p_type") == "ECONOMY", "ring", "widget")
    b = complete.is_workshop(name, F.col("p_brand") == "Brand#1", "widget")
    return p.select("p_partkey", complete.resolved_type(a, b).alias("type"))


@query("""WITH f AS (SELECT CASE WHEN contains(p_name, 'widget') THEN 'WORKSHOP' WHEN contains(p_name, 'ring') THEN 'CONFERENCE' ELSE 'UNKNOWN' END AS type FROM part)
SELECT type, count(*) AS n FROM f GROUP BY type""")
def count_by_type(spark, sf):
    name = F.col("p_name")
    kind = complete.resolved_type(complete.is_conference(name, F.lit(False), "ring", "widget"), complete.is_workshop(name, F.lit(False), "widget"))
    return _read(spark, sf, "part").select(kind.alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def _completions(spark, sf):
    e = _read(spark, sf, "events").filter(F.col("event_type").isin("click", "view"))
    return e.select(F.col("user_id").cast("string").alias("qid"), F.col("event_type").alias("attr"), F.col("value").cast("string").alias("value"), F.lit("log").alias("found_by"), F.col("event_id").alias("seq"))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events),
c AS (SELECT user_id, max_by(value, event_id) FILTER (event_type = 'click') AS click, max_by(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id)
SELECT user_id, coalesce(c.click, 0.0) AS click, coalesce(c.view, -1.0) AS view FROM u LEFT JOIN c USING (user_id)""")
def patched_items(spark, sf):
    """Each user's last completions over their defaults."""
    items = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("qid")).distinct().withColumns({"click": F.lit(0.0), "view": F.lit(-1.0)})
    return complete.patched(items, _completions(spark, sf), ["click", "view"]).select(F.col("qid").cast("long").alias("user_id"), "click", "view")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal < 5000 AND NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'click' AND user_id = c_custkey)""")
def uncompleted_items(spark, sf):
    items = _read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("qid"), F.when(F.col("c_acctbal") >= 5000, F.col("c_acctbal")).alias("click"))
    return complete.uncompleted(items, "click", _completions(spark, sf)).select(F.col("qid").cast("long").alias("c_custkey"))


@query("""SELECT user_id, string_agg(event_type || '=' || event_id, ',' ORDER BY event_id) AS found FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id""")
def completions_by_item(spark, sf):
    out = complete.completions_by_item(_completions(spark, sf))
    return out.select(F.col("qid").cast("long").alias("user_id"), F.array_join(F.transform("found", lambda x: F.concat(x["attr"], F.lit("="), x["seq"].cast("string"))), ",").alias("found"))


@query("SELECT event_type, max(event_id) AS event_id, max_by(value, event_id) AS value, count(*) AS n FROM events GROUP BY event_type")
def matches_by_source(spark, sf):
    """The last row of each source, and how many there are."""
    e = _read(spark, sf, "events")
    last = complete.last_by(e.select("event_type", "event_id", "value"), "event_type", "event_id")
    return last.join(e.groupBy("event_type").agg(F.count("*").alias("n")), "event_type").select("event_type", "event_id", "value", "n")


@query("""SELECT event_id, coalesce(nullif(json_extract_string(props, '$.title'), ''), nullif(json_extract_string(props, '$.k'), '')) AS title FROM events""")
def json_precedence(spark, sf):
    return _read(spark, sf, "events").select("event_id", T.json_title(F.col("props"), ("title", "k")).alias("title"))


@query("""SELECT DISTINCT s_nationkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN part ON l_partkey = p_partkey
WHERE regexp_matches(p_name, '(?i)\\b(?:new|red)\\b') AND s_nationkey IS NOT NULL""".replace("\\\\", "\\"))
def annual_series(spark, sf):
    """Distinct parents of the records whose child title holds a synonym."""
    children = _read(spark, sf, "lineitem").join(_read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("event"), F.col("p_name").alias("title"))
    events = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_nationkey").alias("part_of_series"))
    return complete.annual_series(children, events, ["new", "red"]).select(F.col("part_of_series").alias("s_nationkey"))


# Groups, votes, lookups
@query("SELECT o_custkey, min(o_orderpriority) AS o_orderpriority, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_custkey")
def sample_group(spark, sf):
    return complete.sampled(_read(spark, sf, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderstatus"])


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ' ' ORDER BY o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_custkey")
def group_concat(spark, sf):
    return complete.concatenated(_read(spark, sf, "orders"), ["o_custkey"], "o_orderstatus")


_VOTES = "m AS (SELECT user_id AS event, CAST(floor(value) AS BIGINT) % 7 AS series, event_type AS found_by, event_id AS seq FROM events)"


def _votes(spark, sf):
    return _read(spark, sf, "events").select(F.col("user_id").alias("event"), (F.floor("value") % 7).alias("series"), F.col("event_type").alias("found_by"), F.col("event_id").alias("seq"))


@query(f"WITH {_VOTES} SELECT event, series, count(*) AS votes, string_agg(found_by, '+' ORDER BY seq) AS found_by FROM m GROUP BY event, series HAVING count(*) >= 3")
def vote_merge(spark, sf):
    return ensemble.vote(_votes(spark, sf), 3)


@query(f"""WITH {_VOTES} SELECT event, series, count(DISTINCT found_by) AS votes, string_agg(found_by, '+' ORDER BY seq) AS found_by FROM m
GROUP BY event, series HAVING count(DISTINCT found_by) >= 2""")
def vote_merge_distinct(spark, sf):
    return ensemble.vote(_votes(spark, sf), 2, distinct=True)


@query(f"WITH {_VOTES}, v AS (SELECT count(*) AS votes FROM m GROUP BY event, series) SELECT votes, count(*) AS pairs FROM v GROUP BY votes")
def vote_frequency(spark, sf):
    return ensemble.vote_frequency(_votes(spark, sf))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_returnflag = 'R' AS p FROM lineitem)
SELECT l_orderkey AS event, l_partkey AS series FROM l WHERE p
UNION ALL SELECT DISTINCT l_orderkey, l_partkey FROM l x WHERE NOT p AND NOT EXISTS (SELECT 1 FROM l y WHERE y.p AND y.l_orderkey = x.l_orderkey AND y.l_partkey = x.l_partkey)""")
def union_missing(spark, sf):
    """The first list, and of the second the pairs that the first lacks."""
    rows = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("series"), (F.col("l_returnflag") == "R").alias("p"))
    return ensemble.union_missing(rows.filter("p").drop("p"), rows.filter("not p").drop("p").distinct(), ["event", "series"])


@query("""WITH r AS (SELECT l.toxic, l.quality, CASE WHEN d.n_chars > 1000 THEN 1 WHEN d.n_chars > 200 THEN 0 END AS predicted FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT count(*) FILTER (predicted = quality) AS tp, count(*) FILTER (predicted <> quality) AS fp, count(*) FILTER (predicted IS NULL) AS fn FROM r)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def confusion_metrics(spark, sf):
    rows = _read(spark, sf, "labels").join(_read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    predicted = F.when(F.col("n_chars") > 1000, 1).when(F.col("n_chars") > 200, 0)
    return ensemble.with_scores(rows.agg(*ensemble.confusion(F.col("quality"), predicted)))


@query("""SELECT round(avg(CASE WHEN (n_chars > 1000) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id)""")
def accuracy_summary(spark, sf):
    rows = _read(spark, sf, "labels").join(_read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.agg(F.round(F.avg(((F.col("n_chars") > 1000) == (F.col("quality") == 1)).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


@query("""SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey, max_by(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey""")
def last_by_key(spark, sf):
    return complete.last_by(_read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name) ON k = p_partkey""")
def first_by_title(spark, sf):
    """Rows that point at the first record of their title."""
    first = complete.first_by(_read(spark, sf, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")
    return _read(spark, sf, "lineitem").join(first, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_partkey")


@query("""SELECT c_custkey, coalesce(x.name, c_name) AS c_name FROM customer LEFT JOIN (SELECT s_suppkey AS k, s_name AS name FROM supplier) x ON k = c_custkey""")
def corrected_names(spark, sf):
    fixes = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return complete.corrected(_read(spark, sf, "customer").select("c_custkey", "c_name"), fixes, "c_custkey", "c_name")


# Hierarchies and rules
@query("""WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS id FROM pages),
s AS (SELECT DISTINCT array_to_string(string_split(id, '/')[1:2], '/') AS id FROM p),
e AS (SELECT id AS event, array_to_string(string_split(id, '/')[1:2], '/') AS s FROM p)
SELECT s.id AS series_id, coalesce(string_agg(event, ' ' ORDER BY event), '') AS events FROM s LEFT JOIN e ON e.s = s.id AND event <> s.id GROUP BY s.id""")
def prefix_children(spark, sf):
    """Pages below each site section, by id prefix with a boundary."""
    ids = _read(spark, sf, "pages").select(F.regexp_replace("url", "^https?://", "").alias("id")).distinct()
    series = ids.select(F.substring_index("id", "/", 2).alias("id")).distinct()
    out = resolve.children_by_prefix(series, ids)
    return out.select("series_id", F.array_join("events", " ").alias("events"))


@query("""WITH s AS (SELECT s_suppkey AS seq, s_suppkey, s_nationkey, s_name FROM supplier),
c AS (SELECT c_custkey, s_suppkey, 0 AS rule FROM customer JOIN s ON c_custkey = s_suppkey
  UNION ALL SELECT c_custkey, s_suppkey, 1 FROM customer JOIN s ON c_nationkey = s_nationkey)
SELECT c_custkey, CAST(s_suppkey AS VARCHAR) AS qid, CAST(rule AS INTEGER) AS rule FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY rule, s_suppkey) AS r FROM c) WHERE r = 1""")
def ranked_rule_resolution(spark, sf):
    """An equal id first, else the first record with the same short name."""
    known = _read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("qid"), F.col("s_suppkey").alias("seq"), F.col("s_suppkey").cast("string").alias("dblp_id"), F.col("s_name").alias("title"), F.col("s_name").alias("label"), F.col("s_nationkey").cast("string").alias("acronym"))
    pages = _read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("dblp_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("abbreviation"))
    return resolve.series_by_rules(pages, known).select(F.col("dblp_id").cast("long").alias("c_custkey"), "qid", "rule")


@query("""WITH r AS (SELECT o_orderdate AS d, o_orderpriority AS p, string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), ' ' ORDER BY CAST(o_orderkey AS VARCHAR)) AS ids FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT o_orderkey AS id, ids FROM orders LEFT JOIN r ON o_orderdate = d AND o_orderpriority = p WHERE o_orderstatus = 'O'""")
def same_time_join(spark, sf):
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", "o_orderpriority", "o_orderstatus")
    right = o.filter("o_orderstatus = 'F'").withColumn("id", F.col("id").cast("string"))
    out = resolve.same_time(o.filter("o_orderstatus = 'O'"), right, ["o_orderdate", "o_orderpriority"])
    return out.select("id", F.array_join("ids", " ").alias("ids"))


@query("""SELECT l_orderkey AS id, string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey) AS titles FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def titles_of_ids(spark, sf):
    """Titles of each record's list of ids, in order."""
    lists = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    titles = _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("seq"))
    return resolve.titles_of(lists, titles).select("id", F.array_join("titles", "|").alias("titles"))


@query("SELECT n_name, r_name, count(c_custkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, r_name")
def parent_lookup(spark, sf):
    """Inner and left joins along a hierarchy."""
    n = _read(spark, sf, "nation").join(F.broadcast(_read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(_read(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("n"))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def value_intersection(spark, sf):
    rows = _read(spark, sf, "lineitem")
    return rows.filter("l_returnflag = 'R'").select("l_partkey").intersect(rows.filter("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT doc_id, doc_id % 10 < 3 AS is_test FROM documents")
def deterministic_split(spark, sf):
    return complete.hash_split(_read(spark, sf, "documents"), "doc_id", 0.3, 10, F.col("doc_id")).select("doc_id", "is_test")


# Vectors
@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : x::DOUBLE) AS e FROM embeddings),
p AS (SELECT a.vec_id AS l_id, b.vec_id AS r_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT l_id, r_id, score FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY score DESC, r_id) AS r FROM p) WHERE r = 1""")
def cosine_top1(spark, sf):
    v = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return similarity.cosine_top1(v, v)


@query("""SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (
  SELECT label, unnest(range(0, len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, pos""")
def mean_vector(spark, sf):
    v = _read(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"))
    return similarity.mean_vectors(v, "label").select("label", "pos", F.round("mean", 6).alias("mean"))


@query()
def word2vec_top1(spark, sf):
    """The most similar other part name by mean word vectors."""
    from .plans import linking

    names = _names(spark, sf).select("id", "text")
    return linking.embedding(names, names, learning.word_vectors(names, size=32), None)


@query()
def classifier_scores(spark, sf):
    """Accuracy, precision and recall of three classifiers from part name to part kind."""
    rows = _read(spark, sf, "part").select("p_partkey", T.content_words(F.col("p_name")).alias("words"), F.substring_index("p_name", " ", -1).alias("target"))
    split = complete.hash_split(rows, "p_partkey").cache()
    out = []
    for kind in ("logistic", "svm", "forest"):
        model = learning.classifier(kind, features=256).fit(split.filter("not is_test"))
        out.append((kind, *[round(v, 6) for v in learning.scores(model.transform(split.filter("is_test"))).values()]))
    return spark.createDataFrame(out, "model string, accuracy double, precision double, recall double")


@query()
def linked_titles(spark, sf):
    """Part of the linking plan: part names of even ids against those of odd ids, single votes, without the embedding matcher.

    Pairs within one half are never tried, and the names are distinct, so the exact matcher finds nothing.
    """
    from .plans import linking

    names = _names(spark, sf).withColumns({"qid": F.col("id").cast("string"), "label": F.col("text"), "title": F.col("text"), "part_of_series": F.when(F.col("id") % 2 == 1, "known")})
    return linking.link(names.filter("id % 2 = 0"), names.filter("id % 2 = 1"), required=1)["matches"].select("event", "series", "votes", "found_by")


# Scans of statements
_ENTITY = "http://www.wikidata.org/entity/"


def _said(df, subject, *facts):
    """Statements (property, value[, language]) of each row; those without a value are left out."""
    one = lambda p, v, lang=None: F.struct(F.lit(p).alias("property"), v.cast("string").alias("value"), (F.lit(lang) if lang is None or isinstance(lang, str) else lang).cast("string").alias("lang"))
    return df.select(subject.alias("subject"), F.explode(F.array(*[one(*f) for f in facts])).alias("s")).select("subject", "s.*").filter("value IS NOT NULL")


def _statements(spark, sf):
    """What could be stated of orders as proceedings, customers as events and nations as series."""
    k, c, n = F.col("o_orderkey"), F.col("c_custkey"), F.col("n_nationkey")
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    orders = _said(
        _read(spark, sf, "orders"), name(_ENTITY, "P", k), (scans.INSTANCE_OF, F.when(F.col("o_orderstatus") != "P", F.lit(scans.PROCEEDINGS_CLASS))), (scans.SERIES_OF, F.when(k % 5 != 0, F.lit(_ENTITY + scans.VOLUMES_SERIES))),
        (scans.VOLUME, k), (scans.PROCEEDINGS_OF, name(_ENTITY, "C", F.col("o_custkey"))), (scans.TITLE, F.col("o_orderpriority"), F.when(k % 3 == 0, "de").otherwise("en")), (scans.DESCRIBED_AT, name("u", k)),
        ("P1813", F.when(k % 2 == 0, name("V", k))), ("P577", F.col("o_orderdate").cast("timestamp")),
    )
    who = F.col("c_name")
    events = _said(
        _read(spark, sf, "customer"), name("C", c), (scans.LABEL, F.when(c % 7 != 0, who), "en"),
        (scans.TITLE, F.when(c % 4 == 0, name("Meeting ", who)).when(c % 4 == 1, name("Workshop ", who)).when(c % 4 == 3, name("A Conference ", who)), "en"),
        (scans.TITLE, F.when(c % 4 == 3, name("B Workshop ", who)), "en"), (scans.TITLE, F.when(c % 4 == 2, name("Conference ", who)), "de"),
        (scans.INSTANCE_OF, F.when(c % 6 == 0, F.lit(scans.CONFERENCE))), (scans.INSTANCE_OF, F.when(c % 10 == 0, F.lit(_ENTITY + scans.WORKSHOP))), (scans.SERIES_OF, F.when(c % 2 == 0, name(_ENTITY, "S", F.col("c_nationkey")))),
        (scans.ORDINAL, c % 50), ("P17", name(_ENTITY, "N", F.col("c_nationkey"))),
    )
    series = _said(
        _read(spark, sf, "nation"), name("S", n), (scans.LABEL, F.when(n % 2 == 0, F.col("n_name")), "en"), (scans.TITLE, F.when(n % 3 == 0, name(F.col("n_name"), " Conference")).when(n % 3 == 1, name("Workshop ", F.col("n_name"))), "en"),
        (scans.INSTANCE_OF, F.lit("QA")), (scans.INSTANCE_OF, F.lit(_ENTITY + "QB")), (scans.INSTANCE_OF, F.when(n % 5 == 2, F.lit(scans.WORKSHOP_SERIES))), ("P8926", name("conf/", n)),
    )
    return orders.unionByName(events).unionByName(series)


_VOLUMES = """
v AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 <> 0),
e AS (SELECT 'C' || c_custkey AS qid, c_custkey AS k, c_name, c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE 'C' || c_custkey END AS label,
  CASE c_custkey % 4 WHEN 0 THEN 'Meeting ' || c_name WHEN 1 THEN 'Workshop ' || c_name WHEN 3 THEN 'A Conference ' || c_name END AS title,
  CASE WHEN c_custkey % 2 = 0 THEN 'S' || c_nationkey END AS part_of_series, u AS ceurws_url
  FROM customer JOIN (SELECT c, min('u' || k) AS u FROM v GROUP BY c) ON c = c_custkey),
s AS (SELECT 'S' || n_nationkey AS qid, n_nationkey AS k, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'S' || n_nationkey END AS label,
  CASE n_nationkey % 3 WHEN 0 THEN n_name || ' Conference' WHEN 1 THEN 'Workshop ' || n_name END AS title
  FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM e WHERE k % 2 = 0))"""


@query(f"WITH {_VOLUMES} SELECT qid, label, title, part_of_series, 'N' || c_nationkey AS country, CAST(k % 50 AS INTEGER) AS ordinal, ceurws_url FROM e")
def event_scan(spark, sf):
    """Events of volumes with one value of each property."""
    return scans.all_of(scans.event_scan(_statements(spark, sf))).select("qid", "label", "title", "part_of_series", "country", "ordinal", "ceurws_url")


@query(f"""WITH {_VOLUMES} SELECT 'CONFERENCE' AS type, qid, title FROM e WHERE k % 4 = 3 OR (k % 4 = 0 AND k % 6 = 0)
UNION ALL SELECT 'WORKSHOP', qid, CASE WHEN k % 4 = 3 THEN 'B Workshop ' || c_name ELSE title END FROM e WHERE k % 4 IN (1, 3) OR k % 10 = 0""")
def typed_event_scan(spark, sf):
    """Conferences and workshops by their titles or their class."""
    found = scans.event_scan(_statements(spark, sf))
    return scans.conferences(found).unionByName(scans.workshops(found)).select("type", "qid", "title")


@query(f"WITH {_VOLUMES} SELECT qid, label, title, 'conf/' || k AS dblp_id, CASE WHEN k % 5 = 2 THEN 'Q47459256 QA QB' ELSE 'QA QB' END AS instance_of FROM s")
def series_scan(spark, sf):
    """Series of the events of volumes; classes as a set."""
    found = scans.all_of(scans.series_scan(_statements(spark, sf)))
    return found.select("qid", "label", "title", "dblp_id", F.array_join(F.array_sort("instance_of"), " ").alias("instance_of"))


@query(f"""WITH {_VOLUMES} SELECT 'CONFERENCE' AS type, qid, title FROM s WHERE k % 3 = 0
UNION ALL SELECT 'WORKSHOP', qid, title FROM s WHERE k % 3 = 1 OR k % 5 = 2""")
def typed_series_scan(spark, sf):
    found = scans.series_scan(_statements(spark, sf))
    return scans.conferences(found, scans.CONFERENCE_SERIES).unionByName(scans.workshops(found, scans.WORKSHOP_SERIES)).select("type", "qid", "title")


@query(f"""WITH {_VOLUMES} SELECT 'P' || k AS qid, 'P' || k AS label, 'C' || c AS event, CAST(k AS INTEGER) AS volume_number, o_orderpriority AS title,
  CASE WHEN k % 2 = 0 THEN 'V' || k END AS acronym, CAST(year(o_orderdate) AS INTEGER) AS year FROM v WHERE k % 3 <> 0""")
def proceedings_scan(spark, sf):
    """Volumes with a title in the language."""
    return scans.proceedings_scan(_statements(spark, sf)).select("qid", "label", "event", "volume_number", "title", "acronym", F.year("pub_date").alias("year"))


@query(f"WITH {_VOLUMES} SELECT 'event' AS kind, qid, label, title FROM e UNION ALL SELECT 'series', qid, label, title FROM s")
def chained_items(spark, sf):
    """Events and then series by the columns that both have."""
    said = _statements(spark, sf)
    return scans.chained(event=scans.all_of(scans.event_scan(said)), series=scans.all_of(scans.series_scan(said))).select("kind", "qid", "label", "title")


@query(f"WITH {_VOLUMES} SELECT qid, label FROM e WHERE k % 2 <> 0 ORDER BY label, qid LIMIT 30")
def events_without_series(spark, sf):
    """The report of the first 30 events without a series."""
    return scans.head(complete.without_parent(scans.all_of(scans.event_scan(_statements(spark, sf)))), 30, "label", "qid").select("qid", "label")


@query("""SELECT c_name AS event_title, CASE WHEN c_custkey % 3 <> 0 THEN 'Name ' || c_custkey WHEN s_suppkey % 2 = 0 THEN 'T ' || s_name ELSE s_name END AS series_title
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % 50 WHERE (c_custkey % 3 = 0 AND s_suppkey IS NOT NULL) OR (c_custkey % 3 <> 0 AND c_custkey % 9 <> 1)""")
def training_titles(spark, sf):
    """Pairs of titles of full matches and of such as are known by name only."""
    c, s, k = _read(spark, sf, "customer"), _read(spark, sf, "supplier"), F.col("c_custkey")
    kind = F.when(k % 3 == 0, "full").when(k % 3 == 1, "page").otherwise("string")
    log = c.select(k.alias("event_qid"), kind.alias("series_kind"), F.when(k % 3 == 0, k % 50).alias("series_qid"), F.when(k % 9 == 1, "").otherwise(F.concat(F.lit("Name "), k.cast("string"))).alias("series_name"))
    events = c.select(k.alias("qid"), F.col("c_name").alias("title"), F.lit("unused").alias("label"))
    series = s.select(F.col("s_suppkey").alias("qid"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("T "), F.col("s_name"))).alias("title"), F.col("s_name").alias("label"))
    return scans.matched_titles(log, events, series)


@query("""WITH c AS (SELECT c_custkey AS k, 'conf/w/' || c_custkey AS id,
  CASE WHEN c_custkey % 5 = 1 THEN NULL WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 3 = 1 THEN 'conf/venue' END
    ELSE CASE c_custkey % 3 WHEN 0 THEN 'conf/only' WHEN 1 THEN CASE WHEN 1990 + c_custkey % 20 >= 1995 THEN 'conf/swat' END ELSE 'conf/abc' END END AS dblp_id FROM customer)
SELECT id, dblp_id, CASE dblp_id WHEN 'conf/only' THEN 'Q0' WHEN 'conf/swat' THEN 'Q1' WHEN 'conf/abc' THEN 'Q2' END AS series_qid,
  CASE WHEN dblp_id = 'conf/venue' THEN 'page' ELSE 'full' END AS series_kind FROM c WHERE dblp_id IS NOT NULL""")
def page_matches(spark, sf):
    """Page events by their type's rules, and their series by id, abbreviation or name."""
    k = F.col("c_custkey")
    c = _read(spark, sf, "customer").select(k, F.concat(F.lit("conf/w/"), k.cast("string")).alias("id"))
    kind = F.when(k % 5 == 0, "CONFERENCE").when(k % 5 == 1, "UNKNOWN").otherwise("WORKSHOP")
    events = c.select("id", F.when(k % 3 == 0, "S").when(k % 3 == 1, "SWAT@VENUE").otherwise("ABC@X").alias("title"), (1990 + k % 20).cast("int").alias("year"), kind.alias("type"))
    row = lambda id_, name: F.struct(F.lit(id_).alias("dblp_id"), F.lit(name).alias("name"))
    several = F.array(row("conf/abc", "Workshop ABC"), row("conf/q", "Workshop Q"))
    up = resolve.parents(c.select("id", F.when(k % 3 == 0, F.array(row("conf/only", "A Workshop"))).when(k % 3 == 1, F.array(row("conf/venue", "Venue"))).otherwise(several).alias("parents")))
    since = F.struct(F.lit(1995).alias("since"), F.lit(None).cast("int").alias("until"), F.array().cast("array<int>").alias("years"))
    r = _read(spark, sf, "region").select("r_regionkey")
    venue = r.filter("r_regionkey = 0").select(F.lit("conf/venue").alias("series_id"), F.lit("SWAT Workshop").alias("name"), F.lit("conf/swat").alias("reference"), since.alias("years"))
    pick = lambda *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.col("r_regionkey").cast("int"))
    pages = r.filter("r_regionkey < 4").select(pick("conf/only", "conf/swat", "conf/abc", "conf/venue").alias("dblp_id"), pick("Unlike", "SWAT Workshop", "Other", "Nowhere").alias("name"), pick(None, "S", "ABC", "V").alias("abbreviation"))
    known = r.filter("r_regionkey < 3").select(
        F.concat(F.lit("Q"), F.col("r_regionkey").cast("string")).alias("qid"), F.col("r_regionkey").alias("seq"), pick("conf/only", None, None).alias("dblp_id"),
        pick("Only", "The SWAT Workshop", "Alphabet").alias("title"), pick("Only", "Label", "Label").alias("label"), pick(None, None, "ABC").alias("acronym"),
    )
    return resolve.page_matches(events, up, venue, pages, known).select("id", "dblp_id", "series_qid", "series_kind")


# Fitting
_KINDS = """names AS (SELECT p_name AS text, min(p_partkey) AS id FROM part GROUP BY p_name),
truth AS (SELECT id AS event, first_value(id) OVER (PARTITION BY split_part(text, ' ', 2) ORDER BY id) AS truth FROM names)"""


def _kinds(spark, sf):
    """Names as events and series; the right series is the least name of the same kind."""
    names = _names(spark, sf)
    kind = Window.partitionBy(F.substring_index("text", " ", -1)).orderBy("id")
    return names.select("id", "text"), names.select(F.col("id").alias("event"), F.first("id").over(kind).alias("truth"))


_SCORES = 'round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1'
_SIZES = f"""WITH {_KINDS},
g AS (SELECT n, id, list_distinct(list_transform(range(1, length(text) - n + 2), lambda i : substr(text, i, n))) AS g FROM names, (SELECT unnest([3, 4, 5]) AS n)),
pairs AS (SELECT a.n, a.id AS event, b.id AS predicted, 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS s FROM g a JOIN g b ON a.n = b.n),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, event ORDER BY s DESC, predicted) AS r FROM pairs WHERE s >= 0.6) WHERE r = 1),
points AS (SELECT n, t::DOUBLE AS threshold FROM (SELECT unnest([3, 4, 5]) AS n), (SELECT unnest([0.8, 0.7, 0.6]) AS t)),
c AS (SELECT points.n, threshold, count(*) FILTER (s >= threshold AND predicted = truth) AS tp, count(*) FILTER (s >= threshold AND predicted <> truth) AS fp,
  count(*) FILTER (s IS NULL OR s < threshold) AS fn FROM points CROSS JOIN truth LEFT JOIN best ON best.n = points.n AND best.event = truth.event GROUP BY ALL),
m AS (SELECT CAST(n AS INTEGER) AS n, threshold, tp, fp, fn, {_SCORES} FROM c)"""


@query(f"{_SIZES} SELECT * FROM m")
def ngram_size_grid(spark, sf):
    """Sizes of grams by thresholds."""
    names, truth = _kinds(spark, sf)
    return tuning.ngram_grid(names, names, truth).drop("place")


@query(f"{_SIZES} SELECT * FROM m ORDER BY coalesce(f1, -1) DESC, n, threshold DESC LIMIT 1")
def ngram_size_best(spark, sf):
    names, truth = _kinds(spark, sf)
    return tuning.best_point(tuning.ngram_grid(names, names, truth)).drop("place")


@query(rf"""WITH {_KINDS},
sides AS (SELECT 0 AS side, id, text FROM names UNION ALL SELECT 1, id, text FROM names),
t AS (SELECT side, id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM sides),
tf AS (SELECT side, id, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT side, id, term, tf * (ln((1 + (SELECT count(*) FROM sides)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term)),
w AS (SELECT side, id, term, x / sqrt(sum(x * x) OVER (PARTITION BY side, id)) AS w FROM x),
hits AS (SELECT a.id AS event, b.id AS predicted, round(sum(a.w * b.w), 9) AS s FROM w a JOIN w b ON a.term = b.term AND a.side = 0 AND b.side = 1 GROUP BY 1, 2),
c AS (SELECT t::DOUBLE AS threshold, count(*) FILTER (s >= t AND predicted = truth) AS tp, count(*) FILTER (s >= t AND predicted <> truth) AS fp, (SELECT count(*) FROM truth) AS events
  FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]) AS t) CROSS JOIN (hits JOIN truth USING (event)) GROUP BY t),
d AS (SELECT threshold, tp, fp, events - tp - fp AS fn FROM c)
SELECT *, {_SCORES} FROM d""")
def tfidf_grid(spark, sf):
    """Thresholds of TF-IDF; every hit counts."""
    names, truth = _kinds(spark, sf)
    return tuning.tfidf_grid(names, names, truth, stop=()).drop("place")


@query(f"""WITH {_PHRASE},
truth AS (SELECT doc_id, min(item_id) AS truth FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id),
c AS (SELECT count(*) FILTER (item_id = truth) AS tp, count(*) FILTER (item_id <> truth) AS fp, (SELECT count(*) FROM truth) AS n FROM phrases JOIN truth USING (doc_id)),
d AS (SELECT tp, fp, n - tp - fp AS fn FROM c)
SELECT *, {_SCORES} FROM d""")
def span_accuracy(spark, sf):
    """All found passages against the first that a document contains."""
    texts, items = _texts(spark, sf), _texts(spark, sf, "benchmark", "item_id")
    truth = similarity.containment_pairs(texts, items).groupBy(F.col("l_id").alias("event")).agg(F.min("r_id").alias("truth"))
    return tuning.span_accuracy(_phrases(spark, sf).select(F.col("l_id").alias("event"), F.col("r_id").alias("predicted")), truth)
