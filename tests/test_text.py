"""Scalar functions on literal rows."""

from pyspark.sql import functions as F

from linkloom.functions import text as T


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("c")).alias("x")).collect()]


def test_irregular_titles(spark):
    titles = ["DL 1992; Boston, MA, USA", "4th 1980 Amsterdam", "IR 1995 Workshop: San Francisco, California, USA", "33rd DL 2020: Online Event [Rhodes, Greece]", "9th CIKM 2000 Washington, DC, USA", "X 2021 [virtual]", None]
    got = column(spark, titles, T.event_from_title)
    assert [(r.title, r.location, r.year, r.ordinal) for r in got] == [
        ("DL 1992", "Boston, MA, USA", 1992, None),
        ("4th 1980 Amsterdam", None, 1980, 4),
        ("IR 1995 Workshop", "San Francisco, California, USA", 1995, None),
        ("33rd DL 2020", "Online Event [Rhodes, Greece]", 2020, 33),
        ("9th CIKM 2000 Washington, DC, USA", None, 2000, 9),
        ("X 2021", "[virtual]", 2021, None),
        (None, None, None, None),
    ]


def test_free_ordinals(spark):
    titles = ["12th Symposium on Looms", "The 3rd Days of Yarn for Weavers", "First Gathering of Dyers", "Sessions of the 2019 Fair", "Twenty-First Meeting"]
    assert column(spark, titles, T.free_ordinal) == [12, 3, 1, None, 21]


def test_year_ranges(spark):
    r = column(spark, ["since 2001, 2003-2005, 2009", "until 1999", "no year", "2005-2003", "2003 - 2005", "since 1999, 1999"], T.year_range)
    assert (r[0].since, r[0].until, r[0].years) == (2001, None, [2003, 2004, 2005, 2009])
    assert (r[1].until, r[1].years, r[2], r[3]) == (1999, [], None, None)
    assert r[4].years == [2005] and (r[5].since, r[5].years) == (1999, [])
    rows = spark.createDataFrame([(2004,), (2010,)], "y int").select(T.in_year_range(F.col("y"), T.year_range(F.lit("since 2001, 2003-2005, 2009"))).alias("x"))
    assert sorted(x[0] for x in rows.collect()) == [False, True]


def test_acronyms_and_ids(spark):
    assert column(spark, ["a (B) (C)", "()", "none", "x (A B) (CD)"], T.acronym) == ["B", "", None, "A B"]
    assert column(spark, ["x (A B) (CD)", "none"], T.abbreviation) == ["CD", None]
    assert column(spark, ["SWAT@ISWC 2009", "none"], T.at_abbreviation) == ["SWAT", None]
    assert column(spark, ["https://dblp.org/db/conf/ai/index.html", "conf/ai/x.html"], lambda c: T.url_to_id(c, "https://dblp.org/db/")) == ["conf/ai", "conf/ai/x"]
    assert column(spark, ["conf/yarn/", "https://loom.example"], T.clean_id) == ["conf/yarn", None]
    assert column(spark, ["conf/a", "conf/a/b", "x/a"], T.is_series_id) == [True, False, False]
    assert column(spark, ["http://www.wikidata.org/entity/Q5", "Q7"], T.parse_qid) == ["Q5", "Q7"]


def test_sets(spark):
    d = spark.createDataFrame([("abcd", "abce"), ("ab", "abc")], "a string, b string")
    a, b = T.char_ngrams(F.col("a"), 3), T.char_ngrams(F.col("b"), 3)
    got = d.select(T.dice(a, b), T.jaccard(a, b)).collect()
    assert (got[0][0], round(got[0][1], 6), got[1][0]) == (0.5, 0.333333, 0.0)
    assert column(spark, ["A-B, the Cat!"], lambda c: T.content_words(c)) == [["ab", "cat"]]
    assert column(spark, ["yearly meeting", "yearbooks", None], lambda c: T.contains_synonym(c, ["annual", "yearly", "yearbook"])) == [True, False, None]


def test_headers(spark):
    got = column(spark, ["2nd A / 3rd B 2010: Rome"], T.events_from_header)[0]
    assert [(e.title, e.year, e.location, e.ordinal) for e in got] == [("2nd A 2010", 2010, "Rome", 2), ("3rd B 2010", 2010, "Rome", 3)]
