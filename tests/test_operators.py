"""Joins, rules, votes and patches on small rows, against brute force where that is plain."""

import math
import random
import re
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction
from itertools import product

import pytest
from pyspark.sql import functions as F

from linkloom.functions import html as H
from linkloom.operators import complete, ensemble, nearest, resolve, runs, similarity


@pytest.mark.parametrize("measure,threshold", [("dice", Fraction(3, 5)), ("jaccard", Fraction(1, 2)), ("dice", Fraction(1))])
def test_set_similarity_is_lossless(spark, measure, threshold):
    rng = random.Random(3)
    rows = [(i, sorted(rng.sample("abcdefgh", rng.randint(0, 6)))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, grams array<string>")
    got = {(r.l_id, r.r_id) for r in similarity.set_similarity_pairs(df, df, measure, threshold).collect()}
    want = set()
    for (i, a), (j, b) in product(rows, rows):
        x, whole = len(set(a) & set(b)), len(a) + len(b) if measure == "dice" else len(set(a) | set(b))
        if a and b and Fraction((2 if measure == "dice" else 1) * x, whole) >= threshold:
            want.add((i, j))
    assert got == want


def test_containment(spark):
    texts = spark.createDataFrame([(1, "xa one two three four b"), (2, "hello short one"), (3, None), (4, "")], "id long, text string")
    patterns = spark.createDataFrame([(1, "a one two three four"), (2, "short"), (3, None), (4, "one two three four x")], "id long, text string")
    assert sorted(map(tuple, similarity.containment_pairs(texts, patterns).collect())) == [(1, 1), (2, 2)]


def test_phrases(spark):
    texts = spark.createDataFrame([(1, "The IR, Workshop: IR, Workshop"), (2, "ir workshop")], "id long, text string")
    phrases = spark.createDataFrame([(7, "IR, Workshop"), (8, "")], "id long, text string")
    assert sorted(map(tuple, similarity.phrase_pairs(texts, phrases).collect())) == [(1, 7, 1), (1, 7, 5)]


def test_passages_are_matched_whole(spark, tmp_path):
    from linkloom import queries

    passage = "one two three four five, six 7 eight nine"
    docs = [(1, "one two three four five only"), (2, f"so: {passage}. {passage}"), (3, passage.replace("nine", "ten")), (4, None), (5, passage[:-2]), (None, passage), (6, "x two three"), (6, f"a {passage}")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(8, passage), (9, "two three"), (7, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pairs = sorted(((r.l_id or 0, r.r_id, r.start) for r in queries._phrases(spark, str(tmp_path)).collect()))
    assert pairs == [(0, 8, 0), (0, 9, 1), (1, 9, 1), (2, 8, 2), (2, 8, 13), (2, 9, 3), (2, 9, 14), (3, 9, 1), (5, 9, 1), (6, 8, 1), (6, 9, 1), (6, 9, 2)]


def test_votes_and_scores(spark):
    rows = [("e", "s", "a", 2), ("e", "s", "b", 1), ("e", "t", "a", 1)]
    m = spark.createDataFrame(rows, "event string, series string, found_by string, seq int")
    assert [tuple(r) for r in ensemble.vote(m, 2).collect()] == [("e", "s", 2, "b+a")]
    assert sorted(map(tuple, ensemble.vote_frequency(m).collect())) == [(1, 1), (2, 1)]
    empty = ensemble.with_scores(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).first()
    assert (empty.precision, empty.recall, empty.f1) == (None, None, None)


def test_patches_override_and_leave_the_input(spark):
    items = spark.createDataFrame([("Q1", None, 5), ("Q2", "X", None)], "qid string, acronym string, ordinal int")
    log = spark.createDataFrame([("Q1", "acronym", "MBK", "t", 1), ("Q2", "acronym", "Y", "t", 2), ("Q2", "acronym", "Z", "t", 3), ("Q2", "ordinal", "7", "t", 4)], "qid string, attr string, value string, found_by string, seq long")
    got = {r.qid: (r.acronym, r.ordinal) for r in complete.patched(items, log, ["acronym", "ordinal"]).collect()}
    assert got == {"Q1": ("MBK", 5), "Q2": ("Z", 7)}
    assert items.filter("qid = 'Q1'").first().acronym is None
    assert [r.qid for r in complete.uncompleted(items, "ordinal", log).collect()] == []


def test_hierarchy(spark):
    series = spark.createDataFrame([("conf/loom",), ("conf/weft",)], "id string")
    events = spark.createDataFrame([("conf/loom/one",), ("conf/loom/two",), ("conf/loom1/a",), ("journals/yarn/v3",)], "id string")
    assert {r.series_id: r.events for r in resolve.children_by_prefix(series, events).collect()} == {"conf/loom": ["conf/loom/one", "conf/loom/two"], "conf/weft": []}
    raw = {r.series_id: r.events for r in resolve.children_by_prefix(series, events, boundary=False).collect()}
    assert raw["conf/loom"] == ["conf/loom/one", "conf/loom/two", "conf/loom1/a"]


def test_workshop_cascade(spark):
    kinds = "id string, title string, year int"
    events = spark.createDataFrame([("conf/a/1", "S 2004", 2004), ("conf/b/2", "SWAT@ISWC 2004", 2004), ("conf/c/3", "ABC@X 2001", 2001), ("conf/d/4", "none", 2000)], kinds)
    parents = spark.createDataFrame([("conf/a/1", 0, "conf/a", "Workshop on S"), ("conf/b/2", 0, "conf/iswc", "ISWC Conference"), ("conf/c/3", 0, "conf/x", "X"), ("conf/c/3", 1, "conf/abc", "Workshop ABC"), ("conf/c/3", 2, "conf/q", "Workshop Q")], "id string, pos int, parent_id string, parent_name string")
    venue = spark.createDataFrame([("conf/iswc", "SWAT Workshop", "conf/swat", (2003, None, [])), ("conf/iswc", "SWAT old", None, (None, 2002, []))], "series_id string, name string, reference string, years struct<since:int,until:int,years:array<int>>")
    got = {r.id: (r.parent_id, r.rule) for r in resolve.workshop_series(events, parents, venue).collect()}
    assert got == {"conf/a/1": ("conf/a", 1), "conf/b/2": ("conf/swat", 2), "conf/c/3": ("conf/abc", 3)}
    conferences = {r.id: r.parent_id for r in resolve.conference_series(parents).collect()}
    assert "conf/a/1" not in conferences and conferences["conf/b/2"] == "conf/iswc"


PAGE = """<html><body><div id="breadcrumbs"><ul><li><span><span><a href="https://dblp.org/db/conf/weave"><span>WEAVE</span></a><meta itemprop="position" content="3"></span></span></li></ul></div>
<header id="headline" data-bhtkey="db/conf/weave/weave1999"><h1>7. WEAVE 1999: Ghent, Belgium</h1></header><div id="main"><header><h2>8th WEAVE 2001: Lyon</h2></header><p><br>x</div></body>"""


def test_pages(spark):
    other = '<header id="headline" data-bhtkey="db/journals/weave/index"><h1>x</h1></header>'
    pages = spark.createDataFrame([(PAGE,), (None,), ("<p>broken",), (other,)], "html string").select(H.page(F.col("html")).alias("p"))
    got = pages.select("p.*", H.event(F.col("p")).alias("e"), H.series(F.col("p")).alias("s")).collect()
    assert got[0].headline == "7. WEAVE 1999: Ghent, Belgium" and got[0].headers == ["8th WEAVE 2001: Lyon"] and got[0].id == "conf/weave/weave1999"
    assert tuple(got[0].e) == ("conf/weave/weave1999", "7. WEAVE 1999", 1999, "Ghent, Belgium", 7) and got[0].s is None
    assert [(p.dblp_id, p.name) for p in got[0].parents] == [("conf/weave", "WEAVE")]
    assert (got[1].headline, got[2].headline, got[2].is_series, got[1].e, got[3].id) == (None, None, False, None, None)


def test_parents_fall_back_to_the_stem(spark):
    events = spark.createDataFrame([("conf/loom/one", [])], "id string, parents array<struct<dblp_id:string,name:string>>")
    assert [tuple(r) for r in resolve.parents(events).collect()] == [("conf/loom/one", 0, "conf/loom", "loom")]


def test_types(spark):
    rows = spark.createDataFrame([("A Workshop Conference", False), ("B Conference", False), (None, True), ("C", False)], "t string, i boolean")
    kind = complete.resolved_type(complete.is_conference(F.col("t"), F.col("i")), complete.is_workshop(F.col("t"), F.col("i")))
    assert [r[0] for r in rows.select(kind).collect()] == ["WORKSHOP", "CONFERENCE", "WORKSHOP", "UNKNOWN"]


def test_series_by_rules(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    known = [(f"Q{i}", rng.choice([None, i // 3, 50 - i]), rng.choice([None, f"d{i % 9}"]), rng.choice([None, word(12)]), rng.choice([None, word(9)]), rng.choice([None, "", "A", "B"])) for i in range(60)]
    pages = [(rng.choice([None, f"d{i % 40}"]), rng.choice([None, "", "a", word(2), word(3), word(5), word(6), "zzzz"]), rng.choice([None, "", "A", "C"])) for i in range(150)]
    want = {}
    for d, name, abbr in pages:
        for qid, seq, own, title, label, acronym in known:
            same = d is not None and d == own
            if same or abbr is not None and abbr == acronym or name is not None and any(t is not None and name in t for t in (title, label)):
                want[d] = min(want.get(d, (2,)), (0 if same else 1, seq is None, seq or 0, qid))
    p = spark.createDataFrame(pages, "dblp_id string, name string, abbreviation string")
    s = spark.createDataFrame(known, "qid string, seq int, dblp_id string, title string, label string, acronym string")
    out = resolve.series_by_rules(p, s)
    assert {r.dblp_id: (r.rule, r.qid) for r in out.collect()} == {d: (w[0], w[3]) for d, w in want.items()}
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _cosines(rows):
    """{l_id: (r_id, score)} by brute force, scores rounded half away from zero."""
    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        dot = lambda x, y: sum((p * q for p, q in zip(x, y)), 0.0)
        norms = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
        return 0.0 if norms == 0 else float(Decimal(dot(a, b) / norms).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if math.isfinite(norms) else math.nan

    best = {}
    for i, a in rows:
        for j, b in rows:
            if i is not None and j is not None and i != j:
                s = score(a, b)
                key = (-2.0 if s is None else 2.0 if s != s else s, [-j])
                best[i] = max(best.get(i, (-9.0, [0], None)), (*key, s))
    return {i: (-j[0], repr(s)) for i, (_, j, s) in best.items()}


@pytest.mark.parametrize("chunks", [1, 3])
def test_most_similar_vectors(spark, monkeypatch, chunks):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(0, 300, 2)]
    rows += [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(1, 300, 2)]
    rows += [(i, [0.3, 0.1, -0.7, 2.0]) for i in range(400, 440)] + [(500, None), (501, [1.0, None, 2.0, 1.0]), (None, [1.0] * 4), (502, [1.0, 2.0]), (503, [2.0, 4.1])]
    rows += [(600, [1e-120, 2e-120, 0.0, 0.0]), (601, [1e120, 0.0, -1e120, 0.0]), (7, [5.0, 5.0, 4.9, -3.0])]
    monkeypatch.setattr(nearest, "LEAST", 1000 if chunks == 1 else 120)
    for more in ([], [(700, [math.nan, 1.0, 1.0, 1.0]), (701, [math.inf, 1.0, 1.0, 1.0])]):
        df = spark.createDataFrame(rows + more, "id long, vec array<double>").repartition(3)
        assert {r.l_id: (r.r_id, repr(r.score)) for r in similarity.cosine_top1(df, df).collect()} == _cosines(rows + more)


def test_most_similar_vectors_have_no_row_by_row_loop(spark):
    """Twelve million pairs, by products."""
    near = spark.range(3500).select(F.col("id").cast("string").alias("id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: F.sin(F.col("id") * x + x * x)).alias("vec"))
    out = similarity.cosine_top1(near, near, 0.5)
    assert out.schema["r_id"].dataType.simpleString() == "string" and "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    assert out.filter("l_id = r_id or score <= 0.5").count() == 0


def test_vectors_without_another(spark):
    one = spark.createDataFrame([(1, [1.0]), (1, [2.0])], "id long, vec array<double>")
    assert similarity.cosine_top1(one, one).count() == 0 and similarity.cosine_top1(one.limit(0), one).count() == 0


@pytest.mark.parametrize("threshold,small", [(Fraction(1, 2), False), (Fraction(1, 2), True), (Fraction(4, 5), True), (Fraction(1, 10), True)])
def test_similar_texts_are_all_found(spark, monkeypatch, threshold, small):
    if small:  # many buckets, slices and shuffled joins on few rows
        for name, value in (("BYTES", 300), ("ROWS", 100), ("BUCKET", 500), ("PAIRS", 50), ("PLACES", 0)):
            monkeypatch.setattr(runs, name, value)
    rng = random.Random(11)
    vocabulary = ["a", "b", "é", "d d", "ee", "f", "g,"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(60)]
    for t in texts[:40]:
        for _ in range(2):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "x"
            texts.append("\t ".join(w) + "\n")
    rows = [(i, t) for i, t in enumerate(texts + texts[:9] + ["one common line of words " + str(i) for i in range(30)] + ["q q q q q"] * 25)] + [(900, None), (None, texts[0])]
    rng.shuffle(rows)
    sets = {i: {tuple(w[j : j + 3]) for w in [[x for x in re.split(r"[ \t\n\x0b\f\r]+", t) if x]] for j in range(len(w) - 2)} for i, t in rows if t is not None and i is not None}
    want = {(i, j): (len(a & b), len(a), len(b)) for i, a in sets.items() for j, b in sets.items() if i < j and a and b and Fraction(len(a & b), len(a | b)) >= threshold}
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = runs.similar_texts(df, threshold).collect()
    assert len(got) == len(want) and {(r.l_id, r.r_id): (r.inter, r.l_n, r.r_n) for r in got} == want
    assert all(abs(r.score - r.inter / (r.l_n + r.r_n - r.inter)) < 1e-12 for r in got)
    assert runs.similar_texts(df.limit(0), threshold).count() == 0
