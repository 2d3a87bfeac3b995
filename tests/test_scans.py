"""Scans of statements and the fitting of matchers."""

from linkloom.operators import scans
from linkloom.plans import tuning

DDL = "subject string, property string, value string, lang string"


def volume(k, event, **more):
    facts = {scans.INSTANCE_OF: scans.PROCEEDINGS_CLASS, scans.SERIES_OF: scans.VOLUMES_SERIES, scans.VOLUME: str(k), scans.PROCEEDINGS_OF: event} | more
    return [(f"P{k}", p, v, None) for p, v in facts.items() if v is not None]


def test_optional_and_mandatory_properties(spark):
    rows = volume(1, "E1") + volume(2, "E2") + volume(3, "E3", P31="Q1") + volume(4, "E4", **{scans.VOLUME: None})
    rows += [("E1", scans.TITLE, "Titel", "de"), ("E2", scans.TITLE, "b", "en"), ("E2", scans.TITLE, "a", "en"), ("E2", scans.TITLE, "a", "en"), ("E2", "P580", "no date", None)]
    rows += [("P2", scans.TITLE, "Vol", "en"), (None, scans.TITLE, "x", "en"), ("E2", None, "x", "en"), ("E2", scans.TITLE, None, "en")]
    s = spark.createDataFrame(rows, DDL)
    events = {r["qid"]: r for r in scans.all_of(scans.event_scan(s)).collect()}
    assert set(events) == {"E1", "E2"}
    assert events["E1"]["title"] is None and events["E2"]["title"] == "a" and events["E2"]["label"] == "E2" and events["E2"]["start_time"] is None
    assert [(r["qid"], r["event"], r["volume_number"], r["title"]) for r in scans.proceedings_scan(s).collect()] == [("P2", "E2", 2, "Vol")]


def test_empty_statements(spark):
    s = spark.createDataFrame([], DDL)
    assert scans.all_of(scans.event_scan(s)).count() == scans.all_of(scans.series_scan(s)).count() == scans.proceedings_scan(s).count() == 0


def test_a_bare_event_keeps_its_row(spark):
    found = scans.event_scan(spark.createDataFrame(volume(1, "E1"), DDL))
    assert [(r["qid"], r["label"], r["titles"]) for r in found.collect()] == [("E1", "E1", [])]
    assert scans.conferences(found).count() == scans.workshops(found).count() == 0


def test_matched_titles_leave_out_empty_names(spark):
    log = spark.createDataFrame([("e", "full", "s", None), ("e", "full", "gone", None), ("e", "string", None, "n"), ("e", "page", None, ""), ("f", "page", None, "n")], "event_qid string, series_kind string, series_qid string, series_name string")
    items = "qid string, title string, label string"
    out = scans.matched_titles(log, spark.createDataFrame([("e", None, "E"), ("f", "", "F")], items), spark.createDataFrame([("s", None, "S")], items))
    assert sorted(map(tuple, out.collect())) == [("E", "S"), ("E", "n")]


def test_hits_count_one_by_one(spark):
    hits = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.6)], "event int, predicted int, score double")
    truth = spark.createDataFrame([(1, 1), (2, 2)], "event int, truth int")
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in tuning.counted_hits(hits, truth, [0.5, 0.7, 0.95]).collect()}
    assert got == {0.5: (1, 2, -1), 0.7: (1, 1, 0), 0.95: (0, 0, 2)}


def test_the_first_of_equal_points_wins(spark):
    points = spark.createDataFrame([(3, 0.5), (2, 0.5), (1, None)], "place int, f1 double")
    assert tuning.best_point(points).first()["place"] == 2


def test_a_perfect_fit_matches_nothing(spark):
    names = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "id int, text string")
    itself = names.selectExpr("id AS event", "id AS truth")
    wrong = names.selectExpr("id AS event", "CASE id WHEN 1 THEN 1 ELSE 9 END AS truth").unionByName(spark.createDataFrame([(3, 3)], "event int, truth int"))
    assert tuning.fitted_ngram(names, names, itself, names).count() == 0
    assert sorted(map(tuple, tuning.fitted_ngram(names, names, wrong, names).collect())) == [(1, 1), (2, 2)]
