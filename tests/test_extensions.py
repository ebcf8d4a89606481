"""A user's validators and interceptors: their issues, what they may not return, and that an exception stays with its event."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from archweave.operators import coach
from archweave.operators import extensions as ext

EVENTS = "event_id long, intent string, source string, event_version string, payload string"
PLACED = "Domain.Order.Placed"


async def _later(payload):
    return []


@pytest.mark.parametrize(
    ("check", "payload", "want"),
    [
        (lambda p: None, "{}", []),
        (lambda p: [], "{}", []),
        (lambda p: [(("a", 0, "b"), "m"), ("x.y", "m"), (None, "m"), ((), 3)], "{}", [("a[0].b", "invalid", "m"), ("x.y", "invalid", "m"), ("$", "invalid", "m"), ("$", "invalid", "3")]),
        (lambda p: [((), "none")] if p is None else [], None, [("$", "invalid", "none")]),
        (lambda p: [((), "null")] if p is None else [], "null", [("$", "invalid", "null")]),
        (lambda p: 1 / 0, "{}", [("$", "validator-error", "ZeroDivisionError: division by zero")]),
        (lambda p: [((1.5,), "m")], "{}", [("$", "validator-error", "TypeError: a path has names and positions")]),
        (lambda p: 7, "{}", [("$", "validator-error", "TypeError: 'int' object is not iterable")]),
        (lambda p: [], "{", [("$", "not-json", "the payload is no JSON")]),
        (_later, "{}", [("$", "asynchronous", "a validator must answer at once")]),
    ],
)
def test_issues(check, payload, want):
    assert ext.issues_of(check, payload) == want


def test_exceptions_stay_with_their_events(spark):
    rows = [(i, PLACED, "s", "2", json.dumps({"k": i})) for i in range(100)] + [(100, "Domain.User.Registered", "s", "1", '{"k":0}'), (101, PLACED, "s", "9", '{"k":0}'), (102, PLACED, "s", "2", None)]
    events = spark.createDataFrame(rows, EVENTS).coalesce(1)
    got = ext.validate_with(events, (ext.Validator(PLACED, "2", lambda p: [("k", "odd")] if 8 // p["k"] % 2 else []),)).collect()
    errors = {x.event_id: x.message.split(":")[0] for x in got if x.code == "validator-error"}
    assert errors[0] == "ZeroDivisionError" and errors[102] == "TypeError" and 100 not in errors
    assert {x.event_id for x in got if x.code == "invalid" and x.event_id < 100} == {i for i in range(1, 100) if 8 // i % 2}
    assert {(x.event_id, x.code) for x in got if x.message is None} == {(101, "no-contract"), (102, "missing-required")}


def test_no_events(spark):
    none = spark.createDataFrame([], EVENTS)
    assert ext.validate_with(none, (ext.Validator(PLACED, "2", lambda p: []),)).count() == 0
    assert ext.intercept_with(none, (ext.CodedInterceptor("a", PLACED, lambda p: {}),)).count() == 0


def test_interceptors_in_order(spark):
    coded = (
        ext.CodedInterceptor("first", PLACED, lambda p: {"n": p["k"] + 1}),
        ext.CodedInterceptor("second", PLACED, lambda p: {"m": p["n"] * 2} if "n" in p else None),
        ext.CodedInterceptor("over", PLACED, lambda p: {"k": 9}, F.col("event_id") == 1),
        ext.CodedInterceptor("odd", PLACED, lambda p: 5, F.col("event_id") == 2),
        ext.CodedInterceptor("nan", PLACED, lambda p: {"z": float("nan")}, F.col("event_id") == 3),
    )
    rows = [(1, PLACED, "s", "2", '{"k":1}'), (2, PLACED, "s", "2", '{"k":2}'), (3, PLACED, "s", "2", '{"k":3}'), (4, PLACED, "s", "2", '{"k":"x"}'), (5, "Other", "s", "2", '{"k":1}'), (6, PLACED, "s", "2", None)]
    got = {x.event_id: x for x in ext.intercept_with(spark.createDataFrame(rows, EVENTS), coded).collect()}
    assert [(got[i].payload, list(got[i].interceptions), list(got[i].failures)) for i in (1, 2, 3)] == [
        ('{"k":1,"m":4,"n":2}', ["first", "second"], ["over"]),
        ('{"k":2,"m":6,"n":3}', ["first", "second"], ["odd"]),
        ('{"k":3,"m":8,"n":4}', ["first", "second"], ["nan"]),
    ]
    assert got[1].errors == ["over: conflict: payload.k"] and got[2].errors == ["odd: TypeError: a patch is an object or an array"]
    assert (got[4].payload, list(got[4].failures)) == ('{"k":"x"}', ["first"])
    assert (got[5].payload, list(got[5].failures), list(got[5].interceptions)) == ('{"k":1}', [], [])
    assert got[6].payload is None and list(got[6].failures) == ["first", "second"]


def test_events_that_forbid_it(spark):
    rows = spark.createDataFrame([(1, PLACED, "s", "2", '{"k":1}')], EVENTS).withColumn("allow_interception", F.lit(False))
    got = ext.intercept_with(rows, (ext.CodedInterceptor("a", PLACED, lambda p: {"n": 1}),)).first()
    assert (got.payload, list(got.interceptions)) == ('{"k":1}', [])


def test_recommendations(spark):
    weights = spark.createDataFrame([("api", "service", 6), ("db", "service", 4), ("ui", "service", -3), ("ui", "app", 8), ("api", "app", 1)], "signal string, archetype string, weight int")
    have = {"whole": ("api", "db"), "close": ("api", "ui"), "none": (), "thin": ("api", "db"), "low": ("ui",)}
    signals = spark.createDataFrame([(r, s, int(s in own)) for r, own in have.items() for s in ("api", "db", "ui")], "repo string, signal string, value int")
    trees = spark.createDataFrame([("whole", 50, False, 95.0), ("close", 50, None, 95.0), ("none", 50, True, 95.0), ("thin", 3, False, 95.0), ("low", 50, False, None), ("unseen", None, None, None)], "repo string, n_sources int, tiny boolean, coverage double")
    got = {x.repo: tuple(x)[1:] for x in coach.recommendations(coach.archetype_scores(signals, weights), weights, trees, "spike").collect()}
    assert got == {
        "whole": ("service", "app", 10, 0.97, False, False, False, False),
        "close": ("app", "service", 9, 0.9, False, False, False, False),
        "none": ("spike", "service", 0, 0.55, False, False, False, True),
        "thin": ("service", "app", 10, 0.28, False, True, False, True),
        "low": ("app", "service", 8, 0.49, False, False, True, True),
        "unseen": ("spike", None, 0, 0.35, False, False, True, True),
    }
