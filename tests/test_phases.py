"""Rates of phases on rows in which each branch decides."""

import datetime as dt

from pyspark.sql import functions as F

from quillon.operators import phases


def test_states_rates_and_what_is_left(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    order = ["a", "b", "c", "d", "e"]
    tasks = spark.createDataFrame(
        [(1, order, "d", at(0), 30, 40, at(60)), (2, order, "b", None, 5, 9, at(60)), (3, order, "x", at(0), 1, 2, at(9)), (4, order, "a", at(0), 50, 40, at(60)), (5, order, "a", at(0), 0, 40, at(60))],
        "id int, phases array<string>, phase string, started_at timestamp, done int, total int, as_of timestamp",
    )
    closed = spark.createDataFrame(
        [(1, 1, "a", at(0), at(9), 2.0, 10, 10), (1, 2, "c", at(3), at(3), 0.0, 7, 7), (1, 3, "a", at(5), at(9), None, 8, 8), (2, 1, "c", at(9), at(3), None, None, None)],
        "id int, no int, phase string, started_at timestamp, ended_at timestamp, seconds double, done int, total int",
    )
    got = {(r["id"], r["phase"]): (r["status"], r["elapsed_ms"], r["rate"], r["eta"]) for r in phases.rates(tasks, closed, ["id"]).collect()}
    assert [got[1, p] for p in order] == [("done", 4000, 2.0, None), ("skipped", None, None, None), ("done", 0, None, None), ("running", 60000, 0.5, 20.0), ("pending", None, None, None)]
    assert [got[2, p] for p in order[:3]] == [("skipped", None, None, None), ("running", 0, None, None), ("done", 0, None, None)]
    assert {got[3, p][0] for p in order} == {"pending"}
    assert (got[4, "a"], got[5, "a"]) == (("running", 60000, 0.833333333, None), ("running", 60000, None, None))


def test_durations(spark):
    rows = spark.createDataFrame([(n,) for n in (999, 1000, 59_999, 60_000, 61_000, 3_600_000, 3_661_000, None)], "ms bigint")
    assert [r["d"] for r in rows.coalesce(1).select(phases.duration(F.col("ms")).alias("d")).collect()] == ["<1 秒", "1 秒", "59 秒", "1 分", "1 分 1 秒", "1 时", "1 时 1 分", None]
