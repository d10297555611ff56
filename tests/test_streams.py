"""States of tasks and windows over streams of several batches: equal to the batch form, replays, late rows, bounded state."""

import datetime as dt

from quillon.streaming import tasks

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
T0 = dt.datetime(2024, 1, 1)


def events(n=240):
    """Events an hour apart of three users, some at equal times, with a pause after each thirty."""
    return [(i, T0 + dt.timedelta(hours=i - i % 7 // 6 + i // 30 * 9), i % 3, ("view", "error")[i % 2], float(i)) for i in range(n)]


def batches(spark, path, parts):
    """A stream that reads one file for each part, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/{i:02d}")
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return read.parquet(str(path)).withWatermark("ts", tasks.CLOSES)


def newest(rows):
    out = {}
    for no, at, user, kind, value in rows:
        if at is not None:
            key = f"{user}:{kind}" if user is not None else kind
            out[key] = max(out.get(key, (T0, -1)), (at, no, tasks.STATUSES[no % 5], value))
    return out


def states(spark, path, after=None):
    return {r["task_id"]: r for r in tasks.states(spark, str(path), after).collect()}


def test_states_of_batches_in_any_order(spark, tmp_path):
    rows = events()
    parts = [rows[120:180], rows[:120] + rows[:5], rows[180:] + [(999, None, 1, "view", 1.0), (1000, T0, None, "error", None)]]
    path, changes = tmp_path / "t", [tasks.task_changes(spark.createDataFrame(p, SCHEMA)) for p in parts]
    for no, batch in enumerate(changes):
        tasks.upsert_states(batch, no, str(path))
        got, want = states(spark, path), newest(sum(parts[: no + 1], []))
        assert {k: (r["at"], r["no"], r["status"], r["value"]) for k, r in got.items()} == want
        if no == 1:
            assert sum(r["n_late"] for r in got.values()) == 125 and not states(spark, path, 0)  # all older than the first batch
    before = states(spark, path)
    assert sum(r["n"] for r in before.values()) == 246 and states(spark, path, 1).keys() == before.keys()
    tasks.upsert_states(changes[2], 2, str(path))  # the batch runs again
    tasks.upsert_states(changes[1].limit(0), 3, str(path))
    assert states(spark, path) == before


def test_stream_gives_the_states_of_the_batch(spark, tmp_path):
    rows = events(60)
    run = tasks.stream_states(tasks.task_changes(batches(spark, tmp_path / "e", [rows[:20], rows[20:40], rows[40:]])), str(tmp_path / "t"), str(tmp_path / "c"))
    run.awaitTermination()
    got = states(spark, tmp_path / "t")
    assert {k: (r["at"], r["no"], r["status"], r["value"]) for k, r in got.items()} == newest(rows) and {r["last_batch"] for r in got.values()} == {2}


def test_windows_close_and_their_state_goes(spark, tmp_path):
    rows = events()
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    for name, made in (("sliding", tasks.sliding_counts), ("sessions", tasks.activity_sessions)):
        stream = made(batches(spark, tmp_path / name, parts))
        run = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress]
        batch = made(spark.createDataFrame(rows, SCHEMA)).collect()
        closed = [r for r in batch if r["w"]["end"] <= max(r[1] for r in rows) - dt.timedelta(hours=1)]
        got = tasks.drained(stream, "append")
        assert sorted(map(str, got.collect())) == sorted(map(str, closed)) and len(closed) > 20
        if name == "sliding":
            assert max(held) < len(batch) / 2 and held[-1] == len(batch) - len(closed)
