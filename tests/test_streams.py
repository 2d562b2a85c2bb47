"""Streams that are stopped, repeated and fed out of order, against what one batch says."""

import datetime as dt

from tidegraph.streaming import jobs

DAY0 = dt.datetime(2024, 1, 1)


def drop(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def test_cursor_survives_a_restart(spark, tmp_path):
    path, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id long, host string, note string"
    big = 2**60
    for rows in ([(1, "a", "x"), (1, "a", "x"), (big + 1, "b", None)], [(1, "a", "again"), (2, "a", "y"), (big, "b", "old"), (5, None, "z"), (None, "a", "lost")], [(2, "a", "y"), (5, None, "z")]):
        drop(spark, path, rows, schema)
        jobs.append_log(jobs.since_cursor(jobs.drops(spark, path, schema), ["host"], "id"), target, mark).awaitTermination()
    assert sorted(map(repr, map(tuple, spark.read.parquet(target).select("id", "host", "note").collect()))) == sorted(map(repr, [(1, "a", "x"), (big + 1, "b", None), (2, "a", "y"), (5, None, "z")]))


def test_cursors_are_kept_in_groups_of_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "CURSOR_GROUPS", 8, raising=False)
    path, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id long, host string"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # repeats come in different batches of a group
    try:
        cursor, want = {}, set()
        for rows in ([(i, f"h{i % 300}") for i in range(600)] * 2, [(i, f"h{i % 330}") for i in range(300, 990)] + [(900, None), (900, None), (899, None)]):
            drop(spark, path, rows, schema)
            query = jobs.append_log(jobs.since_cursor(jobs.drops(spark, path, schema), ["host"], "id"), target, mark)
            query.awaitTermination()
            want |= {r for r in rows if r[0] > cursor.get(r[1], -1)}
            for i, host in rows:
                cursor[host] = max(cursor.get(host, -1), i)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = [(r.id, r.host) for r in spark.read.parquet(target).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert 0 < sum(s["numRowsTotal"] for s in query.recentProgress[-1]["stateOperators"]) <= 8


def test_posts_fall_due_once(spark, tmp_path):
    path, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id long, created_at timestamp, raw string, seen_at timestamp"
    day = lambda d: DAY0 + dt.timedelta(days=d)
    batches = [
        [(1, day(0), "old", day(1)), (1, day(0), "new", day(3)), (2, day(4), "a", day(4))],
        [(1, day(0), "late but in time", day(2)), (3, day(11), "b", day(11))],  # after this, day 1 is past
        [(1, day(0), "too late", day(12)), (2, day(4), "c", day(12)), (2, day(4), "c", day(12))],
        [(4, day(20), "d", day(20))],
    ]
    want, held, past = {}, {}, dt.datetime.min
    for rows in batches:
        drop(spark, path, rows, schema)
        jobs.due(jobs.drops(spark, path, schema), 10, target, mark).awaitTermination()
        for i, at, raw, seen in rows:
            if at > past:
                held[i, at] = max(held.get((i, at), (dt.datetime.min, "")), (seen, raw))
        past = max(past, max(r[1] for r in rows) - dt.timedelta(days=10))
        want |= {k: held.pop(k)[1] for k in [k for k in held if k[1] <= past]}
    got = spark.read.parquet(target).collect()
    assert len(got) == len(want) and {(r.id, r.created_at): r.raw for r in got} == want == {(1, day(0)): "new", (2, day(4)): "c"}


def test_counts_are_kept_over_restarts(spark, tmp_path):
    path, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "lang string, probability double"
    for rows in ([("en", 0.1), ("en", 0.9), (None, None)], [("en", 0.1), ("it", float("nan"))]):
        drop(spark, path, rows, schema)
        jobs.live_counts(jobs.drops(spark, path, schema), target, mark).awaitTermination()
    assert {(r.lang, r.bin): r.n for r in jobs.counted(spark, target).collect()} == {("en", 0): 2, ("en", 4): 1, ("??", -1): 1, ("it", -1): 1}


def test_log_is_folded(spark, tmp_path):
    path, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    args = (["id"], ["source"], ["raw"])
    for i in range(4):
        drop(spark, path, [(1, f"s{i}", f"r{i}", i), (i + 10, "x", "y", i)], "id long, source string, raw string, at long")
        jobs.collect(jobs.drops(spark, path, "id long, source string, raw string, at long"), target, mark, *args, ["at"]).awaitTermination()
        if i == 2:
            before = {tuple(r) for r in jobs.collected(spark, target, *args).collect()}
            assert jobs.fold(spark, target, *args, keep=2) and not jobs.fold(spark, target, *args, keep=2)
            assert {tuple(r) for r in jobs.collected(spark, target, *args).collect()} == before
    assert {tuple(r) for r in jobs.collected(spark, target, *args).collect()} == {(1, "s0", "r3"), (10, "x", "y"), (11, "x", "y"), (12, "x", "y"), (13, "x", "y")}
