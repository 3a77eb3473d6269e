import json
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from noetica.operators import tasks
from noetica.streaming import streams

ROWS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("event_type", T.StringType())])
START = datetime(2024, 1, 1)


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps({"user_id": u, "event_id": i, "ts": (START + timedelta(minutes=m)).isoformat(), "event_type": k}) for u, i, m, k in rows))


def run(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_sessions_match_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    minutes = [0, 60, 180, 301, 302, 900]  # a gap of 120 stays, one of 121 opens
    rows = [(u, 10 * u + i, m, "click") for u in (1, 2) for i, m in enumerate(minutes)]
    write(folder, "a.json", rows)
    stream = streams.watch(spark, str(folder), ROWS)
    got = {(r.user_id, r.started, r.n) for r in run(streams.sessions(stream, "user_id", "ts"), "complete", tmp_path, "sessions").collect() if r.n > 1}
    batch = tasks.windows(spark.read.schema(ROWS).json(str(folder)), "user_id", "ts")
    assert got == {(r.user_id, r.started, r.n) for r in batch.collect()} and len(got) == 4


def test_loads_match_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, "a.json", [(1, i, 7 * i, f"k{i % 5}") for i in range(30)])
    stream = streams.watch(spark, str(folder), ROWS)
    got = sorted(run(streams.loads(stream, "ts", "event_type"), "complete", tmp_path, "loads").collect())
    assert got == sorted(tasks.load_gates(spark.read.schema(ROWS).json(str(folder)), "ts", "event_type").collect())


def test_ingest_adds_nothing_twice(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    for name in ("a.json", "b.json"):
        write(folder, name, [(1, 1, 0, "x"), (1, 2, 5, "y")])
        stream = streams.watch(spark, str(folder), ROWS).withColumn("uuid", F.sha2(F.col("event_id").cast("string"), 256))
        streams.ingest(stream, table, str(tmp_path / "checkpoint")).awaitTermination(120)
        assert spark.read.parquet(table).count() == 2


def test_recurrence(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    day = 24 * 60
    write(folder, "a.json", [(1, 1, 0, "note"), (1, 2, 3 * day, "mail"), (1, 3, 15 * day, "chat"), (2, 4, 0, "note"), (2, 5, 20 * day, "mail")])
    stream = streams.watch(spark, str(folder), ROWS).select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("source"), "ts")
    rows = run(streams.recurrence(stream), "update", tmp_path, "recurrence").collect()
    assert [(r.key, r.n_sources, r.days) for r in rows] == [("1", 3, 15)]


def test_late_rows_are_counted(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    late = streams.LateRows()
    spark.streams.addListener(late)
    df = streams.idle(streams.watch(spark, str(folder), ROWS), "user_id", "ts")
    for name, rows in (("a", [(1, i, i, "x") for i in range(4)]), ("b", [(1, 9, 3000, "x")]), ("c", [(1, 10, 1, "x"), (2, 11, 2, "x"), (1, 12, 3001, "x")])):
        write(folder, f"{name}.json", rows)
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    end = time.monotonic() + 30
    while sum(late.counts.values()) < 2 and time.monotonic() < end:
        time.sleep(0.2)
    spark.streams.removeListener(late)
    assert sum(late.counts.values()) == 2
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.user_id, r.started, r.n) for r in got] == [(1, START, 4)]


def test_gates(spark):
    minutes = [0, 10, 25, 40, 300, 301, 1000, 1001, 1002]
    rows = spark.createDataFrame([(1, i, START + timedelta(minutes=m), "a" if m < 300 else f"k{i}") for i, m in enumerate(minutes)], ROWS)
    got = tasks.idle_gates(rows, "user_id", "ts", F.lit(START + timedelta(minutes=1002 + 120)))
    assert [(r.n, r.ended) for r in got.collect()] == [(4, START + timedelta(minutes=40))]  # the last burst is not idle for over two hours yet
    singles = tasks.load_gates(rows, "ts", "event_type").where("single").collect()
    assert {r.started for r in singles} == {START - timedelta(minutes=10), START} and {r.n for r in singles} == {4}


def test_states_by_language_and_edges(spark):
    texts = [("a", "We decided on it."), ("a", "pros and cons"), ("b", "It is MERGED now"), ("c", None)]
    got = {r.thread_id: r for r in tasks.told(spark.createDataFrame(texts, "thread_id string, text string")).collect()}
    assert (got["a"].n_decided, got["a"].n_compared, got["b"].n_done, got["c"].n_done) == (1, 1, 1, 0)
    edges = spark.createDataFrame([("a", "WEIGHS", START), ("a", "DID", START), ("b", "OTHER", START)], "thread_id string, name string, valid_at timestamp")
    rows = tasks.states(tasks.linked(edges, {"WEIGHS": "n_compared", "DID": "n_acted"}), F.lit(START + timedelta(days=1)))
    assert {r.thread_id: r.state for r in rows.collect()} == {"a": "acting", "b": "exploring"}


def test_windows_over_days_against_a_plain_loop(spark):
    """Windows that cross midnights, days without rows, equal times, null keys and times."""
    import random

    rng, rows = random.Random(4), []
    for user in (1, 2, None):
        at = START
        for i in range(120):
            at += timedelta(minutes=rng.choice([0, 1, 30, 119, 120, 121, 600, 3000]))
            rows.append((user, 1000 * (user or 9) + i, at, "x"))
    rows += [(1, 1, None, "x"), (1, 2, None, "x"), (3, 3, None, "x")]
    want = []
    for user in (1, 2, None, 3):
        own = sorted(((r[2], r[1]) for r in rows if r[0] == user), key=lambda r: (r[0] is not None, r[0] or START, r[1]))
        groups = []
        for at, _ in own:
            if not groups or at is None or groups[-1][-1] is None or at - groups[-1][-1] > timedelta(hours=2):
                groups.append([])
            groups[-1].append(at)
        want += [(user, k, len(g), min(g), max(g)) for k, g in enumerate(groups, 1) if len(g) > 1]
    got = tasks.windows(spark.createDataFrame(rows, ROWS).repartition(5), "user_id", "ts")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 30
