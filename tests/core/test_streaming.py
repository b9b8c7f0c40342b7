"""Streams against the same rows in one batch."""

from pyspark.sql import functions as F

from ctxengine.functions import tokens
from ctxengine.operators.rewrite import Reads
from ctxengine.streaming import turns

SCHEMA = "session_id long, pos int, source string, content string, event_time timestamp"


def stream(spark, tmp_path, batches):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)


def result(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def at(s):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_windows_equal_batch(spark, tmp_path):
    rows = [(i % 3, i, "user" if i % 2 else "assistant", "word " * (i % 7 + 1), at(i * 97)) for i in range(60)]
    got = result(turns.token_windows(stream(spark, tmp_path, [rows[:30], rows[30:]])), "windows", tmp_path, "complete")
    want = spark.createDataFrame(rows, SCHEMA).groupBy(F.window("event_time", "10 minutes"), "source").agg(F.sum(tokens.estimate(F.col("content"))).alias("tokens"), F.count(F.lit(1)).alias("turns")).collect()
    key = lambda r: (str(r["window"]), r["source"], r["tokens"], r["turns"])
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 10


def test_first_copies(spark, tmp_path):
    rows = [(1, 0, "u", "Same  text", at(0)), (1, 1, "u", "same text", at(5)), (2, 0, "u", "same text", at(9)), (1, 2, "u", "other", at(9))]
    got = result(turns.first_copies(stream(spark, tmp_path, [rows[:1], rows[1:]])), "copies", tmp_path)
    assert sorted((r["session_id"], r["pos"]) for r in got) == [(1, 0), (1, 2), (2, 0)]


def test_read_versions_keep_state_between_batches(spark, tmp_path):
    old = "\n".join(f"line {i} of a file" for i in range(30))
    new = old.replace("line 9 of", "line nine of")
    rows = [(1, 0, "a.py", old, at(0)), (2, 0, "a.py", new, at(0)), (1, 1, "a.py", old, at(1)), (1, 2, "a.py", new, at(2)), (1, 3, "b.py", "x", at(3))]
    got = result(turns.read_versions(stream(spark, tmp_path, [rows[:2], rows[2:4], rows[4:]]), ttl=None), "versions", tmp_path)
    plain = {1: Reads(), 2: Reads()}
    want = {(s, p): plain[s].take(path, text) for s, p, path, text, _ in sorted(rows, key=lambda r: r[1])}
    assert {(r["session_id"], r["pos"]): (r["content"], r["how"]) for r in got} == want
    assert [want[1, p][1] for p in range(4)] == ["first", "unchanged", "delta", "first"]
