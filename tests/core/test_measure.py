"""Slices of code, logs, segments, routes, caches and analysis against stated results."""

from pyspark.sql import functions as F

from ctxengine.functions import tokens
from ctxengine.operators import catalog, compress, measure, slicing, tools

STORE = """import os
import re
import json
import hmac

class Users:
    def __init__(self, db):
        self.db = db

    def delete_user(self, user_id: int) -> bool:
        row = self.db.find(user_id)
        return self.db.remove(row)

    def list_users(self, page: int) -> list:
        return self.db.page(page)

def helper(x):
    return hmac.new(x)

LIMIT = 5
""" + "\n".join(f"def unrelated{i}(a):\n    return a * {i}\n" for i in range(9))


def test_slice_keeps_what_is_asked():
    out = slicing.sliced(STORE, "fix test_delete_user")
    assert "def delete_user(self, user_id):" in out and "self.db.remove(row)" in out
    assert "class Users:" in out and "# - list_users" in out and "self.db.page" not in out
    assert "import" not in out and "LIMIT" not in out and "return a * 3" not in out and len(out) < len(STORE) * 0.7
    assert slicing.sliced(STORE, "nothing zzz here") is None and slicing.sliced("x = 1", "x") is None
    assert slicing.sliced(STORE, "") is None and slicing.sliced("", "delete") is None


def test_slice_synonyms_and_faults():
    code = "class Hook:\n    def verify(self, body):\n        return compare_digest(self.sig, body)\n\n    def send(self, body):\n        return post(body)\n\n    def log(self, body):\n        print(body)\n" + "# filler\n" * 30
    out = slicing.sliced(code, "webhook signature is invalid")
    assert out is None or "compare_digest" in out
    out = slicing.sliced(code, "the signature of verify fails")
    assert "compare_digest" in out and "post(body)" not in out
    assert slicing.query_terms("fix src/user_store.py deleteUser") >= {"user_store", "user", "store", "delete"}


def test_parts_cover_all_rows():
    rows = [r for r in STORE.splitlines() if r.strip()]
    assert [r for p in slicing.parts(rows) for r in p.rows] == rows


def test_log_templates_and_test_runs():
    rows = [f"GET /srv/a{i} took {i} ms" for i in range(40)] + ["tests/test_a.py::test_x PASSED"] * 12 + ["E       assert 1 == 2", "==== 1 failed, 12 passed in 0.3s ===="]
    out = compress.log("\n".join(rows), 0.3, "")
    assert "[×40] GET /srv/a0 took 0 ms" in out or "assert 1 == 2" in out
    assert "1 failed, 12 passed in 0.3s" in out and "PASSED" not in out
    assert "[×30] GET /srv/b0 took 0 ms" in compress.log("\n".join(f"GET /srv/b{i} took {i} ms" for i in range(30)), 0.85, "")


def test_vitest(spark):
    text = "RUN  v1.2.0\n" + "\n".join(f" ✓ src/a{i}.spec.tsx" for i in range(9)) + "\nFAIL  src/b.spec.tsx\nAssertionError: no\n Test Files  1 broken (10)\n      Tests  9 passed"
    row = spark.createDataFrame([(text,)], "t string").select(tools.compressed(F.col("t")).alias("c")).first()["c"]
    assert row["strategy"] in ("vitest", "pytest") and (row["strategy"] != "vitest" or "PASS: 9 omitted" in row["content"])
    assert "AssertionError: no" in tools.vitest(text, 0.85, "") and "PASS: 9 omitted" in tools.vitest(text, 0.85, "")


def test_routed(spark):
    log = "\n".join(f"2024-01-01 10:00:00 INFO beat {i}" for i in range(60))
    df = spark.createDataFrame([(1, "def f():\n    pass\n" + log), (2, ""), (3, "plain")], "k int, t string")
    out = {r["k"]: r for r in compress.routed(df, ["k"], "t").collect()}
    assert out[1]["content"].startswith("def f():\n    pass" + compress.SEPARATOR) and "[×60]" in out[1]["content"] and out[1]["strategies"] == "none,log"
    assert out[3]["content"] == "plain" and out[3]["strategies"] == "none"


def test_route(spark):
    tools_ = spark.createDataFrame([("a", 1, "read_file", "reads a file"), ("a", 2, "delete_all", "removes all"), ("b", 1, "x", "d"), ("b", 2, "x", "d")], "catalog_id string, pos int, name string, description string").withColumn("schema_json", F.col("description"))
    intents = spark.createDataFrame([(1, "a", "read the file"), (2, "b", "x"), (3, "c", "x"), (4, "a", "what removes them"), (5, "a", "read the file")], "intent_id int, catalog_id string, intent string")
    out = {r["intent_id"]: r for r in catalog.route(intents, tools_, k=1).collect()}
    assert [out[i]["source"] for i in range(1, 6)] == ["bm25", "blocked", "skipped", "bm25", "bm25"]
    assert out[1]["tool_name"] == "read_file" and out[4]["risk"] == "destructive" and not any(r["allow_execute"] for r in out.values())
    assert out[1]["full_tokens"] == int((12 + 11 + 4) / 3.3) and out[1]["saved"] == out[1]["full_tokens"] - int((12 + 2) / 3.3)
    assert out[1]["route_key"] == out[5]["route_key"] != out[4]["route_key"]


def test_schema_of_and_cache(spark):
    rows = spark.createDataFrame([("s", 2, "n", "second", 5), ("s", 1, "n", "first", 5), ("old", 1, "n", "gone", 1)], "session_id string, pos int, name string, schema_json string, stored_at int")
    asked = spark.createDataFrame([("s", "n"), ("s", "m"), ("old", "n")], "session_id string, name string")
    assert sorted((r["session_id"], r["name"], r["schema_json"]) for r in catalog.schema_of(rows, asked, sessions=1).collect()) == [("old", "n", None), ("s", "m", None), ("s", "n", "first")]
    entries = spark.createDataFrame([("a", 100, "1", ["/x/f"]), ("b", 100, "2", ["/y"]), ("c", 100, "3", ["/z"]), ("d", 1, "4", []), ("a", 50, "0", ["/q"])], "key string, created_at long, value string, dependencies array<string>")
    changes = spark.createDataFrame([("/x/f", 100), ("/y/g", 120), ("/z", 99), ("/q", 120)], "path string, at long")
    assert [(r["key"], r["value"]) for r in catalog.cached(entries, changes, F.lit(120), ttl=60).collect()] == [("c", "3")]
    assert not catalog.cached(entries, changes, F.lit(120), ttl=60, most=2).where("key = 'b' or key = 'a'").count()


def test_quality_stats_failures(spark):
    df = spark.createDataFrame([(1, "Error 17 at\tstart"), (2, None)], "k int, text string")
    score = catalog.quality(F.col("text"), F.array(F.lit("ERROR")), F.array(F.lit("at start"), F.lit("absent")), (r"\d+", "^x"))
    assert df.select(score.alias("s")).first()["s"] == 3 / 5
    out = {r["k"]: r for r in measure.stats(df).collect()}
    assert out[1]["tokens"] == 5 and out[1]["chars"] == 17 and out[2]["tokens"] == 0
    ratios = spark.createDataFrame([("total", "", 0.5), ("category", "c", 0.25)], "level string, key string, ratio double")
    limits = spark.createDataFrame([("total", "", 0.6), ("category", "c", 0.25), ("fixture", "f", 0.9)], "level string, key string, floor double")
    assert [r["message"] for r in measure.failures(ratios, limits).collect()] == ["TOTAL ratio 50.0% below baseline 60.0%"]
    assert tokens.counter() is tokens.estimate


def test_analysis(spark):
    a = "a text of some length that is repeated in full below, twice"
    rows = spark.createDataFrame([(1, 0, "x", a, "critical", 10), (1, 1, "y", a, "medium", 10), (1, 2, "z", "more: " + a, "low", 3000), (2, 0, "q", "short", "medium", 1)], "session_id int, pos long, id string, content string, tier string, token_count int")
    out = {r["session_id"]: r for r in measure.analysis(rows).collect()}
    assert out[1]["duplicates"] == 3 and out[1]["redundant"] == 30 and out[1]["critical"] == 10
    assert out[1]["recommendations"] == "Remove 3 duplicate item(s) (~30 tokens)\nCompress 1 large item(s): z\nConsider dropping 1 low-relevance items (~3000 tokens)"
    assert out[2]["recommendations"] == "" and out[2]["duplicates"] == 0
