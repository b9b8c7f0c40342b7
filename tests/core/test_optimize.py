"""The session plan and the labelled sections on small sessions."""

from pyspark.sql import functions as F

from ctxengine.operators import ranking, semantic
from ctxengine.plans.optimize import Config, optimize_context

ITEM = "session_id string, pos int, id string, content string, content_type string, source string"
BODY = "\n".join(f"    line_{i} = compute({i})" for i in range(40))
FIRST = f"def total(x):\n{BODY}\n    return x"


def plan(spark, rows, **config):
    items, sessions = optimize_context(spark.createDataFrame(rows, ITEM), Config(**config))
    return {(r["session_id"], r["pos"]): r for r in items.collect()}, {r["session_id"]: r for r in sessions.collect()}


def test_passes_take_effect_in_order(spark):
    rows = [
        ("a", 0, "msg_0", "Fix total in src/sums.py", "message", "user"),
        ("a", 1, "read_1", FIRST, "code", "src/sums.py"),
        ("a", 2, "read_2", FIRST.replace("line_7 =", "line_seven ="), "code", "src/sums.py"),
        ("a", 3, "read_3", "\n".join(f"def other{i}(y):\n    pass" for i in range(40)), "code", "lib/far.py"),
        ("a", 4, "note", "deprecated: " + "an old remark that nobody needs " * 6, "message", "assistant"),
        ("a", 5, "log", "\n".join(f"2024-01-01 10:00:{i:02d} INFO beat {i}" for i in range(60)), "log", "app"),
        ("a", 6, "copy", "deprecated: " + "an old remark that nobody needs " * 6, "message", "assistant"),
        ("b", 0, None, None, None, None),
        ("c", 0, "input", "日本語", "text", ""),
    ]
    items, sessions = plan(spark, rows, budget=None, budget_share=None)
    how = {k: r["how"] for k, r in items.items()}
    assert how[("a", 1)] == "superseded" and how[("a", 2)] == "delta" and how[("a", 3)] == "pointer" and how[("a", 6)] == "duplicate"
    assert "line_seven" in items[("a", 2)]["content"] and items[("a", 4)]["content"].startswith("[obsolete note: ")
    assert items[("a", 5)]["token_count"] < items[("a", 5)]["original_tokens"] and items[("a", 0)]["content"] == "Fix total in src/sums.py"
    assert all(len(r["content"]) <= len(x[3] or "") for x in rows for r in [items[(x[0], x[1])]]) and len(items) == len(rows)
    assert sessions["a"]["optimized_tokens"] < sessions["a"]["original_tokens"] / 3 and "line_seven" in sessions["a"]["content"]
    assert sessions["b"]["content"] == "" and sessions["c"]["content"] == "日本語" and sessions["c"]["strategy"] == "plain"


def test_covered_searches_and_whole_versions(spark):
    rows = [
        ("a", 0, "s", "\n".join(["src/x.py:1:def total(x):"] * 9), "search", "grep"), ("a", 1, "r", FIRST, "code", "src/x.py"),
        ("b", 0, "r1", FIRST, "code", "src/x.py"), ("b", 1, "r2", "\n".join(f"new text {i}" for i in range(30)), "code", "src/x.py"),
        ("d", 0, "s", "src/x.py:1:nothing of the file", "search", "grep"), ("d", 1, "r", FIRST, "code", "src/x.py"),
    ]
    items, _ = plan(spark, rows, budget_share=None, pointers=False, compress=False)
    assert items[("a", 0)]["content"] == "[grep: 9 matches in src/x.py — see earlier read]" and items[("d", 0)]["how"] == "item"
    assert (items[("b", 0)]["how"], items[("b", 1)]["how"]) in {("stale", "whole"), ("superseded", "delta")}


def test_budget_and_empty(spark):
    rows = [("a", i, f"msg_{i}", f"message {i} " + "word " * 80, "message", "user" if i % 2 else "assistant") for i in range(6)]
    items, sessions = plan(spark, rows, budget=300)
    assert sum(r["kept"] for r in items.values()) == 2 and sessions["a"]["kept"] == 2
    assert plan(spark, [], budget=300) == ({}, {})
    got = spark.createDataFrame([(5, 100), (5, 900), (20, 700), (9, 100), (2, 5000)], "n long, t long").select(ranking.hybrid_budget(1000, F.col("n"), F.col("t")).alias("b"))
    assert [r["b"] for r in got.collect()] == [None, 950, 950, 72, 950]


def test_sections(spark):
    cols = "session_id int, pos int, id string, source string, content_type string, content string, tier string"
    rows = [
        (1, 0, "msg_0", "user", "message", "Fix a.py", "medium"), (1, 1, "msg_1", "system", "message", "You are a software engineer.", "critical"),
        (1, 2, "f", "a.py", "code", "def f(): pass", "medium"), (1, 3, "g", "git", "tool_output", "On branch main\n\tmodified: b.py\n", "medium"),
        (1, 4, "h", "git", "tool_output", "On branch main\n\tmodified: a.py\n", "medium"), (1, 5, "e", "run", "terminal", "AssertionError: 1", "critical"),
        (1, 6, "d", "x", "text", "[dropped:d|9tok|knapsack]", "low"), (1, 7, "s", "a.py", "text", "[subset read: a.py, 1/9L — see earlier read]", "medium"),
        (1, 8, "z", "y", "text", "all is well", "medium"), (2, 0, "n", None, "text", None, None),
    ]
    got = {r["session_id"]: r["semantic"] for r in semantic.sections(spark.createDataFrame(rows, cols)).collect()}
    assert got[1] == "T: Fix a.py\nE: AssertionError: 1\nC: def f(): pass\nGIT: main | mod b.py\nSTATE: all is well\nO:knapsack3" and got[2] == ""
    long = semantic.sections(spark.createDataFrame(rows, cols), long_labels=True).where("session_id = 1").first()["semantic"]
    assert long.startswith("TASK: Fix a.py\nCONSTRAINTS: You are") and "mod a.py" in long
