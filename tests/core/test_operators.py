"""Operators on small inputs, with plain Python as the other side."""

import difflib
import itertools

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxengine.functions import detect, redact, relevance, tokens
from ctxengine.operators import catalog, dedup, ranking, rewrite, session, structured
from ctxengine.sources import items as src


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 9)), min_size=1, max_size=8), st.integers(0, 30))
def test_best_subset_is_optimal(items, budget):
    w, v = [a for a, _ in items], [float(b) for _, b in items]
    kept = ranking.best_subset(w, v, [False] * len(w), [False] * len(w), budget)
    best = max(sum(v[i] for i in c) for k in range(len(w) + 1) for c in itertools.combinations(range(len(w)), k) if sum(w[i] for i in c) <= budget)
    assert sum(w[i] for i in kept) <= budget and sum(v[i] for i in kept) == best


def test_pinned_items_stay():
    assert ranking.best_subset([100, 5], [1.0, 1.0], [True, False], [False, False], 10) == [0]
    assert ranking.best_subset([1, 1, 60_000], [1.0, 2.0, 3.0], [False] * 3, [False, True, False], 70_000) == [0, 2]


def test_reads_become_deltas():
    reads = rewrite.Reads()
    old = "\n".join(f"line {i} of the file" for i in range(40))
    new = old.replace("line 7 of", "line seven of")
    assert reads.take("a.py", old) == (old, "first")
    assert reads.take("a.py", old) == ("[unchanged: a.py]", "unchanged")
    assert reads.take("a.py", "line 3 of the file\nline 4 of the file")[1] == "subset"
    shown, how = reads.take("a.py", new)
    assert how == "delta" and shown.startswith("[DELTA a.py +1/-1]") and "line seven" in shown
    assert reads.take("a.py", "all new")[1] in ("whole", "delta") and reads.take("b.py", "x")[1] == "first"
    assert len(list(difflib.unified_diff(old.splitlines(), new.splitlines()))) > 3


def test_repeated_runs_are_folded():
    fold = rewrite.Folder()
    block = "\n".join(f"a long enough line number {i}" for i in range(5))
    assert fold.take(0, "start\n" + block, False) == "start\n" + block
    assert fold.take(3, "again\n" + block + "\nend", False) == "again\n[↑5L same as msg 0: 'a long enough line n']\nend"
    assert fold.take(4, block, True) == block


def one(spark, text, c):
    return spark.createDataFrame([(text,)], "text string").select(c(F.col("text")).alias("x")).first()["x"]


def test_detection(spark):
    cases = {
        "": "text", "Traceback (most recent call last)\n x": "log", "On branch main\nnothing": "tool_output", '{"a": [1]}': "json", "diff --git a/x b/x\n@@ -1 +1 @@": "diff",
        "[ERROR] 2024-01-01 10:00:00 x": "log", "total 12\ndrwx x": "terminal", "def f():\n    return 1": "code", "plain words": "text", "a: 1\nb: 2\nc: 3\nd: 4": "config",
        "Step 1/3 : FROM x": "tool_output",
    }
    got = {r["text"]: r["t"] for r in spark.createDataFrame([(k,) for k in cases], "text string").select("text", detect.content_type(F.col("text")).alias("t")).collect()}
    assert got == cases
    assert one(spark, "x", lambda c: detect.content_type(c, F.lit("diff"))) == "diff"
    exact = {r["text"]: r["t"] for r in spark.createDataFrame([("[NaN]",), ("[1,]",), ('{"a":1} x',)], "text string").select("text", detect.json_valid()("text").alias("t")).collect()}
    assert exact == {"[NaN]": True, "[1,]": False, '{"a":1} x': False}


def test_tokens_and_redaction(spark):
    assert one(spark, "日本語 abc", tokens.estimate) == 4 and one(spark, "", tokens.estimate) == 0 and one(spark, "a", tokens.estimate) == 1
    assert one(spark, "token = abc mail a@b.co Bearer xyz sk-abcdefgh1", redact.redact) == "[REDACTED] mail [REDACTED] [REDACTED] [REDACTED]"
    assert len(one(spark, "w " * 900, redact.minimize)) == 500


def test_relevance(spark):
    df = spark.createDataFrame([("Fix login in src/auth/login.py when token expires", "src/auth/login.py", "x"), ("Fix login", "src/other.py", "nothing here")], "q string, p string, c string")
    terms, symbols = relevance.query_terms(F.col("q"))
    df = df.withColumn("t", terms).withColumn("s", symbols)
    out = df.select(relevance.path_matches(F.col("p"), F.col("q"), F.col("t"), F.col("s")).alias("m"), relevance.tier(F.col("c"), F.lit("code"), F.lit(5), F.col("p"), F.col("q"), F.col("t"), F.col("s")).alias("tier"), "t").collect()
    assert [r["m"] for r in out] == [True, False] and [r["tier"] for r in out] == ["high", "low"]
    assert "login" in out[0]["t"] and "fix" not in out[0]["t"]
    risks = spark.createDataFrame([("reset_form", None), ("list", None), ("drop_table", "read"), ("x", "odd")], "n string, e string").select(relevance.risk(F.col("n"), F.col("e")).alias("r")).collect()
    assert [r["r"] for r in risks] == ["destructive", "read", "read", "destructive"]


def test_sources(spark):
    payloads = spark.createDataFrame([("a", '[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]'), ("b", '{"name":"n","items":[{"id":"i","content":"c","content_type":"log"},{"content":"d"}]}'), ("c", '{"messages":[{"role":"user","content":"m"}]}'), ("d", "no json")], "session_id string, text string")
    got = {(r["session_id"], r["pos"]): (r["id"], r["content"], r["content_type"], r["source"]) for r in src.parse_sessions(payloads).collect()}
    assert got == {("a", 0): ("msg_0", "hi", "message", "user"), ("a", 1): ("msg_1", "yo", "message", "assistant"), ("b", 0): ("i", "c", "log", ""), ("b", 1): ("n_1", "d", "unknown", ""), ("c", 0): ("msg_0", "m", "message", "user")}
    tools = src.parse_tools(spark.createDataFrame([(1, '{"tools":[{"name":"a","description":"x"},{"name":"a"},{"name":""},{"name":"b"}]}')], "catalog_id int, text string"))
    assert tools.count() == 4
    assert [r["name"] for r in catalog.filter_catalog(tools).collect()] == ["b"]


def test_files(spark, tmp_path):
    (tmp_path / "p" / ".git").mkdir(parents=True)
    (tmp_path / "p" / "a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "p" / ".git" / "b.py").write_text("x")
    (tmp_path / "p" / "c.bin").write_text("x")
    got = src.read_project(spark, str(tmp_path / "p")).collect()
    assert len(got) == 1 and got[0]["content_type"] == "code" and got[0]["content"].startswith("def f")
    assert src.read_text(spark, str(tmp_path / "p" / "a.py")).first()["id"] == "input"


def test_containment_equals_all_pairs(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank today"
    texts = [base + " and more words follow here", base, base.upper(), "quick brown fox jumps over the lazy dog near the old", "x" * 60, "y" + "x" * 60 + "z", "different text of some length that is in nothing else here at all"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "s int, pos int, content string")
    n = [" ".join(t.lower().split()) for t in texts]
    want = {(a, b) for a in range(len(n)) for b in range(len(n)) if a != b and len(n[b]) >= 40 and n[b] in n[a] and (n[a] != n[b] or a < b)}
    assert {(r["outer"], r["inner"]) for r in dedup.contained(df, "s", "pos").collect()} == want and len(want) > 4


def test_session_passes(spark):
    rows = [(1, 0, "a.py", "code", "def f():\n" + "    x = 1\n" * 60, False, False), (1, 1, "a.py", "code", "[DELTA]", True, False), (1, 2, "user", "message", "hi", False, True)]
    df = spark.createDataFrame(rows, "session_id int, pos int, source string, content_type string, content string, read_delta boolean, on_task boolean").withColumn("token_count", tokens.estimate(F.col("content")))
    assert [r["is_stale"] for r in session.stale(df).orderBy("pos").collect()] == [True, False, False]
    assert [r["superseded"] for r in session.superseded(df).orderBy("pos").collect()] == [True, False, False]
    assert session.pointer(df).orderBy("pos").first()["pointer"].startswith("[CBM: a.py — 61L omitted. f")
    assert one(spark, " 12: x = 1\n13| y\nz", session.strip_gutters) == "x = 1\ny\nz"
    assert spark.range(1).select(session.signal_paths(F.array(F.lit("src/a.py"), F.lit("node_modules/x/y.js"), F.lit("yarn.lock"))).alias("p")).first()["p"] == ["src/a.py"]


def test_segments(spark):
    df = spark.createDataFrame([(1, "plain\ndef f():\n  x\n2024-01-01 ERROR y\nmore\n{\"a\": 1}")], "k int, t string")
    got = [(r["kind"], r["content"]) for r in structured.segments(df, ["k"], "t").orderBy("segment").collect()]
    assert got == [("code", "plain\ndef f():\n  x"), ("log", "2024-01-01 ERROR y\nmore"), ("json", '{"a": 1}')]


def test_policy(spark):
    df = spark.createDataFrame([(True, 0.6, "read"), (True, 0.6, "write"), (True, 0.9, "destructive"), (False, 0.9, "read")], "m boolean, c double, r string")
    assert [r[0] for r in df.select(catalog.allow_execute(F.col("m"), F.col("c"), F.col("r"))).collect()] == [True, False, False, False]
