"""Compressors: what must stay stays, nothing grows, broken input is left alone."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxengine.functions.detect import CLI_TOOLS
from ctxengine.operators import cli, compress


def outputs(spark, texts, a=0.85):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["c"] for r in df.select("i", cli.compressed(F.col("t"), a=a).alias("c")).orderBy("i").collect()]


def test_command_output(spark):
    npm = "\n".join([f"npm http fetch GET 200 https://r/{i}" for i in range(30)] + ["added 52 packages, and audited 53 packages in 4s", "found 0 vulnerabilities"])
    docker = "\n".join(x for i in range(9) for x in (f"Step {i}/9 : RUN x{i}", " ---> Running in abc123")) + "\nERROR: no such file\nSuccessfully built 0123456789ab"
    cargo = "\n".join(f"   Compiling crate{i} v1" for i in range(30)) + "\n    Finished dev in 3s"
    go = "\n".join(f"=== RUN Test{i}" for i in range(20)) + "\n--- FAIL: Test3 (0.0s)\nFAIL\tpkg [build]\nok  \tother 0.1s"
    ts = "\n".join(f"src/a{i}.ts({i},1): error TS2304: Cannot find name 'x{i}'." for i in range(30)) + "\nFound 30 errors."
    out = outputs(spark, [npm, docker, cargo, go, ts, "plain text only"])
    assert [r["strategy"] for r in out] == ["rtk:npm", "rtk:docker", "rtk:cargo", "rtk:go", "rtk:tsc", "rtk:none"]
    assert [r["compressed"] for r in out] == [True] * 5 + [False]
    assert out[0]["content"].splitlines() == ["added 52 packages, and audited 53 packages in 4s", "found 0 vulnerabilities"]
    assert "docker: 9 steps" in out[1]["content"] and "no such file" in out[1]["content"] and "0123456789ab" in out[1]["content"]
    assert out[2]["content"] == "Finished dev in 3s\ncargo: 30 crates"
    assert "--- FAIL: Test3 (0.0s)" in out[3]["content"] and "=== RUN" not in out[3]["content"]
    assert out[4]["content"].splitlines()[0].endswith("'x0'.") and "=== TS ERRORS (30) ===" in out[4]["content"]
    assert out[5]["content"] == "plain text only"
    assert set(cli.tables(0.5)) == {n for n, _ in CLI_TOOLS}


def test_json_keeps_errors_and_totals():
    rows = [{"id": i, "host": "h1", "cpu": 5.0 if i != 40 else 900.0, "status": "error" if i == 17 else "ok"} for i in range(80)]
    out = json.loads(compress.smart_rows(json.dumps(rows), 0.85, ""))
    ids = [r["id"] for r in out["_items"]]
    assert out["_total"] == 80 and out["_constants"] == {"host": "h1"} and {0, 17, 40, 79} <= set(ids)
    text, name = compress.best(json.dumps({"users": rows, "total_count": 80}), "json", 0.85, "")
    assert name in ("smart_rows", "json") and "error" in text and "total" in text
    assert compress.toon(json.dumps(rows[:3]), 0.5, "").startswith("# TOON 3 rows\nid\thost\tcpu\tstatus\n0\th1\t5.0\tok")


def test_log_and_diff():
    rows = [f"2024-01-01 10:00:{i % 60:02d} INFO heartbeat {i}" for i in range(200)]
    rows[77] = "2024-01-01 10:01:00 ERROR PaymentError: pi_9x declined"
    out = compress.log("\n".join(rows), 0.85, "")
    assert "PaymentError: pi_9x" in out and len(out) < 200
    quiet = compress.log("\n".join(rows[:70]), 0.85, "")
    assert "[×70]" in quiet
    d = "diff --git a/x b/x\n--- a/x\n+++ b/x\n" + "\n".join(f"@@ -{i},9 +{i},9 @@\n" + "\n".join(f" c{j}" for j in range(8)) + f"\n+new{i}" for i in range(1, 30))
    out = compress.diff(d, 0.85, "")
    assert "+new1" in out and "more hunks omitted" in out and len(out) < len(d) / 2
    assert compress.diff("@@ -1 +1 @@\n+x", 0.85, "") is None


def test_code_keeps_what_the_query_names():
    src = "import os\n\n" + "\n".join(f"def name{i}(x):\n" + "    y = x + 1\n" * 9 + f"    return y * {i}\n" for i in range(12))
    out = compress.code(src, 0.85, "fix name7")
    assert "import os" in out and "def name3(x):" in out and "return y * 7" in out and "return y * 3" not in out


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300), st.sampled_from(["json", "log", "terminal", "diff", "code", "text"]), st.floats(0, 1))
def test_nothing_grows(text, kind, a):
    out, name = compress.best(text, kind, a, "")
    assert len(out) <= len(text) and (name != "none" or out == text)


@settings(max_examples=80, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=9), lambda c: st.lists(c, max_size=9) | st.dictionaries(st.text(max_size=5), c, max_size=5), max_leaves=40))
def test_json_of_any_shape(value):
    text = json.dumps(value)
    for name, (kinds, f) in compress.COMPRESSORS.items():
        if "json" in kinds:
            out = f(text, 0.85, "")
            assert out is None or isinstance(out, str)


def test_registry_and_dispatch(spark):
    compress.register("test_only", "odd")(lambda text, a, query: text[:3])
    df = spark.createDataFrame([("abcdef" * 20, "odd"), ("x", "text"), (None, "log")], "t string, k string")
    out = [tuple(r["c"]) for r in df.select(compress.compressed(F.col("t"), F.col("k")).alias("c")).collect()]
    del compress.COMPRESSORS["test_only"]
    assert ("abc", "test_only") in out and ("x", "none") in out and (None, "none") in out


def test_tools(spark):
    tool = {"name": "find", "description": "Finds things. " + "More words. " * 20, "inputSchema": {"title": "t", "type": "object", "required": ["b"], "properties": {"query": {"type": "string", "description": "what"}, "b": {"type": "string", "description": "needed", "examples": [1]}}}}
    df = spark.createDataFrame([(1, i, "find", "d", json.dumps(tool)) for i in range(3)], "catalog_id int, pos int, name string, description string, schema_json string")
    row = compress.compact_tools(df).first()
    small = json.loads(row["compact_json"])
    assert small["description"] == "Finds things." and "title" not in small["inputSchema"] and small["inputSchema"]["properties"] == {"query": {"type": "string"}, "b": {"type": "string", "description": "needed"}}
    assert row["line"] == "find(b, query): Finds things."
    out = compress.lazy_catalog(df).first()
    assert out["catalog"].count("\n") == 2 and out["catalog_chars"] < out["full_chars"]
    assert compress.tool_line(tool, "max") == "find" and compress.tool_line(tool, "high") == "find(b, query)"
