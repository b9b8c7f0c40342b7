"""Shorteners of tool output, the router to them, and repeated blocks."""

from pyspark.sql import functions as F

from ctxengine.operators import compress, tools

STATUS = "On branch fix/login\nChanges not staged for commit:\n  modified:   src/login/form.py\n  modified:   NOTES.md\n\nUntracked files:\n  debug.log\n  tmp_out.txt\n"
RUN = """============== test session starts ==============
platform linux -- Python 3.12
collected 9 items

tests/test_cart.py::test_total FAILED                 [ 11%]

=================== FAILURES ===================
__________________ test_total __________________

    def test_total():
        cart = make_cart()
>       assert cart.total == 12
E       AssertionError: assert 11 == 12
E         - 12
E         + 11

tests/test_cart.py:8: AssertionError
============ short test summary info ============
FAILED tests/test_cart.py::test_total - AssertionError
========= 1 failed, 8 passed in 0.21s ==========
"""


def routed(spark, texts, a=0.85, query=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = df.select("i", tools.compressed(F.col("text"), a, None if query is None else F.lit(query)).alias("c")).orderBy("i").collect()
    return [(r["c"]["strategy"], r["c"]["compressed"], r["c"]["content"]) for r in out]


def test_router(spark):
    listing = "total 40\n" + "\n".join(f"-rw-r--r-- 1 a a 10 Jan 1 f{i}" for i in range(40))
    search = "\n".join(f"src/a{i % 3}.py:{i}: value of x" for i in range(60))
    texts = [STATUS, RUN, listing, search, "2024-01-02 10:00:00 ERROR 3 failed\n" * 3, "plain words", "", None, "Tests:  3 failed\nTest Suites: 1 failed\n"]
    got = routed(spark, texts)
    assert [k for k, _, _ in got] == ["git", "pytest", "ls", "grep", "none", "none", "none", "none", "none"]
    assert [c for _, c, _ in got] == [True] * 4 + [False] * 5 and [x for _, _, x in got][4:] == texts[4:]
    assert got[2][2].endswith("... 26 more entries") and len(got[2][2].splitlines()) == 16
    assert got[3][2].splitlines()[:4] == ["src/a0.py: 20 matches", "  0: value of x", "  3: value of x", "  ... 18 more"]


def test_status_of_a_task(spark):
    (_, good, text), = routed(spark, [STATUS], 0.5, "Fix the bug in src/login/form.py")
    assert good and text == "On branch fix/login\nM: src/login/form.py\nuntracked: 2"
    (_, _, text), = routed(spark, [STATUS], 0.5, "Look at lib/none.go")
    assert "modified: 2 files (none task-relevant)" in text and "debug" not in text
    long_ = "On branch main\nChanges not staged for commit:\n" + "".join(f"\tmodified:   src/package/module_{i}.py\n" for i in range(30)) + "\nUntracked files:\n" + "".join(f"\tbuild/cache_{i}.log\n" for i in range(30))
    (_, _, text), = routed(spark, [long_])
    assert len(text) < 0.25 * len(long_) and "modified: 30 files" in text and "untracked: 30" in text


def test_test_runs(spark):
    (_, good, text), = routed(spark, [RUN])
    assert good and "test_total" in text and "12≠11" in text and "tests/test_cart.py:8" in text and "AssertionError" in text
    assert "session starts" not in text and "make_cart" not in text and len(text) < 0.25 * len(RUN)
    many = "\n".join(["collected 3 items", *(f"tests/t.py::test_{c} FAILED" for c in "abcdefghi"), "9 failed, 1 passed in 1s"])
    (_, _, text), = routed(spark, [many])
    assert text.splitlines()[:2] == ["9 failed", "FAILED (9):"] and len(text.splitlines()) == 5


def test_repeated_blocks():
    block = "alpha line one\nbeta line two\ngamma line three"
    assert tools.folded(f"{block}\nother\n{block}\nend\nmore") == f"{block}\nother\n\n[... repeated block ×1 omitted ...]\n\nend\nmore"
    for same in ("", "a\nb\nc", "a\nb\nc\nd\ne\nf", block):
        assert tools.folded(same) == same
    text = "\n".join([block, *(f"unique {i}" for i in range(5))] * 1 + [block] * 3)
    assert len(tools.folded(text)) < len(text) and tools.folded(text).count("alpha") == 1
    assert compress.best(text, "search", 0.85, "")[1] == "blocks"
    assert compress.best("a\nb", "search", 0.85, "") == ("a\nb", "none")
