"""Patience alignment against brute force, and notices in texts."""

from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxengine.llm import licenses
from tests.llm.common import docs, odd


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=9))
def test_increasing_is_longest(values):
    own = [values[i] for i in licenses.increasing(values)]
    longest = max(k for k in range(len(values) + 1) if any(list(c) == sorted(set(c)) for c in combinations(values, k)))
    assert len(own) == longest and own == sorted(set(own))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.permutations("abcdefgh"))
def test_alignment_is_monotone_and_true(text, template):
    pairs = licenses.align(text, list(template))
    assert all(text[i] == template[j] for i, j in pairs)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))


@settings(max_examples=100, deadline=None)
@given(st.permutations("abcdefgh"), st.permutations("abcdefgh"))
def test_alignment_of_unique_words_is_longest(text, template):
    want = max(k for k in range(9) for c in combinations(range(8), k) if [template.index(text[i]) for i in c] == sorted(template.index(text[i]) for i in c))
    assert len(licenses.align(text, template)) >= 1 and len(licenses.align(text, template)) <= want


def test_notices(spark):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8)
    pad = "the of a to and in is it that was for on are with his they at be this have from or one had by "
    for name, t in licenses.TEMPLATES.items():
        found = scanner.scan(pad * 9 + t + " " + pad * 5)
        assert found and any(x[0] == name and x[1] == 1.0 for x in found), name
        w = t.split()
        if len(w) > 20:
            w[5], w[11] = "other", "words"
            assert any(x[0] == name and x[1] > 0.8 for x in scanner.scan(pad + " ".join(w) + " " + pad)), name
    twice = scanner.scan((licenses.TEMPLATES["MIT"] + " ") * 3 + pad + licenses.TEMPLATES["MIT"])
    assert sum(x[0] == "MIT" for x in twice) >= 2
    assert not scanner.scan(pad * 30) and not scanner.scan(None) and not scanner.scan("")


def test_scan_of_documents(spark):
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, 200)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs(spark, 200).collect()}
    for d, t in texts.items():
        for name in ("MIT", "Apache-2.0", "GPL-3.0"):
            if t and licenses.TEMPLATES[name] in t:
                assert name in {x["license"] for x in got[d]["found"]}
    assert sum(r["license"] is not None for r in got.values()) >= 3
    assert all(r["license"] is None for d, r in got.items() if d is None or d >= 9000)
    assert not licenses.scan(odd(spark).limit(0)).count()


LINES = {
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
}


def test_every_licence_line_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    want = {d: {name for name, line in LINES.items() if line in t.split("\n")} for d, t in texts.items()}
    want = {d: names for d, names in want.items() if names}
    got = {r["doc_id"]: {x["license"] for x in r["found"]} for r in licenses.scan(df.where(df.doc_id.isin(list(want)))).collect()}
    assert {name for names in want.values() for name in names} == set(LINES)
    assert all(names <= got[d] for d, names in want.items())


def test_reserved_rights_with_and_without_a_holder():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    for t in ("All rights reserved.", "Copyright. All rights reserved.", "Copyright (c) 2024 A Long Holder Name Inc. All rights reserved."):
        assert [x[0] for x in scanner.scan(t)] == ["All-rights-reserved"], t
    assert not scanner.scan("Copyright law grants all rights to authors")


def test_a_line_that_repeats_inside_other_words():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    for name, line in LINES.items():
        for n in (2, 3, 7):
            found = [x for x in scanner.scan("one two three. " + (line + " ") * n + "four five six") if x[0] == name]
            assert len(found) == n and all(x[1] == 1.0 for x in found), (name, n)
    assert len(scanner.scan("All rights reserved. " * 5000)) == 5000


def test_many_notices_and_full_texts():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    assert len(scanner.scan(LINES["MIT"] + "\n" + (LINES["MIT"] + "\n") * 99_999)) == 100_000
    assert len([x for x in scanner.scan((licenses.TEMPLATES["GPL-3.0-header"] + "\n") * 1500) if x[0] == "GPL-3.0-header"]) == 1500
    pad = "some other words of a document that has nothing to do with it "
    for name, text in licenses.TEMPLATES.items():
        assert scanner.scan(pad * 20 + text + " " + pad * 20)[0][0] == name, name
    # A licence's own holder and year, and a disclaimer of somebody else's name.
    own = "MIT License\n\nCopyright (c) 2021 Somebody\n\n" + licenses.TEMPLATES["MIT-full"].replace("THE AUTHORS OR COPYRIGHT HOLDERS", "SOMEBODY")
    assert scanner.scan(own)[0][0] in ("MIT-text", "MIT-full") and {x[0] for x in scanner.scan(own)} >= {"MIT-text", "MIT-full"}


def test_scan_with_clashing_columns(spark):
    df = odd(spark).withColumn("found", F.lit(1)).withColumn("license", F.lit("x")).withColumn("coverage", F.lit(2.0))
    assert [tuple(r) for r in licenses.scan(df).collect()] == [tuple(r) for r in licenses.scan(odd(spark)).collect()]
