"""Packing: ids against the tokenizer itself, the plan against best-fit of single pieces."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ctxengine.llm import packing
from tests.llm.common import docs, odd, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r'<|>sab1.,\xa0\x85\x1c　 "), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=5))
def test_encoder_equals_tokenizer(encoder, texts):
    t = Tokenizer.from_file(PATH)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_special_strings_have_their_ids(encoder):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext|", "plain"]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    assert got == [Tokenizer.from_file(PATH).encode(x, add_special_tokens=False).ids for x in texts]
    assert got[0] == [64, 220, 50256, 275]


def single(lengths, capacity):
    """Bins of single pieces' best-fit, as what each holds."""
    full, bins, held = capacity.full(), [], defaultdict(list)
    weights = np.array(capacity.weights) / full.astype(float) ** 2
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n])
        fits = [i for i, b in enumerate(bins) if (b >= need).all()]
        if not fits:
            bins.append(full.copy())
            fits = [len(bins) - 1]
        if capacity.score == "norm":
            best = min(fits, key=lambda i: ((bins[i] - need).astype(float) ** 2 @ weights, i))
        else:
            best = min(fits, key=lambda i: (-(bins[i].astype(float) * need @ weights), i))
        bins[best] = bins[best] - need
        held[best].append(n)
    return sorted(sorted(h) for h in held.values())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=120), st.sampled_from([None, 2, 8]), st.sampled_from([None, 512]), st.sampled_from(["norm", "dot"]))
def test_plan(lengths, most, attention, score):
    if attention:
        lengths = [min(n, 22) for n in lengths]
    # Whole numbers as weights over powers of two as capacities: equal scores are equal floats.
    capacity = packing.Capacity(32, most, attention, (1.0, 4.0, 2.0), score)
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, end, bin0, each, at in packing.plan(counts, capacity):
        for k in range(first, end):
            bins[bin0 + (k - first) // each].append((at + (k - first) % each * length, length))
            ranks[length].append(k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 32 and len(own) <= (most or 32) and sum(n * n for _, n in own) <= (attention or 1024)
    assert sorted(sorted(n for _, n in own) for own in bins.values()) == single(lengths, capacity)


def test_report_round_trip(spark):
    out = packing.packed(docs(spark), PATH, packing.Capacity(256), keep_ids=True).collect()
    t = Tokenizer.from_file(PATH)
    want = sorted((str(r["doc_id"]), np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in rows(spark))
    by = defaultdict(list)
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4 <= 256
        by[r["doc_id"]].append(r)
    single_ = [(str(d), b"".join(p["ids"] for p in sorted(ps, key=lambda p: p["piece"]))) for d, ps in by.items() if d != 9006]
    assert sorted(single_) == [w for w in want if w[0] != "9006"]
    for d, ps in by.items():
        ps.sort(key=lambda p: p["piece"])
        if d != 9006:
            assert [p["start"] for p in ps] == np.cumsum([0, *[p["length"] for p in ps]])[:-1].tolist()
            assert all(p["length"] == 256 for p in ps[1:])
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in out)
    assert len(sequences) <= total / 256 * 1.1 + 2
    made = packing.sequences(packing.packed(docs(spark), PATH, packing.Capacity(256), keep_ids=True)).collect()
    assert sum(len(r["ids"]) for r in made) == 4 * total


def test_hot_length_is_cut_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(None if i % 3 else i, "word", "s", i) for i in range(400)], "doc_id long, text string, length string, part int").repartition(5)
    out = packing.report(df).toPandas()
    assert len(out) == 400 and out["length"].tolist() == [2] * 400
    # 512 documents or 1024 pieces of two tokens: the documents bind at 512 only.
    assert out["sequence_id"].nunique() == 1 and sorted(out["offset"]) == list(range(0, 800, 2))


def test_documents_bind(spark):
    df = spark.range(1300).selectExpr("id as doc_id", "'' as text")
    out = packing.report(df).toPandas()
    assert sorted(out.groupby("sequence_id").size()) == [276, 512, 512]


def test_empty(spark):
    assert not packing.report(odd(spark).limit(0)).count()
