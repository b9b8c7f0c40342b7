"""The Katz model against dictionaries, and its sums against one."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ctxengine.llm import katz
from tests.llm.common import docs, lower, odd, rows, words


class Plain:
    """The recursion, word by word."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order + 1)]
        self.followers = defaultdict(list)
        for t in texts:
            s = ["<s>", *words(lower(t)), ""]
            for i in range(1, len(s)):
                for k in range(1, order + 1):
                    if k == 1 or i - k + 1 >= 0:
                        self.counts[k][tuple(s[i - k + 1 : i + 1])] += 1
        for k in range(1, order + 1):
            for g in self.counts[k]:
                self.followers[g[:-1]].append(g[-1])
        self.d = [None]
        for k in range(1, order + 1):
            n = Counter(self.counts[k].values())
            self.d.append(katz.discounts([n[r] for r in range(1, katz.K + 2)]))
        self.memo = {}

    def weight(self, h):
        if h not in self.memo:
            k = len(h) + 1
            own = [self.counts[k][(*h, w)] for w in self.followers[h]]
            total = sum(own)
            kept = sum(self.d[k][min(c, katz.K + 1)] * c for c in own)
            below = math.fsum(self.p(w, h[1:]) for w in self.followers[h]) if h else 0.0
            scale = total / (total + 1) if kept >= total - 1e-9 else 1.0
            if 1 - below <= 1e-12 and kept:
                scale = total / kept
            left = (1 - kept * scale / total) / (1 - below) if 1 - below > 1e-12 else 0.0
            self.memo[h] = total, left, scale
        return self.memo[h]

    def p(self, w, h):
        if not self.followers.get(h):
            return self.p(w, h[1:]) if h else 1.0
        k = len(h) + 1
        total, left, scale = self.weight(h)
        c = self.counts[k][(*h, w)]
        if c:
            return self.d[k][min(c, katz.K + 1)] * c * scale / total
        return left * (self.p(w, h[1:]) if h else 1.0)

    def score(self, text, order):
        s = ["<s>", *words(lower(text)), ""]
        return sum(math.log10(self.p(s[i], tuple(s[max(0, i - order + 1) : i]))) for i in range(1, len(s)))


@pytest.mark.parametrize("order,block", [(1, 10**9), (2, 700), (3, 3000)])
def test_scores_equal_recursion(spark, monkeypatch, order, block):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    data = rows(spark, 40)
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 7 == 2 for r in data}
    train = [r["text"] for r in data if not held[r["doc_id"]]]
    model = Plain(train, order)
    got = katz.report(docs(spark, 40), order).collect()
    assert len(got) == len(data) and any(held.values())
    uni = Counter(w for t in train for w in [*words(lower(t)), ""])
    n, v = sum(uni.values()), len(uni)
    text = {r["doc_id"]: r["text"] for r in data}
    for r in got:
        s = [*words(lower(text[r["doc_id"]])), ""]
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(s) and r["train_tokens"] == n
        assert r["n_known"] == sum(w in uni for w in s)
        assert math.isclose(r["base_score"], sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in s), rel_tol=1e-9)
        assert math.isclose(r["score"], model.score(text[r["doc_id"]], order), rel_tol=1e-9), r
    if order > 1:
        for h in list(model.followers)[:200]:
            if len(h) == order - 1:
                whole = sum(model.p(w[0], h) for w in model.counts[1]) + model.p("never seen", h)
                assert math.isclose(whole, 1, rel_tol=1e-9)


def test_tables_hold_all_counts(spark):
    data = rows(spark, 30)
    from pyspark.sql import functions as F

    _, tables = katz.scored(docs(spark, 30).select("doc_id", "text", F.lit(False).alias("held_out")), 2)
    plain = Plain([r["text"] for r in data], 2)
    for k, t in enumerate(tables, 1):
        parts = [katz._unpack(bytes(r["message"])) for r in t.collect()]
        assert Counter(np.concatenate([p[2] for p in parts]).tolist()) == Counter(plain.counts[k].values())


def test_held_out_text_is_likelier_than_base(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = [r for r in katz.report(df).collect() if r["held_out"]]
    assert len(out) > 80 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_empty(spark):
    assert not katz.report(odd(spark).limit(0)).count()
    one = katz.report(odd(spark).where("doc_id = 9002")).collect()
    assert len(one) == 1 and one[0]["n_tokens"] == 1
