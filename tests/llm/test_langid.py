"""Language ID: the text model against brute force, fused evidence, held-out accuracy."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ctxengine.llm import langid
from tests.llm.common import SCHEMA, SF, docs, odd


def plain_grams(text):
    s = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    s = [0, *[ord(c) if c != " " else 0 for c in " ".join(s.split())], 0]
    if len(s) < 3:
        return []
    return [((a * 961 + b * 31 + c) * 2654435761 % 2**32) >> 16 for a, b, c in zip(s, s[1:], s[2:])]


def test_grams():
    for text in (None, "", "  ", "123 !?", "Hello, World", "éà Ünï-code 12x", "a", "日本 語"):
        assert langid.grams(text).tolist() == plain_grams(text), text


def test_held_out_accuracy(spark):
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.from_documents(all_docs)
    test = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0
    languages, model = langid.train(rows.where(~test).select("id", "text", F.col("declared").alias("language")))
    assert languages == ["de", "en", "es", "fr"] and np.isfinite(model).all()
    blind = rows.where(test).withColumn("truth", F.col("declared")).withColumn("declared", F.lit(None).cast("string"))
    out = langid.identify(blind, languages, model, ("truth",)).collect()
    assert len(out) > 150
    assert np.mean([r["language"] == r["truth"] for r in out]) > 0.97
    assert sum(r["rejected"] for r in out) <= 2
    assert all(0 <= r["posterior"] <= 1 + 1e-9 for r in out)


def test_evidence_decides_what_text_leaves_open(spark):
    languages, model = langid.train(langid.from_documents(docs(spark, 200)).select("id", "text", F.col("declared").alias("language")))
    clear = [(i, t, l, None, h) for i, (t, l, h) in enumerate((r["text"], r["lang"], f"www.{r['lang']}.net") for r in docs(spark, 120).where("doc_id < 120").collect())]
    rows = spark.createDataFrame(clear + [(900, "x", "fr", "fr", "new.net"), (901, "x", None, None, "www.de.net"), (902, "!!! 123", "en", None, "h"), (903, "xqzj " * 50, "en", None, "h"), (904, None, None, None, "h")], "id long, text string, declared string, suffix string, host string")
    got = {r["id"]: r for r in langid.identify(rows, languages, model).collect()}
    assert got[900]["language"] == "fr" and got[901]["language"] == "de"
    assert got[902]["rejected"] and got[903]["rejected"] and got[904]["rejected"]
    assert not any(got[i]["rejected"] for i, (_, t, *_) in enumerate(clear) if t and sum(c.isalpha() for c in t) > 0.5 * len(t))


def test_pages(spark):
    html = '<!DOCTYPE html><html class=x LANG="FR-ca"><head><script>var a="</p>";</script><style>p{}</style></head><!-- c --><body><p>Le texte &amp; la page</p></body></html>'
    pages = spark.createDataFrame([(1, "http://A.example.fr/x", html), (2, "https://h.net/de/3", "<p>x</p>"), (3, None, None), (4, "http://h.co.uk:80/", "")], "page_id long, url string, html string")
    got = {r["id"]: r for r in langid.from_pages(pages).collect()}
    assert got[1]["declared"] == "fr" and got[1]["suffix"] == "fr" and got[1]["host"] == "a.example.fr" and got[1]["text"].split() == ["Le", "texte", "la", "page"]
    assert got[2]["suffix"] == "de" and got[2]["declared"] is None and got[4]["suffix"] == "en" and got[3]["host"] == ""


def test_report_and_odd_rows(spark):
    out = langid.report(docs(spark), spark.read.parquet(f"{SF}/pages.parquet")).collect()
    n = Counter((r["doc_id"] is None, r["page_id"] is None) for r in out)
    assert n[False, True] == docs(spark).where("doc_id is not null").count() and n[True, False] == spark.read.parquet(f"{SF}/pages.parquet").count() and n[True, True] == 1
    none = langid.report(odd(spark).limit(0), spark.read.parquet(f"{SF}/pages.parquet").limit(3)).collect()
    assert len(none) == 3 and all(r["language"] is None and not r["rejected"] for r in none)


def test_accepted_keeps_columns(spark):
    df = docs(spark).withColumn("host", F.lit("h")).withColumn("id", F.lit(1)).withColumn("ratio", F.lit(1)).withColumn("mark", F.lit(2))
    out = langid.accepted(df)
    assert out.columns == df.columns
    kept = Counter(r["doc_id"] for r in out.collect())
    assert kept[9006] == 2 and kept[None] == 1 and not kept[9002] and sum(kept[i] for i in range(60)) >= 55


def test_rare_language_has_a_model_in_a_large_table(spark):
    rows = [(i, "the quick brown fox and the lazy dog", "en") for i in range(3000)] + [(5000 + i, "αλφα βητα γαμμα δελτα", "el") for i in range(3)]
    labelled = spark.createDataFrame(rows, "id long, text string, language string")
    languages, model = langid.train(labelled, 10)
    assert languages == ["el", "en"]
    assert all(model[k][langid.grams(t)].mean() > 0 for k, t in ((0, rows[-1][1]), (1, rows[0][1])))


def test_declared_language_without_a_model_is_kept(spark):
    text = "αλφα βητα γαμμα δελτα επσιλον"
    rows = [(i, "the quick brown fox and the lazy dog", "en", "s", 36) for i in range(5)] + [(9, text, "el", "s", 29), (10, "12 34", "el", "s", 5), (11, text, "en", "s", 29), (12, text, None, "s", 29)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    evidence = langid.from_documents(df)
    languages, model = langid.train(evidence.select("id", "text", F.col("declared").alias("language")).where("id < 5"))
    got = {r["id"]: r for r in langid.identify(evidence, languages, model).collect()}
    assert languages == ["en"] and got[9]["language"] == "el" and got[9]["posterior"] is None and not got[9]["rejected"]
    assert got[10]["rejected"] and got[11]["rejected"] and got[12]["rejected"]
    # A value that is no code of a language has no model; every code has one.
    odd_value = df.where("doc_id < 11").withColumn("lang", F.when(F.col("doc_id") == 9, F.lit("greek, modern")).otherwise(F.col("lang")))
    assert sorted(r["doc_id"] for r in langid.accepted(odd_value).collect()) == [0, 1, 2, 3, 4, 9]
    assert sorted(r["doc_id"] for r in langid.accepted(df.where("doc_id <> 11")).collect()) == [0, 1, 2, 3, 4, 9, 12]


def test_more_languages_than_any_bound(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    codes = [a + b for a in "abcdefghij" for b in "abcdefghij"]
    rows = [(i * 10 + j, "".join(letters[4 * i : 4 * i + 4][(j + k) % 4] for k in range(12)), lang, "s", 12) for i, lang in enumerate(codes) for j in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    evidence = langid.from_documents(df)
    languages, model = langid.train(evidence.select("id", "text", F.col("declared").alias("language")))
    assert languages == sorted(codes)
    assert all(r["language"] == r["declared"] and not r["rejected"] for r in langid.identify(evidence, languages, model).collect())


def test_letters_of_all_planes():
    assert not len(langid.grams("\U0001f600\U0001f601\U0001f602")) and len(langid.grams("\U00020000\U00020001\U00020002")) == 3


def plain_identify(rows, languages, model):
    """(id, language, posterior, rejected) by dictionaries and plain sums."""
    n = len(languages)

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    def value(x):
        return None if x is None else languages.index(x) if x in languages else n

    seen = []
    for r in rows:
        g = langid.grams(r["text"])
        ratio = model[:, g].sum(1, dtype=float)
        like = ratio * langid.SHARE * min(1, langid.MOST / max(1, len(g) * langid.SHARE))
        seen.append((r, len(g), ratio, like, softmax(like)))
    tables = []
    for field in ("declared", "suffix"):
        cells = np.full((n + 2, n), langid.CELL)
        for r, size, _, _, alone in seen:
            if size:
                cells[n + 1 if r[field] is None else value(r[field])] += alone
        logs = np.log(cells / cells.sum(0))
        logs[n + 1] = 0
        tables.append(logs)
    hosts, parents, top = {}, {}, np.ones(n)
    for r, size, _, _, alone in seen:
        if size:
            hosts[r["host"]] = hosts.get(r["host"], 0) + alone
            parent = r["host"].split(".", 1)[1] if "." in r["host"] else r["host"]
            parents[parent] = parents.get(parent, 0) + alone
            top = top + alone
    top = top / top.sum()
    out = []
    for r, size, ratio, like, _ in seen:
        parent = r["host"].split(".", 1)[1] if "." in r["host"] else r["host"]
        prior = top
        if r["host"] in hosts:
            for sums in (parents[parent], hosts[r["host"]]):
                prior = (sums + langid.PRIOR * prior) / (sums.sum() + langid.PRIOR)
        fused = softmax(like + np.log(prior) + sum(t[n + 1 if r[f] is None else value(r[f])] for t, f in zip(tables, ("declared", "suffix"))))
        poor = (size >= langid.LEAST_GRAMS and ratio.max() <= 0) or fused.max() < langid.LEAST_POSTERIOR
        unheard = poor and r["declared"] is not None and r["declared"] not in languages and size > 0
        out.append((r["id"], r["declared"] if unheard else languages[fused.argmax()], None if unheard else round(fused.max(), 9), (poor and not unheard) or not size))
    return out


def test_posterior_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    evidence = langid.from_documents(docs(spark)).unionByName(langid.from_pages(pages))
    languages, model = langid.train(langid.from_documents(docs(spark)).select("id", "text", F.col("declared").alias("language")))
    got = [(r["id"], r["language"], None if r["posterior"] is None else round(r["posterior"], 9), r["rejected"]) for r in langid.identify(evidence, languages, model).collect()]
    assert sorted(got, key=repr) == sorted(plain_identify([r.asDict() for r in evidence.collect()], languages, model), key=repr)
