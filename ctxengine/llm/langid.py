"""Language ID by Bayesian fusion of evidence.

Four kinds of evidence are multiplied: the text's likelihood under a model of letter trigrams
for each language, the language that its markup declares, the language that its address
suggests, and its host's prior. How far declarations and addresses are to be trusted is
counted on all rows, against what the texts alone say; a host's prior is the sum of what its
texts say, smoothed towards its parent domain's, and that towards all rows'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxengine.llm.shared import fresh, written
from ctxengine.llm.url_tree import host_and_path

#: Hash buckets of trigrams; weight of the uniform background in each model.
BUCKETS, BACKGROUND = 65536, 0.1
#: Labelled rows of each language that the text model is fitted on, about (those with the smallest
#: hashes); a language is a code of two or three letters, maybe with a script or region.
TRAIN_ROWS, CODE = 4000, "^[a-z]{2,3}([-_][a-z0-9]{2,8})*$"
#: Neighbouring trigrams tell much the same, so a text counts for this share of them, and no
#: text for more than MOST of them.
SHARE, MOST = 1 / 3, 200.0
#: Rows that a parent's prior counts for; that each cell of the evidence tables starts with.
PRIOR, CELL = 20.0, 1.0
#: Trigrams from which on a text is judged by itself, and the least posterior.
LEAST_GRAMS, LEAST_POSTERIOR = 5, 0.3
#: Languages that country suffixes suggest.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en"}

_letters: list[np.ndarray] = []


def grams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams of letters and gaps; gaps are one character, case is dropped."""
    if not _letters:
        _letters.append(np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32))
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    kinds = _letters[0][codes]
    gap = kinds == 0
    kinds = np.concatenate([[0], kinds[~(gap & np.concatenate([[True], gap[:-1]]))], [0]]).astype(np.uint32)
    if len(kinds) < 3 or not kinds.any():
        return np.zeros(0, np.uint32)
    mixed = (kinds[:-2] * np.uint32(961) + kinds[1:-1] * np.uint32(31) + kinds[2:]) * np.uint32(2654435761)
    return mixed >> np.uint32(16)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood ratios to the background by language and bucket).

    labelled: id, text, language; null languages are no labels. Fitted on about `rows` rows of
    each language, chosen by a hash of id and text, or all where it has no more, so a rare language
    has its model in a table of any size. Every value that has the form of a language's code and
    a text with letters is a language; their number, not the table's, bounds the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(grams(text), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["language", "counts"])

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(b, np.int64) for b in pdf["counts"])
        return pd.DataFrame({"language": pdf["language"][:1], "counts": [total.tobytes()], "n": [int(total.sum())]})

    labelled = labelled.where(F.col("language").rlike(CODE))
    sizes = labelled.where(F.col("text").rlike(r"\p{L}")).groupBy("language").count().orderBy("language").collect()
    if not sizes:
        return [], np.zeros((0, BUCKETS), np.float32)
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["language"], min(1 << 20, int(rows / r["count"] * (1 << 20)) + 1))])
    labelled = labelled.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < shares[F.col("language")])
    parts = labelled.select("language", "text").mapInArrow(count, "language string, counts binary")
    found = parts.groupBy("language").applyInPandas(add, "language string, counts binary, n long").collect()
    found = sorted((r for r in found if r["n"]), key=lambda r: r["language"])
    model = np.zeros((len(found), BUCKETS), np.float32)
    for k, r in enumerate(found):
        own = np.frombuffer(r["counts"], np.int64)
        model[k] = np.log((1 - BACKGROUND) * own / own.sum() * BUCKETS + BACKGROUND)
    return [r["language"] for r in found], model


def from_documents(docs: DataFrame) -> DataFrame:
    """Evidence of documents: the column lang declares, the source is the host."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.lower("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.coalesce("source", F.lit("")).alias("host"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Evidence of pages: text without markup, scripts and styles, the language of <html>, that
    of the country suffix or else of a first path segment of two letters, and the host."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>|&[A-Za-z0-9#]+;", " ")
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    host, path = host_and_path(F.col("url"))
    country = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[F.regexp_extract(host, r"([a-z]+)(?::[0-9]+)?$", 1)]
    segment = F.lower(F.regexp_extract(path, "^/([A-Za-z]{2})(?:/|$)", 1))
    return pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.coalesce(country, F.nullif(segment, F.lit(""))).alias("suffix"), host.alias("host"))


def _code(c: str, languages: list[str]) -> Column:
    """A language's number; one more for any other value, two more for none."""
    codes = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    return F.when(F.col(c).isNull(), F.lit(len(languages) + 1)).otherwise(F.coalesce(codes[F.col(c)], F.lit(len(languages))))


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(raised, lambda x: x / total)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(rows: DataFrame, languages: list[str], model: np.ndarray, keep: tuple[str, ...] = ()) -> DataFrame:
    """rows of from_documents() or from_pages() with language, posterior, text_language, n_grams
    and rejected; id, declared, suffix, host and the columns `keep` stay.

    A row is rejected if its text has no letters, or enough of them and every language's
    model is worse than the background, or if no language reaches LEAST_POSTERIOR. Where the
    declared language has no model, nothing of this but the lack of letters rejects: the row
    keeps its declared language, with null posterior. Null text is the empty text. Without any language nothing is known: language and posterior are null
    and nothing is rejected. All hosts' sums are grouped aggregates; host priors come back by
    a join of two tables, split where a host has most rows."""
    n = len(languages)
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("id", "declared", "suffix", "host", *keep, none.alias("language"), F.lit(None).cast("double").alias("posterior"), none.alias("text_language"), F.lit(0).alias("n_grams"), F.lit(False).alias("rejected"))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = rows.select("id", "declared", "suffix", "host", *keep).schema
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_grams int, ratio array<double>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(shared.value.T)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [grams(t.as_py()) for t in part.column(part.num_columns - 1)]
                ratio = [np.sum([table[g[s : s + 65536]].sum(0, dtype=np.float64) for s in range(0, len(g), 65536)] or [np.zeros(n)], axis=0).tolist() for g in own]
                columns = [*part.columns[:-1], pa.array([len(g) for g in own], pa.int32()), pa.array(ratio, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "n_grams", "ratio"])

    scored = written(rows.select("id", "declared", "suffix", "host", *keep, "text").mapInArrow(score, out_schema), "scored")
    weight = F.lit(SHARE) * F.least(F.lit(1.0), F.lit(MOST) / F.greatest(F.lit(1.0), F.col("n_grams") * F.lit(SHARE)))
    scored = scored.withColumn("__like", F.transform("ratio", lambda x: x * weight))
    scored = scored.withColumn("__alone", _softmax(F.col("__like"))).withColumn("__d", _code("declared", languages)).withColumn("__s", _code("suffix", languages))

    def table(code: str) -> Column:
        """log P(value | language), an array of values for each language; a row with no
        letters says nothing. All sums are in one row for each value."""
        sums = scored.where("n_grams > 0").groupBy(code).agg(*[F.sum(F.col("__alone")[k]).alias(f"l{k}") for k in range(n)]).collect()
        cells = np.full((n + 2, n), CELL)
        for r in sums:
            cells[r[code]] += [r[f"l{k}"] for k in range(n)]
        logs = np.log(cells / cells.sum(0))
        logs[n + 1] = 0  # nothing is said by saying nothing
        return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in logs])

    by_declared, by_suffix = table("__d"), table("__s")
    parent = F.regexp_replace("host", "^[^.]*\\.", "")
    sums = scored.where("n_grams > 0").groupBy("host").agg(*[F.sum(F.col("__alone")[k]).alias(f"l{k}") for k in range(n)])
    sums = written(sums.withColumn("parent", parent), "hosts")
    levels = sums.groupBy("parent").agg(*[F.sum(f"l{k}").alias(f"p{k}") for k in range(n)])
    whole = sums.agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(n)]).first()
    top = np.array([(whole[f"l{k}"] or 0) + 1.0 for k in range(n)])
    top = top / top.sum()

    def smoothed(own: list[Column], above: list[Column]) -> list[Column]:
        total = sum(own[1:], own[0])
        return [(own[k] + PRIOR * above[k]) / (total + PRIOR) for k in range(n)]

    levels = levels.select("parent", F.array(*smoothed([F.col(f"p{k}") for k in range(n)], [F.lit(float(x)) for x in top])).alias("above"))
    priors = sums.join(levels, "parent").select("host", F.array(*[F.log(x) for x in smoothed([F.col(f"l{k}") for k in range(n)], [F.col("above")[k] for k in range(n)])]).alias("__prior"))
    priors = written(priors, "priors")
    flat = F.array(*[F.lit(float(x)) for x in np.log(top)])
    out = scored.join(priors, "host", "left")
    out = out.withColumn("__all", _softmax(_plus(_plus(F.col("__like"), F.coalesce("__prior", flat)), _plus(by_declared[F.col("__d")], by_suffix[F.col("__s")]))))
    names = F.array(*[F.lit(x) for x in languages])
    best = F.array_max("__all")
    poor = ((F.col("n_grams") >= LEAST_GRAMS) & (F.array_max("ratio") <= 0)) | (best < LEAST_POSTERIOR)
    # No model can speak against a language that has none.
    unheard = poor & (F.col("__d") == n) & (F.col("n_grams") > 0)
    return out.select(
        "id", "declared", "suffix", "host", *keep,
        F.when(unheard, F.col("declared")).otherwise(names[(F.array_position("__all", best) - 1).cast("int")]).alias("language"),
        F.when(~unheard, best).alias("posterior"),
        F.when(F.col("n_grams") > 0, names[(F.array_position("__alone", F.array_max("__alone")) - 1).cast("int")]).alias("text_language"),
        "n_grams",
        ((poor & ~unheard) | (F.col("n_grams") == 0)).alias("rejected"),
    )


def report(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for every document (doc_id) and every page (page_id): language, posterior, rejected
    and the evidence. The text model is fitted on documents with a language."""
    evidence = from_documents(docs)
    languages, model = train(evidence.select("id", "text", F.col("declared").alias("language")))
    columns = ("language", "posterior", "text_language", "declared", "suffix", "host", "n_grams", "rejected")
    of_docs = identify(evidence, languages, model).select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), *columns)
    of_pages = identify(from_pages(pages), languages, model).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("page_id"), *columns)
    return of_docs.unionByName(of_pages)


def accepted(docs: DataFrame) -> DataFrame:
    """docs without those that are rejected; same columns, whatever their names.

    Rejected rows are known by doc_id and text; they are few, or else the join is split."""
    evidence = from_documents(docs)
    languages, model = train(evidence.select("id", "text", F.col("declared").alias("language")))
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    its, of = fresh(docs.columns, "__id", "__mark")
    out = identify(evidence.withColumn("mark", mark), languages, model, ("mark",)).where("rejected")
    out = written(out.select(F.col("id").alias(its), F.col("mark").alias(of)).distinct(), "rejected")
    return docs.join(out, F.col("doc_id").cast("long").eqNullSafe(F.col(its)) & (mark == F.col(of)), "left_anti")
