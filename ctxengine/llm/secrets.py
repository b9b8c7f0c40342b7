"""Secret scans: an incremental ledger of content-addressed blobs.

Every historical version of a path is a blob, named by its SHA-256. Only pairs of blob and
rule version that the ledger does not hold are scanned; findings are joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxengine.llm.shared import fresh, written

#: Two characters that mark a match; in the text itself they stand as a third one of equal length.
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: a Java regular expression whose matches are leftmost and do
    not overlap; least: matches whose capture `group` is shorter are dropped afterwards."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in the order of their kinds. A run of the characters of
#: `access` or `hex` ends where they end, so a lower bound on its length drops the same runs.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: What the method adds.
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
SPAN = "array<struct<start:bigint,end:bigint>>"


def found(text: Column, rule: Rule) -> Column:
    """Spans of the rule's matches in code points, end exclusive; text holds no marks."""
    marked = F.regexp_replace(text, rule.pattern, f"{OPEN}$0{CLOSE}")
    parts = F.split(marked, f"[{OPEN}{CLOSE}]", -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("match"), F.array().cast(SPAN).alias("spans"))

    def step(acc, part):
        end = acc["at"] + F.length(part)
        keep = acc["match"]
        if rule.least:
            keep = keep & (F.length(F.regexp_extract(part, rule.pattern, rule.group)) >= rule.least)
        spans = F.when(keep, F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), (~acc["match"]).alias("match"), spans.alias("spans"))

    spans = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    return F.when(F.size(parts) > 1, spans).otherwise(F.array().cast(SPAN))


def scan(versions: DataFrame, rules=BASE + ADDED, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): paths has path and blob for every row of versions; the new ledger
    (blob, rule, spans) holds the pairs of the old one and those scanned now, with or without
    a match. findings() joins the two.

    versions: path (any type), text; several rows may share a path. Null text is the empty
    text. Repeated rows give repeated findings. An empty table gives empty ones.
    A blob that a third of all rows share is scanned once: rows are cut to one for each blob
    by a partial aggregation over hashes, and texts move once, by path, not by blob.
    """
    body = F.coalesce("text", F.lit(""))
    hashed = versions.select("path", F.sha2(body, 256).alias("blob"))
    paths = written(hashed, "paths")
    ids = F.array(*[F.lit(r.id) for r in rules])
    todo = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("todo", F.array_except(ids, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    else:
        todo = todo.withColumn("todo", ids)
    todo = written(todo.select("path", "blob", "todo"), "todo")
    # A null path is joined as well; the blob keeps versions of one path apart.
    texts = versions.select(F.col("path").alias("at"), body.alias("text")).withColumn("named", F.sha2("text", 256))
    once = todo.hint("shuffle_hash").join(texts, F.col("path").eqNullSafe(F.col("at")) & (F.col("blob") == F.col("named")))
    clean = once.select("blob", "todo", F.translate("text", OPEN + CLOSE, OTHER + OTHER).alias("text"))
    each = [F.struct(F.lit(r.id).alias("rule"), F.when(F.array_contains("todo", r.id), found(F.col("text"), r)).alias("spans")) for r in rules]
    fresh = clean.select("blob", F.filter(F.array(*each), lambda x: x["spans"].isNotNull()).alias("each"))
    fresh = written(fresh.dropDuplicates(["blob"]), "scanned").select("blob", F.inline("each"))
    ledger = fresh if ledger is None else ledger.select("blob", "rule", "spans").unionByName(fresh)
    return paths, ledger


def findings(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """path, blob, rule and spans for every path and each rule with a match in its blob."""
    return paths.join(ledger.where(F.size("spans") > 0), "blob").select("path", "blob", "rule", "spans")


def spans_by_blob(ledger: DataFrame, rules) -> DataFrame:
    """blob and hits: all spans as (start, order of the kind, end, kind), sorted."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.id), F.struct(F.lit(i).alias("i"), F.lit(r.kind).alias("kind")))])
    hits = ledger.where(F.size("spans") > 0).select("blob", order[F.col("rule")].alias("k"), F.inline("spans"))
    return hits.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", F.col("k.i").alias("i"), "end", F.col("k.kind").alias("kind")))).alias("hits"))


def _count(hits: Column, kind: str) -> Column:
    return F.size(F.filter(hits, lambda x: x["kind"] == kind)).cast("long")


def _listed(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, all spans.

    Documents without a match have zero counts and the digest of the empty text. doc_id may
    be null or repeated. Other columns are not read."""
    rules = BASE + ADDED
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    paths, ledger = scan(versions, rules)
    by_blob = written(spans_by_blob(ledger, rules), "hits")
    all_hits = F.coalesce("hits", F.array().cast("array<struct<start:bigint,i:int,end:bigint,kind:string>>"))
    rows = paths.join(by_blob, "blob", "left").select(F.col("path").alias("doc_id"), all_hits.alias("hits"))
    base = [r.kind for r in BASE]
    rows = rows.withColumn("base", F.filter("hits", lambda x: x["kind"].isin(base)))
    counts = [_count(F.col("hits"), k).alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("hits")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span of the text replaced by [SECRET]; same columns, all rows.

    Overlapping spans are replaced as one. Rows without a match are unchanged, null text stays."""
    kept = docs.columns
    rules = BASE + ADDED
    _, ledger = scan(docs.select(F.col("doc_id").alias("path"), "text"), rules)
    by_blob = written(spans_by_blob(ledger, rules), "hits")
    named, hits = fresh(kept, "__blob", "__hits")
    rows = docs.withColumn(named, F.sha2(F.coalesce("text", F.lit("")), 256)).join(by_blob.select(F.col("blob").alias(named), F.col("hits").alias(hits)), named, "left")
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        gap = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int")), F.lit("[SECRET]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), gap.alias("out"))

    text = F.aggregate(hits, first, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))))
    return rows.withColumn("text", F.when(F.size(hits) > 0, text).otherwise(F.col("text"))).select(*kept)
