"""URL filters: a path-template tree for each host, judged by smoothed labelled purity.

Segments that vary (digits, long hexadecimal or mixed names) become wildcards at once; a node
with many children of few pages each makes all of them one wildcard. Else branches under one
node are merged when their labels do not tell them apart: in the order of their shares of good
pages, each joins the cluster before it if the two shares differ by less than chance allows.
Branches with too few labels to say anything are one wildcard. A template is rejected when
the share of good pages among its labelled ones, smoothed towards its host's and that towards
all pages', is low.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxengine.llm.shared import ascii_lower, written

#: Rules (verdict, host, start of the path) of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


@dataclass(frozen=True)
class Limits:
    """depth: segments that are nodes of the tree; all below these, wildcards in them too, are
    one node. children: a node with more, and fewer than `pages` pages for each of them, has
    one wildcard child. labels: a branch with fewer says nothing. z: branches whose shares
    differ by fewer standard errors are merged. prior: labelled pages that the parent's share
    counts for. least: a template is rejected below this share."""

    depth: int = 5
    children: int = 20
    pages: int = 4
    labels: int = 5
    z: float = 2.0
    prior: float = 10.0
    least: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    text = verdict = None
    for what, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        text = F.when(fits, F.lit(at + start)).otherwise(F.lit(None) if text is None else text)
        verdict = F.when(fits, F.lit(what)).otherwise(F.lit(None) if verdict is None else verdict)
    return text.cast("string"), verdict.cast("string")


def segment(s: Column) -> Column:
    """A segment's node: variable parts are wildcards, an ending stays."""
    end = F.regexp_extract(s, r"\.[A-Za-z]{1,5}$", 0)
    name = F.substring(s, F.lit(1), F.length(s) - F.length(end))
    return F.when(s == "", s).when(name.rlike("^[0-9]+$"), F.concat(F.lit("{n}"), end)).when(name.rlike("^(?=.*[0-9])[0-9A-Za-z_-]{8,}$"), F.concat(F.lit("{id}"), end)).otherwise(s)


def _share(good: Column, seen: Column, parent: Column, prior: float) -> Column:
    return (good + F.lit(prior) * parent) / (seen + F.lit(prior))


def _clusters(classes: Column, z: float) -> Column:
    """The cluster's number, from 1, of each class (p, m, good, seen, branches), in their order.

    A class joins the cluster before it, with all that is in that, if half a page of each kind
    added to either their shares differ by fewer than z standard errors."""
    start = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("seen"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        p1, p2 = (acc["good"] + 0.5) / (acc["seen"] + 1), (x["good"] + 0.5) / (x["seen"] + 1)
        pooled = (acc["good"] + x["good"] + 1.0) / (acc["seen"] + x["seen"] + 2)
        error = F.sqrt(pooled * (1 - pooled) * (1 / (acc["seen"] + 1.0) + 1 / (x["seen"] + 1.0)))
        alike = (acc["k"] > 0) & (F.abs(p1 - p2) < z * error)
        k = F.when(alike, acc["k"]).otherwise(acc["k"] + 1)
        good, seen = (F.when(alike, acc[c]).otherwise(F.lit(0).cast("long")) + x[c] for c in ("good", "seen"))
        return F.struct(k.alias("k"), good.alias("good"), seen.alias("seen"), F.concat(acc["out"], F.array(k)).alias("out"))

    return F.aggregate(classes, start, step, lambda acc: acc["out"])


def _named(node: DataFrame, above: list[str], at: str, limits: Limits) -> DataFrame:
    """above, at and to: the template's segment for each branch `at` under the nodes `above`.

    Branches of one share (in 64ths) and one number of labels (in powers of two) are a class;
    a node has a bounded number of these, whatever the number of its branches."""
    branch = node.groupBy(*above, at).agg(F.sum("pages").alias("pages"), F.sum("good").alias("good"), F.sum("seen").alias("seen"))
    share = F.round(64 * (F.col("good") + 0.5) / (F.col("seen") + 1)).cast("int")
    weak = (F.col("seen") < limits.labels) | (F.col(at) == "")
    branch = branch.withColumn("p", F.when(~weak, share)).withColumn("m", F.when(~weak, F.floor(F.log2("seen"))).cast("int"))
    classes = written(branch.groupBy(*above, "p", "m").agg(F.sum("pages").alias("pages"), F.sum("good").alias("good"), F.sum("seen").alias("seen"), F.count(F.lit(1)).alias("branches")), "classes")
    strong = F.col("p").isNotNull()
    parent = classes.groupBy(*above).agg(
        F.sum("pages").alias("pages"), F.sum("branches").alias("kids"),
        F.array_sort(F.collect_list(F.when(strong, F.struct("p", "m", "good", "seen", "branches")))).alias("c"),
    )
    wide = (F.col("kids") > limits.children) & (F.col("pages") < limits.pages * F.col("kids"))
    parent = parent.select(*above, F.col("kids").alias("kids"), wide.alias("wide"), F.arrays_zip(F.col("c").alias("c"), _clusters(F.col("c"), limits.z).alias("k")).alias("z"))
    of = parent.select(*above, F.explode("z").alias("z")).select(*above, F.col("z.c.p").alias("p"), F.col("z.c.m").alias("m"), F.col("z.k").alias("k"), F.col("z.c.branches").alias("branches"))
    # How many branches a cluster has; it has few classes.
    of = of.groupBy(*above, "k").agg(F.sum("branches").alias("many"), F.collect_list(F.struct("p", "m")).alias("own"))
    of = of.select(*above, "k", "many", F.inline("own"))
    nodes = parent.select(*above, "kids", "wide")
    rows = branch.select(*above, at, "p", "m").join(nodes, above).join(of, [*above, "p", "m"], "left")
    to = (
        F.when(F.col(at) == "", F.lit("")).when(F.col("wide"), F.lit("*")).when(F.col("kids") == 1, F.col(at))
        .when(F.col("k").isNull(), F.lit("*")).when(F.col("many") > 1, F.concat(F.lit("*"), F.col("k"))).otherwise(F.col(at))
    )
    return written(rows.select(*above, at, to.alias("to")), f"branches-{at}")


def judged(pages: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """page_id, host, path, template, purity, verdict of the method for every page.

    pages: page_id, url. labels: page_id, good (0 or 1; null is no label); several labels of a
    page all count. Null urls have empty host and path. Templates without a labelled page have
    their host's smoothed share. Branches of equal share are one class, so ties need no order.
    A host with most pages is never one group of rows: all that is computed for it are sums,
    and the join back to pages is split where it is skewed.
    """
    host, path = host_and_path(F.col("url"))
    split = F.transform(F.split(F.substring(path, 2, 2**31 - 1), "/", -1), segment)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), split.alias("s"))
    for d in range(limits.depth):
        rows = rows.withColumn(f"s{d}", F.coalesce(F.try_element_at("s", F.lit(d + 1)), F.lit("")))
    rows = rows.withColumn(f"s{limits.depth}", F.array_join(F.slice("s", limits.depth + 1, 2**31 - 1), "/"))
    levels = [f"s{d}" for d in range(limits.depth + 1)]
    marks = labels.groupBy("page_id").agg(F.sum("good").alias("good"), F.count("good").alias("seen"))
    rows = written(rows.drop("s").join(marks, "page_id", "left").fillna(0, ["good", "seen"]), "pages")
    # Sums of nodes, not pages, from here on: branches with the same templates are one row.
    node = rows.groupBy("host", *levels).agg(F.count(F.lit(1)).alias("pages"), F.sum("good").alias("good"), F.sum("seen").alias("seen"))
    node = node.select("host", *levels, *[F.col(c).alias(f"t{i}") for i, c in enumerate(levels)], "pages", "good", "seen")
    node = written(node, "nodes")
    whole = node.agg(F.sum("good").alias("good"), F.sum("seen").alias("seen")).first()
    share = (((whole["good"] or 0) + 1.0) / ((whole["seen"] or 0) + 2.0))
    hosts = node.groupBy("host").agg(F.sum("good").alias("good"), F.sum("seen").alias("seen"))
    hosts = written(hosts.select("host", _share(F.col("good"), F.col("seen"), F.lit(share), limits.prior).alias("host_share")), "hosts")
    for d in range(limits.depth + 1):
        above = ["host", *[f"t{i}" for i in range(d)]]
        node = node.join(_named(node, above, f"t{d}", limits), [*above, f"t{d}"]).withColumn(f"t{d}", F.col("to")).drop("to")
        node = written(node, "named")
    names = [f"t{d}" for d in range(limits.depth + 1)]
    template = node.groupBy("host", *names).agg(F.sum("good").alias("good"), F.sum("seen").alias("seen")).join(hosts, "host")
    template = template.withColumn("purity", _share(F.col("good"), F.col("seen"), F.col("host_share"), limits.prior)).select("host", *names, "purity")
    verdicts = node.select("host", *levels, *names).join(template, ["host", *names])
    verdicts = written(verdicts.withColumn("template", F.concat(F.lit("/"), F.regexp_replace(F.concat_ws("/", *names), "/+$", ""))).select("host", *levels, "template", "purity"), "verdicts")
    out = rows.join(verdicts, ["host", *levels])
    return out.select("page_id", "host", "path", "template", "purity", F.when(F.col("purity") < limits.least, "block").otherwise("allow").alias("verdict"))


def report(pages: DataFrame, labels: DataFrame, rules=RULES, limits: Limits = Limits()) -> DataFrame:
    """One row per page: host, path, the longest fitting rule, and the rule's verdict or else the tree's.

    labels: doc_id, quality; a page is good or not as the document of its number is."""
    marks = labels.select(F.col("doc_id").alias("page_id"), F.col("quality").cast("long").alias("good"))
    rows = judged(pages, marks, limits)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "verdict").alias("verdict"), "template", "purity")
