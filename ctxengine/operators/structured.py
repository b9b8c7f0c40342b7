"""Rows, logs and tables inside context: which rows to keep, what is constant, templates, TOON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxengine.functions.text import lines, strip

#: Rows that are never dropped; severities, worst first.
PROTECTED = r"(?i)(error|fatal|critical|exception|failed|panic|traceback)"
SEVERITY = {"fatal": 0, "panic": 0, "error": 1, "traceback": 1, "critical": 2, "exception": 3, "failed": 3, "warning": 4}
#: What a log template leaves out of a line, in this order.
TEMPLATE = [(r"\b\d+\b", "#"), (r"0x[0-9a-fA-F]+", "0x#"), (r"/[\w./-]+", "/<path>"), (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<ts>")]


def smart_rows(rows: DataFrame, group: list[str], order: list[str], numeric: list[str], text: Column, keep: int) -> DataFrame:
    """The `keep` rows of each group that tell most, with their score.

    The first and the last row score 100, protected rows 1000, and a value more than two
    standard deviations off its group's mean five times its distance in them. Two windows over
    one exchange: the group's statistics and its order."""
    whole = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(whole)
    place = F.row_number().over(whole.orderBy(*order))
    score = F.when(place == 1, 100.0).otherwise(0.0) + F.when(place == n, 100.0).otherwise(0.0) + F.when(text.rlike(PROTECTED), 1000.0).otherwise(0.0)
    for c in numeric:
        sd, mean = F.stddev_pop(c).over(whole), F.avg(c).over(whole)
        z = F.when(sd * sd >= 1e-9, F.abs(F.col(c) - mean) / sd)
        score = score + F.when((F.count(c).over(whole) >= 3) & (z > 2), z * 5).otherwise(0.0)
    scored = rows.withColumn("__place", place).withColumn("__score", F.round(score, 6))
    best = F.row_number().over(whole.orderBy(F.desc("__score"), "__place"))
    return scored.withColumn("__rank", best).where(F.col("__rank") <= keep).withColumnRenamed("__score", "score").drop("__rank", "__place")


def constants(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """group, column, value: columns with a single value in a group of two rows or more."""
    sums = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[x for c in columns for x in (F.min(c).cast("string").alias(f"lo_{c}"), F.max(c).cast("string").alias(f"hi_{c}"), F.count(c).alias(f"n_{c}"))])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.when((F.col(f"lo_{c}") == F.col(f"hi_{c}")) & (F.col(f"n_{c}") == F.col("n")), F.col(f"lo_{c}")).alias("value")) for c in columns])
    return sums.where("n > 1").select(*group, F.inline(each)).where("value is not null")


def severity(word: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.lower(word)], F.lit(50))


def severity_samples(rows: DataFrame, group: list[str], signal: str, order: list[str], keep: int) -> DataFrame:
    """One row of each signal, of each group the worst ones; a first and a last row fill up."""
    first = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*group, signal).orderBy(*order))).where("__rn = 1")
    best = F.row_number().over(Window.partitionBy(*group).orderBy(severity(F.col(signal)), *order))
    return first.withColumn("__rank", best).where(F.col("__rank") <= keep).drop("__rn", "__rank")


def toon(rows: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    """group, toon: rows of each group as a header and tab-separated lines."""
    cell = lambda c: F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\n", "  ")
    row = F.concat_ws("\t", *[cell(c) for c in columns])
    own = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))).alias("z"))
    head = F.concat(F.lit("# TOON "), F.size("z").cast("string"), F.lit(" rows\n" + "\t".join(columns) + "\n"))
    return own.select(*group, F.concat(head, F.array_join(F.transform("z", lambda x: x["r"]), "\n")).alias("toon"))


def template(line: Column) -> Column:
    s = strip(line)
    for pattern, by in TEMPLATE:
        s = F.regexp_replace(s, pattern, by)
    return F.substring(s, 1, 120)


def log_templates(rows: DataFrame, session: list[str], order: str, line: str, least: int = 3) -> DataFrame:
    """session, template, n, first_pos, shown: templates of `least` lines or more, as one line.

    Sessions with fewer than twice as many lines are left alone."""
    big = rows.groupBy(*session).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= 2 * least).drop("__n")
    keyed = rows.join(big, session, "left_semi").withColumn("template", template(F.col(line)))
    out = keyed.groupBy(*session, "template").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_pos"), F.min_by(line, order).alias("line")).where(F.col("n") >= least)
    s = strip(F.col("line"))
    short = F.when(F.length(s) > 100, F.concat(F.substring(s, 1, 97), F.lit("..."))).otherwise(s)
    return out.select(*session, "template", "n", "first_pos", F.concat(F.lit("[×"), F.col("n").cast("string"), F.lit("] "), short).alias("shown"))


def log_severity(line: Column) -> Column:
    return F.when(line.rlike(r"(?i)\b(error|fatal|critical|exception|panic|traceback)"), "error").when(line.rlike(r"(?i)\bwarn"), "warning").when(line.rlike(r"(?i)\bdebug\b"), "debug").otherwise("info")


def segments(items: DataFrame, key: list[str], text: str) -> DataFrame:
    """key, segment, kind, n_lines, content: runs of lines of one kind; a line without a kind
    belongs to the run before it. Gaps and islands over the lines of each text."""
    at = items.select(*key, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    line = F.col("line")
    kind = F.when(line.startswith("diff --git") | line.startswith("@@"), "diff").when(line.rlike(r"^\s*[\{\[]"), "json").when(line.rlike(r"(ERROR|Traceback|FAILED|\d{4}-\d{2}-\d{2})"), "log").when(line.rlike("^(def |class |import |function )"), "code")
    w = Window.partitionBy(*key).orderBy("pos")
    before = F.last("kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = at.withColumn("kind", kind).withColumn("before", before)
    cut = (F.col("kind").isNotNull() & F.col("before").isNotNull() & (F.col("kind") != F.col("before"))).cast("int")
    own = own.withColumn("segment", F.sum(cut).over(w))
    out = own.groupBy(*key, "segment").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("z"))
    return out.select(*key, "segment", F.coalesce("kind", F.lit("text")).alias("kind"), "n_lines", F.array_join(F.transform("z", lambda x: x["line"]), "\n").alias("content"))
