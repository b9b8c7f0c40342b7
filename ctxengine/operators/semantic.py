"""A session as labelled sections: task, rules, errors, code, changes, state, and what was left out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxengine.functions.relevance import CRITICAL, OBSOLETE
from ctxengine.functions.text import first_of, strip

#: How stubs begin and what the omission line calls them; what else stays visible.
STUBS = {
    "[dropped:": "knapsack", "[CBM:": "CBM", "[omit:": "omit", "[irrelevant read:": "irr", "[obsolete note:": "obsolete", "[stale read:": "stale", "[grep:": "grep", "[same as": "same",
}
KEPT = ("[DELTA ", "[subset read:", "[unchanged:", "[first read:")
STRUCTURAL = ("CBM", "knapsack", "stale", "irr", "grep")
#: Notes that carry no state, system texts that say nothing, git output.
NOISE = r"(?i)\b(meeting notes|last sprint|discussed UI polish|routine heartbeat|INFO: heartbeat ok|DEBUG: cache miss on key)\b"
GENERIC = r"(?i)^you are a (senior )?(software )?engineer\.?( follow project conventions\.?)?$"
GIT = r"(?i)^(On branch |Changes not staged|modified:|untracked:)"
#: Labels in the order of the sections, short and long.
LABELS = {"T": "TASK", "SYS": "CONSTRAINTS", "E": "ERRORS", "C": "RELEVANT_CODE", "GIT": "CHANGES", "STATE": "CURRENT_STATE"}


def starts(text: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


def stub_tag(text: Column) -> Column:
    """What a stub is called; null of any other text."""
    return first_of([(tag, text.startswith(p)) for p, tag in STUBS.items()])


def labelled(items: DataFrame, session: str = "session_id", generic_stays: bool = False) -> DataFrame:
    """items (session, pos, id, source, content_type, content, tier) with label, tag and body.

    Label O is left out, under its tag; null labels are blank items. A subset read is left out
    where an earlier item of the session shows its file."""
    items = items.withColumn("__text", strip(F.coalesce("content", F.lit(""))))
    text, kind, who = F.col("__text"), F.col("content_type"), F.lower(F.coalesce("source", F.lit("")))
    items = items.withColumns({"__stub": stub_tag(text), "__shown": starts(text, KEPT), "__git": text.rlike(f"(?m){GIT}"), "__critical": text.rlike(CRITICAL)})
    tag, shown, git, critical = F.col("__stub"), F.col("__shown"), F.col("__git"), F.col("__critical")
    file = (kind == "code") | shown
    before = Window.partitionBy(session, "source").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max((file & tag.isNull() & (text != "")).cast("int")).over(before), F.lit(0)) == 1
    noise = text.rlike(OBSOLETE if generic_stays else f"(?:{NOISE})|(?:{OBSOLETE})")
    rule = (kind == "message") & who.isin("system", "instruction")
    out = (
        F.when(noise, F.col("id"))
        .when(tag.isNotNull(), tag)
        .when(text.startswith("[subset read:") & seen, "subset")
        .when(shown, F.lit(None))
        .when(rule & text.rlike(GENERIC) & F.lit(not generic_stays), "sys")
        .when((kind == "message") | (kind == "code") | (kind == "log") | critical | git, F.lit(None))
        .when(F.col("tier").isin("discardable", "redundant") | ((F.col("tier") == "low") & F.lit(not generic_stays)), F.col("id"))
    )
    label = (
        F.when(text == "", F.lit(None)).when(F.col("tag").isNotNull(), "O").when(shown, "C").when(rule, "SYS").when(kind == "message", "T")
        .when((kind != "code") & critical, "E").when(kind == "code", "C").when(git, "GIT").when(kind == "log", "E").otherwise("STATE")
    )
    anchor = F.when(F.col("id").rlike("^(read_|msg_|v)"), F.concat(F.lit("["), F.col("id"), F.lit("]"), F.when((kind == "code") | text.startswith("["), " ").otherwise("\n"))).otherwise("")
    body = F.when(F.col("label").isin("T", "SYS"), text).when(F.col("label") == "GIT", git_state(text)).otherwise(F.concat(anchor, text))
    return items.withColumn("tag", F.when(text != "", out)).withColumn("label", label).withColumn("body", body).drop("__text", "__stub", "__shown", "__git", "__critical")


def git_state(text: Column) -> Column:
    """Branch and modified files of a status; the text where it has neither."""
    branch = F.nullif(F.regexp_extract(text, r"(?im)^On branch (\S+)", 1), F.lit(""))
    files = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?im)^\s*modified:\s+([\w./\\-]+\.\w+)"), 1))
    mods = F.when(F.size(files) > 0, F.concat(F.lit("mod "), F.array_join(files, ", ")))
    return F.coalesce(F.nullif(F.concat_ws(" | ", branch, mods), F.lit("")), text)


def omissions(tags: Column) -> Column:
    """`O:` with the distinct tags in order and how many items they stand for; null of none.

    Tags of structure hide ids of single items, and any other tag hides `sys`."""
    kinds = F.array_distinct(tags)
    structure = F.filter(kinds, lambda t: t.isin(*STRUCTURAL))
    others = F.filter(kinds, lambda t: t != "sys")
    shown = F.when(F.size(structure) > 0, structure).when(F.size(others) > 0, others).otherwise(kinds)
    count = F.when(F.size(tags) > 1, F.size(tags).cast("string")).otherwise("")
    return F.when(F.size(tags) > 0, F.concat(F.lit("O:"), F.array_join(shown, ","), count))


def sections(items: DataFrame, session: str = "session_id", long_labels: bool = False) -> DataFrame:
    """session, semantic: the session's items as labelled sections, one row for each session.

    Git rows whose files the task or the code names are left out, and so are those that name
    no file, unless long_labels. A session of blank items has an empty text."""
    rows = labelled(items, session, long_labels)
    got = rows.groupBy(session).agg(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("pos", "label", "body", "tag")))).alias("__p"))

    def of(label: str) -> Column:
        return F.transform(F.filter("__p", lambda x: x["label"] == label), lambda x: x["body"])

    said = F.lower(F.array_join(F.concat(of("T"), of("C")), " "))
    got = got.withColumn("__said", said)

    def news(row: Column) -> Column:
        files = F.regexp_extract_all(row, F.lit(r"[\w./\\-]+\.\w{1,5}\b"), 0)
        return (F.size(files) > 0) & F.exists(files, lambda f: ~F.contains(F.col("__said"), F.lower(f)))

    def bodies(label: str) -> Column:
        return F.filter(of(label), news) if label == "GIT" and not long_labels else of(label)

    parts = [F.when(F.size(bodies(k)) > 0, F.concat(F.lit(f"{v if long_labels else k}: "), F.array_join(bodies(k), "\n"))) for k, v in LABELS.items()]
    left = omissions(F.transform(F.filter("__p", lambda x: x["label"] == "O"), lambda x: x["tag"]))
    return got.select(session, F.concat_ws("\n", *parts, left).alias("semantic"))
