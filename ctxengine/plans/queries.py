"""Queries of the library's own operators over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxengine.functions import detect, redact, relevance, tokens
from ctxengine.functions.text import count_of
from ctxengine.operators import catalog, cli, compress, dedup, measure, ranking, rewrite, semantic, session, structured, tools
from ctxengine.plans.optimize import optimize_context
from ctxengine.sources import items as src

WORDS = r"[^\p{L}\p{M}\p{N}_]+"  # what separates words, in SQL
#: Lines of command output that events stand for.
COMMANDS = {"purchase": "added 5 packages in 2s", "error": "src/app.ts(3,4): error TS2304: x", "click": "Step 1/3 : FROM base", "signup": "=== RUN TestLogin", "view": "> Task :compileJava"}


def _r(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _quote(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _sub(template: str, c: str) -> str:
    return template.replace("{c}", c)


def _has(c: str, p: str) -> str:
    return f"regexp_matches({c}, {_quote('(?m)' + p)})"


def _cases(c: str, cases) -> str:
    return "case " + " ".join(f"when {_has(c, p)} then '{n}'" for n, p in cases) + " end"


SPACE = r"[\s\x0b\x85\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+"
STRIP = "regexp_replace({c}, '^" + SPACE + "|" + SPACE + "$', '', 'g')"
SQL_NORM = "regexp_replace(lower(" + STRIP + "), '" + SPACE + "', ' ', 'g')"
SQL_HASH = "substr(sha256(" + SQL_NORM + "), 1, 16)"
SQL_TOK = "case when length({c}) = 0 then 0 else greatest(1, floor((length({c}) - length(regexp_replace({c}, '[^一-鿿぀-ヿ]', '', 'g'))) / 3.3)::bigint + length(regexp_replace({c}, '[^一-鿿぀-ヿ]', '', 'g'))) end"


def q01(spark, d):
    t = tokens.estimate(F.col("text"))
    return _r(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(t).alias("sum_tokens"), F.max(t).cast("long").alias("max_tokens"), F.round(F.avg(t), 6).alias("avg_tokens"), F.round(tokens.cost(F.sum(t), F.lit(0)), 6).alias("cost"))


def q02(spark, d):
    texts = _r(spark, d, "documents").select(F.lit("documents").alias("of"), "text").unionByName(_r(spark, d, "pages").select(F.lit("pages").alias("of"), F.col("html").alias("text"))).unionByName(_r(spark, d, "events").select(F.lit("events").alias("of"), F.col("props").alias("text")))
    return texts.withColumn("content_type", detect.content_type(F.col("text"))).groupBy("of", "content_type").agg(F.count(F.lit(1)).alias("n"))


def _commands(spark, d):
    by = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])
    lines = _r(spark, d, "events").select(F.concat(F.lit("run "), F.col("event_id"), F.lit("\n"), by[F.col("event_type")]).alias("text"))
    return lines.unionByName(_r(spark, d, "documents").select("text"))


def q03(spark, d):
    t = F.col("text")
    return _commands(spark, d).select(detect.cli_tool(t).alias("cli"), detect.test_runner(t).alias("runner"), detect.shell_tool(t).alias("shell")).groupBy("cli", "runner", "shell").agg(F.count(F.lit(1)).alias("n"))


def q04(spark, d):
    rows = _r(spark, d, "pages").select("page_id", F.replace(F.col("html"), F.lit("><"), F.lit(">\n{<")).alias("html"))
    return structured.segments(rows, ["page_id"], "html").select("page_id", F.col("segment").cast("long").alias("segment"), "kind", "n_lines", F.length("content").cast("long").alias("chars"))


def q05(spark, d):
    texts = _r(spark, d, "pages").select(F.col("html").alias("text")).unionByName(_r(spark, d, "events").select(F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.lit("session_id="), F.col("user_id")), "props").alias("text")))
    return texts.select(F.inline(detect.volatile(F.col("text")))).groupBy("type").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("count").cast("long")).alias("found"))


def _tiered(spark, d):
    items = src.from_conversations(_r(spark, d, "conversations"))
    asked = items.join(src.last_user_message(items), "session_id", "left")
    terms, symbols = relevance.query_terms(F.coalesce("task_query", F.lit("")))
    asked = asked.withColumn("terms", terms).withColumn("symbols", symbols).withColumn("token_count", tokens.estimate(F.col("content")))
    t = relevance.tier(F.col("content"), F.col("content_type"), F.col("token_count"), F.col("source"), F.col("task_query"), F.col("terms"), F.col("symbols"), role=F.col("source"))
    return asked.withColumn("overlap", F.round(relevance.overlap(F.col("content"), F.col("terms")), 6)).withColumn("tier", t)


def q06(spark, d):
    return _tiered(spark, d).select(F.col("session_id").alias("conv_id"), F.col("pos").cast("long").alias("turn"), "tier", "overlap")


def q07(spark, d):
    rows = _tiered(spark, d).withColumn("n", F.col("token_count").cast("long"))
    out = rows.groupingSets([[], ["source"], ["content_type"]], "source", "content_type").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("items"), F.sum(F.when(F.col("tier") == "critical", F.col("n")).otherwise(0)).alias("critical"), F.grouping_id().alias("g"))
    return out.select(F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "source").otherwise("type").alias("level"), F.coalesce("source", "content_type", F.lit("")).alias("key"), "tokens", "items", "critical")


def _bm25(spark, d):
    docs = _r(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    query = _r(spark, d, "benchmark").agg(F.min_by("text", "item_id").alias("task_query"))
    langs = docs.select("lang").distinct().crossJoin(query)  # languages and one query, the task of this report
    return ranking.bm25(docs, langs, ["doc_id"], ["lang"]).select("doc_id", "lang", F.round("score", 6).alias("score"))


def q08(spark, d):
    return _bm25(spark, d)


def q09(spark, d):
    return ranking.top(_bm25(spark, d), ["lang"], [F.desc("score"), F.col("doc_id")], 10).select("lang", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def q10(spark, d):
    e = _r(spark, d, "events")
    as_of = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return e.select("event_id", F.round(relevance.recency(F.col("ts").cast("timestamp") + F.expr("interval 0 seconds"), F.least(as_of, F.lit("2024-06-01 00:00:00").cast("timestamp"))), 6).alias("recency"), relevance.error_boost(F.col("event_type")).alias("error_boost"))


def _docs_as_items(spark, d):
    return _r(spark, d, "documents").select("lang", "doc_id", F.col("text").alias("content"))


def q11(spark, d):
    return dedup.exact(_docs_as_items(spark, d), "lang", "doc_id")


def q12(spark, d):
    return dedup.contained(_docs_as_items(spark, d), "lang", "doc_id")


def q13(spark, d):
    return dedup.repeated_lines(_docs_as_items(spark, d), "doc_id")


def q14(spark, d):
    rows = session.stale(src.from_conversations(_r(spark, d, "conversations")))
    return rows.select(F.col("session_id").alias("conv_id"), F.col("pos").cast("long").alias("turn"), F.col("last_pos").cast("long").alias("last_turn"), "is_stale")


def q15(spark, d):
    docs = _r(spark, d, "documents").select(F.lit(1).alias("s"), F.concat(F.lit("d"), F.col("doc_id"), F.lit(".md")).alias("path"), F.col("text").alias("content"), F.col("doc_id").alias("pos"))
    items = _r(spark, d, "benchmark").select(F.lit(1).alias("s"), "item_id", F.concat(F.lit("d"), F.col("item_id"), F.lit(".md:1:"), "text").alias("content"))
    own = _r(spark, d, "documents").select(F.lit(1).alias("s"), (F.col("doc_id") + 1000000).alias("item_id"), F.concat(F.lit("d"), F.col("doc_id"), F.lit(".md:2:"), F.regexp_extract("text", r"^[^\n]*", 0)).alias("content"))
    return session.covered_greps(items.unionByName(own), docs, ["s"], "item_id").select("item_id", "matches", "covered")


def q16(spark, d):
    e = _r(spark, d, "events").select("event_id", F.concat(F.when(F.col("event_type") == "view", "deprecated:  ").otherwise(""), F.col("event_type"), F.lit("  "), F.col("props")).alias("content"))
    return e.select("event_id", session.obsolete_stub(F.col("content"), F.lit("discardable")).alias("stub")).where("stub is not null")


def q17(spark, d):
    rows = _tiered(spark, d).select("session_id", "pos", "token_count", F.lit("medium").alias("tier"), (F.length("content") % 17 + 1).cast("double").alias("score"))
    kept = ranking.select(rows).where("kept")
    return rows.select("session_id").distinct().join(kept.groupBy("session_id").agg(F.sum("score").alias("value")), "session_id", "left").select(F.col("session_id").alias("conv_id"), F.coalesce("value", F.lit(0.0)).alias("value"))


def q18(spark, d):
    rows = structured.smart_rows(_r(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], ["o_totalprice"], F.lit(""), 5)
    return rows.select("o_custkey", "o_orderkey", "score")


def q19(spark, d):
    return structured.constants(_r(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"]).select("l_orderkey", "column", "value")


def q20(spark, d):
    return structured.severity_samples(_r(spark, d, "events"), ["user_id"], "event_type", ["event_id"], 2).select("user_id", "event_id", "event_type")


def q21(spark, d):
    return structured.toon(_r(spark, d, "nation"), ["n_regionkey"], "n_nationkey", ["n_nationkey", "n_name"])


def _log_lines(spark, d):
    return _r(spark, d, "events").select((F.col("user_id") % 50).alias("session"), F.col("event_id").alias("pos"), F.concat(F.lit("  "), F.upper(F.when(F.col("event_type") == "error", "error").otherwise("info")), F.lit(" user "), F.col("user_id"), F.lit(" "), F.col("event_type"), F.lit(" at /srv/"), F.col("event_type"), F.lit("/x 0xFF"), F.col("event_id")).alias("line"))


def q22(spark, d):
    return structured.log_templates(_log_lines(spark, d), ["session"], "pos", "line")


def q23(spark, d):
    return _log_lines(spark, d).groupBy("session", structured.log_severity(F.col("line")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def q24(spark, d):
    r = redact.redact(F.col("text"))
    return _r(spark, d, "documents").select("doc_id", count_of(r, r"\[REDACTED\]").cast("long").alias("n"), F.sha2(r, 256).alias("digest"))


def q25(spark, d):
    tools = _r(spark, d, "part").select(F.lit(1).alias("catalog_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    intents = _r(spark, d, "part").select(F.col("p_type").alias("intent_id")).distinct().select("intent_id", F.lit(1).alias("catalog_id"), F.col("intent_id").alias("intent"))
    return catalog.shortlist(intents, tools).select("intent_id", "pos", "score", F.col("rank").cast("long").alias("rank"))


def q26(spark, d):
    names = _r(spark, d, "part").select(F.col("p_name").alias("name"))
    return names.withColumn("risk", relevance.risk(F.col("name"))).groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


def q27(spark, d):
    docs = _r(spark, d, "documents").select(F.col("text").alias("content"), F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 4).alias("created_at"))
    return catalog.recovery(docs, F.timestamp_seconds(F.lit(1700003600))).groupBy("alive").agg(F.count(F.lit(1)).alias("n"), F.min("handle").alias("first_handle"))


def q28(spark, d):
    rows = _r(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("source"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 0.0).otherwise((F.col("event_id") % 10) / 10).alias("ratio"))
    return catalog.feedback(rows)


def q29(spark, d):
    """Whole texts against what they must hold: their language's name, their last line, patterns."""
    last = F.substring_index("text", "\n", -1)
    score = catalog.quality(F.col("text"), F.array(F.col("lang"), F.lit("the")), F.array(last, F.lit("no such text")), ("[0-9]{3,}", "(?i)licen[cs]e"))
    return _r(spark, d, "documents").select("doc_id", F.round(score, 6).alias("score"))


def q30(spark, d):
    rows = _r(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.col("o_totalprice").alias("a"), F.floor(F.col("o_totalprice") / 3).alias("b"))
    return catalog.floors(rows, "o_orderpriority", "o_orderstatus", "a", "b")


def q31(spark, d):
    """What leaving out copies saves, by source: a later copy becomes a line with a handle."""
    docs = _r(spark, d, "documents").select("lang", "source", "doc_id", F.col("text").alias("content"))
    copies = dedup.exact(docs, "lang", "doc_id").select(F.col("dup").alias("doc_id"), "keep")
    name = lambda c: F.concat(F.lit("d"), c)
    rows = docs.join(copies, "doc_id", "left")
    rows = rows.withColumn("after", F.when(F.col("keep").isNotNull(), measure.omission(name("doc_id"), name("keep"), F.col("content"))).otherwise(F.col("content")))
    return measure.net(rows, "source", "content", "after")


def q33(spark, d):
    limits = spark.createDataFrame(LIMITS, "level string, key string, floor double")
    return measure.failures(q30(spark, d), limits)


def q34(spark, d):
    return measure.stats(_r(spark, d, "documents").select("doc_id", "text")).drop("text")


def q35(spark, d):
    rows = _tiered(spark, d).select("session_id", F.col("pos").cast("long").alias("pos"), "id", "content", "tier", "token_count")
    return measure.analysis(rows, large=LARGE_TURN).withColumnRenamed("session_id", "conv_id")


def _catalogs(spark, d):
    """Small catalogs of tools; some give two tools one name."""
    p = _r(spark, d, "part")
    schema = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "description": "'), "p_type", F.lit('", "size": '), F.col("p_size").cast("string"), F.lit("}"))
    return p.select(F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), (F.col("p_size") % 5).cast("string")).alias("catalog_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), schema.alias("schema_json"))


def q36(spark, d):
    tools_ = _catalogs(spark, d)
    intents = tools_.groupBy("catalog_id").agg(F.concat(F.lit("use the "), F.max("name"), F.lit(" token=abc123")).alias("intent")).withColumn("intent_id", F.col("catalog_id"))
    routed = catalog.route(intents, tools_.where("name not like 'red %'"), k=2)
    return routed.drop("route_key", "allow_execute")


def q37(spark, d):
    docs = _r(spark, d, "documents")
    folder, k = F.concat(F.lit("/d"), (F.col("doc_id") % 40).cast("string")), F.col("doc_id").cast("string")
    paths = F.array(F.concat(folder, F.lit("/f"), k), F.when(F.col("doc_id") % 3 == 0, folder).otherwise(F.lit("/none")))
    entries = docs.select(F.substring(F.sha2("text", 256), 1, 32).alias("key"), (F.lit(1700000000) + F.col("doc_id") * 4).alias("created_at"), F.col("doc_id").alias("value"), paths.alias("dependencies"))
    changes = _r(spark, d, "benchmark").select(F.concat(F.lit("/d"), F.col("item_id") % 40, F.lit("/f"), F.col("item_id") * 7).alias("path"), (F.lit(1700000000) + F.col("item_id") * 20).alias("at"))
    return catalog.cached(entries, changes, F.lit(1700004000), most=900)


def q38(spark, d):
    tools_ = _catalogs(spark, d).select(F.col("catalog_id").alias("session_id"), "pos", "name", "schema_json", F.col("pos").alias("stored_at"))
    asked = tools_.select("session_id", "name").distinct()
    asked = asked.unionByName(asked.where("name like 'red %'").select("session_id", F.upper("name").alias("name")))
    return catalog.schema_of(tools_, asked).select("session_id", "name", "schema_json")


def q44(spark, d):
    """Pages cut between tags: each part by the compressors of its kind."""
    rows = _r(spark, d, "pages").select("page_id", F.replace(F.col("html"), F.lit("><"), F.lit(">\n{<")).alias("html"))
    return compress.routed(rows, ["page_id"], "html")


def _modules(spark, d):
    """A Python module of each part type and brand, with a class whose methods are its parts."""
    p = _r(spark, d, "part")
    body = F.concat(F.lit("    def "), F.regexp_replace("p_name", r"\W+", "_"), F.lit("_"), F.col("p_partkey"), F.lit("(self, size: int) -> int:\n        price = "), F.col("p_size"), F.lit("\n        self.log(price)\n        return price + size\n"))
    rows = p.groupBy("p_brand", "p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", body.alias("b")))), lambda x: x["b"]), "\n").alias("b"), F.max(F.concat(F.regexp_replace("p_name", r"\W+", "_"), F.lit("_"), F.col("p_partkey"))).alias("wanted"))
    return rows.select("p_brand", "p_type", F.concat(F.lit("import os\n\n\nclass Store:\n"), "b").alias("text"), F.concat(F.lit("fix "), "wanted").alias("query"), "wanted")


def q45(spark, d):
    """Modules cut to the method that a task names."""
    rows = _modules(spark, d).withColumn("c", compress.compressed(F.col("text"), F.lit("code"), 0.85, F.col("query")))
    return rows.select("p_brand", "p_type", F.length("text").cast("long").alias("chars"), F.length("c.content").cast("long").alias("left"), "c.strategy", F.contains("c.content", "wanted").alias("found"))


#: Floors that some of the orders' groups miss; from how many tokens on a turn is large here.
LIMITS = [("total", "", 0.7), ("category", "1-URGENT", 0.5), ("category", "5-LOW", 0.75), ("fixture", "F", 0.9), ("fixture", "O", 0.2)]
LARGE_TURN = 40
SOURCES = ("src/a.py", "notes.md", "user", "README", "lib\\b.go", "x.cs ", "", "docs/guide.txt")


def q32(spark, d):
    """What each item of a made session weighs: orders as items of all tiers, ranks and sources."""
    k = F.col("o_orderkey")
    tiers, kinds, sources = (F.array(*[F.lit(x) for x in xs]) for xs in (list(relevance.TIERS), ("code", "text", "log"), SOURCES))
    pick = lambda xs, n: F.element_at(xs, (k % n + 1).cast("int"))
    rows = _r(spark, d, "orders").select(k, pick(tiers, 6).alias("tier"), ((k % 10) / 10).alias("bm25"), pick(kinds, 3).alias("kind"), pick(sources, 8).alias("source"), F.concat_ws(" ", "o_orderpriority", F.when(k % 7 == 0, "job Failed"), F.repeat(F.lit("x"), (k % 50).cast("int"))).alias("content"))
    return rows.select(
        "o_orderkey", "tier", F.round(relevance.aggressiveness(F.col("tier"), F.col("bm25")), 4).alias("aggressiveness"), relevance.tier_boost(F.col("tier")).alias("boost"), ranking.default_value(F.col("tier")).alias("value"),
        tokens.quick_estimate(F.col("content")).cast("long").alias("quick_tokens"), relevance.is_file_read(F.col("source"), F.col("kind")).alias("is_file_read"), relevance.error_boost(F.col("content")).alias("error_boost"), ranking.dropped_stub(F.concat(F.lit("msg_"), k), tokens.estimate(F.col("content"))).alias("stub"),
    )


def _payloads(spark, d):
    """Every user's events as a JSON list, a log and a diff-like text."""
    e = _r(spark, d, "events")
    each = F.array_sort(F.collect_list(F.struct("event_id", "event_type", F.round("value", 3).alias("value"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))))
    rows = e.groupBy("user_id").agg(each.alias("z"))
    level = lambda x: F.when(x["event_type"] == "error", "ERROR").otherwise("INFO")
    log = F.array_join(F.transform("z", lambda x: F.concat_ws(" ", x["ts"], level(x), x["event_type"], x["value"].cast("string"))), "\n")
    hunks = F.array_join(F.transform("z", lambda x: F.concat(F.lit("@@ -1,9 +1,9 @@\n a\n b\n c\n d\n+"), x["event_type"], F.lit("\n e\n f\n g\n h"))), "\n")
    texts = F.array(F.struct(F.lit("json").alias("kind"), F.to_json("z").alias("text")), F.struct(F.lit("log").alias("kind"), log.alias("text")), F.struct(F.lit("diff").alias("kind"), hunks.alias("text")))
    return rows.select("user_id", F.inline(texts))


def q40(spark, d):
    rows = _payloads(spark, d).select("user_id", "kind", F.length("text").cast("long").alias("chars"), compress.compressed(F.col("text"), F.col("kind")).alias("c"))
    return rows.select("user_id", "kind", "chars", F.length("c.content").cast("long").alias("left"), "c.strategy")


def q41(spark, d):
    e = _r(spark, d, "events")
    by = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.concat(by[x["event_type"]], F.lit("\nnote "), x["event_id"].cast("string"))), "\n")
    rows = e.groupBy("user_id", "event_type").agg(text.alias("text"))
    rows = rows.select("user_id", "event_type", F.length("text").cast("long").alias("chars"), cli.compressed(F.col("text")).alias("c"))
    return rows.select("user_id", "event_type", "chars", F.length("c.content").cast("long").alias("left"), "c.strategy", "c.compressed")


def q42(spark, d):
    p = _r(spark, d, "part")
    schema = F.struct(F.col("p_name").alias("name"), F.concat(F.col("p_type"), F.lit(". "), F.repeat(F.lit("More about it. "), 12)).alias("description"), F.struct(F.lit("object").alias("type"), F.struct(F.struct(F.lit("string").alias("type"), F.lit("what to find").alias("description")).alias("query"), F.struct(F.lit("integer").alias("type"), F.col("p_type").alias("description")).alias("size")).alias("properties")).alias("inputSchema"))
    tools = p.select(F.col("p_type").alias("catalog_id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.lit("").alias("description"), F.to_json(schema).alias("schema_json"))
    return compress.lazy_catalog(tools).select("catalog_id", "tools", "full_chars", "catalog_chars")


def _statuses(spark, d):
    """A status for each source: its documents as changed, untracked and noisy files."""
    k, n = F.col("doc_id") % 9, F.col("doc_id").cast("string")
    path = F.when(k == 1, F.concat(F.lit("\tmodified:   src/m"), n, F.lit(".py"))).when(k == 2, F.concat(F.lit("\tnotes/n"), n, F.lit(".txt"))).when(k == 3, F.concat(F.lit("\ttmp_"), n, F.lit(".log")))
    files = _r(spark, d, "documents").where("source is not null").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", k.alias("k"), path.alias("path")))).alias("z"))

    def under(head, *kinds):
        own = F.filter("z", lambda x: x["k"].isin(*kinds))
        return F.when(F.size(own) > 0, F.concat(F.lit(head), F.array_join(F.transform(own, lambda x: x["path"]), "\n"), F.lit("\n"))).otherwise("")

    text = F.concat(F.lit("On branch "), "source", F.lit("\n"), under("Changes not staged for commit:\n", 1), under("\nUntracked files:\n", 2, 3))
    return files.select("source", text.alias("text"))


def q43(spark, d):
    """Statuses by the tools' router: the branch, some changed files, and numbers of the others."""
    rows = _statuses(spark, d).select("source", "text", tools.compressed(F.col("text")).alias("c"))
    return rows.select("source", F.length("text").cast("long").alias("chars"), F.col("c.content").alias("content"), "c.strategy", "c.compressed")


def q50(spark, d):
    return rewrite.rewritten(src.from_documents(_r(spark, d, "documents"))).select("session_id", "pos", "content", "how")


def _agent_sessions(spark, d):
    """Conversations whose replies are reads of a file in versions, searches in it, logs and status."""
    turns = src.from_conversations(_r(spark, d, "conversations"))
    k, path = F.col("pos") % 4, F.concat(F.lit("src/m"), F.col("session_id") % 7, F.lit(".py"))
    read = F.concat(F.lit("import os\n\n\ndef total(x):\n    return x + "), F.col("pos"), F.repeat(F.lit("\n    # the same line of a file"), 12))
    text = F.when(k == 1, read).when(k == 2, F.concat(path, F.lit(":4:def total(x):"))).when(k == 3, F.concat(F.lit("On branch main\n\tmodified:   src/x"), F.col("session_id") % 3, F.lit(".py\n"))).otherwise(F.col("content"))
    kind = F.when(k == 1, "code").when(k == 2, "search").when(k == 3, "tool_output").otherwise("message")
    return turns.withColumn("id", F.when(k == 0, F.col("id")).otherwise(F.concat(F.lit("read_"), F.col("pos")))).withColumn("content", text).withColumn("content_type", kind).withColumn("source", F.when(k == 0, F.col("source")).otherwise(path))


def q51(spark, d):
    """Equal runs of lines folded across the turns of each conversation, whose odd turns repeat the one before."""
    turns = src.from_conversations(_r(spark, d, "conversations"))
    before = F.lag("content").over(Window.partitionBy("session_id").orderBy("pos"))
    turns = turns.withColumn("content", F.concat_ws("\n", F.when(F.col("pos") % 2 == 1, F.replace(before, F.lit(". "), F.lit(".\n"))), F.replace(F.col("content"), F.lit(". "), F.lit(".\n"))))
    return rewrite.rewritten(turns).select("session_id", "pos", "content", "how")


def q52(spark, d):
    return semantic.sections(_agent_sessions(spark, d).withColumn("tier", F.lit("medium")))


def q54(spark, d):
    return optimize_context(_agent_sessions(spark, d))[0]


def q53(spark, d):
    return optimize_context(src.from_conversations(_r(spark, d, "conversations")))[1]


#: The same text by aggregates, and what its shortener must make of it at 0.85.
_STATUS = """with f as (select source, list('\tmodified:   src/m' || doc_id || '.py' order by doc_id) filter (doc_id % 9 = 1) as m, list('src/m' || doc_id || '.py' order by doc_id) filter (doc_id % 9 = 1) as names,
 list(case doc_id % 9 when 2 then '\tnotes/n' || doc_id || '.txt' else '\ttmp_' || doc_id || '.log' end order by doc_id) filter (doc_id % 9 in (2, 3)) as u, list('notes/n' || doc_id || '.txt' order by doc_id) filter (doc_id % 9 = 2) as notes from documents where source is not null group by 1),
 t as (select *, 'On branch ' || source || '\n' || case when m is null then '' else 'Changes not staged for commit:\n' || array_to_string(m, '\n') || '\n' end || case when u is null then '' else '\nUntracked files:\n' || array_to_string(u, '\n') || '\n' end as text,
 'On branch ' || source || case when m is null then '' when len(m) <= 4 then '\nM: ' || array_to_string(names, ', ') else '\nmodified: ' || len(m) || ' files\n  ' || array_to_string(names[:3], '\n  ') || '\n  ... ' || (len(m) - 3) || ' more' end
 || case when u is null then '' else '\nuntracked: ' || len(u) || case when notes is null then '' else '\n  ' || array_to_string(notes[:2], '\n  ') || case when len(notes) > 2 then '\n  ... ' || (len(notes) - 2) || ' more' else '' end end end as short from f)
 select source, length(text) as chars, case when length(short) < length(text) then short else text end as content, 'git' as strategy, length(short) < length(text) as compressed from t"""

_CATALOG = """with p as (select p_type, p_name, '{"name":"' || p_name || '","description":"' || p_type || '. ' || repeat('More about it. ', 12) || '","inputSchema":{"type":"object","properties":{"query":{"type":"string","description":"what to find"},"size":{"type":"integer","description":"' || p_type || '"}}}}' as j, count(*) over (partition by p_type) as n from part)
 select p_type as catalog_id, count(*) as tools, sum(length(j))::bigint as full_chars, (sum(length(case when n < 50 then p_name || '(query, size): ' || p_type || '.' when n < 100 then p_name || '(query, size)' else p_name end)) + count(*) - 1)::bigint as catalog_chars from p group by 1"""

_WEIGHTS = """with i as (select o_orderkey, ['critical', 'high', 'medium', 'low', 'redundant', 'discardable'][o_orderkey % 6 + 1] as tier, (o_orderkey % 10) / 10.0::double as bm25, ['code', 'text', 'log'][o_orderkey % 3 + 1] as kind,
 trim(['src/a.py', 'notes.md', 'user', 'README', 'lib\\b.go', 'x.cs ', '', 'docs/guide.txt'][o_orderkey % 8 + 1]) as source, o_orderpriority || case when o_orderkey % 7 = 0 then ' job Failed' else '' end || ' ' || repeat('x', (o_orderkey % 50)::int) as content from orders),
 a as (select *, case tier when 'critical' then 0.55 when 'redundant' then 0.9 when 'discardable' then 0.95 else 0.85 end::double as own from i)
 select o_orderkey, tier, round(case when bm25 < 0.1 and tier not in ('critical', 'high') then least(0.95, own + 0.15) when bm25 > 0.5 then greatest(0.15, own - 0.1) else own end, 4) as aggressiveness,
 case tier when 'critical' then 10.0 when 'high' then 3.0 when 'low' then -2.0 when 'redundant' then -5.0 when 'discardable' then -10.0 else 0.0 end::double as boost,
 case tier when 'critical' then 1000.0 when 'high' then 10.0 when 'medium' then 3.0 when 'low' then 1.0 else 0.0 end::double as value, greatest(1, length(content) // 4)::bigint as quick_tokens,
 kind in ('code', 'text') and source in ('src/a.py', 'lib\\b.go', 'x.cs', 'docs/guide.txt') as is_file_read, case when o_orderkey % 7 = 0 then 5.0 else 0.0 end::double as error_boost,
 '[dropped:msg_' || o_orderkey || '|' || greatest(1, floor(length(content) / 3.3)::int) || 'tok|knapsack]' as stub from a"""

_SEGMENTS = r"""with l as (select page_id, unnest(z) as line, generate_subscripts(z, 1) as pos from (select page_id, string_split_regex(regexp_replace(replace(html, '><', '>' || chr(10) || '{<'), '\r?\n$', ''), '\r?\n') as z from pages)),
 k as (select *, case when line like 'diff --git%' or line like '@@%' then 'diff' when regexp_matches(line, '^\s*[\{\[]') then 'json' when regexp_matches(line, '(ERROR|Traceback|FAILED|\d{4}-\d{2}-\d{2})') then 'log' when regexp_matches(line, '^(def |class |import |function )') then 'code' end as kind from l),
 b as (select *, last_value(kind ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and 1 preceding) as before from k),
 s as (select *, sum(case when kind is not null and before is not null and kind <> before then 1 else 0 end) over (partition by page_id order by pos)::bigint as segment from b)
 select page_id, segment, coalesce(max(kind), 'text') as kind, count(*) as n_lines, (sum(length(line)) + count(*) - 1)::bigint as chars from s group by 1, 2"""

QUERIES = {
    "q01_token_estimate": q01, "q02_content_type": q02, "q03_cli_detect": q03, "q04_segments": q04, "q05_volatile": q05, "q06_tier": q06, "q07_metrics": q07, "q08_bm25": q08, "q09_bm25_topk": q09,
    "q10_recency": q10, "q11_exact_dups": q11, "q12_containment": q12, "q13_repeat_lines": q13, "q14_stale_reads": q14, "q15_grep_coverage": q15, "q16_obsolete": q16, "q17_knapsack": q17, "q18_smart_rows": q18,
    "q19_constants": q19, "q20_severity_samples": q20, "q21_toon": q21, "q22_log_templates": q22, "q23_log_severity": q23, "q24_redact": q24, "q25_tool_shortlist": q25, "q26_risk": q26, "q27_recovery": q27,
    "q28_feedback": q28, "q29_quality": q29, "q30_floors": q30, "q31_net": q31, "q33_floor_failures": q33, "q34_stats": q34, "q35_analysis": q35, "q36_route": q36, "q37_cache": q37, "q38_schema_of": q38, "q44_routed_segments": q44, "q45_code_slices": q45, "q32_item_weights": q32, "q40_compress": q40, "q41_cli_output": q41, "q42_lazy_catalog": q42, "q43_git_status": q43, "q50_rewrite_reads": q50, "q51_cross_turn": q51, "q52_semantic": q52, "q53_optimize_context": q53,
    "q54_optimize_items": q54,
}

SQL_JSON = "(regexp_matches(s, '(?s)^(\\{.*\\}|\\[.*\\])$') and json_valid(s))"
SQL_LOGS = " + ".join(f"({_has('s', p)})::int" for p in detect.LOG)
SQL_TYPE = f"""case when length(s) = 0 then 'text' when contains(s, 'Traceback (most recent call last)') then 'log' when {_cases('s', detect.CLI_TOOLS)} is not null then 'tool_output'
 when {_has('s', '^(On branch |Changes not staged|Untracked files:)')} then 'tool_output' when {SQL_JSON} then 'json' when {_has('s', '^diff --git|^--- a/|^[+]{3} |^@@ -[0-9]+')} then 'diff'
 when {SQL_LOGS} >= 2 or contains(s, 'Traceback') then 'log' when len(regexp_extract_all(s, '(?m)^\\s*at .+\\(')) >= 3 then 'log' when {_has('s', r'^(total [0-9]+|drwx|[-rwx]{10}|[$] |>>> |> )')} then 'terminal'
 when {_has('s', '^[0-9]+:[ \\t]*.+')} and length(s) - length(replace(s, chr(10), '')) > 3 and {_has('s', '^[A-Za-z0-9_./-]+[.](py|ts|js|go|rs|java|rb|tsx|jsx|md):')} then 'search'
 when regexp_matches(s, '^[\\p{{L}}\\p{{N}}_.-]+\\s*[:=]\\s*') and length(s) - length(replace(s, chr(10), '')) > 2 and not {_has('s', '^(def |class |function |import |const |let |var )')} then 'config'
 when {_has('s', detect.CODE[0])} or {_has('s', detect.CODE[1])} then 'code' else 'text' end"""
SQL_COMMANDS = "(select 'run ' || event_id || chr(10) || case event_type " + " ".join(f"when '{k}' then {_quote(v)}" for k, v in COMMANDS.items()) + " end as text from events union all select text from documents)"
SQL_ITEMS = "(select conv_id, turn, coalesce(text, '') as text, role from conversations)"
SQL_LISTW = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '" + WORDS + "'), lambda w: length(w) > 2))"
SQL_STOP = "[" + ", ".join(map(_quote, relevance.QUERY_STOPWORDS)) + "]"
SQL_TIER = f"""(with q as (select conv_id, substr(max_by(text, turn), 1, 300) as query from {SQL_ITEMS} where role = 'user' group by 1),
 w as (select i.*, q.query, list_filter({_sub(SQL_LISTW, "coalesce(q.query, '')")}, lambda x: not list_contains({SQL_STOP}, x)) as terms, {_sub(SQL_LISTW, 'i.text')} as own from {SQL_ITEMS} i left join q using (conv_id)),
 o as (select *, case when len(terms) = 0 then 0.0 else len(list_filter(terms, lambda x: list_contains(own, x))) / len(terms) end as ov, {_sub(SQL_TOK, 'text')} as tok from w)
 select *, case when regexp_matches(text, '{relevance.CRITICAL}') or role = 'system' then 'critical' when coalesce(query, '') <> '' and ov > 0.5 then 'high' when coalesce(query, '') <> '' and ov > 0.2 then 'medium'
 when regexp_matches(text, '{relevance.OBSOLETE}') then 'discardable' else 'medium' end as tier from o)"""
SQL_BM = "[" + ", ".join(map(_quote, ranking.STOPWORDS)) + "]"
SQL_TERMS = "list_filter(list_transform(regexp_extract_all({c}, '[\\p{L}\\p{M}\\p{N}_]+'), lambda w: lower(w)), lambda w: length(w) > 1 and not list_contains(" + SQL_BM + ", w))"


def _bm25_sql(items: str, queries: str, key: str, group: str) -> str:
    """items: key, group, content; queries: group, query."""
    return f"""(with t as (select {key}, {group}, {_sub(SQL_TERMS, 'content')} as ts from {items}), l as (select {key}, {group}, len(ts) as dl, unnest(ts) as term from t),
 tf as (select {key}, {group}, dl, term, count(*) as tf from l group by all), st as (select {group}, count(*) as n, avg(len(ts)) as av from t group by 1), df as (select {group}, term, count(*) as df from tf group by 1, 2),
 q as (select {group}, term, count(*) as qn from (select {group}, unnest({_sub(SQL_TERMS, 'query')}) as term from {queries}) group by 1, 2),
 s as (select tf.{key}, tf.{group}, sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(av, 1)))) as score from tf join q using ({group}, term) join df using ({group}, term) join st using ({group}) group by 1, 2)
 select t.{key}, t.{group}, round(coalesce(score, 0), 6) as score from t left join s using ({key}, {group}))"""


SQL_DOC_BM = _bm25_sql("(select doc_id, lang, text as content from documents)", "(select distinct lang, (select min_by(text, item_id) from benchmark) as query from documents)", "doc_id", "lang")
SQL_NORMED = f"(select lang, doc_id, {_sub(SQL_NORM, 'text')} as t from documents where length({_sub(STRIP, 'text')}) >= 50)"
SQL_LOG = "(select user_id % 50 as session, event_id as pos, '  ' || case when event_type = 'error' then 'ERROR' else 'INFO' end || ' user ' || user_id || ' ' || event_type || ' at /srv/' || event_type || '/x 0xFF' || event_id as line from events)"
SQL_KEY = "substr(regexp_replace(regexp_replace(regexp_replace(trim(line), '\\b[0-9]+\\b', '#', 'g'), '0x[0-9a-fA-F]+', '0x#', 'g'), '/[A-Za-z0-9_./-]+', '/<path>', 'g'), 1, 120)"
SQL_REDACT = "text"
for _p in redact.SECRETS:
    SQL_REDACT = f"regexp_replace({SQL_REDACT}, {_quote(_p)}, '[REDACTED]', 'g')"

_NET = f"""with h as (select *, {_sub(SQL_HASH, 'text')} as h, length({_sub(STRIP, 'text')}) >= 50 as ok from documents), k as (select lang, h, min(doc_id) as keep from h where ok group by 1, 2),
 t as (select source, text, case when ok and doc_id > keep then 'OMIT: d' || doc_id || ' = d' || keep || ' <<ccr:' || substr(sha256(text), 1, 12) || '>>' else text end as z from h left join k using (lang, h)),
 o as (select source, {_sub(SQL_TOK, 'text')} as a, {_sub(SQL_TOK, 'z')} as b, coalesce(list_sum(list_transform(regexp_extract_all(z, '(?m)^(?:O|OMIT):.*$|<<ccr:[0-9a-f]+>>'), lambda x: {_sub(SQL_TOK, 'x')})), 0) as w from t)
 select source, sum(a)::bigint as original, sum(b)::bigint as compressed, sum(w)::bigint as overhead, round((sum(a) - sum(b) - sum(w)) / greatest(sum(a), 1), 6)::double as net from o group by 1"""
_FAILURES = """with r as (select case grouping(o_orderpriority, o_orderstatus) when 3 then 'total' when 1 then 'category' else 'fixture' end as level, case grouping(o_orderpriority, o_orderstatus) when 3 then '' when 1 then o_orderpriority else o_orderstatus end as key, round((sum(o_totalprice) - sum(floor(o_totalprice / 3))) / greatest(sum(o_totalprice), 1), 6)::double as ratio from orders group by grouping sets ((), (o_orderpriority), (o_orderpriority, o_orderstatus))),
 l(level, key, floor) as (values """ + ", ".join(f"('{a}', '{b}', {c}::double)" for a, b, c in LIMITS) + """)
 select level, key, case level when 'total' then 'TOTAL ratio ' when 'category' then 'category ' || key || ': ' else key || ': ' end || printf('%.1f', ratio * 100) || '% below ' || case level when 'total' then 'baseline ' else 'floor ' end || printf('%.1f', floor * 100) || '%' as message from r join l using (level, key) where ratio < floor"""
_ANALYSIS = f"""with i as (select conv_id, turn, text, tier, tok from {SQL_TIER}), n as (select conv_id, turn, {_sub(SQL_NORM, 'text')} as t from i where length({_sub(STRIP, 'text')}) >= 50),
 e as (select conv_id, t, min(turn) as keep from n group by 1, 2), p as (select n.conv_id, keep as a, turn as b from n join e using (conv_id, t) where turn > keep union select a.conv_id, a.turn, b.turn from n a join n b on a.conv_id = b.conv_id and a.turn <> b.turn and length(b.t) >= 40 and contains(a.t, b.t) and (a.t <> b.t or a.turn < b.turn)),
 d as (select p.conv_id, count(*) as duplicates, sum(tok) as redundant from p join i on i.conv_id = p.conv_id and i.turn = p.b group by 1),
 s as (select conv_id, count(*) as items, sum(tok) as tokens, sum(case when tier = 'critical' then tok else 0 end) as critical, sum(case when tier in ('redundant', 'discardable') then tok else 0 end) as discardable, list('msg_' || turn order by turn) filter (tok > {LARGE_TURN}) as big, count(*) filter (tier in ('low', 'discardable')) as low, sum(case when tier in ('low', 'discardable') then tok else 0 end)::bigint as low_n from i group by 1)
 select conv_id, items, tokens::bigint as tokens, critical::bigint as critical, discardable::bigint as discardable, coalesce(redundant, 0)::bigint as redundant, coalesce(duplicates, 0)::bigint as duplicates, concat_ws(chr(10), case when duplicates > 0 then 'Remove ' || duplicates || ' duplicate item(s) (~' || redundant::bigint || ' tokens)' end,
 case when len(big) > 0 then 'Compress ' || len(big) || ' large item(s): ' || array_to_string(big[:5], ', ') end, case when low > 0 then 'Consider dropping ' || low || ' low-relevance items (~' || low_n || ' tokens)' end) as recommendations from s left join d using (conv_id)"""
_SQL_CATALOGS = """(select p_brand || '/' || p_type || '/' || (p_size % 5) as c, p_partkey as pos, p_name as name, p_type as d, '{"name": "' || p_name || '", "description": "' || p_type || '", "size": ' || p_size || '}' as j from part)"""
_ROUTE = f"""with a as {_SQL_CATALOGS}, t as (select * from a where name not like 'red %'), w as (select c, count(*) > count(distinct name) as dup, greatest(1, floor(sum(length(j) + 2) / 3.3))::bigint as full_tokens from t group by 1),
 r as (select *, row_number() over (partition by c order by score desc, pos) as k from {_bm25_sql("(select pos, c, name || ' ' || d as content from t)", "(select c, 'use the ' || max(name) || ' token=abc123' as query from a group by 1)", 'pos', 'c')}),
 z as (select c, list(name order by k) as names, greatest(1, floor(sum(length(j) + 2) / 3.3))::bigint as short_tokens from r join t using (c, pos) where k <= 2 group by 1), o as (select distinct c from a)
 select c as intent_id, case when dup then 'blocked' when dup is null then 'skipped' else 'bm25' end as source, case when not dup then names[1] end as tool_name, case when not dup then array_to_string(names, ', ') end as candidates,
 case when dup or dup is null then null when regexp_matches(lower(names[1]), '{'|'.join(relevance.DESTRUCTIVE)}') then 'destructive' when regexp_matches(lower(names[1]), '{'|'.join(relevance.WRITE)}') then 'write' else 'read' end as risk,
 coalesce(full_tokens, 1)::bigint as full_tokens, case when not dup then short_tokens end as short_tokens, case when not dup then greatest(0, full_tokens - short_tokens) else 0 end::bigint as saved from o left join w using (c) left join z using (c)"""
_CACHE = """with e as (select substr(sha256(text), 1, 32) as key, 1700000000 + doc_id * 4 as created_at, doc_id from documents), l as (select key, max(created_at) as created_at, max_by(doc_id, created_at) as value from e group by 1 order by 2 desc, 1 desc limit 900),
 c as (select '/d' || item_id % 40 || '/f' || item_id * 7 as path, '/d' || item_id % 40 as folder, 1700000000 + item_id * 20 as changed from benchmark)
 select key, created_at, value from l where 1700004000 - created_at <= 3600 and not exists (select 1 from c where changed >= created_at and (path = '/d' || value % 40 || '/f' || value or (value % 3 = 0 and folder = '/d' || value % 40)))"""
_SEGMENT_TEXTS = _SEGMENTS.replace("count(*) as n_lines, (sum(length(line)) + count(*) - 1)::bigint as chars", "string_agg(line, chr(10) order by pos) as content")

ORACLES = {
    "q01_token_estimate": f"select lang, count(*) as n_docs, sum(t)::bigint as sum_tokens, max(t)::bigint as max_tokens, round(avg(t), 6) as avg_tokens, round(sum(t) * 3.0 / 1e6, 6)::double as cost from (select lang, {_sub(SQL_TOK, 'text')} as t from documents) group by 1",
    "q02_content_type": f"select of, {SQL_TYPE} as content_type, count(*) as n from (select of, {_sub(STRIP, 'text')} as s from (select 'documents' as of, text from documents union all select 'pages', html from pages union all select 'events', props from events)) group by 1, 2",
    "q03_cli_detect": f"select {_cases('text', detect.CLI_TOOLS)} as cli, {_cases('text', detect.RUNNERS)[:-4]} when {_has('text', detect.PLAYWRIGHT)} and contains(lower(text), 'playwright') then 'playwright' end as runner, {_cases('text', detect.SHELL)[:-4]} when length(text) - length(replace(text, ':', '')) > 5 and {_has('text', '^[^ ]+[.](py|ts|js|go|rs):[0-9]+:')} then 'grep' end as shell, count(*) as n from {SQL_COMMANDS} group by 1, 2, 3",
    "q05_volatile": "select type, sum((n > 0)::int)::bigint as texts, sum(n)::bigint as found from (select unnest([" + ", ".join(f"{{'type': '{k}', 'n': len(regexp_extract_all(text, {_quote(p)}))}}" for k, p in detect.VOLATILE) + "], recursive := true) from (select html as text from pages union all select strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' session_id=' || user_id || ' ' || props from events)) where n > 0 group by 1",
    "q06_tier": f"select conv_id, turn, tier, round(ov, 6) as overlap from {SQL_TIER}",
    "q07_metrics": f"select case grouping(role, content_type) when 3 then 'all' when 1 then 'source' else 'type' end as level, coalesce(role, content_type, '') as key, sum(tok)::bigint as tokens, count(*) as items, sum(case when tier = 'critical' then tok else 0 end)::bigint as critical from (select *, 'message' as content_type from {SQL_TIER}) group by grouping sets ((), (role), (content_type))",
    "q08_bm25": f"select doc_id, lang, score from {SQL_DOC_BM}",
    "q09_bm25_topk": f"select * from (select lang, doc_id, score, row_number() over (partition by lang order by score desc, doc_id) as rank from {SQL_DOC_BM}) where rank <= 10",
    "q10_recency": "select event_id, round(exp(-0.693 * ((epoch_us(timestamp '2024-06-01 00:00:00') - epoch_us(ts)) / 3.6e9) / 24), 6) as recency, case when regexp_matches(event_type, '(?i)(error|exception|traceback|failed)') then 5.0 else 0.0 end::double as error_boost from events",
    "q11_exact_dups": f"with h as (select lang, doc_id, {_sub(SQL_HASH, 'text')} as h from documents where length({_sub(STRIP, 'text')}) >= 50), k as (select lang, h, min(doc_id) as keep from h group by 1, 2) select lang, keep, doc_id as dup from h join k using (lang, h) where doc_id > keep",
    "q12_containment": f"with n as (select * from {SQL_NORMED}) select a.lang, a.doc_id as outer, b.doc_id as inner from n a join n b on a.lang = b.lang and a.doc_id <> b.doc_id and length(b.t) >= 40 and contains(a.t, b.t) and (a.t <> b.t or a.doc_id < b.doc_id)",
    "q32_item_weights": _WEIGHTS,
    "q42_lazy_catalog": _CATALOG,
    "q04_segments": _SEGMENTS,
    "q43_git_status": _STATUS,
    "q13_repeat_lines": f"select sha256({_sub(STRIP, 'line')}) as line_hash, count(distinct doc_id) as items, count(*) as lines from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where length({_sub(STRIP, 'line')}) >= 4 group by 1 having count(*) > 1",
    "q14_stale_reads": "select conv_id, turn, max(turn) over (partition by conv_id, role) as last_turn, turn < max(turn) over (partition by conv_id, role) as is_stale from conversations",
    "q16_obsolete": "select event_id, '[obsolete note: ' || substr(trim(regexp_replace(c, '\\s+', ' ', 'g')), 1, 80) || ']' as stub from (select event_id, case when event_type = 'view' then 'deprecated:  ' else '' end || event_type || '  ' || props as c from events) where regexp_matches(c, '" + relevance.OBSOLETE + "')",
    "q17_knapsack": f"with recursive i as (select conv_id, turn, greatest(1, {_sub(SQL_TOK, 'text')}) as w, (length(text) % 17 + 1)::double as v, row_number() over (partition by conv_id order by turn) as k, floor(sum({_sub(SQL_TOK, 'text')}) over (partition by conv_id) * 0.5) as b from {SQL_ITEMS}), r as (select distinct conv_id, 0::bigint as k, 0::hugeint as w, 0::double as v, b from i union all select r.conv_id, i.k, r.w + i.w * t, r.v + i.v * t, r.b from r join i on i.conv_id = r.conv_id and i.k = r.k + 1, (values (0), (1)) x(t) where r.w + i.w * t <= r.b) select conv_id, max(v) as value from r group by 1",
    "q18_smart_rows": "select o_custkey, o_orderkey, score from (select *, row_number() over (partition by o_custkey order by score desc, place) as r from (select o_custkey, o_orderkey, place, round(case when place = 1 then 100.0 else 0 end + case when place = n then 100.0 else 0 end + case when n >= 3 and sd * sd >= 1e-9 and abs(o_totalprice - m) / sd > 2 then abs(o_totalprice - m) / sd * 5 else 0 end, 6)::double as score from (select *, row_number() over (partition by o_custkey order by o_orderkey) as place, count(*) over w as n, avg(o_totalprice) over w as m, stddev_pop(o_totalprice) over w as sd from orders window w as (partition by o_custkey)))) where r <= 5",
    "q19_constants": " union all ".join(f"select l_orderkey, '{c}' as \"column\", min({c}) as value from lineitem group by 1 having count(*) > 1 and count(distinct {c}) = 1" for c in ("l_returnflag", "l_linestatus")),
    "q20_severity_samples": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by case when event_type = 'error' then 1 else 50 end, event_id) as r from (select *, row_number() over (partition by user_id, event_type order by event_id) as f from events) where f = 1) where r <= 2",
    "q21_toon": "select n_regionkey, '# TOON ' || count(*) || ' rows' || chr(10) || 'n_nationkey' || chr(9) || 'n_name' || chr(10) || string_agg(n_nationkey || chr(9) || n_name, chr(10) order by n_nationkey) as toon from nation group by 1",
    "q22_log_templates": f"with k as (select session, pos, trim(line) as line, {SQL_KEY} as template, count(*) over (partition by session) as s from {SQL_LOG}) select session, template, count(*) as n, min(pos) as first_pos, '[×' || count(*) || '] ' || case when length(min_by(line, pos)) > 100 then substr(min_by(line, pos), 1, 97) || '...' else min_by(line, pos) end as shown from k where s >= 6 group by 1, 2 having count(*) >= 3",
    "q23_log_severity": f"select session, case when contains(line, 'ERROR') or contains(line, 'error') then 'error' else 'info' end as severity, count(*) as n from {SQL_LOG} group by 1, 2",
    "q24_redact": f"select doc_id, len(regexp_extract_all(r, '\\[REDACTED\\]'))::bigint as n, sha256(r) as digest from (select doc_id, {SQL_REDACT} as r from documents)",
    "q25_tool_shortlist": f"with t as (select p_partkey as pos, {_sub(SQL_TERMS, "(p_name || ' ' || p_type)")} as ts from part), tf as (select pos, dl, term, count(*) as tf from (select pos, len(ts) as dl, unnest(ts) as term from t) group by all), st as (select count(*) as n, greatest(avg(len(ts)), 1) as av from t), df as (select term, count(*) as df from tf group by 1), q as (select intent_id, term, count(*) as qn from (select p_type as intent_id, unnest({_sub(SQL_TERMS, 'p_type')}) as term from (select distinct p_type from part)) group by 1, 2), s as (select intent_id, pos, round(sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6) as score from q join df using (term) join tf using (term) cross join st group by 1, 2 union all select p_type, pos, 0.0 from (select distinct p_type from part), (select pos from t order by pos limit 8)), m as (select intent_id, pos, max(score)::double as score from s group by 1, 2) select * from (select *, row_number() over (partition by intent_id order by score desc, pos) as rank from m) where rank <= 8",
    "q26_risk": f"select case when regexp_matches(lower(p_name), '{'|'.join(relevance.DESTRUCTIVE)}') then 'destructive' when regexp_matches(lower(p_name), '{'|'.join(relevance.WRITE)}') then 'write' else 'read' end as risk, count(*) as n from part group by 1",
    "q27_recovery": "select alive, count(*) as n, min(handle) as first_handle from (select substr(sha256(text), 1, 12) as handle, 1700003600 - max(1700000000 + doc_id * 4) <= 1800 as alive from documents group by 1) group by 1",
    "q28_feedback": "with r as (select 'u' || user_id as source, event_id as seq, case when event_type = 'error' then 0.0 else (event_id % 10) / 10 end::double as ratio from events), k as (select *, row_number() over (partition by source, ratio > 0 order by seq desc) as n from r), s as (select source, count(*) as attempts, sum((ratio > 0)::int) / count(*) as rate, coalesce(avg(case when ratio > 0 and n <= 50 then ratio end), 0) as av from k group by 1) select source, attempts, round(rate, 6) as success_rate, round(av, 6) as avg_ratio, round(case when attempts < 3 then 0.85 when rate > 0.7 and av > 0.3 then 1.0 when rate < 0.2 then 0.65 else 0.85 end, 6)::double as suggested from s",
    "q29_quality": f"select doc_id, round((contains(lower(text), lower(lang))::int + contains(lower(text), 'the')::int + (contains(text, z) or contains(regexp_replace(text, '{SPACE}', '', 'g'), regexp_replace(z, '{SPACE}', '', 'g')))::int + (contains(text, 'no such text') or contains(regexp_replace(text, '{SPACE}', '', 'g'), 'nosuchtext'))::int + regexp_matches(text, '[0-9]{{3,}}')::int + regexp_matches(text, '(?i)licen[cs]e')::int) / 6, 6)::double as score from (select *, string_split(text, chr(10))[-1] as z from documents)",
    "q15_grep_coverage": f"with g as (select item_id, item_id as d, {_sub(STRIP, 'text')} as x from benchmark where text <> '' union all select doc_id + 1000000, doc_id, {_sub(STRIP, 'regexp_extract(text, $$^[^\\n]*$$)')} from documents) select item_id, count(*) as matches, bool_and(coalesce(contains(text, x), false)) as covered from g left join documents on doc_id = d group by 1",
    "q30_floors": "select case grouping(o_orderpriority, o_orderstatus) when 3 then 'total' when 1 then 'category' else 'fixture' end as level, case grouping(o_orderpriority, o_orderstatus) when 3 then '' when 1 then o_orderpriority else o_orderstatus end as key, count(*) as n, round((sum(o_totalprice) - sum(floor(o_totalprice / 3))) / greatest(sum(o_totalprice), 1), 6)::double as ratio from orders group by grouping sets ((), (o_orderpriority), (o_orderpriority, o_orderstatus))",
    "q31_net": _NET,
    "q33_floor_failures": _FAILURES,
    "q34_stats": f"select doc_id, t::bigint as tokens, length(text)::bigint as chars, round(t * 3.0 / 1e6, 9)::double as cost from (select doc_id, coalesce(text, '') as text, {_sub(SQL_TOK, "coalesce(text, '')")} as t from documents)",
    "q35_analysis": _ANALYSIS,
    "q36_route": _ROUTE,
    "q37_cache": _CACHE,
    "q38_schema_of": f"""with t as {_SQL_CATALOGS}, k as (select c, max(pos) as at from t group by 1 order by 2 desc, 1 limit 100), a as (select distinct c, name from t union all select distinct c, upper(name) from t where name like 'red %')
 select a.c as session_id, a.name, min_by(j, pos) as schema_json from a left join (select t.* from t join k using (c)) t on t.c = a.c and t.name = a.name group by 1, 2""",
    "q44_routed_segments": f"select page_id, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by segment) as content, string_agg('none', ',') as strategies from ({_SEGMENT_TEXTS}) group by 1",
}
