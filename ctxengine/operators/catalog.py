"""Tool catalogs: filter, shortlist, lazy signatures; and tables of state and measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxengine.functions import relevance, tokens
from ctxengine.functions.redact import minimize
from ctxengine.functions.text import content_hash
from ctxengine.operators.ranking import K1, B, terms, top


def filter_catalog(tools: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None, reserved: list[str] = ()) -> DataFrame:
    """Tools that may be routed to: named, not denied, allowed, and of a name that is theirs alone.

    Descriptions are cut at 240 characters."""
    ok = tools.where(F.coalesce("name", F.lit("")) != "")
    if deny or reserved:
        ok = ok.where(~F.col("name").isin(*[*(deny or []), *reserved]))
    if allow is not None:
        ok = ok.where(F.col("name").isin(*allow))
    copies = F.count(F.lit(1)).over(Window.partitionBy("catalog_id", "name"))
    return ok.withColumn("__n", copies).where("__n = 1").drop("__n").withColumn("description", F.substring(F.coalesce("description", F.lit("")), 1, 240))


def shortlist(intents: DataFrame, tools: DataFrame, k: int = 8) -> DataFrame:
    """intent_id, pos, score, rank: for each intent its catalog's k best tools by BM25.

    intents: intent_id, catalog_id, intent. tools: catalog_id, pos, name, description. Intents
    meet tools by their terms; where fewer than k tools share one, the first tools of the
    catalog follow with score 0."""
    k = max(1, k)
    docs = tools.select("catalog_id", "pos", terms(F.concat_ws(" ", "name", F.substring("description", 1, 200))).alias("t")).withColumn("dl", F.size("t"))
    stats = docs.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("av"))
    tf = docs.select("catalog_id", "pos", "dl", F.explode("t").alias("term")).groupBy("catalog_id", "pos", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("catalog_id", "term").agg(F.count(F.lit(1)).alias("df"))
    asked = intents.select("intent_id", "catalog_id", F.explode(terms(F.col("intent"))).alias("term")).groupBy("intent_id", "catalog_id", "term").agg(F.count(F.lit(1)).alias("q"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("q") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("av")))
    scores = asked.join(df, ["catalog_id", "term"]).join(stats, "catalog_id").join(tf, ["catalog_id", "term"]).groupBy("intent_id", "pos").agg(F.round(F.sum(part), 6).alias("score"))
    first = top(tools.select("catalog_id", "pos"), ["catalog_id"], [F.col("pos")], k)
    rest = intents.select("intent_id", "catalog_id").join(first, "catalog_id").select("intent_id", "pos", F.lit(0.0).alias("score"))
    both = scores.unionByName(rest).groupBy("intent_id", "pos").agg(F.max("score").alias("score"))
    return top(both, ["intent_id"], [F.desc("score"), F.col("pos")], k)


def allow_execute(by_model: Column, confidence: Column, risk: Column) -> Column:
    """Only a model's pick runs by itself: from .5 on to read, from .75 on to write."""
    return by_model & F.when(risk == "read", confidence >= 0.5).when(risk == "write", confidence >= 0.75).otherwise(F.lit(False))


def _weight(text: str) -> tuple[Column, Column]:
    """Sums of characters and of East Asian ones, with the separators and brackets of a list."""
    east = F.length(text) - F.length(F.regexp_replace(text, tokens.EAST_ASIAN, ""))
    return F.sum(F.length(text) + 2), F.sum(east)


def _tokens(chars: Column, east: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((chars - east) / F.lit(tokens.CHARS_PER_TOKEN)) + east).cast("long")


def route(intents: DataFrame, tools: DataFrame, k: int = 8, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """intent_id, source, tool_name, candidates, risk, full_tokens, short_tokens, saved, route_key, allow_execute.

    intents: intent_id, catalog_id, intent. tools: catalog_id, pos, name, description, schema_json
    (a tool as the model would see it). A catalog that gives two tools one name is blocked, one
    without tools skipped; else the best tools by BM25 stay, and the first is the pick. Ranks never
    run a tool by themselves. route_key is equal where the intent without secrets and all tools are.
    Tokens are those of the tools' list, by sums, so that no catalog is put together as a text."""
    named = tools.where(F.coalesce("name", F.lit("")) != "")
    if deny:
        named = named.where(~F.col("name").isin(*deny))
    if allow is not None:
        named = named.where(F.col("name").isin(*allow))
    mark = F.sha2(F.to_json(F.struct("name", F.substring("description", 1, 240).alias("d"), F.sha2("schema_json", 256).alias("s"))), 256)
    chars, east = _weight("schema_json")
    whole = named.withColumn("m", F.conv(F.substring(mark, 1, 15), 16, 10).cast("decimal(38,0)")).groupBy("catalog_id").agg(chars.alias("c"), east.alias("e"), F.sum("m").alias("m"), (F.count(F.lit(1)) > F.countDistinct("name")).alias("double"))
    whole = whole.select("catalog_id", "m", "double", _tokens(F.col("c"), F.col("e")).alias("full_tokens"))
    asked = intents.join(whole, "catalog_id", "left")
    usable = named.join(whole.where("not double").select("catalog_id"), "catalog_id", "left_semi")
    # An intent of a catalog without usable tools has no shortlist.
    best = shortlist(asked.where("not double").select("intent_id", "catalog_id", "intent"), usable, k).join(intents.select("intent_id", "catalog_id"), "intent_id")
    chars, east = _weight("schema_json")
    best = best.join(usable, ["catalog_id", "pos"]).groupBy("intent_id").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("z"), chars.alias("c"), east.alias("e"))
    rows = asked.join(best, "intent_id", "left").withColumn("short_tokens", F.when(F.col("z").isNotNull(), _tokens(F.col("c"), F.col("e"))))
    source = F.when(F.col("double"), "blocked").when(F.col("z").isNull(), "skipped").otherwise("bm25")
    name = F.try_element_at("z", F.lit(1))["name"]
    key = F.substring(F.sha2(F.concat_ws("|", minimize(F.col("intent")), F.col("m").cast("string")), 256), 1, 32)
    return rows.select(
        "intent_id", source.alias("source"), name.alias("tool_name"), F.array_join(F.transform("z", lambda x: x["name"]), ", ").alias("candidates"), F.when(name.isNotNull(), relevance.risk(name)).alias("risk"),
        F.coalesce("full_tokens", F.lit(1)).cast("long").alias("full_tokens"), "short_tokens", F.greatest(F.lit(0), F.col("full_tokens") - F.col("short_tokens")).cast("long").alias("saved"), key.alias("route_key"), F.lit(False).alias("allow_execute"),
    )


def schema_of(tools: DataFrame, asked: DataFrame, sessions: int = 100) -> DataFrame:
    """asked (session_id, name) with schema_json: the session's first tool of the name, else null.

    tools: session_id, pos, name, schema_json, stored_at. Only the newest sessions are kept."""
    kept = tools.groupBy("session_id").agg(F.max("stored_at").alias("at")).orderBy(F.desc("at"), "session_id").limit(sessions)
    own = tools.join(kept.select("session_id"), "session_id", "left_semi").groupBy("session_id", "name").agg(F.min_by("schema_json", "pos").alias("schema_json"))
    return asked.join(own, ["session_id", "name"], "left")


def cached(entries: DataFrame, changes: DataFrame, as_of: Column, ttl: int = 3600, most: int = 10_000) -> DataFrame:
    """key, created_at, value: what a cache still gives: the newest entry of each key, of the newest
    `most` keys, young enough, and no path it depends on (or file in a directory it depends on)
    changed since.

    entries: key, created_at (long seconds), value, dependencies (array of paths). changes: path, at."""
    last = entries.groupBy("key").agg(F.max("created_at").alias("created_at"), F.max_by(F.struct("value", "dependencies"), "created_at").alias("z"))
    last = last.orderBy(F.desc("created_at"), F.desc("key")).limit(most).where(as_of - F.col("created_at") <= ttl)
    touched = changes.select(F.explode(F.array("path", F.regexp_replace("path", "/[^/]*$", ""))).alias("path"), "at").groupBy("path").agg(F.max("at").alias("at"))
    gone = last.select("key", "created_at", F.explode("z.dependencies").alias("path")).join(touched, "path").where("at >= created_at").select("key")
    return last.join(gone, "key", "left_anti").select("key", "created_at", "z.value")


def recovery(items: DataFrame, as_of: Column, created: str = "created_at", ttl: int = 1800) -> DataFrame:
    """handle, content, created_at, alive: what can still be read back; the newest of a handle."""
    rows = items.select(F.substring(F.sha2("content", 256), 1, 12).alias("handle"), "content", F.col(created).alias("created_at"))
    last = rows.groupBy("handle").agg(F.max_by("content", "created_at").alias("content"), F.max("created_at").alias("created_at"))
    return last.withColumn("alive", F.unix_seconds(as_of) - F.unix_seconds("created_at") <= ttl)


def feedback(outcomes: DataFrame, base: float = 0.85, last: int = 50) -> DataFrame:
    """source, attempts, success_rate, avg_ratio, suggested: how hard to compress a source next.

    outcomes: source, seq, ratio. A ratio over 0 is a success; the mean is of the last 50."""
    rows = outcomes.withColumn("good", F.col("ratio") > 0)
    rank = F.row_number().over(Window.partitionBy("source", "good").orderBy(F.desc("seq")))
    rows = rows.withColumn("rank", rank)
    sums = rows.groupBy("source").agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.col("good").cast("long")).alias("successes"), F.coalesce(F.avg(F.when(F.col("good") & (F.col("rank") <= last), F.col("ratio"))), F.lit(0.0)).alias("avg_ratio"))
    rate = F.col("successes") / F.col("attempts")
    b = F.lit(base)
    suggested = F.when(F.col("attempts") < 3, b).when((rate > 0.7) & (F.col("avg_ratio") > 0.3), F.least(F.lit(1.0), b + 0.15)).when(rate < 0.2, F.greatest(F.lit(0.1), b - 0.2)).otherwise(b)
    return sums.select("source", "attempts", F.round(rate, 6).alias("success_rate"), F.round("avg_ratio", 6).alias("avg_ratio"), F.round(suggested, 6).alias("suggested"))


def resisting(outcomes: DataFrame) -> DataFrame:
    """Sources that two attempts or more saved less than .15 on average."""
    return outcomes.groupBy("source").agg(F.avg("ratio").alias("avg_ratio"), F.count(F.lit(1)).alias("attempts")).where((F.col("avg_ratio") < 0.15) & (F.col("attempts") >= 2))


def handles(items: DataFrame) -> DataFrame:
    return items.select("*", F.substring(F.sha2("content", 256), 1, 12).alias("handle"), content_hash(F.col("content")).alias("hash"))


def quality(text: Column, contain: Column, preserve: Column, match: tuple[str, ...] = ()) -> Column:
    """The share of checks that pass: contained whatever the case; preserved but for white space;
    patterns found anywhere."""
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    a = F.transform(contain, lambda c: F.contains(F.lower(text), F.lower(c)))
    b = F.transform(preserve, lambda c: F.contains(text, c) | F.contains(bare, F.regexp_replace(c, r"(?U)\s+", "")))
    both = F.concat(a, b, F.array(*[text.rlike(p) for p in match]).cast("array<boolean>"))
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.filter(both, lambda x: x)) / F.size(both))


def floors(results: DataFrame, category: str, name: str, original: str, compressed: str) -> DataFrame:
    """level, key, ratio, n: saved share of all, of each category and of each name, in one pass."""
    sums = results.groupingSets([[], [category], [category, name]], category, name).agg(F.sum(original).alias("o"), F.sum(compressed).alias("c"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "category").otherwise("fixture")
    key = F.when(F.col("g") == 3, F.lit("")).when(F.col("g") == 1, F.col(category).cast("string")).otherwise(F.col(name).cast("string"))
    return sums.select(level.alias("level"), key.alias("key"), "n", F.round((F.col("o") - F.col("c")) / F.greatest(F.col("o"), F.lit(1)), 6).alias("ratio"))
