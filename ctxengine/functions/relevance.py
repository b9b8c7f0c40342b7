"""Relevance of items to a task: terms, paths, overlap, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxengine.functions.text import let, strip

#: Words that say nothing in a query, and symbols that say nothing.
QUERY_STOPWORDS = "the and for with from that this when fix bug use not are was has have been into than then".split()
SYMBOL_NOISE = "the and fix bug when with from that this test file src api returns instead flaky special characters".split()
#: What makes an item critical or obsolete.
CRITICAL = r"(?i)(error|exception|traceback|failed|panic|security|password|secret|api[_-]?key|stack trace|assertion|critical|fatal|vulnerability|CVE-\d+)"
OBSOLETE = r"(?i)(deprecated|legacy|old version|no longer used|TODO: remove|FIXME)"
#: Which sources are files.
FILE_PATH = r"(?i)[/\\]|\.(?:py|ts|tsx|js|jsx|go|rs|md|json|yaml|yml|toml|java|rb|php|cs)$"
NOT_FILES = ("user", "system", "assistant", "pytest", "git status", "grep", "notes.md")
#: The order of tiers, and what each adds to a rank.
TIERS = {"critical": 0, "high": 1, "medium": 2, "low": 3, "redundant": 4, "discardable": 5}
TIER_BOOST = {"critical": 10.0, "high": 3.0, "low": -2.0, "redundant": -5.0, "discardable": -10.0}
TIER_VALUE = {"critical": 1000.0, "high": 10.0, "medium": 3.0, "low": 1.0, "redundant": 0.0, "discardable": 0.0}
#: Risk of tools by parts of their names.
DESTRUCTIVE = "delete remove drop destroy rm purge wipe deploy publish push force payment pay transfer send_message email chmod chown grant revoke".split()
WRITE = "write create update edit put patch post upload commit merge apply set add insert".split()


def _map(values: dict, of: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[of], F.lit(default))


def words(text: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\W+", -1), lambda w: F.length(w) > 2))


def _files(query: Column) -> Column:
    return F.regexp_extract_all(F.lower(query), F.lit(r"(?U)[\w./\\-]+\.(?:py|tsx|ts|jsx|js|java|go|rs|rb|md)"), 0)


def _name(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "[^/]*$", 0)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_name(path), r"(?<=.)\.[^.]*$", "")


def query_terms(query: Column) -> tuple[Column, Column]:
    """(words of the query, symbols and words)."""
    files = _files(query)
    parts = F.flatten(F.transform(files, lambda p: F.filter(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), lambda x: F.length(x) > 2)))
    terms = F.array_union(F.array_except(words(query), F.array(*map(F.lit, QUERY_STOPWORDS))), parts)
    symbols = F.array_except(F.regexp_extract_all(F.lower(query), F.lit(r"\b([a-z_][a-z0-9_]{2,})\b"), 1), F.array(*map(F.lit, SYMBOL_NOISE)))
    stems = F.filter(F.transform(files, _stem), lambda x: F.length(x) > 2)
    return terms, F.array_union(F.array_union(symbols, stems), terms)


def path_matches(path: Column, query: Column, terms: Column, symbols: Column) -> Column:
    def named(x: Column) -> Column:
        parts = F.filter(F.split(x["low"], "/"), lambda p: F.length(p) > 2)
        said = F.array_union(F.array_intersect(terms, parts), symbols)
        return x["q"].contains(x["name"]) | x["q"].contains(x["low"]) | F.array_contains(said, x["stem"]) | F.array_contains(said, x["name"])

    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return let(let(low, lambda p: F.struct(p.alias("low"), _name(p).alias("name"), _stem(p).alias("stem"), F.lower(query).alias("q"))), named)


def overlap(content: Column, terms: Column) -> Column:
    """The share of the query's terms that the content has."""
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(terms, words(content))) / F.size(terms))


def is_file_read(source: Column, kind: Column) -> Column:
    path = strip(F.coalesce(source, F.lit("")))
    return (path != "") & ~path.isin(*NOT_FILES) & kind.isin("code", "text") & path.rlike(FILE_PATH)


def path_score(source: Column, kind: Column, content: Column, query: Column, terms: Column, symbols: Column, shared: Column | None = None) -> Column:
    """Null of what is no file read; 1 of a path in the query; else by overlap (shared, if known)."""
    o = overlap(content, terms) if shared is None else shared
    score = F.when(path_matches(strip(source), query, terms, symbols), 1.0).when(o > 0.15, 0.5 + o).otherwise(0.0)
    return F.when(is_file_read(source, kind) & (F.coalesce(query, F.lit("")) != ""), score)


def tier(content, kind, tokens, source, query, terms, symbols, is_error=None, role=None, recency=None, is_duplicate=None) -> Column:
    """The first tier whose test an item passes."""
    no = F.lit(False)
    is_error = no if is_error is None else F.coalesce(is_error, no)
    role = F.lit("") if role is None else F.coalesce(role, F.lit(""))
    recency = F.lit(0.0) if recency is None else F.coalesce(recency, F.lit(0.0))
    is_duplicate = no if is_duplicate is None else F.coalesce(is_duplicate, no)
    asked = F.coalesce(query, F.lit("")) != ""

    def first(x: Column) -> Column:
        score, o = x["score"], x["o"]
        return (
            F.when(content.rlike(CRITICAL) | is_error | role.isin("system", "instruction", "api_contract"), "critical")
            .when(asked & (score >= 1.0), "high")
            .when(asked & (score == 0.0), "low")
            .when(asked & score.isNotNull() & (o < 0.05), "low")
            .when(asked & (o > 0.5), "high")
            .when(asked & (o > 0.2), "medium")
            .when(asked & (o < 0.05) & kind.isin("code", "text") & ~role.isin("system", "instruction", "user"), "low")
            .when(recency > 0.8, "high")
            .when(content.rlike(OBSOLETE) & ~kind.isin("tool_output", "terminal", "log"), "discardable")
            .when(kind.isin("log", "terminal") & (tokens > 3000), "low")
            .when(is_duplicate, "redundant")
            .otherwise("medium")
        )

    scored = let(overlap(content, terms), lambda o: F.struct(o.alias("o"), path_score(source, kind, content, query, terms, symbols, o).alias("score")))
    return let(scored, first)


def tier_boost(t: Column) -> Column:
    return _map(TIER_BOOST, t, 0.0)


def tier_rank(t: Column) -> Column:
    return _map(TIERS, t, 2)


def tier_value(t: Column) -> Column:
    return _map(TIER_VALUE, t, 3.0)


def error_boost(content: Column) -> Column:
    return F.when(content.rlike("(?i)(error|exception|traceback|failed)"), 5.0).otherwise(0.0)


def recency(event_time: Column, as_of: Column) -> Column:
    """Half of it is left after a day; no time has none."""
    hours = (F.unix_micros(as_of) - F.unix_micros(event_time)) / F.lit(3.6e9)
    return F.when(event_time.isNull(), 0.0).otherwise(F.exp(F.lit(-0.693) * hours / 24))


def risk(name: Column, explicit: Column | None = None) -> Column:
    """read, write or destructive: what is stated, else by parts of the name."""
    low = F.lower(name)
    guess = F.when(low.rlike("|".join(DESTRUCTIVE)), "destructive").when(low.rlike("|".join(WRITE)), "write").otherwise("read")
    if explicit is None:
        return guess
    stated = F.lower(explicit)
    return F.when(stated.isin("read", "write", "destructive"), stated).when(F.coalesce(stated, F.lit("")) != "", "destructive").otherwise(guess)


def aggressiveness(t: Column, bm25: Column, base: float = 0.85) -> Column:
    """How hard an item is compressed, by its tier and its rank."""
    b = F.lit(base)
    own = F.when(t == "critical", F.least(F.lit(0.55), b)).when(t == "low", F.least(F.lit(0.85), b + 0.25)).when(t == "redundant", 0.9).when(t == "discardable", 0.95).otherwise(b)
    return F.when((bm25 < 0.1) & ~t.isin("critical", "high"), F.least(F.lit(0.95), own + 0.15)).when(bm25 > 0.5, F.greatest(F.lit(0.15), own - 0.1)).otherwise(own)
