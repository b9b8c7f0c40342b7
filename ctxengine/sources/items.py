"""Context items from messages, files, JSON sessions and tool catalogs, and their sinks.

An item is a row (session_id, pos, id, content, content_type, source); pos is its place in the
session. Every pass keeps (session_id, pos) as the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxengine.functions.detect import content_type

#: Which files of a project are read, and how much of each.
SUFFIXES = ("py", "js", "ts", "tsx", "jsx", "go", "rs", "java", "md", "json", "log")
MOST_CHARS = 500_000
SESSION = "struct<name:string,items:array<struct<id:string,content:string,content_type:string,source:string>>,messages:array<struct<role:string,content:string>>>"


def from_conversations(turns: DataFrame) -> DataFrame:
    """Messages as items: id msg_{turn}, the role is the source."""
    return turns.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("pos"), F.concat(F.lit("msg_"), F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.lit("message").alias("content_type"), F.col("role").alias("source"))


def last_user_message(items: DataFrame) -> DataFrame:
    """session_id, task_query: the last message of the user, 300 characters."""
    return items.where("source = 'user'").groupBy("session_id").agg(F.substring(F.max_by("content", "pos"), 1, 300).alias("task_query"))


def first_user_message(items: DataFrame) -> DataFrame:
    return items.where("source = 'user'").groupBy("session_id").agg(F.substring(F.min_by("content", "pos"), 1, 300).alias("task_query"))


def from_documents(docs: DataFrame, files: int = 64) -> DataFrame:
    """Documents as files of sessions of bounded size: each run of `files` ids is one session."""
    block = F.floor(F.col("doc_id") / files)
    return docs.select(block.alias("session_id"), (F.col("doc_id") - block * files).cast("int").alias("pos"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("content"), F.lit("text").alias("content_type"), F.concat_ws("/", "source", F.concat(F.col("doc_id"), F.lit(".md"))).alias("source"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Every file as a session of one item, `input`, with its detected type."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("session_id"), F.col("value").alias("content"))
    return files.select("session_id", F.lit(0).alias("pos"), F.lit("input").alias("id"), "content", content_type(F.col("content")).alias("content_type"), F.lit("").alias("source"))


def read_project(spark: SparkSession, path: str, suffixes=SUFFIXES) -> DataFrame:
    """Files below a folder, without any below a dotted one; long ones are cut with a mark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("path").rlike(rf"\.({'|'.join(suffixes)})$") & ~F.replace(F.col("path"), F.lit(path)).rlike(r"/\.[^/]"))
    text = F.decode("content", "UTF-8")
    text = F.when(F.length(text) > MOST_CHARS, F.concat(F.substring(text, 1, MOST_CHARS), F.lit("\n[... truncated]"))).otherwise(text)
    rows = files.select(F.lit(path).alias("session_id"), F.col("path").alias("source"), text.alias("content"))
    pos = F.row_number().over(Window.partitionBy("session_id").orderBy("source")) - 1
    return rows.select("session_id", pos.cast("int").alias("pos"), F.col("source").alias("id"), "content", content_type(F.col("content")).alias("content_type"), "source")


def parse_sessions(payloads: DataFrame, bare_messages: bool = True) -> DataFrame:
    """payloads (session_id, text) as items: a list, or an object with items or messages.

    Text that is none gives no items. A bare list of {role, content} is taken as messages, or,
    without bare_messages, as items of unknown type."""
    one = F.from_json("text", SESSION)
    item = "array<struct<id:string,content:string,content_type:string,source:string,role:string>>"
    many = F.from_json("text", item)
    whole = F.coalesce(
        F.when(F.col("text").rlike(r"^\s*\["), F.transform(many, lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content"), x["content_type"].alias("content_type"), x["source"].alias("source"), x["role"].alias("role")))),
        F.transform(one["items"], lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content"), x["content_type"].alias("content_type"), x["source"].alias("source"), F.lit(None).cast("string").alias("role"))),
        F.transform(one["messages"], lambda x: F.struct(F.lit(None).cast("string").alias("id"), x["content"].alias("content"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("string").alias("source"), x["role"].alias("role"))),
    )
    message = F.col("x.role").isNotNull() & (F.lit(bare_messages) | ~F.col("text").rlike(r"^\s*\["))
    rows = payloads.select("session_id", "text", one["name"].alias("name"), F.posexplode(whole).alias("pos", "x"))
    name = F.when(message, F.lit("msg")).otherwise(F.coalesce("name", F.lit("session")))
    return rows.select("session_id", F.col("pos").cast("int").alias("pos"), F.coalesce("x.id", F.concat_ws("_", name, "pos")).alias("id"), F.coalesce("x.content", F.lit("")).alias("content"), F.coalesce("x.content_type", F.when(message, "message").otherwise("unknown")).alias("content_type"), F.coalesce("x.source", F.when(message, F.col("x.role")), F.lit("")).alias("source"))


def parse_tools(payloads: DataFrame) -> DataFrame:
    """payloads (catalog_id, text), a list or {tools: [...]}, as (catalog_id, pos, name, description, schema_json)."""
    inner = F.coalesce(F.get_json_object("text", "$.tools"), F.col("text"))
    each = F.posexplode(F.from_json(inner, "array<string>")).alias("pos", "tool")
    rows = payloads.select("catalog_id", each)
    get = lambda k: F.coalesce(F.get_json_object("tool", f"$.{k}"), F.lit(""))
    return rows.select("catalog_id", "pos", get("name").alias("name"), get("description").alias("description"), F.col("tool").alias("schema_json"))


def write_stats(sessions: DataFrame, path: str) -> None:
    """One JSON object for each session."""
    sessions.select(F.to_json(F.struct(*sessions.columns)).alias("value")).write.mode("overwrite").text(path)


def write_text(items: DataFrame, path: str) -> None:
    items.select(F.col("content").alias("value")).write.mode("overwrite").text(path)
