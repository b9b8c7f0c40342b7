"""Rows that all tests of this folder use: real ones of the smallest table, and awkward ones."""

import re

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (9001, None, None, None, None),
    (9002, "", "en", "src0", 0),
    (9003, " \t\n ", "en", "", 4),
    (9004, "word", None, None, 4),
    (9005, "Same text. Same text.\n\nSame text.", "en", "src0", 33),
    (9006, "Same text. Same text.\n\nSame text.", "xx", "src1", 33),
    (9006, "Same text. Same text.\n\nSame text.", "xx", "src1", 33),
    (9007, "a" * 5000 + " " + "b c d " * 3000, "en", "src0", 23001),
    (9008, "\x01\x02 \U0001f600 token = \"abcdef12\" AKIA" + "Z9" * 10 + " api-key: short secret=token = abcdefghi\u00e9", "en", "src2", 90),
    (9009, "password:'x' TOKEN=token=abcdef apikey: " + "0123456789abcdef" * 2 + "g", "en", "src2", 70),
    (None, "nameless words here", "en", "src0", 19),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def docs(spark, n=60):
    return spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") < n).unionByName(odd(spark))


def rows(spark, n=60):
    return [r.asDict() for r in docs(spark, n).collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
