"""Token estimates and cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token outside East Asian scripts; prices for a million tokens.
CHARS_PER_TOKEN, COST_IN, COST_OUT = 3.3, 3.0, 15.0
EAST_ASIAN = "[一-鿿぀-ヿ]"


def estimate(c: Column) -> Column:
    """0 of no text, else at least 1: other characters / 3.3, rounded down, and East Asian ones."""
    east = F.length(c) - F.length(F.regexp_replace(c, EAST_ASIAN, ""))
    rest = F.floor((F.length(c) - east) / F.lit(CHARS_PER_TOKEN))
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), (rest + east).cast("int"))).cast("int")


def quick_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def cost(tokens_in: Column, tokens_out: Column, price_in: float = COST_IN, price_out: float = COST_OUT) -> Column:
    return (tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) / F.lit(1e6)


def vocabulary_counter(path: str):
    """An Arrow function text -> exact number of tokens by a tokenizer file."""

    @F.pandas_udf("int")
    def count(texts):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return texts.fillna("").map(lambda t: len(own.encode(t, add_special_tokens=False).ids))

    return count


def counter(path: str | None = None):
    """text -> tokens: exact by a tokenizer file, else the estimate."""
    return estimate if path is None else vocabulary_counter(path)
