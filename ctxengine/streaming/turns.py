"""Streams of turns and events: windows of tokens, first copies, read versions with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxengine.functions import tokens
from ctxengine.functions.text import content_hash
from ctxengine.operators.rewrite import Reads

#: How late a row may be; how long a session's reads are remembered (seconds).
LATE, TTL = "1 hour", 1800


def token_windows(turns: DataFrame, width: str = "10 minutes", late: str = LATE) -> DataFrame:
    """window, source, tokens, turns of a stream of turns (event_time, source, content)."""
    own = turns.withWatermark("event_time", late).withColumn("t", tokens.estimate(F.col("content")))
    return own.groupBy(F.window("event_time", width), "source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("turns"))


def session_windows(turns: DataFrame, gap: str = "5 minutes", late: str = LATE) -> DataFrame:
    """One row for each burst of a session's turns."""
    own = turns.withWatermark("event_time", late).withColumn("t", tokens.estimate(F.col("content")))
    return own.groupBy(F.session_window("event_time", gap), "session_id").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("turns"))


def first_copies(turns: DataFrame, late: str = LATE) -> DataFrame:
    """Turns whose normalized content the session did not have within the watermark."""
    own = turns.withWatermark("event_time", late).withColumn("hash", content_hash(F.col("content")))
    return own.dropDuplicatesWithinWatermark(["session_id", "hash"])


def read_versions(reads: DataFrame, ttl: int | None = TTL) -> DataFrame:
    """session_id, pos, source, content, how: each read as a delta of the session's earlier ones.

    A stream of (session_id, pos, source, content); rows of a micro-batch are taken in the order
    of pos. What a session read is forgotten when nothing comes for `ttl` seconds; None keeps it,
    as runs must that end by themselves (a trigger of what is available now waits for timers)."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = Reads()
        if state.exists:
            paths, texts = state.get
            seen.seen = dict(zip(paths, texts, strict=True))
        rows = pd.concat(list(batches)).sort_values("pos")
        out = [(key[0], int(r.pos), r.source, *seen.take(r.source or "", r.content or "")) for r in rows.itertuples()]
        state.update((list(seen.seen), list(seen.seen.values())))
        if ttl is not None:
            state.setTimeoutDuration(ttl * 1000)
        yield pd.DataFrame(out, columns=["session_id", "pos", "source", "content", "how"])

    kind = dict(reads.dtypes)["session_id"]
    out = f"session_id {kind}, pos int, source string, content string, how string"
    return reads.groupBy("session_id").applyInPandasWithState(run, out, "paths array<string>, texts array<string>", "append", GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.ProcessingTimeTimeout)
