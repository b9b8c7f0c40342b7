"""BM25 within a session, and selection under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxengine.functions.relevance import tier_value

#: Parameters of BM25, and words that are no terms.
K1, B = 1.5, 0.75
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might must can could of in to for on with at by from as into "
    "through during before after and or but not no nor so yet both either neither each every all any few more most other some such than too very just also"
).split()
WORD = r"(?U)\b\w+\b"


def terms(text: Column) -> Column:
    """Lower-case words of two characters or more that are no stopwords, repeats included."""
    found = F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), F.lower)
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def bm25(items: DataFrame, queries: DataFrame, key: list[str], session: list[str]) -> DataFrame:
    """key, score: BM25 of items (key, session columns, content) for their session's query.

    queries: session columns, task_query. A term that the query repeats counts as often. Items
    without any of its terms have score 0. Only terms of the query are counted after the
    shuffle: documents meet them by (session, term), and one aggregate gives all lengths."""
    of = items.select(*dict.fromkeys([*session, *key]), terms(F.col("content")).alias("__t")).withColumn("__dl", F.size("__t"))
    stats = of.groupBy(*session).agg(F.count(F.lit(1)).alias("__n"), F.avg("__dl").alias("__avg"))
    asked = queries.select(*session, F.explode(terms(F.col("task_query"))).alias("__term")).groupBy(*session, "__term").agg(F.count(F.lit(1)).alias("__q"))
    wanted = asked.groupBy(*session).agg(F.collect_set("__term").alias("__wanted"))
    near = of.join(wanted, session).withColumn("__t", F.filter("__t", lambda w: F.array_contains(F.col("__wanted"), w)))
    tf = near.select(*dict.fromkeys([*session, *key]), "__dl", F.explode("__t").alias("__term")).groupBy(*dict.fromkeys([*session, *key]), "__dl", "__term").agg(F.count(F.lit(1)).alias("__tf"))
    df = tf.groupBy(*session, "__term").agg(F.count(F.lit(1)).alias("__df"))
    weighted = asked.join(df, [*session, "__term"]).join(stats, session)
    idf = F.log((F.col("__n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5) + 1)
    weighted = weighted.select(*session, "__term", (idf * F.col("__q")).alias("__w"), "__avg")
    part = F.col("__w") * F.col("__tf") * (K1 + 1) / (F.col("__tf") + K1 * (1 - B + B * F.col("__dl") / F.greatest(F.col("__avg"), F.lit(1.0))))
    scores = tf.join(weighted, [*session, "__term"]).groupBy(*dict.fromkeys([*session, *key])).agg(F.sum(part).alias("score"))
    return items.select(*dict.fromkeys([*session, *key])).join(scores, list(dict.fromkeys([*session, *key])), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def top(scores: DataFrame, session: list[str], order: list[Column], k: int) -> DataFrame:
    """The k best rows of each session."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*session).orderBy(*order))).where(F.col("rank") <= k)


def best_subset(tokens: list[int], values: list[float], pinned: list[bool], excluded: list[bool], budget: int) -> list[int]:
    """Places of the items that fit the budget with the most value; pinned ones always stay.

    Exact over weights of at least 1; equal values keep the earlier choice. Budgets left
    beyond 50,000 are filled by value for each token."""
    import numpy as np

    keep = [i for i, p in enumerate(pinned) if p]
    if budget <= 0:
        return keep
    free = [i for i in range(len(tokens)) if not pinned[i] and not excluded[i] and values[i] > 0]
    left = budget - sum(max(1, tokens[i]) for i in keep)
    if left <= 0:
        return keep
    if left > 50_000:
        for i in sorted(free, key=lambda i: -values[i] / max(1, tokens[i])):
            if max(1, tokens[i]) <= left:
                keep.append(i)
                left -= max(1, tokens[i])
        return sorted(keep)
    best = np.zeros(left + 1)
    took = np.zeros((len(free), left + 1), bool)
    for k, i in enumerate(free):
        w = max(1, tokens[i])
        if w <= left:
            new = best[: left + 1 - w] + values[i]
            took[k, w:] = new > best[w:]
            best[w:] = np.where(took[k, w:], new, best[w:])
    for k in range(len(free) - 1, -1, -1):
        if took[k, left]:
            keep.append(free[k])
            left -= max(1, tokens[free[k]])
    return sorted(keep)


def hybrid_budget(budget: int, items: Column, total: Column) -> Column:
    """What a session of so many items and tokens is cut to; null where all of it stays.

    Fixed values: sessions under 0.8 of the budget stay (0.6 from 15 items on), unless they have 8
    items and 0.01 of the budget or more, which are cut to 0.72; others to 0.95 of the budget."""
    threshold = F.when(items >= 15, F.lit(int(budget * 0.6))).otherwise(int(budget * 0.8))
    small = (items >= 8) & (total >= int(budget * 0.01))
    return F.when(total > threshold, F.lit(int(budget * 0.95))).when(small, F.floor(total * 0.72)).cast("long")


def select(items: DataFrame, budget_share: float | None = 0.5, budget: int | None = None, hybrid: bool = False) -> DataFrame:
    """items (session_id, pos, token_count, tier, score) with `kept`: what a session's budget holds.

    The budget is stated, a share of the session, or none. One group is one session; sessions are
    bounded by what a context window holds."""
    if budget is None and budget_share is None:
        return items.withColumn("kept", F.lit(True))
    own = Window.partitionBy("session_id")
    total = F.sum(F.col("token_count").cast("long")).over(own)
    if budget is None:
        most = F.floor(total * budget_share).cast("long")
    else:
        most = hybrid_budget(budget, F.count(F.lit(1)).over(own), total) if hybrid else F.lit(budget).cast("long")
    rows = items.select("session_id", "pos", "token_count", "tier", "score", F.coalesce(most, F.lit(-1)).alias("__most"))

    def run(pdf):
        pdf = pdf.sort_values("pos")
        most = int(pdf["__most"].iloc[0])
        at = set(range(len(pdf))) if most < 0 else set(best_subset(pdf["token_count"].tolist(), pdf["score"].tolist(), (pdf["tier"] == "critical").tolist(), pdf["tier"].isin(["redundant", "discardable"]).tolist(), most))
        return pdf.assign(kept=[i in at for i in range(len(pdf))])[["session_id", "pos", "kept"]]

    kinds = dict(items.dtypes)
    chosen = rows.groupBy("session_id").applyInPandas(run, f"session_id {kinds['session_id']}, pos {kinds['pos']}, kept boolean")
    return items.join(chosen, ["session_id", "pos"])


def default_value(t: Column) -> Column:
    return tier_value(t)


def dropped_stub(ident: Column, tokens: Column) -> Column:
    return F.concat(F.lit("[dropped:"), ident, F.lit("|"), tokens.cast("string"), F.lit("tok|knapsack]"))
