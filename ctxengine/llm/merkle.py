"""Document fingerprints: a Merkle tree over sections, paragraphs and the pieces of a paragraph.

Sections end at a blank line, paragraphs at a line's end, pieces behind `.`, `!` or `?` or
after 64 code points. A leaf is the SHA-256 of its piece, an inner node that of its
children's digests, so equal roots mean equal texts.

The fingerprint is the root, `|` and the tree below it. A node is the first digits of its
digest, `.` and its weight; a section goes on with `:` and its paragraphs, divided by `;`, a
paragraph with `=` and its leaves, divided by `,`; sections are divided by `/`. A leaf weighs
its code points, a paragraph or section what is in it and one for its end. Fingerprints are
compared from their roots down: equal branches are not entered, differing ones tell where the
texts differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxengine.llm.shared import written

#: A piece of a paragraph; digits of a node in the fingerprint.
PIECE, DIGITS = r"[^.!?]{1,64}[.!?]*|[.!?]+", 12
#: Rows that a range of documents should hold, and the most ranges there are: of 100 TB, 1.5 GB
#: each, which one task sorts outside its memory.
RANGE_ROWS, RANGES = 2000, 65536


def _leaf(piece: Column) -> Column:
    return F.struct(F.sha2(piece, 256).alias("digest"), F.length(piece).cast("long").alias("weight"))


def _node(children: Column, end: str, between: str, below) -> Column:
    """digest, weight and, as text, what is below a node. children must be a variable of a
    lambda, as any other expression would be computed anew for each of its uses here."""
    digest = F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), "\n"), 256)
    weight = F.aggregate(children, F.lit(1).cast("long"), lambda acc, c: acc + c["weight"])
    return F.struct(digest.alias("digest"), weight.alias("weight"), F.concat(F.lit(end), F.array_join(F.transform(children, below), between)).alias("below"))


def _shown(node: Column) -> Column:
    return F.concat(F.substring(node["digest"], 1, DIGITS), F.lit("."), node["weight"])


def _inner(node: Column) -> Column:
    return F.concat(_shown(node), node["below"])


def fingerprint(text: Column) -> Column:
    """Of a text; null is the empty text."""
    sections = F.split(F.coalesce(text, F.lit("")), "\n\n", -1)
    pieces = F.transform(sections, lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), 0), _leaf)))
    lines = F.transform(pieces, lambda s: F.transform(s, lambda p: _node(p, "=", ",", _shown)))
    parts = F.transform(lines, lambda s: _node(s, ":", ";", _inner))

    def root(nodes):
        return F.concat(F.sha2(F.array_join(F.transform(nodes, lambda n: n["digest"]), "\n"), 256), F.lit("|"), F.array_join(F.transform(nodes, _inner), "/"))

    return F.transform(F.array(parts), root)[0]


def sections(print_: Column) -> Column:
    """The sections of a fingerprint, each with all that is below it."""
    return F.split(F.substring(print_, 66, 2**31 - 1), "/", -1)


def _below(nodes: Column, end: str, between: str) -> Column:
    """All children of some nodes; a node without any has none."""
    return F.filter(F.flatten(F.transform(nodes, lambda n: F.split(F.substring_index(n, end, -1), between, -1))), lambda x: x != "")


def _weight(nodes: Column, end: str) -> Column:
    return F.aggregate(nodes, F.lit(0).cast("long"), lambda acc, n: acc + F.substring(F.substring_index(n, end, 1), DIGITS + 2, 20).cast("long"))


def compared(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """rows with the column `name`: how alike the fingerprints a and b are, 1 for equal roots and
    less for all others.

    Below differing nodes, those children that both sides have are equal branches, and only
    the others are entered; a branch that a side repeats counts once. What is shared is the
    weight of equal branches, twice, over that and the weight of all that differs: leaves, and
    one for each inner node that was entered, the root among them."""
    kept = rows.columns
    x, y = f"{name}_a", f"{name}_b"
    rows = rows.withColumn(x, sections(F.col(a))).withColumn(y, sections(F.col(b)))
    shared, differ = F.lit(0).cast("long"), F.lit(2).cast("long")
    for depth, (end, between) in enumerate(((":", ";"), ("=", ","), (",", None))):
        rows = rows.withColumn(f"{name}_same", F.array_intersect(x, y)).withColumn(f"{name}_x", F.array_except(x, y)).withColumn(f"{name}_y", F.array_except(y, x))
        rows = rows.withColumn(f"{name}_shared{depth}", _weight(F.col(f"{name}_same"), end))
        if between:
            rows = rows.withColumn(f"{name}_differ{depth}", (F.size(f"{name}_x") + F.size(f"{name}_y")).cast("long"))
            rows = rows.withColumn(x, _below(F.col(f"{name}_x"), end, between)).withColumn(y, _below(F.col(f"{name}_y"), end, between))
        else:
            rows = rows.withColumn(f"{name}_differ{depth}", _weight(F.col(f"{name}_x"), end) + _weight(F.col(f"{name}_y"), end))
        shared, differ = shared + F.col(f"{name}_shared{depth}"), differ + F.col(f"{name}_differ{depth}")
    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    return rows.withColumn(name, F.when(same, F.lit(1.0)).otherwise(2 * shared / (2 * shared + differ))).select(*kept, name)


def _first(a: Column, b: Column) -> Column:
    """The first place, from 1, where two arrays differ; 0 for nowhere."""
    return F.coalesce(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)), F.lit(0)).cast("int")


def place(a: Column, b: Column) -> Column:
    """Where the text of fingerprint a first differs from that of b: section, paragraph and
    leaf, from 0, with dots between them; null where it does not. Of each two lists of
    children only the first two that differ are entered."""
    x, y, at = sections(a), sections(b), []
    for end, between in ((":", ";"), ("=", ","), ("", "")):
        k = _first(x, y)
        at.append(k - 1)
        if end:
            x, y = (F.split(F.substring_index(F.coalesce(F.try_element_at(z, F.greatest(k, F.lit(1))), F.lit(end)), end, -1), between, -1) for z in (x, y))
    return F.when(F.substring(a, 1, 64) != F.substring(b, 1, 64), F.concat_ws(".", *at))


def edits(a: Column, b: Column) -> Column:
    """Leaves below the differing branches of fingerprint a that b has not below its own, in
    order, as (section, paragraph, leaf, weight), places from 0: where a was edited."""
    none = F.array().cast("array<struct<section:int,paragraph:int,leaf:int,weight:bigint>>")
    theirs = F.array_except(sections(b), sections(a))
    lines = _below(theirs, ":", ";")

    def of_section(s, i):
        def of_paragraph(p, j):
            own = F.split(F.substring_index(p, "=", -1), ",", -1)
            found = F.transform(own, lambda leaf, k: F.struct(i.alias("section"), j.alias("paragraph"), k.alias("leaf"), F.substring(leaf, DIGITS + 2, 20).try_cast("long").alias("weight"), leaf.alias("own")))
            gone = F.filter(found, lambda f: (f["own"] != "") & ~F.array_contains(_below(lines, "=", ","), f["own"]))
            return F.when(F.array_contains(lines, p), none).otherwise(F.transform(gone, lambda f: F.struct(f["section"].alias("section"), f["paragraph"].alias("paragraph"), f["leaf"].alias("leaf"), f["weight"].alias("weight"))))

        return F.when(F.array_contains(sections(b), s), none).otherwise(F.flatten(F.transform(F.split(F.substring_index(s, ":", -1), ";", -1), of_paragraph)))

    return F.flatten(F.transform(sections(a), of_section))


def with_next(docs: DataFrame, made=None) -> DataFrame:
    """doc_id, text (never null) and next: the text of the document with the next smaller
    doc_id, of the first one after the last. Null doc_ids are the last; documents with equal
    doc_ids follow each other by a hash of their texts. With `made`, which gives a column for a
    column of texts, also the columns made and next_made, of the text and of the next.

    doc_ids are cut into ranges of about as many rows each, and a range ends with a copy of
    the first document of the following one, so only a range's rows meet in one task and texts
    move once. A doc_id that more rows have (null, above all) is cut by the hash. The number of
    ranges is bounded, and so is what is broadcast: one document's key a range.
    """
    low = F.lit(-(2**63)).cast("long")
    # Ascending order of the bits' complement is descending order of doc_id.
    key = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), low))
    ids = docs.select(key.alias("id"))
    n = ids.count()
    ranges = max(2, min(RANGES, n // RANGE_ROWS))
    cuts = ids.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first()["c"] or [0]
    # At most a quarter of the ranges' number of ids have that many rows.
    many = max(4 * RANGE_ROWS, 4 * n // ranges)
    hot = {r["id"]: -(-r["n"] * 4 // many) for r in ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).collect()}
    cuts = sorted({*cuts, *hot, *(i - 1 for i in hot if i > -(2**63))})
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in cuts])
    steps = max(1, len(cuts).bit_length())
    # A hot id is the only one between two cuts.
    parts = F.array(*[F.lit(hot.get(c, 1)) for c in cuts], F.lit(1))

    def part(x: Column) -> Column:
        # How many cuts are below x, by bisection: the answer stays in lo..hi.
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

        def step(acc, _):
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            below = F.try_element_at(bounds, F.least(mid + 1, F.lit(len(cuts)))) < x
            done = acc["lo"] >= acc["hi"]
            return F.struct(F.when(done | ~below, acc["lo"]).otherwise(mid + 1).alias("lo"), F.when(done | below, acc["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["lo"])

    body = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", body.alias("text"), key.alias("id"), (F.xxhash64(body) if hot else F.lit(0).cast("long")).alias("hash"))

    def placed(x: DataFrame) -> DataFrame:
        x = x.withColumn("part", part(F.col("id")))
        share = F.floor((F.col("hash") / 2.0**64 + 0.5) * F.try_element_at(parts, F.col("part") + 1)).cast("int")
        return x.withColumn("sub", share if hot else F.lit(0))

    first = placed(rows.select("id", "hash")).groupBy("part", "sub").agg(F.min(F.struct("id", "hash")).alias("z")).select("part", "sub", "z.id", "z.hash")
    on = Window.orderBy("part", "sub")
    top = F.min(F.struct("part", "sub", "id", "hash")).over(Window.partitionBy())
    tails = first.withColumn("z", F.coalesce(F.lead(F.struct("id", "hash")).over(on), F.struct(top["id"].alias("id"), top["hash"].alias("hash"))))
    tails = written(tails.select("part", "sub", F.col("z.id").alias("id"), F.col("z.hash").alias("hash")), "tails")  # one row a range
    ends = rows.join(F.broadcast(tails), ["id", "hash"]).select("doc_id", "text", "id", "part", "sub", F.lit(1).alias("tail"))
    own = placed(rows).select("doc_id", "text", "id", "part", "sub", F.lit(0).alias("tail"))
    along = Window.partitionBy("part", "sub").orderBy("tail", "id", "order")
    out = own.unionByName(ends).withColumn("order", F.xxhash64("text"))
    if made is not None:
        # A second window over the same rows in the same order: nothing moves again.
        out = out.withColumn("next", F.lead("text").over(along)).withColumn("made", made(F.col("text"))).withColumn("next_made", F.lead("made").over(along))
        return out.where("tail = 0").select("doc_id", "text", "next", "made", "next_made")
    return out.withColumn("next", F.lead("text").over(along)).where("tail = 0").select("doc_id", "text", "next")


def edited(text: Column, following: Column) -> Column:
    """text, its last half replaced by as much of the start of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, how alike they are, and
    edited_at, where they first differ (null: nowhere).

    Null and empty texts have the fingerprint of the empty text. Repeated rows are documents
    of their own; a single document follows itself; an empty table gives an empty one."""
    rows = with_next(docs, fingerprint).withColumn("edited", edited(F.col("text"), F.col("next")))
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("made").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), F.col("next_made").alias("next_fingerprint"),
    )
    rows = compared(compared(rows, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return rows.withColumn("edited_at", place(F.col("fingerprint"), F.col("edited_fingerprint"))).drop("next_fingerprint")
