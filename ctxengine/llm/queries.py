"""One query for each operator of this package, over its whole table, and what SQL can express."""

from __future__ import annotations

from ctxengine.llm import cover_tree, katz, langid, licenses, merkle, mixing, packing, secrets, simhash, url_tree


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


QUERIES = {
    "op1_license_scan": lambda spark, d: licenses.scan(_read(spark, d, "documents")),
    "op2_katz_score": lambda spark, d: katz.report(_read(spark, d, "documents")),
    "op3_url_filter": lambda spark, d: url_tree.report(_read(spark, d, "pages"), _read(spark, d, "labels")),
    "op4_merkle_fingerprint": lambda spark, d: merkle.report(_read(spark, d, "documents")),
    "op5_mix_sources": lambda spark, d: mixing.report(_read(spark, d, "documents")),
    "op8_cover_tree_dedup": lambda spark, d: cover_tree.report(_read(spark, d, "embeddings")),
    "op9_pack_sequences": lambda spark, d: packing.report(_read(spark, d, "documents")),
    "op10_simhash_dedup": lambda spark, d: simhash.report(_read(spark, d, "documents")),
    "op6_language_id": lambda spark, d: langid.report(_read(spark, d, "documents"), _read(spark, d, "pages")),
    "op7_secret_scan": lambda spark, d: secrets.report(_read(spark, d, "documents")),
}
_DOCS = "(select doc_id, coalesce(text, '') as text, source from documents)"
_JOIN = "array_to_string(list_transform({l}, lambda c: {e}), {s})"
_SHOWN = f"substr({{c}}.d, 1, {merkle.DIGITS}) || '.' || {{c}}.w"


def _put(template: str, **values: str) -> str:
    for k, v in values.items():
        template = template.replace("{" + k + "}", v)
    return template


def _node(children: str, below: str) -> str:
    """A node's digest, weight and shown children."""
    digest = _put(_JOIN, l=children, e="c.d", s="chr(10)")
    return f"{{{{'d': sha256({digest}), 'w': (1 + coalesce(list_sum(list_transform({children}, lambda c: c.w)), 0))::bigint, 'b': {below}}}}}"


#: Of one text in a column t: its tree, level by level, as three steps of a query.
_PIECES = f"list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{merkle.PIECE}'), lambda l: {{{{'d': sha256(l), 'w': length(l)}}}})))"
_LINES = "list_transform(n, lambda s: list_transform(s, lambda p: " + _node("p", "'=' || " + _put(_JOIN, l="p", e=_put(_SHOWN, c="c"), s="','")) + "))"
_PARTS = "list_transform(n, lambda s: " + _node("s", "':' || " + _put(_JOIN, l="s", e=_put(_SHOWN, c="c") + " || c.b", s="';'")) + ")"
_ROOT = f"sha256({_put(_JOIN, l='n', e='c.d', s='chr(10)')}) || '|' || {_put(_JOIN, l='n', e=_put(_SHOWN, c='c') + ' || c.b', s=repr('/'))}"
_PRINTS = f"""p0 as (select i, {_PIECES} as n from u), p1 as (select i, {_LINES} as n from p0), p2 as (select i, {_PARTS} as n from p1), f as (select i, {_ROOT} as f from p2)""".replace("{{", "{").replace("}}", "}")
_BELOW = "list_filter(flatten(list_transform({n}, lambda q: string_split(split_part(q, '{e}', -1), '{b}'))), lambda q: q <> '')"
_HEAVY = f"coalesce(list_sum(list_transform({{n}}, lambda q: substr(split_part(q, '{{e}}', 1), {merkle.DIGITS + 2})::bigint)), 0)"
_ONLY = "list_filter(list_distinct({a}), lambda q: not list_contains({b}, q))"


def _compared(name: str, a: str, b: str) -> str:
    """Steps of a query from f-strings a and b of the table l to their likeness."""
    steps = [f"{name}0 as (select i, {a} = {b} as same, string_split(substr({a}, 66), '/') as x, string_split(substr({b}, 66), '/') as y, 0 as shared, 2 as differ from l)"]
    for k, (end, between) in enumerate(((":", ";"), ("=", ","), (",", None))):
        u, v = _put(_ONLY, a="x", b="y"), _put(_ONLY, a="y", b="x")
        shared = f"shared + {_put(_HEAVY, n='list_intersect(x, y)', e=end)}"
        if between:
            rest = f"{_put(_BELOW, n=u, e=end, b=between)} as x, {_put(_BELOW, n=v, e=end, b=between)} as y, {shared} as shared, differ + len({u}) + len({v}) as differ"
        else:
            rest = f"{shared} as shared, differ + {_put(_HEAVY, n=u, e=end)} + {_put(_HEAVY, n=v, e=end)} as differ"
        steps.append(f"{name}{k + 1} as (select i, same, {rest} from {name}{k})")
    steps.append(f"{name} as (select i, case when same then 1.0 else 2 * shared::double / (2 * shared + differ) end::double as {name} from {name}3)")
    return ", ".join(steps)


def _first(a: str, b: str) -> str:
    return f"coalesce(list_position(list_transform(list_zip({a}, {b}), lambda z: z[1] is not distinct from z[2]), false), 0)"


_PLACES = f"""s1 as (select i, fingerprint = edited_fingerprint as same, string_split(substr(fingerprint, 66), '/') as x, string_split(substr(edited_fingerprint, 66), '/') as y from l),
 s2 as (select *, {_first('x', 'y')} as k1 from s1),
 s3 as (select i, same, k1, string_split(split_part(coalesce(x[greatest(k1, 1)], ':'), ':', -1), ';') as x, string_split(split_part(coalesce(y[greatest(k1, 1)], ':'), ':', -1), ';') as y from s2),
 s4 as (select *, {_first('x', 'y')} as k2 from s3),
 s5 as (select i, same, k1, k2, string_split(split_part(coalesce(x[greatest(k2, 1)], '='), '=', -1), ',') as x, string_split(split_part(coalesce(y[greatest(k2, 1)], '='), '=', -1), ',') as y from s4),
 places as (select i, case when not same then (k1 - 1) || '.' || (k2 - 1) || '.' || ({_first('x', 'y')} - 1) end as edited_at from s5)"""

_OP4 = f"""with n as (select row_number() over () as r, doc_id, text, coalesce(lead(text) over w, first_value(text) over w) as nx from {_DOCS} window w as (order by doc_id desc)),
 e as (select r, doc_id, text, nx, substr(text, 1, length(text) - length(text) // 2) || substr(nx, 1, length(text) // 2) as ed from n),
 u as (select 3 * r as i, text as t from e union all select 3 * r + 1, ed from e union all select 3 * r + 2, nx from e),
 {_PRINTS},
 l as (select e.r as i, a.f as fingerprint, b.f as edited_fingerprint, c.f as next_fingerprint from e join f a on a.i = 3 * e.r join f b on b.i = 3 * e.r + 1 join f c on c.i = 3 * e.r + 2),
 {_compared('near_edited', 'fingerprint', 'edited_fingerprint')}, {_compared('near_next', 'fingerprint', 'next_fingerprint')}, {_PLACES}
 select doc_id, length(text) as n_chars, sha256(ed) as edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_at from e join l on l.i = e.r join near_edited ne on ne.i = e.r join near_next nn on nn.i = e.r join places p on p.i = e.r"""

_OP5 = rf"""with d as (select row_number() over () as r, doc_id, coalesce('s' || source, 't') as key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as digest from documents),
 s as (select key, sum(size)::bigint as source_size from d group by 1),
 w as (select *, [5.0, 2.0, 1.0][(row_number() over (order by key) - 1) % 3 + 1]::double as weight, source_size * 2.0::double as most, sum(source_size) over () * 1.5::double as budget from s),
 v as (select *, (budget - coalesce(sum(most) over (order by most / weight, key rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by most / weight, key rows between current row and unbounded following) as level from w),
 x as (select *, (select arg_min(v2.level, row(v2.most / v2.weight, v2.key)) from v v2 where v2.level < v2.most / v2.weight) as water from v),
 g as (select key, source_size, coalesce(least(most, water * weight), most)::double as target from x),
 q as (select r, doc_id, key, size, source_size, target, coalesce(sum(size) over (partition by key order by digest, size rows between unbounded preceding and 1 preceding), 0)::bigint as sent from d join g using (key)),
 e as (select r, key, (sent + e.e * source_size + least(size, (j.j + 1) * {mixing.PACKET}))::double / target as finish, least(size, (j.j + 1) * {mixing.PACKET}) - j.j * {mixing.PACKET} as words from q, (select unnest(range(0, 2)) as e) e, lateral (select unnest(range(0, (size + {mixing.PACKET - 1}) // {mixing.PACKET})) as j) j where target > 0),
 b as (select r, words, sum(words) over (order by finish, key rows between unbounded preceding and current row) as run from e),
 t as (select r, sum(greatest(0, least(words, floor((select 1.5 * sum(size) from d))::bigint - (run - words)))) as taken from b group by 1)
 select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, case when size > 0 and target > 0 then (sent + size)::double / target end as finish from q left join t using (r)"""


def _spans(rule: secrets.Rule, i: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    parts = f"string_split_regex(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), '[\x01\x02]')"
    ends = "list_sum(list_transform(p[:k], lambda x: length(x)))"
    keep = f" and length(regexp_extract(p[k], '{pattern}', {rule.group})) >= {rule.least}" if rule.least else ""
    return f"select doc_id, {i} as i, '{rule.kind}' as kind, (e - l)::bigint as s, e::bigint as e from (select doc_id, {ends} as e, length(p[k]) as l, p, k from (select doc_id, p, unnest(range(2, len(p) + 1, 2)) as k from (select doc_id, {parts} as p from c))) where true{keep}"


_RULES = secrets.BASE + secrets.ADDED
_OP7 = (
    "with c as (select doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) as t from documents), f as (" + " union all ".join(_spans(r, i) for i, r in enumerate(_RULES)) + "), "
    "g as (select doc_id, " + ", ".join(f"sum((kind = '{r.kind}')::int)::bigint as n_{r.kind}" for r in secrets.BASE) + ", string_agg(kind || ':' || s || ':' || e, ',' order by s, i) filter (i < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, i, e) as spans from f group by 1) "
    "select d.doc_id, " + ", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.BASE) + ", sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents d left join g using (doc_id)"
)

_OP8 = """with recursive u as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 p as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95),
 r as (select vec_id as a, vec_id as b from embeddings union select r.a, p.b from r join p on r.b = p.a)
 select e.vec_id, (select count(*) from p where p.a = e.vec_id) as n_links, m.c as component_id, m.c = e.vec_id as kept from embeddings e join (select a, min(b) as c from r group by 1) m on m.a = e.vec_id"""

#: SQL where it can express the whole result at the size of the driver's comparison. The others
#: have a text model, a tokenizer, a hash function or an alignment that SQL lacks; their tests
#: hold them against brute force.
ORACLES: dict[str, str] = {"op4_merkle_fingerprint": _OP4, "op5_mix_sources": _OP5, "op7_secret_scan": _OP7, "op8_cover_tree_dedup": _OP8}
