"""Code cut to what a query asks for: the parts that score best stay, others are named.

A part is a class, a function or method, or a line outside of both. Parts are found by
indentation. A query's terms score 8 as a part's name, 3 inside its name, 1 in its text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Words that mean the same in code; words of a query that asks for a fault; what
#: names and texts of parts say where such a fault may be, and what that adds.
SYNONYMS = {
    "signature": "sig sign hmac digest", "validation": "validate verify check", "validate": "validation verify", "verify": "validation signature sig",
    "password": "passwd pwd", "delete": "remove destroy", "error": "exception fail failed",
}
FAULT = set("special character invalid encode unicode regex signature validation verify hmac auth password webhook".split())
HINTS = [(4, "name", r"validate|sanitize|check|verify"), (3, "text", r"re\.match|regex|special"), (3, "text", r"hmac|compare_digest|signature| sig")]
SOURCE = r"[\w./\\-]+\.(?:py|tsx|ts|jsx|js|go|rs)"
#: Scores of a term; methods that say little by their names; most words of an excerpt.
NAMED, PARTLY, INSIDE = 8, 3, 1
PLAIN = {"__init__", "__repr__", "__str__"}
EXCERPT = 60

IMPORT = re.compile(r"\s*(?:import|from)\s")
HEAD = re.compile(r"\s*(?:(class)|(?:async\s+)?def)\s+(\w+)")
HINT = re.compile(r":\s*(?:int|str|bytes|bool|dict|list|float|None|[A-Z]\w*(?:\[[^\]]+\])?)(?=\s*[,)=])")
RETURNS = re.compile(r"\)\s*->\s*[^:\n]+:")


@dataclass
class Part:
    name: str
    rows: list[str]
    kind: str = "line"
    methods: list[Part] = field(default_factory=list)

    def score(self, terms: set[str]) -> int:
        name, text = self.name.lower(), "\n".join(self.rows).lower()
        return sum((NAMED if t == name else PARTLY if t in name else 0) + INSIDE * (t in text) for t in terms)

    def fault(self) -> int:
        seen = {"name": self.name.lower(), "text": "\n".join(self.rows).lower()}
        return sum(n for n, where, p in HINTS if re.search(p, seen[where]))


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def parts(rows: list[str]) -> list[Part]:
    """The parts of rows without blank lines, in order; every row is in one part."""
    out, at = [], 0
    while at < len(rows):
        head, end = HEAD.match(rows[at]), at + 1
        if head:
            while end < len(rows) and _indent(rows[end]) > _indent(rows[at]):
                end += 1
        own = rows[at:end]
        if head and head[1]:
            out.append(Part(head[2], own, "class", parts(own[1:])))
        else:
            out.append(Part(head[2] if head else "", own, "def" if head else "line"))
        at = end
    return out


def query_terms(query: str) -> set[str]:
    """Words, stems of files, and what snake and camel case join; all of three characters or more."""
    found = set(re.split(r"\W+", query))
    found |= {re.split(r"[/\\]", p)[-1].rsplit(".", 1)[0] for p in re.findall(SOURCE, query, re.I)}
    found |= {p for t in found for p in t.split("_")} | {p for t in found for p in re.findall(r"[A-Z]?[a-z0-9]+", t)}
    return {t.lower() for t in found if len(t) > 2}


def _dense(rows: list[str]) -> list[str]:
    """A body of one statement stands behind its head."""
    body = [r.strip() for r in rows[1:] if not r.strip().startswith("#")]
    one = len(body) == 1 and rows[0].rstrip().endswith(":") and not body[0].endswith(":")
    return [f"{rows[0].rstrip()} {body[0]}"] if one else rows


def _of_class(c: Part, terms: set[str], least: int) -> list[str]:
    """Its head, fields, the methods that score, and a line that names the others."""
    methods = [m for m in c.methods if m.kind == "def"]
    asks_fault = bool(terms & FAULT)
    scores = [m.score(terms) + (m.fault() if asks_fault else 0) for m in methods]
    ranked = sorted(scores, reverse=True)
    top = ranked[0] if ranked else 0
    floor = top if asks_fault and top else max(1, top - 1) if top > 2 else least
    if len(ranked) > 1 and top >= ranked[1] + 3:
        floor = top
    out, left = [c.rows[0]], []
    for m, s in zip(methods, scores, strict=True):
        if s >= max(least, floor):
            out += _dense(m.rows)
        else:
            left.append(m)
    if left:
        shown = "\n".join(out).lower()
        # One line of an omitted method that has a term which nothing kept has.
        lost = next((r.strip()[:EXCERPT] for m in left for r in m.rows[1:] if any(len(t) > 3 and t in r.lower() and t not in shown for t in terms)), "")
        names = [m.name for m in left if m.name not in PLAIN]
        if names or lost:
            names = names or [m.name for m in left]
            note = ", ".join(names[:2]) + (f"+{len(names) - 2}" if len(names) > 2 else "")
            out.append(" " * _indent(left[0].rows[0]) + f"# - {note}" + (f" · {lost}" if lost else ""))
    return out


def sliced(code: str, query: str, least_chars: int = 200) -> str | None:
    """The code for a query; null where nothing scores, nothing is left out, or under a quarter of
    the query's own terms would be left."""
    asked = query_terms(query)
    terms = asked | {w for t in asked for w in SYNONYMS.get(t, "").split()}
    rows = [r for r in code.splitlines() if r.strip()]
    found = parts([r for r in rows if not IMPORT.match(r)])
    scores = [p.score(terms) for p in found] + [m.score(terms) for p in found for m in p.methods]
    if len(code) < least_chars or not terms or max(scores, default=0) == 0:
        return None
    least = max(1, max(scores) // 2)
    out: list[str] = []
    for p in found:
        if p.kind == "class":
            out += _of_class(p, terms, least)
        elif p.score(terms) >= least:
            out += p.rows
        elif p.kind == "def":
            out.append(f"{p.rows[0].rstrip()}  # ...")
    body = "\n".join(out)
    names = set(re.findall(r"\w+", re.sub(r"#.*", "", body).lower()))
    used = [r.strip() for r in rows if IMPORT.match(r) and any(n.lower() in names for n in re.findall(r"\w+", r) if n not in ("import", "from", "as"))]
    head = used if len(used) <= 3 else ["import " + ", ".join(re.sub(r"^(?:import|from)\s+", "", r) for r in used)]
    text = RETURNS.sub("):", HINT.sub("", "\n".join([*head, body])))
    kept = sum(t in text.lower() for t in asked)
    return text if kept >= max(1, len(asked) // 4) and text != code else None
