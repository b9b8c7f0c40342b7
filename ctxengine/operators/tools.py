"""Output of git, pytest, vitest, searches and listings, and blocks of lines that a text repeats.

A shortener takes (text, aggressiveness, query) and returns a shorter text, or None to leave it.
Which one a text goes to is found by column functions; only the rewriting runs in Arrow batches.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxengine.functions import detect
from ctxengine.operators.session import NOISE

#: What tells a log of an application; headings of a status and what is below them;
#: paths that a task names; lines of a test run that are its result, its surroundings, its rules.
APP_LOG = r"(?m)^\d{4}-\d{2}-\d{2}[T ].*\b(ERROR|WARN|INFO|DEBUG)\b"
HEADINGS = (("Changes not staged", "modified"), ("Changes to be committed", "modified"), ("Untracked files", "untracked"))
TASK_PATH = re.compile(r"[\w./-]+\.(?:py|ts|tsx|js|jsx|go|rs|md|json|yaml|yml|toml)|(?:src|tests|lib|app)/[\w./-]+")
RESULT = re.compile(r"\d+ (?:passed|failed|error)", re.I)
AROUND = ("platform ", "plugins:", "collected ")
RULE = re.compile(r"=+$|_{5,}$")
#: Lines of a block that may repeat, from and to.
BLOCK_LINES = (3, 20)


def task_paths(query: str) -> set[str]:
    return {m[0].replace("\\", "/") for m in TASK_PATH.finditer(query)}


def _of_task(paths: list[str], wanted: set[str]) -> list[str]:
    """Those that a wanted path is part of, or whose end is its file; all if nothing is wanted."""
    return [p for p in paths if not wanted or any(w in p.replace("\\", "/") or p.replace("\\", "/").endswith(w.rsplit("/", 1)[-1]) for w in wanted)]


def git(text: str, a: float, query: str) -> str | None:
    """The branch, changed files by name or number, and how many are untracked."""
    files, heading, branch = defaultdict(list), None, []
    for line in text.splitlines():
        heading = next((kind for mark, kind in HEADINGS if mark in line), heading)
        if line.startswith("On branch"):
            branch = branch or [line]
        elif heading and line.startswith(("\t", "  ")) and line.strip():
            files[heading].append(line.strip())
    wanted, most, out = task_paths(query), max(3, int(10 * (1 - a))), branch

    def listed(names: list[str], shown: int) -> list[str]:
        rest = [f"  ... {len(names) - shown} more"] if len(names) > shown else []
        return [f"  {n}" for n in names[:shown]] + rest

    if changed := files["modified"]:
        names = [re.sub(r"^(?:modified|new file|deleted):\s*", "", n).strip() for n in _of_task(changed, wanted)]
        if not names:
            out = [*out, f"modified: {len(changed)} files (none task-relevant)"]
        elif len(names) <= 4:
            out = [*out, ("M: " if a >= 0.5 else "modified: ") + ", ".join(names)]
        else:
            out = [*out, f"modified: {len(changed)} files", *listed(names, most)]
    if untracked := files["untracked"]:
        signal = [n for n in untracked if not re.search(NOISE, n)]
        named = _of_task(signal, wanted)
        why = f"{len(untracked) - len(signal)} noise omitted" if named or not wanted else "none task-relevant"
        brief = a >= (0.7 if named else 0.4)
        out = [*out, f"untracked: {len(untracked)}" + ("" if brief else f" files ({why})"), *listed(named, min(most, 2) if a >= 0.4 else most)]
    return "\n".join(out) or None


def _run_line(line: str) -> str:
    """What a line of a test run is."""
    s = line.strip()
    if RESULT.search(line):
        return "result"
    if s.startswith(AROUND):
        return "around"
    if s.startswith("E ") and re.search("Error|Exception", line):
        return "error"
    if "FAILED" in line and "::" in line and not s.startswith("="):
        return "failed"
    return "open" if line.startswith("=") and "FAILURES" in line else "rule" if RULE.match(s) else "other"


def _failure(lines: list[str]) -> list[str]:
    """Of a failure's section: the test's name, what was compared, the place and the error."""
    out, sides = [], {}
    for s in (x.strip() for x in lines):
        side = re.match(r"E\s+([-+]) (.*)|([-+]) (.*)", s)
        if side and "Error" not in s:
            sides[side[1] or side[3]] = (side[2] or side[4] or "").strip()
        elif m := re.match(r"def (test_.*):$", s):
            out.append(m[1])
        elif s.startswith(">"):
            out.append(s.lstrip("> ").strip())
        elif s.startswith("E ") and "AssertionError: assert" in s:
            out.append("AssertionError")
        elif re.match(r"E\s|test_\w+|assert ", s) or re.search(r"Error|Exception|\.\w+:\d+| assert ", s):
            if "assert" in s or not re.match(r"[a-z_][a-z0-9_]*\s*=", s):
                out.append(s)
    if sides:
        out.append(f"{sides.get('-') or '?'}≠{sides.get('+') or '?'}")
    return out or [x.strip() for x in lines if x.strip()]


def _dense(lines: list[str]) -> str | None:
    """A single failure as one line: name, comparison, place, error; None without a name."""
    name = next((s.rstrip("()") for s in reversed(lines) if re.match(r"test_\w+", s)), None)
    if name is None:
        return None
    place = next((s for s in reversed(lines) if re.search(r"\.\w+:\d+", s) and not re.match(r"test_\w+", s)), "")
    both = next((s for s in reversed(lines) if "≠" in s and s != place), "")
    error = next(("AssertionError" if "AssertionError" in s else s for s in reversed(lines) if "Error" in s and s not in (place, both)), "")
    return " ".join(x for x in (f"FAILED {name}", both, place, "" if "AssertionError" in place else error) if x)


def pytest(text: str, a: float, query: str) -> str | None:
    """The result, and each failure by its name, comparison, place and error."""
    by, failures, current = defaultdict(list), [], None
    for line in text.splitlines():
        kind = _run_line(line)
        if kind == "open":
            current = []
        elif kind == "rule" and current is not None and line.startswith("=") and len(current) > 1:
            failures.append(current)
            current = None
        elif kind != "other":
            by[kind].append(line.strip())
        elif current is not None and line.startswith("=") and len(current) > 1:
            failures.append(current)
            current = None
        elif current is not None:
            current.append(line)
    failures = [_failure(f) for f in [*failures, *([current] if current else [])]]
    most = max(2, int(6 * (1 - a * 0.5)))
    if len(failures) == 1 and a >= 0.5 and (one := _dense(failures[0])):
        return one
    out = []
    for s in by["result"][:3]:
        failed = re.search(r"\d+ failed", s, re.I)
        out.append(failed[0] if failed and "passed" in s.lower() else s)
    if failures:
        out += [f"FAIL ({len(failures)}):", *("\n".join(f) for f in failures[:most])]
    else:
        for head, kind in (("FAILED", "failed"), ("ERR", "error")):
            if by[kind]:
                out += [f"{head} ({len(by[kind])}):", *by[kind][:most]]
    return "\n".join(out) or None


def grep(text: str, a: float, query: str) -> str | None:
    """Matches by file, the files with most first."""
    rows = [x for x in text.splitlines() if x.strip()]
    most, each = max(10, int(50 * (1 - a))), max(2, int(5 * (1 - a)))
    if len(rows) <= most:
        return None
    files = defaultdict(list)
    for name, colon, match in (x.partition(":") for x in rows):
        if colon:
            files[name].append(match.strip()[:120])
    out = []
    for name in sorted(files, key=lambda n: -len(files[n]))[: most // each]:
        own = files[name]
        out += [f"{name}: {len(own)} matches", *(f"  {m}" for m in own[:each]), *([f"  ... {len(own) - each} more"] if len(own) > each else [])]
    return "\n".join(out)


def ls(text: str, a: float, query: str) -> str | None:
    """The first entries."""
    rows, most = [x for x in text.splitlines() if x.strip()], max(15, int(50 * (1 - a)))
    return "\n".join([*rows[:most], f"... {len(rows) - most} more entries"]) if len(rows) > most else None


def vitest(text: str, a: float, query: str) -> str | None:
    """Counts, the first failures, and how many passed."""
    rows = [x.strip() for x in text.splitlines()]
    failed = [x for x in rows if x.startswith("FAIL ") or "AssertionError" in x or "Expected" in x]
    passed = sum(x.startswith(("PASS ", "✓")) for x in rows)
    out = [x for x in rows if re.search(r"Tests\s+\d+|Test Files", x)][:2]
    out += [f"=== FAIL ({len(failed)}) ===", *failed[:8]] if failed else []
    out += [f"PASS: {passed} omitted"] if passed > 2 else []
    return "\n".join(out) or None


SHORTENERS = {"vitest": vitest, "git": git, "pytest": pytest, "grep": grep, "ls": ls}


def tool(text: Column) -> Column:
    """The shortener that a text goes to; null for logs, other tools and plain text. A status
    comes before a test run, and that before a search or a listing."""
    shell, runner = detect.shell_tool(text), detect.test_runner(text)
    return F.when(text.rlike(APP_LOG), F.lit(None).cast("string")).when(shell == "git", "git").when(runner.isin("pytest", "vitest"), runner).when(runner.isNotNull(), F.lit(None).cast("string")).when(shell.isin("pytest", "grep", "ls"), shell)


def compressed(text: Column, a: float | Column = 0.85, query: Column | None = None) -> Column:
    """struct<content, strategy, compressed>: as its tool's shortener leaves it, if that is shorter."""

    @F.pandas_udf("content string, strategy string, compressed boolean")
    def run(texts: pd.Series, kinds: pd.Series, queries: pd.Series, hard: pd.Series) -> pd.DataFrame:
        out = []
        for t, kind, q, x in zip(texts, kinds, queries, hard, strict=True):
            short = SHORTENERS[kind](t, x, q or "") if t is not None and kind else None
            good = short is not None and len(short) < len(t)
            out.append((short if good else t, kind or "none", good))
        return pd.DataFrame(out, columns=["content", "strategy", "compressed"])

    return run(text, tool(text), F.lit("") if query is None else F.coalesce(query, F.lit("")), a if isinstance(a, Column) else F.lit(float(a)))


def folded(text: str) -> str:
    """text without the blocks of lines that it repeats: the first stays, a mark stands for each
    other one. Blocks are equal but for case and white space when they are counted, and the
    same text when they are left out; longer ones go first."""
    rows = text.splitlines()
    low, high = BLOCK_LINES
    found: dict[str, list] = {}
    for size in range(low, min(len(rows) // 2, high) + 1, 2):
        for at in range(len(rows) - size + 1):
            block = "\n".join(rows[at : at + size])
            of = found.setdefault(" ".join(block.lower().split()), [0, ""])
            of[0] += 1
            of[1] = block
    for times, block in sorted((x for x in found.values() if x[0] > 1), key=lambda x: -len(x[1])):
        at = text.find(block) if block else -1
        end = at + len(block)
        if at >= 0 and block in text[end:]:
            text = text[:end] + text[end:].replace(block, f"\n[... repeated block ×{times - 1} omitted ...]\n")
    return text
