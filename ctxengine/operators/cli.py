"""Command output by tables of sections: which lines stay, how many, under which heading.

A section is a filter over the lines of a text; all of it is native. What aggressiveness
decides is decided when the plan is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxengine.functions.detect import cli_tool
from ctxengine.functions.text import lines


@dataclass(frozen=True)
class Section:
    """pattern: lines that belong to it, but for those of `but`. most: how many are shown, the
    last ones with `last`. head and more: lines before and behind, {n} is the number of lines,
    {rest} of those not shown. unless: patterns of which no line may be there."""

    pattern: str
    most: int
    head: str = ""
    last: bool = False
    more: str = ""
    but: str = ""
    unless: tuple[str, ...] = ()
    strip: bool = True


def tables(a: float) -> dict[str, list[Section]]:
    """The sections of each tool at aggressiveness a."""

    def upto(n: float, least: int = 1) -> int:
        return max(least, int(n * (1 - a) + 1e-9))

    hard = a >= 0.7
    soft = lambda s: [] if hard else [s]
    # What the lines of each tool look like.
    docker_err, docker_sum = r"(?i)(error|failed|denied|Cannot |no such|Error response)", r"(?i)Successfully (built|tagged|pushed)|exited with code"
    cargo_err, crate = r"^error\[E\d+\]|^error:", r"^\s*Compiling "
    pip_ok = "^Requirement already satisfied"
    go_fail, make_err = r"^--- FAIL:|^FAIL\t", r"(?i)\*\*\* |error:|Error \d+"
    http = r"^HTTP/|^< |^> "
    gradle_err, npm_sum = r"(?i)FAILURE:|BUILD FAILED|Execution failed|error:", r"(?i)added \d+ packages|up to date|audited \d+ packages|found \d+ vulnerabilities"
    journal_err = r"(?i)\b(error|failed|fatal|panic|segfault|denied|unavailable)\b"
    pnpm_sum, ready = r"Done in [\d.]+s|^Packages:", r"NAME\s+READY|^NAMESPACE"
    tables = {
        "docker": [Section(r"^\s*Step | --->", upto(4, 0), "docker: {n} steps", True, but=r"---> (Using cache|Running in [a-f0-9]+)\s*$"), Section(docker_err, 10, "ERR ({n}):"), Section(docker_sum, 3 if hard else 5)],
        "cargo": [Section("Finished", 1 if hard else 3), Section(crate, upto(3, 0), "cargo: {n} crates", True, unless=(cargo_err,)), Section(cargo_err, 15, "ERR ({n}):"), *soft(Section("^warning:", 5, "WARN ({n}):"))],
        "kubectl": [Section(ready, 1), Section(r"\b0/\d+\b|Error|CrashLoop|Pending|Failed", upto(20), "=== NOT READY / PROBLEMS ({n}) ===", but=ready), Section(r"\S", upto(20), more="... {rest} more resources", but=ready)],
        "pip": [Section("^Successfully installed", 3), Section("(?i)ERROR:|Could not|No matching distribution", 10, "=== ERRORS ({n}) ==="), *([Section(pip_ok, upto(10), "=== SATISFIED ({n}) ===")] if a < 0.6 else []), Section("^Collecting ", upto(10), "=== COLLECTING ({n}) ===", True, unless=(pip_ok,) if a < 0.6 else ())],
        "yarn": [Section(r"(?i)Done in |success|Saved lockfile|added \d+ packages", 3), Section("^error ", 10, "errors: {n}"), *soft(Section("(?i)warning", 5, "warnings: {n}"))],
        "go": [Section(r"^ok  |^PASS$", upto(8), "=== PASS ({n}) ===", more="... {rest} more passed"), Section(go_fail, 10, "=== FAIL ({n}) ==="), Section(r"^\s{4,}.*(Error|error:)", 10), Section("^=== RUN ", upto(8), "=== RUN ({n} tests) ===", unless=(go_fail,))],
        "make": [Section(make_err, 15, "=== ERRORS ({n}) ==="), Section("(Entering|Leaving) directory", upto(5, 2), "=== DIRS ({n}) ===", True), Section(r"^make\[", 10, but="(?i)warning", unless=(make_err,))],
        "curl": [Section(http, upto(12)), Section(r"\S", upto(15), "=== BODY ({n} lines) ===", more="... {rest} more lines", but=http, strip=False)],
        "dotnet": [Section(r"(?i)Build succeeded|Error\(s\)|Warning\(s\)", 5), Section("(?i)error (CS|MSB|NU)|Build FAILED", 15, "=== ERRORS ({n}) ==="), *soft(Section("(?i)warning ", 5, "warnings: {n}"))],
        "webpack": [Section("(?i)webpack compiled|compiled (?:with|successfully)", 3), Section("(?i)ERROR in |Module not found|Failed to compile", 15, "=== ERRORS ({n}) ==="), *soft(Section("(?i)WARNING in |warning ", 8, "=== WARNINGS ({n}) ===")), Section(r"(?i)asset \S+ \d+ (?:KiB|MiB|bytes)", upto(8), "=== ASSETS ({n}) ===", True)],
        "gradle": [Section(r"(?i)BUILD SUCCESSFUL|BUILD FAILED|\d+ actionable task", 3), Section(gradle_err, 15, "=== ERRORS ({n}) ==="), Section(r"^\s*> Task ", upto(12), "=== TASKS ({n}) ===", True, unless=(gradle_err,))],
        "journalctl": [Section("^--", 2), Section(journal_err, upto(25), "=== ERRORS ({n}) ===", but="^--"), Section(r"\S", upto(25), "=== RECENT ({n}) ===", True, "... {rest} older log lines omitted", but=f"{journal_err}|^--")],
        "terraform": [Section(r"^Plan: \d+ to |^No changes\.|^Apply complete!|^Destroy complete!", 5), Section(r"^Error:|Error: |^\s*│ Error:", 15, "=== ERRORS ({n}) ==="), Section(r"^\s*[~+-]\s+\S+|^  # module\.", upto(20), "=== CHANGES ({n}) ===", more="... {rest} more resource changes", strip=False)],
        "npm": [Section(npm_sum, 3), Section("(?i)npm ERR|npm error", 12, "=== ERRORS ({n}) ==="), *soft(Section("(?i)npm WARN", upto(10), "=== WARNINGS ({n}) ===", unless=(npm_sum,)))],
        "jest": [Section(r"^(Test Suites|Tests|Snapshots|Time):", 4), Section(r"^\s*FAIL |^\s*● ", 10), Section(r"^\s*(Expected|Received)", 12), Section(r"^\s*PASS ", 0, "PASS {n}")],
        "pnpm": [Section(pnpm_sum, 3), Section("ERR_| ELIFECYCLE |ERROR", 12, "=== ERRORS ({n}) ==="), *soft(Section("(?i)WARN|deprecated", upto(8), "=== WARNINGS ({n}) ===")), Section("^Progress:", upto(8), "=== PROGRESS ({n}) ===", True, unless=(pnpm_sum,))],
        "vite": [Section("(?i)built in" if hard else r"(?i)^vite v|built in [\d.]+s", 1 if hard else 2), Section(r"(?i)error during build|✘ \[ERROR\]|Failed to compile", 12, "ERR ({n}):"), Section(r"(?i)dist/.*\.(js|css|html)", upto(3, 0), "vite: {n} assets", True), *soft(Section("(?i)warning", 5, "warnings: {n}"))],
        "tsc": [Section(r"error TS\d+|Found \d+ error", 3, strip=False), Section(r"\.tsx?\(\d+,\d+\):", upto(15), "=== TS ERRORS ({n}) ===")],
        "eslint": [Section(r"(?i)error|✖ \d+ problem", upto(12), more="... {rest} more eslint issues")],
        "gh": [Section("(?i)pull request|merged|created", 5, strip=False), Section(r"(?i)error|GraphQL:|HTTP 4\d\d", 8)],
        "traceback": [*([Section(r"^Traceback|^\s+\S|^File ", int(25 * (1 - a / 2)), strip=False)] if a < 0.6 else []), Section(r"^[\w.]*(Error|Exception|Interrupt|Exit|Warning)\b.*", max(2, int(25 * (1 - a / 2))))],
        "playwright": [Section(r"(?i)Error:|TimeoutError|expect\(", 10), Section(r"\d+ (failed|passed)", 3)],
    }
    return tables


def _section(rows: Column, s: Section) -> Column:
    found = F.filter(rows, lambda x: x.rlike(s.pattern) & ~x.rlike(s.but) if s.but else x.rlike(s.pattern))
    n = F.size(found)
    shown = F.slice(found, F.greatest(F.lit(1), n - s.most + 1), F.lit(s.most)) if s.last else F.slice(found, 1, s.most)
    if s.strip:
        shown = F.transform(shown, lambda x: F.trim(x))
    none = F.array().cast("array<string>")

    def line(template: str, rest: Column) -> Column:
        return F.replace(F.replace(F.lit(template), F.lit("{n}"), n.cast("string")), F.lit("{rest}"), rest.cast("string"))

    parts = [shown]
    if s.head:
        parts.insert(0, F.array(line(s.head, n)))
    if s.more:
        parts.append(F.when(n > s.most, F.array(line(s.more, n - s.most))).otherwise(none))
    there = n > 0
    for p in s.unless:
        there = there & (F.size(_matching(rows, p)) == 0)
    return F.when(there, F.concat(*parts)).otherwise(none)


def _matching(rows: Column, pattern: str) -> Column:
    return F.filter(rows, lambda x: x.rlike(pattern))


def compressed(text: Column, tool: Column | None = None, a: float = 0.85) -> Column:
    """struct<content, strategy, compressed>: the sections of the text's tool, if they are shorter
    by 5 % or more; else the text."""
    tool = cli_tool(text) if tool is None else tool

    def sections(t: Column) -> Column:
        rows, out = lines(text), F.lit(None).cast("string")
        for name, parts in tables(a).items():
            out = F.when(t == name, F.array_join(F.concat(*[_section(rows, s) for s in parts]), "\n")).otherwise(out)
        return F.struct(t.alias("tool"), out.alias("out"))

    def checked(x: Column) -> Column:
        good = F.coalesce((F.length(x["out"]) > 0) & (F.length(x["out"]) < F.length(text) * 0.95), F.lit(False))
        return F.struct(F.when(good, x["out"]).otherwise(text).alias("content"), F.concat(F.lit("rtk:"), F.coalesce(x["tool"], F.lit("none"))).alias("strategy"), good.alias("compressed"))

    # Arrays of one element hold what is used many times, so that each is computed once.
    return F.transform(F.transform(F.array(tool), sections), checked)[0]


def listing(text: Column, a: float = 0.85) -> Column:
    """The first entries of a directory listing."""
    rows, most = lines(text), max(15, int(50 * (1 - a)))
    return F.when(F.size(rows) > most, F.concat(F.array_join(F.slice(rows, 1, most), "\n"), F.lit("\n... "), (F.size(rows) - most).cast("string"), F.lit(" more entries"))).otherwise(text)
