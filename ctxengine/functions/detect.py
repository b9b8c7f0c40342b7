"""Types of text by an ordered cascade of tests; all native but JSON validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxengine.functions.text import count_of, first_of, has, strip

#: Command-line tools and what their output looks like, first match first.
CLI_TOOLS = [
    ("docker", r"(^Step \d+/|Successfully (built|tagged)|Sending build context| ---> (Running|Using|Pulling))"),
    ("cargo", r"(^   Compiling |^    Finished |error\[E\d+\]|^warning:)"),
    ("kubectl", r"(^NAME\s+READY|^NAMESPACE\s+|^kubectl |^\S+\s+\d+/\d+\s+Running)"),
    ("pip", r"(^(Collecting|Installing|Successfully installed|Requirement already satisfied) )"),
    ("yarn", r"^(?:yarn (?:install|add|run)|warning |error )"),
    ("jest", r"(Test Suites:|^Tests:\s+\d+|^FAIL \S+\.|^\s*● )"),
    ("go", r"(^=== RUN |^--- FAIL:|^PASS$|^ok\s+\S+\s+[\d.]+s|^FAIL\s+\S+\s+\[)"),
    ("make", r"(^make(\[\d+\])?: (Entering|Leaving) directory|^make(\[\d+\])?: \*\*\* )"),
    ("curl", r"(^[*<>] (Connected|HTTP|GET |POST )|^HTTP/\d\.\d \d{3})"),
    ("dotnet", r"(^Build (FAILED|succeeded)|^    \d+ Error\(s\)|^MSBUILD : error)"),
    ("webpack", r"(webpack compiled|ERROR in |Module not found|asset \S+ \d+ (?:KiB|MiB|bytes)|WARNING in )"),
    ("gradle", r"(^> Task |BUILD SUCCESSFUL|BUILD FAILED|^FAILURE: Build failed)"),
    ("journalctl", r"(^-- Logs begin|^-- Boot \d+|^[A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} \S+ \S+\[\d+\]:)"),
    ("terraform", r"(^Terraform |^Plan: \d+ to |^No changes\.|^\s*[~+-]\s+\S+.*= |^  # module\.)"),
    ("pnpm", r"(^Progress: resolved|^Packages: \+|^Done in [\d.]+s|^WARN\s+.*deprecated)"),
    ("vite", r"(^vite v\d|built in [\d.]+s|dist/.*\.(js|css)|error during build)"),
    ("npm", r"(?i)(^npm warn |^npm error |added \d+ packages|audited \d+ packages|up to date)"),
    ("tsc", r"(error TS\d+|Found \d+ error|\.tsx?\(\d+,\d+\):)"),
    ("eslint", r"(\d+:\d+\s+error\s+|✖ \d+ problem|ESLint)"),
    ("traceback", r"^Traceback \(most recent call last\):"),
    ("playwright", r"(?i)(playwright|TimeoutError|expect\()"),
    ("gh", r"(^gh:|GraphQL:|HTTP 4\d\d|pull request #\d+)"),
]
#: Test runners and shell tools.
PYTEST = r"(=+ FAILURES =+|ERROR collecting|\bpytest\b|\d+ passed(?: in |\b)|^\d+ failed|::[\w.]+\s+FAILED\b|^PASSED\b|^FAILED\b)"
RUNNERS = [("jest", r"(Test Suites:|^Tests:\s+\d+|^FAIL \S|^\s*● )"), ("pytest", PYTEST), ("vitest", r"(FAIL\s+\S+|Tests\s+\d+\s+passed|RUN\s+v)")]
PLAYWRIGHT = r"(\d+ failed|\d+ passed|Error:|TimeoutError|expect\()"
SHELL = [
    ("git", r"^(On branch |Changes not staged|Untracked files|diff --git)"),
    ("jest", r"(Test Suites:|^FAIL \S|^\s*● )"),
    ("pytest", PYTEST),
    ("npm", r"^(npm WARN|npm ERR|added \d+ packages|up to date)"),
    ("ls", r"^(total \d+|drwx|[-rwxls]{10})"),
]
#: What logs, code and volatile values look like.
LOG = [r"(?i)\[(ERROR|WARN|INFO|DEBUG|TRACE)\]", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", r"(?i)Traceback \(most recent call last\)", r"(?i)^\s*at .+\(.+:\d+:\d+\)"]
CODE = [r"^(def |class |import |from |function |const |let |var |pub fn |func |package )", r"^\s*(if |for |while |return |async |await |export |interface |type )"]
VOLATILE = [
    ("uuid", r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"),
    ("timestamp", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
    ("unix_ms", r"\b\d{10,13}\b"),
    ("session_id", r"(?i)session[_-]?id[=:\s]+\S+"),
    ("request_id", r"(?i)request[_-]?id[=:\s]+\S+"),
]
HINTS = ("code", "json", "log", "diff", "terminal", "message", "tool_output")


def cli_tool(text: Column) -> Column:
    return first_of([(name, has(text, p)) for name, p in CLI_TOOLS])


def test_runner(text: Column) -> Column:
    return first_of([(name, has(text, p)) for name, p in RUNNERS] + [("playwright", has(text, PLAYWRIGHT) & F.lower(text).contains("playwright"))])


def shell_tool(text: Column) -> Column:
    grep = (F.length(text) - F.length(F.replace(text, F.lit(":"))) > 5) & has(text, r"^\S+\.(py|ts|js|go|rs):\d+:")
    return first_of([(name, has(text, p)) for name, p in SHELL] + [("grep", grep)])


def json_valid():
    """An Arrow function: whether the first 100,000 characters are a JSON value."""

    @F.pandas_udf("boolean")
    def valid(texts):
        import json

        def one(t):
            try:
                json.loads((t or "")[:100_000])
                return True
            except ValueError:
                return False

        return texts.map(one)

    return valid


def is_json(text: Column) -> Column:
    """Native where all engines agree: one JSON object or array without anything behind it."""
    whole = text.rlike(r"(?s)^(\{.*\}|\[.*\])$")
    return whole & F.try_parse_json(text).isNotNull()


def content_type(text: Column, hint: Column | None = None, exact_json: Column | None = None) -> Column:
    """The type of a text; `exact_json` replaces the native test of JSON validity."""
    s = strip(text)
    breaks = F.length(s) - F.length(F.replace(s, F.lit("\n")))
    logs = sum((has(s, p).cast("int") for p in LOG[1:]), has(s, LOG[0]).cast("int"))
    valid = is_json(s) if exact_json is None else exact_json
    case = F.when(F.coalesce(F.length(s), F.lit(0)) == 0, "text")
    if hint is not None:
        case = F.when(hint.isin(*HINTS), hint).when(F.coalesce(F.length(s), F.lit(0)) == 0, "text")
    return (
        case.when(s.contains("Traceback (most recent call last)"), "log")
        .when(cli_tool(s).isNotNull(), "tool_output")
        .when(has(s, r"^(On branch |Changes not staged|Untracked files:)"), "tool_output")
        .when(valid, "json")
        .when(has(s, r"^diff --git|^--- a/|^\+{3} ") | has(s, r"^@@ -\d+"), "diff")
        .when((logs >= 2) | s.contains("Traceback"), "log")
        .when(count_of(s, r"(?md)^\s*at .+\(") >= 3, "log")
        .when(has(s, r"^(total \d+|drwx|[-rwx]{10}|\$ |>>> |> )"), "terminal")
        .when(has(s, r"^\d+:\s*.+") & (breaks > 3) & has(s, r"^[\w./-]+\.(py|ts|js|go|rs|java|rb|tsx|jsx|md):"), "search")
        .when(s.rlike(r"(?U)^[\w.-]+\s*[:=]\s*") & (breaks > 2) & ~has(s, r"^(def |class |function |import |const |let |var )"), "config")
        .when(has(s, CODE[0]) | has(s, CODE[1]), "code")
        .otherwise("text")
    )


def volatile(text: Column) -> Column:
    """array<struct<type, count, hint>> of kinds of values that change with every call."""
    found = [F.struct(F.lit(kind).alias("type"), count_of(text, p).cast("string").alias("count"), F.lit(f"Volatile {kind} in context may reduce prompt cache hit rate").alias("hint")) for kind, p in VOLATILE]
    return F.filter(F.array(*found), lambda x: x["count"] != "0")
