"""Scalar functions of the engine, as column expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an identifier token is, and where camel case is cut.
CAMEL = r"([a-z])([A-Z])"
TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+"

# File extensions and the language each stands for.
LANGUAGES = {
    ".md": "markdown", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".json": "text",
    ".py": "python", ".rs": "rust", ".go": "go", ".java": "java", ".cs": "csharp", ".dart": "dart", ".css": "text",
    ".html": "text", ".yaml": "text", ".yml": "text", ".toml": "text", ".txt": "text",
}
CODE_LANGUAGES = sorted(set(LANGUAGES.values()) - {"markdown", "text"})
CODE_EXTENSIONS = [e for e, language in LANGUAGES.items() if language in CODE_LANGUAGES]

# Folders that are never collected.
SKIPPED_FOLDERS = [
    "node_modules", ".git", ".notula", ".obsidian", ".llm-index", ".claude", ".cursor", ".vscode", ".next", ".nuxt", ".turbo", ".cache",
    ".parcel-cache", ".svelte-kit", "dist", "build", "out", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox",
    "egg-info", ".eggs", "coverage", ".nyc_output", "rnd",
]

# base64 payloads, HTML markup, test paths, words of a question about tests.
DATA_URI = r"(data:[\w/+.-]+;base64,)[A-Za-z0-9+/=]{100,}"
HTML_MARKUP = r"(?is)<(script|style|svg)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"
TEST_PATH = r"(?i)(^|/)(tests?|specs?|__tests__|fixtures?|testdata|e2e)/|(^|/)[^/]*\.Tests?/|(^|/)test_[^/]+$|[._-](tests?|spec)\.[^/.]+$"
WANTS_TESTS = r"(?i)\b(test|tests|testing|spec|specs|mock|mocks|fixture|fixtures)\b"
# What a code file that tests is worth, and the model of entries that name none.
TEST_PENALTY = 0.5
DEFAULT_MODEL = "all-MiniLM-L6-v2"


def ident_tokens(text: Column) -> Column:
    """Lower-case identifiers and numbers; camel case is cut, other letters than ASCII part tokens."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, CAMEL, "$1 $2")), F.lit(TOKEN), F.lit(0))


def strip_data_uri(text: Column) -> Column:
    return F.regexp_replace(text, DATA_URI, "$1")


def strip_html(html: Column) -> Column:
    """Visible text; each piece of markup leaves as many newlines as it held, so lines keep their numbers."""
    between = F.split(html, HTML_MARKUP, -1)
    markup = F.regexp_extract_all(html, F.lit(HTML_MARKUP), F.lit(0))
    newlines = F.transform(markup, lambda m: F.repeat(F.lit("\n"), F.length(m) - F.length(F.replace(m, F.lit("\n"), F.lit("")))))
    joined = F.array_join(F.zip_with(between, newlines, lambda s, n: F.concat(s, F.coalesce(n, F.lit("")))), "")
    return F.regexp_replace(F.regexp_replace(joined, "[ \t]+", " "), " ?\n ?", "\n")


def clean_text(text: Column, path: Column) -> Column:
    text = strip_data_uri(text)
    return F.when(F.lower(path).endswith(".html"), strip_html(text)).otherwise(text)


def content_hash(model: Column, text: Column) -> Column:
    """Key of a vector: the model's name, a zero byte, and the text."""
    return F.md5(F.concat(model, F.char(F.lit(0)), text).cast("binary"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot; empty for a name without one, or with one only in front."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[F.lower(extension(path))], F.lit("text"))


def has_known_extension(path: Column) -> Column:
    """Of the known extensions, in lower case only."""
    return path.rlike("(" + "|".join(re.escape(e) for e in LANGUAGES) + ")$")


def in_skipped_folder(path: Column) -> Column:
    """Some folder along a relative path has a name that is never collected."""
    folders = F.split(path, "/")
    return F.arrays_overlap(F.slice(folders, 1, F.size(folders) - 1), F.array(*map(F.lit, SKIPPED_FOLDERS)))


def _literal(c: str) -> str:
    """A character as itself, in Java's expressions and Python's, inside classes and outside."""
    return "\\" + c if c.isascii() and not c.isalnum() else c


def _glob_class(body: str) -> str:
    """What stands between a pattern's brackets, as an expression; ranges that run backwards hold nothing."""
    negated = body[0] == "!"
    rest, members = body[negated:], []
    while rest:
        span = 3 if len(rest) > 2 and rest[1] == "-" else 1
        low, high = rest[0], rest[span - 1]
        if low <= high:
            members.append(_literal(low) if span == 1 else f"{_literal(low)}-{_literal(high)}")
        rest = rest[span:]
    if not members:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(members)}]"


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression: * and ? also match a slash. A bracket
    that nothing closes is itself; just behind it, or behind its !, a closing one is a member."""
    out, i = [], 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        first = i + pattern.startswith("!", i)
        close = pattern.find("]", first + 1) if c == "[" else -1
        if close > 0:
            out.append(_glob_class(pattern[i:close]))
            i = close + 1
        else:
            out.append({"*": ".*", "?": "."}.get(c) or _literal(c))
    return "(?s)^" + "".join(out) + "(?!.)"


def _matches(regex: str):
    return lambda name: name.rlike(regex)


def excluded(path: Column, patterns: list[str]) -> Column:
    """A pattern with a slash is held against the relative path or a folder above it, one without against each name along it."""
    hit = F.lit(False)
    for pattern in (p.rstrip("/") for p in patterns):
        if "/" in pattern:
            hit = hit | path.rlike(glob_regex(pattern)) | path.rlike(glob_regex(pattern + "/*"))
        else:
            hit = hit | F.exists(F.split(path, "/"), _matches(glob_regex(pattern)))
    return hit


def relative_path(path: Column, root: Column) -> Column:
    """Below the root; paths elsewhere stay as they are."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), path.substr(F.length(root) + 2, F.length(path))).otherwise(path)


def chunk_header(path: Column, context: Column) -> Column:
    """The line that is stored, embedded and searched in front of a chunk's body."""
    return F.concat(F.lit("# file: "), path, F.lit(" | "), context)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = text.substr(F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def location(path: Column, start: Column, end: Column) -> Column:
    """path:a-b, path:a or path, as far as lines are known."""
    return (
        F.when(start.isNotNull() & end.isNotNull(), F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))
        .when(start.isNotNull(), F.concat(path, F.lit(":"), start.cast("string")))
        .otherwise(path)
    )


def is_test_code(path: Column) -> Column:
    """A path of tests, and of a source file rather than a document."""
    return path.rlike(TEST_PATH) & path.rlike("(" + "|".join(map(re.escape, CODE_EXTENSIONS)) + ")$")


def wants_tests(question: Column) -> Column:
    return question.rlike(WANTS_TESTS)


def storage_key(directory: Column) -> Column:
    return F.concat(F.substring(F.sha2(directory.cast("binary"), 256), 1, 12), F.lit("-"), base_name(directory))
