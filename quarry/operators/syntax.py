"""Declarations of source files in languages with braces, by a lexer and not by a grammar.

Comments and strings are blanked out first, in place, so that brackets can be counted. A line
at depth zero that looks like a declaration begins one; it ends with its block, its semicolon
or its line. Whole lines are dealt, and every line is in one chunk, so nothing is lost where a
file is not what it seems.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?\*/"
_NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*.*?\*/)*\*/"
_DOUBLE, _SINGLE, _CHAR = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'", r"'(?:\\[^\n]+?|[^'\\\n])'"
_TEMPLATE = r"`(?:\\.|[^`\\])*`"
_REGEX = r"(?<=[=(,:\[!&|?{};])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"


def _words(text: str) -> str:
    return "|".join(text.split())


@dataclass(frozen=True)
class Syntax:
    """``declared`` has the groups kind and name; ``member`` begins a container's method."""

    opaque: str
    declared: str
    containers: frozenset[str] = frozenset()
    member: str | None = None
    kinds: dict[str, str] = field(default_factory=dict)
    #: kinds that end with their line where no bracket is open
    by_line: frozenset[str] = frozenset()
    scope: str | None = None

    def __post_init__(self):
        for name in ("opaque", "declared", "member", "scope"):
            pattern = getattr(self, name)
            object.__setattr__(self, name, pattern and re.compile(pattern, re.S if name == "opaque" else 0))


_NOT_METHODS = rf"(?!(?:{_words('if for while switch catch return else do new throw using lock await super assert synchronized class interface struct enum record delegate event')})\b)"
_JS_MEMBER = rf"[ \t]*(?:(?:{_words('public private protected static async readonly override abstract get set')})\s+)*[*#]?\s*{_NOT_METHODS}(?P<name>[\w$]+)\s*(?:<[^>{{}}()]*>)?\s*\("
_JAVA_MEMBER = rf"[ \t]*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:{_words('public protected private abstract final static synchronized native default strictfp')})\s+)*(?:<[^>]*>\s+)?{_NOT_METHODS}(?:[\w.<>,?\[\] ]+\s)?{_NOT_METHODS}(?P<name>\w+)\s*\("
_CS_MODIFIERS = _words("public internal private protected static abstract sealed partial readonly unsafe new file ref virtual override async extern required")
_CS_MEMBER = rf"[ \t]*(?:\[[^\]]*\]\s*)*(?:(?:{_CS_MODIFIERS})\s+)*{_NOT_METHODS}(?:[\w.<>,?\[\] ]+\s)?{_NOT_METHODS}(?P<name>\w+)\s*(?:<[^>]*>)?\s*(?:\(|\{{|=>)"
_DART_MEMBER = rf"[ \t]*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:static|external|factory|const|covariant)\s+)*{_NOT_METHODS}(?:[\w.<>,?\[\] ]+\s)?{_NOT_METHODS}(?P<name>\w+(?:\.\w+)?)\s*(?:<[^>]*>)?\s*\("

_MORE_JS = "|interface|enum|type"
_JS = r"[ \t]*(?:(?:export|default|declare|abstract|async|const(?=\s+enum))\s+)*(?P<kind>function|class{more})\b\s*\*?\s*(?P<name>[\w$]+)?|[ \t]*(?P<export>export)\b"

SYNTAX = {
    "typescript": Syntax("|".join([_LINE, _BLOCK, _DOUBLE, _SINGLE, _TEMPLATE, _REGEX]), _JS.replace("{more}", _MORE_JS), frozenset({"class"}), _JS_MEMBER, {"type": "type_alias"}, frozenset({"type", "export"})),
    "javascript": Syntax("|".join([_LINE, _BLOCK, _DOUBLE, _SINGLE, _TEMPLATE, _REGEX]), _JS.replace("{more}", ""), frozenset({"class"}), _JS_MEMBER, {}, frozenset({"export"})),
    "rust": Syntax(
        "|".join([_LINE, _NESTED, r'b?r(?P<hashes>#*)".*?"(?P=hashes)', r'"(?:\\.|[^"\\])*"', _CHAR]),
        r"[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|async|const|unsafe|extern)\s+)*(?P<kind>fn|struct|enum|impl|trait|mod|macro_rules!)\s*(?:<[^{;]*?>\s*)?(?P<name>[\w:]+)",
        frozenset({"impl", "trait"}),
        r"[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|async|const|unsafe|extern)\s+)*fn\s+(?P<name>\w+)",
        {"fn": "function", "macro_rules!": "macro"},
    ),
    "go": Syntax("|".join([_LINE, _BLOCK, _DOUBLE, r"`[^`]*`", _CHAR]), r"(?P<kind>func)\s+(?P<name>\w+)|(?P<method>func)\s*\([^)]*\)\s*(?P<own>\w+)|(?P<type>type)\s+(?P<alias>\w+|\()", kinds={"func": "function"}, by_line=frozenset({"type"})),
    "java": Syntax(
        "|".join([_LINE, _BLOCK, r'""".*?"""', _DOUBLE, _CHAR]),
        rf"[ \t]*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:{_words('public protected private abstract final static sealed non-sealed strictfp')})\s+)*(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)",
        frozenset({"class", "interface", "enum"}),
        _JAVA_MEMBER,
    ),
    "csharp": Syntax(
        "|".join([_LINE, _BLOCK, r'(?P<quotes>"{3,}).*?(?P=quotes)', r'\$?@\$?"(?:[^"]|"")*"', _DOUBLE, _CHAR, r"(?m:^[ \t]*#[^\n]*)"]),
        rf"[ \t]*(?:\[[^\]]*\]\s*)*(?:(?:{_CS_MODIFIERS})\s+)*(?:(?P<kind>class|interface|struct|enum|record)(?:\s+(?:class|struct))?\s+(?P<name>\w+)|(?P<delegate>delegate)\s+[^;(]*?(?P<handler>\w+)\s*(?:<[^>]*>)?\s*\()",
        frozenset({"class", "struct", "interface", "record"}),
        _CS_MEMBER,
        scope=r"[ \t]*namespace\s+[\w.]+\s*\{",
    ),
    "dart": Syntax(
        "|".join([_LINE, _NESTED, r"r?'''.*?'''", r'r?""".*?"""', r"r'[^'\n]*'", r'r"[^"\n]*"', _DOUBLE, _SINGLE]),
        rf"(?:(?:abstract|base|final|sealed|interface|mixin(?=\s+class))\s+)*(?P<kind>class|mixin|extension|enum)\s+(?:type\s+)?(?P<name>\w+)|{_NOT_METHODS}(?:[\w.<>,?\[\] ]+\s)?{_NOT_METHODS}(?P<function>\w+)\s*(?:<[^>]*>)?\s*\((?=[^;]*?\)\s*(?:\{{|=>|async\b|sync\b))",
        frozenset({"class", "mixin", "extension"}),
        _DART_MEMBER,
    ),
}

_OPEN, _CLOSE = "([{", ")]}"


def _blank(hit: re.Match) -> str:
    return "".join(c if c == "\n" else " " for c in hit[0])


@dataclass
class Source:
    """A file's text, what of it counts, and how deep each of its lines begins."""

    text: str
    syntax: Syntax

    def __post_init__(self):
        self.bare = self.syntax.opaque.sub(_blank, self.text)
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.bare))]
        self.lines = self.text.split("\n")
        self.depths, depth, at = [], 0, 0
        for start in self.starts:
            part = self.bare[at:start]
            depth = max(0, depth + sum(map(part.count, _OPEN)) - sum(map(part.count, _CLOSE)))
            self.depths.append(depth)
            at = start

    def line(self, offset: int) -> int:
        """1-based."""
        return self.bare.count("\n", 0, offset) + 1

    def closing(self, opening: int, end: int) -> int:
        """Just behind the bracket that closes that at ``opening``."""
        depth = 0
        for m in re.compile(r"[()\[\]{}]").finditer(self.bare, opening, end):
            depth += 1 if m[0] in _OPEN else -1
            if depth == 0:
                return m.end()
        return end

    def end(self, start: int, end: int, by_line: bool) -> int:
        """Where what begins at ``start`` ends: with a block, a semicolon, or a line."""
        at = start
        while at < end:
            m = re.compile(r"[(\[{;\n]|=>").search(self.bare, at, end)
            if m is None:
                return end
            before = self.bare[start : m.start()].rstrip()
            if m[0] == ";":
                return m.end()
            if m[0] == "\n":
                # a line goes on behind an operator, and before one
                if by_line and not before.endswith(("=", "=>", "|", "&", ",")) and not re.match(r"\s*[|&.?:]", self.bare[m.end() : m.end() + 200]):
                    return m.start()
                at = m.end()
            elif m[0] == "=>":
                # an arrow's body may be a block; else it ends with its semicolon
                at = m.end()
                if not by_line and not re.match(r"\s*\{", self.bare[at : at + 200]):
                    return self._semicolon(at, end)
            else:
                close = self.closing(m.start(), end)
                is_type = re.search(r"(?:[:|&]|\b(?:interface|struct))$", before)
                if m[0] == "{" and not by_line and not is_type:
                    return close + 1 if self.bare[close : close + 1] == ";" else close
                at = close
        return end

    def _semicolon(self, at: int, end: int) -> int:
        while at < end:
            m = re.compile(r"[(\[{;]").search(self.bare, at, end)
            if m is None:
                return end
            if m[0] == ";":
                return m.end()
            at = self.closing(m.start(), end)
        return end

    def begins(self, first: int, last: int, depth: int, pattern: re.Pattern) -> list[tuple[int, int, re.Match]]:
        """(first line, last line, match) of what begins at a depth on lines first to last, one after another."""
        out, end = [], self.starts[last] if last < len(self.starts) else len(self.bare)
        n = first
        while n <= last:
            hit = pattern.match(self.bare, self.starts[n - 1], end) if self.depths[n - 1] == depth else None
            if hit:
                where = hit.start() + len(hit[0]) - len(hit[0].lstrip())
                stop = self.end(where, end, _kind(hit) in self.syntax.by_line)
                out.append((n, self.line(max(where, stop - 1)), hit))
                n = out[-1][1]
            n += 1
        return out


def _kind(hit: re.Match) -> str:
    found = hit.groupdict()
    return found.get("kind") or next((k for k in ("export", "method", "type", "delegate", "function") if found.get(k)), "")


def _name(hit: re.Match) -> str | None:
    found = hit.groupdict()
    return next((found[k] for k in ("name", "own", "alias", "handler", "function") if found.get(k)), None)


def declarations(text: str, language: str, split_lines: int) -> list[tuple[str, int, int, str]]:
    """(symbol, first line, last line, text) of a file's declarations, and, as ``preamble``, of
    what stands between them without its blank lines. A container of more than ``split_lines``
    lines gives a shell without its methods, and its methods."""
    syntax = SYNTAX[language]
    source = Source(text, syntax)
    lines = source.lines
    out: list[tuple[str, int, int, str]] = []

    def between(a: int, b: int) -> None:
        while a <= b and not lines[a - 1].strip():
            a += 1
        body = [lines[n - 1] for n in range(a, b + 1) if lines[n - 1].strip() or source.depths[n - 1]]
        if body:
            out.append(("preamble", a, b, "\n".join(body)))

    def declared(a: int, b: int, hit: re.Match, depth: int) -> None:
        kind, name, whole = _kind(hit), _name(hit), "\n".join(lines[a - 1 : b])
        named = name and name != "(" and kind != "export"
        symbol = f"{syntax.kinds.get(kind, kind)} {name}" if named else lines[a - 1].strip()[:80]
        methods = source.begins(a + 1, b - 1, depth + 1, syntax.member) if kind in syntax.containers and syntax.member and b - a >= split_lines else []
        if not methods:
            out.append((symbol, a, b, whole))
            return
        inside = {n for x, y, _ in methods for n in range(x, y + 1)}
        shell = [lines[n - 1] for n in range(a, b + 1) if n not in inside and (n < methods[0][0] or lines[n - 1].strip())]
        out.append((symbol, a, b, "\n".join(shell)))
        out.extend((f"{name or kind}.{_name(m)}", x, y, "\n".join(lines[x - 1 : y])) for x, y, m in methods)

    def walk(first: int, last: int, depth: int) -> None:
        scopes = source.begins(first, last, depth, syntax.scope) if syntax.scope else []
        at = first
        for a, b, hit in scopes:
            plain(at, a - 1, depth)
            opening = min(source.line(hit.end() - 1), b)
            between(a, opening)
            if opening < b:
                walk(opening + 1, b - 1, depth + 1)
                between(b, b)
            at = b + 1
        plain(at, last, depth)

    def plain(first: int, last: int, depth: int) -> None:
        at = first
        for a, b, hit in source.begins(first, last, depth, syntax.declared) if first <= last else []:
            between(at, a - 1)
            declared(a, b, hit, depth)
            at = b + 1
        between(at, last)

    walk(1, len(lines), 0)
    return out


def parser(language: str, split_lines: int) -> Callable[[str], list[tuple[str, int, int, str]]]:
    return lambda text: declarations(text, language, split_lines)
