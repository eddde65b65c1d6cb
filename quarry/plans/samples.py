"""Small source files, and by hand what each is cut into: (context, first line, last line)."""

from __future__ import annotations

FILES: dict[str, tuple[str, list[tuple[str, int, int]]]] = {
    "app.py": (
        "import os\n\n# a note\nLIMIT = 3\n\n\ndef read(path):\n    return open(path).read()\n\n\nclass Reader:\n    def run(self):\n        return 1\n\n\nprint(LIMIT)\n",
        [("symbol: preamble", 1, 6), ("symbol: function read", 7, 8), ("symbol: class Reader", 11, 13), ("symbol: preamble", 16, 17)],
    ),
    "broken.py": ("def broken(:\n    pass\n", [("language: python", 1, 2)]),
    "guide.md": ("intro\n# One\ntext\n## Two\nmore\n", [("section: /", 1, 1), ("section: /", 2, 3), ("section: /One/", 4, 5)]),
    "box.ts": (
        'import { a } from "x{";\n\n// function no() {}\nexport class Box<T> {\n  size = 1;\n}\n\ninterface Shape {\n  a: string;\n}\ntype Id = string |\n  number\n'
        "export const area = (s: Shape) => {\n  return `${s} {`;\n};\nenum Kind { A }\nexport default function make(): { a: number } {\n  return { a: 1 };\n}\nlet rest = /[{]/;\n",
        [
            ("symbol: preamble", 1, 3), ("symbol: class Box", 4, 6), ("symbol: interface Shape", 8, 10), ("symbol: type_alias Id", 11, 12),
            ("symbol: export const area = (s: Shape) => {", 13, 15), ("symbol: enum Kind", 16, 16), ("symbol: function make", 17, 19), ("symbol: preamble", 20, 21),
        ],
    ),
    "two.js": (
        "'use strict'\nfunction one() {\n  return '}'\n}\nclass Two extends One {}\nexport { one } from './one'\nconst x = 1\n",
        [("symbol: preamble", 1, 1), ("symbol: function one", 2, 4), ("symbol: class Two", 5, 5), ("symbol: export { one } from './one'", 6, 6), ("symbol: preamble", 7, 8)],
    ),
    "lib.rs": (
        "use std::io;\n\n#[derive(Debug)]\npub struct P<'a> {\n    x: &'a str,\n}\nstruct Unit;\nimpl<'a> P<'a> {\n    fn y(&self) -> char { '{' }\n}\n"
        "pub(crate) async fn run<T>(t: T) -> [u8; 4] where T: Copy {\n    /* { /* nested */ */ todo!()\n}\nmacro_rules! m { () => {} }\nmod tests {\n    fn z() {}\n}\n",
        [
            ("symbol: preamble", 1, 3), ("symbol: struct P", 4, 6), ("symbol: struct Unit", 7, 7), ("symbol: impl P", 8, 10), ("symbol: function run", 11, 13),
            ("symbol: macro m", 14, 14), ("symbol: mod tests", 15, 17),
        ],
    ),
    "main.go": (
        'package main\n\nimport (\n\t"fmt"\n)\n\ntype Size int\n\ntype Box struct {\n\tw int\n}\n\nfunc (b *Box) Wide() interface{} {\n\treturn `{`\n}\n\nfunc main() {\n\tfmt.Println(\'{\')\n}\n\nvar x = 1\n',
        [("symbol: preamble", 1, 6), ("symbol: type Size", 7, 7), ("symbol: type Box", 9, 11), ("symbol: method Wide", 13, 15), ("symbol: function main", 17, 19), ("symbol: preamble", 21, 22)],
    ),
    "Main.java": (
        'package a.b;\n\nimport java.util.*;\n\n/** A { doc. */\n@Deprecated\npublic final class Main {\n    int x = 1;\n    void run() { String s = "}"; }\n}\n\n'
        "interface Shape { double area(); }\nenum Kind { A, B }\npublic record Point(int x, int y) {}\n",
        [("symbol: preamble", 1, 5), ("symbol: class Main", 6, 10), ("symbol: interface Shape", 12, 12), ("symbol: enum Kind", 13, 13), ("symbol: record Point", 14, 14)],
    ),
    "Store.cs": (
        'using System;\n\nnamespace App.Core\n{\n    [Serializable]\n    public partial class Store\n    {\n        string p = @"c:\\{";\n    }\n\n    public delegate void Done(int code);\n    internal struct Pair { }\n}\n\n'
        "record Person(string Name);\n",
        [
            ("symbol: preamble", 1, 2), ("symbol: preamble", 3, 4), ("symbol: class Store", 5, 9), ("symbol: delegate Done", 11, 11), ("symbol: struct Pair", 12, 12),
            ("symbol: preamble", 13, 13), ("symbol: record Person", 15, 15),
        ],
    ),
    "shape.dart": (
        "import 'dart:io';\n\nabstract class Shape {\n  double area();\n}\n\nmixin Walks on Shape {}\nextension Loud on String {\n  String get up => toUpperCase();\n}\nenum Kind { a, b }\n"
        "void main(List<String> args) async {\n  print('}');\n}\nint twice(int x) => x * 2;\nfinal y = twice(2);\n",
        [
            ("symbol: preamble", 1, 2), ("symbol: class Shape", 3, 5), ("symbol: mixin Walks", 7, 7), ("symbol: extension Loud", 8, 10), ("symbol: enum Kind", 11, 11),
            ("symbol: function main", 12, 14), ("symbol: function twice", 15, 15), ("symbol: preamble", 16, 17),
        ],
    ),
}

LONG = "class Long:\n    size = 1\n" + "".join(f"    def m{i}(self):\n" + "        pass\n" * 20 for i in range(9))
PAGE = "<p>Visible</p>\n<script>x\ny</script>\n<b>end</b>"


def expected() -> list[tuple[str, int, int, str]]:
    """(name, first line, last line, text) of all chunks of all files."""
    rows = []
    for name, (text, parts) in FILES.items():
        lines = text.split("\n")
        for context, first, last in parts:
            body = [line for line in lines[first - 1 : last] if line.strip() or context != "symbol: preamble"]
            rows.append((name, first, last, "\n".join([f"# file: {name} | {context}", *body])))
    rows.append(("long.py", 1, 191, "# file: long.py | symbol: class Long\nclass Long:\n    size = 1"))
    rows += [("long.py", 3 + 21 * i, 23 + 21 * i, f"# file: long.py | symbol: Long.m{i}\n    def m{i}(self):" + "\n        pass" * 20) for i in range(9)]
    rows.append(("page.html", 1, 4, "# file: page.html | language: text\nVisible\n\n\nend"))
    return rows


SOURCES = [*((name, text) for name, (text, _) in FILES.items()), ("long.py", LONG), ("page.html", PAGE)]
