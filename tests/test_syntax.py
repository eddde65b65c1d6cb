"""Declarations of languages with braces, by hand; a tiny sentence model."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions.text import LANGUAGES
from quarry.operators import chunking, embed, syntax
from quarry.plans import samples

CASES = {LANGUAGES["." + name.split(".")[1]]: (text, parts) for name, (text, parts) in samples.FILES.items() if name.split(".")[1] not in ("py", "md")}


@pytest.mark.parametrize("language", sorted(CASES))
def test_declarations_by_hand(language):
    source, want = CASES[language]
    got = syntax.declarations(source, language, 150)
    assert [(f"symbol: {s}", a, b) for s, a, b, _ in got] == want


LONG = {
    "typescript": ("class Big {\n  size = 1;\n", "  async m{0}(a: number): Promise<void> {{\n", "  }\n\n", "}\n", "Big"),
    "javascript": ("class Big {\n  size = 1;\n", "  m{0}(a) {{\n", "  }\n\n", "}\n", "Big"),
    "rust": ("impl Big {\n    const N: i32 = 1;\n", "    pub fn m{0}(&self) -> i32 {{\n", "    }\n\n", "}\n", "Big"),
    "java": ("public class Big {\n  int n = f(1);\n", "  @Override\n  public List<String> m{0}(int a) throws E {{\n", "  }\n\n", "}\n", "Big"),
    "csharp": ("public class Big {\n  int n = f(1);\n", "  public override async Task<int> m{0}(int a) {{\n", "  }\n\n", "}\n", "Big"),
    "dart": ("class Big {\n  int n = f(1);\n", "  Future<int> m{0}(int a) async {{\n", "  }\n\n", "}\n", "Big"),
}


@pytest.mark.parametrize("language", sorted(LONG))
def test_long_containers_give_a_shell_and_methods(language):
    head, begin, end, close, name = LONG[language]
    source = head + "".join(begin.format(i) + "    call();\n" * 20 + end for i in range(9)) + close
    got = syntax.declarations(source, language, 150)
    first = "impl Big" if language == "rust" else "class Big"
    assert [s for s, *_ in got] == [first, *(f"{name}.m{i}" for i in range(9))]
    assert got[0][3] == head + close.rstrip("\n") and got[0][1:3] == (1, source.count("\n"))
    assert all("call();" in body and body.rstrip().endswith("}") for *_, body in got[1:])
    assert syntax.declarations(source, language, 10_000)[0][3] == source.rstrip("\n")


@given(st.sampled_from(sorted(CASES)), st.lists(st.sampled_from(["{", "}", "(", ")", '"', "'", "`", "//", "/*", "*/", "class A", "fn f()", "func g()", "\n", "\n\n", ";", "=>", "x = 1", "namespace N {", "export "]), max_size=40).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_every_line_is_in_one_chunk(language, text):
    """Of whatever text: what is no blank line is in one chunk, in order."""
    got = syntax.declarations(text, language, 3)
    plain = lambda t: [line for line in t.split("\n") if line.strip()]
    assert sorted(line for *_, body in got for line in plain(body)) == sorted(plain(text))


def test_code_files_have_symbols():
    found = list(chunking.chunks_of("/r/a.go", "a.go", CASES["go"][0].encode()))
    assert found[0][2].startswith("# file: a.go | symbol: preamble\npackage main\nimport (\n") and found[3][2].startswith("# file: a.go | symbol: method Wide\n")


# -- a sentence model -----------------------------------------------------------------------


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def lookup_model(table):
    """A model that gives each token its row of a table, in the format's own encoding."""
    weights = b"".join([_field(1, table.shape[0]), _field(1, table.shape[1]), _field(2, 1), _field(8, "table"), _field(9, table.astype("<f4").tobytes())])
    dims = lambda *names: b"".join(_field(1, _field(2, n)) for n in names)
    value = lambda name, kind, shape: _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))
    node = _field(1, "table") + _field(1, "input_ids") + _field(2, "states") + _field(4, "Gather")
    graph = _field(1, node) + _field(2, "g") + _field(5, weights) + _field(11, value("input_ids", 7, dims("b", "t"))) + _field(12, value("states", 1, dims("b", "t", "d")))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


@pytest.fixture
def folder(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {w: i for i, w in enumerate(["<pad>", "[UNK]", "query", "passage", ":", "red", "green", "blue"])}
    tokenizer = Tokenizer(models.WordLevel(vocabulary, "[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    table = np.random.default_rng(1).normal(size=(8, 5)).astype(np.float32)
    (tmp_path / "model.onnx").write_bytes(lookup_model(table))
    return tmp_path, table


def unit(v):
    return v / np.linalg.norm(v)


def test_onnx_embedder(folder, spark):
    import pickle

    path, table = folder
    plain = embed.OnnxEmbedder(str(path), "some-model")
    got = plain.passages(["red", "red green blue", "red " * 600])
    assert np.allclose(got[0], unit(table[5]), atol=1e-6) and np.allclose(got[1], unit(table[[5, 6, 7]].mean(axis=0)), atol=1e-6)
    assert np.allclose(got[2], got[0], atol=1e-5)  # padding has no part, and 512 tokens are read
    assert plain.offsets("red  green, blue") == [0, 5, 10, 12]
    prefixed = embed.OnnxEmbedder(str(path), "multilingual-e5-small")
    assert np.allclose(prefixed.question("red"), unit(table[[2, 4, 5]].mean(axis=0)), atol=1e-6)
    assert np.allclose(prefixed.passages(["red"])[0], unit(table[[3, 4, 5]].mean(axis=0)), atol=1e-6)
    (path / "pooling.json").write_text(json.dumps({"pooling_mode_cls_token": True}))
    first = pickle.loads(pickle.dumps(embed.OnnxEmbedder(str(path), "first")))
    assert np.allclose(first.passages(["green red"])[0], unit(table[6]), atol=1e-6)
    rows = embed.embedded(spark.createDataFrame([("green red",), ("blue",)], "text string"), first).collect()
    assert {r["text"]: tuple(r["vector"]) for r in rows}.keys() == {"green red", "blue"} and all(np.isclose(np.linalg.norm(r["vector"]), 1) for r in rows)
