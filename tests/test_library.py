import os
import subprocess

import pytest

from quarry import render
from quarry.cli import main
from quarry.operators.library import Library
from quarry.serve import answer, serve, server
from quarry.streaming.feed import follow


def put(root, rel, text):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as file:
        file.write(text)
    return path


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ws"))
    put(root, "app.py", "import os\n\ndef readZebra(path):\n    return open(path)\n")
    put(root, "api/__init__.py", "VERSION = 1\n")
    put(root, "api/handler.py", "class Handler:\n    def serve_giraffe(self):\n        return 1\n")
    put(root, "api/tests/test_handler.py", "def test_giraffe():\n    assert serve_giraffe()\n")
    put(root, "docs/guide.md", "# Guide\nintro\n## Zebra\nhow zebras are read\n")
    put(root, "node_modules/x.js", "zebra()")
    put(root, ".gitignore", "secret.py\n")
    put(root, "secret.py", "zebra = 1")
    return root


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    return Library(spark, str(tmp_path_factory.mktemp("home")))


def test_build_and_search(library, tree):
    done = library.build(tree, tags=["team"])
    ignored = 1 if subprocess.run(["which", "git"], capture_output=True).returncode == 0 else 0
    assert (done["files"], done["ignored"]) == (6 - ignored, ignored)
    rows = library.query("readZebra", 3, directory=tree + "/api").collect()
    assert rows[0]["source"].endswith("app.py") and rows[0]["start_line"] == 3
    assert rows[0]["text"].startswith("# file: app.py | symbol: function readZebra\n")
    assert set(rows[0].asDict()) == {"rank", "source", "text", "start_line", "end_line", "loc"}
    assert render.compact(rows).split("\n")[0] == rows[0]["loc"]
    assert "     3  def readZebra" in render.full(rows)


def test_tests_rank_lower_unless_asked_for(library, tree):
    first = lambda q: library.query(q, 1, directory=tree).collect()[0]["source"]
    assert first("serve_giraffe").endswith("api/handler.py")
    assert first("tests test_giraffe assert").endswith("tests/test_handler.py")


def test_nothing_changed_then_one_file(library, tree, spark):
    assert library.build(tree)["skipped"]
    before = {r["text"]: r["vector"] for r in library.store(tree).read("chunks").collect()}
    put(tree, "extra.py", "def walrus():\n    return 3\n")
    os.utime(os.path.join(tree, "app.py"), (1, 1))
    changes = library.build(tree)["changes"]
    assert (changes["new"], changes["changed"]) == (1, 1)
    after = library.store(tree).read("chunks").collect()
    assert all(before[r["text"]] == r["vector"] for r in after if r["text"] in before)
    assert sorted(r["row_id"] for r in after) == list(range(len(after)))
    os.remove(os.path.join(tree, "extra.py"))
    assert library.build(tree)["changes"]["deleted"] == 1


def test_folder_filter_and_routes(library, tree):
    assert {r["source"] for r in library.query("giraffe", 5, "api/", tree).collect()} == {f"{tree}/api/{f}" for f in ("__init__.py", "handler.py", "tests/test_handler.py")}
    assert library.route(tags=["team"]) == [tree]
    with pytest.raises(KeyError):
        library.route(tags=["nobody"])
    with pytest.raises(KeyError):
        library.query("x", directory="/nowhere")
    with pytest.raises(ValueError):
        library.query("x", 0, directory=tree)


def test_split_and_back(library, tree):
    done = library.build(tree, split=True)
    assert [os.path.basename(c) for c in done["children"]] == ["api", "docs"]
    assert library.entry(tree + "/api")["tags"] == ["folder:api", "team"]
    assert library.query("serve_giraffe", 1, directory=tree).collect()[0]["source"].endswith("api/handler.py")
    assert [os.path.basename(d) for d in library.split(tree, ["docs"])] == ["docs"]
    assert library.entry(tree)["skip"] == ["docs"]
    assert library.split(tree, None) == [tree + "/api"]
    assert library.entry(tree)["split"] is None and library.store(tree + "/api").generation() is None
    library.build(tree)


def test_other_model_is_an_error(library, tree, spark):
    from quarry.operators.embed import HashingEmbedder

    with pytest.raises(ValueError, match="hashing-64"):
        Library(spark, library.home, HashingEmbedder(32)).query("x", directory=tree)


def test_service(library, tree):
    status, body = answer(library, "/query", {"question": "zebra", "directory": tree, "top_k": 2})
    assert status == 200 and len(body["results"]) == 2 and "rank" not in body["results"][0]
    assert answer(library, "/query", {})[0] == 400
    status, body = answer(library, "/query", {"question": "zebra", "tags": []})
    assert status == 200 and body["results"] and body["stale"] == []
    assert answer(library, "/query", {"question": "zebra"})[1] == body == answer(library, "/query", {"question": "zebra", "all": True})[1]
    assert answer(library, "/query", {"question": "x", "all": False})[0] == 400
    assert answer(library, "/query", {"question": "x", "tags": ["no"]})[0] == 404
    assert answer(library, "/health", {}) == (200, {"ok": True})
    assert answer(library, "/index", {})[0] == 400
    assert len(answer(library, "/list", {})[1]) == 1
    assert answer(library, "/nothing", {})[0] == 404


def test_older_formats_are_reported(library, tree, spark, tmp_path):
    old = str(tmp_path / "old")
    put(old, "a.py", "def zebraOld():\n    pass\n")
    library.build(old)
    store = library.store(old)
    spark.createDataFrame([(library.embedder.name, 1)], "model string, format int").write.mode("overwrite").parquet(store.location("about"))
    assert library.stale() == [old] and library.stale([tree]) == []
    assert answer(library, "/query", {"question": "zebra", "directory": old})[0] == 409
    status, body = answer(library, "/query", {"question": "zebra"})
    assert status == 200 and body["stale"] == [old] and all(not r["source"].startswith(old) for r in body["results"])
    assert not library.build(old).get("skipped") and library.stale() == []
    assert library.query("zebraOld", 1, directory=old).collect()[0]["source"] == old + "/a.py"
    library.remove(old)


def test_service_over_a_socket(library, tree):
    import json
    import threading
    import urllib.error
    import urllib.request

    http = server(library)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def post(path, raw):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}{path}", raw) as reply:
                return reply.status, json.loads(reply.read())
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())

    try:
        status, body = post("/query", json.dumps({"question": "zebra", "directory": tree, "top_k": 1}).encode())
        assert status == 200 and len(body["results"]) == 1 and "stale" not in body
        assert post("/query", b"{")[0] == 400 and post("/query", b"[]")[0] == 400 and post("/query", b"{}")[0] == 400
        assert post("/health", None) == (200, {"ok": True}) and post("/invalidate", b"{}") == (200, {"ok": True})
    finally:
        http.shutdown()
        http.server_close()


def test_service_ends_when_idle(library, monkeypatch):
    import threading
    import time

    monkeypatch.setattr("quarry.serve.signal.signal", lambda *_: None)
    running = threading.Thread(target=serve, args=(library, 0, 0.3), daemon=True)
    began = time.time()
    running.start()
    running.join(20)
    assert not running.is_alive() and time.time() - began >= 0.3


def test_stream_of_notices(library, tree, spark, tmp_path):
    put(tree, "late.py", "def ocelot():\n    pass\n")
    spark.createDataFrame([(f"{tree}/late.py",)], "path string").write.parquet(str(tmp_path / "in"))
    notices = spark.readStream.schema("path string").parquet(str(tmp_path / "in"))
    follow(notices, library, str(tmp_path / "checkpoint")).awaitTermination()
    assert library.query("ocelot", 1, directory=tree).collect()[0]["source"].endswith("late.py")


def test_commands(library, tree, capsys):
    run = lambda *a: main(list(a), library)
    assert run("query", "zebra", tree, "-c", "-k", "2") == 0 and len(capsys.readouterr().out.split()) == 2
    assert run("tag", tree, "b", "a", "b") == 0 and run("describe", tree, "an app") == 0
    assert run("tags") == 0 and capsys.readouterr().out.split() == ["a", tree, "b", tree]
    assert run("cat") == 0 and "an app" in capsys.readouterr().out
    assert run("ls") == 0 and run("model") == 0 and "hashing-64" in capsys.readouterr().out
    assert run("reindex", tree) == 0 and run("add", tree + "/docs", "-t", "d") == 0
    assert run("rm", tree) == 0 and run("rm", tree) == 1
    assert run("query", "zebra", tree) == 1 and run("index", tree + "/no") == 1
