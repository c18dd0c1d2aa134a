import os

import numpy as np
import pytest

from quern.operators.ann import IvfIndex
from quern.operators.syntax import chunk_file
from quern.plans.indexer import Indexer
from quern.plans.tools import TOOLS, ToolError

GO = 'package main\n\nimport (\n\t"fmt"\n)\n\nfunc hello() {\n\tfmt.Println("}")\n}\n\ntype Server struct {\n\tport int\n}\n\nfunc (s *Server) Start(port int) {\n\thello()\n}\n'
PY = "import os\n\n\n@cache\ndef add(a, b):\n    return a + b\n\n\nclass Calc:\n    def sub(self):\n        return 1\n"


def test_chunks_of_go():
    got = chunk_file("main.go", GO)
    named = {(c.node_type, c.node_name) for c in got if c.node_type != "gap"}
    assert named == {("function_declaration", "hello"), ("type_declaration", "Server"), ("method_declaration", "Start")}
    data = GO.encode()
    assert all(data[c.start_byte : c.end_byte].decode() == c.content and len(c.content_hash) == 64 for c in got)
    assert [(c.start_line, c.end_line) for c in got if c.node_type == "gap"] == [(1, 6)]


def test_chunks_of_other_languages():
    assert {(c.node_type, c.node_name) for c in chunk_file("a.py", PY) if c.node_type != "gap"} == {("decorated_definition", "add"), ("class_definition", "Calc")}
    assert {c.node_name for c in chunk_file("a.rb", "module M\n  def go\n    1\n  end\nend\n") if c.node_name} == {"M", "go"}
    assert {c.node_name for c in chunk_file("a.ts", "export interface A {\n  x: number\n}\nexport function run() {\n  return 1\n}\n") if c.node_name} == {"A", "run"}
    windows = chunk_file("test.xyz", "\n".join(["line content here"] * 100))
    assert [(c.start_line, c.end_line, c.node_type) for c in windows] == [(1, 50, "block"), (41, 90, "block"), (81, 100, "block")]
    assert chunk_file("a.py", None) == chunk_file("a.py", "") == []
    assert chunk_file("broken.py", "def (:\n")[0].node_type == "block"


def test_indexer_lifecycle(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "sub").mkdir(parents=True)
    (root / "main.go").write_text(GO)
    (root / "sub" / "copy.go").write_text(GO)
    (root / "calc.py").write_text(PY)
    index = Indexer(spark, str(root), str(tmp_path / "store"))
    first = index.index()
    assert first.change_type == "full" and first.files_processed == 3 and first.chunks_created > 5
    assert first.chunks_embedded < first.chunks_created  # copies are embedded once
    assert index.index().change_type == "none"
    (root / "main.go").write_text(GO.replace("hello", "goodbye"))
    (root / "calc.py").unlink()
    again = index.index()
    assert (again.change_type, again.files_processed, again.files_deleted) == ("incremental", 1, 1) and again.cache_hits >= 1
    stats = index.stats()
    assert stats["files"] == 2 and stats["by_language"] == {"go": stats["locations"]}
    assert index.orphans().count() > 0
    assert index.index(force=True).change_type == "full"
    assert TOOLS["search_keyword"](index, "func goodbye")[0]["path"] == "main.go"
    assert TOOLS["get_file"](index, "main.go", 1, 1)["content"] == "package main"
    assert {r["name"] for r in TOOLS["find_symbol"](index, "server")} == {"Server"}
    assert [r["name"] for r in TOOLS["list_defs_in_file"](index, "main.go")] == ["goodbye", "Server", "Start"]
    assert TOOLS["search_semantic"](index, "type Server struct port int")[0]["node_name"] == "Server"
    assert TOOLS["hybrid_search_v2"](index, "goodbye")
    with pytest.raises(ToolError):
        TOOLS["search_keyword"](index, "")
    with pytest.raises(ToolError):
        TOOLS["get_file"](index, "main.go", 100)
    assert TOOLS["search_semantic"](Indexer(spark, str(root), str(tmp_path / "none")), "x") == {"available": False, "error": "no index"}


def test_second_run_reads_no_content(spark, tmp_path, monkeypatch):
    from quern.plans import indexer

    root = tmp_path / "repo"
    root.mkdir()
    for name in ("a.go", "b[1].go", "c.go"):
        (root / name).write_text(GO.replace("hello", "f" + name[0]))
    read = []
    scan = indexer.scan_tree
    monkeypatch.setattr(indexer, "scan_tree", lambda *a, **k: read.append(k.get("paths")) or scan(*a, **k))
    index = Indexer(spark, str(root), str(tmp_path / "store"))
    index.index()
    assert read == [None]
    assert index.index().change_type == "none" and read == [None]
    (root / "b[1].go").write_text(GO.replace("hello", "another"))
    os.utime(root / "c.go", (1, 1))  # touched, with the same content
    got = index.index()
    assert (got.change_type, got.files_processed) == ("incremental", 1) and sorted(read[-1]) == ["b[1].go", "c.go"]
    assert {r.node_name for r in index.locations.read().filter("node_type = 'function_declaration'").collect()} == {"fa", "another", "fc"}
    assert index.index().change_type == "none" and len(read) == 2


def test_run_that_failed_is_done_again(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.go").write_text(GO)
    index = Indexer(spark, str(root), str(tmp_path / "store"))
    index.index()
    (root / "a.go").write_text(GO.replace("hello", "another"))
    failing = Indexer(spark, str(root), str(tmp_path / "store"))
    failing._places = None
    with pytest.raises(TypeError):
        failing.index()
    assert {r.node_name for r in index.locations.read().filter("node_type = 'function_declaration'").collect()} == {"hello"}
    assert index.index().files_processed == 1 and index.index().change_type == "none"
    assert {r.node_name for r in index.locations.read().filter("node_type = 'function_declaration'").collect()} == {"another"}


def test_index_recall_on_clusters(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(8, 16))
    vectors = [(n, [float(x) for x in centres[n % 8] + 0.2 * r.normal(size=16)]) for n in range(400)]
    df = spark.createDataFrame(vectors, "id int, v array<float>").repartition(4)
    index = IvfIndex.build(df, "id", "v", lists=8)
    x = np.array([v for _, v in vectors])
    hits = 0
    for n in range(0, 400, 100):
        cos = x @ x[n] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[n])
        hits += len({i.id for i in index.search(vectors[n][1], 10, 3).collect()} & set(np.argsort(-cos)[:10].tolist()))
    assert hits >= 36
    # an index that was written is opened, and only the probed lists are read
    again = IvfIndex(spark, index.folder, "id", "v")
    found = again.search(vectors[0][1], 10, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and plan.count(" IN ") >= 1
    assert again.search(vectors[0][1], 400, 8).count() == 400


def test_index_of_nothing(spark):
    index = IvfIndex.build(spark.createDataFrame([], "id int, v array<float>"), "id", "v")
    assert index.search([1.0, 0.0]).collect() == []
