import json
import os

import pytest
from pyspark.sql import functions as F

from quern.sources.ignore import ignored_by, parse_gitignore
from quern.sources.records import IndexSettings, Registry, read_cases, read_tags
from quern.sources.tree import scan_tree
from quern.sources.versioned import CommitConflict, VersionedTable, net_changes, process


def test_gitignore(spark):
    patterns = parse_gitignore("# c\n\n*.log\n!keep.log\n/build\ndocs/*.tmp\nsecret/\r\n")
    paths = {"a.log": True, "x/a.log": True, "keep.log": False, "build": True, "build/x": True, "x/build": False, "docs/a.tmp": True, "docs/x/a.tmp": False, "x/secret/y": True, "secret.txt": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r[0]: r[1] for r in df.select("p", ignored_by(F.col("p"), patterns)).collect()} == paths


def test_scan_tree(spark, tmp_path):
    for name, text in {"src/a.go": "package a\n", "src/b.txt": "b", "node_modules/x.js": "x", ".hidden/y": "y", "deep/er/c.py": "é"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r for r in scan_tree(spark, str(tmp_path), ["*.txt"], with_content=True).collect()}
    assert set(got) == {"src/a.go", "deep/er/c.py"}
    assert got["deep/er/c.py"].content == "é" and got["src/a.go"].size == 10 and len(got["src/a.go"].hash) == 64


def test_cases_and_tags(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('// note\n\n{"id": "a", "category": "x", "ground_truth": {"files": ["f"], "lines": {"f": [1, 2]}}}\n{"id": "b", "category": "y"}\n')
    assert [r.id for r in read_cases(spark, str(tmp_path / "c.jsonl"), ["x"]).collect()] == ["a"]
    (tmp_path / "t.json").write_text('{"_type": "tag", "name": "f", "path": "a.go", "line": 3, "scope": "S", "scopeKind": "struct"}\nnot json\n{"_type": "ptag", "name": "x", "path": "y"}\n')
    assert [(r.name, r.scope) for r in read_tags(spark, str(tmp_path / "t.json")).collect()] == [("f", "struct:S")]


def test_registry(tmp_path):
    r = Registry.open(str(tmp_path / "r.json"))
    r.add(str(tmp_path / "p"))
    r.add(str(tmp_path / "p"))
    r.update(str(tmp_path / "p"), {"symbols": 3}, watch=False)
    again = Registry.open(str(tmp_path / "r.json"))
    assert len(again.projects) == 1 and again.totals()["symbols"] == 3 and again.watched() == []
    os.makedirs(tmp_path / "q" / ".index")
    assert again.discover(str(tmp_path))[1] == [str((tmp_path / "q").resolve())]
    with pytest.raises(KeyError):
        again.get("/nowhere")
    assert json.loads((tmp_path / "r.json").read_text())["version"] == 1


def test_index_settings():
    IndexSettings.preset("high_recall").validate()
    with pytest.raises(ValueError):
        IndexSettings(m=1).validate()
    assert IndexSettings().memory_bytes(1000, 768) == 1000 * 768 * 4 + 1000 * 16 * 16


def test_versions_and_changes(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() == 0 and t.read() is None
    t.append(spark.range(0, 10).coalesce(2))
    t.append(spark.range(10, 15).coalesce(1))
    t.delete("id in (3, 12)")
    t.delete("id = 4")
    assert sorted(r.id for r in t.read().collect()) == [i for i in range(15) if i not in (3, 4, 12)]
    assert sorted(r.id for r in t.read(2).collect()) == list(range(15))
    delta = lambda a, b: sorted((r._change, r.id) for r in (t.changes(a, b).collect() if t.changes(a, b) is not None else []))
    assert delta(1, 2) == [("insert", i) for i in range(10, 15)]
    assert delta(2, 3) == [("delete", 3), ("delete", 12)]
    assert delta(3, 4) == [("delete", 4)]
    assert delta(2, 4) == [("delete", 3), ("delete", 4), ("delete", 12)]
    assert delta(4, 2) == [("insert", 3), ("insert", 4), ("insert", 12)]
    assert delta(4, 4) == []
    t.rewrite(spark.range(100, 102))
    assert ("insert", 100) in delta(4, 5) and ("delete", 0) in delta(4, 5) and ("delete", 3) not in delta(4, 5)


def test_processing_survives_failures(spark, tmp_path):
    source, sink = VersionedTable(spark, str(tmp_path / "s")), VersionedTable(spark, str(tmp_path / "o"))
    source.append(spark.range(0, 5))

    def fails(df):
        df.count()
        raise RuntimeError("lost half-way")

    with pytest.raises(RuntimeError):
        process(source, sink, fails)
    assert sink.version() == 0
    assert process(source, sink, lambda df: df.withColumn("twice", F.col("id") * 2)) == 1
    assert process(source, sink, lambda df: df) is None
    source.append(spark.range(5, 7))
    source.delete("id = 1")
    process(source, sink, lambda df: df.withColumn("twice", F.col("id") * 2))
    got = sorted((r._change, r.id) for r in sink.read().collect())
    assert got == [("delete", 1)] + [("insert", i) for i in range(7)]
    # two runs of one consumer: the slower one loses its commit
    source.append(spark.range(7, 8))

    def overtaken(df):
        process(source, sink, lambda x: x.withColumn("twice", F.lit(0).cast("bigint")))
        return df.withColumn("twice", F.lit(1).cast("bigint"))

    with pytest.raises(CommitConflict):
        process(source, sink, overtaken)
    assert sink.read().filter("id = 7").count() == 1


def test_torn_manifest_is_no_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(spark.range(3))
    torn = tmp_path / "t" / "_manifests" / "v000000000002.json"
    for text in ("", '{"files": {'):
        torn.write_text(text)
        assert t.version() == 1 and t.read().count() == 3
    assert t.append(spark.range(3, 5)) == 2 and t.read().count() == 5
    with pytest.raises(CommitConflict):
        t._commit(2, {"files": {}, "meta": {}})
    assert t.read().count() == 5
    assert sorted(f for f in os.listdir(tmp_path / "t" / "_manifests") if not f.endswith(".crc")) == ["v000000000001.json", "v000000000002.json"]


def test_replace_keeps_what_is_the_same(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    state = lambda rows: spark.createDataFrame(rows, "root string, path string, size int")
    assert t.replace(state([("r", "a", 1), ("r", "b", 2), ("r", "c", None), (None, "x", 1)]), ["root", "path"]) == 1
    assert t.replace(state([("r", "c", None), ("r", "b", 2), ("r", "a", 1)]), ["root", "path"]) == 1
    assert t.replace(state([("r", "a", 1), ("r", "b", 3), ("r", "d", None)]), ["root", "path"]) == 2
    delta = t.changes(1, 2)
    assert sorted((r._change, r.path) for r in delta.collect()) == [("delete", "b"), ("delete", "c"), ("insert", "b"), ("insert", "d")]
    assert {tuple(r) for r in net_changes(delta, ["root", "path"]).collect()} == {("r", "b", "modified"), ("r", "c", "deleted"), ("r", "d", "added")}
    assert sorted(map(tuple, t.read().collect())) == [("r", "a", 1), ("r", "b", 3), ("r", "d", None)]
    assert t.replace(state([("r", "a", 1)]), ["root", "path"]) == 3
    assert t.replace(state([("r", "a", 1), ("r", "b", 9)]), ["root", "path"]) == 4
    assert sorted(map(tuple, t.read().collect())) == [("r", "a", 1), ("r", "b", 9)]
    assert {tuple(r) for r in net_changes(t.changes(2, 4), ["root", "path"], ["size"]).collect()} == {("r", "b", "modified"), ("r", "d", "deleted")}
