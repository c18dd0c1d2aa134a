from pyspark.sql import functions as F

from quern.functions.codec import vector_from_bytes, vector_from_json, vector_to_bytes, vector_to_json
from quern.functions.text import extract_paths, truncate_snippet
from quern.operators.search import extract_name
from quern.plans import report


def test_codecs(spark):
    df = spark.createDataFrame([([1.0, -2.5],), ([],), (None,)], "v array<float>")
    back = df.select(vector_from_bytes(vector_to_bytes("v")), vector_from_json(vector_to_json(F.col("v")))).collect()
    assert [list(r[0]) if r[0] is not None else None for r in back] == [[1.0, -2.5], [], None] == [r[1] for r in back]
    bad = spark.createDataFrame([(bytearray(b"abc"), "[1, null]"), (bytearray(b""), "no"), (None, None)], "b binary, t string")
    assert [(r[0], r[1]) for r in bad.select(vector_from_bytes("b"), vector_from_json(F.col("t"))).collect()] == [(None, None), ([], None), (None, None)]


def test_texts(spark):
    df = spark.createDataFrame([("see src/a.tsx lib/x.cpp b.json src/a.tsx",), ("\n\nabcd\nefgh\nij",), ("x" * 50,)], "t string")
    paths = df.select(extract_paths(F.col("t"))).first()[0]
    assert paths[:3] == ["src/a.ts", "lib/x.c", "b.js"] and "src/a.tsx" in paths
    cut = [r[0] for r in df.select(truncate_snippet(F.col("t"), 10)).collect()]
    assert cut[1] == "abcd\nefgh\n..." and cut[2] == "x" * 10 + "..."
    names = spark.createDataFrame([("func main() {",), ("  type Server struct {",), ("({",), (None,)], "t string")
    assert [r[0] for r in names.select(extract_name(F.col("t"))).collect()] == ["main", "Server struct", "unknown", "unknown"]


def test_report(spark, tmp_path):
    cases = spark.createDataFrame([("c1", (["src/a.go"], ["Run"])), ("c2", ([], []))], "id string, ground_truth struct<files: array<string>, symbols: array<string>>")
    schema = "test_case_id string, mode string, success boolean, output string, duration_ms bigint, tokens_used bigint, cost double"
    results = spark.createDataFrame([("c1", "with_tools", True, "it is SRC/a.go and Run", 100, 10, 0.5), ("c1", "without_tools", True, "src/b.go", 200, 40, 1.0), ("c2", "with_tools", False, None, 1, 1, 0.0), ("c2", "without_tools", True, "x", 1, 1, 0.0)], schema)
    made = report.evaluate(cases, results)
    assert {(r["test_case_id"], r["mode"]): r["f1"] for r in made["results"]}[("c1", "with_tools")] == 1.0
    assert made["changes"]["accuracy"] == 100.0 and made["changes"]["avg_tokens"] > 70
    assert report.load(report.save(made, str(tmp_path)))["changes"] == made["changes"]
    assert "with_tools: 2 runs" in report.text(made)
    assert report.reduction(0, 5) == 0
