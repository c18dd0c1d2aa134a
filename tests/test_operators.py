import math

import numpy as np

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions import vectors as V
from quern.functions.identity import canonical_hash, canonical_path, whole_seconds
from quern.operators import chunking, fusion, increments, references, search, store
from quern.operators.knn import knn, knn_many
from quern.streaming import watch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_canonical_hash(spark):
    df = spark.createDataFrame([(" SHA256:00AB ",), ("ab",), ("0xAB",), ("0",), ("",), (None,), ("not hex",)], "h string")
    assert [r[0] for r in df.select(canonical_hash(F.col("h"))).collect()] == ["ab", "ab", "ab", "0", None, None, "nothex"]


def test_canonical_path(spark):
    df = spark.createDataFrame([("./a//b/./c.go", "/r"), ("a\\b\\c.go", "/r"), ("/r/a/x/../b/c.go", "/r/"), ("", "/r"), (None, "/r"), ("a/../..", "/r"), ("a/b/c.go", None)], "p string, r string")
    got = [r[0] for r in df.select(canonical_path(F.col("p"), F.col("r"))).collect()]
    assert got == ["a/b/c.go"] * 3 + [None, None, None, "a/b/c.go"]


def test_whole_seconds(spark):
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_123,), (None,)], "t bigint")
    assert [r[0] for r in df.select(whole_seconds(F.col("t"))).collect()] == [1_700_000_000, 1_700_000_000, None]


def test_references_match_semantics(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", None), (4, "c", None), (5, None, None), (6, None, "x"), (7, "a", "x"), (2, "a", "y")], "id int, k1 string, k2 string")
    targets = spark.createDataFrame([("a", "x", 9), ("b", "y", 9), (None, "z", 9), ("a", "x", 9)], "k1 string, k2 string, id int")
    ids = lambda m: sorted(r.id for r in references.orphan_references(refs, targets, ["k1", "k2"], match=m).collect())
    assert ids("simple") == [2, 2]
    assert ids("partial") == [2, 2, 4]
    assert ids("full") == [2, 2, 3, 4, 6]
    empty = targets.limit(0)
    assert len(references.orphan_references(refs, empty, ["k1", "k2"]).collect()) == 4
    assert references.orphan_references(refs.limit(0), targets, ["k1", "k2"]).collect() == []


def test_reference_hot_key(spark):
    refs = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    targets = spark.range(1500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    assert references.orphan_references(refs, targets, ["k"]).count() == 1000 + 1000


RUNS = "run_id bigint, repo_root string, started_at bigint, finished_at bigint, status string, logged_at bigint"


def test_changes_depend_on_committed_runs_only(spark):
    runs = spark.createDataFrame([(1, "r", 100, None, "running", 100), (1, "r", 100, 150, "ok", 150), (2, "r", 200, None, "running", 200), (2, "r", 200, 210, "failed", 210), (3, "q", 100, None, "running", 100)], RUNS)
    files = spark.createDataFrame([("r", "a", 1, 1, 120), ("r", "a", 2, 2, 205), ("r", "b", 5, 5, 130), ("r", "b", 5, 5, 130), ("r", "gone", 1, 1, 140), ("r", "early", 1, 1, 50), ("q", "z", 1, 1, 120), (None, "a", 1, 1, 120), ("r", None, 1, 1, 120)], "repo_root string, path string, mtime bigint, size bigint, indexed_at bigint")
    scans = spark.createDataFrame([(7, "r", "a", 2, 2, 300), (7, "r", "b", 5000, 5, 300), (7, "r", "b", 5, 5, 301), (6, "r", "gone", 1, 1, 290), (7, "r", "early", 1, 1, 300), (7, "r", None, 1, 1, 300)], "scan_id bigint, repo_root string, path string, mtime bigint, size bigint, seen_at bigint")
    want = [("r", "a", "modified"), ("r", "early", "added"), ("r", "gone", "deleted")]
    assert rows(increments.files_to_process(files, runs, scans)) == want
    assert rows(increments.files_to_process(files, runs, scans)) == want
    done = runs.unionByName(spark.createDataFrame([(2, "r", 200, 220, "ok", 220)], RUNS))
    assert ("r", "a", "modified") not in rows(increments.files_to_process(files, done, scans))
    assert rows(increments.files_to_process(files.limit(0), runs, scans))[0] == ("r", "a", "added")
    assert increments.files_to_process(files, runs, scans.limit(0)).count() == 0
    assert {r[2] for r in rows(increments.files_to_process(files, runs.limit(0), scans))} == {"added"}


def test_line_slice(spark):
    df = spark.createDataFrame([("line 1\r\nline 2\nline 3\nline 4\nline 5\n",)], "t string")
    get = lambda s, e: df.select(X.line_slice(F.col("t"), s, e)).first()[0]
    assert get(1, 2) == "line 1\nline 2"
    assert get(5, 5) == "line 5"
    assert get(0, 3) == "line 1\nline 2\nline 3"
    assert get(3, 0) == "line 3\nline 4\nline 5"
    assert get(4, 2) == ""
    assert get(100, 0) is None


def test_chunk_lines_follows_the_loop(spark):
    def loop(n, size, overlap, least):
        out, cur = [], 0
        while cur < n:
            end = min(cur + size, n)
            if end - cur >= least:
                out.append((cur + 1, end))
            if end >= n:
                break
            cur = max(end - overlap, cur + 1)
        return out or ([(1, n)] if n else [])

    for n in (0, 1, 3, 8, 10, 11, 30, 57):
        df = spark.createDataFrame([("p", [f"l{i}" for i in range(n)])], "path string, lines array<string>")
        got = [(r.start_line, r.end_line) for r in chunking.chunk_lines(df, "path", "lines", 10, 2, 5).orderBy("start_line").collect()]
        assert got == loop(n, 10, 2, 5), n


def test_chunk_fallback_offsets(spark):
    text = "\n".join(f"zeile ä {i}" for i in range(100))
    df = spark.createDataFrame([("p", text), ("empty", ""), ("null", None)], "path string, text string")
    got = chunking.chunk_fallback(df, "path", "text").orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in got] == [(1, 50), (41, 90), (81, 100)]
    data = text.encode()
    assert data[got[1].start_byte : got[1].end_byte].decode() == "\n".join(text.split("\n")[40:90])


def test_chunk_by_symbols_covers_every_line(spark):
    lines = [f"l{i}" for i in range(60)]
    files = spark.createDataFrame([("p", lines), ("q", lines[:4])], "path string, lines array<string>")
    symbols = spark.createDataFrame([("p", 10, "function"), ("p", 40, "class"), ("p", 58, "function"), ("p", 5, "variable")], "path string, line int, kind string")
    got = chunking.chunk_by_symbols(files, symbols, "path", "lines", 12, 4, 5).collect()
    covered = {n for r in got if r.path == "p" for n in range(r.start_line, r.end_line + 1)}
    assert covered == set(range(1, 61))
    assert [(r.start_line, r.end_line) for r in got if r.path == "q"] == [(1, 4)]


def test_search_keyword_limits(spark):
    df = spark.createDataFrame([("b", "hit\nmiss\nhit"), ("a", "hit"), ("c", None)], "path string, text string")
    got = search.search_keyword(df, "^hit$", "path", "text", 2).collect()
    assert [(r.path, r.line, r.score) for r in got] == [("a", 1, 100), ("b", 1, 99)]
    try:
        search.search_keyword(df, "(", "path", "text")
        raise AssertionError("an invalid pattern must fail")
    except search.SearchError:
        pass


def test_vector_metrics(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(V.cosine(F.col("a"), F.col("b")), V.euclidean(F.col("a"), F.col("b")), V.manhattan(F.col("a"), F.col("b")), V.dot(F.col("a"), F.col("b"))).collect()]
    assert got[0][0] == 0 and math.isclose(got[0][1], math.sqrt(5)) and got[0][2] == 3
    assert math.isclose(got[1][0], 1) and got[1][3] == 25
    assert got[2] == (0, 0, 0, 0) and got[3][0] == 0
    V.register_sql(spark)
    assert spark.sql("select vec_dot(array(1D, 2D), array(3D, 4D))").first()[0] == 11


def test_knn_axes(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [1.0, 1.0, 0.0]), (5, None)], "id int, v array<float>")
    q = spark.createDataFrame([([1.0, 0.0, 0.0],)], "q array<float>")
    got = knn(df, q, "id", "v", 3).collect()
    assert [r.id for r in got] == [1, 4, 2] and got[0].distance == 0
    assert knn(df, q, "id", "v", 0).collect() == []
    assert len(knn(df, q, "id", "v", 10).collect()) == 4


def test_rrf_arithmetic(spark):
    lists = spark.createDataFrame([("a", "one", 1.0, 1), ("b", "one", 0.8, 2), ("a", "two", 0.5, 1)], "id string, source string, score double, rank int")
    got = {r.id: r for r in fusion.rrf(lists).collect()}
    assert abs(got["a"].rrf_score - 2 / 61) < 1e-6 and abs(got["b"].rrf_score - 1 / 62) < 1e-6
    assert got["a"].sources == ["one", "two"]
    weighted = {r.id: r.rrf_score for r in fusion.rrf(lists, {"one": 0.0, "two": 0.5}).collect()}
    assert abs(weighted["a"] - (1 / 61 + 0.5 / 61)) < 1e-6
    assert [r.id for r in fusion.top_fused(fusion.rrf(lists), 1).collect()] == ["a"]


def test_rerank_buckets(spark):
    c = spark.createDataFrame([("a", 1, 0.4), ("b", 2, 0.3), ("c", 3, 0.2), ("d", 4, 0.1)], "id string, place int, rrf_score double")
    s = spark.createDataFrame([("a", 0.8), ("b", 0.9)], "id string, rerank_score double")
    assert [r.id for r in fusion.rerank(c, s, 2).orderBy("place").collect()] == ["b", "a", "c", "d"]
    assert [r.id for r in fusion.rerank(c, s, 2, 0.85).orderBy("place").collect()] == ["b", "c", "d"]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "B", 99), (3, "C", 99)], "k int, v string, t int")
    assert rows(store.upsert_replace(old, new, ["k"])) == [(1, "a", 10), (2, "B", 99), (3, "C", 99)]
    assert rows(store.upsert_columns(old, new, ["k"], ["v"])) == [(1, "a", 10), (2, "B", 20), (3, "C", 99)]


def test_cache_put_keeps_the_first_vector(spark):
    cache = spark.createDataFrame([("h", [1.0], "m", 1, 5, 1, 5)], "content_hash string, embedding array<float>, model string, dimensions int, created_at bigint, access_count bigint, last_accessed bigint")
    puts = spark.createDataFrame([("h", [9.0], "m", 1), ("n", [2.0], "m", 1)], "content_hash string, embedding array<float>, model string, dimensions int")
    got = {r.content_hash: r for r in store.cache_put(cache, puts, 7).collect()}
    assert got["h"].embedding == [1.0] and got["h"].access_count == 2 and got["h"].last_accessed == 7 and got["h"].created_at == 5
    assert got["n"].embedding == [2.0] and got["n"].access_count == 1


def test_changed_files_compare_multisets(spark):
    old = spark.createDataFrame([("f", "h1"), ("f", "h1"), ("g", "h2"), ("gone", "h3")], "path string, h string")
    new = spark.createDataFrame([("f", "h1"), ("g", "h2"), ("fresh", "h4")], "path string, h string")
    assert rows(store.changed_files(old, new, ["path"], "h")) == [("f",), ("fresh",)]


def test_route_takes_the_first_project(spark):
    events = spark.createDataFrame([(1, "/w/a/x/f.go"), (2, "/w/b/f.go"), (3, "/other/f"), (4, None)], "id int, path string")
    projects = spark.createDataFrame([("/w/a", 2), ("/w/a/x", 1), ("/w/b", 3)], "project_path string, ordinal int")
    assert rows(watch.route(events, projects, "path").select("id", "project").fillna("", ["project"])) == [(1, "/w/a/x"), (2, "/w/b"), (3, ""), (4, "")]


def test_debounce_stream_equals_batch(spark, small, tmp_path):
    source = str(tmp_path / "events")
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(source)
    batch = {(r.project, r.fire_at): r.events for r in watch.debounce(events.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "12 hours").collect()}
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got: dict = {}

    def run(df, batch_id):
        for r in df.collect():
            got[(r.project, r.fire_at)] = r.events

    q = watch.start_worker(watch.debounced_stream(stream, "user_id", "ts", "12 hours", "3650 days"), run, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert all(batch[k] == v for k, v in got.items())
    # with a short watermark sessions close
    stream = spark.readStream.schema(events.schema).parquet(source)
    q = watch.start_worker(watch.debounced_stream(stream, "user_id", "ts", "12 hours", "1 hour"), run, str(tmp_path / "ckpt2"))
    q.awaitTermination(120)
    assert got and all(batch[k] == v for k, v in got.items())


def test_search_with_a_query_set(spark):
    r = np.random.default_rng(3)
    vectors = [(f"v{n:03d}", [float(x) for x in r.normal(size=6)], n) for n in range(150)] + [("same", None, 1), ("short", [1.0], 2), (None, [1.0] * 6, 3), ("none", [], 4), ("zero", [0.0] * 6, 5)]
    df = spark.createDataFrame(vectors, "id string, v array<double>, query int").repartition(3)
    asked = df.filter("id in ('v000', 'v100', 'short', 'zero')")
    for metric in V.METRICS:
        got = {}
        for x in knn_many(df, asked, "id", "v", 4, metric, block=16).collect():
            got.setdefault(x["query"], []).append((x.distance, x.id, x.score))
        assert {q: len(x) for q, x in got.items()} == {"v000": 4, "v100": 4, "zero": 4, "short": 1}
        for q in ("v000", "v100", "zero"):
            own = next(v for i, v, _ in vectors if i == q)
            assert sorted(got[q]) == [(x.distance, x.id, x.score) for x in knn(df.filter("size(v) = 6 and id is not null"), own, "id", "v", 4, metric).collect()]
    assert knn_many(df, asked.limit(0), "id", "v").collect() == [] == knn_many(df.limit(0), asked, "id", "v").collect() == knn_many(df, asked, "id", "v", 0).collect()
