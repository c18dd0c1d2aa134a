import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from quern.functions.embed import embed
from quern.functions.remote import RemoteEmbedder, ServiceError, remote_scores
from quern.plans.migrate import differences, migrate
from quern.sources.records import read_matches
from quern.sources.versioned import VersionedTable


@pytest.fixture(scope="module")
def service():
    seen = {"busy": 2, "keys": set()}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen["keys"].add(self.headers.get("Authorization"))
            if self.path == "/busy" and seen["busy"]:
                seen["busy"] -= 1
                self.send_error(503)
                return
            if self.path == "/none":
                self.send_error(404)
                return
            texts = body.get("input", [])
            vector = lambda t: [float(len(t)), 1.0, 0.0]
            answer = {
                "/data": {"data": [{"index": n, "embedding": vector(t)} for n, t in reversed(list(enumerate(texts)))]},
                "/busy": {"embeddings": [vector(t) for t in texts]},
                "/short": {"embeddings": [[1.0] for _ in texts]},
                "/rank": {"results": [{"index": n, "relevance_score": t.count(body.get("query", "?"))} for n, t in enumerate(body.get("documents", [])) if t]},
            }[self.path]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_remote_embedder(spark, service):
    url, seen = service
    own = RemoteEmbedder(f"{url}/data", "m", 3, key="k", batch=2)
    assert own.available() and own.embed(["a", "bbb", ""]).tolist() == [[1, 1, 0], [3, 1, 0], [0, 1, 0]] and own.embed([]).shape == (0, 3)
    assert "Bearer k" in seen["keys"]
    assert np.allclose(RemoteEmbedder(f"{url}/busy", "m", 3, form="vectors", wait=0.01).embed(["xy"]), [[2, 1, 0]]) and seen["busy"] == 0
    for path in ("none", "short"):
        assert not RemoteEmbedder(f"{url}/{path}", "m", 3, form="vectors", wait=0.01).available()
    with pytest.raises(ServiceError):
        RemoteEmbedder("http://127.0.0.1:9/x", "m", 3, tries=2, wait=0.01).embed(["x"])
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, t string")
    assert sorted((r.id, r.embedding, r.model) for r in embed(df, own, "id", "t").collect()) == [(1, [2, 1, 0], "m"), (2, [0, 1, 0], "m")]


def test_remote_scores(spark, service):
    url, _ = service
    hits = spark.createDataFrame([("a", "go go"), ("b", ""), ("c", "go"), ("d", None)], "id string, text string")
    assert sorted(tuple(r) for r in remote_scores(hits, "go", f"{url}/rank", "m", batch=2).collect()) == [("a", 2.0), ("c", 1.0)]


def test_structural_matches(spark, tmp_path):
    rows = [
        {"text": "  func Go(x int) {\n}", "file": "/r/a.go", "language": "Go", "range": {"start": {"line": 4, "column": 0}}, "metaVariables": {"single": {"NAME": {"text": "Go"}}}},
        {"text": "class Some {", "file": "other/b.ts", "language": "TypeScript", "range": {"start": {"line": 0, "column": 0}}},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    got = sorted(tuple(r) for r in read_matches(spark, str(tmp_path / "m.json"), "func", "/r").collect())
    assert got == [("Go", "function", "a.go", 4, "go", "func Go(x int) {\n}"), ("Some", "function", "other/b.ts", 0, "typescript", "class Some {")]


def test_migration_is_resumed_and_checked(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("b", [1.0]), ("c", None), (None, [1.0])], "h string, v array<double>")
    assert migrate(rows, table, ["h"], dry_run=True).migrated == 3 and table.version() == 0
    table.append(rows.filter("h = 'a'"))
    done = migrate(rows, table, ["h"])
    assert (done.total, done.skipped, done.migrated) == (3, 1, 2) and migrate(rows, table, ["h"]).migrated == 0
    assert differences(rows, table.read(), ["h"], "v").collect() == []
    copy = spark.createDataFrame([("a", [1.0, 2.1]), ("b", [1.0, 0.0])], "h string, v array<double>")
    assert {tuple(r) for r in differences(rows, copy, ["h"], "v").collect()} == {("a", "values"), ("b", "dimensions"), ("c", "missing")}
