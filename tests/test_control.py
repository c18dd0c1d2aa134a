import os

from quern.plans.config import IndexConfig, RetrieverConfig, set_repo_config, stale_vectors
from quern.sources.records import Registry
from quern.streaming.control import Worker


def test_settings_from_the_environment():
    c = RetrieverConfig.from_env({"QUERN_KEYWORD_LIMIT": "7", "QUERN_SYMBOL_LIMIT": "-1", "QUERN_SEMANTIC_LIMIT": "x", "QUERN_RERANK": " Enabled "})
    assert (c.keyword_limit, c.semantic_limit, c.symbol_limit, c.rerank, c.total_limit) == (7, 20, 10, True, 37)
    assert IndexConfig(jdbc_url="jdbc:postgresql://app:hidden@h/db").masked_url() == "jdbc:postgresql://app:***@h/db"
    assert IndexConfig.from_env({"QUERN_DIMENSIONS": "0"}).dimensions == 64


def test_repository_settings(spark):
    schema = "repo_root string, model string, dimensions int, created_at bigint, updated_at bigint"
    configs = set_repo_config(spark.createDataFrame([("r", "old", 2, 1, 1)], schema), "r", "new", 3, 9)
    assert [tuple(x) for x in configs.collect()] == [("r", "new", 3, 1, 9)]
    vectors = spark.createDataFrame([("r", 1, [1.0, 2.0]), ("r", 2, [1.0, 2.0, 3.0]), ("q", 3, [1.0])], "repo_root string, id int, embedding array<float>")
    assert [r.id for r in stale_vectors(vectors, configs).collect()] == [1]


def test_worker(tmp_path):
    registry = Registry.open(str(tmp_path / "r.json"))
    a, b = (os.path.abspath(tmp_path / n) for n in "ab")

    def run(project):
        if project == b:
            raise RuntimeError("broken")
        return {"symbols": 5}

    w = Worker(registry, run, capacity=2)
    assert w.handle("add", a)["ok"] and w.handle("add", b)["ok"]
    assert w.handle("reindex", a)["ok"] and not w.handle("reindex", a)["ok"] and w.handle("reindex", b)["ok"]
    assert not w.trigger("third")
    assert w.drain() == 2 and w.handle("status")["done"] == 2
    assert registry.get(a)["index_stats"]["symbols"] == 5 and "broken" in registry.get(b)["index_stats"]["last_error"]
    assert not w.handle("remove", "/none")["ok"] and not w.handle("nonsense")["ok"] and not w.handle("reindex")["ok"] and w.handle("stop")["ok"]
