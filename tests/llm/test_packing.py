import numpy as np
import pytest

from quern.llm.packing import pack_items, pieces_of, sum_of_squares, token_counts


def simulate(sizes, capacity):
    """The rule itself, written plainly."""
    level, where = {}, []
    counts = [0] * (capacity + 1)
    for s in sizes:
        best = None
        for h in range(capacity - s, -1, -1):
            if h and not counts[h]:
                continue
            after = counts.copy()
            if h:
                after[h] -= 1
            after[h + s] += 1
            value = sum(c * c for c in after[1:capacity])
            if best is None or value < best[0]:
                best = (value, h)
        h = best[1]
        if h:
            counts[h] -= 1
            box = level[h].pop()
        else:
            box = len({x for x in where})
        counts[h + s] += 1
        if h + s < capacity:
            level.setdefault(h + s, []).append(box)
        else:
            counts[h + s] -= 1
        where.append(box)
    return where


def test_rule_equals_its_definition():
    r = np.random.default_rng(1)
    for _ in range(20):
        sizes = r.integers(1, 21, 60)
        got = sum_of_squares(sizes, 20)
        assert np.bincount(got, sizes).max() <= 20
        assert got.tolist() == simulate(sizes.tolist(), 20)


def test_pieces():
    assert pieces_of(7, 10) == [(0, 7)] and pieces_of(10, 10) == [(0, 10)] and pieces_of(25, 10) == [(0, 10), (10, 10), (20, 5)]


def test_every_item_once(spark):
    r = np.random.default_rng(2)
    sizes = [(int(n), int(s)) for n, s in enumerate(r.integers(0, 300, 2000))] + [(2001, 1000), (2002, None), (None, 5)]
    items = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint").selectExpr("*", "'x' as pack_name")
    packs = spark.createDataFrame([("a", 256, 1), ("b", 1000, 0), ("c", None, 1), (None, 5, 1), ("d", 300, None)], "pack_name string, capacity_tokens int, separator_tokens int")
    got = pack_items(items, packs, "doc_id", shard_items=300, pool=16).toPandas()
    for name, capacity, separator in (("a", 256, 1), ("b", 1000, 0), ("d", 300, 0)):
        own = got[got.pack_name == name]
        use = own.groupby("container").tokens.agg(["sum", "count"])
        assert (use["sum"] + separator * (use["count"] - 1)).max() <= capacity
        assert own.groupby("doc_id").tokens.sum().to_dict() == {k: v or 0 for k, v in sizes if k is not None}
        assert (own[own.tokens < capacity].groupby("doc_id").piece.count() <= 1 + (name != "b")).all()
        filled = own.tokens.sum() / (capacity * own.container.nunique())
        assert filled > 0.93  # sizes up to the capacity cannot be packed without waste
    assert pack_items(items.limit(0), packs, "doc_id").count() == 0
    assert pack_items(items, packs.limit(0), "doc_id").count() == 0


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "x " * 50000)], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in token_counts(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 50000
