import math
import random

from quern.llm.ranking import rank_items

SCORES = "query_id bigint, signal string, item_index int, score double, extra string"
SIGNALS = "signal string, higher_is_better boolean, weight double"


def brute(rows, signals):
    """The same ranking in plain Python."""
    told = {s: (up, w) for s, up, w in signals}
    best = {}
    for q, s, i, v, _ in rows:
        best.setdefault((q, i), {})
        if v is None or math.isnan(v):
            continue
        v = v if told[s][0] else -v
        best[(q, i)][s] = max(v, best[(q, i)].get(s, -math.inf))
    out = {}
    for q in {q for q, _ in best}:
        items = {i: d for (a, i), d in best.items() if a == q}
        odds = {}
        for s in told:
            values = sorted(d[s] for d in items.values() if s in d)
            for i, d in items.items():
                if s in d:
                    share = (sum(v < d[s] for v in values) + values.count(d[s]) / 2) / len(values)
                    odds[i, s] = math.log(share / (1 - share))
        widest = max((len(d) for d in items.values()), default=0)
        key = {}
        for i, d in items.items():
            if not d:
                key[i] = []
                continue
            sw, so = sum(told[s][1] for s in d), sum(told[s][1] * odds[i, s] for s in d)
            v = [(so - told[s][1] * odds[i, s]) / (sw - told[s][1]) if sw - told[s][1] > 1e-12 else so / sw for s in d]
            key[i] = [round(x, 9) for x in sorted(v + [so / sw] * (widest - len(v)))]
        for place, i in enumerate(sorted(items, key=lambda i: ([-math.inf] if not key[i] else [], [-x for x in key[i]], i) if key[i] else ([1], [], i)), 1):
            out[q, i] = place
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    signals = [("a", True, 0.5), ("b", False, 0.3), ("c", True, 0.2)]
    rows = []
    for q in range(8):
        for i in range(r.randrange(3, 30)):
            for s, _, _ in signals:
                if r.random() < 0.85:
                    rows.append((q, s, i, r.choice((None, float("nan"), r.gauss(0, 10**q), float(r.randrange(3)))), "x"))
    rows += rows[:20]
    got = {(x.query_id, x.item_index): x.place for x in rank_items(spark.createDataFrame(rows, SCORES), spark.createDataFrame(signals, SIGNALS)).collect()}
    assert got == brute(rows, signals)


def test_scale_does_not_matter_and_edge_cases(spark):
    signals = spark.createDataFrame([("a", True, 1.0), ("b", True, 1.0), ("flat", None, None)], SIGNALS)
    base = [(1, s, i, float(i if s == "a" else -i if s == "b" else 1), "") for s in ("a", "b", "flat") for i in range(5)]
    wide = [(q, s, i, v * (1e9 if s == "a" else 1), e) for q, s, i, v, e in base]
    place = lambda rows: {x.item_index: x.place for x in rank_items(spark.createDataFrame(rows, SCORES), signals).collect()}
    assert place(base) == place(wide)
    odd = [(2, None, 0, 1.0, ""), (2, "a", 1, None, ""), (2, "new", 2, 1.0, ""), (None, "a", 1, 1.0, ""), (2, "a", None, 1.0, "")]
    assert place(odd) == {2: 1, 0: 2, 1: 3}
    assert rank_items(spark.createDataFrame(odd, SCORES).limit(0), signals).collect() == []


def test_hot_query(spark):
    rows = spark.range(20000).selectExpr("0L as query_id", "'a' as signal", "cast(id as int) as item_index", "cast(id % 7919 as double) as score")
    signals = spark.createDataFrame([("a", True, 1.0)], SIGNALS)
    got = rank_items(rows, signals).toPandas().sort_values("place")
    assert got.place.tolist() == list(range(1, 20001))
    assert (got.item_index.to_numpy() % 7919)[:3].tolist() == [7918, 7918, 7917]
