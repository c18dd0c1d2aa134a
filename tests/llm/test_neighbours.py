import numpy as np

from quern.llm.neighbours import encode, nearest_pairs, nearest_vectors, neighbour_pairs, rotation, unit

SCHEMA = "content_hash string, embedding array<float>, model string, dimensions int, created_at bigint, access_count bigint, last_accessed bigint, hash string"


def exact(vectors, k):
    hashes = sorted(vectors)
    x = np.array([vectors[h] for h in hashes], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for n, h in enumerate(hashes):
        s = np.round(x @ x[n], 12)
        s[n] = -9
        out |= {(min(h, hashes[m]), max(h, hashes[m])) for m in np.argsort(-s, kind="stable")[:k]}
    return out


def test_estimate_is_within_its_bound():
    r = np.random.default_rng(0)
    v, c = unit(r.normal(size=(400, 48))), unit(r.normal(size=(1, 48)))[0] * 0.3
    turn = rotation(48)
    assert np.allclose(turn @ turn.T, np.eye(48), atol=1e-5)
    codes, scalars = encode(v, c, turn)
    signs = (np.unpackbits(codes, axis=1, count=48) * 2.0 - 1) / np.sqrt(48)
    q = unit(r.normal(size=(1, 48)))[0]
    estimate = q @ c + scalars[:, 1] + scalars[:, 0] / scalars[:, 2] * (signs @ ((q - c) @ turn))
    bound = np.linalg.norm(q - c) * scalars[:, 0] * np.sqrt(1 - scalars[:, 2] ** 2) / scalars[:, 2] * 1.9 / np.sqrt(47)
    assert (np.abs(estimate - v @ q) <= bound).mean() > 0.9


def test_recall_and_odd_rows(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16))
    vectors = {f"h{n:04d}": (centres[n % 12] + 0.5 * r.normal(size=16)).astype(np.float32) * (1 + n % 3) for n in range(900)}
    rows = [(h, [float(x) for x in v], "m", 16, 5, 1, 1, "x") for h, v in vectors.items()]
    rows += [("h0001", [9.0] * 16, "m", 16, 9, 1, 1, "x"), ("null", None, "m", 16, 1, 1, 1, "x"), ("short", [1.0], "m", 16, 1, 1, 1, "x"), ("zero", [0.0] * 16, "m", 16, 1, 1, 1, "x"), ("nan", [float("nan")] * 16, "m", 16, 1, 1, 1, "x"), (None, [1.0] * 16, "m", 16, 1, 1, 1, "x"), ("alone", [1.0, 2.0], "other", 2, 1, 1, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(x) for x in neighbour_pairs(nearest_vectors(df, k=5, list_size=60, bundle=2, block=64)).collect()}
    want = exact(vectors, 5)
    assert len(got & want) / len(want) >= 0.97
    assert not {h for p in got for h in p} & {"null", "short", "zero", "nan", "alone"}
    assert nearest_vectors(df.limit(0)).collect() == []


def test_spaces_are_not_mixed(spark):
    r = np.random.default_rng(4)
    rows, vectors = [], {}
    for model, dims in (("m", 8), ("m", 12), ("n", 8)):
        for n in range(120):
            h = f"{model}{dims:02d}{n:03d}"
            vectors[h] = r.normal(size=dims).astype(np.float32)
            rows.append((h, [float(x) for x in vectors[h]], model, dims, 1, 1, 1, "x"))
    got = nearest_vectors(spark.createDataFrame(rows, SCHEMA), k=4, list_size=30, bundle=2, slack=9.0).collect()
    assert len(got) == 360 * 4 and all(x.hash[:3] == x.neighbour[:3] for x in got)
    pairs = {(min(x.hash, x.neighbour), max(x.hash, x.neighbour)) for x in got}
    for prefix in ("m08", "m12", "n08"):
        assert {p for p in pairs if p[0].startswith(prefix)} == exact({h: v for h, v in vectors.items() if h.startswith(prefix)}, 4)
    assert pairs == {tuple(x) for x in nearest_pairs(spark.createDataFrame(rows, SCHEMA), k=4, list_size=30, bundle=2, slack=9.0).collect()}


def test_crowded_space_and_ties(spark):
    r = np.random.default_rng(6)
    # a third of all vectors lies in one place, many are multiples of one another
    rows = [(f"c{n:04d}", [float(x) for x in np.array([5.0, 1.0, 0.0, 2.0]) + 1e-3 * r.normal(size=4)], "m", 4, 1, 1, 1, "x") for n in range(400)]
    rows += [(f"t{n:04d}", [1.0 * 2**n, 2.0 * 2**n, -3.0 * 2**n, 0.0], "m", 4, 1, 1, 1, "x") for n in range(30)]
    rows += [(f"o{n:04d}", [float(x) for x in r.normal(size=4)], "m", 4, 1, 1, 1, "x") for n in range(800)]
    got = nearest_vectors(spark.createDataFrame(rows, SCHEMA), k=5, block=64, list_size=40, bundle=4).toPandas()
    by = {h: sorted(g.neighbour) for h, g in got.groupby("hash")}
    assert len(by) == 1230 and (got.groupby("hash").size() == 5).all()
    assert by["t0000"] == [f"t{n:04d}" for n in range(1, 6)] and by["t0029"] == by["t0007"] == [f"t{n:04d}" for n in range(5)]
    want = exact({h: np.array(v, np.float32) for h, v, *_ in rows if h[0] != "t"}, 5)
    mine = {(min(a, b), max(a, b)) for a, b in zip(got.hash, got.neighbour, strict=True) if a[0] != "t" and b[0] != "t"}
    assert len(mine & want) / len(want) > 0.9


def test_copies_of_a_vector(spark):
    r = np.random.default_rng(2)
    rows = [(f"c{n:03d}", [1.0, 2.0, 3.0, 4.0], "m", 4, 1, 1, 1, "x") for n in range(40)] + [(f"o{n:03d}", [float(x) for x in r.normal(size=4)], "m", 4, 1, 1, 1, "x") for n in range(60)]
    got = nearest_vectors(spark.createDataFrame(rows, SCHEMA), k=3, block=16, list_size=20, bundle=1).toPandas()
    by = {h: sorted(g.neighbour) for h, g in got.groupby("hash")}
    assert by["c000"] == ["c001", "c002", "c003"] and by["c001"] == ["c000", "c002", "c003"] and by["c039"] == ["c000", "c001", "c002"]
    assert (got.groupby("hash").size() == 3).all() and len(by) == 100
