import numpy as np
import pytest

from quern.llm import neighbours as N

SCHEMA = "id string, embedder_name string, embedder_dim int, embedding array<double>"


def data(n=1500, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[:200] + rng.normal(size=(200, dim)) * 0.25
    return np.vstack([base, near]) * rng.uniform(0.1, 9, size=(n + 200, 1))


def brute(m, least):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    return {(i, j) for i, j in zip(*np.nonzero(s >= least)) if i < j}


def test_recall_against_brute_force(spark):
    m = data()
    df = spark.createDataFrame([(f"{i:05d}", "e", 32, x.tolist()) for i, x in enumerate(m)], SCHEMA)
    got = {(int(r.id), int(r.other)) for r in N.nearest(df).collect()}
    pairs = {p for p in got if p[0] < p[1]}
    want = brute(m, 0.9)
    assert len(want) > 100 and pairs <= want
    assert len(pairs) >= 0.97 * len(want)
    assert {(b, a) for a, b in got} == got


def test_spaces_never_meet_and_unusable_rows_are_left_out(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    nan, inf = float("nan"), float("inf")
    rows = [("a", "e", 4, v), ("b", "e", 4, [2 * x for x in v]), ("c", "f", 4, v), ("d", "e", 5, v), ("z", "e", 4, [0.0] * 4), ("n", "e", 4, None), ("x", "e", 4, [nan, 1.0, 1.0, 1.0]), ("i", "e", 4, [inf, 1.0, 1.0, 1.0]), ("m", "e", 4, [None, 1.0, 1.0, 1.0]), ("u", "e", None, v), ("o", None, 4, v), (None, "e", 4, v), ("a", "e", 4, v)]
    got = N.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.id, r.other) for r in got} == {("a", "b"), ("b", "a")}
    assert all(r.similarity == pytest.approx(1.0) for r in got)


def test_copies_are_listed_by_id_and_bounded(spark):
    rng = np.random.default_rng(3)
    v, w = rng.normal(size=16), rng.normal(size=16)
    near = v + rng.normal(size=16) * 0.01
    rows = [(f"c{i:03d}", "e", 16, v.tolist()) for i in range(60)] + [("near", "e", 16, near.tolist()), ("far", "e", 16, w.tolist())]
    got = N.nearest(spark.createDataFrame(rows, SCHEMA), k=5).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.id, []).append(r.other)
    assert {len(x) for x in by.values()} == {5} and "far" not in by
    assert sorted(by["c000"]) == [f"c{i:03d}" for i in range(1, 6)]
    assert sorted(by["near"]) == [f"c{i:03d}" for i in range(5)]


def test_every_row_gets_its_k_nearest(spark, monkeypatch):
    # Several blocks on both sides, and several tasks a query block.
    for name, n in (("QUERY_BLOCK", 300), ("ROW_BLOCK", 100), ("TASK_BLOCKS", 3)):
        monkeypatch.setattr(N, name, n)
    m = data(n=700)
    copies = [("v1", "e", 32, m[0].tolist()), ("v2", "e", 32, m[0].tolist())]
    other = [(f"s{i}", "f", 16, x.tolist()) for i, x in enumerate(data(n=200, dim=16)[:4])]
    df = spark.createDataFrame([(f"{i:05d}", "e", 32, x.tolist()) for i, x in enumerate(m)] + copies + other, SCHEMA)
    by: dict = {}
    for r in N.nearest(df, whole=True).collect():
        by.setdefault(r.id, {})[r.other] = r.similarity
    ids = [f"{i:05d}" for i in range(len(m))] + ["v1", "v2"]
    u = np.vstack([m, m[:1], m[:1]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for i, name in enumerate(ids):
        assert len(by[name]) == N.K and name not in by[name]
        assert sorted(by[name].values()) == pytest.approx(np.sort(s[i])[-N.K :], abs=1e-6)
    assert {k: set(by[k]) for k in by if k[0] == "s"} == {f"s{i}": {f"s{j}" for j in range(4) if j != i} for i in range(4)}
    assert N.nearest(df.limit(0), whole=True).count() == 0


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.nearest(df).count() == 0
    clash = spark.createDataFrame([("a", "e", 2, [1.0, 0.0], "x", 1), ("b", "e", 2, [1.0, 0.1], "y", 2)], SCHEMA + ", class string, code int")
    assert N.nearest(clash).columns == ["id", "other", "similarity"] and N.nearest(clash).count() == 2


def test_index_shape():
    for n in (0, 1, 1000, 10**6, 10**9):
        bits, subs = N.index_shape(n, 0.9)
        p = N.flip_rate(0.9)
        near = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
        assert bits % 2 == 0 and 1 - (1 - near) ** subs >= N.RECALL


def test_a_crowd_of_near_copies_is_ranked_exactly(spark, monkeypatch):
    monkeypatch.setattr(N, "CROWD_ROWS", 60)
    monkeypatch.setattr(N, "BUCKET_ROWS", 500)
    rng = np.random.default_rng(5)
    m = np.vstack([data(n=500), rng.normal(size=32) + rng.normal(size=(700, 32)) * 0.04])
    sizes: list = []
    exact = N._exact
    monkeypatch.setattr(N, "_exact", lambda few, rows, k: sizes.append(few.count()) or exact(few, rows, k))
    df = spark.createDataFrame([(f"{i:05d}", "e", 32, x.tolist()) for i, x in enumerate(m)], SCHEMA)
    by: dict = {}
    for r in N.nearest(df).collect():
        by.setdefault(int(r.id), {})[int(r.other)] = r.similarity
    assert sizes and 650 <= sizes[0] <= 800
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    full = 0
    for i in range(len(m) - 700, len(m)):
        full += sorted(by[i].values()) == pytest.approx(np.sort(s[i])[-N.K :], abs=1e-6)
    assert full >= 690
    assert sum(len(by.get(i, ())) for i in range(700)) >= 0.97 * 2 * len([p for p in brute(m[:700], 0.9)])
