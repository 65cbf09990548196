import math
import random

import pytest
from pyspark.sql import functions as F

from quern import schema as S
from quern.operators import envelope, evaluation, ledger, lexical, records, retrieval, upsert, vector


def _sequential(rows):
    """The rule of the upsert, one delivery after the other."""
    state = {}
    for g, seq, i, trust, proof in sorted(rows, key=lambda r: r[1]):
        now = state.get(g)
        if now and (trust < now[1] or (trust == now[1] and i != now[0])):
            continue
        state[g] = (i, trust, max(proof, now[2]) if now else proof, seq)
    return state


def test_upsert_equals_sequential_application(spark):
    rng = random.Random(5)
    rows = [(f"g{rng.randrange(60)}", s, f"id{rng.randrange(3)}", rng.randrange(5), rng.randrange(9)) for s in range(1200)]
    df = spark.createDataFrame([("s", "raw_fact", g, s, i, t, p) for g, s, i, t, p in rows], "scope_key string, kind string, content_hash string, seq bigint, id string, trust_tier int, proof_count bigint")
    got = {r.content_hash: (r.id, r.trust_tier, r.proof_count, r.seq) for r in upsert.fold(df).collect()}
    assert got == _sequential(rows)


def _records(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, id string, scope_key string, kind string, content_hash string, trust_tier int, status string, proof_count bigint, created_at string").withColumn("created_at", F.to_timestamp("created_at"))


ROWS = [
    (1, "a", "s", "raw_fact", "h1", 2, "active", 0, "2026-01-01 00:00:01"),
    (2, "b", "s", "raw_fact", "h2", 0, "active", 0, "2026-01-01 00:00:01"),
    (3, "c", "s", "directive", "h3", 3, "active", 0, "2026-01-01 00:00:03"),
    (4, "d", "t", "raw_fact", "h4", 1, "superseded", 0, "2026-01-01 00:00:04"),
]


def test_forged_rows_never_surface(spark):
    df = _records(spark, ROWS)
    assert {r.id for r in records.recent_feed(df).collect()} == {"a", "c"}
    assert {r.id for r in records.newest(df).collect()} == {"a", "b", "c", "d"}
    assert [(r.scope_key, r.n) for r in records.census(df).collect()] == [("s", 2)]
    md = spark.createDataFrame([("a", "board", "major", "str"), ("b", "board", "major", "str"), ("a", "board", "major", "str")], "record_id string, meta_key string, meta_value string, vtype string")
    assert [r.id for r in records.board_entries(df, md, "major", 10).collect()] == ["a"]
    assert records.board_entries(df, md, "major", 0).count() == 0
    with pytest.raises(ValueError):
        records.scoped(df, "")


def test_writes(spark):
    df = _records(spark, ROWS)
    assert upsert.conflicts(df).isEmpty() and not upsert.conflicts(df.unionByName(df)).isEmpty()
    gone = spark.createDataFrame([("a",), ("d",)], "id string")
    assert {r.id for r in upsert.delete(df, "s", gone).collect()} == {"b", "c", "d"}
    n = {r.id: r.proof_count for r in upsert.bumped(df, spark.createDataFrame([("a", 2), ("b", 1)], "id string, n bigint")).collect()}
    assert (n["a"], n["b"], n["c"]) == (2, 0, 0)
    s = {r.id: r.status for r in upsert.set_status(df, "s", ["a", "b", "d"], "superseded").collect()}
    assert (s["a"], s["b"], s["d"]) == ("superseded", "active", "superseded")
    with pytest.raises(ValueError):
        upsert.set_status(df, "s", [], "nope")


def _ranked(spark, rows):
    return spark.createDataFrame(rows, "qid string, id string, rank int, score double")


def test_fusion_keeps_first_appearance_on_ties(spark):
    v = _ranked(spark, [("q", "a", 1, 0.9), ("q", "b", 2, 0.8)])
    x = _ranked(spark, [("q", "c", 1, 5.0), ("q", "b", 2, 4.0)])
    got = [r.id for r in retrieval.fuse(v, x, 10).orderBy("rank").collect()]
    assert got == ["b", "a", "c"]


def test_filter_is_above_the_pool_and_gate_sees_shown_hits_only(spark):
    rec = _records(spark, ROWS)
    v = _ranked(spark, [("q", "b", 1, 0.9), ("q", "a", 2, 0.3)])
    x = _ranked(spark, [])
    q = spark.createDataFrame([("q",), ("none",)], "qid string")
    assert [r.id for r in retrieval.hybrid(v, x, rec, q, 1, candidates=1).collect()] == []
    g = {r.qid: (r.top_score, r.verdict) for r in retrieval.gate(q, v, rec, 0.5).collect()}
    assert g == {"q": (0.3, "abstain"), "none": (None, "unavailable: no vector candidates")}
    assert retrieval.hybrid(v, x, rec, q, 5, min_score=0.5).isEmpty()
    with pytest.raises(ValueError):
        retrieval.gate(q, v, rec, 2.0)


def test_vector_topk_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    m[7] = 0
    m[9] = m[8]
    rows = [(str(i), "x", x.tolist()) for i, x in enumerate(m)] + [("short", "x", [1.0]), ("bad", "x", [float("nan")] * 8), ("null", "x", None)]
    df = spark.createDataFrame(rows, "id string, space string, vector array<double>")
    got = vector.topk(df.filter("id IN ('3', '7', 'short')"), df, 5).orderBy("qid", "rank").collect()
    n = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    s = np.round(n[3] @ n.T, 9)
    want = sorted(range(300), key=lambda i: (-s[i], str(i)))[:5]
    assert [r.id for r in got if r.qid == "3"] == [str(i) for i in want]
    assert {r.score for r in got if r.qid == "7"} == {0.0}
    assert [r.id for r in got if r.qid == "short"] == ["short"]
    assert vector.topk(df, df, 0).isEmpty()


def test_lexical_edges(spark):
    docs = spark.createDataFrame([("a", "Café au lait"), ("b", "cafe"), ("c", ""), ("d", None)], "id string, text string")
    q = spark.createDataFrame([("1", "CAFÉ!"), ("2", "..."), ("3", None)], "qid string, text string")
    got = lexical.bm25(q, docs, 5).orderBy("rank").collect()
    assert [(r.qid, r.id) for r in got] == [("1", "b"), ("1", "a")]
    assert lexical.bm25(q, docs, 0).isEmpty()
    assert lexical.bm25(q, docs.limit(0), 5).isEmpty()


def test_metrics(spark):
    runs = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "a", 3), ("q", "b", 4)], "qid string, id string, rank int")
    labels = spark.createDataFrame([("q", "a", 2), ("q", "a", 2), ("q", "b", 1), ("q", "z", 0)], "qid string, id string, grade int")
    queries = spark.createDataFrame([("q",), ("none",)], "qid string")
    m = {r.qid: r for r in evaluation.per_query(runs, labels, queries, 3).collect()}
    r = m["q"]
    assert (r.recall, r.reciprocal_rank, r.hit_rate, r.precision) == (0.5, 0.5, 1.0, pytest.approx(1 / 3))
    assert r.average_precision == pytest.approx((1 / 2 + 2 / 4) / 2)
    assert m["none"].recall == m["none"].ndcg == 0.0


def test_rank_auc_counts_ties_half(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(6) / 2, rng.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame(rows, "v double, p boolean")
    pos, neg = [v for v, p in rows if p], [v for v, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluation.rank_auc(df, "v", "p").first().auc == pytest.approx(want)


def test_resampling():
    assert evaluation.sign_test(4, 1) == pytest.approx(0.375)
    assert evaluation.sign_test(0, 0) == 1.0 and evaluation.sign_test(3000, 3000) == 1.0


def test_ledger(spark):
    rows = [(f"2026-01-01 00:00:{i:02d}", "c", f"q{i}", ["a", "a"] if i else []) for i in range(9)] + [("2026-01-01 00:00:08", "c", "q8", ["a", "a"]), ("2025-12-01 00:00:00", None, "old", ["z"])]
    df = spark.createDataFrame(rows, "ts string, call_id string, query_text string, ids array<string>").withColumn("ts", F.to_timestamp("ts"))
    assert [r.query_text for r in ledger.informed_by(df, 2).orderBy("rank").collect()] == ["q8", "q7"]
    assert ledger.informed_by(df, 0).count() == 1
    assert {r.id: r.n for r in ledger.credits(df).collect()} == {"a": 8, "z": 1}
    assert ledger.kept(df, F.to_timestamp(F.lit("2026-01-01 00:00:08"))).count() == 8


def test_envelope(spark):
    cols = "qid string, rank int, id string, kind string, trust_tier int, status string"
    hits = spark.createDataFrame([("q", 1, "e", "raw_fact", 1, "active"), ("q", 2, "p", "directive", 3, "active"), ("q", 3, "d", "directive", 2, "active"), ("q", 4, "f", "directive", 0, "active")], cols)
    pinned = spark.createDataFrame([("q", 1, "p", "directive", 3, "active"), ("q", 2, "low", "directive", 1, "active")], cols)
    got = [(r.channel, r.position, r.id) for r in envelope.partition(hits, pinned).orderBy("channel", "position").collect()]
    assert got == [("directive", 1, "p"), ("directive", 2, "d"), ("evidence", 1, "e")]
    assert envelope.render([], ["[1] x"]) == f"{envelope.DATA}\n[1] (1) x"


def test_trust_levels():
    assert [int(t) for t in S.Trust] == [0, 1, 2, 3, 4]


def test_phrases_and_passes(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "the scan cache is warm"), ("b", "cache of the scan"), ("c", "scan_cache once, scan cache twice"), ("d", None), ("e", "x y z")], "id string, text string")
    q = spark.createDataFrame([("p", "scan_cache"), ("w", "scan cache"), ("n", "__ ,"), ("u", "_x_")], "qid string, text string")

    def hits():
        out: dict = {}
        for r in lexical.bm25(q, docs, 5).orderBy("qid", "rank").collect():
            out.setdefault(r.qid, []).append(r.id)
        return out

    one = hits()
    assert set(one["p"]) == {"a", "c"} and set(one["w"]) == {"a", "b", "c"} and one["u"] == ["e"] and "n" not in one
    monkeypatch.setattr(lexical, "PASS_QUERIES", 1)
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 1)
    assert hits() == one


def test_texts_are_not_shuffled(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"word{i} common") for i in range(20)], "id string, text string")
    post = lexical.postings(df)._jdf.queryExecution().executedPlan().toString()
    for line in post.splitlines():
        if "Exchange" in line:
            assert "text" not in line


def test_resampling_against_plain_draws(spark):
    import random
    import statistics

    rng = random.Random(4)
    a = [(f"q{i}", *(min(1.0, 0.5 + rng.random()) for _ in evaluation.METRICS)) for i in range(60)]
    b = [(f"q{i}", *(0.45 + rng.random() / 2 for _ in evaluation.METRICS)) for i in range(60)]
    names = "qid string, " + ", ".join(f"{m} double" for m in evaluation.METRICS)
    da, db = spark.createDataFrame(a, names), spark.createDataFrame(b, names)
    got = {r.metric: r for r in evaluation.resampled(da, db, resamples=400).collect()}
    d = [x[1] - y[1] for x, y in zip(a, b)]
    r, error = got["recall"], statistics.stdev(d) / 60**0.5
    assert set(got) == set(evaluation.METRICS) and r.n == 60 and r.mean_diff == pytest.approx(sum(d) / 60, abs=1e-9)
    assert r.lo == pytest.approx(r.mean_diff - 1.96 * error, abs=error * 0.5) and r.hi == pytest.approx(r.mean_diff + 1.96 * error, abs=error * 0.5)
    assert r.permutation_p < 0.05
    same = evaluation.resampled(da, da, resamples=50).collect()
    assert all(x.lo == x.hi == 0 and x.sign_p == x.permutation_p == 1 for x in same)
    assert evaluation.resampled(da.limit(0), db).count() == 0


def test_many_queries_by_blocks_give_the_same(spark, monkeypatch):
    import random

    rng = random.Random(6)
    df = spark.createDataFrame([(str(i), "s" if i % 3 else "t", [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(300)], "id string, space string, vector array<double>")
    some = df.filter("id % 5 = 0")
    here = {tuple(r) for r in vector.topk(some, df, 7).collect()}
    monkeypatch.setattr(vector, "BROADCAST_QUERIES", 0)
    monkeypatch.setattr(vector, "ROW_BLOCK", 40)
    assert {tuple(r) for r in vector.topk(some, df, 7).collect()} == here and len(here) == 60 * 7


def test_lexical_hits_dont_grow_with_blocks(spark, monkeypatch):
    import random
    from collections import Counter

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = {f"d{i:03}": [rng.choice(words[: rng.choice((5, 40))]) for _ in range(rng.randint(0, 12))] for i in range(400)}
    asked = {f"q{i}": rng.sample(words, 5) for i in range(64)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id string, text string")
    q = spark.createDataFrame([(i, " ".join(t)) for i, t in asked.items()], "qid string, text string")
    monkeypatch.setattr(lexical, "DOC_BLOCK", 16)
    made, real = [], lexical._scored
    monkeypatch.setattr(lexical, "_scored", lambda *a: made.append(real(*a)) or made[-1])
    got: dict = {}
    for r in lexical.bm25(q, docs, 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    df = Counter(w for t in texts.values() for w in set(t))
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    for qid, terms in asked.items():
        want = []
        for i, t in texts.items():
            s = sum(max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in terms)
            want.append((-round(s, 9), i))
        assert [(i, pytest.approx(-s, abs=2e-9)) for s, i in sorted(want)[:3]] == got[qid]
    assert made[0].count() == 64 * 3


def test_blocks_of_queries_are_not_broadcast(spark, monkeypatch, tmp_path):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(f"r{i:03}", "x", x.tolist()) for i, x in enumerate(rng.normal(size=(300, 4)))]
    spark.createDataFrame(rows, "id string, space string, vector array<double>").write.parquet(f"{tmp_path}/v")
    df = spark.read.parquet(f"{tmp_path}/v")
    here = {tuple(r) for r in vector.topk(df, df, 5).collect()}
    monkeypatch.setattr(vector, "BROADCAST_QUERIES", 0)
    by_blocks = vector.topk(df, df, 5)
    assert "Broadcast" not in by_blocks._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in by_blocks.collect()} == here and len(here) == 300 * 5


def test_blocks_of_documents_are_read_where_arrow_has_them(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"a w{i % 7} w{i % 3}" if i % 20 else "") for i in range(200)], "id string, text string")
    q = spark.createDataFrame([(f"q{i}", f"w{i} a none") for i in range(7)], "qid string, text string")
    made, real = [], lexical._scored
    monkeypatch.setattr(lexical, "_scored", lambda *a: made.append(real(*a)) or made[-1])
    monkeypatch.setattr(lexical, "DOC_BLOCK", 10)
    assert lexical.bm25(q, docs, 4).count() == 7 * 4
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    # A pandas frame would hold each batch of blocks a second time.
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_vectors_alike_to_seven_digits_keep_their_order(spark, monkeypatch):
    rows = [(f"r{i:02}", "x", [1.0, 1e-4 * i, 3e-4]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, space string, vector array<double>")
    here = {tuple(r) for r in vector.topk(df, df, 5).collect()}
    monkeypatch.setattr(vector, "BROADCAST_QUERIES", 0)
    assert {tuple(r) for r in vector.topk(df, df, 5).collect()} == here


def test_the_store_is_read_without_shuffling_texts(spark, data, monkeypatch):
    from quern.plans import catalogue

    rows = catalogue.current(spark, data).select("seq", "content", "proof_count")
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(catalogue, "SENT", 0)
    joined = catalogue.current(spark, data).select("seq", "content", "proof_count")
    assert "Exchange hashpartitioning" in joined._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in joined.collect()}


def test_blocks_go_to_workers_in_small_batches(spark, monkeypatch):
    df = spark.createDataFrame([("a", "x", [1.0, 2.0])], "id string, space string, vector array<double>")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    monkeypatch.setattr(vector, "BROADCAST_QUERIES", 0)
    vector.topk(df, df, 1)
    assert int(spark.conf.get(name)) <= 16 << 20
    spark.conf.unset(name)
    lexical.bm25(df.select(df.id.alias("qid"), df.id.alias("text")), df.select("id", df.id.alias("text")), 1)
    assert int(spark.conf.get(name)) <= 16 << 20
