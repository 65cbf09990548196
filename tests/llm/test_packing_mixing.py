import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import mixing, packing, tokens


@given(st.lists(st.integers(0, 100), max_size=80))
@settings(max_examples=100, deadline=None)
def test_first_fit_decreasing_equals_plain_search(sizes):
    got = packing.first_fit_decreasing(sizes, 100)
    free, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, f in enumerate(free) if f >= sizes[i]), None)
        if at is None:
            at = len(free)
            free.append(100)
        free[at] -= sizes[i]
        want[i] = at
    assert got == want


def test_pack_keeps_everything(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randrange(1, 90), rng.randrange(90, 350)])) for i in range(500)] + [(1000, None), (1001, 0), (1002, 200), (1003, -5), (None, 7), (2**60 + 1, 9), (7, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    got = packing.pack(df, capacity=100, group_rows=150).collect()
    by_bin: dict = {}
    for r in got:
        by_bin[r.container] = by_bin.get(r.container, 0) + r.n_tokens
    assert max(by_bin.values()) <= 100
    total = sum(max(n or 0, 0) for _, n in rows)
    assert sum(by_bin.values()) == total
    assert {r.doc_id for r in got} == {i for i, _ in rows}
    assert sorted(r.n_tokens for r in got if r.doc_id == 1002) == [100, 100]
    assert len(by_bin) <= total / 100 * 1.1 + 5
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=0)


DOCS = "doc_id bigint, source string, text string"


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", " A ", "B"]), "word " * rng.randrange(1, 60)) for i in range(900)]
    rows += [(1000, "c", "word " * 50), (1001, None, "x"), (1002, "a", None), (1003, "a", ""), (None, "b", "word"), (5, rows[5][1], rows[5][2])]
    docs = mixing.prepared(spark.createDataFrame(rows, DOCS))
    weights = spark.createDataFrame([("a", 0.4, 3), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    shares = mixing.plan_shares(docs, weights)
    assert {s.source: s.is_short for s in shares} == {"a": False, "b": False, "c": True, "none": True}
    total = docs.agg({"n_tokens": "sum"}).first()[0]
    rep = {r.source: r for r in mixing.report(docs, shares).collect()}
    for s, share in (("a", 0.4), ("b", 0.3)):
        assert abs(rep[s].used_tokens - share * total) <= 60
    assert rep["c"].used_tokens == 4 * rep["c"].source_tokens and rep["none"].used_tokens == 0
    uses = mixing.mix(docs, shares).collect()
    assert max(u.n_uses for u in uses if u.source == "a") <= 3
    assert not any(u.doc_id in (1002, 1003) for u in uses)


def test_mix_edges(spark):
    empty = mixing.prepared(spark.createDataFrame([], DOCS))
    weights = spark.createDataFrame([("a", 1.0, 1), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    shares = mixing.plan_shares(empty, weights)
    assert [s.is_short for s in shares] == [True]
    assert mixing.mix(empty, shares).count() == 0 and mixing.report(empty, shares).count() == 1
    clash = spark.createDataFrame([(1, "a", "word", 7, "x")], DOCS + ", place int, n_tokens string")
    assert mixing.sized(clash).columns == ["doc_id", "source", "n_tokens", "place"]


def test_token_counts(spark):
    enc = tokens.load(tokens.vocabulary(spark))
    texts = ["Hello world", "", None, "é ünï\n\n  x", "a" * 300_000]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int")
    assert [r.n_tokens for r in tokens.with_token_counts(df).collect()] == [tokens.count(enc, t) for t in texts]
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]
