import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import lookalikes as L


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return {r.k: r.canonical for r in L.canonical(df, "k", "t").collect()}


ALIKE = ["café x", "café x", "ｃａｆé x", "сafé x", "ca​fé　x", "ca︀f­é x", "саfе́ x"]
DIFFERENT = ["Café x", "cafe x", "café  x", "café ①", "café 1", "café ²", "strasse", "straße", "café x.", "cafè x"]


def test_alike_and_different(spark):
    got = forms(spark, ALIKE + DIFFERENT)
    assert {got[i] for i in range(len(ALIKE))} == {"café x"}
    rest = [got[len(ALIKE) + i] for i in range(len(DIFFERENT))]
    assert len(set(rest)) == len(rest) and "café x" not in rest


@given(st.lists(st.text(alphabet="abẹ́́​аｂ 　й가가ß²\n\r\U0001f600", max_size=12), min_size=1, max_size=8))
@settings(max_examples=30, deadline=None)
def test_equals_plain_rule(spark, texts):
    got = forms(spark, texts)
    for i, t in enumerate(texts):
        # The same up to composition of what has no composed form.
        assert unicodedata.normalize("NFC", got[i]) == L.canonical_text(t)


def test_marks_in_any_order_are_one_form(spark):
    got = forms(spark, ["q̣́", "q̣́", "ấ", "ấ", "́"])
    assert got[0] == got[1] and got[2] == got[3] and got[4] == "́"


def test_pairs_and_edges(spark):
    rows = [("a", "x é"), ("b", "x é"), ("c", "x é"), ("d", None), ("e", ""), ("f", "​"), ("a", "x é"), ("g", "y")]
    df = spark.createDataFrame(rows, "id string, content string")
    got = {(r.key_a, r.key_b) for r in L.alike_pairs(df, "id", "content").collect()}
    assert got == {("a", "b"), ("b", "c"), ("e", "f")}
    assert L.alike_pairs(df.limit(0), "id", "content").count() == 0
    clash = spark.createDataFrame([("a", "é" * 50_000, "x", 1)], "id string, content string, canonical string, __k int")
    assert L.canonical(clash, "id", "content").first().canonical == "é" * 50_000


@pytest.mark.parametrize("ch", ["­", "͏", "‍", "️", "\U000e0061", "⁣"])
def test_shows_nothing(ch):
    assert L.apart(ch) == ""


def test_composed_whole(spark):
    cases = ["\u1f92", "\u03b7\u0313\u0300\u0345", "e\u200b\u0301", "e\u034f\u0301", "\U0002f800", "\uac01", "\u1100\u1161\u11a8", "\u0bca", "\u0bc6\u0bbe", "\u00e9"]
    got = forms(spark, cases)
    assert [got[i] for i in range(len(cases))] == [L.canonical_text(t) for t in cases]
    assert got[0] == got[1] and got[2] == got[3] == got[9] and got[5] == got[6] and got[7] == got[8]


def test_classes(spark):
    rows = [("a", "x é"), ("b", "x e\u0301"), ("c", "x é"), ("d", None), ("e", "y"), ("f", "y")]
    df = spark.createDataFrame(rows, "id string, content string")
    assert {tuple(r) for r in L.alike_classes(df, "id", "content").collect()} == {("a", "a", 2), ("b", "a", 2), ("c", "a", 2)}
