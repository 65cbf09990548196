import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import splitting as P

SCHEMA = "id string, content string, prov_source_file string"


def cut(spark, rows):
    got = P.split_oversized(spark.createDataFrame(rows, SCHEMA)).orderBy("id", "piece_index").collect()
    out: dict = {}
    for r in got:
        out.setdefault(r.id, []).append(r)
    return out


def test_limits_follow_file_kind(spark):
    files = {"a.py": 2000, "A.PY": 2000, "b.Markdown": 1500, "b.md": 1500, "c.txt": 800, None: 800, "md": 800}
    df = spark.createDataFrame([(f,) for f in files], "f string")
    assert {r.f: r.n for r in df.select("f", P.size_limit(F.col("f")).alias("n")).collect()} == files


def test_pieces_tile_the_text_with_overlap(spark):
    text = " " + "\n\n".join(" ".join(f"word{i}-{j}." for j in range(40)) for i in range(30)) + "\n"
    pieces = cut(spark, [("x", text, None)])["x"]
    assert "".join(p.piece[p.piece_overlap :] for p in pieces) == text.strip()
    for a, b in zip(pieces, pieces[1:]):
        assert len(b.piece) <= 800 and 90 <= b.piece_overlap <= 100
        assert a.piece.endswith(b.piece[: b.piece_overlap])
        assert re.search(r"\s\Z", a.piece)
    assert [p.piece_index for p in pieces] == list(range(len(pieces)))
    assert all(p.is_cut and not p.is_forced for p in pieces)


def test_forced_cut_and_astral_characters(spark):
    pieces = cut(spark, [("x", "\U0001f600" * 1700, None), ("y", "a" * 800, None), ("z", "b" * 400 + " " + "c" * 801, None)])
    assert all(p.is_forced for p in pieces["x"]) and "".join(p.piece[p.piece_overlap :] for p in pieces["x"]) == "\U0001f600" * 1700
    assert [p.is_cut for p in pieces["y"]] == [False]
    assert pieces["z"][0].is_forced


@given(st.text(alphabet="a \n.é \U0001f600", max_size=3000))
@settings(max_examples=25, deadline=None)
def test_round_trip(spark, text):
    white = "".join(chr(c) for c in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
    got = cut(spark, [("x", text, "n.txt")])["x"]
    assert "".join(p.piece[p.piece_overlap :] for p in got) == text.strip(white)
    assert all(len(p.piece) <= 800 for p in got)


def test_edges(spark):
    got = cut(spark, [("null", None, None), ("empty", "", "a.py"), ("white", " \n　", None), ("same", "x", None), ("same", "x", None)])
    assert [r.piece for r in got["null"]] == [None]
    assert [r.piece for r in got["empty"]] == [r.piece for r in got["white"]] == [""]
    assert len(got["same"]) == 2
    assert P.split_oversized(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([("x", "y" * 900, None, "old", 1)], SCHEMA + ", piece string, __text int")
    assert sorted(P.split_oversized(clash).columns) == sorted(["id", "content", "prov_source_file", "is_cut", "is_forced", "piece_index", "piece_start", "piece_overlap", "piece"])
    long = cut(spark, [("long", "word " * 100_000, None)])["long"]
    assert "".join(p.piece[p.piece_overlap :] for p in long) == ("word " * 100_000).strip()


@pytest.mark.parametrize("limit", [800, 1500, 2000])
def test_pattern_is_bounded(limit):
    assert f"{limit - 100}}}" in P.boundary_pattern(limit, 100)
