"""Override tags: kinds, resets, first and last of several, and the table function."""

import pytest

from cuegrain.functions import overrides


def test_all_kinds():
    block = r"{\b700\i1\u0\s1\bord1.5\shad-2\be1\fnArial Black\fs20.\fscx.5\fscy99\fsp2\fr45\frx1\fry2\c&H0000FF&\2cHFF\3c&00FF00\4cABC\alpha&H80&\1a&H10&\2aFF\3aH20\pbo3\p0}text"
    _, found = overrides.spans(block)
    assert found == [(0, "text", {"b": 700, "i": True, "u": False, "s": True, "bord": 1.5, "shad": -2.0, "be": 1, "fn": "Arial Black", "fs": 20.0, "fscx": 0.5, "fscy": 99.0, "fsp": 2.0, "frz": 45.0, "frx": 1.0, "fry": 2.0, "1c": 255, "2c": 255, "3c": 0xFF00, "4c": 0xABC, "alpha": 0x80, "1a": 0x10, "3a": 0x20, "4a": 0x80, "2a": 0xFF, "p": 0.0})]
    assert len(overrides.TAGS) == 26


@pytest.mark.parametrize(
    "line, want",
    [
        ("", [(0, "", {})]),
        ("plain", [(0, "plain", {})]),
        (r"a{\b1}b", [(0, "a", {}), (1, "b", {"b": 1})]),
        (r"{\b1}a{comment}b", [(0, "a", {"b": 1}), (1, "b", {"b": 1})]),
        (r"{\b1\b0}a", [(0, "a", {"b": 0})]),  # of a span the last wins
        (r"{\b1\fs9}a{\rOther\i1}b{\r}c", [(0, "a", {"b": 1, "fs": 9.0}), (1, "b", {"r": "Other", "i": True}), (2, "c", {"r": ""})]),
        (r"a\Nb\hc\xd\\{\i1}e", [(0, "a\nb cxd\\", {}), (8, "e", {"i": True})]),
        (r"a{\p1}m 0 0 l 1 1{\p0}b", [(0, "a", {}), (1, "", {"p": 1.0}), (1, "b", {"p": 0.0})]),
        (r"😀{\i1}x", [(0, "😀", {}), (2, "x", {"i": True})]),  # units of 16 bits
        (r"{\t(0,1,\fs40)\fs8x\i2\b1}a", [(0, "a", {"b": 1})]),  # what changes over time, and wrong arguments, are passed over
        (r"a{\b1", [(0, "a{b1", {})]),  # a tag that isn't closed is text
    ],
)
def test_spans(line, want):
    assert overrides.spans(line)[1] == want


def test_lines():
    line, _ = overrides.spans(r"{\a6\an3\q2\pos(1,2.5)}a{\q1\move(3,4,5,6)\org(1,1)}b")
    assert (line.align, line.wrap, line.at, line.origin) == (8, 2, (1.0, 2.5), True)
    assert overrides.spans(r"{\a10}x")[0].align == 5 and overrides.spans(r"{\a2}x")[0].align == 2
    assert overrides.spans(r"{\move(3,4,5)}x")[0].at is None
    assert overrides.spans(r"{\1c&HFF&}a")[0].complexity == 0  # before the first span
    assert overrides.spans(r"a{\1c&HFF&}b")[0].complexity == 1 and overrides.spans(r"a{\frz1}b{\shad1}c")[0].complexity == 7


def test_table_function(spark):
    rows = [("f", 2, 1, r"{\b1}x"), ("f", 1, 0, "y{\\i1}z"), ("g", 1, 1, None), ("f", 3, 1, r"{\org(1,1)}w"), ("f", 4, 1, "v")]
    df = spark.createDataFrame(rows, "file string, num int, layer int, line string").selectExpr("*", "1 AS b", "2 AS text")
    got = overrides.override_spans(df, "b", "i", "2c")
    assert got.columns[-3:] == ["b", "i", "c2"] and got.schema["i"].dataType.simpleString() == "boolean"
    found = sorted((r.file, r.num, r.span, r.offset, r.text, r.resets, r.b, r.i) for r in got.collect())
    assert found == [("f", 1, 0, 0, "y", True, None, None), ("f", 1, 1, 1, "z", True, None, True), ("f", 2, 0, 0, "x", True, 1, None), ("f", 3, 0, 0, "w", True, None, None), ("f", 4, 0, 0, "v", False, None, None), ("g", 1, 0, 0, "", True, None, None)]
    with pytest.raises(Exception, match="no such tags: zz"):
        overrides.override_spans(df, "zz").collect()
    overrides.register(spark)
    df.createOrReplaceTempView("some_cues")
    assert spark.sql("SELECT count(b) AS n FROM override_spans(TABLE(some_cues), 'b')").first().n == 1
    assert overrides.override_spans(df.where("false")).collect() == []
