import json

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rankspark.operators import nested, packed

STAND = ["n/a", "none", "-"]


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("a;b", ["a", "b"]),
        ("a | b,c\td\n e", ["a", "b", "c", "d", "e"]),
        ("with blank.json", ["with blank.json"]),
        ('"d ""final"".json"; x', ['d "final".json', "x"]),
        ("'P;v2.json'; Q", ["P;v2.json", "Q"]),
        ('["P/a", "P|b"]', ["P/a", "P|b"]),
        ("c_rev'd.json; None; d", ["c_rev'd.json", "d"]),
        ("[]", []), ('""', []), (" ; ;|\t", []), ("N/A; -;q", ["q"]), (None, []), ("", []),
        ("[a (copy), b]", ["a (copy)", "b"]), ("x (1).json", ["x (1).json"]), ('"open; b', ["open", "b"]),
        ("a\x010\x01b", ["a", "0", "b"]),
    ],
)
def test_split_packed(spark, text, values):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(packed.split_packed(F.col("s"), STAND).alias("v")).first().v == values


def test_explode_packed_positions_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a;;b", "x", 5), (2, None, "", 6), (1, "a;;b", "x", 5)], "row_id long, f string, pos string, value int")
    got = sorted(tuple(r) for r in packed.explode_packed(df, "row_id", ["f", "pos"], []).collect())
    assert got == sorted([(1, "f", 1, "a"), (1, "f", 2, "b"), (1, "pos", 1, "x")] * 2)
    assert packed.explode_packed(df.limit(0), "row_id", ["f"], []).count() == 0


LONG = 1_000_000


@pytest.mark.parametrize(
    ("text", "n", "length"),
    [
        ('"' + "a" * LONG + '"', 1, LONG), ('"' + "a" * LONG, 1, LONG), ("[" + "a" * LONG + "]", 1, LONG), ("x; '" + "b''" * (LONG // 3) + "'; y", 3, 1),
        ("(" + "(a)" * (LONG // 3) + ")", 1, LONG - 1), (" " * LONG, 0, None), ("a" + " " * LONG + "b", 1, LONG + 2), ("[[" * (LONG // 2), 0, None),
        ('"' * LONG, 1, LONG // 2 - 1), ("\n" * LONG, 0, None), ('"a;b";' * 20_000, 20_000, 3), (";" + " [" * (LONG // 2) + '"q"', 1, 1),
    ],
    ids="quoted unclosed bracketed doubled pairs blank inner open quotes lines many lead".split(),
)
def test_values_of_a_million_characters(spark, tmp_path, text, n, length):
    spark.createDataFrame([(text,)], "f string").write.parquet(str(tmp_path / "f"))
    v = packed.split_packed(F.col("f"), STAND)
    assert tuple(spark.read.parquet(str(tmp_path / "f")).select(F.size(v), F.length(F.get(v, F.lit(0)))).first()) == (n, length)


def test_very_long_packed_field(spark):
    df = spark.createDataFrame([(1, "; ".join(f"p{i}" for i in range(20000)))], "row_id long, f string")
    assert packed.explode_packed(df, "row_id", ["f"], []).agg(F.max("pos")).first()[0] == 20000


def test_shred_order_wrapping_and_nulls():
    body = [{"text": "one", "cite_spans": [None, {"start": 1}, {"start": 2}]}, {"text": " ", "cite_spans": [{"start": 3}]}, {"body_text": {"text": ["", "two"], "cite_spans": {"start": 4}, "body_text": [{"text": "three"}]}}, None, "x"]
    rows = nested.shred(7, json.dumps({"paper_id": "p", "body_text": json.dumps(body), "back_matter": [{"text": "no"}]}))
    keys = [(r[1], r[2], r[3], r[4]) for r in rows]
    assert keys == [("article", 0, 0, None), ("paragraph", 1, 0, 0), ("span", 1, 1, 1), ("span", 1, 2, 1), ("paragraph", 2, 0, 0), ("span", 2, 1, 2), ("paragraph", 3, 0, 2)]


@pytest.mark.parametrize("payload", [None, "", "<html>", '{"body_text": [', "[]", "null", "3"])
def test_unreadable_payloads(payload):
    rows = nested.shred(1, payload)
    assert [r[1] for r in rows] == ([] if payload is None else ["unreadable"]) and nested.shred(1, payload, keys_only=True) == []


def test_shapes_are_equal_for_equal_forms_only():
    a, b, c = {"x": 1, "y": ["s", "t"]}, {"y": ["u"], "x": 2.5}, {"x": "1", "y": ["s"]}
    s = [nested.shape_states(o)[id(o)].name for o in (a, b, c)]
    assert s[0] == s[1] != s[2]


def test_the_states_route_the_objects(monkeypatch):
    p = json.dumps({"body_text": [{"text": "a", "cite_spans": [{"start": 1}]}, {"text": " "}, {"text": ["", "b"]}]})
    assert [r[2:4] for r in nested.shred(1, p, keys_only=True)] == [(1, 0), (1, 1), (2, 0)]
    same = nested.State("o", "x")
    monkeypatch.setattr(nested, "transition", lambda x, children: same)
    assert nested.shred(1, p, keys_only=True) == []


def test_subtypes_are_typed_and_merge_shapes(spark, tmp_path):
    spans = [{"start": 1, "score": 0.5, "it's, a:key": True}, {"score": 2, "it's, a:key": False, "start": None, "ref_id": None}, {"start": 2, "score": 1, "it's, a:key": True, "ref_id": None, "more": None}]
    df = spark.createDataFrame([(1, json.dumps({"body_text": [{"text": "t", "cite_spans": spans}]}))], "article_id long, payload string")
    t = {(r.kind, r.fields): (r.n_shapes, r.n_objects) for r in nested.article_tables(df)["subtypes"].collect() if r.kind == "span"}
    both, without = json.dumps({"it's, a:key": "b", "score": "n", "start": "n"}), json.dumps({"it's, a:key": "b", "score": "n"})
    assert t == {("span", both): (2, 2), ("span", without): (1, 1)}
    nested.write_subtypes(df, str(tmp_path / "sub"))
    got = nested.read_subtype(spark, str(tmp_path / "sub"), "span", both)
    assert [f.dataType.simpleString() for f in got.schema][3:] == ["int", "boolean", "double", "bigint"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, 1, True, 0.5, 1), (1, 1, 3, 1, True, 1.0, 2)]


def test_deep_and_long_payloads_from_parquet(spark, tmp_path):
    deep = 100_000
    rows = [(1, '{"body_text":' * deep + '{"text":"t","more":' + "[" * deep + "]" * deep + "}" + "}" * deep), (2, '{"body_text":[{"text":"n","no":' + "9" * 5000 + "}]}"), (3, "[" * deep)]
    spark.createDataFrame(rows, "article_id long, payload string").write.parquet(str(tmp_path / "a"))
    t = nested.article_tables(spark.read.parquet(str(tmp_path / "a")))
    assert sorted((r.article_id, r.depth, r.extra[:7]) for r in t["paragraphs"].collect()) == [(1, deep, '{"more"'), (2, 1, '{"no": ')]
    assert [r.article_id for r in t["unreadable"].collect()] == [3]


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)), st.integers(0, 10**6), st.sampled_from(["", ",", "}", "]", '"', "x"]))
@settings(max_examples=300, deadline=None)
def test_the_parser_without_recursion_reads_what_json_reads(value, at, change):
    text = json.dumps(value)
    assert nested._parse_deep(text) == value and json.loads(nested._written(value)) == value
    at %= len(text)
    bad = text[:at] + change + text[at + 1 :]
    try:
        want = json.loads(bad)
    except ValueError:
        with pytest.raises(ValueError):
            nested._parse_deep(bad)
    else:
        assert nested._parse_deep(bad) == want or want != want


def test_article_tables_link(spark):
    p = json.dumps({"paper_id": "p", "body_text": [{"text": "a", "cite_spans": [{"start": 1, "end": 2, "ref_id": "b0", "latex": None}]}]})
    df = spark.createDataFrame([(1, p, "z"), (2, None, "z"), (3, "{", "z")], "article_id long, payload string, kind string")
    t = nested.article_tables(df)
    assert [r.article_id for r in t["articles"].collect()] == [1]
    assert [(r.para_no, r.span_no, r.start, r.ref_id) for r in t["spans"].collect()] == [(1, 1, 1, "b0")]
    assert t["paragraphs"].first().text == "a"
    assert t["shapes"].count() == 3
    assert [r.article_id for r in t["unreadable"].collect()] == [3]
    assert nested.shred_articles(df.limit(0)).count() == 0


def test_deep_nesting_does_not_overflow():
    deep = '{"body_text":' * 400 + '{"text":"t","cite_spans":' + "[" * 300 + '{"start":1}' + "]" * 300 + "}" + "}" * 400
    assert [r[1] for r in nested.shred(1, deep)] == ["article", "paragraph", "span"]
