import datetime

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from quern.functions import literals as L, scalars as S
from quern.operators import closure as G, dispatch as X, search
from quern.sources import files as FS


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_strings(spark):
    s = lambda t: F.lit(t)
    assert one(spark, S.string_chars(s("a😀\n"))) == ["a", "😀", "\n"] and one(spark, S.string_chars(s(""))) == []
    assert one(spark, S.string_len(s("a😀"))) == 2
    assert one(spark, S.string_slice(s("hello"), 1, 3)) == "el" and one(spark, S.string_slice(s("ab"), 2, 2)) == ""
    with pytest.raises(Exception, match="E_INDEX"):
        one(spark, S.string_slice(s("ab"), 1, 3))
    assert one(spark, S.url_encode_component(s("a b~*/é"))) == "a%20b~%2A%2F%C3%A9"
    assert one(spark, S.url_decode_component(s("a+b%20c"))) == "a b c"
    assert one(spark, S.words(s('say "a b" c\\ d  "" \\'))) == ["say", "a b", "c d", "\\"]
    assert one(spark, S.edit_distance(s("kitten"), s("sitting"))) == 3
    assert [one(spark, S.parse_ordinal(s(t))) for t in ("2nd", "twenty-third", "x", "0", "", "5.")] == [2, 23, None, None, None, 5]


def test_arithmetic(spark):
    i = lambda n: F.lit(n).cast("long")
    assert one(spark, S.divide(i(6), i(3))).int == 2 and one(spark, S.divide(i(7), i(2))).float == 3.5
    assert one(spark, S.rem(i(-7), i(3))) == -1
    for bad, code in ((S.add(i(2**55 - 1), i(1)), "E_ARITH"), (S.mul(i(2**40), i(2**40)), "E_ARITH"), (S.divide(i(1), i(0))["float"], "E_DIV"), (S.rem(i(1), i(0)), "E_DIV")):
        with pytest.raises(Exception, match=code):
            one(spark, bad)
    assert one(spark, S.float32(F.lit(-0.0))) == 0.0
    with pytest.raises(Exception, match="E_ARITH"):
        one(spark, S.float32(F.lit(1e300)))


def test_collections(spark):
    xs = F.array(F.lit(3), F.lit(1), F.lit(2))
    assert one(spark, S.slice_list(xs, 1, 2)) == [1, 2] and one(spark, S.sort_list(xs)) == [1, 2, 3]
    assert one(spark, S.index_or(xs, 9, -1)) == -1 and one(spark, S.set_index(xs, 0, 9)) == [9, 1, 2]
    with pytest.raises(Exception, match="E_INDEX"):
        one(spark, S.index_list(xs, 3))
    m = F.create_map(F.lit("b"), F.lit(1))
    assert one(spark, S.set_key(m, "a", 2)) == {"b": 1, "a": 2} and [r.key for r in one(spark, S.map_pairs(S.set_key(m, "a", 2)))] == ["a", "b"]
    assert one(spark, S.truthy(F.array().cast("array<int>"), "array<int>")) is False


def test_embedding(spark):
    text = "Grüße 😀\n"
    counts = [0.0] * 8
    for i, ch in enumerate(text):
        counts[(ord(ch) + i) % 8] += 1
    norm = sum(c * c for c in counts) ** 0.5
    assert one(spark, S.embed_text(F.lit(text))) == pytest.approx([c / norm for c in counts], abs=1e-6)
    assert one(spark, S.embed_text(F.lit(""))) == [0.0] * 8


names = st.from_regex(r"[a-z][a-z0-9_]{0,6}", fullmatch=True)
values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**55), 2**55 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text() | names.map(L.Symbol) | names.map(L.Identity),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=4) | names.map(L.Symbol), inner, max_size=3), max_leaves=8)


@given(values)
def test_literals_round_trip(v):
    back = L.from_literal(L.to_literal(v))
    assert L.canonical_key(back) == L.canonical_key(v)


def test_literals_and_json():
    assert L.canonical_key(1) != L.canonical_key(1.0) and L.canonical_key(1) < L.canonical_key(1.0)
    for bad in ("", "[1", "1 2", "foo", str(2**55)):
        with pytest.raises(ValueError):
            L.from_literal(bad)
    assert L.json_encode_value({L.Symbol("a"): [None, L.Symbol("b"), 1]}) == '{"a":[null,"b",1]}'
    assert L.json_decode_value('{"a": [1, 1.0, null]}') == {L.Symbol("a"): [1, 1.0, None]}
    with pytest.raises(ValueError):
        L.json_encode_value({1: 2})


def test_nearest(spark, rows):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [1.0, 1.0]), ("c", [2.0, 0.0]), (None, [1.0, 0.0])], "s string, e array<double>")
    got = [(r.subject, round(r.score, 4)) for r in search.nearest_embedding(v, [1.0, 0.0], 3, subject="s", embedding="e").collect()]
    assert got == [("a", 1.0), ("c", 1.0), ("b", 0.7071)]
    with pytest.raises(ValueError):
        search.nearest_embedding(v, [1.0], -1, subject="s", embedding="e")
    with pytest.raises(Exception, match="dimensions"):
        search.nearest_embedding(v, [1.0], 1, subject="s", embedding="e").collect()
    with pytest.raises(search.MissingRequiredBindings):
        search.nearest_embedding(v, None, 1, subject="s", embedding="e")


def test_text_search(spark):
    u = spark.createDataFrame([
        ("r", "u1", "docs/lamp.md", "Lamp", "markdown", "intro\nthe lamp\nis lit", 10, 12), ("r", "u2", "src/a.rs", "A", "code", "no match", 1, 1), ("r", "u3", "src/b.rs", None, "code", "fn x", 5, 9)],
        "repository string, unit string, path string, title string, kind string, text string, start_line long, end_line long")
    sym = spark.createDataFrame([("r", "src/b.rs", "lamp", 6, 7)], "repository string, path string, name string, start_line long, end_line long")
    got = search.text_search(u, "lamp", 5, symbols=sym).collect()
    assert [(r.unit, r.score) for r in got] == [("u1", 260 + 210 + 120 + 180 + 110 + 95 + 55), ("u3", 320)]
    assert got[0].start_line == 10 and got[1].start_line == 6 and "the lamp" in got[0].snippet
    assert search.text_search(u, "lamp", 5, scope="code", symbols=sym).count() == 1
    assert search.text_search(u, "!!", 5).count() == 0


def test_closures(spark, rows):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (None, 1)], "a long, b long")
    assert rows(G.closure(e, "a", "b")) == [(1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
    assert rows(G.reachable_from(e, "a", "b", spark.createDataFrame([(1,)], "x long"))) == [(1, 2), (1, 3)]
    assert G.reaches(e, "a", "b", 1, 3) and not G.reaches(e, "a", "b", 2, 1)
    assert G.closure(e.limit(0), "a", "b").count() == 0


def test_positional_dispatch(spark, rows):
    frame = spark.createDataFrame
    sel = frame([("m1", "go"), ("m2", "go"), ("m0", "go")], "method string, selector string")
    par = frame([("m1", "0", "any", None), ("m2", "0", "frob", "box")], "method string, slot string, rkind string, rvalue string")
    dele = frame([("crate", "box")], "child string, proto string")
    proto = frame([("int", "int_proto")], "kind string, proto string")
    calls = frame([("a", "go"), ("b", "go"), ("c", "go")], "call string, selector string")
    args = frame([("a", "0", "frob", "v", "crate"), ("b", "0", "int", "1", None)], "call string, slot string, kind string, value string, delegate string")
    found = X.applicable(calls, args, sel, par, dele, proto, positional=True)
    assert rows(found) == [("a", "m1"), ("a", "m2"), ("b", "m1"), ("c", "m0")]
    best = X.most_specific(found, par, dele, positional=True)
    assert rows(best) == [("a", "m2"), ("b", "m1"), ("c", "m0")] and rows(X.ambiguous(best)) == []
    assert rows(X.ambiguous(found)) == [("a", 2)]


def test_files(spark, rows):
    at = datetime.datetime(2025, 1, 1)
    f = spark.createDataFrame([("r", "1", "a/b.rs", "x\r\ny\n", "h", at), ("r", "1", "c.md", "", "h", at), ("r", "1", "d.md", None, None, at)], "repository string, revision string, path string, text string, hash string, indexed_at timestamp")
    assert [tuple(r)[3:] for r in sorted(FS.file_lines(f).collect(), key=lambda r: r.number)] == [(1, "x"), (2, "y")]
    assert {r.path: r["count"] for r in FS.file_line_count(f).collect()} == {"a/b.rs": 2, "c.md": 0}
    assert {(r.parent, r.path, r.kind) for r in FS.repository_entries(f).collect()} == {("", "a", "directory"), ("a", "a/b.rs", "file"), ("", "c.md", "file"), ("", "d.md", "file")}
    facts, rules = FS.parse_program('// c\nassert R(1, "a, b")\nH(?x) :- R(?x, ?y), not S(?x), x > 0')
    assert facts == {"R": [(1, "a, b")]} and len(rules) == 1
    assert [r.line for r in FS.render_facts("R", spark.createDataFrame([(1, 'q"x'), (2, None)], "a long, b string")).orderBy("line").collect()] == ['assert R(1, "q\\"x")', "assert R(2, nothing)"]
    with pytest.raises(ValueError):
        FS.parse_program("nonsense")
