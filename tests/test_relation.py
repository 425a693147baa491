import random

import pytest
from pyspark.sql import functions as F

from quern.plans.algebra import Plan
from quern.plans.atoms import HOLE, Var, exists, query, value
from quern.relation import AmbiguousError, Relation, RelationError


class Reader:
    def __init__(self, **tables):
        self.tables = tables

    def read(self, name):
        return self.tables[name]


def rel(spark, rows, ddl="a long, b long"):
    return Relation(spark.createDataFrame(list(rows), ddl))


def test_set_operators_follow_python_sets(spark, rows):
    rng = random.Random(1)
    for _ in range(3):
        x = {(rng.randrange(5), rng.randrange(5)) for _ in range(12)}
        y = {(rng.randrange(5), rng.randrange(5)) for _ in range(12)}
        a, b = rel(spark, list(x) + list(x)), rel(spark, y)
        assert rows(a.union(b).df) == sorted(x | y)
        assert rows(a.difference(b).df) == sorted(x - y)
        assert rows(a.intersection(b).df) == sorted(x & y)
        assert rows(a.project("b").df) == sorted({(q,) for _, q in x})
        assert rows(a.natural_join(b.rename(a="c")).df) == sorted({(q, p, r) for p, q in x for r, s in y if q == s} and {(p, q, r) for p, q in x for r, s in y if q == s})
        assert rows(a.semi_join(b, [0], [1]).df) == sorted(t for t in x if any(t[0] == u[1] for u in y))
        assert rows(a.anti_join(b, [0], [1]).df) == sorted(t for t in x if not any(t[0] == u[1] for u in y))


def test_headings_are_checked(spark):
    a = rel(spark, [(1, 2)])
    with pytest.raises(RelationError):
        a.union(rel(spark, [(1, 2)], "a long, c long"))
    with pytest.raises(RelationError):
        a.project("z")
    with pytest.raises(RelationError):
        a.project("a", "a")
    with pytest.raises(RelationError):
        Relation.literal(spark, ["a", "b"], [(1,)])


def test_columns_align_by_name(spark, rows):
    a = rel(spark, [(1, 2)])
    b = rel(spark, [(3, 4)], "b long, a long")
    assert rows(a.union(b).df) == [(1, 2), (4, 3)]


def test_kinds_never_meet(spark):
    a, b = rel(spark, [(1,)], "a long"), rel(spark, [(1.0,)], "a double")
    assert a.natural_join(b).df.count() == 0
    assert a.difference(b).df.count() == 1
    assert a.intersection(b).df.count() == 0
    assert a.join_eq(b, [0], [0]).df.count() == 0


def test_unit_and_nothing(spark):
    a = rel(spark, [(1, 2)])
    assert a.natural_join(Relation.unit(spark)).df.count() == 1
    assert a.natural_join(Relation.nothing(spark)).df.count() == 0
    assert Relation.unit(spark).truthy() and not Relation.nothing(spark).truthy()


def test_one(spark):
    assert rel(spark, []).one() is None
    assert rel(spark, [(1, 2)]).one() == {"a": 1, "b": 2}
    assert rel(spark, [(7,)], "a long").one() == 7
    with pytest.raises(AmbiguousError):
        rel(spark, [(1, 2), (2, 2)]).one()
    with pytest.raises(Exception, match="E_AMBIGUOUS"):
        rel(spark, [(1, 2), (1, 3)]).one_per(["a"]).df.collect()


def test_index_is_canonical(spark):
    r = rel(spark, [(2, 1), (1, 9), (1, 3)])
    assert [r.at(i) for i in range(3)] == [{"a": 1, "b": 3}, {"a": 1, "b": 9}, {"a": 2, "b": 1}]
    with pytest.raises(IndexError):
        r.at(3)


def test_map_cells_are_refused(spark):
    with pytest.raises(RelationError):
        Relation(spark.range(1).select(F.create_map(F.lit("a"), F.lit(1)).alias("m")))


def test_plans(spark, rows):
    r = Reader(L=spark.createDataFrame([(1, 2), (2, 3), (2, 3)], "x long, y long"), R=spark.createDataFrame([(3, 9)], "x long, y long"))
    assert rows(Plan.scan("L", [2, None]).execute(r).df) == [(2, 3)]
    assert rows(Plan.scan("L").project(1, 0, 1).execute(r).df) == [(2, 1, 2), (3, 2, 3)]
    assert rows(Plan.scan("L").join_eq(Plan.scan("R"), [1], [0]).execute(r).df) == [(2, 3, 3, 9)]
    assert rows(Plan.scan("L").intersect(Plan.scan("L")).execute(r).df) == [(1, 2), (2, 3)]
    with pytest.raises(RelationError):
        Plan.scan("L", [1]).execute(r)


def test_atoms(spark, rows):
    r = Reader(E=spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "x long, y long"), N=spark.createDataFrame([(1, "a")], "k long, v string"))
    assert rows(query(r, "E", Var("x"), Var("x")).df) == [(1,), (2,)]
    assert rows(query(r, "E", Var("x"), HOLE).df) == [(1,), (2,)]
    assert exists(r, "E", 1, 2) and not exists(r, "E", 2, 1) and exists(r, "E", HOLE, HOLE)
    assert value(r, "N", 1) == "a" and value(r, "N", 2) is None
    assert query(r, "E", 1, *[Var("y")]).df.count() == 2
