import itertools
import random

import pytest

from quern.plans.rules import RuleError, RuleSet, Stats, UnboundHeadVariable, UnsafeGuard, UnsafeNegation, UnstratifiedNegation, atom, components, guard, rule


class Reader:
    def __init__(self, **tables):
        self.tables = tables

    def read(self, name):
        return self.tables[name]


def edges(spark, rows):
    return spark.createDataFrame(list(rows), "a long, b long")


def closed(pairs):
    out = set(pairs)
    while True:
        new = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not new:
            return out
        out |= new


REACH = [rule(atom("Reach", "?x", "?y"), atom("Edge", "?x", "?y")), rule(atom("Reach", "?x", "?z"), atom("Reach", "?x", "?y"), atom("Edge", "?y", "?z"))]


def test_safety():
    with pytest.raises(UnboundHeadVariable):
        rule(atom("H", "?x"), atom("B", "?y"))
    with pytest.raises(UnsafeNegation):
        rule(atom("H", "?x"), atom("B", "?x"), ~atom("C", "?z"))
    with pytest.raises(UnsafeGuard):
        rule(atom("H", "?x"), atom("B", "?x"), guard("?z", "<", 1))
    with pytest.raises(RuleError):
        rule(atom("H", 1))


def test_strata_and_components():
    rs = RuleSet(REACH + [rule(atom("Apart", "?x"), atom("Node", "?x"), ~atom("Reach", "?x", "?x"))])
    assert components(rs.rules.values()) == [{"Reach"}, {"Apart"}]
    with pytest.raises(UnstratifiedNegation):
        RuleSet([rule(atom("P", "?x"), atom("N", "?x"), ~atom("Q", "?x")), rule(atom("Q", "?x"), atom("N", "?x"), ~atom("P", "?x"))])
    with pytest.raises(RuleError):
        RuleSet([rule(atom("P", "?x"), atom("N", "?x")), rule(atom("P", "?x", "?x"), atom("N", "?x"))])


@pytest.mark.parametrize("mask", random.Random(3).sample(range(1, 128), 3))
def test_small_graphs(spark, rows, mask):
    every = [(1, 2), (2, 3), (3, 1), (1, 1), (2, 2), (1, 3), (3, 2)]
    e = [p for i, p in enumerate(every) if mask >> i & 1]
    assert rows(RuleSet(REACH).fixpoint(Reader(Edge=edges(spark, e)))["Reach"]) == sorted(closed(e))


def test_chain_stats(spark):
    stats = Stats()
    out = RuleSet(REACH).fixpoint(Reader(Edge=edges(spark, [(i, i + 1) for i in range(5)])), stats=stats)
    assert out["Reach"].count() == 15 and stats.rounds == 5 and stats.novel == [4, 3, 2, 1, 0]


def test_single_pass_differs_from_fixpoint(spark):
    r = Reader(Edge=edges(spark, [(1, 2), (2, 3)]), Reach=edges(spark, []))
    assert RuleSet(REACH).evaluate(r)["Reach"].count() == 2


def test_guards_compare_numbers_by_value(spark, rows):
    r = Reader(A=spark.createDataFrame([(1,), (2,)], "x long"), B=spark.createDataFrame([(1.0,), (2.5,)], "y double"))
    rs = RuleSet([rule(atom("Same", "?x", "?y"), atom("A", "?x"), atom("B", "?y"), guard("?x", "==", "?y")), rule(atom("Join", "?x"), atom("A", "?x"), atom("B", "?x"))])
    out = rs.fixpoint(r)
    assert rows(out["Same"]) == [(1, 1.0)] and rows(out["Join"]) == []
    big = Reader(A=spark.createDataFrame([(2**53 + 1,)], "x long"), B=spark.createDataFrame([(float(2**53),)], "y double"))
    more = RuleSet([rule(atom("More", "?x"), atom("A", "?x"), atom("B", "?y"), guard("?x", ">", "?y"))])
    assert rows(more.fixpoint(big)["More"]) == [(2**53 + 1,)]


def test_negation_of_a_constant_pattern_and_disable(spark, rows):
    r = Reader(N=spark.createDataFrame([(1,), (2,)], "x long"), Off=spark.createDataFrame([(2, "off")], "x long, y string"))
    rs = RuleSet()
    key = rs.install(rule(atom("On", "?x"), atom("N", "?x"), ~atom("Off", "?x", "off"), id="on"))
    assert rows(rs.fixpoint(r)["On"]) == [(1,)]
    rs.disable(key)
    assert rs.fixpoint(r) == {} and "on" in rs.disabled


def test_only_needed_rules_run(spark):
    rs = RuleSet(REACH + [rule(atom("Broken", "?x"), atom("NoSuchTable", "?x"))])
    assert rs.fixpoint(Reader(Edge=edges(spark, [(1, 2)])), ["Reach"])["Reach"].count() == 1


def test_naive_and_semi_naive_agree_on_triangles(spark, rows):
    e = list(itertools.permutations(range(3), 2))
    rs = RuleSet([rule(atom("Tri", "?x", "?y", "?z"), atom("Edge", "?x", "?y"), atom("Edge", "?y", "?z"), atom("Edge", "?z", "?x"), guard("?x", "<", "?y"))])
    want = sorted((x, y, z) for x, y in e for z in range(3) if (y, z) in e and (z, x) in e and x < y)
    assert rows(rs.fixpoint(Reader(Edge=edges(spark, e)))["Tri"]) == want
