import itertools
import random
from collections import Counter

import pytest

from quern import queries
from quern.operators import delta as D
from quern.plans.atoms import HOLE
from quern.plans.rules import RuleSet, atom, guard, rule
from quern.runtime import Scratch


class Reader:
    def __init__(self, tables):
        self.tables = tables

    def read(self, name):
        return self.tables[name]


def frame(spark, rows, ddl="a long, b long"):
    return spark.createDataFrame(list(rows), ddl)


def change(spark, plus=(), minus=()):
    return D.zset(frame(spark, plus), 1).union(D.zset(frame(spark, minus), -1))


@pytest.mark.parametrize("kind", ["cycle", "negation", "ringed"])
def test_incremental_equals_recompute(spark, rows, kind):
    rng = random.Random(7)
    rules = {
        "cycle": [rule(atom("Reach", "?x", "?y"), atom("Edge", "?x", "?y")), rule(atom("Reach", "?x", "?z"), atom("Reach", "?x", "?y"), atom("Edge", "?y", "?z"))],
        "negation": [rule(atom("Pair", "?x", "?z"), atom("Edge", "?x", "?y"), atom("Edge", "?y", "?z"), guard("?x", "<", "?z")),
                     rule(atom("Lone", "?x"), atom("Edge", "?x", "?y"), ~atom("Pair", "?x", "?y"))],
        # A negation under the recursion, base facts in the recursive head, a ground atom.
        "ringed": [rule(atom("Far", "?x", "?y"), atom("Edge", "?x", "?y"), ~atom("Loop", "?x")), rule(atom("Far", "?x", "?z"), atom("Far", "?x", "?y"), atom("Edge", "?y", "?z")),
                   rule(atom("Loop", "?x"), atom("Edge", "?x", "?x")), rule(atom("Odd", "?x"), atom("Edge", "?x", HOLE), atom("Edge", 1, HOLE))],
    }[kind]
    far = {(0, 9), (1, 9)}
    rs = RuleSet(rules)
    now = {(rng.randrange(4), rng.randrange(4)) for _ in range(5)}
    stored = lambda: {"Edge": frame(spark, now), **({"Far": frame(spark, far)} if kind == "ringed" else {})}
    view = D.MaintainedView(rs, stored(), Scratch(spark))
    before = {h: set(rows(view.read(h))) for h in rs.heads}
    for _ in range(3):
        plus = {(rng.randrange(4), rng.randrange(4)) for _ in range(2)} - now
        minus = set(rng.sample(sorted(now), 1))
        now = (now - minus) | plus
        changes = {"Edge": change(spark, plus, minus)}
        if kind == "ringed":
            changes["Far"] = change(spark, [(2, 9)], [(0, 9)])
            far = (far - {(0, 9)}) | {(2, 9)}
        out = view.advance(changes)
        full = rs.fixpoint(Reader(stored()))
        for h in rs.heads:
            want = set(rows(full[h]))
            assert set(rows(view.read(h))) == want
            seen = {tuple(r)[:-1]: r[-1] for r in out[h].collect()} if h in out else {}
            assert seen == {**{t: 1 for t in want - before[h]}, **{t: -1 for t in before[h] - want}}
            before[h] = want


def test_arrangement_compacts(spark, rows):
    a = D.Arrangement(Scratch(spark), frame(spark, [(1, 1), (2, 2), (None, 3)]), every=3)
    for plus, minus in (([(3, 3)], [(1, 1)]), ([(1, 1)], [(3, 3)]), ([], [(None, 3)]), ([(4, 4)], [])):
        a.add(change(spark, plus, minus))
    assert rows(a.rows()) == [(1, 1), (2, 2), (4, 4)] and len(a.deltas) == 1
    assert rows(a.touched(frame(spark, [(4, 4), (9, 9)]))) == [(4, 4)]


def test_computed_relations_are_evaluated_afresh(spark, rows):
    class Made:
        def read(self, name):
            return frame(spark, [(x,) for x in self.values], "x long")

    made = Made()
    made.values = [1, 2]
    rs = RuleSet([rule(atom("P", "?x"), atom("Edge", "?x", "?y"), atom("Made", "?x")), rule(atom("Q", "?x"), atom("P", "?x"))])
    view = D.MaintainedView(rs, {"Edge": frame(spark, [(1, 2), (3, 4)])}, Scratch(spark), computed=made)
    made.values = [3]
    out = view.advance({})
    assert rows(out["Q"]) == [(1, -1), (3, 1)] and rows(view.read("P")) == [(3,)]
    view.check()
    view.state["Q"].add(change_one(spark, 7))
    with pytest.raises(D.NegativeSupport):
        view.check()


def change_one(spark, x):
    return D.zset(frame(spark, [(x,)], "c0 long"))


def test_unmoved_input_does_nothing(spark):
    rs = RuleSet([rule(atom("P", "?x"), atom("Edge", "?x", "?y"))])
    view = D.MaintainedView(rs, {"Edge": frame(spark, [(1, 2)])}, Scratch(spark))
    assert view.advance({"Edge": change(spark, plus=[(1, 2)], minus=[(9, 9)])}) == {}


def test_delta_join_counts_each_term_once(spark, rows):
    a0, da, b0, db = [(1, 1), (2, 1)], [(3, 1)], [(1, 5)], [(1, 6), (1, 7)]
    z = lambda r, ddl: D.zset(frame(spark, r, ddl))
    got = D.delta_join([z(a0, "x long, k long"), z(b0, "k long, y long")], [z(da, "x long, k long"), z(db, "k long, y long")], ["k"])
    full = {(x, y) for x, _ in a0 + da for _, y in b0 + db} - {(x, y) for x, _ in a0 for _, y in b0}
    assert sorted((r.x, r.y) for r in got.collect()) == sorted(full) and {r[D.W] for r in got.collect()} == {1}


def test_delta_join_of_three_against_brute_force(spark):
    """Rows repeated, lost, back again and of null; what cancels out isn't shown, nothing is shown twice."""
    rng = random.Random(3)
    ddl = ["k long, a long", "b long, k long", "k long, c long"]
    at = [0, 1, 0]  # where k is

    def bag(n):
        return [(rng.choice([0, 1, 2, None]), rng.choice([0, 1, None]), rng.choice([-1, 1, 1, 2])) for _ in range(n)]

    def total(*bags):
        out = Counter()
        for x in bags:
            for a, b, w in x:
                out[a, b] += w
        return out

    def joined(inputs):
        out = Counter()
        for (r, v), (s, w), (t, x) in itertools.product(*[i.items() for i in inputs]):
            k = {row[i] for row, i in zip((r, s, t), at)}
            if len(k) == 1 and None not in k:
                out[k.pop(), r[1], s[0], t[1]] += v * w * x
        return out

    olds, deltas = [bag(9) for _ in range(3)], [bag(4) for _ in range(3)]
    deltas[1] += [(a, b, -w) for a, b, w in olds[1][:3]]
    frames = lambda bags: [frame(spark, b, f"{d}, {D.W} long") for b, d in zip(bags, ddl)]
    before, after = joined([total(o) for o in olds]), joined([total(o, d) for o, d in zip(olds, deltas)])
    for whole in (False, True):
        want = Counter(after)
        if not whole:
            want.subtract(before)
        got = [tuple(r) for r in D.delta_join(frames(olds), frames(deltas), ["k"], whole=whole).select("k", "a", "b", "c", D.W).collect()]
        assert len({r[:-1] for r in got}) == len(got)
        assert {r[:-1]: r[-1] for r in got} == {t: w for t, w in want.items() if w}


def test_delta_join_adds_up_its_inputs_and_not_what_they_join_to(spark):
    """Joined rows, thousands for one customer of a large nation, go through no shuffle or aggregate."""
    z = lambda n, where: D.zset(spark.range(n).where(where).selectExpr(f"id as x{n}", "id % 5 as k"))
    old, delta = ([z(n, where) for n in (200, 100)] for where in ("id % 10 <> 0", "id % 10 = 0"))
    change, whole = D.delta_join(old, delta, ["k"]), D.delta_join(old, delta, ["k"], whole=True)
    assert change.count() == 600 and whole.count() == 4000
    for df in (change, whole, queries.delta_join(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        above = plan[: next(i for i, x in enumerate(plan) if "Join" in x)]
        assert not any(word in x for x in above for word in ("Aggregate", "Repartition"))


def test_delta_join_query_on_odd_rows(spark, tmp_path, rows):
    """Repeated rows count, rows without a key too; those without a nation join nothing."""
    c = [(10, 1), (10, 1), (3, 1), (None, 1), (None, 1), (20, 2), (4, 2), (5, None), (None, None), (6, 7)]
    s = [(10, 1), (2, 1), (2, 1), (None, 1), (30, 2), (None, 2), (7, None)]
    for name, x, ddl in (("customer", c, "c_custkey long, c_nationkey int"), ("supplier", s, "s_suppkey long, s_nationkey int")):
        frame(spark, x, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    want = Counter((x, k, y) for x, k in c for y, n in s if k == n and k is not None)
    df = queries.delta_join(spark, str(tmp_path)).select("c_custkey", "k", "s_suppkey", "w")
    assert rows(df) == sorted(((*t, w) for t, w in want.items()), key=repr)


def test_support(spark, rows):
    s = D.consolidate(D.zset(frame(spark, [(1,), (1,), (2,)], "a long")))
    base = frame(spark, [(2,)], "a long")
    new, flips = D.support_change(s, base, D.zset(frame(spark, [(1,), (2,)], "a long"), -1))
    assert rows(D.visible(new)) == [(1,)] and rows(flips) == []  # 1 keeps one derivation, 2 is a base fact
    with pytest.raises(Exception, match="negative differential support"):
        D.support_change(s, base, D.zset(frame(spark, [(3,)], "a long"), -1))[0].collect()


def test_apply_and_effective(spark, rows):
    base = frame(spark, [(1, 1), (2, 2)])
    c = change(spark, plus=[(1, 1), (3, 3)], minus=[(2, 2), (9, 9)])
    assert rows(D.effective(base, c)) == [(2, 2, -1), (3, 3, 1)]
    assert rows(D.apply_changes(base, c)) == [(1, 1), (3, 3)]
