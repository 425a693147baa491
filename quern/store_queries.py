"""Queries of the store, its transactions and feeds, of rule management and maintenance, and their SQL."""

from __future__ import annotations

import os
import subprocess
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import closure as G, delta as D
from .plans.rules import RuleError, RuleSet, Stats, atom, guard, rule
from .runtime import Scratch, read, scratch_root
from .sources import git as V
from .store import Conflict, ReadOnlyRelation, Store
from .streaming.feed import Replica, Subscription

QUERIES: dict = {}
ORACLES: dict = {}


def _q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class _Named:
    def __init__(self, **tables):
        self.tables = tables

    def read(self, name: str) -> DataFrame:
        return self.tables[name]


def _customers(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))


def _suppliers(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("SUPPLIER").alias("v"))


def _store(spark, d, path=None) -> Store:
    """Every customer with the segment, as a set; every user with the first event's type, by user."""
    s = Store(spark, path)
    s.make_relation("Member", "k long, v string")
    s.make_functional_relation("Latest", "user_id long, event_type string", [0])
    t = s.begin()
    t.assert_("Member", _customers(spark, d))
    e = read(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    t.replace("Latest", e)
    t.commit()
    return s


_C = "SELECT c_custkey AS k, c_mktsegment AS v FROM customer"
_S = "SELECT s_suppkey AS k, 'SUPPLIER' AS v FROM supplier"


# -- relations and transactions (M1-M11, P1, P2) ---------------------------------------------
@_q("SELECT * FROM (VALUES ('Latest', 2, 'functional', 'durable'), ('Member', 2, 'set', 'durable'), ('Session', 1, 'set', 'volatile'), ('Trail', 2, 'event_append', 'durable')) t(relation, arity, policy, durability)")
def make_relations(spark: SparkSession, d: str) -> DataFrame:
    s = Store(spark)
    s.make_relation("Member", "k long, v string")
    s.make_functional_relation("Latest", "user_id long, event_type string", [0])
    s.make_relation("Session", "id long", durability="volatile")
    s.make_relation("Trail", "id long, what string", policy="event_append")
    r = s.catalog.reflect(spark)
    return r["Arity"].join(r["ConflictPolicy"], "relation").join(r["RelationDurability"], "relation")


@_q("""SELECT * FROM (VALUES ('Relation', 'Latest'), ('Relation', 'Member'), ('RelationName', 'Latest|Latest'), ('RelationName', 'Member|Member'), ('Arity', 'Latest|2'), ('Arity', 'Member|2'),
('RelationDurability', 'Latest|durable'), ('RelationDurability', 'Member|durable'), ('ArgumentName', 'Latest|0|user_id'), ('ArgumentName', 'Latest|1|event_type'), ('ArgumentName', 'Member|0|k'), ('ArgumentName', 'Member|1|v'),
('ConflictPolicy', 'Latest|functional'), ('ConflictPolicy', 'Member|set'), ('FunctionalKey', 'Latest|0|0'), ('Index', 'Latest|Latest_index_0'), ('Index', 'Member|Member_index_0'),
('IndexPosition', 'Latest_index_0|0|0'), ('IndexPosition', 'Latest_index_0|1|1'), ('IndexPosition', 'Member_index_0|0|0'), ('IndexPosition', 'Member_index_0|1|1'), ('IndexStorageKind', 'Latest_index_0|parquet'), ('IndexStorageKind', 'Member_index_0|parquet'),
('Rule', 'builders'), ('Rule', 'seen'), ('RuleHead', 'builders|Builder'), ('RuleHead', 'seen|Seen'), ('RuleSource', 'builders|Builder(?k) :- Member(?k, ''BUILDING'')'), ('RuleSource', 'seen|Seen(?u) :- Latest(?u, ?e)'), ('ActiveRule', 'builders|Builder')) t("view", fact)""")
def catalog_views(spark: SparkSession, d: str) -> DataFrame:
    """All views of the catalogue and of the rules, with one rule disabled."""
    s = Store(spark)
    s.make_relation("Member", "k long, v string")
    s.make_functional_relation("Latest", "user_id long, event_type string", [0])
    s.install_rule(rule(atom("Builder", "?k"), atom("Member", "?k", "BUILDING"), id="builders"))
    s.install_rule(rule(atom("Seen", "?u"), atom("Latest", "?u", "?e"), id="seen"))
    s.disable_rule("seen")
    out = None
    for name, df in s.catalog.reflect(spark, s.rules).items():
        part = df.select(F.lit(name).alias("view"), F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]).alias("fact"))
        out = part if out is None else out.union(part)
    return out


@_q(f"{_C} UNION {_S}")
def txn_assert(spark: SparkSession, d: str) -> DataFrame:
    """Asserting is idempotent, also twice in one transaction and of rows that are there."""
    s = _store(spark, d)
    t = s.begin()
    t.assert_("Member", _suppliers(spark, d))
    t.assert_("Member", _suppliers(spark, d))
    t.assert_("Member", _customers(spark, d))
    t.commit()
    return s.read("Member")


@_q(f"SELECT k, v FROM ({_C}) WHERE v <> 'MACHINERY'")
def txn_retract(spark: SparkSession, d: str) -> DataFrame:
    """Exact tuples; those that are not there change nothing."""
    s = _store(spark, d)
    t = s.begin()
    t.retract("Member", _customers(spark, d).where("v = 'MACHINERY'").union(_suppliers(spark, d)))
    t.commit()
    return s.read("Member")


@_q(f"SELECT k, v FROM ({_C}) WHERE v <> 'BUILDING' AND k <> 3")
def txn_retract_where(spark: SparkSession, d: str) -> DataFrame:
    """All rows of a pattern, read with the transaction's own writes."""
    s = _store(spark, d)
    t = s.begin()
    t.assert_("Member", _suppliers(spark, d))
    t.retract_where("Member", [None, "BUILDING"])
    t.retract_where("Member", [None, "SUPPLIER"])
    t.retract_where("Member", [3, None])
    t.commit()
    return s.read("Member")


@_q("SELECT user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS event_type FROM events GROUP BY user_id")
def txn_replace(spark: SparkSession, d: str) -> DataFrame:
    """x.event_type = v for every user: the row of the key leaves and the new one enters."""
    s = _store(spark, d)
    t = s.begin()
    t.replace("Latest", read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type")))
    t.commit()
    return s.read("Latest")


@_q("SELECT 'requirement not met; the transaction is aborted' AS outcome, count(*) AS members, 2::BIGINT AS versions_before, 2::BIGINT AS versions_after FROM customer WHERE FALSE HAVING TRUE")
def txn_require(spark: SparkSession, d: str) -> DataFrame:
    """A requirement that fails aborts: nothing is left of the transaction, and no version."""
    s = Store(spark)
    s.make_relation("Member", "k long, v string")
    s.make_relation("Other", "k long")
    before, t = s.version, s.begin()
    t.assert_("Member", _customers(spark, d))
    try:
        t.require(t.read("Member").count() == 0)
        outcome = "committed"
    except RuntimeError as e:
        outcome = str(e)
    return spark.createDataFrame([(outcome, s.read("Member").count(), before, s.version)], "outcome string, members long, versions_before long, versions_after long")


@_q(f"WITH want AS (SELECT k, v FROM ({_C}) WHERE k % 3 = 0 UNION {_S}) SELECT k, v, 1::BIGINT AS w FROM (SELECT * FROM want EXCEPT {_C}) UNION ALL SELECT k, v, -1 FROM ({_C} EXCEPT SELECT * FROM want)")
def txn_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The relation comes to hold exactly the rows wanted; the commit holds the fewest changes."""
    s = _store(spark, d)
    t = s.begin()
    t.reconcile("Member", _customers(spark, d).where("k % 3 = 0").union(_suppliers(spark, d)))
    return t.commit().changes["Member"].withColumnRenamed(D.W, "w")


@_q("SELECT DISTINCT c_custkey AS c0 FROM customer WHERE c_mktsegment = 'BUILDING'")
def txn_materialize(spark: SparkSession, d: str) -> DataFrame:
    """Derived rows written into a relation of the head's name, which outlives the rule."""
    s = _store(spark, d)
    s.install_rule(rule(atom("Builder", "?k"), atom("Member", "?k", "BUILDING"), id="builders"))
    t = s.begin()
    t.materialize_rules()
    t.commit()
    s.disable_rule("builders")
    return s.read("Builder")


@_q("""SELECT 'Member' AS relation, (SELECT count(*) FROM customer WHERE c_custkey <> 7) AS remaining, (SELECT count(*) FROM customer WHERE c_custkey = 7) + (SELECT count(DISTINCT user_id) FROM events WHERE user_id = 7) AS retracted
UNION ALL SELECT 'Latest', (SELECT count(DISTINCT user_id) FROM events WHERE user_id <> 7), (SELECT count(*) FROM customer WHERE c_custkey = 7) + (SELECT count(DISTINCT user_id) FROM events WHERE user_id = 7)""")
def txn_destroy(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark, d)
    t = s.begin()
    n = t.destroy_identity(7)
    t.commit()
    return spark.createDataFrame([(r, s.read(r).count(), n) for r in ("Member", "Latest")], "relation string, remaining long, retracted long")


@_q("""SELECT * FROM (VALUES ('same functional key', 'Conflict'), ('other functional key', 'committed'), ('retracted meanwhile, asserted again', 'Conflict'), ('new rows beside', 'committed'), ('appended events', 'committed'),
('no effect', 'no version'), ('computed relation', 'ReadOnlyRelation')) t(case_, outcome)""")
def txn_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """What another commit in between makes of a commit."""
    s = _store(spark, d)
    s.make_relation("Trail", "id long, what string", policy="event_append")
    out = []

    def race(case, first, second):
        a, b = s.begin(), s.begin()
        try:
            first(a)
            a.commit()
            second(b)
            out.append((case, "committed" if b.commit() else "no version"))
        except (Conflict, ReadOnlyRelation) as e:
            out.append((case, type(e).__name__))

    user, other = (r.user_id for r in s.read("Latest").orderBy("user_id").limit(2).collect())
    k, v = _customers(spark, d).orderBy("k").first()
    race("same functional key", lambda t: t.replace("Latest", [(user, "x")]), lambda t: t.replace("Latest", [(user, "y")]))
    race("other functional key", lambda t: t.replace("Latest", [(user, "z")]), lambda t: t.replace("Latest", [(other, "z")]))
    race("retracted meanwhile, asserted again", lambda t: t.retract("Member", [(k, v)]), lambda t: t.assert_("Member", [(k, v)]))
    race("new rows beside", lambda t: t.assert_("Member", [(-1, "a")]), lambda t: t.assert_("Member", [(-2, "b")]))
    race("appended events", lambda t: t.assert_("Trail", [(1, "a")]), lambda t: t.assert_("Trail", [(1, "b")]))
    race("no effect", lambda t: None, lambda t: t.assert_("Member", [(-1, "a")]))
    race("computed relation", lambda t: None, lambda t: t.assert_("TextSearch", [(1,)]))
    return spark.createDataFrame(out, "case_ string, outcome string")


# -- rules (R12-R16) --------------------------------------------------------------------------
@_q("""SELECT * FROM (VALUES ('negated variable not bound', 'UnsafeNegation'), ('compared variable not bound', 'UnsafeGuard'), ('head variable not bound', 'UnboundHeadVariable'), ('negation in a cycle', 'UnstratifiedNegation'),
('two arities', 'RuleError'), ('no body', 'RuleError')) t(case_, error)""")
def rule_errors(spark: SparkSession, d: str) -> DataFrame:
    cases = {
        "negated variable not bound": lambda: rule(atom("P", "?x"), atom("Q", "?x"), ~atom("R", "?y")), "compared variable not bound": lambda: rule(atom("P", "?x"), atom("Q", "?x"), guard("?y", "<", 1)),
        "head variable not bound": lambda: rule(atom("P", "?y"), atom("Q", "?x")),
        "negation in a cycle": lambda: RuleSet([rule(atom("P", "?x"), atom("Q", "?x"), ~atom("R", "?x")), rule(atom("R", "?x"), atom("P", "?x"))]),
        "two arities": lambda: RuleSet([rule(atom("P", "?x"), atom("Q", "?x")), rule(atom("P", "?x", "?x"), atom("Q", "?x"))]), "no body": lambda: rule(atom("P", 1))}
    out = []
    for case, make in cases.items():
        try:
            make()
            out.append((case, "none"))
        except RuleError as e:
            out.append((case, type(e).__name__))
    return spark.createDataFrame(out, "case_ string, error string")


def _tree(spark, d):
    """Every customer under the one of a tenth of its number; 0 is its own parent."""
    return read(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.expr("c_custkey div 10").alias("b")).distinct()


_T = "e AS (SELECT DISTINCT c_custkey AS a, c_custkey // 10 AS b FROM customer)"
REACH = (rule(atom("Reach", "?x", "?y"), atom("Edge", "?x", "?y"), id="edge"), rule(atom("Reach", "?x", "?z"), atom("Reach", "?x", "?y"), atom("Edge", "?y", "?z"), id="step"))


@_q(f"WITH {_T} SELECT a AS c0, b AS c1 FROM e UNION SELECT x.a, y.b FROM (SELECT a, b FROM e WHERE a < 100) x JOIN e y ON x.b = y.a UNION SELECT a, b FROM e WHERE a < 100")
def rule_single_pass(spark: SparkSession, d: str) -> DataFrame:
    """evaluate: one pass, in which a recursive atom sees the base rows alone."""
    e = _tree(spark, d)
    return RuleSet(REACH).evaluate(_Named(Edge=e, Reach=e.where("a < 100")))["Reach"]


@_q("SELECT * FROM (VALUES ('edge', 'active', 'Reach(?x, ?y) :- Edge(?x, ?y)'), ('step', 'disabled', 'Reach(?x, ?z) :- Reach(?x, ?y), Edge(?y, ?z)')) t(rule, state, source)")
def rule_management(spark: SparkSession, d: str) -> DataFrame:
    rs = RuleSet(REACH)
    rs.disable("step")
    return spark.createDataFrame([(k, s, r.describe()) for s, rules in (("active", rs.rules), ("disabled", rs.disabled)) for k, r in rules.items()], "rule string, state string, source string")


@_q(f"""WITH RECURSIVE {_T}, p AS (SELECT a, b, 0::BIGINT AS n FROM e UNION SELECT p.a, e.b, p.n + 1 FROM p JOIN e ON p.b = e.a WHERE p.n < 8), m AS (SELECT a, b, min(n) AS n FROM p GROUP BY ALL)
SELECT n AS round, count(*) AS novel FROM m WHERE n > 0 GROUP BY n""")
def rule_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of the fixpoint and how many rows each brought."""
    stats = Stats()
    RuleSet(REACH).fixpoint(_Named(Edge=_tree(spark, d)), ["Reach"], stats=stats)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(stats.novel) if n], "round long, novel long")


_CLOSED = "WITH RECURSIVE {0}, p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT a AS c0, b AS c1 FROM p"


@_q(_CLOSED.format(_T))
def materialize_closure(spark: SparkSession, d: str) -> DataFrame:
    """The closure reconciled into a relation of the store."""
    s = Store(spark)
    s.make_relation("DelegatesStar", "c0 long, c1 long")
    t = s.begin()
    t.assert_("DelegatesStar", [(-1, -2)])  # leaves again
    G.materialize_closure(t, "DelegatesStar", _tree(spark, d), "a", "b")
    t.commit()
    return s.read("DelegatesStar")


# -- maintenance (D3-D13) ---------------------------------------------------------------------
@_q("SELECT DISTINCT user_id AS c0 FROM events WHERE event_type = 'purchase' AND event_id % 3 <> 0")
def maintain_support(spark: SparkSession, d: str) -> DataFrame:
    """A user stays a buyer while one purchase is left."""
    e = read(spark, d, "events").select("user_id", "event_id", "event_type")
    view = D.MaintainedView(RuleSet([rule(atom("Buyer", "?u"), atom("Event", "?u", "?e", "purchase"))]), {"Event": e}, Scratch(spark))
    view.advance({"Event": D.zset(e.where("event_id % 3 = 0"), -1)})
    return view.read("Buyer")


@_q("""WITH c AS (SELECT DISTINCT c_custkey AS k FROM customer), u AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'),
r0 AS (SELECT DISTINCT o_custkey AS k FROM u WHERE o_orderkey % 2 = 0), r1 AS (SELECT DISTINCT o_custkey AS k FROM u WHERE o_orderkey % 4 <> 0)
SELECT k AS c0, 1::BIGINT AS w FROM (SELECT k FROM c EXCEPT SELECT k FROM r1 EXCEPT (SELECT k FROM c EXCEPT SELECT k FROM r0)) UNION ALL SELECT k, -1 FROM (SELECT k FROM c EXCEPT SELECT k FROM r0 EXCEPT (SELECT k FROM c EXCEPT SELECT k FROM r1))""")
def maintain_negation(spark: SparkSession, d: str) -> DataFrame:
    """Customers without urgent orders, as orders come and go: the visible changes."""
    c, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rs = RuleSet([rule(atom("Ordered", "?c"), atom("Order", "?o", "?c", "1-URGENT")), rule(atom("Idle", "?c"), atom("Customer", "?c"), ~atom("Ordered", "?c"))])
    view = D.MaintainedView(rs, {"Customer": c, "Order": o.where("o_orderkey % 2 = 0")}, Scratch(spark))
    out = view.advance({"Order": D.zset(o.where("o_orderkey % 4 = 0"), -1).union(D.zset(o.where("o_orderkey % 2 = 1"), 1))})
    return out.get("Idle", D.zset(c.limit(0).toDF("c0"))).withColumnRenamed(D.W, "w")


@_q("SELECT DISTINCT c_custkey AS c0, n_name AS c1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0 AND n_nationkey <> 3")
def maintain_join(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of a join change at once; each new pair counts once."""
    c, n = read(spark, d, "customer").select("c_custkey", "c_nationkey"), read(spark, d, "nation").select("n_nationkey", "n_name")
    rs = RuleSet([rule(atom("Home", "?c", "?name"), atom("Customer", "?c", "?n"), atom("Nation", "?n", "?name"))])
    view = D.MaintainedView(rs, {"Customer": c.where("c_custkey % 5 <> 0"), "Nation": n.where("n_nationkey <> 4")}, Scratch(spark))
    view.advance({"Customer": D.zset(c.where("c_custkey % 5 = 0 and c_custkey % 7 <> 0"), 1).union(D.zset(c.where("c_custkey % 5 <> 0 and c_custkey % 7 = 0"), -1)),
                  "Nation": D.zset(n.where("n_nationkey = 4"), 1).union(D.zset(n.where("n_nationkey = 3"), -1))})
    return view.read("Home")


@_q(_CLOSED.format("e AS (SELECT a, b FROM (SELECT DISTINCT c_custkey AS a, c_custkey // 10 AS b FROM customer) WHERE a % 11 <> 5 UNION SELECT -1::BIGINT, 12::BIGINT UNION SELECT 0::BIGINT, -2::BIGINT)"))
def maintain_recursive(spark: SparkSession, d: str) -> DataFrame:
    """Delete and rederive over a tree that grows with the table: every eleventh edge goes, two come."""
    e = _tree(spark, d)
    view = D.MaintainedView(RuleSet(REACH), {"Edge": e}, Scratch(spark))
    view.advance({"Edge": D.zset(e.where("a % 11 = 5"), -1).union(D.zset(spark.createDataFrame([(-1, 12), (0, -2)], "a long, b long"), 1))})
    return view.read("Reach")


@_q(_CLOSED.format("e AS (SELECT DISTINCT c_custkey AS a, c_custkey // 10 AS b FROM customer WHERE c_custkey % 13 <> 0)"))
def maintain_lost_base(spark: SparkSession, d: str) -> DataFrame:
    """Base rows of a recursive head leave, and a negated input gains rows."""
    e = _tree(spark, d)
    rs = RuleSet([rule(atom("Reach", "?x", "?y"), atom("Edge", "?x", "?y"), ~atom("Cut", "?x")), rule(atom("Reach", "?x", "?z"), atom("Reach", "?x", "?y"), atom("Edge", "?y", "?z"), ~atom("Cut", "?y"))])
    base = spark.createDataFrame([(-5, 3)], "a long, b long")
    view = D.MaintainedView(rs, {"Edge": e, "Cut": e.select("a").limit(0), "Reach": base}, Scratch(spark))
    view.advance({"Reach": D.zset(base, -1), "Cut": D.zset(e.select("a").where("a % 13 = 0"), 1)})
    return view.read("Reach")


@_q("SELECT DISTINCT c_custkey AS c0 FROM customer WHERE c_mktsegment = 'MACHINERY'")
def maintain_computed(spark: SparkSession, d: str) -> DataFrame:
    """What depends on a relation made at scan time is evaluated afresh."""
    class Wanted:
        segment = "BUILDING"

        def read(self, name):
            return spark.createDataFrame([(self.segment,)], "v string")

    made = Wanted()
    rs = RuleSet([rule(atom("Chosen", "?k"), atom("Member", "?k", "?v"), atom("Wanted", "?v")), rule(atom("Shown", "?k"), atom("Chosen", "?k"))])
    view = D.MaintainedView(rs, {"Member": _customers(spark, d)}, Scratch(spark), computed=made)
    made.segment = "MACHINERY"
    view.advance({})
    view.check()
    return view.read("Shown")


@_q("SELECT 'negative differential support' AS error")
def maintain_invariant(spark: SparkSession, d: str) -> DataFrame:
    """A row that loses more derivations than it has is an error, not a negative count."""
    s = D.consolidate(D.zset(read(spark, d, "nation").select(F.col("n_regionkey").alias("r"))))
    try:
        D.support_change(s, s.drop(D.W).limit(0), D.zset(read(spark, d, "customer").select(F.lit(0).alias("r")), -1))[0].collect()
        found = "none"
    except Exception as e:
        found = "negative differential support" if "negative differential support" in str(e) else type(e).__name__
    return spark.createDataFrame([(found,)], "error string")


@_q(f"SELECT k, v, 1::BIGINT AS batches FROM ({_C}) WHERE k % 9 <> 0")
def arrangement_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Nine changes on one base: it is written again after the eighth, and one change is left."""
    rows = _customers(spark, d)
    a = D.Arrangement(Scratch(spark), rows)
    for i in range(8):
        a.add(D.zset(rows.where(f"k % 9 = 0 and k % 8 = {i}"), -1))
    a.add(D.zset(rows.limit(0), 1))
    return a.rows().withColumn("batches", F.lit(len(a.deltas)).cast("long"))


@_q("SELECT DISTINCT c_custkey AS c0 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey <> 1 UNION SELECT s_suppkey FROM supplier WHERE s_suppkey <> 1")
def txn_overlay(spark: SparkSession, d: str) -> DataFrame:
    """A derived relation read inside a transaction that has not committed."""
    s = _store(spark, d)
    s.install_rule(rule(atom("Builder", "?k"), atom("Member", "?k", "BUILDING"), id="builders"))
    t = s.begin()
    t.assert_("Member", _suppliers(spark, d).withColumn("v", F.lit("BUILDING")))
    t.retract("Member", [(1, "BUILDING")])
    return t.read("Builder")


@_q("""WITH b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'), s AS (SELECT DISTINCT s_suppkey AS k FROM supplier)
SELECT k AS c0, 1::BIGINT AS w FROM (SELECT k FROM s EXCEPT SELECT k FROM b)""")
def visible_changes(spark: SparkSession, d: str) -> DataFrame:
    """The commit's visible changes of a derived relation that is kept warm: zero crossings only."""
    s = _store(spark, d)
    s.make_relation("Site", "k long")
    s.install_rule(rule(atom("Builder", "?k"), atom("Member", "?k", "BUILDING"), id="members"))
    s.install_rule(rule(atom("Builder", "?k"), atom("Site", "?k"), id="sites"))
    s.keep_warm("Builder")
    t = s.begin()
    t.assert_("Site", read(spark, d, "supplier").select("s_suppkey"))
    return t.commit().visible["Builder"].withColumnRenamed(D.W, "w")


# -- feeds (S1-S11) ---------------------------------------------------------------------------
def _messages(spark, *boxes) -> DataFrame:
    """(feed, place, kind, rows) of every message that has come."""
    out = [(name, i, m.kind, m.rows.count() if m.rows is not None else 0) for name, box in boxes for i, m in enumerate(box.drain())]
    return spark.createDataFrame(out, "feed string, place long, kind string, rows long")


def _write(s: Store, *rows) -> None:
    t = s.begin()
    t.assert_("Member", list(rows))
    t.commit()


@_q("SELECT k, v, 1::BIGINT AS w FROM (SELECT s_suppkey AS k, 'SUPPLIER' AS v FROM supplier WHERE s_suppkey = 5)")
def feed_facts(spark: SparkSession, d: str) -> DataFrame:
    """Stored changes, filtered by a bound position."""
    s = _store(spark, d)
    sub = Subscription(s, "facts", "Member", bindings=(5, None))
    t = s.begin()
    t.assert_("Member", _suppliers(spark, d))
    t.commit()
    return sub.mailbox.drain()[0].rows.withColumnRenamed(D.W, "w")


@_q("SELECT * FROM (VALUES ('relation', 0, 'snapshot', 0), ('relation', 1, 'changes', 2), ('relation', 2, 'changes', 1)) t(feed, place, kind, n)")
def feed_relation(spark: SparkSession, d: str) -> DataFrame:
    """Visible changes of a derived relation: another derivation of a row shows nothing."""
    s = _store(spark, d)
    s.install_rule(rule(atom("New", "?k"), atom("Member", "?k", "?v"), guard("?k", "<", 0), id="new"))
    sub = Subscription(s, "relation", "New", start="snapshot")
    _write(s, (-1, "a"), (-2, "a"))
    _write(s, (-1, "b"))
    t = s.begin()
    t.retract_where("Member", [-2, None])
    t.commit()
    return _messages(spark, ("relation", sub.mailbox)).withColumnRenamed("rows", "n")


@_q("SELECT * FROM (VALUES ('catalogue', 0, 'catalogue', 0), ('catalogue', 1, 'catalogue', 0), ('relation', 0, 'changes', 1)) t(feed, place, kind, n)")
def feed_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Changes of relations and rules; a rule that goes takes its rows from the view's feed."""
    s = Store(spark)
    s.make_relation("Member", "k long, v string")
    _write(s, (1, "a"))
    s.install_rule(rule(atom("New", "?k"), atom("Member", "?k", "?v"), id="new"))
    cat, sub = Subscription(s, "catalogue"), Subscription(s, "relation", "New")
    s.make_relation("Other", "k long")
    s.disable_rule("new")
    return _messages(spark, ("catalogue", cat.mailbox), ("relation", sub.mailbox)).withColumnRenamed("rows", "n")


@_q("SELECT 'snapshot' AS kind, count(*) AS n FROM (SELECT DISTINCT c_custkey, c_mktsegment FROM customer) UNION ALL SELECT 'changes', 1")
def feed_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The rows first, then changes without a gap."""
    s = _store(spark, d)
    sub = Subscription(s, "facts", "Member", start="snapshot")
    _write(s, (-1, "a"))
    return _messages(spark, ("f", sub.mailbox)).select("kind", F.col("rows").alias("n"))


@_q("SELECT * FROM (VALUES ('kept', 0, 'changes', 1), ('kept', 1, 'changes', 2), ('lost', 0, 'resynchronize', 0), ('catalogue moved', 0, 'resynchronize', 0)) t(feed, place, kind, n)")
def feed_resume(spark: SparkSession, d: str) -> DataFrame:
    """A cursor resumes where the commits since are kept and the catalogue stood still."""
    s = Store(spark)
    s.make_relation("Member", "k long, v string")
    at = s.version
    _write(s, (1, "a"))
    _write(s, (2, "a"), (3, "a"))
    kept, lost = Subscription(s, "facts", "Member", cursor=at), Subscription(s, "facts", "Member", cursor=-9)
    s.make_relation("Other", "k long")
    moved = Subscription(s, "facts", "Member", cursor=at)
    return _messages(spark, ("kept", kept.mailbox), ("lost", lost.mailbox), ("catalogue moved", moved.mailbox)).withColumnRenamed("rows", "n")


@_q("SELECT * FROM (VALUES ('slow', 0, 'resynchronize', 0), ('slow', 1, 'changes', 1), ('read', 0, 'changes', 1), ('read', 1, 'changes', 1), ('read', 2, 'changes', 1), ('read', 3, 'changes', 1)) t(feed, place, kind, n)")
def feed_backpressure(spark: SparkSession, d: str) -> DataFrame:
    """A backlog over the budget becomes one marker."""
    s = Store(spark)
    s.make_relation("Member", "k long, v string")
    slow, ready = Subscription(s, "facts", "Member", budget=2), Subscription(s, "facts", "Member")
    for i in range(4):
        _write(s, (i, "a"))
    return _messages(spark, ("slow", slow.mailbox), ("read", ready.mailbox)).withColumnRenamed("rows", "n")


@_q("SELECT * FROM (VALUES ('revoked', 0, 'changes', 1), ('revoked', 1, 'revoked', 0), ('cancelled', 0, 'changes', 1)) t(feed, place, kind, n)")
def feed_end(spark: SparkSession, d: str) -> DataFrame:
    """Revoked authority ends a feed with a marker; a cancelled feed just ends."""
    s = Store(spark)
    s.make_relation("Member", "k long, v string")
    rights = [True]
    one, two = Subscription(s, "facts", "Member", allowed=lambda: rights[0]), Subscription(s, "facts", "Member")
    _write(s, (1, "a"))
    rights[0] = False
    two.cancel()
    _write(s, (2, "a"))
    _write(s, (3, "a"))
    return _messages(spark, ("revoked", one.mailbox), ("cancelled", two.mailbox)).withColumnRenamed("rows", "n")


@_q("SELECT * FROM (VALUES ('before the commit', 0), ('after an abort', 0), ('after the commit', 2)) t(moment, waiting)")
def mailbox_sends(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a transaction come with its commit, in order, or not at all."""
    from .streaming.feed import Mailbox

    s, box, out = Store(spark), Mailbox(), []
    s.make_relation("Member", "k long, v string")
    t = s.begin()
    t.send(box, "first")
    t.send(box, "second")
    out.append(("before the commit", len(box.items)))
    gone = s.begin()
    gone.send(box, "never")
    gone.abort()
    out.append(("after an abort", len(box.items)))
    t.commit()
    out.append(("after the commit", len(box.drain())))
    return spark.createDataFrame(out, "moment string, waiting int")


@_q("SELECT DISTINCT c_custkey AS c0 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 UNION SELECT DISTINCT s_suppkey FROM supplier")
def projected_replica(spark: SparkSession, d: str) -> DataFrame:
    """A copy of one relation with rules of its own, fed by a store's commits; a batch seen twice counts once."""
    s = _store(spark, d)
    mine = Replica(D.MaintainedView(RuleSet([rule(atom("Builder", "?k"), atom("Member", "?k", "BUILDING"))]), {"Member": s.read("Member")}, Scratch(spark)), s.version)
    t = s.begin()
    t.retract("Member", _customers(spark, d).where("k % 2 = 1"))
    t.assert_("Member", _suppliers(spark, d).withColumn("v", F.lit("BUILDING")))
    c = t.commit()
    for _ in range(2):
        mine.apply(c.version, c.changes)
    return mine.read("Builder")


# -- stored versions (K4-K6, K10) -------------------------------------------------------------
@_q(f"SELECT k, v FROM ({_C}) WHERE k % 2 = 0 UNION {_S}")
def store_recovery(spark: SparkSession, d: str) -> DataFrame:
    """A durable store opened again: its last whole commit, without what was volatile."""
    path = f"{scratch_root(spark)}/store-{uuid.uuid4().hex}"
    s = _store(spark, d, path)
    s.make_relation("Session", "k long, v string", durability="volatile")
    t = s.begin()
    t.retract("Member", _customers(spark, d).where("k % 2 = 1"))
    t.assert_("Session", _customers(spark, d))
    t.commit()
    t = s.begin()
    t.assert_("Member", _suppliers(spark, d))
    t.commit()
    again = Store.open(spark, path)
    return again.read("Member").union(again.read("Session"))


@_q(_C)
def store_earlier_version(spark: SparkSession, d: str) -> DataFrame:
    """The same store as of an earlier version, from its manifest and change rows."""
    path = f"{scratch_root(spark)}/store-{uuid.uuid4().hex}"
    s = _store(spark, d, path)
    at = s.version
    t = s.begin()
    t.reconcile("Member", _suppliers(spark, d))
    t.commit()
    return Store.open(spark, path, at).read("Member").distinct()


@_q("SELECT 'open' AS moment, 2::BIGINT AS rows_ UNION ALL SELECT 'one closed', 1 UNION ALL SELECT 'reopened store', 0")
def host_rows(spark: SparkSession, d: str) -> DataFrame:
    """Volatile rows of an endpoint: there while it is open, gone when it closes and after a restart."""
    path = f"{scratch_root(spark)}/store-{uuid.uuid4().hex}"
    s, out = Store(spark, path), []
    s.make_relation("HttpRequest", "endpoint string, path string", durability="volatile")
    s.host_rows("a", "HttpRequest", [("a", "/x")])
    s.host_rows("b", "HttpRequest", [("b", "/y")])
    out.append(("open", s.read("HttpRequest").count()))
    s.close_endpoint("a")
    out.append(("one closed", s.read("HttpRequest").count()))
    out.append(("reopened store", Store.open(spark, path).read("HttpRequest").count()))
    return spark.createDataFrame(out, "moment string, rows_ long")


# -- version control (P12) ----------------------------------------------------------------------
def _repository(spark: SparkSession) -> str:
    """A small repository of fixed content and dates in the shared folder."""
    path = f"{scratch_root(spark)}/git-{uuid.uuid4().hex}".removeprefix("file:")
    os.makedirs(path)
    env = {**os.environ, "GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "ann@example.org", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "ann@example.org", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    run = lambda *args, at=0: subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, env={**env, "GIT_AUTHOR_DATE": f"{1_700_000_000 + at} +0000", "GIT_COMMITTER_DATE": f"{1_700_000_000 + at} +0000"})
    run("init", "-q", "-b", "main")
    versions = [{"a.txt": "one\ntwo\nthree\n", "b.txt": "b\n"}, {"a.txt": "zero\none\ntwo\nthree\n"}, {"a.txt": "zero\none\n2\nthree\n", "c.txt": "c\n"}]
    for i, files in enumerate(versions):
        for name, text in files.items():
            with open(os.path.join(path, name), "w") as f:
                f.write(text)
        run("add", "-A")
        run("commit", "-q", "-m", f"change {i}", at=60 * i)
    run("tag", "first", "HEAD~2")
    return path


@_q("""SELECT * FROM (VALUES ('RepositoryVcs', 'git'), ('RefTarget', 'refs/heads/main'), ('RefTarget', 'refs/tags/first'), ('CommitLog', 'change 0|Ann|1700000000'), ('CommitLog', 'change 1|Ann|1700000060'), ('CommitLog', 'change 2|Ann|1700000120'),
('CommitParents', '0'), ('CommitParents', '0'), ('CommitSearch', 'change 1'), ('ChangedFiles', 'a.txt|modified'), ('ChangedFiles', 'c.txt|added'),
('FileDiffLine', '0|0||1|added|zero'), ('FileDiffLine', '0|1|1|2|context|one'), ('FileDiffLine', '0|2|2||removed|two'), ('FileDiffLine', '0|3||3|added|2'), ('FileDiffLine', '0|4|3|4|context|three'),
('FileLineProjection', '1|1|2|2|shifted'), ('FileLineProjection', '2|2|3|3|changed'), ('FileHistory', 'change 0'), ('FileHistory', 'change 1'), ('FileHistory', 'change 2'),
('FileBlame', '1|change 1'), ('FileBlame', '2|change 0'), ('FileBlame', '3|change 2'), ('FileBlame', '4|change 0'), ('FileBlameHunk', '1|1'), ('FileBlameHunk', '2|2'), ('FileBlameHunk', '3|3'), ('FileBlameHunk', '4|4'),
('ReceivedRefUpdate', 'refs/heads/main|update'), ('ReceivedRefUpdate', 'refs/heads/main|create'), ('ReceivedRefUpdate', 'refs/tags/first|delete')) t("view", row_)""")
def version_control(spark: SparkSession, d: str) -> DataFrame:
    """All version-control views over a small repository of fixed content."""
    repos = spark.createDataFrame([(_repository(spark),)], "repository string")
    log = Scratch(spark).keep(V.commits(repos), "log")
    blame = V.file_blame(repos, "HEAD", "a.txt")
    none, zero, one = "0" * 40, "a" * 40, "b" * 40
    updates = spark.createDataFrame([("r", f"{none} {zero} refs/heads/main\n{zero} {one} refs/heads/main"), ("r", f"{one} {none} refs/tags/first"), ("r", None), ("r", "")], "repository string, lines string")
    parts = {
        "RepositoryVcs": (V.repository_vcs(repos), ["vcs"]), "RefTarget": (V.ref_targets(repos), ["ref"]), "CommitLog": (log, ["summary", "name", "timestamp"]), "CommitParents": (V.commit_parents(log), ["index"]),
        "CommitSearch": (V.commit_search(log, "CHANGE 1", 5), ["summary"]), "ChangedFiles": (V.changed_files(repos, "HEAD~1", "HEAD"), ["path", "kind"]),
        "FileDiffLine": (V.file_diff_lines(repos, "HEAD~2", "HEAD", "a.txt"), ["hunk", "line_index", "old_line", "new_line", "kind", "text"]),
        "FileLineProjection": (V.line_projection(repos, "HEAD~2", "HEAD", "a.txt", 1, 1).union(V.line_projection(repos, "HEAD~2", "HEAD", "a.txt", 2, 2)), ["start", "end", "projected_start", "projected_end", "quality"]),
        "FileHistory": (V.file_history(repos, "a.txt"), ["summary"]), "FileBlame": (blame, ["line", "summary"]), "FileBlameHunk": (V.blame_hunks(blame), ["start_line", "end_line"]),
        "ReceivedRefUpdate": (V.received_ref_updates(updates), ["ref", "kind"]),
    }
    out = None
    for name, (df, cols) in parts.items():
        part = df.select(F.lit(name).alias("view"), F.array_join(F.array(*[F.col(c).cast("string") for c in cols]), "|", "").alias("row_"))
        out = part if out is None else out.union(part)
    return out
