import pytest

from quern.plans.rules import atom, rule
from quern.store import Conflict, Store
from quern.streaming.feed import Subscription, change_log, current, replicate


def make(spark, path=None):
    s = Store(spark, path)
    s.make_relation("Held", "item long, who long")
    s.make_functional_relation("Name", "id long, name string", [0])
    return s


def test_read_your_writes_and_commit(spark, rows):
    s = make(spark)
    t = s.begin()
    t.assert_("Held", [(1, 2), (1, 2)])
    assert rows(t.read("Held")) == [(1, 2)] and rows(s.read("Held")) == []
    v = s.version
    c = t.commit()
    assert c.version == v + 1 and rows(s.read("Held")) == [(1, 2)]
    t = s.begin()
    t.assert_("Held", [(1, 2)])
    assert t.commit() is None  # no effect, no version
    t = s.begin()
    t.retract_where("Held", [1, None])
    t.abort()
    assert rows(s.read("Held")) == [(1, 2)]


def test_functional_replace_reconcile_destroy(spark, rows):
    s = make(spark)
    t = s.begin()
    t.replace("Name", [(1, "a"), (2, "b")])
    t.replace("Name", [(1, "c")])
    t.assert_("Held", [(1, 5), (3, 5)])
    t.commit()
    assert rows(s.read("Name")) == [(1, "c"), (2, "b")]
    t = s.begin()
    t.reconcile("Held", [(3, 5), (4, 4)])
    assert rows(t.commit().changes["Held"]) == [(1, 5, -1), (4, 4, 1)]
    t = s.begin()
    assert t.destroy_identity(2) == 1
    t.commit()
    assert rows(s.read("Name")) == [(1, "c")]


def test_conflicts(spark):
    s = make(spark)
    t = s.begin()
    t.replace("Name", [(1, "a")])
    t.assert_("Held", [(1, 1)])
    t.commit()
    a, b = s.begin(), s.begin()
    a.replace("Name", [(1, "x")])
    a.commit()
    b.replace("Name", [(1, "y")])
    with pytest.raises(Conflict):
        b.commit()
    a, b, c = s.begin(), s.begin(), s.begin()
    a.retract("Held", [(1, 1)])
    a.commit()
    b.assert_("Held", [(1, 1)])
    with pytest.raises(Conflict):
        b.commit()
    c.assert_("Held", [(2, 2)])
    assert c.commit() is not None


def test_derived_reads_and_subscription(spark, rows):
    s = make(spark)
    s.make_relation("Carried", "item long")
    s.install_rule(rule(atom("Carried", "?i"), atom("Held", "?i", "?w"), id="carried"))
    sub = Subscription(s, "relation", "Carried", start="snapshot")
    facts = Subscription(s, "facts", "Held", bindings=(None, 7))
    cat = Subscription(s, "catalogue")
    t = s.begin()
    t.assert_("Held", [(1, 7), (2, 8)])
    assert rows(t.read("Carried")) == [(1,), (2,)]
    t.commit()
    got = sub.mailbox.drain()
    assert [m.kind for m in got] == ["snapshot", "changes"] and rows(got[1].rows) == [(1, 1), (2, 1)]
    assert [rows(m.rows) for m in facts.mailbox.drain()] == [[(1, 7, 1)]]
    t = s.begin()
    t.assert_("Held", [(1, 9)])  # another derivation of the same row: nothing visible
    t.commit()
    assert sub.mailbox.drain() == []
    s.disable_rule("carried")
    assert [m.kind for m in cat.mailbox.drain()] == ["catalogue"]
    assert rows(sub.mailbox.drain()[0].rows) == [(1, -1), (2, -1)]
    sub.cancel()
    assert sub._on_commit not in s.listeners


def test_resume_budget_and_revocation(spark):
    s = make(spark)
    for i in range(3):
        t = s.begin()
        t.assert_("Held", [(i, i)])
        t.commit()
    assert [m.kind for m in Subscription(s, "facts", "Held", cursor=s.version - 2).mailbox.drain()] == ["changes", "changes"]
    assert [m.kind for m in Subscription(s, "facts", "Held", cursor=-5).mailbox.drain()] == ["resynchronize"]
    small = Subscription(s, "facts", "Held", budget=1)
    gone = Subscription(s, "facts", "Held", allowed=lambda: False)
    for i in range(3, 5):
        t = s.begin()
        t.assert_("Held", [(i, i)])
        t.commit()
    assert [m.kind for m in small.mailbox.drain()] == ["resynchronize"]
    assert [m.kind for m in gone.mailbox.drain()] == ["revoked"]


def test_recovery(spark, rows, tmp_path):
    s = make(spark, str(tmp_path))
    s.make_relation("Session", "id long", durability="volatile")
    s.install_rule(rule(atom("Big", "?i"), atom("Held", "?i", "?w"), id="big"))
    for i in range(9):  # enough for a compaction
        t = s.begin()
        t.assert_("Held", [(i, 0)])
        t.assert_("Session", [(i,)])
        if i == 8:
            t.retract("Held", [(0, 0)])
        t.commit()
    again = Store.open(spark, str(tmp_path))
    assert rows(again.read("Held")) == [(i, 0) for i in range(1, 9)]
    assert again.read("Session").count() == 0 and again.version == s.version
    assert rows(again.read("Big")) == [(i,) for i in range(1, 9)]
    assert again.catalog.relations["Name"].policy == "functional"


def test_streamed_replica(spark, rows, tmp_path):
    ddl = "version long, __w long, a long"
    log, target, ck = (str(tmp_path / n) for n in ("log", "target", "ck"))
    spark.createDataFrame([(1, 1, 5), (2, -1, 5), (2, 1, 6)], ddl).write.parquet(log)
    replicate(change_log(spark, log, ddl), target, ["a"], ck).awaitTermination()
    assert rows(current(spark, target)) == [(6,)]
    spark.createDataFrame([(3, 1, 5), (3, -1, 6)], ddl).write.mode("append").parquet(log)
    replicate(change_log(spark, log, ddl), target, ["a"], ck).awaitTermination()
    assert rows(current(spark, target)) == [(5,)]
