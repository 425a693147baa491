"""Problems 1, 2 and 4 on small cases: nulls, ties, repeats, empty tables, extra columns."""

import datetime as dt
import random

import pytest

from quern.operators.hierarchy import all_descendants, ancestors_of, build_hierarchy, descendants_of
from quern.operators.orphans import bloom_blocks, bloom_flag, find_orphans, hot_buckets, reference_orphans
from quern.operators.replay import replay, watermark

T = [dt.datetime(2025, 1, 1) + dt.timedelta(days=i) for i in range(60)]
REF = "ref_id long, repository string, symbol string, path string, indexed_at timestamp, count long"
LIFE = "repository string, symbol string, indexed_at timestamp, deleted_at timestamp, ref_id long"
FILE = "repository string, path string, indexed_at timestamp, deleted_at timestamp"


def test_orphans(spark, rows):
    refs = spark.createDataFrame([
        (1, "r", "a", None, T[5], 0), (1, "r", "a", None, T[5], 0), (2, "r", "a", None, T[0], 0), (3, "r", "a", None, T[20], 0), (4, "r", "zz", "p", T[40], 0),
        (5, "r", None, "", T[5], 0), (6, "r", "a", "p", None, 0), (7, None, "a", None, T[5], 0), (8, "r", "a", None, T[1], 0), (9, "r", "a", None, T[10], 0), (10, "q", "a", None, T[5], 0)], REF)
    lives = spark.createDataFrame([("r", "a", T[1], T[10], 1), ("r", "a", T[1], T[10], 1), ("r", "n", None, None, 1), (None, "a", T[0], None, 1)], LIFE)
    files = spark.createDataFrame([("r", "p", T[50], None)], FILE)
    want = [(2, "symbol", "late", "2025-01"), (3, "symbol", "deleted", "2025-01"), (4, "path", "late", "2025-02"), (4, "symbol", "missing", "2025-02"), (7, "symbol", "missing", "2025-01"), (9, "symbol", "deleted", "2025-01"), (10, "symbol", "missing", "2025-01")]
    assert rows(reference_orphans(refs, lives, files)) == sorted(want, key=repr)
    # The same with a filter of one block a pass, and with every key treated as hot.
    assert rows(reference_orphans(refs, lives, files, filter_limit_mb=0, bits_per_key=400)) == sorted(want, key=repr)
    assert rows(reference_orphans(refs, lives, files, hot_share=10**9, hot_least=0)) == sorted(want, key=repr)
    assert reference_orphans(refs.limit(0), lives, files).count() == 0
    assert reference_orphans(refs, lives.limit(0), files.limit(0)).where("reason <> 'missing'").count() == 0


def test_orphans_random(spark):
    rng = random.Random(2)
    lives = [(rng.choice("abc"), T[rng.randrange(40)]) for _ in range(12)]
    lives = [(k, b, b + dt.timedelta(days=rng.randrange(1, 9)) if rng.random() < 0.8 else None) for k, b in lives]
    refs = [(i, rng.choice("abcd"), T[rng.randrange(60)]) for i in range(80)]
    got = find_orphans(spark.createDataFrame(refs, "id long, k string, at timestamp"), spark.createDataFrame(lives, "k string, born timestamp, died timestamp"), key=["k"], carry=["id"])
    want = {}
    for i, k, t in refs:
        own = [x for x in lives if x[0] == k]
        if not any(b <= t and (d is None or d > t) for _, b, d in own):
            want[i] = "missing" if not own else "deleted" if any(b <= t for _, b, _ in own) else "late"
    assert {r.id: r.reason for r in got.collect()} == want


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id) h")
    f = bloom_blocks(keys, "h", 125)
    assert bloom_flag(keys, "h", f, 125, "m").where("not m").count() == 0
    other = spark.range(10_000, 20_000).selectExpr("xxhash64(id) h")
    assert bloom_flag(other, "h", f, 125, "m").where("m").count() < 600
    load = spark.range(1000).selectExpr("xxhash64(id % 10) h").union(spark.range(500).selectExpr("xxhash64(3L) h"))
    assert [n for _, n in hot_buckets(load, "h", 5, 0)] == [2]


LOG = "delivery_id long, world string, version long, catalog_changes array<struct<change:string,relation:string,rule_id:string,functional:boolean>>, changes array<struct<relation:string,tuple:array<string>,kind:string>>, received_at timestamp, state string"


def made(r, f=False):
    return ("RelationCreated", r, None, f)


def test_replay(spark, rows):
    a, r = "Assert", "Retract"
    log = spark.createDataFrame([
        (1, "w", 1, [made("S"), made("F", True), ("RuleInstalled", "S", "r1", None)], [("S", ["x", "y"], a), ("F", ["k", "1"], a), ("N", ["early"], a)], T[1], "s"),
        (2, "w", 1, [made("S")], None, T[0], "s"),  # an older delivery of version 1
        (3, "w", 2, [], [("F", ["k", "2"], a), ("S", ["x", "y"], a), ("S", ["x", "y"], r)], T[3], "s"),  # retractions first
        (4, "w", 4, [made("N"), ("RuleInstalled", "F", "r1", None), ("RuleInstalled", "F", "r2", None)], [("F", ["k", "1"], r), ("N", ["n"], a), (None, ["z"], a)], T[2], "s"),
        (5, "w", 5, [("RuleDisabled", None, "r2", None)], [("S", ["q"], r), ("F", ["j", "3"], a), ("F", ["j", "4"], a)], T[6], "s"),
        (6, "w", 5, [], [("S", ["tie"], a)], T[6], "s"),  # same time, higher id: this one counts
        (7, "w", None, [made("S")], [("S", ["no"], a)], T[9], "s"),
        (8, "v", 3, None, [("S", ["x"], a)], None, "s"),
        (9, None, 1, [made("S")], [("S", ["x"], a)], T[1], "s"),
    ], LOG)
    want = [("w", "fact", "F", "k|2"), ("w", "fact", "N", "n"), ("w", "fact", "S", "tie"), ("w", "fact", "S", "x|y"), ("w", "rule", "F", "r1"), ("w", "rule", "F", "r2")]
    assert rows(replay(log)) == want
    assert rows(replay(log.union(log))) == want
    assert rows(watermark(log)) == [("v", 0, 3, 1), ("w", 2, 5, 2)]
    assert rows(replay(log, gaps="hold")) == [("w", "fact", "F", "k|2"), ("w", "fact", "S", "x|y"), ("w", "rule", "S", "r1")]
    assert replay(log.limit(0)).count() == 0 and watermark(log.limit(0)).count() == 0
    with pytest.raises(ValueError):
        replay(log, gaps="guess")


def test_functional_retraction(spark, rows):
    a, r = "Assert", "Retract"
    log = spark.createDataFrame([
        (1, "w", 1, [made("F", True)], [("F", ["k", "1"], a)], T[1], ""), (2, "w", 2, [], [("F", ["k", "2"], a)], T[1], ""), (3, "w", 3, [], [("F", ["k", "2"], r)], T[1], "")], LOG)
    assert rows(replay(log)) == []  # the replaced tuple doesn't come back


LINK = "child long, parent long, `order` int, recorded_at timestamp, node string, depth long"


def links(spark, data):
    return spark.createDataFrame([(c, p, o, None, "x", 0) for c, p, o in data], LINK)


def walk(data):
    par = {}
    for c, p, o in data:
        key = (2**40 if o is None else o, p)
        if p is not None and (c not in par or key < par[c]):
            par[c] = key
    out = {}
    for n in {c for c, _, _ in data}:
        path = [n]
        while path[-1] in par and par[path[-1]][1] not in path:
            path.append(par[path[-1]][1])
        if path[-1] in par:
            ring = path[path.index(par[path[-1]][1]):]
            out[n] = (min(ring), -1, "")
        else:
            out[n] = (path[-1], len(path) - 1, "/".join(map(str, reversed(path))))
    return out


def test_hierarchy_random(spark):
    rng = random.Random(5)
    data = [(i, rng.randrange(max(1, i - 3), i), 0) for i in range(2, 40)] + [(i, None, 0) for i in (1, 50)]
    data += [(60, 61, 0), (61, 62, 0), (62, 60, 1), (63, 62, 0), (64, 63, 0), (70, 70, 0), (5, 90, None), (6, 2, 0), (6, 3, 0), (6, 3, 0)]
    h = build_hierarchy(links(spark, data), block=7).cache()
    got = {r.node: (r.root, r.depth, r.path) for r in h.where("is_child").collect()}
    assert got == walk(data)
    tree = {r.node: r for r in h.where("not ring").collect()}
    for a in tree.values():  # ranges hold exactly the descendants
        inside = {b.node for b in tree.values() if b.root == a.root and a.lft < b.lft <= a.rgt}
        assert inside == {n for n, r in tree.items() if n != a.node and f"/{a.node}/" in f"/{r.path}/"} and len(inside) == a.size - 1
    q = spark.createDataFrame([(10,), (39,), (60,)], "node long")
    up = {(r.node, r.ancestor) for r in ancestors_of(h, q).collect()}
    assert up == {(n, int(x)) for n in (10, 39) for x in tree[n].path.split("/")[:-1]}
    down = {r.node for r in descendants_of(h, spark.createDataFrame([(10,)], "node long")).collect()}
    assert down == {n for n, r in tree.items() if n != 10 and "/10/" in f"/{r.path}/"}


def test_all_descendants(spark, rows):
    rng = random.Random(7)
    data = [(i, rng.randrange(max(1, i - 4), i), 0) for i in range(2, 50)] + [(60, 61, 0), (61, 60, 0), (62, 60, 0), (70, 90, 0), (71, None, 0)]
    h = build_hierarchy(links(spark, data), block=3)
    pairs = [(int(a), r.root, r.node) for r in h.where("not ring").collect() for a in r.path.split("/")[:-1]]
    assert rows(all_descendants(h)) == sorted(pairs, key=repr) and pairs
    assert all_descendants(build_hierarchy(links(spark, []))).count() == 0


def test_hierarchy_deep_and_empty(spark):
    chain = [(i, i - 1, 0) for i in range(1, 300)]
    h = build_hierarchy(links(spark, chain), block=50)
    assert h.agg({"depth": "max"}).first()[0] == 299
    assert build_hierarchy(links(spark, [])).count() == 0
    assert build_hierarchy(links(spark, [(None, 1, 0)])).count() == 0


def test_rings_of_many_lengths(spark):
    data, at = [], 1
    for length in (1, 2, 3, 5, 8, 13):  # a ring with tails of its own length, side by side with a tree
        data += [(at + i, at + (i + 1) % length, 0) for i in range(length)] + [(at + 100 + i, at + i if i == 0 else at + 99 + i, 0) for i in range(length)]
        at += 1000
    data += [(9000 + i, 9000 + i // 2, 0) for i in range(1, 40)]
    got = {r.node: (r.root, r.depth, r.path) for r in build_hierarchy(links(spark, data)).where("is_child").collect()}
    assert got == walk(data)
