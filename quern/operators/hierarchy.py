"""Parent-child links to full hierarchies (problem 4).

Nested sets: subtree sizes are summed upward, preorder ranges handed downward by prefix
sums over siblings, and nodes that neither pass reaches lie on or under a ring. Both
passes double the distance they look at in each round, so a tree of depth d takes
log2(d) rounds and not d. Paths and depths are then read off the ranges in preorder.
"""

from __future__ import annotations

from collections.abc import Iterator
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import Scratch, maybe_broadcast


def choose_parents(links: DataFrame, child: str, parent: str, order: str) -> DataFrame:
    """(node, parent): one row per child with its non-null parent of lowest order, then
    the smallest; a null order comes last. Repeated rows don't matter; rows without child
    are left out."""
    e = links.select(F.col(child).cast("long").alias("node"), F.col(parent).cast("long").alias("parent"), F.col(order).cast("long").alias("__o")).where("node is not null")
    own = e.groupBy("node").agg(F.min(F.when(F.col("parent").isNotNull(), F.struct(F.coalesce("__o", F.lit(2**63 - 1)).alias("o"), "parent"))).alias("__p"))
    return own.select("node", F.col("__p.parent").alias("parent"))


def build_hierarchy(
    links: DataFrame, child: str = "child", parent: str = "parent", order: str = "order", scratch: Scratch | None = None, paths: bool = True, block: int = 100_000
) -> DataFrame:
    """(node, parent, is_child, root, depth, path, lft, rgt, size, ring).

    lft..rgt is the node's range in a preorder over all its root's tree: a is an ancestor
    of b iff they have the same root and a.lft < b.lft <= a.rgt; descendants likewise.
    A node on or under a ring has ring true, root = the smallest node of the ring it runs
    into, depth -1, an empty path and no range. Parents that are nobody's child are roots
    with is_child false. See choose_parents for nulls, ties and repeated rows; an empty
    table gives no rows; other columns aren't read. ``paths=False`` leaves depth and path out.

    A node is settled once its jump is a root. Only nodes not yet settled move in a round
    and are written again; settled ones stay in the table of the round that settled them
    and are looked up there. Every unsettled node hands what it has counted to its jump
    once a round; the hand-overs of all rounds are added up in one aggregate, and a root's
    size is the number of its nodes, so a hot root sums before its shuffle. Siblings follow
    one another by node: they are dealt out by ranges of (parent, node), with prefix sums
    over a parent's ranges, so a parent's children need not meet in one task.
    """
    spark = links.sparkSession
    s = scratch or Scratch(spark)
    base = s.keep(choose_parents(links, child, parent, order), "parents", local=False)
    linked = base.where("parent is not null")
    inner = linked.select(F.col("node").alias("__n"), F.lit(True).alias("__in"))

    # Upward: jump is the ancestor 2^k links up, n the descendants nearer than that and the
    # node, least the smallest node among the first 2^k of the way up.
    first = linked.join(inner, F.col("parent") == F.col("__n"), "left").select(
        "node", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("n"), F.col("node").alias("least"), F.col("__in").isNull().alias("settled"))
    settled = lambda tables: s.part(tables, "settled", "true").withColumn("settled", F.lit(True))
    unsettled = lambda tables: s.part(tables, "settled", "false").withColumn("settled", F.lit(False))
    ups, open_ = [s.keep(first, "up", local=False, by="settled")], -1
    while True:
        now = unsettled(ups[-1:])
        still = now.count()
        if still in (0, open_):  # each round settles some node of a tree that has any left
            break
        open_ = still
        gained = now.groupBy(F.col("jump").alias("__t")).agg(F.sum("n").alias("__g"))
        far = settled(ups).unionByName(now).select(F.col("node").alias("__n"), F.col("jump").alias("__j"), F.col("least").alias("__l"), F.col("settled").alias("__s"))
        step = now.join(far, F.col("jump") == F.col("__n")).join(gained, F.col("node") == F.col("__t"), "left").select(
            "node", F.col("__j").alias("jump"), (F.col("n") + F.coalesce("__g", F.lit(0))).alias("n"), F.least("least", "__l").alias("least"), F.col("__s").alias("settled"))
        ups.append(s.keep(step, "up", local=False, by="settled"))
    caught = now if still else None

    # What is settled is in a tree; sizes are the hand-overs of all rounds, roots' their nodes.
    rooted = settled(ups).select("node", F.col("jump").alias("root"))
    handed = unsettled(ups).select(F.col("jump").alias("node"), F.col("n").alias("size"))
    whole = rooted.select(F.col("root").alias("node"), F.lit(1).cast("long").alias("size"))
    sizes = handed.unionByName(whole).groupBy("node").agg((F.sum("size") + 1).alias("__size"))
    tree = linked.join(rooted, "node").join(sizes, "node", "left").select("node", "parent", "root", F.coalesce("__size", F.lit(1)).alias("size"))
    # Sibling ranges: a child starts one after its parent plus the sizes of earlier siblings.
    tree = s.keep(tree.repartitionByRange("parent", "node").withColumn("__b", F.spark_partition_id()), "tree", local=False)
    per = tree.groupBy("parent", "__b").agg(F.sum("size").alias("__s"))
    per = per.withColumn("__before", F.coalesce(F.sum("__s").over(Window.partitionBy("parent").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("parent", "__b").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = tree.withColumn("__in", inside).join(per, ["parent", "__b"])

    # Downward: lft is the sum of the offsets along the way to the root, doubled likewise.
    start = offset.select("node", F.col("parent").alias("jump"), (F.col("__before") + F.col("__in") + 1).alias("lft"), (F.col("parent") == F.col("root")).alias("settled"))
    downs = [s.keep(start, "down", local=False, by="settled")]
    for _ in range(len(ups) - (2 if caught is not None else 1)):
        now = unsettled(downs[-1:])
        far = settled(downs).unionByName(now).select(F.col("node").alias("__n"), F.col("jump").alias("__j"), F.col("lft").alias("__l"), F.col("settled").alias("__s"))
        step = now.join(far, F.col("jump") == F.col("__n")).select("node", F.col("__j").alias("jump"), (F.col("lft") + F.col("__l")).alias("lft"), F.col("__s").alias("settled"))
        downs.append(s.keep(step, "down", local=False, by="settled"))
    at = settled(downs).select("node", "lft")

    # Roots: children without parent, and parents that are nobody's child.
    tops = base.where("parent is null").select("node", F.lit(True).alias("is_child")).unionByName(
        linked.select(F.col("parent").alias("node")).distinct().join(base.select("node"), "node", "left_anti").withColumn("is_child", F.lit(False)))
    tops = tops.join(sizes, "node", "left").select("node", F.lit(None).cast("long").alias("parent"), "is_child", F.col("node").alias("root"), F.lit(0).cast("long").alias("lft"), F.coalesce("__size", F.lit(1)).alias("size"))
    ranged = tree.join(at, "node").select("node", "parent", F.lit(True).alias("is_child"), "root", "lft", "size").unionByName(tops)
    ranged = ranged.withColumn("rgt", F.col("lft") + F.col("size") - 1)
    out = read_paths(s.keep(ranged, "ranges", local=False), block) if paths else ranged
    out = out.withColumn("ring", F.lit(False))
    if caught is None:
        return out
    ringed = _rings(s, caught, unsettled(ups[:1])).select("node", "root")
    extra = {"depth": F.lit(-1).cast("long"), "path": F.lit("")} if paths else {}
    ringed = ringed.join(linked, "node").select(
        "node", "parent", F.lit(True).alias("is_child"), "root", *[c.alias(k) for k, c in extra.items()], *[F.lit(None).cast("long").alias(k) for k in ("lft", "rgt", "size")], F.lit(True).alias("ring"))
    return out.unionByName(ringed)


def _rings(s: Scratch, caught: DataFrame, first: DataFrame) -> DataFrame:
    """(node, root) of the nodes that run into a ring; the root is its smallest node.

    The doubling goes on from where the upward pass left it. Where a jump sends the set of
    its targets onto itself, that set is the rings; once all of a ring's nodes have seen the
    same smallest node, they have seen it whole."""
    held = first.join(caught.select("node"), "node", "left_semi").select("node", F.col("jump").alias("parent"))
    cur = s.keep(caught.select("node", "jump", "least").join(held, "node"), "ring")
    while True:
        # The targets of this jump, and of it taken twice.
        look = cur.select(F.col("node").alias("__n"), F.col("jump").alias("__j"), F.col("least").alias("__l"), F.col("parent").alias("__p"))
        nxt = s.keep(cur.join(look, F.col("jump") == F.col("__n")).select("node", "parent", "jump", "least", F.col("__j").alias("jump2"), F.col("__l").alias("least2")), "ring")
        once, twice = nxt.agg(F.countDistinct("jump"), F.countDistinct("jump2")).first()
        if once == twice:
            on = nxt.select(F.col("jump").alias("node")).distinct()
            ring = nxt.join(on, "node", "left_semi").select("node", "parent", "least")
            seen = ring.join(ring.select(F.col("node").alias("__n"), F.col("least").alias("__l")), F.col("parent") == F.col("__n"))
            if seen.where("least <> __l").isEmpty():
                return nxt.select("node", "jump").join(ring.select(F.col("node").alias("__n"), F.col("least").alias("root")), F.col("jump") == F.col("__n"))
        cur = s.keep(nxt.select("node", "parent", F.col("jump2").alias("jump"), F.least("least", "least2").alias("least")), "ring")


def read_paths(ranges: DataFrame, block: int = 100_000) -> DataFrame:
    """Adds depth and path to nodes with their nested-set ranges.

    In preorder the ancestors of a node are the ranges still open at its place, so one pass
    with a stack reads them off. A root's preorder is cut into blocks of ``block`` places;
    ranges open at a block's start are handed to it, as many as the start is deep, so a
    large tree spreads over many tasks and each holds a stack and a batch."""
    own = F.expr(f"lft div {block}")
    spans = F.when(F.expr(f"rgt div {block}") > own, F.sequence(own + 1, F.expr(f"rgt div {block}")))
    cols = ["node", "parent", "is_child", "root", "lft", "rgt", "size"]
    rows = ranges.select(*cols, own.alias("__block"), F.lit(True).alias("__own")).unionByName(ranges.select(*cols, F.explode(spans).alias("__block"), F.lit(False).alias("__own")))
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ready = rows.repartition(tasks, "root", "__block").sortWithinPartitions("root", "__block", "lft")
    kinds = dict(ranges.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in cols) + ", depth long, path string"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, stack = None, []  # (rgt, path)
        for b in batches:
            col = {c: b.column(c).to_pylist() for c in ("node", "root", "__block", "rgt", "lft", "__own")}
            kept, depths, names = [], [], []
            for i, node in enumerate(col["node"]):
                place = (col["root"][i], col["__block"][i])
                if place != here:
                    here = place
                    stack.clear()
                at = col["lft"][i]
                while stack and stack[-1][0] < at:
                    stack.pop()
                path = f"{stack[-1][1]}/{node}" if stack else str(node)
                if col["__own"][i]:
                    kept.append(i)
                    depths.append(len(stack))
                    names.append(path)
                if col["rgt"][i] > at:
                    stack.append((col["rgt"][i], path))
            held = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[held.column(c) for c in cols], pa.array(depths, pa.int64()), pa.array(names, pa.string())], names=[*cols, "depth", "path"])

    return ready.mapInArrow(walk, schema)


def ancestors_of(hierarchy: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """(node, ancestor) for the stated nodes: the ranges that hold their places, within
    their roots. A range join with the asked side the small one."""
    asked = hierarchy.join(nodes.select(F.col(node).alias("__q")).distinct(), F.col("node") == F.col("__q"), "left_semi").where("not ring")
    b = asked.select("node", F.col("root").alias("__r"), F.col("lft").alias("__at"))
    a = hierarchy.where("not ring and size > 1").select(F.col("node").alias("ancestor"), "root", "lft", "rgt")
    return a.join(maybe_broadcast(b), (F.col("root") == F.col("__r")) & (F.col("lft") < F.col("__at")) & (F.col("__at") <= F.col("rgt"))).select("node", "ancestor")


def descendants_of(hierarchy: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """(ancestor, node) of the stated nodes' whole subtrees, read off the nested-set ranges:
    a range join within a root, with the asked side the small one."""
    asked = hierarchy.join(nodes.select(F.col(node).alias("__q")).distinct(), F.col("node") == F.col("__q"), "left_semi").where("not ring")
    a = asked.select(F.col("node").alias("ancestor"), F.col("root").alias("__r"), F.col("lft").alias("__l"), F.col("rgt").alias("__u"))
    b = hierarchy.where("not ring").select("node", "root", "lft")
    return b.join(maybe_broadcast(a), (F.col("root") == F.col("__r")) & (F.col("lft") > F.col("__l")) & (F.col("lft") <= F.col("__u"))).select("ancestor", "node")


def all_descendants(hierarchy: DataFrame) -> DataFrame:
    """(node, root, descendant): every node of a tree with each node below it; nodes on or
    under a ring have none.

    A range is spelt out as its positions and each position is looked up within the root,
    so the work is that of the pairs there are, and a large root's nodes aren't compared
    with one another.
    """
    trees = hierarchy.where("not ring")
    spots = trees.where("size > 1").select("node", "root", F.explode(F.sequence(F.col("lft") + 1, "rgt")).alias("__at"))
    held = trees.select("root", F.col("lft").alias("__at"), F.col("node").alias("descendant"))
    return spots.join(held, ["root", "__at"]).select("node", "root", "descendant")
