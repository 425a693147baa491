"""Closures of edge relations and the neighbourhood of a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch, maybe_broadcast, rows_of


def closure(edges: DataFrame, src: str, dst: str, scratch: Scratch | None = None, stats: list | None = None) -> DataFrame:
    """(src, dst) pairs joined by a path of one or more edges; reflexive only round a ring.

    Paths double: each round puts all pairs known behind the pairs found last, which a
    shortest path longer than those known begins with, so a path of length n takes log2(n)
    rounds, and cyclic graphs end since pairs are finite. A round's pairs are written once;
    known ones fall to an anti-join. Null ends are left out.
    """
    spark = edges.sparkSession
    s = scratch or Scratch(spark)
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null").distinct()
    delta = s.keep(e, "closure")
    parts = [delta]
    while True:
        known = reduce(DataFrame.union, parts)
        longer = delta.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        delta = s.keep(longer.join(known, ["a", "b"], "left_anti"), "closure")
        n = rows_of(delta)
        if stats is not None:
            stats.append(n)
        if not n:
            return known.select(F.col("a").alias(src), F.col("b").alias(dst))
        parts.append(delta)


def reachable_from(edges: DataFrame, src: str, dst: str, starts: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(start, dst): what each start reaches. ``starts`` has one column. The recursion is
    seeded with the starts alone, so nothing else is explored (demand, not filter after)."""
    s = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.col(src).alias("m"), F.col(dst).alias("b")).where("m is not null and b is not null").distinct()
    begin = starts.toDF("a").where("a is not null").distinct()
    delta = s.keep(begin.join(e, F.col("a") == F.col("m")).select("a", "b").distinct(), "reach")
    parts = [delta]
    while True:
        known = parts[0]
        for p in parts[1:]:
            known = known.union(p)
        step = maybe_broadcast(delta.select("a", F.col("b").alias("m"))).join(e, "m").select("a", "b").distinct()
        delta = s.keep(step.join(known, ["a", "b"], "left_anti"), "reach")
        if not rows_of(delta):
            return known.toDF("start", dst)
        parts.append(delta)
        if len(parts) >= 16:
            parts = [s.keep(known.union(delta), "reach")]


def reaches(edges: DataFrame, src: str, dst: str, start, goal, scratch: Scratch | None = None) -> bool:
    """Whether ``start`` reaches ``goal``; stops in the round that finds it."""
    s = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.col(src).alias("m"), F.col(dst).alias("b")).distinct()
    front = s.keep(e.where(F.col("m") == F.lit(start)).select(F.col("b").alias("m")).distinct(), "front")
    seen = front
    while rows_of(front):
        if not front.where(F.col("m") == F.lit(goal)).isEmpty():
            return True
        front = s.keep(maybe_broadcast(front).join(e, "m").select(F.col("b").alias("m")).distinct().join(seen, "m", "left_anti"), "front")
        seen = seen.union(front)
    return False


def materialize_closure(transaction, relation: str, edges: DataFrame, src: str, dst: str) -> None:
    """Makes a stored relation hold exactly the closure, by the fewest changes."""
    transaction.reconcile(relation, closure(edges, src, dst))


def subject_facts(tables: dict[str, DataFrame], subject) -> DataFrame:
    """(subject, relation, fact): rows with the value in position 0, cells as strings."""
    return _facts(tables, subject, lambda i: i == 0).select("value", "relation", "fact").withColumnRenamed("value", "subject").distinct()


def mentioned_facts(tables: dict[str, DataFrame], value) -> DataFrame:
    """(value, relation, position, fact): rows with the value in any position."""
    return _facts(tables, value, lambda i: True)


def _facts(tables: dict[str, DataFrame], value, wanted) -> DataFrame:
    parts = []
    for name, df in sorted(tables.items()):
        cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nothing")) for c in df.columns])
        for i, c in enumerate(df.columns):
            if wanted(i) and _comparable(dict(df.dtypes)[c], value):
                parts.append(df.where(F.col(f"`{c}`") == F.lit(value)).select(F.lit(str(value)).alias("value"), F.lit(name).alias("relation"), F.lit(i).alias("position"), cells.alias("fact")))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "value string, relation string, position int, fact array<string>")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def _comparable(kind: str, value) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if isinstance(value, int):
        return kind in ("bigint", "int", "smallint", "tinyint")
    if isinstance(value, float):
        return kind in ("double", "float")
    return kind == "string"
