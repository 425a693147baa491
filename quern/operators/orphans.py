"""References to records that do not exist (problem 1).

A split-block Bloom filter over the parents' keys, held as a table of 512-bit blocks and
broadcast in slices of a set size, proves most orphans; only references that pass it are
checked exactly against the parents' lives, and the orphans are then aggregated per table
and period.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import Scratch

LANES = 8
FILTER_BYTES_PER_BLOCK = 136  # of a hashed row: key, eight words and the map's overhead
BUCKETS = 65_536


def _key(cols: list[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def _masks(h: Column) -> list[Column]:
    """One bit in each of eight 64-bit words, from a second hash of the key's hash."""
    g = F.xxhash64(h, F.lit(97))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftright(g, 7 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(LANES)]


def bloom_blocks(keys: DataFrame, h: str, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter as rows; the masks are OR-ed before the shuffle."""
    aggs = [F.bit_or(m).alias(f"w{i}") for i, m in enumerate(_masks(F.col(h)))]
    return keys.groupBy(F.pmod(F.col(h), F.lit(blocks)).alias("block")).agg(*aggs)


def bloom_flag(df: DataFrame, h: str, filter_: DataFrame, blocks: int, out: str) -> DataFrame:
    """Adds ``out``: false proves that the key was never inserted. ``filter_`` is broadcast."""
    f = filter_.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(LANES)])
    hit = F.lit(True)
    for i, m in enumerate(_masks(F.col(h))):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(m) == m)
    joined = df.withColumn("__block", F.pmod(F.col(h), F.lit(blocks))).join(F.broadcast(f), "__block", "left")
    return joined.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__block", *[f"__w{i}" for i in range(LANES)])


def bloom_passes(df: DataFrame, h: str, keys: DataFrame, n: int, out: str, bits_per_key: int, limit_mb: int, scratch: Scratch) -> DataFrame:
    """bloom_flag whatever the number ``n`` of keys. A filter larger than ``limit_mb`` is
    cut into slices by ranges of blocks; each pass broadcasts one slice and asks it about
    the rows whose block lies there, and is over before the next slice is broadcast."""
    blocks = max(1, math.ceil(n * bits_per_key / (64 * LANES)))
    per = max(1, (limit_mb << 20) // FILTER_BYTES_PER_BLOCK)
    filter_ = bloom_blocks(keys, h, blocks)
    if blocks <= per:
        return bloom_flag(df, h, filter_, blocks, out)
    filter_, at = scratch.keep(filter_, "filter", local=False), F.pmod(F.col(h), F.lit(blocks))
    parts = []
    for low in range(0, blocks, per):
        mine = df.where((at >= low) & (at < low + per))
        parts.append(scratch.keep(bloom_flag(mine, h, filter_.where((F.col("block") >= low) & (F.col("block") < low + per)), blocks, out), "pass", local=False))
    return reduce(DataFrame.unionByName, parts)


def hot_buckets(keys: DataFrame, h: str, share: int, least: int) -> list[tuple[int, int]]:
    """(bucket, salts) of the hash buckets that hold more than 1/``share`` of the rows and
    more than ``least``: those of any key that frequent are among them. One count over
    BUCKETS groups, which combines before its shuffle and is as many rows at any size."""
    counted = keys.groupBy(F.pmod(F.col(h), F.lit(BUCKETS)).cast("int").alias("b")).count().toArrow()
    rows = list(zip(counted.column("b").to_pylist(), counted.column("count").to_pylist()))
    load = max(least, sum(n for _, n in rows) // share, 1)
    return [(b, -(-n // load)) for b, n in rows if n > load]


def find_orphans(
    refs: DataFrame,
    lives: DataFrame,
    *,
    key: list[str],
    at: str = "at",
    born: str = "born",
    died: str = "died",
    carry: list[str],
    bits_per_key: int = 16,
    filter_limit_mb: int = 64,
    hot_share: int = 512,
    hot_least: int = 10_000,
    scratch: Scratch | None = None,
) -> DataFrame:
    """References whose key has no living parent at the reference's time.

    ``refs`` holds ``key``, ``at`` and ``carry``; ``lives`` holds ``key``, ``born`` and
    ``died``, one row per life. A parent lives at t if born <= t and died is null or > t.
    Returns ``key``, ``at``, ``carry`` and ``reason``: 'missing' (no parent of that key at
    all), 'deleted' (one was born by then) or 'late' (all were born later or never).

    Nulls: a reference without ``at`` or with a null or empty last key column is left out;
    a null in another key column equals nothing, so the reference is 'missing'; a parent
    with a null key matches nothing, one with null ``born`` exists but never lives. Empty
    tables give no rows (no parents: everything is 'missing'). Repeated references come
    out as often as they came in; repeated lives change nothing. Only the named columns
    are read, so extra columns may have any name.

    Every reference asks the filter, however many parents there are: beyond
    ``filter_limit_mb`` it is broadcast in slices (bloom_passes). Skew: keys are hashed to
    BUCKETS buckets; one that holds more than 1/``hot_share`` of the references (and than
    ``hot_least``), so at most ``hot_share`` of them, spreads over as many tasks as it holds
    such shares, with its parents' lives repeated there.
    """
    k = [f"__k{i}" for i in range(len(key))]
    name = F.col(key[-1])
    r = refs.where(F.col(at).isNotNull() & name.isNotNull() & (name != F.lit("")))
    r = r.select(*[F.col(c).alias(a) for c, a in zip(key, k)], F.col(at).alias("__at"), F.struct(*carry).alias("__carry"))
    r = r.withColumn("__h", _key(k))
    p = lives.select(*[F.col(c).alias(a) for c, a in zip(key, k)], F.col(born).alias("__born"), F.col(died).alias("__died"))
    for c in k:
        p = p.where(F.col(c).isNotNull())
    p = p.withColumn("__h", _key(k))

    spark = refs.sparkSession
    flagged = bloom_passes(r, "__h", p, lives.count(), "__maybe", bits_per_key, filter_limit_mb, scratch or Scratch(spark))
    proven = flagged.where(~F.col("__maybe")).drop("__maybe").withColumn("reason", F.lit("missing"))
    maybe = flagged.where("__maybe").drop("__maybe")

    hot = hot_buckets(r, "__h", hot_share, hot_least)
    # At most hot_share entries: a map in the plan, no join.
    salts = F.lit(1)
    if hot:
        book = F.create_map(*[F.lit(x) for pair in hot for x in pair])
        salts = F.coalesce(F.try_element_at(book, F.pmod(F.col("__h"), F.lit(BUCKETS)).cast("int")), F.lit(1))
    salted = maybe.withColumn("__salt", F.pmod(F.xxhash64("__carry", "__at"), salts))
    asked = salted.select(*k, "__salt", F.col("__at").alias("__t"), F.lit(1).alias("__ask"), F.lit(0).alias("__alive"), F.lit(0).alias("__births"), F.lit(0).alias("__rows"), "__carry")

    lived = (F.col("__born").isNotNull()) & (F.col("__died").isNull() | (F.col("__died") > F.col("__born")))
    events = F.array(
        F.struct(F.col("__born").alias("t"), F.when(lived, 1).otherwise(0).alias("alive"), F.when(F.col("__born").isNotNull(), 1).otherwise(0).alias("births"), F.lit(1).alias("rows")),
        F.struct(F.col("__died").alias("t"), F.when(lived & F.col("__died").isNotNull(), -1).otherwise(0).alias("alive"), F.lit(0).alias("births"), F.lit(0).alias("rows")),
    )
    told = (
        p.withColumn("__e", F.explode(events)).where((F.col("__e.rows") == 1) | (F.col("__e.alive") != 0))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)))
        .select(*k, "__salt", F.col("__e.t").alias("__t"), F.lit(0).alias("__ask"), F.col("__e.alive").alias("__alive"), F.col("__e.births").alias("__births"), F.col("__e.rows").alias("__rows"),
                F.lit(None).cast(maybe.schema["__carry"].dataType).alias("__carry"))
    )
    # Births and deaths sort before the references of the same instant.
    within = Window.partitionBy(*k, "__salt").orderBy("__t", "__ask")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = asked.unionByName(told).select(
        "*", F.sum("__alive").over(upto).alias("__a"), F.sum("__births").over(upto).alias("__b"), F.max("__rows").over(whole).alias("__known"))
    checked = run.where((F.col("__ask") == 1) & (F.col("__a") <= 0)).withColumn(
        "reason", F.when(F.col("__b") > 0, "deleted").when(F.col("__known") > 0, "late").otherwise("missing"))
    cols = [*[F.col(a).alias(c) for c, a in zip(key, k)], F.col("__at").alias(at), F.col("__carry"), F.col("reason")]
    out = proven.select(*cols).unionByName(checked.withColumnRenamed("__t", "__at").select(*cols))
    return out.select(*key, at, F.col("__carry.*"), "reason")


def reference_orphans(references: DataFrame, symbols: DataFrame, files: DataFrame, **options) -> DataFrame:
    """(ref_id, target, reason, period) of every dangling symbol or path, each once."""
    refs = references.where(F.col("indexed_at").isNotNull()).select(
        "ref_id", "repository", F.col("indexed_at").alias("at"),
        F.explode(F.array(
            F.struct(F.lit("symbol").alias("target"), F.col("symbol").alias("name")),
            F.struct(F.lit("path").alias("target"), F.col("path").alias("name")),
        )).alias("named"),
    ).select("ref_id", F.col("named.target").alias("target"), "repository", F.col("named.name").alias("name"), "at")
    life = lambda df, target, name: df.select(F.lit(target).alias("target"), "repository", F.col(name).alias("name"), F.col("indexed_at").alias("born"), F.col("deleted_at").alias("died"))
    lives = life(symbols, "symbol", "symbol").unionByName(life(files, "path", "path"))
    found = find_orphans(refs, lives, key=["target", "repository", "name"], carry=["ref_id"], **options)
    return found.select("ref_id", "target", "reason", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """References per target table, period and reason."""
    return found.groupBy("target", "period", "reason").agg(F.count("*").alias("orphans"), F.countDistinct("ref_id").alias("refs"))
