"""Applying a stream of inserts, updates and deletes (problem 2).

Commits arrive repeatedly and in any order. A version is one transaction; of its
deliveries one counts. Facts of different keys don't conflict, so each key is replayed
on its own, in commit order, by aggregates that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import Scratch


def assemble(deliveries: DataFrame) -> DataFrame:
    """One complete transaction per (world, version): the delivery received last, then of
    the highest delivery_id. Deliveries without version or world are left out; a null
    received_at counts as the earliest; null change lists as empty ones."""
    last = Window.partitionBy("world", "version").orderBy(F.col("received_at").desc_nulls_last(), F.col("delivery_id").desc_nulls_last())
    return (
        deliveries.where(F.col("version").isNotNull() & F.col("world").isNotNull())
        .select("world", "version", "catalog_changes", "changes", "received_at", "delivery_id")
        .withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    )


def watermark(deliveries: DataFrame, first: int = 1) -> DataFrame:
    """(world, watermark, last_version, held): versions first..watermark have all come;
    ``held`` are those received beyond the first gap. watermark is first-1 where the first
    version is missing.

    The gap is found without sorting a world in one task where it is hot: version minus
    its rank is constant along a gapless run, and ranks come from per-bucket counts
    (a bucket is 1,024 consecutive versions) whose prefix sums are over few rows."""
    v = deliveries.where(F.col("version").isNotNull() & F.col("world").isNotNull() & (F.col("version") >= first)).select("world", "version").distinct()
    v = v.withColumn("__bucket", F.expr(f"(version - {first}) div 1024"))
    full = v.groupBy("world", "__bucket").agg(F.count("*").alias("__n"))
    prefix = full.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("world").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = v.withColumn("__in", F.row_number().over(Window.partitionBy("world", "__bucket").orderBy("version"))).join(prefix, ["world", "__bucket"])
    rank = F.col("__before") + F.col("__in")
    return ranked.groupBy("world").agg(
        F.coalesce(F.max(F.when(F.col("version") - first + 1 == rank, F.col("version"))), F.lit(first - 1)).alias("watermark"),
        F.max("version").alias("last_version"),
        F.count(F.when(F.col("version") - first + 1 != rank, 1)).alias("held"),
    )


POSITIONS = 21  # bits of a change's place in its commit


def replay(deliveries: DataFrame, gaps: str = "skip", salts: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """(world, entry, name, item): the facts and active rules after the last version.

    State is exposed through each world's committed watermark alone. ``gaps='hold'``:
    that of watermark(); versions beyond a world's first gap are held back.
    ``gaps='skip'``: the log is taken as complete, so a missing version is an empty
    transaction and the watermark runs to the last version received.

    Within a version catalog changes come first, then retractions, then assertions (in
    list order). A fact change counts if its relation was created in that world by then;
    since that is a lower bound on the version, it is checked once per key after the
    replay. In a functional relation the last assertion for a first value wins and
    stands unless that very tuple is retracted in a later version. Rules follow their
    RuleInstalled and RuleDisabled alone.

    Nulls: a change without relation or kind, or a rule change without rule_id, has no
    effect; a null value in a tuple reads as ''; a null tuple as the empty one. Repeated
    deliveries don't matter; an empty table gives no rows; other columns aren't read.
    A change's place in the log is one number, version times 2^21 plus its place in the
    commit, so keys are replayed by hash aggregates; versions beyond 2^41 are an error.
    Hot worlds spread over the tuples' hashes; the joins with watermarks and created
    relations, a row each, are salted ``salts``-fold.
    """
    if gaps not in ("skip", "hold"):
        raise ValueError(f"gaps must be 'skip' or 'hold', not {gaps!r}")
    s = scratch or Scratch(deliveries.sparkSession)
    fan = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt")
    known = deliveries.where(F.col("version").isNotNull() & F.col("world").isNotNull())
    upto = watermark(deliveries).select("world", "watermark") if gaps == "hold" else known.groupBy("world").agg(F.max("version").alias("watermark"))
    marks = upto.select(F.col("world").alias("__w"), "watermark", fan)
    tx = assemble(deliveries).withColumn("__s", F.pmod(F.col("version"), F.lit(salts)).cast("int"))
    tx = tx.join(marks, (F.col("world") == F.col("__w")) & (F.col("__s") == F.col("__salt")) & (F.col("version") <= F.col("watermark")))

    # One pass over the transactions: every change becomes a step of one key, a created
    # relation, a rule with the relation it is installed for, or a tuple of a relation.
    low = -(1 << (62 - POSITIONS))
    place = lambda i: F.when(F.col("version").between(low, -low), F.shiftleft(F.col("version"), POSITIONS) + i).otherwise(F.raise_error(F.lit("version out of range")).cast("long"))
    is_rule = lambda c: c["change"].isin("RuleInstalled", "RuleDisabled")
    catalog = F.transform(F.col("catalog_changes"), lambda c, i: F.struct(
        c["change"].alias("op"), F.when(is_rule(c), c["rule_id"]).otherwise(c["relation"]).alias("name"),
        F.when(is_rule(c), F.array(c["relation"])).alias("tuple"), c["functional"].alias("functional"), i.alias("pos")))
    facts = F.transform(F.col("changes"), lambda c, i: F.struct(
        c["kind"].alias("op"), c["relation"].alias("name"), F.transform(F.coalesce(c["tuple"], F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit(""))).alias("tuple"),
        F.lit(None).cast("boolean").alias("functional"), i.alias("pos")))
    none = F.array().cast("array<struct<op:string,name:string,tuple:array<string>,functional:boolean,pos:int>>")
    step = tx.select("world", "version", F.explode(F.concat(F.coalesce(catalog, none), F.coalesce(facts, none))).alias("s")).select("world", "s.*", place(F.col("s.pos")).alias("at"))
    what = F.when(F.col("op") == "RelationCreated", "relation").when(F.col("op").isin("RuleInstalled", "RuleDisabled"), "rule").when(F.col("op").isin("Assert", "Retract"), "fact")
    step = step.withColumn("what", what).where(F.col("what").isNotNull() & F.col("name").isNotNull())
    when = lambda *ops: F.when(F.col("op").isin(*ops), F.col("at"))
    state = s.keep(step.groupBy("world", "what", "name", "tuple").agg(
        F.max(when("Assert", "RuleInstalled")).alias("up"), F.max(when("Retract", "RuleDisabled")).alias("down"), F.min(when("RelationCreated")).alias("made"),
        F.coalesce(F.min_by("functional", when("RelationCreated")), F.lit(False)).alias("functional")), "state", local=False)

    rule = state.where("what = 'rule'").groupBy("world", "name").agg(F.max("down").alias("down"), F.max(F.struct("up", "tuple")).alias("last"))
    rules = rule.where(F.col("last.up").isNotNull() & (F.col("down").isNull() | (F.col("last.up") > F.col("down")))).select(
        "world", F.lit("rule").alias("entry"), F.col("last.tuple")[0].alias("name"), F.col("name").alias("item"))

    version = lambda c: F.shiftright(c, POSITIONS)
    created = state.where("what = 'relation'").select(F.col("world").alias("__w"), F.col("name").alias("__r"), version("made").alias("__from"), F.col("functional").alias("__functional"), fan)
    held = state.where("what = 'fact' and up is not null").select("world", "name", "tuple", "up", "down").withColumn("__s", F.pmod(F.xxhash64("tuple"), F.lit(salts)).cast("int")).join(
        created, (F.col("world") == F.col("__w")) & (F.col("name") == F.col("__r")) & (F.col("__s") == F.col("__salt")) & (version("up") >= F.col("__from")))
    alive = F.col("down").isNull() | (version("down") <= version("up"))
    # In a set relation a tuple stands for itself; in a functional one the last of its first value.
    sets = held.where(~F.col("__functional") & alive).select("world", "name", "tuple")
    best = held.where("__functional").groupBy("world", "name", F.slice("tuple", 1, 1).alias("slot")).agg(F.max(F.struct("up", "tuple", alive.alias("alive"))).alias("last"))
    now = sets.unionByName(best.where("last.alive").select("world", "name", F.col("last.tuple").alias("tuple")))
    return now.select("world", F.lit("fact").alias("entry"), "name", F.array_join("tuple", "|").alias("item")).unionByName(rules)
