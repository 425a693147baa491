"""Multimethod dispatch as queries: applicability, specificity, ambiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch
from .closure import closure

#: Values are struct<kind, value, delegate>: ``value`` the text of the value or identity,
#: ``delegate`` that of a frob. Restrictions are struct<kind, value>: kind 'any', 'frob'
#: (only frobs of the delegate in value), or the kind of an exact value or prototype.


def _closed(delegates: DataFrame, scratch: Scratch | None) -> DataFrame:
    """(child, proto): reflexive reachability over delegation."""
    star = closure(delegates.select("child", "proto"), "child", "proto", scratch)
    nodes = delegates.select(F.col("child").alias("n")).union(delegates.select("proto")).distinct()
    return star.union(nodes.select(F.col("n").alias("child"), F.col("n").alias("proto"))).distinct()


def matches(args: DataFrame, params: DataFrame, delegates: DataFrame, prototypes: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(call, method, slot) for each argument that meets a parameter's restriction.

    ``args``: call, slot, kind, value, delegate. ``params``: method, slot, rkind, rvalue.
    ``prototypes``: kind, proto, the identity that stands for each primitive kind. What an
    argument can stand for is listed first (itself, its delegation, its kind's prototype),
    so that matching is one equi-join.
    """
    star = _closed(delegates, scratch)
    itself = args.select("call", "slot", F.col("kind").alias("__k"), F.col("value").alias("__v"))
    start = (
        args.where("kind = 'identity'").select("call", "slot", F.col("value").alias("child"))
        .union(args.where("kind = 'frob'").select("call", "slot", F.col("delegate").alias("child")))
        .union(args.join(prototypes, "kind").select("call", "slot", F.col("proto").alias("child")))
    )
    up = start.join(star, "child").select("call", "slot", F.lit("identity").alias("__k"), F.col("proto").alias("__v"))
    alone = start.select("call", "slot", F.lit("identity").alias("__k"), F.col("child").alias("__v"))
    frobs = args.where("kind = 'frob'").select("call", "slot", F.col("delegate").alias("child"))
    frob_only = frobs.join(star, "child").select("call", "slot", F.lit("frob").alias("__k"), F.col("proto").alias("__v")).union(frobs.select("call", "slot", F.lit("frob").alias("__k"), F.col("child").alias("__v")))
    anything = args.select("call", "slot", F.lit("any").alias("__k"), F.lit("").alias("__v"))
    faces = itself.where("__k <> 'frob'").union(up).union(alone).union(frob_only).union(anything).distinct()
    p = params.select("method", "slot", F.col("rkind").alias("__k"), F.when(F.col("rkind") == "any", "").otherwise(F.col("rvalue")).alias("__v"))
    return faces.join(p, ["slot", "__k", "__v"]).select("call", "method", "slot").distinct()


def applicable(calls: DataFrame, args: DataFrame, selectors: DataFrame, params: DataFrame, delegates: DataFrame, prototypes: DataFrame, positional: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(call, method) before pruning. ``calls``: call, selector. Every parameter must match;
    named calls may have further roles, positional ones have exactly as many arguments."""
    met = matches(args, params, delegates, prototypes, scratch).groupBy("call", "method").agg(F.count("*").alias("__met"))
    need = selectors.select("method", "selector").distinct().join(params.groupBy("method").agg(F.count("*").alias("__need")), "method", "left").na.fill({"__need": 0})
    given = args.groupBy("call").agg(F.count("*").alias("__given"))
    c = calls.select("call", "selector").join(need, "selector").join(given, "call", "left").na.fill({"__given": 0})
    out = c.join(met, ["call", "method"], "left").na.fill({"__met": 0}).where("__met = __need")
    return (out.where("__given = __need") if positional else out).select("call", "method").distinct()


def implications(params: DataFrame, delegates: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(slot, k1, v1, k2, v2): restriction 1 implies restriction 2, over those in use."""
    r = params.select("slot", F.col("rkind").alias("k"), F.when(F.col("rkind") == "any", "").otherwise(F.col("rvalue")).alias("v")).distinct()
    star = _closed(delegates, scratch)
    a, b = r.toDF("slot", "k1", "v1"), r.toDF("slot", "k2", "v2")
    same = r.select("slot", F.col("k").alias("k1"), F.col("v").alias("v1"), F.col("k").alias("k2"), F.col("v").alias("v2"))
    general = a.join(b.where("k2 = 'any'"), "slot")
    down = a.where("k1 in ('identity', 'frob')").join(star.select(F.col("child").alias("v1"), F.col("proto").alias("v2")), "v1").join(b, ["slot", "v2"]).where("k1 = k2 or (k1 = 'frob' and k2 = 'identity')")
    cols = ["slot", "k1", "v1", "k2", "v2"]
    return same.select(*cols).union(general.select(*cols)).union(down.select(*cols)).distinct()


def most_specific(found: DataFrame, params: DataFrame, delegates: DataFrame, positional: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(call, method) without methods that another applicable one is at least as specific
    as everywhere and stricter somewhere (having more parameters counts for named calls)."""
    p = params.select("method", "slot", F.col("rkind").alias("k"), F.when(F.col("rkind") == "any", "").otherwise(F.col("rvalue")).alias("v"))
    n = p.groupBy("method").agg(F.count("*").alias("n"))
    imp = implications(params, delegates, scratch)
    left, right = p.toDF("left", "slot", "k1", "v1"), p.toDF("right", "slot", "k2", "v2")
    # Which pairs of methods compare is settled once per pair, not per call, and a pair meets
    # only through a restriction of one that implies one of the other.
    back = imp.select("slot", F.col("k1").alias("k2"), F.col("v1").alias("v2"), F.col("k2").alias("k1"), F.col("v2").alias("v1"), F.lit(1).alias("__ge"))
    known = imp.join(back, ["slot", "k1", "v1", "k2", "v2"], "left")
    pairs = left.join(known, ["slot", "k1", "v1"]).join(right, ["slot", "k2", "v2"]).where("left <> right")
    pairs = pairs.groupBy("left", "right").agg(F.count("*").alias("le"), F.count(F.when(F.col("__ge").isNull(), 1)).alias("strict"))
    sizes = pairs.join(n.toDF("left", "nl"), "left").join(n.toDF("right", "nr"), "right")
    better = sizes.where("le = nr and nl = nr and strict > 0") if positional else sizes.where("le = nr and (strict > 0 or nl > nr)")
    better = better.select("left", "right")
    beaten = found.select("call", F.col("method").alias("left")).join(better, "left").select("call", F.col("right").alias("method"))
    if not positional:  # a method without parameters yields to any applicable one that has some
        has = params.select("method").distinct()
        rich = found.join(has, "method", "left_semi").select("call").distinct()
        beaten = beaten.union(found.join(has, "method", "left_anti").join(rich, "call", "left_semi").select("call", "method"))
    return found.join(beaten.distinct(), ["call", "method"], "left_anti")


def ambiguous(found: DataFrame) -> DataFrame:
    """(call, methods): calls for which more than one method is left."""
    return found.groupBy("call").agg(F.count("*").alias("methods")).where("methods > 1")
