"""Percentiles of very large numeric columns (problem 6).

Exact ranks by distributed multi-select, and per-day histograms of bounded relative error
that can be added up over any days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import Scratch, maybe_broadcast, rows_of

STUCK = 2**63 - 1
#: The percentiles reported, in thousandths.
PERMILLES = (500, 900, 990, 999)
NAMES = {500: "p50", 900: "p90", 990: "p99", 999: "p999"}


def clean_samples(table: DataFrame, metric: str, label: str, duration: str) -> DataFrame:
    """(metric, label, day, value) of the samples that count, each once.

    Null, negative and stuck (largest int64) durations don't count. A second copy repeats
    sample_id and label; of copies that differ the smallest duration and earliest day
    stand. Without sample_id every row is a sample of its own. A null label is a label; a
    null recorded_at gives a null day.
    """
    x = table.where(F.col(duration).isNotNull() & (F.col(duration) >= 0) & (F.col(duration) < F.lit(STUCK))).select(
        "sample_id", F.col(label).alias("label"), F.datediff(F.to_date("recorded_at"), F.lit("1970-01-01")).alias("day"), F.col(duration).cast("long").alias("value"))
    once = x.where("sample_id is not null").groupBy("sample_id", "label").agg(F.min("day").alias("day"), F.min("value").alias("value"))
    return once.select("label", "day", "value").unionByName(x.where("sample_id is null").select("label", "day", "value")).select(F.lit(metric).alias("metric"), "label", "day", "value")


def multi_select(
    values: DataFrame, *, group: str = "g", value: str = "v", permilles: tuple[int, ...] = PERMILLES, finish: int = 1024, scratch: Scratch | None = None
) -> DataFrame:
    """(g, permille, n, v): per group the value of rank ceil(n * permille / 1000), exactly.

    Each partition proposes the (approximate) median of every open range it holds; the
    median of the proposals, weighted by their counts, is the range's pivot. One pass
    counts below, at and above the pivots and gathers the proposals for both sides;
    ranges without a sought rank are ruled out, and once less than half of the stored
    candidates is in an open range the rest is written anew. A pivot is a value of its
    range, so every round rules something out; ranges of at most ``finish`` values are
    sorted and read off.

    The open ranges (g, lo, hi, n, p and the ranks sought in them) are a table of each
    round, at most groups times permilles rows, whatever their number; the driver learns
    only how many there are. They are broadcast to the candidates where their size allows
    and joined by a shuffle else. Null groups or values are left out; ties count; an empty
    table gives no rows.
    """
    s = scratch or Scratch(values.sparkSession)
    cand = s.keep(values.select(F.col(group).cast("long").alias("g"), F.col(value).cast("long").alias("v")).where("g is not null and v is not null"), "select", local=False)
    key = ["g", "lo", "hi"]

    def proposals(x: DataFrame) -> DataFrame:
        """Per range and side: how many (n), and the weighted median (m) of the local medians."""
        by = [*key, "side"]
        local = x.withColumn("pid", F.spark_partition_id()).groupBy(*by, "pid").agg(F.count("*").alias("n"), F.percentile_approx("v", F.lit(0.5), F.lit(100)).alias("m"))
        w = Window.partitionBy(*by).orderBy("m", "pid")
        run = local.select("*", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.sum("n").over(Window.partitionBy(*by)).alias("t"))
        return run.groupBy(*by).agg(F.max("t").alias("n"), F.min(F.when(F.col("c") * 2 >= F.col("t"), F.col("m"))).alias("m"))

    def inside(ranges: DataFrame) -> DataFrame:
        return cand.join(maybe_broadcast(ranges), "g").where("v > lo and v < hi")

    whole = cand.select("g", F.lit(-(2**63)).alias("lo"), F.lit(STUCK).alias("hi"), F.lit(0).alias("side"), "v")
    sought = F.array(*[F.struct(F.lit(q).alias("permille"), F.greatest(F.lit(1).cast("long"), F.expr(f"(n * {q} + 999) div 1000")).alias("k")) for q in permilles])
    ranges = s.keep(proposals(whole).select(*key, "n", F.col("m").alias("p"), sought.alias("ks")), "ranges")
    counts = ranges.select("g", F.col("n").alias("all"))
    last, found = [ranges.where(F.col("n") <= finish)], []
    open_ = s.keep(ranges.where(F.col("n") > finish), "open")
    stored, total, sides = None, 0, None
    while rows_of(open_):
        total = open_.agg(F.sum("n")).first()[0]
        if stored is None or total * 2 <= stored:
            alive = reduce(DataFrame.unionByName, [x.select(*key) for x in last], open_.select(*key))
            new = s.keep(inside(alive).select("g", "v"), "select", local=False) if stored is not None else cand
            if new is not cand:
                s.drop(cand)
            cand, stored = new, total + sum(x.agg(F.sum("n")).first()[0] or 0 for x in last)
        x = inside(open_.select(*key, "p")).select(*key, F.signum(F.col("v") - F.col("p")).cast("int").alias("side"), "v")
        side = lambda i, c: F.max(F.when(F.col("side") == i, F.col(c)))
        split = proposals(x).groupBy(*key).agg(
            F.coalesce(side(-1, "n"), F.lit(0)).alias("below"), side(-1, "m").alias("m0"), F.coalesce(side(0, "n"), F.lit(0)).alias("at"), F.coalesce(side(1, "n"), F.lit(0)).alias("above"), side(1, "m").alias("m2"))
        met = s.keep(open_.join(split, key), "met")
        upto = F.col("below") + F.col("at")
        found.append(met.select("g", F.explode(F.filter("ks", lambda k: (k["k"] > F.col("below")) & (k["k"] <= upto))).alias("k"), F.col("p").alias("v")).select("g", "k.permille", "v"))
        left = met.select("g", "lo", F.col("p").alias("hi"), F.col("below").alias("n"), F.col("m0").alias("p"), F.filter("ks", lambda k: k["k"] <= F.col("below")).alias("ks"))
        right = met.select("g", F.col("p").alias("lo"), "hi", F.col("above").alias("n"), F.col("m2").alias("p"), F.transform(
            F.filter("ks", lambda k: k["k"] > upto), lambda k: F.struct(k["permille"].alias("permille"), (k["k"] - upto).alias("k"))).alias("ks"))
        both = s.keep(left.unionByName(right).where(F.size("ks") > 0), "ranges")
        last.append(both.where(F.col("n") <= finish))
        open_ = s.keep(both.where(F.col("n") > finish), "open")
    ends = reduce(DataFrame.unionByName, last)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("v"))
    read = inside(ends.select(*key, "ks")).withColumn("r", rank).select("g", "v", F.explode(F.filter("ks", lambda k: k["k"] == F.col("r"))).alias("k")).select("g", "k.permille", "v")
    out = reduce(DataFrame.unionByName, found, read)
    return out.join(maybe_broadcast(counts), "g").select("g", "permille", F.col("all").alias("n"), "v")


def percentiles(samples: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """(metric, label, day, n, p50, p90, p99, p999), exact; day 'all' is over all days.

    ``samples`` holds metric, label, day, value (clean_samples). The groups' names are
    numbered once, in a table of their own."""
    s = scratch or Scratch(samples.sparkSession)
    once = s.keep(samples, "samples", local=False)
    names = once.select("metric", "label", "day").distinct()
    every = names.select("metric", "label", F.lit(None).cast("int").alias("day"), F.lit(True).alias("every")).unionByName(names.where("day is not null").withColumn("every", F.lit(False))).distinct()
    book = s.keep(every.withColumn("g", F.monotonically_increasing_id()), "book", local=False)
    own, whole = (book.where("not every" if daily else "every").select(*[F.col(c).alias(f"__{c}") for c in ("metric", "label", "day")], F.col("g").alias(g)) for daily, g in ((True, "gd"), (False, "ga")))
    same = lambda *cols: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols])
    x = once.join(maybe_broadcast(own.withColumnsRenamed({"__metric": "__m", "__label": "__l", "__day": "__d"})),
                  F.col("metric").eqNullSafe(F.col("__m")) & F.col("label").eqNullSafe(F.col("__l")) & F.col("day").eqNullSafe(F.col("__d")), "left")
    x = x.join(maybe_broadcast(whole), same("metric", "label"))
    both = x.select(F.explode(F.array("gd", "ga")).alias("g"), F.col("value").alias("v"))
    got = multi_select(both, scratch=s, **options)
    wide = got.groupBy("g").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("permille") == q, F.col("v"))).alias(NAMES[q]) for q in PERMILLES])
    day = F.coalesce(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd"), F.lit("all"))
    return wide.join(maybe_broadcast(book), "g").select("metric", "label", day.alias("day"), "n", *NAMES.values())


def bucket(v, bits: int = 7):
    """The lower end of v's bucket: v itself below 2^bits, else v with all but its ``bits``
    +1 leading binary digits cleared, so v lies less than 1/2^bits of itself above it."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - F.lit(bits + 1)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def day_sketch(samples: DataFrame, bits: int = 7) -> DataFrame:
    """(metric, label, day, low, n): how many durations lie in the bucket that starts at low.

    Sketches add up: those of any days, partitions or tables are merged by summing n. A
    group has at most 64 * 2^bits buckets however many values it has."""
    return samples.groupBy("metric", "label", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd").alias("day"), bucket(F.col("value"), bits).alias("low")).agg(F.count("*").alias("n"))


def merge_sketches(sketch: DataFrame, by: list[str], bits: int = 7) -> DataFrame:
    """(by, n, p50, p90, p99, p999): bounds from below of the percentiles over the merged
    sketches; each true percentile is less than 1/2^bits of itself larger."""
    merged = sketch.groupBy(*by, "low").agg(F.sum("n").alias("c"))
    whole = Window.partitionBy(*by)
    run = merged.select(*by, "low", F.sum("c").over(whole.orderBy("low").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(whole).alias("n"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1).cast("long"), F.floor((F.col("n") * q + 999) / 1000)), F.col("low")))
    return run.groupBy(*by, "n").agg(*[at(q).alias(NAMES[q]) for q in PERMILLES])
