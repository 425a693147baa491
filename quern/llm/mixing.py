"""Mixing sources to target weights (problem 8): pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import Scratch


def pivotal(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds copy probabilities in (0, 1) to 0 or 1, pair by pair: mass (tokens times
    probability) moves at random between two items, each keeping its expectation, until
    one is integral. The total mass stays. Returns the result and the one item that may
    still be fractional (-1 if none)."""
    p = p.astype(float).copy()
    held = -1
    draws = rng.random(len(p))
    for j in range(len(p)):
        if p[j] <= 1e-12 or p[j] >= 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, size[held], size[j]
        up = min(a * (1 - p[i]), b * p[j])  # mass from j to i
        down = min(a * p[i], b * (1 - p[j]))  # mass from i to j
        move = up if draws[j] * (up + down) < down else -down
        p[i] += move / a
        p[j] -= move / b
        loose = []
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                p[k] = round(p[k])
            else:
                loose.append(k)
        held = loose[0] if loose else -1
    return p, held


def mixture_plan(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per target source: docs, tokens, share of those that have tokens, rate
    (expected copies per document) and goal tokens.

    Shares are taken of the targets whose sources have documents. Without ``total`` the
    mixture is the largest in which no source needs more than max_repeats copies of a
    document; a larger ``total`` is an error, as the shares would not hold.
    """
    have = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(have, "source", "left").na.fill({"docs": 0, "tokens": 0, "target_share": 0.0, "max_repeats": 0})
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy(F.lit(0))  # one row per target source
    t = t.select("*", F.sum(F.when(usable, F.col("target_share"))).over(every).alias("__sum"), F.min(F.when(usable, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).over(every).alias("__m"))
    share = F.when(usable, F.col("target_share") / F.col("__sum")).otherwise(0.0)
    largest = F.col("__m") * F.col("__sum")
    if total is None:
        size = largest
    else:
        size = F.when(F.lit(float(total)) <= largest, F.lit(float(total))).when(largest.isNotNull(), F.raise_error(F.concat(F.lit(f"a mixture of {total} tokens needs more repeats than allowed; the largest has "), F.floor(largest).cast("string"))).cast("double"))
    goal = share * size
    return t.withColumn("share", share).withColumn("goal", F.coalesce(goal, F.lit(0.0))).withColumn(
        "rate", F.when(F.col("tokens") > 0, F.least(F.col("goal") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)).drop("__sum", "__m")


def mix(
    sized: DataFrame, targets: DataFrame, *, total: float | None = None, seed: int = 0, bucket_docs: int = 20_000, fan_in: int = 1_000, scratch: Scratch | None = None
) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents used, each at most max_repeats times.

    ``sized`` holds doc_id, source and n_tokens. A document gets the whole part of its
    source's rate and, by pivotal rounding weighted with its tokens, perhaps one copy
    more, so a source's tokens miss its goal by less than one document. Buckets of about
    ``bucket_docs`` documents round on their own; the one document each leaves open is
    combined with those of ``fan_in`` other buckets, level by level, up to one per source.

    Nulls: documents without source, id or tokens take no part; sources without documents
    get nothing and are reported with share 0. Repeated rows are separate documents. An
    empty table gives no rows; other columns aren't read.
    """
    s = scratch or Scratch(sized.sparkSession)
    docs = sized.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).where("doc_id is not null and source is not null and n_tokens > 0")
    # The targets, one row per source, are as small as the list given; AQE chooses the join.
    plan = s.keep(mixture_plan(docs, targets, total), "plan")
    most = plan.agg(F.max("docs")).first()[0] or 0
    buckets = max(1, -(-most // bucket_docs))
    rated = plan.select("source", "rate", F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket_docs)).alias("__nb"))
    x = docs.join(F.broadcast(rated) if _few(rated) else rated, "source").where("rate > 0")
    x = x.select("doc_id", "source", "n_tokens", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"),
                 F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("__nb")).alias("bucket"))
    kind = dict(x.dtypes)["doc_id"]
    schema = f"doc_id {kind}, source string, n_tokens long, whole int, p double, bucket long, open boolean"

    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        source, bucket = key
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(bucket), len(pdf), *str(source).encode()])
        pdf["p"], held = pivotal(pdf.n_tokens.to_numpy(float), pdf.p.to_numpy(float), rng)
        pdf["open"] = pdf.index == held
        pdf["bucket"] = int(bucket)
        return pdf[["doc_id", "source", "n_tokens", "whole", "p", "bucket", "open"]]

    level = s.keep(x.groupBy("source", "bucket").applyInPandas(combine, schema), "round")
    closed = [level.where(~F.col("open"))]
    rest = level.where("open")
    while buckets > 1:
        buckets = -(-buckets // fan_in)
        up = rest.select("doc_id", "source", "n_tokens", "whole", "p", F.floor(F.col("bucket") / fan_in).alias("bucket"))
        level = s.keep(up.groupBy("source", "bucket").applyInPandas(combine, schema), "round")
        closed.append(level.where(~F.col("open")))
        rest = level.where("open")
    draw = F.pmod(F.xxhash64("doc_id", "source", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    closed.append(rest.withColumn("p", (draw < F.col("p")).cast("double")))
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out.select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies")).where("copies > 0")


def _few(rated: DataFrame, limit: int = 100_000) -> bool:
    """Whether the target list, checked by count, is small enough to broadcast."""
    return rated.limit(limit + 1).count() <= limit


def mixture_report(sized: DataFrame, targets: DataFrame, mixed: DataFrame, total: float | None = None) -> DataFrame:
    """Per target source: its documents and tokens, the share asked for, the goal and what was reached."""
    plan = mixture_plan(sized.where("source is not null and doc_id is not null and n_tokens > 0"), targets, total)
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    x = plan.join(got, "source", "left").na.fill({"mixed_tokens": 0, "copies": 0, "most_copies": 0})
    x = x.withColumn("__all", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))))
    return x.select("source", "target_share", "max_repeats", "docs", "tokens", F.round("share", 6).alias("share"), "mixed_tokens", "copies", "most_copies",
                                F.round(F.col("mixed_tokens") / F.col("__all"), 6).alias("actual_share"))
