"""Filling fixed-capacity containers with items (problem 7): cost-balanced packing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import Scratch


def pack_sizes(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> np.ndarray:
    """The container of each item. Items go in descending order to the cheapest container
    with room; cost is linear in an item's tokens plus quadratic for its attention. As
    many containers as the total needs are open from the start; where none has room one
    more opens. Containers are held by the room they have left, a heap for each."""
    n = len(sizes)
    where = np.empty(n, dtype=np.int64)
    if not n:
        return where
    opened = max(1, -(-int(sizes.sum()) // capacity))
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    heaps[capacity] = [(0.0, i) for i in range(opened)]
    top = np.full(capacity + 1, np.inf)
    top[capacity] = 0.0
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        r = s + int(np.argmin(top[s:]))
        if top[r] == np.inf:
            cost, c, r = 0.0, opened, capacity
            opened += 1
        else:
            cost, c = heapq.heappop(heaps[r])
            top[r] = heaps[r][0][0] if heaps[r] else np.inf
        where[i] = c
        cost += linear * s + quadratic * s * s
        heapq.heappush(heaps[r - s], (cost, c))
        top[r - s] = heaps[r - s][0][0]
    return where


def pack(
    items: DataFrame, *, item: str, tokens: str, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 4096, shard_items: int = 20_000
) -> DataFrame:
    """(container, item, part, parts, first_token, n_tokens): every item with tokens once.

    No container holds more than ``capacity`` tokens. An item is split only if it exceeds
    that: into full parts and a rest, by token position. Items with null or no tokens go
    nowhere. Repeated items are packed as often as they occur. An empty table gives no
    rows; only the two named columns are read.

    Items are spread over shards of about ``shard_items`` by their hash, so no task holds
    more than that, and each shard is packed on its own; at that size a shard's last
    containers waste a fraction of one in a thousand. Full parts take no part in it.
    """
    cap = F.lit(capacity)
    known = items.select(F.col(item).alias("item"), F.col(tokens).cast("long").alias("n")).where("n > 0")
    parts = known.select("item", "n", F.expr(f"(n + {capacity - 1}) div {capacity}").alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    parts = parts.select("item", "part", "parts", (F.col("part") * cap).alias("first_token"), F.least(cap, F.col("n") - F.col("part") * cap).cast("long").alias("n_tokens"))
    full = parts.where(F.col("n_tokens") == cap).select(
        F.concat_ws("-", F.lit("full"), F.col("item").cast("string"), F.col("part").cast("string")).alias("container"), "item", "part", "parts", "first_token", "n_tokens")
    rest = parts.where(F.col("n_tokens") < cap)
    shards = max(1, -(-known.count() // shard_items))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("item", "part"), F.lit(shards)))
    kind = dict(rest.dtypes)["item"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "part"], kind="stable").reset_index(drop=True)
        where = pack_sizes(pdf.n_tokens.to_numpy(), capacity, linear, quadratic)
        pdf["container"] = [f"{s}-{c}" for s, c in zip(pdf["shard"], where)]
        return pdf[["container", "item", "part", "parts", "first_token", "n_tokens"]]

    packed = rest.groupBy("shard").applyInPandas(one, f"container string, item {kind}, part long, parts long, first_token long, n_tokens long")
    return full.unionByName(packed)


def pack_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, items, tokens, least_containers, fill, split_items) over all."""
    by = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.count(F.when(F.col("part") == 1, 1)).alias("s"))
    return by.agg(
        F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.sum("s").alias("split_items"),
    ).withColumn("least_containers", F.ceil(F.col("tokens") / capacity)).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 4))
