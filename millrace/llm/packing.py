"""Filling containers of fixed capacity: minimum bin slack over the histogram of sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.lineage import checkpointed


def fullest(room: int, sizes: list[int], left: dict[int, int]) -> dict[int, int]:
    """The multiset of at most ``left[s]`` items of each size that fills ``room`` best, as {size: count}.

    Subset sums as bits of one integer: shifting by a size and or-ing adds an item.  Counts go in as powers of two.  It stops as
    soon as ``room`` itself is reached; the reached sums after every step lead back to the items.
    """
    if room <= 0:
        return {}
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for s in sizes:
        if s > room:
            continue
        n, k = min(left[s], room // s), 1
        while n > 0:
            k = min(k, n)
            now = (reach | (reach << (s * k))) & mask
            if now != reach:
                steps.append((s, k, reach))
                reach = now
            n -= k
            k *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    use: dict[int, int] = {}
    for s, k, before in reversed(steps):
        if not before >> at & 1:
            use[s] = use.get(s, 0) + k
            at -= s * k
    return use


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Fillings as (number of containers, {size: items in each}), using up ``counts`` items of each size.

    Each container takes a largest item left and, by :func:`fullest`, the items that leave the least slack beside it.  The filling is
    repeated as long as the sizes last, so there are about as many fillings as sizes, however many items.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    out = []
    while left:
        sizes = sorted(left, reverse=True)
        big = sizes[0]
        left[big] -= 1
        use = fullest(capacity - big, sizes, left)
        left[big] += 1
        use[big] = use.get(big, 0) + 1
        times = min(left[s] // k for s, k in use.items())
        out.append((times, use))
        for s, k in use.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return out


def _segments(bins: list[tuple[int, dict[int, int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """Per size, runs of item ranks with the container of the first and how many share one; sorted by (size, first rank)."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, use in bins:
        for s, k in use.items():
            at = used.get(s, 0)
            rows.append((s, at, base, k))
            used[s] = at + k * times
        base += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def pack(spark: SparkSession, sized: DataFrame, capacity: int = 2048, shard_rows: int = 200_000) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id): every item of ``sized`` (doc_id, n_tokens) in a container.

    An item over the capacity is cut into pieces, all but the last of full capacity (``piece`` counts from 0); no other item is
    split.  Items of size 0 take no room and have a null container; a null size counts as 0.  Repeated ids are items of their own.

    Only the histogram of sizes, at most ``capacity`` rows, reaches the driver, and the plan made of it goes back: its size depends on
    the capacity, not on the data.  Items find their place by their rank among those of their size, counted in shards, so
    a size that a third of all items have is ranked by many tasks.  ``sized`` is checkpointed once.
    """
    items = checkpointed(spark, sized.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n")))
    full = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1).cast("int")
    pieces = items.select("doc_id", "n", F.explode(F.sequence(F.lit(0), full)).alias("piece")).select(
        "doc_id", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("n_tokens")
    )
    counts = {r["n_tokens"]: r["count"] for r in pieces.filter("n_tokens > 0").groupBy("n_tokens").count().collect()}
    bins = plan_bins(counts, capacity)
    size, first, base, share = _segments(bins, capacity)
    key = size * (1 << 48) + first
    plan = spark.sparkContext.broadcast((key, first, base, share))
    shards = max(1, -(-max(counts.values(), default=0) // shard_rows))
    sharded = pieces.filter("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    by = Window.partitionBy("n_tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = sharded.groupBy("n_tokens", "shard").count().select("n_tokens", "shard", F.coalesce(F.sum("count").over(by), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("n_tokens", "shard").orderBy("doc_id", "piece")) - 1
    ranked = sharded.withColumn("inner", inner).join(before, ["n_tokens", "shard"]).select("doc_id", "piece", "n_tokens", (F.col("before") + F.col("inner")).alias("rank"))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, base, share = plan.value
        for p in parts:
            rank = p["rank"].to_numpy()
            at = np.searchsorted(key, p["n_tokens"].to_numpy().astype(np.int64) * (1 << 48) + rank, side="right") - 1
            yield pd.DataFrame({"doc_id": p["doc_id"], "piece": p["piece"], "n_tokens": p["n_tokens"], "container_id": base[at] + (rank - first[at]) // share[at]})

    kind = "doc_id long, piece int, n_tokens int, container_id long"
    placed = ranked.mapInPandas(place, kind)
    return placed.unionByName(pieces.filter("n_tokens = 0").select("*", F.lit(None).cast("long").alias("container_id")))
