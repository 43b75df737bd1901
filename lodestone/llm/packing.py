"""Filling containers of fixed capacity with texts, by sum-of-squares packing.

Items of one shard arrive in the order of a hash. With N(g) open bins of residual gap g, an item of size
s goes where the sum of N(g)^2 over all gaps g > 0 becomes smallest: into a bin of some gap g >= s, or
into a new one. The state is one counter for each gap, so an item costs one pass over `capacity`
counters whatever the number of bins.

Texts above the capacity are cut into full containers and a rest, which is packed like a text; no other text is cut.
The table is packed in shards of about `bins` containers: each is one task of bounded size, and
the bins left open at its end are few against `bins`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, numbered from 0. Sizes are 1..capacity. Of equally good places the
    bin with the smallest gap is taken, and a new bin last."""
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    bins = 0
    for k, s in enumerate(sizes.tolist()):
        # change of the sum of squares, halved and without the constant, for gaps s..capacity-1
        gaps = open_bins[s:capacity]
        change = open_bins[: capacity - s] - gaps + 1.0
        if len(change):
            change[0] = 0.5 - gaps[0]  # the bin is full after it and leaves the sum
            change[gaps == 0] = np.inf
            best = int(change.argmin())
            cost = change[best]
        else:
            best, cost = -1, np.inf
        rest = capacity - s
        new_cost = open_bins[rest] + 0.5 if rest else 0.0
        if cost <= new_cost:
            gap = best + s
            b = stacks[gap].pop()
            open_bins[gap] -= 1
            rest = best
        else:
            b = bins
            bins += 1
        if rest:
            open_bins[rest] += 1
            stacks.setdefault(rest, []).append(b)
        out[k] = b
    return out


def pack(items: DataFrame, containers: DataFrame, bins: int = 4096) -> DataFrame:
    """items: (id, n_tokens); containers: (container_kind, capacity_tokens), a few rows.
    Every item is packed once for each kind: (container_kind, container_id, id, piece, first_token, n_tokens).

    Items without a size or of size 0 need no room and are left out; repeated ids count once; kinds
    without a positive capacity are left out. Empty tables give an empty result.
    """
    id_type = items.schema["id"].dataType.simpleString()
    items = items.where(F.col("n_tokens") > 0).groupBy("id").agg(F.max("n_tokens").cast("long").alias("n_tokens"))
    kinds = containers.where((F.col("capacity_tokens") > 0) & F.col("container_kind").isNotNull()).select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity")).distinct()
    total = items.agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total.n:
        total = {"t": 0, "n": 0}
    # the table of kinds has a few rows, each of which is a packing job of its own
    known = [(r.container_kind, r.capacity, max(1, math.ceil((total["t"] or 0) / (r.capacity * bins)), math.ceil(total["n"] / 200_000))) for r in kinds.collect()]
    spark = items.sparkSession
    plan = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity"), F.lit(s).alias("shards")) for k, c, s in known]) if known else None
    schema = f"container_kind string, container_id long, id {id_type}, piece int, first_token long, n_tokens int"
    if plan is None:
        return spark.createDataFrame([], schema)

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        kind, capacity, shard = (v.as_py() for v in key)
        group = group.sort_by([("h", "ascending"), ("id", "ascending")])
        n = group["n_tokens"].to_numpy()
        full, rest = n // capacity, n % capacity
        packed = np.flatnonzero(rest)
        where = sum_of_squares(rest[packed], capacity)
        base = int(where.max()) + 1 if len(where) else 0
        item = np.r_[packed, np.repeat(np.arange(len(n)), full)]
        first_full = np.cumsum(np.r_[0, full])[:-1]
        piece = np.r_[full[packed], np.arange(full.sum()) - np.repeat(first_full, full)]
        container = np.r_[where, base + np.arange(full.sum())] + (shard << 32)
        size = np.r_[rest[packed], np.full(full.sum(), capacity)]
        return pa.table(
            {
                "container_kind": pa.array([kind] * len(item), pa.string()),
                "container_id": pa.array(container.astype(np.int64)),
                "id": group["id"].combine_chunks().take(pa.array(item)),
                "piece": pa.array(piece.astype(np.int32)),
                "first_token": pa.array((piece * capacity).astype(np.int64)),
                "n_tokens": pa.array(size.astype(np.int32)),
            }
        )

    sharded = items.select("id", "n_tokens", F.xxhash64("id").alias("h"), F.explode(plan).alias("k")).select(
        "id", "n_tokens", "h", "k.container_kind", "k.capacity", F.pmod("h", F.col("k.shards")).cast("int").alias("shard")
    )
    return sharded.groupBy("container_kind", "capacity", "shard").applyInArrow(fill, schema)


def fills(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, container_id, n_items, used_tokens, capacity_tokens, fill) of each container."""
    sizes = containers.select("container_kind", "capacity_tokens").distinct()
    used = packed.groupBy("container_kind", "container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used_tokens"))
    return used.join(F.broadcast(sizes), "container_kind").select("*", (F.col("used_tokens") / F.col("capacity_tokens")).alias("fill"))
