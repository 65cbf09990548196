"""Filling fixed-capacity containers with items.

First-fit decreasing inside randomised groups of items. Only (id, size) pairs are shuffled, by
a hash of the id and a row number, so a group is a fair sample of all sizes and no source or key can
make one group large. Inside a group a tournament tree over the free space of the open containers finds
the first one an item fits into in logarithmic time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tokens import with_token_counts
from quern.session import checkpointed, partitions_for

CAPACITY = 8192
GROUP_ROWS = 20_000


class FirstFit:
    """Containers in order of opening, with a tree of maxima over their free space."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1
        while self.leaves < max(1, most):
            self.leaves *= 2
        # Every leaf starts as a container not opened yet, which is wholly free.
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        """Index of the first container with room for ``size``, which is taken from it."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        free[at] -= size
        index = at - self.leaves
        at //= 2
        while at:
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
            at //= 2
        return index


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container index of each size, in the given order; sizes are at most ``capacity``."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    fit, out = FirstFit(capacity, len(sizes)), [0] * len(sizes)
    for i in order:
        out[i] = fit.put(sizes[i])
    return out


def pack(
    df: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS, rows: int | None = None,
) -> DataFrame:
    """Assign items to containers: rows (key, part, container, size), nothing else passes through.

    An item within the capacity has one row with part 0. A larger one has as many full
    containers to itself as it fills (parts 0, 1, ...), and its rest is packed as an ordinary
    item. A null or negative size counts as 0. Items of size 0 share a container with others. Repeated rows are
    items of their own; a null key is kept. An empty table gives no rows. ``rows`` is the row
    count if the caller knows it; it only sets the number of groups.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    s = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    # Written once, with a number for each row: rows that share a key, or have none, are spread as well.
    items = checkpointed(df.select(F.col(key).cast("string").alias("key"), s.alias("size"), F.monotonically_increasing_id().alias("n")))
    groups = partitions_for(items.count() if rows is None else rows, group_rows)
    items = items.select("key", "size", F.pmod(F.xxhash64("key", "n", F.lit("pack")), F.lit(groups)).cast("int").alias("grp")).repartition(groups, "grp")
    # Keys travel as text, so that a null among them doesn't turn numbers into floats.
    kind = df.schema[key].dataType.simpleString()

    def fill(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "key"], ascending=[False, True], kind="stable", ignore_index=True)
        base = int(g["grp"].iloc[0]) << 32
        full, rest = g["size"] // capacity, g["size"] % capacity
        packed = ~((rest == 0) & (full > 0))
        bins = first_fit_decreasing(rest[packed].tolist(), capacity)
        one = pd.DataFrame({
            "key": g["key"][packed], "part": full[packed].astype("int32"),
            "container": [base + b for b in bins], "size": rest[packed],
        })
        big = g[full > 0]
        times = full[full > 0]
        own = big.loc[big.index.repeat(times)]
        part = own.groupby(level=0).cumcount()
        first = base + (max(bins) + 1 if bins else 0)
        whole = pd.DataFrame({
            "key": own["key"], "part": part.astype("int32"),
            "container": range(first, first + len(own)), "size": capacity,
        })
        return pd.concat([one, whole], ignore_index=True).astype({"container": "int64", "size": "int64"})

    out = items.groupBy("grp").applyInPandas(fill, "key string, part int, container bigint, size bigint")
    return out.select(F.col("key").cast(kind).alias(key), "part", "container", F.col("size").alias(size))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents by the token count of their whole texts."""
    sized = with_token_counts(docs.select("doc_id", "text"), "text").drop("text")
    return pack(sized, capacity=capacity)
