"""Filling fixed-capacity containers with items of varying length.

Method: Karmarkar-Karp multiway differencing. Partial partitions are merged two at a time, those of the largest
imbalance first and with opposing order (the fullest window of one with the emptiest of the other), which
leaves near-equal windows; the number of windows starts at the least possible and rises whenever a
window exceeds the capacity. An item longer than the capacity is cut into full pieces, which are containers of their
own, and a rest, which is packed like any item; no other item is cut.

Items are spread by hash over shards of a bounded number of tokens, each packed in one task: a shard
wastes less than a container or so beyond its own imbalance, so the fill doesn't depend on the number of shards.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers a shard holds, about.
SHARD_CONTAINERS = 512


def _key(x: tuple) -> int:
    return x[0]


def _merge(a: list, b: list, m: int) -> list:
    """Opposing merge of two partitions, each a list of (sum, items) in ascending order without the empty windows."""
    if len(a) < len(b):
        a, b = b, a
    over = max(len(a) + len(b) - m, 0)
    joined = [(a[t][0] + b[over - 1 - t][0], (a[t][1], b[over - 1 - t][1])) for t in range(over)]
    rest = a[over:] if over else a
    more = joined + b[over:]
    if len(more) <= 8:
        for x in more:
            insort(rest, x, key=_key)
        return rest
    rest = rest + more
    rest.sort(key=_key)
    return rest


def difference_partition(sizes: list[int], m: int) -> list[tuple[int, list[int]]]:
    """``sizes`` as ``m`` windows of near-equal sums: (sum, positions) per window in use."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        c = _merge(a, b, m)
        count += 1
        heapq.heappush(heap, (-(c[-1][0] - (c[0][0] if len(c) == m else 0)), count, c))
    out = []
    for total, node in heap[0][2] if heap else []:
        items, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                items.append(x)
        out.append((total, items))
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` (each at most ``capacity``) by container. Items of size 0 go with the first."""
    real = [i for i, s in enumerate(sizes) if s > 0]
    empty = [i for i, s in enumerate(sizes) if s <= 0]
    total = sum(sizes[i] for i in real)
    m = max(1, -(-total // capacity))
    while True:
        windows = difference_partition([sizes[i] for i in real], m)
        if all(t <= capacity for t, _ in windows):
            break
        m += max(1, m // 200)
    out = [[real[j] for j in items] for _, items in windows] or [[]]
    out[0] = out[0] + empty
    return [x for x in out if x]


def _copies(items: DataFrame) -> DataFrame:
    """``item``, ``_n`` (its tokens), ``copy``: equal rows numbered from 0. They are counted, not ranked, so any number of equal rows is spread over tasks, and the numbers do not depend on how."""
    counted = items.select("item", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("_n")).groupBy("item", "_n").agg(F.count(F.lit(1)).alias("_c"))
    step = 4096  # in two steps, so that no array grows with the count
    blocks = counted.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1, F.lit(step).cast("long"))))
    return blocks.select("item", "_n", F.explode(F.sequence(F.col("_b"), F.least(F.col("_c"), F.col("_b") + step) - 1)).alias("copy"))


def pieces(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """Items by capacity, cut where they exceed it: ``size_name``, ``capacity``, ``item``, ``whole`` (the item's tokens), ``copy``, ``piece_no``, ``start_token``, ``n_tokens``.

    ``items``: (item, n_tokens); ``sizes``: (size_name, capacity_tokens), whose capacities must be above 0.
    """
    caps = [(r["size_name"], int(r["capacity_tokens"])) for r in sizes.select("size_name", "capacity_tokens").distinct().collect()]
    if any(c <= 0 for _, c in caps):
        raise ValueError("capacities must be above 0")
    if not caps:
        raise ValueError("no capacities given")
    per = F.explode(F.array(*[F.struct(F.lit(n).alias("size_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(caps)]))
    rows = _copies(items).select("item", "_n", "copy", per.alias("_c")).select("item", "_n", "copy", "_c.*")
    last = F.greatest(F.ceil(F.col("_n") / F.col("capacity")) - 1, F.lit(0))
    cut = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece_no") * F.col("capacity")
    return cut.select("size_name", "capacity", "item", F.col("_n").alias("whole"), "copy", F.col("piece_no").cast("int").alias("piece_no"), start.alias("start_token"), F.least(F.col("_n") - start, F.col("capacity")).alias("n_tokens"))


def pack_items(items: DataFrame, sizes: DataFrame, shard_containers: int = SHARD_CONTAINERS) -> DataFrame:
    """Container of every piece of every item: ``size_name``, ``container_id``, ``item``, ``piece_no``, ``start_token``, ``n_tokens``.

    ``items`` should be cheap to read twice (a written table): totals decide the number of shards. Containers and their ids follow from the items alone, however
    they are partitioned. Defined results: an item of no
    tokens (or null) takes no room and goes with other items; a null item is packed like any other; repeated items are items
    of their own; no items give no rows.
    """
    cut = pieces(items, sizes)
    totals = {r["size_name"]: math.ceil(r["t"] / (r["capacity"] * shard_containers)) for r in cut.filter(F.col("n_tokens") < F.col("capacity")).groupBy("size_name", "capacity").agg(F.sum("n_tokens").alias("t")).collect()}
    shards = F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(max(v, 1)))]) if totals else F.create_map(F.lit(""), F.lit(1))
    is_full = F.col("n_tokens") == F.col("capacity")
    full = cut.filter(is_full).select("size_name", F.concat_ws("-", "size_name", F.lit("full"), F.coalesce(F.col("item").cast("string"), F.lit("null")), F.col("whole").cast("string"), F.col("copy").cast("string"), F.col("piece_no").cast("string")).alias("container_id"), "item", "piece_no", "start_token", "n_tokens")
    open_ = cut.filter(~is_full).withColumn("_shard", F.pmod(F.xxhash64("item", "whole", "copy", "piece_no"), F.coalesce(shards[F.col("size_name")], F.lit(1))).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "item", "whole", "copy", "piece_no"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        name, shard, capacity = pdf["size_name"].iloc[0], pdf["_shard"].iloc[0], int(pdf["capacity"].iloc[0])
        where = [""] * len(pdf)
        for k, positions in enumerate(pack(pdf["n_tokens"].astype(int).tolist(), capacity)):
            for i in positions:
                where[i] = f"{name}-{shard}-{k}"
        pdf["container_id"] = where
        return pdf[["size_name", "container_id", "item", "piece_no", "start_token", "n_tokens"]]

    schema = f"size_name string, container_id string, item {dict(items.dtypes)['item']}, piece_no int, start_token long, n_tokens long"
    packed = open_.groupBy("size_name", "_shard").applyInPandas(run, schema)
    return packed.unionByName(full)


def container_summary(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per size: ``size_name``, ``capacity_tokens``, ``containers``, ``tokens``, ``fullest`` (tokens of the fullest container), ``fill`` (share of the room in use)."""
    per = packed.groupBy("size_name", "container_id").agg(F.sum("n_tokens").alias("t"))
    per = per.groupBy("size_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    per = per.join(sizes.select("size_name", "capacity_tokens").distinct(), "size_name")
    return per.select("size_name", "capacity_tokens", "containers", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))
