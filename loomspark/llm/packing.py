"""Filling fixed-capacity containers with items: best fit over counts of sizes instead of items.

The histogram of sizes has at most as many entries as the capacity. Best fit decreasing runs over it on the driver in
steps of equal items and equal containers, so its work depends on the capacity and not on the number of items. The plan
says which containers the items of each size with ranks from-to go to; items then find their place by their rank among
the items of their size.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import running_total

PLAN_ROWS = 500_000  # a plan of so many segments, some 20 MB, is repeated to all tasks; a larger one is joined


def plan_best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(size, rank from, rank to, first container, items a container)], containers used) for items of 1..capacity.

    Best fit decreasing: each item goes to the fullest container it fits into. Equal items fill such a container before
    the next, so a whole group of equally full containers is dealt with in one step.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> groups (first container, how many)
    spaces: list[int] = []  # the spaces with groups, sorted
    segments, used = [], 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append((first, n))

    for size in sorted((s for s in histogram if 0 < s <= capacity), reverse=True):
        left, rank = histogram[size], 0
        while left:
            i = bisect.bisect_left(spaces, size)
            if i < len(spaces):
                space = spaces[i]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space]
                    spaces.pop(i)
            else:
                space, first, n = capacity, used, -(-left // (capacity // size))
                used += n
            each = space // size
            full = min(n, left // each)
            if full:
                segments.append((size, rank, rank + full * each, first, each))
                put(space - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left and left < each:  # the last, not wholly filled container of this size
                    segments.append((size, rank, rank + left, first + full, left))
                    put(space - left * size, first + full, 1)
                    full, left = full + 1, 0
                put(space, first + full, n - full)
    return segments, used


def pack(items: DataFrame, containers: dict[str, int], id_col: str = "doc_id") -> DataFrame:
    """(container_name, container_id, id, piece, from_token, n_tokens): where every item goes, for each kind of container.

    items: unique ids and n_tokens. An item larger than the capacity is split: each full piece has a container of its
    own, the rest is packed like an item. Items without tokens take no space and lie in container 0. Capacities must be
    positive; without items or containers there are no rows.
    """
    spark = items.sparkSession
    if not containers:
        return spark.createDataFrame([], f"container_name string, container_id long, {id_col} {items.schema[id_col].dataType.simpleString()}, piece int, from_token long, n_tokens long")
    kinds = F.array(*[F.struct(F.lit(n).alias("container_name"), F.lit(c).cast("long").alias("capacity")) for n, c in sorted(containers.items())])
    each = items.select(F.col(id_col).alias("id"), "n_tokens", F.explode(kinds).alias("c")).select("id", "n_tokens", "c.*")
    cut = each.withColumn("n_full", F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(0).cast("long")).withColumn("rest", (F.col("n_tokens") - F.col("n_full") * F.col("capacity")).cast("long"))
    counts: dict[str, dict[int, int]] = {}
    for r in cut.filter("rest > 0").groupBy("container_name", "rest").count().collect():  # at most the sum of the capacities
        counts.setdefault(r[0], {})[r[1]] = r[2]
    rows, used = [], {}
    for name, capacity in containers.items():
        segments, used[name] = plan_best_fit(counts.get(name, {}), capacity)
        rows += [(name, *s) for s in segments]
    plan = spark.createDataFrame(rows, "container_name string, rest long, lo long, hi long, first long, each long")
    segments = plan.groupBy("container_name", "rest").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "each"))).alias("_segs"))  # a row for each size, of which there are as many as the capacities
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in used.items() for x in kv]), F.col("container_name")), F.lit(0)).cast("long")

    ranked = running_total(cut.filter("rest > 0").select("container_name", "rest", "id", "n_full", "capacity"), ["container_name", "rest"], "id", F.lit(1), "rank")
    # every item keeps one row: it looks its segment up by its rank
    placed = ranked.join(F.broadcast(segments) if len(rows) <= PLAN_ROWS else segments, ["container_name", "rest"])
    mine = F.get(F.filter("_segs", lambda g: (g["lo"] <= F.col("rank")) & (F.col("rank") < g["hi"])), F.lit(0))
    placed = placed.withColumn("_seg", mine).select("container_name", "rest", "id", "n_full", "capacity", "rank", "_seg.lo", "_seg.first", "_seg.each")
    rests = placed.select("container_name", (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long").alias("container_id"), F.col("id").alias(id_col), F.col("n_full").cast("int").alias("piece"), (F.col("n_full") * F.col("capacity")).cast("long").alias("from_token"), F.col("rest").alias("n_tokens"))
    whole = running_total(cut.filter("n_full > 0").select("container_name", "id", "n_full", "capacity"), ["container_name"], "id", F.col("n_full"), "before")
    fulls = whole.select("container_name", "id", "capacity", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_full") - 1)).alias("k")).select("container_name", (base + F.col("before") + F.col("k")).alias("container_id"), F.col("id").alias(id_col), F.col("k").cast("int").alias("piece"), (F.col("k") * F.col("capacity")).alias("from_token"), F.col("capacity").alias("n_tokens"))
    empty = cut.filter("n_tokens = 0").select("container_name", F.lit(0).cast("long").alias("container_id"), F.col("id").alias(id_col), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("from_token"), F.lit(0).cast("long").alias("n_tokens"))
    return rests.unionByName(fulls).unionByName(empty)


def fill(packed: DataFrame, containers: dict[str, int]) -> DataFrame:
    """Per kind of container: how many, their space, the tokens in them and the share of space unused."""
    capacity = (F.element_at(F.create_map(*[F.lit(x) for kv in containers.items() for x in kv]), F.col("container_name")) if containers else F.lit(None)).cast("long")
    per = packed.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("t"))
    out = per.groupBy("container_name").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return out.select("container_name", capacity.alias("capacity_tokens"), "n_containers", "n_tokens", "fullest", (1 - F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("unused_share"))


def violations(packed: DataFrame, items: DataFrame, containers: dict[str, int], id_col: str = "doc_id") -> DataFrame:
    """What a right packing has none of, for each kind of container: containers over their capacity, items that are not there with
    all their tokens, and items in several pieces that would fit into one container; and how many items are placed."""
    capacity = (F.element_at(F.create_map(*[F.lit(x) for kv in containers.items() for x in kv]), F.col("container_name")) if containers else F.lit(None)).cast("long")
    over = packed.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("t")).filter(F.col("t") > capacity).groupBy("container_name").agg(F.count(F.lit(1)).alias("n_over"))
    own = packed.groupBy("container_name", id_col).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("from_token").alias("starts"))
    j = own.join(items.select(id_col, F.col("n_tokens").alias("whole")), id_col, "full_outer")
    wrong = F.col("whole").isNull() | ~F.col("t").eqNullSafe(F.col("whole")) | (F.col("pieces") != F.col("starts"))
    per = j.groupBy("container_name").agg(F.count(F.lit(1)).alias("n_items"), F.sum(wrong.cast("long")).alias("n_wrong"), F.sum(((F.col("pieces") > 1) & (F.col("whole") <= capacity)).cast("long")).alias("n_split"))
    return per.join(over, "container_name", "left").select("container_name", "n_items", F.coalesce("n_over", F.lit(0)).alias("n_over"), "n_wrong", "n_split")
