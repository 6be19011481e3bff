"""Helpers that keep joins, ranks and sums even when one group holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

HOT_ROWS = 50_000  # a group of fewer rows is left to one task
PER_TASK = 4  # a key is split if it alone would make a task this many times smaller than the mean too large


def hot_keys(df: DataFrame, key: str, at_least: int = HOT_ROWS) -> dict:
    """key -> rows, of the keys with at least so many rows.

    Only the 4 x shuffle partitions largest come to the driver: any other key has less than a quarter of a mean task's rows,
    so leaving it whole skews nothing, however many rows that is.
    """
    most = PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = df.filter(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count")).limit(most)
    return {r[0]: r[1] for r in top.collect() if r[1] >= at_least}


def skew_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left", at_least: int = HOT_ROWS) -> DataFrame:
    """Inner or left equi-join on `key` in which a hot key of `left` is split over as many tasks as its rows need.

    Only the rows of `right` with a hot key are repeated, once a task; `right` should have few rows a key. `spread` decides a
    left row's task and must be a function of the row, so that a retried task makes the same rows. Rows with a null key meet
    nothing and are not shuffled.
    """
    hot = hot_keys(left, key, at_least)
    none = left.filter(F.col(key).isNull()) if how == "left" else None
    left = left.filter(F.col(key).isNotNull())
    if not hot:
        out = left.join(right, key, how)
    else:
        salts = F.element_at(F.create_map(*[F.lit(x) for k, n in hot.items() for x in (k, -(-n // at_least))]), F.col(key))
        a = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce(salts, F.lit(1))).cast("int"))
        b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)))
        out = a.join(b, [key, "_salt"], how).drop("_salt")
    return out if none is None else out.unionByName(none, allowMissingColumns=True)


def look_up(asks: DataFrame, rows: DataFrame, key: str, at_least: int = HOT_ROWS, n: int | None = None) -> DataFrame:
    """Inner join with a table that has one row a key. The rows of hot keys, as many as hot_keys gives at most, go to all tasks
    instead of their askers to one; `n` is the number of askers, if known."""
    hot = hot_keys(asks, key, at_least) if n is None or n >= at_least else {}
    if not hot:
        return asks.join(rows, key)
    is_hot = F.col(key).isin(list(hot))
    return asks.filter(~is_hot).join(rows, key).unionByName(asks.filter(is_hot).join(F.broadcast(rows.filter(is_hot)), key))


def running_total(df: DataFrame, group: list[str], order: str, value: Column, name: str, buckets: int | None = None) -> DataFrame:
    """Exclusive running sum of `value` within `group`, in the order (hash bucket of `order`, `order`).

    A group of any size is spread over `buckets` tasks (as many as shuffle partitions, 64 at least): the buckets' sums are
    added up first (at most `buckets` rows a group), then each bucket runs its own window from its offset. `order` must be
    unique within the group.
    """
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = df.withColumn("_v", value.cast("long")).withColumn("_b", F.pmod(F.xxhash64(F.col(order)), F.lit(buckets)).cast("int"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.groupBy(*group, "_b").agg(F.sum("_v").alias("_s")).withColumn("_off", F.coalesce(F.sum("_s").over(w), F.lit(0))).drop("_s")
    inner = Window.partitionBy(*group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = part.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    cond = [own[g].eqNullSafe(offsets[g]) for g in [*group, "_b"]]
    joined = own.join(offsets, cond, "left").select(*[own[c] for c in df.columns], (F.col("_in") + F.col("_off")).alias(name))
    return joined


def previous(df: DataFrame, group: str, order: list[str], take: list[str], name: str = "prev", at_least: int = HOT_ROWS) -> DataFrame:
    """df plus `name`: the struct of `take` of the row before in the group's order (null for the first); `order` must be total.

    Without hot groups that is a plain window. With one, rows are split by ranges of (group, order), each range looks
    back within itself, and its first row takes the last row of the range before, of which there are as many as ranges.
    """
    here = F.struct(*take)
    if not hot_keys(df, group, at_least):
        return df.withColumn(name, F.lag(here).over(Window.partitionBy(group).orderBy(*order)))
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = materialise(df.repartitionByRange(n, group, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    own = x.withColumn("_l", F.lag(here).over(Window.partitionBy(group, "_p").orderBy(*order)))
    ends = x.groupBy(group, "_p").agg(F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], here.alias("_t"))).alias("_e"))
    carry = ends.withColumn("_c", F.lag("_e._t").over(Window.partitionBy(group).orderBy("_p"))).filter("_c is not null").select(F.col(group).alias("_g"), "_p", "_c")
    j = own.join(carry, own[group].eqNullSafe(carry["_g"]) & (own["_p"] == carry["_p"]), "left")
    return j.select(*[own[c] for c in df.columns], F.coalesce("_l", "_c").alias(name))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df plus each row's place (from 0) in a total order, without one task seeing all rows: ranges of the order are counted, then each numbers its own."""
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = materialise(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = x.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))  # as many rows as ranges
    own = x.withColumn("_own", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    return own.join(offsets, "_p").select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias(name))
