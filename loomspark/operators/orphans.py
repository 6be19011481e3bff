"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from .scale import skew_join


PLAIN_TIME = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"


def plain_time(c: Column | str) -> Column:
    """The instant of a time in the plain UTC form; null for all other forms and impossible times."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(PLAIN_TIME), F.try_to_timestamp(c))


def parent_intervals(parents: list[tuple[str, DataFrame, str, str]], tombstones: DataFrame) -> DataFrame:
    """(kind, key, valid_from, valid_to): when each record was there.

    parents: kind, table, key column, column of the creation time. A key in several rows is valid from the earliest
    time that can be read; valid_to is the earliest deletion, null without one. A deletion whose time is null still ends
    the interval: it is then taken as the beginning of time.
    """
    rows = None
    for kind, df, key, since in parents:
        one = df.select(F.lit(kind).alias("kind"), norm_key(key).alias("key"), plain_time(since).alias("valid_from")).filter(F.col("key").isNotNull())
        rows = one if rows is None else rows.unionByName(one)
    alive = rows.groupBy("kind", "key").agg(F.min("valid_from").alias("valid_from"))
    dead = tombstones.select(F.lower(F.trim("record_kind")).alias("kind"), norm_key("record_key").alias("key"), F.coalesce(plain_time("deleted_at"), F.timestamp_seconds(F.lit(0))).alias("valid_to")).groupBy("kind", "key").agg(F.min("valid_to").alias("valid_to"))
    return alive.join(dead, ["kind", "key"], "left")


def reference_rows(refs: list[tuple[str, DataFrame, str, str, str, Column]]) -> DataFrame:
    """(table_name, row_key, kind, key, at) of all rows whose reference is not null. refs: table, rows, row key, reference column, kind, time."""
    rows = None
    for name, df, row_key, ref, kind, at in refs:
        one = df.filter(F.col(ref).isNotNull()).select(F.lit(name).alias("table_name"), F.col(row_key).cast("string").alias("row_key"), F.lit(kind).alias("kind"), norm_key(ref).alias("key"), at.alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def classify(refs: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds state: 'missing', 'deleted', 'late' (the record came after the row that names it) or 'good'.

    References and keys meet in one sort-merge join on (kind, key): both streams are partitioned alike, sorted and
    merged. References to one hot key are split over many tasks.
    """
    a = refs.withColumn("_k", F.concat_ws("|", "kind", "key"))
    b = intervals.select(F.concat_ws("|", "kind", "key").alias("_k"), F.lit(True).alias("_there"), "valid_from", "valid_to").hint("merge")
    j = skew_join(a, b, "_k", F.concat_ws("|", F.col("table_name"), F.coalesce("row_key", F.lit(""))), "left")
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("valid_to").isNotNull(), "deleted").when(F.col("at") < F.col("valid_from"), "late").otherwise("good")
    return j.select("table_name", "row_key", "kind", "key", "at", state.alias("state"))


def broken_references(classified: DataFrame) -> DataFrame:
    """(table_name, row_key, missing_key), each once: the references that are missing or deleted. Repeated rows count once."""
    return classified.filter(F.col("state").isin("missing", "deleted")).select("table_name", "row_key", F.col("key").alias("missing_key")).distinct()


def monthly_report(classified: DataFrame) -> DataFrame:
    """Rows per table, month of the row ('unknown' where its time can't be read) and state other than good."""
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    return classified.filter("state <> 'good'").groupBy("table_name", month.alias("month"), "state").agg(F.countDistinct("row_key", "key").alias("n_rows"))
