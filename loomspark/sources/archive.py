"""An archive of growing files: append where the old beginning is proven unchanged, else rotate, and keep what was deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def archive_key(provider: Column, surface: Column, identity: Column) -> Column:
    return F.concat(provider, F.lit("/"), F.substr(F.sha2(F.concat_ws("\x1f", provider, surface, identity), 256), F.lit(1), F.lit(24)))


def prefix_hash(content: Column, length: Column) -> Column:
    """sha256 of the first `length` bytes: of all that was archived, so that a change anywhere in it is seen."""
    return F.sha2(F.substring(content, F.lit(1), length.cast("int")), 256)


def sync(archive: DataFrame, live: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """What to do with each file: (key, action, generation, bytes, content, live_missing).

    archive: key, generation, bytes, prefix_hash, content (the newest generation of each key). live: key, content. An equal
    file is 'kept'; a file that begins with the archived bytes is 'appended'; another is 'rotated' into the next
    generation; new ones are 'added'; archived ones without a live file stay as 'missing'. Keys with a tombstone (key, mode)
    are not archived.
    """
    if tombstones is not None:
        live = live.join(tombstones.select("key").distinct(), "key", "left_anti")
    old = archive.select("key", "generation", F.col("bytes").alias("had"), F.col("prefix_hash").alias("old_hash"), F.col("content").alias("old_content"))
    j = live.select("key", F.col("content").alias("new")).join(old, "key", "full_outer").withColumn("size", F.octet_length("new").cast("long"))
    same = (F.col("size") >= F.col("had")) & (prefix_hash(F.col("new"), F.coalesce("had", F.lit(0))) == F.col("old_hash"))
    action = F.when(F.col("new").isNull(), "missing").when(F.col("had").isNull(), "added").when(same & (F.col("size") == F.col("had")), "kept").when(same, "appended").otherwise("rotated")
    out = j.withColumn("action", action)
    gone = F.col("action") == "missing"
    return out.select("key", "action", F.when(F.col("action") == "rotated", F.col("generation") + 1).otherwise(F.coalesce("generation", F.lit(1))).alias("generation"), F.when(gone, F.col("had")).otherwise(F.col("size")).alias("bytes"), F.when(gone, F.col("old_content")).otherwise(F.col("new")).alias("content"), gone.alias("live_missing"))


def next_archive(synced: DataFrame) -> DataFrame:
    return synced.select("key", "generation", "bytes", prefix_hash(F.col("content"), F.col("bytes")).alias("prefix_hash"), "content")


def prune(versions: DataFrame, keep: int) -> DataFrame:
    """The generations (key, generation) to delete: all but the newest `keep` of each key."""
    rn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("generation")))
    return versions.withColumn("rn", rn).filter(F.col("rn") > keep).drop("rn")


def archived_sources(versions: DataFrame, live: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """(key, generation, origin, live_path) of the archived copies as sources: 'archive' (its live file is there), 'archive_only' (it is
    gone) or 'archive_version' (an older generation, a session of its own, without a live path).

    versions: key, generation, live_path; live: path. Keys or live paths with a tombstone (target, mode 'exclude_all') give none, and
    of several keys with one live path the first one counts.
    """
    if tombstones is not None:
        out = tombstones.filter("mode = 'exclude_all'").select(F.lower("target").alias("_t")).distinct()
        versions = versions.join(out, F.lower("key") == F.col("_t"), "left_anti").join(out, F.lower("live_path") == F.col("_t"), "left_anti")
    newest = versions.groupBy("key").agg(F.max("generation").alias("newest"))
    owner = versions.groupBy("live_path").agg(F.min("key").alias("owner"))
    v = versions.join(newest, "key").join(owner, "live_path").join(live.select(F.col("path").alias("live_path"), F.lit(True).alias("there")).distinct(), "live_path", "left")
    old = F.col("generation") < F.col("newest")
    kept = v.filter(old | (F.col("key") == F.col("owner")))
    return kept.select("key", "generation", F.when(old, "archive_version").when(F.col("there"), "archive").otherwise("archive_only").alias("origin"), F.when(~old, F.col("live_path")).alias("live_path"))
