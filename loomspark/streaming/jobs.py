"""Structured Streaming: file streams into tables, deliveries once a session, claims once, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


BUCKETS = 16


def sync(stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: str, interval: str | None = None, buckets: int = BUCKETS):
    """Keep in `target` the newest row of each key, in buckets of the keys' hash. A micro-batch rewrites only the buckets it
    touches, under its batch id, so that a batch that is run again after a failure overwrites its own attempt and nothing is
    counted twice; of what it replaces, the version before stays for such a retry and older ones are deleted."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        from ..operators.state import latest

        b = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        b.persist()
        touched = [r[0] for r in b.select("_bucket").distinct().collect()]  # `buckets` at most
        if touched:
            old = _read(spark, target, {k: v for k, v in _versions(spark, target, batch_id).items() if k in touched})
            rows = b if old is None else b.unionByName(old.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
            latest(rows, keys, [order]).write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/batch={batch_id:012d}")
            _prune(spark, target, batch_id, touched)
        b.unpersist()

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def _folders(spark: SparkSession, target: str):
    """(batch id, bucket) of all complete batches in a synced table."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(target)):
        return fs, path, []
    out = []
    for s in fs.listStatus(path(target)):
        name = s.getPath().getName()
        if name.startswith("batch=") and fs.exists(path(s.getPath(), "_SUCCESS")):
            out += [(int(name[6:]), int(x.getPath().getName()[8:])) for x in fs.listStatus(s.getPath()) if x.getPath().getName().startswith("_bucket=")]
    return fs, path, out


def _versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """bucket -> the newest batch that wrote it."""
    out: dict[int, int] = {}
    for batch, bucket in _folders(spark, target)[2]:
        if before is None or batch < before:
            out[bucket] = max(batch, out.get(bucket, batch))
    return out


def _read(spark: SparkSession, target: str, versions: dict[int, int]) -> DataFrame | None:
    return spark.read.parquet(*[f"{target}/batch={n:012d}/_bucket={k}" for k, n in sorted(versions.items())]) if versions else None


def _prune(spark: SparkSession, target: str, batch_id: int, touched: list[int]) -> None:
    fs, path, have = _folders(spark, target)
    for k in touched:
        old = sorted(b for b, x in have if x == k and b < batch_id)
        for b in old[:-1]:
            fs.delete(path(f"{target}/batch={b:012d}/_bucket={k}"), True)


def newest(spark: SparkSession, target: str) -> DataFrame | None:
    """A synced table as it is now, or None."""
    return _read(spark, target, _versions(spark, target))


def once(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each combination of keys once within the delay: a delivery is not repeated in its session, a claim has one winner (the first that arrives)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, time: str, size: str, delay: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums in event-time windows with a bound on lateness (not in the reference: a Spark extra)."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def run_to_table(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is available into a table in the folder `target`, written by the executors, and read it back."""
    q = stream.writeStream.format("parquet").option("path", target).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def lease(spark: SparkSession, folder: str, owner: str, now: float, stale_s: float = 60.0) -> bool:
    """Take a lease if nobody holds it or its holder's heartbeat is older than `stale_s`.

    Each holder's turn has a number, and taking a turn creates its file, which only one can: of two who find the same lease
    stale the second fails. A holder's own heartbeat takes the next turn too.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    turns = [int(s.getPath().getName()[6:]) for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("lease-")]
    last = max(turns, default=0)
    if last:
        into = fs.open(path(f"{folder}/lease-{last}"))
        held, _, at = bytes(into.readAllBytes()).decode().partition("\n")
        into.close()
        if held != owner and (not at or now - float(at) <= stale_s):
            return False
    try:
        out = fs.create(path(f"{folder}/lease-{last + 1}"), False)
    except Exception:  # somebody was faster
        return False
    out.write(bytearray(f"{owner}\n{now}".encode()))
    out.close()
    for n in turns:
        if n < last:
            fs.delete(path(f"{folder}/lease-{n}"), False)
    return True


def lease(spark: SparkSession, folder: str, owner: str, now: float, stale_s: float = 60.0) -> bool:
    """Take a lease file if nobody holds it or its holder's heartbeat is older than `stale_s`; creating it is atomic in the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/lease")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write() -> bool:
        try:
            out = fs.create(p, False)
        except Exception:  # somebody was faster
            return False
        out.write(bytearray(f"{owner} {now}".encode()))
        out.close()
        return True

    if not fs.exists(p):
        return write()
    held, _, at = spark.read.text(str(p)).first()[0].partition(" ")
    if held == owner or now - float(at) > stale_s:
        fs.delete(p, False)
        return write()
    return False
