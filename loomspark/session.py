"""Session set-up, table access and lineage cutting."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str, str | None]] = []  # (session, path, name of its table)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local runs; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomspark")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir if the cluster names one, else, in local mode only, one made for this run."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_loomspark_dir"):
        spark._loomspark_dir = tempfile.mkdtemp(prefix="loomspark-")
        _MADE.append((spark, spark._loomspark_dir, None))
    return spark._loomspark_dir


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage: write df as a compressed table in the shared folder and read it back.

    The written table survives the loss of executors, and later readers prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark, path, None))
    return spark.read.schema(df.schema).parquet(path)


def colocated(df: DataFrame, by: list[str], label: str = "stage", buckets: int | None = None, split: str | None = None, moved: bool = True, folder: str | None = None, tally: Column | None = None) -> DataFrame:
    """Like materialise, but rows are kept in buckets of `by` (as many as shuffle partitions), so that joins and groups on
    those columns between such tables need no shuffle. `split` names a column whose values get a folder each.

    `moved`: bring the rows to their buckets first, one file a bucket; false for what was joined from such tables. `tally` counts
    the rows that meet a condition as they are written (the attribute `tallied` of what comes back); rows must not be moved then,
    as only the tasks that write count once however often they are tried.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{folder or shared_dir(spark)}/{name}"
    seen = None
    if tally is not None:
        if moved:
            raise ValueError("rows that move can't be tallied")
        seen = Observation()
        df = df.observe(seen, F.count(F.when(tally, 1)).alias("n"))
    w = (df.repartition(n, *by) if moved else df).write.format("parquet").bucketBy(n, *by).sortBy(*by).option("path", path)
    (w.partitionBy(split) if split else w).saveAsTable(name)
    _MADE.append((spark, path, name))
    out = spark.table(name)
    out.made, out.tallied = _MADE[-1], seen.get["n"] if seen is not None else None
    return out


def stored(spark: SparkSession, sf_dir: str, name: str, build):
    """What build() returns, made once a session for a folder of tables as it is now; a changed file makes it anew."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    version = tuple(sorted((s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in fs.listStatus(p)))
    kept = spark.sparkContext.__dict__.setdefault("_loomspark_stored", {})
    if (sf_dir, name) not in kept or kept[sf_dir, name][0] != version:
        kept[sf_dir, name] = (version, build())
    return kept[sf_dir, name][1]


@contextmanager
def joins_in_place(spark: SparkSession):
    """Within, a join whose keys include the columns that both sides are bucketed by needs no shuffle (Spark else asks for all of its keys)."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session: as a zip in the shared folder, for workers that don't have it installed."""
    if getattr(spark.sparkContext, "_loomspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("loomspark", os.path.relpath(p, root)))
    path = f"{shared_dir(spark)}/loomspark-{uuid.uuid4().hex}.zip"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    _MADE.append((spark, path, None))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._loomspark_shipped = True


def drop_materialised(df: DataFrame) -> None:
    """Delete the written tables that df reads; only for intermediates nobody reads any more."""
    made = df.__dict__.get("made")
    if made is not None:
        if made in _MADE:
            _delete(*made)
            _MADE.remove(made)
        return
    folders = {f.rsplit("/", 1)[0] + "/" for f in df.inputFiles()}
    for x in [m for m in _MADE if any(m[1].split("://")[-1].lstrip("/") + "/" in f for f in folders)]:
        _delete(*x)
        _MADE.remove(x)


def _delete(spark: SparkSession, path: str, name: str | None = None) -> None:
    if name:
        spark.sql(f"drop table if exists {name}")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for made in _MADE:
        try:
            if made[0].sparkContext._jsc is not None:
                _delete(*made)
        except Exception:  # the JVM may be gone at exit
            pass


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """All tables of a folder as temporary views; returns their names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName()[:-8] for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return names
