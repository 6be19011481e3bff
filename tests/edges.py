"""Odd versions of the driver's tables for tests: empty, all null, and with repeated rows and further columns."""

import glob
import os

from pyspark.sql import functions as F

CLASHING = ["key", "id_", "kind_", "path_", "size", "depth", "root", "parent", "known", "value", "surface_", "lo", "hi", "n", "block", "state", "slot", "word", "token", "lease", "rank", "rest", "h", "pattern", "place", "_v", "_b", "_k", "_salt"]


def odd_tables(spark, sf, out, how):
    for p in glob.glob(f"{sf}/*.parquet"):
        df = spark.read.parquet(p)
        if how == "empty":
            df = df.limit(0)
        elif how == "null":
            df = df.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        else:  # clashing
            df = df.limit(400).unionByName(df.limit(50))
            df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHING if c not in df.columns])
        df.write.parquet(f"{out}/{os.path.basename(p)}")
    return str(out)
