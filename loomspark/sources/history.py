"""Commit logs and working-tree states, read from the text that version control prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_target(path: Column) -> Column:
    """The new path of 'a/{old => new}/b' or 'old => new'."""
    inner = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.when(inner.contains(" => "), F.substring_index(inner, " => ", -1)).otherwise(inner), "//+", "/")


def parse_numstat(logs: DataFrame, text_col: str, mark: str = "@") -> DataFrame:
    """(sha, ts, path, added, deleted) of logs printed as '@sha epoch' lines followed by numstat lines, one row a changed file.

    A log is cut at its marks inside one row, so lines keep their commit. Binary files count as changed without churn;
    commits without files (merges) give nothing.
    """
    parts = logs.select(F.explode(F.filter(F.split(text_col, rf"(?m)^{mark}"), lambda x: F.trim(x) != "")).alias("c"))
    head = F.substring_index("c", "\n", 1)
    lines = parts.select(F.substring_index(head, " ", 1).alias("sha"), F.substring_index(head, " ", -1).try_cast("long").alias("epoch"), F.explode(F.split("c", "\n")).alias("line"))
    m = lines.filter(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.+"))
    num = lambda k: F.coalesce(F.regexp_extract("line", r"^(\d+|-)\t(\d+|-)\t(.+)$", k).try_cast("int"), F.lit(0))
    return m.select("sha", F.timestamp_seconds("epoch").alias("ts"), rename_target(F.regexp_extract("line", r"^(\d+|-)\t(\d+|-)\t(.+)$", 3)).alias("path"), num(1).alias("added"), num(2).alias("deleted"))


def parse_status(states: DataFrame, text_col: str) -> DataFrame:
    """(path) of what a NUL-separated porcelain status names; of a rename both sides."""
    e = states.select(F.explode(F.split(text_col, "\x00")).alias("e")).filter("e <> ''")
    coded = F.col("e").rlike(r"^[ MADRCU?!]{2} ")
    return e.select(F.when(coded, F.expr("substring(e, 4)")).otherwise(F.col("e")).alias("path")).distinct()


def changed_since(status: DataFrame, diff: DataFrame | None) -> tuple[DataFrame | None, bool]:
    """(paths, complete): status and the diff since a commit together; without the diff nobody knows, and all has to be read."""
    return (None, False) if diff is None else (status.select("path").unionByName(diff.select("path")).distinct(), True)


def last_touched(commits: DataFrame) -> DataFrame:
    return commits.groupBy("path").agg(F.max("ts").alias("ts"))


def commit_or_null(commit: Column) -> Column:
    """Names of refs are no commits."""
    return F.when(commit.rlike("^[0-9a-f]{7,64}$"), commit)


def shadow_log(lines: DataFrame, col: str) -> DataFrame:
    """(sha, at, author, subject) of unit-separated log lines."""
    p = F.split(col, "\x1f")
    return lines.filter(F.size(p) >= 4).select(*[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(("sha", "at", "author", "subject"))])
