"""The experiment lab: run metrics, states, verdicts, frozen code, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from .state import latest

TERMINAL = ("done", "failed", "cancelled", "timeout", "lost")


def metrics_of_log(text: Column, mark: str = "METRIC") -> Column:
    """map<name, value> of the lines 'MARK name=value' of a log; the last value of a name holds."""
    found = F.regexp_extract_all(text, F.lit(rf"(?m)^\s*{mark}\s+([\w.-]+\s*=\s*-?[0-9.]+(?:[eE][-+]?\d+)?)\s*$"), 1)
    pairs = F.transform(found, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring_index(x, "=", -1)).try_cast("double").alias("v")))
    kept = F.filter(pairs, lambda p: p["v"].isNotNull())
    names = F.array_distinct(F.transform(kept, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(kept, lambda p: p["k"] == n), -1)["v"]))


def log_slice(content: Column, tail: int | None = None, offset: int | None = None, size: int = 4096) -> Column:
    """A byte range of a log: from `offset`, or its last `tail` bytes."""
    n = F.octet_length(content)
    if offset is not None:
        return content.substr(F.lit(offset + 1), F.lit(size))
    return content.substr(F.greatest(n - (tail or size), F.lit(0)) + 1, n)


def run_view(runs: DataFrame) -> DataFrame:
    """One row a run, the newest of repeated ones: keys in normal form, metrics as a map, duration, whether it has ended."""
    r = runs.select(norm_key("run_id").alias("run_id"), norm_key("exp_id").alias("exp_id"), "status", "verdict", "exit_code", "answered", "commit_sha", "command", F.try_to_timestamp("started_at").alias("started"), F.try_to_timestamp("ended_at").alias("ended"), "metrics").filter("run_id is not null")
    one = latest(r, ["run_id"], ["ended", "started"])
    m = F.from_json("metrics", "map<string,double>")
    return one.withColumns({"metrics": m, "duration_s": F.when(F.col("ended") >= F.col("started"), (F.unix_millis("ended") - F.unix_millis("started")) / 1000), "terminal": F.col("status").isin(*TERMINAL)})


def refresh_state(runs: DataFrame, as_of, stale_s: float = 45.0) -> DataFrame:
    """A run that says it runs is lost once its heartbeat is older than `stale_s`; an exit code that came late overrides that. runs: run_id, status, heartbeat timestamp, exit_code."""
    old = F.unix_millis(F.lit(as_of).cast("timestamp")) - F.unix_millis("heartbeat") > stale_s * 1000
    return runs.withColumn("status", F.when(F.col("exit_code").isNotNull() & F.col("status").isin("running", "lost"), F.when(F.col("exit_code") == 0, "done").otherwise("failed")).when((F.col("status") == "running") & old, "lost").otherwise(F.col("status")))


def frozen_by(view: DataFrame) -> DataFrame:
    """(exp_id, run_id, commit_sha): the first answered run of each experiment, which freezes its code."""
    return view.filter("answered = 1 and exp_id is not null").groupBy("exp_id").agg(F.min(F.struct("started", "run_id", "commit_sha")).alias("m")).select("exp_id", "m.run_id", "m.commit_sha")


def summary(view: DataFrame) -> DataFrame:
    """Per experiment: runs, verdicts, answered ones, the newest unjudged run."""
    v = lambda x: F.sum(F.when(F.col("verdict") == x, 1).otherwise(0)).alias(x)
    open_ = F.when(F.col("verdict").isNull() & F.col("terminal"), F.struct("started", "run_id"))
    return view.filter("exp_id is not null").groupBy("exp_id").agg(F.count(F.lit(1)).alias("n_runs"), v("win"), v("loss"), v("inconclusive"), F.sum(F.coalesce("answered", F.lit(0))).alias("n_answered"), F.max(open_).alias("o")).withColumn("unjudged", F.col("o.run_id")).drop("o")


def evidence(view: DataFrame, links: DataFrame) -> DataFrame:
    """Sentences of evidence for the ended runs that memories rest on. links: memory_id, run_id."""
    m = F.array_join(F.transform(F.array_sort(F.map_entries("metrics")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4g", e["value"]))), ", ")
    s = F.concat(F.lit("run "), "run_id", F.lit(" "), "status", F.when(F.size("metrics") > 0, F.concat(F.lit(": "), m)).otherwise(F.lit("")), F.when(F.col("verdict").isNotNull(), F.concat(F.lit(", judged "), "verdict")).otherwise(F.lit("")))
    return links.select("memory_id", norm_key("run_id").alias("run_id")).distinct().join(view.filter("terminal"), "run_id").select("memory_id", "run_id", s.alias("sentence"))
