"""Recorded runs: calling-context trees, hot functions, runtime edges, value histories, run differences, CPU profiles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NODE = "run string, pid long, path array<string>, position int, function string, file string, calls long, total_ms double, self_ms double, errors long"


def flatten(recordings: DataFrame) -> DataFrame:
    """(run, pid, tree JSON) -> one row a node: its path of 'file:function' keys from the root, its place in preorder and its sums.

    Nodes: {file, function, count, total_ms, self_ms, errors, children}. Equal siblings are one node at the first's place.
    Trees are walked with a stack, so their depth is not bound by recursion; an unreadable tree gives no rows.
    """

    def run(batches):
        for b in batches:
            out = []
            for name, pid, text in b.itertuples(index=False, name=None):
                try:
                    root = json.loads(text)
                except (TypeError, ValueError):
                    continue
                stack, place, seen = [(root, ())], 0, {}
                while stack:
                    n, above = stack.pop()
                    path = (*above, f"{n.get('file') or ''}:{n.get('function') or ''}")
                    errors = sum((n.get("errors") or {}).values()) if isinstance(n.get("errors"), dict) else 0
                    row = [n.get("count") or 0, float(n.get("total_ms") or 0), float(n.get("self_ms") or 0), errors]
                    if path in seen:
                        seen[path][1] = [x + y for x, y in zip(seen[path][1], row)]
                    else:
                        seen[path] = [place, row]
                        place += 1
                    stack += [(c, path) for c in reversed(n.get("children") or []) if isinstance(c, dict)]
                out += [(name, pid, list(p), at, p[-1].rsplit(":", 1)[1], p[-1].rsplit(":", 1)[0], *row) for p, (at, row) in seen.items()]
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in NODE.split(", ")])

    return recordings.select("run", F.col("pid").cast("long"), "tree").mapInPandas(run, NODE)


def latest_snapshots(recordings: DataFrame) -> DataFrame:
    """One recording a (run, pid): the final one, else the last snapshot. recordings: run, pid, final boolean, at, tree."""
    return recordings.groupBy("run", "pid").agg(F.max(F.struct("final", "at", "tree")).alias("m")).select("run", "pid", "m.tree")


def hot_functions(nodes: DataFrame) -> DataFrame:
    """Per function calls, self and total time; the total of a recursive call is counted at its outermost frame only. Waiting: much time, little of it own."""
    key = F.element_at("path", -1)
    outer = ~F.array_contains(F.slice("path", F.lit(1), F.size("path") - 1), key)
    return nodes.groupBy("run", key.alias("key")).agg(F.sum("calls").alias("calls"), F.round(F.sum("self_ms"), 6).alias("self_ms"), F.round(F.sum(F.when(outer, F.col("total_ms")).otherwise(0.0)), 6).alias("total_ms"))


def runtime_edges(nodes: DataFrame) -> DataFrame:
    """(run, caller, callee, calls)."""
    return nodes.filter(F.size("path") > 1).groupBy("run", F.element_at("path", -2).alias("caller"), F.element_at("path", -1).alias("callee")).agg(F.sum("calls").alias("calls"))


def check_static(observed: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Observed calls against the static graph: 'known', 'missing' (no such edge) or 'not_indexed'. A class's call is its __init__.

    symbols: symbol_id, key ('file:function'); edges: from_id, to_id.
    """
    s = symbols.groupBy("key").agg(F.min("symbol_id").alias("symbol_id"))
    j = observed.join(s.select(F.col("key").alias("caller"), F.col("symbol_id").alias("from_id")), "caller", "left").join(s.select(F.col("key").alias("callee"), F.col("symbol_id").alias("to_id")), "callee", "left").join(edges.select("from_id", "to_id", F.lit(True).alias("known")).distinct(), ["from_id", "to_id"], "left")
    return j.select("run", "caller", "callee", "calls", F.when(F.col("from_id").isNull() | F.col("to_id").isNull(), "not_indexed").when(F.col("known"), "known").otherwise("missing").alias("state"))


def compare(a: DataFrame, b: DataFrame, least_ms: float = 5.0, ratio: float = 1.25) -> DataFrame:
    """Two runs' trees met on their paths: only_a and only_b (not below a node that is new itself), changed call counts, and times that differ by 5 ms and a quarter."""
    side = lambda df, s: df.select(F.concat_ws("\x1e", "path").alias("p"), F.concat_ws("\x1e", F.slice("path", F.lit(1), F.size("path") - 1)).alias(f"up_{s}"), F.col("calls").alias(f"calls_{s}"), F.col("total_ms").alias(f"ms_{s}"))
    j = side(a, "a").join(side(b, "b"), "p", "full_outer")
    big = F.greatest("ms_a", "ms_b") >= ratio * F.greatest(F.least("ms_a", "ms_b"), F.lit(1e-9))
    state = F.when(F.col("calls_a").isNull(), "only_b").when(F.col("calls_b").isNull(), "only_a").when(F.col("calls_a") != F.col("calls_b"), "calls").when((F.abs(F.col("ms_a") - F.col("ms_b")) >= least_ms) & big, "time").otherwise("same")
    d = j.withColumns({"state": state, "up": F.coalesce("up_a", "up_b")})
    new = d.filter(F.col("state").isin("only_a", "only_b")).select(F.col("p").alias("up"), F.col("state"))
    return d.join(new, ["up", "state"], "left_anti").filter("state <> 'same'").select(F.split("p", "\x1e").alias("path"), "state", "calls_a", "calls_b", "ms_a", "ms_b")


def first_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first node, in the order of calls, that only one run has or that stands elsewhere: (position, path_a, path_b)."""
    j = a.select("position", F.col("path").alias("path_a")).join(b.select("position", F.col("path").alias("path_b")), "position", "full_outer")
    return j.filter(~F.col("path_a").eqNullSafe(F.col("path_b"))).orderBy("position").limit(1)


def value_changes(snapshots: DataFrame, keep: int = 6) -> DataFrame:
    """Values as they change: (call, name, step, value) where a variable's value differs from the one before; the first `keep` of each, and the last."""
    w = Window.partitionBy("call", "name").orderBy("at")
    c = snapshots.withColumn("p", F.lag("value").over(w)).withColumn("n", F.row_number().over(w)).filter((F.col("n") == 1) | ~F.col("value").eqNullSafe(F.col("p")))
    step = F.row_number().over(w)
    last = F.row_number().over(Window.partitionBy("call", "name").orderBy(F.desc("at")))
    return c.withColumns({"step": step, "back": last}).filter((F.col("step") <= keep) | (F.col("back") == 1)).select("call", "name", "step", "at", "value")


def value_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first step at which each variable of a call went another way in the second run: (call, name, step, at, a, b)."""
    j = a.select("call", "name", "step", F.col("at").alias("at_a"), F.col("value").alias("a")).join(b.select("call", "name", "step", F.col("at").alias("at_b"), F.col("value").alias("b")), ["call", "name", "step"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    m = j.groupBy("call", "name").agg(F.min(F.struct("step", F.coalesce("at_a", "at_b").alias("at"), "a", "b")).alias("m"))
    return m.select("call", "name", "m.step", "m.at", "m.a", "m.b")


def exception_chains(events: DataFrame) -> DataFrame:
    """(exception, function, caught): the frames an exception went through; a frame caught it if it does not leave that frame again later.

    events: exception, step, function, kind ('raise', 'reraise', 'escape').
    """
    w = Window.partitionBy("exception", "function").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    later = F.max((F.col("kind") == "escape").cast("int")).over(w)
    return events.withColumn("again", F.coalesce(later, F.lit(0))).filter("kind <> 'escape'").select("exception", "step", "function", (F.col("again") == 0).alias("caught"))


def fold_events(events: DataFrame) -> DataFrame:
    """(pid, thread, path, calls, total, self): a calling-context tree from enter and leave events (seq, at, kind, function) of each thread.

    A leave closes the frames above the one it names; frames that never end close at their thread's last event.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, stack, acc = pdf.sort_values("seq"), [], {}

        def close(at):
            path, began, inner = stack.pop()
            a = acc.setdefault(path, [0, 0.0, 0.0])
            took = at - began
            a[0], a[1], a[2] = a[0] + 1, a[1] + took, a[2] + took - inner
            if stack:
                stack[-1][2] += took

        for kind, fn, at in pdf[["kind", "function", "at"]].itertuples(index=False, name=None):
            if kind == "enter":
                stack.append([(*(stack[-1][0] if stack else ()), fn), at, 0.0])
            elif any(s[0][-1] == fn for s in stack):
                while stack[-1][0][-1] != fn:
                    close(at)
                close(at)
        end = pdf["at"].iloc[-1]
        while stack:
            close(end)
        first = pdf.iloc[0]
        return pd.DataFrame([(int(first["pid"]), int(first["thread"]), list(p), n, t, s) for p, (n, t, s) in acc.items()], columns=["pid", "thread", "path", "calls", "total", "self"])

    return events.select("pid", "thread", "seq", "at", "kind", "function").groupBy("pid", "thread").applyInPandas(lambda pdf: fold(pdf), "pid long, thread long, path array<string>, calls long, total double, self double")


def cpu_profile(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """(function, self_us, total_us) of a sampled profile: a sample's time is the step to the next one; a recursive function's total counts once a path.

    nodes: id, function, children array; samples: i, node_id, delta_us. Ancestors are resolved by the hierarchy operator's doubling.
    """
    from .hierarchy import hierarchy

    dt = samples.select("i", "node_id", F.lead("delta_us").over(Window.orderBy("i")).alias("us")) if "run" not in samples.columns else samples.select("i", "node_id", F.lead("delta_us").over(Window.partitionBy("run").orderBy("i")).alias("us"))
    own = dt.groupBy("node_id").agg(F.sum(F.coalesce("us", F.lit(0))).alias("us"))
    links = nodes.select(F.col("id").cast("string").alias("parent"), F.explode_outer("children").alias("child"))
    tree = nodes.select(F.col("id").cast("string").alias("child")).join(links.filter("child is not null").select(F.col("child").cast("string").alias("child"), "parent"), "child", "left")
    h = hierarchy(tree, "child", "parent").select(F.col("id"), F.split("path", "/").alias("path"))
    j = h.join(own.select(F.col("node_id").cast("string").alias("id"), "us"), "id")
    names = nodes.select(F.col("id").cast("string").alias("nid"), "function")
    on_path = j.select("id", "us", F.explode("path").alias("nid")).join(names, "nid").groupBy("id", "us").agg(F.collect_set("function").alias("fs"))
    total = on_path.select(F.explode("fs").alias("function"), "us").groupBy("function").agg(F.sum("us").alias("total_us"))
    mine = j.join(names.withColumnRenamed("nid", "id"), "id").groupBy("function").agg(F.sum("us").alias("self_us"))
    return total.join(mine, "function", "left").select("function", F.coalesce("self_us", F.lit(0)).alias("self_us"), "total_us")


def tree_totals(nodes: DataFrame) -> DataFrame:
    """(run, calls, nodes): all calls of a run's tree."""
    return nodes.groupBy("run").agg(F.sum("calls").alias("calls"), F.count(F.lit(1)).alias("nodes"))


def library_calls(calls: DataFrame, keep: int = 40) -> DataFrame:
    """(run, node, label, n): calls of library functions (run, node, label, at) under the node that made them; a node keeps the `keep` labels it called first."""
    n = calls.groupBy("run", "node", "label").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy("run", "node").orderBy("first", "label"))).filter(F.col("rn") <= keep).select("run", "node", "label", "n")


def error_events(errors: DataFrame, keep: int = 300) -> DataFrame:
    """The first `keep` errors of each run (run, at, type, ...); exceptions that only end an iteration are none."""
    real = errors.filter(~F.col("type").isin("GeneratorExit", "StopIteration", "StopAsyncIteration"))  # fixed values
    return real.withColumn("rn", F.row_number().over(Window.partitionBy("run").orderBy("at"))).filter(F.col("rn") <= keep).drop("rn")


def costliest_histories(changes: DataFrame, costs: DataFrame, keep: int = 25) -> DataFrame:
    """(run, function, name, trail): how values went in the first call of each of the `keep` functions a run spent longest in.

    changes: run, function, call, at, name, value; costs: run, function, total_ms.
    """
    top = costs.withColumn("rn", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("total_ms"), "function"))).filter(F.col("rn") <= keep).select("run", "function")
    first = changes.groupBy("run", "function").agg(F.min(F.struct("at", "call")).alias("f")).select("run", "function", "f.call")
    own = changes.join(first, ["run", "function", "call"]).join(top, ["run", "function"])
    kept = value_changes(own.select(F.struct("run", "function").alias("call"), "name", "at", "value"))
    return kept.groupBy("call", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda x: x["value"].cast("string")), " -> ").alias("trail")).select("call.run", "call.function", "name", "trail")


def narrative(nodes: DataFrame, top: int = 15, children: int = 8) -> DataFrame:
    """(run, step, path, calls, total_ms, n_children, called): what a run did: its `top` longest activities below the root, and of each the first `children` it called.

    Functions that call themselves come once, as their tree is folded. `n_children` counts all, also those that are not named.
    """
    level = F.size("path")
    acts = nodes.filter(level == 2).withColumn("step", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("total_ms"), "position"))).filter(F.col("step") <= top)
    inner = nodes.filter(level == 3).select("run", F.slice("path", 1, 2).alias("path"), "position", F.element_at("path", -1).alias("callee"))
    ranked = inner.withColumn("rn", F.row_number().over(Window.partitionBy("run", "path").orderBy("position")))
    named = ranked.groupBy("run", "path").agg(F.count(F.lit(1)).alias("n_children"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= children, F.struct("rn", "callee")))), lambda x: x["callee"]), ", ").alias("called"))
    return acts.join(named, ["run", "path"], "left").select("run", "step", F.element_at("path", -1).alias("activity"), "calls", "total_ms", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("called", F.lit("")).alias("called"))


def output_difference(a: DataFrame, b: DataFrame, keep: int = 10) -> DataFrame:
    """(side, at, line): the last `keep` lines (at, line) that only one of two runs printed; repeated lines stay repeated."""
    one = lambda x, y, side: x.join(y.select("line").distinct(), "line", "left_anti").orderBy(F.desc("at")).limit(keep).select(F.lit(side).alias("side"), "at", "line")
    return one(a, b, "only_a").unionByName(one(b, a, "only_b"))


def observed(edges: DataFrame, symbols: DataFrame, runs: int = 3, callers: int = 8) -> DataFrame:
    """(key, run, calls, called_by): for each symbol (key) the newest of the last `runs` recordings that ran it, and who called it there.

    edges: run, caller, callee, calls. A symbol that none of them ran has calls 0 and the newest run; that is no proof it is unreachable.
    """
    last = edges.select("run").distinct().orderBy(F.desc("run")).limit(runs)
    per = edges.join(last, "run").groupBy(F.col("callee").alias("key"), "run").agg(F.sum("calls").alias("calls"), F.slice(F.sort_array(F.collect_set("caller")), 1, callers).alias("called_by"))
    best = per.filter("calls > 0").groupBy("key").agg(F.max(F.struct("run", "calls", "called_by")).alias("b"))
    newest = last.agg(F.max("run").alias("newest"))  # one row
    j = symbols.select("key").distinct().join(best, "key", "left").crossJoin(F.broadcast(newest)).filter("newest is not null")
    return j.select("key", F.coalesce("b.run", "newest").alias("run"), F.coalesce("b.calls", F.lit(0)).alias("calls"), F.coalesce("b.called_by", F.array().cast("array<string>")).alias("called_by"))


def run_list(recordings: DataFrame) -> DataFrame:
    """(run, started, n_files): the runs of a folder's recordings (path = .../run/file), newest name last."""
    parts = F.split("path", "/")
    return recordings.select(F.element_at(parts, -2).alias("run"), "modified").groupBy("run").agg(F.min("modified").alias("started"), F.count(F.lit(1)).alias("n_files"))
