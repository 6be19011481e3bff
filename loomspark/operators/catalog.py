"""Repositories and their relations, reference resolution, deliveries, handoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import SEVERITY_ORDER, rank_of


def normal_remote(url: Column) -> Column:
    """'host/path' of a remote, whatever its protocol, user, port or ending."""
    u = F.lower(F.trim(url))
    u = F.regexp_replace(u, r"^[a-z+]+://", "")
    u = F.regexp_replace(u, r"^[^@/]*@", "")
    u = F.regexp_replace(u, r"^([^/:]+):(\d+)/", "$1/")
    u = F.regexp_replace(u, r"^([^/:]+):", "$1/")
    return F.regexp_replace(F.regexp_replace(u, r"/+$", ""), r"\.git$", "")


def identify(aliases: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, repo_id): the repository that shares the heaviest alias with a probe. aliases: repo_id, alias, weight; probes: probe_id, alias."""
    m = probes.join(aliases, "alias")
    return m.groupBy("probe_id").agg(F.max(F.struct("weight", "repo_id")).alias("m")).select("probe_id", "m.repo_id")


def forks(probes: DataFrame, repos: DataFrame) -> DataFrame:
    """Probes (probe_id, root_commit, path, remotes array) that look like a fork: a repository with the same root commit, none of its remotes, another path."""
    r = repos.select("repo_id", "root_commit", F.col("remotes").alias("known"), F.col("paths").alias("seen"))
    j = probes.join(r, "root_commit").filter((F.size("remotes") > 0) & (F.size("known") > 0) & ~F.arrays_overlap("remotes", "known") & ~F.array_contains("seen", F.col("path")))
    return j.select("probe_id", "repo_id")


def lifecycle(repos: DataFrame, present: DataFrame) -> DataFrame:
    """Repository states after a look at the disk: active ones without a present checkout are missing, missing ones with one are active again. present: repo_id."""
    p = present.select("repo_id").distinct().withColumn("there", F.lit(True))
    j = repos.join(p, "repo_id", "left")
    s = F.when((F.col("status") == "ACTIVE") & F.col("there").isNull(), "MISSING").when(F.col("status").isin("MISSING", "OFFLINE") & F.col("there"), "ACTIVE").otherwise(F.col("status"))
    return j.select("repo_id", F.col("status").alias("was"), s.alias("status"))


def resolve_names(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, symbol_id, confidence, n): a reference is a symbol's path, its unique name, the end of its path, its name in lower case, or its name without separators.

    The first way that gives candidates holds; n > 1 says that it is ambiguous, and then there is no symbol_id.
    """
    squash = lambda c: F.regexp_replace(F.lower(c), "[-_. ]", "")
    dot = F.regexp_replace(F.col("symbol_path"), r"^.*\.([^.]+\.[^.]+)$", "$1")
    ways = [(0, 1.0, F.col("symbol_path"), F.col("ref")), (1, 0.95, F.col("name"), F.col("ref")), (2, 0.6, dot, F.col("ref")), (3, 0.55, F.lower("name"), F.lower("ref")), (4, 0.5, squash(F.col("name")), squash(F.col("ref")))]
    out = None
    for i, conf, a, b in ways:
        x = refs.select("ref", b.alias("k")).join(symbols.select(a.alias("k"), "symbol_id"), "k").select("ref", F.lit(i).alias("way"), F.lit(conf).alias("confidence"), "symbol_id")
        out = x if out is None else out.unionByName(x)
    g = out.groupBy("ref", "way", "confidence").agg(F.count_distinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"))
    best = g.groupBy("ref").agg(F.min(F.struct("way", "confidence", "n", "symbol_id")).alias("b"))
    return best.select("ref", F.when(F.col("b.n") == 1, F.col("b.symbol_id")).alias("symbol_id"), "b.confidence", "b.n")


def cross_edges(edges: DataFrame, repos: DataFrame) -> DataFrame:
    """Edges to other repositories with the target's state: 'reachable', 'unreachable' (known, not active) or 'unknown'; none is dropped."""
    r = repos.select(F.col("repo_id").alias("to_repo"), F.col("status").alias("s"))
    return edges.join(r, "to_repo", "left").select(*edges.columns, F.when(F.col("s").isNull(), "unknown").when(F.col("s") == "ACTIVE", "reachable").otherwise("unreachable").alias("reach"))


def heal_pending(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pending edges (edge_id, to_ref, status) whose reference is by now an alias of one repository are resolved."""
    a = aliases.groupBy("alias").agg(F.count_distinct("repo_id").alias("n"), F.min("repo_id").alias("repo_id")).filter("n = 1").select(F.col("alias").alias("to_ref"), "repo_id")
    j = edges.join(a, "to_ref", "left")
    ok = (F.col("status") == "PENDING") & F.col("repo_id").isNotNull()
    return j.select("edge_id", "to_ref", F.when(ok, "ACTIVE").otherwise(F.col("status")).alias("status"), F.when(ok, F.col("repo_id")).alias("to_repo"))


def deliver(memories: DataFrame, anchors: DataFrame, touched: DataFrame, delivered: DataFrame, budget: int = 2000, most: int = 4) -> DataFrame:
    """(session_id, memory_id): what a session that touches files is told: trusted memories anchored in the touched lines, not told before, worst first, within the budget and at most `most`.

    memories: memory_id, claim, severity, confidence, helpful, unhelpful, evidence; anchors: memory_id, file_path, lo, hi;
    touched: session_id, file_path, lo, hi (null: anywhere); delivered: session_id, memory_id.
    """
    withheld = (F.col("confidence") < 0.4) | ((F.col("unhelpful") >= 2) & (F.col("unhelpful") > 2 * F.col("helpful")))
    t = touched.select("session_id", "file_path", F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    meets = F.col("lo").isNull() | F.col("tlo").isNull() | ((F.col("lo") <= F.col("thi")) & (F.col("hi") >= F.col("tlo")))
    c = anchors.join(t, "file_path").filter(meets).select("session_id", "memory_id").distinct().join(memories.filter(~withheld), "memory_id").join(delivered, ["session_id", "memory_id"], "left_anti")
    order = [F.coalesce(rank_of(SEVERITY_ORDER, F.col("severity")), F.lit(9)), F.desc("evidence"), F.col("memory_id")]
    w = Window.partitionBy("session_id").orderBy(*order)
    top = c.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    return top.withColumn("run", F.sum(F.length("claim")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("run") <= budget).select("session_id", "memory_id", "rn")


def claim_handoff(handoffs: DataFrame, by: str) -> DataFrame:
    """The handoffs after `by` took the newest open one. handoffs: handoff_id, status, created_at, claimed_by."""
    one = handoffs.filter("status = 'OPEN'").agg(F.max(F.struct("created_at", "handoff_id")).alias("m")).select("m.handoff_id").filter("handoff_id is not null").withColumn("take", F.lit(True))
    j = handoffs.join(F.broadcast(one), "handoff_id", "left")  # one row
    return j.select("handoff_id", F.when(F.col("take"), "CLAIMED").otherwise(F.col("status")).alias("status"), "created_at", F.when(F.col("take"), F.lit(by)).otherwise(F.col("claimed_by")).alias("claimed_by"))


def areas(communities: DataFrame, symbols: DataFrame, members: int = 8) -> DataFrame:
    """(community, n, test_share, top_dir, top_file, members): what an area is made of. communities: id, community; symbols: id, name, path."""
    j = communities.join(symbols, "id").withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))

    def top(c: str) -> DataFrame:
        n = j.groupBy("community", c).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("community").agg(F.max(F.struct("n", c)).alias("m")).select("community", F.col(f"m.{c}").alias(f"top_{c}"))

    base = j.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.avg(F.lower("path").rlike("test|spec").cast("double")).alias("test_share"))
    names = j.withColumn("rn", F.row_number().over(Window.partitionBy("community").orderBy("name", "id"))).filter(F.col("rn") <= members).groupBy("community").agg(F.array_sort(F.collect_list("name")).alias("members"))
    return base.join(top("dir"), "community").join(top("path").withColumnRenamed("top_path", "top_file"), "community").join(names, "community")


def area_calls(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(a, b, n): calls between different areas, whatever their direction."""
    e = edges.join(communities.select(F.col("id").alias("from_id"), F.col("community").alias("x")), "from_id").join(communities.select(F.col("id").alias("to_id"), F.col("community").alias("y")), "to_id").filter("x <> y")
    return e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def derived_edges(edges: DataFrame, anchored: DataFrame, symbols: DataFrame, limit: int = 12) -> DataFrame:
    """Callers of an anchored symbol become IMPACTS (0.6), tests among them GUARDED_BY (0.75); at most `limit` a memory. anchored: memory_id, symbol_id."""
    j = anchored.join(edges.select(F.col("to_id").alias("symbol_id"), F.col("from_id").alias("caller")), "symbol_id").join(symbols.select(F.col("symbol_id").alias("caller"), "name", "path"), "caller")
    test = F.col("name").startswith("test_") | F.lower("path").contains("test")
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("memory_id").orderBy("caller"))).filter(F.col("rn") <= limit).select("memory_id", "caller", F.when(test, "GUARDED_BY").otherwise("IMPACTS").alias("kind"), F.when(test, 0.75).otherwise(0.6).alias("confidence"))


def near_lines(observed: DataFrame, symbols: DataFrame, reach: int = 3) -> DataFrame:
    """(observed rows, symbol_id): the symbol of that path whose name and line (within `reach`) fit, else the one of that symbol path. The lines around are spread out and met by equality."""
    o = observed.withColumn("_o", F.xxhash64(*observed.columns))
    a = o.withColumn("line_start", F.explode(F.sequence(F.col("line") - reach, F.col("line") + reach))).join(symbols.select("path", "name", "line_start", "symbol_id"), ["path", "name", "line_start"]).select("_o", F.struct(F.lit(1).alias("w"), F.abs(F.col("line") - F.col("line_start")).alias("d"), "symbol_id").alias("c"))
    b = o.join(symbols.select("path", F.col("symbol_path").alias("qualified"), "symbol_id"), ["path", "qualified"]).select("_o", F.struct(F.lit(0).alias("w"), F.lit(0).alias("d"), "symbol_id").alias("c"))
    best = a.unionByName(b).groupBy("_o").agg(F.min("c").alias("c"))
    return o.join(best, "_o", "left").select(*observed.columns, F.col("c.symbol_id").alias("symbol_id"))
