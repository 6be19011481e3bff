"""Mixing sources to target weights by min-cost flow over membership patterns.

A text that occurs in several sources may be counted to any of them. Texts are put together by the set of sources they
occur in; the tokens of each such pattern flow to the sources' quotas, and every further use of the same tokens costs
more than the last. The flow network has patterns x repetitions edges, whatever the number of documents. Documents are
then laid out along each pattern's tokens in a seeded order and take the uses that the flow gives to their place.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import running_total
from ..session import materialise


class Network:
    """Min-cost flow by successive shortest paths on integers."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, s: int, t: int) -> int:
        total = 0
        while True:
            far, via, queue, inside = {s: 0}, {}, deque([s]), {s}
            while queue:
                x = queue.popleft()
                inside.discard(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] > 0 and far[x] + self.cost[e] < far.get(y, 1 << 62):
                        far[y], via[y] = far[x] + self.cost[e], e
                        if y not in inside:
                            inside.add(y)
                            queue.append(y)
            if t not in far:
                return total
            path, y = [], t
            while y != s:
                path.append(via[y])
                y = self.to[via[y] ^ 1]
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step
            total += step


def members_of(pattern: str) -> list[str]:
    """The sources of a membership pattern, which stand between bars; a bar in a name is written as a unit separator."""
    return [x.replace("\x1f", "|") for x in pattern.split("|")]


def route(patterns: dict[str, int], quotas: dict[str, int], repeats: dict[str, int]) -> tuple[int, dict[str, dict[str, int]]]:
    """(tokens routed, pattern -> source -> tokens). The r-th use of a pattern's tokens costs r * r."""
    names, sources = sorted(patterns), sorted(quotas)
    net = Network(2 + len(names) + len(sources))
    at = {p: 2 + i for i, p in enumerate(names)} | {("s", s): 2 + len(names) + i for i, s in enumerate(sources)}
    edges = {}
    for p in names:
        members = [s for s in members_of(p) if s in quotas]
        for r in range(1, max((repeats[s] for s in members), default=0) + 1):
            net.add(0, at[p], patterns[p], r * r)
        for s in members:
            edges[p, s] = net.add(at[p], at["s", s], patterns[p] * repeats[s])
    for s in sources:
        net.add(at["s", s], 1, quotas[s])
    total = net.flow(0, 1)
    got: dict[str, dict[str, int]] = {}
    for (p, s), e in edges.items():
        if net.room[e ^ 1]:
            got.setdefault(p, {})[s] = net.room[e ^ 1]
    return total, got


def quotas_for(patterns: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens for each source that has any. Without `total`, the most that can be had at the target shares within the repeats."""
    there = {s: w for s, w in shares.items() if w > 0 and any(s in members_of(p) for p in patterns)}
    if not there:
        return {}
    whole = sum(there.values())
    split = lambda t: {s: int(t * w / whole) for s, w in there.items()}
    if total is not None:
        return split(total)
    lo, hi = 0, int(min(sum(n for p, n in patterns.items() if s in members_of(p)) * repeats[s] / (w / whole) for s, w in there.items()))
    if route(patterns, split(hi), repeats)[0] == sum(split(hi).values()):
        return split(hi)
    while hi - lo > max(1, hi // 100_000):
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if route(patterns, split(mid), repeats)[0] == sum(split(mid).values()) else (lo, mid)
    return split(lo)


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen documents, shares). docs: doc_id, source, h (struct of hashes of the text), n_tokens.

    Chosen: (doc_id, source_name, n_repeats, n_tokens). A text that is there several times in one source is one document
    (the lowest id); one in several sources is one that may be counted to each of them, within that source's repeats.
    Documents without tokens, without a source or of a source without a target are not chosen. A target without documents
    gets nothing and the others share its part; targets named twice count with the highest share.
    Shares: (source_name, target_share, actual_share, n_tokens, n_documents, most_repeats, n_copies) of all targets; n_copies
    counts the documents that are copies of another one of their source, and so can't be chosen.
    """
    wanted = {r["source_name"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.filter("source_name is not null").groupBy("source_name").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()}  # the table of targets is small and given
    repeats = {s: r for s, (_, r) in wanted.items()}
    of = docs.filter(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0))
    once = of.groupBy("h", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.count_distinct("doc_id").alias("n"))
    copies = once.groupBy(F.col("source").alias("source_name")).agg(F.sum(F.col("n") - 1).alias("n_copies"))
    texts = once.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("members"), F.max("n_tokens").alias("n_tokens"))
    texts = materialise(texts.select(F.array_join(F.transform("members.source", lambda x: F.replace(x, F.lit("|"), F.lit("\x1f"))), "|").alias("pattern"), "members", "n_tokens", F.concat_ws("-", F.hex(F.xxhash64(F.lit(seed), "h.a")), F.hex("h.a"), F.hex("h.b")).alias("place")), "mix_texts")
    patterns = {r[0]: r[1] for r in texts.groupBy("pattern").agg(F.sum("n_tokens")).collect()}  # at most 2 ^ sources
    quotas = quotas_for(patterns, {s: w for s, (w, _) in wanted.items()}, repeats, total)
    _, flows = route(patterns, quotas, repeats)
    spark, ranges = docs.sparkSession, []
    for p, by in flows.items():  # each source has a stretch of the pattern's uses, laid end to end
        at = 0
        for s in sorted(by):
            ranges.append((p, s, at, at + by[s], patterns[p]))
            at += by[s]
    stretch = F.broadcast(spark.createDataFrame(ranges, "pattern string, source_name string, lo long, hi long, length long"))  # patterns x sources
    placed = running_total(texts, ["pattern"], "place", F.col("n_tokens"), "at")
    # uses k with lo <= at + k * length < hi
    first = F.greatest(F.lit(0), F.ceil((F.col("lo") - F.col("at")) / F.col("length")))
    after = F.greatest(F.lit(0), F.ceil((F.col("hi") - F.col("at")) / F.col("length")))
    used = placed.join(stretch, "pattern").withColumn("n_repeats", (after - first).cast("int")).filter("n_repeats > 0")
    chosen = materialise(used.select(F.filter("members", lambda m: m["source"] == F.col("source_name"))[0]["doc_id"].alias("doc_id"), "source_name", "n_repeats", "n_tokens"), "mix")
    sums = chosen.groupBy("source_name").agg(F.sum(F.col("n_repeats") * F.col("n_tokens")).alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("n_repeats").alias("most_repeats"))
    whole = sums.agg(F.sum("n_tokens").alias("whole"))
    goal = spark.createDataFrame([(s, float(w)) for s, (w, _) in wanted.items()], "source_name string, target_share double")
    shares = goal.join(sums, "source_name", "left").join(copies, "source_name", "left").join(F.broadcast(whole)).select("source_name", "target_share", (F.coalesce("n_tokens", F.lit(0)) / F.col("whole")).alias("actual_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))
    return chosen, shares


def violations(chosen: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """What a right mix has none of, for each target: documents used more often than they may be, of another source, chosen twice, or with other tokens."""
    most = targets.filter("source_name is not null").groupBy("source_name").agg(F.max("max_repeats").alias("most"))
    d = docs.select("doc_id", F.col("source").alias("own"), F.col("n_tokens").alias("size"))
    c = chosen.groupBy("doc_id", "source_name").agg(F.sum("n_repeats").alias("used"), F.count(F.lit(1)).alias("rows"), F.max("n_tokens").alias("n_tokens"))
    j = c.join(d, "doc_id", "left").join(F.broadcast(most), "source_name", "left")  # the table of targets is small and given
    per = j.groupBy("source_name").agg(F.sum((F.col("used") > F.col("most")).cast("long")).alias("n_too_often"), F.sum((~F.col("own").eqNullSafe(F.col("source_name"))).cast("long")).alias("n_foreign"), F.sum((F.col("rows") > 1).cast("long")).alias("n_twice"), F.sum((~F.col("size").eqNullSafe(F.col("n_tokens"))).cast("long")).alias("n_missized"))
    names = ["n_too_often", "n_foreign", "n_twice", "n_missized"]
    return most.select("source_name").join(per, "source_name", "left").select("source_name", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
