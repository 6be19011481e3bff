"""State on tables: upserts, reconciliation, monotone trust, versions, streaks, latest rows, prefix joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import previous

# How far an anchor's state may be trusted, best first.
ANCHOR_RANK = ["ACTIVE", "DRIFTED", "NEEDS_REVIEW", "ORPHANED", "RESOLVED", "SUPERSEDED"]
EXPORT_RANK = ["ACTIVE", "SUPERSEDED", "DRIFTED", "NEEDS_REVIEW", "RESOLVED", "ORPHANED"]
STALE_PENALTY = {"ACTIVE": 0.0, "DRIFTED": 0.35, "NEEDS_REVIEW": 0.5, "ORPHANED": 0.7, "SUPERSEDED": 1.2, "RESOLVED": 0.9}
SEVERITY = {"critical": 1.0, "high": 0.75, "medium": 0.45, "low": 0.2}
SEVERITY_ORDER = ["critical", "high", "medium", "low"]


def lookup(values: dict, key: Column, default=None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    v = F.element_at(m, key)
    return v if default is None else F.coalesce(v, F.lit(default))


def rank_of(order: list[str], value: Column) -> Column:
    """The place of a value in an order, from 0; null for others."""
    return lookup({v: i for i, v in enumerate(order)}, value)


def worst(order: list[str], value: Column) -> Column:
    """Aggregate: the worst of the values by an order, best first; null if none is known."""
    return F.get(F.array(*[F.lit(v) for v in order]), F.max(rank_of(order, value)))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of `new` put in place of those with equal keys; of several new rows with one key the greatest holds."""
    rest = [c for c in stored.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return stored.join(one, keys, "left_anti").unionByName(one.select(*stored.columns))


def replace_owned(stored: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All rows of each owner that `new` names give way to its new rows."""
    return stored.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the greatest by the order columns, then by all others."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    r = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return r.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def reconcile(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored rows keep their identity through a new extraction of one file's symbols.

    stored: symbol_id, file_id, content_fp, symbol_path, skeleton_fp, name; seen: the same without symbol_id. A seen row
    takes the id of a stored row of its file with equal content, else with equal path, else with equal skeleton and name,
    each stored row once (pairs are settled in the order of their ids and paths). Result: symbol_id (null for new ones),
    the seen columns, state 'kept', 'new' or 'deleted'.
    """
    s = stored.withColumn("_sid", F.col("symbol_id"))
    left = seen.withColumn("_k", F.concat_ws("|", "file_id", "symbol_path"))
    pairs = None
    for on in (["content_fp"], ["symbol_path"], ["skeleton_fp", "name"]):
        a = left if pairs is None else left.join(pairs, "_k", "left_anti")
        b = s if pairs is None else s.join(pairs, "_sid", "left_anti")
        g = ["file_id", *on]
        # the n-th seen row with a key takes the n-th stored row with it
        ra = a.select(*g, "_k", F.row_number().over(Window.partitionBy(*g).orderBy("_k")).alias("_n"))
        rb = b.select(*g, "_sid", F.row_number().over(Window.partitionBy(*g).orderBy("symbol_path", "_sid")).alias("_n"))
        p = ra.join(rb, [*g, "_n"]).select("_k", "_sid")
        pairs = p if pairs is None else pairs.unionByName(p)
    kept = left.join(pairs, "_k", "left").select(F.col("_sid").alias("symbol_id"), *seen.columns, F.when(F.col("_sid").isNull(), "new").otherwise("kept").alias("state"))
    gone = s.join(pairs, "_sid", "left_anti").select("symbol_id", *seen.columns, F.lit("deleted").alias("state"))
    return kept.unionByName(gone)


def anchor_cascade(anchors: DataFrame, symbols: DataFrame, similar: DataFrame) -> DataFrame:
    """Each anchor's state after a new extraction: (anchor_id, status, confidence, transition, symbol_id).

    anchors: anchor_id, symbol_path, file_path, content_fp, skeleton_fp, status. symbols: symbol_id, symbol_path,
    file_path, content_fp, skeleton_fp. similar: anchor_id, symbol_id, score, the best candidates elsewhere. The steps: same
    content at the same place, same content elsewhere, same skeleton at the same place, same place, a candidate alike by
    at least 0.7, none. Trust is monotone: a state never gets better by itself.
    """
    place = symbols.groupBy("file_path", "symbol_path").agg(F.min(F.struct("symbol_id", "content_fp", "skeleton_fp")).alias("p"))
    same = symbols.filter("content_fp is not null").groupBy("content_fp").agg(F.min("symbol_id").alias("c_id"))
    cand = similar.groupBy("anchor_id").agg(F.max(F.struct("score", "symbol_id")).alias("s"))
    j = anchors.join(place, ["file_path", "symbol_path"], "left").join(same, "content_fp", "left").join(cand, "anchor_id", "left")
    here, fp = F.col("p").isNotNull(), F.col("content_fp")
    score = F.col("s.score")
    steps = [
        (here & (F.col("p.content_fp") == fp), "ACTIVE", F.lit(1.0), "unchanged", F.col("p.symbol_id")),
        (F.col("c_id").isNotNull(), "ACTIVE", F.lit(0.9), "moved", F.col("c_id")),
        (here & (F.col("p.skeleton_fp") == F.col("skeleton_fp")), "ACTIVE", F.lit(0.8), "renamed_internals", F.col("p.symbol_id")),
        (here, "NEEDS_REVIEW", F.lit(0.55), "body_changed", F.col("p.symbol_id")),
        (score >= 0.7, "DRIFTED", F.least(F.lit(0.85), F.greatest(F.lit(0.7), score)), "migrated", F.col("s.symbol_id")),
    ]

    def pick(i: int, other):
        out = F.when(steps[0][0], steps[0][i] if isinstance(steps[0][i], Column) else F.lit(steps[0][i]))
        for st in steps[1:]:
            out = out.when(st[0], st[i] if isinstance(st[i], Column) else F.lit(st[i]))
        return out.otherwise(other)

    found, old = pick(1, F.lit("ORPHANED")), F.col("status")
    worse = F.coalesce(rank_of(ANCHOR_RANK, old), F.lit(0)) > rank_of(ANCHOR_RANK, found)
    conf = pick(2, F.lit(0.0))
    t = pick(3, F.lit("orphaned"))
    return j.select("anchor_id", F.when(worse, old).otherwise(found).alias("status"), F.when(worse, F.least(conf, F.coalesce("confidence", conf)) if "confidence" in anchors.columns else conf).otherwise(conf).alias("confidence"), F.when(worse, F.concat(t, F.lit("_unverified"))).otherwise(t).alias("transition"), pick(4, F.lit(None)).alias("symbol_id"))


def versions(changes: DataFrame, key: str, at: str, cols: list[str], tie: list[str]) -> DataFrame:
    """Slowly changing dimension: one row for each stretch in which the columns did not change, with valid_from, valid_until (null for the last) and version.

    Looking back goes through `scale.previous`, so a key with very many changes is no problem; what is left to number
    are the stretches.
    """
    w = Window.partitionBy(key).orderBy(at, *tie)
    x = previous(changes, key, [at, *tie], [*cols, at], "_prev")
    same = F.col("_prev").isNotNull()
    for c in cols:
        same = same & F.col(f"_prev.{c}").eqNullSafe(F.col(c))
    starts = x.filter(~same)
    return starts.select(key, *cols, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_until"), F.row_number().over(w).alias("version"))


def leading_streak(df: DataFrame, group: list[str], order: list[Column], bad: Column, skip: Column) -> DataFrame:
    """(group, streak): how many rows in a row, from the first in the order, are bad; rows to skip neither count nor break."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.filter(~skip).withColumn("_good", F.sum((~bad).cast("int")).over(w))
    return x.groupBy(*group).agg(F.sum((F.col("_good") == 0).cast("long")).alias("streak"))


def push_history(history: Column, entry: Column, keep: int = 25) -> Column:
    """A ring buffer of transitions: an 'unchanged' that follows an 'unchanged' only counts up its repeats."""
    last = F.element_at(history, -1)
    again = (F.size(history) > 0) & (last["transition"] == "unchanged") & (entry["transition"] == "unchanged")
    bumped = F.concat(F.slice(history, F.lit(1), F.greatest(F.size(history) - 1, F.lit(0))), F.array(F.struct(last["at"].alias("at"), last["transition"].alias("transition"), (last["repeats"] + 1).alias("repeats"))))
    pushed = F.concat(history, F.array(entry))
    out = F.when(again, bumped).otherwise(pushed)
    return F.slice(out, F.greatest(F.size(out) - keep + 1, F.lit(1)), F.lit(keep))


def longest_prefix(rows: DataFrame, path_col: str, roots: DataFrame, root_col: str) -> DataFrame:
    """rows joined with the longest root that contains their path: a path's ancestors are spread out and met by equality."""
    parts = F.split(F.col(path_col), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    x = rows.withColumn("_id", F.xxhash64(*rows.columns)).withColumn("_root", F.explode(ups))
    best = x.join(roots.withColumnRenamed(root_col, "_root"), "_root").groupBy("_id", *rows.columns).agg(F.max_by(F.struct("_root", *[c for c in roots.columns if c != root_col]), F.length("_root")).alias("_b"))
    return best.select(*rows.columns, F.col("_b._root").alias(root_col), *[F.col(f"_b.{c}").alias(c) for c in roots.columns if c != root_col])


def vote(memories: DataFrame, votes: DataFrame) -> DataFrame:
    """Feedback: counts of helpful and unhelpful signals a memory; more unhelpful than helpful ones (two at least) cap its confidence at 0.4."""
    v = votes.groupBy("memory_id").agg(F.sum((F.col("signal") == "helpful").cast("long")).alias("h"), F.sum((F.col("signal") == "unhelpful").cast("long")).alias("u"))
    j = memories.join(v, "memory_id", "left").withColumns({"helpful_count": F.col("helpful_count") + F.coalesce("h", F.lit(0)), "unhelpful_count": F.col("unhelpful_count") + F.coalesce("u", F.lit(0))})
    low = (F.col("unhelpful_count") >= 2) & (F.col("unhelpful_count") > F.col("helpful_count"))
    return j.withColumn("confidence", F.when(low, F.least("confidence", F.lit(0.4))).otherwise(F.col("confidence"))).drop("h", "u")


def usage_boost(opened: Column, surfaced: Column, helpful: Column, unhelpful: Column, days: Column, half_life: float = 45.0) -> Column:
    """What a memory's use lifts it by: log of opens, impressions and votes, halved every `half_life` days, at most 0.5; votes against it take away at most 0.3."""
    used = (opened > 0) | (surfaced > 0) | (helpful > 0)
    lift = F.least(F.lit(0.5), 0.18 * F.log1p(4 * opened + 0.35 * surfaced + 6 * helpful) * F.pow(F.lit(0.5), F.coalesce(F.greatest(F.lit(0.0), days), F.lit(0.0)) / half_life))
    return F.when(used, lift).otherwise(0.0) - F.least(F.lit(0.3), 0.1 * unhelpful)


def recency(days: Column) -> Column:
    return F.when(days.isNull(), 0.0).otherwise(1 / (1 + F.greatest(F.lit(0.0), days) / 30))


def uncovered(spans: DataFrame, covers: DataFrame, key: str) -> DataFrame:
    """(key, line): the lines of the spans (lo, hi) that no cover (lo, hi) of the same key contains."""
    line = lambda df: df.select(key, F.explode(F.sequence("lo", "hi")).alias("line")).distinct()
    return line(spans).join(line(covers), [key, "line"], "left_anti")


def last_downgrade(history: Column, best: str = "ACTIVE") -> Column:
    """The newest transition in a history (array of struct with `transition`) that was no 'unchanged' and no verification: what a state is to be replayed from."""
    bad = F.filter(history, lambda h: ~h["transition"].isin("unchanged", "verified", "moved", "renamed_internals"))
    return F.element_at(F.when(F.size(bad) > 0, bad), -1)["transition"]


def history_summary(history: Column) -> Column:
    """map<transition, times>: repeats summed up."""
    names = F.array_distinct(F.transform(history, lambda h: h["transition"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.aggregate(F.filter(history, lambda h: h["transition"] == n), F.lit(0), lambda s, h: s + h["repeats"])))


def mark_verified(anchors: DataFrame, verified: DataFrame, at) -> DataFrame:
    """Explicit verification: the anchors of the given memories are active again, with full confidence. verified: memory_id."""
    j = anchors.join(verified.select("memory_id").distinct().withColumn("_v", F.lit(True)), "memory_id", "left")
    v = F.col("_v").isNotNull()
    return j.withColumns({"status": F.when(v, "ACTIVE").otherwise(F.col("status")), "confidence": F.when(v, 1.0).otherwise(F.col("confidence")), "last_verified_at": F.when(v, F.lit(at)).otherwise(F.col("last_verified_at"))}).drop("_v")


def rebase(anchors: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """After a change of the extractor: an anchor whose content equals the symbol's under the old algorithm takes the new fingerprints and keeps its state.

    fingerprints: symbol_id, old_fp, new_content_fp, new_skeleton_fp.
    """
    j = anchors.join(fingerprints, "symbol_id", "left")
    same = F.coalesce(F.col("content_fp") == F.col("old_fp"), F.lit(False))
    return j.withColumns({"content_fp": F.when(same, F.col("new_content_fp")).otherwise(F.col("content_fp")), "skeleton_fp": F.when(same, F.col("new_skeleton_fp")).otherwise(F.col("skeleton_fp")), "rebased": same}).select(*anchors.columns, "rebased")


def anchor_candidates(anchors: DataFrame, symbols: DataFrame) -> DataFrame:
    """(anchor_id, symbol_id, score): the best place an anchor may have gone to: equal skeleton 0.85, equal name 0.72, or the likeness of the sketches, among symbols of equal skeleton, name or file.

    anchors: anchor_id, name, file_path, skeleton_fp, token_signature; symbols likewise with symbol_id. By definition an
    anchor meets the first 25 symbols of its skeleton and of its name and the first 60 of its file, by their ids.
    """
    from .code import similarity

    a = anchors.select("anchor_id", F.col("name").alias("an"), F.col("file_path").alias("af"), F.col("skeleton_fp").alias("ak"), F.col("token_signature").alias("at"))
    pairs = None
    for mine, theirs, most in (("ak", "skeleton_fp", 25), ("an", "name", 25), ("af", "file_path", 60)):
        few = symbols.withColumn("_n", F.row_number().over(Window.partitionBy(theirs).orderBy("symbol_id"))).filter(F.col("_n") <= most)
        p = a.join(few, a[mine] == few[theirs]).select("anchor_id", "symbol_id", (F.col("ak") == F.col("skeleton_fp")).alias("k"), (F.col("an") == F.col("name")).alias("n"), similarity(F.col("at"), F.col("token_signature")).alias("s"))
        pairs = p if pairs is None else pairs.unionByName(p)
    score = F.greatest(F.when(F.col("k"), 0.85).otherwise(0.0), F.when(F.col("n"), 0.72).otherwise(0.0), F.col("s"))
    best = pairs.withColumn("score", score).groupBy("anchor_id").agg(F.max(F.struct("score", "symbol_id")).alias("b"))
    return best.select("anchor_id", "b.symbol_id", "b.score")


def leads(candidates: DataFrame) -> DataFrame:
    """Candidates too weak to follow (0.45 to 0.7): kept as POSSIBLY_MIGRATED_TO edges."""
    return candidates.filter("score >= 0.45 and score < 0.7").select(F.col("anchor_id").alias("from_id"), F.col("symbol_id").alias("to_id"), F.lit("POSSIBLY_MIGRATED_TO").alias("kind"), F.col("score").alias("confidence"))


def supersede(memories: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, edges): each change (memory_id, new_id, body, at) ends a memory and adds its successor, with a SUPERSEDES edge. memories: memory_id, body, status, version, updated_at."""
    one = changes.groupBy("memory_id").agg(F.max(F.struct("at", "new_id", "body")).alias("c"))
    j = memories.join(one, "memory_id", "left")
    old = j.select("memory_id", F.col("body"), F.when(F.col("c").isNotNull(), "SUPERSEDED").otherwise(F.col("status")).alias("status"), "version", F.coalesce("c.at", "updated_at").alias("updated_at"))
    new = j.filter("c is not null").select(F.col("c.new_id").alias("memory_id"), F.col("c.body").alias("body"), F.lit("ACTIVE").alias("status"), (F.col("version") + 1).alias("version"), F.col("c.at").alias("updated_at"))
    edges = j.filter("c is not null").select(F.col("c.new_id").alias("from_id"), F.col("memory_id").alias("to_id"), F.lit("SUPERSEDES").alias("kind"))
    return old.unionByName(new), edges


def reinforce(memories: DataFrame, repeats: DataFrame) -> DataFrame:
    """A restated memory gains evidence: one more for each repetition. repeats: memory_id."""
    n = repeats.groupBy("memory_id").agg(F.count(F.lit(1)).alias("_n"))
    return memories.join(n, "memory_id", "left").withColumn("evidence_count", F.col("evidence_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def sweep_order(anchors: DataFrame, limit: int) -> DataFrame:
    """The anchors to verify next: never verified ones first, then the longest ago."""
    return anchors.orderBy(F.asc_nulls_first("last_verified_at"), "anchor_id").limit(limit)
