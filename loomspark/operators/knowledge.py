"""Stored claims about code: similarity, duplicates, contradictions, inference, diagnostics, rules and the briefing."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

from .state import ANCHOR_RANK, SEVERITY, SEVERITY_ORDER, lookup, rank_of, worst

DUPLICATE, NEAR, EXTENDS, RELATED, CONVERGENT = 0.8, 0.5, 0.45, 0.28, 0.5
MIN_PARENTS, MIN_AGREEMENT, MIN_SHARED = 3, 0.03, 2
# Words that say nothing about a claim; what negates one; where composed context begins.
CLAIM_STOP = "the a an and or of to in on for is are be it this that with as by at from not must should never always when was were has have had will can".split()
NEGATION = r"(?i)\b(not|never|no longer|must not|cannot|can't|don't|avoid|without)\b"
MARKERS = ("\n\nRecorded while: ", "\n\nWhy: ", "\n\nChanged: ", "\n\nApplies to: ")


def claim(body: Column) -> Column:
    """The claim of a composed body: what stands before its context."""
    out = F.coalesce(body, F.lit(""))
    for m in MARKERS:
        out = F.substring_index(out, m, 1)
    return out


def claim_tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]{3,}"), 0)), F.array(*[F.lit(w) for w in CLAIM_STOP]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def _rare_tokens(claims: DataFrame, col: str, least: float) -> DataFrame:
    """(memory_id, token): of each claim's tokens the rarest, so many that two claims alike by `least` must have one of them in common."""
    t = claims.select("memory_id", F.size(col).alias("n"), F.explode(col).alias("token"))
    seen = t.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    r = t.join(seen, "token").withColumn("rn", F.row_number().over(Window.partitionBy("memory_id").orderBy("df", "token")))
    return r.filter(F.col("rn") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("memory_id", F.concat(F.lit(f"{col} "), "token").alias("token"))


def related(memories: DataFrame, scope: DataFrame) -> DataFrame:
    """(a, b, similarity, relation) of memories about a common target.

    memories: memory_id, kind, claim, event_id; scope: memory_id, target. Equal claims are taken once (the lowest id stands
    for its class, see `restatements`), so a much repeated claim makes no pairs with itself. relation: 'restates' (same
    kind, alike by 0.8; claims of fewer than 3 tokens must be equal), 'near' (0.5), 'contradicts' (opposite polarity,
    0.28) or 'extends' (same polarity, 0.45). Memories of one event neither contradict nor extend each other.
    """
    m = memories.withColumns({"t": claim_tokens(F.col("claim")), "w": F.array_distinct(F.regexp_extract_all(F.lower("claim"), F.lit("[a-z]{4,}"), 0)), "neg": F.col("claim").rlike(NEGATION)})
    one = m.join(restatements(memories).filter("memory_id = class_id").select("memory_id"), "memory_id", "left_semi")
    one = materialise(one.select("memory_id", "kind", "claim", "event_id", "t", "w", "neg"), "claims")
    rare = _rare_tokens(one, "w", min(RELATED, EXTENDS)).unionByName(_rare_tokens(one, "t", min(DUPLICATE, NEAR)))
    at = rare.join(scope.select("memory_id", "target").distinct(), "memory_id")
    pairs = at.select("target", "token", F.col("memory_id").alias("a_memory_id")).join(at.select("target", "token", F.col("memory_id").alias("b_memory_id")), ["target", "token"]).filter("a_memory_id < b_memory_id").select("a_memory_id", "b_memory_id").distinct()
    side = lambda s: one.select(*[F.col(c).alias(f"{s}_{c}") for c in ("memory_id", "kind", "claim", "event_id", "t", "w", "neg")])
    p = pairs.join(side("a"), "a_memory_id").join(side("b"), "b_memory_id")
    s, overlap = jaccard(F.col("a_t"), F.col("b_t")), jaccard(F.col("a_w"), F.col("b_w"))
    same_kind, same_event = F.col("a_kind") == F.col("b_kind"), F.coalesce(F.col("a_event_id") == F.col("b_event_id"), F.lit(False))
    short = F.least(F.size("a_t"), F.size("b_t")) < 3
    r = F.when(same_kind & ~short & (s >= DUPLICATE), "restates").when(~same_event & (F.col("a_neg") != F.col("b_neg")) & (overlap >= RELATED), "contradicts").when(~same_event & (F.col("a_neg") == F.col("b_neg")) & (overlap >= EXTENDS), "extends").when(same_kind & (s >= NEAR), "near")
    return p.select(F.col("a_memory_id").alias("a"), F.col("b_memory_id").alias("b"), F.greatest(s, overlap).alias("similarity"), r.alias("relation")).filter("relation is not null")


def restatements(memories: DataFrame) -> DataFrame:
    """(memory_id, class_id, n): memories of one kind with equal claims; the lowest id names the class."""
    w = Window.partitionBy("kind", F.sha2("claim", 256))
    g = memories.groupBy("kind", F.sha2("claim", 256).alias("h")).agg(F.min("memory_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    del w
    return memories.withColumn("h", F.sha2("claim", 256)).join(g, ["kind", "h"]).select("memory_id", "class_id", "n")


def agreement(claims: DataFrame, group: str, id_col: str, tokens: str) -> DataFrame:
    """(group, n, shared, score): terms that a strict majority of a group's claims use, and their share of all its terms."""
    t = claims.select(group, id_col, F.explode(F.array_distinct(tokens)).alias("term"))
    n = claims.groupBy(group).agg(F.count_distinct(id_col).alias("n"))
    c = t.groupBy(group, "term").agg(F.count_distinct(id_col).alias("k")).join(n, group)
    common = F.col("k") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2) + 1)
    return c.groupBy(group).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.when(common, F.col("term")))).alias("shared"), F.count(F.lit(1)).alias("terms")).select(group, "n", "shared", (F.size("shared") / F.col("terms")).alias("score"))


def shared_rule_on_callers(edges: DataFrame, applies: DataFrame, memories: DataFrame) -> DataFrame:
    """Proposals (symbol_id, n, shared, score, severity): symbols at least 3 of whose callers have rules that agree; severity is one step below the commonest worst.

    applies: memory_id, symbol_id; memories: memory_id, claim, severity.
    """
    m = edges.select(F.col("from_id").alias("symbol_id"), "to_id").join(applies, "symbol_id").join(memories, "memory_id").select(F.col("to_id").alias("target"), "memory_id", "severity", claim_tokens(F.col("claim")).alias("t")).dropDuplicates(["target", "memory_id"])
    top = m.groupBy("target").agg(F.min(rank_of(SEVERITY_ORDER, F.col("severity"))).alias("r"))
    a = agreement(m, "target", "memory_id", "t").filter((F.col("n") >= MIN_PARENTS) & (F.size("shared") >= MIN_SHARED) & (F.col("score") >= MIN_AGREEMENT))
    own = applies.select(F.col("symbol_id").alias("target")).distinct()
    return a.join(top, "target").join(own, "target", "left_anti").select(F.col("target").alias("symbol_id"), "n", "shared", F.bround("score", 3).alias("score"), F.get(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.least(F.coalesce("r", F.lit(3)) + 1, F.lit(3))).alias("severity"))


def unguarded(memories: DataFrame, guards: DataFrame) -> DataFrame:
    """Rules that no test guards. guards: memory_id."""
    return memories.filter(F.col("kind").isin("invariant", "warning")).join(guards.select("memory_id"), "memory_id", "left_anti").select("memory_id", "kind", "severity")


def converge(memories: DataFrame, most: int = 400) -> DataFrame:
    """(memory_id, cluster): claims clustered in the order of their ids, each to the first cluster whose common tokens are alike by 0.5.

    The result depends on the order and a cluster's centre is the running intersection, so one task folds them; by
    definition only the first `most` ids take part.
    """
    def fold(pdf):
        centres, out = [], []
        for mid, toks in pdf.sort_values("memory_id")[["memory_id", "t"]].itertuples(index=False, name=None):
            t = set(toks)
            hit = next((i for i, c in enumerate(centres) if t and len(t & c) / len(t | c) >= CONVERGENT), None)
            if hit is None:
                centres.append(t)
                hit = len(centres) - 1
            else:
                centres[hit] &= t
            out.append((mid, hit))
        return pd.DataFrame(out, columns=["memory_id", "cluster"])

    first = memories.orderBy("memory_id").limit(most).select("memory_id", claim_tokens(F.col("claim")).alias("t"), F.lit(0).alias("g"))
    return first.groupBy("g").applyInPandas(lambda pdf: fold(pdf), f"memory_id {memories.schema['memory_id'].dataType.simpleString()}, cluster int")


def bypassed_wrappers(edges: DataFrame, symbols: DataFrame, applies: DataFrame, limit: int = 4) -> DataFrame:
    """(caller, target, wrapper): calls that go past a wrapper which a rule is attached to.

    A wrapper (by its name) calls the target and carries a rule; another caller calls the target directly.
    """
    wrap = symbols.filter(F.col("name").rlike(r"(?i)^(safe|guarded|checked|locked|with|wrap)|_(safe|locked|guarded|once)$")).join(applies.select("symbol_id"), "symbol_id", "left_semi").select(F.col("symbol_id").alias("wrapper"))
    w = edges.select(F.col("from_id").alias("wrapper"), F.col("to_id").alias("target")).join(wrap, "wrapper")
    direct = edges.select(F.col("from_id").alias("caller"), F.col("to_id").alias("target")).join(wrap.withColumnRenamed("wrapper", "caller"), "caller", "left_anti")
    j = direct.join(w, "target").filter("caller <> wrapper")
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy("caller", "wrapper"))).filter(F.col("rn") <= limit).select("caller", "target", "wrapper")


def deprecated_callers(edges: DataFrame, symbols: DataFrame, memories: DataFrame, applies: DataFrame) -> DataFrame:
    """(symbol_id, n_callers): symbols that a memory calls deprecated and that still have callers."""
    d = memories.filter(F.col("claim").rlike(r"(?i)\b(deprecated|do not use|no longer used|superseded by)\b")).join(applies, "memory_id").select("symbol_id").distinct()
    return edges.select(F.col("to_id").alias("symbol_id"), "from_id").join(d, "symbol_id", "left_semi").groupBy("symbol_id").agg(F.count_distinct("from_id").alias("n_callers"))


def diverging_twins(symbols: DataFrame, applies: DataFrame) -> DataFrame:
    """(symbol_id, skeleton_fp, n_ruled): symbols without a rule whose skeleton equals that of symbols with one. A class of equal skeletons is summed up, its pairs are not made."""
    ruled = applies.select("symbol_id").distinct().withColumn("ruled", F.lit(1))
    s = symbols.select("symbol_id", "skeleton_fp").join(ruled, "symbol_id", "left")
    c = s.groupBy("skeleton_fp").agg(F.sum(F.coalesce("ruled", F.lit(0))).alias("n_ruled"), F.count(F.lit(1)).alias("n")).filter("n_ruled > 0 and n > n_ruled")
    return s.filter("ruled is null").join(c, "skeleton_fp").select("symbol_id", "skeleton_fp", "n_ruled")


def untested(edges: DataFrame, symbols: DataFrame, applies: DataFrame, memories: DataFrame, hops: int = 3) -> DataFrame:
    """Symbols with an invariant that no test reaches within `hops` calls."""
    from .graph import bfs

    ruled = applies.join(memories.filter("kind = 'invariant'").select("memory_id"), "memory_id", "left_semi").select(F.col("symbol_id").alias("id")).distinct()
    tests = symbols.filter(F.col("name").startswith("test_") | F.lower("path").contains("test")).select(F.col("symbol_id").alias("id"))
    reached = bfs(edges, tests, hops).select("id")
    return ruled.join(reached, "id", "left_anti").select(F.col("id").alias("symbol_id"))


def rule_score(severity: Column, evidence: Column, helpful: Column, unhelpful: Column, reach: Column, used: Column) -> Column:
    """What a rule is worth: severity weighed by evidence, votes, reach and use."""
    return F.coalesce(lookup(SEVERITY, severity), F.lit(0.3)) * (1 + 0.6 * F.log(F.greatest(evidence, F.lit(1)))) * (1 + 0.4 * F.log1p(helpful)) / (1 + 0.5 * unhelpful) * (1 + 0.25 * F.log1p(reach)) * (1 + 0.15 * F.log1p(used))


def blockers(kind: Column, status: Column, anchors_active: Column, inference: Column, confidence: Column) -> Column:
    """Why a memory may not become a rule: the reasons, none if it may."""
    return F.array_compact(F.array(F.when(~kind.isin("invariant", "warning", "contract", "decision"), F.lit("kind")), F.when(status != "ACTIVE", F.lit("status")), F.when(~F.coalesce(anchors_active, F.lit(False)), F.lit("anchors")), F.when(inference, F.lit("inferred")), F.when(confidence < 0.4, F.lit("confidence"))))


def memory_list(memories: DataFrame, anchors: DataFrame) -> DataFrame:
    """Memories with their worst anchor state, least confidence and number of anchors; the worst first."""
    a = anchors.groupBy("memory_id").agg(worst(ANCHOR_RANK, F.col("status")).alias("anchor_status"), F.min("confidence").alias("anchor_confidence"), F.count(F.lit(1)).alias("n_anchors"))
    return memories.join(a, "memory_id", "left").orderBy(F.desc_nulls_last(rank_of(ANCHOR_RANK, F.col("anchor_status"))), F.desc("created_at"), "memory_id")


def memory_score(relevance: Column, severity: Column, usage: Column, status: Column, inferred: Column, kind: Column, intent: str) -> Column:
    """How much a memory says to a query: relevance with a floor for warnings of its kind, severity, use, less for stale and unreviewed ones."""
    from .state import STALE_PENALTY

    floor = F.when(kind.isin("security", "warning", "invariant", "failed_attempt"), 0.62 if intent in ("modify", "debug", "audit") else 0.15).otherwise(0.0)
    return 1.6 * F.greatest(floor, F.coalesce(relevance, F.lit(0.0))) + F.coalesce(lookup(SEVERITY, severity), F.lit(0.3)) * (1.4 if intent in ("modify", "debug") else 0.8) + usage - 0.5 * F.coalesce(lookup(STALE_PENALTY, status), F.lit(0.0)) - F.when(inferred, 0.55).otherwise(0.0)


def compile_event(events: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Events to memories: each text of each payload field becomes one memory of the field's kind, composed with the event's summary.

    events: event_id, summary, payload map<string,array<string>>, at. Ids are hashes of event, field and claim.
    """
    kinds = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    f = events.select("event_id", "summary", "at", F.explode("payload").alias("field", "claims")).withColumn("kind", F.element_at(kinds, F.col("field"))).filter("kind is not null")
    c = f.select("event_id", "summary", "at", "kind", F.explode("claims").alias("claim")).filter(F.trim("claim") != "")
    return c.select(F.concat(F.lit("mem_"), F.substr(F.sha2(F.concat_ws("|", "event_id", "kind", "claim"), 256), F.lit(1), F.lit(12))).alias("memory_id"), "kind", "claim", F.substring(F.substring_index("claim", "\n", 1), 1, 200).alias("title"), F.when(F.coalesce("summary", F.lit("")) != "", F.concat("claim", F.lit(MARKERS[0]), "summary")).otherwise(F.col("claim")).alias("body"), "event_id", F.col("at").alias("created_at"))


def mentions(text: Column, name: Column) -> Column:
    """Whether a text names something, by whole words; plain lower-case words count only where written as code."""
    plain = name.rlike("^[a-z]+$")
    body, quoted = F.concat(F.lit(" "), F.regexp_replace(text, r"[^A-Za-z0-9_.]+", " "), F.lit(" ")), F.concat(F.lit("`"), name, F.lit("`"))
    whole = body.contains(F.concat(F.lit(" "), name, F.lit(" "))) | body.contains(F.concat(F.lit(" "), name, F.lit(". ")))
    return F.when(plain, text.contains(quoted) | text.contains(F.concat(name, F.lit("(")))).otherwise(whole)


def narrowed(memories: DataFrame, anchors: DataFrame, broad: int = 3) -> DataFrame:
    """(memory_id, file_path): where a memory applies. One with anchors in more than `broad` files keeps those it names, or all if it names none."""
    n = anchors.groupBy("memory_id").agg(F.count_distinct("file_path").alias("n"))
    j = anchors.join(n, "memory_id").join(memories.select("memory_id", "claim"), "memory_id")
    named = mentions(F.col("claim"), F.element_at(F.split("file_path", "/"), -1))
    any_named = F.max(named).over(Window.partitionBy("memory_id"))
    return j.withColumns({"named": named, "any": any_named}).filter((F.col("n") <= broad) | F.col("named") | ~F.col("any")).select("memory_id", "file_path").distinct()


def briefing(memories: DataFrame, anchors: DataFrame, entry_points: DataFrame) -> DataFrame:
    """One row of totals: memories by kind, unverified and stale ones, entry points by kind."""
    m = memories.groupBy("kind").agg(F.count(F.lit(1)).alias("c")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "c")))).alias("by_kind"), F.sum("c").alias("n_memories"))
    s = anchors.filter(F.col("status") != "ACTIVE").agg(F.count_distinct("memory_id").alias("n_stale"))
    e = entry_points.groupBy("kind").agg(F.count(F.lit(1)).alias("c")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "c")))).alias("entries"))
    return m.join(F.broadcast(s)).join(F.broadcast(e))  # three rows of totals


def coverage_edges(memories: DataFrame) -> DataFrame:
    """GUARDED_BY edges between the rules and the test evidence of one event; pairs within an event only. memories: memory_id, kind, event_id."""
    rules = memories.filter(F.col("kind").isin("invariant", "warning", "contract")).select("event_id", F.col("memory_id").alias("from_id"))
    tests = memories.filter("kind = 'test_evidence'").select("event_id", F.col("memory_id").alias("to_id"))
    return rules.join(tests, "event_id").select("from_id", "to_id", F.lit("GUARDED_BY").alias("kind"))


def causal_links(links: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) causal assertions (from_id, to_id, kind, confidence): the kind must be known, both ends there and different. Repeated ones keep the highest confidence."""
    kinds = ["CAUSED", "LED_TO", "ESTABLISHED", "REFINES", "DEPENDS_ON"]
    m = memories.select("memory_id", F.lit(True).alias("ok"))
    j = links.join(m.select(F.col("memory_id").alias("from_id"), F.col("ok").alias("a")), "from_id", "left").join(m.select(F.col("memory_id").alias("to_id"), F.col("ok").alias("b")), "to_id", "left")
    good = F.col("kind").isin(kinds) & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("from_id") != F.col("to_id"))
    return j.filter(good).groupBy("from_id", "to_id", "kind").agg(F.max("confidence").alias("confidence")), j.filter(~F.coalesce(good, F.lit(False))).select("from_id", "to_id", "kind", "confidence")


def problems(memories: DataFrame, anchors: DataFrame, edges: DataFrame, applies: DataFrame, limit: int = 14) -> DataFrame:
    """(problem, rank, subject, detail): stale knowledge, callers newer than the last verification, and contradictions; at most 4 of each, the gravest first.

    memories: memory_id, severity; anchors: memory_id, symbol_id, status, last_verified_at; edges: from_id, to_id, created_at; applies: memory_id, symbol_id.
    """
    stale = anchors.filter(F.col("status").isin("NEEDS_REVIEW", "ORPHANED")).join(memories.select("memory_id", "severity"), "memory_id").select(F.lit("stale_knowledge").alias("problem"), rank_of(SEVERITY_ORDER, F.col("severity")).alias("rank"), F.col("memory_id").alias("subject"), F.col("status").alias("detail"))
    late = anchors.join(edges.select(F.col("to_id").alias("symbol_id"), "from_id", "created_at"), "symbol_id").filter(F.col("created_at") > F.col("last_verified_at")).select(F.lit("unreviewed_caller").alias("problem"), F.lit(2).alias("rank"), F.col("memory_id").alias("subject"), F.col("from_id").alias("detail"))
    contra = edges.filter("kind = 'CONTRADICTS'").select(F.lit("conflict").alias("problem"), F.lit(0).alias("rank"), F.col("from_id").alias("subject"), F.col("to_id").alias("detail")) if "kind" in edges.columns else stale.limit(0)
    x = stale.unionByName(late).unionByName(contra).distinct()
    w = Window.partitionBy("problem").orderBy("rank", "subject", "detail")
    return x.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 4).drop("rn").orderBy("rank", "problem", "subject", "detail").limit(limit)


def shell_files(command: Column) -> Column:
    """The files that a command line names: quote-aware words that look like paths; commands that only search name none."""
    looks = re.compile(r"^[\w./~-]*[\w-]+\.[A-Za-z]\w{0,7}$")
    searching = {"grep", "rg", "find", "ag", "ack", "fd", "git", "ls"}

    @F.pandas_udf("array<string>")
    def names(col: pd.Series) -> pd.Series:
        def one(c):
            out: dict[str, None] = {}
            for part in re.split(r"&&|\|\||[;|\n]", c or ""):
                try:
                    words = shlex.split(part)
                except ValueError:
                    words = part.split()
                words = [w for i, w in enumerate(words) if i or "=" not in w]
                if words and words[0].rsplit("/", 1)[-1] not in searching:
                    out |= dict.fromkeys(w for w in words[1:] if looks.match(w))
            return list(out)

        return col.map(one)

    return names(command)


def line_span(text: Column, needle: Column) -> Column:
    """struct(lo, hi): the lines of a text that a passage covers; null where it is missing or there more than once."""
    at = F.position(needle, text)
    once = (at > 0) & (F.position(needle, F.substr(text, at + 1)) == 0)
    lines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    lo = lines(F.substr(text, F.lit(1), at)) + 1
    return F.when(once & (needle != ""), F.struct(lo.alias("lo"), (lo + lines(needle)).alias("hi")))
