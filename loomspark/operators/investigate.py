"""The flagship query: from a question to the symbols and memories that answer it, within a budget.

The driver reads the question (intent, terms, clauses); everything else is one DataFrame job: seeds from full text, names
and vectors, memories pulled in with what they apply to, relevance spread over the call graph, one score, and the budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import graph, knowledge
from . import text as tx
from . import vector as vx
from .state import SEVERITY, STALE_PENALTY, lookup

# How much each signal counts for each intent.
WEIGHTS = {
    "locate": {"lex": 1.0, "sem": 0.30, "sym": 1.5, "graph": 0.3, "sev": 0.2, "time": 0.1, "test": 0.1, "mem": 0.3},
    "understand": {"lex": 0.8, "sem": 0.56, "sym": 1.0, "graph": 0.9, "sev": 0.6, "time": 0.3, "test": 0.3, "mem": 1.0},
    "modify": {"lex": 0.7, "sem": 0.49, "sym": 1.0, "graph": 1.0, "sev": 1.4, "time": 0.5, "test": 0.8, "mem": 1.3},
    "debug": {"lex": 0.8, "sem": 0.56, "sym": 0.9, "graph": 0.9, "sev": 1.0, "time": 1.0, "test": 0.6, "mem": 1.1},
    "audit": {"lex": 0.6, "sem": 0.42, "sym": 0.7, "graph": 1.1, "sev": 1.2, "time": 0.4, "test": 1.0, "mem": 1.2},
}
MEMORY_FLOOR, LEAST = 1.45, 0.05


@dataclass
class Store:
    """symbols: symbol_id, name, symbol_path, path, signature, status. edges: from_id, to_id, confidence, edge_class,
    edge_id. memories: memory_id, kind, claim, severity, status, usage double, inferred boolean. applies: memory_id,
    symbol_id; or memory_id, name for all symbols of a name, as pairs of memories and symbols would grow with the product of
    both. touched: path, days (since its last change).

    symbol_index and memory_index are the inverted indexes of the symbols' texts and the memories' claims, vectors (id, v) the
    symbols' letter vectors; they are made with the store, so a question reads no text.
    """

    symbols: DataFrame
    edges: DataFrame
    memories: DataFrame
    applies: DataFrame
    touched: DataFrame
    symbol_index: tx.TextIndex | None = None
    memory_index: tx.TextIndex | None = None
    vectors: DataFrame | None = None

    def applied(self, memories: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
        """What applies holds of some memories (memory_id and more columns) or some symbols (symbol_id): memory_id, symbol_id, and what the memories have."""
        a, by_name = self.applies.distinct(), "name" in self.applies.columns
        if memories is not None:
            a = a.join(memories, "memory_id")
        if symbols is not None:
            own = self.symbols.select("symbol_id", "name").join(symbols.select("symbol_id"), "symbol_id", "left_semi").distinct()
            return own.join(a, "name").drop("name") if by_name else a.join(symbols.select("symbol_id"), "symbol_id", "left_semi")
        return self.symbols.select("symbol_id", "name").distinct().join(a, "name").drop("name") if by_name else a

    def indexed(self) -> Store:
        """The same with the indexes and vectors that are missing."""
        s = self.symbols.select("symbol_id", F.concat_ws(" ", "symbol_path", "signature", "path").alias("t"))
        self.symbol_index = self.symbol_index or tx.TextIndex(s, "symbol_id", "t")
        self.memory_index = self.memory_index or tx.TextIndex(self.memories.filter("status <> 'DELETED'"), "memory_id", "claim")
        if self.vectors is None:
            self.vectors = materialise(s.select(F.col("symbol_id").alias("id"), vx.letter_histogram(F.col("t")).alias("v")), "vectors")
        return self


def _clauses(terms: list[str]) -> list[tx.Clause]:
    """One prefix clause for each spelling of each term that has words, in the order of the terms."""
    out: list[tx.Clause] = []
    for spelling in (v for t in terms for v in tx.variants(t)):
        clause = tx.Clause(tx._words(spelling), prefix=True)
        if clause.words and clause not in out:
            out.append(clause)
    return out


def symbol_seeds(store: Store, terms: list[str], query: str, limit: int = 120) -> DataFrame:
    """(id, lex, sym, sem): symbols by full text (normalised to 0..1), by equal or contained names, and by the built-in vectors."""
    from pyspark.sql import Window

    s = store.symbols.select("symbol_id", "name", "path")
    top = store.symbol_index.hits(_clauses(terms)).orderBy(F.desc("score"), "id").limit(limit)
    lex = top.select("id", tx.min_max(F.col("score"), Window.partitionBy(F.lit(1))).alias("lex"))
    low, words = F.lower("name"), [t.lower() for t in terms]
    named = s.select(F.col("symbol_id").alias("id"), F.when(low.isin(words), 1.0).when(F.greatest(*[low.contains(w) for w in words], F.lit(False)), 0.5).alias("sym")).filter("sym is not null")
    mentioned = [m for m in query.split() if "/" in m]
    if mentioned:  # a path named in the question pins its symbols
        hit = F.greatest(*[F.col("path").contains(m) for m in mentioned], F.lit(False))
        named = named.unionByName(s.filter(hit).select(F.col("symbol_id").alias("id"), F.lit(1.0).alias("sym")))
    base = lex.join(named.groupBy("id").agg(F.max("sym").alias("sym")), "id", "full_outer").select("id", F.coalesce("lex", F.lit(0.0)).alias("lex"), F.coalesce("sym", F.lit(0.0)).alias("sym"))
    near = vx.top_k(store.vectors, "id", "v", vx.letter_vector(query), 60)
    sem = vx.semantic_seeds(base.select("id", "lex"), near).select("id", "sem")
    return base.join(sem, "id", "full_outer").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lex", "sym", "sem")])


def memory_seeds(store: Store, terms: list[str], limit: int = 60) -> DataFrame:
    """(memory_id, relevance): memories by full text; where nothing matches, by approximate match."""
    from pyspark.sql import Window

    hit = store.memory_index.hits(_clauses(terms)).orderBy(F.desc("score"), "id").limit(limit)
    if hit.limit(1).count():
        return hit.select(F.col("id").alias("memory_id"), tx.min_max(F.col("score"), Window.partitionBy(F.lit(1))).alias("relevance"))
    return tx.fuzzy_score(store.memories.filter("status <> 'DELETED'"), "memory_id", "claim", terms).select(F.col("id").alias("memory_id"), F.col("score").alias("relevance"))


def rank(store: Store, query: str, intent: str | None = None, depth: int = 2) -> DataFrame:
    """All symbols that say something to the query: (symbol_id, score, its signals, memories array), not cut yet."""
    intent = intent or tx.infer_intent(query)
    store, terms, w = store.indexed(), tx.query_terms(query), WEIGHTS[intent]
    if not terms:
        return store.symbols.select("symbol_id", F.lit(0.0).alias("score")).limit(0)
    seeds, mems = materialise(symbol_seeds(store, terms, query), "seeds"), materialise(memory_seeds(store, terms), "seeds")  # a few hundred rows each, read several times
    pulled = store.applied(memories=mems).groupBy(F.col("symbol_id").alias("id")).agg(F.max(F.col("relevance") * 0.8).alias("pull"))
    all_ = seeds.join(pulled, "id", "full_outer").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("lex", "sym", "sem", "pull")])
    near = materialise(graph.spread(store.edges, all_.select("id", F.greatest("lex", "sym", "sem", "pull").alias("score")).filter("score > 0"), depth).withColumnRenamed("score", "graph"), "near")  # a few hundred rows, all that are ranked
    m = store.memories.join(mems, "memory_id", "left").withColumn("mscore", knowledge.memory_score(F.col("relevance"), F.col("severity"), F.col("usage"), F.col("status"), F.col("inferred"), F.col("kind"), intent))
    per = m.join(store.applied(symbols=near.select(F.col("id").alias("symbol_id"))), "memory_id").groupBy(F.col("symbol_id").alias("id")).agg(
        F.max(F.coalesce(lookup(SEVERITY, F.col("severity")), F.lit(0.3))).alias("sev"), F.least(F.lit(1.0), 0.35 * F.count(F.lit(1))).alias("mem"), F.max(F.coalesce(lookup(STALE_PENALTY, F.col("status")), F.lit(0.0))).alias("stale"), F.max((F.col("kind") == "test_evidence").cast("double")).alias("test"), F.count(F.lit(1)).alias("n"),
        F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.round("mscore", 4).alias("s"), "memory_id", "kind")))), 1, 10).alias("ranked"),
    )
    s = store.symbols.join(near, F.col("symbol_id") == F.col("id")).join(all_, "id", "left").join(per, "id", "left").join(store.touched.groupBy("path").agg(F.min("days").alias("days")), "path", "left")
    part = lambda c: F.coalesce(c, F.lit(0.0))
    time = F.when(F.col("days").isNull(), 0.0).otherwise(1 / (1 + F.col("days") / 30)) if w["time"] > 0.2 else F.lit(0.0)
    specific = F.when(F.coalesce("n", F.lit(0)) > 3, F.least(F.lit(0.45), 0.08 * (F.col("n") - 3))).otherwise(0.0)
    score = w["lex"] * part("lex") + w["sem"] * part("sem") + w["sym"] * part("sym") + w["graph"] * part("graph") + w["sev"] * part("sev") + w["time"] * time + w["test"] * part("test") + w["mem"] * part("mem") - specific - 0.25 * part("stale") - F.when(F.col("status") != "ACTIVE", 0.4).otherwise(0.0)
    return s.withColumn("score", F.round(score, 6)).filter(F.col("score") > LEAST).select("symbol_id", "name", "path", "score", F.round(part("lex"), 6).alias("lex"), F.round(part("graph"), 6).alias("graph"), F.coalesce("ranked", F.array()).alias("memories"))


def capsules(store: Store, ranked: DataFrame, budget: int = 9000, most: int = 12) -> DataFrame:
    """The best symbols within the budget, each with up to 6 callers and callees and its memories: quoted from MEMORY_FLOOR on
    (at most 6), named below it (at most 4). A memory is quoted at its best symbol only."""
    top = materialise(ranked.orderBy(F.desc("score"), "symbol_id").limit(most), "top")  # `most` rows, read several times
    side = lambda key, other, name: store.edges.join(top.select(F.col("symbol_id").alias(key)), key).join(store.symbols.select(F.col("symbol_id").alias(other), F.col("name").alias("n")), other).groupBy(F.col(key).alias("symbol_id")).agg(F.slice(F.array_sort(F.collect_set("n")), 1, 6).alias(name))
    c = top.join(side("to_id", "from_id", "callers"), "symbol_id", "left").join(side("from_id", "to_id", "callees"), "symbol_id", "left")
    first = top.select("symbol_id", "score", F.explode("memories").alias("m")).groupBy(F.col("m.memory_id").alias("memory_id")).agg(F.max(F.struct("score", "symbol_id")).alias("b")).select("memory_id", F.col("b.symbol_id").alias("home"))
    own = top.select("symbol_id", F.explode("memories").alias("m")).select("symbol_id", "m.s", "m.memory_id").join(first, "memory_id").join(store.memories.select("memory_id", "claim"), "memory_id")
    quoted = own.filter((F.col("s") >= MEMORY_FLOOR) & (F.col("home") == F.col("symbol_id"))).groupBy("symbol_id").agg(F.slice(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("s", "memory_id", "claim")))), lambda x: x["claim"]), 1, 6).alias("quoted"))
    named = own.filter(F.col("s") < MEMORY_FLOOR).groupBy("symbol_id").agg(F.slice(F.array_sort(F.collect_set("memory_id")), 1, 4).alias("named"))
    none = F.array().cast("array<string>")
    full = c.join(quoted, "symbol_id", "left").join(named, "symbol_id", "left").select("symbol_id", "name", "path", "score", *[F.coalesce(x, none).alias(x) for x in ("callers", "callees", "quoted", "named")])
    sized = full.withColumn("cost", F.greatest(F.lit(1), F.floor((F.length("name") + F.length("path") + F.length(F.array_join("callers", " ")) + F.length(F.array_join("callees", " ")) + F.length(F.array_join("quoted", " ")) + 80) / 4)).cast("long"))
    return tx.within_budget(sized, [F.desc("score"), F.col("symbol_id")], "cost", budget, most)


def investigate(store: Store, query: str, intent: str | None = None, depth: int = 2, budget: int = 9000) -> DataFrame:
    ranked = rank(store, query, intent, depth)
    return capsules(store, ranked, budget) if "memories" in ranked.columns else ranked


def continue_from(frontier: DataFrame, focus: str) -> DataFrame:
    """The rest of an earlier answer, those whose name fits the focus first: equal 4, begins 3, contains 2, shares a piece 1.5, else 0.5."""
    f, n = focus.lower(), F.lower("name")
    pieces = [p for p in tx.variants(focus.lower()) if p != f]
    grade = F.when(n == f, 4.0).when(n.startswith(f), 3.0).when(n.contains(f), 2.0).when(F.greatest(*[n.contains(p) for p in pieces], F.lit(False), F.lit(False)), 1.5).otherwise(0.5)
    return frontier.withColumn("grade", grade).orderBy(F.desc("grade"), F.desc("score"), "symbol_id")


def several(stores: list[tuple[str, Store]], query: str, intent: str | None = None, most: int = 12) -> DataFrame:
    """One question to several roots (name, store): their answers in one, sorted again, the best `most`."""
    out = None
    for root, s in stores:
        one = investigate(s, query, intent)
        one = one.select(F.lit(root).alias("root"), "symbol_id", *[F.col(c) if c in one.columns else F.lit(None).cast("string").alias(c) for c in ("name", "path")], "score")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("score"), "root", "symbol_id").limit(most)


def empty_result(query: str, intent: str | None = None) -> dict:
    """The answer to a query that has no terms: the same fields as any answer, all empty, and a note why."""
    return {"query": query, "intent": intent or tx.infer_intent(query), "terms": tx.query_terms(query), "capsules": [], "memories": [], "note": "the query has no terms to search for"}
