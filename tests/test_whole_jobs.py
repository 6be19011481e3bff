"""Queries that once looked at a part of their tables, against brute force over all rows."""

from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from loomspark.plans import domain, graphs, more, search
from test_state_graph_text import shuffled_rows


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders and lines whose keys lie on both sides of the bounds that were there: customers up to 200, orders up to 2000."""
    d = str(tmp_path_factory.mktemp("orders"))
    o = [(k, c, f"{k % 3}-P") for k, c in ((1, 1), (2, 2), (3, 1), (1999, 200), (2001, 201), (2002, 40_000), (5000, 201))]
    l = [(k, p, float(q)) for k, _, _ in o for p, q in ((k % 7, 3), (k % 5 + 20, k % 50 + 1), (9, 2))]  # noqa: E741
    spark.createDataFrame(o, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(l, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return d, o, l


def test_recordings_of_all_customers(spark, orders):
    d, o, l = orders  # noqa: E741
    of, calls, own, total, edges = {k: (c, f"orders:{p}") for k, c, p in o}, Counter(), Counter(), Counter(), Counter()
    for k, p, q in l:
        part = f"lines:part{p % 20}"
        calls[part] += 1
        own[part] += q
        total[part] += q
        total[of[k][1]] += q
        total["c:main"] += q
        edges[of[k][1], part] += 1
    for _, up in of.values():
        calls[up] += 1
        own[up] += 1
        total[up] += 1
        total["c:main"] += 1
        edges["c:main", up] += 1
    n = len({c for c, _ in of.values()})
    calls["c:main"], own["c:main"] = n, 2 * n
    total["c:main"] += 2 * n
    assert {tuple(r) for r in domain.hot(spark, d).select("key", "calls", "self_ms", "total_ms").collect()} == {(x, calls[x], own[x], total[x]) for x in calls}
    assert {tuple(r) for r in domain.runtime(spark, d).select("caller", "callee", "calls").collect()} == {(*x, n) for x, n in edges.items()}


def test_commit_log_of_all_orders(spark, orders):
    d, _, l = orders  # noqa: E741
    by = defaultdict(list)
    for k, p, q in l:
        by[f"src/p{p}.py"].append((k, int(q)))
    assert {tuple(r) for r in more.commit_log(spark, d).select("path", "n", "added", "last").collect()} == {(p, len(x), sum(q for _, q in x), max(x)[0] * 1000) for p, x in by.items()}
    assert {tuple(r) for r in more.recency(spark, d).select("path", "last").collect()} == {(p, max(x)[0] * 1000) for p, x in by.items()}


def test_context_of_all_hits(spark, tmp_path):
    rows = [(i, "s1", i, "message", "the baseline of the loss" if i in (3, 4, 9) else "baseline only") for i in range(1, 12)]
    rows += [(30 + i, "s2", i, "message", "Loss, baseline" if i == 0 else "other") for i in range(4)] + [(50, "s3", 0, "message", "no hit"), (51, "s3", 1, "tool_result", "baseline loss"), (52, "s3", None, "message", "baseline loss")]
    spark.createDataFrame([(i, k, o, "user", kind, t, None) for i, k, o, kind, t in rows], "id long, session_key string, ordinal int, role string, kind string, text string, tool_name string").write.parquet(f"{tmp_path}/messages.parquet")
    at = {(k, o): i for i, k, o, _, _ in rows}
    want = {(k, h, o, at[k, o], h == o) for k, h in (("s1", 3), ("s1", 4), ("s1", 9), ("s2", 0)) for o in range(h - 2, h + 2) if (k, o) in at}
    assert {tuple(r) for r in search.message_context(spark, str(tmp_path)).collect()} == want


def test_every_symbol_is_an_anchor(spark, sf):
    n = graphs._symbols(spark, sf).select("symbol_id").count()
    assert n > 100 and more.candidate_places(spark, sf).agg(F.sum("n")).first()[0] == n


def test_lineage_of_all_depths(spark, tmp_path):
    up = {"a": None, "b": "a", "c": "b", "d": "c", "e": "d", "f": "e", "g": "b", "lone": "gone", "x": "y", "y": "x", "z": "x"}
    spark.createDataFrame(list(up.items()), "exp_id string, parent_id string").write.parquet(f"{tmp_path}/experiments.parquet")
    want = set()
    for e in set(up) - {"x", "y", "z"}:
        chain = [e]
        while up.get(chain[-1]) in up:
            chain.append(up[chain[-1]])
        want |= {(e, i, a) for i, a in enumerate(reversed(chain))}
    assert {tuple(r) for r in graphs.lineage(spark, str(tmp_path)).collect()} == want


def test_cycles_of_the_parts_graph(spark, sf):
    near = defaultdict(set)
    for r in graphs.parts_edges(spark, sf).select("from_id", "to_id").collect():
        near[r[0]].add(r[1])

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        return seen

    to = {a: reach(a) for a in list(near)}
    groups = {a: frozenset(b for b in x if a in to.get(b, ())) for a, x in to.items() if a in x}
    assert len(groups) > 25
    assert {tuple(r) for r in graphs.cycles(spark, sf).select("id", "component", "n_nodes").collect()} == {(a, min(g), len(g)) for a, g in groups.items()}


def test_areas_of_the_call_graph(spark, sf):
    calls = {(r[0], r[1]) for r in graphs.call_graph(spark, sf).select("from_id", "to_id").collect()}
    of = {r["id"]: r["community"] for r in graphs.areas(spark, sf).collect()}
    assert calls and of and set(of) <= {x for c in calls for x in c}
    assert {r["community"]: r["n"] for r in more.area_table(spark, sf).collect()} == Counter(of.values())
    between = Counter(tuple(sorted((of[a], of[b]))) for a, b in graphs.call_graph(spark, sf).select("from_id", "to_id").collect() if a in of and b in of and of[a] != of[b])
    assert {(r["a"], r["b"]): r["n"] for r in more.calls_between(spark, sf).collect()} == between


@pytest.fixture(scope="module")
def common(spark, tmp_path_factory):
    """Files whose functions have names in common, and experiments that all name one of them."""
    d, n = str(tmp_path_factory.mktemp("common")), 400
    docs = [(i, "code_file", f"d{i}/a.py", f"def get_it(x):\n    return put_it(x)\ndef only_{i}(x):\n    return get_it(x)\n") for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, source string, path string, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(f"e{i}", f"t{i}", f"run {i} says that get_it waits", "2026-01-01") for i in range(n)], "exp_id string, title string, hypothesis string, created_at string").write.parquet(f"{d}/experiments.parquet")
    return d, n


def test_memories_of_a_common_name_are_not_paired_with_its_symbols(spark, common):
    d, n = common
    s = domain.store(spark, d)
    assert s.applies.count() == n and s.applied().count() == n * n
    pairs = s.applied().select("memory_id", "symbol_id")
    some = s.symbols.filter("name = 'get_it'").select("symbol_id").limit(2)
    assert s.applied(symbols=some).count() == 2 * n and s.applied(memories=s.memories.select("memory_id").limit(3)).count() == 3 * n
    old = domain.inv.Store(**{**vars(s), "applies": pairs})
    query = "refactor get_it"
    got, want = (sorted(map(tuple, domain.inv.rank(x, query).drop("memories").collect())) for x in (s, old))
    assert got == want and any(r[3] > 1 for r in got)


def test_dead_code_of_a_common_name(spark, common):
    d, n = common
    before = shuffled_rows(spark)
    got = [tuple(r) for r in graphs.dead_code(spark, d).collect()]
    assert shuffled_rows(spark) - before < n * n / 4
    assert len(got) == n and {r[1] for r in got} == {"higher"}


def test_areas_of_a_common_name(spark, common):
    d, n = common
    before = shuffled_rows(spark)
    of = graphs.areas(spark, d).collect()
    assert shuffled_rows(spark) - before < n * n
    assert 1.9 * n <= len(of) == 2 * len({r["community"] for r in of})  # a pair that rounds leave apart is no area
    assert {r["n"] for r in more.area_table(spark, d).collect()} == {2}
    assert more.calls_between(spark, d).count() == 0
