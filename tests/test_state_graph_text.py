import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import code, graph as g, scale, state as st, text as tx, vector as vx


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, c, i, "x") for i, (a, b, c) in enumerate(pairs)], "from_id long, to_id long, confidence double, edge_id long, extra string")


def random_edges(seed, n=30, m=60):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), round(r.random(), 2)) for _ in range(m)]


def brute_hops(pairs, seeds, depth):
    hops, front = {s: 0 for s in seeds}, set(seeds)
    for h in range(1, depth + 1):
        front = {b for a, b, _ in pairs if a in front} - set(hops)
        hops |= dict.fromkeys(front, h)
    return hops


def test_bfs_trace_and_spread(spark):
    pairs = random_edges(1)
    e = edges(spark, pairs)
    got = {r["id"]: r["hops"] for r in g.bfs(e, spark.createDataFrame([(0,), (5,)], "id long"), 4).collect()}
    assert got == brute_hops(pairs, [0, 5], 4)
    want = brute_hops(pairs, [0], 8)
    for t in (3, 9, 29):
        path = [r["id"] for r in g.trace(e, 0, t).orderBy("hop").collect()]
        assert (len(path) - 1 == want[t] and path[0] == 0 and path[-1] == t and all(any((a, b) == (x, y) for x, y, _ in pairs) for a, b in zip(path, path[1:]))) if t in want else path == []
    s = g.spread(e.withColumn("edge_class", F.lit("deterministic")), spark.createDataFrame([(0, 1.0)], "id long, score double"), 2)
    und = [(a, b, 1) for a, b, _ in pairs] + [(b, a, 1) for a, b, _ in pairs]
    assert {r["id"]: round(r["score"], 6) for r in s.collect()} == {k: round(0.75**v, 6) for k, v in brute_hops(und, [0], 2).items()}


@pytest.mark.parametrize("seed", [2, 3])
def test_components_against_reachability(spark, seed):
    pairs = random_edges(seed, 14, 22)
    nodes = {x for p in pairs for x in p[:2]}
    reach = {n: set(brute_hops(pairs, [n], 20)) for n in nodes}
    want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    assert {r["id"]: r["component"] for r in g.components(edges(spark, pairs)).collect()} == want


def test_louvain_entry_points_and_dead_code(spark):
    two = [(a, b, 1.0) for a in range(4) for b in range(4) if a < b] + [(a, b, 1.0) for a in range(10, 14) for b in range(10, 14) if a < b] + [(0, 10, 0.1)]
    c = {r["id"]: r["community"] for r in g.louvain(edges(spark, two)).collect()}
    assert len({c[i] for i in range(4)}) == 1 and len({c[i] for i in range(10, 14)}) == 1 and c[0] != c[10]
    assert g.louvain(edges(spark, [])).count() == 0
    sym = spark.createDataFrame([(1, "get_user", "get_user", "a/api.py", ['@app.get("/users/{uid}")']), (2, "legacy", "legacy", "a/api.py", ['@bp.route("/legacy", methods=["PUT","DELETE"])']), (3, "tool", "tool", "a/t.py", ["@mcp.tool()"]), (4, "test_a", "test_a", "tests/test_a.py", []), (5, "main", "main", "a/cli.py", []), (6, "plain", "K.plain", "a/x.py", []), (7, "used", "used", "a/x.py", []), (8, "check", "check", "A.java", ["@Test"])], "id long, name string, symbol_path string, path string, decorators array<string>")
    ep = g.entry_points(sym)
    assert {(r["id"], r["kind"], r["detail"]) for r in ep.collect()} == {(1, "route", "GET /users/{uid}"), (2, "route", "PUT|DELETE /legacy"), (3, "tool", "tool"), (4, "test", "test_a"), (5, "cli", "main"), (8, "test", "check")}
    dead = g.unreached(sym.withColumn("kind", F.lit("function")), edges(spark, [(6, 7, 1.0)]), ep, spark.createDataFrame([("plain", "ambiguous")], "leaf string, reason string"), spark.createDataFrame([], "name string")).collect()
    assert [(r["id"], r["confidence"], len(r["weakened_by"])) for r in dead] == [(6, "lower", 2)]


def test_coupling(spark):
    commits = [("c0", p) for p in ("alpha", "beta", "lonely")] + [(f"c{i}", p) for i in (1, 2, 3) for p in ("alpha", "beta")] + [("c4", "lonely")] + [("bulk", f"f{i}") for i in range(50)] + [("bulk", "alpha"), ("bulk", "beta")]
    got = g.coupling(spark.createDataFrame(commits, "sha string, path string")).collect()
    assert [(r["a"], r["b"], r["shared"], r["strength"]) for r in got] == [("alpha", "beta", 4, 1.0)]


SOURCE = '''
import os
from pkg.store import Store

class Refresher:
    def __init__(self):
        self.store = Store()
    def acquire(self, n: int):
        # comment
        return self._lock(n) + self.store.get(n)
    def _lock(self, n):
        return n

@app.get("/x")
def refresh(a):
    return rotate(a)

def rotate(b):
    return os.path.join(b)

refresh(1)
'''


def test_extraction_and_resolution(spark):
    files = spark.createDataFrame([("pkg/a.py", SOURCE), ("pkg/store.py", "class Store:\n    def get(self, k):\n        return k\n"), ("pkg/b.py", "from pkg.a import refresh\ndef post():\n    return refresh(2)\ndef lost():\n    return unknown(3)\n"), ("pkg/broken.py", "def half(import):\n    return post(1)\n"), ("pkg/empty.py", ""), ("pkg/none.py", None)], "file_id string, text string")
    s = code.symbols(files, "file_id", "text").cache()
    assert {r["name"] for r in s.filter("file_id = 'pkg/a.py'").collect()} == {"Refresher", "__init__", "acquire", "_lock", "refresh", "rotate", "<module>"}
    assert s.filter("file_id = 'pkg/broken.py'").first()["extracted_by"] == "tags"
    imp = code.resolve_imports(code.imports(files, "file_id", "text"), files.select("file_id", F.col("file_id").alias("path")))
    assert {(r["from_id"], r["to_id"]) for r in imp.collect()} >= {("pkg/a.py", "pkg/store.py"), ("pkg/b.py", "pkg/a.py"), ("pkg/a.py", "extern:os")}
    edges_, missed = code.resolve_calls(s, imp)
    name = {r["symbol_id"]: r["name"] for r in s.collect()}
    got = {(name[r["from_id"]], name[r["to_id"]]): r["tier"] for r in edges_.collect()}
    assert got[("acquire", "_lock")] == "receiver_self" and got[("acquire", "get")] == "receiver_typed" and got[("refresh", "rotate")] == "same_file" and got[("post", "refresh")] == "imported"
    assert {(r["leaf"], r["reason"]) for r in missed.collect()} >= {("unknown", "external")}


def test_fingerprints_ignore_what_they_should():
    a, b = code.fingerprints("def f(x):\n    return x + 1  # c\n"), code.fingerprints("def f( x ):\n\n    return x+1\n")
    c, d = code.fingerprints("def f(y):\n    return y + 2\n"), code.fingerprints("def f(x):\n    return x - 1\n")
    assert a["content_fp"] == b["content_fp"] != c["content_fp"] and a["skeleton_fp"] == c["skeleton_fp"] != d["skeleton_fp"] and a["alpha_fp"] == c["alpha_fp"]
    assert len(code.signature([str(i) for i in range(500)])) == code.SIGNATURE and code.signature([]) == []


def test_previous_row_with_a_hot_group(spark):
    rows = [("hot", i, i % 7) for i in range(500)] + [("k", 1, 5), (None, 1, 1), (None, 2, 2)]
    df = spark.createDataFrame(rows, "g string, at int, v int")
    key = lambda x: sorted(((r["g"] or "", r["at"], r["p"]["v"] if r["p"] else None) for r in x.collect()), key=str)
    assert key(scale.previous(df, "g", ["at"], ["v"], "p", at_least=100)) == key(scale.previous(df, "g", ["at"], ["v"], "p"))


def test_reconcile_keeps_identities(spark):
    cols = "file_id string, content_fp string, symbol_path string, skeleton_fp string, name string"
    stored = spark.createDataFrame([("s1", "f", "c1", "a", "k1", "a"), ("s2", "f", "c2", "b", "k2", "b"), ("s3", "f", "c3", "c", "k3", "c"), ("s4", "f", "c4", "d", "k4", "d")], "symbol_id string, " + cols)
    seen = spark.createDataFrame([("f", "c1", "moved", "k1", "moved"), ("f", "new", "b", "k9", "b"), ("f", "zz", "K.c", "k3", "c"), ("f", "q", "brand", "kq", "new")], cols)
    got = {(r["symbol_path"], r["symbol_id"], r["state"]) for r in st.reconcile(stored, seen).collect()}
    assert got == {("moved", "s1", "kept"), ("b", "s2", "kept"), ("K.c", "s3", "kept"), ("brand", None, "new"), ("d", "s4", "deleted")}


def test_anchor_cascade_is_monotone(spark):
    a = spark.createDataFrame([("a1", "p", "f", "c1", "k1", "ACTIVE", 1.0), ("a2", "gone", "f", "c2", "k2", "ACTIVE", 1.0), ("a3", "r", "f", "cx", "k3", "ACTIVE", 1.0), ("a4", "s", "f", "cy", "ky", "ACTIVE", 1.0), ("a5", "no", "f", "no", "no", "ACTIVE", 1.0), ("a6", "no2", "f", "no2", "no", "ACTIVE", 1.0), ("a7", "p", "f", "c1", "k1", "SUPERSEDED", 0.3)], "anchor_id string, symbol_path string, file_path string, content_fp string, skeleton_fp string, status string, confidence double")
    s = spark.createDataFrame([("s1", "p", "f", "c1", "k1"), ("s2", "elsewhere", "g", "c2", "k2"), ("s3", "r", "f", "c9", "k3"), ("s4", "s", "f", "c8", "k8")], "symbol_id string, symbol_path string, file_path string, content_fp string, skeleton_fp string")
    sim = spark.createDataFrame([("a5", "s4", 0.9), ("a5", "s3", 0.1), ("a6", "s1", 0.5)], "anchor_id string, symbol_id string, score double")
    got = {r["anchor_id"]: (r["status"], r["transition"], r["symbol_id"]) for r in st.anchor_cascade(a, s, sim).collect()}
    assert got == {"a1": ("ACTIVE", "unchanged", "s1"), "a2": ("ACTIVE", "moved", "s2"), "a3": ("ACTIVE", "renamed_internals", "s3"), "a4": ("NEEDS_REVIEW", "body_changed", "s4"), "a5": ("DRIFTED", "migrated", "s4"), "a6": ("ORPHANED", "orphaned", None), "a7": ("SUPERSEDED", "unchanged_unverified", "s1")}


def test_upsert_versions_history(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert {tuple(r) for r in st.upsert(base, new, ["k"]).collect()} == {(1, "a"), (2, "d"), (3, "e"), (None, "n")}
    h = spark.createDataFrame([([("t", "unchanged", 1)], ("u", "unchanged", 1)), ([], ("u", "moved", 1)), ([(str(i), "moved", 1) for i in range(25)], ("z", "unchanged", 1))], "h array<struct<at: string, transition: string, repeats: int>>, e struct<at: string, transition: string, repeats: int>")
    got = [r[0] for r in h.select(st.push_history(F.col("h"), F.col("e"))).collect()]
    assert [tuple(x) for x in got[0]] == [("t", "unchanged", 2)] and len(got[1]) == 1 and len(got[2]) == 25 and got[2][-1]["at"] == "z"


def test_query_grammar_and_scoring(spark):
    assert [c.needle() for c in tx.parse('"a b" x* src/auth.ts')] == [" a  b ", " x", " src  auth  ts "]
    with pytest.raises(ValueError):
        tx.parse("--")
    assert tx.query_terms("the RefreshCoordinator") == ["RefreshCoordinator", "Refresh", "Coordinator"] and "anchor" in tx.variants("reanchor") and "reanchor" in tx.variants("re-anchor")
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None), (4, ""), (5, "ab a, b")], "id int, t string")
    s = tx.bm25(docs, "t", tx.parse("a"))
    assert [r["id"] for r in s.orderBy(F.desc("score")).collect()][0] == 1 and s.count() == 2
    n = tx.normal(F.col("t"))
    assert [r[0] for r in docs.orderBy("id").select(tx.count(n, tx.Clause(("a",)))).collect()] == [2, 0, 0, 0, 1] and [r[0] for r in docs.orderBy("id").select(tx.length(n)).collect()] == [3, 1, 0, 0, 3]
    assert tx.bm25(docs.limit(0), "t", tx.parse("a")).count() == 0
    f = tx.fuse([docs.select("id", F.lit(1.0).alias("score")), docs.select("id", (-F.col("id")).cast("double").alias("score"))])
    assert f.agg(F.max("score")).first()[0] == 1.0 and f.count() == 5


def test_vectors_refresh(spark):
    items = spark.createDataFrame([("s", "1", "abc"), ("s", "2", "new"), ("s", "3", None)], "scope string, item_id string, text string")
    old = vx.refresh(items.filter("item_id = '1'"), spark.createDataFrame([], "scope string, item_id string, content_hash string, encoder_id string, vector array<double>"), "e1")
    dead = spark.createDataFrame([("s", "9", "h", "e1", [0.0])], "scope string, item_id string, content_hash string, encoder_id string, vector array<double>")
    kept = old.unionByName(dead)
    assert {r["item_id"] for r in vx.stale(items, kept, "e1").collect()} == {"2", "3"} and {r["item_id"] for r in vx.refresh(items, kept, "e1").collect()} == {"1", "2", "3"}
    assert vx.stale(items, kept, "e2").count() == 3


def test_index_scores_like_the_scan(spark):
    import random

    from loomspark.operators import text as tx

    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["lease", "leases", "queue", "retry-queue", "the", "Ledger"]) for _ in range(rnd.randint(0, 12))) or None) for i in range(300)] + [(900, ""), (901, "x" * 50_000), (None, "lease")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "id long, text string, term string, tf int")
    index = tx.TextIndex(df, "id", "text")
    known = df.filter("id is not null")
    for query in ("lease", "lease queue", "lea* ledger", '"retry queue" the', "absent"):
        clauses = tx.parse(query, "any")
        want = {r["id"]: round(r["score"], 9) for r in tx.bm25(known, "text", clauses).collect()}
        assert {r["id"]: round(r["score"], 9) for r in index.hits(clauses).collect()} == want, query
    own = known.filter("id < 100")
    assert {r["id"]: round(r["score"], 9) for r in index.hits(tx.parse("lease"), own).collect()} == {r["id"]: round(r["score"], 9) for r in tx.bm25(own, "text", tx.parse("lease")).collect()}
    assert tx.TextIndex(df.limit(0), "id", "text").hits(tx.parse("lease")).count() == 0


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_calls_of_a_common_name_do_not_meet_its_symbols(spark):
    n = 500
    files = spark.createDataFrame([(f"d{i:03}/a.py", f"def get(x):\n    return put(x)\ndef only{i}(x):\n    return get(x)\n") for i in range(n)] + [("z/b.py", "def put(x):\n    return put(x)\ndef ask(x):\n    return get(x)\ndef out(x):\n    return gone(x)\n")], "file_id string, text string")
    s = code.symbols(files, "file_id", "text").localCheckpoint()
    before = shuffled_rows(spark)
    edges_, missed = code.resolve_calls(s, spark.createDataFrame([], "from_id string, to_id string, deferred boolean"))
    assert edges_.groupBy("tier").count().collect() and missed.count() == 3
    assert shuffled_rows(spark) - before < 30 * s.count()
    name = {r["symbol_id"]: r["name"] for r in s.collect()}
    got = [(name[r["from_id"]], name[r["to_id"]], r["tier"]) for r in edges_.collect()]
    assert got.count(("get", "put", "unique_global")) == n and sum(t == "same_file" for _, _, t in got) == n and len(got) == 2 * n
    assert {(r["leaf"], r["reason"], r["candidates"]) for r in missed.collect()} == {("put", "external", 0), ("get", "ambiguous", n), ("gone", "external", 0)}
