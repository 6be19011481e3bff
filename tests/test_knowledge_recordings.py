import json

from pyspark.sql import functions as F

from loomspark.operators import knowledge as kn
from loomspark.operators import recordings as rec


def test_relations_between_claims(spark):
    rows = [("m1", "invariant", "settle must be idempotent under the native import lock", "e1"), ("m2", "invariant", "settle must be idempotent under the native import lock", "e2"), ("m3", "invariant", "settle must never be idempotent under native import lock", "e3"), ("m4", "warning", "colour of the briefing page", "e4"), ("m5", "invariant", None, "e5")]
    m = spark.createDataFrame([(a, b, c or "", e) for a, b, c, e in rows], "memory_id string, kind string, claim string, event_id string")
    scope = spark.createDataFrame([(r[0], "s1") for r in rows] + [("m1", "s2"), ("m3", "s2")], "memory_id string, target string")
    assert {(r["memory_id"], r["class_id"], r["n"]) for r in kn.restatements(m).filter("n > 1").collect()} == {("m1", "m1", 2), ("m2", "m1", 2)}
    got = {(r["a"], r["b"]): r["relation"] for r in kn.related(m, scope).collect()}
    assert got == {("m1", "m3"): "restates"} or got == {("m1", "m3"): "contradicts"}


def test_claims_scores_and_inference(spark):
    df = spark.createDataFrame([("x\n\nWhy: y", ), ("plain",), (None,)], "b string")
    assert [r[0] for r in df.select(kn.claim(F.col("b"))).collect()] == ["x", "plain", ""]
    m = spark.createDataFrame([(f"m{i}", "native import lock held" if i < 3 else "else", "high") for i in range(4)], "memory_id string, claim string, severity string")
    e = spark.createDataFrame([(f"c{i}", "t") for i in range(4)], "from_id string, to_id string")
    a = spark.createDataFrame([(f"m{i}", f"c{i}") for i in range(4)], "memory_id string, symbol_id string")
    p = kn.shared_rule_on_callers(e, a, m).collect()
    assert len(p) == 1 and p[0]["symbol_id"] == "t" and {"native", "import"} <= set(p[0]["shared"]) and p[0]["severity"] == "medium"
    assert kn.converge(m.withColumn("kind", F.lit("x"))).select("cluster").distinct().count() == 2
    s = spark.createDataFrame([("high", 3, 1, 0, 2, 5)], "s string, e int, h int, u int, r int, n int").select(kn.rule_score(*[F.col(c) for c in "s e h u r n".split()]).alias("v")).first()["v"]
    assert 1.5 < s < 4


def test_detectors(spark):
    sym = spark.createDataFrame([("w", "safe_call", "a.py", "k1"), ("t", "target", "a.py", "k2"), ("c", "caller", "b.py", "k1"), ("q", "test_x", "tests/t.py", "k3")], "symbol_id string, name string, path string, skeleton_fp string")
    edges = spark.createDataFrame([("w", "t", 1.0, 1), ("c", "t", 1.0, 2), ("q", "c", 1.0, 3)], "from_id string, to_id string, confidence double, edge_id long")
    app = spark.createDataFrame([("m", "w"), ("i", "t"), ("i", "w")], "memory_id string, symbol_id string")
    mem = spark.createDataFrame([("m", "warning", "deprecated, do not use", "high"), ("i", "invariant", "holds", "low")], "memory_id string, kind string, claim string, severity string")
    assert [tuple(r) for r in kn.bypassed_wrappers(edges, sym, app).collect()] == [("c", "t", "w")]
    assert [tuple(r) for r in kn.deprecated_callers(edges, sym, mem, app).collect()] == []
    assert [r["symbol_id"] for r in kn.diverging_twins(sym, app).collect()] == ["c"]
    assert [r["symbol_id"] for r in kn.untested(edges, sym, app, mem).collect()] == ["w"]


def tree(fn, total, *children, n=1):
    return {"file": "f", "function": fn, "count": n, "total_ms": total, "self_ms": total - sum(c["total_ms"] for c in children), "errors": {}, "children": list(children)}


def test_trees(spark):
    a = tree("main", 100.0, tree("work", 60.0, tree("work", 20.0), n=2), tree("io", 10.0))
    b = tree("main", 100.0, tree("work", 90.0, tree("work", 20.0), n=2), tree("new", 5.0, tree("below", 1.0)))
    df = spark.createDataFrame([("a", 1, json.dumps(a)), ("b", 1, json.dumps(b)), ("c", 1, "{cut"), ("d", 1, None)], "run string, pid int, tree string")
    n = rec.flatten(df).cache()
    hot = {r["key"]: r for r in rec.hot_functions(n.filter("run = 'a'")).collect()}
    assert hot["f:work"]["total_ms"] == 60.0 and hot["f:work"]["self_ms"] == 60.0 and hot["f:work"]["calls"] == 3
    d = {(r["path"][-1], r["state"]) for r in rec.compare(n.filter("run = 'a'"), n.filter("run = 'b'")).collect()}
    assert d == {("f:work", "time"), ("f:io", "only_a"), ("f:new", "only_b")}
    assert rec.first_divergence(n.filter("run = 'a'"), n.filter("run = 'b'")).first()["path_b"][-1] == "f:new"
    assert rec.runtime_edges(n).count() == 7


def test_events_values_and_profile(spark):
    ev = spark.createDataFrame([(1, 1, i, float(t), k, f) for i, (t, k, f) in enumerate([(0, "enter", "a"), (1, "enter", "b"), (2, "enter", "c"), (5, "leave", "b"), (6, "enter", "b"), (7, "leave", "b"), (9, "leave", "a")])], "pid long, thread long, seq long, at double, kind string, function string")
    got = {"/".join(r["path"]): (r["calls"], r["total"], r["self"]) for r in rec.fold_events(ev).collect()}
    assert got == {"a": (1, 9.0, 4.0), "a/b": (2, 5.0, 2.0), "a/b/c": (1, 3.0, 3.0)}
    v = spark.createDataFrame([("k", "x", i, str(i // 2)) for i in range(20)], "call string, name string, at int, value string")
    c = rec.value_changes(v)
    assert [r["value"] for r in c.orderBy("step").collect()] == ["0", "1", "2", "3", "4", "5", "9"]
    w = rec.value_changes(v.withColumn("value", F.when(F.col("at") >= 6, "z").otherwise(F.col("value"))))
    assert rec.value_difference(c, w).first()["step"] == 4
    nodes = spark.createDataFrame([(1, "root", [2, 3]), (2, "f", [4]), (3, "g", []), (4, "f", None)], "id long, function string, children array<long>")
    smp = spark.createDataFrame([(0, 2, 0), (1, 4, 10), (2, 3, 20), (3, 3, 5)], "i int, node_id long, delta_us long")
    p = {r["function"]: (r["self_us"], r["total_us"]) for r in rec.cpu_profile(nodes, smp).collect()}
    assert p == {"root": (0, 35), "f": (30, 30), "g": (5, 5)}
    x = spark.createDataFrame([("e", 1, "f", "raise"), ("e", 2, "f", "escape"), ("e", 3, "g", "reraise")], "exception string, step int, function string, kind string")
    assert [(r["function"], r["caught"]) for r in rec.exception_chains(x).orderBy("step").collect()] == [("f", False), ("g", True)]
