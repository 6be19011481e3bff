from pyspark.sql import functions as F

from loomspark.operators import knowledge as kn, state as st
from loomspark.session import register

H = "array<struct<at: string, transition: string, repeats: int>>"


def test_histories(spark):
    df = spark.createDataFrame([([("1", "body_changed", 1), ("2", "unchanged", 3), ("3", "moved", 1), ("4", "unchanged", 2)],), ([],), (None,)], f"h {H}")
    assert [r[0] for r in df.select(st.last_downgrade(F.col("h"))).collect()] == ["body_changed", None, None]
    assert df.select(st.history_summary(F.col("h")).alias("m")).first()["m"] == {"body_changed": 1, "unchanged": 5, "moved": 1}


def test_verify_rebase_candidates(spark):
    a = spark.createDataFrame([("a1", "m1", "s1", "old", "k", "DRIFTED", 0.7, None), ("a2", "m2", "s2", "zz", "k", "ORPHANED", 0.0, "t0")], "anchor_id string, memory_id string, symbol_id string, content_fp string, skeleton_fp string, status string, confidence double, last_verified_at string")
    v = {r["anchor_id"]: (r["status"], r["confidence"], r["last_verified_at"]) for r in st.mark_verified(a, spark.createDataFrame([("m1",), ("m1",)], "memory_id string"), "now").collect()}
    assert v == {"a1": ("ACTIVE", 1.0, "now"), "a2": ("ORPHANED", 0.0, "t0")}
    fp = spark.createDataFrame([("s1", "old", "new", "nk"), ("s2", "old2", "new2", "nk2")], "symbol_id string, old_fp string, new_content_fp string, new_skeleton_fp string")
    assert {(r["anchor_id"], r["content_fp"], r["rebased"]) for r in st.rebase(a, fp).collect()} == {("a1", "new", True), ("a2", "zz", False)}
    assert [r["anchor_id"] for r in st.sweep_order(a, 1).collect()] == ["a1"]
    an = spark.createDataFrame([("a1", "f", "x.py", "k1", [1, 2, 3, 4]), ("a2", "g", "y.py", "kk", [9])], "anchor_id string, name string, file_path string, skeleton_fp string, token_signature array<bigint>")
    sy = spark.createDataFrame([("s1", "f", "z.py", "k9", [7]), ("s2", "h", "x.py", "k8", [1, 2, 3, 5]), ("s3", "q", "w.py", "k1", [8])], "symbol_id string, name string, file_path string, skeleton_fp string, token_signature array<bigint>")
    c = st.anchor_candidates(an, sy)
    assert [tuple(r) for r in c.collect()] == [("a1", "s3", 0.85)]
    assert st.leads(c.withColumn("score", F.lit(0.5))).first()["kind"] == "POSSIBLY_MIGRATED_TO"


def test_supersede_and_reinforce(spark):
    m = spark.createDataFrame([("m1", "old", "ACTIVE", 1, "t0"), ("m2", "x", "ACTIVE", 3, "t0")], "memory_id string, body string, status string, version int, updated_at string")
    out, e = st.supersede(m, spark.createDataFrame([("m1", "n1", "new", "t1"), ("none", "n2", "y", "t1")], "memory_id string, new_id string, body string, at string"))
    assert {(r["memory_id"], r["status"], r["version"]) for r in out.collect()} == {("m1", "SUPERSEDED", 1), ("n1", "ACTIVE", 2), ("m2", "ACTIVE", 3)} and [tuple(r) for r in e.collect()] == [("n1", "m1", "SUPERSEDES")]
    r = st.reinforce(m.withColumn("evidence_count", F.lit(1)), spark.createDataFrame([("m1",), ("m1",)], "memory_id string"))
    assert {(x["memory_id"], x["evidence_count"]) for x in r.collect()} == {("m1", 3), ("m2", 1)}


def test_links_and_problems(spark):
    m = spark.createDataFrame([("r", "invariant", "e", "high"), ("t", "test_evidence", "e", "low"), ("u", "test_evidence", "f", "low")], "memory_id string, kind string, event_id string, severity string")
    assert [tuple(x) for x in kn.coverage_edges(m).collect()] == [("r", "t", "GUARDED_BY")]
    ok, bad = kn.causal_links(spark.createDataFrame([("r", "t", "CAUSED", 0.5), ("r", "t", "CAUSED", 0.9), ("r", "r", "CAUSED", 1.0), ("r", "zz", "LED_TO", 1.0), ("r", "t", "ODD", 1.0)], "from_id string, to_id string, kind string, confidence double"), m)
    assert [tuple(x) for x in ok.collect()] == [("r", "t", "CAUSED", 0.9)] and bad.count() == 3
    anchors = spark.createDataFrame([("r", "s", "ORPHANED", 5), ("t", "s2", "ACTIVE", 5)], "memory_id string, symbol_id string, status string, last_verified_at int")
    edges = spark.createDataFrame([("c", "s2", 9, "CALLS"), ("c", "s", 1, "CALLS"), ("r", "t", 1, "CONTRADICTS")], "from_id string, to_id string, created_at int, kind string")
    assert [(x["problem"], x["subject"]) for x in kn.problems(m, anchors, edges, anchors).collect()] == [("conflict", "r"), ("stale_knowledge", "r"), ("unreviewed_caller", "t")]


def test_commands_and_spans(spark):
    df = spark.createDataFrame([("cat 'a b.py' src/x.py && grep foo y.py; X=1 python run.py | tee out.log",), (None,), ("cat 'open",)], "c string")
    assert [r[0] for r in df.select(kn.shell_files(F.col("c"))).collect()] == [["src/x.py", "run.py", "out.log"], [], []]
    t = spark.createDataFrame([("a\nbb\ncc\n", "bb\ncc"), ("x\nx", "x"), ("a", "zz"), (None, "a")], "t string, n string")
    assert [tuple(r[0]) if r[0] else None for r in t.select(kn.line_span(F.col("t"), F.col("n"))).collect()] == [(2, 3), None, None, None]


def test_views(spark, sf):
    assert "messages" in register(spark, sf) and spark.sql("select count(*) from role_names").first()[0] == 10
