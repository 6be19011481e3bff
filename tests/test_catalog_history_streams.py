from pyspark.sql import functions as F

from loomspark.operators import catalog as c
from loomspark.sources import history as h
from loomspark.streaming import jobs


def test_history(spark):
    log = "@aaa 100\n\n1\t2\tsrc/{old => new}/a.py\n-\t-\timg.png\n@bbb 200\n\n@ccc 300\n\n5\t0\tx => y\n"
    got = {tuple(r) for r in h.parse_numstat(spark.createDataFrame([(log,), (None,)], "t string"), "t").select("sha", F.unix_seconds("ts"), "path", "added", "deleted").collect()}
    assert got == {("aaa", 100, "src/new/a.py", 1, 2), ("aaa", 100, "img.png", 0, 0), ("ccc", 300, "y", 5, 0)}
    s = spark.createDataFrame([(" M a.py\0R  new.py\0old.py\0?? x y.txt\0",)], "t string")
    assert {r[0] for r in h.parse_status(s, "t").collect()} == {"a.py", "new.py", "old.py", "x y.txt"}
    assert h.changed_since(s, None) == (None, False)
    df = spark.createDataFrame([("main",), ("0123abcd",), (None,)], "c string")
    assert [r[0] for r in df.select(h.commit_or_null(F.col("c"))).collect()] == [None, "0123abcd", None]


def test_catalog(spark):
    df = spark.createDataFrame([("https://u@Host.org:443/a/b.git/",), ("git@host.org:a/b.git",), ("ssh://git@host.org/a/b",), (None,)], "u string")
    assert [r[0] for r in df.select(c.normal_remote(F.col("u"))).collect()] == ["host.org/a/b"] * 3 + [None]
    al = spark.createDataFrame([("r1", "x", 1), ("r2", "y", 5), ("r2", "z", 1), ("r3", "z", 1)], "repo_id string, alias string, weight int")
    pr = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "none")], "probe_id string, alias string")
    assert [tuple(r) for r in c.identify(al, pr).collect()] == [("p", "r2")]
    e = spark.createDataFrame([("e1", "y", "PENDING"), ("e2", "z", "PENDING"), ("e3", "y", "ACTIVE")], "edge_id string, to_ref string, status string")
    assert {(r["edge_id"], r["status"], r["to_repo"]) for r in c.heal_pending(e, al).collect()} == {("e1", "ACTIVE", "r2"), ("e2", "PENDING", None), ("e3", "ACTIVE", None)}
    probes = spark.createDataFrame([("p", "root", "/new", ["a"]), ("q", "root", "/old", ["a"]), ("s", "root", "/n", ["k"])], "probe_id string, root_commit string, path string, remotes array<string>")
    repos = spark.createDataFrame([("r", "root", ["k"], ["/old"])], "repo_id string, root_commit string, remotes array<string>, paths array<string>")
    assert [r["probe_id"] for r in c.forks(probes, repos).collect()] == ["p"]


def test_resolution_and_delivery(spark):
    syms = spark.createDataFrame([("s1", "acquire", "Refresh.acquire", "a.py", 10), ("s2", "rotate_token", "rotate_token", "a.py", 20), ("s3", "twin", "A.twin", "a.py", 30), ("s4", "twin", "B.twin", "b.py", 30)], "symbol_id string, name string, symbol_path string, path string, line_start int")
    refs = spark.createDataFrame([("Refresh.acquire",), ("acquire",), ("twin",), ("rotate token",), ("nothing",)], "ref string")
    got = {r["ref"]: (r["symbol_id"], r["n"]) for r in c.resolve_names(refs, syms).collect()}
    assert got == {"Refresh.acquire": ("s1", 1), "acquire": ("s1", 1), "twin": (None, 2), "rotate token": ("s2", 1)}
    obs = spark.createDataFrame([("a.py", "acquire", "Refresh.acquire", 99), ("a.py", "rotate_token", "x", 22), ("a.py", "rotate_token", "x", 40)], "path string, name string, qualified string, line int")
    assert {(r["line"], r["symbol_id"]) for r in c.near_lines(obs, syms).collect()} == {(99, "s1"), (22, "s2"), (40, None)}
    mem = spark.createDataFrame([("m1", "x" * 100, "low", 0.9, 0, 0, 1), ("m2", "x" * 100, "high", 0.9, 0, 0, 1), ("m3", "x", "high", 0.1, 0, 0, 1), ("m4", "x", "high", 0.9, 0, 3, 1), ("m5", "y", "critical", 0.9, 0, 0, 1)], "memory_id string, claim string, severity string, confidence double, helpful int, unhelpful int, evidence int")
    anc = spark.createDataFrame([(m, "a.py", 10, 20) for m in ("m1", "m2", "m3", "m4")] + [("m5", "a.py", 50, 60), ("m5", "b.py", None, None)], "memory_id string, file_path string, lo int, hi int")
    tou = spark.createDataFrame([("s", "a.py", 15, 16), ("t", "b.py", None, None)], "session_id string, file_path string, lo int, hi int")
    done = spark.createDataFrame([("s", "m1")], "session_id string, memory_id string")
    assert {(r["session_id"], r["memory_id"]) for r in c.deliver(mem, anc, tou, done).collect()} == {("s", "m2"), ("t", "m5")}
    ho = spark.createDataFrame([("h1", "OPEN", 1, None), ("h2", "OPEN", 2, None), ("h3", "DONE", 3, "z")], "handoff_id string, status string, created_at int, claimed_by string")
    one = c.claim_handoff(ho, "me")
    assert {(r["handoff_id"], r["status"], r["claimed_by"]) for r in one.collect()} == {("h1", "OPEN", None), ("h2", "CLAIMED", "me"), ("h3", "DONE", "z")}


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(i, i % 3, f"2026-01-01 00:{i:02d}:00", float(i)) for i in range(30)], "id int, user int, t string, v double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    e.repartitionByRange(3, "id").write.parquet(str(tmp_path / "in"))
    s = jobs.read_events(spark, str(tmp_path / "in"), e.schema)
    for _ in range(2):  # a second run finds nothing new
        jobs.sync(s, str(tmp_path / "out"), str(tmp_path / "cp"), ["user"], "ts").awaitTermination()
    assert {(r["user"], r["id"]) for r in jobs.newest(spark, str(tmp_path / "out")).collect()} == {(0, 27), (1, 28), (2, 29)}
    assert jobs.run_to_table(jobs.once(s, ["user"], "ts", "1 day"), str(tmp_path / "once"), str(tmp_path / "cp2")).count() == 3
    w = jobs.run_to_table(jobs.tumbling(s, "ts", "10 minutes", "1 minute", ["user"], "v"), str(tmp_path / "win"), str(tmp_path / "cp3"))
    assert w.agg(F.sum("n")).first()[0] in (10, 20)  # the last windows are still open
    f = str(tmp_path / "lease")
    assert jobs.lease(spark, f, "a", 100.0) and not jobs.lease(spark, f, "b", 120.0) and jobs.lease(spark, f, "b", 200.0)
