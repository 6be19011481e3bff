import random
import re

from pyspark.sql import functions as F

from loomspark.operators import index, investigate, record, recordings
from loomspark.sources import archive


def test_session_lookup_by_falling_certainty(spark):
    rows = [("k1", "nat-1", "/a/1", None, "2026-01-01", "x"), ("nat-9", "nat-2", "/a/2", "/l/2", "2026-01-02", "x"), ("k3", "nat-9", "/a/1", None, None, "x")] + [(f"p{i}", f"pre-{i}", None, None, f"2026-02-{i + 1:02d}", "x") for i in range(8)]
    s = spark.createDataFrame(rows, "session_key string, native_id string, source_path string, live_path string, updated_at string, asked string")
    asked = spark.createDataFrame([("k1",), ("nat-9",), ("/a/1",), ("/l/2",), ("pre-",), ("none",), ("",), (None,), ("k1",)], "asked string")
    got = {}
    for r in record.find_sessions(s, asked).collect():
        got.setdefault((r["asked"], r["how"]), set()).add(r["session_key"])
    assert got == {("k1", "key"): {"k1"}, ("nat-9", "key"): {"nat-9"}, ("/a/1", "name"): {"k1", "k3"}, ("/l/2", "name"): {"nat-9"}, ("pre-", "prefix"): {"p3", "p4", "p5", "p6", "p7"}}
    assert record.find_sessions(s.limit(0), asked).count() == 0 and record.find_sessions(s, asked.limit(0)).count() == 0


def test_pages(spark):
    m = spark.createDataFrame([("k", i, "user" if i % 2 else "tool", "message", "x" * (i * 10), i) for i in range(10)] + [("k", None, "user", "message", "y", 99)], "session_key string, ordinal int, role string, kind string, text string, id long")
    got = record.fetch(m, m.select("session_key"), 1, 3, ["user"], None, 40).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["next_ordinal"]) for r in got] == [(1, None), (3, None), (5, 6)] and got[2]["text"] == "x" * 40 + " [... 10 more chars]"


def test_anchor_snapshot_and_whole_record(spark):
    links = spark.createDataFrame([("m1", "s1", None), ("m1", None, "f2"), ("m2", "gone", None)], "memory_id string, symbol_id string, file_id string")
    syms = spark.createDataFrame([("s1", "f1", "A.b", 3, 9, "c", "k")], "symbol_id string, file_id string, symbol_path string, line_start int, line_end int, content_fp string, skeleton_fp string")
    files = spark.createDataFrame([("f1", "a.py"), ("f2", "b.py")], "file_id string, path string")
    a = record.anchor_snapshot(links, syms, files, F.lit("c0"), F.lit("t"))
    assert {(r["memory_id"], r["target_kind"], r["file_path"], r["symbol_path"]) for r in a.collect()} == {("m1", "symbol", "a.py", "A.b"), ("m1", "file", "b.py", None), ("m2", "repo", None, None)}
    edges = spark.createDataFrame([("m1", "K", "x", 1.0, "ACTIVE")], "from_id string, kind string, to_id string, confidence double, status string")
    versions = spark.createDataFrame([("m1", 1, "t1", "a"), ("m1", 2, "t2", "b")], "memory_id string, version int, changed_at string, reason string")
    w = {r["memory_id"]: r for r in record.whole_record(spark.createDataFrame([("m1",), ("m3",)], "memory_id string"), a, edges, versions).collect()}
    assert len(w["m1"]["anchors"]) == 2 and [v["version"] for v in w["m1"]["versions"]] == [2, 1] and w["m3"]["anchors"] == [] and w["m3"]["edges"] == []


def test_recovery_takes_only_what_grew(spark):
    m = spark.createDataFrame([("m1", "the claim...", "ACTIVE", "e1"), ("m2", "whole", "ACTIVE", "e1"), ("m3", "long enough to stay as it is...", "ACTIVE", "e2"), ("m4", "x...", "ACTIVE", "e3")], "memory_id string, body string, status string, event_id string")
    e = spark.createDataFrame([("e1", "a test run", '{"reasoning": "it broke", "changes": ["a", "", "b"]}'), ("e2", None, "{}"), ("e3", "s", "{cut")], "event_id string, summary string, payload string")
    a = spark.createDataFrame([("m1", 2, None, "f.py"), ("m1", 1, "S.t", "f.py"), ("m1", 3, "S.t", None)], "memory_id string, at int, symbol_path string, file_path string")
    got = record.recovered(m, e, a).collect()
    assert [(r["memory_id"], r["body"]) for r in got] == [("m1", "the claim\n\nRecorded while: a test run\n\nWhy: it broke\n\nChanged: a; b\n\nApplies to: S.t, f.py")]


def test_touched_symbols_against_brute_force(spark):
    patch = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@ def outer\n-old = 1\n+new = call(arg)\n context_only\n+++ /dev/null\n+lost\n+++ b/y.py\n+second"
    ids = {(r["path"], r["name"]) for r in record.touched_identifiers(spark.createDataFrame([("p", patch), ("q", None), ("r", "")], "patch_id string, patch string")).collect()}
    assert ids == {("x.py", n) for n in "def outer old new call arg".split()} | {("y.py", "second")}
    syms = spark.createDataFrame([(p, n, f"{p}:{n}", n, i, s) for i, (p, n, s) in enumerate([("x.py", "outer", "ACTIVE"), ("x.py", "call", "GONE"), ("x.py", "context_only", "ACTIVE"), ("y.py", "outer", "ACTIVE"), ("y.py", "second", "ACTIVE")])], "path string, name string, symbol_id string, symbol_path string, line_start int, status string")
    got = record.touched_symbols(record.touched_identifiers(spark.createDataFrame([("p", patch)], "patch_id string, patch string")), syms).collect()
    assert {r["symbol_id"] for r in got} == {"x.py:outer", "y.py:second"}


def test_workspaces(spark):
    f = spark.createDataFrame([("/u/ws/abc/workspace.json", '{"folder": "file:///c%3A/My%20Code"}'), ("/u/ws/d/workspace.json", '{"workspace": "file:///srv/x+y"}'), ("/u/ws/e/workspace.json", "{cut"), ("/u/ws/f/workspace.json", None)], "path string, content string")
    assert {(r[0], r[1]) for r in record.workspace_map(f).collect()} == {("abc", "c:/My Code"), ("d", "/srv/x+y")}


def test_stories_histories_and_observations(spark):
    n = spark.createDataFrame([("r", ["root"], 0, 1, 50.0), *[("r", ["root", f"a{i}"], 1 + 10 * i, 1, float(i)) for i in range(4)], *[("r", ["root", "a3", f"c{i}"], 40 + i, 2, 1.0) for i in range(5)]], "run string, path array<string>, position int, calls long, total_ms double")
    got = {r["activity"]: (r["step"], r["n_children"], r["called"]) for r in recordings.narrative(n, 2, 3).collect()}
    assert got == {"a3": (1, 5, "c0, c1, c2"), "a2": (2, 0, "")}
    assert recordings.tree_totals(n).first()["calls"] == 15
    e = spark.createDataFrame([("1", "a", "b", 5), ("2", "c", "b", 1), ("2", "a", "d", 1), ("0", "x", "old", 9), ("3", "z", "z", 1)], "run string, caller string, callee string, calls long")
    o = {r["key"]: (r["run"], r["calls"], r["called_by"]) for r in recordings.observed(e, spark.createDataFrame([("b",), ("old",), ("none",)], "key string")).collect()}
    assert o == {"b": ("2", 1, ["c"]), "old": ("3", 0, []), "none": ("3", 0, [])}
    c = spark.createDataFrame([("r", "f", "c1", i, "x", v) for i, v in enumerate("aab")] + [("r", "f", "c2", 9, "x", "zz"), ("r", "g", "c1", 1, "y", "q")], "run string, function string, call string, at int, name string, value string")
    costs = spark.createDataFrame([("r", "f", 5.0), ("r", "g", 1.0)], "run string, function string, total_ms double")
    assert [(r["function"], r["name"], r["trail"]) for r in recordings.costliest_histories(c, costs, 1).collect()] == [("f", "x", "a -> b")]
    errs = spark.createDataFrame([("r", i, t) for i, t in enumerate(["StopIteration", "ValueError", "KeyError"])], "run string, at int, type string")
    assert [r["type"] for r in recordings.error_events(errs, 1).collect()] == ["ValueError"]
    runs = spark.createDataFrame([("/t/run1/a.json", 5), ("/t/run1/b.json", 3), ("/t/run2/a.json", 9)], "path string, modified long")
    assert {(r["run"], r["started"], r["n_files"]) for r in recordings.run_list(runs).collect()} == {("run1", 3, 2), ("run2", 9, 1)}


def test_archived_sources(spark):
    v = spark.createDataFrame([("k1", 1, "/l/1"), ("k1", 2, "/l/1"), ("k2", 1, "/l/2"), ("k3", 1, "/l/1"), ("k4", 1, "/l/4")], "key string, generation int, live_path string")
    t = spark.createDataFrame([("/L/4", "exclude_all")], "target string, mode string")
    got = {(r["key"], r["generation"], r["origin"], r["live_path"]) for r in archive.archived_sources(v, spark.createDataFrame([("/l/1",)], "path string"), t).collect()}
    assert got == {("k1", 2, "archive", "/l/1"), ("k1", 1, "archive_version", None), ("k2", 1, "archive_only", "/l/2")}


def test_a_change_beyond_the_beginning_is_seen(spark):
    big = b"x" * (3 << 20)
    none = spark.createDataFrame([], "key string, generation int, bytes long, prefix_hash string, content binary")
    one = archive.next_archive(archive.sync(none, spark.createDataFrame([("k", big)], "key string, content binary")))
    changed = big[:-5] + b"y" + big[-4:]
    assert archive.sync(one, spark.createDataFrame([("k", changed)], "key string, content binary")).first()["action"] == "rotated"
    assert archive.sync(one, spark.createDataFrame([("k", big + b"z")], "key string, content binary")).first()["action"] == "appended"


def test_index_refresh_parses_only_what_changed(spark, tmp_path):
    f = lambda *r: spark.createDataFrame(list(r), "file_id string, path string, text string")
    i = index.CodeIndex(spark, str(tmp_path / "ix"))
    a, b, c = ("1", "a.py", "def one():\n    pass\n"), ("2", "b.py", "def two():\n    one()\n"), ("3", "c.py", None)
    assert {tuple(r) for r in i.refresh(f(a, b, c)).collect()} == {("added", 3)}
    assert {r["status"] for r in i.files().filter("file_id = '3'").collect()} == {"skipped"}
    before = {r["name"]: r["symbol_id"] for r in i.symbols().collect()}
    assert {tuple(r) for r in i.refresh(f(a, (*b[:2], "def three():\n    one()\n"), ("4", "d.py", "def four(): pass"))).collect()} == {("same", 1), ("changed", 1), ("removed", 1), ("added", 1)}
    after = {r["name"]: r["symbol_id"] for r in i.symbols().collect()}
    assert after["one"] == before["one"] and "two" not in after and {"three", "four"} <= set(after)
    assert index.CodeIndex(spark, i.root).symbols().count() == i.symbols().count()
    assert i.calls()[0].count() >= 1
    tree = tmp_path / "src"
    for p, t in (("a.py", b"x = 1"), ("pkg/b.py", b"y = 2"), ("node_modules/z.js", b"no"), ("bin.dat", b"\xff\xfe")):
        (tree / p).parent.mkdir(parents=True, exist_ok=True)
        (tree / p).write_bytes(t)
    assert {(r["path"], r["text"]) for r in index.scan_tree(spark, str(tree)).collect()} == {("a.py", "x = 1"), ("pkg/b.py", "y = 2"), ("bin.dat", None)}


def test_empty_result():
    e = investigate.empty_result("how is the")
    assert e["terms"] == [] and e["capsules"] == [] and e["intent"] == "understand" and re.search("no terms", e["note"])


def test_scopes_and_queues_on_random_rows(spark):
    rnd = random.Random(2)
    a = [(f"m{rnd.randint(0, 4)}", f"s{rnd.randint(0, 6)}", f"f{rnd.randint(0, 3)}", rnd.choice(["ACTIVE", "ACTIVE", "ORPHANED"])) for _ in range(30)]
    e = [(f"c{rnd.randint(0, 5)}", f"s{rnd.randint(0, 6)}") for _ in range(30)]
    got = {r["memory_id"]: (r["n_files"], r["n_callers"], r["all_active"]) for r in record.rule_scope(spark.createDataFrame(a, "memory_id string, symbol_id string, file_path string, status string"), spark.createDataFrame(e, "from_id string, to_id string")).collect()}
    for m in {x[0] for x in a}:
        own = [x for x in a if x[0] == m]
        assert got[m] == (len({x[2] for x in own}), len({c for c, s in e if s in {x[1] for x in own}}), all(x[3] == "ACTIVE" for x in own))
