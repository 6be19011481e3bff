import json

from pyspark.sql import functions as F

from loomspark.operators import view as v


def test_sections_in_the_order_of_the_text(spark):
    rows = [("c\n\nWhy: w\n\nRecorded while: r", [("", "c"), ("Why", "w"), ("Recorded while", "r")]), ("Why: only", [("Why", "only")]), ("plain", [("", "plain")]), ("c Why:  ", [("", "c Why:")]), ("", []), (None, [])]
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(rows)], "i int, b string")
    got = {r["i"]: [(s["label"], s["text"]) for s in r["s"]] for r in df.select("i", v.sections(F.col("b")).alias("s")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_display_follows_the_focus(spark):
    e = spark.createDataFrame([("m1", "s1", "APPLIES_TO", "a.py", "A.x", None), ("m1", "s2", "APPLIES_TO", "b.py", "B", None), ("m1", "s3", "CALLER", None, None, '{"target": "A.x"}'), ("m1", "s4", "CALLER", None, None, '{"target": "B"}'), ("m1", "s5", "CALLER", None, None, "{cut"), ("m2", "s2", "APPLIES_TO", "b.py", "B", None)], "memory_id string, symbol_id string, kind string, file_path string, symbol_path string, evidence string")
    f = spark.createDataFrame([("m1", "A.x"), ("m1", None), ("m3", "z")], "memory_id string, path string")
    assert {(r["memory_id"], r["symbol_id"]) for r in v.displayed(e, f).collect()} == {("m1", "s1"), ("m1", "s3"), ("m1", "s5"), ("m2", "s2")}


def test_lists_titles_and_highlights(spark):
    df = spark.createDataFrame([('"a"',), ('["x", " ", 3, null]',), ("7",), ("null",), ("{cut",), (None,), ('""',)], "j string")
    assert [r[0] for r in df.select(v.as_list(F.col("j"))).collect()] == [["a"], ["x", "3"], ["7"], [], [], [], []]
    t = spark.createDataFrame([("a <b> A&b",), (None,)], "t string")
    assert [r[0] for r in t.select(v.highlighted(F.col("t"), "a&b")).collect()] == ["a &lt;b&gt; <mark>A&amp;b</mark>", None]
    assert t.select(v.highlighted(F.col("t"), "<B>")).first()[0] == "a <mark>&lt;b&gt;</mark> A&amp;b"
    s = spark.createDataFrame([("k1", "n1", None), ("k2", "n2", "own"), ("k3", None, None)], "session_key string, native_id string, title string")
    log = spark.createDataFrame([(1, json.dumps({"id": "n1", "thread_name": "old"})), (2, json.dumps({"id": "n1", "thread_name": "** new *"})), (3, "{cut"), (4, json.dumps({"id": "n2", "thread_name": "x"})), (5, None)], "at long, line string")
    assert {(r["session_key"], r["title"]) for r in v.with_titles(s, log).collect()} == {("k1", "new"), ("k2", "own"), ("k3", None)}
    assert [r[0] for r in spark.createDataFrame([("One. Two.",), ("no end",)], "t string").select(v.first_sentence(F.col("t"))).collect()] == ["One.", "no end"]


def test_seeds_siblings_and_settings(spark):
    n = spark.createDataFrame([(f"e{i}", "symbol", f"l{i}", i, "route" if i < 3 else "test" if i == 3 else None) for i in range(8)], "id string, kind string, label string, degree int, entry_point string")
    assert v.default_seed(n).first()["id"] == "e1" and v.default_seed(n.filter("degree >= 3")).first()["id"] == "e6" and v.default_seed(n.limit(0)).count() == 0
    roots = spark.createDataFrame([("/a", "billing"), ("/b", "bill"), ("/c", "here")], "root string, name string")
    assert [r["name"] for r in v.named_siblings("how does Billing call bill, here?", roots, "/c").collect()] == ["billing", "bill"]
    assert v.repo_config('[related]\nx = "y"\n') == {"related": {"x": "y"}} and v.repo_config("not toml [") == {} and v.repo_config(None) == {}
    r = spark.createDataFrame([("a", "b"), ("b", "c")], "from_path string, to_path string")
    p = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "a"), ("a", "a"), (None, "b")], "old_path string, new_path string")
    assert {(x["old_path"], x["new_path"]) for x in v.rename_evidence(p, r).filter("moved").collect()} == {("a", "b"), ("a", "c")}


def test_saved_answers(spark):
    a = json.dumps({"data": [{"paper_id": "2401.00001v2", "title": "T", "abstract": "x" * 20, "snippets": [{"snippet": "s1"}, "s2", None, "s3", "s4"]}, {"paper_id": "2401.00001"}, {"link": "https://x.test/abs/2402.1", "title": "U"}, "odd"]})
    df = spark.createDataFrame([("a1", a), ("a2", "{cut"), ("a3", None), ("a4", "[]")], "answer_id string, answer string")
    got = {r["rank"]: (r["paper_id"], r["abstract"], r["snippets"]) for r in v.answers(df, 3, 10).collect()}
    assert got == {1: ("2401.00001", "x" * 10, ["s1", "s2", "s3"]), 2: ("2402.1", None, [])}


def test_visible_and_coverage(spark):
    n = spark.createDataFrame([("a", "k", "ACTIVE", "Alpha", None), ("b", "k", "ACTIVE", "beta", "alpha too"), ("c", "k", "GONE", "alpha", None)], "id string, kind string, status string, label string, body string")
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "from_id string, to_id string")
    nodes, edges = v.visible(n, e, ["k"], ["ACTIVE"], None, "ALPHA")
    assert {r["id"] for r in nodes.collect()} == {"a", "b"} and [tuple(r) for r in edges.collect()] == [("a", "b")]
    c = spark.createDataFrame([("1", "x\\y.py"), ("1", "z"), ("2", "z")] + [("3", f"f{i}") for i in range(5)], "sha string, path string")
    assert tuple(v.coverage(c, spark.createDataFrame([("x/y.py",), ("q",)], "path string"), 4).first()) == ("lower-bound", 3, 2, 1, 1)
    assert v.coverage(c.limit(0), c.select("path")).first()["commits_considered"] == 0
