import json

from loomspark.operators import drift


def profile(spark, rows, target=None, many=False):
    df = spark.createDataFrame([(*r, 1) for r in rows], "surface string, parser_version string, j string, n int")
    return drift.profile(df, "j", target or {}, many, ["surface", "parser_version"], "meta_json")


def test_changes_between_versions(spark):
    rows = []
    for i in range(40):
        rows.append(("s", "s-v9", json.dumps({"a": i % 3 == 0, "model": "mxy"[i % 3], "n": i, "gone": 1.5, "t": ["p", "q"], "deep": {"x": None if i % 2 else "k"}})))
        rows.append(("s", "s-v10", json.dumps({"a": "yes", "model_name": "mxy"[i % 3], "n": i, "tags": ["q", "p"], "deep": {"x": "k"}, "hash": str(hash(i))})))
    rows += [("s", "s-v10", '{"cut": '), ("s", "s-v10", None), ("s", "s-v10", ""), ("s", None, '{"zzz": 1}'), (None, "s-v10", '{"yyy": 1}'), ("s", "s-v10", "[1]")]
    got = {tuple(r)[3:] for r in drift.drift_report(profile(spark, rows), "surface", "parser_version").collect()}
    assert got == {("renamed", "model", "model_name"), ("renamed", "t", "tags"), ("removed", "gone", ""), ("added", "hash", ""), ("retyped", "a", "")}


def test_versions_follow_their_numbers():
    assert sorted(["v1", "v1.1", "v2", "v10"], key=drift.version_order) == ["v1", "v1.1", "v2", "v10"]
    assert drift.version_order("x-2025.9") < drift.version_order("x-2025.10") < drift.version_order("x-2026.1")


def test_rescue_and_promote(spark):
    target = {"n": "number", "ok": "boolean", "tags": "array", "name": "string"}
    rows = [("1", '{"n": "12", "ok": "yes", "tags": ["a"], "name": "x", "extra": {"deep": 3}}'), ("2", '{"n": "no number", "label": "y"}'), ("3", "{cut"), ("4", None), ("5", '{"n": null, "name": 7}')]
    t = drift.ingest(spark.createDataFrame(rows, "f_n string, doc string"), "doc", target, False, ["f_n"])
    got = {r[0]: r for r in t.toDF("id", "position", "n", "ok", "tags", "name", "rescued", "readable").collect()}
    assert got["1"]["n"] == 12.0 and got["1"]["ok"] is True and json.loads(got["1"]["rescued"]) == {"n": "12", "ok": "yes", "extra.deep": 3}
    assert got["2"]["n"] is None and json.loads(got["2"]["rescued"]) == {"n": "no number", "label": "y"}
    assert not got["3"]["readable"] and got["4"]["readable"] and got["5"]["name"] == "7"
    p = drift.promote(drift.ingest(spark.createDataFrame(rows, "id string, doc string"), "doc", target, False, ["id"]), {"label": ("name", "string"), "extra.deep": ("deep", "number")})
    by = {r["id"]: r for r in p.collect()}
    assert by["2"]["f_name"] == "y" and by["1"]["f_name"] == "x" and by["1"]["f_deep"] == 3.0


def test_arrays_and_empty(spark):
    rows = [("f", '[{"a": 1}, {"a": 2}, 5]'), ("g", "[]"), ("h", '[{"a"')]
    t = drift.ingest(spark.createDataFrame(rows, "id string, doc string"), "doc", {"a": "number"}, True, ["id"]).collect()
    assert [(r["id"], r["position"], r["f_a"], r["_readable"]) for r in t] == [("f", 0, 1.0, True), ("f", 1, 2.0, True), ("g", None, None, True), ("h", None, None, False)]
    assert drift.drift_report(profile(spark, []), "surface", "parser_version").count() == 0


def test_report_is_what_typed_and_rescued_columns_hold(spark):
    """Whatever the target schema knows, the report stays; what it doesn't know is rescued."""
    rows = [("s", f"v{v}", json.dumps({"a": i, "b": None, "big": (1 << 60) + i, "half": "x\ud800", ("old" if v == 1 else "new"): f"w{i % 7}", "n": {"t": [i, "q", None]}})) for v in (1, 2) for i in range(100)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "surface string, parser_version string, j string, n int")
    shares, reports = [], []
    for target in ({}, {"a": "number", "old": "string", "n.t": "array", "big": "number"}, {"a": "string", "b": "boolean", "half": "number"}):
        t = drift.ingest(df, "j", target, False, ["surface"])
        shares.append(sum(len(json.loads(r[0] or "{}")) for r in t.select("_rescued").collect()))
        found = drift.profile(df, "j", target, False, ["surface", "parser_version"], "m")
        reports.append(({tuple(r) for r in drift.drift_report(found, "surface", "parser_version").collect()}, sorted((r["field"], r["type"], r["value"] or "") for r in found.collect())))
    assert shares == [1200, 700, 1200] and reports[0] == reports[1] == reports[2]
    assert reports[0][0] == {("m", "s", "v2", "renamed", "old", "new")}


def test_many_values_are_compared_exactly(spark):
    """Half of the values in common is a renaming, a little less is not, however many they are."""
    for shift, kind in ((666, "renamed"), (680, "removed")):
        rows = [("s", "s-v1", json.dumps({"x": f"k{i}"}), 1) for i in range(2000)] + [("s", "s-v2", json.dumps({"y": f"k{i + shift}"}), 1) for i in range(2000)]
        df = spark.createDataFrame(rows, "surface string, parser_version string, j string, n int")
        got = drift.drift_report(drift.profile(df, "j", {"x": "string"}, False, ["surface", "parser_version"], "m"), "surface", "parser_version").collect()
        assert {r["change_kind"] for r in got if r["field_name"] == "x"} == {kind}
