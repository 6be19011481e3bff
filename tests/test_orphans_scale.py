import random

from pyspark.sql import functions as F

from loomspark.operators import orphans, scale


def test_missing_deleted_and_late(spark):
    parents = spark.createDataFrame([("A ", "2026-01-01T00:00:00.000Z"), ("b", "2026-02-01T00:00:00.000Z"), ("b", None), (None, None)], "k string, at string")
    dead = spark.createDataFrame([("run", "B", None), ("session", "a", "2026-01-01T00:00:00.000Z")], "record_kind string, record_key string, deleted_at string")
    refs = spark.createDataFrame([("1", "a"), ("2", "A\t"), ("2", "a"), ("3", "B"), ("4", "zz"), ("5", None), ("6", " ")], "id string, ref string")
    r = orphans.reference_rows([("t", refs, "id", "ref", "run", F.to_timestamp(F.lit("2025-01-01")))])
    c = orphans.classify(r, orphans.parent_intervals([("run", parents, "k", "at")], dead))
    assert {tuple(x) for x in orphans.broken_references(c).collect()} == {("t", "3", "b"), ("t", "4", "zz"), ("t", "6", "")}
    assert {(x["row_key"], x["state"]) for x in c.collect()} == {("1", "late"), ("2", "late"), ("3", "deleted"), ("4", "missing"), ("6", "missing")}
    assert orphans.monthly_report(c).filter("month = '2025-01'").agg(F.sum("n_rows")).first()[0] == 5


def test_skew_join_splits_hot_keys(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, -1)], "k string, i int")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    got = sorted((r["i"], r["v"]) for r in scale.skew_join(left, right, "k", F.col("i"), "left", at_least=10).collect() if r["v"])
    assert got == sorted((r["i"], r["v"]) for r in left.join(right, "k").collect())
    assert scale.skew_join(left, right, "k", F.col("i"), "left", at_least=10).count() == 301
    assert sorted((r["i"], r["v"]) for r in scale.skew_join(left, right, "k", F.col("i"), "inner", at_least=10).collect()) == got
    assert sorted((r["i"], r["v"]) for r in scale.look_up(left, right, "k", at_least=10).collect()) == got


def test_running_total(spark):
    rnd = random.Random(1)
    rows = [("g" if i % 2 else None, f"id{i}", rnd.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id string, n int")
    got = scale.running_total(df, ["g"], "id", F.col("n"), "before", buckets=5).collect()
    for g in ("g", None):
        own = sorted((r["before"], r["before"] + r["n"]) for r in got if r["g"] == g)
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][1] == sum(n for x, _, n in rows if x == g)
