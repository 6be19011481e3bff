import datetime as dt
import itertools
import random

import pytest

from loomspark.operators import ledger


def brute(seen, runs):
    rows = {}
    for key, run, at, m, s, status in seen:
        if key is None:
            continue
        r = (at is not None, at or "", m is not None, m or 0, s is not None, s or 0, status or "")
        if (key, run) not in rows or r > rows[key, run][0]:
            rows[key, run] = (r, (m, s), status)
    out = set()
    for (key, run), (_, state, _status) in rows.items():
        if runs.get(run) != "ok":
            continue
        before = [r for (k, r), (_, _, st) in rows.items() if k == key and r < run and runs.get(r) == "ok" and st != "error"]
        if not before or rows[key, max(before)][1] != state:
            out.add((run, key))
    return out


def test_replay_against_brute_force(spark):
    rnd = random.Random(3)
    runs = {1: "ok", 2: "failed", 3: "ok", 4: "killed", 5: "ok", 6: "ok"}
    seen = [(rnd.choice("abcdef") if rnd.random() > 0.02 else None, rnd.randint(1, 7), rnd.choice(["t1", "t2", "t3", None]), rnd.choice([1, 2, None]), rnd.choice([5, None]), rnd.choice(["ok", "error", "degraded", None])) for _ in range(200)]
    df = spark.createDataFrame([(*r, "x") for r in seen], "source_path string, refresh_id int, indexed_at string, mtime_ns long, size_bytes long, status string, token string")
    rr = spark.createDataFrame([(k, v, "y") for k, v in runs.items()], "refresh_id int, outcome string, accepted string").drop("accepted")
    h = ledger.replay(df, rr, "source_path", "refresh_id", ["mtime_ns", "size_bytes"], "status", "indexed_at")
    got = {tuple(r) for r in ledger.new_or_changed(h, "source_path", "refresh_id").collect()}
    assert got == brute(seen, runs)
    assert ledger.new_or_changed(ledger.replay(df.limit(0), rr, "source_path", "refresh_id", ["mtime_ns"], "status", "indexed_at"), "source_path", "refresh_id").count() == 0


def test_leases_expire_and_stale_writers_are_rejected(spark, tmp_path):
    led, t0 = ledger.Ledger(spark, str(tmp_path / "led")), dt.datetime(2026, 1, 1)
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    led.observe(spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "1")], "key string, version string"))
    assert {r["key"] for r in led.lease(1, t0, 60).collect()} == {"a", "b"}
    assert led.complete(1, keys("a")) == 1
    assert led.lease(2, t0 + dt.timedelta(seconds=30), 60).count() == 0  # b is still leased
    again = led.lease(3, t0 + dt.timedelta(seconds=61), 60).collect()
    assert [r["key"] for r in again] == ["b"] and again[0]["output"].endswith("/3")
    assert led.complete(1, keys("b")) == 0  # the old holder comes too late
    assert led.complete(3, keys("b")) == 1
    with pytest.raises(ValueError):
        led.lease(3, t0, 60)
    led.observe(spark.createDataFrame([("a", "2"), ("b", "1"), ("c", None)], "key string, version string"))
    assert {r["key"] for r in led.lease(4, t0 + dt.timedelta(days=1), 60).collect()} == {"a", "c"}


def test_time_fences_and_generations(spark, tmp_path):
    led, t0 = ledger.Ledger(spark, str(tmp_path / "led2")), dt.datetime(2026, 1, 1)
    seen = lambda *r: spark.createDataFrame(list(r), "key string, version string")
    led.lease(1, t0, 60, seen(("a", "1"), ("b", "1")))
    late = t0 + dt.timedelta(seconds=60)
    assert led.complete(1, seen(("a", "1")).select("key"), late) == 0  # its time was up, although nobody else took the lease
    assert led.taken().count() == 0 and led.taken(committed=False).count() == 2
    led.lease(2, late, 60, seen(("a", "1"), ("c", None)))
    assert led.complete(2, seen(("a", "1")).select("key"), late) == 1
    assert {(r["token"], r["key"]) for r in led.taken().collect()} == {(2, "a"), (2, "c")}
    assert {r["key"]: r["state"] for r in led.items().collect()} == {"a": "done", "b": "leased", "c": "pending"}  # c failed
    other = ledger.Ledger(spark, led.root)
    assert {r["key"] for r in other.items().collect()} == {"a", "b", "c"}
    base = other._newest()
    other._write(other.items(), base, moved=True)
    with pytest.raises(RuntimeError):
        led._write(led.items(), base, moved=True)
