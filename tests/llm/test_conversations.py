import random
import re

from loomspark.llm import conversations as conv

ROLES = [("user", "user"), ("human", "user"), ("assistant", "assistant"), ("bot", "assistant"), ("tool", "tool")]
SCHEMA = "id long, session_key string, ordinal int, timestamp string, role string, kind string, text string, tool_name string, key string, block string"


def brute(rows, sessions):
    names, by = dict(ROLES), {k.strip().lower(): set() for k in sessions if k is not None}
    for r in rows:
        if r[1] is not None:
            role = None if r[4] is None else names.get(r[4].strip().lower(), r[4].strip().lower())
            by.setdefault(r[1].strip(" \t\r\n").lower(), set()).add((r[2], role, r[5], r[6]))
    out = {}
    for k, ms in by.items():
        if not ms:
            out[k] = "empty"
            continue
        if None in {m[0] for m in ms} or sorted(m[0] for m in ms) != list(range(len(ms))):
            out[k] = "broken"
            continue
        seq = [("U" if (m[1], m[2]) == ("user", "message") else "A" if (m[1], m[2]) == ("assistant", "message") else "O") for m in sorted(ms, key=lambda m: m[0]) if m[3] is not None and re.sub("[\\s​-‏﻿ ]", "", m[3])]
        s = "".join(seq)
        ok = "U" in s and "A" in s and not re.search("UO+U|UO*$", s)
        out[k] = None if ok else "no_reply"
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(conv, "BLOCK", 4)  # many blocks, so that pointers jump
    rnd, rows = random.Random(5), []
    for s in range(60):
        n = rnd.choice([1, 2, 3, 5, 9, 17, 40])
        for o in range(n):
            if rnd.random() < 0.01:
                continue
            role = "user" if o % 2 == 0 else "assistant"
            if rnd.random() < 0.15:
                role = rnd.choice(["Human ", "BOT", "tool", None])
            text = rnd.choice([f"t{o}", f"t{o}", f"t{o}", f"t{o}", "​ \n", None, ""]) if rnd.random() < 0.3 else f"t{o}"
            row = (len(rows), rnd.choice([f"S{s}", f" s{s}\t"]), o, None, role, rnd.choice(["message"] * 9 + ["tool_call"]), text)
            rows += [row] * rnd.choice([1, 1, 1, 2])
            if rnd.random() < 0.01:
                rows.append((len(rows), f"s{s}", o, None, role, "message", "other"))
    rows += [(900, None, 0, None, "user", "message", "x"), (901, "nul", None, None, "user", "message", "x")]
    sessions = spark.createDataFrame([("Alone ",), ("s1",), (None,)], "session_key string")
    roles = spark.createDataFrame(ROLES, "raw_role string, role_name string")
    m = frame(spark, rows)
    got = {r["session_key"]: r["reason"] for r in conv.verdicts(m, sessions, roles).collect()}
    want = brute(rows, ["Alone ", "s1", None])
    assert got == want and {"empty", "broken", "no_reply", None} == set(want.values())
    out = conv.conversations(m, sessions, roles).collect()
    assert {r["session_key"] for r in out} == {k for k, v in want.items() if v is None}
    for k in {r["session_key"] for r in out}:
        assert sorted(r["position"] for r in out if r["session_key"] == k) == list(range(sum(1 for r in out if r["session_key"] == k)))


def test_empty_tables(spark):
    none = frame(spark, [])
    s, r = spark.createDataFrame([], "session_key string"), spark.createDataFrame([], "raw_role string, role_name string")
    assert conv.verdicts(none, s, r).count() == 0 and conv.conversations(none, s, r).count() == 0


def test_parents_of_any_kind(spark, monkeypatch):
    """Trees, broken chains and circles, within a stretch and across several."""
    monkeypatch.setattr(conv, "BLOCK", 4)
    rnd, parents = random.Random(8), {}
    for k in range(12):
        for n in range(rnd.choice([1, 3, 20, 70])):
            x = rnd.random()
            parents[f"k{k}", n] = None if n == 0 or x < 0.05 else 999 if x < 0.08 else rnd.randint(0, 69) if x < 0.12 else n - 1
    want = {}
    for (k, n), p in parents.items():
        seen, at, own = [], n, []
        while at is not None and (k, at) in parents and at not in seen:
            seen.append(at)
            at = parents[k, at]
        want[k, n] = ("root", len(seen) - 1) if at is None else ("circle", None) if at in seen else ("orphan", None)
    df = spark.createDataFrame([(k, n, p, conv.OTHER) for (k, n), p in parents.items()], "key string, node long, parent long, own int")
    got = {(r["key"], r["node"]): (r["end"], r["depth"] if r["end"] == "root" else None) for r in conv.resolve(df).collect()}
    assert got == want and {e for e, _ in want.values()} == {"root", "circle", "orphan"}


def test_rounds_spare_the_driver(spark, monkeypatch):
    """Rounds join in place without broadcasts, and the plan of what they found is as large after many rounds as after few."""
    real, rounds, leaves = conv.colocated, [], []

    def spy(df, *a, **k):
        if not k.get("moved", True):
            rounds[-1].append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *a, **k)

    monkeypatch.setattr(conv, "colocated", spy)
    for n in (4, 200):
        rounds.append([])
        df = spark.createDataFrame([("k", i, i - 1 if i else None, conv.OTHER) for i in range(n)], "key string, node long, parent long, own int")
        got = conv.resolve(df)
        assert {(r["node"], r["end"], r["depth"]) for r in got.collect()} == {(i, "root", i) for i in range(n)}
        leaves.append(got._jdf.queryExecution().analyzed().collectLeaves().size())
    assert len(rounds[1]) > len(rounds[0]) > 1 and leaves[0] == leaves[1]
    assert all("SortMergeJoin" in p and "Exchange" not in p for p in rounds[0] + rounds[1])
