import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import mixing, packing, tokens


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20), st.integers(40, 60))
def test_plan_places_each_item_once_and_never_overfills(hist, capacity):
    segments, used = packing.plan_best_fit(hist, capacity)
    fill, got = {}, {}
    for size, lo, hi, first, each in segments:
        for r in range(lo, hi):
            assert (size, r) not in got
            got[size, r] = first + (r - lo) // each
            fill[got[size, r]] = fill.get(got[size, r], 0) + size
    assert len(got) == sum(hist.values()) and all(v <= capacity for v in fill.values()) and set(fill) == set(range(used))
    # as item by item: best fit decreasing
    bins = []
    for s in sorted((s for s, n in hist.items() for _ in range(n)), reverse=True):
        i = min((i for i, b in enumerate(bins) if b >= s), key=lambda i: bins[i], default=None)
        if i is None:
            bins.append(capacity - s)
        else:
            bins[i] -= s
    assert used == len(bins)


def test_pack_splits_only_what_is_too_large(spark):
    rnd = random.Random(2)
    sizes = {i: rnd.choice([0, 1, 3, 7, 10, 10, 10, 25, 33]) for i in range(200)}
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in sizes.items()], "doc_id long, n_tokens long, container_name string, capacity int").select("doc_id", "n_tokens")
    caps = {"s": 10, "m": 32}
    rows = packing.pack(df, caps).collect()
    for name, c in caps.items():
        own = [r for r in rows if r["container_name"] == name]
        fill = {}
        for r in own:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
        assert all(v <= c for v in fill.values()) and sum(fill.values()) == sum(sizes.values())
        for i, n in sizes.items():
            ps = sorted((r["piece"], r["from_token"], r["n_tokens"]) for r in own if r["doc_id"] == i)
            assert len(ps) == max(1, -(-n // c)) and [p[0] for p in ps] == list(range(len(ps))) and sum(p[2] for p in ps) == n
            assert all(p[1] == sum(q[2] for q in ps[: p[0]]) for p in ps)
    assert packing.pack(df.limit(0), caps).count() == 0


def test_sizes_of_null_empty_and_long_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "hello world", "c"), (4, "word " * 50_000, "d"), (5, "<|endoftext|>", "e")], "doc_id long, text string, n string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.with_sizes(df, "text").collect()}
    assert got[1] == 0 and got[2] == 0 and got[3] == 2 and got[4] >= 50_000 and got[5] > 1


def test_mix_meets_shares_within_repeats(spark):
    rnd = random.Random(4)
    rows = [(i, ["a", "b", "c", "b", None, "zz"][i % 6], (i // 2 if i % 10 else 5, 0), rnd.randint(0, 20)) for i in range(600)]
    fixed = {}
    rows = [(i, s, h, fixed.setdefault(h, n)) for i, s, h, n in rows]
    docs = spark.createDataFrame(rows, "doc_id long, source string, h struct<a: long, b: long>, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.3, 1), ("c", 0.1, 2), ("none", 0.1, 3)], "source_name string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets, seed=7)
    got = {r["source_name"]: r for r in shares.collect()}
    assert got["none"]["n_tokens"] == 0
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(got[s]["actual_share"] - w / 0.9) < 0.03 and got[s]["most_repeats"] <= {"a": 4, "b": 1, "c": 2}[s]
    by = {i: s for i, s, _, _ in rows}
    picked = chosen.collect()
    assert all(by[r["doc_id"]] == r["source_name"] for r in picked) and len({(r["doc_id"]) for r in picked}) == len(picked)
    again = {tuple(r) for r in mixing.mix(docs, targets, seed=7)[0].collect()}
    assert again == {tuple(r) for r in picked} and again != {tuple(r) for r in mixing.mix(docs, targets, seed=8)[0].collect()}
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


def test_flow_prefers_few_repeats():
    total, got = mixing.route({"a": 10, "a|b": 10, "b": 10}, {"a": 15, "b": 15}, {"a": 3, "b": 3})
    assert total == 30 and got["a"]["a"] == 10 and got["b"]["b"] == 10 and sum(got["a|b"].values()) == 10


def test_names_with_bars_and_checkers(spark):
    docs = spark.createDataFrame([(i, "a|b" if i % 2 else "c", (f"t{i}", "x"), 10) for i in range(20)] + [(90 + i, "c", (f"t{2 * i}", "x"), 10) for i in range(3)], "doc_id long, source string, h struct<a: string, b: string>, n_tokens long")
    targets = spark.createDataFrame([("a|b", 0.5, 2), ("c", 0.5, 2), ("none", 0.0, 1)], "source_name string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(docs, targets)
    assert {r["source_name"] for r in chosen.collect()} == {"a|b", "c"}
    assert {r["source_name"]: r["n_copies"] for r in shares.collect()} == {"a|b": 0, "c": 3, "none": 0}
    assert all(sum(tuple(r)[1:]) == 0 for r in mixing.violations(chosen, docs, targets).collect())
    wrong = chosen.unionByName(chosen.limit(1))
    assert sum(r["n_twice"] for r in mixing.violations(wrong, docs, targets).collect()) == 1
    items = spark.createDataFrame([(i, s) for i, s in enumerate([0, 3, 4, 5, 5, 7, 12, 25])], "doc_id long, n_tokens long")
    packed = packing.pack(items, {"ten": 10})
    assert tuple(packing.violations(packed, items, {"ten": 10}).first()) == ("ten", 8, 0, 0, 0)
    assert tuple(packing.violations(packed.filter("doc_id <> 2"), items, {"ten": 10}).filter("container_name = 'ten'").first())[1:4] != (8, 0, 0) or packing.violations(packed.filter("doc_id <> 2"), items, {"ten": 10}).agg({"n_wrong": "sum"}).first()[0] > 0
