from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomspark.operators import hierarchy as h


def brute(parents):
    known = {k for k in parents}
    out = {}
    for k in known:
        path, at, seen = [], k, set()
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            p = parents[at]
            at = p if p in known else None
        out[k] = None if at is not None else list(reversed(path))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "exp_id string, parent_id string, size int, path string")
    return {r["id"]: r for r in h.hierarchy(df, "exp_id", "parent_id").collect()}


def check(spark, parents):
    got = run(spark, [(k, p, 1, "x") for k, p in parents.items()])
    want = brute(parents)
    assert set(got) == set(want)
    for k, path in want.items():
        r = got[k]
        assert r["in_cycle"] == (path is None)
        if path is not None:
            assert r["path"].split("/") == path and r["depth"] == len(path) - 1 and r["root"] == path[0]
            assert r["size"] == sum(1 for p in want.values() if p is not None and k in p)
            inside = {x for x, y in got.items() if not y["in_cycle"] and y["root"] == r["root"] and r["lft"] < y["lft"] <= r["rgt"]}
            assert inside == {x for x, p in want.items() if p is not None and k in p and x != k}
        else:
            assert r["path"] is None and r["lft"] is None


def test_trees_circles_and_orphans(spark):
    chain = {f"c{i:02d}": f"c{i - 1:02d}" if i else None for i in range(20)}
    check(spark, chain | {"x": "y", "y": "x", "z": "x", "s": "s", "o": "gone", "e": ""} | {f"w{i}": "c00" for i in range(30)})


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 12), min_size=1, max_size=12))
def test_random_links(spark, links):
    check(spark, {f"n{i}": f"n{p}" for i, p in enumerate(links)})


def test_keys_nulls_repeats_and_empty(spark):
    got = run(spark, [(" A\t", None, 1, ""), ("a", "", 2, ""), ("B", "A ", 1, ""), ("b", "a\n", 1, ""), (None, "a", 1, ""), ("", "a", 1, "")])
    assert set(got) == {"a", "b"} and got["b"]["path"] == "a/b"
    assert run(spark, []) == {}


def test_descendants_come_from_the_nested_sets(spark):
    """Ids with '/' in them, a chain and a bush of more nodes than a block has places."""
    parents = {f"a/{i}": None if i == 0 else f"a/{i - 1}" if i < 40 else f"a/{i % 40}" if i < 300 else "a/0" for i in range(5000)} | {"x": "y", "y": "x"}
    df = spark.createDataFrame([(k, p) for k, p in parents.items()], "exp_id string, parent_id string")
    got = [tuple(r) for r in h.closure(h.hierarchy(df, "exp_id", "parent_id")).collect()]
    want = {(a, k, len(path) - 1 - i) for k, path in brute(parents).items() if path for i, a in enumerate(path[:-1])}
    assert len(got) == len(want) and set(got) == want
