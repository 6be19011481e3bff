import datetime as dt

from pyspark.sql import functions as F

from loomspark.operators import timestamps as ts

UTC = dt.timezone.utc


def ms(*a):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp() * 1000)


CASES = [  # value, order, instant, local
    ("2025-09-18T14:12:20Z", None, ms(2025, 9, 18, 14, 12, 20), None),
    (" 2025-09-18 16:44:29.461z\n", None, ms(2025, 9, 18, 16, 44, 29) + 461, None),
    ("2025-11-01T09:02:40.515525656Z", None, ms(2025, 11, 1, 9, 2, 40) + 515, None),
    ("2025-09-18 14:12:20 CEST", None, ms(2025, 9, 18, 12, 12, 20), None),
    ("2025-09-18T18:25:37,017+02:00", None, ms(2025, 9, 18, 16, 25, 37) + 17, None),
    ("2025-07-15T17:20:24.384+10:00[Australia/Sydney]", None, ms(2025, 7, 15, 7, 20, 24) + 384, None),
    ("2026-06-14T17:22:34+02", None, ms(2026, 6, 14, 15, 22, 34), None),
    ("2026-06-14T17:22:34-0330", None, ms(2026, 6, 14, 20, 52, 34), None),
    ("20250913T124809Z", None, ms(2025, 9, 13, 12, 48, 9), None),
    ("2026-05-28T23:03Z", None, ms(2026, 5, 28, 23, 3), None),
    ("Thu, 18 Sep 2025 18:40:31 +0200", None, ms(2025, 9, 18, 16, 40, 31), None),
    ("Mon, 08 Sep 2025 21:10:27 GMT", None, ms(2025, 9, 8, 21, 10, 27), None),
    ("1778632142", None, 1778632142000, None),
    ("1765906620535", None, 1765906620535, None),
    ("1773928536273675", None, 1773928536273, None),
    ("1773564609.798", None, 1773564609798, None),
    ("1770127394.819417", None, 1770127394819, None),
    ("/Date(1760760235830)/", None, 1760760235830, None),
    ("26.07.2025 19:07:11", "dmy", None, ms(2025, 7, 26, 19, 7, 11)),
    ("03/01/2026 09:50:07 PM", "mdy", None, ms(2026, 3, 1, 21, 50, 7)),
    ("03/01/2026 12:50:07 AM", "dmy", None, ms(2026, 1, 3, 0, 50, 7)),
    ("03/01/2026 13:50:07 PM", "mdy", None, None),
    ("16/05/2026 10:00:00", "mdy", None, None),
    ("26.07.2025 19:07:11", None, None, None),
    ("Jun 5, 2026 11:20:09", None, None, ms(2026, 6, 5, 11, 20, 9)),
    ("2026-05-22T08:27:13", None, None, ms(2026, 5, 22, 8, 27, 13)),
    *[(v, "dmy", None, None) for v in ("", "-", "n/a", "yesterday", "2025-06-07", "12 Jun 2026", "18:22:35", "0000-00-00 00:00:00", "2026-02-30T10:00:00Z", "2026-02-03T24:00:00Z", "2026-05-00T09:00:00Z", "20250607", None, "x" * 5000)],
]


def test_forms(spark):
    df = spark.createDataFrame([(i, v, o) for i, (v, o, _, _) in enumerate(CASES)], "i int, value string, day_order string")
    got = {r["i"]: (r["instant_ms"], r["local_ms"]) for r in ts.read_values(df, "value", "day_order").collect()}
    assert got == {i: (a, b) for i, (_, _, a, b) in enumerate(CASES)}


def test_skipped_and_repeated_hours(spark):
    rows = [("Europe/Berlin", ms(2026, 3, 29, 2, 30)), ("Europe/Berlin", ms(2025, 10, 26, 2, 30)), ("Europe/Berlin", ms(2026, 3, 29, 3, 0)), ("America/New_York", ms(2025, 11, 2, 1, 20)), ("America/New_York", ms(2025, 11, 2, 2, 20)), (None, 0)]
    df = spark.createDataFrame([(i, z, t) for i, (z, t) in enumerate(rows)], "i int, z string, t long")
    got = [r[0] for r in df.orderBy("i").select(ts.to_instant(F.col("t"), F.col("z"))).collect()]
    assert got == [None, None, ms(2026, 3, 29, 1, 0), None, ms(2025, 11, 2, 7, 20), None]


def test_zones_are_estimated(spark):
    rows = [("s", ms(2026, 1, 1, 12) + k * 60_000 + 60 * 60_000, ms(2026, 1, 1, 12), ms(2026, 1, 1, 12, 30)) for k in range(20)]
    df = spark.createDataFrame(rows, "surface string, local_ms long, lo long, hi long")
    votes = ts.estimate_zones(df, ["UTC", "Europe/Berlin", "Asia/Tokyo"])
    assert votes["s"]["Europe/Berlin"] == 0 and votes["s"]["UTC"] > 0 and ts.best_zone(votes["s"], None) == "Europe/Berlin"
    assert ts.best_zone({}, "UTC") == "UTC"


def test_zones_are_found_without_their_names(spark):
    """The clock table's names only break ties: without them the same instants come out, and a wrong zone changes rows."""
    from loomspark.plans import prep_time

    d = "/root/testdata/sf0.01"
    every, aligned = prep_time.read(spark, d)
    known = [s for s, z in prep_time._declared(spark, d).items() if z]
    blind = {s: est for s, _, est, _ in prep_time.zones(aligned, {s: None for s in known})}
    rows = lambda df: {tuple(r) for r in df.collect()}
    stated = rows(prep_time.p5_found(spark, d))
    assert rows(ts.instants(every, blind)) == stated
    assert rows(ts.instants(every, blind | {known[0]: "Asia/Tokyo"})) != stated
