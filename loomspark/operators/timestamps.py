"""Mixed timestamp forms and time zones to one UTC instant, inside the JVM.

A value is first brought into the form year|month|day|hour|minute|second|fraction|AM or PM|zone|order by the first
pattern that fits, then computed with integer arithmetic. What has a zone is an instant at once. What has none is
wall-clock time of its surface: a surface's offset history is estimated by aligning its local times with the zoned times
that stand beside them in the order of their session. Candidates are all offset histories that any zone of the JVM's
calendar has in the period of the data; the one with the fewest violations converts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from .scale import skew_join

CANONICAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"

# The usual European and US zone abbreviations, in minutes from UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
NEAR = 8  # so many neighbouring ordinals of a session are aligned with each other
SLACK_MS = 300_000  # a local time may lie so far outside the zoned times beside it
GRID_MS = 900_000  # all offsets of the period are multiples of this

_ZONE = r"(?:\s*([A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?))?(?:\[[A-Za-z_/+\-0-9]+\])?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp][Mm])\b)?" + _ZONE
#: (pattern, replacement); the parts are y|m|d|h|min|s|frac|ampm|zone|order, order says whose dates the first two are.
_FORMS = [
    (r"^(\d{4})-(\d{2})-(\d{2})[Tt ]\s*" + _TIME + "$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?(X)?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$9|"),
    (r"^(\d{1,2})[./](\d{1,2})[./](\d{4}),?\s+" + _TIME + "$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|n"),
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4}),?\s+" + _TIME + "$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    (r"^(?:[A-Za-z]{3,9},\s+)?([A-Za-z]{3})[a-z]* (\d{1,2}),? (\d{4}),?\s+" + _TIME + "$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
]


def parts(value: Column) -> Column:
    """The parts of a value, or null if no form fits."""
    t = F.trim(value, F.lit(" \t\r\n"))
    out = F.when(t.rlike(_FORMS[0][0]), F.regexp_replace(t, _FORMS[0][0], _FORMS[0][1]))
    for pattern, into in _FORMS[1:]:
        out = out.when(t.rlike(pattern), F.regexp_replace(t, pattern, into))
    return F.split(out, r"\|", -1)


def epoch_ms(value: Column) -> Column:
    """Milliseconds of a bare number (seconds, milliseconds or microseconds by its size) or of /Date(milliseconds)/; else null.

    Eight digits that read as a date are a date without time.
    """
    t = F.trim(value, F.lit(" \t\r\n"))
    n = F.regexp_extract(t, r"^(-?\d{1,17})(?:\.(\d+))?$", 1)
    frac = F.rpad(F.regexp_extract(t, r"^-?\d{1,17}\.(\d+)$", 1), 3, "0").try_cast("long")
    i = n.try_cast("long")
    size = F.abs(i)
    bare = F.when(size < 100_000_000_000, i * 1000 + F.when(t.startswith("-"), -F.coalesce(frac, F.lit(0))).otherwise(F.coalesce(frac, F.lit(0)))).when(size < 100_000_000_000_000, i).when(size < 100_000_000_000_000_000, F.floor(i / 1000).cast("long"))
    bare = F.when(~t.rlike(r"^(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$"), bare)
    date = F.regexp_extract(t, r"^/Date\((-?\d{1,17})(?:[+-]\d{4})?\)/$", 1).try_cast("long")
    return F.coalesce(bare, date)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date in the Gregorian calendar."""
    y2 = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(y2 / 400).cast("long")
    yoe = y2 - era * 400
    doy = F.floor((153 * F.when(m > 2, m - 3).otherwise(m + 9) + 2) / 5).cast("long") + d - 1
    return era * 146_097 + yoe * 365 + F.floor(yoe / 4).cast("long") - F.floor(yoe / 100).cast("long") + doy - 719_468


def read_values(df: DataFrame, value: str, day_order: str) -> DataFrame:
    """Adds instant_ms and local_ms of a value; at most one is set, both null if it is no date with a time.

    day_order ('dmy' or 'mdy') says how all-numeric dates begin; where it is null such dates can't be read. The steps are
    separate projections: nested into one expression they would repeat each other.
    """
    order = F.col(day_order)
    num = lambda k: F.col("_p")[k].try_cast("long")
    x = df.withColumn("_p", parts(F.col(value))).withColumn("_epoch", epoch_ms(F.col(value)))
    numeric = F.col("_p")[9] == "n"
    named_month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(F.substring(F.col("_p")[1], 1, 3)))
    x = x.withColumns({"_y": num(0), "_one": num(1), "_two": num(2), "_numeric": numeric, "_name": F.when(F.col("_p")[1].rlike("^[A-Za-z]"), named_month), "_h": num(3), "_mi": num(4), "_s": F.coalesce(num(5), F.lit(0)), "_ms": F.coalesce(F.rpad(F.when(F.col("_p")[6] != "", F.col("_p")[6]), 3, "0").try_cast("long"), F.lit(0)), "_ap": F.upper(F.col("_p")[7]), "_z": F.upper(F.col("_p")[8])})
    dmy, mdy = F.col("_numeric") & (order == "dmy"), F.col("_numeric") & (order == "mdy")
    x = x.withColumns({"_m": F.when(F.col("_name").isNotNull(), F.col("_name")).when(dmy, F.col("_two")).when(mdy | ~F.col("_numeric"), F.col("_one")).cast("long"), "_d": F.when(dmy, F.col("_one")).when(mdy | ~F.col("_numeric"), F.col("_two")), "_h": F.when(F.col("_ap") == "", F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_ap") == "PM", 12).otherwise(0))})
    y, m, d = F.col("_y"), F.col("_m"), F.col("_d")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    good = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last) & F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
    z = F.col("_z")
    hh, mm = F.substring(z, 2, 2).try_cast("long"), F.coalesce(F.substring(F.replace(z, F.lit(":"), F.lit("")), 4, 2).try_cast("long"), F.lit(0))
    named = F.element_at(F.create_map(*[F.lit(v) for kv in ABBREVIATIONS.items() for v in kv]), z)
    x = x.withColumns({"_good": F.coalesce(good, F.lit(False)), "_hh": hh, "_mm": mm, "_named": F.when(z.rlike("^[A-Z]"), named)})
    x = x.withColumns({"_local": F.when(F.col("_good"), ((_days(y, m, d) * 24 + F.col("_h")) * 60 + F.col("_mi")) * 60_000 + F.col("_s") * 1000 + F.col("_ms")), "_off": F.when(z.rlike(r"^[+-]"), F.when((F.col("_hh") <= 18) & (F.col("_mm") <= 59), (F.col("_hh") * 60 + F.col("_mm")) * F.when(z.startswith("-"), -1).otherwise(1))).otherwise(F.col("_named"))})
    return x.select(*df.columns, F.coalesce("_epoch", F.when(z != "", F.col("_local") - F.col("_off") * 60_000)).cast("long").alias("instant_ms"), F.when(z == "", F.col("_local")).cast("long").alias("local_ms"))


def to_instant(local_ms: Column, zone: Column) -> Column:
    """The one instant (ms) at which clocks in `zone` show local_ms; null if that hour was skipped or came twice."""
    t = F.timestamp_millis(local_ms)
    u = F.to_utc_timestamp(t, zone)
    us = F.unix_micros(u)
    once = F.from_utc_timestamp(u, zone) == t
    for minutes in (-120, -60, -30, 30, 60, 120):
        once = once & (F.from_utc_timestamp(F.timestamp_micros(us + minutes * 60_000_000), zone) != t)
    return F.when(zone.isNotNull() & once, F.unix_millis(u))


def offset_histories(spark: SparkSession, lo_ms: int, hi_ms: int) -> list[str]:
    """One zone for each offset history that the zones of the JVM's calendar have between two instants, the first by name.

    Histories are compared every three hours. The zones are some 500 whatever the data, the histories fewer.
    """
    names = [n for n in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds() if n == "UTC" or ("/" in n and not n.startswith(("Etc/", "SystemV/")))]
    hours = F.sequence(F.timestamp_millis(F.lit(lo_ms - 86_400_000)), F.timestamp_millis(F.lit(hi_ms + 86_400_000)), F.expr("interval 3 hours"))
    history = F.xxhash64(F.transform(hours, lambda t: F.unix_seconds(F.from_utc_timestamp(t, F.col("zone")))))
    zones = spark.createDataFrame([(n,) for n in names], "zone string").repartition(8)
    return sorted(r[0] for r in zones.select("zone", history.alias("h")).groupBy("h").agg(F.min("zone")).select("min(zone)").collect())


def zoned_beside(messages: DataFrame, key: str, ordinal: str, value: str) -> DataFrame:
    """(key, near, lo, hi) in ms: the span of the plain UTC times among NEAR neighbouring ordinals of a session."""
    t = F.when(F.col(value).rlike(CANONICAL), F.unix_millis(F.col(value).try_cast("timestamp")))
    m = messages.select(norm_key(key).alias("key"), near(F.col(ordinal)).alias("near"), t.alias("t")).filter(F.col("t").isNotNull() & F.col("key").isNotNull() & F.col("near").isNotNull())
    return m.groupBy("key", "near").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))


def near(ordinal: Column) -> Column:
    return F.floor(ordinal / NEAR).cast("long")


def estimate_zones(read: DataFrame, zones: list[str], slack_ms: int = SLACK_MS) -> dict[str, dict[str, int]]:
    """surface -> zone -> violations: local times that, put into the zone, fall outside the span of the zoned times beside them.

    Columns of `read`: surface, local_ms, lo, hi. Local times are first added up by surface, hour and the range of offsets
    that their neighbours allow, so that the candidates meet a table as large as the calendar, not as the data; what comes
    back is surfaces x zones numbers. Times that no offset fits, or any (a range of a day and more), count for none.
    """
    rows = read.filter(F.col("local_ms").isNotNull() & F.col("lo").isNotNull() & F.col("surface").isNotNull())
    a, b = F.ceil((F.col("local_ms") - F.col("hi") - slack_ms) / GRID_MS), F.floor((F.col("local_ms") - F.col("lo") + slack_ms) / GRID_MS)
    hourly = rows.select("surface", F.floor(F.col("local_ms") / 3_600_000).cast("long").alias("hour"), a.cast("long").alias("a"), b.cast("long").alias("b")).filter("a <= b and b - a < 96").groupBy("surface", "hour", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    local = F.timestamp_millis(F.col("hour") * 3_600_000)
    tried = hourly.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in zones])))
    offset = F.col("hour") * 3_600_000 - F.unix_millis(F.to_utc_timestamp(local, F.col("zone")))
    bad = F.when((offset < F.col("a") * GRID_MS) | (offset > F.col("b") * GRID_MS), F.col("n")).otherwise(0)
    out: dict[str, dict[str, int]] = {}
    for r in tried.groupBy("surface", "zone").agg(F.sum(bad).alias("bad")).collect():
        out.setdefault(r["surface"], {})[r["zone"]] = r["bad"]
    return out


def best_zone(violations: dict[str, int], declared: str | None) -> str | None:
    """The zone with the fewest violations; the declared one among equals (within a hundredth), then the first by name."""
    if not violations:
        return declared
    least = min(violations.values())
    if declared in violations and violations[declared] <= least * 1.01 + 1:
        return declared
    return min(z for z, n in violations.items() if n == least)


def read_table(rows: DataFrame, surfaces: DataFrame, clock: DataFrame) -> DataFrame:
    """rows: (table_name, row_key, field_name, value, key, ordinal) -> the same with surface, near, instant_ms, local_ms.

    Values in the plain form are left out. `surfaces` has one row a key; the join splits hot sessions.
    """
    odd = rows.filter(F.col("value").isNotNull() & ~F.col("value").rlike(CANONICAL))
    j = skew_join(odd, surfaces, "key", F.col("row_key"), "left")
    order = F.broadcast(clock.select("surface", "day_order").dropDuplicates(["surface"]))
    return read_values(j.withColumn("near", near(F.col("ordinal"))).join(order, "surface", "left"), "value", "day_order").select("table_name", "row_key", "field_name", "key", "near", "surface", "instant_ms", "local_ms")


def instants(read: DataFrame, zone_of: dict[str, str]) -> DataFrame:
    """(table_name, row_key, field_name, instant_ms), each once, of the values that stand for exactly one instant."""
    zone = F.lit(None).cast("string")
    for s, z in zone_of.items():
        zone = F.when(F.col("surface") == s, F.lit(z)).otherwise(zone)
    local = None
    for z in sorted(set(zone_of.values())):  # a literal zone lets the JVM look its rules up once
        own = F.when(zone == z, to_instant(F.col("local_ms"), F.lit(z)))
        local = own if local is None else F.coalesce(local, own)
    ms = F.coalesce("instant_ms", local) if local is not None else F.col("instant_ms")
    return read.select("table_name", "row_key", "field_name", ms.alias("instant_ms")).filter("instant_ms is not null").distinct()
