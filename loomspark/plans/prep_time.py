"""Queries of problem 5: timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..operators import timestamps as ts
from ..session import materialise, table


def read(spark, d) -> tuple[DataFrame, DataFrame]:
    """(all values that are not in the plain form, read; the local times among the messages with the span of the zoned times beside them)."""
    messages, sessions, clock = (table(spark, d, n) for n in ("messages", "sessions", "surface_clock"))
    rows = messages.select(F.lit("messages").alias("table_name"), F.col("id").cast("string").alias("row_key"), F.lit("timestamp").alias("field_name"), F.col("timestamp").alias("value"), norm_key("session_key").alias("key"), "ordinal")
    for c in ("started_at", "updated_at"):
        rows = rows.unionByName(sessions.select(F.lit("sessions").alias("table_name"), norm_key("session_key").alias("row_key"), F.lit(c).alias("field_name"), F.col(c).alias("value"), norm_key("session_key").alias("key"), F.lit(None).cast("int").alias("ordinal")))
    surfaces = sessions.filter(F.col("session_key").isNotNull()).groupBy(norm_key("session_key").alias("key")).agg(F.max("surface").alias("surface"))
    every = materialise(ts.read_table(rows, surfaces, clock), "times")
    local = every.filter("local_ms is not null and near is not null and key is not null").select("key", "near", "surface", "local_ms")
    return every, local.join(ts.zoned_beside(messages, "session_key", "ordinal", "timestamp"), ["key", "near"]).select("surface", "local_ms", "lo", "hi")


def zones(aligned: DataFrame, declared: dict[str, str | None]) -> list[tuple[str, str | None, str | None, dict[str, int]]]:
    """(surface, declared, estimated, violations) of each surface. A stated zone is one more candidate, and holds among equals only."""
    span = aligned.agg(F.min("lo"), F.max("hi")).first()
    names = sorted({*ts.offset_histories(aligned.sparkSession, *span), *(z for z in declared.values() if z)}) if span[0] is not None else []
    votes = ts.estimate_zones(aligned, names) if names else {}
    return [(s, z, ts.best_zone(votes.get(s, {}), z), votes.get(s, {})) for s, z in sorted(declared.items())]


def _declared(spark, d) -> dict[str, str | None]:
    """The zones of the clock table, which is fixed and small."""
    return {r[0]: r[1] for r in table(spark, d, "surface_clock").groupBy("surface").agg(F.max("zone_name")).collect() if r[0] is not None}


def p5_found(spark, d) -> DataFrame:
    """The estimated offset history of each surface converts its local times; the clock table says which surfaces have a known zone at all."""
    every, aligned = read(spark, d)
    return ts.instants(every, {s: est for s, declared, est, _ in zones(materialise(aligned, "aligned"), _declared(spark, d)) if declared})


def p5_zones(spark, d) -> DataFrame:
    _, aligned = read(spark, d)
    rows = [(s, declared, est, votes.get(est)) for s, declared, est, votes in zones(materialise(aligned, "aligned"), _declared(spark, d))]
    return spark.createDataFrame(rows, "surface string, declared_zone string, estimated_zone string, violations long")


QUERIES = {"p5_found": p5_found, "p5_zones": p5_zones}


def _sql() -> str:
    """The same in SQL: forms by their patterns, dates and zones by the database's own calendar."""
    key = "lower(trim(session_key, ' ' || chr(9) || chr(10) || chr(13)))"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = " ".join(f"when regexp_matches(t, {quote(p)}) then string_split(regexp_replace(t, {quote(p)}, {quote(into.replace('$', chr(92)))}), '|')" for p, into in ts._FORMS)
    zones = " ".join(f"when '{z}' then {m}" for z, m in ts.ABBREVIATIONS.items())
    months = " ".join(f"when '{m.lower()}' then {i}" for i, m in enumerate(ts.MONTHS, 1))
    back = " and ".join(f"timezone(zone_name, timezone(zone_name, local) + interval ({m}) minute) <> local" for m in (-120, -60, -30, 30, 60, 120))
    return f"""with raw as (select 'messages' as table_name, cast(id as varchar) as row_key, 'timestamp' as field_name, "timestamp" as value, {key} as k from messages
union all select 'sessions', {key}, 'started_at', started_at, {key} from sessions union all select 'sessions', {key}, 'updated_at', updated_at, {key} from sessions),
odd as (select table_name, row_key, field_name, trim(value, ' ' || chr(9) || chr(10) || chr(13)) as t, c.zone_name, c.day_order from raw
left join (select {key} as sk, max(surface) as surface from sessions group by 1) s on s.sk = raw.k left join surface_clock c on c.surface = s.surface where value is not null and not regexp_matches(value, {quote(ts.CANONICAL)})),
q as (select *, case {parts} end as p from odd),
f as (select *, case when regexp_matches(p[2], '^[A-Za-z]') then 'd' when p[10] = 'n' then day_order else 'o' end as o, upper(p[8]) as ap, upper(p[9]) as z, try_cast(p[4] as bigint) as h0 from q),
w as (select *, case o when 'd' then case lower(left(p[2], 3)) {months} end when 'dmy' then try_cast(p[3] as bigint) when 'mdy' then try_cast(p[2] as bigint) when 'o' then try_cast(p[2] as bigint) end as mo,
case o when 'dmy' then try_cast(p[2] as bigint) when 'mdy' then try_cast(p[3] as bigint) when 'd' then try_cast(p[3] as bigint) when 'o' then try_cast(p[3] as bigint) end as dd,
case when ap = '' then h0 when h0 between 1 and 12 then h0 % 12 + case ap when 'PM' then 12 else 0 end end as h from f),
l as (select *, case when h between 0 and 23 then try_cast(p[1] || '-' || lpad(cast(mo as varchar), 2, '0') || '-' || lpad(cast(dd as varchar), 2, '0') || ' ' || lpad(cast(h as varchar), 2, '0') || ':' || p[5] || ':' || case when p[6] = '' then '00' else p[6] end || '.' || rpad(left(p[7], 3), 3, '0') as timestamp) end as local,
case when regexp_matches(z, '^[+-]') then case when cast(substr(z, 2, 2) as bigint) <= 18 and coalesce(try_cast(substr(replace(z, ':', ''), 4, 2) as bigint), 0) <= 59 then (cast(substr(z, 2, 2) as bigint) * 60 + coalesce(try_cast(substr(replace(z, ':', ''), 4, 2) as bigint), 0)) * case left(z, 1) when '-' then -1 else 1 end end else case z {zones} end end as off,
try_cast(regexp_extract(t, '^(-?[0-9]{{1,17}})(?:[.]([0-9]+))?$', 1) as bigint) as num, try_cast(rpad(left(regexp_extract(t, '^-?[0-9]{{1,17}}[.]([0-9]+)$', 1), 3), 3, '0') as bigint) as frac, try_cast(regexp_extract(t, '^/Date[(](-?[0-9]{{1,17}})(?:[+-][0-9]{{4}})?[)]/$', 1) as bigint) as jsdate from w),
i as (select *, case when num is not null and not regexp_matches(t, '^(19|20)[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$') then case when abs(num) < 100000000000 then num * 1000 + case when t like '-%' then -1 else 1 end * coalesce(frac, 0) when abs(num) < 100000000000000 then num else num // 1000 end
when jsdate is not null then jsdate when z <> '' then epoch_ms(local) - off * 60000
when z = '' and zone_name is not null and local is not null and timezone(zone_name, timezone(zone_name, local)) = local and {back} then epoch_ms(timezone(zone_name, local)) end as instant_ms from l)
select distinct table_name, row_key, field_name, instant_ms from i where instant_ms is not null"""


SQL: dict[str, str] = {"p5_found": _sql()}
