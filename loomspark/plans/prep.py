"""Queries of the general training-data operators (problems 1, 2, 3, 5, 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift, hierarchy, ledger, orphans
from ..session import table

KEY = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"

#: The agreed schema of the two JSON columns; everything else is rescued first and promoted when approved.
DIAGNOSTICS = {"code": "string", "severity": "string", "message": "string", "line": "number", "offset": "number", "count": "number", "retry": "boolean"}
META = {"model": "string", "branch": "string", "turns": "number", "sandbox": "boolean", "cli_build": "string", "agent": "string", "token_total": "number", "flags": "array", "theme": "string", "composer_mode": "string", "pinned": "boolean", "labels": "array", "queue": "string"}
#: Approved after the first drift report: rescued field -> (column, type).
APPROVED_META = {"model_name": ("model", "string"), "git.branch": ("branch", "string"), "agent_id": ("agent", "string"), "usage.total": ("token_total", "number"), "mode": ("composer_mode", "string"), "tags": ("labels", "array"), "lane": ("queue", "string"), "region": ("region", "string"), "cost_cents": ("cost_cents", "number"), "locale": ("locale", "string")}
APPROVED_DIAGNOSTICS = {"level": ("severity", "string"), "detail": ("message", "string"), "position": ("offset", "number"), "expected": ("expected", "string"), "hint": ("hint", "string")}


def p1_found(spark, d) -> DataFrame:
    links = hierarchy.read_links(table(spark, d, "experiments"), "exp_id", "parent_id")
    return hierarchy.subtree_sizes(links).filter("in_cycle").select(F.col("id").alias("exp_id"))


def p1_hierarchy(spark, d) -> DataFrame:
    t = hierarchy.hierarchy(table(spark, d, "experiments"), "exp_id", "parent_id")
    return t.select(F.col("id").alias("exp_id"), "path", "depth", "root", F.col("size").alias("n_subtree"), "in_cycle")


def p1_descendants(spark, d) -> DataFrame:
    t = hierarchy.hierarchy(table(spark, d, "experiments"), "exp_id", "parent_id")
    return hierarchy.closure(t)


_NODES = f"""e as (select id, max(p) as p from (select {KEY.format('exp_id')} as id, nullif({KEY.format('parent_id')}, '') as p from experiments) where id <> '' group by id),
n as (select id, case when p in (select id from e) then p end as p from e),
r as (select id, id as path, cast(0 as bigint) as depth, id as root from n where p is null union all select n.id, r.path || '/' || n.id, r.depth + 1, r.root from n join r on n.p = r.id)"""
P1_FOUND = f"with recursive {_NODES} select id as exp_id from n where id not in (select id from r)"
P1_HIERARCHY = f"""with recursive {_NODES}, c as (select id, id as anc from n where id in (select id from r) union all select c.id, n.p from c join n on n.id = c.anc where n.p is not null),
s as (select anc as id, count(*) as n_subtree from c group by anc)
select n.id as exp_id, r.path, r.depth, r.root, s.n_subtree, r.id is null as in_cycle from n left join r on r.id = n.id left join s on s.id = n.id"""
P1_DESCENDANTS = f"""with recursive {_NODES}, c as (select p as ancestor, id as descendant, cast(1 as bigint) as distance from n where p is not null and id in (select id from r)
union all select n.p, c.descendant, c.distance + 1 from c join n on n.id = c.ancestor where n.p is not null)
select ancestor, descendant, distance from c"""


def _history(spark, d) -> DataFrame:
    return ledger.replay(table(spark, d, "source_files"), table(spark, d, "refresh_runs"), "source_path", "refresh_id", ["mtime_ns", "size_bytes"], "status", "indexed_at")


def p2_found(spark, d) -> DataFrame:
    """Read from the ledger: what the committed tokens took."""
    led, _ = ledger.work_off(table(spark, d, "source_files"), table(spark, d, "refresh_runs"), "source_path", "refresh_id", ["mtime_ns", "size_bytes"], "status", "indexed_at")
    return led.taken().select(F.col("token").cast("int").alias("refresh_id"), F.col("key").alias("source_path"))


def p2_ledger(spark, d) -> DataFrame:
    return _history(spark, d).groupBy("refresh_id", "lease", "ended").agg(F.count(F.lit(1)).alias("n_items"))


_SEEN = """k2 as (select refresh_id, source_path, mtime_ns, size_bytes, status from (select *, row_number() over (partition by refresh_id, source_path order by indexed_at desc nulls last, mtime_ns desc nulls last, size_bytes desc nulls last, status desc nulls last) as rn from source_files) where rn = 1),
h as (select k2.*, coalesce(r.ok, false) as ok, coalesce(r.ok, false) and coalesce(status, '') <> 'error' as fin from k2 left join (select refresh_id, bool_or(outcome = 'ok') as ok from refresh_runs group by 1) r using (refresh_id)),
l as (select h.*, (select max(b.refresh_id) from h b where b.source_path = h.source_path and b.refresh_id < h.refresh_id and b.fin) as prev from h),
x as (select l.*, case when l.prev is not null and b.mtime_ns is not distinct from l.mtime_ns and b.size_bytes is not distinct from l.size_bytes then 'skipped' else 'leased' end as lease from l left join h b on b.source_path = l.source_path and b.refresh_id = l.prev)"""
P2_FOUND = f"with {_SEEN} select refresh_id, source_path from x where ok and lease = 'leased'"
P2_LEDGER = f"with {_SEEN} select refresh_id, lease, case when fin then 'done' when not ok then 'expired' else 'pending' end as ended, count(*) as n_items from x group by 1, 2, 3"


def _sessions(spark, d) -> DataFrame:
    return drift.with_version(table(spark, d, "sessions"), table(spark, d, "source_files"), "source_path", F.col("parser_version"))


def p3_found(spark, d) -> DataFrame:
    by = ["surface", "parser_version"]
    a = drift.profile(table(spark, d, "source_files"), "diagnostics_json", DIAGNOSTICS, True, by, "diagnostics_json")
    b = drift.profile(_sessions(spark, d), "meta_json", META, False, by, "meta_json")
    return drift.drift_report(a.unionByName(b), "surface", "parser_version")


def p3_meta_table(spark, d) -> DataFrame:
    t = drift.ingest(_sessions(spark, d), "meta_json", META, False, ["session_key", "surface", "parser_version"])
    return drift.promote(t, APPROVED_META).drop("position")


def p3_diagnostics_table(spark, d) -> DataFrame:
    t = drift.ingest(table(spark, d, "source_files"), "diagnostics_json", DIAGNOSTICS, True, ["source_path", "surface", "parser_version", "refresh_id"])
    return drift.promote(t, APPROVED_DIAGNOSTICS)


def _classified(spark, d) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("messages", "sessions", "runs", "experiments", "evidence", "checkouts", "repositories", "tombstones")}
    at = orphans.plain_time  # only times in the plain form count for lateness
    refs = orphans.reference_rows([
        ("messages", t["messages"], "id", "session_key", "session", at("timestamp")),
        ("runs", t["runs"], "run_id", "exp_id", "experiment", at("started_at")),
        ("evidence", t["evidence"], "memory_id", "run_id", "run", at("created_at")),
        ("checkouts", t["checkouts"], "checkout_id", "repo_id", "repository", at("created_at")),
    ])
    parents = orphans.parent_intervals([("session", t["sessions"], "session_key", "started_at"), ("experiment", t["experiments"], "exp_id", "created_at"), ("run", t["runs"], "run_id", "started_at"), ("repository", t["repositories"], "repo_id", "created_at")], t["tombstones"])
    return orphans.classify(refs, parents)


def p6_found(spark, d) -> DataFrame:
    return orphans.broken_references(_classified(spark, d))


def p6_monthly(spark, d) -> DataFrame:
    return orphans.monthly_report(_classified(spark, d))


_REFS = [("messages", "id", "session_key", "session", "sessions", "session_key"), ("runs", "run_id", "exp_id", "experiment", "experiments", "exp_id"), ("evidence", "memory_id", "run_id", "run", "runs", "run_id"), ("checkouts", "checkout_id", "repo_id", "repository", "repositories", "repo_id")]
P6_FOUND = " union ".join(
    f"select '{t}' as table_name, cast({k} as varchar) as row_key, {KEY.format(ref)} as missing_key from {t} where {ref} is not null and ({KEY.format(ref)} not in (select {KEY.format(pk)} from {p} where {pk} is not null) or {KEY.format(ref)} in (select {KEY.format('record_key')} from tombstones where record_kind = '{kind}'))"
    for t, k, ref, kind, p, pk in _REFS
)

_AT = {"messages": "timestamp", "runs": "started_at", "evidence": "created_at", "checkouts": "created_at"}
_SINCE = {"sessions": "started_at", "experiments": "created_at", "runs": "started_at", "repositories": "created_at"}
_PLAIN = "case when regexp_matches({0}, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d[.]\\d{{3}}Z$') then try_cast({0} as timestamptz) end"
P6_MONTHLY = (
    "with p as (" + " union all ".join(f"select '{kind}' as kind, {KEY.format(pk)} as k, min({_PLAIN.format(_SINCE[p])}) as since from {p} where {pk} is not null group by 2" for _, _, _, kind, p, pk in _REFS) + "), "
    "d as (select distinct record_kind as kind, " + KEY.format("record_key") + " as k from tombstones), "
    "r as (" + " union all ".join(f"select '{t}' as table_name, cast({k} as varchar) as row_key, '{kind}' as kind, {KEY.format(ref)} as k, {_PLAIN.format(_AT[t])} as moment from {t} where {ref} is not null" for t, k, ref, kind, _, _ in _REFS) + "), "
    "c as (select r.*, case when p.k is null then 'missing' when d.k is not null then 'deleted' when r.moment < p.since then 'late' else 'good' end as state from r left join p on p.kind = r.kind and p.k = r.k left join d on d.kind = r.kind and d.k = r.k) "
    "select table_name, coalesce(strftime(moment at time zone 'UTC', '%Y-%m'), 'unknown') as month, state, count(distinct row(row_key, k)) as n_rows from c where state <> 'good' group by 1, 2, 3"
)

P3_FOUND = """with sv as (select source_path, max(parser_version) as pv from source_files where source_path is not null group by 1),
src as (select 'diagnostics_json' as col, surface, parser_version as pv, diagnostics_json as j from source_files union all select 'meta_json', s.surface, sv.pv, meta_json from sessions s join sv using (source_path)),
ok as (select col, surface, pv, cast(j as json) as j from src where j is not null and j <> '' and json_valid(j) and surface is not null and pv is not null),
ob as (select col, surface, pv, j as o from ok where col = 'meta_json' and json_type(j) = 'OBJECT' union all select col, surface, pv, unnest(cast(j as json[])) from ok where col = 'diagnostics_json' and json_type(j) = 'ARRAY'),
tr as (select col, surface, pv, unnest(list_zip(k, v)) as kv from (select col, surface, pv, json_keys(o) as k, list_transform(json_keys(o), lambda x: json_extract(o, '$."' || x || '"')) as v from ob where json_type(o) = 'OBJECT')),
l1 as (select col, surface, pv, kv[1] as f, kv[2] as v from tr),
l2 as (select col, surface, pv, f, v from l1 where coalesce(json_type(v), 'NULL') <> 'OBJECT' union all select col, surface, pv, f || '.' || unnest(json_keys(v)), unnest(list_transform(json_keys(v), lambda x: json_extract(v, '$."' || x || '"'))) from l1 where json_type(v) = 'OBJECT'),
lf as (select col, surface, pv, f, v, case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'NULL' then null else case when v is null then null else 'number' end end as ty from l2),
vs as (select distinct col, surface, pv from ob),
nv as (select *, lag(pv) over (partition by col, surface order by list_transform(regexp_extract_all(pv, '[0-9]+'), lambda x: cast(x as int))) as before from vs),
fd as (select col, surface, pv, f, mode(ty) filter (ty is not null) as ty from lf group by 1, 2, 3, 4),
el as (select distinct col, surface, pv, f, cast(v as varchar) as x from lf where ty <> 'array' union select col, surface, pv, f, cast(unnest(json_extract(v, '$[*]')) as varchar) from lf where ty = 'array'),
rg as (select col, surface, pv, f, min(try_cast(trim(x, '"') as double)) as lo, max(try_cast(trim(x, '"') as double)) as hi, bool_and(try_cast(trim(x, '"') as double) is not null) as isnum, bool_and(coalesce(try_cast(trim(x, '"') as double) = floor(try_cast(trim(x, '"') as double)), false)) as whole from el group by 1, 2, 3, 4),
gone as (select n.col, n.surface, n.pv, n.before, a.f, a.ty from nv n join fd a on a.col = n.col and a.surface = n.surface and a.pv = n.before where not exists (select 1 from fd b where b.col = n.col and b.surface = n.surface and b.pv = n.pv and b.f = a.f)),
come as (select n.col, n.surface, n.pv, n.before, b.f, b.ty from nv n join fd b on b.col = n.col and b.surface = n.surface and b.pv = n.pv where n.before is not null and not exists (select 1 from fd a where a.col = n.col and a.surface = n.surface and a.pv = n.before and a.f = b.f)),
pr as (select g.col, g.surface, g.pv, g.f as old, c.f as new, case when ra.isnum and rb.isnum and ra.whole = rb.whole and (g.ty = 'number' or ra.whole) then greatest(0, least(ra.hi, rb.hi) - greatest(ra.lo, rb.lo)) / nullif(greatest(ra.hi, rb.hi) - least(ra.lo, rb.lo), 0) when g.ty = 'number' then 0 else
(select count(*) from el x join el y on x.x = y.x where x.col = g.col and x.surface = g.surface and x.pv = g.before and x.f = g.f and y.col = g.col and y.surface = g.surface and y.pv = g.pv and y.f = c.f) / (select count(distinct x) from el where col = g.col and surface = g.surface and ((pv = g.before and f = g.f) or (pv = g.pv and f = c.f))) end as score
from gone g join come c on c.col = g.col and c.surface = g.surface and c.pv = g.pv and c.ty = g.ty left join rg ra on ra.col = g.col and ra.surface = g.surface and ra.pv = g.before and ra.f = g.f left join rg rb on rb.col = g.col and rb.surface = g.surface and rb.pv = g.pv and rb.f = c.f),
rn as (select * from (select *, row_number() over (partition by col, surface, pv, old order by score desc, new) as ra, row_number() over (partition by col, surface, pv, new order by score desc, old) as rb from pr where score >= 0.5) where ra = 1 and rb = 1),
al as (select col, surface, pv, 'renamed' as kind, old as f, new from rn
union all select col, surface, pv, 'removed', f, '' from gone g where not exists (select 1 from rn where rn.col = g.col and rn.surface = g.surface and rn.pv = g.pv and rn.old = g.f)
union all select col, surface, pv, 'added', f, '' from come c where not exists (select 1 from rn where rn.col = c.col and rn.surface = c.surface and rn.pv = c.pv and rn.new = c.f)
union all select n.col, n.surface, n.pv, 'retyped', b.f, '' from nv n join fd a on a.col = n.col and a.surface = n.surface and a.pv = n.before join fd b on b.col = n.col and b.surface = n.surface and b.pv = n.pv and b.f = a.f where a.ty <> b.ty)
select col as json_column, surface, pv as parser_version, kind as change_kind, f as field_name, new as new_name from al"""

QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants, "p2_found": p2_found, "p2_ledger": p2_ledger, "p3_found": p3_found, "p3_meta_table": p3_meta_table, "p3_diagnostics_table": p3_diagnostics_table, "p6_found": p6_found, "p6_monthly": p6_monthly}
SQL = {"p1_found": P1_FOUND, "p1_hierarchy": P1_HIERARCHY, "p1_descendants": P1_DESCENDANTS, "p2_found": P2_FOUND, "p2_ledger": P2_LEDGER, "p3_found": P3_FOUND, "p6_found": P6_FOUND, "p6_monthly": P6_MONTHLY}
