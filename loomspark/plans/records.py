"""Queries of sessions, records of memories, recordings and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..operators import investigate as inv, orphans, record as rc, recordings as rec, text as tx
from ..session import materialise, table
from ..sources import archive
from .domain import _index, _trees, store
from .graphs import _EDGES, parts_edges
from .search import _MSG, bm25_sql, message_index

K = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"
_STATES = "['native_id', 'source_path', 'live_path', 'updated_at', 'started_at', 'origin', 'provider', 'cwd', 'repo_root']"
_COLS = ["native_id", "source_path", "live_path", "updated_at", "started_at", "origin", "provider", "cwd", "repo_root"]


def _sessions(spark, d) -> DataFrame:
    """One row a session key: of repeated rows the greatest value of each column."""
    s = table(spark, d, "sessions").filter("session_key is not null")
    return s.groupBy(norm_key("session_key").alias("session_key")).agg(*[F.max(c).alias(c) for c in _COLS])


_S = f"s as (select {K.format('session_key')} as session_key, " + ", ".join(f"max({c}) as {c}" for c in _COLS) + " from sessions where session_key is not null group by 1)"


def session_lookup(spark, d) -> DataFrame:
    """All sessions asked for by their keys, native ids, paths and the first four characters of native ids."""
    s = materialise(_sessions(spark, d), "sessions")
    asked = s.select(F.explode(F.array("session_key", "native_id", "source_path", F.substring("native_id", 1, 4))).alias("asked"))
    return rc.find_sessions(s, asked).groupBy("asked", "how").agg(F.count(F.lit(1)).alias("n"), F.min("session_key").alias("first_key"))


def session_pages(spark, d) -> DataFrame:
    """The second page of each session of provider northbeam: user and assistant rows from ordinal 3 on, 4 a session, texts cut at 60 characters."""
    m = table(spark, d, "messages").filter("session_key is not null").select("id", norm_key("session_key").alias("session_key"), "ordinal", norm_key("role").alias("role"), "kind", "text").dropDuplicates(["id"])
    one = m.groupBy("session_key", "ordinal").agg(F.min(F.struct("id", "role", "kind", "text")).alias("m")).select("session_key", "ordinal", "m.id", "m.role", "m.kind", "m.text")
    found = _sessions(spark, d).filter("provider = 'northbeam'")
    return rc.fetch(one, found, 3, 4, ["user", "assistant"], None, 60).select("session_key", "ordinal", "role", "kind", "text", "next_ordinal")


def filtered_search(spark, d) -> DataFrame:
    """Hits in archived sessions of one code base within a time range, at most 2 a session, the best 20."""
    hits = message_index(spark, d).hits(tx.parse("baseline loss", "any")).select("id", F.round("score", 6).alias("score"))
    m = table(spark, d, "messages").filter("session_key is not null").groupBy("id").agg(F.min(norm_key("session_key")).alias("session_key"), F.min("timestamp").alias("timestamp"))
    s = _sessions(spark, d).filter(rc.in_code_base("/srv/work") | rc.of_origin("archive"))
    j = hits.join(m, "id").join(s, "session_key").filter(rc.message_time().between("2025-09-01", "2026-03-31"))
    return tx.per_group(j, ["session_key"], [F.desc("score"), F.col("id")], 2).orderBy(F.desc("score"), "id").limit(20).select("id", "session_key", "score")


def _memories(spark, d) -> DataFrame:
    e = table(spark, d, "experiments").groupBy(norm_key("exp_id").alias("memory_id")).agg(F.max("title").alias("title"), F.max("hypothesis").alias("claim"), F.max("created_at").alias("created_at"), F.max(norm_key("parent_id")).alias("parent"))
    return e.filter("claim <> ''")


_M = f"mm as (select * from (select {K.format('exp_id')} as memory_id, max(title) as title, max(hypothesis) as claim, max(created_at) as created_at, max({K.format('parent_id')}) as parent from experiments group by 1) where claim <> '')"


def whole_records(spark, d) -> DataFrame:
    """Experiments as memories with their runs as anchors and their evidence as edges; of each the sizes and first and last entries."""
    m = _memories(spark, d)
    r = table(spark, d, "runs").filter("exp_id is not null and run_id is not null").select(norm_key("exp_id").alias("memory_id"), norm_key("run_id").alias("symbol_id"), F.lit(None).cast("string").alias("file_id")).distinct()
    syms = r.select("symbol_id").distinct().select("symbol_id", F.lit("f").alias("file_id"), F.col("symbol_id").alias("symbol_path"), F.lit(1).alias("line_start"), F.lit(2).alias("line_end"), F.md5("symbol_id").alias("content_fp"), F.md5("symbol_id").alias("skeleton_fp"))
    files = spark.createDataFrame([("f", "a.py")], "file_id string, path string")
    anchors = rc.anchor_snapshot(r, syms, files, F.lit("c0"), F.lit("2026-01-01"))
    edges = table(spark, d, "evidence").filter("exp_id is not null").select(norm_key("exp_id").alias("from_id"), F.coalesce("verdict", F.lit("none")).alias("kind"), F.col("memory_id").alias("to_id"), F.lit(1.0).alias("confidence"), F.lit("ACTIVE").alias("status")).distinct()
    versions = table(spark, d, "experiments").filter("promoted_at is not null").select(norm_key("exp_id").alias("memory_id"), "promoted_at").distinct().select("memory_id", F.row_number().over(Window.partitionBy("memory_id").orderBy("promoted_at")).alias("version"), F.col("promoted_at").alias("changed_at"), F.lit("promoted").alias("reason"))
    x = rc.whole_record(m.select("memory_id"), anchors, edges, versions)
    return x.select("memory_id", F.size("anchors").cast("long").alias("n_anchors"), F.size("edges").cast("long").alias("n_edges"), F.get("versions.version", F.lit(0)).cast("long").alias("newest"))


def recovery(spark, d) -> DataFrame:
    """Bodies cut at 60 characters, composed anew from their events and from the runs they are anchored in."""
    m = _memories(spark, d).filter("length(claim) > 60").select("memory_id", F.concat(F.substring("claim", 1, 57), F.lit("...")).alias("body"), F.lit("ACTIVE").alias("status"), F.col("memory_id").alias("event_id"))
    e = _memories(spark, d).select(F.col("memory_id").alias("event_id"), F.col("title").alias("summary"), F.to_json(F.struct(F.col("claim").alias("reasoning"), F.array("title").alias("changes"))).alias("payload"))
    a = table(spark, d, "runs").filter("exp_id is not null and run_id is not null").select(norm_key("exp_id").alias("memory_id"), norm_key("run_id").alias("at"), norm_key("run_id").alias("symbol_path"), F.lit(None).cast("string").alias("file_path")).distinct()
    return rc.recovered(m, e, a).select("memory_id", "stored_chars", "rebuilt_chars")


def reach(spark, d) -> DataFrame:
    """Suppliers as rules on the parts of their number: files and callers they reach."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("file_path"))
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("memory_id"), F.col("l_partkey").alias("symbol_id")).distinct().join(p, "symbol_id").withColumn("status", F.when(F.col("symbol_id") % 50 == 0, "ORPHANED").otherwise("ACTIVE"))
    return rc.rule_scope(a, parts_edges(spark, d))


def queue(spark, d) -> DataFrame:
    """Experiments with evidence as inferences that wait for review."""
    m = _memories(spark, d).select("memory_id", "created_at", F.lit("ACTIVE").alias("status"), F.lit(True).alias("inferred"), F.lit(None).cast("string").alias("review"))
    p = table(spark, d, "evidence").filter("exp_id is not null").select(norm_key("exp_id").alias("memory_id"), F.col("memory_id").alias("to_id"))
    return rc.review_queue(m, p).select("memory_id", "n_parents")


def touched(spark, d) -> DataFrame:
    """A diff that changes the first line of every symbol of the code: the symbols it names, at most 12 a file."""
    i = _index(spark, d)
    s = materialise(i.symbols().filter("kind <> 'module'").join(i.files().select("file_id", "path"), "file_id").select("file_id", "path", "name", "symbol_id", "symbol_path", "line_start", F.lit("ACTIVE").alias("status"), "signature"), "symbols")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_start", "signature"))), lambda x: F.concat(F.lit("+"), F.coalesce(x["signature"], F.lit("")))), "\n")
    patches = s.groupBy(F.col("file_id").alias("patch_id"), "path").agg(body.alias("b")).select("patch_id", F.concat(F.lit("--- a/x\n+++ b/"), "path", F.lit("\n@@ -1 +1 @@\n"), "b").alias("patch"))
    return rc.touched_symbols(rc.touched_identifiers(patches), s).select("patch_id", "symbol_path")


def tree_sums(spark, d) -> DataFrame:
    return rec.tree_totals(rec.flatten(_trees(spark, d)))


def stories(spark, d) -> DataFrame:
    """The longest kinds of orders of each customer, as activities of a run."""
    return rec.narrative(rec.flatten(_trees(spark, d)), 3, 4).select("run", "activity", "calls", F.round("total_ms", 3).alias("total_ms"), "n_children")


def libraries(spark, d) -> DataFrame:
    """Event types as labels that users call: the first three a user."""
    e = table(spark, d, "events").select(F.lit("r").alias("run"), F.col("user_id").alias("node"), F.col("event_type").alias("label"), F.col("event_id").alias("at"))
    return rec.library_calls(e, 3).select("node", "label", "n")


def histories(spark, d) -> DataFrame:
    """Users as functions, days as calls, values of the event types as variables; the ten busiest users."""
    e = table(spark, d, "events")
    c = e.select(F.lit("r").alias("run"), F.col("user_id").alias("function"), F.to_date("ts").cast("string").alias("call"), F.col("event_id").alias("at"), F.col("event_type").alias("name"), F.round("value", 0).cast("long").alias("value"))
    cost = e.groupBy(F.lit("r").alias("run"), F.col("user_id").alias("function")).agg(F.count(F.lit(1)).alias("total_ms"))
    return rec.costliest_histories(c, cost, 10).select("function", "name", "trail")


def printed(spark, d) -> DataFrame:
    """Events of two users as the lines that two runs printed."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("at"), F.concat("event_type", F.lit(" "), F.round("value", 0).cast("long")).alias("line"))
    return rec.output_difference(e.filter("user_id = 1").select("at", "line"), e.filter("user_id = 2").select("at", "line"))


def seen_running(spark, d) -> DataFrame:
    """Which kinds of lines the last three customers' trees ran."""
    e = rec.runtime_edges(rec.flatten(_trees(spark, d))).withColumn("run", F.lpad("run", 8, "0"))
    keys = spark.createDataFrame([(f"lines:part{i}",) for i in range(25)], "key string")
    return rec.observed(e, keys).select("key", "run", "calls", F.array_join("called_by", ",").alias("called_by"))


def sources_of_archive(spark, d) -> DataFrame:
    """Source files as archived copies, refreshes as generations; a file the last refresh saw is still there."""
    f = table(spark, d, "source_files").filter("source_path is not null and refresh_id is not null")
    v = f.select(F.col("source_path").alias("key"), F.col("refresh_id").alias("generation"), F.col("source_path").alias("live_path")).distinct()
    return archive.archived_sources(v, f.filter("refresh_id = 9").select(F.col("source_path").alias("path"))).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("live_path").alias("n_live"))


def workspaces(spark, d) -> DataFrame:
    s = _sessions(spark, d).filter("cwd is not null and native_id is not null")
    f = s.select(F.concat(F.lit("/home/u/workspaceStorage/"), "native_id", F.lit("/workspace.json")).alias("path"), F.to_json(F.struct(F.concat(F.lit("file://"), F.replace("cwd", F.lit("w"), F.lit("%77"))).alias("folder"))).alias("content"))
    return rc.workspace_map(f)


def two_roots(spark, d) -> DataFrame:
    s = store(spark, d)
    return inv.several([("one", s), ("two", s)], "refactor rank_alias and load_path")


def no_terms(spark, d) -> DataFrame:
    e = inv.empty_result("how is the")
    return spark.createDataFrame([(e["query"], e["intent"], len(e["terms"]), len(e["capsules"]), e["note"])], "query string, intent string, n_terms long, n_capsules long, note string")


QUERIES = {
    "F29_session_lookup": session_lookup, "F29_session_pages": session_pages, "P7_P8_O5_filtered_search": filtered_search, "M9_M12_whole_records": whole_records, "M13_recovery": recovery, "A31_rule_scope": reach, "O8_review_queue": queue, "J29_touched_symbols": touched,
    "A20_tree_totals": tree_sums, "X7_narrative": stories, "X4_library_calls": libraries, "X6_value_histories": histories, "U7_output_difference": printed, "M28_observed": seen_running, "S27_archived_sources": sources_of_archive, "S21_workspace_map": workspaces, "U6_two_roots": two_roots, "F19_empty_result": no_terms,
}

_TREE = "t as (select o_custkey, o_orderkey, o_orderpriority, l_partkey % 20 as p, l_quantity as q from orders join lineitem on o_orderkey = l_orderkey)"
_LAST = "cast(o_custkey as varchar)"
SQL = {
    "F29_session_lookup": f"with {_S}, a as (select distinct unnest([session_key, native_id, source_path, substr(native_id, 1, 4)]) as asked from s), k as (select asked, session_key, 'key' as how from a join s on asked = session_key), nm as (select distinct asked, session_key, 'name' as how from a join (select session_key, unnest([native_id, source_path, live_path]) as x from s) on asked = x where asked not in (select asked from k)), r as (select asked from a where asked is not null and asked <> '' and asked not in (select asked from k) and asked not in (select asked from nm)), p as (select asked, session_key, 'prefix' as how, row_number() over (partition by asked order by updated_at desc nulls last, session_key) as rn from r join s on starts_with(native_id, asked)), x as (select * from k union all select * from nm union all select asked, session_key, how from p where rn <= 5) select asked, how, count(*) as n, min(session_key) as first_key from x where asked <> '' group by 1, 2",
    "F29_session_pages": f"with {_S}, m0 as (select id, min(struct_pack(sk := {K.format('session_key')}, o := ordinal, r := {K.format('role')}, k := kind, t := text)) as x from messages where session_key is not null group by id), m1 as (select x.sk as session_key, x.o as ordinal, id, x.r as role, x.k as kind, x.t as text from m0), m as (select * from (select *, row_number() over (partition by session_key, ordinal order by id) as k1 from m1) where k1 = 1), w as (select m.*, row_number() over v as rn, lead(ordinal) over v as nx from m where ordinal >= 3 and session_key in (select session_key from s where provider = 'northbeam') and role in ('user', 'assistant') window v as (partition by session_key order by ordinal, id)) select session_key, ordinal, role, kind, case when length(text) > 60 then left(text, 60) || ' [... ' || (length(text) - 60) || ' more chars]' else text end as text, case when rn = 4 and nx is not null then ordinal + 1 end as next_ordinal from w where rn <= 4",
    "P7_P8_O5_filtered_search": f"with {_S}, {_MSG}, {bm25_sql('m', 'text', [' baseline ', ' loss '], 'id, session_key')}, ts as (select id, min(\"timestamp\") as at from messages where session_key is not null group by id), h as (select x.id, x.session_key, round(x.score, 6) as score from scored x join s on s.session_key = x.session_key join ts on ts.id = x.id where (s.origin in ('archive', 'archive_only', 'archive_version') or lower(rtrim(s.cwd, '/')) = '/srv/work' or lower(s.cwd) like '/srv/work/%' or lower(rtrim(s.repo_root, '/')) = '/srv/work' or lower(s.repo_root) like '/srv/work/%') and coalesce(ts.at, s.updated_at, s.started_at) between '2025-09-01' and '2026-03-31'), r as (select *, row_number() over (partition by session_key order by score desc, id) as rn from h) select id, session_key, score from r where rn <= 2 order by score desc, id limit 20",
    "M9_M12_whole_records": f"with {_M}, a as (select {K.format('exp_id')} as memory_id, count(distinct {K.format('run_id')}) as n from runs where exp_id is not null and run_id is not null group by 1), e as (select {K.format('exp_id')} as memory_id, count(distinct (coalesce(verdict, 'none'), memory_id)) as n from evidence where exp_id is not null group by 1), v as (select {K.format('exp_id')} as memory_id, count(distinct promoted_at) as n from experiments where promoted_at is not null group by 1) select mm.memory_id, coalesce(a.n, 0) as n_anchors, coalesce(e.n, 0) as n_edges, v.n as newest from mm left join a using (memory_id) left join e using (memory_id) left join v using (memory_id)",
    "M13_recovery": f"with {_M}, w as (select memory_id, string_agg(run_id, ', ' order by run_id) as w from (select *, row_number() over (partition by memory_id order by run_id) as rn from (select distinct {K.format('exp_id')} as memory_id, {K.format('run_id')} as run_id from runs where exp_id is not null and run_id is not null and {K.format('run_id')} <> '')) where rn <= 6 group by 1), c as (select memory_id, title, claim, substr(claim, 1, 57) as cut, w from mm left join w using (memory_id) where length(claim) > 60), b as (select memory_id, rtrim(ltrim(cut)) || case when coalesce(title, '') <> '' and not contains(lower(cut), lower(title)) then chr(10) || chr(10) || 'Recorded while: ' || title else '' end || case when not contains(lower(cut), lower(claim)) then chr(10) || chr(10) || 'Why: ' || trim(claim) else '' end || case when coalesce(title, '') <> '' then chr(10) || chr(10) || 'Changed: ' || title else '' end || coalesce(chr(10) || chr(10) || 'Applies to: ' || w, '') as body from c) select memory_id, cast(60 as bigint) as stored_chars, length(body) as rebuilt_chars from b where length(body) > 60",
    "A31_rule_scope": f"with {_EDGES}, a as (select distinct l_suppkey as memory_id, l_partkey as symbol_id from lineitem), x as (select memory_id, count(distinct p_brand) as n_files, bool_and(symbol_id % 50 <> 0) as all_active from a join part on p_partkey = symbol_id group by 1), c as (select memory_id, count(distinct from_id) as n from a join part on p_partkey = symbol_id join e on e.to_id = symbol_id group by 1) select memory_id, n_files, coalesce(c.n, 0) as n_callers, all_active from x left join c using (memory_id)",
    "O8_review_queue": f"with {_M}, n as (select {K.format('exp_id')} as memory_id, count(distinct memory_id) as n from evidence where exp_id is not null group by 1) select memory_id, coalesce(n, 0) as n_parents from mm left join n using (memory_id) order by 2 desc, created_at desc nulls last, memory_id limit 30",
    "A20_tree_totals": f"with {_TREE}, n as (select o_custkey, count(distinct o_orderpriority) as pri, count(distinct o_orderkey) as ord, count(*) as lines, count(distinct (o_orderpriority, p)) as kinds from t group by 1) select {_LAST} as run, cast(1 + ord + lines as bigint) as calls, cast(1 + pri + kinds as bigint) as nodes from n",
    "X4_library_calls": "with n as (select user_id as node, event_type as label, count(*) as n, min(event_id) as first from events group by 1, 2) select node, label, n from (select *, row_number() over (partition by node order by first, label) as rn from n) where rn <= 3",
    "U7_output_difference": "with e as (select user_id, event_id as n, event_type || ' ' || cast(round(value, 0) as bigint) as line from events where user_id in (1, 2)), x as (select 'only_a' as side, n, line from e where user_id = 1 and line not in (select line from e where user_id = 2) order by n desc limit 10), y as (select 'only_b' as side, n, line from e where user_id = 2 and line not in (select line from e where user_id = 1) order by n desc limit 10) select side, n as \"at\", line from x union all select side, n, line from y",
    "M28_observed": f"with {_TREE}, last as (select distinct o_custkey from t order by lpad({_LAST}, 8, '0') desc limit 3), k as (select 'lines:part' || i as key from range(25) r(i)), c as (select 'lines:part' || p as key, lpad({_LAST}, 8, '0') as run, count(*) as calls, string_agg(distinct 'orders:' || o_orderpriority, ',' order by 'orders:' || o_orderpriority) as called_by from t where o_custkey in (select o_custkey from last) group by 1, 2), b as (select * from (select *, row_number() over (partition by key order by run desc) as rn from c) where rn = 1) select k.key, coalesce(b.run, (select max(lpad({_LAST}, 8, '0')) from last)) as run, coalesce(b.calls, 0) as calls, coalesce(b.called_by, '') as called_by from k left join b on b.key = k.key",
    "S27_archived_sources": "with v as (select distinct source_path as key, refresh_id as g from source_files where source_path is not null and refresh_id is not null), x as (select key, g, g = max(g) over (partition by key) as newest, key in (select source_path from source_files where refresh_id = 9 and source_path is not null) as there from v) select case when not newest then 'archive_version' when there then 'archive' else 'archive_only' end as origin, count(*) as n, count(*) filter (newest) as n_live from x group by 1",
    "S21_workspace_map": f"with {_S} select native_id as workspace_id, max(cwd) as folder from s where cwd is not null and native_id is not null group by 1",
    "F19_empty_result": "select 'how is the' as query, 'understand' as intent, cast(0 as bigint) as n_terms, cast(0 as bigint) as n_capsules, 'the query has no terms to search for' as note",
}
