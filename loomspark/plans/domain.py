"""Queries of the lab, transcripts, knowledge, recordings, documents, exchange, streams and the flagship, on the domain's tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..operators import code, index as ix, investigate as inv, knowledge as kn, lab, papers, recordings as rec, state as st, text as tx
from ..session import materialise, shared_dir, stored, table
from ..sources import exchange as ex, transcripts as tr
from ..streaming import jobs
from .graphs import files
from .search import bm25_sql

K = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"


def _view(spark, d) -> DataFrame:
    return lab.run_view(table(spark, d, "runs"))


def run_metrics(spark, d) -> DataFrame:
    return _view(spark, d).select("run_id", F.explode("metrics").alias("metric", "value"))


def lab_summary(spark, d) -> DataFrame:
    return lab.summary(_view(spark, d)).select("exp_id", "n_runs", "win", "loss", "inconclusive", "n_answered")


def frozen(spark, d) -> DataFrame:
    return lab.frozen_by(_view(spark, d)).select("exp_id", "run_id")


def evidence(spark, d) -> DataFrame:
    return lab.evidence(_view(spark, d), table(spark, d, "evidence")).select("memory_id", "run_id", "sentence")


def log_metrics(spark, d) -> DataFrame:
    m = table(spark, d, "messages").filter("kind = 'tool_result' and text is not null").groupBy("id").agg(F.min("text").alias("text"))
    return m.select("id", F.explode(lab.metrics_of_log(F.col("text"))).alias("metric", "value"))


def _messages(spark, d) -> DataFrame:
    m = table(spark, d, "messages").filter("session_key is not null and ordinal is not null")
    one = m.groupBy(norm_key("session_key").alias("session_key"), "ordinal").agg(F.min(F.struct("id", "timestamp", "role", "kind", "text", "tool_name")).alias("m")).select("session_key", "ordinal", "m.*")
    names = F.broadcast(table(spark, d, "role_names").select(norm_key("raw_role").alias("r"), "role_name"))
    return one.join(names, norm_key("role") == F.col("r"), "left").withColumn("role", F.coalesce("role_name", "role")).drop("r", "role_name")


def digests(spark, d) -> DataFrame:
    x = tr.digest(_messages(spark, d))
    return x.select("session_key", "n", "n_user", "n_assistant", "n_tool_calls", F.coalesce(F.size("user_turns"), F.lit(0)).cast("long").alias("n_turns"))


def user_text_classes(spark, d) -> DataFrame:
    m = table(spark, d, "messages").filter("kind = 'message'").select(tr.classify_user(F.col("text")).alias("c"))
    return m.groupBy("c.role", "c.kind").agg(F.count(F.lit(1)).alias("n"))


def reparsed_transcripts(spark, d) -> DataFrame:
    """Sessions written out as line files of the generic kind and read back by the adapter: what comes back, per session."""
    m = _messages(spark, d).filter("text is not null and kind = 'message'")
    line = F.to_json(F.struct(F.col("role"), F.col("text").alias("content"), "timestamp"))
    f = m.groupBy("session_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l")))), lambda x: x["l"]), "\n").cast("binary").alias("content"))
    p = tr.parse(f.select(F.concat(F.lit("/x/"), "session_key", F.lit(".jsonl")).alias("path"), F.lit("generic").alias("surface"), "content"))
    return p.filter("ordinal is not null").groupBy(F.col("native_id").alias("session_key")).agg(F.count(F.lit(1)).alias("n_messages"))


def memories(spark, d) -> DataFrame:
    """Experiments' hypotheses as memories."""
    e = table(spark, d, "experiments").groupBy(norm_key("exp_id").alias("memory_id")).agg(F.max("hypothesis").alias("claim"), F.max("title").alias("title"), F.min("created_at").alias("created_at")).filter("claim <> ''")
    b = F.length("claim") % 4
    return e.withColumns({"kind": F.when(F.col("claim").rlike(kn.NEGATION), "warning").otherwise("invariant"), "severity": F.get(F.array(*[F.lit(s) for s in st.SEVERITY_ORDER]), b.cast("int")), "status": F.lit("ACTIVE"), "usage": F.lit(0.0), "inferred": F.lit(False), "event_id": F.col("memory_id")})


def claim_classes(spark, d) -> DataFrame:
    return kn.restatements(memories(spark, d))


def claim_token_counts(spark, d) -> DataFrame:
    return memories(spark, d).select("memory_id", F.size(kn.claim_tokens(F.col("claim"))).cast("long").alias("n_tokens"))


def claim_relations(spark, d) -> DataFrame:
    m = memories(spark, d)
    scope = m.select("memory_id", F.explode(F.array_distinct(F.regexp_extract_all("claim", F.lit("[a-z]+_[a-z_]+"), 0))).alias("target"))
    return kn.related(m, scope).select("a", "b", F.round("similarity", 4).alias("similarity"), "relation")


def rule_scores(spark, d) -> DataFrame:
    e = table(spark, d, "evidence").groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("verdict") == "win", 1).otherwise(0)).alias("h"), F.sum(F.when(F.col("verdict") == "loss", 1).otherwise(0)).alias("u"))
    return e.select("memory_id", F.round(kn.rule_score(F.lit("high"), F.col("n"), F.col("h"), F.col("u"), F.col("n"), F.lit(0)), 6).alias("score"))


def compiled(spark, d) -> DataFrame:
    e = table(spark, d, "experiments").groupBy(norm_key("exp_id").alias("event_id")).agg(F.max("title").alias("summary"), F.max("hypothesis").alias("h"), F.min("created_at").alias("at"))
    ev = e.withColumn("payload", F.create_map(F.lit("invariants"), F.array(F.coalesce("h", F.lit(""))), F.lit("other"), F.array(F.lit("x")))).drop("h")
    return kn.compile_event(ev, {"invariants": "invariant"}).select("event_id", "kind", "claim", "body")


def _trees(spark, d) -> DataFrame:
    """Trees as recordings have them, of the driver's orders: customer, order, line."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("lines").alias("file"), F.concat(F.lit("part"), F.col("l_partkey") % 20).alias("function"), F.lit(1).alias("count"), F.col("l_quantity").alias("total_ms"), F.col("l_quantity").alias("self_ms"))).alias("children"), F.sum("l_quantity").alias("q"))  # noqa: E741
    o = table(spark, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.struct(F.lit("orders").alias("file"), F.col("o_orderpriority").alias("function"), F.lit(1).alias("count"), (F.col("q") + 1.0).alias("total_ms"), F.lit(1.0).alias("self_ms"), "children").alias("n"))
    c = o.groupBy("o_custkey").agg(F.collect_list("n").alias("children"), F.sum("n.total_ms").alias("t"))
    return c.select(F.col("o_custkey").cast("string").alias("run"), F.lit(1).alias("pid"), F.to_json(F.struct(F.lit("c").alias("file"), F.lit("main").alias("function"), F.lit(1).alias("count"), (F.col("t") + 2.0).alias("total_ms"), F.lit(2.0).alias("self_ms"), "children")).alias("tree"))


def hot(spark, d) -> DataFrame:
    return rec.hot_functions(rec.flatten(_trees(spark, d))).groupBy("key").agg(F.sum("calls").alias("calls"), F.round(F.sum("self_ms"), 3).alias("self_ms"), F.round(F.sum("total_ms"), 3).alias("total_ms"))


def runtime(spark, d) -> DataFrame:
    return rec.runtime_edges(rec.flatten(_trees(spark, d))).groupBy("caller", "callee").agg(F.sum("calls").alias("calls"))


def run_diff(spark, d) -> DataFrame:
    n = materialise(rec.flatten(_trees(spark, d)), "trees")
    x = rec.compare(n.filter("run = '1'"), n.filter("run = '2'"))
    return x.select(F.array_join("path", " > ").alias("path"), "state", "calls_a", "calls_b")


def value_trails(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("call"), F.col("event_type").alias("name"), F.col("event_id").alias("at"), F.round("value", 0).cast("string").alias("value"))
    return rec.value_changes(e).select("call", "name", F.col("step").cast("long").alias("step"), F.col("at").alias("pos"), "value")


def context_tree(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(F.lit(1).alias("pid"), F.col("user_id").alias("thread"), F.col("event_id").alias("seq"), F.col("event_id").cast("double").alias("at"), F.when(F.col("event_id") % 3 == 0, "leave").otherwise("enter").alias("kind"), F.col("event_type").alias("function"))
    return rec.fold_events(e).groupBy(F.size("path").cast("long").alias("depth")).agg(F.sum("calls").alias("calls"), F.round(F.sum("self"), 3).alias("self"))


def doc_outline(spark, d) -> DataFrame:
    p = table(spark, d, "documents").filter("text is not null and source <> 'code_file'").select("doc_id", F.lit(1).alias("page"), "text")
    return papers.section_ends(papers.outline(p, "doc_id", "page", "text")).select("id", "line", "level", "title", F.col("end.line").alias("end_line"))


def html_text(spark, d) -> DataFrame:
    p = table(spark, d, "documents").filter("text is not null")
    page = F.concat(F.lit("<html><body><nav>menu</nav><h1>"), F.coalesce("source", F.lit("")), F.lit("</h1><p>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p><script>x</script></body></html>"))
    return p.select("doc_id", F.length(papers.html_to_text(page)).cast("long").alias("n_chars"))


def _export(spark, d) -> tuple[DataFrame, DataFrame]:
    r = table(spark, d, "repositories").select(F.col("repo_id").alias("id"), F.lit("repository").alias("kind"), F.col("name").alias("label"), F.col("vcs").alias("body"), "status")
    e = memories(spark, d).select(F.col("memory_id").alias("id"), F.lit("memory").alias("kind"), F.col("title").alias("label"), F.col("claim").alias("body"), "status")
    links = table(spark, d, "experiments").groupBy(norm_key("exp_id").alias("from_id")).agg(F.max(norm_key("parent_id")).alias("to_id")).filter("to_id is not null").select("from_id", "to_id", F.lit("DERIVED_FROM").alias("kind"), F.lit(1.0).alias("confidence"))
    return ex.build([r, e], links)


def export_stats(spark, d) -> DataFrame:
    return ex.stats(*_export(spark, d))


def export_round_trip(spark, d) -> DataFrame:
    at = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    ex.write_parts(*_export(spark, d), at)
    n, e = ex.read_parts(spark, at)
    return ex.stats(n, e)


def streamed_latest(spark, d) -> DataFrame:
    """The newest event of each user through a file stream, with the generations in the shared folder."""


    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.repartitionByRange(4, "event_id").write.parquet(f"{at}/in")
    jobs.sync(jobs.read_events(spark, f"{at}/in", e.schema), f"{at}/out", f"{at}/cp", ["user_id"], "ts").awaitTermination()
    return jobs.newest(spark, f"{at}/out").select("user_id", "event_id", "event_type")


def delivered_once(spark, d) -> DataFrame:
    """Each (user, event type) delivered once through a stream."""


    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.repartitionByRange(3, "event_id").write.parquet(f"{at}/in")
    s = jobs.once(jobs.read_events(spark, f"{at}/in", e.schema), ["user_id", "event_type"], "ts", "60 days")
    return jobs.run_to_table(s, f"{at}/out", f"{at}/cp").select("user_id", "event_type")


def _index(spark, d) -> ix.CodeIndex:
    """The stored index of the code files."""

    def build():
        i = ix.CodeIndex(spark, f"{shared_dir(spark)}/code-index-{uuid.uuid4().hex}")
        i.refresh(files(spark, d).select(F.col("doc_id").cast("string").alias("file_id"), "path", "text"))
        return i

    return stored(spark, d, "code", build)


def index_refresh(spark, d) -> DataFrame:
    """An index built from the code as it was on 1 January 2026, when texts of an odd length still lacked their last character, and refreshed to what is there now, files from before July 2025 being gone."""
    f = table(spark, d, "documents").filter("source = 'code_file' and text is not null").select(F.col("doc_id").cast("string").alias("file_id"), F.coalesce("path", F.lit("")).alias("path"), "text", "created_at")
    odd = F.length("text") % 2 == 1
    was = f.filter("created_at < timestamp'2026-01-01 00:00:00+00:00'").withColumn("text", F.when(odd, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    now = f.filter("created_at >= timestamp'2025-07-01 00:00:00+00:00' or created_at is null")
    i = ix.CodeIndex(spark, f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex}")
    i.refresh(was.drop("created_at"))
    return i.refresh(now.drop("created_at"))


def index_build(spark, d) -> DataFrame:
    """The store that questions are put to, with its indexes: what it holds."""
    st = store(spark, d)
    rows = [("files", _index(spark, d).files()), ("symbols", st.symbols), ("edges", st.edges), ("memories", st.memories)]
    out = None
    for what, df in rows:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def store(spark, d) -> inv.Store:
    """Made once a session from the stored index."""
    return stored(spark, d, "store", lambda: _store(spark, d))


def _store(spark, d) -> inv.Store:
    i = _index(spark, d)
    s = i.symbols()
    edges, _ = i.calls()
    syms = materialise(s.join(i.files().select("file_id", "path"), "file_id").select("symbol_id", "name", "symbol_path", "path", "signature", F.lit("ACTIVE").alias("status")), "symbols")
    m = memories(spark, d)
    named = m.select("memory_id", F.explode(F.array_distinct(F.regexp_extract_all("claim", F.lit("[a-z]+_[a-z_]+"), 0))).alias("name"))
    applies = named.join(syms.select("name").distinct(), "name", "left_semi").select("memory_id", "name")
    touched = materialise(syms.select("path", F.pmod(F.crc32("path"), F.lit(90)).cast("double").alias("days")).distinct(), "touched")
    return inv.Store(syms, materialise(edges, "edges"), materialise(m, "memories"), materialise(applies, "applies"), touched).indexed()


def investigate(spark, d) -> DataFrame:
    return inv.investigate(store(spark, d), "why does trim_vector wait on the import resolver").select("symbol_id", "name", "score", F.size("callers").alias("n_callers"), F.size("quoted").alias("n_quoted"), "cost")


def investigate_ranked(spark, d) -> DataFrame:
    return inv.rank(store(spark, d), "refactor rank_alias and load_path").select("symbol_id", "name", "score")


def memory_ranking(spark, d) -> DataFrame:
    m = memories(spark, d)
    hit = tx.bm25(m, "claim", tx.parse("hook import wait", "any"))
    s = kn.memory_score(F.least(F.lit(1.0), F.col("score") / 10), F.col("severity"), F.col("usage"), F.col("status"), F.col("inferred"), F.col("kind"), "modify")
    return hit.select("memory_id", F.round(s, 6).alias("mscore"))


def static_settings(spark, d) -> DataFrame:
    rows = [(i, json.dumps(w, sort_keys=True)) for i, w in inv.WEIGHTS.items()]
    return spark.createDataFrame(rows, "intent string, weights string")


QUERIES = {
    "S41_X16_run_metrics": run_metrics, "A28_M22_lab_summary": lab_summary, "X16_frozen_by": frozen, "X10_evidence": evidence, "S41_log_metrics": log_metrics, "A11_digest": digests, "P24_user_text": user_text_classes, "S23_S30_reparsed": reparsed_transcripts,
    "D1_D8_claim_classes": claim_classes, "D7_claim_tokens": claim_token_counts, "D10_claim_relations": claim_relations, "M18_rule_scores": rule_scores, "M10_D11_compiled": compiled, "A18_X8_hot_functions": hot, "A19_runtime_edges": runtime, "M26_run_diff": run_diff, "X3_value_trails": value_trails, "X2_context_tree": context_tree,
    "F24_W12_outline": doc_outline, "F25_html_text": html_text, "S44_A26_export": export_stats, "S45_S46_round_trip": export_round_trip, "T1_T2_stream_latest": streamed_latest, "T6_delivered_once": delivered_once,
    "S1_X33_index_build": index_build, "S2_M23_index_refresh": index_refresh, "F15_investigate": investigate, "F15_ranked": investigate_ranked, "F16_memory_scores": memory_ranking, "F18_weights": static_settings,
}

_VIEW = f"v as (select * from (select {K.format('run_id')} as run_id, {K.format('exp_id')} as exp_id, status, verdict, answered, try_cast(started_at as timestamptz) as started, metrics, row_number() over (partition by {K.format('run_id')} order by try_cast(ended_at as timestamptz) desc nulls last, try_cast(started_at as timestamptz) desc nulls last, {K.format('exp_id')} desc nulls last) as rn from runs where run_id is not null) where rn = 1)"
_TREE = "t as (select o_custkey, o_orderkey, o_orderpriority, l_partkey % 20 as p, l_quantity as q from orders join lineitem on o_orderkey = l_orderkey)"
SQL = {
    "S41_X16_run_metrics": f"with {_VIEW} select run_id, unnest(json_keys(metrics)) as metric, cast(json_extract(metrics, '$.' || unnest(json_keys(metrics))) as double) as value from v where metrics is not null and json_valid(metrics)",
    "S2_M23_index_refresh": "with f as (select doc_id, text, created_at from documents where source = 'code_file' and text is not null), c as (select case when not (created_at >= timestamptz '2025-07-01 00:00:00+00' or created_at is null) then 'removed' when created_at is null or created_at >= timestamptz '2026-01-01 00:00:00+00' then 'added' when length(text) % 2 = 1 then 'changed' else 'same' end as change from f) select change, count(*) as n from c group by 1",
    "A28_M22_lab_summary": f"with {_VIEW} select exp_id, count(*) as n_runs, count(*) filter (verdict = 'win') as win, count(*) filter (verdict = 'loss') as loss, count(*) filter (verdict = 'inconclusive') as inconclusive, cast(sum(coalesce(answered, 0)) as bigint) as n_answered from v where exp_id is not null group by 1",
    "X16_frozen_by": f"with {_VIEW} select exp_id, min_by(run_id, (started, run_id)) as run_id from v where answered = 1 and exp_id is not null group by 1",
    "A11_digest": f"with m as (select {K.format('session_key')} as session_key, ordinal, min(id) as id from messages where session_key is not null and ordinal is not null group by 1, 2), j as (select m.session_key, coalesce(r.role_name, x.role) as role, x.kind from m join (select id, min(role) as role, min(kind) as kind, ordinal, {K.format('session_key')} as k from messages group by id, ordinal, {K.format('session_key')}) x on x.id = m.id and x.ordinal = m.ordinal and x.k = m.session_key left join role_names r on r.raw_role = {K.format('x.role')}) select session_key, count(*) as n, count(*) filter (role = 'user') as n_user, count(*) filter (role = 'assistant') as n_assistant, count(*) filter (kind = 'tool_call') as n_tool_calls, greatest(-0, case when count(*) filter (role = 'user' and kind = 'message') = 0 then -1 else least(40, count(*) filter (role = 'user' and kind = 'message')) end)::bigint as n_turns from j group by 1",
    "P24_user_text": "select case when left(ltrim(text), 80) like '<system-reminder>%' then 'system' else 'user' end as role, case when left(ltrim(text), 80) like '<system-reminder>%' then 'system' else 'message' end as kind, count(*) as n from messages where kind = 'message' group by 1, 2",
    "D7_claim_tokens": f"with e as (select {K.format('exp_id')} as memory_id, max(hypothesis) as claim from experiments group by 1) select memory_id, len(list_filter(list_distinct(regexp_extract_all(lower(claim), '[a-z0-9_]{{3,}}')), lambda x: not list_contains(string_split('{' '.join(kn.CLAIM_STOP)}', ' '), x)))::bigint as n_tokens from e where claim <> ''",
    "D1_D8_claim_classes": f"with e as (select {K.format('exp_id')} as memory_id, max(hypothesis) as claim from experiments group by 1), m as (select memory_id, claim, case when regexp_matches(claim, '{kn.NEGATION[4:].replace(chr(39), chr(39) * 2)}', 'i') then 'w' else 'i' end as kind from e where claim <> '') select memory_id, min(memory_id) over (partition by kind, claim) as class_id, count(*) over (partition by kind, claim) as n from m",
    "M18_rule_scores": "with e as (select memory_id, count(*) as n, sum(case when verdict = 'win' then 1 else 0 end) as h, sum(case when verdict = 'loss' then 1 else 0 end) as u from evidence group by 1) select memory_id, round(0.75 * (1 + 0.6 * ln(n)) * (1 + 0.4 * ln(1 + h)) / (1 + 0.5 * u) * (1 + 0.25 * ln(1 + n)), 6) as score from e",
    "M10_D11_compiled": f"with e as (select {K.format('exp_id')} as event_id, max(title) as summary, max(hypothesis) as claim from experiments group by 1) select event_id, 'invariant' as kind, claim, case when coalesce(summary, '') <> '' then claim || chr(10) || chr(10) || 'Recorded while: ' || summary else claim end as body from e where trim(coalesce(claim, '')) <> ''",
    "M26_run_diff": f"with {_TREE}, n as (select o_custkey as run, 'c:main > orders:' || o_orderpriority as path, count(distinct o_orderkey) as calls, sum(q) + count(distinct o_orderkey) as ms from t where o_custkey <= 2 group by 1, 2 union all select o_custkey, 'c:main > orders:' || o_orderpriority || ' > lines:part' || p, count(*), sum(q) from t where o_custkey <= 2 group by 1, 2 union all select o_custkey, 'c:main', 1, sum(q) + count(distinct o_orderkey) + 2 from t where o_custkey <= 2 group by 1), j as (select coalesce(a.path, b.path) as path, a.calls as calls_a, b.calls as calls_b, case when a.path is null then 'only_b' when b.path is null then 'only_a' when a.calls <> b.calls then 'calls' when abs(a.ms - b.ms) >= 5 and greatest(a.ms, b.ms) >= 1.25 * least(a.ms, b.ms) then 'time' else 'same' end as state from (select * from n where run = 1) a full join (select * from n where run = 2) b on a.path = b.path) select path, state, calls_a, calls_b from j where state <> 'same' and not exists (select 1 from j u where u.state in ('only_a', 'only_b') and u.state = j.state and u.path = regexp_replace(j.path, ' > [^>]*$', '') and u.path <> j.path)",
    "A19_runtime_edges": f"with {_TREE} select 'orders:' || o_orderpriority as caller, 'lines:part' || p as callee, count(*) as calls from t group by 1, 2 union all select 'c:main', 'orders:' || o_orderpriority, count(distinct o_orderkey) from t group by 2",
    "A18_X8_hot_functions": f"with {_TREE} select 'lines:part' || p as key, count(*) as calls, round(sum(q), 3) as self_ms, round(sum(q), 3) as total_ms from t group by 1 union all select 'orders:' || o_orderpriority, count(*), count(*), round(sum(s), 3) from (select o_orderkey, o_orderpriority, sum(q) + 1 as s from t group by 1, 2) group by 1 union all select 'c:main', count(*), 2.0 * count(*), round(sum(s) + 2 * count(*), 3) from (select o_custkey, sum(s) as s from (select o_custkey, o_orderkey, sum(q) + 1 as s from t group by 1, 2) group by 1)",
    "S44_A26_export": f"with e as (select {K.format('exp_id')} as id, max(hypothesis) as claim, max({K.format('parent_id')}) as p from experiments group by 1), n as (select id from e where claim <> '' union all select repo_id from repositories where status <> 'DELETED') select 'node' as what, 'memory' as kind, count(*) as n from e where claim <> '' union all select 'node', 'repository', count(*) from repositories where status <> 'DELETED' union all select 'edge', 'DERIVED_FROM', count(*) from e where id in (select id from n) and p in (select id from n)",
    "T1_T2_stream_latest": "select user_id, max_by(event_id, (ts, event_id)) as event_id, max_by(event_type, (ts, event_id)) as event_type from events group by 1",
    "T6_delivered_once": "select distinct user_id, event_type from events",
    "X3_value_trails": "with v as (select user_id as call, event_type as name, event_id as pos, round(value, 0) as val, lag(round(value, 0)) over w as p, row_number() over w as n from events window w as (partition by user_id, event_type order by event_id)), c as (select call, name, pos, val, row_number() over (partition by call, name order by pos) as step, row_number() over (partition by call, name order by pos desc) as back from v where n = 1 or val <> p) select call, name, step, pos, cast(cast(val as double) as varchar) as value from c where step <= 6 or back = 1",
}
SQL["F16_memory_scores"] = f"with hy as (select * from (select {K.format('exp_id')} as memory_id, max(hypothesis) as claim from experiments group by 1) where claim <> ''), {bm25_sql('hy', 'claim', [' hook ', ' import ', ' wait '], 'memory_id, claim')} select memory_id, round(1.6 * greatest(0.62, least(1.0, score / 10)) + 1.4 * [1.0, 0.75, 0.45, 0.2][1 + length(claim) % 4], 6) as mscore from scored"
SQL["S45_S46_round_trip"] = SQL["S44_A26_export"]
