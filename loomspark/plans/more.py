"""Further queries: catalog, history, anchors, fingerprints, areas, deliveries, documents and archive on the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..operators import catalog as cat, code, graph as g, knowledge as kn, papers, state as st, text as tx, vector as vx
from ..session import materialise, table
from ..sources import archive, exchange as ex, history
from .domain import memories
from .search import bm25_sql, doc_index
from .graphs import _EDGES, code_areas, files, nation_edges, parts_edges

K = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"


def commits(spark, d) -> DataFrame:
    """A commit log in text, as version control prints it, made of orders and lines, and read back."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.format_string("%d\t0\tsrc/p%d.py", F.col("l_quantity").cast("long"), F.col("l_partkey")).alias("line"))  # noqa: E741
    t = l.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("b")).select(F.concat(F.lit("@"), F.lpad("l_orderkey", 8, "0"), F.lit(" "), F.col("l_orderkey") * 1000, F.lit("\n\n"), "b", F.lit("\n")).alias("t"))
    return history.parse_numstat(t, "t")


def commit_log(spark, d) -> DataFrame:
    return commits(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("added").alias("added"), F.max(F.unix_seconds("ts")).alias("last"))


def recency(spark, d) -> DataFrame:
    return history.last_touched(commits(spark, d)).select("path", F.unix_seconds("ts").alias("last"))


def rename_paths(spark, d) -> DataFrame:
    p = table(spark, d, "documents").filter("path is not null").select("doc_id", F.concat(F.lit("old/{x => "), F.substring_index("path", "/", 1), F.lit("}/"), F.element_at(F.split("path", "/"), -1)).alias("p"))
    return p.select("doc_id", history.rename_target(F.col("p")).alias("path"))


def coupled_without_import(spark, d) -> DataFrame:
    """Couplings that no edge explains: unordered pairs against edges."""
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"))
    pairs = g.coupling(c, 3, 8)
    e = parts_edges(spark, d).select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"), F.lit(True).alias("e")).distinct()
    return pairs.join(e, ["a", "b"], "left").select("a", "b", "shared", F.col("e").isNotNull().alias("explained"))


def repository_states(spark, d) -> DataFrame:
    present = table(spark, d, "checkouts").filter("status = 'ACTIVE'").select(norm_key("repo_id").alias("repo_id")).filter("repo_id is not null")
    return cat.lifecycle(table(spark, d, "repositories").select("repo_id", "status"), present)


def cross_repository(spark, d) -> DataFrame:
    e = table(spark, d, "checkouts").groupBy("checkout_id").agg(F.max(norm_key("repo_id")).alias("to_repo")).filter("to_repo is not null")
    return cat.cross_edges(e, table(spark, d, "repositories"))


def pending_healed(spark, d) -> DataFrame:
    e = table(spark, d, "checkouts").groupBy(F.col("checkout_id").alias("edge_id")).agg(F.max(norm_key("repo_id")).alias("to_ref")).filter("to_ref is not null").withColumn("status", F.lit("PENDING"))
    a = table(spark, d, "repositories").select("repo_id", F.col("repo_id").alias("alias"))
    return cat.heal_pending(e, a)


def identified(spark, d) -> DataFrame:
    """Repositories by the heaviest alias: customers as aliases of nations, orders as probes."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("repo_id"), F.col("c_custkey").alias("alias"), F.round("c_acctbal", 2).alias("weight"))
    p = table(spark, d, "orders").select(F.col("o_orderpriority").alias("probe_id"), F.col("o_custkey").alias("alias"))
    return cat.identify(a, p)


def names_resolved(spark, d) -> DataFrame:
    s = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat_ws(".", F.col("p_brand"), F.col("p_name")).alias("symbol_path"))
    r = table(spark, d, "part").select(F.upper("p_name").alias("ref")).unionByName(table(spark, d, "part").select(F.concat_ws(".", F.col("p_brand"), F.col("p_name")).alias("ref"))).distinct()
    return cat.resolve_names(r, s).select("ref", "symbol_id", "n")


def delivered(spark, d) -> DataFrame:
    """What users who touch parts are told: parts as files, lines as memories."""
    m = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.concat(F.col("l_orderkey"), F.lit("-"), F.col("l_partkey")).alias("memory_id")).agg(F.lit("x" * 100).alias("claim"), F.max(F.when(F.col("l_quantity") > 40, "high").otherwise("low")).alias("severity"), F.lit(0.9).alias("confidence"), F.lit(0).alias("helpful"), F.lit(0).alias("unhelpful"), F.count(F.lit(1)).alias("evidence"))
    a = m.select("memory_id", F.element_at(F.split("memory_id", "-"), -1).alias("file_path"), F.lit(1).alias("lo"), F.lit(9).alias("hi"))
    t = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), (F.col("event_id") % 500).cast("string").alias("file_path"), F.lit(5).alias("lo"), F.lit(5).alias("hi")).distinct()
    return cat.deliver(m, a, t, spark.createDataFrame([], "session_id string, memory_id string"), 300, 4).select("session_id", "memory_id")


def area_table(spark, d) -> DataFrame:
    s, _, c = code_areas(spark, d)
    n = s.join(files(spark, d).select(F.col("doc_id").cast("string").alias("file_id"), "path"), "file_id").select(F.col("symbol_id").alias("id"), "name", "path")
    return cat.areas(c, n).select("community", "n", "top_dir", F.array_join("members", ",").alias("members"))


def calls_between(spark, d) -> DataFrame:
    """Calls between the areas of the code."""
    _, e, c = code_areas(spark, d)
    return cat.area_calls(e, c)


def guards(spark, d) -> DataFrame:
    e = parts_edges(spark, d).select(F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"))
    s = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol_id"), F.when(F.col("p_size") > 25, F.concat(F.lit("test_"), "p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("path"))
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("memory_id"), F.col("s_suppkey").cast("string").alias("symbol_id"))
    return cat.derived_edges(e, a, s).select("memory_id", "caller", "kind", "confidence")


def anchors(spark, d) -> DataFrame:
    """Anchors through a change of the code: symbols of the code files before and after half of the files were rewritten."""
    s = materialise(code.symbols(files(spark, d), "doc_id", "text").filter("kind <> 'module'").select("symbol_id", "symbol_path", F.col("file_id").alias("file_path"), "content_fp", "skeleton_fp"), "symbols").dropDuplicates(["file_path", "symbol_path"])
    a = s.select(F.col("symbol_id").alias("anchor_id"), "symbol_path", "file_path", "content_fp", "skeleton_fp", F.lit("ACTIVE").alias("status"), F.lit(1.0).alias("confidence"))
    h = F.pmod(F.crc32("symbol_id"), F.lit(4))
    after = s.filter(h != 0).withColumn("content_fp", F.when(h == 1, F.concat(F.lit("new"), "content_fp")).otherwise(F.col("content_fp"))).withColumn("skeleton_fp", F.when((h == 1) & (F.pmod(F.crc32("symbol_path"), F.lit(2)) == 0), F.concat(F.lit("new"), "skeleton_fp")).otherwise(F.col("skeleton_fp")))
    none = spark.createDataFrame([], "anchor_id string, symbol_id string, score double")
    return st.anchor_cascade(a, after, none).groupBy("status", "transition").agg(F.count(F.lit(1)).alias("n"))


def reconciled(spark, d) -> DataFrame:
    s = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol_id"), F.col("p_brand").alias("file_id"), F.md5(F.concat("p_name", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))).alias("content_fp"), F.col("p_partkey").cast("string").alias("symbol_path"), F.col("p_type").alias("skeleton_fp"), F.col("p_name").alias("name"))
    seen = s.filter("cast(symbol_id as int) % 3 <> 0").withColumn("content_fp", F.when(F.col("symbol_id").cast("int") % 3 == 1, F.concat(F.lit("x"), "content_fp")).otherwise(F.col("content_fp"))).drop("symbol_id")
    return st.reconcile(s, seen).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def content_hashes(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").groupBy(F.substr(F.sha2("text", 256), F.lit(1), F.lit(32)).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))


def sketches(spark, d) -> DataFrame:
    """Bottom-k sketches of the code's symbols: sizes, and how alike neighbours of one file are."""
    s = materialise(code.symbols(files(spark, d), "doc_id", "text"), "symbols").select("file_id", "line_start", "symbol_id", "token_signature")
    w = Window.partitionBy("file_id").orderBy("line_start", "symbol_id")
    p = s.withColumn("p", F.lag("token_signature").over(w))
    return p.select("symbol_id", F.size("token_signature").cast("long").alias("k"), F.round(code.similarity(F.col("token_signature"), F.coalesce("p", F.array().cast("array<bigint>"))), 4).alias("similarity"))


def import_pairs(spark, d) -> DataFrame:
    """Each document imports the module at the path of the next one, and one that is not there."""
    t = table(spark, d, "documents").filter("path is not null").select("doc_id", "path")
    module = F.replace(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit("/"), F.lit("."))
    nxt = t.select((F.col("doc_id") - 1).alias("doc_id"), module.alias("m"))
    specs = t.join(nxt, "doc_id").select(F.col("doc_id").cast("string").alias("file_id"), F.explode(F.array(F.struct(F.col("m").alias("module"), F.lit(False).alias("probe"), F.lit(False).alias("deferred")), F.struct(F.lit("lib.gone").alias("module"), F.lit(False).alias("probe"), F.lit(True).alias("deferred")), F.struct(F.lit("lib.maybe").alias("module"), F.lit(True).alias("probe"), F.lit(True).alias("deferred")))).alias("s")).select("file_id", "s.*")
    return code.resolve_imports(specs, t.select(F.col("doc_id").cast("string").alias("file_id"), "path"))


def entry_kinds(spark, d) -> DataFrame:
    """Parts as symbols, their sizes deciding how they are declared."""
    k = F.col("p_size") % 5
    deco = F.when(k == 0, F.array(F.lit('@app.get("/x")'))).when(k == 1, F.array(F.lit("@cache"), F.lit("@mcp.tool()"))).when(k == 2, F.array(F.lit("@Test"))).otherwise(F.array().cast("array<string>"))
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(k == 3, F.lit("test_it")).otherwise(F.lit("it")).alias("name"), F.lit("it").alias("symbol_path"), F.lit("src/a.py").alias("path"), deco.alias("decorators"))
    return g.entry_points(s)


def memory_states(spark, d) -> DataFrame:
    """Memories with their worst anchor, runs standing for anchors."""
    m = memories(spark, d).select("memory_id", "claim", "created_at")
    r = table(spark, d, "runs").filter("exp_id is not null").select(norm_key("exp_id").alias("memory_id"), F.when(F.col("status") == "done", "ACTIVE").when(F.col("status") == "failed", "ORPHANED").otherwise("DRIFTED").alias("status"), F.coalesce(F.col("exit_code"), F.lit(0)).cast("double").alias("confidence"))
    return kn.memory_list(m, r).select("memory_id", "anchor_status", "n_anchors")


def blocked_rules(spark, d) -> DataFrame:
    m = memories(spark, d)
    b = kn.blockers(F.col("kind"), F.col("status"), F.col("severity") != "low", F.col("severity") == "critical", F.when(F.col("severity") == "medium", 0.3).otherwise(0.8))
    return m.select("memory_id", F.array_join(b, ",").alias("blockers"))


def agreements(spark, d) -> DataFrame:
    m = memories(spark, d).select("severity", "memory_id", kn.claim_tokens(F.col("claim")).alias("t"))
    return kn.agreement(m, "severity", "memory_id", "t").select("severity", "n", F.size("shared").cast("long").alias("n_shared"), F.round("score", 6).alias("score"))


def clusters(spark, d) -> DataFrame:
    return kn.converge(memories(spark, d)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def narrowed(spark, d) -> DataFrame:
    m = memories(spark, d).select("memory_id", "claim")
    a = m.select("memory_id", F.explode(F.array(*[F.lit(f"src/{x}.py") for x in ("hook", "lease", "session", "resolver", "import")])).alias("file_path"))
    return kn.narrowed(m, a)


def briefed(spark, d) -> DataFrame:
    m = memories(spark, d)
    r = table(spark, d, "runs").filter("exp_id is not null").select(norm_key("exp_id").alias("memory_id"), F.when(F.col("status") == "done", "ACTIVE").otherwise("ORPHANED").alias("status"))
    b = kn.briefing(m, r, table(spark, d, "tombstones").select(F.col("record_kind").alias("kind")))
    return b.select("n_memories", "n_stale")


def duplicate_skeletons(spark, d) -> DataFrame:
    s = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("skeleton_fp"))
    a = table(spark, d, "lineitem").filter("l_quantity > 49 and l_discount > 0.09").select(F.col("l_partkey").alias("symbol_id"))
    return kn.diverging_twins(s, a)


def untested(spark, d) -> DataFrame:
    s = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.when(F.col("p_size") == 1, F.lit("test_x")).otherwise(F.lit("f")).alias("name"), F.lit("a.py").alias("path"))
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("memory_id"), F.col("s_suppkey").alias("symbol_id"))
    m = a.select("memory_id", F.lit("invariant").alias("kind"))
    return kn.untested(materialise(parts_edges(spark, d), "edges"), s, a, m, 1)


def refreshed_vectors(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    items = docs.select(F.lit("doc").alias("scope"), F.col("doc_id").cast("string").alias("item_id"), "text")
    none = spark.createDataFrame([], "scope string, item_id string, content_hash string, encoder_id string, vector array<double>")
    first = materialise(vx.refresh(items.filter("cast(item_id as int) % 2 = 0"), none, "letters"), "vectors")
    return vx.stale(items, first, "letters").select("item_id")


def archived(spark, d) -> DataFrame:
    """Two rounds of archiving documents: the second sees longer, changed and vanished texts."""
    t = table(spark, d, "documents").filter("text is not null").select(archive.archive_key(F.coalesce("source", F.lit("")), F.lit("docs"), F.col("doc_id").cast("string")).alias("key"), "doc_id", "text")
    none = spark.createDataFrame([], "key string, generation int, bytes long, prefix_hash string, content binary")
    one = materialise(archive.next_archive(archive.sync(none, t.select("key", F.col("text").cast("binary").alias("content")))), "archive")
    k = F.col("doc_id") % 4
    two = t.filter(k != 0).select("key", F.when(k == 1, F.col("text")).when(k == 2, F.concat("text", F.lit("more"))).otherwise(F.concat(F.lit("new"), "text")).cast("binary").alias("content"))
    return archive.sync(one, two).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def merged_graphs(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("label"), F.lit(None).cast("string").alias("body"), F.lit("ACTIVE").alias("status"))
    e = nation_edges(spark, d).select(F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"), F.lit("K").alias("kind"), "confidence")
    a, b = ex.build([n.filter("cast(id as int) < 15")], e), ex.build([n.filter("cast(id as int) > 10")], e)
    return ex.stats(*ex.merge(a, b))


def pdf_links(spark, d) -> DataFrame:
    p = table(spark, d, "documents").filter("path is not null").select("doc_id", F.concat(F.lit('<html><a href="/x/'), "path", F.lit('.pdf">t</a></html>')).alias("h"))
    return p.select("doc_id", papers.pdf_link(F.col("h")).alias("link"))


def query_metrics(spark, d) -> DataFrame:
    """Share of a word's documents among the first ten of its ranking, per source."""
    h = doc_index(spark, d).hits(tx.parse("budget", "any")).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score")).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    top = tx.per_group(h, ["source"], [F.desc("score"), F.col("doc_id")], 10)
    return top.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


def evening_windows(spark, d) -> DataFrame:
    """Sessions of events with gaps under a day: a Spark extra, not a reference capability."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy(F.session_window("ts", "24 hours"), "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))


def superseded(spark, d) -> DataFrame:
    """Orders as memories; those of high priority are superseded."""
    m = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("memory_id"), F.col("o_orderpriority").alias("body"), F.lit("ACTIVE").alias("status"), F.lit(1).alias("version"), F.col("o_orderdate").alias("updated_at"))
    c = m.filter("body = '1-URGENT'").select("memory_id", F.concat(F.lit("n"), "memory_id").alias("new_id"), F.lit("new").alias("body"), F.lit("2030-01-01").cast("timestamp_ntz").alias("at"))
    return st.supersede(m, c)[0].groupBy("status", "version").agg(F.count(F.lit(1)).alias("n"))


def coverage(spark, d) -> DataFrame:
    """Lines of an order as memories of one event: returned ones as rules, others as evidence."""
    m = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("memory_id"), F.when(F.col("l_returnflag") == "R", "invariant").when(F.col("l_returnflag") == "A", "test_evidence").otherwise("note").alias("kind"), F.col("l_orderkey").alias("event_id")).distinct()
    return kn.coverage_edges(m).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("from_id").alias("n_rules"))


def reviewed(spark, d) -> DataFrame:
    """Problems of the runs' anchors: stale ones and callers newer than the last verification."""
    m = memories(spark, d).select("memory_id", "severity")
    r = table(spark, d, "runs").filter("exp_id is not null and run_id is not null").select(norm_key("exp_id").alias("memory_id"), norm_key("run_id").alias("symbol_id"), F.when(F.col("status") == "failed", "ORPHANED").otherwise("ACTIVE").alias("status"), F.col("ended_at").alias("last_verified_at")).distinct()
    e = table(spark, d, "evidence").filter("run_id is not null").select(F.col("memory_id").alias("from_id"), norm_key("run_id").alias("to_id"), "created_at").distinct()
    return kn.problems(m, r, e, r).select("problem", "subject", "detail")


def candidate_places(spark, d) -> DataFrame:
    s = materialise(code.symbols(files(spark, d), "doc_id", "text"), "symbols").select("symbol_id", "name", F.col("file_id").alias("file_path"), "skeleton_fp", "token_signature")
    a = s.select(F.col("symbol_id").alias("anchor_id"), "name", F.concat(F.lit("x"), "file_path").alias("file_path"), "skeleton_fp", "token_signature")
    return st.anchor_candidates(a, s).groupBy(F.round("score", 2).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def touched_files(spark, d) -> DataFrame:
    m = table(spark, d, "messages").filter("kind = 'tool_call' and text is not null").groupBy("id").agg(F.min("text").alias("text"))
    cmd = F.concat(F.lit("cat "), F.coalesce(F.get_json_object(F.expr("substring(text, instr(text, chr(10)) + 1)"), "$.path"), F.lit("-")), F.lit(" && grep x y.py"))
    return m.select("id", F.explode(kn.shell_files(cmd)).alias("path"))


QUERIES = {
    "M11_superseded": superseded, "G16_coverage": coverage, "M21_problems": reviewed, "J22_M8_candidates": candidate_places, "P26_touched_files": touched_files,
    "S5_A10_commit_log": commit_log, "S7_recency": recency, "S6_renames": rename_paths, "J27_coupled_pairs": coupled_without_import, "M14_repository_states": repository_states, "J16_cross_repository": cross_repository, "J17_pending_healed": pending_healed, "M14_identified": identified, "P18_P19_names": names_resolved,
    "J28_U4_M25_delivered": delivered, "A25_areas": area_table, "A27_area_calls": calls_between, "G15_guards": guards, "M4_M5_anchors": anchors, "M2_J21_reconciled": reconciled, "D1_content_hashes": content_hashes, "D4_D5_sketches": sketches, "J19_D14_imports": import_pairs, "G14_G4_entry_kinds": entry_kinds,
    "A5_O6_memory_states": memory_states, "P21_blockers": blocked_rules, "A12_agreement": agreements, "J25_clusters": clusters, "P15_P16_narrowed": narrowed, "A24_briefing": briefed, "M20_J8_twins": duplicate_skeletons, "G7_M20_untested": untested, "V2_stale_vectors": refreshed_vectors, "S25_S26_archive": archived, "U2_S46_merged": merged_graphs, "S38_pdf_links": pdf_links, "W3_F5_per_source": query_metrics, "T_session_windows": evening_windows,
}
_NE = "nr as (select s_nationkey as from_id, c_nationkey as to_id, round(sum(l_extendedprice), 0) as v from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2), ne as (select from_id, to_id from (select *, row_number() over (partition by from_id order by v desc, to_id) as rn from nr) where rn <= 2)"
_HYP = f"hy as (select * from (select {K.format('exp_id')} as memory_id, max(hypothesis) as claim, min(created_at) as created_at from experiments group by 1) where claim <> '')"
SQL = {
    "M11_superseded": "select case when o_orderpriority = '1-URGENT' then 'SUPERSEDED' else 'ACTIVE' end as status, 1 as version, count(*) as n from orders group by 1 union all select 'ACTIVE', 2, count(*) from orders where o_orderpriority = '1-URGENT'",
    "G16_coverage": "with m as (select distinct l_orderkey || '-' || l_partkey as id, l_returnflag as f, l_orderkey as e from lineitem) select 'GUARDED_BY' as kind, count(*) as n, count(distinct a.id) as n_rules from m a join m b on a.e = b.e where a.f = 'R' and b.f = 'A'",
    "P26_touched_files": "select id, json_extract_string(substr(t, strpos(t, chr(10)) + 1), '$.path') as path from (select id, min(text) as t from messages where kind = 'tool_call' and text is not null group by 1) where json_valid(substr(t, strpos(t, chr(10)) + 1)) and json_extract_string(substr(t, strpos(t, chr(10)) + 1), '$.path') is not null",
    "S5_A10_commit_log": "select 'src/p' || l_partkey || '.py' as path, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as added, max(l_orderkey) * 1000 as last from lineitem group by 1",
    "S7_recency": "select 'src/p' || l_partkey || '.py' as path, max(l_orderkey) * 1000 as last from lineitem group by 1",
    "S6_renames": "select doc_id, 'old/' || split_part(path, '/', 1) || '/' || split_part(path, '/', -1) as path from documents where path is not null",
    "J27_coupled_pairs": f"with {_EDGES}, c as (select distinct l_orderkey as sha, l_partkey as path from lineitem), ok as (select sha from c group by 1 having count(*) <= 8), f as (select c.* from c join ok using (sha)), s as (select x.path as a, y.path as b, count(*) as shared from f x join f y on x.sha = y.sha and x.path < y.path group by 1, 2 having count(*) >= 3) select a, b, shared, exists (select 1 from e where least(from_id, to_id) = a and greatest(from_id, to_id) = b) as explained from s",
    "M14_repository_states": f"with p as (select distinct {K.format('repo_id')} as k from checkouts where status = 'ACTIVE' and repo_id is not null) select repo_id, status as was, case when status = 'ACTIVE' and k is null then 'MISSING' when status in ('MISSING', 'OFFLINE') and k is not null then 'ACTIVE' else status end as status from repositories left join p on k = repo_id",
    "J16_cross_repository": f"with e as (select checkout_id, max({K.format('repo_id')}) as to_repo from checkouts group by 1) select checkout_id, to_repo, case when r.status is null then 'unknown' when r.status = 'ACTIVE' then 'reachable' else 'unreachable' end as reach from e left join repositories r on r.repo_id = to_repo where to_repo is not null",
    "J17_pending_healed": f"with e as (select checkout_id as edge_id, max({K.format('repo_id')}) as to_ref from checkouts group by 1) select edge_id, to_ref, case when r.repo_id is not null then 'ACTIVE' else 'PENDING' end as status, r.repo_id as to_repo from e left join repositories r on r.repo_id = to_ref where to_ref is not null",
    "M14_identified": "select o_orderpriority as probe_id, max_by(cast(c_nationkey as varchar), (round(c_acctbal, 2), cast(c_nationkey as varchar))) as repo_id from orders join customer on o_custkey = c_custkey group by 1",
    "P18_P19_names": "with s as (select p_partkey as id, p_name as name, p_brand || '.' || p_name as path from part), r as (select upper(p_name) as ref from part union select p_brand || '.' || p_name from part), w as (select ref, 0 as way, id from r join s on path = ref union all select ref, 1, id from r join s on name = ref union all select ref, 2, id from r join s on regexp_replace(path, '^.*[.]([^.]+[.][^.]+)$', '\\1') = ref union all select ref, 3, id from r join s on lower(name) = lower(ref) union all select ref, 4, id from r join s on regexp_replace(lower(name), '[-_. ]', '', 'g') = regexp_replace(lower(ref), '[-_. ]', '', 'g')), g as (select ref, way, count(distinct id) as n, min(id) as id from w group by 1, 2), b as (select *, row_number() over (partition by ref order by way) as rn from g) select ref, case when n = 1 then id end as symbol_id, n from b where rn = 1",
    "J28_U4_M25_delivered": "with m as (select l_orderkey || '-' || l_partkey as memory_id, cast(l_partkey as varchar) as f, max(case when l_quantity > 40 then 'high' else 'low' end) as severity, count(*) as ev from lineitem where l_returnflag = 'R' group by 1, 2), t as (select distinct cast(user_id as varchar) as session_id, cast(event_id % 500 as varchar) as f from events), c as (select distinct session_id, memory_id, severity, ev from t join m using (f)), r as (select *, row_number() over (partition by session_id order by case severity when 'high' then 1 else 3 end, ev desc, memory_id) as rn from c) select session_id, memory_id from r where rn <= 3",
    "G15_guards": f"with {_EDGES}, j as (select to_id as memory_id, cast(from_id as varchar) as caller, row_number() over (partition by to_id order by cast(from_id as varchar)) as rn from e where to_id in (select s_suppkey from supplier)) select memory_id, caller, case when p_size > 25 then 'GUARDED_BY' else 'IMPACTS' end as kind, case when p_size > 25 then 0.75 else 0.6 end::double as confidence from j join part on p_partkey = cast(caller as bigint) where rn <= 12",
    "D1_content_hashes": "select left(sha256(text), 32) as content_hash, count(*) as n, min(doc_id) as doc_id from documents where text is not null group by 1",
    "A5_O6_memory_states": f"with {_HYP}, a as (select {K.format('exp_id')} as memory_id, max(case when status = 'done' then 0 when status = 'failed' then 3 else 1 end) as r, count(*) as n_anchors from runs where exp_id is not null group by 1) select hy.memory_id, case r when 0 then 'ACTIVE' when 1 then 'DRIFTED' when 3 then 'ORPHANED' end as anchor_status, n_anchors from hy left join a using (memory_id)",
    "A24_briefing": f"with {_HYP}, s as (select count(distinct {K.format('exp_id')}) as n from runs where exp_id is not null and coalesce(status, '') <> 'done') select cast(count(*) as bigint) as n_memories, any_value(s.n) as n_stale from hy, s",
    "M20_J8_twins": "with r as (select distinct l_partkey as id from lineitem where l_quantity > 49 and l_discount > 0.09), s as (select p_partkey as symbol_id, p_brand || '|' || p_type || '|' || p_size as skeleton_fp, r.id is not null as ruled from part left join r on r.id = p_partkey), c as (select skeleton_fp, cast(sum(case when ruled then 1 else 0 end) as bigint) as n_ruled, count(*) as n from s group by 1) select symbol_id, skeleton_fp, n_ruled from s join c using (skeleton_fp) where not ruled and n_ruled > 0",
    "G7_M20_untested": f"with {_EDGES}, t as (select p_partkey as id from part where p_size = 1), reached as (select id from t union select to_id from e where from_id in (select id from t)) select s_suppkey as symbol_id from supplier where s_suppkey not in (select id from reached)",
    "V2_stale_vectors": "select cast(doc_id as varchar) as item_id from documents where text is not null and doc_id % 2 <> 0",
    "S25_S26_archive": "select case doc_id % 4 when 0 then 'missing' when 1 then 'kept' when 2 then 'appended' else case when text = '' then 'appended' else 'rotated' end end as action, count(*) as n from documents where text is not null group by 1",
    "U2_S46_merged": f"with {_NE} select 'node' as what, 'nation' as kind, count(*) as n from nation union all select 'edge', 'K', count(*) from ne where (from_id < 15 and to_id < 15) or (from_id > 10 and to_id > 10)",
    "S38_pdf_links": "select doc_id, '/x/' || path || '.pdf' as link from documents where path is not null",
    "J19_D14_imports": "with t as (select doc_id, path, regexp_replace(path, '[.][^./]+$', '') as p from documents where path is not null), n as (select a.doc_id as from_id, b.p as want from t a join t b on b.doc_id = a.doc_id + 1), one as (select n.from_id, n.want, min_by(f.doc_id, f.path) as to_id from n join t f on f.p = n.want or ends_with(f.p, '/' || n.want) group by 1, 2) select cast(from_id as varchar) as from_id, cast(to_id as varchar) as to_id, false as deferred from one where from_id <> to_id union all select cast(from_id as varchar), 'extern:lib.gone', true from n",
    "G14_G4_entry_kinds": "select p_partkey as id, case p_size % 5 when 0 then 'route' when 1 then 'tool' else 'test' end as kind, case p_size % 5 when 0 then 'GET /x' when 3 then 'test_it' else 'it' end as detail from part where p_size % 5 <> 4",
    "P21_blockers": f"with {_HYP}, m as (select memory_id, ['critical', 'high', 'medium', 'low'][1 + length(claim) % 4] as s from hy) select memory_id, concat_ws(',', case when s = 'low' then 'anchors' end, case when s = 'critical' then 'inferred' end, case when s = 'medium' then 'confidence' end) as blockers from m",
    "A12_agreement": f"with {_HYP}, m as (select memory_id, ['critical', 'high', 'medium', 'low'][1 + length(claim) % 4] as severity, list_filter(list_distinct(regexp_extract_all(lower(claim), '[a-z0-9_]{{3,}}')), lambda x: not list_contains(string_split('{' '.join(kn.CLAIM_STOP)}', ' '), x)) as t from hy), n as (select severity, count(*) as n from m group by 1), c as (select severity, term, count(distinct memory_id) as k from (select severity, memory_id, unnest(t) as term from m) group by 1, 2) select severity, n.n, cast(count(*) filter (k >= greatest(2, n.n // 2 + 1)) as bigint) as n_shared, round(count(*) filter (k >= greatest(2, n.n // 2 + 1)) / count(*), 6) as score from c join n using (severity) group by 1, 2",
    "W3_F5_per_source": f"with {bm25_sql('documents', 'text', [' budget '], 'doc_id, source, text')}, r as (select source, round(score, 6) as score, row_number() over (partition by source order by round(score, 6) desc, doc_id) as rn from scored) select source, count(*) as n, max(score) as best from r where rn <= 10 group by 1",
    "T_session_windows": "with x as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 24 hours or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events), y as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from x), z as (select user_id, s, count(*) as n from y group by 1, 2) select user_id, count(*) as n_sessions, max(n) as longest from z group by 1",
}
