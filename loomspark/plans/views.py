"""Queries of what readers see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..operators import view as v
from ..session import table
from .graphs import _EDGES, parts_edges
from .more import commits
from .records import _M, _S, _memories, _sessions

K = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"


def display(spark, d) -> DataFrame:
    """Lines as edges of suppliers' rules on parts: returned ones apply, others are derived from a part; rules are about parts of their own brand number."""
    e = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("memory_id"), F.col("l_partkey").alias("symbol_id"), F.when(F.col("l_returnflag") == "R", "APPLIES_TO").otherwise("CALLER").alias("kind"), F.col("p_brand").alias("file_path"), F.col("p_type").alias("symbol_path"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit('{"target": "'), "p_brand", F.lit('"}'))).alias("evidence"))
    f = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("memory_id"), F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 5 + 1), (F.col("s_suppkey") % 5 + 1)).alias("path"))
    return v.displayed(e, f).groupBy("memory_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def reading_lists(spark, d) -> DataFrame:
    """The first ten experiments in each of a reader's orders."""
    m = _memories(spark, d).select("memory_id", "title", F.col("claim").alias("body"), F.col("created_at").alias("updated_at"), F.get(F.array(*[F.lit(x) for x in v.SEVERITIES]), (F.length("claim") % 5).cast("int")).alias("severity"), F.get(F.array(*[F.lit(x) for x in v.KINDS]), (F.length("claim") % 13).cast("int")).alias("kind"))
    out = None
    for how in ("severity", "kind", "recent", "oldest", "longest"):
        one = v.by_rank(m.orderBy(*v.reader_order(how)).limit(10), how).select(F.lit(how).alias("how"), "place", "memory_id")
        out = one if out is None else out.unionByName(one)
    return out


def visible_parts(spark, d) -> DataFrame:
    n = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.lit("ACTIVE").alias("status"), F.col("p_name").alias("label"), F.col("p_type").alias("body"))
    scope = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    nodes, edges = v.visible(n, parts_edges(spark, d), None, ["ACTIVE"], scope, "steel")
    tally = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return tally(nodes, "nodes").unionByName(tally(edges, "edges"))


def body_sections(spark, d) -> DataFrame:
    m = _memories(spark, d).select("memory_id", F.concat_ws("", F.col("claim"), F.lit("\n\nWhy: "), F.coalesce("title", F.lit("")), F.lit("\n\nApplies to: "), "memory_id").alias("b"))
    return m.select("memory_id", F.posexplode(v.sections(F.col("b"))).alias("at", "s")).select("memory_id", F.col("at").cast("long").alias("at"), "s.label", "s.text")


def titled(spark, d) -> DataFrame:
    s = _sessions(spark, d).filter("native_id is not null")
    log = table(spark, d, "messages").filter("native_id is not null and text is not null").select(F.col("id").alias("at"), F.to_json(F.struct(F.col("native_id").alias("id"), F.concat(F.lit("** "), F.substring("text", 1, 20), F.lit(" *")).alias("thread_name"))).alias("line"))
    own = log.unionByName(s.select(F.lit(-1).cast("long").alias("at"), F.to_json(F.struct(F.col("native_id").alias("id"), F.concat(F.lit("* t "), "session_key", F.lit(" *")).alias("thread_name"))).alias("line")))
    return v.with_titles(s.select("session_key", "native_id", F.lit(None).cast("string").alias("title")), own.filter("at = -1")).select("session_key", "title")


def history_coverage(spark, d) -> DataFrame:
    c = commits(spark, d).select("sha", "path")
    return v.coverage(c, table(spark, d, "part").filter("p_size <= 25").select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".py")).alias("path")), 4)


def renamed(spark, d) -> DataFrame:
    """Checkouts of one repository as renames from path to path."""
    c = table(spark, d, "checkouts").filter("path is not null and repo_id is not null").select(norm_key("repo_id").alias("r"), "path").distinct()
    ends = c.groupBy("r").agg(F.min("path").alias("from_path"), F.max("path").alias("to_path"))
    pairs = c.join(ends, "r").select(F.col("from_path").alias("old_path"), F.col("path").alias("new_path"))
    return v.rename_evidence(pairs, ends.select("from_path", "to_path")).groupBy("moved").agg(F.count(F.lit(1)).alias("n"))


def sentences(spark, d) -> DataFrame:
    return _memories(spark, d).select("memory_id", v.first_sentence(F.col("claim")).alias("sentence"), F.size(v.as_list(F.to_json(F.array("title", F.lit(" "))))).cast("long").alias("n_listed"))


def middles(spark, d) -> DataFrame:
    return v.picked(table(spark, d, "orders"), "o_totalprice", 0.75).select(F.round("value", 2).alias("value"))


def workspace_status(spark, d) -> DataFrame:
    return v.status({n: table(spark, d, n) for n in ("documents", "experiments", "sessions")})


QUERIES = {"P17_displayed": display, "O9_reader_orders": reading_lists, "U8_visible": visible_parts, "X32_sections": body_sections, "X13_titles": titled, "X18_coverage": history_coverage, "S9_rename_evidence": renamed, "X31_first_sentences": sentences, "X32_percentile": middles, "M24_status": workspace_status}

_R = "(select *, case length(claim) % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 else 5 end as sv, length(claim) % 13 as kd from mm)"
SQL = {
    "P17_displayed": "with e as (select l_suppkey as memory_id, case when l_returnflag = 'R' then 'APPLIES_TO' else 'CALLER' end as kind, p_brand, case when l_linestatus = 'O' then p_brand end as target from lineitem join part on l_partkey = p_partkey), f as (select s_suppkey as memory_id, 'Brand#' || (s_nationkey % 5 + 1) || (s_suppkey % 5 + 1) as path from supplier where s_suppkey % 2 = 0) select e.memory_id, kind, count(*) as n from e left join f using (memory_id) where path is null or case when kind = 'APPLIES_TO' then p_brand = path else target is null or target = path end group by 1, 2",
    "O9_reader_orders": f"with {_M} " + " union all ".join(f"select '{how}' as how, place, memory_id from (select memory_id, cast(row_number() over (order by {o}, title nulls first, memory_id) as integer) as place from {_R}) where place <= 10" for how, o in (("severity", "sv"), ("kind", "kd"), ("recent", "created_at desc nulls last"), ("oldest", "created_at asc nulls last"), ("longest", "length(claim) desc"))),
    "U8_visible": f"with {_EDGES}, n as (select p_partkey as id from part where (contains(lower(p_name), 'steel') or contains(lower(p_type), 'steel')) and p_partkey in (select l_partkey from lineitem where l_returnflag = 'R')) select 'nodes' as what, count(*) as n from n union all select 'edges', count(*) from e where from_id in (select id from n) and to_id in (select id from n)",
    "X13_titles": f"with {_S} select s.session_key, 't ' || m.k as title from s join (select native_id, max(session_key) as k from s group by 1) m using (native_id)",
    "X18_coverage": "with c as (select l_orderkey as sha, l_partkey as p from lineitem group by 1, 2), k as (select sha, count(*) as k from c group by 1) select 'lower-bound' as epistemic, count(*) as commits_read, count(*) filter (k <= 4) as commits_considered, count(*) filter (k > 4) as bulk_commits_excluded, (select count(distinct p) from c where p in (select p_partkey from part where p_size <= 25)) as indexed_paths from k",
    "S9_rename_evidence": f"with c as (select distinct {K.format('repo_id')} as r, path from checkouts where path is not null and repo_id is not null), e as (select r, min(path) as a, max(path) as b from c group by 1), t as (select a, b from e union select x.a, y.b from e x join e y on x.b = y.a), p as (select e.a, c.path from c join e using (r)) select exists (select 1 from t where t.a = p.a and t.b = p.path) and p.a <> p.path as moved, count(*) as n from p group by 1",
    "X32_percentile": "select round(percentile_disc(0.75) within group (order by o_totalprice), 2) as value from orders",
    "M24_status": "select 'documents' as part, count(*) as n from documents union all select 'experiments', count(*) from experiments union all select 'sessions', count(*) from sessions",
    "X31_first_sentences": f"with {_M} select memory_id, coalesce(nullif(regexp_extract(claim, '^(.+?[.!?])(\\s|$)', 1), ''), trim(claim)) as sentence, cast(case when trim(coalesce(title, '')) <> '' then 1 else 0 end as bigint) as n_listed from mm",
    "X32_sections": f"with {_M}, x as (select memory_id, claim, coalesce(title, '') as title from mm), a as (select memory_id, 0 as o, '' as label, trim(claim) as text from x union all select memory_id, 1, 'Why', trim(title) from x where trim(title) <> '' union all select memory_id, 2, 'Applies to', memory_id from x) select memory_id, row_number() over (partition by memory_id order by o) - 1 as at, label, text from a where text <> ''".replace(" as at,", ' as "at",'),
}
