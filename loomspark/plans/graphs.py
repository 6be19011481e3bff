"""Queries of the graph, history and code operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import code
from ..operators import graph as g
from ..operators import hierarchy
from ..session import materialise, stored, table

K = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"
# What the resolution of calls reads of symbols.
CALLING = ["file_id", "symbol_id", "name", "symbol_path", "kind", "calls", "types"]


def parts_edges(spark, d) -> DataFrame:
    """Parts of neighbouring lines of an order: the driver's stand-in for a call graph."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")  # noqa: E741
    nxt = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_id"))
    e = l.join(nxt, ["l_orderkey", "l_linenumber"]).filter("l_partkey <> to_id").groupBy(F.col("l_partkey").alias("from_id"), "to_id").agg(F.max(F.round(1 - F.col("l_discount"), 2)).alias("confidence"))
    return e.withColumn("edge_id", F.col("from_id") * 10_000_000 + F.col("to_id"))


_EDGES = "e as (select a.l_partkey as from_id, b.l_partkey as to_id, max(round(1 - a.l_discount, 2)) as confidence from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey group by 1, 2)"


def _layers(n: int, seed: str, edges: str = "e") -> str:
    """SQL of n rounds of breadth-first search: relations h0..hn."""
    out = [f"h0 as (select {seed} as id)"]
    for i in range(1, n + 1):
        before = " union ".join(f"select id from h{k}" for k in range(i))
        out.append(f"h{i} as (select distinct to_id as id from {edges} where from_id in (select id from h{i - 1}) and to_id not in ({before}))")
    return ", ".join(out)


def _seed(spark, v) -> DataFrame:
    return spark.createDataFrame([(v,)], "id long")


def impact(spark, d) -> DataFrame:
    return g.bfs(g.reverse(materialise(parts_edges(spark, d), "edges")), _seed(spark, 1), 3).select("id", F.col("hops").cast("long").alias("hops"))


def impact_kinds(spark, d) -> DataFrame:
    r = g.bfs(materialise(parts_edges(spark, d), "edges"), _seed(spark, 1), 2)
    return r.groupBy("hops").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("confidence"), 2).alias("weakest"))


def trace(spark, d) -> DataFrame:
    e = materialise(parts_edges(spark, d), "edges")
    return g.trace(e, 1, 50, 6).agg(F.max("hop").cast("long").alias("hops"))


def triggers(spark, d) -> DataFrame:
    e = materialise(parts_edges(spark, d), "edges")
    entries = table(spark, d, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"))
    return g.triggers(e, _seed(spark, 7), entries, 2, 3).select("id", "kind", F.col("hops").cast("long").alias("hops"))


def expand(spark, d) -> DataFrame:
    e = materialise(parts_edges(spark, d).withColumn("edge_class", F.when(F.col("confidence") >= 0.97, "deterministic").when(F.col("confidence") >= 0.94, "asserted").otherwise("inferred")), "edges")
    seeds = spark.createDataFrame([(3, 1.0), (9, 0.6)], "id long, score double")
    return g.spread(e, seeds, 2).select("id", F.round("score", 6).alias("score"))


def nation_edges(spark, d) -> DataFrame:
    """Nations and the two nations that buy most from their suppliers."""
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier")}
    from pyspark.sql import Window

    r = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("from_id"), F.col("c_nationkey").alias("to_id")).agg(F.round(F.sum("l_extendedprice"), 0).alias("v"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("rn", F.row_number().over(Window.partitionBy("from_id").orderBy(F.desc("v"), "to_id"))).filter("rn <= 2").select("from_id", "to_id", F.col("n").cast("double").alias("confidence"))


_NATIONS = "r as (select s_nationkey as from_id, c_nationkey as to_id, round(sum(l_extendedprice), 0) as v from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2), e as (select from_id, to_id from (select *, row_number() over (partition by from_id order by v desc, to_id) as rn from r) where rn <= 2)"


def cycles(spark, d) -> DataFrame:
    return g.cycles(materialise(parts_edges(spark, d), "edges")).select(F.col("id").cast("long").alias("id"), F.col("component").cast("long").alias("component"), "n_nodes")


def code_calls(spark, d) -> tuple[DataFrame, DataFrame]:
    """The symbols of the code files, and the calls resolved between them."""
    s = _symbols(spark, d, *CALLING)
    return s, materialise(code.resolve_calls(s, spark.createDataFrame([], "from_id string, to_id string, deferred boolean"))[0], "edges")


def areas(spark, d) -> DataFrame:
    return code_areas(spark, d)[2].select("id", "community")


def code_areas(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, calls, communities) of the code's call graph, made once a session."""

    def build():
        s, e = code_calls(spark, d)
        return s, e, materialise(g.louvain(e, min_size=2), "areas")

    return stored(spark, d, "areas", build)


def experiment_shape(spark, d) -> DataFrame:
    """Children per experiment, with the shapes that deserve a warning: many children, or a long chain of only children."""
    t = hierarchy.read_links(table(spark, d, "experiments"), "exp_id", "parent_id")
    k = t.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    return k.select(F.col("id").alias("exp_id"), "n_children", F.when(F.col("n_children") >= 5, "fan").when(F.col("n_children") >= 4, "wide").otherwise("").alias("shape"))


def lineage(spark, d) -> DataFrame:
    t = hierarchy.hierarchy(table(spark, d, "experiments"), "exp_id", "parent_id").filter("not in_cycle")
    return t.select(F.col("id").alias("exp_id"), F.posexplode(F.split("path", "/")).alias("step", "ancestor")).select("exp_id", F.col("step").cast("long").alias("step"), "ancestor")


def causal(spark, d) -> DataFrame:
    e = materialise(parts_edges(spark, d), "edges")
    seed = _seed(spark, 5)
    up = g.bfs(g.reverse(e), seed, 2).filter("hops > 0").select("id", (-F.col("hops")).cast("long").alias("at"))
    down = g.bfs(e, seed, 2).filter("hops > 0").select("id", F.col("hops").cast("long").alias("at"))
    return up.unionByName(down)


def focus(spark, d) -> DataFrame:
    return g.focus(materialise(parts_edges(spark, d), "edges"), _seed(spark, 11), 1, 70).select("id", F.col("hops").cast("long").alias("hops"))


def coupling(spark, d) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"))
    return g.coupling(c, 2, 8)


def hotspots(spark, d) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    w = l.groupBy(F.col("l_partkey").alias("path")).agg(F.count_distinct("l_suppkey").alias("weight"))
    return g.hotspots(l.select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"), F.col("l_quantity").alias("churn")), w, 8)


def files(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("source = 'code_file' and text is not null").select(F.col("doc_id"), F.coalesce("path", F.lit("")).alias("path"), "text")


def _symbols(spark, d, *columns: str) -> DataFrame:
    return materialise(code.symbols(files(spark, d), "doc_id", "text").select(*(columns or ["*"])), "symbols")


def symbol_table(spark, d) -> DataFrame:
    return _symbols(spark, d).select("file_id", "symbol_id", "name", "kind", "line_start", "line_end", "content_fp", "skeleton_fp", "n_tokens", "extracted_by")


def language_counts(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy(code.language_column(F.col("path")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def call_graph(spark, d) -> DataFrame:
    s = _symbols(spark, d, *CALLING)
    none = spark.createDataFrame([], "from_id string, to_id string, deferred boolean")
    return code.resolve_calls(s, none)[0].select("from_id", "to_id", "tier", "confidence")


def call_outcomes(spark, d) -> DataFrame:
    s = _symbols(spark, d, *CALLING)
    edges, missed = code.resolve_calls(s, spark.createDataFrame([], "from_id string, to_id string, deferred boolean"))
    return edges.groupBy(F.col("tier").alias("outcome")).agg(F.count(F.lit(1)).alias("n")).unionByName(missed.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))


def dead_code(spark, d) -> DataFrame:
    s = _symbols(spark, d, *CALLING, "decorators")
    edges, missed = code.resolve_calls(s, spark.createDataFrame([], "from_id string, to_id string, deferred boolean"))
    nodes = s.join(files(spark, d).select(F.col("doc_id").cast("string").alias("file_id"), "path"), "file_id").select(F.col("symbol_id").alias("id"), "name", "path", "kind", "symbol_path")
    entries = g.entry_points(s.join(files(spark, d).select(F.col("doc_id").cast("string").alias("file_id"), "path"), "file_id").select(F.col("symbol_id").alias("id"), "name", "symbol_path", "path", "decorators"))
    return g.unreached(nodes, edges, entries, missed, spark.createDataFrame([], "name string")).select("id", "confidence", F.array_join("weakened_by", "; ").alias("weakened_by"))


def clone_classes(spark, d) -> DataFrame:
    return code.clones(_symbols(spark, d), "alpha_fp", 8)


def quiet_customers(spark, d) -> DataFrame:
    """Dead-code shape on the driver's tables: parts without a returned line of 1998."""
    r = table(spark, d, "lineitem").filter("l_returnflag = 'R' and year(l_shipdate) = 1998").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(r, "p_partkey", "left_anti").select("p_partkey", F.when(F.col("p_size") > 25, "lower").otherwise("higher").alias("confidence"))


QUERIES = {
    "G1_impact": impact, "G1_A21_hops": impact_kinds, "G2_trace": trace, "G5_G7_triggers": triggers, "G6_expand": expand, "G3_cycles": cycles, "G11_G12_areas": areas, "G18_experiment_shape": experiment_shape, "G19_lineage": lineage, "G8_G9_causal": causal, "G20_focus": focus,
    "A9_J9_coupling": coupling, "A10_A8_hotspots": hotspots, "S4_languages": language_counts, "S3_D2_D13_symbols": symbol_table, "J18_call_graph": call_graph, "J18_A22_outcomes": call_outcomes, "G13_G14_dead_code": dead_code, "D3_D6_clones": clone_classes, "G13_conditional_anti": quiet_customers,
}
_H = lambda n: " union all ".join(f"select id, cast({i} as bigint) as hops from h{i}" for i in range(n + 1))
SQL = {
    "G1_impact": f"with {_EDGES}, rv as (select to_id as from_id, from_id as to_id from e), {_layers(3, '1', 'rv')} {_H(3)}",
    "G2_trace": f"with recursive {_EDGES}, w as (select 1 as id, 0 as hops union select to_id, hops + 1 from w join e on from_id = id where hops < 6) select cast(min(hops) as bigint) as hops from w where id = 50",
    "G5_G7_triggers": f"with {_EDGES}, rv as (select to_id as from_id, from_id as to_id from e), {_layers(2, '7', 'rv')}, a as ({_H(2)}), j as (select a.id, p_brand as kind, hops, row_number() over (partition by p_brand order by hops, a.id) as rn from a join part on p_partkey = a.id where p_size <= 5) select id, kind, hops from j where rn <= 3",
    "G6_expand": f"with {_EDGES}, c as (select from_id, to_id, case when confidence >= 0.97 then 0.75 when confidence >= 0.94 then 0.65 else 0.35 end as k from e), u as (select from_id, to_id, max(k) as k from (select * from c union all select to_id, from_id, k from c) group by 1, 2), s0(id, score) as (values (3, 1.0::double), (9, 0.6::double)), o1 as (select to_id as id, max(score * k) as score from s0 join u on from_id = id group by 1), s1 as (select id, max(score) as score from (select * from s0 union all select * from o1) group by 1), o2 as (select to_id as id, max(score * k) as score from s1 join u on from_id = id group by 1), s2 as (select id, max(score) as score from (select * from s1 union all select * from o2) group by 1) select id, round(score, 6) as score from s2 order by s2.score desc, id limit 400",
    "G18_experiment_shape": f"with n as (select {K.format('exp_id')} as id, max(nullif({K.format('parent_id')}, '')) as p from experiments group by 1) select p as exp_id, count(*) as n_children, case when count(*) >= 5 then 'fan' when count(*) >= 4 then 'wide' else '' end as shape from n where p in (select id from n) group by 1",
    "G8_G9_causal": f"with {_EDGES}, rv as (select to_id as from_id, from_id as to_id from e), {_layers(2, '5', 'e')}, {_layers(2, '5', 'rv').replace('h0', 'u0').replace('h1', 'u1').replace('h2', 'u2')} select id, cast(1 as bigint) as at from h1 union all select id, 2 from h2 union all select id, -1 from u1 union all select id, -2 from u2",
    "G20_focus": f"with {_EDGES}, b as (select from_id, to_id from e union all select to_id, from_id from e), {_layers(1, '11', 'b')}, dg as (select from_id as id, count(*) as degree from b group by 1), a as ({_H(1)}) select a.id, hops from a left join dg using (id) order by hops, coalesce(degree, 0) desc, a.id limit 70",
    "S4_languages": "with x as (select lower(regexp_extract(coalesce(path, ''), '[.]([^./]+)$', 1)) as e from documents) select case when e in ('py', 'pyi') then 'python' when e = 'md' then 'markdown' when e in ('ts', 'tsx') then 'typescript' when e = 'go' then 'go' when e = 'rs' then 'rust' when e = 'sql' then 'sql' when e = 'toml' then 'toml' else 'text' end as lang, count(*) as n from x group by 1",
    "G19_lineage": f"with recursive n0 as (select {K.format('exp_id')} as id, max(nullif({K.format('parent_id')}, '')) as p from experiments group by 1), n as (select id, case when p in (select id from n0) then p end as p from n0), r as (select id, 0 as d from n where p is null union all select n.id, r.d + 1 from n join r on n.p = r.id), a as (select id as exp_id, d as step, id as ancestor from r union all select a.exp_id, a.step - 1, n.p from a join n on n.id = a.ancestor where n.p is not null) select exp_id, cast(step as bigint) as step, ancestor from a",
    "A9_J9_coupling": "with c as (select distinct l_orderkey as sha, l_partkey as path from lineitem), ok as (select sha from c group by 1 having count(*) <= 8), f as (select c.* from c join ok using (sha)), n as (select path, count(*) as n from f group by 1), s as (select x.path as a, y.path as b, count(*) as shared from f x join f y on x.sha = y.sha and x.path < y.path group by 1, 2 having count(*) >= 2) select a, b, shared, na.n as changes_a, nb.n as changes_b, round_even(shared / (na.n + nb.n - shared), 3) as strength from s join n na on na.path = a join n nb on nb.path = b",
    "A10_A8_hotspots": "with ok as (select l_orderkey from lineitem group by 1 having count(distinct l_partkey) <= 8), h as (select l_partkey as path, count(distinct l_orderkey) as commits, sum(l_quantity) as churn from lineitem where l_orderkey in (select l_orderkey from ok) group by 1), w as (select l_partkey as path, count(distinct l_suppkey) as weight from lineitem group by 1) select path, commits, churn, commits * (1 + coalesce(weight, 0)) as score from h left join w using (path)",
    "G13_conditional_anti": "select p_partkey, case when p_size > 25 then 'lower' else 'higher' end as confidence from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R' and year(l_shipdate) = 1998)",
    "G1_A21_hops": f"with {_EDGES}, {_layers(2, '1', 'e')} select 0 as hops, cast(1 as bigint) as n, cast(null as double) as weakest union all select 1, count(*), min(c) from (select to_id, max(confidence) as c from e where from_id = 1 and to_id in (select id from h1) group by 1) union all select 2, count(*), min(c) from (select to_id, max(confidence) as c from e where from_id in (select id from h1) and to_id in (select id from h2) group by 1)",
}
