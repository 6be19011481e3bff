"""Queries of the relational core, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..operators import scale as sc
from ..operators import state as st
from ..operators import text as tx
from ..session import table

PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
K = "lower(trim({}, ' ' || chr(9) || chr(10) || chr(13)))"
_REG: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _REG[name] = (f, sql)
        return f

    return keep


class Tables:
    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    def __getattr__(self, name) -> DataFrame:
        return table(self.spark, self.d, name)


@query("P1_P2_filters", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderdate >= timestamp '1995-01-01' and o_totalprice > 1000")
def filters(t):
    return t.orders.filter((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (F.col("o_totalprice") > 1000)).select("o_orderkey", "o_totalprice")


@query("P3_J6_semi_join", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def semi(t):
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("J3_J4_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def anti(t):
    return t.customer.join(t.orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("J5_not_in", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_shipdate >= timestamp '1998-01-01' and l_partkey is not null)")
def not_in(t):
    gone = t.lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))).select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(gone, "p_partkey", "left_anti").select("p_partkey")


@query("J1_five_way_join", "select n_name, cast(count(*) as bigint) as n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by n_name")
def five_way(t):
    asia = t.nation.join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(asia), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("J2_left_outer_two_keys", f"select m.memory_id, m.run_id, e.verdict as run_verdict from (select distinct memory_id, {K.format('run_id')} as run_id, {K.format('exp_id')} as exp_id from evidence) m left join (select {K.format('run_id')} as run_id, {K.format('exp_id')} as exp_id, max(verdict) as verdict from runs group by 1, 2) e on e.run_id = m.run_id and e.exp_id = m.exp_id")
def left_two_keys(t):
    m = t.evidence.select("memory_id", norm_key("run_id").alias("run_id"), norm_key("exp_id").alias("exp_id")).distinct()
    r = t.runs.groupBy(norm_key("run_id").alias("run_id"), norm_key("exp_id").alias("exp_id")).agg(F.max("verdict").alias("run_verdict"))
    return m.join(r, ["run_id", "exp_id"], "left").select("memory_id", "run_id", "run_verdict")


@query("J7_J8_twins", "select a.s_suppkey, min(b.s_suppkey) as class_id, count(*) as n_same, count(*) filter (b.s_acctbal > a.s_acctbal) as n_richer from supplier a join supplier b on a.s_nationkey = b.s_nationkey group by 1")
def twins(t):
    """Each supplier with the class of those of its nation, how many they are and how many of them are richer: a self-join that keeps classes instead of pairs."""
    n = t.supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("class_id"), F.count(F.lit(1)).alias("n_same"))
    richer = F.rank().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"))) - 1
    return t.supplier.withColumn("n_richer", richer.cast("long")).join(n, "s_nationkey").select("s_suppkey", "class_id", "n_same", "n_richer")


@query("J10_theta_join", "select l_orderkey, count(*) as n_early from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate group by 1")
def theta(t):
    return t.lineitem.join(t.orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") < F.col("o_orderdate"))).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_early"))


@query("J13_correlated", "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n_orders, (select o_orderkey from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey desc limit 1) as dearest from customer")
def correlated(t):
    o = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("o_totalprice", "o_orderkey")).alias("m"))
    return t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.col("m.o_orderkey").alias("dearest"))


@query("J14_or_join", "select n_nationkey, count(*) as n_touching from nation join (select o_orderkey, c.c_nationkey as a, s.s_nationkey as b from orders join customer c on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier s on s_suppkey = l_suppkey) x on n_nationkey = a or n_nationkey = b group by 1")
def or_join(t):
    x = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("c_nationkey", "s_nationkey")
    ends = x.select(F.explode(F.array_distinct(F.array("c_nationkey", "s_nationkey"))).alias("n_nationkey"))
    return ends.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n_touching"))


@query("J15_resolve_with_fallback", f"with r as (select distinct {K.format('repo_id')} as k from checkouts where repo_id is not null), d as (select {K.format('record_key')} as k from tombstones where record_kind = 'repository') select r.k as repo_id, case when d.k is not null then 'purged' when p.repo_id is null then 'unresolved' when p.status = 'ACTIVE' then 'active' else 'unavailable' end as outcome from r left join repositories p on {K.format('p.repo_id')} = r.k left join (select distinct k from d) d on d.k = r.k")
def resolve(t):
    r = t.checkouts.filter("repo_id is not null").select(norm_key("repo_id").alias("k")).distinct()
    p = t.repositories.select(norm_key("repo_id").alias("k"), F.coalesce("status", F.lit("?")).alias("status"))
    d = t.tombstones.filter("record_kind = 'repository'").select(norm_key("record_key").alias("k"), F.lit(True).alias("dead")).distinct()
    out = F.when(F.col("dead"), "purged").when(F.col("status").isNull(), "unresolved").when(F.col("status") == "ACTIVE", "active").otherwise("unavailable")
    return r.join(p, "k", "left").join(d, "k", "left").select(F.col("k").alias("repo_id"), out.alias("outcome"))


@query("J23_full_outer_diff", "with a as (select l_partkey as k, sum(l_quantity) as q from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey as k, sum(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1) select coalesce(a.k, b.k) as k, a.q as qa, b.q as qb, case when a.k is null then 'only_b' when b.k is null then 'only_a' when a.q <> b.q then 'changed' else 'same' end as state from a full join b on a.k = b.k")
def full_outer(t):
    side = lambda f, n: t.lineitem.filter(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias(n))
    s = F.when(F.col("qa").isNull(), "only_b").when(F.col("qb").isNull(), "only_a").when(F.col("qa") != F.col("qb"), "changed").otherwise("same")
    return side("A", "qa").join(side("R", "qb"), "k", "full_outer").select("k", "qa", "qb", s.alias("state"))


@query("J26_latest_per_key", f"select exp_id, run_id from (select {K.format('exp_id')} as exp_id, {K.format('run_id')} as run_id, row_number() over (partition by {K.format('exp_id')} order by started_at desc, {K.format('run_id')} desc) as rn from runs where verdict is not null and exp_id is not null) where rn = 1")
def latest(t):
    r = t.runs.filter("verdict is not null and exp_id is not null").select(norm_key("exp_id").alias("exp_id"), norm_key("run_id").alias("run_id"), "started_at")
    return st.latest(r, ["exp_id"], ["started_at", "run_id"]).select("exp_id", "run_id")


@query("X1_longest_prefix_join", "with r as (select distinct regexp_extract(source_path, '^/home/[^/]+(/[.][^/]+/2026)?', 0) as root from source_files), p as (select distinct source_path from source_files) select source_path, max_by(root, length(root)) as root from p join r on source_path = root or starts_with(source_path, root || '/') where root <> '' group by 1")
def longest_prefix(t):
    f = t.source_files.select("source_path").distinct()
    roots = f.select(F.regexp_extract("source_path", "^/home/[^/]+(/[.][^/]+/2026)?", 0).alias("root")).filter("root <> ''").distinct()
    return st.longest_prefix(f, "source_path", roots, "root")


@query("A1_count_by_key", "select status, count(*) as n from runs group by 1")
def count_by(t):
    return t.runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("A2_multi_key_aggregate", "select surface, provider, origin, count(*) as n, coalesce(sum(message_count), 0)::bigint as n_messages, min(started_at) as first, max(updated_at) as last from sessions group by 1, 2, 3")
def multi_key(t):
    return t.sessions.groupBy("surface", "provider", "origin").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("n_messages"), F.min("started_at").alias("first"), F.max("updated_at").alias("last"))


@query("A3_count_distinct", "select l_returnflag, count(distinct l_partkey) as n_parts, count(distinct l_suppkey) as n_suppliers from lineitem group by 1")
def count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("A4_having", "select l_partkey, count(*) as n from lineitem group by 1 having count(*) >= 40")
def having(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 40")


@query("A5_worst_of", "select o_custkey, min(o_orderpriority) as worst, min(o_totalprice) as lowest, count(*) as n from orders group by 1")
def worst_of(t):
    return t.orders.groupBy("o_custkey").agg(st.worst(PRIORITIES, F.col("o_orderpriority")).alias("worst"), F.min("o_totalprice").alias("lowest"), F.count(F.lit(1)).alias("n"))


@query("A6_concat_distinct", "select l_orderkey, string_agg(distinct l_shipmode, ',' order by l_shipmode) as modes from (select l_orderkey, l_returnflag as l_shipmode from lineitem) group by 1")
def concat_distinct(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("modes"))


@query("A7_one_row_per_group", "select event_type, min_by(event_id, (value, event_id)) as event_id from events group by 1")
def one_row(t):
    return t.events.groupBy("event_type").agg(F.min(F.struct("value", "event_id")).alias("m")).select("event_type", "m.event_id")


@query("A14_specificity", "select o_custkey, case when count(*) > 3 then round(least(0.45, 0.08 * (count(*) - 3)), 6) else 0 end::double as discount from orders group by 1")
def specificity(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select("o_custkey", F.when(F.col("n") > 3, F.round(F.least(F.lit(0.45), 0.08 * (F.col("n") - 3)), 6)).otherwise(0.0).alias("discount"))


@query("A15_signals", "select user_id, max(value) as top, least(1.0, 0.35 * sum(case when event_type = 'purchase' then 1 else 0 end))::double as signal, bool_or(event_type = 'click') as clicked from events group by 1")
def signals(t):
    return t.events.groupBy("user_id").agg(F.max("value").alias("top"), F.least(F.lit(1.0), 0.35 * F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0))).alias("signal"), F.bool_or(F.col("event_type") == "click").alias("clicked"))


@query("A17_verdict_band", "with m as (select l_returnflag as f, avg(case when l_linestatus = 'O' then l_extendedprice end) as a, avg(case when l_linestatus = 'F' then l_extendedprice end) as b from lineitem group by 1) select f, case when abs(b - a) <= 0.02 * abs(a) then 'same' when b > a then 'better' else 'worse' end as verdict from m")
def verdict_band(t):
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("f")).agg(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))).alias("a"), F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))).alias("b"))
    return m.select("f", F.when(F.abs(F.col("b") - F.col("a")) <= 0.02 * F.abs("a"), "same").when(F.col("b") > F.col("a"), "better").otherwise("worse").alias("verdict"))


@query("A21_A26_tally", "select record_kind as kind, cast(count(*) as bigint) as n from tombstones group by 1 union all select 'total', count(*) from tombstones")
def tally(t):
    return t.tombstones.groupBy(F.col("record_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n")).unionByName(t.tombstones.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("total")))


@query("A29_upper_median", "with r as (select source, length(text) as n, row_number() over (partition by source order by length(text)) - 1 as i, count(*) over (partition by source) as c from documents where text is not null) select source, n as median from r where i = c // 2")
def upper_median(t):
    # the element at floor(n / 2): a histogram of lengths a group, then the running count
    h = t.documents.filter("text is not null").groupBy("source", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    r = h.withColumns({"upto": F.sum("c").over(w), "whole": F.sum("c").over(Window.partitionBy("source"))})
    return r.filter(F.col("upto") > F.floor(F.col("whole") / 2)).groupBy("source").agg(F.min("n").cast("long").alias("median"))


@query("A12_consensus_terms", "with tk as (select distinct exp_id, unnest(string_split_regex(lower(title), '[^a-z0-9]+')) as term, branch from (select exp_id, title, coalesce(split_part(branch, '/', 1), '-') as branch from experiments)), w as (select * from tk where length(term) >= 3), n as (select branch, count(distinct exp_id) as n from w group by 1), c as (select branch, term, count(distinct exp_id) as k from w group by 1, 2) select c.branch, c.term, c.k as n_claims from c join n using (branch) where c.k >= greatest(2, n.n // 50 + 1)")
def consensus(t):
    w = t.experiments.select("exp_id", F.coalesce(F.substring_index("branch", "/", 1), F.lit("-")).alias("branch"), F.explode(tx.tokens(F.col("title"))).alias("term")).filter(F.length("term") >= 3).distinct()
    n = w.groupBy("branch").agg(F.count_distinct("exp_id").alias("n"))
    c = w.groupBy("branch", "term").agg(F.count_distinct("exp_id").alias("n_claims"))
    return c.join(n, "branch").filter(F.col("n_claims") >= F.greatest(F.lit(2), F.floor(F.col("n") / 50) + 1)).select("branch", "term", "n_claims")


@query("W3_top_n_per_group", "select l_suppkey, l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as rn from lineitem) where rn <= 3")
def top_n(t):
    return tx.per_group(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("W5_first_occurrence", "select l_partkey, l_orderkey from (select l_partkey, l_orderkey, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as rn from lineitem) where rn = 1")
def first_occurrence(t):
    return t.lineitem.groupBy("l_partkey").agg(F.min("l_orderkey").alias("l_orderkey"))


@query("W6_collapse_adjacent", "select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts) as p from events) where p is null or p <> event_type")
def collapse(t):
    p = sc.previous(t.events.select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts"], ["event_type"], "p")
    return p.filter("p is null or p.event_type <> event_type").select("event_id")


@query("W7_siblings", "select event_id, lag(event_id) over w as prev_id, lead(event_id) over w as next_id from events window w as (partition by user_id order by ts)")
def siblings(t):
    w = Window.partitionBy("user_id").orderBy("ts")
    return t.events.select("event_id", F.lag("event_id").over(w).alias("prev_id"), F.lead("event_id").over(w).alias("next_id"))


@query("W9_A28_setback_streak", f"with r as (select {K.format('exp_id')} as exp_id, {K.format('run_id')} as run_id, max(started_at) as began, max(status) as status, max(verdict) as verdict from runs where exp_id is not null group by 1, 2), w as (select *, sum(case when coalesce(verdict, '') <> 'loss' and status <> 'failed' then 1 else 0 end) over (partition by exp_id order by began desc, run_id desc rows unbounded preceding) as good from r where status <> 'cancelled') select exp_id, cast(sum(case when good = 0 then 1 else 0 end) as bigint) as streak from w group by 1")
def streak(t):
    r = t.runs.filter("exp_id is not null").groupBy(norm_key("exp_id").alias("exp_id"), norm_key("run_id").alias("run_id")).agg(F.max("started_at").alias("at"), F.max("status").alias("status"), F.max("verdict").alias("verdict"))
    bad = (F.coalesce("verdict", F.lit("")) == "loss") | (F.col("status") == "failed")
    return st.leading_streak(r.filter("status is not null"), ["exp_id"], [F.desc("at"), F.desc("run_id")], bad, F.col("status") == "cancelled")


@query("W13_paging", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 25 offset 50")
def paging(t):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(25).select("o_orderkey", "o_orderdate")


@query("O1_O2_O3_composite_sort", "select p_partkey from part order by p_name like '%steel%', p_size, p_retailprice desc, p_partkey limit 40")
def composite_sort(t):
    return t.part.orderBy(F.col("p_name").contains("steel"), "p_size", F.desc("p_retailprice"), "p_partkey").limit(40).select("p_partkey")


@query("O10_nulls_last", f"select repo_id, last_seen_at from repositories order by last_seen_at desc nulls last, repo_id limit 30")
def nulls_last(t):
    return t.repositories.orderBy(F.desc_nulls_last("last_seen_at"), "repo_id").limit(30).select("repo_id", "last_seen_at")


@query("U1_union_max", "select k, max(s) as s from (select o_custkey as k, o_totalprice as s from orders where o_orderpriority = '1-URGENT' union all select c_custkey, c_acctbal from customer) group by 1")
def union_max(t):
    a = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("s"))
    return a.unionByName(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("s"))).groupBy("k").agg(F.max("s").alias("s"))


@query("U3_U4_difference", "select distinct l_partkey from lineitem where l_returnflag = 'A' except select l_partkey from lineitem where l_returnflag = 'R' and l_discount > 0.08")
def difference(t):
    a = t.lineitem.filter(F.col("l_returnflag") == "A").select("l_partkey")
    return a.distinct().join(t.lineitem.filter("l_returnflag = 'R' and l_discount > 0.08").select("l_partkey"), "l_partkey", "left_anti")


@query("P4_P5_mentions", "with q(needle) as (values ('hooks/'), ('ledger')) select needle, count(*) as n from q join (select distinct path from documents where path is not null) f on contains(f.path, needle) group by 1")
def mentions(t):
    f = t.documents.filter("path is not null").select("path").distinct()
    hit = F.filter(F.array(F.lit("hooks/"), F.lit("ledger")), lambda n: F.col("path").contains(n))
    return f.select(F.explode(hit).alias("needle")).groupBy("needle").agg(F.count(F.lit(1)).alias("n"))


@query("P6_directory_scope", f"select count(distinct {K.format('session_key')}) as n from sessions where cwd = '/srv/work/u1' or cwd like '/srv/work/u1/%' or repo_root = '/srv/work/u1' or repo_root like '/srv/work/u1/%'")
def scope(t):
    inside = lambda c: (F.col(c) == "/srv/work/u1") | F.col(c).startswith("/srv/work/u1/")
    return t.sessions.filter(inside("cwd") | inside("repo_root")).agg(F.count_distinct(norm_key("session_key")).alias("n"))


@query("P9_P10_pattern_predicates", "select regexp_matches(lower(coalesce(path, '')), '(^|/)tests?/|_test\\.|test_') as is_test, regexp_matches(lower(coalesce(text, '')), '(^|[^a-z])(do not|never|must not)($|[^a-z])') as negated, count(*) as n from documents group by 1, 2")
def patterns(t):
    return t.documents.groupBy(F.lower(F.coalesce("path", F.lit(""))).rlike(r"(^|/)tests?/|_test\.|test_").alias("is_test"), F.lower(F.coalesce("text", F.lit(""))).rlike(r"(^|[^a-z])(do not|never|must not)($|[^a-z])").alias("negated")).agg(F.count(F.lit(1)).alias("n"))


@query("P12_P13_uncovered_lines", "with s as (select l_orderkey as k, unnest(generate_series(l_linenumber, l_linenumber + 3)) as line from lineitem where l_returnflag = 'A'), c as (select l_orderkey as k, unnest(generate_series(l_linenumber, l_linenumber + 1)) as line from lineitem where l_returnflag <> 'A') select distinct k, line from s except select k, line from c")
def lines(t):
    span = lambda f, n: t.lineitem.filter(f).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + n).alias("hi"))
    return st.uncovered(span("l_returnflag = 'A'", 3), span("l_returnflag <> 'A'", 1), "k").select("k", F.col("line").cast("long").alias("line"))


@query("P28_P29_tombstone_precedence", f"select {K.format('record_key')} as k, max(case record_kind when 'repository' then 2 when 'session' then 1 else 0 end)::bigint as mode from tombstones where regexp_matches({K.format('record_key')}, '^(exp|run|repo)_[0-9a-f]{{12}}$|^[0-9a-f]{{24}}$') group by 1")
def tombstone_mode(t):
    k = norm_key("record_key")
    return t.tombstones.filter(k.rlike("^(exp|run|repo)_[0-9a-f]{12}$|^[0-9a-f]{24}$")).groupBy(k.alias("k")).agg(F.max(F.when(F.col("record_kind") == "repository", 2).when(F.col("record_kind") == "session", 1).otherwise(0)).cast("long").alias("mode"))


@query("M1_upsert", "with n as (select c_custkey, max(c_acctbal) as b from (select c_custkey, c_acctbal + 1 as c_acctbal from customer where c_nationkey < 5) group by 1) select c.c_custkey, coalesce(n.b, c.c_acctbal) as c_acctbal from customer c left join n using (c_custkey) union all select -1, 0.0")
def upsert(t):
    base = t.customer.select("c_custkey", "c_acctbal")
    new = t.customer.filter("c_nationkey < 5").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    extra = t.spark.createDataFrame([(-1, 0.0)], "c_custkey long, c_acctbal double")
    return st.upsert(base, new.unionByName(new).unionByName(extra), ["c_custkey"])


@query("M3_replace_owned", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey % 3 <> 0 union all select l_orderkey, 1, sum(l_quantity) from lineitem where l_orderkey % 3 = 0 group by 1")
def replace_owned(t):
    base = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    new = base.filter("l_orderkey % 3 = 0").groupBy("l_orderkey").agg(F.lit(1).alias("l_linenumber"), F.sum("l_quantity").alias("l_quantity"))
    return st.replace_owned(base, new.select(*base.columns), "l_orderkey")


@query("M5_monotone_trust", "select user_id, max(case event_type when 'view' then 0 when 'click' then 1 when 'purchase' then 2 else 3 end)::int as worst, min(value) as least from events group by 1")
def monotone(t):
    r = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    return t.events.groupBy("user_id").agg(F.max(r).alias("worst"), F.min("value").alias("least"))


@query("M11_scd2_versions", "with s as (select user_id, event_type, ts, event_id, lag(event_type) over (partition by user_id order by ts, event_id) as p from events), f as (select * from s where p is null or p <> event_type) select user_id, event_type, ts as valid_from, lead(ts) over (partition by user_id order by ts, event_id) as valid_until, cast(row_number() over (partition by user_id order by ts, event_id) as integer) as version from f")
def scd2(t):
    return st.versions(t.events, "user_id", "ts", ["event_type"], ["event_id"])


@query("M16_P14_votes", "with v as (select user_id as id, sum(case when event_type = 'purchase' then 1 else 0 end) as h, sum(case when event_type = 'error' or event_type = 'refund' then 1 else 0 end) as u from events group by 1) select id, cast(h as bigint) as helpful, cast(u as bigint) as unhelpful, u >= 2 and u > 2 * h as withheld from v")
def votes(t):
    v = t.events.groupBy(F.col("user_id").alias("id")).agg(F.sum((F.col("event_type") == "purchase").cast("long")).alias("helpful"), F.sum(F.col("event_type").isin("error", "refund").cast("long")).alias("unhelpful"))
    return v.withColumn("withheld", (F.col("unhelpful") >= 2) & (F.col("unhelpful") > 2 * F.col("helpful")))


@query("F20_usage_boost", "with a as (select max(ts) as at from events), u as (select user_id, sum(case when event_type = 'purchase' then 1 else 0 end) as h, sum(case when event_type = 'click' then 1 else 0 end) as o, sum(case when event_type = 'view' then 1 else 0 end) as s, sum(case when event_type not in ('purchase', 'click', 'view') then 1 else 0 end) as x, max(ts) as last from events group by 1) select user_id, round(case when o + s + h > 0 then least(0.5, 0.18 * ln(1 + 4 * o + 0.35 * s + 6 * h) * power(0.5, date_diff('day', last, a.at) / 45.0)) else 0 end - least(0.3, 0.1 * x), 6) as boost from u, a")
def usage(t):
    at = t.events.agg(F.max("ts")).first()[0]
    n = lambda c: F.sum(c.cast("int"))
    e = F.col("event_type")
    u = t.events.groupBy("user_id").agg(n(e == "click").alias("o"), n(e == "view").alias("s"), n(e == "purchase").alias("h"), n(~e.isin("click", "view", "purchase")).alias("x"), F.max("ts").alias("last"))
    return u.select("user_id", F.round(st.usage_boost(F.col("o"), F.col("s"), F.col("h"), F.col("x"), F.datediff(F.lit(at), "last")), 6).alias("boost"))


@query("F21_recency", "with a as (select max(o_orderdate) as at from orders) select o_custkey, round(1 / (1 + date_diff('day', max(o_orderdate), any_value(a.at)) / 30.0), 6) as recency from orders, a group by 1")
def recency(t):
    at = t.orders.agg(F.max("o_orderdate")).first()[0]
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("m")).select("o_custkey", F.round(st.recency(F.datediff(F.lit(at), "m")), 6).alias("recency"))


@query("X11_session_derivations", f"with m as (select {K.format('session_key')} as k, ordinal, role, kind, text from messages where session_key is not null), u as (select k, min(ordinal) as o from m where kind = 'message' and {K.format('role')} in ('user', 'human') and text is not null group by 1) select m.k as session_key, min(left(trim(regexp_replace(m.text, '[\\s\\x{{00A0}}]+', ' ', 'g')), 160)) as title from m join u on m.k = u.k and m.ordinal = u.o where m.kind = 'message' and {K.format('m.role')} in ('user', 'human') and m.text is not null group by 1")
def derivations(t):
    m = t.messages.filter("session_key is not null and kind = 'message' and text is not null and ordinal is not null").filter(norm_key("role").isin("user", "human"))
    title = F.substring(F.trim(F.regexp_replace("text", r"[\s\u00a0]+", " ")), 1, 160)
    return m.groupBy(norm_key("session_key").alias("session_key")).agg(F.min(F.struct("ordinal", title.alias("title"))).alias("m")).select("session_key", "m.title")


@query("X9_retention", "select surface, source_path from (select surface, source_path, row_number() over (partition by surface order by m desc, source_path desc) as rn from (select surface, source_path, max(indexed_at) as m from source_files group by 1, 2)) where rn > 20")
def retention(t):
    f = t.source_files.groupBy("surface", "source_path").agg(F.max("indexed_at").alias("m"))
    rn = F.row_number().over(Window.partitionBy("surface").orderBy(F.desc("m"), F.desc("source_path")))
    return f.withColumn("rn", rn).filter("rn > 20").select("surface", "source_path")


@query("JSON_props", "select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n from events group by 1")
def json_props(t):
    return t.events.groupBy(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {n: (lambda spark, d, f=f: f(Tables(spark, d))) for n, (f, _) in _REG.items()}
SQL = {n: s for n, (_, s) in _REG.items() if s}
