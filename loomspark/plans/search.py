"""Queries of full-text and vector retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..operators import text as tx
from ..operators import vector as vx
from ..session import stored, table

QUERY = "retry queue lease"
NORM = "' ' || trim(regexp_replace(lower(coalesce({t}, '')), '[^a-z0-9]+', '  ', 'g')) || ' '"


def norm_sql(t: str) -> str:
    return NORM.format(t=t)


def bm25_sql(source: str, text: str, needles: list[str], cols: str, p: str = "") -> str:
    """The same scoring in SQL: a query whose last part is a relation `scored` with the columns and score."""
    tfs = ", ".join(f"(length(n) - length(replace(n, '{x}', ''))) / {len(x)}.0 as tf{i}" for i, x in enumerate(needles))
    dfs = ", ".join(f"sum(case when tf{i} > 0 then 1 else 0 end) as df{i}" for i in range(len(needles)))
    part = " + ".join(f"ln((st.cnt - st.df{i} + 0.5) / (st.df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / st.avgdl))" for i in range(len(needles)))
    anyhit = " or ".join(f"tf{i} > 0" for i in range(len(needles)))
    return f"""{p}base as (select {cols}, {norm_sql(text)} as n from {source}),
{p}tf as (select *, case when n = '  ' then 0 else (length(n) - length(replace(n, '  ', ''))) / 2 + 1 end as dl, {tfs} from {p}base),
{p}st as (select count(*) as cnt, avg(dl) as avgdl, {dfs} from {p}tf),
{p}scored as (select x.*, {part} as score from {p}tf x, {p}st st where {anyhit})"""


def doc_index(spark, d) -> tx.TextIndex:
    return stored(spark, d, "documents", lambda: tx.TextIndex(table(spark, d, "documents"), "doc_id", "text"))


def message_index(spark, d) -> tx.TextIndex:
    return stored(spark, d, "messages", lambda: tx.TextIndex(_messages(spark, d), "id", "text"))


def _doc_hits(spark, d) -> DataFrame:
    return doc_index(spark, d).hits(tx.parse(QUERY, "any")).select(F.col("id").alias("doc_id"), "score")


def bm25_documents(spark, d) -> DataFrame:
    return _doc_hits(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def bm25_top(spark, d) -> DataFrame:
    top = _doc_hits(spark, d).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(120)
    return top.select("doc_id", F.round(tx.min_max(F.col("score"), Window.partitionBy(F.lit(1))), 6).alias("lex"))


def phrase_documents(spark, d) -> DataFrame:
    h = doc_index(spark, d).all_of(tx.parse('"import resolver" graph*'))
    return h.select(F.col("id").alias("doc_id"), F.col("tf0").alias("n_phrase"), F.col("dl").alias("n_tokens"))


def postings_documents(spark, d) -> DataFrame:
    """Builds the index of the documents, unless it is there, and adds its postings up."""
    p = doc_index(spark, d).postings
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.min(F.get("positions", F.lit(0))).cast("long").alias("first_pos"))


def postings_messages(spark, d) -> DataFrame:
    """The same for the messages: how many terms, postings and tokens their index has."""
    p = message_index(spark, d).postings
    return p.agg(F.count_distinct("term").alias("n_terms"), F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"))


def fuzzy_terms(spark, d) -> DataFrame:
    v = tx.vocabulary(table(spark, d, "documents"), "text")
    out = None
    for w in ("resolver", "fragmant", "leese", "cat"):
        x = tx.fuzzy_variants(v, w).withColumn("word", F.lit(w))
        out = x if out is None else out.unionByName(x)
    return out.select("word", "term", "distance", "n")


def fuzzy_memories(spark, d) -> DataFrame:
    e = table(spark, d, "experiments").groupBy("exp_id").agg(F.max(F.concat_ws(" ", "title", "hypothesis")).alias("body"))
    return tx.fuzzy_score(e, "exp_id", "body", tx.query_terms("chekpoint writter importresolver")).select(F.col("id").alias("exp_id"), F.round("score", 6).alias("score"))


def _messages(spark, d) -> DataFrame:
    m = table(spark, d, "messages").filter("session_key is not null")
    return m.select("id", norm_key("session_key").alias("session_key"), "ordinal", norm_key("role").alias("role"), "kind", "text", "tool_name").dropDuplicates(["id"])


def message_search(spark, d) -> DataFrame:
    """All words, messages only, at most 3 a session, best 20. The texts stay unread: hits come from the index."""
    found = message_index(spark, d).all_of(tx.parse("baseline loss")).select("id", F.round("score", 6).alias("score"))
    hits = found.join(_messages(spark, d).filter("kind = 'message'").select("id", "session_key", "ordinal"), "id")
    best = tx.per_group(hits, ["session_key"], [F.desc("score"), F.col("id")], 3)
    return best.orderBy(F.desc("score"), "id").limit(20).select("id", "session_key", "ordinal", "score")


def message_search_fuzzy(spark, d) -> DataFrame:
    """A misspelt query: near misses are tried where the exact words find too little, and kept if they find more."""
    m, query, limit = _messages(spark, d).filter("kind = 'message'"), "baselne paralel", 30
    n = tx.normal(F.col("text"))
    exact = m.filter(tx.matches(n, [[c] for c in tx.parse(query, "any")], "any")).orderBy("id").limit(limit)
    found = exact.count()
    if found < max(1, limit // 3):
        groups = tx.expand(tx.vocabulary(m, "text"), query, "any")
        near = m.filter(tx.matches(n, groups, "any")).orderBy("id").limit(limit)
        if near.count() > found:
            return near.select("id", "session_key")
    return exact.select("id", "session_key")


def recall(spark, d) -> DataFrame:
    """Any of the terms, in talk (messages and summaries) of one code base, 5 hits, 2 a session."""
    s = table(spark, d, "sessions").select(norm_key("session_key").alias("session_key"), "cwd", "repo_root").filter(F.col("repo_root").startswith("/srv/work/u1") | F.col("cwd").startswith("/srv/work/u1")).select("session_key").distinct()
    own = _messages(spark, d).join(s, "session_key", "left_semi").select("id", "session_key", "kind")
    found = message_index(spark, d).hits(tx.parse("ranking baseline cause", "any"), own).select("id", F.round("score", 6).alias("score"))
    hits = found.join(own.filter(F.col("kind").isin("message", "summary")), "id")
    return tx.per_group(hits, ["session_key"], [F.desc("score"), F.col("id")], 2).orderBy(F.desc("score"), "id").limit(5).select("id", "session_key", "score")


def snippets(spark, d) -> DataFrame:
    h = message_index(spark, d).hits(tx.parse("metric")).join(_messages(spark, d).filter("kind = 'tool_result'"), "id")
    return h.select("id", tx.snippet(F.col("text"), ["metric"]).alias("snippet"))


def message_context(spark, d) -> DataFrame:
    """The messages around every match of message_search, not only around its best."""
    all_ = _messages(spark, d)
    m = all_.groupBy("session_key", "ordinal").agg(F.min("id").alias("id"))
    found = message_index(spark, d).all_of(tx.parse("baseline loss")).select("id")
    hits = all_.filter((F.col("kind") == "message") & F.col("ordinal").isNotNull()).join(found, "id", "left_semi")
    return tx.context(m, hits.select("session_key", "ordinal").distinct(), "session_key", "ordinal", 2, 1).select("session_key", "hit", "ordinal", "id", "is_match")


def budgeted(spark, d) -> DataFrame:
    h = _doc_hits(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").withColumn("score", F.round("score", 6)).withColumn("cost", F.ceil(F.length("text") / 4).cast("long"))
    return tx.within_budget(h, [F.desc("score"), F.col("doc_id")], "cost", 2000).select("doc_id", "cost", "score")


def rrf(spark, d) -> DataFrame:
    lists = [doc_index(spark, d).hits(tx.parse(q, "any")).select("id", F.round("score", 6).alias("score")) for q in ("lease ledger", "cursor index")]
    return tx.fuse(lists).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


def grep_documents(spark, d) -> DataFrame:
    return tx.grep(table(spark, d, "documents"), ["doc_id"], "text", r"recall_at_10\s*=\s*\d\.\d+", limit=40).select("doc_id", F.col("start").cast("long").alias("start"), "match")


def query_shapes(spark, d) -> DataFrame:
    rows = [(q, tx.infer_intent(q), ",".join(tx.query_terms(q)), ",".join(v for t in tx.query_terms(q) for v in tx.variants(t))) for q in ("How does RefreshCoordinator acquire locks?", "rename re-anchor in src/auth", "where is parse_latex defined", "why is multicast failing")]
    return spark.createDataFrame(rows, "query string, intent string, terms string, forms string")


def _vecs(spark, d) -> DataFrame:
    return table(spark, d, "embeddings")


def cosine_topk(spark, d) -> DataFrame:
    e = _vecs(spark, d)
    q = [float(x) for x in e.filter("vec_id = 0").first()["embedding"]]
    return vx.top_k(e, "vec_id", "embedding", q, 60).select(F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


def semantic_seeds(spark, d) -> DataFrame:
    e = _vecs(spark, d)
    q = [float(x) for x in e.filter("vec_id = 7").first()["embedding"]]
    lexical = e.filter("label = 3").select(F.col("vec_id").alias("id"), F.lit(0.5).alias("lex"))
    return vx.semantic_seeds(lexical, vx.top_k(e, "vec_id", "embedding", q, 60)).select(F.col("id").alias("vec_id"), F.round("lex", 6).alias("lex"), F.round("sem", 6).alias("sem"))


def retrieval_metrics(spark, d) -> DataFrame:
    e = _vecs(spark, d)
    ranks = vx.gold_ranks(e, "vec_id", "embedding", "label", e.filter("vec_id % 100 = 0"))
    return vx.metrics(ranks)


def hashed_encoding(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("t"))
    return docs.select("doc_id", vx.letter_histogram(F.col("t")).alias("v")).select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"), F.round(F.get("v", F.lit(4)), 5).alias("e_share"))


QUERIES = {
    "F8_bm25_documents": bm25_documents, "W2_F5_min_max_top120": bm25_top, "F3_F9_phrase_and_prefix": phrase_documents, "F4_inverted_index": postings_documents, "F4_message_index": postings_messages, "F10_D12_fuzzy_variants": fuzzy_terms, "F7_fuzzy_fallback": fuzzy_memories,
    "F12_W3_message_search": message_search, "F11_expanded_search": message_search_fuzzy, "F13_recall": recall, "F14_snippets": snippets, "J11_W8_context": message_context, "W4_budget": budgeted, "V6_W1_rrf": rrf, "F22_grep": grep_documents, "F1_F2_F18_query_shapes": query_shapes,
    "V3_O4_cosine_topk": cosine_topk, "V5_semantic_seeds": semantic_seeds, "A16_retrieval_metrics": retrieval_metrics, "V4_letter_histogram": hashed_encoding,
}

_MSG = "m as (select id, min(lower(trim(session_key, ' ' || chr(9) || chr(10) || chr(13)))) as session_key, min(ordinal) as ordinal, min(kind) as kind, min(text) as text from messages where session_key is not null group by id)"
_N = norm_sql("text")
SQL = {
    "F8_bm25_documents": f"with {bm25_sql('documents', 'text', [' retry ', ' queue ', ' lease '], 'doc_id, text')} select doc_id, round(score, 6) as score from scored",
    "W2_F5_min_max_top120": f"with {bm25_sql('documents', 'text', [' retry ', ' queue ', ' lease '], 'doc_id, text')}, top as (select doc_id, round(score, 6) as s from scored order by s desc, doc_id limit 120) select doc_id, round(case when max(s) over () = min(s) over () then 1.0 else (s - min(s) over ()) / (max(s) over () - min(s) over ()) end, 6) as lex from top",
    "F3_F9_phrase_and_prefix": f"with n as (select doc_id, {_N} as n from documents) select doc_id, cast((length(n) - length(replace(n, ' import  resolver ', ''))) / 18 as bigint) as n_phrase, cast((length(n) - length(replace(n, '  ', ''))) / 2 + 1 as bigint) as n_tokens from n where contains(n, ' import  resolver ') and contains(n, ' graph')",
    "F4_inverted_index": "with t as (select doc_id, unnest(l) as term, unnest(range(len(l))) as pos from (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as l from documents)), p as (select term, doc_id, count(*) as tf, min(pos) as first from t group by 1, 2) select term, count(*) as df, cast(sum(tf) as bigint) as cf, min(first) as first_pos from p group by 1",
    "F4_message_index": f"with {_MSG}, t as (select id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term from m) select count(distinct term) as n_terms, count(distinct (term, id)) as n_postings, count(*) as n_tokens from t where term <> ''",
    "F10_D12_fuzzy_variants": "with v as (select term, count(*) as n from (select unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as term from documents) where term <> '' group by 1), q(word, b) as (values ('resolver', 2), ('fragmant', 2), ('leese', 1), ('cat', 0)), c as (select word, term, levenshtein(term, word) as distance, n from q join v on left(term, 1) = left(word, 1) and length(term) between length(word) - b and length(word) + b and term <> word where levenshtein(term, word) <= b) select word, term, distance, n from (select *, row_number() over (partition by word order by distance, n desc, term) as rn from c) where rn <= 12",
    "F12_W3_message_search": f"with {_MSG}, {bm25_sql('m', 'text', [' baseline ', ' loss '], 'id, session_key, ordinal, kind, text')}, h as (select id, session_key, ordinal, round(score, 6) as score from scored where tf0 > 0 and tf1 > 0 and kind = 'message'), r as (select *, row_number() over (partition by session_key order by score desc, id) as rn from h) select id, session_key, ordinal, score from r where rn <= 3 order by score desc, id limit 20",
    "F13_recall": f"with {_MSG}, own as (select distinct lower(trim(session_key, ' ' || chr(9) || chr(10) || chr(13))) as k from sessions where repo_root like '/srv/work/u1%' or cwd like '/srv/work/u1%'), mm as (select * from m where session_key in (select k from own)), {bm25_sql('mm', 'text', [' ranking ', ' baseline ', ' cause '], 'id, session_key, kind, text')}, h as (select id, session_key, round(score, 6) as score from scored where kind in ('message', 'summary')), r as (select *, row_number() over (partition by session_key order by score desc, id) as rn from h) select id, session_key, score from r where rn <= 2 order by score desc, id limit 5",
    "J11_W8_context": f"with {_MSG}, o as (select session_key, ordinal, min(id) as id from m group by 1, 2), n as (select session_key, ordinal, {_N} as n from m where kind = 'message' and ordinal is not null), h as (select distinct session_key, ordinal from n where contains(n, ' baseline ') and contains(n, ' loss ')) select o.session_key, h.ordinal as hit, o.ordinal, o.id, h.ordinal = o.ordinal as is_match from o join h on o.session_key = h.session_key and o.ordinal between h.ordinal - 2 and h.ordinal + 1",
    "W4_budget": f"with {bm25_sql('documents', 'text', [' retry ', ' queue ', ' lease '], 'doc_id, text')}, t as (select doc_id, cast(ceil(length(text) / 4.0) as bigint) as cost, round(score, 6) as score from scored order by score desc, doc_id limit 12), r as (select *, sum(cost) over (order by score desc, doc_id rows unbounded preceding) as run, row_number() over (order by score desc, doc_id) as rn from t) select doc_id, cost, score from r where run <= 2000 or rn = 1",
    "V6_W1_rrf": f"with {bm25_sql('documents', 'text', [' lease ', ' ledger '], 'doc_id, text', 'a')}, {bm25_sql('documents', 'text', [' cursor ', ' index '], 'doc_id, text', 'b')}, ra as (select doc_id, 10.0 / (9 + row_number() over (order by round(score, 6) desc, doc_id)) as v, row_number() over (order by round(score, 6) desc, doc_id) as rn from ascored), rb as (select doc_id, 10.0 / (9 + row_number() over (order by round(score, 6) desc, doc_id)) as v, row_number() over (order by round(score, 6) desc, doc_id) as rn from bscored), t as (select doc_id, sum(v) as v from (select * from ra where rn <= 120 union all select * from rb where rn <= 120) group by 1) select doc_id, round(v / max(v) over (), 6) as score from t",
    "V5_semantic_seeds": "with q as (select cast(embedding as double[]) as e from embeddings where vec_id = 7), s as (select vec_id, row_number() over (order by list_dot_product(cast(embedding as double[]), q.e) desc, vec_id) - 1 as rk from embeddings, q), n as (select * from s where rk < 60), l as (select vec_id from embeddings where label = 3) select coalesce(l.vec_id, n.vec_id) as vec_id, case when l.vec_id is not null then 0.5 else 0 end::double as lex, round(case when n.rk is null then 0 else 10.0 / (10 + n.rk) end, 6)::double as sem from l full join n on l.vec_id = n.vec_id where l.vec_id is not null or n.rk < 20",
    "V3_O4_cosine_topk": "with q as (select embedding as e from embeddings where vec_id = 0), s as (select vec_id, round(list_dot_product(cast(embedding as double[]), cast(q.e as double[])), 5) as similarity, list_dot_product(cast(embedding as double[]), cast(q.e as double[])) as s from embeddings, q) select vec_id, similarity from s order by s desc, vec_id limit 60",
    "A16_retrieval_metrics": "with q as (select * from embeddings where vec_id % 100 = 0), s as (select q.vec_id as qid, q.label = e.label as good, row_number() over (partition by q.vec_id order by list_dot_product(cast(e.embedding as double[]), cast(q.embedding as double[])) desc, e.vec_id) as rk from q join embeddings e on e.vec_id <> q.vec_id), g as (select q.vec_id as qid, min(case when good then rk end) as rk from q left join s on s.qid = q.vec_id group by 1) select count(*) as n_queries, round(avg(coalesce(1.0 / rk, 0)), 6) as mrr, round(avg(case when rk <= 1 then 1.0 else 0 end), 6) as hit_at_1, round(avg(case when rk <= 5 then 1.0 else 0 end), 6) as hit_at_5, round(avg(case when rk <= 10 then 1.0 else 0 end), 6) as hit_at_10 from g",
    "V4_letter_histogram": "with c as (select doc_id, list_transform(range(97, 123), lambda k: length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), chr(k::int), ''))) as v from documents), n as (select doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x * 1.0))) as l from c) select doc_id, case when l > 0 then 1.0 else 0 end::double as norm, round(case when l > 0 then v[5] / l else 0 end, 5)::double as e_share from n",
    "F22_grep": "with x as (select doc_id, unnest(regexp_extract_all(text, 'recall_at_10\\s*=\\s*\\d\\.\\d+')) as match, unnest(range(len(regexp_extract_all(text, 'recall_at_10\\s*=\\s*\\d\\.\\d+')))) as k, text from documents) select doc_id, match, cast(case when k = 0 then strpos(text, match) - 1 else null end as bigint) as start from x order by doc_id, k limit 40",
}
del SQL["F22_grep"]  # SQL has no offsets of later hits
