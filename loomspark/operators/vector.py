"""Vector retrieval: exact cosine top-k, incremental encoding, seeds and retrieval metrics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import numbered
from .text import rank_score


def dot(a: Column, b: Column) -> Column:
    """Dot product in double arithmetic; of unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def top_k(vectors: DataFrame, id_col: str, vec_col: str, query: list[float], k: int) -> DataFrame:
    """(id, similarity): the k nearest to the query vector, exactly; each task keeps its own k first. Null vectors and other dimensions are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.filter(F.size(vec_col) == len(query)).select(F.col(id_col).alias("id"), dot(F.col(vec_col), q).alias("similarity"))
    return s.orderBy(F.desc("similarity"), "id").limit(k)


def semantic_seeds(lexical: DataFrame, nearest: DataFrame, new_cap: int = 20) -> DataFrame:
    """(id, lex, sem): seeds known before get sem = K / (K + rank) for all ranks, unknown ones only for the first `new_cap`."""
    ranked = nearest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")) - 1)  # of k rows
    j = lexical.join(ranked, "id", "full_outer").filter(F.col("lex").isNotNull() | (F.col("rank") < new_cap))
    return j.select("id", F.coalesce("lex", F.lit(0.0)).alias("lex"), F.coalesce(rank_score(F.col("rank")), F.lit(0.0)).alias("sem"))


def gold_ranks(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, queries: DataFrame, block: int = 64) -> DataFrame:
    """(query, rank): the place of the first vector with the query's label, itself left out; null if there is none.

    The queries are a stated set and go through all vectors in blocks. Only the nearest of the right label and the number
    of nearer ones are needed, so a block makes two aggregates and no pairs that outlive a batch.
    """
    import numpy as np

    q = queries.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("q"), F.col(vec_col).alias("qv"), F.col(label_col).alias("ql"))
    width = vectors.filter(F.col(vec_col).isNotNull()).select(F.size(vec_col)).first()
    if width is None:
        return queries.select(F.col(id_col).cast("long").alias("query"), F.lit(None).cast("long").alias("rank"))
    # blocks of queries meet all vectors: each block is one row, repeated to the tasks that hold the vectors
    placed = numbered(q, [F.col("q")], "_n")
    blocks = placed.groupBy(F.floor(F.col("_n") / block).alias("_b")).agg(F.collect_list(F.struct("q", "qv", "ql")).alias("qs"))
    rows = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("v"), F.col(vec_col).alias("x"), F.col(label_col).alias("l")).withColumn("_t", F.pmod(F.xxhash64("v"), F.lit(max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = blocks.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))

    def parts(right, with_gold):
        """Runs over the vectors of a task with the query blocks beside them."""

        def run(_, mine, theirs):
            if not len(mine):
                return pd.DataFrame({"query": [], "s": [], "v": [], "n": []}).astype({"query": "int64", "s": "float64", "v": "int64", "n": "int64"})
            x, v, lab = np.stack(mine["x"].to_numpy()).astype(float), mine["v"].to_numpy(), mine["l"].to_numpy()
            out = []
            for qs in theirs["qs"]:
                sims = np.array([list(k["qv"]) for k in qs], dtype=float) @ x.T
                for k, s in zip(qs, sims):
                    if with_gold:
                        if k["s"] is not None:
                            near = (s > k["s"] + 1e-12) | ((abs(s - k["s"]) <= 1e-12) & (v < k["gv"]))
                            out.append((k["q"], 0.0, 0, int((near & (v != k["q"])).sum())))
                        continue
                    ok = (lab == k["ql"]) & (v != k["q"])
                    if ok.any():
                        j = np.lexsort((v[ok], -s[ok]))[0]
                        out.append((k["q"], float(s[ok][j]), int(v[ok][j]), 0))
            return pd.DataFrame(out, columns=["query", "s", "v", "n"]).astype({"query": "int64", "s": "float64", "v": "int64", "n": "int64"})

        return rows.groupBy("_t").cogroup(right.groupBy("_t")).applyInPandas(run, "query long, s double, v long, n long")

    gold = parts(spread, False).groupBy("query").agg(F.max(F.struct("s", (-F.col("v")).alias("nv"))).alias("m")).select(F.col("query").alias("q"), F.col("m.s").alias("s"), (-F.col("m.nv")).alias("gv"))
    known = placed.join(gold, "q", "left")
    again = known.groupBy(F.floor(F.col("_n") / block).alias("_b")).agg(F.collect_list(F.struct("q", "qv", "ql", "s", "gv")).alias("qs")).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    counted = parts(again, True).groupBy("query").agg((F.sum("n") + 1).alias("rank"))
    return queries.select(F.col(id_col).cast("long").alias("query")).join(counted, "query", "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """MRR and hit rates at 1, 5 and 10 of (query, rank); a missing rank counts 0."""
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{k}")
    return ranks.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), hit(1), hit(5), hit(10))


def letter_vector(text: str) -> list[float]:
    """The built-in encoding of one text, on the driver."""
    n = [text.lower().count(chr(c)) for c in range(97, 123)]
    size = sum(x * x for x in n) ** 0.5 or 1.0
    return [x / size for x in n]


def letter_histogram(text: Column) -> Column:
    """The built-in encoder: counts of the letters a..z at length 1; a text without them gives zeros."""

    @F.pandas_udf("array<double>")
    def encode(col: pd.Series) -> pd.Series:
        import numpy as np

        def one(t):
            n = np.bincount(np.frombuffer((t or "").lower().encode("utf-8", "replace"), dtype=np.uint8), minlength=256)[97:123].astype(float)
            return n / (np.sqrt((n * n).sum()) or 1.0)

        return col.map(one)

    return encode(text)


def stale(items: DataFrame, stored: DataFrame, encoder: str) -> DataFrame:
    """The items (scope, item_id, text) whose text or encoder differs from what is stored (scope, item_id, content_hash, encoder_id): what has to be encoded."""
    h = items.withColumn("content_hash", F.substr(F.sha2("text", 256), F.lit(1), F.lit(32)))
    return h.join(stored.filter(F.col("encoder_id") == encoder).select("scope", "item_id", "content_hash"), ["scope", "item_id", "content_hash"], "left_anti")


def refresh(items: DataFrame, stored: DataFrame, encoder: str, encode=letter_histogram) -> DataFrame:
    """The stored vectors after a refresh: dead items and other encoders' vectors go, changed and new items are encoded."""
    live = stored.filter(F.col("encoder_id") == encoder).join(items.withColumn("content_hash", F.substr(F.sha2("text", 256), F.lit(1), F.lit(32))).select("scope", "item_id", "content_hash"), ["scope", "item_id", "content_hash"], "left_semi")
    new = stale(items, stored, encoder).select("scope", "item_id", "content_hash", F.lit(encoder).alias("encoder_id"), encode(F.col("text")).alias("vector"))
    return live.select("scope", "item_id", "content_hash", "encoder_id", "vector").unionByName(new)
