"""Parent-child links to full hierarchies, in a number of rounds that grows with the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..session import colocated, drop_materialised
from .scale import look_up, running_total

RADIX, LEVELS = 16, 4  # blocks of 1, 16, 256 and 4096 places


def read_links(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent, orphan): one row a key in normal form.

    Rows with a null or empty id are no nodes. Repeated rows count once; if they name several parents, the last in
    string order holds. A null, empty or unknown parent makes a root; `orphan` says that an unknown one was named.
    """
    links = df.select(norm_key(id_col).alias("id"), F.nullif(norm_key(parent_col), F.lit("")).alias("parent"))
    nodes = links.filter(F.col("id") != "").groupBy("id").agg(F.max("parent").alias("parent"))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    out = nodes.join(known, "parent", "left")
    return out.select("id", F.when(F.col("known"), F.col("parent")).alias("parent"), (F.col("parent").isNotNull() & F.col("known").isNull()).alias("orphan"))


def _jump(state: DataFrame, take: list[str], n: int) -> DataFrame:
    """(id, columns of `take` with a 2) of the rows that the pointers `anc` of the open rows name. Every pointer names a row."""
    to = state.select(F.col("id").alias("anc"), *[F.col(c).alias(f"{c}2") for c in take])
    return look_up(state.filter("anc is not null").select("id", "anc"), to, "anc", n=n).drop("anc")


def subtree_sizes(links: DataFrame) -> DataFrame:
    """Upward pass: adds root, depth and size (of the subtree with its top); nodes left over are on or below a circle.

    After round k a node knows its ancestor 2^k links up (`anc`, null beyond the root) and the number of nodes less
    than 2^k links below it. A round in which no further node reaches its root leaves only circles and what hangs
    below them: those keep an `anc` and get in_cycle. Nodes stay in buckets of their id; only the pointers of open nodes, and
    what they name, are shuffled.
    """
    state = colocated(links.select("id", "parent", "orphan", F.col("parent").alias("anc"), F.coalesce("parent", "id").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("size")), ["id"], "links")
    open_before, still = None, state.filter(F.col("anc").isNotNull()).count()
    while still and still != open_before:
        open_before = still
        below = state.filter(F.col("anc").isNotNull()).groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("below"))
        moved = _jump(state, ["anc", "root", "depth"], still)
        jumped = state.join(moved, "id", "left").join(below, "id", "left").select(
            "id", "parent", "orphan", F.col("anc2").alias("anc"), F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("size") + F.coalesce("below", F.lit(0))).alias("size"),
        )
        last, state = state, colocated(jumped, ["id"], "links", moved=False, tally=F.col("anc").isNotNull())
        still = state.tallied
        drop_materialised(last)
    bad = F.col("anc").isNotNull()
    return state.select("id", "parent", "orphan", *[F.when(~bad, F.col(c)).alias(c) for c in ("root", "depth", "size")], bad.alias("in_cycle"))


def nested_sets(sized: DataFrame) -> DataFrame:
    """Downward pass: adds path (ids from the root, joined by '/') and the preorder range [lft, rgt] within the root.

    A node's children share its range by a prefix sum over their sizes; a node's place is then the sum of the shares on
    its way from the root, again by doubling. u is a descendant of v if roots are equal and v.lft < u.lft <= v.rgt.
    Nodes with in_cycle have none of these.
    """
    tree = sized.filter(~F.col("in_cycle"))
    shares = running_total(tree.filter(F.col("parent").isNotNull()).select("id", "parent", "size"), ["parent"], "id", F.col("size"), "before").select("id", (F.col("before") + 1).alias("lft"))
    state = colocated(tree.join(shares, "id", "left").select(*tree.columns, F.coalesce("lft", F.lit(0)).alias("lft"), F.col("id").alias("path"), F.col("parent").alias("anc")), ["id"], "nested")
    still = state.filter(F.col("anc").isNotNull()).count()
    while still:
        jumped = state.join(_jump(state, ["anc", "lft", "path"], still), "id", "left").select(
            *tree.columns, (F.col("lft") + F.coalesce("lft2", F.lit(0))).alias("lft"), F.when(F.col("path2").isNull(), F.col("path")).otherwise(F.concat_ws("/", "path2", "path")).alias("path"), F.col("anc2").alias("anc"),
        )
        last, state = state, colocated(jumped, ["id"], "nested", moved=False, tally=F.col("anc").isNotNull())
        still = state.tallied
        drop_materialised(last)
    done = state.drop("anc").withColumn("rgt", F.col("lft") + F.col("size") - 1)
    rest = sized.filter("in_cycle")
    return done.unionByName(rest, allowMissingColumns=True)


def hierarchy(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    return nested_sets(subtree_sizes(read_links(df, id_col, parent_col)))


def _cover(first: Column, end: Column) -> Column:
    """The places [first, end) as (level, block) pairs, each block being RADIX^level places that begin at a multiple of it; the
    blocks don't overlap, and only on the top level are there more than 2 x (RADIX - 1) of them."""
    pieces, go = [], F.lit(True)
    span = lambda on, a, b, level: F.when(on & (a < b), F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
    a, e = first.cast("long"), end.cast("long")
    for level in range(LEVELS - 1):
        up, down = F.ceil(a / RADIX).cast("long"), F.floor(e / RADIX).cast("long")
        split = go & (up < down)
        pieces += [span(split, a, up * RADIX, level), span(split, down * RADIX, e, level), span(go & ~split, a, e, level)]
        a, e, go = F.when(split, up).otherwise(0).cast("long"), F.when(split, down).otherwise(0).cast("long"), split
    return F.concat(*pieces, span(go, a, e, LEVELS - 1))


def closure(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every pair, by the nested sets: u is below v if v.lft < u.lft <= v.rgt under one root.

    The range join is an equi-join: v's range is cut into aligned blocks of RADIX^level places, and u names the block it lies
    in on each level, so every pair meets exactly once. A block has RADIX^(LEVELS - 1) places at most, so no tree, however
    large, has its pairs in one task.
    """
    t = tree.filter(~F.col("in_cycle")).select("id", "root", "depth", "lft", "rgt")
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("lft") / RADIX**k).cast("long").alias("block")) for k in range(LEVELS)]))
    lower = t.filter("lft > 0").select(F.col("id").alias("descendant"), "root", F.col("depth").alias("depth2"), at.alias("_b")).select("descendant", "root", "depth2", "_b.level", "_b.block")
    upper = t.filter("rgt > lft").select(F.col("id").alias("ancestor"), "root", "depth", F.explode(_cover(F.col("lft") + 1, F.col("rgt") + 1)).alias("_b")).select("ancestor", "root", "depth", "_b.level", "_b.block")
    return lower.join(upper, ["root", "level", "block"]).select("ancestor", "descendant", (F.col("depth2") - F.col("depth")).alias("distance"))
