"""Rebuilding conversations from message rows.

A message's parent is the message before it in its session: the parent column of ordinal n names n - 1, and ordinal 0 is a
root. Pointer jumping follows the parents of all rows to their roots, and finds rows whose chain of parents breaks off
(orphans) or never ends (circles). Whether turns are answered is decided by a small automaton whose transitions are composed on
the way, so that a row knows the state after everything from its root to itself:

    0 no open user turn    1 in a user turn    2 after a user turn, no answer yet    3 unanswered turn (stays)

Rows are kept in buckets of (session, stretch of BLOCK ordinals), in which the joins of a jump need no shuffle. Pointers that
leave their stretch are resolved among the rows they name, in stretches BLOCK times as long. So a session of any size is
spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import norm_key
from ..session import colocated, joins_in_place, materialise

BLOCK = 4096
# transitions: the states after 0, 1 and 2, two bits each
USER, ASSISTANT, OTHER, BLANK_ROW = 1 | 1 << 2 | 3 << 4, 0, 2 << 2 | 2 << 4, 1 << 2 | 2 << 4
BLANK = "^[\\s\\p{Z}\\u0085\\u180e\\u200b-\\u200f\\u2060-\\u2064\\ufeff]*$"


def blank(text: Column) -> Column:
    """True for null, empty, and texts of white space and zero-width characters only."""
    return text.isNull() | text.rlike(BLANK)


def message_rows(messages: DataFrame, role_names: DataFrame) -> DataFrame:
    """(key, ordinal, role, kind, text, id): roles by their names; a spelling without a name stays, trimmed and in lower case. Rows with a null key belong to no conversation."""
    names = F.broadcast(role_names.select(norm_key("raw_role").alias("_raw"), "role_name").filter("_raw is not null").groupBy("_raw").agg(F.min("role_name").alias("role_name")))  # the table is fixed and small
    m = messages.select(norm_key("session_key").alias("key"), "ordinal", norm_key("role").alias("_raw"), "kind", "text", "id").filter("key is not null")
    return m.join(names, "_raw", "left").select("key", "ordinal", F.coalesce("role_name", "_raw").alias("role"), "kind", "text", "id")


def message_nodes(rows: DataFrame) -> DataFrame:
    """(key, node, parent, own, bad), one row a (session, ordinal): rows equal in ordinal, role, kind and text are one; `bad` says
    that the ordinal is null or has two different rows, `own` is the row's transition."""
    said = F.col("kind") == "message"
    own = F.when(blank(F.col("text")), BLANK_ROW).when(said & (F.col("role") == "user"), USER).when(said & (F.col("role") == "assistant"), ASSISTANT).otherwise(OTHER)
    what = [F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in ("role", "kind", "text")]
    x = rows.select("key", F.col("ordinal").cast("long").alias("node"), own.alias("own"), F.xxhash64(*what).alias("a"), F.xxhash64(F.lit(7), *what[::-1]).alias("b"))
    one = x.groupBy("key", "node").agg(F.max("own").alias("own"), *[f(c).alias(f"{c}{i}") for c in "ab" for i, f in enumerate((F.min, F.max))])
    bad = F.col("node").isNull() | (F.col("a0") != F.col("a1")) | (F.col("b0") != F.col("b1"))
    return one.select("key", "node", F.when(F.col("node") != 0, F.col("node") - 1).alias("parent"), "own", bad.alias("bad"))


def _then(first: str, second: str) -> Column:
    """The transition that runs `first` and then `second`."""
    after = "if((shiftright({f}, {i}) & 3) = 3, 3, shiftright({g}, 2 * (shiftright({f}, {i}) & 3)) & 3)"
    return F.expr(" | ".join(f"shiftleft({after.format(f=first, g=second, i=i)}, {i})" for i in (0, 2, 4))).cast("int")


def resolve(nodes: DataFrame, span: int | None = None) -> DataFrame:
    """Pointer jumping: nodes (key, node long, parent long, own int, further columns) plus depth, run and end.

    `end` is 'root' (then `depth` counts the links to it and `run` is the transition of all rows from the root to the node),
    'orphan' (the chain of parents names a node that isn't there) or 'circle' (it never ends). (key, node) must be unique.
    Each round joins the open rows with the rows their pointers name, within stretches of `span` nodes; rounds grow with the
    logarithm of the longest chain in a stretch, and stretches without open rows drop out. No round sends
    rows through the driver, and one scan reads what all rounds wrote, so that plans don't grow with their number.
    """
    span, spark = span or BLOCK, nodes.sparkSession
    kept = [c for c in nodes.columns if c not in ("key", "node", "parent", "run", "depth", "preset")]
    if "run" not in nodes.columns:
        nodes = nodes.withColumn("run", F.col("own")).withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long")).withColumn("preset", F.lit(None).cast("string"))
    inside = F.coalesce(F.floor(F.col("ptr") / span) == F.col("part"), F.lit(False))
    at_once = F.when(F.col("ptr").isNull(), "root").when(inside, "open").otherwise("away")
    first = nodes.select("key", "node", F.floor(F.col("node") / span).alias("part"), F.col("parent").alias("ptr"), *kept, "run", "depth", "preset")
    state = colocated(first.withColumn("state", F.coalesce("preset", at_once)).drop("preset"), ["key", "part"], "chains")
    n, n_away = state.agg(*[F.count(F.when(F.col("state") == s, 1)) for s in ("open", "away")]).first()
    rounds, before = [], None
    while n and n != before:  # each round ends some chain, if any has an end
        before = n
        with joins_in_place(spark):
            to = state.select("key", "part", F.col("node").alias("at"), *[F.col(c).alias(f"{c}2") for c in ("ptr", "run", "depth", "state")])
            j = state.withColumn("at", F.when(F.col("state") == "open", F.col("ptr"))).join(to.hint("merge"), ["key", "part", "at"], "left")  # a broadcast would go through the driver
            jumped = F.col("state2").isin("root", "open", "away")
            state3 = F.when(F.col("state") != "open", F.col("state")).when(F.col("state2").isNull(), "orphan").when(~jumped, F.col("state2"))
            j = j.select("key", "node", "part", F.when(jumped, F.col("ptr2")).otherwise(F.col("ptr")).alias("ptr"), *kept, F.when(jumped, _then("run2", "run")).otherwise(F.col("run")).alias("run"), (F.col("depth") + F.when(jumped, F.col("depth2")).otherwise(0)).alias("depth"), state3.alias("state"))
            j = j.withColumn("state", F.coalesce("state", at_once)).withColumn("_open", F.max(F.col("state") == "open").over(Window.partitionBy("key", "part")))
            written = colocated(j, ["key", "part"], "chains", moved=False, tally=F.col("state") == "open")
        n = written.tallied
        rounds.append(written)
        state = written.filter("_open").drop("_open")
    done = state
    if rounds:
        done = spark.read.schema(rounds[0].schema).parquet(*[x.made[1] for x in rounds]).filter("not _open").drop("_open")
    if n:
        done = done.unionByName(state.withColumn("state", F.when(F.col("state") == "open", "circle").otherwise(F.col("state"))))
    cols = ["key", "node", *kept, "run", "depth"]
    away = done.filter("state = 'away'")
    if not n_away:  # no row gets away later that wasn't at first
        return done.select(*cols, F.col("state").alias("end"))
    heads = done.join(away.select("key", F.col("ptr").alias("node")).distinct(), ["key", "node"], "left_semi")
    preset = F.when(F.col("state").isin("orphan", "circle"), F.col("state"))
    upper = resolve(heads.select("key", "node", F.when(F.col("state") == "away", F.col("ptr")).alias("parent"), "own", "run", "depth", preset.alias("preset")), span * BLOCK)
    j = away.join(upper.select("key", F.col("node").alias("ptr"), *[F.col(c).alias(f"{c}2") for c in ("run", "depth", "end")]), ["key", "ptr"], "left")
    ok = F.col("end2") == "root"
    over = j.select("key", "node", *kept, F.when(ok, _then("run2", "run")).otherwise(F.col("run")).alias("run"), (F.col("depth") + F.when(ok, F.col("depth2")).otherwise(0)).alias("depth"), F.coalesce("end2", F.lit("orphan")).alias("end"))
    return done.filter("state <> 'away'").select(*cols, F.col("state").alias("end")).unionByName(over)


def chains(messages: DataFrame, role_names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved rows, the keys of rows without an ordinal)."""
    nodes = materialise(message_nodes(message_rows(messages, role_names)), "nodes")
    return resolve(nodes.filter("node is not null")), nodes.filter("node is null").select("key")


def verdicts(messages: DataFrame, sessions: DataFrame, role_names: DataFrame) -> DataFrame:
    """(session_key, reason) of every conversation: reason is null to keep it, else 'empty', 'broken' or 'no_reply'."""
    return _judged(*chains(messages, role_names), sessions)


def _judged(resolved: DataFrame, unplaced: DataFrame, sessions: DataFrame) -> DataFrame:
    """A conversation is whole if all its rows hang on the root, in one chain: as many rows as the deepest one has above it, and itself."""
    rooted = F.col("end") == "root"
    rows = resolved.select("key", (F.col("bad") | ~rooted).alias("bad"), F.when(rooted, F.col("depth")).alias("depth"), "run", "own")
    rows = rows.unionByName(unplaced.select("key", F.lit(True).alias("bad"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("int").alias("run"), F.lit(None).cast("int").alias("own")))
    last = F.max(F.struct("depth", "run"))
    per = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("bad").alias("bad"), last.alias("last"), F.max(F.col("own") == USER).alias("u"), F.max(F.col("own") == ASSISTANT).alias("a"))
    every = sessions.select(norm_key("session_key").alias("key")).filter("key is not null").distinct().join(per, "key", "full_outer")
    broken = F.col("bad") | F.col("last.depth").isNull() | (F.col("last.depth") != F.col("n") - 1)
    unanswered = F.col("last.run").bitwiseAND(3) != 0  # the state after all rows, from state 0
    reason = F.when(F.col("n").isNull(), "empty").when(broken, "broken").when(~F.col("u") | ~F.col("a") | unanswered, "no_reply")
    return every.select(F.col("key").alias("session_key"), reason.alias("reason"))


def conversations(messages: DataFrame, sessions: DataFrame, role_names: DataFrame) -> DataFrame:
    """The kept conversations' paths from root to leaf as rows (session_key, position, role, kind, text), position being the links to the root.

    A row written several times comes once. Rows are not gathered into one value a conversation, as that may be of any size.
    """
    resolved, unplaced = chains(messages, role_names)
    keep = _judged(resolved, unplaced, sessions).filter("reason is null").select(F.col("session_key").alias("key"))
    path = resolved.join(keep, "key", "left_semi").select("key", "node", "depth")
    rows = message_rows(messages, role_names).withColumn("node", F.col("ordinal").cast("long")).groupBy("key", "node").agg(F.min_by(F.struct("role", "kind", "text"), "id").alias("m"))
    return rows.join(path, ["key", "node"]).select(F.col("key").alias("session_key"), F.col("depth").alias("position"), "m.role", "m.kind", "m.text")
