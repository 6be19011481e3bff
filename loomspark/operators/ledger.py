"""Processing only new or changed records: a ledger of work items with leases and fencing tokens.

An item is (key, version). Each run takes the items it sees whose version differs from the last one done, under its token,
which must be higher than any before. A lease lasts until its time is up; then the item is pending again. Only the holder
of a live lease can turn it into done: a writer whose lease ran out or went to another token is rejected. What a run took
is written to a path made of its token alone, so a retry overwrites what its first attempt wrote; results are read from
the tokens that committed.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import colocated, drop_materialised, shared_dir

ITEM = "key string, version string, done_version string, state string, token long, until timestamp"
_COLS = ["key", "version", "done_version", "state", "token", "until"]


def counting_rows(seen: DataFrame, key: str, run: str, state: list[str], status: str, at: str) -> DataFrame:
    """One row a (key, run): of several sightings the one with the latest `at`; equal ones are told apart by all columns.

    A null `at` counts as earliest. Sightings are combined before they are shuffled, so a key seen very often costs one row
    a task and run.
    """
    cols = [c for c in dict.fromkeys([*state, status])]
    part = seen.select(key, run, at, *cols).filter(F.col(key).isNotNull() & F.col(run).isNotNull())
    best = part.groupBy(key, run).agg(F.max(F.struct(at, *cols)).alias("_r"))
    return best.select(key, run, *[F.col(f"_r.{c}").alias(c) for c in cols])


class Ledger:
    """A ledger kept as a table in buckets of the key: each step writes a new generation, and the newest committed one holds.

    `root` is a folder all executors share. Below it: `grants/<token>` (a token that was given out), `g<n>` (the name of
    generation n's table), `out/<token>` (what the token took) and `commits/<token>`. Grants, generations and commits are
    files that only one writer can create, so of two writers on one generation the second is rejected. The two newest
    generations are kept. Items: (key string, version string, done_version string, state, token long, until timestamp).
    """

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for d in ("grants", "commits", "out", "tables"):
            self._fs.mkdirs(self._path(f"{self.root}/{d}"))
        self._tables: dict[int, DataFrame] = {}

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}".rstrip("/")))]

    def _create(self, name: str, text: str) -> bool:
        """Create a small file; false if it was there already."""
        try:
            out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        except Exception:  # py4j wraps FileAlreadyExistsException
            if self._fs.exists(self._path(f"{self.root}/{name}")):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, name: str) -> str:
        p = self._path(f"{self.root}/{name}")
        into = self._fs.open(p)
        try:
            return bytes(into.readAllBytes()).decode()
        finally:
            into.close()

    def _newest(self) -> int:
        return max((int(n[1:]) for n in self._names("") if n[0] == "g" and n[1:].isdigit()), default=0)

    def items(self) -> DataFrame:
        n = self._newest()
        if n in self._tables:
            return self._tables[n]
        if not n:
            return self.spark.createDataFrame([], ITEM)
        return self.spark.read.schema(ITEM).parquet(f"{self.root}/tables/{self._read(f'g{n}')}")

    def _write(self, df: DataFrame, base: int, moved: bool = False) -> None:
        """Write generation base + 1. Two writers on the same base make tables of their own, and only the first to commit holds."""
        t = colocated(df.select(*_COLS), ["key"], "gen", moved=moved, folder=f"{self.root}/tables")
        if not self._create(f"g{base + 1}", t.made[1].rsplit("/", 1)[1]):
            drop_materialised(t)
            raise RuntimeError(f"generation {base + 1} exists: another writer was first")
        self._tables[base + 1] = t
        old = self._tables.pop(base - 1, None)
        if old is not None:
            drop_materialised(old)
            self._fs.delete(self._path(f"{self.root}/g{base - 1}"), False)

    def _merge(self, seen: DataFrame | None):
        """Items joined with what is seen; (frame, is there a seen version that is not the one done, its version)."""
        items = self.items()
        if seen is None:
            return items.withColumn("seen", F.lit(None).cast("string")).withColumn("is_seen", F.lit(None).cast("boolean"))
        s = seen.select(F.col("key").cast("string"), F.col("version").cast("string").alias("seen"))
        return items.join(s.withColumn("is_seen", F.lit(True)), "key", "full_outer")

    def observe(self, seen: DataFrame) -> None:
        """Merge (key, version) of what is there now: new or changed items become pending, unless they are leased for that
        version; an item that is back at the version done is done. Of several versions of a key the highest counts."""
        base = self._newest()
        s = seen.select(F.col("key").cast("string"), F.col("version").cast("string")).groupBy("key").agg(F.max(F.struct("version")).alias("s")).select("key", "s.version")
        j = self._merge(s)
        fresh = F.col("is_seen").isNotNull() & (F.col("state").isNull() | ~F.col("seen").eqNullSafe(F.col("version")))
        back = fresh & F.col("seen").eqNullSafe(F.col("done_version")) & F.col("done_version").isNotNull()
        state = F.when(back, "done").when(fresh, "pending").otherwise(F.col("state"))
        self._write(j.select("key", F.when(fresh, F.col("seen")).otherwise(F.col("version")).alias("version"), "done_version", state.alias("state"), F.when(~fresh, F.col("token")).alias("token"), F.when(~fresh, F.col("until")).alias("until")), base, moved=True)

    def grants(self) -> dict[int, dt.datetime]:
        """token -> until when its leases last."""
        return {int(n): dt.datetime.fromisoformat(self._read(f"grants/{n}")) for n in self._names("grants") if n.isdigit()}

    def lease(self, token: int, now: dt.datetime, seconds: float, seen: DataFrame | None = None) -> DataFrame:
        """Lease items under `token`, which must be higher than any before, until `now` + `seconds`; returns them with their output path.

        Without `seen` all pending items are taken, and those whose lease has run out. With `seen` (key, version; one row a
        key, in buckets of the key) the run observes and takes at once, and only what it sees and isn't done at that version.
        """
        top = max(self.grants(), default=None)
        until = now + dt.timedelta(seconds=seconds)
        if top is not None and token <= top or not self._create(f"grants/{token}", until.isoformat()):
            raise ValueError(f"token {token} is stale: {top} was given out")
        base, at = self._newest(), F.lit(now).cast("timestamp")
        j = self._merge(seen)
        live = F.coalesce((F.col("state") == "leased") & (F.col("until") > at), F.lit(False))
        if seen is None:
            new, back = F.lit(False), F.lit(False)
            take = (F.col("state") == "pending") | ((F.col("state") == "leased") & ~live)
        else:
            new = F.col("is_seen").isNotNull() & ~(live & F.col("seen").eqNullSafe(F.col("version")))
            back = new & F.col("done_version").isNotNull() & F.col("seen").eqNullSafe(F.col("done_version"))
            take = new & ~back
        state = F.when(back, "done").when(take, "leased").otherwise(F.col("state"))
        held = F.when(take, F.lit(token).cast("long")).when(~back, F.col("token"))
        limit = F.when(take, F.lit(until).cast("timestamp")).when(~back, F.col("until"))
        self._write(j.select("key", F.when(new, F.col("seen")).otherwise(F.col("version")).alias("version"), "done_version", state.alias("state"), held.alias("token"), limit.alias("until")), base, moved=base == 0)
        mine = self.items().filter((F.col("state") == "leased") & (F.col("token") == token))
        mine.select("key", "version").write.mode("overwrite").parquet(f"{self.root}/out/{token}")
        return mine.withColumn("output", F.concat_ws("/", F.lit(self.root), F.lit("out"), F.sha2("key", 256), F.col("token")))

    def complete(self, token: int, finished: DataFrame, now: dt.datetime | None = None) -> int:
        """Turn the leases on (key) of `finished` held under `token` into done, and commit the token; returns how many were accepted.

        Rows whose lease went to another token are rejected, and so is the whole writer if its leases' time is up at `now`
        (without `now` time isn't looked at). Leases of a committed token that it doesn't finish are pending again.
        """
        until = self.grants().get(token)
        if until is None or (now is not None and now >= until):
            return 0
        base, held = self._newest(), (F.col("state") == "done") & (F.col("token") == token)
        before = self.items().filter(held).count()
        f = finished.select(F.col("key").cast("string"), F.lit(True).alias("fin"))
        j = self.items().join(f.dropDuplicates(["key"]), "key", "left")
        mine = (F.col("state") == "leased") & (F.col("token") == token)
        ok = F.coalesce(mine & F.col("fin"), F.lit(False))
        self._write(j.select("key", "version", F.when(ok, F.col("version")).otherwise(F.col("done_version")).alias("done_version"), F.when(ok, "done").when(mine & F.lit(now is not None), "pending").otherwise(F.col("state")).alias("state"), "token", F.when(~ok, F.col("until")).alias("until")), base)
        n = self.items().filter(held).count() - before
        if n or now is not None:
            self._create(f"commits/{token}", "")
        return n

    def taken(self, committed: bool = True) -> DataFrame:
        """(token, key, version) of what the runs took, read from the tokens' paths; by default only tokens that committed."""
        tokens = {int(n) for n in self._names("out") if n.isdigit()} & ({int(n) for n in self._names("commits")} if committed else set(self.grants()))
        out = None
        for t in sorted(tokens):
            one = self.spark.read.schema("key string, version string").parquet(f"{self.root}/out/{t}").select(F.lit(t).cast("long").alias("token"), "key", "version")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "token long, key string, version string")


def work_off(seen: DataFrame, runs: DataFrame, key: str, run: str, state: list[str], status: str, at: str, failed: str = "error", started: str = "started_at") -> tuple[Ledger, DataFrame]:
    """Send all runs through a ledger, one after the other; returns it and the counting rows (key, run, state columns, status).

    A run takes what it sees and what isn't done at that state, null being equal to null. Its leases last until the next run
    starts (runs without a time start a second after the one before). A run with outcome 'ok' commits the items that did not
    fail. The writer of any other run comes when the next one has started, and is rejected. Runs without a row in `runs`
    count as not ended well. `runs` is small; the steps are as many as runs.
    """
    spark = seen.sparkSession
    rows = counting_rows(seen, key, run, state, status, at)
    version = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in state])
    rows = colocated(rows.withColumn("_key", F.col(key).cast("string")).withColumn("_version", version).withColumn("_run", F.col(run).cast("long")), ["_key"], "sightings", split="_run")
    has_start = started in runs.columns
    known: dict[int, list] = {}
    for r in runs.select(F.col(run).cast("long"), "outcome", *([started] if has_start else [])).filter(F.col(run).isNotNull()).collect():
        x = known.setdefault(r[0], [False, None])
        x[0], x[1] = x[0] or r[1] == "ok", x[1] or (r[2] if has_start and isinstance(r[2], dt.datetime) else None)
    for r in rows.select("_run").distinct().collect():
        known.setdefault(r[0], [False, None])
    led, clock, late, order = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"), dt.datetime(1970, 1, 1), None, sorted(known)
    starts = []
    for r in order:
        clock = max(known[r][1] or clock, clock + dt.timedelta(seconds=1))
        starts.append(clock)
    for i, r in enumerate(order):
        now, then = starts[i], starts[i + 1] if i + 1 < len(order) else starts[i] + dt.timedelta(days=1)
        mine = rows.filter(F.col("_run") == r).select(F.col("_key").alias("key"), F.col("_version").alias("version"), F.col(status).alias("_status"))
        led.lease(r, now, (then - now).total_seconds(), mine)
        if late is not None and led.complete(*late, now) != 0:
            raise AssertionError("a stale writer was accepted")
        fine = mine.filter(~F.coalesce(F.col("_status") == failed, F.lit(False)))
        if known[r][0]:
            led.complete(r, fine, now)
        late = None if known[r][0] else (r, fine)
    return led, rows


def replay(seen: DataFrame, runs: DataFrame, key: str, run: str, state: list[str], status: str, at: str, failed: str = "error") -> DataFrame:
    """The history of a ledger that all runs went through: per key and run the lease, its token and how it ended.

    Columns: key, run, state columns, lease ('leased' or 'skipped'), token, ended ('done', 'expired' or 'pending'), accepted.
    'skipped': the state equals the last one done. 'expired': the run didn't commit. 'pending': it did, but the item failed.
    """
    led, rows = work_off(seen, runs, key, run, state, status, at, failed)
    took = led.taken(committed=False).select(F.col("token").alias("_run"), F.col("key").alias("_key"), F.lit(True).alias("_took"))
    commits = [int(n) for n in led._names("commits")]
    accepted = F.col("_run").isin(commits) if commits else F.lit(False)
    ended = F.when(~accepted, "expired").when(F.coalesce(F.col(status) == failed, F.lit(False)), "pending").otherwise("done")
    j = rows.join(took, ["_run", "_key"], "left")
    return j.select(key, run, *state, F.when(F.col("_took"), "leased").otherwise("skipped").alias("lease"), F.col("_run").alias("token"), ended.alias("ended"), accepted.alias("accepted"))


def new_or_changed(history: DataFrame, key: str, run: str) -> DataFrame:
    """What the runs that ended well leased: the items that were new or changed for them."""
    return history.filter("accepted and lease = 'leased'").select(run, key)
