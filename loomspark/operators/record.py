"""Records of memories and sessions: look-ups, snapshots of anchors, whole records, recovery of cut bodies, reach of rules, review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_HITS = 5  # sessions that a prefix finds at most
PARTS, CHANGES = 6, 4  # places and changes that a body names at most
ARCHIVE = ["archive", "archive_only", "archive_version"]


def find_sessions(sessions: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, session_key, how) for identifiers (asked), all looked up at once: by session key; where that finds nothing, by native
    id, source path or live path; where that finds nothing either, the newest PREFIX_HITS whose native id begins with it.

    sessions: session_key, native_id, source_path, live_path, updated_at; one row a key. A null or empty identifier finds nothing.
    """
    a = asked.select("asked").filter("asked is not null and asked <> ''").distinct()
    key = a.join(sessions.select("session_key", F.col("session_key").alias("asked")), "asked").select("asked", "session_key", F.lit("key").alias("how"))
    a = a.join(key.select("asked"), "asked", "left_anti")
    names = sessions.select("session_key", F.explode(F.array_distinct(F.array("native_id", "source_path", "live_path"))).alias("asked")).filter("asked is not null")
    name = a.join(names, "asked").select("asked", "session_key", F.lit("name").alias("how")).distinct()
    rest = a.join(name.select("asked"), "asked", "left_anti")
    lengths = sorted(r[0] for r in rest.select(F.length("asked")).distinct().collect())  # as many as lengths of identifiers
    if not lengths:
        return key.unionByName(name)
    begins = sessions.filter("native_id is not null").select("session_key", "updated_at", F.explode(F.array_distinct(F.array(*[F.substring("native_id", 1, n) for n in lengths]))).alias("asked"))
    hit = rest.join(begins, "asked").withColumn("rn", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc_nulls_last("updated_at"), "session_key")))
    return key.unionByName(name).unionByName(hit.filter(F.col("rn") <= PREFIX_HITS).select("asked", "session_key", F.lit("prefix").alias("how")))


def fetch(messages: DataFrame, found: DataFrame, start: int = 0, limit: int = 200, roles: list[str] | None = None, kinds: list[str] | None = None, max_chars: int = 4_000) -> DataFrame:
    """A page of each session found (session_key): messages from ordinal `start` on, `limit` a session, long texts cut with a note
    of what is missing, and next_ordinal on the last row if more follow."""
    m = messages.filter(F.col("ordinal") >= start).join(found.select("session_key").distinct(), "session_key", "left_semi")
    for col, kept in (("role", roles), ("kind", kinds)):
        m = m.filter(F.col(col).isin(kept)) if kept else m
    w = Window.partitionBy("session_key").orderBy("ordinal", "id")
    page = m.withColumns({"rn": F.row_number().over(w), "after": F.lead("ordinal").over(w)}).filter(F.col("rn") <= limit)
    over = F.length("text") - max_chars
    cut = F.when(over > 0, F.concat(F.substring("text", 1, max_chars), F.lit(" [... "), over, F.lit(" more chars]"))).otherwise(F.col("text"))
    more = F.when((F.col("rn") == limit) & F.col("after").isNotNull(), F.col("ordinal") + 1)
    return page.select("session_key", "ordinal", "role", "kind", cut.alias("text"), more.alias("next_ordinal"))


def of_origin(origin: str) -> Column:
    """'archive' means any archived copy; other values are compared as they are."""
    return F.col("origin").isin(ARCHIVE) if origin == "archive" else F.col("origin") == origin


def in_code_base(folder: str) -> Column:
    """Sessions whose working folder or repository is `folder` or lies below it, whatever the case and slashes."""
    want = folder.replace("\\", "/").rstrip("/").lower()
    out = F.lit(False)
    for c in ("cwd", "repo_root"):
        p = F.lower(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")), "/+$", ""))
        out = out | (p == want) | p.startswith(want + "/")
    return out


def message_time() -> Column:
    """When a message was written: its own time, else its session's last, else its session's first."""
    return F.coalesce("timestamp", "updated_at", "started_at")


def anchor_snapshot(links: DataFrame, symbols: DataFrame, files: DataFrame, commit: Column, at: Column) -> DataFrame:
    """New anchors of memories (memory_id, symbol_id, file_id): of the symbol as it is now if there is one, else of the file, else of the repository."""
    s = symbols.select("symbol_id", F.col("file_id").alias("s_file"), "symbol_path", "line_start", "line_end", "content_fp", "skeleton_fp")
    j = links.join(s, "symbol_id", "left").join(files.select("file_id", F.col("path").alias("file_path")), F.coalesce("s_file", links["file_id"]) == files["file_id"], "left").drop(files["file_id"])
    kind = F.when(F.col("symbol_path").isNotNull(), "symbol").when(F.col("file_path").isNotNull(), "file").otherwise("repo")
    a = j.select("memory_id", kind.alias("target_kind"), "symbol_id", "file_path", "symbol_path", "line_start", "line_end", "content_fp", "skeleton_fp", commit.alias("commit_observed"), F.lit(1.0).alias("confidence"), F.lit("ACTIVE").alias("status"), at.alias("created_at"))
    return a.withColumn("anchor_id", F.concat(F.lit("anc_"), F.substring(F.sha2(F.concat_ws("|", "memory_id", "target_kind", F.coalesce("symbol_id", "file_path", F.lit(""))), 256), 1, 12)))


def whole_record(memories: DataFrame, anchors: DataFrame, edges: DataFrame, versions: DataFrame) -> DataFrame:
    """Each memory with its anchors, edges and versions (newest first) as arrays. Side rows are few a memory; they are gathered per memory, never over all."""
    def side(df, key, cols, name, order=None):
        return df.groupBy(F.col(key).alias("memory_id")).agg(F.sort_array(F.collect_list(F.struct(*cols)), asc=order is None).alias(name))

    out = memories
    for s in (side(anchors, "memory_id", ["anchor_id", "target_kind", "symbol_path", "file_path", "status", "confidence"], "anchors"), side(edges, "from_id", ["kind", "to_id", "confidence", "status"], "edges"), side(versions, "memory_id", ["version", "changed_at", "reason"], "versions", "newest first")):
        out = out.join(s, "memory_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("anchors", "edges", "versions")})


def recovered(memories: DataFrame, events: DataFrame, anchors: DataFrame) -> DataFrame:
    """(memory_id, stored_chars, rebuilt_chars, body): bodies that were cut off (they end with ...) and come out longer when composed
    anew from their event: claim, occasion, reasoning, changes, and what the anchors name. A part that the claim says already is left out.

    memories: memory_id, body, status, event_id; events: event_id, summary, payload (JSON with reasoning and changes); anchors:
    memory_id, at (order), symbol_path, file_path.
    """
    m = memories.filter("status = 'ACTIVE'").filter(F.col("body").endswith("..."))
    where = anchors.select("memory_id", "at", F.coalesce(F.nullif("symbol_path", F.lit("")), "file_path").alias("label")).filter("label is not null").groupBy("memory_id", "label").agg(F.min("at").alias("at"))
    where = where.withColumn("rn", F.row_number().over(Window.partitionBy("memory_id").orderBy("at", "label"))).filter(F.col("rn") <= PARTS).groupBy("memory_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "label"))), lambda x: x["label"]), ", ").alias("where_"))
    j = m.join(events, "event_id").filter(F.try_parse_json("payload").isNotNull()).join(where, "memory_id", "left")
    claim = F.trim(F.substring_index("body", "\n\n", 1))
    said = lambda label, text: F.when((F.coalesce(text, F.lit("")) != "") & ~F.contains(F.lower("_claim"), F.lower(F.coalesce(text, F.lit("")))), F.concat(F.lit(label), text))
    changes = F.array_join(F.slice(F.filter(F.coalesce(F.from_json(F.get_json_object("payload", "$.changes"), "array<string>"), F.array().cast("array<string>")), lambda x: x != ""), 1, CHANGES), "; ")
    j = j.withColumns({"_claim": F.trim(F.regexp_replace(claim, r"\.\.\.$", ""))})
    j = j.withColumn("rebuilt", F.concat_ws("\n\n", "_claim", said("Recorded while: ", F.col("summary")), said("Why: ", F.trim(F.get_json_object("payload", "$.reasoning"))), F.when(changes != "", F.concat(F.lit("Changed: "), changes)), F.concat(F.lit("Applies to: "), F.col("where_"))))
    return j.filter((F.col("_claim") != "") & (F.length("rebuilt") > F.length("body"))).select("memory_id", F.length("body").cast("long").alias("stored_chars"), F.length("rebuilt").cast("long").alias("rebuilt_chars"), F.col("rebuilt").alias("body"))


def rule_scope(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """(memory_id, n_files, n_callers, all_active): what a rule reaches: the files it is anchored in and the different callers of its symbols."""
    calls = anchors.select("memory_id", "symbol_id").distinct().join(edges.select(F.col("to_id").alias("symbol_id"), "from_id"), "symbol_id").groupBy("memory_id").agg(F.count_distinct("from_id").alias("n_callers"))
    own = anchors.groupBy("memory_id").agg(F.count_distinct("file_path").alias("n_files"), F.min(F.col("status") == "ACTIVE").alias("all_active"))
    return own.join(calls, "memory_id", "left").select("memory_id", "n_files", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), "all_active")


def review_queue(memories: DataFrame, parents: DataFrame, limit: int = 30) -> DataFrame:
    """The inferences that wait for a decision, those with the most parents and then the newest first, `limit` of them."""
    n = parents.groupBy("memory_id").agg(F.count_distinct("to_id").alias("n_parents"))
    m = memories.filter("status = 'ACTIVE' and inferred and review is null").join(n, "memory_id", "left")
    return m.withColumn("n_parents", F.coalesce("n_parents", F.lit(0))).orderBy(F.desc("n_parents"), F.desc_nulls_last("created_at"), "memory_id").limit(limit)


def touched_identifiers(patches: DataFrame) -> DataFrame:
    """(patch_id, path, name): the identifiers on the changed lines and hunk headers of unified diffs (patch_id, patch), by the new path of their file."""
    line = patches.select("patch_id", F.posexplode(F.split("patch", "\r?\n")).alias("at", "line"))
    head = F.when(F.col("line").startswith("+++ "), F.coalesce(F.nullif(F.regexp_extract(F.trim("line"), r"^\+\+\+ b/(.*)$", 1), F.lit("")), F.lit("/")))
    w = Window.partitionBy("patch_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    x = line.withColumn("path", F.last(head, ignorenulls=True).over(w)).filter("path is not null and path <> '/'")
    hunk, changed = F.col("line").startswith("@@"), F.col("line").rlike("^[+-]") & ~F.col("line").rlike(r"^(\+\+\+|---)")
    text = F.when(hunk, F.regexp_replace("line", "^@@.*?@@", "")).when(changed, F.expr("substring(line, 2)"))
    return x.select("patch_id", "path", F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)).alias("name")).distinct()


def touched_symbols(identifiers: DataFrame, symbols: DataFrame, cap: int = 12) -> DataFrame:
    """(patch_id, symbol_id, symbol_path): the symbols that a diff names in the files it changes, the first `cap` by path and line."""
    j = identifiers.join(symbols.filter("status = 'ACTIVE'").select("path", "name", "symbol_id", "symbol_path", "line_start"), ["path", "name"])
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("patch_id").orderBy("path", "line_start", "symbol_id"))).filter(F.col("rn") <= cap).select("patch_id", "symbol_id", "symbol_path")


def workspace_map(files: DataFrame) -> DataFrame:
    """(workspace_id, folder) from workspace files (path, content): the id is the folder the file lies in, the folder a file URI in its JSON."""
    uri = F.coalesce(F.get_json_object("content", "$.folder"), F.get_json_object("content", "$.workspace"), F.get_json_object("content", "$.configuration"))
    plain = F.try_url_decode(F.replace(F.regexp_replace(uri, r"^file://", ""), F.lit("+"), F.lit("%2B")))
    return files.select(F.element_at(F.split("path", "/"), -2).alias("workspace_id"), F.regexp_replace(plain, r"^/([A-Za-z]:)", "$1").alias("folder")).filter("folder is not null").groupBy("workspace_id").agg(F.max("folder").alias("folder"))
