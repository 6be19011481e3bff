"""What readers see: memories narrowed to what they are about, sorts, visible subgraphs, sections of bodies, titles, coverage, siblings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of severities and kinds in a reader's order, and the marks that begin a body's sections.
SEVERITIES = ["critical", "high", "medium", "low"]
KINDS = ["security", "invariant", "warning", "contract", "failed_attempt", "bug_history", "fix_history", "decision", "performance", "migration", "convention", "test_evidence", "rationale"]
SECTIONS = ["Recorded while: ", "Why: ", "Changed: ", "Applies to: "]


def displayed(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """The edges (memory_id, symbol_id, kind, file_path, symbol_path, evidence) that a reader is shown.

    focus: memory_id, path (a file or symbol path that the memory is about); memories without a focus are shown everywhere.
    Others are shown where an APPLIES_TO edge leads into their focus, and on derived edges whose evidence names no target or
    one within it.
    """
    own = focus.filter("path is not null").groupBy("memory_id").agg(F.collect_set("path").alias("_focus"))  # a claim names few paths
    target = F.get_json_object("evidence", "$.target")
    within = lambda c: F.coalesce(F.array_contains("_focus", c), F.lit(False))
    shown = F.col("_focus").isNull() | F.when(F.col("kind") == "APPLIES_TO", within(F.col("file_path")) | within(F.col("symbol_path"))).otherwise(target.isNull() | within(target))
    return edges.join(own, "memory_id", "left").filter(shown).drop("_focus")


def reader_order(how: str) -> list[Column]:
    """The order of a reader's list: 'severity', 'kind', 'recent', 'oldest' or 'longest'; ties by title and id. Unknown severities and kinds come last."""
    place = lambda names, c: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c)), F.lit(0)), F.lit(len(names) + 1))
    first = {"severity": [place(SEVERITIES, "severity")], "kind": [place(KINDS, "kind")], "recent": [F.desc_nulls_last("updated_at")], "oldest": [F.asc_nulls_last("updated_at")], "longest": [F.desc(F.length("body"))]}[how]
    return [*first, F.col("title"), F.col("memory_id")]


def visible(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, statuses: list[str] | None = None, scope: DataFrame | None = None, text: str = "") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that filters, scope (id) and a search text leave: edges stay if both of their ends do."""
    n = nodes
    for col, kept in (("kind", kinds), ("status", statuses)):
        n = n.filter(F.col(col).isin(kept)) if kept else n
    if scope is not None:
        n = n.join(scope.select("id").distinct(), "id", "left_semi")
    if text:
        n = n.filter(F.lower("label").contains(text.lower()) | F.lower(F.coalesce("body", F.lit(""))).contains(text.lower()))
    ends = n.select("id")
    return n, edges.join(ends.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ends.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)


def sections(body: Column) -> Column:
    """A body in parts: array of (label, text) in the order in which they stand in it, the claim first with an empty label. Empty parts are left out."""
    blank = F.lit(" \t\r\n")
    t = F.trim(F.coalesce(body, F.lit("")), blank)
    at = F.array_sort(F.filter(F.array(F.struct(F.lit(1).alias("at"), F.lit("").alias("mark")), *[F.struct(F.locate(m, t).alias("at"), F.lit(m).alias("mark")) for m in SECTIONS]), lambda x: x["at"] > 0))
    ends = F.concat(F.transform(F.slice(at, 2, 99), lambda x: x["at"]), F.array(F.length(t) + 1))
    cut = F.zip_with(at, ends, lambda x, e: F.struct(F.trim(F.regexp_replace(x["mark"], ": $", "")).alias("label"), F.trim(F.substr(t, x["at"] + F.length(x["mark"]), F.greatest(F.lit(0), e - x["at"] - F.length(x["mark"]))), blank).alias("text")))
    return F.filter(cut, lambda x: x["text"] != "")


def highlighted(text: Column, query: str) -> Column:
    """The text for a page: escaped, with every place that matches the query, whatever its case, within <mark>."""
    safe = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        safe, query = F.replace(safe, F.lit(a), F.lit(b)), query.replace(a, b)
    pattern = "".join("\\" + c if not c.isalnum() and c != " " else c for c in query)
    return F.regexp_replace(safe, f"(?i)({pattern})", "<mark>$1</mark>") if query else safe


def picked(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row (value): the value at a share of the rows in ascending order, a real one, never between two."""
    return df.agg(F.expr(f"percentile_disc({share}) within group (order by {value})").alias("value"))


def default_seed(nodes: DataFrame) -> DataFrame:
    """The node (id) a view begins with: of the entry points that are no tests the one of middle degree, else the symbol at three quarters of the degrees."""
    from .scale import numbered

    entries = nodes.filter("entry_point is not null and entry_point <> 'test'")
    n = entries.count()
    base, share, order = (entries, 0.5, ["degree", "label", "id"]) if n else (nodes.filter("kind = 'symbol'"), 0.75, ["degree", "id"])
    n = n or base.count()
    return numbered(base, [F.col(c) for c in order], "_at").filter(F.col("_at") == int(n * share)).select("id")


def with_titles(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Sessions with a title: their own, else the last that the title log (line, at) has for their native id; stars and blanks around it go."""
    line = titles.select("at", F.try_parse_json("line").alias("j")).select("at", F.try_variant_get("j", "$.id", "string").alias("native_id"), F.try_variant_get("j", "$.thread_name", "string").alias("t"))
    last = line.filter("native_id <> '' and t <> ''").groupBy("native_id").agg(F.max(F.struct("at", "t")).alias("m")).select("native_id", F.trim(F.trim("m.t", F.lit("* "))).alias("_title"))
    return sessions.join(last, "native_id", "left").withColumn("title", F.coalesce("title", "_title")).drop("_title")


def first_sentence(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^(.+?[.!?])(\s|$)", 1), F.lit("")), F.trim(text))


def as_list(value: Column) -> Column:
    """A JSON value as a list of texts: null and blanks give none, a scalar one."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    items = F.when(kind.startswith("ARRAY"), F.transform(v.cast("array<variant>"), lambda x: F.when(F.schema_of_variant(x) != "VOID", F.coalesce(x.try_cast("string"), F.to_json(x))))).when(v.isNotNull() & (kind != "VOID"), F.array(F.coalesce(v.try_cast("string"), F.to_json(v))))
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.trim(x) != ""))


def coverage(commits: DataFrame, indexed: DataFrame, bulk: int = 40) -> DataFrame:
    """One row on what an answer from history rests on: commits (sha, path) read, considered, left out for more than `bulk` files, and the
    files of them that are indexed (path). It is a lower bound whatever the numbers: what was not committed is not seen."""
    size = commits.groupBy("sha").agg(F.count_distinct("path").alias("k"))
    per = size.agg(F.count(F.lit(1)).alias("commits_read"), F.sum((F.col("k") <= bulk).cast("long")).alias("commits_considered"), F.sum((F.col("k") > bulk).cast("long")).alias("bulk_commits_excluded"))
    known = commits.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).distinct()
    seen = known.join(indexed.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).distinct(), "path", "left_semi").agg(F.count(F.lit(1)).alias("indexed_paths"))
    return per.crossJoin(F.broadcast(seen)).select(F.lit("lower-bound").alias("epistemic"), "commits_read", F.coalesce("commits_considered", F.lit(0)).alias("commits_considered"), F.coalesce("bulk_commits_excluded", F.lit(0)).alias("bulk_commits_excluded"), "indexed_paths")  # one row each


def rename_evidence(pairs: DataFrame, renames: DataFrame) -> DataFrame:
    """Pairs (old_path, new_path) with `moved`: whether the log has that rename (from_path, to_path), at once or over steps in one file's line of names.

    Null and equal paths are no move.
    """
    direct = renames.select(F.col("from_path").alias("old_path"), F.col("to_path").alias("new_path"), F.lit(True).alias("_m")).distinct()
    two = renames.alias("a").join(renames.alias("b"), F.col("a.to_path") == F.col("b.from_path")).select(F.col("a.from_path").alias("old_path"), F.col("b.to_path").alias("new_path"), F.lit(True).alias("_m"))
    return pairs.join(direct.unionByName(two).distinct(), ["old_path", "new_path"], "left").select(*pairs.columns, (F.coalesce("_m", F.lit(False)) & (F.col("old_path") != F.col("new_path"))).alias("moved"))


def repo_config(text: str | None) -> dict:
    """The settings of a repository's TOML file; unreadable text has none. A driver-side dimension of one row."""
    import tomllib

    try:
        return tomllib.loads(text or "")
    except ValueError:
        return {}


def named_siblings(query: str, roots: DataFrame, here: str) -> DataFrame:
    """The other roots (root, name) that a query names by a whole word, the longest names first."""
    words = [w for w in "".join(c if c.isalnum() or c in "-_." else " " for c in query.lower()).split() if w]
    hit = roots.filter((F.col("root") != here) & F.lower("name").isin(words or [""]))
    return hit.orderBy(F.desc(F.length("name")), "name")


def answers(saved: DataFrame, snippets: int = 3, chars: int = 900) -> DataFrame:
    """Papers from saved search answers (answer, a JSON list or an object with one): (rank, paper_id, title, abstract, snippets).

    Ids go without their version; an abstract is cut at `chars` characters, a paper has `snippets` snippets at most; an answer that
    can't be read gives none, and a paper counts once an answer.
    """
    schema = "answer_id string, rank int, paper_id string, title string, abstract string, snippets array<string>"

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for aid, text in b.itertuples(index=False, name=None):
                try:
                    v = json.loads(text) if isinstance(text, str) else None
                except ValueError:
                    continue
                rows = v if isinstance(v, list) else next((v[k] for k in ("data", "papers", "results") if isinstance(v.get(k), list)), []) if isinstance(v, dict) else []
                known = set()
                for x in (r for r in rows if isinstance(r, dict)):
                    pid = str(x.get("universal_paper_id") or x.get("paper_id") or x.get("link", "").rsplit("/", 1)[-1] or "")
                    head, v_, n = pid.rpartition("v")
                    pid = head if v_ and n.isdigit() and head else pid
                    if not pid or pid in known:
                        continue
                    known.add(pid)
                    said = [s.get("snippet") if isinstance(s, dict) else s for s in x.get("snippets") or []]
                    out.append((aid, len(known), pid, x.get("title"), (x.get("abstract") or "")[:chars] or None, [str(s) for s in said if s][:snippets]))
            if out:
                yield pd.DataFrame(out, columns=["answer_id", "rank", "paper_id", "title", "abstract", "snippets"])

    return saved.select("answer_id", "answer").mapInPandas(run, schema)


def status(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, n): how many rows each part of a workspace has. A part that can't be read has null and breaks nothing."""
    out = None
    for name, df in sorted(parts.items()):
        try:
            one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
            one.schema
        except Exception:  # a side that is missing must not stop the others
            continue
        out = one if out is None else out.unionByName(one)
    return out


def by_rank(df: DataFrame, how: str) -> DataFrame:
    """df with `place`, its row in a reader's order, of lists small enough for one reader."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*reader_order(how))))
