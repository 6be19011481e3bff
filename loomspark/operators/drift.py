"""Schemas that drift between files: rescue-column ingestion, a profile per version, and the list of changes.

Ingestion enforces a target schema. A leaf of a JSON object (a dotted path, no array positions) that the target knows
goes into its typed column, cast where the cast is exact; a leaf it doesn't know, or whose value is of another JSON
type, is also kept as it was in the JSON column `_rescued`. Approved fields are promoted later by replaying the rescued
values into typed columns, without reading the source again. The report of changes reads nothing but the ingested table:
what a version has is what its typed columns and its rescued values have together, so a schema that knows more fields
rescues less and reports the same.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

ALIKE = 0.5  # least share two value sets or ranges have in common in a renaming
SPARK_TYPES = {"string": "string", "number": "double", "boolean": "boolean", "array": "string"}


def json_type(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return "string" if isinstance(v, str) else "array"


def leaves(obj: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """The leaves of an object as (dotted path, value). An empty object has none."""
    stack = [(prefix, obj)]
    while stack:
        p, o = stack.pop()
        for k, v in o.items():
            q = f"{p}.{k}" if p else k
            if isinstance(v, dict):
                stack.append((q, v))
            else:
                yield q, v


def _no_number(name: str):
    raise ValueError(f"{name} is not JSON")


def objects(text: str | None, many: bool) -> list[dict]:
    """The objects of a JSON text: the text itself, or, with `many`, the objects of its array. Unreadable JSON has none."""
    if not text:
        return []
    try:
        o = json.loads(text, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return []
    if "\\ud" in text or "\\uD" in text:  # halves of characters can't be written; pairs are whole by now
        o = json.loads(json.dumps(o, ensure_ascii=False).encode("utf-8", "replace").decode())
    if many:
        return [x for x in o if isinstance(x, dict)] if isinstance(o, list) else []
    return [o] if isinstance(o, dict) else []


def cast(v, kind: str):
    """v as `kind`, or None where the cast would lose something."""
    if kind == "array":
        return json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, list) else None
    if kind == "string":
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if kind == "number":
        if isinstance(v, bool):
            return None
        if isinstance(v, int):
            return float(v) if abs(v) <= 1 << 53 else None
        if isinstance(v, float):
            return v
        return float(v) if isinstance(v, str) and re.fullmatch(r"-?\d{1,15}(\.\d+)?", v) else None
    if isinstance(v, bool):
        return v
    return {"true": True, "false": False, "yes": True, "no": False}.get(v) if isinstance(v, str) else None


def split(obj: dict, target: dict[str, str]) -> tuple[dict, dict]:
    """(typed, rescued) of one object under the target schema. A null is rescued as null, to tell it from a field that isn't there."""
    typed, rescued = {}, {}
    for f, v in leaves(obj):
        kind = target.get(f)
        if kind and v is not None:
            typed[f] = cast(v, kind)
        if v is None or json_type(v) != kind or typed[f] is None:
            rescued[f] = v
    return typed, rescued


def column_name(field: str) -> str:
    return "f_" + re.sub(r"\W", "_", field)


def ingest(df: DataFrame, text_col: str, target: dict[str, str], many: bool, keep: list[str]) -> DataFrame:
    """One row an object: the columns `keep`, `position` in its array, a typed column f_<field> for each target field,
    `_rescued` (JSON text, null if nothing was rescued) and `_readable`. A null, empty or cut-off text gives one row
    without values, with _readable false where there was a text.
    """
    fields = list(target)
    kept = df.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"k_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "position int", *(f"{column_name(f)} {SPARK_TYPES[target[f]]}" for f in fields), "_rescued string", "_readable boolean"])

    def run(batches):
        for b in batches:
            at, pos, cols, rescued, ok = [], [], [[] for _ in fields], [], []
            for i, t in enumerate(b["_text"]):
                t = t if isinstance(t, str) else None
                objs = objects(t, many)
                for p, o in enumerate(objs) if objs else [(None, None)]:
                    typed, rest = split(o, target) if o is not None else ({}, {})
                    at.append(i)
                    pos.append(p)
                    for c, f in zip(cols, fields):
                        c.append(typed.get(f))
                    rescued.append(json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None)
                    ok.append(o is not None or t is None or t.strip() == "[]")
            out = b.drop(columns="_text").iloc[at].reset_index(drop=True)
            out["position"] = pd.array(pos, dtype="Int32")
            for c, f in zip(cols, fields):
                out[column_name(f)] = pd.Series(c, dtype=object)
            out["_rescued"], out["_readable"] = pd.Series(rescued, dtype=object), ok
            yield out

    return kept.mapInPandas(run, schema).select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "position", *[column_name(f) for f in fields], "_rescued", "_readable")


def promote(ingested: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Replay rescued values into typed columns. fields: rescued field -> (target field, type); a value already there holds."""
    out = ingested
    for old, (new, kind) in fields.items():
        raw = F.get_json_object("_rescued", f"$['{old}']")
        value = {"number": raw.try_cast("double"), "boolean": F.when(F.lower(raw).isin("true", "yes"), True).when(F.lower(raw).isin("false", "no"), False)}.get(kind, raw)
        name = column_name(new)
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in out.columns else value)
    return out


def profile(df: DataFrame, text_col: str, target: dict[str, str], many: bool, group: list[str], label: str) -> DataFrame:
    """Ingests df, writes the table, and returns what it holds as rows (json_column, group columns as text, field, type, value).

    A leaf comes from `_rescued` if it is there, with the type it had, else from its typed column; a null has type 'null'. A
    value is its text, for arrays as JSON. Field '' with type 'object' stands for an object that could be read.
    """
    table = materialise(ingest(df, text_col, target, many, group).drop("_readable"), "ingested")
    rescued = F.try_parse_json("_rescued").cast("map<string,variant>")
    t = table.filter("position is not null").withColumn("_m", F.coalesce(rescued, F.create_map().cast("map<string,variant>")))
    kind = lambda v: F.regexp_replace(F.schema_of_variant(v), r"[<(].*", "")
    named = lambda k: F.when(k.isNull() | (k == "VOID"), "null").when(k == "STRING", "string").when(k == "BOOLEAN", "boolean").when(k == "ARRAY", "array").otherwise("number")
    leaf = lambda f, k, v: F.struct(f.alias("field"), k.alias("type"), v.cast("string").alias("value"))
    text = lambda v, k: F.when(k == "number", v.try_cast("double").cast("string")).when(k == "array", F.to_json(v)).when(k != "null", v.try_cast("string"))
    kept = [leaf(F.lit(f), F.lit(k), F.col(column_name(f))) for f, k in target.items()]
    known = F.filter(F.array(leaf(F.lit(""), F.lit("object"), F.lit(None)), *kept), lambda x: (x["field"] == "") | (x["value"].isNotNull() & ~F.map_contains_key("_m", x["field"])))
    unknown = F.transform(F.map_entries("_m"), lambda e: leaf(e["key"], named(kind(e["value"])), text(e["value"], named(kind(e["value"])))))
    out = t.select(*[F.col(c).cast("string").alias(f"g_{i}") for i, c in enumerate(group)], F.explode(F.concat(known, unknown)).alias("_l"))
    return out.select(F.lit(label).alias("json_column"), *[F.col(f"g_{i}").alias(c) for i, c in enumerate(group)], "_l.field", "_l.type", "_l.value")


def inventory(found: DataFrame, group: str, version: str) -> list[dict]:
    """What each version's fields are: rows, and the range of the values that read as numbers. Comes to the driver: (versions x fields x types) rows."""
    by = ["json_column", group, version, "field", "type"]
    x = elements(found.withColumn("_n", F.lit(1)), outer=True)
    digits = F.col("value").rlike(r"^-?\d{1,15}(\.\d+)?$") | (F.col("type") == "number")
    num = F.when(digits, F.col("value").try_cast("double"))
    whole = F.min(F.when(F.col("value").isNotNull(), F.coalesce(num == F.floor(num), F.lit(False))))
    return [r.asDict() for r in x.groupBy(*by).agg(F.sum("_n").alias("n"), F.min(num).alias("lo"), F.max(num).alias("hi"), whole.alias("whole")).collect()]


def elements(found: DataFrame, outer: bool = False) -> DataFrame:
    """Values as they are compared: an array's elements, each as JSON (text without quotes), and others as they are."""
    items = F.when(F.col("type") == "array", F.transform(F.try_parse_json("value").cast("array<variant>"), lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string")), F.to_json(v))))
    each = F.coalesce(items, F.array("value"))
    cols = [c for c in found.columns if c not in ("value", "_n")]
    if not outer:
        return found.select(*cols, F.explode(each).alias("value"))
    y = found.select(*cols, F.posexplode_outer(each).alias("_pos", "value"))
    return y.withColumn("_n", F.when(F.coalesce("_pos", F.lit(0)) == 0, 1).otherwise(0)).drop("_pos")


def shared_values(found: DataFrame, group: str, version: str, pairs: list[tuple]) -> dict[tuple, float]:
    """(json_column, group, old version, new version, old field, new field) -> the share of their distinct values that both have.

    `pairs` has those keys and the type; they are as few as fields, the values are counted by Spark: distinct ones of each
    field first, then those that two fields have in common.
    """
    if not pairs:
        return {}
    step = lambda p: "|".join((p[2], p[3]))
    sides = {(p[0], p[1], step(p), v, f, p[6], w) for p in pairs for v, f, w in ((p[2], p[4], 0), (p[3], p[5], 1))}
    spark = found.sparkSession
    want = spark.createDataFrame(sorted(sides), f"json_column string, {group} string, _step string, {version} string, field string, type string, _side int")
    mine = found.join(F.broadcast(want), ["json_column", group, version, "field", "type"])  # as many rows as fields at most
    sets = materialise(elements(mine).filter("value is not null").select("json_column", group, "_step", "_side", "field", "type", F.md5("value").alias("v")).distinct(), "values")
    n = {tuple(r)[:-1]: r[-1] for r in sets.groupBy("json_column", group, "_step", "_side", "field").count().collect()}
    on = ["json_column", group, "_step", "type", "v"]
    a, b = (sets.filter(F.col("_side") == w).drop("_side").withColumnRenamed("field", f) for w, f in ((0, "_old"), (1, "_new")))
    both = {tuple(r)[:-1]: r[-1] for r in a.join(b, on).groupBy("json_column", group, "_step", "_old", "_new").count().collect()}
    out = {}
    for p in pairs:
        k = both.get((p[0], p[1], step(p), p[4], p[5]), 0)
        union = n.get((p[0], p[1], step(p), 0, p[4]), 0) + n.get((p[0], p[1], step(p), 1, p[5]), 0) - k
        out[p[:6]] = k / union if union else 0.0
    return out


def version_order(version: str) -> tuple:
    return tuple(int(x) for x in re.findall(r"\d+", version))


def in_range(a: dict, b: dict) -> float | None:
    """The share of their value range that two fields have in common (numbers, and texts of whole numbers), or None where ranges say nothing."""
    if a["lo"] is not None and b["lo"] is not None and a["whole"] == b["whole"] and (a["type"] == "number" or a["whole"]):
        union = max(a["hi"], b["hi"]) - min(a["lo"], b["lo"])
        both = min(a["hi"], b["hi"]) - max(a["lo"], b["lo"])
        return 1.0 if union == 0 else max(0.0, both) / union
    return 0.0 if a["type"] == "number" else None


def steps(rows: list[dict], group: str, version: str) -> list[tuple]:
    """(json_column, group, old version, new version, its old fields, its new fields), each field with its commonest type that isn't null (None without one)."""
    there: dict[tuple, dict[str, dict[str, dict]]] = {}
    for p in rows:
        if p[group] is not None and p[version] is not None:
            there.setdefault((p["json_column"], p[group]), {}).setdefault(p[version], {}).setdefault(p["field"], {})[p["type"]] = p
    out = []
    for (col, g), versions in there.items():
        order = sorted(versions, key=lambda v: (version_order(v), v))
        for a, b in zip(order, order[1:]):
            out.append((col, g, a, b, *({f: max((p for t, p in kinds.items() if t != "null"), key=lambda p: (p["n"], p["type"]), default=None) for f, kinds in versions[v].items() if f} for v in (a, b))))
    return out


def drift_report(found: DataFrame, group: str, version: str) -> DataFrame:
    """(json_column, group, version, change_kind, field_name, new_name) from each version to the next that says anything.

    A field is there in a version if any readable object has it, be it null. A field that goes and one of the same type that
    comes are one renamed field if they have half of their value range or of their distinct values in common, the likest first.
    """
    todo, pairs = steps(inventory(found, group, version), group, version), []
    for col, g, a, b, old, new in todo:
        pairs += [(col, g, a, b, x, y, old[x]["type"]) for x in set(old) - set(new) for y in set(new) - set(old) if old[x] and new[y] and old[x]["type"] == new[y]["type"] and in_range(old[x], new[y]) is None]
    alike, out = shared_values(found, group, version, pairs), []
    for col, g, a, b, old, new in todo:
        gone, come, scored = sorted(set(old) - set(new)), sorted(set(new) - set(old)), []
        for x in gone:
            for y in come:
                if old[x] and new[y] and old[x]["type"] == new[y]["type"]:
                    by_range = in_range(old[x], new[y])
                    scored.append((alike[col, g, a, b, x, y] if by_range is None else by_range, x, y))
        for score, x, y in sorted(scored, key=lambda p: (-p[0], p[1], p[2])):
            if score >= ALIKE and x in gone and y in come:
                out.append((col, g, b, "renamed", x, y))
                gone.remove(x)
                come.remove(y)
        out += [(col, g, b, "removed", x, "") for x in gone] + [(col, g, b, "added", y, "") for y in come]
        out += [(col, g, b, "retyped", f, "") for f in sorted(set(old) & set(new)) if old[f] and new[f] and old[f]["type"] != new[f]["type"]]
    return found.sparkSession.createDataFrame(out, f"json_column string, {group} string, {version} string, change_kind string, field_name string, new_name string")


def with_version(sessions: DataFrame, files: DataFrame, key: str, version: Column) -> DataFrame:
    """Sessions with their file's version; of several versions of one file the highest in string order, none if the file is unknown."""
    v = files.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(version).alias("parser_version"))
    return sessions.drop("parser_version").join(v, key, "left")
