"""Exchange of knowledge graphs: export, Markdown and zip bundles, merge and import."""

from __future__ import annotations

import io
import json
import re
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES, EDGES = "id string, kind string, label string, body string, status string", "from_id string, to_id string, kind string, confidence double"
PAGE = 50_000
_TAIL = re.compile(r"<!-- graph\n(.*?)\n-->", re.S)


def build(nodes: list[DataFrame], edges: DataFrame, include_deleted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for export: all kinds of nodes in one table; edges whose ends are not both there are dropped."""
    n = nodes[0]
    for x in nodes[1:]:
        n = n.unionByName(x)
    n = n if include_deleted else n.filter("status <> 'DELETED'")
    e = edges.join(n.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(n.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return n, e.select("from_id", "to_id", "kind", "confidence")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    tally = lambda df, what: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return tally(nodes, "node").unionByName(tally(edges, "edge"))


def merge(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two graphs in one: nodes by id, edges by ends and kind; the left one holds where both have it."""
    (n1, e1), (n2, e2) = left, right
    return n1.unionByName(n2.join(n1.select("id"), "id", "left_anti").select(*n1.columns)), e1.unionByName(e2.join(e1.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti").select(*e1.columns))


def write_parts(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """A graph of any size as JSON lines in `folder`/nodes and /edges, written by the executors."""
    nodes.select(*[c.split()[0] for c in NODES.split(", ")]).write.mode("overwrite").json(f"{folder}/nodes")
    edges.select(*[c.split()[0] for c in EDGES.split(", ")]).write.mode("overwrite").json(f"{folder}/edges")


def read_parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODES).json(f"{folder}/nodes"), spark.read.schema(EDGES).json(f"{folder}/edges")


def to_markdown(nodes: DataFrame, edges: DataFrame) -> str:
    """A readable document with the graph itself as JSON at its end. A file for people: of more than PAGE rows it is an error; `write_parts` takes any."""
    if nodes.limit(PAGE + 1).count() + edges.limit(PAGE + 1).count() > PAGE:
        raise ValueError(f"a page holds {PAGE} nodes and edges at most; write parts instead")
    n = [r.asDict() for r in nodes.orderBy("kind", "id").toLocalIterator()]
    e = [r.asDict() for r in edges.orderBy("from_id", "to_id", "kind").toLocalIterator()]
    out, kind = [], None
    for x in n:
        if x["kind"] != kind:
            kind = x["kind"]
            out.append(f"\n## {kind}\n")
        out.append(f"- **{x['label'] or x['id']}** ({x['status']})" + (f": {x['body']}" if x["body"] else ""))
    return "# Graph\n" + "\n".join(out) + "\n\n<!-- graph\n" + json.dumps({"nodes": n, "edges": e}, ensure_ascii=False).replace("--", "\\u002d\\u002d") + "\n-->\n"


def from_markdown(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    m = _TAIL.search(text)
    g = json.loads(m.group(1)) if m else {"nodes": [], "edges": []}
    pick = lambda rows, schema: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in schema.split(", ")) for r in rows], schema)
    return pick(g["nodes"], NODES), pick(g["edges"], EDGES)


def write_bundle(nodes: DataFrame, edges: DataFrame) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("graph.md", to_markdown(nodes, edges))
    return buf.getvalue()


def read_bundle(spark: SparkSession, blob: bytes) -> tuple[DataFrame, DataFrame]:
    """A bundle with any number of Markdown graphs, merged in the order of their names."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        parts = [from_markdown(spark, z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n.endswith(".md") and ".." not in n.split("/")]
    out = parts[0]
    for p in parts[1:]:
        out = merge(out, p)
    return out


def import_graph(stored: DataFrame, nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """The memories of a graph that are new: no stored one has the same body. They get authority 'imported' and, by their label, the symbol of that path.

    stored: body; symbols: symbol_id, symbol_path.
    """
    new = nodes.filter("kind = 'memory'").dropDuplicates(["body"]).join(stored.select("body"), "body", "left_anti")
    s = symbols.groupBy("symbol_path").agg(F.min("symbol_id").alias("symbol_id"))
    return new.join(s, new["label"] == s["symbol_path"], "left").select("id", "label", "body", "status", "symbol_id", F.lit("imported").alias("authority"))


def managed_block(text: str, block: str, mark: str = "managed") -> str:
    """The text with what stands between the markers replaced; the markers come at the end if there are none. Line ends stay as they are."""
    nl = "\r\n" if "\r\n" in text else "\n"
    a, b = f"<!-- {mark}:begin -->", f"<!-- {mark}:end -->"
    new = nl.join([a, *block.splitlines(), b])
    pattern = re.compile(re.escape(a) + ".*?" + re.escape(b), re.S)
    return pattern.sub(lambda _: new, text, count=1) if pattern.search(text) else text + ("" if not text or text.endswith(nl) else nl) + new + nl
