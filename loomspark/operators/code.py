"""From source files to a code graph: symbols, fingerprints, imports, calls and their resolution."""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Languages by file extension.
LANGUAGES = {"py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "sql": "sql", "toml": "toml", "md": "markdown", "sh": "bash"}
# How much each way of resolving a call is trusted, strongest first.
TIERS = [("receiver_self", "deterministic", 1.0), ("receiver_class", "deterministic", 0.95), ("receiver_typed", "inferred", 0.85), ("imported_module", "deterministic", 0.92), ("same_file", "deterministic", 0.9), ("imported", "inferred", 0.8), ("unique_global", "inferred", 0.6)]
MAX_BYTES = 2_000_000
SIGNATURE, MIN_FRAGMENT = 32, 60


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def language_column(path):
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(m, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("text"))


def words_of(text: str) -> list[tuple[int, str]]:
    """(token type, text) of Python-like source without comments, blanks and line ends; what can't be tokenised is cut into words and signs."""
    skip = (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER)
    try:
        return [(t.type, t.string) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in skip]
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return [(tokenize.NAME if w[0].isalpha() or w[0] == "_" else tokenize.NUMBER if w[0].isdigit() else tokenize.OP, w) for w in re.findall(r"\w+|[^\w\s]", text)]


_KEEP = frozenset("def class return if else elif for while in not and or is None True False try except finally with as import from raise lambda yield await async pass break continue self cls".split())


def fingerprints(text: str) -> dict:
    """content: structure, names and operators, without comments, blanks and punctuation; skeleton: the same with all names
    and literals folded; alpha: names numbered in the order they come, called attributes kept; signature: the bottom-k
    sketch of the token trigrams."""
    w = [(k, t) for k, t in words_of(text) if t not in ("(", ")", "[", "]", "{", "}", ",", ":", ";", ".")]
    fold = lambda k, t: t if k == tokenize.OP or t in _KEEP else "N" if k == tokenize.NAME else "L"
    all_words, number, alpha = words_of(text), {}, []
    for i, (k, t) in enumerate(all_words):
        called = i and all_words[i - 1][1] == "." and i + 1 < len(all_words) and all_words[i + 1][1] == "("
        alpha.append(t if k == tokenize.OP or t in _KEEP or called else f"V{number.setdefault(t, len(number) + 1)}" if k == tokenize.NAME else "L")
    toks = [fold(k, t) if k != tokenize.NAME else t for k, t in w]
    return {"content_fp": sha(" ".join(t for _, t in w)), "skeleton_fp": sha(" ".join(fold(k, t) for k, t in w)), "alpha_fp": sha(" ".join(alpha)), "token_signature": signature(toks), "n_tokens": len(w)}


def signature(tokens: list[str], k: int = SIGNATURE) -> list[int]:
    """The k smallest 32-bit hashes of the distinct token trigrams; shorter texts hash as one."""
    grams = {" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))} if tokens else set()
    return sorted({int.from_bytes(hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") for g in grams})[:k]


def _calls(node) -> list[str]:
    out = []
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            try:
                out.append(re.sub(r"\s", "", ast.unparse(n.func)))
            except Exception:  # an expression too deep to print
                continue
    return [c for c in out if re.fullmatch(r"[\w.]+", c)]


def _types(node) -> dict[str, list[str]]:
    """Names that are assigned an instance or annotated with a type -> the types."""
    out: dict[str, list[str]] = {}

    def note(target, kind):
        name = target.id if isinstance(target, ast.Name) else f"self.{target.attr}" if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" else None
        if name and kind and kind not in out.setdefault(name, []):
            out[name].append(kind)

    for n in ast.walk(node):
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call):
            leaf = ast.unparse(n.value.func).rsplit(".", 1)[-1]
            for t in n.targets:
                if leaf[:1].isupper():
                    note(t, leaf)
        elif isinstance(n, ast.AnnAssign):
            note(n.target, re.sub(r"\W.*", "", ast.unparse(n.annotation)))
        elif isinstance(n, ast.arg) and n.annotation is not None:
            note(ast.Name(id=n.arg), re.sub(r"\W.*", "", ast.unparse(n.annotation)))
    return out


def imports_of(tree) -> list[dict]:
    """The import specifiers of a module: deferred ones lie in functions, probes in a try."""
    out = []

    def walk(node, deferred, probe):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Import):
                out.extend({"module": a.name, "level": 0, "raw": ast.unparse(n), "probe": probe, "deferred": deferred} for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                base = n.module or ""
                out.append({"module": base, "level": n.level, "raw": ast.unparse(n), "probe": probe, "deferred": deferred}) if base else None
                out.extend({"module": f"{base}.{a.name}" if base else a.name, "level": n.level, "raw": ast.unparse(n), "probe": True, "deferred": deferred} for a in n.names if a.name != "*")
            else:
                walk(n, deferred or isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)), probe or isinstance(n, ast.Try))

    walk(tree, False, False)
    return out


def extract(text: str) -> tuple[list[dict], list[dict], str]:
    """(symbols, imports, how): by the syntax tree where the text parses ('tree'), else by its definitions' lines ('tags')."""
    text = text or ""
    rows = text.split("\n")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_tags(rows)
    out: list[dict] = []

    def add(node, owner):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                path = f"{owner}.{n.name}" if owner else n.name
                lo = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                body = "\n".join(rows[n.lineno - 1 : n.end_lineno])
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if owner else "function"
                out.append({"name": n.name, "symbol_path": path, "kind": kind, "line_start": lo, "line_end": n.end_lineno, "signature": rows[n.lineno - 1].strip()[:200], "decorators": ["@" + ast.unparse(d) for d in n.decorator_list], "calls": _calls(n) if kind != "class" else [], "types": _types(n), **fingerprints(body)})
                add(n, path)
            else:
                add(n, owner)

    add(tree, "")
    top = [n for n in tree.body if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom))]
    calls = [c for n in top for c in _calls(n)]
    if calls:
        out.append({"name": "<module>", "symbol_path": "<module>", "kind": "module", "line_start": 1, "line_end": len(rows), "signature": "", "decorators": [], "calls": calls, "types": {}, **fingerprints("\n".join(ast.unparse(n) for n in top))})
    return out, imports_of(tree), "tree"


_DEF = re.compile(r"^(\s*)(?:async\s+)?(?:def|class|fn|func|function)\s+(\w+)")


def _by_tags(rows: list[str]) -> tuple[list[dict], list[dict], str]:
    starts = [(i, len(m.group(1)), m.group(2)) for i, r in enumerate(rows) if (m := _DEF.match(r))]
    out = []
    for i, depth, name in starts:
        end = next((j for j in range(i + 1, len(rows)) if rows[j].strip() and len(rows[j]) - len(rows[j].lstrip()) <= depth), len(rows))
        body = "\n".join(rows[i:end]).rstrip()
        calls = [c for c in re.findall(r"(?<![\w.])(\w+(?:\.\w+)*)\(", "\n".join(rows[i + 1 : end])) if c not in ("if", "for", "while", "return", "print")]
        out.append({"name": name, "symbol_path": name, "kind": "function", "line_start": i + 1, "line_end": i + body.count("\n") + 1, "signature": rows[i].strip()[:200], "decorators": [], "calls": calls, "types": {}, **fingerprints(body)})
    return out, [{"module": m, "level": 0, "raw": r.strip(), "probe": False, "deferred": False} for r in rows for m in re.findall(r"^(?:from|import)\s+([\w.]+)", r)], "tags"


_SYMBOL = "file_id string, symbol_id string, name string, symbol_path string, kind string, line_start int, line_end int, signature string, decorators array<string>, calls array<string>, types map<string,array<string>>, content_fp string, skeleton_fp string, alpha_fp string, token_signature array<long>, n_tokens int, extracted_by string"


def symbols(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The symbols of all files; ids are hashes of file, path and line, so a repeated run makes the same. Null texts have none; texts over MAX_BYTES are left out by definition."""

    def run(batches):
        for b in batches:
            out = []
            for fid, text in b.itertuples(index=False, name=None):
                rows, _, how = extract(text)
                out += [(fid, "sym_" + sha(f"{fid}|{s['symbol_path']}|{s['line_start']}")[:12], s["name"], s["symbol_path"], s["kind"], s["line_start"], s["line_end"], s["signature"], s["decorators"], s["calls"], s["types"], s["content_fp"], s["skeleton_fp"], s["alpha_fp"], s["token_signature"], s["n_tokens"], how) for s in rows]
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _SYMBOL.split(", ")])

    return files.filter(F.octet_length(text_col) <= MAX_BYTES).select(F.col(id_col).cast("string").alias("f"), F.col(text_col).alias("t")).mapInPandas(run, _SYMBOL)


def imports(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    schema = "file_id string, module string, level int, raw string, probe boolean, deferred boolean"

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(fid, i["module"], i["level"], i["raw"], i["probe"], i["deferred"]) for fid, text in b.itertuples(index=False, name=None) for i in extract(text)[1]], columns=[c.split()[0] for c in schema.split(", ")])

    return files.filter(F.octet_length(text_col) <= MAX_BYTES).select(F.col(id_col).cast("string").alias("f"), F.col(text_col).alias("t")).mapInPandas(run, schema)


def resolve_imports(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(from_id, to_id, deferred): each specifier meets the files whose path ends with it; `extern:` where none does, but probes that miss are dropped.

    specs: file_id, module, level, probe, deferred; files: file_id, path. A file's path suffixes are spread out, so the
    match is an equi-join. A specifier with several files of one suffix length takes the first path; an eager import goes before a deferred one.
    """
    paths = files.select("file_id", F.regexp_replace(F.regexp_replace("path", r"\.[^./]+$", ""), "/__init__$", "").alias("p"), "path")
    parts = F.split("p", "/")
    suffix = paths.select(F.col("file_id").alias("to_id"), "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))).alias("want"))
    one = suffix.groupBy("want").agg(F.min(F.struct("path", "to_id")).alias("t")).select("want", "t.to_id")
    j = specs.withColumn("want", F.replace("module", F.lit("."), F.lit("/"))).join(one, "want", "left")
    hit = j.filter(F.col("to_id").isNotNull() | ~F.col("probe")).select(F.col("file_id").alias("from_id"), F.coalesce("to_id", F.concat(F.lit("extern:"), "module")).alias("to_id"), "deferred").filter("from_id <> to_id")
    return hit.groupBy("from_id", "to_id").agg(F.min("deferred").alias("deferred"))


def _candidates(keys: DataFrame) -> DataFrame:
    """(scope, word, n, lo, hi): how many symbols a key has, the least and the greatest of them. keys: scope, word, to_id."""
    return keys.filter("scope is not null and word is not null").groupBy("scope", "word").agg(F.count_distinct("to_id").alias("n"), F.min("to_id").alias("lo"), F.max("to_id").alias("hi"))


def resolve_calls(syms: DataFrame, file_imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved) of all calls: a call takes the strongest way of resolving that has exactly one candidate other than the caller.

    A call asks for keys (a path, a name in a file, a name), one or more for each way, and each key has its candidates summed
    up in one row: their number, the least and the greatest. These tell whether there is just one besides the caller, so calls
    never meet the symbols themselves, of which a common name has as many as it has calls.

    edges: from_id, to_id, confidence, edge_class, tier, edge_id. unresolved: from_id, leaf, callee, reason ('external': no
    symbol has that name; 'ambiguous': some have), candidates.
    """
    dot = F.split("callee", r"\.")
    owner = F.when(F.col("symbol_path").contains("."), F.regexp_extract("symbol_path", r"^(.*)\.[^.]*$", 1))
    calls = syms.select(F.col("symbol_id").alias("from_id"), "file_id", "name", owner.alias("owner"), "types", F.explode(F.array_distinct("calls")).alias("callee"))
    calls = calls.select("from_id", "file_id", "name", "owner", "types", "callee", F.element_at(dot, -1).alias("leaf"), F.when(F.size(dot) > 1, F.element_at(dot, -2)).alias("receiver"))
    in_file = lambda file: F.concat(F.lit("file "), file)
    key = lambda tier, scope, word: F.struct(F.lit(tier).alias("tier"), (F.lit(scope) if isinstance(scope, str) else scope).alias("scope"), word.alias("word"))
    keep = ["from_id", "callee", (F.col("name") == F.col("leaf")).alias("own")]  # own: the caller is one of those that have the name
    inner = file_imports.filter(~F.col("to_id").startswith("extern:")).select(F.col("from_id").alias("file_id"), F.col("to_id").alias("to_file")).distinct()
    fields = syms.filter("kind = 'method' or kind = 'class'").select(F.when(F.col("kind") == "class", F.col("symbol_path")).otherwise(owner).alias("owner"), F.explode("types").alias("n", "ts")).filter(F.col("n").startswith("self.")).select("owner", F.expr("substring(n, 6)").alias("receiver"), F.explode("ts").alias("type")).distinct()
    received = F.col("receiver").isNotNull()
    own = F.transform(F.coalesce(F.element_at("types", F.col("receiver")), F.array().cast("array<string>")), lambda t: key(2, "path", F.concat_ws(".", t, "leaf")))
    one_each = F.array(
        key(6, "name", F.col("leaf")),
        key(4, in_file(F.col("file_id")), F.col("leaf")),
        F.when(F.col("receiver").isin("self", "this", "cls") & F.col("owner").isNotNull(), key(0, "path", F.concat_ws(".", "owner", "leaf"))),
        F.when(received, key(1, "path", F.concat_ws(".", "receiver", "leaf"))),
    )
    asked = calls.select(*keep, F.explode(F.concat(F.array_compact(one_each), F.when(received, own).otherwise(F.array().cast("array<struct<tier:int,scope:string,word:string>>")))).alias("k"))
    asked = asked.unionByName(calls.join(fields, ["owner", "receiver"]).select(*keep, key(2, "path", F.concat_ws(".", "type", "leaf")).alias("k")))
    modules = inner.withColumn("receiver", F.regexp_extract("to_file", r"([^/]+?)(?:\.[^./]+)?$", 1))
    asked = asked.unionByName(calls.join(modules, ["file_id", "receiver"]).select(*keep, key(3, in_file(F.col("to_file")), F.col("leaf")).alias("k")))
    asked = asked.unionByName(calls.join(inner, "file_id").select(*keep, key(5, in_file(F.col("to_file")), F.col("leaf")).alias("k")))
    found = _candidates(syms.select(F.col("symbol_id").alias("to_id"), F.explode(F.array(F.struct(F.lit("path").alias("scope"), F.col("symbol_path").alias("word")), F.struct(F.lit("name").alias("scope"), F.col("name").alias("word")), F.struct(in_file(F.col("file_id")).alias("scope"), F.col("name").alias("word")))).alias("k")).select("k.scope", "k.word", "to_id"))
    met = asked.select("from_id", "callee", "own", "k.*").join(found, ["scope", "word"], "left").filter("tier = 6 or n is not null")
    few, lo, hi = F.col("n") <= 2, F.when(F.col("lo") != F.col("from_id"), F.col("lo")), F.when(F.col("hi") != F.col("from_id"), F.col("hi"))
    met = met.select("from_id", "callee", "tier", "own", "n", F.when(few, F.coalesce(lo, hi)).alias("lo"), F.when(few, F.coalesce(hi, lo)).alias("hi")).repartition("from_id")
    per = met.groupBy("from_id", "callee", "tier").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"), F.max("own").alias("own"), F.count(F.lit(1)).alias("copies"))
    sole = F.when((F.col("n") <= 2) & (F.col("lo") == F.col("hi")), F.struct("tier", F.col("lo").alias("to_id")))
    named = lambda c: F.max(F.when(F.col("tier") == 6, c))
    others = F.col("n") - F.when(F.col("own"), 1).otherwise(0)
    j = materialise(per.groupBy("from_id", "callee").agg(F.min(sole).alias("b"), named(F.nullif(others, F.lit(0))).alias("candidates"), named(F.col("copies")).alias("copies")), "calls")
    table = F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(k).alias("edge_class"), F.lit(c).alias("confidence")) for n, k, c in TIERS])
    e = j.filter("b is not null").select("from_id", F.col("b.to_id").alias("to_id"), F.get(table, F.col("b.tier")).alias("t")).select("from_id", "to_id", "t.tier", "t.edge_class", "t.confidence")
    edges = e.groupBy("from_id", "to_id").agg(F.max(F.struct("confidence", "edge_class", "tier")).alias("m")).select("from_id", "to_id", "m.confidence", "m.edge_class", "m.tier", F.xxhash64("from_id", "to_id").alias("edge_id"))
    each = j.filter("b is null").select("from_id", "callee", "candidates", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))  # a symbol that is there twice misses its calls twice
    missed = each.select("from_id", F.element_at(dot, -1).alias("leaf"), "callee", F.when(F.col("candidates").isNull(), "external").otherwise("ambiguous").alias("reason"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    return edges, missed


def similarity(a, b):
    """Jaccard of two sketches as sets (an underestimate for sets larger than the sketch)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def clones(syms: DataFrame, fingerprint: str = "alpha_fp", min_tokens: int = MIN_FRAGMENT) -> DataFrame:
    """(symbol_id, class_id, n): symbols that share a fingerprint with others, each with its class instead of all pairs."""
    big = syms.filter(F.col("n_tokens") >= min_tokens)
    groups = big.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("class_id")).filter("n > 1")
    return big.join(groups, fingerprint).select("symbol_id", "class_id", "n")
