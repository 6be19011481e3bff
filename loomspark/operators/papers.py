"""Text of documents: HTML and TeX to text, outlines, sections and slices, abstracts, ids and citations."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Elements whose content is no text of the page, and elements that begin a line of their own.
NO_TEXT = ["script", "style", "nav", "header", "footer", "svg", "form", "button", "noscript", "template"]
OWN_LINE = ["p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "tr", "table", "br", "hr", "blockquote", "pre", "figure", "figcaption", "dd", "dt"]
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[A-Za-z][\w:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ALT = re.compile(r"\b(alt|alttext)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _pieces(html: str):
    """The text of a page piece by piece: what stands between tags, line breaks for elements with a line of their own, the alt texts of pictures and formulas."""
    at, hidden, formula = 0, 0, 0
    while at < len(html):
        m = _MARKUP.search(html, at)
        between = html[at : m.start() if m else len(html)]
        if not hidden and not formula:
            yield unescape(between)
        if m is None:
            return
        at, tag, ends = m.end(), (m["tag"] or "").lower(), bool(m["end"])
        alts = {k.lower(): unescape(a or b or c) for k, a, b, c in _ALT.findall(m["rest"] or "")}
        if tag in NO_TEXT:
            hidden = max(0, hidden + (-1 if ends else 1))
            if tag in ("script", "style") and not ends:  # no markup within: go to the end of the element
                stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at, hidden = (stop.end(), hidden - 1) if stop else (len(html), hidden)
        elif tag == "math":
            if not ends and not hidden and not formula and alts.get("alttext"):
                yield f"${alts['alttext']}$"
            formula = max(0, formula + (-1 if ends else 1))
        elif not hidden and tag == "img" and alts.get("alt"):
            yield f"[figure: {alts['alt']}]"
        elif not hidden and tag in OWN_LINE:
            yield "\n"


def html_text(html: str | None) -> str | None:
    """Readable text of a page: no scripts, navigation and forms; math by its alt text, pictures by theirs; blanks collapsed."""
    if html is None:
        return None
    t = re.sub(r"[ \t\r\f\v\xa0]+", " ", "".join(_pieces(html)))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", t)).strip()


def html_to_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def read(col: pd.Series) -> pd.Series:
        return col.map(lambda x: html_text(x) if isinstance(x, str) else None)

    return read(html)


def strip_comments(tex: str) -> str:
    return re.sub(r"(?m)(?<!\\)((?:\\\\)*)%.*$", r"\1", tex)


def balanced(s: str, at: int) -> int:
    """The place after the brace that closes the one at `at`; the end if none does."""
    depth = 0
    for i in range(at, len(s)):
        if s[i] == "\\":
            continue
        if s[i] == "{" and (i == 0 or s[i - 1] != "\\"):
            depth += 1
        elif s[i] == "}" and s[i - 1] != "\\":
            depth -= 1
            if not depth:
                return i + 1
    return len(s)


def macros(tex: str) -> dict[str, str]:
    """Macros without arguments: name -> body."""
    out = {}
    for m in re.finditer(r"\\(?:re)?newcommand\*?\s*\{?\\(\w+)\}?\s*(\[\d\])?\s*(?=\{)|\\def\s*\\(\w+)\s*(?=\{)", tex):
        if not m.group(2):
            end = balanced(tex, m.end())
            out[m.group(1) or m.group(3)] = tex[m.end() + 1 : end - 1]
    return out


def expand(tex: str, own: dict[str, str] | None = None, rounds: int = 4) -> str:
    own = macros(tex) if own is None else own
    for _ in range(rounds if own else 0):
        new = re.sub(r"\\(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + r")(?![A-Za-z])(?:\{\})?", lambda m: own[m.group(1)], tex)
        if new == tex:
            break
        tex = new
    return tex


def detex(tex: str) -> str:
    """Text of TeX source: comments and commands gone, arguments of text commands kept, math left as it is."""
    t = expand(strip_comments(tex))
    body = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", t, re.S)
    t = body.group(1) if body else t
    kept: list[str] = []

    def keep(m):
        kept.append(m.group(0))
        return f"\x00{len(kept) - 1}\x00"

    t = re.sub(r"\$\$.*?\$\$|(?<!\\)\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)|\\begin\{(equation|align|eqnarray|gather)\*?\}.*?\\end\{\1\*?\}", keep, t, flags=re.S)
    t = re.sub(r"\\(?:cite\w*|ref|eqref|label|bibliography\w*|usepackage|documentclass|vspace|hspace|includegraphics|input|include)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", t)
    t = re.sub(r"\\(?:sub)*section\*?\{([^{}]*)\}", r"\n\n\1\n\n", t)
    for _ in range(6):
        t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", t)
        t = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\item\b", "- ", t)
    t = re.sub(r"\\[A-Za-z]+\*?|\\(?=[%&#_{}$])|(?<!\x00)[{}]|~", lambda m: " " if m.group() == "~" else "", t)
    t = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))], t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


def tex_outline(tex: str) -> list[tuple[int, str, str, int]]:
    """(level, number, title, offset) of the sections, numbered by levels; starred ones have no number."""
    out, count = [], [0, 0, 0]
    for m in re.finditer(r"\\((?:sub){0,2})section(\*?)\s*(?:\[[^\]]*\])?(?=\{)", strip_comments(tex)):
        level = len(m.group(1)) // 3
        title = strip_comments(tex)[m.end() + 1 : balanced(strip_comments(tex), m.end()) - 1]
        if not m.group(2):
            count[level] += 1
            count[level + 1 :] = [0] * (2 - level)
        out.append((level + 1, "" if m.group(2) else ".".join(map(str, count[: level + 1])), detex(title), m.start()))
    return out


def unpack(blob: bytes) -> dict[str, str]:
    """The text files of a TeX bundle: tar (compressed or not), one compressed file, or the bare source. Names that lead out of the bundle are left out."""
    try:
        with tarfile.open(fileobj=io.BytesIO(blob)) as t:
            return {m.name: t.extractfile(m).read().decode("utf-8", "replace") for m in t.getmembers() if m.isfile() and not m.name.startswith("/") and ".." not in m.name.split("/")}
    except tarfile.TarError:
        pass
    try:
        blob = gzip.decompress(blob)
    except OSError:
        pass
    return {"main.tex": blob.decode("utf-8", "replace")}


def main_file(files: dict[str, str]) -> str | None:
    """The file that begins the document; of several the one with a title, then the shortest path."""
    tex = [n for n in files if n.endswith(".tex")]
    return min(tex, key=lambda n: ("\\documentclass" not in files[n], "\\begin{document}" not in files[n], "\\title" not in files[n], len(n), n), default=None)


def flatten(files: dict[str, str], name: str, depth: int = 0, above: frozenset = frozenset()) -> str:
    """A file with its includes put in: looked for beside it, then whatever the case, then by the bare name; circles stay out."""
    here = name.rsplit("/", 1)[0] + "/" if "/" in name else ""

    def find(target: str) -> str | None:
        want = [t for x in (here + target, target) for t in (x, x + ".tex")]
        low = {n.lower(): n for n in sorted(files, reverse=True)}
        base = {n.rsplit("/", 1)[-1].lower(): n for n in sorted(files, reverse=True)}
        return next((w for w in want if w in files), None) or next((low[w.lower()] for w in want if w.lower() in low), None) or next((base[w.rsplit("/", 1)[-1].lower()] for w in want if w.rsplit("/", 1)[-1].lower() in base), None)

    def put(m):
        t = find(m.group(1).strip())
        return flatten(files, t, depth + 1, above | {name}) if t and t not in above | {name} and depth < 20 else ""

    return re.sub(r"\\(?:input|include|subfile)\s*\{([^{}]+)\}", put, strip_comments(files[name]))


def tex_documents(bundles: DataFrame, id_col: str, blob_col: str) -> DataFrame:
    """(id, title, sections, text) of TeX bundles; a bundle without a main file gives nulls."""

    def run(batches):
        for b in batches:
            out = []
            for i, blob in b.itertuples(index=False, name=None):
                files = unpack(bytes(blob)) if blob is not None else {}
                main = main_file(files)
                src = flatten(files, main) if main else None
                t = re.search(r"\\title\s*(?:\[[^\]]*\])?(?=\{)", src or "")
                out.append((i, detex(src[t.end() + 1 : balanced(src, t.end()) - 1]) if t else None, [f"{n} {x}".strip() for _, n, x, _ in tex_outline(src)] if src else None, detex(src) if src else None))
            yield pd.DataFrame(out, columns=["id", "title", "sections", "text"])

    return bundles.select(F.col(id_col).alias("id"), blob_col).mapInPandas(run, f"id {bundles.schema[id_col].dataType.simpleString()}, title string, sections array<string>, text string")


HEADING = r"^(?:(\d+(?:\.\d+)*)\.?\s+\S.{0,80}|#{1,6} .+|(?:abstract|introduction|conclusions?|references|related work)\s*)$"


def outline(pages: DataFrame, id_col: str, page_col: str, text_col: str) -> DataFrame:
    """(id, page, line, level, title): headings found in the lines of pages; a heading equal to the one before it counts once."""
    lines = pages.select(F.col(id_col).alias("id"), F.col(page_col).alias("page"), F.posexplode(F.split(text_col, "\n")).alias("line", "t")).select("id", "page", "line", F.trim("t").alias("title")).filter(F.col("title").rlike("(?i)" + HEADING) & (F.length("title") <= 100))
    number, marks = F.regexp_extract("title", r"^(\d+(?:\.\d+)*)", 1), F.length(F.regexp_extract("title", "^(#+) ", 1))
    level = F.when(marks > 0, marks).when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).otherwise(1)
    before = F.lag("title").over(Window.partitionBy("id").orderBy("page", "line"))
    return lines.withColumns({"level": level.cast("int"), "before": before}).filter(~F.col("title").eqNullSafe(F.col("before"))).drop("before")


def section_ends(headings: DataFrame) -> DataFrame:
    """Headings with `end`: the (page, line) of the next one of the same or a higher level; null to the end of the document.

    The next heading of at most a level is the least over the levels up to it, each a running minimum from the end.
    """
    at = F.struct("page", "line")
    w = Window.partitionBy("id").orderBy("page", "line").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= k, at)).over(w) for k in range(1, 7)]
    out = headings
    for k, e in enumerate(ends, 1):
        out = out.withColumn(f"_e{k}", e)
    pick = F.get(F.array(*[F.col(f"_e{k}") for k in range(1, 7)]), F.least("level", F.lit(6)) - 1)
    return out.withColumn("end", pick).drop(*[f"_e{k}" for k in range(1, 7)])


def page_numbers(spec: str, total: int) -> list[int]:
    """'1-3,7,-1' -> pages that exist, in order, each once; '' is all. Negative numbers count from the end."""
    out: dict[int, None] = {}
    for part in filter(None, (p.strip() for p in (spec or f"1-{total}").split(","))):
        m = re.fullmatch(r"(-?\d+)(?:-(\d*))?", part)
        if not m:
            raise ValueError(f"not a page: {part}")
        a = int(m.group(1)) if int(m.group(1)) > 0 else total + 1 + int(m.group(1))
        b = a if m.group(2) is None else int(m.group(2) or total)
        out |= dict.fromkeys(p for p in range(a, b + 1) if 1 <= p <= total)
    return list(out)


def clip(text: Column, offset: int, size: int) -> Column:
    return F.substring(text, offset + 1, size)


def abstract(inverted: Column) -> Column:
    """The text of an inverted index map<word, positions>."""
    pos = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pos), lambda x: x["w"]), " ")


def arxiv_id(raw: Column) -> Column:
    """The id in an address or a name, without its version; null if there is none."""
    new = F.regexp_extract(raw, r"(?:^|[/:\s])(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?(?:$|[?#\s])", 1)
    old = F.regexp_extract(raw, r"([a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v\d+)?", 1)
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))


def pdf_link(html: Column) -> Column:
    """The PDF that a landing page names: by its citation tag, a link to a .pdf, or a link that says pdf."""
    tries = [r"(?i)<meta[^>]+name=[\"']citation_pdf_url[\"'][^>]+content=[\"']([^\"']+)", r"(?i)<a[^>]+href=[\"']([^\"']+\.pdf(?:\?[^\"']*)?)[\"']", r"(?i)<a[^>]+href=[\"']([^\"']*pdf[^\"']*)[\"']"]
    return F.coalesce(*[F.nullif(F.regexp_extract(html, t, 1), F.lit("")) for t in tries])


def atom_entries(feeds: DataFrame, xml_col: str) -> DataFrame:
    """(id, title, authors, published, summary) of the entries of Atom feeds; a feed that can't be read gives none."""
    import xml.etree.ElementTree as ET

    def run(batches):
        ns = {"a": "http://www.w3.org/2005/Atom"}
        for b in batches:
            out = []
            for x in b[xml_col]:
                try:
                    root = ET.fromstring(x)
                except (ET.ParseError, TypeError):
                    continue
                for e in root.findall("a:entry", ns):
                    get = lambda t, e=e: re.sub(r"\s+", " ", e.findtext(f"a:{t}", "", ns)).strip() or None
                    out.append((get("id"), get("title"), [a.findtext("a:name", "", ns).strip() for a in e.findall("a:author", ns)], get("published"), get("summary")))
            if out:
                yield pd.DataFrame(out, columns=["id", "title", "authors", "published", "summary"])

    return feeds.select(xml_col).mapInPandas(run, "id string, title string, authors array<string>, published string, summary string")


def citation(authors: Column, title: Column, year: Column, ident: Column) -> Column:
    who = F.when(F.size(authors) > 3, F.concat(F.get(authors, F.lit(0)), F.lit(" et al."))).otherwise(F.array_join(authors, ", "))
    return F.concat(who, F.when(year.isNotNull(), F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(F.lit("")), F.lit(". "), title, F.lit("."), F.when(ident.isNotNull(), F.concat(F.lit(" "), ident)).otherwise(F.lit("")))
