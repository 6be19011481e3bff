"""Personal information in free text: bootstrapped contextual extraction.

One pass over the texts cuts out candidates: spans that might be an email address, a phone number, an identity number, a
street address or a person's name, each with its instance key (the shape of a number or address, the word of a name) and
its patterns (the words before it, after it and around it, and for names the name beside it). Seed entities, whose form
alone tells what they are or which the roster names, give the patterns they occur in a confidence for their type; the
patterns then give the other instances a score, and those that score high enough become seeds of the next round. The
rounds run over the graph of patterns and instances, not over texts. At last the accepted instances are looked up among
the candidates.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa

try:
    import ahocorasick
except ImportError:  # the gates then look for one word after the other
    ahocorasick = None
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

ROUNDS = 3
REACH = 40  # characters on either side of a candidate that its patterns are made of
PRIOR = 18  # a word counts as ordinary if it is written small three times as often as with a capital, and so much more
FILTER = 1 << 20  # bytes of the bit map of names
PURE = 0.4  # share of one type among what a pattern surrounds, from which the pattern speaks for that type
ACCEPT = {"email": 0.5, "phone": 0.5, "id_number": 0.5, "address": 0.5, "person": 0.4}
ANY = 0.6  # the same for numbers and addresses of any shape
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}

_END = r"(?![\w@]|[./-]\d)"


def _at(first: str) -> str:
    """A first character that no word, number or path runs into; it stands before the look behind it, so that a search skips to it."""
    return rf"{first}(?<![\w.+/@#-].)"


# the letters of the scripts that have capitals: Latin, Greek and Cyrillic
_UP = "A-Z" + "".join(c for c in map(chr, range(0xC0, 0x530)) if c.isupper())
_LOW = "a-z" + "".join(c for c in map(chr, range(0xC0, 0x530)) if c.islower())
_EXT = r"(?: ?(?:x|ext\.? ?)\d{1,5})?"
_CAP = rf"[{_UP}][{_LOW}]++"
_PLACE = rf"{_CAP}(?:(?:[ -](?:del?|du|des|da|do|sur|la|le))*[ -]{_CAP})*"
_EN = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Close|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Crescent|Boulevard|Blvd|Row|Hill|Walk|Grove|Gardens|Mews"
_FR = r"rue|avenue|boulevard|place|chemin|impasse|all[ée]e|quai|cours|route|passage|square"
_ES = r"Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrera|Ronda|Travesía|C/"
_GAP = r"(?:,\s*|\s*\n\s*)"

#: (type, form, is it a seed, gate, pattern). The form and the shape of what was found make the instance key. A text is
#: searched only if it passes the form's gate, a test that every match of the pattern passes and that costs little.
FORMS: list[tuple[str, str, bool, str, re.Pattern]] = [
    (t, name, seed, gate, re.compile(p))
    for t, name, seed, gate, p in [
        ("email", "plain", True, "at", r"(?<![\w.+/@-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@]|:[\w/~])"),
        ("email", "bracketed", False, "bracket", r"(?<![\w.+@-])[A-Za-z0-9][A-Za-z0-9._%+-]* ?[(\[{<]\s?(?:at|AT|@)\s?[)\]}>] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]) ?[A-Za-z0-9-]+)+"),
        ("email", "spelled", False, "dot", r"(?<![\w.+@-])[A-Za-z0-9][A-Za-z0-9._%+-]* (?:at|AT) [A-Za-z0-9-]+(?: (?:dot|DOT) [A-Za-z0-9-]+)+"),
        ("id_number", "labelled", True, "label", r"(?i:\b(?:ssn|social security(?: no\.?| number)?|passport(?: no\.?| number)?|national insurance(?: no\.?| number)?|ni (?:number|no\.?)|n\.?i\.?e\.?|dni|steuer-?id(?:nr\.?)?|tax id|national[_ ]id|insurance no\.?|id card)\b)[\s\"':=#.]{1,6}(?P<x>(?:[A-Z]{1,2} ?)?\d[\d -]{4,14}\d(?:[ -]?[A-Z])?)(?![\w-])"),
        ("id_number", "explained", True, "explain", r"(?<![\w.+/@#-])(?:[A-Z]{1,2} ?)?\d[\d -]{4,12}\d ?[A-Z]?(?= (?:\((?:social security|ssn|dni|passport|tax id)\)|as (?:national insurance|social security|passport|tax) (?:no|number|id)))"),
        ("id_number", "insurance", False, "long", _at("[A-CEGHJ-PR-TW-Z]") + r"[A-CEGHJ-PR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]" + _END),
        ("id_number", "social", False, "long", _at(r"\d") + r"\d{2}-\d{2}-\d{4}" + _END),
        ("id_number", "national", False, "long", _at(r"\d") + r"\d{2}-\d{4}-\d{4}" + _END),
        ("id_number", "letter last", False, "long", _at(r"\d") + r"\d{7}-?[A-Z]" + _END),
        ("id_number", "tax", False, "long", _at(r"\d") + r"\d \d{3} \d{3} \d{3}" + _END),
        ("id_number", "document", False, "long", _at("[A-Z]") + r"\d{8}" + _END),
        ("phone", "international", True, "long", r"(?:\+(?<![\w.+/@#-].)|tel:\+(?<![\w.+/@#-]tel:.))\d{1,3}[ .-]?(?:\(0\) ?)?(?:\(\d{1,4}\) ?)?\d{1,5}(?:[ ./-]\d{2,6}){1,5}" + _EXT + _END),
        ("phone", "joined", True, "long", r"(?:\+(?<![\w.+/@#-].)|tel:\+(?<![\w.+/@#-]tel:.))\d{10,14}" + _EXT + _END),
        ("phone", "bracketed", False, "long", r"(?<![\w.+/@#-])(?:1[ -])?\(\d{3}\) ?\d{3}[ .-]\d{4}" + _EXT + _END),
        ("phone", "trunk one", False, "long", _at("1") + r"[-. ]\d{3}[-. ]\d{3}[-. ]\d{4}" + _EXT + _END),
        ("phone", "ten", False, "long", _at(r"\d") + r"\d{2}([-. ])\d{3}\1\d{4}" + _EXT + _END),
        ("phone", "five pairs", False, "long", _at("0") + r"\d(?:[. -]\d{2}){4}" + _END),
        ("phone", "slash", False, "long", _at("0") + r"\d{2,4}/\d{3,6}(?:[ -]\d{2,4})?" + _END),
        ("phone", "trunk zero", False, "long", _at("0") + r"\d{2,4} \d{3,4} ?\d{3,4}" + _END),
        ("address", "english, postcode", True, "english", rf"(?<![\w.])(?:(?:Unit|Flat|Suite) \d+[A-Z]?, )?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:{_EN})\b\.?(?:, (?:Apt|Unit|Suite|Flat)\.? \w+)?{_GAP}{_PLACE},? (?:[A-Z]{{2}} )?\d{{5}}\b"),
        ("address", "english", False, "english", rf"(?<![\w.])(?:(?:Unit|Flat|Suite) \d+[A-Z]?, )?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:{_EN})\b\.?(?:, (?:Apt|Unit|Suite|Flat)\.? \w+)?{_GAP}{_CAP}"),
        ("address", "english, flat", False, "english", rf"(?<![\w.])(?:Unit|Flat|Suite) \d+[A-Z]?, \d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:{_EN})\b|(?<![\w.])\d{{1,5}} (?:{_CAP} ){{1,3}}(?:{_EN})\b\.?, (?:Apt|Unit|Suite|Flat)\.? \w+"),
        ("address", "capitals", False, "capitals", rf"(?<![\w.])\d{{1,5}} (?:[A-Z]{{3,}} ){{1,3}}(?:{_EN.upper()})\b,? [A-Z]{{3,}}(?: \d{{5}})?"),
        ("address", "german", True, "post", rf"(?<![\w.])(?:(?:Am|Im|An der|An den|Auf der|Auf dem|Zum|Zur) )?{_CAP}(?:[ -]{_CAP})?\.? \d{{1,4}} ?[a-z]?, (?:D-)?\d{{5}} {_CAP}"),
        ("address", "german, no town", False, "german", rf"(?<![\w.]){_CAP}(?:straße|strasse|str\.|weg|steig|platz|allee|gasse|damm|ufer) \d{{1,4}}\b"),
        ("address", "french, postcode", True, "french", rf"(?<![\w.])\d{{1,4}}(?: (?:bis|ter))?,? (?:{_FR})(?: d(?:u|e|es)(?: la)?)? ?(?:[lLdD]['’])?[\w'’ -]{{2,40}}?, \d{{5}} {_PLACE}"),
        ("address", "french", False, "french", rf"(?<![\w.])\d{{1,4}}(?: (?:bis|ter))?,? (?:{_FR})(?: d(?:u|e|es)(?: la)?)? ?(?:[lLdD]['’])?(?:{_CAP}[ -]?){{1,3}}, {_PLACE}"),
        ("address", "spanish", True, "spanish", rf"(?<![\w.])(?:{_ES})(?: d(?:el|e)(?: l[ao]s?)?)? (?:{_CAP} ){{1,3}}\d{{1,4}}(?:, ?\d{{1,2}}\.? ?[ºª°]\.?(?: ?[A-Z]\b)?)?, (?:\d{{5}} )?{_PLACE}"),
        ("address", "any", False, "post", rf"(?<![\w.])(?:[{_LOW}]{{1,5}}\.? )?(?:{_CAP}[ -]){{1,4}}\d{{1,4}} ?[a-z]?(?:/\d{{1,4}})?, (?:[A-Z]{{1,3}}-)?\d[\d -]{{1,6}}\d(?: [A-Z]{{2}})? {_CAP}"),
    ]
]
#: A number of any shape. Whether that shape is a phone number, an identity number or neither only the patterns around it say.
_NUMBER = re.compile(r"(?<![\w.+/@#:=\\-])(?:[A-Z]{1,3}[ -]?)?\(?\d(?:[()./ -]{0,2}\d){6,17}(?:[ -]?[A-Z])?(?![\w@%]|[./:-]\d)")
_SIX = re.compile(r"\d(?:[ ()./-]{0,3}\d){5}")
_POST = re.compile(r", (?:[A-Z]{1,3}-)?\d[\d -]{1,6}\d ?[A-Z]")
_IN_TEXT = {  # any of these must be in the text (in the text in lower case for `label` and `dot`)
    "at": ("@",),
    "bracket": tuple(f"{a}{b}{c}" for a in ("at", "AT", "@") for b in ("", " ") for c in ")]}>"),
    "english": tuple(f" {w}" for w in _EN.split("|")),
    "capitals": tuple(f" {w.upper()}" for w in _EN.split("|")),
    "german": ("stra\u00dfe ", "strasse ", "str. ", "weg ", "steig ", "platz ", "allee ", "gasse ", "damm ", "ufer "),
    "french": ("rue", "avenue", "boulevard", "place", "chemin", "impasse", "all\u00e9e", "allee", "quai", "cours", "route", "passage", "square"),
    "spanish": ("Calle", "Avenida", "Avda", "Plaza", "Paseo", "Camino", "Carrera", "Ronda", "Traves\u00eda", "C/"),
    "explain": ("(social security)", "(ssn)", "(dni)", "(passport)", "(tax id)", " as national insurance ", " as social security ", " as passport ", " as tax "),
}
_IN_LOWER = {"dot": (" dot ",), "label": ("ssn", "social security", "passport", "national insurance", "ni n", "nie", "n.i", "ni.", "dni", "steuer", "tax id", "national", "insurance no", "id card")}
_NAME = re.compile(rf"[{_UP}](?<![\w@/_\\.#-].)(?<!\.\..)[{_LOW}]++(?:-{_CAP})*(?:(?:\. |, | (?:[A-Z]\.? )?){_CAP}(?:-{_CAP})*)*(?![\w@/_]|[.-]\w|[(\[]at[)\]])")
_PARTS = re.compile(_CAP)
_LOWER = re.compile(rf"(?<![\w@./_+-])[{_LOW}]{{2,}}+(?![\w@/_+]|[.-]\w| ?[(\[]at| at \w+ dot)")
_PLAIN = re.compile(rf"(?<![\w@./_+-])(?:[{_LOW}]{{3,}}+|[{_UP}]{{3,}}+)(?![\w@/_+]|[.-]\w| ?[(\[]at| at \w+ dot)")
_WORD = re.compile(rf"[{_UP}{_LOW}]{{3,}}")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|([nrt\"\\/]))")
_DIGIT = re.compile(r"\d")
_BLUR = [(re.compile(p), r) for p, r in ((r"\b[a-z]\w*/[\w./]+", "<path>"), (r"\b[a-z]+_\w+", "<fn>"), (r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,}\b", "<hex>"), (r"\d+", "9"))]


def view(text: str) -> tuple[str, list[int] | None]:
    """The text with JSON escapes undone, and each character's place in the text (None: the text itself)."""
    if "\\" not in text:
        return text, None
    out, at, last = [], [], 0
    for m in _ESCAPE.finditer(text):
        out.append(text[last : m.start()])
        at += range(last, m.start())
        out.append(chr(int(m.group(1), 16)) if m.group(1) else {"n": "\n", "r": "\r", "t": "\t"}.get(m.group(2), m.group(2)))
        at.append(m.start())
        last = m.end()
    out.append(text[last:])
    at += range(last, len(text) + 1)
    return "".join(out), at


@lru_cache(1 << 16)
def _blur(s: str) -> str:
    """A piece without blanks: paths, names of functions, hashes and numbers in one form each, in lower case."""
    for mark, (p, r) in zip("/_", _BLUR):
        if mark in s:
            s = p.sub(r, s)
    if _DIGIT.search(s):
        for p, r in _BLUR[2:]:
            s = p.sub(r, s)
    return s.lower()


def contexts(v: str, a: int, b: int) -> tuple[str, str, str]:
    """Patterns of a span: the two pieces before, the two after, and the ones on either side, within REACH characters. Numbers, paths and names of functions are blurred; a line's start and end count as pieces."""
    l = ["^", *v[max(0, a - REACH) : a].rpartition("\n")[2].split()][-2:]  # noqa: E741
    r = [*v[b : b + REACH].partition("\n")[0].split(None, 2)[:2], "$"][:2]
    l, r = [_blur(x) for x in l], [_blur(x) for x in r]  # noqa: E741
    return " ".join(l), " ".join(r), f"{l[-1]} _ {r[0]}"


def _shape(s: str) -> str:
    return re.sub(r"[A-Za-zß-ÿ]+", "a", re.sub(r"\d", "9", s))


@lru_cache(2)
def _automaton(which: int):
    a = ahocorasick.Automaton()
    for g, ws in (_IN_TEXT, _IN_LOWER)[which].items():
        for w in ws:
            a.add_word(w, (a.get(w, ()) + (g,)))
    a.make_automaton()
    return a


def _hits(which: int, v: str):
    """(place, groups) of the words of a table in a text, all looked for in one pass where the automaton is installed."""
    if ahocorasick is not None:
        yield from _automaton(which).iter(v)
        return
    for g, ws in (_IN_TEXT, _IN_LOWER)[which].items():
        for w in ws:
            at = v.find(w)
            while at >= 0:
                yield at, (g,)
                at = v.find(w, at + 1)


def _gates(texts: list[str], joined: str, starts: list[int]) -> dict[int, set[str]]:
    """Index of a text -> the gates it passes; `joined` are the texts on lines of their own, which begin at `starts`."""
    out: dict[int, set[str]] = {}
    low = [t.lower() for t in texts]  # may be longer
    for which, v, at in ((0, joined, starts), (1, "\n".join(low), list(accumulate((len(t) + 1 for t in low), initial=0)))):
        for place, groups in _hits(which, v):
            out.setdefault(bisect_right(at, place) - 1, set()).update(groups)
    for g, p in (("long", _SIX), ("post", _POST)):
        for m in p.finditer(joined):
            out.setdefault(bisect_right(starts, m.start()) - 1, set()).add(g)
    return out


def candidates_in(texts: list[str]) -> list[tuple]:
    """(index of the text, then as in candidates_of) of many texts. Texts that pass no gate have only names, which are looked for in all of them at once."""
    seen = [view(t) for t in texts]
    views = [v for v, _ in seen]
    joined, starts = "\n".join(views), list(accumulate((len(v) + 1 for v in views), initial=0))
    gates = _gates(views, joined, starts)
    single = {i for i, (_, at) in enumerate(seen) if at is not None} | set(gates)
    out = [(i, *c) for i in single for c in candidates_of(texts[i], gates.get(i, set()))]
    for m in _NAME.finditer(joined):
        a, b = m.span()
        i = bisect_right(starts, a) - 1
        if i not in single:
            s = starts[i]
            out.append((i, a - s, b - s, "person", None, False, *contexts(joined, a, b), [(p.group(), a - s + p.start(), a - s + p.end()) for p in _PARTS.finditer(m.group())]))
    return out


def candidates_of(text: str, open_: set[str] | None = None) -> list[tuple]:
    """(start, end, type, instance key, seed, left, right, around, name parts) of a text, not overlapping except for names."""
    v, at = view(text)
    out, taken = [], []
    open_ = _gates([v], v, [0]).get(0, set()) if open_ is None else open_
    for kind, form, seed, gate, pattern in FORMS:
        if gate not in open_:
            continue
        for m in pattern.finditer(v):
            a, b = m.span("x") if "x" in pattern.groupindex else m.span()
            if any(a < y and x < b for x, y in taken):
                continue
            taken.append((a, b))
            key = form if kind == "email" or (kind == "address" and form != "any") or form in ("labelled", "explained") else f"{form} {_shape(m.group().rpartition(',')[2])}"
            out.append((a, b, kind, key, seed, *contexts(v, a, b), None))
    if "long" in open_:
        for m in _NUMBER.finditer(v):
            a, b = m.span()
            if not any(a < y and x < b for x, y in taken):
                taken.append((a, b))
                near = contexts(v, a, b)
                out += [(a, b, kind, f"any {_shape(m.group())}", False, *near, None) for kind in ("phone", "id_number")]
    rest = v
    for a, b in taken:
        rest = rest[:a] + "\x00" * (b - a) + rest[b:]
    for m in _NAME.finditer(rest):
        a, b = m.span()
        out.append((a, b, "person", None, False, *contexts(v, a, b), [(p.group(), a + p.start(), a + p.end()) for p in _PARTS.finditer(m.group())]))
    if at is not None:
        out = [(at[a], at[b], *rest, parts and [(w, at[x], at[y]) for w, x, y in parts]) for a, b, *rest, parts in out]
    return out


_PARTS_TYPE = pa.list_(pa.struct([("word", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
_FOUND = pa.schema([("message_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("key", pa.string()), ("seed", pa.bool_()), ("l", pa.string()), ("r", pa.string()), ("around", pa.string()), ("parts", _PARTS_TYPE), ("n", pa.int64())])
_FOUND_SQL = "message_id long, row long, start int, end int, kind string, key string, seed boolean, l string, r string, around string, parts array<struct<word: string, a: int, b: int>>, n long"
AT_ONCE = 4_000_000  # characters of texts that are searched at once
WORDS = 200_000  # words that a task adds up before it hands their counts on


def scan(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over all texts: all candidates, and, as rows of kind 'word', how often each word (key) is written in small letters (n).

    `row` tells apart the texts of one id. Null texts have no candidates; a null id is kept.
    """

    def words(acc):
        return pa.RecordBatch.from_arrays([pa.nulls(len(acc), f.type) if f.name not in ("kind", "key", "n") else pa.array(["word"] * len(acc) if f.name == "kind" else list(acc) if f.name == "key" else list(acc.values()), f.type) for f in _FOUND], schema=_FOUND)

    def run(batches):
        acc: Counter = Counter()
        for batch in batches:
            ids, rows, texts = (c.to_pylist() for c in batch.columns)
            got, a = [], 0
            while a < len(texts):  # a few megabytes at a time, however long the texts are
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= AT_ONCE):
                    size, b = size + len(texts[b]), b + 1
                got += [(ids[a + i], rows[a + i], *c) for i, *c in candidates_in(texts[a:b])]
                acc.update(_LOWER.findall("\n".join(texts[a:b])))
                a = b
            if got:
                cols = list(zip(*got))
                cols[10] = [p and [{"word": w, "a": x, "b": y} for w, x, y in p] for p in cols[10]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, _FOUND)), pa.nulls(len(got), pa.int64())], schema=_FOUND)
            if len(acc) > WORDS:
                yield words(acc)
                acc = Counter()
        if acc:
            yield words(acc)

    return _texts(messages, id_col, text_col).mapInArrow(run, _FOUND_SQL)


def _texts(messages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return messages.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("message_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))


def ordinary_words(cands: DataFrame, words: DataFrame) -> DataFrame:
    """(key): the capitalised words that are written small three times as often, and PRIOR times more. A share, so that it stays the same as data grow."""
    capital = cands.filter("kind = 'person'").select(F.explode("parts.word").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_capital"))
    return capital.join(words, F.lower(capital["key"]) == words["word"]).filter(F.col("n_lower") >= 3 * F.col("n_capital") + PRIOR).select("key")


def graph(cands: DataFrame, ordinary: DataFrame, roster: DataFrame) -> DataFrame:
    """The pattern-instance graph: (kind, key, seed, patterns, alone, n), one row for each way an instance is surrounded; `alone` says that a word has no other capitalised word beside it.

    Instances of names are their words. Words that are written in lower case far more often than with a capital are
    ordinary words and no instances.
    """
    around = F.array(F.concat(F.lit("L "), "l"), F.concat(F.lit("R "), "r"), F.concat(F.lit("A "), "around"))
    shapes = cands.filter("kind <> 'person'").select("kind", "key", "seed", around.alias("patterns"))
    part = cands.filter("kind = 'person'").select("parts", around.alias("near"), F.posexplode("parts.word").alias("i", "key"))
    word = F.col("parts.word")
    beside = F.array_compact(F.array(F.when(F.col("i") > 0, F.concat(F.lit("N "), F.get(word, F.col("i") - 1))), F.when(F.col("i") < F.size("parts") - 1, F.concat(F.lit("N "), F.get(word, F.col("i") + 1)))))
    names = part.select(F.lit("person").alias("kind"), "key", F.concat("near", beside).alias("patterns"), (F.size("parts") == 1).alias("alone"))
    seeds = roster.select(F.explode(F.array("given_name", "family_name")).alias("key")).filter("key is not null").select("key", F.lit(True).alias("seed")).distinct()
    counted = names.groupBy("kind", "key", "patterns", "alone").agg(F.count(F.lit(1)).alias("n"))
    names = counted.join(ordinary, "key", "left_anti").join(seeds, "key", "left").select("kind", "key", F.coalesce("seed", F.lit(False)).alias("seed"), "patterns", "alone", "n")
    return materialise(shapes.groupBy("kind", "key", "seed", "patterns").agg(F.count(F.lit(1)).alias("n")).withColumn("alone", F.lit(False)).unionByName(names), "pii_graph")


def pattern_confidence(edges: DataFrame, accepted: DataFrame) -> DataFrame:
    """(pattern, kind, confidence): the share of `kind` among what a pattern surrounds, weighed down for few occurrences. Patterns below PURE are left out.

    Counted are the accepted instances of all types, all words that might be names, and numbers of any shape, which are there
    once for either type; instances of stated forms that are not accepted yet speak neither for nor against.
    """
    loose = F.col("key").startswith("any ")
    typed = accepted.filter(loose).select("key", F.lit(True).alias("typed")).distinct()
    known = edges.join(accepted.withColumn("yes", F.lit(True)), ["kind", "key"], "left").join(typed, "key", "left")
    known = known.filter(F.col("yes") | (F.col("kind") == "person") | (loose & (F.col("kind") == "phone") & F.col("typed").isNull())).select(F.when(F.col("yes"), F.col("kind")).alias("kind"), "n", F.explode("patterns").alias("pattern"))
    per = known.groupBy("pattern", "kind").agg(F.sum("n").alias("n"))
    total = per.groupBy("pattern").agg(F.sum("n").alias("total"))
    return per.filter("kind is not null").join(total, "pattern").withColumn("confidence", F.col("n") / (F.col("total") + 0.5)).filter(F.col("confidence") >= PURE).select("pattern", "kind", "confidence")


def scores(edges: DataFrame, confidence: DataFrame) -> DataFrame:
    """(kind, key, score): the mean, over an instance's occurrences, of the confidence of its best pattern for its type, 0 where none speaks for it.

    A word that only scores beside names (as in "Ask <name>"), while what surrounds it alone speaks for nothing, scores 0; one
    occurrence in its favour is presumed. Shapes of any kind have half an occurrence against them, so that a single one isn't enough.
    """
    e = edges.select("kind", "key", "n", "alone", F.xxhash64("kind", "key", "seed", "patterns", "alone").alias("at"), F.explode("patterns").alias("pattern"))
    best = e.join(confidence, ["pattern", "kind"], "left").groupBy("kind", "key", "at").agg(F.first("n").alias("n"), F.first("alone").alias("alone"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    lone = F.when(F.col("alone"), F.col("n")).otherwise(0)
    s = best.groupBy("kind", "key").agg((F.sum(F.col("n") * F.col("c")) / (F.sum("n") + F.when(F.col("key").startswith("any "), 0.5).otherwise(0.0))).alias("score"), F.sum(lone).alias("n_alone"), F.sum(lone * F.col("c")).alias("c_alone"))
    return s.select("kind", "key", F.when(F.col("c_alone") + 1 < 0.25 * F.col("n_alone"), 0.0).otherwise(F.col("score")).alias("score"))


def _threshold(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ACCEPT.items() for x in kv]), kind)


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(accepted instances (kind, key), pattern confidences) after the rounds. Seeds stay accepted."""
    seeds = edges.filter("seed").select("kind", "key").distinct()
    accepted, confidence = seeds, None
    for _ in range(rounds):
        confidence = materialise(pattern_confidence(edges, accepted), "pii_patterns")
        better = scores(edges, confidence).filter(F.col("score") >= F.when(F.col("key").startswith("any "), ANY).otherwise(_threshold(F.col("kind"))))
        better = better.groupBy("key", F.col("kind") == "person").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")).select("kind", "key")  # a shape is of the type that its patterns speak for most
        accepted = materialise(seeds.unionByName(better).distinct(), "pii_instances")
    return accepted, confidence


def entities(cands: DataFrame, ordinary: DataFrame, accepted: DataFrame, confidence: DataFrame) -> DataFrame:
    """(message_id, row, start, end, kind): the candidates that are personal information.

    A number or address of any shape counts where its shape was accepted, or where what surrounds it speaks for its type almost
    surely. A name reaches from its first accepted word to its last. A run of capitalised words none of which is accepted counts
    where what surrounds it speaks for persons almost surely; an exact check leaves out runs with an ordinary word in them
    (names of components).
    """
    yes = accepted.withColumn("yes", F.lit(True))
    at = ["message_id", "row", "start", "end"]
    shapes = cands.filter("kind <> 'person'").join(yes, ["kind", "key"]).select(*at, "kind")
    loose = cands.filter(F.col("key").startswith("any ")).select(*at, "kind", F.concat(F.lit("A "), "around").alias("pattern"))  # what is on one side only doesn't do: a unit may follow
    sure = loose.join(confidence.filter("kind <> 'person' and confidence >= 0.9").select("kind", "pattern"), ["kind", "pattern"], "left_semi").select(*at, "kind").distinct()
    people = cands.filter("kind = 'person'").select(*at, "l", "around", F.explode("parts").alias("p")).select(*at, "l", "around", F.col("p.word").alias("key"), "p.a", "p.b")
    ordinary = ordinary.withColumn("ordinary", F.lit(True))
    p = people.join(yes.filter("kind = 'person'").select("key", "yes"), "key", "left").join(ordinary, "key", "left")
    spans = p.groupBy(*at, "l", "around").agg(F.min(F.when(F.col("yes"), F.col("a"))).alias("a"), F.max(F.when(F.col("yes"), F.col("b"))).alias("b"), F.max(F.coalesce("ordinary", F.lit(False))).alias("any_word"))
    named = spans.filter("a is not null").select("message_id", "row", F.col("a").alias("start"), F.col("b").alias("end"))
    placed = spans.filter("a is null and not any_word").select(*at, F.explode(F.array(F.concat(F.lit("A "), "around"), F.concat(F.lit("L "), "l"))).alias("pattern")).join(_sure(confidence), "pattern", "left_semi").select(*at).distinct()
    return shapes.unionByName(sure).unionByName(named.unionByName(placed).withColumn("kind", F.lit("person")))


def _bit(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % (8 * FILTER)


def uncapitalised(messages: DataFrame, id_col: str, text_col: str, accepted: DataFrame, confidence: DataFrame) -> DataFrame:
    """(message_id, row, start, end, kind): names of two words written in small or in capital letters only.

    A second pass looks for pairs with a bit map of the accepted names, FILTER bytes whatever their number; joins then
    make sure of them. Both words must be accepted names, or one of them where the pattern speaks for persons almost surely.
    """
    names = accepted.filter("kind = 'person'").select("key").distinct()

    def bits(batches):
        own = bytearray(FILTER)
        for b in batches:
            for w in b["key"]:
                i = _bit(w.lower())
                own[i >> 3] |= 1 << (i & 7)
        if any(own):
            yield pd.DataFrame({"at": [i for i, x in enumerate(own) if x], "v": [x for x in own if x]}, dtype="int32")

    table = bytearray(FILTER)
    for r in names.mapInPandas(bits, "at int, v int").groupBy("at").agg(F.bit_or("v").alias("v")).collect():  # FILTER rows at most
        table[r["at"]] = r["v"]
    shared = messages.sparkSession.sparkContext.broadcast(bytes(table))
    out_schema = pa.schema([("message_id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("one", pa.string()), ("two", pa.string()), ("l", pa.string()), ("around", pa.string())])

    def run(batches):
        on, memo = shared.value, {}

        def may(w: str) -> bool:
            if w not in memo:
                if len(memo) >= WORDS:
                    memo.clear()
                i = _bit(w)
                memo[w] = bool(on[i >> 3] >> (i & 7) & 1)
            return memo[w]

        for b in batches:
            cols = [[] for _ in out_schema]
            for i, row, text in zip(*(c.to_pylist() for c in b.columns)):
                if not any(may(w) for w in _WORD.findall(text.lower())):  # most texts have no word that is a name
                    continue
                last = None
                for m in _PLAIN.finditer(text):
                    if last and last.end() + 1 == m.start() and text[last.end()] == " " and last.group().islower() == m.group().islower() and (may(m.group().lower()) or may(last.group().lower())):
                        for c, x in zip(cols, (i, row, last.start(), m.end(), last.group().capitalize(), m.group().capitalize(), *contexts(text, last.start(), m.end())[::2])):
                            c.append(x)
                    last = m
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

    pairs = _texts(messages, id_col, text_col).mapInArrow(run, "message_id long, row long, start int, end int, one string, two string, l string, around string")
    known = names.withColumn("yes", F.lit(1))
    judged = pairs.join(known.select(F.col("key").alias("one"), F.col("yes").alias("y1")), "one", "left").join(known.select(F.col("key").alias("two"), F.col("yes").alias("y2")), "two", "left").join(_sure(confidence).select(F.col("pattern").alias("p1"), F.lit(1).alias("y3")), F.concat(F.lit("A "), "around") == F.col("p1"), "left").join(_sure(confidence).select(F.col("pattern").alias("p2"), F.lit(1).alias("y4")), F.concat(F.lit("L "), "l") == F.col("p2"), "left")
    hits = F.coalesce("y1", F.lit(0)) + F.coalesce("y2", F.lit(0))
    return judged.filter((hits == 2) | ((hits == 1) & F.coalesce("y3", "y4").isNotNull())).select("message_id", "row", "start", "end", F.lit("person").alias("kind"))


def _sure(confidence: DataFrame) -> DataFrame:
    """The surroundings, and pairs of words before, that speak for persons almost surely."""
    return confidence.filter("kind = 'person' and confidence >= 0.9 and (pattern like 'A %' or pattern like 'L %')").select("pattern").distinct()


def find(messages: DataFrame, roster: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(message_id, row, start, end, kind): all personal information; `row` is the hash of the text, so rows with a null id are found too."""
    found = materialise(scan(messages, id_col, text_col), "pii_candidates")
    cands, words = found.filter("kind <> 'word'"), found.filter("kind = 'word'").groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n_lower"))
    ordinary = materialise(ordinary_words(cands, words), "pii_ordinary")
    accepted, confidence = bootstrap(graph(cands, ordinary, roster))
    listed = roster.select(F.lit("person").alias("kind"), F.explode(F.array("given_name", "family_name")).alias("key")).filter("key is not null")
    return entities(cands, ordinary, accepted, confidence).unionByName(uncapitalised(messages, id_col, text_col, accepted.unionByName(listed), confidence))


def redact(messages: DataFrame, found: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(message_id, text): every row's text with each entity replaced by its placeholder and the rest untouched; null stays null."""
    spans = found.select(F.col("message_id").alias("_id"), F.col("row").alias("_row"), "start", "end", "kind").distinct().groupBy("_id", "_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans"))
    m = messages.select(F.col(id_col).alias("message_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))

    def run(batches):
        for b in batches:
            out = []
            for i, text, spans in b.itertuples(index=False, name=None):
                if isinstance(text, str) and spans is not None:
                    pieces, at = [], 0
                    for s in spans:
                        if s["start"] >= at:
                            pieces += [text[at : s["start"]], PLACEHOLDER[s["kind"]]]
                            at = s["end"]
                    text = "".join([*pieces, text[at:]])
                out.append((i, text))
            if out:
                yield pd.DataFrame(out, columns=["message_id", "text"])

    return m.join(spans, F.col("message_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left").select("message_id", "text", "spans").mapInPandas(run, "message_id long, text string")


def altered(messages: DataFrame, redacted: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(n_rows, n_altered): rows, and those whose redacted text is not its text with pieces taken out: what stands between placeholders must be in the text, in order."""
    marks = re.compile("|".join(re.escape(p) for p in PLACEHOLDER.values()))

    def run(batches):
        for b in batches:
            bad = 0
            for text, red in b[["text", "red"]].itertuples(index=False, name=None):
                if not isinstance(text, str) or not isinstance(red, str):
                    bad += isinstance(text, str) != isinstance(red, str)
                    continue
                at, pieces = 0, marks.split(red)
                for k, piece in enumerate(pieces):
                    at = text.find(piece, at) if k else (0 if text.startswith(piece) else -1)
                    if at < 0:
                        break
                    at += len(piece)
                bad += at < 0 or not text.endswith(pieces[-1])
            yield pd.DataFrame({"n": [len(b)], "bad": [bad]})

    one = messages.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).groupBy("i").agg(F.count(F.lit(1)).alias("c"), F.min("text").alias("text"))
    red = redacted.groupBy(F.col("message_id").alias("j")).agg(F.count(F.lit(1)).alias("c2"), F.min("text").alias("red"))
    j = one.filter("c = 1").join(red, F.col("i").eqNullSafe(F.col("j")), "left").select("text", "red")  # repeated ids can't be told apart
    return j.mapInPandas(run, "n long, bad long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_altered")).filter("n_rows > 0")
