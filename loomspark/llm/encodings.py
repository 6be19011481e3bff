"""Garbled text from wrong character encoding: expectation-maximisation over latent encoding chains.

The words with non-ASCII characters are counted per source. Each may be as it should be, or the result of one of the
chains below, in which case undoing the chain gives the word that was meant. A character bigram model of the meant
words and the share of each chain in each source are estimated together: the E step weighs a word's readings, the M
step counts shares and bigrams by those weights. So texts that leave it open what happened to them are judged by what
happened to others of their source. The model has a fixed size, whatever the corpus: hashed bigram counts and hashed
sources. At last each line of each text gets the posterior of its chains, and lines are repaired by the likeliest.
"""

from __future__ import annotations

import html
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BITS, SOURCES, ROUNDS = 18, 256, 4
KNOWN = 200_000  # readings that a task keeps before it begins anew
SURE = 2.0  # log odds from which a line counts as garbled
FORM = 6.0  # log odds of one sequence of characters that spells valid UTF-8
LOST = "�"

#: Chains whose wrong step read UTF-8 bytes in another encoding: name -> (encoding, times). cp1252 stands for Latin-1 too.
UTF8 = {f"utf-8 as {c}" + f" x{n}" * (n > 1): (c, n) for n, cs in ((1, ("cp1252", "cp1251", "cp1250", "iso8859-2", "cp437", "cp850", "cp852", "mac_roman", "cp866", "koi8-r", "cp1253", "cp1254", "cp1257", "iso8859-15")), (2, ("cp1252", "mac_roman", "cp437", "cp850", "cp1251")), (3, ("cp1252",))) for c in cs}
#: Chains within single-byte encodings: (meant, read as).
BYTES = [
    ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "cp1250"), ("iso8859-2", "cp1252"), ("cp1250", "cp1252"), ("cp852", "cp1252"), ("cp1250", "cp852"), ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"),
    ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1251", "cp866"), ("cp1251", "iso8859-5"), ("iso8859-5", "cp1251"), ("cp1251", "mac_cyrillic"),
]
CHAINS = [*UTF8, *(f"{a} as {b}" for a, b in BYTES), "entities"]
QUOTED = re.compile(r"`[^`]*`")
ODD = re.compile(r"(?:[^\x00-\x7f]|&[A-Za-z]{2,8}[0-9]{0,2};)+(?:[A-Za-z]*(?:[^\x00-\x7f]|&[A-Za-z]{2,8}[0-9]{0,2};)+)*")
ENTITY = re.compile(r"&[A-Za-z]{2,8}[0-9]{0,2};")


def _table(codec: str) -> dict[str, int]:
    """character -> byte above 127; bytes without a character are taken as C1 controls, as lenient decoders do."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec in ("cp1252",):
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


_TO_BYTE: dict[str, dict[str, int]] = {}


def _bytes(s: str, codec: str) -> bytes | None:
    t = _TO_BYTE.get(codec)
    if t is None:
        t = _TO_BYTE[codec] = _table(codec)
    out = bytearray()
    for ch in s:
        o = ord(ch)
        if o < 128:
            out.append(o)
        elif (b := t.get(ch)) is None:
            return None
        else:
            out.append(b)
    return bytes(out)


def undo_utf8(s: str, codec: str, times: int) -> str | None:
    """The text whose UTF-8 bytes, read as `codec` (so often), give s; None if there is none."""
    for _ in range(times):
        raw = _bytes(s, codec)
        if raw is None:
            return None
        try:
            t = raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
        if t == s:
            return None
        s = t
    return s


def undo_bytes(s: str, meant: str, read_as: str) -> str | None:
    raw = _bytes(s, read_as)
    if raw is None:
        return None
    try:
        return raw.decode(meant)
    except UnicodeDecodeError:
        return None


def readings(word: str) -> list[tuple[int, str, float]]:
    """(chain number, meant word, evidence of form) of every chain that can have made this word out of another.

    Characters that happen to spell valid UTF-8 are improbable in a text that is as it should be: each such sequence
    counts as FORM. Where a white-space trim or a lost soft hyphen broke the last byte off, there is no such evidence.
    """
    out: list[tuple[int, str, float]] = []
    if ENTITY.search(word):
        t = undo_utf8(html.unescape(word), "cp1252", 1)
        if t is not None:
            out.append((len(CHAINS) - 1, t, FORM * sum(c > "\x7f" for c in t)))
        return out
    for k, (codec, times) in enumerate(UTF8.values()):
        t, sequences = word, 0
        for _ in range(times):
            t = undo_utf8(t, codec, 1)
            if t is None:
                break
            sequences += sum(c > "\x7f" for c in t)
        if t is not None:
            out.append((k, t, FORM * sequences))
    if not out and "\u00c3" in word:
        t = undo_utf8("\u00c3\xa0" if word == "\u00c3" else re.sub("\u00c3(?=[A-Za-z]|$)", "\u00c3\xad", word), "cp1252", 1)
        if t is not None:
            out.append((0, t, 0.0))
    for k, (meant, read_as) in enumerate(BYTES, len(UTF8)):
        t = undo_bytes(word, meant, read_as)
        if t is not None and t != word:
            out.append((k, t, 0.0))
    return [x for x in out if not any("\x7f" <= c < "\xa0" or c == LOST for c in x[1])]


def spans(line: str) -> list[tuple[int, int]]:
    """Where a line has words with non-ASCII characters or named entities, with the letters around them."""
    out = []
    for m in ODD.finditer(line):
        if m.group().isascii() and not re.search(r"&[A-Z]?[a-z]{2,}", m.group()):
            continue
        a, b = m.span()
        while a and line[a - 1].isalpha() and line[a - 1].isascii():
            a -= 1
        while b < len(line) and line[b].isalpha() and line[b].isascii():
            b += 1
        out.append((a, b))
    return out


def words(line: str) -> list[str]:
    """The words at `spans`, without those with lost characters."""
    return [w for a, b in spans(line) if LOST not in (w := line[a:b])]


def lines(text: str) -> list[str]:
    """The lines that matter: what is quoted between back-ticks is left out."""
    if text.isascii() and "&" not in text:
        return []
    return [x for x in QUOTED.sub("``", text).split("\n") if not x.isascii() or "&" in x]


def _slot(a: str, b: str) -> int:
    """The place of a pair of characters in the hashed counts; '' stands for any character."""
    return (((ord(a) if a else 1) * 0x9E3779B1 + (ord(b) if b else 1) * 0x85EBCA6B) >> 7) & ((1 << BITS) - 1)


def source_slot(source: str | None) -> int:
    return 0 if source is None else 1 + zlib.crc32(source.encode("utf-8", "replace")) % (SOURCES - 1)


class Model:
    """Hashed bigram counts, one-character counts and the chains' shares by hashed source."""

    def __init__(self, pairs: np.ndarray, shares: np.ndarray):
        self.pairs, self.shares = pairs, shares
        self._own: dict[str, float] = {}
        self._first: dict[str, float] = {}

    def __getstate__(self):
        return {"pairs": self.pairs, "shares": self.shares, "_own": {}, "_first": {}}

    @staticmethod
    def start() -> Model:
        shares = np.full((SOURCES, len(CHAINS) + 1), 1e-3)
        shares[:, 0] = 1 - 1e-3 * len(CHAINS)
        return Model(np.zeros(1 << BITS), shares)

    def _p(self, two: str) -> float:
        """log P(second character | first), backed off to the second character's own frequency."""
        v = self._own.get(two)
        if v is None:
            a, b = two
            total = max(self.pairs[_slot("", "")], 1.0)
            one = (self.pairs[_slot("", b)] + 0.1) / (total + 300)
            v = self._own[two] = math.log((self.pairs[_slot(a, b)] + 2 * one) / (self.pairs[_slot("", a)] + 2))
        return v

    def forget(self) -> None:
        """Empty the cache of probabilities."""
        self._own.clear()

    def score(self, word: str) -> float:
        w = "\x02" + word + "\x03"
        return sum(self._p(w[i : i + 2]) for i in range(len(w) - 1))

    def odds(self, word: str) -> list[tuple[int, float, str]]:
        """(chain, log odds against the word as it is, without the chains' shares, meant word)."""
        own = self.score(word)
        return [(k, self.score(t) + form - own, t) for k, t, form in readings(word)]


def _count(acc: np.ndarray, word: str, n: float) -> None:
    w = "\x02" + word + "\x03"
    for i in range(len(w) - 1):
        acc[_slot(w[i], w[i + 1])] += n
        acc[_slot("", w[i])] += n
    acc[_slot("", "\x03")] += n
    acc[_slot("", "")] += n * len(w)


def vocabulary(docs: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """(slot, word, n, chains, meant): all words with non-ASCII characters, counted per source over all texts, with their readings."""

    def run(batches):
        acc: dict[tuple[int, str], int] = {}
        for b in batches:
            for source, text in zip(b["source"], b["text"]):
                if not isinstance(text, str):
                    continue
                s = source_slot(source if isinstance(source, str) else None)
                for line in lines(text):
                    for w in words(line):
                        acc[s, w] = acc.get((s, w), 0) + 1
            if len(acc) > 200_000:
                yield pd.DataFrame([(s, w, n) for (s, w), n in acc.items()], columns=["slot", "word", "n"])
                acc = {}
        if acc:
            yield pd.DataFrame([(s, w, n) for (s, w), n in acc.items()], columns=["slot", "word", "n"])

    def read(batches):
        for b in batches:
            r = [readings(w) for w in b["word"]]
            yield b.assign(chains=[[x[0] for x in y] for y in r], meant=[[x[1] for x in y] for y in r], form=[[x[2] for x in y] for y in r])

    counted = docs.select(F.col(source_col).alias("source"), F.col(text_col).alias("text")).mapInPandas(run, "slot int, word string, n long").groupBy("slot", "word").agg(F.sum("n").alias("n"))
    spread = counted.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")  # small in bytes, but each word costs time: not to be merged into one task
    return materialise(spread.mapInPandas(read, "slot int, word string, n long, chains array<int>, meant array<string>, form array<double>"), "words")


def fit(vocab: DataFrame, rounds: int = ROUNDS) -> Model:
    """EM over the vocabulary. What comes back to the driver each round is at most 2^BITS bigram counts and SOURCES x chains shares."""
    model = Model.start()
    for r in range(rounds + 1):
        first = r == 0  # the first round takes every word as it is

        def step(batches, model=model, first=first):
            pairs, shares = np.zeros(1 << BITS), np.zeros(SOURCES * (len(CHAINS) + 1))
            for b in batches:
                for slot, word, n, ks, ts, fs in b.itertuples(index=False, name=None):
                    base = slot * (len(CHAINS) + 1)
                    if first or not len(ks):
                        _count(pairs, word, n)
                        shares[base] += n
                        continue
                    pi = model.shares[slot]
                    logs = [math.log(pi[0]) + model.score(word), *(math.log(pi[k + 1]) + model.score(t) + f for k, t, f in zip(ks, ts, fs))]
                    top = max(logs)
                    w = [math.exp(x - top) for x in logs]
                    z = sum(w)
                    for p, k, t in zip(w, [-1, *ks], [word, *ts]):
                        if p / z > 1e-4:
                            _count(pairs, t, n * p / z)
                            shares[base + k + 1] += n * p / z
            i, j = np.nonzero(pairs)[0], np.nonzero(shares)[0]
            yield pd.DataFrame({"at": np.concatenate([i, (1 << BITS) + j]), "v": np.concatenate([pairs[i], shares[j]])})

        got = vocab.mapInPandas(step, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros((1 << BITS) + SOURCES * (len(CHAINS) + 1))
        flat[got["at"].to_numpy(dtype=np.int64)] = got["v"].to_numpy()
        shares = model.shares
        if not first:  # a chain never seen keeps a small share
            own = flat[1 << BITS :].reshape(SOURCES, -1)
            shares = own + own.sum(axis=0, keepdims=True) / max(own.sum(), 1) * 20 + 1e-4
            shares = shares / shares.sum(axis=1, keepdims=True)
        model = Model(flat[: 1 << BITS], shares)
    return model


def judge(line: str, slot: int, model: Model, known: dict) -> tuple[int, float] | None:
    """(chain, log odds) of the likeliest chain of a line, if any can be."""
    total: dict[int, float] = {}
    for w in words(line):
        o = known.get(w)
        if o is None:
            o = known[w] = [(k, x) for k, x, _ in model.odds(w) if x > 0]
        for k, x in o:
            total[k] = total.get(k, 0.0) + x
    best = max(((x + math.log(model.shares[slot][k + 1] / model.shares[slot][0]), k) for k, x in total.items()), default=None)
    return (best[1], best[0]) if best else None


def repair_line(line: str, chain: int) -> str:
    """The line with every word undone that the chain can have made; what is quoted between back-ticks stays."""
    quoted = [m.span() for m in QUOTED.finditer(line)]
    out, at = [], 0
    for a, b in spans(line):
        if any(q < b and a < r for q, r in quoted):
            continue
        out += [line[at:a], {k: t for k, t, _ in readings(line[a:b])}.get(chain, line[a:b])]
        at = b
    return "".join([*out, line[at:]])


def detect(docs: DataFrame, id_col: str, text_col: str, source_col: str, model: Model, with_text: bool = False) -> DataFrame:
    """(doc_id, chain, log_odds, lost[, text]) of the texts that are garbled in any place.

    chain: the commonest among the text's garbled lines, null if characters are only lost. lost: characters that can't be
    had back. text: with every garbled line repaired by its likeliest chain. Null and empty texts are never garbled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = "doc_id long, chain string, log_odds double, lost int" + ", text string" * with_text

    def run(batches):
        m, known = shared.value, {}
        for b in batches:
            out = []
            if len(known) > KNOWN:  # a cache of bounded size
                known.clear()
                m.forget()
            for i, source, text in zip(b["doc_id"], b["source"], b["text"]):
                if not isinstance(text, str) or (text.isascii() and "&" not in text):
                    continue
                slot = source_slot(source if isinstance(source, str) else None)
                found: dict[int, float] = {}
                lost = 0
                fixed = {}
                for line in lines(text):
                    lost += line.count(LOST)
                    got = judge(line, slot, m, known)
                    if got and got[1] > SURE:
                        found[got[0]] = found.get(got[0], 0.0) + got[1]
                        fixed[line] = got[0]
                if found or lost:
                    k = max(found, key=found.get) if found else None
                    row = (i, CHAINS[k] if k is not None else None, sum(found.values()), lost)
                    if with_text:
                        row += ("\n".join(repair_line(x, fixed[q]) if (q := QUOTED.sub("``", x)) in fixed else x for x in text.split("\n")),)
                    out.append(row)
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "chain", "log_odds", "lost", *["text"] * with_text])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).mapInPandas(run, schema)
