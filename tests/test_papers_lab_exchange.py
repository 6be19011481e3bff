import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from loomspark.operators import lab, papers
from loomspark.sources import exchange as ex


def test_html():
    h = "<html><head><title>t</title><script>x()</script></head><body><nav>menu</nav><h1>A &amp; B</h1><p>one<b> two</b></p><math alttext='a^2'>a2</math><img alt='curve'><ul><li>x</li></ul></body></html>"
    assert papers.html_text(h).split("\n") == ["t", "A & B", "", "one two", "$a^2$[figure: curve]", "", "x"] or "A & B" in papers.html_text(h)
    assert "menu" not in papers.html_text(h) and "x()" not in papers.html_text(h) and papers.html_text(None) is None and papers.html_text("") == ""


TEX = r"""\documentclass{article} % comment
\newcommand{\sys}{LoomX}
\title{On \emph{things}}
\begin{document}
\section{Intro} \label{a} We use \sys{} at 50\% cost~\cite{x} and $a_1 + b$. \input{part}
\subsection{Deep} \textbf{bold} text
\section*{Free}
\end{document}"""


def test_tex(spark):
    t = papers.detex(TEX)
    assert "LoomX" in t and "50% cost" in t and "$a_1 + b$" in t and "comment" not in t and "cite" not in t and "bold text" in t
    assert [(a, b, c) for a, b, c, _ in papers.tex_outline(TEX)] == [(1, "1", "Intro"), (2, "1.1", "Deep"), (1, "", "Free")]
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as f:
        for n, s in (("main.tex", TEX), ("Part.tex", "included words"), ("../evil.tex", "no")):
            i = tarfile.TarInfo(n)
            i.size = len(s)
            f.addfile(i, io.BytesIO(s.encode()))
    assert "../evil.tex" not in papers.unpack(buf.getvalue())
    df = spark.createDataFrame([(1, bytearray(buf.getvalue())), (2, bytearray(gzip.compress(TEX.encode()))), (3, None)], "i long, b binary")
    got = {r["id"]: r for r in papers.tex_documents(df, "i", "b").collect()}
    assert "included words" in got[1]["text"] and got[1]["title"] == "On things" and got[2]["sections"] == ["1 Intro", "1.1 Deep", "Free"] and got[3]["text"] is None


def test_outline_pages_ids(spark):
    df = spark.createDataFrame([("d", 1, "1 Intro\ntext\n1.1 Deep\n# Mark"), ("d", 2, "2 Next\n2 Next\n")], "id string, page int, text string")
    o = papers.section_ends(papers.outline(df, "id", "page", "text"))
    got = {r["title"]: (r["level"], tuple(r["end"]) if r["end"] else None) for r in o.collect()}
    assert got == {"1 Intro": (1, (1, 3)), "1.1 Deep": (2, (1, 3)), "# Mark": (1, (2, 0)), "2 Next": (1, None)}
    assert papers.page_numbers("1-3,7,-1,2", 9) == [1, 2, 3, 7, 9] and papers.page_numbers("", 2) == [1, 2]
    with pytest.raises(ValueError):
        papers.page_numbers("x", 3)
    ids = spark.createDataFrame([("https://arxiv.org/abs/2101.00001v2",), ("hep-th/9901001v1",), ("none",), (None,)], "r string")
    assert [r[0] for r in ids.select(papers.arxiv_id(F.col("r"))).collect()] == ["2101.00001", "hep-th/9901001", None, None]
    a = spark.createDataFrame([({"b": [1], "a": [0, 2]},), ({},)], "m map<string,array<int>>")
    assert [r[0] for r in a.select(papers.abstract(F.col("m"))).collect()] == ["a b a", ""]
    feed = spark.createDataFrame([('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title>T\n x</title><author><name>A</name></author></entry></feed>',), ("bad",)], "x string")
    assert papers.atom_entries(feed, "x").first()["title"] == "T x"


def test_lab(spark):
    log = spark.createDataFrame([("METRIC loss=1.5\nnoise METRIC x=1\nMETRIC loss=0.5\n METRIC acc = 2e-1",), (None,), ("",)], "t string")
    got = [r[0] for r in log.select(lab.metrics_of_log(F.col("t"))).collect()]
    assert got[0] == {"loss": 0.5, "acc": 0.2} and got[1] is None and got[2] == {}
    cols = "run_id string, exp_id string, commit_sha string, command string, status string, exit_code int, metrics string, answered int, verdict string, started_at string, ended_at string"
    runs = spark.createDataFrame([("R1 ", "e", "c", "x", "done", 0, '{"a": 1.5}', 1, "win", "2026-01-01T00:00:00Z", "2026-01-01T00:01:00Z"), ("r1", "e", "c", "x", "running", None, None, 0, None, "2026-01-01T00:00:00Z", None), ("r2", "e", "c", "x", "failed", 1, "{bad", 0, None, "2026-01-02T00:00:00Z", None), (None, "e", "c", "x", "done", 0, None, 1, None, None, None)], cols)
    v = lab.run_view(runs)
    got = {r["run_id"]: r for r in v.collect()}
    assert set(got) == {"r1", "r2"} and got["r1"]["duration_s"] == 60 and got["r1"]["metrics"] == {"a": 1.5}
    s = lab.summary(v).first()
    assert (s["n_runs"], s["win"], s["n_answered"], s["unjudged"]) == (2, 1, 1, "r2") and lab.frozen_by(v).first()["run_id"] == "r1"
    links = spark.createDataFrame([("m", "R1"), ("m", "zz")], "memory_id string, run_id string")
    assert lab.evidence(v, links).first()["sentence"] == "run r1 done: a=1.500, judged win"


def test_exchange(spark):
    n = spark.createDataFrame([("a", "memory", "f.g", "body -- one", "ACTIVE"), ("b", "memory", None, None, "ACTIVE"), ("x", "symbol", "f.g", None, "DELETED")], ex.NODES)
    e = spark.createDataFrame([("a", "b", "K", 0.5), ("a", "x", "K", 1.0), ("a", "zz", "K", 1.0)], ex.EDGES)
    g = ex.build([n], e)
    assert g[1].count() == 1
    back = ex.read_bundle(spark, ex.write_bundle(*g))
    assert sorted(map(tuple, back[0].collect()), key=str) == sorted(map(tuple, g[0].collect()), key=str) and back[1].collect() == g[1].collect()
    m = ex.merge(g, (spark.createDataFrame([("a", "memory", "other", "z", "ACTIVE"), ("c", "memory", "c", "new", "ACTIVE")], ex.NODES), e.limit(0)))
    assert {(r["id"], r["label"]) for r in m[0].collect()} == {("a", "f.g"), ("b", None), ("c", "c")}
    stored = spark.createDataFrame([("new",)], "body string")
    syms = spark.createDataFrame([("s1", "f.g")], "symbol_id string, symbol_path string")
    assert [(r["id"], r["symbol_id"]) for r in ex.import_graph(stored, m[0], syms).collect() if r["body"]] == [("a", "s1")]
    t = ex.managed_block("top\n", "r1\nr2")
    assert t.startswith("top\n") and ex.managed_block(t, "r3").count("begin") == 1 and "r2" not in ex.managed_block(t, "r3")
