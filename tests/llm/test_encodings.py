from loomspark.llm import encodings as enc

CLEAN = ["Die Größe wäre für spätere Läufe möglich – „sehr“ groß.", "La función está vacía, ¿por qué? Según la medición subió.", "Старые ключи нельзя использовать повторно, порядок стал постоянным.", "Le résumé généré n’indique pas la durée réelle.", "Należy usunąć zbędne blokady i powtórzyć próbę, gdy ścieżka.", "CONFIGURAÇÃO PADRÃO: São não há versões da função."]


def garble(t, meant, read):
    return t.encode(meant, "replace").decode(read, "replace")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", i) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, chain string, lost long")


def run(spark, rows):
    df = frame(spark, rows)
    return {r["doc_id"]: r for r in enc.detect(df, "doc_id", "text", "source", enc.fit(enc.vocabulary(df, "text", "source")), True).collect()}


def test_chains_are_found_and_undone(spark):
    base = [(t, "a") for t in CLEAN] * 30
    bad = [(garble(CLEAN[0], "utf-8", "latin-1"), CLEAN[0]), (garble(CLEAN[1], "utf-8", "cp437"), CLEAN[1]), (garble(CLEAN[2], "utf-8", "cp1251").replace("�", "\x98"), None), (garble(garble(CLEAN[3], "utf-8", "cp1252"), "utf-8", "cp1252"), CLEAN[3]), (garble(CLEAN[4], "iso8859-2", "cp1252"), CLEAN[4]), (garble(CLEAN[2], "koi8-r", "cp1251"), CLEAN[2]), (garble(CLEAN[1], "cp1252", "cp850"), CLEAN[1])]
    rows = base + [(t, "a") for t, _ in bad] + [("plain\nand " + bad[0][0] + "\nend", None), ("lost � here", "b"), ("quoted `Ã¼` and `�` only", "b"), (None, "b"), ("", None), ("only ascii & text", "b"), ("x" * 200_000, "b")]
    got = run(spark, rows)
    n = len(base)
    assert set(got) == {n + i for i in range(len(bad))} | {n + len(bad), n + len(bad) + 1}
    for i, (_, want) in enumerate(bad):
        if want is not None:
            assert got[n + i]["text"] == want, got[n + i]["chain"]
    assert got[n + len(bad)]["text"] == "plain\nand " + CLEAN[0] + "\nend"
    assert got[n + len(bad) + 1]["chain"] is None and got[n + len(bad) + 1]["lost"] == 1


def test_quotes_stay_when_a_line_is_repaired():
    line = garble("für `Ã¼` größer", "utf-8", "cp1252")
    assert enc.repair_line(garble("für", "utf-8", "cp1252") + " `Ã¼` x", 0) == "für `Ã¼` x" and "`" in line


def test_empty_table(spark):
    assert run(spark, []) == {}
