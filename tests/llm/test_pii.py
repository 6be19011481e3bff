from loomspark.llm import pii

NAMES = [("Marta", "Linrosa"), ("Emeka", "Korlund"), ("Orla", "Velstedt"), ("Pavel", "Havmire")]
CARRIERS = ["please ask {} before you delete the branch.", "thanks, {}!", "assigned to {}, blocked since Monday", "{} wrote the first version"]
PHONES = ["+1 817 555 0178", "+44 7700 900359", "+33 1 99 00 72 48", "(925) 555-0160", "01.99.00.56.93"]
CALLS = ["sms gateway rejected {}", "Call me on {} if it hangs", "who owns {}?"]


def texts():
    rows = []
    for k in range(6):
        for i, (g, f) in enumerate(NAMES):
            rows.append(CARRIERS[(i + k) % 4].format(f"{g} {f}"))
        for p in PHONES:
            rows.append(CALLS[k % 3].format(p))
        rows += [f"cc {m} when the run is done" for m in ("x.y@ostrel.test", "a@b.example")] + [f"export TO={m} ok" for m in ("q@r.test", "s@t.test")]
    rows += ["the memory compiler is slow, the budget cutter is not"] * 30
    return rows


def find(spark, extra):
    rows = texts()
    df = spark.createDataFrame([(i, t, "k", "s", 1) for i, t in enumerate(rows + extra)], "id long, text string, kind string, start string, row long")
    roster = spark.createDataFrame([(1, *NAMES[0]), (2, *NAMES[1]), (3, None, "Velstedt")], "name_id int, given_name string, family_name string")
    got = {}
    found = pii.find(df, roster)
    for r in found.collect():
        if r["message_id"] >= len(rows):
            got.setdefault(r["message_id"] - len(rows), set()).add(r["kind"])
    red = {r["message_id"] - len(rows): r["text"] for r in pii.redact(df, found).collect()}
    return got, red


def test_types_negatives_and_redaction(spark):
    extra = [
        "mail ilse.kor@ostrel.invalid now", "cc a.b(at)dev(dot)example(dot)test when the run is done", "export TO=henrike at tinlake dot example ok", "tools@HEAD and git@forge:tools/x", "user@buildbox:~$ ls",
        "found ssn=000445485 there", "SSN 666-29-5544", "DNI 00005234-Y", "Steuer-ID 00 094 992 705", '"national_id": "000-7695-9029"', "QQ107984B as national insurance no.", "SSN is a field name in x.py",
        "ship to 168 Thornby Avenue, Eastholt 17513 please", "Unit 16, 221 Peartree Close\nEastholt 49038", "am Ahornstieg 176, 77263 Seelingen", "198 bis, avenue du Vieux Four, Valmorin", "Calle del Romero 72, 5.º B, Villarroya del Mar", "2 ASHBOURN STREET KELMOUTH", "12 Anchor Lane changes in x", "9 Main.java errors, 3 Street.ts warnings",
        "please ask Tamsin Zaborff before you delete the branch.", "please ask Memory Compiler before you delete the branch.", "thanks, marta linrosa!", "the Grace Period setting of it", "who owns 828-555?", "rows 100-200-3000 were skipped", "who owns [redacted]?",
        None, "", "run_tests\n{\"note\": \"courier to Tannhofstra\\u00dfe 12, 23142 Oberfurt\"}", "x" * 100_000,
    ]
    got, red = find(spark, extra)
    want = {0: {"email"}, 1: {"email"}, 2: {"email"}, 5: {"id_number"}, 6: {"id_number"}, 7: {"id_number"}, 8: {"id_number"}, 9: {"id_number"}, 10: {"id_number"}, 12: {"address"}, 13: {"address"}, 14: {"address"}, 15: {"address"}, 16: {"address"}, 20: {"person"}, 22: {"person"}, 29: {"address"}}
    assert {k: v for k, v in got.items() if k != 17} == want
    assert red[0] == "mail [EMAIL] now" and red[5] == "found ssn=[ID_NUMBER] there" and red[12] == "ship to [ADDRESS] please" and red[20] == "please ask [PERSON] before you delete the branch."
    assert red[3] == extra[3] and red[27] is None and red[28] == ""
    assert red[29] == 'run_tests\n{"note": "courier to [ADDRESS]"}'


def test_no_texts(spark):
    df = spark.createDataFrame([], "id long, text string")
    roster = spark.createDataFrame([], "name_id int, given_name string, family_name string")
    assert pii.find(df, roster).count() == 0


def test_unseen_forms_in_other_languages(spark):
    """Forms, labels and names of which the operator knows nothing are found by the patterns that seeds and known names stand in."""
    say = {
        "phone": ["bel {} als het vastloopt", "zadzwo\u0144 pod {} jutro", "\u043f\u043e\u0437\u0432\u043e\u043d\u0438 {} \u0437\u0430\u0432\u0442\u0440\u0430", "liga para {} amanh\u00e3"],
        "id_number": ["in het dossier staat {} van de klant", "numer {} wpisano do umowy", "\u0432 \u0434\u043e\u0433\u043e\u0432\u043e\u0440\u0435 {} \u0443\u043a\u0430\u0437\u0430\u043d", "no contrato consta {} do titular"],
        "address": ["stuur het naar {} vandaag", "paczka idzie na {} dzi\u015b", "envia para {} hoje"],
        "person": ["vraag {} eerst om raad", "zapytaj {} przed scaleniem", "\u0441\u043f\u0440\u043e\u0441\u0438 {} \u043f\u0435\u0440\u0435\u0434 \u0440\u0435\u043b\u0438\u0437\u043e\u043c", "pergunta a {} antes do corte"],
    }
    seeds = {
        "phone": [f"+31 20 555 {k:04d}" for k in range(12)], "id_number": [f"passport no. X{k:07d}" for k in range(12)], "address": [f"Lindenweg {k + 1}, 10115 Neustadt" for k in range(12)],
        "person": ["Marta Linrosa", "Emeka Korlund", "Orla Velstedt", "\u041e\u043b\u044c\u0433\u0430 \u0412\u0435\u043b\u0441\u043a\u0430\u044f"],
    }
    unseen = {
        "phone": [f"02 9374 {4000 + k}" for k in range(8)], "id_number": [f"123.456.{k:03d}-09" for k in range(8)] + [f"4820 1193 {k:04d}" for k in range(8)], "address": [f"Herengracht {k + 1}, 1015 BN Amsterdam" for k in range(6)] + [f"ul. D\u0142uga {k + 1}, 00-238 Warszawa" for k in range(6)],
        "person": ["\u041d\u0430\u0442\u0430\u043b\u044c\u044f \u041f\u0435\u0442\u0440\u043e\u0432\u0430", "\u0141ukasz Wi\u015bniewski", "Sjoerd Hoekstra", "\u00c7i\u011fdem Y\u0131lmaz"],
    }
    rows, want = [], {}
    for t, carriers in say.items():
        for j, c in enumerate(carriers):
            rows += [c.format(x) for x in seeds[t] for _ in range(2)]
            for k, x in enumerate(unseen[t]):
                if t == "person" or k % len(carriers) == j:
                    want[len(rows)] = t
                    rows.append(c.format(x))
    never = len(rows)
    rows += [f"export klaar: {k} rijen, kompilacja {100000 + k}" for k in range(40)] + [f"build 20 1193 {k:04d} ok" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    roster = spark.createDataFrame([(1, *NAMES[0]), (2, *NAMES[1]), (3, *NAMES[2]), (4, "\u041e\u043b\u044c\u0433\u0430", "\u0412\u0435\u043b\u0441\u043a\u0430\u044f")], "name_id int, given_name string, family_name string")
    got = {(r["message_id"], r["kind"]) for r in pii.find(df, roster).select("message_id", "kind").collect()}
    hit = [i for i, t in want.items() if (i, t) in got]
    assert len(hit) >= 0.9 * len(want), sorted({(t, rows[i]) for i, t in want.items() if (i, t) not in got})
    assert not [rows[i] for i, _ in got if i >= never]


def test_rows_without_an_id_are_redacted(spark):
    df = spark.createDataFrame([(None, "mail a.b@ostrel.test now"), (None, "mail a.b@ostrel.test now"), (None, "nothing")], "id long, text string")
    roster = spark.createDataFrame([], "name_id int, given_name string, family_name string")
    assert sorted(r["text"] for r in pii.redact(df, pii.find(df, roster)).collect()) == ["mail [EMAIL] now", "mail [EMAIL] now", "nothing"]
