import re

from pyspark.sql import functions as F

from passagekit.llm import surrogates as s

TEXT = [(1, "mail Ann.Lee@mail3.Example.com or ann.lee@mail3.example.com, card 4539 5787 6362 1486 and 4539578763621486."),
        (2, "card 4952935900253052; ip 97.51.17.173. Call +1 (017) 555-7713 now"), (3, None), (4, ""), (5, "nothing here 12 3.4"),
        (6, "Mr. John Smith met Mrs. Anna Smith and Frau Weiß; Herr Иван Петров too"), (6, "Mr. John Smith met Mrs. Anna Smith and Frau Weiß; Herr Иван Петров too"),
        (None, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 97.51.17.173'), (8, "ssn 123-45-6789 DE89 3704 0044 0532 0130 00"),
        (9, "a" * 50_000 + "@x " + "b@c.de")]


def test_replacements(spark):
    docs = spark.createDataFrame([(*r, "z", 1) for r in TEXT], "doc_id long, text string, sur string, kind int")
    out = s.pseudonymise(docs, "k")
    got = {(r.doc_id, i): r for i, r in enumerate(sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)))}
    rows = {}
    for (d, _), r in got.items():
        rows.setdefault(d, []).append(r)
    assert sum(map(len, rows.values())) == len(TEXT)
    old = "|".join(["ann.lee", "4539 5787", "4539578763621486", "97.51.17.173", "555-7713", "04dbebab", "123-45-6789", "3704 0044", "Smith", "Weiß", "Петров", "b@c.de"])
    for rs in rows.values():
        for r in rs:
            assert not r.text or not re.search(old, r.text, re.I), r.text
    one = re.match(r"mail (\S+) or (\S+), card ([\d ]+) and (\d+)\.$", rows[1][0].text)
    assert one[1].lower() == one[2] and one[3].replace(" ", "") == one[4]            # coreference over spellings
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", one[3]) and sum(
        sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(one[4]))) % 10 == 0
    two = re.match(r"card \d{16}; ip (\d+\.\d+\.\d+\.\d+)\. Call \+\d \(\d{3}\) \d{3}-\d{4} now$", rows[2][0].text)
    token = re.match(r'token = "([0-9a-f]{40})" (\S+)$', rows[None][0].text)
    assert token[2] == two[1] and all(0 < int(x) < 256 for x in two[1].split("."))
    assert rows[3][0].text is None and rows[4][0].text == "" and rows[5][0].text == TEXT[4][1]
    name = re.match(r"Mr\. (\S+) (\S+) met Mrs\. (\S+) (\S+) and Frau (\S+); Herr (\S+) (\S+) too$", rows[6][0].text)
    assert name[2] == name[4] and name[1] in s.GIVEN["m", "latin"] and name[3] in s.GIVEN["f", "latin"]
    assert name[6] in s.GIVEN["m", "cyrillic"] and rows[6][0].text == rows[6][1].text
    assert "Python" not in out._jdf.queryExecution().toString() and "MapInArrow" not in out._jdf.queryExecution().toString()


def test_stand_ins_are_distinct_and_never_real(spark):
    """Family names alone: so few stand-ins that many draws clash."""
    rows = [("name", f"Name{chr(97 + i % 26)}{chr(97 + i // 26)}", None) for i in range(600)]
    m = spark.createDataFrame([(*r, 0) for r in rows], "kind string, raw string, gender string, pos int")
    got = s.entity_table(m, "k").collect()
    assert len(got) == 600 and len({r.sur.lower() for r in got}) == 600
    assert not {r.sur.lower() for r in got} & {r[1].lower() for r in rows}


def test_stand_ins_never_run_out(spark):
    """One family, formats that hold few values, and an address nothing can redraw."""
    rows = [("name", f"{chr(65 + i % 26)}{chr(97 + i // 26)}x Smith", None) for i in range(400)]
    rows += [("phone", f"+1 {i:02d} {j:02d}", None) for i in range(10, 40) for j in range(10, 40)]
    rows += [("email", x, None) for x in ("-@-.b", "_@-.b")]
    m = spark.createDataFrame([(*r, 0) for r in rows], "kind string, raw string, gender string, pos int")
    got = s.entity_table(m, "k").collect()
    digits = lambda k, x: re.sub("[^0-9]", "", x) if k == "phone" else x.lower()
    sur = {(r.kind, digits(r.kind, r.sur)) for r in got}
    assert len(got) == len(sur) == len(rows) and not sur & {(k, digits(k, x)) for k, x, _ in rows}
    assert len({r.sur.split(" ", 1)[1] for r in got if r.kind == "name"}) == 1


def test_keyed_and_empty(spark, empty):
    docs = spark.createDataFrame(TEXT[:2], "doc_id long, text string")
    a, b, c = (sorted(r.text for r in s.pseudonymise(docs, k).collect()) for k in ("k", "k", "other"))
    assert a == b != c
    assert s.pseudonymise(empty, "k").collect() == []


def test_all_planted_entities_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lambda d: {x for r in d.select(F.regexp_extract_all("text", F.lit(s.PATTERN), F.lit(0)).alias("m")).collect() for x in r.m or []}
    before, after = found(docs), found(s.pseudonymise(docs, "k"))
    assert len(before) > 20 and not before & after and len(after) == len(before)


def test_hint_is_in_every_entity(spark):
    whole = [s.FORMATS[k] for k in s.FORMATS]
    rows = [(x,) for x in ["a@b.c", "a1bc2de3fa4bc5de6fa7bc8de9fa0bcd", "+1 22 33", "(12) 345-678", "1.2.3.4", "Sra. Ana", "Monsieur X Y",
                           "Señora Álvarez", "Mme Duval", "DE89 3704 0044 0532", "123-45-6789"]]
    out = spark.createDataFrame(rows, "t string").select(F.col("t").rlike(s.PATTERN).alias("p"), F.col("t").rlike(s.HINT).alias("h")).collect()
    assert whole and all(r.h for r in out if r.p) and sum(r.p for r in out) >= 8


def test_other_layouts_go_whole(spark):
    """Long secrets, national telephone numbers, cards of 13 to 19 digits, names of many words."""
    valid = lambda x: sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10 == 0
    cards = ["378282246310005", "3782 822463 10005", "4222222222222", "6304000000000000000", "6304 0000 0000 0000 000", "30569309025904"]
    phones = ["555-123-4567", "555.123.4567", "555 123 4567"]
    names = ["John Adam Baker Smith", "Karl Maximilian" + "x" * 60]
    secret = "0123456789abcdef" * 20
    rows = [(i, f"a {x} b") for i, x in enumerate([secret, *phones, *cards])] + [(50 + i, f"Mr. {x}, b") for i, x in enumerate(names)]
    rows += [(90, "on 2024-10-11 1.2.3 555-12 12345 123456789012 units"), (91, "Mr. " + "Aa " * 20_000)]
    out = {r.doc_id: r for r in s.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    got = [out[i].text[2:-2] for i in range(1 + len(phones) + len(cards))]
    assert re.fullmatch("[0-9a-f]{320}", got[0]) and got[0] != secret
    assert len(set(got[1:4])) == 3 and len({re.sub("[^0-9]", "", x) for x in got[1:4]}) == 1
    for old, new in zip([*phones, *cards], got[1:], strict=True):
        assert old != new and re.sub("[0-9]", "0", old) == re.sub("[0-9]", "0", new), (old, new)
    assert got[4] == got[5].replace(" ", "") and got[7] == got[8].replace(" ", "")
    for old, new in zip(cards, got[4:], strict=True):
        assert valid(re.sub("[^0-9]", "", old)) == valid(re.sub("[^0-9]", "", new))
    for i, name in enumerate(names):
        new = re.fullmatch(r"Mr\. (.*), b", out[50 + i].text)[1]
        assert len(new.split()) == len(name.split()) and not set(new.split()) & set(name.split())
    assert (out[90].text, out[90].n_entities) == (rows[-2][1], 0)
    assert out[91].n_entities == 1 and "Aa" not in out[91].text


def test_known_names_go_without_their_form_of_address(spark):
    rows = [(1, "Mr. John Smith came. John Smith said, and John Smithson heard; Smith left."), (2, "John Smith is not known here."),
            (3, "г-н Иван Петров и госпожа Анна Петрова; Иван Петров ушёл"), (4, "Frau Ann-Marie Low, ann-marie low, Ann-Marie Low. Call 555-123-4567")]
    out = {r.doc_id: r for r in s.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    one = re.fullmatch(r"Mr\. (.+) came\. (.+) said, and John Smithson heard; Smith left\.", out[1].text)
    assert one[1] == one[2] != "John Smith" and out[1].n_entities == 2
    assert out[2].text == rows[1][1]
    three = re.fullmatch(r"г-н (.+) и госпожа (.+); (.+) ушёл", out[3].text)
    assert three[1] == three[3] and "Петров" not in out[3].text and "Иван Петров" not in out[3].text
    assert three[1].split()[0] in s.GIVEN["m", "cyrillic"] and three[2].split()[0] in s.GIVEN["f", "cyrillic"]
    four = re.fullmatch(r"Frau (.+), ann-marie low, (.+)\. Call \d{3}-\d{3}-\d{4}", out[4].text)
    assert four[1] == four[2] != "Ann-Marie Low"


def test_against_a_plain_version(spark):
    """Detection by the fixed formats in plain Python, then: what lies between
    mentions is unchanged, one stand-in per entity in the whole corpus, no two
    entities with one, and none that is a real entity."""
    import random

    import regex
    rng = random.Random(12)
    people = [f"{a} {b}" for a in ("John", "Anna", "Ewa") for b in ("Smith", "Weiß", "Low-Reed")]
    pool = ["a.b@c.de", "A.B@C.DE", "x_1@mail.example.org", "+1 (017) 555-7713", "+1 (017) 5557713", "4539 5787 6362 1486", "4539578763621486",
            "123-45-6789", "DE89 3704 0044 0532 0130 00", "97.51.17.173", "0123456789abcdef" * 2, *people]
    say = lambda: " ".join(rng.choice(["so", "it", "Went", "on", "12", "3.4", "and"]) for _ in range(rng.randint(1, 6)))
    rows = []
    for i in range(80):
        parts = [say()]
        for _ in range(rng.randint(0, 5)):
            x = rng.choice(pool)
            parts += [rng.choice(["Mr. ", "Mrs ", ""]) + x + rng.choice([",", ";"]) if x in people else x, say()]
        rows.append((i, " ".join(parts)))
    rows += [rows[3], (None, rows[5][1]), (200, None), (201, "")]
    out = s.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, r)
    stand_in, kinds = {}, [(k, regex.compile(f"^(?:{v})$")) for k, v in s.FORMATS.items()]

    def entity(raw):
        kind = next((k for k, v in kinds if v.match(raw)), "name")
        canon = regex.sub("[^0-9]", "", raw) if kind in ("phone", "card", "ssn") else raw.lower().replace(" ", "") if kind == "iban" else raw.lower()
        return kind, canon

    for i, text in rows:
        if not text:
            assert got[i].text == text
            continue
        names = {m[0] for m in regex.finditer(s.MALE + "|" + s.FEMALE, text)}
        pattern = s.PATTERN + "".join(rf"|(?<![\p{{L}}\p{{N}}]){regex.escape(n)}(?![\p{{L}}\p{{N}}])" for n in sorted(names, key=lambda n: (-len(n), n)))
        found = [(m.start(), m.end()) for m in regex.finditer(pattern, text)]
        assert got[i].n_entities == len(found), text
        new, at, end = got[i].text, 0, 0
        for n, (b, e) in enumerate(found):
            gap = text[end:b]
            assert new.startswith(gap, at), (text, new)
            at += len(gap)
            after = text[e:found[n + 1][0]] if n + 1 < len(found) else text[e:]
            stop = new.index(after, at + 1) if after and n + 1 < len(found) else len(new) - len(after)
            kind, canon = entity(text[b:e])
            mine = entity(new[at:stop])[1] if kind in ("phone", "card", "ssn", "iban") else new[at:stop].lower()
            assert stand_in.setdefault((kind, canon), mine) == mine, (text, new)
            at, end = stop, e
        assert new[at:] == text[end:]
    for kind in {k for k, _ in stand_in}:
        real = {c for k, c in stand_in if k == kind}
        fake = [v for (k, _), v in stand_in.items() if k == kind]
        assert len(fake) == len(set(fake)) and not real & set(fake)
