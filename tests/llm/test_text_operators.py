"""Training-data operators on text: stated cases, plain restatements, and odd inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from finstrata.llm import confusions, eval_leaks, languages, packing, page_noise, repeated_lines, residue

PAGES = "id string, document_id string, page_number int, text string, language string, lines string, key string, word string, h long"


def pages(spark, rows):
    """rows: (id, document, number, text, language), beside columns whose names the operators use within."""
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], PAGES)


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_fold_is_blind_to_confusions():
    for printed, read in confusions.CONFUSIONS:
        for frame in ("ab{}yz", "{}", "r{}i", "e{}l", "n{}n"):
            assert confusions.fold_str(frame.format(printed)) == confusions.fold_str(frame.format(read)), (printed, read, frame)


def test_fold_is_the_same_in_both_engines(spark):
    words = ["Savvmill", "m0dular", "ÉOLIENNE", "rcported", "", "wieclerkehrender", "p@gina"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.f for r in df.select(confusions.fold(F.col("w")).alias("f")).collect()] == [confusions.fold_str(w) for w in words]


def repeated_by_brute_force(rows):
    found = set()
    docs = {}
    for i, d, n, t, _ in rows:
        docs.setdefault(d, []).append((i, n, t or ""))
    for own in docs.values():
        where = {}
        for i, n, t in own:
            for no, line in enumerate(t.split("\n"), 1):
                if sum(c.isalpha() for c in line) >= 12:
                    key = re.sub(rf"(?<!\w){n}(?!\w)", "#", line.lower())
                    where.setdefault(re.sub(r"\s+", "", key), []).append((i, no))
        for places in where.values():
            n = len({i for i, _ in places})
            if n >= 4 and n * 3 >= len(own):
                found |= set(places)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_repeated_lines(spark, seed):
    rng = random.Random(seed)
    rows = []
    for d in ("a", "b", None):
        for n in range(1, 13):
            lines = [f"Unique sentence {''.join(rng.choices('abcdefgh', k=12))} here"] * rng.choice([1, 2])
            lines += [x for x in ("Annual  Report of the Group", f"Group Holdings  {n}  Annual Report", "SHARE THIS PAGE | PRINT NOW", "short", "") if rng.random() < 0.45]
            rng.shuffle(lines)
            rows.append((f"{d}{n}", d, n, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines), None))
    rows.append(("empty", "a", 13, "", None))
    rows.append(("null", "b", None, None, None))
    df = pages(spark, rows)
    got = pairs(repeated_lines.repeated_line_occurrences(df), "page_id", "line_no")
    assert set(got) == repeated_by_brute_force(rows) and len(got) == len(set(got))
    cleaned = {r.page_id: r.text for r in repeated_lines.without_repeated_lines(df).collect()}
    for i, _, _, t, _ in rows:
        kept = [line for no, line in enumerate((t or "").split("\n"), 1) if (i, no) not in set(got)]
        assert (cleaned[i] or "") == "\n".join(kept)


def test_misread_repetitions_and_sequences(spark):
    text = "Unaudited unless marked otherwise.\nAll other rights are reserved.\n"
    rows = [(str(n), "d", n, text + f"Own text of page number {'abcdef'[n]} goes here\n", None) for n in range(5)] + [("5", "d", 5, text.replace("marked", "rnarked").replace("rights", "ri9hts"), None)]
    df = pages(spark, rows)
    assert len(pairs(repeated_lines.repeated_line_occurrences(df), "page_id", "line_no")) == 12
    found = repeated_lines.frequent_sequences(df).collect()
    assert sorted((len(r.sequence), r.support) for r in found) == [(2, 6)]  # either line alone has no more


def closed_by_brute_force(sequences, least):
    """Every pattern of at least `least` sequences that no longer pattern has as many of."""
    support = {}
    for items in sequences:
        for p in {tuple(x for k, x in enumerate(items) if mask >> k & 1) for mask in range(1, 1 << len(items))}:
            support[p] = support.get(p, 0) + 1
    frequent = {p: n for p, n in support.items() if n >= least}
    within = lambda p, q: (lambda rest: all(x in rest for x in p))(iter(q))
    return sorted((p, n) for p, n in frequent.items() if not any(len(q) > len(p) and m == n and within(p, q) for q, m in frequent.items()))


@pytest.mark.parametrize("seed", range(4))
def test_sequences_of_any_length_are_mined(spark, seed):
    rng = random.Random(seed)
    known = [f"line of repeated words {w}" for w in ("alpha", "orbit", "planet", "summer", "forest", "yacht", "jumping")]
    rows, sequences = [], {"a": [], None: []}
    for d in sequences:
        for n in range(1, 13):
            own = known[:4] * (rng.random() < 0.8) + [x for x in known[4:] if rng.random() < 0.6]
            if rng.random() < 0.2:
                rng.shuffle(own)
            own += own[:1] if rng.random() < 0.2 else []
            rows.append((f"{d}{n}", d, n, "\n".join(own), None))
            sequences[d].append(own)
    got = {}
    for r in repeated_lines.frequent_sequences(pages(spark, rows)).collect():
        got.setdefault(r.document_id, []).append((tuple(r.sequence), r.support))
    key = {r.k: x for x in known for r in spark.range(1).select(F.xxhash64(F.regexp_replace(confusions.fold(F.lit(x)), r"\s+", "")).alias("k")).collect()}
    for d, own in sequences.items():
        assert sorted((tuple(key[k] for k in p), n) for p, n in got[d]) == closed_by_brute_force(own, 4)
    one = [(str(n), None, None, "\n".join(known[:5]) + f"\nown text of the page {'abcde'[n]}", None) for n in range(5)]
    assert [(r.document_id, len(r.sequence), r.support) for r in repeated_lines.frequent_sequences(pages(spark, one)).collect()] == [(None, 5, 5)]


def test_repeated_lines_of_nothing(spark):
    empty = pages(spark, [])
    assert repeated_lines.repeated_line_occurrences(empty).count() == 0
    assert repeated_lines.without_repeated_lines(empty).count() == 0


SENTENCES = {
    "en": "The board expects that sales of the company will rise in the coming year because of stronger demand from customers in the northern markets.",
    "de": "Der Vorstand erwartet, dass die Umsätze der Gesellschaft im kommenden Jahr wegen der höheren Nachfrage der Kunden in den Märkten steigen werden.",
    "fr": "Le conseil prévoit que les ventes de la société vont progresser dans la prochaine année grâce à la demande des clients dans les marchés du nord.",
    "es": "El consejo espera que las ventas de la sociedad aumenten en el próximo año gracias a la demanda de los clientes en los mercados del norte.",
    "it": "Il consiglio prevede che le vendite della società aumentino nel prossimo anno grazie alla domanda dei clienti presso i mercati del nord.",
    "nl": "Het bestuur verwacht dat de omzet van de vennootschap in het komende jaar zal stijgen door de sterkere vraag van klanten in de noordelijke markten.",
    "da": "Bestyrelsen venter, at selskabets salg vil stige i det kommende år på grund af større efterspørgsel fra kunderne på de nordlige markeder.",
}


def test_languages(spark):
    rows, true = [], {}
    codes = list(SENTENCES)
    for k in range(210):
        own, other = codes[k % 7], codes[(k * 3 + 1) % 7 if k % 4 == 0 else k % 7]
        label = {0: None, 1: "und", 2: own.upper(), 3: f"{own}-XX"}.get(k % 11, own) if k % 13 else codes[(k + 2) % 7]
        rows.append((f"p{k}", "d", k, SENTENCES[own] + "\n\n12 13 14 15\n \n" + SENTENCES[other], label))
        for no, code in ((1, own), (3, other)):
            if languages.label_code(label) != code:
                true[f"p{k}", no] = code
    rows += [("none", "d", None, None, "en"), ("blank", "d", 1, " \n\t\n", "en")]
    got = {(r.page_id, r.para_no): r.lang_code for r in languages.foreign_paragraphs(pages(spark, rows)).collect()}
    assert got == true
    whole = {r.page_id: r for r in languages.page_languages(pages(spark, rows)).collect()}
    assert len(whole) == 210 and all(0 < r.confidence <= 1 for r in whole.values())


def test_languages_of_unlabelled_and_empty_tables(spark):
    rows = [("p", "d", 1, SENTENCES["de"], None)]
    assert pairs(languages.foreign_paragraphs(pages(spark, rows)), "page_id", "para_no", "lang_code") == [("p", 1, "de")]
    assert languages.paragraph_languages(pages(spark, [])).count() == 0


def test_codewords_are_apart():
    code = languages.codewords(7)
    assert min((code[a] != code[b]).sum() for a in range(7) for b in range(a)) >= 6


def test_labels():
    assert [languages.label_code(x) for x in ("en-GB", "French", "deu", "NL", "nl-BE", "-", "", "unknown", None, "Portuguese")] == ["en", "fr", "de", "nl", "nl", None, None, None, None, "pt"]


def test_noise(spark):
    clean = "The modular sawmill reported settled sales of raw-material and a broadly stable share.\n\n"
    rows = [(f"c{k}", "d", 100 + k, clean * 4, None) for k in range(20)]
    noisy = "The rnodular savvmill rcported sett-\nled sales of raw-\nmaterial in 2O24 and\na broadly stab1e sh@re.\n- 7 -\nPage 7 of 12\n7 8\n"
    rows += [("n", "d", 7, noisy, None), ("null", "d", 1, None, None), ("empty", "d", 2, "", None), ("nonumber", "d", None, "- 3 -", None)]
    df = pages(spark, rows)
    got = [x for x in pairs(page_noise.noisy_lines(df), "page_id", "line_no", "noise_kind")]
    assert got == [("n", 1, "misread"), ("n", 1, "split_word"), ("n", 3, "misread"), ("n", 4, "misread"), ("n", 5, "page_number"), ("n", 6, "page_number")]
    headers = spark.createDataFrame([("n", 7)], "page_id string, line_no long")
    text = {r.page_id: r.text for r in page_noise.readable_pages(df, headers).collect()}
    assert text["n"] == "The modular sawmill reported settled sales of raw-material in 2024 and a broadly stable share."
    assert text["null"] is None and text["c0"] == "\n\n".join([clean.strip()] * 4)
    assert page_noise.noisy_lines(pages(spark, [])).count() == 0


@pytest.mark.parametrize(("line", "number", "found"), [("7", 7, True), ("[7]", 7, True), ("Seite 7 von 9", 7, True), ("7/12", 7, True), ("— 7 —", 7, True), ("8", 7, False), ("7 8 9", 7, False), ("Note 7", 7, False), ("l0", 10, True), ("7", None, False), ("2024", 7, False)])
def test_page_number_lines(line, number, found):
    assert page_noise.is_page_number(line, number) is found


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", "k") for i, t in rows], "doc_id long, text string, item_id string, kind string")


def brute_leaks(rows, items, n=13):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    runs = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in rows for w in [words(t)] for k in range(len(w) - n + 1) for i in runs.get(tuple(w[k : k + n]), ())}


@pytest.mark.parametrize("edits", [0, 1])
def test_leaks_equal_brute_force(spark, edits):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(60)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(f"i{k}", say(rng.randint(13, 60))) for k in range(12)] + [("short", say(5)), ("null", None), ("same", None)]
    items[-1] = ("same", items[0][1])
    rows = []
    for d in range(150):
        item = rng.choice(items[:12])[1].split()
        at, n = rng.randint(0, max(0, len(item) - 12)), rng.randint(9, 20)
        rows.append((d, say(rng.randint(0, 30)) + rng.choice([" ", ". ", "\n> "]) + rng.choice([" ", ", ", "\n"]).join(item[at : at + n]).upper() + " " + say(rng.randint(0, 30))))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (903, "é" * 50 + rows[0][1])]
    frame = spark.createDataFrame(items, "item_id string, text string")
    got = pairs(eval_leaks.leaked_items(texts(spark, rows), frame, edits=edits), "doc_id", "item_id")
    assert set(got) == brute_leaks(rows, items) and len(got) == len(set(got))


def test_altered_passages_are_reported_with_their_edits(spark):
    words = "harbour quietly lantern seventy marble orchid velvet compass thunder willow anchor meadow saffron pebble".split()
    item = " ".join(words)
    altered = item.replace("compass", "compasz")  # no 13 words in a row are left
    rows = [(1, f"before that {altered} and after"), (2, f"only {' '.join(words[:6])} was taken"), (3, item.upper() + "."), (4, item.replace("velvet", "cotton").replace("willow", "poplar"))]
    frame = spark.createDataFrame([("i", item)], "item_id string, text string")
    found = {r.doc_id: (r.edits, r.run_words) for r in eval_leaks.leak_regions(texts(spark, rows), frame).collect()}
    assert found == {1: (1, 7), 3: (0, 14)}
    assert pairs(eval_leaks.leaked_items(texts(spark, rows), frame), "doc_id", "item_id") == [(3, "i")]


@pytest.mark.parametrize("seed", range(200))
def test_banded_distance_equals_the_full_table(seed):
    rng = random.Random(seed)
    a = bytes(rng.choices(b"ab ", k=rng.randint(0, 14)))
    b = bytes(rng.choices(b"ab ", k=rng.randint(0, 14))) if seed % 2 else a[: rng.randint(0, 14)] + b"a" + a[rng.randint(0, 14) :]
    t = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    for most in range(5):
        assert eval_leaks.banded_distance(a, b, most) == (t[-1][-1] if t[-1][-1] <= most else None)


def test_leak_in_a_very_long_text(spark):
    rng = random.Random(2)
    filler = " ".join("".join(rng.choices("klmnopq", k=6)) for _ in range(60_000))
    item = " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(30))
    cuts = [0, len(filler) // 2, eval_leaks.PIECE - 60]
    rows = [(k, filler[:c] + " " + item + " " + filler[c:]) for k, c in enumerate(cuts)]
    frame = spark.createDataFrame([("i", item)], "item_id string, text string")
    assert pairs(eval_leaks.leaked_items(texts(spark, rows), frame, edits=0), "doc_id", "item_id") == [(0, "i"), (1, "i"), (2, "i")]


def test_edits_within_the_budget_are_regions(spark):
    item = "the modular sawmill of borlatir financed every leased vineyard instead of their granular harbour in the closing quarter of the year"
    near = item.replace("leased", "leaked")
    frame = spark.createDataFrame([("i", item)], "item_id string, text string")
    found = eval_leaks.leak_regions(texts(spark, [(1, near)]), frame, edits=1).agg(F.max("edits"), F.max(F.col("text_end") - F.col("text_start"))).first()
    assert found[0] == 1 and found[1] >= len(item) - 5
    assert eval_leaks.leak_regions(texts(spark, []), frame).count() == 0
    assert eval_leaks.leak_regions(texts(spark, [(1, near)]), frame.limit(0)).count() == 0


def test_misread_years_are_found_however_often_they_stand(spark):
    rows = [(f"y{k}", "d", None, "sales of the year 2020 and of the year 2020 rose", "en") for k in range(300)]
    rows += [(f"m{k}", "d", None, "sales of the year z020 rose", "en") for k in range(25)] + [(f"q{k}", "d", None, "sales of q3 rose, 93 orders", "en") for k in range(25)]
    found = {r.page_id for r in page_noise.noise(pages(spark, rows)).where("noise_kind = 'misread'").collect()}
    assert found == {f"m{k}" for k in range(25)}


def test_residue(spark):
    rng = random.Random(8)
    prose = lambda: f"The board of the company expects that {' '.join(''.join(rng.choices('abcdefgh', k=6)) for _ in range(6))} will rise in the coming year."
    rows = [
        (1, prose()), (3, f"{prose()} The {{{{ issuer_name }}}} rose."), (5, None), (6, ""),
        (7, "Aliqua labora minira tempra elitum ipsa nostra magnis doven labora sitra."), (8, f"{prose()} Square brackets [ ] mark figures; <p>markup</p> is used."), (9, "The plant shipped 404 turbines and 503 spare gearboxes during the year."),
        (10, f"{prose()} It lists rows such as {{\"segment\": \"Packaging\", \"value\": 80}} for the reader."), (11, f"Revenue of [insert amount] was reported by the group."), (12, "The tool was rebuilt without JavaScript, which cut loading times for the readers of the report."),
        (13, "Directors [1] and [2] of the group abstained, and the vote [...] was repeated."), (14, "In XX.X million, the segment of the group closed."), (15, "xxxx xxxxxx xxx xx xxxxxx xxxx xxx xx xxxx"),
    ]
    rows += [(17, f"{prose()}\n> surplus hatchery absorbed unlisted bakery ahead alongside legacy sawmill\n> of the group.")]
    # no list holds these: they are known by standing alone again and again, in records of their own and then within others
    notice = "Skærmen kan ikke vise det ønskede indhold, fordi browseren ikke må køre de nødvendige programdele; " * 3
    rows += [(100 + k, "Kindly reload the viewer panel.") for k in range(6)] + [(200 + k, notice.strip()) for k in range(4)] + [(300 + k, f"Noget gik galt hos os, fejl nr. {k}{k}") for k in range(3)]
    rows += [(400 + k, f"{prose()} {prose()} {prose()} Overskrift kommer senere.\n{prose()}") for k in range(5)] + [(410 + k, "Overskrift kommer senere.") for k in range(2)]
    rows += [(500 + k, f"{prose()} {prose()} Sales rose again. {prose()}") for k in range(9)] + [(600 + k, "Seen only twice so far, hence unknown to it.") for k in range(2)]
    got = [x[0] for x in pairs(residue.residue(texts(spark, rows)), "doc_id")]
    assert got == [3, 7, 11, 14, 15, *range(100, 106), *range(200, 204), *range(300, 303), *range(400, 405), *range(410, 412)]
    assert residue.residue(texts(spark, [])).count() == 0
    one_source = texts(spark, rows).withColumn("source", F.lit("s"))
    assert [x[0] for x in pairs(residue.residue(one_source), "doc_id")] == [3, 7, 11, 14, 15]  # one source's phrases are its own


def test_residue_of_aligned_records(spark):
    # one template, filled in many records; its slot left blank, at a default or as a bare name of a variable in some
    filled = [(k, f"The revenue of {k * 7 + 3} million was reported by the board.") for k in range(20)]
    left = [
        (100, "The revenue of million was reported by the board."), (101, "The revenue of segment_total million was reported by the board."), (102, "The revenue of undefined million was reported by the board."),
        (103, "The revenue of segmentTotal million was reported by the board."), (104, "The revenue of amount million was reported by the board."),
    ]
    ordinary = [(200, "The revenue of several million was reported by the board."), (201, "The amount of revenue was unknown to the board."), (202, "The plan was rejected by the company after the vote.")]
    prose = "The board of the company expects that sales will rise in the coming year. " * 8
    found = lambda rows: [x[0] for x in pairs(residue.residue(texts(spark, [(k, prose + x) for k, x in rows])), "doc_id")]
    assert found(filled + left + ordinary) == [100, 101, 102, 103, 104]
    # without filled records nothing says that a place is a slot
    assert found(left[:1] + ordinary) == []


@pytest.mark.parametrize("times", [1, 2, 3, 50])
def test_residue_in_constant_words_at_every_count(spark, times):
    prose = "The board of the company expects that sales will rise in the coming year. " * 8
    rows = [(k, f"{prose}\nDear [Company Name], we thank you for the trust of the year.") for k in range(times)]
    rows += [(1000 + k, f"{prose}\nAll of the figures [in EUR million] are shown without tax as of the day.") for k in range(times)]
    rows += [(2000 + k, f"{prose}\nWe thank [client] for the trust of the past year.") for k in range(times)] + [(3000, f"{prose}\nWe thank Acme for the trust of the past year.")]
    assert [x[0] for x in pairs(residue.residue(texts(spark, rows)), "doc_id")] == [*range(times), *range(2000, 2000 + times)]


def test_residue_of_sentences_and_marks_of_any_length(spark):
    prose = "The board of the company expects that sales will rise in the coming year. " * 40
    found = lambda rows: [x[0] for x in pairs(residue.residue(texts(spark, [(k, prose + x) for k, x in rows])), "doc_id")]
    rest = "and the plan was kept by the group " * 12
    said = lambda v: f"The revenue of {v}million was reported by the board {rest}in the year."
    assert len(said("")) > 400
    # a slot of a long sentence, and of one with two fixed words
    rows = [(k, said(f"{k * 7 + 3} ")) for k in range(20)] + [(100, said("")), (101, said("segment_total ")), (102, said("undefined ")), (103, said("several "))]
    assert found(rows) == [100, 101, 102]
    rows = [(k, f"Sales reached {k * 7 + 3} million.") for k in range(20)] + [(200, "Sales reached million."), (201, "Sales reached segment_total million."), (202, "Sales reached several million.")]
    assert found(rows) == [200, 201]
    # long marks: an instruction or a tag by its form, a name by what others have in its place, an aside not at all
    mark = "[amount of revenue that the segment reported in the year]"
    marked = [
        (300, f"The revenue of {mark} million was reported by the board."), (301, "It was signed by [insert the name of the issuer as it stands in the register of companies] in the year."),
        (302, "It rose {% if segment.revenue is defined and segment.currency is defined and segment.year is defined %} in the year."), (303, "It rose [the figures of the year before were restated by the group] in the year."),
    ]
    assert found([(k, f"The revenue of {k * 7 + 3} million was reported by the board.") for k in range(20)] + marked) == [300, 301, 302]
    assert found(marked[:1]) == []
    assert [x[3] for x in residue.scan_text("w" * 100 + " " * 70 + "[client]" + " " * 70 + "v" * 100) if x[0] == residue.SLOT] == ["w" * 100 + " □ " + "v" * 100]


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_packing(spark):
    import os

    if not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer here")
    rng = random.Random(4)
    topics = [["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(30)] for _ in range(8)]
    rows = [(k, " ".join(rng.choices(topics[k % 8], k=int(rng.paretovariate(1.2) * 12) % 400 + 3))) for k in range(600)] + [(9000, None), (9001, ""), (7, "again the same id")]
    df = texts(spark, rows)
    packed = packing.pack(df, 512, TOKENIZER, shard=300).persist()
    used = {r.container: r.t for r in packed.groupBy("container").agg(F.sum("tokens").alias("t")).collect()}
    assert max(used.values()) <= 512
    sized = packing.pieces(df, 512, TOKENIZER)
    assert pairs(packed, "item", "piece", "tokens") == pairs(sized, "item", "piece", "tokens")
    whole = sized.groupBy("item", (F.col("start") - F.col("piece") * 512).alias("x")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).where("n > 1")
    assert whole.where("t <= 512 and item <> '7'").count() == 0
    assert packing.fill_rates(packed, 512).first().fill >= 0.95
    # neighbours of a container share a topic far more often than chance
    first = packed.withColumn("topic", F.col("item").cast("long") % 8).groupBy("container").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("topic").alias("topics")).where("n >= 4").agg(F.avg(F.col("topics") / F.col("n"))).first()[0]
    assert first < 0.6
    assert packing.pack(texts(spark, []), 512, TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(df, 0, TOKENIZER)
    kinds = spark.createDataFrame([("small", 100), ("large", 512), ("large", 512), (None, 5), ("none", None)], "container_kind string, capacity_tokens int")
    both = packing.pack_kinds(df, kinds, TOKENIZER)
    total = {r.container_kind: (r.t, r.m) for r in both.groupBy("container_kind", "container").agg(F.sum("tokens").alias("u")).groupBy("container_kind").agg(F.sum("u").alias("t"), F.max("u").alias("m")).collect()}
    n = sized.agg(F.sum("tokens")).first()[0]
    assert set(total) == {"small", "large"} and {t for t, _ in total.values()} == {n} and total["small"][1] <= 100
    assert packing.pack_kinds(df, kinds.limit(0), TOKENIZER).count() == 0
    same = texts(spark, [(1, "one text that is here again and again")] * 900)  # neither equal texts nor equal ids make a shard larger
    assert packing.pack(same, 512, TOKENIZER, shard=100).count() == 900


def test_packing_is_settled_by_the_data(spark):
    sizes = [5, 4, 3, 3, 2, 1, 1]
    import numpy as np

    held = packing.pack_shard([(str(k), 0) for k in range(7)], np.array(sizes), [[ord(w)] for w in "ababacc"], [[1]] * 7, 8)
    assert sorted(k for c in held for k in c) == list(range(7))
    assert held[0] == [0, 2] and all(sum(sizes[k] for k in c) <= 8 for c in held)


def test_packing_counts_every_token(spark):
    import os

    if not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer here")
    encode = packing.encoder(TOKENIZER)
    words = [f" {a}{b}{c}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"]
    one = {ids[0]: w for w, ids in zip(words, encode(words)) if len(ids) == 1}
    by_hash = [one[t] for t in sorted(one, key=lambda t: t * 2654435761 & 0xFFFFFFFF)]
    assert len(by_hash) >= 640
    # 2 shares 80 tokens with 1; 3 shares 20, those of smallest hash; 4 has nothing in common
    rows = [(1, "".join(by_hash[:20] + by_hash[300:420])), (2, "".join(by_hash[340:420])), (3, "".join(by_hash[:20] + by_hash[150:210])), (4, "".join(by_hash[420:640]))]
    packed = packing.pack(texts(spark, rows), 221, TOKENIZER).collect()
    beside = {r.container: set() for r in packed}
    for r in packed:
        beside[r.container].add(r["item"])
    assert sorted(map(sorted, beside.values())) == [["1", "2"], ["3"], ["4"]]
    # counts are whole, and a rest has those of its own tokens
    long = "".join(by_hash[:300] * 2 + by_hash[300:310] * 3)
    sizes = {r.capacity: r for r in packing.sized(texts(spark, [(1, long)]), TOKENIZER, capacities=[600, 630, 1000]).collect()}
    assert set(sizes) == {0, 600}
    for capacity, expected in ((0, encode([long])[0]), (600, encode([long])[0][600:])):
        _, tokens, counts = packing.unpacked([bytes(sizes[capacity].bag)])
        assert dict(zip(tokens.tolist(), counts.tolist())) == {t: expected.count(t) for t in expected}
