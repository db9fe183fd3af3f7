import datetime as dt

from siftlake.llm import bpe, language, leak, linking, residue, sitelines
from siftlake.llm.boilerplate import main_body, page_furniture

T = dt.datetime(2026, 3, 2)
PAGES = "page_id bigint, run_id bigint, url string, final_url string, domain string, title string, text string, fetched_at timestamp, site string, canon string"
CAND = "canonical_url string, domain string, url string"
SCH = "id bigint, name string, provider string, official_domain string, sig bigint, class string"
DOC = "doc_id bigint, text string, lang string, label string"


def pages(spark):
    rows = [(i, 1, f"https://s.example/p{i}", None if i == 3 else f"https://www.S.example/p{i}", "x", f"t{i}", f"Visitors: {i}\nown {chr(97 + i)}\n\nBack  to top", T, "a", "b") for i in range(5)]
    rows += [(10, 1, "https://z.example/q", "https://z.example/q", None, None, None, T, None, None), (11, 1, "https://z.example/r", "https://z.example/r", None, None, "", T, None, None), (12, None, None, None, None, None, "x", T, None, None)]
    return spark.createDataFrame(rows, PAGES)


def test_repeated_lines(spark):
    cand = spark.createDataFrame([("https://s.example/p3", "WWW.s.example", "u"), (None, None, None)], CAND)
    got = {tuple(r) for r in sitelines.repeated_lines(pages(spark), cand).collect()}
    assert got == {(i, n) for i in range(5) for n in (1, 4)}
    assert sitelines.repeated_lines(pages(spark).limit(0), cand.limit(0)).count() == 0
    kept = dict(map(tuple, sitelines.without_repeated_lines(pages(spark), cand).collect()))
    assert kept[1] == "own b\n" and kept[10] is None


def test_pages_operators_on_odd_rows(spark):
    assert {r.page_id for r in page_furniture(pages(spark)).collect()} == {0, 1, 2, 3, 4}
    assert main_body(pages(spark)).count() == 8
    assert residue.residue(pages(spark)).count() == 0
    assert residue.residue(pages(spark).limit(0)).count() == 0


def test_linking(spark):
    rows = [
        (1, "Rimo Tasa Travel Grant for Diploma Students", "Vojaja Jolonu University", "scholar-index.example", 0, ""), (2, "Travel Grant in memory of Tasa, Rimo for Diploma Stud. 2025-26", "Jolonu, Vojaja Univ.", "x.example", 0, ""),
        (3, "R. Tasa Travel Grant (Diploma Students)", "V. Jolonu University", None, 0, ""), (4, "Rimo Tasa Travel Grant for ITI Trainees", "Vojaja Jolonu University", None, 0, ""), (5, "Rimo Tasa Travel Grant for Diploma Students", "Kilo Banu Research Council", None, 0, ""),
        (6, "Girl Child Progress Award", "Kilo Banu Research Council", None, 0, ""), (7, "Girl Chlid Progress Award", "KBRC", None, 0, ""), (8, "Girl Child Progress Award", "Vojaja Jolonu University", None, 0, ""),
        (9, None, "x", None, 0, ""), (10, "Girl Child Progress Award", None, None, 0, ""), (11, "Rimo Tasa Travel Grant for ITI Trainees", None, None, 0, ""),
    ]
    df = spark.createDataFrame(rows, SCH)
    assert {tuple(r) for r in linking.same_programme(df).collect()} == {(1, 2), (1, 3), (2, 3), (6, 7), (4, 11)}
    assert linking.same_programme(df.limit(0)).count() == 0


def test_documents_operators(spark):
    item = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "It says " + item, "en", "l"), (2, None, None, "l"), (3, "", "", "l"), (4, "---", "und", "l")], DOC)
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id bigint, text string")
    assert [tuple(r) for r in leak.leaks(docs, bench).collect()] == [(1, 7)]
    assert [tuple(r) for r in leak.leaked_spans(docs, bench).collect()] == [(1, 7, 3, 42)]
    assert leak.leaks(docs, bench.limit(0)).count() == leak.leaks(docs.limit(0), bench).count() == 0
    ids = dict(map(tuple, bpe.encode(docs).collect()))
    assert ids[2] == ids[3] == [] and len(ids[1]) > 40
    assert language.mislabelled(docs.limit(0)).count() == 0


def test_mislabelled(spark):
    en = ["The stipend stops during the summer break.", "Wards of staff are not eligible for the award.", "The trustees met in June and approved fresh awards."]
    de = ["Die Leitung der Hochschule unterschreibt den Antrag.", "Für das Verfahren werden keine Gebühren erhoben.", "Bewerbungen müssen bis zum Juni eingereicht werden."]
    rows = [(i, " ".join(v), c, "") for i, (c, v) in enumerate([("en", en), ("de", de)] * 30)]
    rows += [(100, de[0], "en", ""), (101, en[0], None, ""), (102, en[0] + " " + de[1], "en-GB", ""), (103, en[1], "English", ""), (104, "12 --", None, "")]
    got = {tuple(r) for r in language.mislabelled(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {(100, "de"), (101, "en"), (102, "en"), (102, "de")}
