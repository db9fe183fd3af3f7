import datetime as dt

from pyspark.sql import functions as F

from siftlake.functions import names, stated
from siftlake.functions import lexicon as L
from siftlake.operators import claims, entities, statements
from siftlake.operators.joins import hot_join


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


def test_stated_values(spark):
    rows = [
        (1, "Apply by 5th January, 2026 or 2026-02-03; see May 7 2026 and 9.8.2026; not 2026-13-01"), (2, "Applicants must be between 18 and 25 years"), (3, "age should not exceed 25 years, at least 17 years"), (4, None), (5, ""),
        (6, "Rs 2.5 lakh per annum, 50,000 rupees"), (7, "for girls of SC, ST and OBC families; applications are accepted round the year"), (8, "Session 2025-26 and 2026-27"),
    ]
    t = F.col("t")
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, t string").select("i", F.array_sort(stated.dates(t)).alias("d"), stated.ages(t).alias("a"), stated.numbers(t).alias("n"), stated.period(t).alias("p"), stated.members(t, L.CATEGORIES).alias("c"), stated.open_window(t).alias("w"), stated.cycle_status(t, F.lit(2026)).alias("y")).collect()}
    assert got[1].d == [dt.date(2026, 1, 5), dt.date(2026, 2, 3), dt.date(2026, 5, 7), dt.date(2026, 8, 9)]
    assert tuple(got[2].a) == (18, 25) and tuple(got[3].a) == (17, 25) and tuple(got[4].a) == (None, None)
    assert set(got[6].n) == {2.5, 250000.0, 50000.0} and got[6].p == "per_year" and got[4].d == [] and got[5].n == []
    assert got[7].c == ["SC", "ST", "OBC"] and got[7].w == "rolling" and got[8].y == "current" and got[4].y == "unknown"


def test_names(spark):
    rows = [("The Rimo Scholarship Scheme for Girls 2025-26",), ("National Scholarship Portal",), ("Top 10 Scholarships",), ("Rimo Tasa Award | Kilo Trust",), (None,)]
    n = F.col("n")
    got = spark.createDataFrame(rows, "n string").select(names.name_key(n), names.is_generic_name(n), names.looks_like_list(n), names.lead_name(n)).collect()
    assert [r[0] for r in got] == ["rimo girls", "national portal", "top 10", "rimo tasa award kilo trust", ""]
    assert [r[1] for r in got] == [False, True, True, False, True] and [r[2] for r in got][:4] == [False, False, True, False] and got[3][3] == "Rimo Tasa Award"


def test_links_pages_and_publishers(spark):
    df = spark.createDataFrame([("Merit scholarship", "https://x.gov.in/scholarship.html", None), ("Login", "https://x.org/login", "scholarships"), (None, None, None)], "a string, u string, c string")
    assert [r[0] for r in df.select(stated.link_score(F.col("a"), F.col("u"), F.col("c"))).collect()] == [0.7, 0.0, 0.0]
    hosts = spark.createDataFrame([("x.gov.in",), ("a.ac.uk",), ("z.example",)], "h string")
    assert [r[0] for r in hosts.select(stated.publisher(F.col("h"))["tier"]).collect()] == ["T1", "T2", "T4"]
    owns = spark.createDataFrame([("Rimo Tasa Trust", "rimotasa.org.in"), ("Kilo Banu Research Council", "kbrc.org"), ("Other Name Society", "rimotasa.org.in")], "p string, h string")
    assert [r[0] for r in owns.select(statements.owns_domain(F.col("p"), F.col("h"))).collect()] == [True, True, False]


def test_pages_that_are_no_programme(spark):
    listing = "\n".join(f"Closing date: {i} May 2026, India" for i in range(1, 10))
    rows = [(1, "https://x.org/news/a", None, "India"), (2, "https://x.org/a", None, listing), (3, "https://x.org/b", None, "For all"), (4, "https://x.ac.in/b", None, "For all"), (5, None, None, None)]
    got = dict(map(tuple, statements.gated_pages(spark.createDataFrame(rows, "page_id bigint, url string, final_url string, text string")).collect()))
    assert got[1] == "news" and got[2] == "listing" and got[3] == "market not named" and 4 not in got


def test_grounding_and_merging(spark):
    pages = spark.createDataFrame([(1, "Only SC and ST students\nmay apply by 31 December 2026."), (2, None)], "page_id bigint, text string")
    rows = [(1, 1, "categories", "SC,ST,OBC", "Only SC and ST students may apply"), (2, 1, "closing_date", "2026-12-31", "may apply by 31 December 2026"), (3, 1, "closing_date", "2026-12-31", "never written there at all"), (4, 2, "name", "x", "quote"), (5, 9, "name", None, None)]
    got = {r.claim_id: r for r in claims.grounded(spark.createDataFrame(rows, "claim_id bigint, page_id bigint, field string, value string, quote string"), pages).collect()}
    assert got[1].accepted and got[1].value == "SC,ST" and got[2].accepted and not got[3].accepted and not got[4].accepted and not got[5].accepted
    o = [(1, "categories", 0, "SC,ST", 100.0), (1, "categories", 1, "SC,ST", 95.0), (1, "categories", 2, "GENERAL", 100.0), (1, "closing_date", 0, "2026-01-01", 95.0), (1, "closing_date", 1, "2026-01-02", 100.0)]
    m = {r.field: r for r in claims.merged(spark.createDataFrame(o, "key bigint, field string, reader int, value string, score double")).collect()}
    assert (m["categories"].value, m["categories"].agreement, m["categories"].conflicts) == ("SC,ST", 0.6667, "GENERAL")
    assert (m["closing_date"].value, m["closing_date"].conflicts) == ("2026-01-01", "2026-01-02")


R = "id bigint, name string, provider string, official_url string, official_domain string, confidence double, source_tier string, status string, closing_date date, categories array<string>"


def record(i, name, provider="Rimo Trust", url=None, confidence=50.0, tier="T2", status="ACTIVE", day=None, cats=None, domain="rimo.org"):
    return (i, name, provider, url, domain, confidence, tier, status, day, cats)


def test_matching_and_duplicates(spark):
    known = spark.createDataFrame([record(1, "Rimo Tasa Merit Award", url="https://rimo.org/a/"), record(2, "Kilo Banu Travel Prize"), record(3, None)], R)
    new = spark.createDataFrame([record(11, "Else", url="https://www.rimo.org/a#x"), record(12, "Kilo Banu Travel Prize 2026"), record(13, "Kilo Banu Travl Prize"), record(14, "Nothing like it"), record(15, None)], R)
    assert {tuple(r) for r in entities.matched(new, known).collect()} == {(11, 1, 2), (12, 2, 3), (13, 2, 4)}
    rows = [record(1, "Rimo Merit Award", confidence=60.0), record(2, "The Rimo Merit Award 2026", confidence=90.0), record(3, "Rimo Merit Award", provider="Kilo Banu University"), record(4, "Rimo Merit Award", provider=None, confidence=10.0), record(5, None)]
    got = dict(map(tuple, entities.duplicate_keys(spark.createDataFrame(rows, R)).collect()))
    assert got[1] == 2 and 4 in got and 5 not in got and 2 not in got
    assert entities.duplicate_keys(spark.createDataFrame([], R)).count() == 0


def test_field_changes(spark):
    old = spark.createDataFrame([record(1, "Rimo Award", url="https://rimo.org/a", cats=["SC", "ST"]), record(2, "Kilo Prize", day=dt.date(2026, 1, 1)), record(3, "Gone")], R)
    new = spark.createDataFrame([record(1, "Rimo Award", url="https://www.rimo.org/a/", cats=["ST", "SC"], status="EXPIRED"), record(2, "Kilo Prize", provider=None, day=dt.date(2026, 2, 1), cats=["SC"]), record(4, "New one")], R)
    got = {tuple(r) for r in entities.field_changes(old, new).collect()}
    assert got == {(4, None, "NEW", None, None), (1, "status", "STATUS_CHANGED", "ACTIVE", "EXPIRED"), (2, "provider", "FIELD_UNSUPPORTED", "Rimo Trust", None), (2, "closing_date", "FIELD_CHANGED", "2026-01-01", "2026-02-01"), (2, "categories", "FIELD_ADDED", None, '["SC"]')}


def test_evidence_versions(spark):
    e = spark.createDataFrame([(1, "name", 1, "a"), (1, "name", 3, "b"), (1, "name", 3, "c"), (2, "name", 1, "d")], "id bigint, field string, run_id bigint, quote string")
    assert {(r.quote, r.until_run, r.is_current) for r in entities.evidence_versions(e).collect()} == {("a", 3, False), ("b", None, True), ("c", None, True), ("d", None, True)}


def test_hot_join_is_a_join(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)] + [(99, None)], "i int, k string")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.upper("k"))
    assert {tuple(r) for r in hot_join(rows, groups, "k", hot=15).select("i", "x").collect()} == {(i, "A" if i % 3 else "B") for i in range(30)}


def test_ranked_text_keeps_order_and_budget(spark):
    text = "\n".join(["first"] + ["filler"] * 40 + ["last date to apply"] + ["filler"] * 3)
    got = statements.ranked_text(spark.createDataFrame([(1, text), (2, None)], "page_id bigint, text string"), budget=30, first=1).collect()
    kept = {r.page_id: r.selected for r in got}
    assert kept[1].startswith("first\n") and "[...]\nlast date to apply" in kept[1] and not kept[2]


def test_links_to_application_forms(spark):
    rows = [
        (1, "https://x.org/a", None, '[{"u":"https://x.org/a/","t":"Apply now"},{"u":"https://x.org/form","t":"Apply here"},{"u":"https://y.org/form","t":"Apply"}]'), (2, "https://x.org/b", None, '[{"u":"https://facebook.com/apply","t":"Apply"},{"u":"https://x.org/otr","t":"More"}]'),
        (3, None, None, "not json"), (4, None, None, None), (5, "https://x.org/c", None, '[{"u":null,"t":"Apply"},{"u":"https://z.org/q","t":null}]'),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, final_url string, links_json string")
    assert [tuple(r) for r in statements.application_links(df).collect()] == [(1, "https://x.org/form", 0.7)]
    assert {(r.page_id, r.place) for r in statements.page_links(df).collect()} == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (5, 2)}


def test_operators_on_nulls_and_empty_tables(spark):
    page = "page_id bigint, run_id bigint, url string, final_url string, title string, text string, status_code int"
    pages = spark.createDataFrame([(1, 1, None, None, None, None, None), (2, 1, "https://x.org/a", None, "", "", 200)], page)
    for rows in (pages, pages.limit(0)):
        for run in (statements.page_dates, statements.dates_in_place, statements.closing_lines, statements.page_ages, statements.text_sections, claims.rule_claims):
            assert run(rows).count() == 0
        assert statements.page_kinds(rows).count() == statements.ranked_text(rows).count() == rows.count()
    records = spark.createDataFrame([record(1, None, None, None, None, None, None, None, None, None), record(2, "")], R)
    assert entities.duplicate_keys(records).count() == 0 and entities.matched(records, records).count() == 0
    assert [r.trusted for r in entities.trusted_addresses(records).collect()] == [False, False]
    assert entities.field_changes(records, records).count() == 0
