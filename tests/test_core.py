import datetime as dt
import random

from pyspark.sql import functions as F

from siftlake.functions.urls import canonical_url, host_of, registered_domain
from siftlake.operators import history, records, snapshots, units

T = dt.datetime(2026, 3, 2, 5)
RUNS = "run_id bigint, started_at timestamp, finished_at timestamp"
PAGES = "page_id bigint, run_id bigint, url string, final_url string, fetched_at timestamp, text string, extra string"
SCH = "id bigint, name string, provider string, source_type string, source_tier string, amount_text string, amount_currency string, amount_period string, income_limit_text string, gender string, age_min int, age_max int"


def runs(spark, n):
    return spark.createDataFrame([(i, T + dt.timedelta(days=28 * (i - 1)), T + dt.timedelta(days=28 * (i - 1), hours=9)) for i in range(1, n + 1)], RUNS)


def test_urls(spark):
    rows = [("https://WWW.A.org.example/x/?utm_source=m&b=1#top",), ("http://a.co.in",), (None,), ("mailto:x",), ("",)]
    got = spark.createDataFrame(rows, "u string").select(canonical_url(F.col("u")), host_of(F.col("u")), registered_domain(host_of(F.col("u")))).collect()
    assert [tuple(r) for r in got] == [("https://a.org.example/x?b=1", "a.org.example", "org.example"), ("http://a.co.in", "a.co.in", "a.co.in"), (None, None, None), ("mailto:x", "", ""), ("", "", "")]


def test_snapshot_changes_against_brute_force(spark):
    rnd = random.Random(4)
    rows, state = [], {}
    for run in range(1, 6):
        for k in range(40):
            for _ in range(rnd.choice([0, 1, 1, 2])):
                rows.append((len(rows), run, f"https://www.S.example/p{k}/#a", None, T + dt.timedelta(minutes=rnd.randrange(99), days=run), rnd.choice(["a  b", "a b", "c", None, ""]), "x"))
    for p, r, u, _, f, t, _ in rows:
        k = (r, u.replace("www.S", "s").removesuffix("/#a"))
        state[k] = max(state.get(k, (dt.datetime.min, -1, "")), (f, p, " ".join((t or "").split())))
    want = set()
    for r in range(2, 6):
        now, past = ({k[1]: v[2] for k, v in state.items() if k[0] == x} for x in (r, r - 1))
        want |= {(r, k, "added") for k in now.keys() - past} | {(r, k, "removed") for k in past.keys() - now} | {(r, k, "changed") for k in now.keys() & past if now[k] != past[k]}
    got = snapshots.page_changes(spark.createDataFrame(rows, PAGES), runs(spark, 5))
    assert {tuple(r) for r in got.collect()} == want


def test_snapshots_empty_and_missing_run(spark):
    one = spark.createDataFrame([(1, 1, "https://a.example/x", None, T, "t", ""), (2, None, "https://a.example/y", None, T, "t", ""), (3, 1, None, None, T, "t", "")], PAGES)
    assert [tuple(r) for r in snapshots.page_changes(one, runs(spark, 2)).collect()] == [(2, "https://a.example/x", "removed")]
    assert snapshots.page_changes(one.limit(0), runs(spark, 2)).count() == 0
    assert snapshots.page_changes(one, runs(spark, 0)).count() == 0


def test_history(spark):
    recs = spark.createDataFrame([(1, 1, dt.date(2027, 1, 19), "REVIEW_REQUIRED"), (2, 2, None, "ACTIVE"), (3, 1, dt.date(2027, 5, 1), None)], "id bigint, first_run_id bigint, closing_date date, status string")
    log = [
        (1, 1, 3, "closing_date", "2027-01-09", "19 Jan 2027", T + dt.timedelta(days=56)), (2, 1, 4, "closing_date", "2027-01-19T00:00:00", "January 19, 2027", T),
        (3, 1, 2, "status", "ACTIVE", "expired", T), (4, 1, 3, "status", "ACTIVE", "EXPIRED", T), (5, 1, None, "status", "EXPIRED", "review required", T + dt.timedelta(days=84)),
        (6, 3, 2, "closing_date", "01/05/2027", None, T), (7, 3, 4, "closing_date", None, "2027-05-01", T), (8, 9, 2, "status", "ACTIVE", "EXPIRED", T), (9, 1, 2, "age_max", "1", "2", T),
    ]
    df = spark.createDataFrame(log, "change_id bigint, scholarship_id bigint, run_id bigint, field_name string, old_value string, new_value string, detected_at timestamp")
    want = {
        (1, "closing_date", "2027-01-09", 1, 2), (1, "closing_date", "2027-01-19", 3, -1), (1, "status", "ACTIVE", 1, 1), (1, "status", "EXPIRED", 2, 3), (1, "status", "REVIEW_REQUIRED", 4, -1),
        (2, "status", "ACTIVE", 2, -1), (3, "closing_date", "2027-05-01", 1, 1), (3, "closing_date", "2027-05-01", 4, -1),
    }
    assert {tuple(r) for r in history.attribute_history(recs, df.unionAll(df), runs(spark, 4)).collect()} == want
    assert history.attribute_history(recs.limit(0), df, runs(spark, 4)).count() == 0
    assert history.attribute_history(recs, df, runs(spark, 0)).count() == 0
    assert history.attribute_history(recs, df.limit(0), runs(spark, 4)).count() == 4


def test_bitmaps_over_several_words(spark):
    spans = spark.createDataFrame([("e", "v", 5, 130), ("e", "v", 140, 141), ("e", "w", 60, 61)], "k string, value string, first int, until int")
    got = history.bit_runs(history.presence_bits(spans, "k"), "k").select("value", "first", "last").collect()
    assert {tuple(r) for r in got} == {("v", 5, 129), ("v", 140, 140), ("w", 60, 60)}


def test_units(spark):
    rows = [(i, "n", f"p{i % 7}", "GOV", "T1", "Rs 5000 a month" if i % 2 else "$ 900 yearly", None, None, None, None, None, None) for i in range(60)]
    rows += [(100, None, None, None, None, "5,000", "usd", "per_month", "up to 2 lakh", None, None, None), (101, None, None, None, None, None, None, None, "5,000 to 6,000 a month", None, None, None), (102, "n", "p1", "GOV", "T1", "no figure", None, None, "", None, None, None)]
    rates = spark.createDataFrame([("INR", "currency", 1.0), ("USD", "currency", 83.45), ("per_year", "period", 1.0), ("per_month", "period", 12.0)], "unit_code string, unit_kind string, factor double")
    recs = spark.createDataFrame(rows, SCH)
    got = {tuple(r) for r in units.found(recs, rates).where("id >= 100").collect()}
    assert got == {(100, "amount", 5007000, 5007000, "year"), (100, "income", 0, 200000, "year"), (101, "income", 60000, 72000, "year")}
    assert units.found(recs.limit(0), rates).count() == 0


def test_forest_fills_missing_units_or_sends_to_review(spark):
    rows = [(i, "n", f"p{i % 2}", "GOV", "T1", f"{'Rs' if i % 2 else '$'} {5000 + i * 100} {'a month' if i % 2 else 'yearly'}", None, None, None, None, None, None) for i in range(400)]
    rows += [(1000, "n", "p1", "GOV", "T1", "6,100", None, None, None, None, None, None)]
    rates = spark.createDataFrame([("INR", "currency", 1.0), ("USD", "currency", 80.0), ("per_year", "period", 1.0), ("per_month", "period", 12.0)], "unit_code string, unit_kind string, factor double")
    recs = spark.createDataFrame(rows, SCH)
    found = units.found(recs, rates).where("id = 1000").collect()
    review = units.review(recs, rates, confident=1.01).where("id = 1000").collect()
    assert [tuple(r) for r in found] == [(1000, "amount", 73200, 73200, "year")]
    assert len(review) == 1


def test_merge_sources(spark):
    s = "domain string, provider_name string, tier string"
    got = records.merge_sources(spark.createDataFrame([("a", "A", "T1"), ("b", "B", "T2")], s), spark.createDataFrame([("b", None, "T3"), ("c", "C", "T4")], s))
    assert {tuple(r) for r in got.select("domain", "provider_name", "tier").collect()} == {("a", "A", "T1"), ("b", "B", "T3"), ("c", "C", "T4")}


def test_stream_keeps_latest_state(spark, tmp_path):
    from siftlake.streaming.arrivals import current_states, keep_states, page_stream

    rows = [(1, 1, "https://a.example/x#q", None, T, "old", ""), (2, 1, "https://www.a.example/x", None, T + dt.timedelta(hours=1), "new", ""), (3, 1, None, None, T, "no address", "")]
    for part in (rows, [(4, 1, "https://a.example/x", None, T - dt.timedelta(days=90), "very late", ""), (5, 2, "https://a.example/x", None, None, None, "")]):
        spark.createDataFrame(part, PAGES).write.mode("append").parquet(str(tmp_path / "in"))
        keep_states(page_stream(spark, str(tmp_path / "in"), PAGES), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.run_id, r.key, r.last_fetch, r.page_id) for r in current_states(spark, str(tmp_path / "log")).collect()} == {(1, "https://a.example/x", T + dt.timedelta(hours=1), 2), (2, "https://a.example/x", None, 5)}


def test_masked_units_and_texts_of_many_figures(spark):
    from siftlake.functions.quantity import read

    assert read("Rs. in lacs: 0.035 every six months")[:4] == (3500, 3500, False, False) and read("INR thirty-seven thousand one time").low == 37000
    assert read("Rs 100 or 200 or 300 yearly").figures == 3
    rows = [(i, "n", f"p{i % 2}", "GOV", "T1", f"{'Rs' if i % 2 else '$'} {5000 + i * 100} {'a month' if i % 2 else 'yearly'}", None, None, None, None, None, None) for i in range(400)]
    told = units.masked_units(spark.createDataFrame(rows, SCH)).collect()
    assert {r.unit for r in told} == {"currency", "period"} and sum(r.right for r in told) >= 0.95 * sum(r.n for r in told)
    rates = spark.createDataFrame([("INR", "currency", 1.0), ("per_year", "period", 1.0)], "unit_code string, unit_kind string, factor double")
    many = spark.createDataFrame([(1, "n", "p", "GOV", "T1", "Rs 100 or 200 or 300 yearly", None, None, None, None, None, None)], SCH)
    assert units.found(many, rates).count() == 0 and [r.id for r in units.review(many, rates).collect()] == [1]
