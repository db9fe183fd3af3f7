import datetime as dt
import threading

import pytest

from siftlake.operators import entities
from siftlake.plans import queries

RECORDS = "id bigint, name string, official_domain string, official_url string, primary_page_id bigint, closing_date date"
PAGES = "page_id bigint, url string, final_url string, text string"
CLOSES = "Last date to apply: 31 May 2026"


@pytest.fixture
def within(spark):
    """Runs an action that is cancelled, and so fails, after some seconds."""

    def run(seconds, action):
        spark.sparkContext.setJobGroup("within", "within", True)
        timer = threading.Timer(seconds, spark.sparkContext.cancelJobGroup, ["within"])
        timer.start()
        try:
            return action()
        finally:
            timer.cancel()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    return run


def test_corroboration_does_not_multiply_records_and_pages(spark, within):
    n = 3000
    own = lambda i: "".join("bdfgklmnpr"[int(c)] + "a" for c in f"{i:05d}")
    records = spark.createDataFrame([(i, f"{own(i)} reimbursements", "rimo.org", None, None, None) for i in range(n)], RECORDS)
    pages = spark.createDataFrame([(i, "https://rimo.org/a", None, f"{own(i)} reimbursements\n{'more words ' * 100}\n{CLOSES}") for i in range(n)], PAGES)
    got = within(60, lambda: entities.corroborated(records, pages).collect())
    assert {(r.id, r.page_id, r.day) for r in got} == {(i, i, dt.date(2026, 5, 31)) for i in range(n)}


@pytest.mark.parametrize("most", [1, 2, 10_000])
def test_corroboration_in_shards(spark, monkeypatch, most):
    monkeypatch.setattr(entities, "SITE_PAGES", most)
    r = [
        (1, "Kilobanu Tasa Travelling", "rimo.org", None, 10, None), (2, "Kilobanu Travelling", "www.rimo.org", None, None, None), (3, "Kilobanu Travelling", "else.org", None, None, None), (4, "Travelling", "rimo.org", None, 11, dt.date(2026, 1, 1)),
        (5, "Vorune Travellings", "rimo.org", None, 14, None), (6, "Kilobanu Travellin", "rimo.org", None, None, None), (7, None, "rimo.org", None, None, None), (8, "Kilobanu", None, None, None, None), (9, "Lobanu Travelling", "rimo.org", None, 2**60 + 1, None),
    ]
    text = f"KILOBANU Tasa Travelling\n{CLOSES}"
    p = [(10, "https://rimo.org/a", None, text), (12, "https://www.rimo.org/b", None, text), (13, "https://rimo.org/c", None, text), (11, "https://rimo.org/d", None, "Kilobanu Travelling: deadline to be announced"), (14, "https://rimo.org/e", None, f"Vorune Travellings\n{CLOSES}"), (9, "https://else.net/", None, text), (15, None, None, text), (16, "https://rimo.org/f", None, None)]
    got = {tuple(x) for x in entities.corroborated(spark.createDataFrame(r, RECORDS), spark.createDataFrame(p, PAGES)).collect()}
    day = dt.date(2026, 5, 31)
    assert got == {(1, 12, day), (2, 10, day), (9, 10, day)}


def names(spark, rows):
    return spark.createDataFrame([(i, n, "rimo.org", None, None, None) for i, n in rows], RECORDS)


def test_matching_does_not_measure_all_names_of_a_domain(spark, within):
    n = 6000
    own = lambda i: " ".join("a" + "".join("bdfgklmnpr"[int(c)] + "aeiou"[(i + k) % 5] for k, c in enumerate(f"{x:05d}")) for x in (i, i * 7919 % 99991, i * 104729 % 99991))
    known, new = names(spark, [(i, own(i)) for i in range(n)]), names(spark, [(n + i, own(i)[:-1]) for i in range(n)])
    got = within(60, lambda: entities.matched(new, known).collect())
    assert len(got) == n and all(r.rule == 4 for r in got)


@pytest.mark.parametrize("most", [1, 3, 4_000])
def test_like_names_in_shards_give_the_least_record(spark, monkeypatch, most):
    monkeypatch.setattr(entities, "BLOCK_NAMES", most)
    known = names(spark, [(7, "Kilo Banu Travel Prize"), (3, "Banu Kilo Travel Prize"), (5, "Kilo Banu Travels Prize"), (9, "Vorune Tasa"), (4, "Vorune Tasu Merit Fund of Hope"), (6, "Kilo Banu Other")])
    new = names(spark, [(21, "Kilo Banu Travl Prize"), (22, "Vorune Tasa Merit Fund of Hope"), (23, "Nothing"), (24, "Travel Prize Kilo Banu")])
    assert {tuple(r) for r in entities.matched(new, known).collect()} == {(21, 3, 4), (22, 4, 4), (24, 3, 4)}


def test_records_are_matched_with_all_earlier_runs(spark, tmp_path):
    r = [
        (1, "Kilo Banu Prize", "https://rimo.org/a", "rimo.org", 2), (2, "Else", "https://rimo.org/a", "rimo.org", 3), (3, "Kilo Banu Travel Prize", None, "rimo.org", 3), (4, "Kilo Banu Travl Prize", None, "rimo.org", 5), (5, "Kilo Banu Travel Prize 2026", None, "rimo.org", 3),
        (6, "Vorune Tasa", "https://rimo.org/v/", "rimo.org", 4), (7, "Tasa", "https://www.rimo.org/v#x", "rimo.org", 6), (8, "Vorune Tasa", None, "rimo.org", None), (9, "Mopoyo", "https://rimo.org/a", "rimo.org", 1),
        (10, "Kilo Banu Travel Prizes", None, "rimo.org", 2),
    ]
    spark.createDataFrame(r, "id bigint, name string, official_url string, official_domain string, first_run_id bigint").write.parquet(f"{tmp_path}/scholarships.parquet")
    got = {tuple(x) for x in queries.self_matched(spark, str(tmp_path)).collect()}
    assert got == {(1, 9, 1), (2, 1, 1), (3, 10, 4), (4, 3, 4), (5, 10, 4), (7, 6, 2)}
