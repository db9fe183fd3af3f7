import datetime as dt
import random

from siftlake.functions import spans as S
from siftlake.operators.claims import agreement, derivable, numbers_in, page_claims


def test_quotes_are_found_with_their_offsets():
    text = "Intro\nStudents  must have\n60 per cent “marks” – overall in the last exam.\nEnd"
    got = S.Folded(text).find('students must have 60 per cent "marks" - overall')
    assert text[got.start : got.end] == "Students  must have\n60 per cent “marks” – overall" and got.score == 100
    near = S.Folded(text).find("students must hve 60 per cent marks - overall in the last")
    assert near.score >= 92 and text[near.start : near.end].startswith("Students")
    assert S.Folded(text).find("abc") is None and S.Folded(text).find("a quite different sentence of some length") is None
    assert S.Folded("").find("something") is None
    long = "filler words here. " * 500 + "The income of both parents must stay below two lakh rupees a year. " + "more filler. " * 500
    assert S.Folded(long).find("the income of both parents mst stay below two lakh rupees a year").score >= 92


def test_similarity_against_the_plain_table():
    rnd = random.Random(1)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(12))) for _ in range(2))
        assert S.similarity(a, b) == (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)
    assert S.token_set_similarity("Rimo Trust", "the Rimo Trust of Nonu") == 100


def test_sentences_cover_lines_and_split_long_ones():
    long = "This is a sentence of the page. " * 12
    text = f"Short line.\n\n{long.strip()}\nLast"
    at = list(S.sentences(text))
    assert text[slice(*at[0])] == "Short line." and text[slice(*at[-1])] == "Last"
    assert len(at) == 14 and all(text[a:b] == "This is a sentence of the page." for a, b in at[1:-1])
    assert list(S.sentences("")) == []
    assert [text[a:b] for a, b in S.sentences(text, 0, 5)] == ["Short line."]


def test_headings_and_sections():
    assert all(map(S.is_heading, ("Eligibility", "2. Documents required", "HOW IT WORKS", "Whom to ask:")))
    assert not any(map(S.is_heading, ("", "Students must apply by post.", "A" * 90)))
    text = "Eligibility\nStudents need 60 per cent marks in the last exam.\nBenefits\nSelected students receive Rs 5,000 a month.\nContact\nx"
    got = S.sections(text)
    assert set(got) == {"eligibility_text", "benefit_text"} and text[got["benefit_text"].start : got["benefit_text"].end].endswith("a month.")
    assert S.sections("") == {}


def test_days_in_four_notations_with_their_kind():
    text = "Closing date: 5th Jan 2026\nResults by 3/4/2026\nOpens on May 3, 2026 for all\nOn 2026-02-30 and 2026-02-28\nin 1850: 1/1/1850"
    assert [(d.day, d.kind) for d in S.days(text)] == [(dt.date(2026, 1, 5), "closing"), (dt.date(2026, 4, 3), "other"), (dt.date(2026, 5, 3), "opening"), (dt.date(2026, 2, 28), "other")]
    assert [S.strength(s) for s in ("Last date to apply: 5 May", "Deadline 5 May", "Referee deadline 5 May", "Register until 5 May", "Nothing")] == [3, 1, 0, 2, 0]


def test_claims_are_slices_of_the_page():
    text = "Rimo Tasa Merit Scholarship\nRimo Memorial Trust runs it.\nEligibility\nOnly SC and ST students below 25 years of age may apply.\nThe last date to apply is 31 December 2026.\nThe scholarship of Rs 50,000 per year is paid to each student."
    got = {f: (v, text[a:b]) for f, v, a, b in page_claims("Rimo Tasa Merit Scholarship | Trust", text)}
    assert got["name"][0] == "Rimo Tasa Merit Scholarship" and got["closing_date"][0] == "2026-12-31" and got["age"][0] == "-25" and got["categories"][0] == "SC,ST" and got["amount"][0] == "INR 50000-50000"
    assert all(q for _, q in got.values())
    assert list(page_claims(None, "")) == []


def test_values_must_be_derivable_from_their_quotes():
    ok = lambda *a: derivable(*a)[0]
    assert ok("closing_date", "2026-12-31", "Apply by 31 December 2026") and not ok("closing_date", "2026-12-30", "Apply by 31 December 2026") and not ok("closing_date", "2026-12-31", "Interview on 31 December 2026")
    assert ok("categories", "SC,ST,OBC", "for SC and ST students") == "SC,ST" and not ok("gender", "FEMALE", "for all students")
    assert ok("amount", "INR 0-250000", "a scholarship of Rs 2.5 lakh") is None and ok("amount", "INR 250000-250000", "a scholarship of Rs 2.5 lakh") and not ok("amount", "INR 5000-5000", "our fund raised Rs 5000")
    assert ok("income", "INR 200000", "income below 2 lakh") and not ok("income", "INR 300000", "income below 2 lakh")
    assert ok("eligibility_text", "x", "Students must be residents") and not ok("eligibility_text", "x", "I was a student") and not ok("selection_process", "x", "Bring a pen")
    assert ok("deadline_note", "x", "Applications are accepted round the year") and not ok("deadline_note", "x", "Applications are closed")
    assert numbers_in("1,50,000 or 2.5 lakh") == {150000.0, 2.5, 250000.0}


def test_agreement_of_two_readers():
    assert agreement("categories", "SC,ST", "ST,SC") == 1 and agreement("categories", "SC,ST", "SC,OBC") == 0 and agreement("categories", "SC,ST", "SC,ST,OBC") == 0.5
    assert agreement("provider", "KBRC", "Kilo Banu Research Council") == 1 and agreement("closing_date", "2026-01-01", "2026-01-02") == 0 and agreement("amount", "INR 0-5000", "INR 5000-5000") == 1
