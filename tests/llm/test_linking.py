import random

from siftlake.llm import linking
from siftlake.llm.names import alike

SCH = "id bigint, name string, provider string, official_domain string"


def test_near_names_with_initials_against_all_pairs(spark):
    rnd = random.Random(4)
    syl = ["ba", "do", "ki", "lu", "me"]
    word = lambda: rnd.choice("bdk") if rnd.random() < 0.3 else "".join(rnd.choice(syl) for _ in range(3))
    names = [("r", "kulkarni"), ("rani", "kolkurni"), ("r", "k")] + [tuple(word() for _ in range(rnd.choice([1, 2, 2, 2]))) for _ in range(120)]
    names = sorted({" ".join(n) for n in names if "".join(n)})
    got = {tuple(r) for r in linking.near_names(spark.createDataFrame([("s", n, n, "") for n in names], "space string, key string, name string, letters string")).collect()}
    assert got == {(a, b) for a in names for b in names if a < b and alike(tuple(a.split()), tuple(b.split()), 2) <= 2}
    assert ("r k", "rani kolkurni") in got


def test_acronyms_meet_full_names(spark):
    rows = [("s", "a", "vojaja jolonu", "vjssb"), ("s", "b", "", "vjssb"), ("s", "c", "kilo banu", "kbrc"), ("t", "d", "", "kbrc")]
    assert {tuple(r) for r in linking.near_names(spark.createDataFrame(rows, "space string, key string, name string, letters string")).collect()} == {("a", "b")}


def test_classes_have_the_number_of_their_links(spark):
    rows = [(i, "Rimo Tasa Music Fellowship", "Vojaja University", None) for i in range(3)] + [(7, "Tasa, Rimo Music Fellowship", "Vojaja University", None), (8, "Kilo Banu Music Fellowship", "Vojaja University", None), (9, None, None, None)]
    got = {tuple(r) for r in linking.class_sizes(spark.createDataFrame(rows, SCH)).collect()}
    assert got == {(0, 0, 3), (1, 0, 3), (2, 0, 3), (7, 0, 3), (8, 8, 0)}


def test_different_providers_and_lost_letters(spark):
    rows = [(1, "Rimo Tasa Travel Grant", "Kilo Banu North Education Foundation", None), (2, "Rimo Tasa Travel Grant", "Kilo Banu South Education Foundation", None)]
    rows += [(3, "Milojo Sokago Travel Grant", "Kuboyo Vokaso University", None), (4, "Milou Sokago Travel Grant", "Kubou Vokaso Univ.", None)]
    assert {tuple(r) for r in linking.same_programme(spark.createDataFrame(rows, SCH)).collect()} == {(3, 4)}


def test_titles_without_provider_are_linked_by_their_own_domain(spark):
    rows = [(1, "Girl Child Progress Award", None, "vojajajolonu.ac.example"), (2, "Girl Child Progress Award 2025-26", None, "www.Vojajajolonu.ac.example"), (3, "Girl Chlid Progress Award", None, "vojajajolonu.ac.example")]
    rows += [(4, "Girl Child Progress Award", None, "vojajajolonu.org.example"), (5, "Rural Talent Search Scheme", None, "vojajajolonu.ac.example"), (6, "Girl Child Progress Award", None, None), (7, "Girl Child Progress Award", None, None)]
    rows += [(i, "Girl Child Progress Award", None, "scholar-index.example") for i in (8, 9)]
    rows += [(20 + i, "Rimo Tasa Travel Grant for Diploma Students", p, "scholar-index.example") for i, p in enumerate(("Kilo Banu Research Council", "Mogogi Maroko Charitable Trust", "Toraji Patovo University"))]
    got = {tuple(r) for r in linking.same_programme(spark.createDataFrame(rows, SCH)).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
