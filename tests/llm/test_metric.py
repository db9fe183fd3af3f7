import random

import numpy as np

from siftlake.llm import metric


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_against_the_plain_table():
    rnd = random.Random(1)
    a = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(12))) for _ in range(300)] + ["a" * 70, "a" * 63, ""]
    b = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(12))) for _ in range(300)] + ["b" + "a" * 69, "a" * 62 + "b", ""]
    at = np.arange(len(a))
    assert metric.distances(a, at, b, at).tolist() == [levenshtein(x, y) for x, y in zip(a, b)]


def test_both_distances_are_metrics():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(6)))
    assert metric.distance("ca", "abc", 9) == 2 and metric.distance("abcd", "x", 1) == 2
    for _ in range(3000):
        x, y, z = word(), word(), word()
        assert metric.distance(x, z, 99) <= metric.distance(x, y, 99) + metric.distance(y, z, 99)
        assert metric.distance(x, y, 99) == metric.distance(y, x, 99) <= levenshtein(x, y) <= 2 * metric.distance(x, y, 99)


def test_radius_join_over_several_rounds_against_all_pairs(spark):
    rnd = random.Random(3)
    texts = sorted({"".join(rnd.choice("abdeik") for _ in range(rnd.randrange(1, 9))) for _ in range(400)})
    rows = [(s, t) for s in ("x", "y") for t in texts[: 400 if s == "x" else 60]] * 2 + [(None, "a"), ("x", None)]
    points = spark.createDataFrame(rows, "space string, text string")
    want = {(s, a, b) for s, part in (("x", texts), ("y", texts[:60])) for a in part for b in part if a < b and levenshtein(a, b) <= 2}
    assert {tuple(r) for r in metric.radius_join(points, 2, sample=40).collect()} == want
    assert {tuple(r) for r in metric.radius_join(points, 2).collect()} == want
    assert metric.radius_join(points.limit(0), 2).count() == 0


def test_pivots_cover_and_cells_share():
    rnd = random.Random(4)
    texts = sorted({"".join(rnd.choice("abdeiklmno") for _ in range(6)) for _ in range(200)})
    pivots = metric.leaders(texts)
    got = metric.cells(texts, pivots, 2)
    assert sum(role == 0 for _, _, role in got) == len(texts)
    own = {t: p for t, p, role in got if role == 0}
    of = {}
    for t, p, _ in got:
        of.setdefault(t, set()).add(p)
    for a in texts:
        for b in texts:
            if levenshtein(a, b) <= 2:
                assert own[a] in of[b]
