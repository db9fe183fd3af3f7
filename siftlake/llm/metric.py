"""Exact radius joins of strings in a metric space, partitioned by pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.session import cut

#: Radius of a pivot's cell, strings of a space that one round draws its pivots from, strings that a task assigns at
#: once, and members of cells that a task compares.
BALL, SAMPLE, ASSIGNED, COMPARED = 1, 2_000, 5_000, 20_000


def distance(a: str, b: str, most: int) -> int:
    """Damerau's edit distance with unrestricted exchange of neighbours, which is a metric, or most + 1 if it is greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    big, last = len(a) + len(b), {}
    d = [[big] * (len(b) + 2), [big, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, met = [big, i], 0
        for j, y in enumerate(b, 1):
            k = last.get(y, 0)
            row.append(min(d[i][j] + (x != y), row[j] + 1, d[i][j + 1] + 1, d[k][met] + i - k + j - met - 1))
            if x == y:
                met = j
        last[x] = i
        d.append(row)
        if min(row[1:]) > most + 1:
            return most + 1
    return min(d[-1][-1], most + 1)


def _codes(texts: list[str]) -> np.ndarray:
    width = max(map(len, texts), default=0)
    return np.array([[ord(c) for c in t] + [0] * (width - len(t)) for t in texts], np.int64).reshape(len(texts), width)


def _long(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        up, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            up, row[j] = row[j], min(up + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def distances(a: list[str], i: np.ndarray, b: list[str], j: np.ndarray) -> np.ndarray:
    """Levenshtein's edit distance, a metric, of each a[i] and b[j], 64 cells of a column at once by bit-parallel arithmetic."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    short = np.array([len(t) < 64 for t in a])[i]
    for k in np.flatnonzero(~short).tolist():
        out[k] = _long(a[i[k]], b[j[k]])
    x, y = _codes([t if len(t) < 64 else "" for t in a]), _codes(b)
    letters, both = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    x, y = both[: x.size].reshape(x.shape), both[x.size :].reshape(y.shape)
    size_a, size_b = np.array([len(t) if len(t) < 64 else 0 for t in a]), np.array([len(t) for t in b])
    place = np.zeros((len(a), len(letters)), np.uint64)
    for c in range(x.shape[1]):
        rows = np.flatnonzero(size_a > c)
        place[rows, x[rows, c]] |= np.uint64(1 << c)
    one = np.uint64(1)
    every = np.flatnonzero(short)
    for begin in range(0, len(every), 100_000):
        part = every[begin : begin + 100_000]
        ia, jb = i[part], j[part]
        m = size_a[ia]
        high = np.where(m > 0, one << np.maximum(m - 1, 0).astype(np.uint64), np.uint64(0))
        up, down, score = np.full(len(part), ~np.uint64(0)), np.zeros(len(part), np.uint64), m.astype(np.int64)
        until = size_b[jb]
        for c in range(int(until.max(initial=0))):
            met = place[ia, y[jb, c]] | down
            same = (((met & up) + up) ^ up) | met
            left, right = up & same, down | ~(up | same)
            live = until > c
            score += (((right & high) != 0).astype(np.int64) - ((left & high) != 0)) * live
            right = right << one | one
            down, up = right & same, left << one | ~(right | same)
        out[part] = np.where(m > 0, score, until)
    return out


def _bags(texts: list[str]) -> np.ndarray:
    """How often each of 32 classes of letters stands in each text."""
    bags = np.zeros((len(texts), 32), np.int16)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    np.add.at(bags, (owner, np.array([ord(c) & 31 for t in texts for c in t], np.int64)), 1)
    return bags


def near(a: list[str], b: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i in a, j in b) within `most`, and their distances. Letters that two texts do not share bound them from below first."""
    left, right = _bags(a), _bags(b)
    size_a, size_b = left.sum(1), right.sum(1)
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for begin in range(0, len(a), 500):
        part = left[begin : begin + 500]
        shared = np.zeros((len(part), len(b)), np.int16)
        for c in range(32):
            if part[:, c].any() and right[:, c].any():
                shared += np.minimum(part[:, c, None], right[None, :, c])
        i, j = np.nonzero(np.maximum(size_a[begin : begin + 500, None], size_b[None, :]) - shared <= most)
        if len(i):
            i = i + begin
            d = distances(a, i, b, j)
            keep = d <= most
            got.append((i[keep], j[keep], d[keep]))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16)
    return tuple(np.concatenate(x) for x in zip(*got))


def leaders(texts: list[str], ball: int = BALL) -> list[str]:
    """Pivots among texts: each text that no earlier pivot has within the ball is one, so that together they cover all."""
    order = sorted(set(texts))
    i, j, _ = near(order, order, ball)
    close: list[list[int]] = [[] for _ in order]
    for x, y in zip(i.tolist(), j.tolist()):
        close[x].append(y)
    covered, out = [False] * len(order), []
    for x, t in enumerate(order):
        if not covered[x]:
            out.append(t)
            for y in close[x]:
                covered[y] = True
    return out


def cells(texts: list[str], pivots: list[str], radius: int, ball: int = BALL) -> list[tuple[str, str, int]]:
    """(text, pivot, role): role 0 in the cell of the first pivot that has the text within the ball, 1 in each other cell
    that by the triangle inequality may hold a text within the radius of it, 2 (without pivot) if it has no cell of its own."""
    i, j, d = near(texts, pivots, ball + radius)
    home: dict[int, int] = {}
    for x, y, v in sorted(zip(i.tolist(), j.tolist(), d.tolist())):
        if v <= ball:
            home.setdefault(x, y)
    out = [(texts[x], pivots[y], int(home.get(x) != y)) for x, y in zip(i.tolist(), j.tolist())]
    return out + [(t, "", 2) for x, t in enumerate(texts) if x not in home]


_CELLS = "space string, text string, pivot string, role int"


def assigned(points: DataFrame, radius: int, ball: int = BALL, sample: int = SAMPLE) -> DataFrame:
    """space, text, pivot, role (0: own cell, 1: boundary text) of distinct points (space, text).

    Rounds: of each space a bounded sample of the texts left is thinned to pivots that lie more than the ball apart; texts
    within the ball of a pivot go to its cell, and every text left, covered or not, is replicated to each cell whose
    pivot it has within ball + radius. What no pivot covers is left to the next round, which covers at least its own
    pivots, so that all texts get a cell and no pair within the radius is without a common one.
    """
    rest, done = points.select("space", "text").distinct(), None

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pivots = leaders(pdf["text"].tolist(), ball)
        parts = -(-int(pdf["n"].iloc[0]) // ASSIGNED)
        return pd.DataFrame({"space": pdf["space"].iloc[0], "pivot": pivots * parts, "part": np.repeat(np.arange(parts, dtype=np.int32), len(pivots))})

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"space": [], "text": [], "pivot": [], "role": []})
        got = cells(left["text"].tolist(), right["pivot"].tolist(), radius, ball)
        return pd.DataFrame(got, columns=["text", "pivot", "role"]).assign(space=left["space"].iloc[0])[["space", "text", "pivot", "role"]]

    while True:
        rest = cut(rest)
        rest = cut(rest.join(rest.groupBy("space").agg(F.count("*").alias("n")), "space"))
        rank = F.row_number().over(W.partitionBy("space").orderBy(F.xxhash64("text", F.lit(7)), "text"))
        draw = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * 2 * sample / F.col("n")
        drawn = rest.where((F.col("n") <= sample) | draw).withColumn("k", rank).where(F.col("k") <= sample)
        pivots = drawn.groupBy("space").applyInPandas(thin, "space string, pivot string, part int").select(F.col("space").alias("s"), "pivot", F.col("part").alias("p"))
        mine = rest.select("space", "text", F.pmod(F.xxhash64("text"), F.ceil(F.col("n") / ASSIGNED)).cast("int").alias("part"))
        placed = cut(mine.groupBy("space", "part").cogroup(pivots.groupBy("s", "p")).applyInPandas(place, _CELLS))
        own = placed.where("role < 2")
        done = own if done is None else done.unionAll(own)
        rest = placed.where("role = 2").select("space", "text")
        if rest.isEmpty():
            return done


def radius_join(points: DataFrame, radius: int, ball: int = BALL, sample: int = SAMPLE) -> DataFrame:
    """space, s, t (s < t): every two texts of one space within the radius, by exact joins inside the pivots' cells.

    points: space, text; nulls and repeated points count for nothing. A cell's own texts are compared with each other and
    with its boundary texts; a task takes the cells of one range of their hashes.
    """
    placed = assigned(points.where("space is not null and text is not null"), radius, ball, sample)
    tasks = max(1, -(-placed.count() // COMPARED))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["space", "pivot", "role", "text"], kind="stable")
        texts, role = pdf["text"].tolist(), pdf["role"].to_numpy()
        key = (pdf["space"] + "\0" + pdf["pivot"]).to_numpy()
        ends = [*np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else []
        out, begin = [], 0
        a: list[int] = []
        b: list[int] = []
        for end in ends:
            for x in range(begin, begin + int((role[begin:end] == 0).sum())):
                a += [x] * (end - x - 1)
                b += range(x + 1, end)
            begin = end
            if len(a) > 200_000 or end == len(key):
                far = distances(texts, np.array(a, np.int64), texts, np.array(b, np.int64))
                for k in np.flatnonzero(far <= radius).tolist():
                    out.append((pdf["space"].iat[a[k]], *sorted((texts[a[k]], texts[b[k]]))))
                a, b = [], []
        return pd.DataFrame(out, columns=["space", "s", "t"])

    return placed.groupBy(F.pmod(F.xxhash64("space", "pivot"), F.lit(tasks)).alias("task")).applyInPandas(compare, "space string, s string, t string").distinct()
