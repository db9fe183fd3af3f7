"""Main body of a page against site furniture, line by line, by minimum cuts."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.lines import CONTENT, ERROR, FILLER, FURNITURE, LineModel

#: Capacities: the most that the classifier may say of one line, what joins neighbours of any kind, neighbours with the
#: same list mark, a run of names with each other and with the short line above it, and a page's own title with its side.
MOST, NEAR, LISTED, NAMED, TITLE = 4.0, 0.12, 0.4, 3.0, 8.0

# Last words of a programme's name and openings of the lists of other programmes.
KINDS = "scholarship|scheme|grant|fellowship|award|bursary|fund|subsidy|stipend|waiver|prize|loan"
_NAME = re.compile(rf"^(?!Copyright\b)[^\W\d_][^|/<>›»:?!=]*\b(?:{KINDS})s?\b(?: for [^|/<>›»:?!]*)?$", re.I)
_SMALL = {"and", "of", "for", "in", "the", "cum", "to", "a"}
_MARK = re.compile(r"^\s*([-*•–]|\d+[.)])\s")
_SLUG = re.compile(r"[^a-z0-9]+")
_SPACES = re.compile(r"\s+")


@cache
def model() -> LineModel:
    """The classifier of furniture against what belongs to the page (content, error messages and filler alike)."""
    return LineModel({"furniture": FURNITURE, "content": CONTENT + ERROR + FILLER})


class Flow:
    """Maximum flow by shortest augmenting paths (breadth first levels, blocking flows) on a small graph."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[float] = []
        self.at: list[list[int]] = [[] for _ in range(n)]

    def join(self, a: int, b: int, there: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def _levels(self, s: int) -> list[int]:
        level = [-1] * len(self.at)
        level[s] = 0
        todo = deque([s])
        while todo:
            v = todo.popleft()
            for e in self.at[v]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[v] + 1
                    todo.append(self.to[e])
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Which nodes are on the source's side of a minimum cut."""
        while (level := self._levels(s))[t] >= 0:
            left = [0] * len(self.at)
            while True:
                path, v = [], s
                while v != t:
                    while left[v] < len(self.at[v]):
                        e = self.at[v][left[v]]
                        if self.room[e] > 1e-9 and level[self.to[e]] == level[v] + 1:
                            break
                        left[v] += 1
                    else:
                        if not path:
                            break
                        e = path.pop()
                        v = self.to[e ^ 1]
                        left[v] += 1
                        continue
                    path.append(e)
                    v = self.to[e]
                if v != t:
                    break
                push = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= push
                    self.room[e ^ 1] += push
        return [x >= 0 for x in self._levels(s)]


def cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes that a minimum cut puts on the positive side.

    A node whose own cost exceeds all its edges is decided beforehand and its edges become its neighbours' costs, which
    changes no minimum cut; what is left goes through the maximum flow.
    """
    n = len(unary)
    cost, near, label = list(unary), [{} for _ in range(n)], [None] * n
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(cost[i]) >= sum(near[i].values()) and cost[i]:
            label[i] = cost[i] > 0
            for j, c in near[i].items():
                cost[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        flow = Flow(len(rest) + 2)
        s, t = len(rest), len(rest) + 1
        for i in rest:
            if cost[i] > 0:
                flow.join(s, at[i], cost[i])
            elif cost[i] < 0:
                flow.join(at[i], t, -cost[i])
            for j, c in near[i].items():
                if i < j:
                    flow.join(at[i], at[j], c, c)
        for i, side in zip(rest, flow.source_side(s, t)):
            label[i] = side
    return label


def is_name(line: str) -> bool:
    """Whether a line is no more than a programme's name: capitalised words that end in a kind of award."""
    return len(line) < 130 and bool(_NAME.match(line)) and all(not w[:1].islower() or w in _SMALL for w in line.split())


class Lines:
    """What the classifier says of single lines, kept for lines that come again."""

    def __init__(self, scorer: LineModel):
        self.scorer, self.seen = scorer, {}

    def look(self, raw: str) -> tuple[float, str, str, str]:
        """Cost (above 0 for the main body), kind, list mark and the form of a name that an address has."""
        if (got := self.seen.get(raw)) is None:
            if len(self.seen) >= 100_000:  # forgets, so that memory stays bounded
                self.seen.clear()
            x = _SPACES.sub(" ", raw).strip()
            if is_name(x):
                got = 0.15, "name", "", _SLUG.sub("-", x.lower()).strip("-")
            else:
                a, b = self.scorer.score(x)
                m = _MARK.match(x)
                got = max(-MOST, min(MOST, b - a)) or 0.05, "short" if len(x) < 40 and x[-1:] not in ".!" else "long", "" if not m else "1" if m[1][0].isdigit() else m[1], ""
            self.seen[raw] = got
        return got


def _joint(one: tuple, two: tuple) -> float:
    """The capacity between neighbouring lines."""
    a, b = one[1], two[1]
    if b == "name" and (a == "name" or a == "short" and one[0] < 0):
        return NAMED
    if a in ("name", "title") or b in ("name", "title"):
        return NEAR / 2
    return LISTED if one[2] and one[2] == two[2] else NEAR


def furniture_lines(text: str, address: str | None, lines: Lines) -> list[int]:
    """Numbers (from 1) of the non-blank lines that are furniture. address tells the page's own title from other names."""
    slug = re.sub(r"-\d+$", "", re.sub(r"[?#].*$", "", address or "").rstrip("/").rsplit("/", 1)[-1].lower()).strip("-")
    numbers, rows = [], []
    for i, raw in enumerate(text.split("\n"), 1):
        if raw and not raw.isspace():
            got = lines.look(raw)
            if got[3] and slug and got[3].startswith(slug):
                got = TITLE, "title", "", ""
            numbers.append(i)
            rows.append(got)
    joints = [0.0, *(_joint(a, b) for a, b in zip(rows, rows[1:])), 0.0]
    label = [u > 0 if abs(u) >= joints[i] + joints[i + 1] else None for i, (u, *_) in enumerate(rows)]
    if open_ := [i for i, v in enumerate(label) if v is None]:
        at = {i: k for k, i in enumerate(open_)}
        cost, edges = [rows[i][0] for i in open_], []
        for i in open_:
            for j, c in ((i - 1, joints[i]), (i + 1, joints[i + 1])):
                if j in at:
                    if i < j:
                        edges.append((at[i], at[j], c))
                elif 0 <= j < len(rows):
                    cost[at[i]] += c if label[j] else -c
        for i, v in zip(open_, cut(cost, edges)):
            label[i] = v
    return [n for n, main in zip(numbers, label) if not main]


def page_furniture(pages: DataFrame) -> DataFrame:
    """page_id, line_no of every non-blank line of furniture. Null and empty texts have none; each row stands alone.

    One pass without a shuffle: lines are scored by a small trained softmax (its weights go with the function), and a
    minimum cut over each page's lines settles what a line alone leaves open.
    """
    scorer = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = Lines(scorer)
        for pdf in batches:
            got = [furniture_lines(t, u, lines) for t, u in zip(pdf["text"], pdf["address"])]
            sizes = [len(g) for g in got]
            yield pd.DataFrame({"page_id": np.repeat(pdf["page_id"].to_numpy(), sizes), "line_no": np.array([i for g in got for i in g], np.int32)})

    rows = pages.select("page_id", F.coalesce("final_url", "url").alias("address"), "text").where("text is not null and text <> ''")
    return rows.mapInPandas(run, "page_id bigint, line_no int")


def main_body(pages: DataFrame) -> DataFrame:
    """page_id and body: the text of every page without its furniture, blank lines dropped; a null text stays null."""
    scorer = model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = Lines(scorer)
        for pdf in batches:
            body = []
            for t, u in zip(pdf["text"], pdf["address"]):
                out = set(furniture_lines(t, u, lines)) if t else set()
                body.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n"), 1) if i not in out and x.strip()))
            yield pd.DataFrame({"page_id": pdf["page_id"], "body": body})

    return pages.select("page_id", F.coalesce("final_url", "url").alias("address"), "text").mapInPandas(run, "page_id bigint, body string")
