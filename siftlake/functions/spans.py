"""Places in a text: quotes, sentences, headings, sections and dates with their offsets.

Pure Python on one text; the operators call it in Arrow batches. Offsets count letters of the text as given.
"""

from __future__ import annotations

import datetime as dt
import difflib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

from siftlake.functions import lexicon as L
from siftlake.functions.stated import NOTATIONS

#: Letters from which a quote may match loosely, its least similarity, and letters below which it matches nothing.
LOOSE_FROM, LOOSE_LEAST, QUOTE_LEAST = 25, 92.0, 4
#: Letters up to which a line is one sentence, a heading's most letters, and lines and letters that a section takes.
LINE, HEADING, SECTION_LINES, SECTION_LETTERS = 260, 85, 39, 1100

_PLAIN = str.maketrans({**dict.fromkeys("‐‑‒–—―−", "-"), "‘": "'", "’": "'", "“": '"', "”": '"'})
_BREAK = re.compile(r"(?<=[.;!?])\s+(?=[A-Z0-9(\"'“])")
# Headings of a programme page's sections.
SECTIONS = {
    "eligibility_text": r"eligibility(?: criteria| conditions)?|who can apply|who is eligible|conditions (?:of eligibility|to be met)",
    "documents_required": r"documents? (?:required|needed|to be \w+)|required documents?|list of (?:documents|enclosures)|supporting documents",
    "selection_process": r"selection(?: process| criteria| procedure)?|mode of selection|method of selection|evaluation (?:process|criteria)",
    "renewal_requirements": r"renewal(?: criteria| conditions| process| requirements)?|continuation of|continuing the award",
    "benefit_text": r"(?:scholarship|award) (?:amount|benefits?|value|details)|benefits?|financial (?:assistance|support|benefits?)|what (?:do|will)? ?you get|amount of (?:the )?(?:scholarship|award|assistance)",
}
OTHER_HEADINGS = r"objectives?|about(?: the)? (?:scheme|scholarship|programme|program)|introduction|how to apply|application (?:process|procedure)|important dates?|terms (?:and|&) conditions|general (?:conditions|instructions)|scope|overview|contact|faqs?|disbursement|duration|tenure|payment|apply (?:online|now)|timeline|key dates|about us"
_NUMBERED = r"^\W*(?:\d+(?:\.\d+)*[.)]?\s*)?"
_HEADS = re.compile(rf"{_NUMBERED}(?:{'|'.join(SECTIONS.values())}|{OTHER_HEADINGS})\b", re.I)


class Span(NamedTuple):
    start: int
    end: int
    score: float


@cache
def pattern(text: str) -> re.Pattern:
    """A pattern of the lexicon, in any case."""
    return re.compile(text, re.I)


class Folded:
    """A text folded for comparison, with the offset that each of its letters has in the text."""

    def __init__(self, text: str):
        self.text, self.at, out = text, [], []
        for i, c in enumerate(text):
            for x in unicodedata.normalize("NFKC", c).translate(_PLAIN).lower():
                x = " " if x.isspace() else x
                if x != " " or not out or out[-1] != " ":
                    out.append(x)
                    self.at.append(i)
        self.plain = "".join(out)

    def find(self, quote: str) -> Span | None:
        """Where a quote stands: exactly (score 100), or from LOOSE_FROM letters on at the likest place, widened to whole words."""
        want = Folded(quote).plain.strip()
        if len(want) < QUOTE_LEAST:
            return None
        if (k := self.plain.find(want)) >= 0:
            return Span(self.at[k], self.at[k + len(want) - 1] + 1, 100.0)
        if len(want) < LOOSE_FROM or not self.plain:
            return None
        best, n = (0.0, 0, 0), len(want)
        blocks = difflib.SequenceMatcher(None, want, self.plain, autojunk=False).get_matching_blocks() if len(self.plain) <= 20 * n else self._seeds(want)
        for a, b, _ in blocks:
            lo = max(0, b - a)
            hi = min(len(self.plain), lo + n)
            best = max(best, (similarity(want, self.plain[lo:hi]), -lo, hi))
        score, lo, hi = best[0], -best[1], best[2]
        if score < LOOSE_LEAST:
            return None
        while lo and self.plain[lo - 1].isalnum():
            lo -= 1
        while hi < len(self.plain) and self.plain[hi].isalnum():
            hi += 1
        return Span(self.at[lo], self.at[hi - 1] + 1, score)

    def _seeds(self, want: str) -> list[tuple[int, int, int]]:
        """Places at which a long text shares a piece of the quote: one of five pieces survives a similarity of LOOSE_LEAST."""
        size = max(4, len(want) // 9)
        return [(a, m.start(), size) for a in range(0, len(want) - size + 1, size) for m in re.finditer(re.escape(want[a : a + size]), self.plain)]


def similarity(a: str, b: str) -> float:
    """Twice the letters in common order over all letters, from 0 to 100: the similarity of insertions and deletions."""
    if not a and not b:
        return 100.0
    rows = {c: 0 for c in a}
    for i, c in enumerate(a):
        rows[c] |= 1 << i
    state = full = (1 << len(a)) - 1
    for c in b:  # bit-parallel longest common subsequence
        met = state & rows.get(c, 0)
        state = (state + met | state - met) & full
    return 200.0 * (len(a) - state.bit_count()) / (len(a) + len(b))


def token_set_similarity(a: str, b: str) -> float:
    """similarity() that does not mind words of which one text has more: the best of shared words against each text's words and of both."""
    x, y = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    one, two = f"{shared} {' '.join(sorted(x - y))}".strip(), f"{shared} {' '.join(sorted(y - x))}".strip()
    return max(similarity(one, two), *(similarity(shared, z) if shared else 0.0 for z in (one, two)))


def sentences(text: str, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence that touches [lo, hi): short lines whole, longer ones split behind their marks."""
    hi, at = len(text) if hi is None else hi, 0
    for line in text.split("\n"):
        begin, at = at, at + len(line) + 1
        if line.strip() and begin + len(line) > lo and begin < hi:
            cuts = [0, *(m.end() for m in _BREAK.finditer(line)), len(line)] if len(line) >= LINE else [0, len(line)]
            for a, b in zip(cuts, cuts[1:]):
                yield begin + a, begin + a + len(line[a:b].rstrip())


def is_heading(line: str) -> bool:
    """Whether a line is a heading: a known one, one that ends in a colon, or one all in capitals."""
    s = line.strip()
    if not s or len(s) > HEADING:
        return False
    return len(s) < 70 and (s.endswith(":") or bool(_HEADS.match(s))) or s.isupper() and sum(c.isalpha() for c in s) >= 4 and not s.endswith(".")


def sections(text: str, most: int = SECTION_LETTERS) -> dict[str, Span]:
    """The first section of each kind: from its heading to the next, SECTION_LINES lines and `most` letters at most, 40 letters at least."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    heads = [is_heading(x) for _, x in lines]
    out: dict[str, Span] = {}
    for field, rx in SECTIONS.items():
        begins = re.compile(rf"{_NUMBERED}(?:{rx})\b", re.I)
        for i, (start, line) in enumerate(lines):
            if len(line.strip()) <= 75 and begins.match(line.strip()):
                end = start + len(line)
                for k in range(i + 1, min(len(lines), i + 1 + SECTION_LINES)):
                    to = lines[k][0] + len(lines[k][1])
                    if heads[k] and k > i + 1 or to - start > most:
                        break
                    end = to
                if len(text[start:end].strip()) >= 40:
                    out[field] = Span(start, start + len(text[start:end].rstrip()), 100.0)
                    break
    return out


class Day(NamedTuple):
    day: dt.date
    start: int
    end: int
    kind: str


_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def days(text: str) -> list[Day]:
    """The dates that a text writes, in their order, with the kind that the words beside them give: closing, opening or other."""
    found: list[Day] = []
    for rx, (y, m, d) in NOTATIONS:
        for hit in pattern(rx).finditer(text):
            if any(hit.start() < x.end and x.start < hit.end() for x in found):
                continue
            month = int(hit[m]) if hit[m].isdigit() else _MONTHS.index(hit[m][:3].lower()) // 3 + 1
            try:
                day = dt.date(int(hit[y]), month, int(hit[d]))
            except ValueError:
                continue
            if 2000 <= day.year <= 2100:
                found.append(Day(day, hit.start(), hit.end(), _kind(text, hit.start(), hit.end())))
    return sorted(found, key=lambda x: x.start)


def _kind(text: str, start: int, end: int) -> str:
    begin = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    line = text[begin : stop if stop >= 0 else len(text)]
    if pattern(L.NOT_CLOSING).search(line[:600]):
        return "other"
    before = text[max(begin, start - 90) : start]
    last = {kind: max((m.end() for m in pattern(rx).finditer(before)), default=-1) for kind, rx in (("closing", L.CLOSING), ("opening", L.OPENING))}
    if max(last.values()) >= 0:
        return "closing" if last["closing"] >= last["opening"] else "opening"
    return "closing" if re.match(r"\s*(?:is|was)?\s*(?:the )?(?:last|closing|deadline)", text[end : end + 40], re.I) else "other"


def strength(sentence: str) -> int:
    """How surely a sentence states the day on which applications close, from 0 to 3."""
    is_ = lambda p: bool(pattern(p).search(sentence))
    if is_(L.NOT_CLOSING):
        return 0
    if is_(L.EXPLICIT_CLOSING):
        return 3
    return 1 + is_(L.APPLYING) if is_(L.CLOSING) else 2 * (is_(L.APPLYING) and is_(L.UNTIL))
