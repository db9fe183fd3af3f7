"""Parts of typed names of award programmes and of their providers, in forms that survive typing habits."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from typing import NamedTuple

from siftlake.llm.metric import distance

# Kinds of award, levels of study, kinds of organisation, short forms, words that tell nothing.
KINDS = ("merit scholarship", "merit cum means scholarship", "nursing stipend scheme", "travel grant", "research fellowship", "science talent award", "book bank grant", "teacher training bursary", "arts and crafts fellowship", "hostel support scheme", "sports scholarship", "tuition waiver scheme")
LEVELS = {
    "school 9 10": "school students of class 9 and 10", "school 11 12": "school students of class 11 and 12", "undergraduate": "undergraduate students", "postgraduate": "postgraduate students",
    "doctoral": "doctoral scholars", "diploma": "diploma students", "iti": "iti trainees",
}
BODIES = (
    "state scholarship board", "institute of technology", "university", "womens education league", "industries social fund", "education foundation", "memorial trust", "charitable trust",
    "cooperative bank csr cell", "students aid fund", "welfare society", "research council", "vidya nidhi", "directorate of higher education", "overseas study commission",
)
SHORT = {
    "schol": "scholarship", "sch": "scheme", "fship": "fellowship", "stud": "students", "std": "class", "edu": "education", "fdn": "foundation", "dte": "directorate", "inst": "institute", "univ": "university",
    "char": "charitable", "mem": "memorial", "cncl": "council", "st": "state", "soc": "society", "ind": "industries", "comm": "commission", "ug": "undergraduate", "pg": "postgraduate", "phd": "doctoral", "govt": "government", "tech": "technology", "welf": "welfare", "coop": "cooperative",
}
#: Letters up to which a word of a longer name may have one edit only: another such word is soon another name.
SMALL = 5
TITLES = frozenset("smt shri sri dr pt prof late ms mr mrs the".split())
_LEVEL_WORDS = frozenset("for school students of class 9 10 11 12 and undergraduate postgraduate doctoral scholars diploma iti trainees".split())

_SESSION = re.compile(r"[-–—(\[]?\s*(?:\bsession\b\s*)?\b20\d\d\s?(?:[-/–]\s?(?:20)?\d\d)?\b\s*[)\]]?|\bsession\b", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
_ASPIRATE = re.compile(r"([bcdfgjklmnpqrstvwxyz])h")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def fold(text: str) -> str:
    """Without marks on letters, case, apostrophes and compatibility forms."""
    text = _CAMEL.sub(" ", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    text = text.replace("m/s", " ").replace("&", " and ").replace("ph.d", "phd").replace("co-op", "coop")
    return re.sub(r"['’`]", "", text)


def spoken(word: str) -> str:
    """A name as it sounds: long vowels and aspirated consonants written plainly."""
    return _ASPIRATE.sub(r"\1", word.replace("aa", "a").replace("ee", "i").replace("oo", "u").replace("au", "o").replace("ou", "u"))


def words(text: str) -> list[str]:
    """The words of a folded text, short forms written out."""
    t = _WORD.findall(fold(text))
    return [w if w == "schol" and n.startswith("stud") else SHORT.get(w, w) for w, n in zip(t, [*t[1:], ""])]


class _Phrases:
    """Finds the phrase of a list that stands among tokens with the fewest typos, the longest of several."""

    def __init__(self, phrases: dict[str, str], slack: Callable[[str], int]):
        self.at = {p.replace(" ", ""): (p, value) for p, value in phrases.items()}
        self.sizes = range(1, max(len(p.split()) for p in phrases) + 2)
        self.rows = [(w, set(w), {len(p.split()) + k for k in (-1, 0, 1)} - {0}, slack(p), p, value) for w, (p, value) in self.at.items()]

    def find(self, tokens: list[str]) -> tuple[str, int, int] | None:
        """The phrase's value and where it begins and ends. A phrase without typos is looked up; only where there is none are typos allowed."""
        spans = [("".join(tokens[i : i + n]), n, i) for n in self.sizes for i in range(len(tokens) - n + 1)]
        exact = [(-len(w), i, n) for w, n, i in spans if w in self.at]
        if exact:
            _, i, n = min(exact)
            return self.at["".join(tokens[i : i + n])][1], i, i + n
        best = None
        marked = [(w, n, i, set(w)) for w, n, i in spans]
        for want, letters, sizes, slack, p, value in self.rows:
            for got, n, i, own in marked:
                if n in sizes and abs(len(got) - len(want)) <= slack and len(letters ^ own) <= 2 * slack:
                    d = distance(got, want, slack)
                    if d <= slack and (best is None or (d, -len(p)) < best[0]):
                        best = (d, -len(p)), value, i, i + n
        return best and best[1:]


_LEVEL = _Phrases({v: k for k, v in LEVELS.items()}, lambda p: 2)
_SHORT_LEVEL = _Phrases({k: k for k in ("undergraduate", "postgraduate", "doctoral")}, lambda p: 1)
_KIND = _Phrases({k: k for k in KINDS}, lambda p: 2 if len(p) > 12 else 1)
_BODY = _Phrases({k: k for k in BODIES}, lambda p: 2 if len(p) > 10 else 1)


class Programme(NamedTuple):
    """name: the words of the founder's name or, where kind is empty, of the title; kind of award; level of study."""

    name: tuple[str, ...]
    kind: str
    level: str


def programme(name: str | None) -> Programme:
    """Founder or title, kind of award and level of study of a programme's typed name; the session in it is dropped."""
    t = words(_SESSION.sub(" ", name or ""))
    level = ""
    hit = _LEVEL.find(t) or _SHORT_LEVEL.find(t)
    if hit:
        level, a, b = hit
        digits = [x for x in t[a:b] if x.isdigit()]
        if level.startswith("school") and digits:
            level = "school 9 10" if digits[0] == "9" or "10" in digits else "school 11 12"
        if a and t[a - 1] in ("for", "fro", "fr", "or"):
            a -= 1
        t = t[:a] + t[b:]
    kind, hit = "", _KIND.find(t)
    if hit:
        kind, a, b = hit
        t = t[:a] + t[b:]
    t = [w for w in t if w not in TITLES]
    if kind and len(t) > 2 and t[:3] == ["in", "memory", "of"]:
        t = t[3:]
    t = [w for w in t if w not in ("in", "memory", "of", "for")] if kind else t
    return Programme(tuple(t), kind, level)


class Provider(NamedTuple):
    """name: the words of the organisation's own name; body: its kind; letters: what stands for it if it is an acronym."""

    name: tuple[str, ...]
    body: str
    letters: str


def provider(text: str | None) -> Provider | None:
    """The parts of an organisation's typed name; None where there is none.

    A place added to it is dropped by its position: in brackets, behind a comma that follows the body, or right behind a
    body that two words or more precede. All words of the name are kept.
    """
    raw = re.sub(r"\([^)]*\)", " ", text or "").strip()
    if not raw:
        return None
    head = re.sub(r"[^A-Za-z]", "", raw.split(",")[0])
    if head.isupper() and len(head) > 1 and " " not in raw.split(",")[0].strip():
        return Provider((), "", head.lower())
    parts = [words(x) for x in raw.split(",")]
    t, at = [w for x in parts for w in x], [i for i, x in enumerate(parts) for _ in x]
    hit = _BODY.find(t)
    if not hit:
        parts = [y for x in parts if (y := _plain(x))]
        kept = parts[:-1] if len(parts) > 1 and len(parts[-2]) > 1 else parts  # "Rimo, Tasa Fund" is a name turned round
        return Provider(tuple(w for x in kept for w in x), "", "")
    body, a, b = hit
    before, same = _plain(t[:a]), [w for w, i in zip(t[b:], at[b:]) if i == at[b - 1]]
    later = [y for i in range(at[b - 1] + 1, len(parts)) if (y := _plain(parts[i]))]
    if before:  # what stands behind the body is a place, unless it goes on with the name
        goes_on = len(before) == 1 or same[:1] in (["of"], ["for"], ["and"])
        name = before + (_plain(same) if goes_on else [])
    elif _plain(same):
        name = _plain(same)
    else:
        name = [w for x in (later if [len(x) for x in later] == [1, 1] else later[:1]) for w in x]
    return Provider(tuple(name), body, "")


def _plain(tokens: list[str]) -> list[str]:
    return [w for w in tokens if w not in TITLES and w != "of"]


def sounded(name: tuple[str, ...]) -> tuple[str, ...]:
    """A name's words as they sound."""
    return tuple(map(spoken, name))


def alike(a: tuple[str, ...], b: tuple[str, ...], radius: int) -> int:
    """Edit distance of two names as they are spelled or as they sound, whichever is less, or radius + 1 if it is greater.

    Of two-word names it is the sum over their words in the better order, which is a metric on names without order; a
    word of one letter stands for any that begins with it. Names of more words are compared word by word as they stand and
    with their words in order, a word of SMALL letters or fewer within one edit; names of unequal numbers of words are
    compared run together.
    """
    best = _apart(a, b, radius)
    x, y = sounded(a), sounded(b)
    return best if not best or (x, y) == (a, b) else min(best, _apart(x, y, radius))


def _apart(a: tuple[str, ...], b: tuple[str, ...], radius: int) -> int:
    best = radius + 1
    if len(a) == len(b) == 2:
        for x in (a, a[::-1]):
            d = 0
            for u, v in zip(x, b):
                if d < best:
                    d += (u[0] != v[0]) * (radius + 1) if 1 in (len(u), len(v)) else distance(u, v, best - 1 - d)
            best = min(best, d)
        return best
    if len(a) == len(b) > 2:
        for x, y in ((a, b), (tuple(sorted(a)), tuple(sorted(b)))):
            apart = [distance(u, v, radius) for u, v in zip(x, y)]
            if all(d < 2 or min(len(u), len(v)) > SMALL for d, u, v in zip(apart, x, y)):
                best = min(best, sum(apart))
        return best
    other = lambda n: n[::-1] if len(n) == 2 else tuple(sorted(n))
    for x in {a, other(a)}:
        for y in {b, other(b)}:
            best = min(best, distance("".join(x), "".join(y), radius))
    return best


def initials(p: Provider) -> str:
    """The letters that an acronym of the organisation would have."""
    return "".join(w[0] for w in (*p.name, *p.body.split()) if w and w != "of")


def same_provider(a: Provider, b: Provider, radius: int = 2) -> bool:
    """Whether two typed names can be those of one organisation."""
    if a.letters or b.letters:
        if a.letters and b.letters:
            return a.letters == b.letters
        full, letters = (b, a.letters) if a.letters else (a, b.letters)
        if not full.body:
            return False
        tail = "".join(w[0] for w in full.body.split() if w != "of")
        head = letters[: -len(tail)]
        return letters.endswith(tail) and (sorted(head) == sorted(w[0] for w in full.name) if len(full.name) > 1 else head[:1] == full.name[0][:1] if full.name else False)
    if a.body and b.body:
        return a.body == b.body and _same_words(a.name, b.name, radius)
    bare, full = (b, a) if a.body else (a, b)  # a body typed too badly to be told stands behind the name's words
    n = len(full.name)
    return _same_words(a.name, b.name, radius) or bool(full.body) and len(bare.name) > n and _same_words(bare.name[:n], full.name, radius) and distance(spoken("".join(bare.name[n:])), spoken(full.body.replace(" ", "")), 4) <= 4


def _same_words(a: tuple[str, ...], b: tuple[str, ...], radius: int) -> bool:
    """Whether two own names are alike; in longer ones too a word of one letter stands for any that begins with it."""
    if alike(a, b, radius) <= radius:
        return True
    if len(a) != len(b) or len(a) < 3:
        return False
    for x, y in ((a, b), (sounded(a), sounded(b))):
        apart = [(u[0] != v[0]) * (radius + 1) if 1 in (len(u), len(v)) else distance(u, v, radius) for u, v in zip(x, y)]
        if sum(apart) <= radius and all(d < 2 or min(len(u), len(v)) > SMALL for d, u, v in zip(apart, x, y)):
            return True
    return False
