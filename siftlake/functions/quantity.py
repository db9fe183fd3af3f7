"""Reading of money amounts typed as free text: value range, scale, currency, period, bound kind.

Pure Python on one text; the operators call it in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal
from typing import NamedTuple

# Spellings of the units.
CURRENCIES = {
    "INR": r"inr\b|rs\b\.?|rupees?\b|₹|रुपये|रुपए",
    "USD": r"usd\b|us\s?\$",
    "AUD": r"aud\b|au\s?\$|a\$",
    "CAD": r"cad\b|ca\s?\$|c\$",
    "GBP": r"gbp\b|£|pounds?\b",
    "EUR": r"eur\b|euros?\b|€",
    "CHF": r"chf\b|sfr\b\.?",
}
SCALES = {
    1_000: r"thousands?\b|k\b|(?<!\d)'000\b|हज़ार|हजार",
    100_000: r"lakhs?\b|lacs?\b|l\b|लाख",
    1_000_000: r"millions?\b|mn\b",
    10_000_000: r"crores?\b|cr\b|करोड़",
}
PERIODS = {
    "full_course": r"(?:whole|full|entire)\s+(?:duration\s+of\s+the\s+)?course|over\s+the\s+(?:full\s+)?course|full[ _]course",
    "once": r"one[- _]?time|once\b|one[- ]off|lump\s?sum|single\s+payment",
    "per_quarter": r"quarterly\b|quarter\b|three\s+months\b|त्रैमासिक",
    "per_semester": r"semesters?\b|sem\b|six\s+months\b|half[- ]yearly\b|अर्धवार्षिक|छमाही",
    "per_month": r"monthly\b|months?\b|p\.\s?m\b|प्रति माह|मासिक",
    "per_year": r"yearly\b|annual(?:ly)?\b|annum\b|p\.\s?a\b|per[ _]year\b|/\s?yr\b|/\s?year\b|(?:a|each|every|academic)\s+year\b|lpa\b|वार्षिक|प्रति वर्ष|सालाना",
}
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
MULTIPLES = {"hundred": 100, "thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "crore": 10_000_000, "million": 1_000_000}

_WORD_VALUE = {w: i for i, w in enumerate(ONES)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
_SPELLED = re.compile(rf"\b(?:{'|'.join(_WORD_VALUE)})(?:[\s-]+(?:and\s+)?(?:{'|'.join([*_WORD_VALUE, *MULTIPLES])}))*\b")
_NUMBER = re.compile(r"\d+(?:[.,'’]\d+)*")
_BOUND = re.compile(r"\bup\s?to\b|\bmax(?:imum)?\b|\bceiling\b|\bat most\b|<=?|≤|\bnot (?:exceed(?:ing)?|more than)\b|\bless than\b|\bbelow\b|\bunder\b|तक")
#: Figures that are no amount: sessions, counts of awards, classes, spans of years, ages.
_ASIDE = re.compile(
    r"\bsession\s+\d{4}(?:\s?[-/–]\s?\d{2,4})?\s*:?|\b\d{4}\s?[-/–]\s?\d{2}\b(?!\d)|\b[\d,]+\s+(?:awards?|seats?|scholarships?|students?)\b"
    r"|\bclass(?:es)?\s+\d+|\bfor\s+(?:up\s+to\s+)?(?:\w+)\s+(?:years?|months|semesters)\b|\bwithin\s+\d+\s+\w+"
)
_CURRENCY = re.compile("|".join(f"(?P<{k}>(?<![a-z])(?:{v}))" for k, v in CURRENCIES.items()) + r"|(?P<DOLLAR>\$)")
_PERIOD = {k: re.compile(v) for k, v in PERIODS.items()}
_SCALE_AFTER = re.compile(r"[\s-]*(?:\(?\s*(?:rs\.?|₹|inr|rupees)?\s*(?:in\s+)?)?(?:" + "|".join(f"(?P<s{i}>{v})" for i, v in enumerate(SCALES.values())) + r"|(?P<lpa>lpa\b))")
_SCALE_BEFORE = re.compile("|".join(f"(?P<s{i}>(?<![a-z])(?:{v}))" for i, v in enumerate(SCALES.values())))
_FACTORS = list(SCALES)


class Quantity(NamedTuple):
    """What a text states; currency and period are None where it is silent. figures: how many it gives; more than two are neither an amount nor a range."""

    low: Decimal
    high: Decimal
    is_bound: bool
    is_range: bool
    currency: str | None
    period: str | None
    figures: int = 1


def number(token: str) -> Decimal:
    """The value of 1,50,000 or 26.800,00 or 1'600 or 4.5: the last mark is decimal unless it groups three digits."""
    token = token.replace("'", "").replace("’", "")
    comma, dot = token.rfind(","), token.rfind(".")
    if comma >= 0 and dot >= 0:
        thousands, point = (",", ".") if dot > comma else (".", ",")
        return Decimal(token.replace(thousands, "").replace(point, ".", 1))
    mark = "," if comma >= 0 else "." if dot >= 0 else ""
    if not mark:
        return Decimal(token)
    whole, _, tail = token.rpartition(mark)
    groups = token.split(mark)
    if mark == ",":
        return Decimal(token.replace(",", "") if len(tail) == 3 else whole.replace(",", "") + "." + tail)
    grouped = len(groups) > 2 or (len(tail) == 3 and groups[0] != "0" and len(groups[0]) <= 3)
    return Decimal(token.replace(".", "") if grouped and all(len(g) == 3 for g in groups[1:]) or len(groups) > 2 else token)


def _spelled(m: re.Match) -> str:
    total = part = 0
    for w in re.split(r"[\s-]+", m[0]):
        if w in _WORD_VALUE:
            part += _WORD_VALUE[w]
        elif w == "hundred":
            part = max(part, 1) * 100
        elif w in MULTIPLES:
            total, part = total + max(part, 1) * MULTIPLES[w], 0
    return str(total + part)


def fold(text: str) -> str:
    """Lower case, compatibility forms, any script's digits as ASCII, single spaces."""
    text = unicodedata.normalize("NFKC", text)
    text = "".join(str(unicodedata.digit(c)) if c.isdigit() and not c.isascii() else c for c in text)
    return re.sub(r"\s+", " ", text.casefold()).strip()


def period_of(text: str | None) -> str | None:
    """The period that a text or a column's label names."""
    text = fold(text or "")
    return next((k for k, rx in _PERIOD.items() if rx.search(text)), None)


def currency_of(text: str | None) -> str | None:
    """The first currency that a text or a column's label names; a bare $ is USD."""
    m = _CURRENCY.search(fold(text or ""))
    return None if not m else "USD" if m.lastgroup == "DOLLAR" else m.lastgroup


def read(text: str | None) -> Quantity | None:
    """The quantity that a text states, in its own units; None where it states no figure."""
    if not text or not text.strip():
        return None
    body = _ASIDE.sub(" ", fold(text))
    period, currency = period_of(body), currency_of(body)
    for unit in ("once", "per_quarter", "per_semester"):  # their number words are no figures
        body = _PERIOD[unit].sub(" ", body)
    body = _SPELLED.sub(_spelled, body)
    found: list[tuple[Decimal, int | None]] = []
    for m in _NUMBER.finditer(body):
        after = _SCALE_AFTER.match(body, m.end())
        scale = 100_000 if after and after["lpa"] else next((_FACTORS[int(k[1])] for k, v in after.groupdict().items() if v), None) if after else None
        if m.start() and body[m.start() - 1] == "'":
            continue
        found.append((number(m[0]), scale))
    if not found:
        return None
    if all(s is None for _, s in found) and (m := _SCALE_BEFORE.search(body)):
        before = next(_FACTORS[int(k[1])] for k, v in m.groupdict().items() if v)
        found = [(v, before) for v, _ in found]
    is_range = len(found) > 1
    (a, sa), (b, sb) = found[0], found[1] if is_range else found[0]
    if is_range and sa is None and sb is not None and a < 1000:
        sa = sb
    low, high = a * (sa or 1), b * (sb or 1)
    if is_range and high < low:
        is_range, high = False, low
    return Quantity(low, high, not is_range and bool(_BOUND.search(body)), is_range, currency, period, len(found))
