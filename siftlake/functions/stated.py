"""What a text states, as column expressions: dates, ages, periods, numbers, groups, windows, topics, scores.

All are built from tables of patterns and stay inside code generation. A null text is an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions import lexicon as L

_MONTH = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: Notations of dates in order of precedence, with the groups that hold year, month and day.
NOTATIONS = (
    (r"\b(20\d\d)-(\d\d)-(\d\d)\b", (1, 2, 3)),
    (rf"\b(\d{{1,2}})\s*(?:st|nd|rd|th)?[\s,.\-]*(?:of\s+)?{_MONTH}\b\.?[\s,.\-]*(\d{{4}})\b", (3, 2, 1)),
    (rf"\b{_MONTH}\b\.?\s+(\d{{1,2}})\s*(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", (3, 1, 2)),
    (r"\b(\d{1,2})\s*[/.\-]\s*(\d{1,2})\s*[/.\-]\s*(\d{4})\b", (3, 2, 1)),
)
PERIODS = (
    ("per_year", r"per\s*(?:annum|year)|p\.?\s?a\.?\b|annual(?:ly)?|yearly|each year|every year"), ("per_month", r"per\s*month|monthly|p\.?\s?m\.?\b|every month"), ("one_time", r"one[- ]time|lump\s*sum|once only|one off"),
    ("full_course", r"full (?:tuition|course|fee)|entire (?:course|duration)|duration of the (?:course|programme|program)|fully funded|complete fee"),
)
NUMBER, UNIT = r"(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)", r"(lakhs?|lacs?|crores?|cr\b|thousand|k\b|million|mn\b)"
AGE_RANGE, AGE_SPAN = r"(?i)(?:between|from|aged?)\s*(?:the\s*age\s*of\s*)?(\d{1,2})\s*(?:and|to|-|–)\s*(\d{1,2})\s*years?", r"(?i)\b(\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})\s*years?\b"
AGE_MOST = r"(?i)(?:not\s*(?:exceed(?:ing)?|more\s*than|above|older\s*than)|below|under|less\s*than|up\s*to|upto|maximum(?:\s*age)?(?:\s*(?:limit|of))?|upper\s*age\s*limit(?:\s*of)?|age\s*limit(?:\s*of)?|within|not\s*be\s*(?:more|above|older)\s*than)\s*(\d{1,2})\s*years?"
AGE_LEAST = r"(?i)(?:at\s*least|minimum(?:\s*age)?(?:\s*of)?|not\s*(?:less|below|younger)\s*than|above|over|more\s*than|attained(?:\s*the\s*age\s*of)?)\s*(\d{1,2})\s*years?"


def said(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def speaks_of(text: Column, pattern: str, cased: bool = False) -> Column:
    """Whether a text matches a pattern of the lexicon."""
    return said(text).rlike(pattern if cased else f"(?i){pattern}")


def _groups(text: Column, pattern: str, *groups: int) -> Column:
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), g).alias(f"g{i}") for i, g in enumerate(groups)])


def _month(m: Column) -> Column:
    """A month's number of two digits, of its name or number."""
    named = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(m, 1, 3))) + 2) / 3
    return F.lpad(F.when(m.rlike("^[0-9]"), m).otherwise(named.cast("int").cast("string")), 2, "0")


def dates(text: Column) -> Column:
    """The days that a text writes, in four notations, ISO first: an array without order. Places read once are not read again; days that are none or lie outside 2000 to 2100 are left out."""
    rest, found = said(text), []
    for pattern, at in NOTATIONS:
        rx = f"(?i){pattern}"
        day = F.transform(_groups(rest, rx, *at), lambda x: F.try_to_date(F.concat(x["g0"], F.lit("-"), _month(x["g1"]), F.lit("-"), F.lpad(x["g2"], 2, "0")), "yyyy-MM-dd"))
        found.append(F.filter(day, lambda d: d.isNotNull() & F.year(d).between(2000, 2100)))
        rest = F.regexp_replace(rest, rx, " # ")
    return F.concat(*found)


def closing_strength(sentence: Column) -> Column:
    """How surely a sentence states the day on which applications close: 0 not, 1 some deadline, 2 of applications, 3 in so many words."""
    is_ = lambda p: speaks_of(sentence, p)
    return F.when(is_(L.NOT_CLOSING), 0).when(is_(L.EXPLICIT_CLOSING), 3).when(is_(L.CLOSING), F.when(is_(L.APPLYING), 2).otherwise(1)).when(is_(L.APPLYING) & is_(L.UNTIL), 2).otherwise(0)


def period(text: Column) -> Column:
    """The first period of the table that a text names; null where it names none."""
    return F.coalesce(*[F.when(speaks_of(text, p), F.lit(k)) for k, p in PERIODS])


def ages(text: Column) -> Column:
    """age_min and age_max that a text states: a range first, else an upper and a lower bound; ages from 3 to 80 count."""
    at = lambda rx, g: F.regexp_extract(said(text), rx, g).try_cast("int")
    fits = lambda a: F.when(a.between(3, 80), a)
    pairs = [F.when((at(rx, 1) >= 3) & (at(rx, 1) <= at(rx, 2)) & (at(rx, 2) <= 80), F.struct(at(rx, 1).alias("age_min"), at(rx, 2).alias("age_max"))) for rx in (AGE_RANGE, AGE_SPAN)]
    spanned = F.when(said(text).rlike(AGE_RANGE), pairs[0]).otherwise(pairs[1])
    return F.coalesce(spanned, F.struct(fits(at(AGE_LEAST, 1)).alias("age_min"), fits(at(AGE_MOST, 1)).alias("age_max")))


def numbers(text: Column) -> Column:
    """Every number that a text writes, as it stands and with its lakh, crore, thousand or million."""
    found = _groups(said(text), rf"(?i){NUMBER}\s*{UNIT}?", 1, 2)
    unit = lambda u: F.when(u.rlike("(?i)^la"), 1e5).when(u.rlike("(?i)^cr"), 1e7).when(u.rlike("(?i)^(thousand|k)$"), 1e3).when(u.rlike("(?i)^m"), 1e6)
    value = lambda n: F.regexp_replace(n, ",", "").cast("double")
    return F.array_distinct(F.flatten(F.transform(found, lambda x: F.filter(F.array(value(x["g0"]), value(x["g0"]) * unit(x["g1"])), lambda v: v.isNotNull()))))


def cycle_status(text: Column, academic_year: Column) -> Column:
    """current, stale or unknown: whether the newest session that a text names is that of the academic year or later."""
    spans = _groups(said(text), r"\b(20\d\d)\s*[-–/]\s*(?:20)?(\d\d)\b", 1, 2)
    years = F.transform(F.filter(spans, lambda x: F.pmod(x["g0"].cast("int") + 1, F.lit(100)) == x["g1"].cast("int")), lambda x: x["g0"].cast("int"))
    named = F.transform(F.regexp_extract_all(said(text), F.lit(r"(?i)(?:academic (?:year|session)|session|batch|for the year|intake|ay)\s*:?\s*(20\d\d)"), 1), lambda x: x.cast("int"))
    newest = F.coalesce(F.array_max(years), F.array_max(named))
    return F.when(newest.isNull(), "unknown").when(newest >= academic_year, "current").otherwise("stale")


def members(text: Column, table: dict[str, tuple[str, bool]]) -> Column:
    """The entries of a table of patterns that a text speaks of, in the table's order."""
    return F.filter(F.array(*[F.when(speaks_of(text, p, cased), F.lit(k)) for k, (p, cased) in table.items()]), lambda x: x.isNotNull())


def supported(proposed: Column, quote: Column, table: dict[str, tuple[str, bool]]) -> Column:
    """The proposed values that a quote supports, in the order proposed."""
    return F.filter(proposed, lambda v: F.array_contains(members(quote, table), v))


def open_window(text: Column) -> Column:
    """rolling, open or null: the kind of open window for applications that a text states; one that is closed states none."""
    return F.when(speaks_of(text, L.CLOSED_NOW), None).when(speaks_of(text, L.ROLLING), "rolling").when(speaks_of(text, L.OPEN_NOW), "open")


def off_topic(field: str, quote: Column) -> Column:
    """Why a quote cannot be filed under a field: narrative or another topic; null if it can."""
    if field not in L.TOPICS:
        return F.lit(None).cast("string")
    return F.when(speaks_of(quote, L.FIRST_PERSON, True), "narrative").when(~speaks_of(quote, L.TOPICS[field]), "other topic")


def _weights(text: Column, table: tuple[tuple[str, float], ...]) -> list[Column]:
    return [F.when(speaks_of(text, p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in table]


def link_score(anchor: Column, url: Column, context: Column) -> Column:
    """How likely a link leads to a programme, from 0 to 1: weights of its anchor and address; the text around counts for six tenths where these say little; rejected kinds count against it."""
    total = lambda cols: reduce(lambda a, b: a + b, cols)
    own = total(_weights(anchor, L.ANCHOR_WEIGHTS)) + total(_weights(url, L.ADDRESS_WEIGHTS))
    near = F.substring(F.lower(said(context)), 1, 300)
    around = F.coalesce(*[F.when(near.rlike(p), F.lit(w * 0.6)) for p, w in L.ANCHOR_WEIGHTS[:5]], F.lit(0.0))
    against = total([F.when(speaks_of(anchor, p) | speaks_of(url, p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in L.REJECTED_LINKS])
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), own + F.when(own < 0.45, around).otherwise(0.0) + against)), 4)


def page_kind(head: Column, text: Column) -> Column:
    """How likely a page describes one programme, from 0 to 1, by its head and by how often the cues of four kinds stand in its text."""
    cues = [F.least(F.lit(most), F.regexp_count(F.lower(said(text)), F.lit(p)) * weight) for p, weight, most in L.PAGE_CUES.values()]
    score = F.when(F.lower(said(head)).rlike(L.PAGE_CUES["programme"][0]), 0.30).otherwise(0.0) + reduce(lambda a, b: a + b, cues)
    return F.round(F.least(F.lit(1.0), score * F.when(F.length(said(text)) < 300, 0.4).otherwise(1.0)), 3)


def publisher(host: Column) -> Column:
    """source_type, tier and authority of a host by the first rule that fits its end; unknown hosts are T4."""
    rows = [F.when(host.endswith(end), F.struct(F.lit(kind).alias("source_type"), F.lit(tier).alias("tier"), F.lit(L.AUTHORITY[tier]).alias("authority"))) for end, kind, tier in L.HOST_RULES]
    return F.coalesce(*rows, F.struct(F.lit("UNKNOWN").alias("source_type"), F.lit("T4").alias("tier"), F.lit(L.AUTHORITY["T4"]).alias("authority")))


def within(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or below one."""
    return reduce(lambda a, b: a | b, [(host == d) | host.endswith(f".{d}") for d in domains], F.lit(False))
