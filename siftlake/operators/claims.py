"""Claims read from pages by rules, their grounding in page texts, and the merging of several readers' claims."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions import lexicon as L
from siftlake.functions import spans as S
from siftlake.functions.quantity import read
from siftlake.functions.stated import AGE_LEAST, AGE_MOST, AGE_RANGE, AGE_SPAN, NUMBER, UNIT

CLAIM = "page_id bigint, field string, value string, quote string, start int, stop int"
#: Letters of a quote, and the share of a set that two readers must have in common to agree in part.
QUOTE, JACCARD = (4, 2500), 0.4

# Words that mark an award, limits of income, and organisations.
AWARD = r"scholarship|fellowship|scheme|stipend|bursary|programme|program|award|grant|yojana|endowment|loan"
BENEFIT = r"scholarship|stipend|fellowship|award|grant|bursary|tuition|college fee|fee waiver|financial assistance|benefit|will be (?:paid|provided|given)|per (?:annum|month|year)|p\.a\."
INCOME, LIMIT = r"income|earning|salary", r"not exceed|below|less than|up ?to|ceiling|limit|under|within|maximum|more than"
ORGANISATION = r"(?:(?-i:[A-Z])[\w.&'-]+ ){1,6}(?:University|Trust|Foundation|Board|Council|Society|Institute[\w ]*|Commission|Ministry[\w ]*|Department[\w ]*|Fund|League|Directorate[\w ]*)"


def _said(rx: str) -> Callable[[str], bool]:
    return lambda s: bool(S.pattern(rx).search(s))


def _ages(s: str) -> str | None:
    for rx in (AGE_RANGE, AGE_SPAN):
        if (m := re.search(rx, s)) and 3 <= int(m[1]) <= int(m[2]) <= 80:
            return f"{int(m[1])}-{int(m[2])}"
    ends = [m[1] if (m := re.search(rx, s)) and 3 <= int(m[1]) <= 80 else "" for rx in (AGE_LEAST, AGE_MOST)]
    return "-".join(ends) if any(ends) else None


def _members(table: dict[str, tuple[str, bool]], s: str) -> list[str]:
    return [k for k, (p, cased) in table.items() if re.search(p, s, 0 if cased else re.I)]


def _money(s: str) -> str | None:
    q = read(s)
    return None if q is None or q.currency is None else f"{q.currency} {int(q.low)}-{int(q.high)}"


def _gender(s: str) -> str | None:
    got = _members(L.GENDERS, s)
    return "ANY" if "ANY" in got else got[0] if len(got) == 1 and re.search(r"\bonly\b|\bfor (?:girls|women)", s, re.I) else None


#: Fields told from one sentence: what it must speak of, and the value it gives; the best-scored sentence wins, of equal ones the first.
RULES: dict[str, tuple[Callable[[str], bool], Callable[[str], str | None], Callable[[str], int]]] = {
    "amount": (_said(BENEFIT), lambda s: None if _said(INCOME)(s) else _money(s), lambda s: len(S.pattern(BENEFIT).findall(s)) + 2 * _said(r"per (?:annum|month|year)|receive|paid")(s)),
    "income": (_said(INCOME), lambda s: _money(s) if _said(LIMIT)(s) else None, lambda s: 0),
    "age": (_said(r"\bage|aged|years"), _ages, lambda s: 0),
    "gender": (_said("|".join(p for p, _ in L.GENDERS.values())), _gender, lambda s: _gender(s) == "ANY"),
    "categories": (lambda s: True, lambda s: ",".join(_members(L.CATEGORIES, s)) or None, lambda s: min(4, len(_members(L.CATEGORIES, s)))),
    "education_levels": (lambda s: not _said(L.TOPICS["documents_required"])(s), lambda s: ",".join(_members(L.LEVELS, s)) or None, lambda s: min(4, len(_members(L.LEVELS, s)))),
    "domicile": (_said(r"resident|domicile|citizen|native of|living in"), lambda s: s if 15 <= len(s) <= 400 else None, lambda s: 0),
    "academic_requirements": (_said(r"marks|percent|per cent|cgpa|percentile|%"), lambda s: s if 15 <= len(s) <= 400 else None, lambda s: 0),
    "institution_requirements": (_said(r"recogni[sz]ed|affiliated|accredited|approved (?:college|institution)"), lambda s: s if 15 <= len(s) <= 400 else None, lambda s: 0),
    "deadline_note": (_said(f"{L.ROLLING}|{L.OPEN_NOW}"), lambda s: s if len(s) < 400 and not _said(L.CLOSED_NOW)(s) else None, lambda s: _said(L.ROLLING)(s)),
}


def page_claims(title: str | None, text: str) -> Iterator[tuple[str, str, int, int]]:
    """field, value, start, end of what a page states; the quote is the text between, so every claim is grounded as it is made."""
    part = re.split(r"\s+[|•»«]\s+|\s+[-–—]\s+(?=[A-Z])", " ".join((title or "").split()))
    for name in [p for p in part if _said(AWARD)(p)] + [x.strip() for x in text.split("\n")[:30] if _said(AWARD)(x) and 8 <= len(x.strip()) <= 130 and not x.strip().endswith(".")]:
        if len(name) > 3 and (at := text.find(name)) >= 0:
            yield "name", name, at, at + len(name)
            break
    for m in S.pattern(ORGANISATION).finditer(text, 0, 4000):
        if 6 <= len(m[0].strip()) <= 90 and not _said(r"\b(?:scholarship|scheme|fellowship)\b")(m[0]):
            yield "provider", m[0].strip(), m.start(), m.start() + len(m[0].strip())
            break
    scoped = S.sections(text)
    lines = list(S.sentences(text))
    best: dict[str, tuple[int, str, int, int]] = {}
    for a, b in lines:
        s = text[a:b]
        for field, (topic, value, score) in RULES.items():
            if topic(s) and (v := value(s)) is not None and ((k := int(score(s))) > best.get(field, (-1,))[0]):
                best[field] = (k, v, a, b)
    for field, (_, v, a, b) in best.items():
        yield field, v, a, b
    closing: list[tuple[int, str, int, int]] = []
    for a, b in lines:
        s = text[a:b]
        found = S.days(s)
        later = "extended" in s.lower()
        power = S.strength(s) if found else 0
        wanted = [d for d in found if d.kind == "closing"] or (found[-1:] if power == 3 else [])
        if power and wanted:
            closing.append((power, (max if later else min)(d.day for d in wanted).isoformat(), a, b))
        if (first := [d for d in found if d.kind == "opening"]) and "opening_date" not in best:
            best["opening_date"] = (0, "", 0, 0)
            yield "opening_date", first[0].day.isoformat(), a, b
    if closing:
        _, v, a, b = max(closing, key=lambda c: (c[0], -c[2]))
        yield "closing_date", v, a, b
    for field, span in scoped.items():
        yield field, " ".join(text[span.start : span.end].split()), span.start, span.end


def rule_claims(pages: DataFrame) -> DataFrame:
    """page_id, field, value, quote, start, stop: what each page states, read by rules in one pass over whole texts without a shuffle.

    stop is excluded. Null and empty texts state nothing; a page states each field once at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, f, v, te[a:b], a, b) for p, ti, te in zip(pdf["page_id"], pdf["title"], pdf["text"]) for f, v, a, b in page_claims(ti, te)]
            yield pd.DataFrame(rows, columns=["page_id", "field", "value", "quote", "start", "stop"])

    return pages.where("text is not null and text <> ''").select("page_id", "title", "text").mapInPandas(run, CLAIM)


def page_verdicts(claims: DataFrame, kinds: DataFrame) -> DataFrame:
    """page_id, kind, fields, is_programme: a page is a programme's if its kind scores 0.25, it states three fields besides its name, and it has a name."""
    g = claims.groupBy("page_id").agg(F.sum(F.when(~F.col("field").isin("name", "provider"), 1).otherwise(0)).alias("fields"), F.max((F.col("field") == "name").cast("int")).alias("named"))
    j = kinds.join(g, "page_id", "left")
    return j.select("page_id", "kind", F.coalesce("fields", F.lit(0)).cast("bigint").alias("fields"), ((F.col("kind") >= 0.25) & (F.coalesce("fields", F.lit(0)) >= 3) & (F.coalesce("named", F.lit(0)) == 1)).alias("is_programme"))


def numbers_in(text: str) -> set[float]:
    """Every number of a text, as it stands and with its unit."""
    out = set()
    for m in S.pattern(rf"{NUMBER}\s*{UNIT}?").finditer(text):
        n = float(m[1].replace(",", ""))
        u = (m[2] or "").lower()
        out |= {n, n * (1e5 if u[:2] == "la" else 1e7 if u[:2] == "cr" else 1e3 if u in ("k", "thousand") else 1e6 if u[:1] == "m" else 1)}
    return out


def close(a: float, b: float) -> bool:
    """Whether two figures are the same but for rounding."""
    return abs(a - b) <= max(1e-6, 1e-3 * max(abs(a), abs(b)))


def derivable(field: str, value: str, quote: str) -> tuple[str | None, str]:
    """The value, narrowed to what its quote supports, or None with the reason for which it is rejected."""
    said = lambda rx: bool(S.pattern(rx).search(quote))
    figures = [float(x) for x in re.findall(r"\d+(?:\.\d+)?", value)]
    if field in ("name", "provider"):
        a, b = S.Folded(value).plain.strip(), S.Folded(quote)
        return (value, "") if a and (a in b.plain or b.find(value)) else (None, "value not contained in quote")
    if field == "deadline_note":
        return (quote.strip(), "") if said(f"{L.ROLLING}|{L.OPEN_NOW}") and not said(L.CLOSED_NOW) else (None, "quote states no open window")
    if field in L.TOPICS:
        if re.search(L.FIRST_PERSON, quote):
            return None, "narrative"
        return (quote.strip(), "") if said(L.TOPICS[field]) else (None, "other topic")
    if field in ("opening_date", "closing_date"):
        if value not in {d.day.isoformat() for d in S.days(quote)}:
            return None, "date not written in quote"
        if said(L.NOT_CLOSING):
            return None, "quote is about a different date"
        return (None, "quote states no closing date") if field == "closing_date" and not S.strength(quote) and not said(r"\b(?:until|till|by|before|due|deadline|close[sd]?|last date|ends?)\b") else (value, "")
    if field in ("amount", "income"):
        if field == "amount" and not said(BENEFIT):
            return None, "quote does not connect the amount to a student benefit"
        if field == "income" and not said(INCOME):
            return None, "quote does not discuss income"
        there = numbers_in(quote) | ({float(q.low), float(q.high)} if (q := read(quote)) else set())
        return (value, "") if figures and all(any(close(f, n) for n in there) for f in figures) else (None, "figures not present in quote")
    if field == "age":
        if not said(r"\bage|aged|years"):
            return None, "quote does not discuss age"
        return (value, "") if figures and set(figures) <= numbers_in(quote) else (None, "figures not present in quote")
    if field in ("categories", "education_levels", "gender"):
        table = {"categories": L.CATEGORIES, "education_levels": L.LEVELS, "gender": L.GENDERS}[field]
        got = [v for v in value.split(",") if v in _members(table, quote)]
        return (",".join(got), "") if got else (None, "wording not present in quote")
    return value, ""


def grounded(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Every claim (claim_id, page_id, field, value, quote) with accepted, value, reason, start, stop, score.

    The quote is located in the page, letters folded, or from 25 letters on at the likest place; the value must be
    derivable from the page's own words there, or else from the quote. Claims are collected by page, so a page's text is
    folded once; claims on unknown or empty pages are rejected. Null quotes and values are rejected too.
    """
    by_page = claims.groupBy("page_id").agg(F.collect_list(F.struct("claim_id", "field", "value", "quote")).alias("c"))
    rows = by_page.join(pages.select("page_id", "text"), "page_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, some, text in zip(pdf["page_id"], pdf["c"], pdf["text"]):
                there = S.Folded(text) if isinstance(text, str) and text else None
                for c in some:
                    quote, value = c["quote"] or "", c["value"]
                    span = there.find(quote) if there and QUOTE[0] <= len(quote) <= QUOTE[1] else None
                    if span is None or value is None:
                        out.append((c["claim_id"], page, c["field"], False, None, "quote not found on page" if span is None else "no value", None, None, None))
                        continue
                    got, why = derivable(c["field"], value, text[span.start : span.end])
                    if got is None:
                        again, _ = derivable(c["field"], value, quote)
                        got = again
                    out.append((c["claim_id"], page, c["field"], got is not None, got, "" if got is not None else why, span.start, span.end, span.score))
            yield pd.DataFrame(out, columns=["claim_id", "page_id", "field", "accepted", "value", "reason", "start", "stop", "score"]).astype({"start": "Int32", "stop": "Int32"})

    return rows.mapInPandas(run, "claim_id bigint, page_id bigint, field string, accepted boolean, value string, reason string, start int, stop int, score double")


def agreement(field: str, a: str, b: str) -> float:
    """How far two values of a field agree: 1, 0.5 for sets that share JACCARD of their members, or 0."""
    if a == b:
        return 1.0
    if field in ("categories", "education_levels"):
        x, y = set(a.split(",")), set(b.split(","))
        return 1.0 if x == y else 0.5 * (len(x & y) / len(x | y) >= JACCARD)
    if field in ("amount", "income"):
        x, y = (re.findall(r"[A-Z]{3}|\d+(?:\.\d+)?", v) for v in (a, b))
        return float(bool(x) and bool(y) and x[:1] == y[:1] and close(float(x[-1]), float(y[-1]))) if x and y and x[-1][0].isdigit() and y[-1][0].isdigit() else 0.0
    if field in ("name", "provider"):
        if S.token_set_similarity(a, b) >= (88 if field == "name" else 80):
            return 1.0
        short, full = sorted((re.sub(r"[^a-z]", "", a.lower()), re.sub(r"[^a-z]", "", b.lower())), key=len)
        return float(len(short) >= 3 and short in ("".join(w[0] for w in re.findall(r"[a-z]+", v.lower()) if w not in ("of", "the", "for", "and")) for v in (a, b)))
    if field in L.TOPICS or field == "deadline_note":
        return float(S.Folded(a).plain[:80] == S.Folded(b).plain[:80] or S.similarity(a, b) >= 90)
    return 0.0


def merged(opinions: DataFrame) -> DataFrame:
    """key, field, value, agreement, opinions, conflicts: one value of each field from several readers' opinions.

    opinions: key, field, reader (a rank; the lowest is trusted most), value, score. Opinions are compared with the first of
    each cluster; the largest cluster wins, of equal ones that of the lowest reader, and gives the value of its best
    scored member. Complementary sets are joined. A key's opinions on a field are as many as there are readers.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        field, rows = pdf["field"].iloc[0], sorted(zip(pdf["reader"], -pdf["score"].fillna(0), pdf["value"]))
        values = [v for _, _, v in rows]
        if field in ("categories", "education_levels") and len(values) > 1:
            sets = [set(v.split(",")) for v in values]
            if not any(x <= y or y <= x for i, x in enumerate(sets) for y in sets[:i]) and any(x & y for i, x in enumerate(sets) for y in sets[:i]):
                return pd.DataFrame([(pdf["key"].iloc[0], field, ",".join(sorted(set().union(*sets))), 0.9, len(values), "")], columns=["key", "field", "value", "agreement", "opinions", "conflicts"])
        clusters: list[list[tuple]] = []
        for r in rows:
            home = next((c for c in clusters if agreement(field, c[0][2], r[2]) >= 0.5), None)
            home.append(r) if home is not None else clusters.append([r])
        best = max(clusters, key=len)
        lost = "" if field in L.TOPICS else " | ".join(v for c in clusters if c is not best for _, _, v in c)
        value = min(best, key=lambda r: (r[1], r[0]))[2]
        return pd.DataFrame([(pdf["key"].iloc[0], field, value, round(len(best) / len(rows), 4), len(rows), lost)], columns=["key", "field", "value", "agreement", "opinions", "conflicts"])

    return opinions.where("value is not null and field is not null").groupBy("key", "field").applyInPandas(one, "key bigint, field string, value string, agreement double, opinions int, conflicts string")
