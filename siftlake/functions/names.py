"""Keys of record names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions.lexicon import GENERIC, KEY_NOISE
from siftlake.functions.urls import registered_domain

def folded(text: Column) -> Column:
    """Lower case with plain dashes, quotes and single spaces; for comparison only. Null is empty."""
    t = F.translate(F.coalesce(text, F.lit("")), "‐‑‒–—―−‘’“”\u00a0", "-------''\"\" ")
    return F.trim(F.lower(F.regexp_replace(t, r"\s+", " ")))


def name_key(name: Column) -> Column:
    """A name without years, sessions, words for the kind of award, function words and punctuation; empty for null."""
    t = F.regexp_replace(folded(name), r"\b(20\d\d\s*[-/]\s*(20)?\d\d|20\d\d)\b", " ")
    t = F.regexp_replace(F.regexp_replace(t, KEY_NOISE, " "), r"[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def record_key(name: Column, host: Column) -> Column:
    """A short hash of the name key and the host's registered domain."""
    return F.substring(F.sha1(F.concat_ws("|", name_key(name), F.coalesce(registered_domain(host), F.lit("")))), 1, 16)


def _tokens(name: Column) -> Column:
    generic = F.array(*[F.lit(w) for w in sorted(GENERIC)])
    return F.filter(F.regexp_extract_all(folded(name), F.lit("([a-z0-9]+)"), 1), lambda w: ~F.array_contains(generic, w) & ~w.rlike(r"^20\d\d$"))


def distinctive_tokens(name: Column) -> Column:
    """Words of a name of four letters or more that are neither generic nor a year, in order, repeated ones kept."""
    return F.filter(_tokens(name), lambda w: F.length(w) >= 4)


def is_generic_name(name: Column) -> Column:
    """Whether a name has no word of its own, or is that of a portal and of no scheme."""
    portal = folded(name).rlike(r"\bportal\b") & ~folded(name).rlike("scheme|yojana|scholarship for|fellowship for")
    return ~F.exists(_tokens(name), lambda w: (F.length(w) >= 4) & ~w.rlike(r"^\d{1,2}$")) | portal


def looks_like_list(title: Column) -> Column:
    """Whether a title announces a list, a question or advice instead of one programme."""
    t = F.trim(F.coalesce(title, F.lit("")))
    odd = F.length(F.regexp_replace(t, r"[\x00-\x7F]", "")) > 0.1 * F.greatest(F.length(t), F.lit(1))
    begins = t.rlike(r"(?i)^(?:top|best|why|discover|how|what|list of|complete list|\d+\s|q\s?\d+[.)]|question)") | t.rlike(r"(?i)^(?:application process|additional awards|award letters of scholarships|stipend, contingency grant and prize money)\b")
    several = t.rlike(r"(?i)\bscholarships\b") & (F.size(distinctive_tokens(t)) < 2)
    return odd | begins | t.endswith("?") | t.rlike(r"(?i)\b(?:faqs?|frequently asked|complete list|guide to)\b") | several


def lead_name(title: Column) -> Column:
    """The name in a page's title: what stands before the site's own name, without words of invitation and punctuation at its ends."""
    cut = lambda t: F.regexp_replace(t, r"\s+[|•»«–—-]\s+[^|•»«–—]{2,40}$", "")
    t = F.regexp_replace(cut(cut(F.coalesce(title, F.lit("")))), r"(?i)\b(?:apply (?:now|online)|last date|eligibility|check (?:here|now)|20\d\d(?:-\d\d)?)\b", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[\s,:;|–—-]+|[\s,:;|–—-]+$", "")


def academic_cycle(day: Column) -> Column:
    """The academic year that a day falls in, which begins in June, as 2026-27."""
    y = F.when(F.month(day) >= 6, F.year(day)).otherwise(F.year(day) - 1)
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))
