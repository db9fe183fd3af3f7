"""Queries on what pages, links and records state: dates, ages, periods, groups, windows, topics, scores, publishers, gates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import lexicon as L
from siftlake.functions import spans as S
from siftlake.functions import stated as St
from siftlake.functions.urls import canonical_url, host_of, registered_domain

#: Closing statements from which a page is a listing, and letters that its head and its market are told from.
LISTING, HEAD = 8, 400


def page_dates(pages: DataFrame) -> DataFrame:
    """page_id, n, first_day, last_day of the dates that a text writes in four notations; pages without any have no row."""
    d = pages.select("page_id", St.dates(F.col("text")).alias("d")).where("size(d) > 0")
    return d.select("page_id", F.size("d").alias("n"), F.array_min("d").alias("first_day"), F.array_max("d").alias("last_day"))


def dates_in_place(pages: DataFrame) -> DataFrame:
    """page_id, day, start, stop, kind: every date of a page with its offsets and whether it closes or opens applications."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *x) for p, t in zip(pdf["page_id"], pdf["text"]) for x in S.days(t)], columns=["page_id", "day", "start", "stop", "kind"])

    return pages.where("text is not null").select("page_id", "text").mapInPandas(run, "page_id bigint, day date, start int, stop int, kind string")


def closing_lines(pages: DataFrame) -> DataFrame:
    """page_id, strength, n: how many lines of a page state a closing day with which strength (1 to 3)."""
    lines = pages.select("page_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return lines.select("page_id", St.closing_strength(F.col("line")).alias("strength")).where("strength > 0").groupBy("page_id", "strength").agg(F.count("*").alias("n"))


def page_ages(pages: DataFrame) -> DataFrame:
    """page_id, age_min, age_max that a page states."""
    a = pages.select("page_id", St.ages(F.col("text")).alias("a"))
    return a.select("page_id", "a.age_min", "a.age_max").where("age_min is not null or age_max is not null")


def benefit_terms(records: DataFrame) -> DataFrame:
    """id, period, window, topic: the period and the open window that a record's benefit text names, and whether it is off its topic."""
    t = F.coalesce("amount_text", "benefit_text")
    return records.select("id", St.period(t).alias("period"), St.open_window(F.col("deadline_note")).alias("open_window"), St.off_topic("benefit_text", F.col("benefit_text")).alias("off_topic"))


def record_groups(records: DataFrame) -> DataFrame:
    """id, named, levels, genders, kept: groups, levels and genders that a record's texts speak of, and which of its categories its eligibility text supports."""
    t = F.concat_ws(" ", "name", "eligibility_text")
    join = lambda c: F.array_join(c, ",")
    kept = St.supported(F.coalesce("categories", F.array().cast("array<string>")), F.col("eligibility_text"), L.CATEGORIES)
    return records.select("id", join(St.members(t, L.CATEGORIES)).alias("named"), join(St.members(t, L.LEVELS)).alias("levels"), join(St.members(t, L.GENDERS)).alias("genders"), join(kept).alias("kept"))


def absences(records: DataFrame) -> DataFrame:
    """field, absent, hinted: for each field that a record may leave blank, how many do so, and in how many of these its eligibility text hints at a value."""
    fields = (("gender", "gender", L.GENDERS["FEMALE"][0]), ("age", "age_max", r"\bage\b|aged|years of age"), ("income", "income_limit_text", r"income|earning|salary"), ("categories", None, "|".join(p for p, _ in L.CATEGORIES.values())))
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), (F.col(column).isNull() if column else F.coalesce(F.size("categories"), F.lit(0)) <= 0).alias("absent"), St.speaks_of(F.col("eligibility_text"), rx).alias("hint")) for name, column, rx in fields]))
    return records.select(rows.alias("x")).select("x.*").groupBy("field").agg(F.sum(F.col("absent").cast("bigint")).alias("absent"), F.sum((F.col("absent") & F.col("hint")).cast("bigint")).alias("hinted"))


def cycle_of_pages(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, cycle, n: pages of each run by whether the newest session that they name is current in the academic year of the run's as_of."""
    year = F.when(F.month("as_of") >= 6, F.year("as_of")).otherwise(F.year("as_of") - 1)
    j = pages.select("run_id", "text").join(F.broadcast(runs.select("run_id", year.alias("y"))), "run_id")  # a row for each run
    return j.groupBy("run_id", St.cycle_status(F.col("text"), F.col("y")).alias("cycle")).agg(F.count("*").alias("n"))


def link_scores(candidates: DataFrame) -> DataFrame:
    """candidate_id, score: how likely a found link leads to a programme."""
    return candidates.select("candidate_id", St.link_score(F.col("anchor_text"), F.col("url"), F.col("context_text")).alias("score"))


def expanded_links(candidates: DataFrame, same: float = 0.35, other: float = 0.45) -> DataFrame:
    """candidate_id, score, inside, priority of links worth following: on the parent's domain from `same` on, off it from `other` on.

    priority adds 0.15 for an official host and takes 0.05 for each level below the third.
    """
    host, parent = registered_domain(host_of(F.col("url"))), registered_domain(host_of(F.col("parent_url")))
    score = St.link_score(F.col("anchor_text"), F.col("url"), F.col("context_text"))
    rows = candidates.select("candidate_id", score.alias("score"), F.coalesce(host == parent, F.lit(False)).alias("inside"), St.publisher(host_of(F.col("url")))["tier"].alias("tier"), "depth")
    worth = rows.where(F.col("score") >= F.when(F.col("inside"), same).otherwise(other))
    return worth.select("candidate_id", "score", "inside", F.round(F.col("score") + F.when(F.col("tier").isin("T1", "T2", "T3"), 0.15).otherwise(0.0) - 0.05 * (3 - F.coalesce("depth", F.lit(0))), 4).alias("priority"))


def page_kinds(pages: DataFrame) -> DataFrame:
    """page_id, kind: how likely a page describes one programme, by its title and first lines and its text's cues."""
    head = F.concat_ws(" ", "title", F.substring(F.coalesce("text", F.lit("")), 1, HEAD))
    return pages.select("page_id", St.page_kind(head, F.col("text")).alias("kind"))


def publishers(sources: DataFrame) -> DataFrame:
    """domain, rule_type, rule_tier, rule_authority: what the rules say of each source's host."""
    p = St.publisher(host_of(F.concat(F.lit("https://"), F.col("domain"), F.lit("/"))))
    return sources.select("domain", p["source_type"].alias("rule_type"), p["tier"].alias("rule_tier"), p["authority"].alias("rule_authority"))


# Words of organisations that tell nothing of their own name.
_STOP = "the of and for india indian limited ltd pvt private trust foundation society programme program scholarship scholarships scheme bank group company corporation".split()


def owns_domain(provider: Column, host: Column) -> Column:
    """Whether a provider's name is recognisably in a host's own label: its telling words, its first two of them, its initials, or the label in its name."""
    label = F.regexp_replace(F.substring_index(registered_domain(host), ".", 1), "[^a-z0-9]", "")
    words = F.regexp_extract_all(F.lower(St.said(provider)), F.lit("([a-z0-9]+)"), 1)
    telling = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*_STOP))
    key = F.array_join(telling, "")
    initials = F.array_join(F.transform(F.filter(words, lambda w: ~w.isin("of", "the", "for", "and", "in", "at", "to", "a")), lambda w: F.substring(w, 1, 1)), "")
    by_key = (F.length(key) >= 4) & (F.instr(label, key) + F.when(F.length(label) >= 5, F.instr(key, label)).otherwise(0) > 0)
    by_words = (F.size(telling) > 0) & F.forall(F.slice(telling, 1, 2), lambda w: F.contains(label, w))
    return (label != "") & (by_key | by_words | (F.length(initials) >= 3) & label.startswith(initials) | (F.length(label) >= 4) & F.contains(F.array_join(words, ""), label))


def provider_domains(records: DataFrame) -> DataFrame:
    """id, owner: whether a record's provider owns its official domain; false where either is missing."""
    return records.select("id", F.coalesce(owns_domain(F.col("provider"), F.lower("official_domain")), F.lit(False)).alias("owner"))


def gated_pages(pages: DataFrame, listing: int = LISTING) -> DataFrame:
    """page_id, reason: pages that are no programme's own: news paths, listings of many closing days, unproven hosts that name no market. Others have no row."""
    closing = dates_in_place(pages).where("kind = 'closing'").groupBy("page_id").agg(F.count("*").alias("n")).where(F.col("n") >= listing)
    url = F.substring_index(F.coalesce("final_url", "url"), "?", 1)
    tier = St.publisher(host_of(url))
    unproven = (tier["source_type"] == "INTERNATIONAL") | tier["tier"].isin("T3h", "T4")
    market = St.speaks_of(F.col("text"), L.HOME_MARKET) | St.speaks_of(F.col("text"), L.ANY_MARKET)
    rows = pages.select("page_id", St.speaks_of(url, L.NEWS_PATH).alias("news"), (unproven & ~F.coalesce(host_of(url).endswith(".in"), F.lit(False)) & ~market).alias("foreign")).join(closing, "page_id", "left")
    reason = F.when(F.col("news"), "news").when(F.col("n").isNotNull(), "listing").when(F.col("foreign"), "market not named")
    return rows.select("page_id", reason.alias("reason")).where("reason is not null")


def text_sections(pages: DataFrame) -> DataFrame:
    """page_id, field, start, stop: the sections of a page's text by their headings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, f, x.start, x.end) for p, t in zip(pdf["page_id"], pdf["text"]) for f, x in S.sections(t).items()], columns=["page_id", "field", "start", "stop"])

    return pages.where("text is not null").select("page_id", "text").mapInPandas(run, "page_id bigint, field string, start int, stop int")


def text_sentences(pages: DataFrame) -> DataFrame:
    """page_id, n, letters, headings: sentences of a page's text, their letters, and how many lines are headings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, t in zip(pdf["page_id"], pdf["text"]):
                at = list(S.sentences(t))
                rows.append((p, len(at), sum(b - a for a, b in at), sum(map(S.is_heading, t.split("\n")))))
            yield pd.DataFrame(rows, columns=["page_id", "n", "letters", "headings"])

    return pages.where("text is not null").select("page_id", "text").mapInPandas(run, "page_id bigint, n int, letters int, headings int")


def ranked_text(pages: DataFrame, budget: int = 9_000, first: int = 25) -> DataFrame:
    """page_id, selected: the lines of a page that matter most under a budget of letters, in their order, [...] where lines are left out.

    The first lines come first, then those with most cues; the budget is what a reader takes, so it is the operator's
    feature. Null texts give null.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x"))), lambda s: s["x"] != "")
    cues = lambda s: sum((F.regexp_count(F.lower(s["x"]), F.lit(p)) for p, _, _ in L.PAGE_CUES.values()), F.lit(0))
    ranked = F.array_sort(F.transform(lines, lambda s: F.struct(F.when(s["i"] < first, -1000).otherwise(-cues(s)).alias("k"), s["i"].alias("i"), s["x"].alias("x"))))
    taken = F.aggregate(ranked, F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<i:int,x:string>>").alias("a")), lambda acc, s: F.when(acc["n"] + F.length(s["x"]) + 1 <= budget, F.struct((acc["n"] + F.length(s["x"]) + 1).alias("n"), F.concat(acc["a"], F.array(F.struct(s["i"], s["x"]))).alias("a"))).otherwise(acc))
    kept = F.array_sort(taken["a"])
    gaps = F.transform(kept, lambda s, k: F.concat(F.when((k > 0) & (s["i"] - F.try_element_at(kept, k)["i"] > 1), F.lit("[...]\n")).otherwise(F.lit("")), s["x"]))
    return pages.select("page_id", F.array_join(gaps, "\n").alias("selected"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, place (from 1), url, anchor of every link that a page keeps in links_json; JSON that cannot be read holds none."""
    links = F.from_json("links_json", "array<struct<u:string,t:string>>")
    return pages.select("page_id", F.posexplode(links).alias("i", "l")).select("page_id", (F.col("i") + 1).alias("place"), F.col("l.u").alias("url"), F.col("l.t").alias("anchor")).where("url is not null")


def application_links(pages: DataFrame, least: float = 0.5) -> DataFrame:
    """page_id, url, score: the link of a page that leads to its application form, the first of equal ones.

    Wording of anchor and address is weighed, a link on the page's own domain a tenth more; what only says register or is on
    a list of other services is none. The page's own address is none either.
    """
    own = pages.select("page_id", F.coalesce("final_url", "url").alias("page_url"))
    said = lambda c, rows: sum((F.when(St.speaks_of(F.col(c), p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in rows), F.lit(0.0))
    j = page_links(pages).join(own, "page_id").where(~St.speaks_of(F.col("url"), L.NO_APPLICATION) & ~F.coalesce(canonical_url(F.col("url")) == canonical_url(F.col("page_url")), F.lit(False)))
    base = said("anchor", L.APPLY_ANCHORS) + said("url", (L.APPLY_ADDRESS,))
    inside = F.coalesce(registered_domain(host_of(F.col("url"))) == registered_domain(host_of(F.col("page_url"))), F.lit(False))
    scored = j.withColumn("score", F.when(base > 0, F.round(base + F.when(inside, 0.1).otherwise(0.0), 4)).otherwise(0.0)).where(F.col("score") >= least)
    best = scored.groupBy("page_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "place", "url")).alias("m"))
    return best.select("page_id", "m.url", (-F.col("m.s")).alias("score"))
