"""Queries on records, pages, changes and candidates: identity, search, feeds, audits, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftlake.functions.names import academic_cycle, distinctive_tokens, name_key, record_key
from siftlake.functions.text import collapse
from siftlake.functions.urls import canonical_url, host_of, registered_domain

#: Pages that a domain may give to one run of the frontier, letters around a quote, and the largest page of a search.
PER_DOMAIN, PAD, MOST = 90, 60, 500


def url_identity(candidates: DataFrame) -> DataFrame:
    """candidate_id, host, site, canonical, url_key of every found address; parts of a null address are null."""
    c = canonical_url(F.col("url"))
    return candidates.select("candidate_id", host_of(F.col("url")).alias("host"), registered_domain(host_of(F.col("url"))).alias("site"), c.alias("canonical"), F.sha1(c).alias("url_key"))


def frontier(candidates: DataFrame) -> DataFrame:
    """One row for each run and canonical address: the first found, with how often and the best relevance.

    Aggregated before the shuffle, so an address found a million times is one row by then.
    """
    first = F.min(F.struct("candidate_id", "discovered_via", "depth")).alias("f")
    g = candidates.where("canonical_url is not null").groupBy("run_id", "canonical_url").agg(first, F.count("*").alias("times"), F.max("relevance").alias("best"))
    return g.select("run_id", "canonical_url", F.col("f.candidate_id").alias("candidate_id"), F.col("f.discovered_via").alias("discovered_via"), F.col("f.depth").alias("depth"), "times", "best")


def crawl_plan(candidates: DataFrame, per_domain: int = PER_DOMAIN, parts: int = 64) -> DataFrame:
    """The addresses that a run fetches: of each domain the best `per_domain`, by relevance, then the first found.

    A domain's addresses are first cut to the best of each of `parts` hash ranges, so that the domain that has most of them
    leaves one task at most parts x per_domain rows to order.
    """
    f = frontier(candidates).withColumn("host", host_of(F.col("canonical_url"))).withColumn("part", F.pmod(F.xxhash64("canonical_url"), F.lit(parts)))
    order = [F.desc_nulls_last("best"), "candidate_id"]
    best = f.withColumn("k", F.row_number().over(W.partitionBy("run_id", "host", "part").orderBy(*order))).where(F.col("k") <= per_domain)
    ranked = best.withColumn("place", F.row_number().over(W.partitionBy("run_id", "host").orderBy(*order)))
    return ranked.where(F.col("place") <= per_domain).select("run_id", "host", "place", "candidate_id", "canonical_url")


def page_identity(pages: DataFrame) -> DataFrame:
    """page_id, text_hash, words, lines: identity and size of each text with white space collapsed; 0 for null or blank."""
    t = collapse(F.col("text"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return pages.select("page_id", F.substring(F.sha1(t), 1, 20).alias("text_hash"), F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).alias("words"), F.size(lines).alias("lines"))


def clean_lines(pages: DataFrame) -> DataFrame:
    """page_id, cleaned: lines trimmed of space and bars, blank ones and repeats of the line before dropped."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^[\s|]+|[\s|]+$", ""))
    full = F.filter(lines, lambda x: x != "")
    kept = F.filter(F.transform(full, lambda x, i: F.when((i == 0) | (x != F.try_element_at(full, i)), x)), lambda x: x.isNotNull())
    return pages.where("text is not null").select("page_id", F.array_join(kept, "\n").alias("cleaned"))


def stated_dates(pages: DataFrame) -> DataFrame:
    """page_id, n, first_day, last_day of the ISO dates in a text; dates that are none are left out."""
    d = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"\b(20\d\d-\d\d-\d\d)\b")), lambda x: F.try_to_date(x, "yyyy-MM-dd")), lambda x: x.isNotNull())
    return pages.select("page_id", d.alias("d")).where("size(d) > 0").select("page_id", F.size("d").alias("n"), F.array_min("d").alias("first_day"), F.array_max("d").alias("last_day"))


def name_identity(records: DataFrame) -> DataFrame:
    """id, name_key, short_key, tokens: keys of a record's name."""
    return records.select("id", name_key(F.col("name")).alias("name_key"), record_key(F.col("name"), F.col("official_domain")).alias("short_key"), F.array_join(distinctive_tokens(F.col("name")), " ").alias("tokens"))


def same_keys(records: DataFrame) -> DataFrame:
    """name_key, official_domain, n, least_id of records that share both."""
    g = records.withColumn("name_key", name_key(F.col("name"))).groupBy("name_key", "official_domain").agg(F.count("*").alias("n"), F.min("id").alias("least_id"))
    return g.where("n > 1")


def totals(records: DataFrame) -> DataFrame:
    """One row: records, providers, with a day of closing, mean confidence, share by tier."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return records.agg(
        F.count("*").alias("records"), F.countDistinct("provider").alias("providers"), count(F.col("closing_date").isNotNull()).alias("dated"),
        count(F.col("source_tier") == "T1").alias("tier_one"), count(F.col("amount_text").isNotNull()).alias("with_amount"), F.round(F.avg("confidence"), 1).alias("mean_confidence"),
    )


def by_source_type(records: DataFrame) -> DataFrame:
    """source_type, n, dated: records of each type and how many state a day of closing."""
    return records.groupBy("source_type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("closing_date").isNotNull(), 1).otherwise(0)).cast("bigint").alias("dated"))


def confidence_histogram(records: DataFrame) -> DataFrame:
    """bucket (0, 10, ... 90), n; 100 counts with 90, a null confidence with none."""
    b = (F.floor(F.least(F.col("confidence"), F.lit(99.99)) / 10) * 10).cast("int")
    return records.where("confidence is not null").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def matching(records: DataFrame, words: str = "", source_type: str | None = None, least: float = 0.0) -> DataFrame:
    """The records whose name, provider, benefit or eligibility text holds the words, in any case."""
    at = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(words.lower()) for c in ("name", "provider", "benefit_text", "eligibility_text")]
    rows = records.where((at[0] | at[1] | at[2] | at[3]) & (F.coalesce("confidence", F.lit(0.0)) >= least))
    return rows if source_type is None else rows.where(F.col("source_type") == source_type)


def search(records: DataFrame, words: str = "", source_type: str | None = None, least: float = 0.0, offset: int = 0, size: int = 200) -> DataFrame:
    """A page of the matching records, the surest first, nulls last. A top-k report: size is at most MOST."""
    rows = matching(records, words, source_type, least).select("id", "name", "provider", "confidence")
    return rows.orderBy(F.desc_nulls_last("confidence"), "id").offset(offset).limit(min(size, MOST))


def change_feed(log: DataFrame, records: DataFrame, kind: str | None = None) -> DataFrame:
    """change_id, id, name, field_name, change_type, old_value, new_value, detected_at of logged changes of known records."""
    rows = log if kind is None else log.where(F.col("change_type") == kind)
    return rows.join(records.select(F.col("id").alias("scholarship_id"), "name"), "scholarship_id").select("change_id", F.col("scholarship_id").alias("id"), "name", "field_name", "change_type", "old_value", "new_value", "detected_at")


def real_changes(log: DataFrame) -> DataFrame:
    """run_id, field_name, n: changes that are more than repeated entries: the log's distinct record, field and values."""
    d = log.where("change_type <> 'NEW'").groupBy("run_id", "scholarship_id", "field_name", "old_value", "new_value").agg(F.count("*").alias("times"))
    return d.groupBy("run_id", "field_name").agg(F.count("*").alias("n"), F.sum("times").alias("entries"))


def run_outcomes(log: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, label, added, changed, records: what each run of the calendar brought; zeros where nothing."""
    g = log.groupBy("run_id").agg(F.sum(F.when(F.col("change_type") == "NEW", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("change_type") != "NEW", 1).otherwise(0)).alias("c"), F.countDistinct("scholarship_id").alias("r"))
    zero = lambda c, n: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(n)
    return runs.select("run_id", "label").join(g, "run_id", "left").select("run_id", "label", zero("a", "added"), zero("c", "changed"), zero("r", "records"))


def record_details(records: DataFrame, log: DataFrame, pages: DataFrame) -> DataFrame:
    """id, name, page_title, n_changes, last_change, fields: each record with its page and its log, in one job instead of lookups."""
    changed = log.groupBy("scholarship_id").agg(F.count("*").alias("n"), F.max("detected_at").alias("t"), F.array_join(F.array_sort(F.collect_set("field_name")), ",").alias("fields"))
    page = pages.select(F.col("page_id").alias("primary_page_id"), F.col("title").alias("page_title"))
    j = records.select("id", "name", "primary_page_id").join(changed, F.col("id") == F.col("scholarship_id"), "left").join(page, "primary_page_id", "left")
    return j.select("id", "name", "page_title", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_changes"), F.col("t").alias("last_change"), F.coalesce("fields", F.lit("")).alias("fields"))


def evidence(records: DataFrame, pages: DataFrame, pad: int = PAD) -> DataFrame:
    """id, page_id, begin, before, quote, after: where a record's own page states its name, with the text around it.

    begin counts letters from 1; the first place counts. Records without a page, or whose page does not state it, have none.
    """
    j = records.select("id", "name", "primary_page_id").join(pages.select(F.col("page_id").alias("primary_page_id"), "text"), "primary_page_id")
    at = F.instr(F.col("text"), F.col("name"))
    row = j.withColumn("begin", at).where("begin > 0 and name <> ''")
    cut = lambda a, n: F.substring(F.col("text"), a, n)
    start = F.greatest(F.col("begin") - pad, F.lit(1))
    return row.select("id", F.col("primary_page_id").alias("page_id"), "begin", cut(start, F.col("begin") - start).alias("before"), F.col("name").alias("quote"), cut(F.col("begin") + F.length("name"), F.lit(pad)).alias("after"))


def source_load(sources: DataFrame, records: DataFrame) -> DataFrame:
    """domain, tier, authority, n: every source with the number of its records."""
    g = records.groupBy(F.col("official_domain").alias("domain")).agg(F.count("*").alias("n"))
    return sources.select("domain", "tier", "authority").join(g, "domain", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def merge_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources after an upsert: the new row of a domain wins, but a missing provider_name keeps the old one."""
    o, n = old.alias("o"), new.alias("n")
    pick: list[Column] = [F.when(F.col("n.domain").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c not in ("domain", "provider_name")]
    return o.join(n, F.col("o.domain") == F.col("n.domain"), "full").select(F.coalesce("n.domain", "o.domain").alias("domain"), F.coalesce("n.provider_name", "o.provider_name").alias("provider_name"), *pick)


def closing_cycles(records: DataFrame) -> DataFrame:
    """cycle, n: records by the academic year of their day of closing; none for those without."""
    return records.where("closing_date is not null").groupBy(academic_cycle(F.col("closing_date")).alias("cycle")).agg(F.count("*").alias("n"))


def reuse_plan(pages: DataFrame) -> DataFrame:
    """run_id, reused, fresh: of each run's addresses, those whose text is the same as in the run before, and the others."""
    h = F.xxhash64(collapse(F.col("text")))
    last = pages.where("run_id is not null").groupBy("run_id", canonical_url(F.coalesce("url", "final_url")).alias("u")).agg(F.max(F.struct("fetched_at", "page_id", h.alias("h"))).alias("s")).select("run_id", "u", F.col("s.h").alias("h"))
    before = last.select((F.col("run_id") + 1).alias("run_id"), "u", F.col("h").alias("p"))
    j = last.join(before, ["run_id", "u"], "left")
    same = F.coalesce(F.col("h") == F.col("p"), F.lit(False))
    return j.groupBy("run_id").agg(F.sum(F.when(same, 1).otherwise(0)).alias("reused"), F.sum(F.when(same, 0).otherwise(1)).alias("fresh"))


def key_figures(records: DataFrame) -> DataFrame:
    """One row of sums over the records: by label, confidence, status, dates and sources; zeros over an empty table."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    is_ = lambda c, v: F.col(c) == v
    return records.agg(
        F.count("*").alias("records"), count(is_("verification_label", "VERIFIED")).alias("verified"), count(is_("verification_label", "REVIEW_REQUIRED")).alias("to_review"), count(F.col("confidence") >= 95).alias("sure"),
        count(is_("status", "ACTIVE")).alias("active"), count(is_("status", "EXPIRING_SOON")).alias("expiring"), count(is_("status", "EXPIRED")).alias("expired"), count(is_("status", "NO_LONGER_VERIFIABLE")).alias("lost"),
        count(F.col("closing_date").isNotNull()).alias("dated"), F.countDistinct("source_type").alias("source_types"), F.round(F.avg("confidence"), 1).alias("mean_confidence"),
    )


def audit(records: DataFrame, log: DataFrame, thresholds: dict[str, int] | None = None) -> DataFrame:
    """metric, value, threshold, met: whether records and log reach what a reader asks of them."""
    asked = {"records": 20, "linked": 15, "verified": 10, "source_types": 3, "changed": 2, "expired": 2} | (thresholds or {})
    r = records.agg(
        F.count("*").alias("records"), F.count("official_url").alias("linked"), F.sum(F.when(F.col("verification_label") == "VERIFIED", 1).otherwise(0)).alias("verified"), F.countDistinct("source_type").alias("source_types"),
        F.sum(F.when(F.col("status").isin("EXPIRED", "NO_LONGER_VERIFIABLE"), 1).otherwise(0)).alias("expired"),
    )
    c = log.agg(F.countDistinct(F.when(F.col("change_type") == "FIELD_CHANGED", F.col("scholarship_id"))).alias("changed"))
    long = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in df.columns]), F.array(*[F.coalesce(F.col(x), F.lit(0)).cast("bigint") for x in df.columns]))).alias("metric", "value"))
    want = F.create_map(*[F.lit(x) for kv in asked.items() for x in kv])[F.col("metric")].cast("bigint")
    return long(r).unionAll(long(c)).select("metric", "value", want.alias("threshold"), (F.col("value") >= want).alias("met"))


def recently_changed(log: DataFrame, days: int = 7) -> DataFrame:
    """run_id, n: distinct records that changed within the last days before the newest entry, new ones left out, by run."""
    newest = log.agg(F.max("detected_at").alias("t"))
    rows = log.where("change_type <> 'NEW'").join(F.broadcast(newest), F.col("detected_at") >= F.col("t") - F.expr(f"interval {days} days"))  # one row
    return rows.groupBy("run_id").agg(F.countDistinct("scholarship_id").alias("n"))


def run_overview(runs: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """run_id, label, as_of, pages, failed, found: every run with what it fetched and found, the newest first."""
    p = pages.groupBy("run_id").agg(F.count("*").alias("p"), F.sum(F.when((F.col("status_code") < 200) | (F.col("status_code") >= 300), 1).otherwise(0)).alias("x"))
    c = candidates.groupBy("run_id").agg(F.count("*").alias("c"))
    zero = lambda x, n: F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(n)
    return runs.select("run_id", "label", "as_of").join(p, "run_id", "left").join(c, "run_id", "left").select("run_id", "label", "as_of", zero("p", "pages"), zero("x", "failed"), zero("c", "found"))


def search_totals(records: DataFrame, words: str = "") -> DataFrame:
    """source_type, n: how many records a search finds in all, by source type."""
    return matching(records, words).groupBy("source_type").agg(F.count("*").alias("n"))


def record_documents(records: DataFrame, log: DataFrame) -> DataFrame:
    """id, n_changes, changes: each record with its log nested as JSON, in the order of its runs; an empty list where it has none."""
    entry = F.struct("run_id", "change_id", "field_name", "change_type", "old_value", "new_value")
    c = log.groupBy(F.col("scholarship_id").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("c"))
    j = records.select("id").join(c, "id", "left")
    return j.select("id", F.coalesce(F.size("c"), F.lit(0)).alias("n_changes"), F.coalesce(F.to_json("c"), F.lit("[]")).alias("changes"))


def report_figures(records: DataFrame, log: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """metric, n: the scalar counts of a report, one pass for each table."""
    some = lambda df, name, c=None: df.agg((F.count("*") if c is None else F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))).cast("bigint").alias("n")).select(F.lit(name).alias("metric"), "n")
    parts = [some(records, "records"), some(records, "verified", F.col("verification_label") == "VERIFIED"), some(records, "sure", F.col("confidence") >= 95), some(log, "field_changes", F.col("change_type") == "FIELD_CHANGED"), some(log, "status_changes", F.col("change_type") == "STATUS_CHANGED"), some(pages, "pages"), some(pages, "unsafe_pages", ~F.col("tls_verified")), some(candidates, "candidates"), some(candidates, "rejected", F.col("status") == "REJECTED")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
