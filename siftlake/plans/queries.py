"""Registered queries of the core operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import claims, entities, history, records, snapshots, statements, units
from siftlake.plans import sql
from siftlake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Amounts and income ceilings in whole rupees a year, or in all."""
    return units.found(table(spark, d, "scholarships"), table(spark, d, "unit_rates"))


def p1_review(spark: SparkSession, d: str) -> DataFrame:
    """Figures whose units could not be told with confidence."""
    return units.review(table(spark, d, "scholarships"), table(spark, d, "unit_rates"))


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    """How well the forests tell units that are known but masked, by confidence, on records that they never saw."""
    return units.masked_units(table(spark, d, "scholarships"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Versions of closing_date and status with the runs in which they held."""
    return history.attribute_history(table(spark, d, "scholarships"), table(spark, d, "changes"), table(spark, d, "crawl_runs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Addresses added, removed or changed from run to run."""
    return snapshots.page_changes(table(spark, d, "pages"), table(spark, d, "crawl_runs"))


#: Queries of the record operators: what they run and the tables that they take.
RECORDS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "url_identity": (records.url_identity, ("discovery_candidates",)),
    "frontier": (records.frontier, ("discovery_candidates",)),
    "crawl_plan": (records.crawl_plan, ("discovery_candidates",)),
    "page_identity": (records.page_identity, ("pages",)),
    "clean_lines": (records.clean_lines, ("pages",)),
    "stated_dates": (records.stated_dates, ("pages",)),
    "reuse_plan": (records.reuse_plan, ("pages",)),
    "name_identity": (records.name_identity, ("scholarships",)),
    "same_keys": (records.same_keys, ("scholarships",)),
    "totals": (records.totals, ("scholarships",)),
    "by_source_type": (records.by_source_type, ("scholarships",)),
    "confidence_histogram": (records.confidence_histogram, ("scholarships",)),
    "closing_cycles": (records.closing_cycles, ("scholarships",)),
    "change_feed": (records.change_feed, ("changes", "scholarships")),
    "real_changes": (records.real_changes, ("changes",)),
    "run_outcomes": (records.run_outcomes, ("changes", "crawl_runs")),
    "record_details": (records.record_details, ("scholarships", "changes", "pages")),
    "evidence": (records.evidence, ("scholarships", "pages")),
    "source_load": (records.source_load, ("sources", "scholarships")),
    "key_figures": (records.key_figures, ("scholarships",)),
    "audit": (records.audit, ("scholarships", "changes")),
    "recently_changed": (records.recently_changed, ("changes",)),
    "run_overview": (records.run_overview, ("crawl_runs", "pages", "discovery_candidates")),
    "record_documents": (records.record_documents, ("scholarships", "changes")),
    "report_figures": (records.report_figures, ("scholarships", "changes", "pages", "discovery_candidates")),
    "page_dates": (statements.page_dates, ("pages",)),
    "dates_in_place": (statements.dates_in_place, ("pages",)),
    "closing_lines": (statements.closing_lines, ("pages",)),
    "page_ages": (statements.page_ages, ("pages",)),
    "benefit_terms": (statements.benefit_terms, ("scholarships",)),
    "record_groups": (statements.record_groups, ("scholarships",)),
    "absences": (statements.absences, ("scholarships",)),
    "cycle_of_pages": (statements.cycle_of_pages, ("pages", "crawl_runs")),
    "link_scores": (statements.link_scores, ("discovery_candidates",)),
    "expanded_links": (statements.expanded_links, ("discovery_candidates",)),
    "page_links": (statements.page_links, ("pages",)),
    "application_links": (statements.application_links, ("pages",)),
    "page_kinds": (statements.page_kinds, ("pages",)),
    "publishers": (statements.publishers, ("sources",)),
    "provider_domains": (statements.provider_domains, ("scholarships",)),
    "gated_pages": (statements.gated_pages, ("pages",)),
    "text_sections": (statements.text_sections, ("pages",)),
    "text_sentences": (statements.text_sentences, ("pages",)),
    "ranked_text": (statements.ranked_text, ("pages",)),
    "rule_claims": (claims.rule_claims, ("pages",)),
    "duplicate_keys": (entities.duplicate_keys, ("scholarships",)),
    "name_places": (entities.name_places, ("scholarships", "pages")),
    "trusted_addresses": (entities.trusted_addresses, ("scholarships",)),
    "corroborated": (entities.corroborated, ("scholarships", "pages")),
}


def search_grants(spark: SparkSession, d: str) -> DataFrame:
    """The 200 surest records that speak of grants."""
    return records.search(table(spark, d, "scholarships"), "grant")


def search_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many records speak of grants."""
    return records.search_totals(table(spark, d, "scholarships"), "grant")


def missing_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose address run 8 did not fetch."""
    return entities.missing_records(table(spark, d, "scholarships"), table(spark, d, "pages"), 8)


def self_matched(spark: SparkSession, d: str) -> DataFrame:
    """Every record as one that comes in, matched with the records of all runs before its first."""
    r = table(spark, d, "scholarships")
    return entities.matched(r, r, "first_run_id")


def grounded_quotes(spark: SparkSession, d: str) -> DataFrame:
    """What records state, grounded in their own pages."""
    return claims.grounded(entities.record_quotes(table(spark, d, "scholarships")), table(spark, d, "pages"))


def grounded_claims(spark: SparkSession, d: str) -> DataFrame:
    """What rules read from pages, grounded again: how many claims of each field stand."""
    c = claims.rule_claims(table(spark, d, "pages")).withColumn("claim_id", F.xxhash64("page_id", "field"))
    return claims.grounded(c, table(spark, d, "pages")).groupBy("field", "accepted").agg(F.count("*").alias("n"))


def merged_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of records by two readers, the record and the rules on its page, merged."""
    r, p = table(spark, d, "scholarships"), table(spark, d, "pages")
    own = r.select(F.col("id").alias("key"), "primary_page_id", F.explode(F.create_map(F.lit("name"), F.col("name"), F.lit("provider"), F.col("provider"), F.lit("closing_date"), F.date_format("closing_date", "yyyy-MM-dd"), F.lit("categories"), F.array_join("categories", ","))).alias("field", "value")).where("value <> ''")
    rules = claims.rule_claims(p).join(r.select(F.col("id").alias("key"), F.col("primary_page_id").alias("page_id")), "page_id").where(F.col("field").isin("name", "provider", "closing_date", "categories"))
    both = own.select("key", "field", F.lit(0).alias("reader"), "value", F.lit(100.0).alias("score")).unionAll(rules.select("key", "field", F.lit(1), "value", F.lit(100.0)))
    return claims.merged(both)


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Which pages are a programme's own."""
    p = table(spark, d, "pages")
    return claims.page_verdicts(claims.rule_claims(p), statements.page_kinds(p))


def _of(run: Callable[..., DataFrame], tables: tuple[str, ...]) -> Query:
    return lambda spark, d: run(*[table(spark, d, t) for t in tables])


def queries() -> dict[str, Query]:
    own = {f.__name__: f for f in (p1_found, p1_review, p1_masked, p3_found, p6_found, search_grants, search_totals, missing_records, self_matched, grounded_quotes, grounded_claims, merged_facts, verdicts)}
    return own | {k: _of(*v) for k, v in RECORDS.items()}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": sql.P3, "p6_found": sql.P6} | sql.RECORDS
