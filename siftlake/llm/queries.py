"""Registered queries of the operators on text corpora and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftlake.llm import boilerplate, bpe, language, leak, linking, residue, sitelines
from siftlake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of scholarships that are of the same programme, in pairs."""
    return linking.same_programme(table(spark, d, "scholarships"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every named row of scholarships with its programme's class and the number of rows linked to it."""
    return linking.class_sizes(table(spark, d, "scholarships"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages with template residue, filler or messages in place of a programme's text."""
    return residue.residue(table(spark, d, "pages"))


def p4_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What shows that a page carries residue: aligned slots, notations, whole-page templates, filler, messages."""
    return residue.evidence(table(spark, d, "pages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages that are site furniture."""
    return boilerplate.page_furniture(table(spark, d, "pages"))


def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Main bodies of pages."""
    return boilerplate.main_body(table(spark, d, "pages"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Places of lines that stand on many pages of their site."""
    return sitelines.repeated_lines(table(spark, d, "pages"), table(spark, d, "discovery_candidates"))


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of pages without such lines."""
    return sitelines.without_repeated_lines(table(spark, d, "pages"), table(spark, d, "discovery_candidates"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of documents."""
    return bpe.encode(table(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and tokens by language label."""
    return bpe.token_counts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the test items that leaked into them."""
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of words to remove from documents because of leaks."""
    return leak.leaked_spans(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of documents that are labelled wrongly or not at all, or mixed."""
    return language.mislabelled(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of documents with their language and confidence."""
    return language.segments(table(spark, d, "documents"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """The main language of each document."""
    return language.document_languages(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_classes, p4_found, p4_evidence, p5_found, p5_bodies, p7_found, p7_texts, p8_ids, p8_counts, p9_found, p9_spans, p10_found, p10_segments, p10_documents)}


P7 = r"""
WITH canon AS (
  SELECT page_id, text, lower(regexp_extract(final_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
    lower(regexp_extract(coalesce(url, final_url), '^([A-Za-z][A-Za-z0-9+.-]*://)', 1)) || regexp_replace(lower(regexp_extract(coalesce(url, final_url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')
      || regexp_replace(regexp_extract(coalesce(url, final_url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS canon
  FROM pages),
given AS (SELECT canonical_url AS canon, min(regexp_replace(lower(trim(domain)), '^www\.', '')) AS given FROM discovery_candidates WHERE domain IS NOT NULL GROUP BY 1),
sites AS (
  SELECT page_id, text, canon, coalesce(regexp_replace(host, '^www\.', ''), given, regexp_extract(canon, '://([^/]*)', 1)) AS site
  FROM canon LEFT JOIN given USING (canon)),
lines AS (
  SELECT page_id, site, canon, i AS line_no, trim(regexp_replace(regexp_replace(lower(string_split(text, chr(10))[i]), '[\s\x{00A0}]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line
  FROM (SELECT *, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM sites WHERE text IS NOT NULL AND text <> '')),
real AS (SELECT * FROM lines WHERE line <> ''),
n AS (SELECT site, count(DISTINCT canon) AS n FROM real GROUP BY 1),
bad AS (SELECT site, line FROM (SELECT site, line, count(DISTINCT canon) AS k FROM real GROUP BY 1, 2) JOIN n USING (site) WHERE k >= 4 AND k >= 0.3 * n)
SELECT page_id, CAST(line_no AS INT) AS line_no FROM real JOIN bad USING (site, line)
"""


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7}
