"""SQL counterparts of the core queries, for DuckDB. Word lists and patterns are those of the lexicon; the rest is written again."""

from siftlake.functions import lexicon as L
from siftlake.functions import stated as St

CANON = r"""(lower(regexp_extract(coalesce(url, final_url), '^([A-Za-z][A-Za-z0-9+.-]*://)', 1))
  || regexp_replace(lower(regexp_extract(coalesce(url, final_url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')
  || regexp_replace(regexp_extract(coalesce(url, final_url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', ''))"""

P6 = rf"""
WITH states AS (
  SELECT run_id, {CANON} AS u, arg_max(trim(regexp_replace(coalesce(text, ''), '[\s\x{{00A0}}]+', ' ', 'g')), (fetched_at, page_id)) AS t
  FROM pages WHERE run_id IS NOT NULL GROUP BY 1, 2),
pairs AS (SELECT run_id AS now_id, lag(run_id) OVER (ORDER BY run_id) AS past_id FROM crawl_runs),
a AS (SELECT p.now_id, s.u, s.t FROM states s JOIN pairs p ON s.run_id = p.now_id WHERE p.past_id IS NOT NULL),
b AS (SELECT p.now_id, s.u, s.t FROM states s JOIN pairs p ON s.run_id = p.past_id)
SELECT coalesce(a.now_id, b.now_id) AS run_id, coalesce(a.u, b.u) AS canonical_url,
  CASE WHEN b.u IS NULL THEN 'added' WHEN a.u IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.now_id = b.now_id AND a.u = b.u
WHERE a.u IS NULL OR b.u IS NULL OR a.t <> b.t
"""

_DATE = """strftime(coalesce(try_strptime(left(trim({0}), 10), '%Y-%m-%d'), try_strptime(trim({0}), '%d/%m/%Y'), try_strptime(trim({0}), '%d %b %Y'), try_strptime(trim({0}), '%B %d, %Y')), '%Y-%m-%d')"""
_VALUE = "CASE WHEN field_name = 'closing_date' THEN " + _DATE + " ELSE nullif(upper(regexp_replace(trim({0}), '[\\s_-]+', '_', 'g')), '') END"

P3 = f"""
WITH log AS (
  SELECT scholarship_id AS id, field_name, coalesce(c.run_id, r.run_id) AS run, detected_at, change_id, {_VALUE.format("old_value")} AS o, {_VALUE.format("new_value")} AS v
  FROM changes c LEFT JOIN (SELECT run_id, started_at, finished_at FROM crawl_runs) r ON c.run_id IS NULL AND c.detected_at BETWEEN r.started_at AND r.finished_at
  WHERE field_name IN ('closing_date', 'status')),
ev AS (SELECT id, field_name, run, arg_max((v,), (detected_at, change_id)) AS v, arg_min((o,), (detected_at, change_id)) AS o FROM log GROUP BY 1, 2, 3),
base AS (
  SELECT id, first_run_id, 'closing_date' AS field_name, strftime(closing_date, '%Y-%m-%d') AS now FROM scholarships
  UNION ALL SELECT id, first_run_id, 'status', upper(status) FROM scholarships),
opening AS (
  SELECT b.id, b.field_name, b.first_run_id AS run, CASE WHEN f.o IS NULL THEN b.now ELSE f.o[1] END AS v
  FROM base b LEFT JOIN (SELECT id, field_name, arg_min(o, run) AS o, min(run) AS run FROM ev GROUP BY 1, 2) f USING (id, field_name)
  WHERE f.run IS NULL OR f.run > b.first_run_id),
states AS (SELECT * FROM opening UNION ALL SELECT ev.id, ev.field_name, run, v[1] FROM ev JOIN base USING (id, field_name)),
marked AS (SELECT *, lag(v) OVER w AS before, row_number() OVER w AS k FROM states WINDOW w AS (PARTITION BY id, field_name ORDER BY run)),
starts AS (SELECT *, lead(run) OVER (PARTITION BY id, field_name ORDER BY run) AS next FROM marked WHERE k = 1 OR before IS DISTINCT FROM v)
SELECT id AS scholarship_id, field_name, v AS value_text, run AS from_run, coalesce(next - 1, -1) AS to_run FROM starts WHERE v IS NOT NULL
"""

_HOST = r"""regexp_replace(regexp_extract({0}, '^[a-z]+://([^/?#:]*)', 1), '^www\.', '')"""
_URL = CANON.replace("coalesce(url, final_url)", "url")
_FOLD = r"""trim(lower(regexp_replace(translate(coalesce({0}, ''), '‐‑‒–—―−‘’“”' || chr(160), '-------\'\'"" '), '\s+', ' ', 'g')))""".replace("\\'", "''").replace('""', '""')
_KEY = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_FOLD.format("name")}, '\b(20\d\d\s*[-/]\s*(20)?\d\d|20\d\d)\b', ' ', 'g'), '{L.KEY_NOISE}', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"""
_GENERIC = ", ".join(f"'{w}'" for w in sorted(L.GENERIC))
_DOMAIN = """array_to_string(list_slice(string_split({0}, '.'), -2, -1), '.')"""  # hosts of the tables end in .example
_TEXT = r"""trim(regexp_replace(coalesce(text, ''), '[\s\x{00A0}]+', ' ', 'g'))"""
_FRONTIER = """SELECT run_id, canonical_url, min(candidate_id) AS candidate_id, arg_min(discovered_via, candidate_id) AS discovered_via, arg_min(depth, candidate_id) AS depth, count(*) AS times, max(relevance) AS best
  FROM discovery_candidates WHERE canonical_url IS NOT NULL GROUP BY 1, 2"""

RECORDS = {
    "url_identity": f"""WITH a AS (SELECT candidate_id, {_URL} AS c FROM discovery_candidates)
        SELECT candidate_id, {_HOST.format("c")} AS host, array_to_string(list_slice(string_split({_HOST.format("c")}, '.'), -2, -1), '.') AS site, c AS canonical, sha1(c) AS url_key FROM a""",
    "frontier": _FRONTIER,
    "crawl_plan": f"""SELECT * FROM (SELECT run_id, {_HOST.format("canonical_url")} AS host, CAST(row_number() OVER (PARTITION BY run_id, {_HOST.format("canonical_url")} ORDER BY best DESC NULLS LAST, candidate_id) AS INT) AS place, candidate_id, canonical_url
        FROM ({_FRONTIER})) WHERE place <= 90""",
    "page_identity": f"""WITH a AS (SELECT page_id, text, {_TEXT} AS t FROM pages)
        SELECT page_id, left(sha1(t), 20) AS text_hash, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS INT) AS words,
          CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '')) AS INT) AS lines FROM a""",
    "clean_lines": r"""WITH a AS (SELECT page_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s|]+|[\s|]+$', '', 'g')), lambda x: x <> '') AS f FROM pages WHERE text IS NOT NULL)
        SELECT page_id, array_to_string(list_filter(f, lambda x, i: i = 1 OR x <> f[i - 1]), chr(10)) AS cleaned FROM a""",
    "stated_dates": r"""WITH a AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(text, '\b20\d\d-\d\d-\d\d\b'), lambda x: try_cast(x AS DATE)), lambda x: x IS NOT NULL) AS d FROM pages)
        SELECT page_id, CAST(len(d) AS INT) AS n, list_min(d) AS first_day, list_max(d) AS last_day FROM a WHERE len(d) > 0""",
    "reuse_plan": f"""WITH s AS (SELECT run_id, {CANON} AS u, arg_max({_TEXT}, (fetched_at, page_id)) AS t FROM pages WHERE run_id IS NOT NULL GROUP BY 1, 2)
        SELECT a.run_id, CAST(count(*) FILTER (WHERE a.t = b.t) AS BIGINT) AS reused, CAST(count(*) FILTER (WHERE a.t IS DISTINCT FROM b.t) AS BIGINT) AS fresh FROM s a LEFT JOIN s b ON b.run_id = a.run_id - 1 AND a.u = b.u GROUP BY 1""",
    "name_identity": f"""WITH a AS (SELECT id, name, official_domain, {_KEY} AS k FROM scholarships)
        SELECT id, k AS name_key, left(sha1(k || '|' || coalesce({_DOMAIN.format("official_domain")}, '')), 16) AS short_key,
          array_to_string(list_filter(regexp_extract_all({_FOLD.format("name")}, '[a-z0-9]+'), lambda w: length(w) >= 4 AND w NOT IN ({_GENERIC}) AND NOT regexp_matches(w, '^20\\d\\d$')), ' ') AS tokens FROM a""",
    "same_keys": f"""SELECT {_KEY} AS name_key, official_domain, count(*) AS n, min(id) AS least_id FROM scholarships GROUP BY 1, 2 HAVING count(*) > 1""",
    "totals": """SELECT count(*) AS records, count(DISTINCT provider) AS providers, count(closing_date) AS dated, count(*) FILTER (WHERE source_tier = 'T1') AS tier_one, count(amount_text) AS with_amount, round(avg(confidence), 1) AS mean_confidence FROM scholarships""",
    "by_source_type": """SELECT source_type, count(*) AS n, count(closing_date) AS dated FROM scholarships GROUP BY 1""",
    "confidence_histogram": """SELECT CAST(floor(least(confidence, 99.99) / 10) * 10 AS INT) AS bucket, count(*) AS n FROM scholarships WHERE confidence IS NOT NULL GROUP BY 1""",
    "closing_cycles": """WITH a AS (SELECT CASE WHEN month(closing_date) >= 6 THEN year(closing_date) ELSE year(closing_date) - 1 END AS y FROM scholarships WHERE closing_date IS NOT NULL)
        SELECT y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS cycle, count(*) AS n FROM a GROUP BY 1""",
    "change_feed": """SELECT change_id, s.id, name, field_name, change_type, old_value, new_value, detected_at FROM changes c JOIN scholarships s ON c.scholarship_id = s.id""",
    "real_changes": """SELECT run_id, field_name, count(*) AS n, CAST(sum(times) AS BIGINT) AS entries FROM (SELECT run_id, scholarship_id, field_name, old_value, new_value, count(*) AS times FROM changes WHERE change_type <> 'NEW' GROUP BY ALL) GROUP BY 1, 2""",
    "run_outcomes": """SELECT r.run_id, r.label, count(*) FILTER (WHERE change_type = 'NEW') AS added, count(*) FILTER (WHERE change_type <> 'NEW') AS changed, count(DISTINCT scholarship_id) AS records FROM crawl_runs r LEFT JOIN changes c ON c.run_id = r.run_id GROUP BY 1, 2""",
    "record_details": """WITH c AS (SELECT scholarship_id, count(*) AS n, max(detected_at) AS t, array_to_string(list_sort(list(DISTINCT field_name)), ',') AS fields FROM changes GROUP BY 1)
        SELECT s.id, s.name, p.title AS page_title, coalesce(c.n, 0) AS n_changes, c.t AS last_change, coalesce(c.fields, '') AS fields FROM scholarships s LEFT JOIN c ON c.scholarship_id = s.id LEFT JOIN pages p ON p.page_id = s.primary_page_id""",
    "evidence": """SELECT s.id, p.page_id, CAST(strpos(p.text, s.name) AS INT) AS begin, substring(p.text, greatest(strpos(p.text, s.name) - 60, 1), strpos(p.text, s.name) - greatest(strpos(p.text, s.name) - 60, 1)) AS before, s.name AS quote, substring(p.text, strpos(p.text, s.name) + length(s.name), 60) AS after
        FROM scholarships s JOIN pages p ON p.page_id = s.primary_page_id WHERE strpos(p.text, s.name) > 0 AND s.name <> ''""",
    "source_load": """SELECT s.domain, s.tier, s.authority, count(r.id) AS n FROM sources s LEFT JOIN scholarships r ON r.official_domain = s.domain GROUP BY 1, 2, 3""",
    "search_grants": """SELECT id, name, provider, confidence FROM scholarships WHERE lower(coalesce(name, '')) LIKE '%grant%' OR lower(coalesce(provider, '')) LIKE '%grant%' OR lower(coalesce(benefit_text, '')) LIKE '%grant%' OR lower(coalesce(eligibility_text, '')) LIKE '%grant%'
        ORDER BY confidence DESC NULLS LAST, id LIMIT 200""",
}


def _is(text: str, pattern: str, cased: bool = False) -> str:
    pattern = pattern.replace("'", "''")
    return f"regexp_matches(coalesce({text}, ''), '{'' if cased else '(?i)'}{pattern}')"


def _table(text: str, table: dict[str, tuple[str, bool]]) -> str:
    rows = ", ".join(f"CASE WHEN {_is(text, p, cased)} THEN '{k}' END" for k, (p, cased) in table.items())
    return f"list_filter([{rows}], lambda x: x IS NOT NULL)"


def _joined(rows: str) -> str:
    return f"coalesce(array_to_string({rows}, ','), '')"


def _sum(text: str, table: tuple[tuple[str, float], ...]) -> str:
    return " + ".join(f"CASE WHEN {_is(text, p)} THEN CAST({w} AS DOUBLE) ELSE 0 END" for p, w in table)


def _dates() -> str:
    """Days of a text in four notations, each read from what the ones before it left."""
    month = "CASE WHEN regexp_matches({m}, '^[0-9]') THEN CAST({m} AS INT) ELSE CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(left({m}, 3))) + 2) / 3 AS INT) END"
    rest, steps, days = "coalesce(text, '')", [], []
    for pattern, (y, m, d) in St.NOTATIONS:
        rx = "(?i)" + pattern.replace("'", "''")
        got = f"list_transform(regexp_extract_all({rest}, '{rx}', 0), lambda x: try_cast(regexp_extract(x, '{rx}', {y}) || '-' || lpad(CAST({month.format(m=f"regexp_extract(x, '{rx}', {m})")} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(x, '{rx}', {d}), 2, '0') AS DATE))"
        days.append(f"list_filter({got}, lambda v: v IS NOT NULL AND year(v) BETWEEN 2000 AND 2100)")
        rest = f"regexp_replace({rest}, '{rx}', ' # ', 'g')"
    return f"WITH a AS (SELECT page_id, list_concat(list_concat({days[0]}, {days[1]}), list_concat({days[2]}, {days[3]})) AS d FROM pages) SELECT page_id, CAST(len(d) AS INT) AS n, list_min(d) AS first_day, list_max(d) AS last_day FROM a WHERE len(d) > 0"


_STRENGTH = f"""CASE WHEN {_is("line", L.NOT_CLOSING)} THEN 0 WHEN {_is("line", L.EXPLICIT_CLOSING)} THEN 3 WHEN {_is("line", L.CLOSING)} AND {_is("line", L.APPLYING)} THEN 2 WHEN {_is("line", L.CLOSING)} THEN 1
  WHEN {_is("line", L.APPLYING)} AND {_is("line", L.UNTIL)} THEN 2 ELSE 0 END"""
_OWN = "(" + _sum("anchor_text", L.ANCHOR_WEIGHTS) + " + " + _sum("url", L.ADDRESS_WEIGHTS) + ")"
_AROUND = "coalesce(" + ", ".join(f"CASE WHEN {_is('left(lower(context_text), 300)', p, True)} THEN {w} * CAST(0.6 AS DOUBLE) END" for p, w in L.ANCHOR_WEIGHTS[:5]) + ", 0)"
_AGAINST = " + ".join(f"CASE WHEN {_is('anchor_text', p)} OR {_is('url', p)} THEN CAST({w} AS DOUBLE) ELSE 0 END" for p, w in L.REJECTED_LINKS)
_CUES = " + ".join(f"least({most}, len(regexp_extract_all(lower(coalesce(text, '')), '{p.replace(chr(39), chr(39) * 2)}')) * CAST({w} AS DOUBLE))" for p, w, most in L.PAGE_CUES.values())
_HEAD = "lower(concat_ws(' ', title, left(coalesce(text, ''), 400)))"
_RULE = lambda i: "CASE " + " ".join(f"WHEN domain LIKE '%{r[0]}' THEN '{r[i]}'" for r in L.HOST_RULES) + f" ELSE '{('', 'UNKNOWN', 'T4')[i]}' END"
_YEARS = r"""coalesce(list_max(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '\b20\d\d\s*[-–/]\s*(?:20)?\d\d\b'), lambda x: (CAST(left(x, 4) AS INT) + 1) % 100 = CAST(right(x, 2) AS INT)), lambda x: CAST(left(x, 4) AS INT))),
  list_max(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)(?:academic (?:year|session)|session|batch|for the year|intake|ay)\s*:?\s*(20\d\d)', 1), lambda x: CAST(x AS INT))))"""
_ANY = "|".join(p for p, _ in L.CATEGORIES.values())
_ABSENT = (("gender", "gender IS NULL", L.GENDERS["FEMALE"][0]), ("age", "age_max IS NULL", r"\bage\b|aged|years of age"), ("income", "income_limit_text IS NULL", "income|earning|salary"), ("categories", "coalesce(len(categories), 0) = 0", _ANY))

RECORDS |= {
    "page_dates": _dates(),
    "closing_lines": f"WITH l AS (SELECT page_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM pages), s AS (SELECT page_id, {_STRENGTH} AS strength FROM l) SELECT page_id, strength, count(*) AS n FROM s WHERE strength > 0 GROUP BY 1, 2",
    "benefit_terms": f"""SELECT id, CASE {" ".join(f"WHEN {_is('coalesce(amount_text, benefit_text)', p)} THEN '{k}'" for k, p in St.PERIODS)} END AS period,
        CASE WHEN {_is("deadline_note", L.CLOSED_NOW)} THEN NULL WHEN {_is("deadline_note", L.ROLLING)} THEN 'rolling' WHEN {_is("deadline_note", L.OPEN_NOW)} THEN 'open' END AS open_window,
        CASE WHEN {_is("benefit_text", L.FIRST_PERSON, True)} THEN 'narrative' WHEN NOT {_is("benefit_text", L.TOPICS["benefit_text"])} THEN 'other topic' END AS off_topic FROM scholarships""",
    "record_groups": f"""WITH a AS (SELECT id, concat_ws(' ', name, eligibility_text) AS t, eligibility_text AS q, coalesce(categories, []) AS c FROM scholarships)
        SELECT id, {_joined(_table("t", L.CATEGORIES))} AS named, {_joined(_table("t", L.LEVELS))} AS levels, {_joined(_table("t", L.GENDERS))} AS genders, {_joined(f"list_filter(c, lambda v: list_contains({_table('q', L.CATEGORIES)}, v))")} AS kept FROM a""",
    "absences": " UNION ALL ".join(f"SELECT '{n}' AS field, count(*) FILTER (WHERE {c}) AS absent, count(*) FILTER (WHERE {c} AND {_is('eligibility_text', p)}) AS hinted FROM scholarships HAVING count(*) > 0" for n, c, p in _ABSENT),
    "cycle_of_pages": f"""WITH a AS (SELECT p.run_id, {_YEARS} AS y, CASE WHEN month(as_of) >= 6 THEN year(as_of) ELSE year(as_of) - 1 END AS now FROM pages p JOIN crawl_runs r USING (run_id))
        SELECT run_id, CASE WHEN y IS NULL THEN 'unknown' WHEN y >= now THEN 'current' ELSE 'stale' END AS cycle, count(*) AS n FROM a GROUP BY 1, 2""",
    "link_scores": f"WITH a AS (SELECT candidate_id, {_OWN} AS own, {_AROUND} AS around, {_AGAINST} AS against FROM discovery_candidates) SELECT candidate_id, round(greatest(0, least(1, own + CASE WHEN own < 0.45 THEN around ELSE 0 END + against)), 4) AS score FROM a",
    "page_kinds": f"SELECT page_id, round(least(1, (CASE WHEN {_is(_HEAD, L.PAGE_CUES['programme'][0], True)} THEN CAST(0.3 AS DOUBLE) ELSE 0 END + {_CUES}) * CASE WHEN length(coalesce(text, '')) < 300 THEN CAST(0.4 AS DOUBLE) ELSE 1 END), 3) AS kind FROM pages",
    "publishers": f"WITH a AS (SELECT domain, {_RULE(1)} AS rule_type, {_RULE(2)} AS rule_tier FROM sources) SELECT domain, rule_type, rule_tier, CASE rule_tier {' '.join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in L.AUTHORITY.items())} END AS rule_authority FROM a",
    "key_figures": """SELECT count(*) AS records, count(*) FILTER (WHERE verification_label = 'VERIFIED') AS verified, count(*) FILTER (WHERE verification_label = 'REVIEW_REQUIRED') AS to_review, count(*) FILTER (WHERE confidence >= 95) AS sure, count(*) FILTER (WHERE status = 'ACTIVE') AS active,
        count(*) FILTER (WHERE status = 'EXPIRING_SOON') AS expiring, count(*) FILTER (WHERE status = 'EXPIRED') AS expired, count(*) FILTER (WHERE status = 'NO_LONGER_VERIFIABLE') AS lost, count(closing_date) AS dated, count(DISTINCT source_type) AS source_types, round(avg(confidence), 1) AS mean_confidence FROM scholarships""",
    "audit": """WITH m AS (SELECT 'records' AS metric, count(*) AS value, 20 AS threshold FROM scholarships UNION ALL SELECT 'linked', count(official_url), 15 FROM scholarships UNION ALL SELECT 'verified', count(*) FILTER (WHERE verification_label = 'VERIFIED'), 10 FROM scholarships
        UNION ALL SELECT 'source_types', count(DISTINCT source_type), 3 FROM scholarships UNION ALL SELECT 'expired', count(*) FILTER (WHERE status IN ('EXPIRED', 'NO_LONGER_VERIFIABLE')), 2 FROM scholarships UNION ALL SELECT 'changed', count(DISTINCT scholarship_id) FILTER (WHERE change_type = 'FIELD_CHANGED'), 2 FROM changes)
        SELECT metric, value, CAST(threshold AS BIGINT) AS threshold, value >= threshold AS met FROM m""",
    "recently_changed": "SELECT run_id, count(DISTINCT scholarship_id) AS n FROM changes WHERE change_type <> 'NEW' AND detected_at >= (SELECT max(detected_at) FROM changes) - INTERVAL 7 DAY GROUP BY 1",
    "run_overview": """SELECT run_id, label, as_of, (SELECT count(*) FROM pages p WHERE p.run_id = r.run_id) AS pages, (SELECT count(*) FROM pages p WHERE p.run_id = r.run_id AND NOT status_code BETWEEN 200 AND 299) AS failed,
        (SELECT count(*) FROM discovery_candidates c WHERE c.run_id = r.run_id) AS found FROM crawl_runs r""",
    "report_figures": """SELECT 'records' AS metric, count(*) AS n FROM scholarships UNION ALL SELECT 'verified', count(*) FROM scholarships WHERE verification_label = 'VERIFIED' UNION ALL SELECT 'sure', count(*) FROM scholarships WHERE confidence >= 95 UNION ALL SELECT 'field_changes', count(*) FROM changes WHERE change_type = 'FIELD_CHANGED'
        UNION ALL SELECT 'status_changes', count(*) FROM changes WHERE change_type = 'STATUS_CHANGED' UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'unsafe_pages', count(*) FROM pages WHERE NOT tls_verified UNION ALL SELECT 'candidates', count(*) FROM discovery_candidates UNION ALL SELECT 'rejected', count(*) FROM discovery_candidates WHERE status = 'REJECTED'""",
    "search_totals": """SELECT source_type, count(*) AS n FROM scholarships WHERE lower(concat_ws(chr(0), coalesce(name, ''), coalesce(provider, ''), coalesce(benefit_text, ''), coalesce(eligibility_text, ''))) LIKE '%grant%' GROUP BY 1""",
    "missing_records": f"""WITH seen AS (SELECT DISTINCT {CANON} AS u FROM pages WHERE run_id = 8) SELECT id, last_run_id, coalesce(miss_count, 0) + 1 AS miss_count FROM scholarships WHERE official_url IS NOT NULL AND {CANON.replace("coalesce(url, final_url)", "official_url")} NOT IN (SELECT u FROM seen WHERE u IS NOT NULL)""",
    "name_places": f"""WITH a AS (SELECT s.id, {_FOLD.format("s.name")} AS n, {_FOLD.format("p.title")} AS ti, {_FOLD.format("p.text")} AS te FROM scholarships s LEFT JOIN pages p ON p.page_id = s.primary_page_id)
        SELECT id, CASE WHEN n = '' THEN 'missing' WHEN contains(ti || ' ' || left(te, 500), n) THEN 'title' WHEN contains(te, n) THEN 'body' ELSE 'missing' END AS place FROM a""",
    "trusted_addresses": f"""WITH a AS (SELECT id, regexp_replace(lower(regexp_extract(official_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS h, lower(official_domain) AS d FROM scholarships)
        SELECT id, coalesce(h = d OR {_DOMAIN.format("h")} = {_DOMAIN.format("d")}, FALSE) AS trusted FROM a""",
}
_LINKS = """SELECT page_id, coalesce(final_url, url) AS page_url, CAST(i AS INT) AS place, json_extract_string(links_json, '$[' || (i - 1) || '].u') AS u, json_extract_string(links_json, '$[' || (i - 1) || '].t') AS t
  FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(links_json) AS BIGINT))) AS i FROM pages WHERE links_json IS NOT NULL)"""
_FORM = lambda c: CANON.replace("coalesce(url, final_url)", c)
_LABEL = lambda c: _DOMAIN.format(_HOST.format(f"lower({c})"))

RECORDS |= {
    "page_links": f"SELECT page_id, place, u AS url, t AS anchor FROM ({_LINKS}) WHERE u IS NOT NULL",
    "application_links": f"""WITH l AS ({_LINKS}), s AS (SELECT page_id, place, u, {_sum("t", L.APPLY_ANCHORS)} + {_sum("u", (L.APPLY_ADDRESS,))} AS base, {_LABEL("u")} = {_LABEL("page_url")} AS inside
        FROM l WHERE u IS NOT NULL AND NOT {_is("u", L.NO_APPLICATION)} AND {_FORM("u")} IS DISTINCT FROM {_FORM("page_url")}),
      w AS (SELECT page_id, place, u, round(base + CASE WHEN inside THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 4) AS score FROM s WHERE base > 0)
      SELECT page_id, arg_min(u, (-score, place)) AS url, max(score) AS score FROM w WHERE score >= 0.5 GROUP BY 1""",
}
