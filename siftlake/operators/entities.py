"""Entity resolution and change capture of records: matching, field differences, versions of evidence, duplicates."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType

from siftlake.functions import lexicon as L
from siftlake.functions import spans as S
from siftlake.functions import stated
from siftlake.functions.alike import alike_pairs
from siftlake.functions.names import distinctive_tokens, folded, name_key, record_key
from siftlake.functions.urls import canonical_url, host_of, registered_domain
from siftlake.operators.joins import by_key, shard_of, shards, whole_groups

#: Similarities from which names at one domain are one, keys of duplicates are one and providers are compatible, and below
#: which a name or text counts as changed.
SAME_NAME, SAME_KEY, SAME_PROVIDER, NAME_CHANGED, TEXT_CHANGED = 92.0, 95.0, 70.0, 88.0, 96.0
#: Pages of a site that are looked through at once, and names of a block that are compared with as many at once.
SITE_PAGES, BLOCK_NAMES = 10_000, 4_000

FIELDS = {"name": "name", "provider": "name", "benefit_text": "text", "eligibility_text": "text", "deadline_note": "text", "income_limit_text": "text", "official_url": "url", "confidence": "number", "age_min": "plain", "age_max": "plain", "gender": "plain", "closing_date": "plain", "categories": "set"}


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """similarity() of two texts, 0 where one is missing."""
    return pd.Series([S.similarity(x, y) if isinstance(x, str) and isinstance(y, str) else 0.0 for x, y in zip(a, b)])


def matched(incoming: DataFrame, known: DataFrame, order: str | None = None) -> DataFrame:
    """in_id, id, rule of every incoming record (id, name, official_url, official_domain) that is a known one.

    Rules in order: the same address, the same canonical address, the same key, the same domain and a like name; the first that
    fits counts, of several records the least id. The last compares names only within a domain and a first letter of their key,
    a key's words in order: distinct names, in tiles of two shards of such a block by their counts of letters. Rows of equal
    keys or names are not multiplied. Null addresses and names match nothing.

    With `order`, a numeric column of few values such as the first run, only known records that come before the incoming one count,
    so both sides may be the same table; a null there comes neither before nor after.
    """
    side = lambda df, x, at: df.select(F.col("id").alias(x), at.cast("double").alias("at"), F.col("official_url").alias("url"), canonical_url(F.col("official_url")).alias("canon"), F.when(name_key(F.col("name")) != "", record_key(F.col("name"), F.lower("official_domain"))).alias("key"), registered_domain(F.lower("official_domain")).alias("domain"), F.array_join(F.array_sort(F.split(name_key(F.col("name")), " ")), " ").alias("words"))
    a, b = side(incoming, "in_id", F.col(order) if order else F.lit(1)), side(known, "id", F.col(order) if order else F.lit(0))
    by_time = lambda df, *on: df.groupBy(*on, "at").agg(F.min("id").alias("id")).groupBy(*on).agg(F.collect_list(F.struct("at", "id")).alias("known"))
    earlier = F.array_min(F.transform(F.filter("known", lambda k: k["at"] < F.col("at")), lambda k: k["id"]))
    meet = lambda rule, groups, *on: a.join(groups, list(on)).select("in_id", earlier.alias("id"), F.lit(rule).alias("rule")).where("id is not null")
    by = lambda rule, on: meet(rule, by_time(b.where(F.col(on) != ""), on), on)
    named = lambda df, last, first: df.where("words <> '' and domain is not null").select("domain", "words", last.alias("last"), first.alias("first"))
    none = F.lit(None).cast("double")
    names = named(a, F.col("at"), none).unionAll(named(b, none, F.col("at"))).groupBy("domain", "words").agg(F.max("last").alias("last"), F.min("first").alias("first"))
    same = names.where("last > first").select("domain", "words", F.col("words").alias("other"))
    like = same.unionAll(_like_names(names)).join(by_time(b, "domain", "words").withColumnRenamed("words", "other"), ["domain", "other"])
    like = like.select("domain", "words", F.explode("known").alias("k")).select("domain", "words", "k.at", "k.id")
    found = by(1, "url").unionAll(by(2, "canon")).unionAll(by(3, "key")).unionAll(meet(4, by_time(like, "domain", "words"), "domain", "words"))
    return found.groupBy("in_id").agg(F.min(F.struct("rule", "id")).alias("m")).select("in_id", "m.id", "m.rule")


def _like_names(names: DataFrame) -> DataFrame:
    """domain, words, other: like names (domain, words, last, first) of one domain and first letter, of which `other` was first known before the last time that `words` came in."""
    blocks = names.withColumn("block", F.concat_ws("\n", F.substring("words", 1, 1), "domain"))
    cut = blocks.join(F.broadcast(shards(blocks, "block", BLOCK_NAMES)), "block", "left").withColumn("i", shard_of(F.col("words")))
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("shards", F.lit(1)) - 1)))
    tiles = cut.select(F.concat_ws("\n", F.least("i", "k").cast("string"), F.greatest("i", "k").cast("string"), "block").alias("tile"), (F.col("i") > F.col("k")).alias("second"), (F.col("i") == F.col("k")).alias("alone"), "domain", "words", "last", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "tile"):
            x = pdf[~pdf["second"]].reset_index(drop=True)
            y = x if pdf["alone"].iloc[0] else pdf[pdf["second"]].reset_index(drop=True)
            pairs = list(alike_pairs(list(x["words"]), None if y is x else list(y["words"]), SAME_NAME)) if len(pdf) > 1 else []
            if pairs:
                i, k = map(list, zip(*pairs))
                for one, two in ((x.iloc[i], y.iloc[k]), (y.iloc[k], x.iloc[i])):
                    fits = one["last"].to_numpy(float) > two["first"].to_numpy(float)
                    yield pd.DataFrame({"domain": one["domain"].to_numpy()[fits], "words": one["words"].to_numpy()[fits], "other": two["words"].to_numpy()[fits]})

    return by_key(tiles, "tile").mapInPandas(run, "domain string, words string, other string")


def _differs(kind: str, old: Column, new: Column) -> Column:
    present = old.isNotNull() & new.isNotNull()
    if kind in ("name", "text"):
        changed = (old != new) & (likeness(folded(old), folded(new)) < (NAME_CHANGED if kind == "name" else TEXT_CHANGED))
    elif kind == "url":
        changed = canonical_url(old) != canonical_url(new)
    elif kind == "number":
        changed = F.abs(old.cast("double") - new.cast("double")) > 1e-6
    elif kind == "set":
        changed = F.array_sort(F.from_json(old, "array<string>")) != F.array_sort(F.from_json(new, "array<string>"))
    else:
        changed = old != new
    return F.when(present, changed).otherwise(old.isNotNull() | new.isNotNull())


def field_changes(old: DataFrame, new: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """id, field_name, change_type, old_value, new_value: what changed between two states of the records.

    NEW for a record not seen before; FIELD_ADDED, FIELD_UNSUPPORTED and FIELD_CHANGED for fields; STATUS_CHANGED for the status. Names
    and texts may differ in spelling, addresses in form, numbers by rounding, sets in order. Records that are gone give
    nothing. One shuffle by id; a null is no value.
    """
    fields = {c: k for c, k in (fields or FIELDS).items() if c in old.columns and c in new.columns}
    kinds = dict(new.dtypes)
    text = lambda c: F.to_json(F.col(c)) if kinds[c].startswith("array") else F.col(c).cast("string")
    pack = lambda df, x: df.select("id", F.col("status").alias(f"{x}_status"), F.create_map(*[v for c in fields for v in (F.lit(c), text(c))]).alias(x))
    j = pack(new, "b").join(pack(old, "a").withColumn("known", F.lit(True)), "id", "left")
    fresh = j.where("known is null").select("id", F.lit(None).cast("string").alias("field_name"), F.lit("NEW").alias("change_type"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value"))
    both = j.where("known")
    status = both.where("not (a_status <=> b_status)").select("id", F.lit("status").alias("field_name"), F.lit("STATUS_CHANGED").alias("change_type"), F.col("a_status").alias("old_value"), F.col("b_status").alias("new_value"))
    long = both.select("id", "a", F.explode("b").alias("field_name", "new_value")).select("id", "field_name", F.col("a")[F.col("field_name")].alias("old_value"), "new_value").where("not (old_value <=> new_value)")
    differs = F.coalesce(*[F.when(F.col("field_name").isin(*[c for c, k in fields.items() if k == kind]), _differs(kind, F.col("old_value"), F.col("new_value"))) for kind in sorted(set(fields.values()))])
    kind = F.when(F.col("old_value").isNull(), "FIELD_ADDED").when(F.col("new_value").isNull(), "FIELD_UNSUPPORTED").otherwise("FIELD_CHANGED")
    return fresh.unionAll(status).unionAll(long.where(differs).select("id", "field_name", kind.alias("change_type"), "old_value", "new_value"))


def corrections(changes: DataFrame, old_pages: DataFrame, new_pages: DataFrame) -> DataFrame:
    """changes (with page_id of either state as old_page_id, new_page_id) with correction: true where the page's text is the same, so that only its reading changed."""
    h = F.xxhash64(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")))
    side = lambda df, x: df.select(F.col("page_id").alias(f"{x}_page_id"), h.alias(f"{x}_hash"))
    j = changes.join(side(old_pages, "old"), "old_page_id", "left").join(side(new_pages, "new"), "new_page_id", "left")
    return j.withColumn("correction", F.coalesce(F.col("old_hash") == F.col("new_hash"), F.lit(False))).drop("old_hash", "new_hash")


def evidence_versions(evidence: DataFrame) -> DataFrame:
    """evidence (id, field, run_id, ...) with is_current and until_run: of each record and field the rows of its last run are current, others end with the next run."""
    runs = evidence.select("id", "field", "run_id").distinct().withColumn("until_run", F.lead("run_id").over(W.partitionBy("id", "field").orderBy("run_id")))
    return evidence.join(runs, ["id", "field", "run_id"]).withColumn("is_current", F.col("until_run").isNull())


def duplicate_keys(records: DataFrame) -> DataFrame:
    """retired, kept: records whose name keys are alike and whose providers are compatible or missing, or whose sources are both of the first tier.

    Of a group that hangs together the surest record is kept, of equal ones the least id. Records meet by the sorted words of
    their key with one word left out, which two keys of the same number of words that are alike in all but one share, and as a
    whole; equal keys are compared with the first of them only, so a hot key costs its size.
    """
    words = F.array_sort(F.split(name_key(F.col("name")), " "))
    base = records.where("id is not null").select("id", F.array_join(words, " ").alias("key"), "provider", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), (F.col("source_tier") == "T1").alias("first")).where("key <> ''")
    provider = F.coalesce(folded(F.col("provider")), F.lit(""))
    groups = base.groupBy("key", provider.alias("of"), F.coalesce("first", F.lit(False)).alias("first")).agg(F.max(F.struct("confidence", (-F.col("id")).alias("n"))).alias("best")).select("key", "of", "first", F.col("best.confidence").alias("confidence"), (-F.col("best.n")).alias("id"))
    parts = F.transform(F.split("key", " "), lambda w, i: F.concat(F.array_join(F.filter(F.split("key", " "), lambda x, k: k != i), " "), F.lit("|")))
    keys = groups.withColumn("block", F.explode(F.array_distinct(F.concat(F.array("key"), F.filter(parts, lambda p: p != "|")))))
    lead = keys.groupBy("block").agg(F.min(F.struct("id", "key", "of", "first", "confidence")).alias("l"))
    pairs = keys.join(lead, "block").where("id <> l.id")
    alike = (likeness("key", "l.key") >= SAME_KEY) & ((F.col("of") == "") | (F.col("l.of") == "") | (likeness("of", "l.of") >= SAME_PROVIDER) | F.col("first") & F.col("l.first"))
    links = pairs.where(alike).select("id", "confidence", F.col("l.id").alias("other"), F.col("l.confidence").alias("other_confidence")).distinct()
    worse = (F.col("confidence") < F.col("other_confidence")) | (F.col("confidence") == F.col("other_confidence")) & (F.col("id") > F.col("other"))
    across = links.select(F.when(worse, F.col("id")).otherwise(F.col("other")).alias("retired"), F.when(worse, F.col("other")).otherwise(F.col("id")).alias("kept"))
    inside = base.join(groups.select("key", "of", F.col("id").alias("kept"), "first"), (base.key == groups.key) & (provider == F.col("of")) & (F.coalesce(base["first"], F.lit(False)) == groups["first"])).where("id <> kept").select(F.col("id").alias("retired"), "kept")
    return inside.unionAll(across).groupBy("retired").agg(F.min("kept").alias("kept"))


def missing_records(records: DataFrame, pages: DataFrame, run: int) -> DataFrame:
    """id, last_run_id, miss_count: records whose address the run did not fetch, with one more miss; values are kept."""
    seen = pages.where(F.col("run_id") == run).select(canonical_url(F.coalesce("url", "final_url")).alias("canon")).where("canon is not null").distinct()
    rows = records.where("official_url is not null").withColumn("canon", canonical_url(F.col("official_url")))
    return rows.join(seen, "canon", "left_anti").select("id", "last_run_id", (F.coalesce("miss_count", F.lit(0)) + 1).alias("miss_count"))


def name_places(records: DataFrame, pages: DataFrame) -> DataFrame:
    """id, place: where a record's own page names it: title (with the first 500 letters), body or missing."""
    j = records.select("id", "name", "primary_page_id").join(pages.select(F.col("page_id").alias("primary_page_id"), "title", "text"), "primary_page_id", "left")
    name, text = folded(F.col("name")), folded(F.col("text"))
    head = F.concat_ws(" ", folded(F.col("title")), F.substring(text, 1, 500))
    return j.select("id", F.when(name == "", "missing").when(F.contains(head, name), "title").when(F.contains(text, name), "body").otherwise("missing").alias("place"))


def trusted_addresses(records: DataFrame) -> DataFrame:
    """id, trusted: whether a record's address lies on its official domain or on the same registered domain."""
    host, domain = host_of(F.col("official_url")), F.lower("official_domain")
    return records.select("id", F.coalesce((host == domain) | (registered_domain(host) == registered_domain(domain)), F.lit(False)).alias("trusted"))


def record_quotes(records: DataFrame) -> DataFrame:
    """claim_id, page_id, field, value, quote: what records state of their own page, to be grounded there."""
    texts = [("name", "name"), ("provider", "provider"), ("benefit_text", "benefit_text"), ("eligibility_text", "eligibility_text"), ("deadline_note", "deadline_note")]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), F.col(c).alias("quote")) for i, (f, c) in enumerate(texts)]))
    r = records.where("primary_page_id is not null").select("id", "primary_page_id", rows.alias("x")).where("x.quote is not null")
    return r.select((F.col("id") * len(texts) + F.col("x.i")).alias("claim_id"), F.col("primary_page_id").alias("page_id"), "x.field", F.col("x.quote").alias("value"), "x.quote")


def corroborated(records: DataFrame, pages: DataFrame) -> DataFrame:
    """id, page_id, day: the closing day that another page of a record's own site states for it, where the record has none.

    The other page must hold all distinctive words of the record's name, the longest as a whole word; of several the least page_id
    counts. Pages go to shards of their site by their text and meet the site's records there, so no two sides are multiplied.
    """
    own = registered_domain(F.lower("official_domain"))
    lack = records.where("closing_date is null and name is not null").select(own.alias("site"), "id", F.col("primary_page_id").alias("page_id"), distinctive_tokens(F.col("name")).alias("words")).where("site is not null and id is not null and size(words) > 0")
    lack = lack.withColumn("words", F.array_join(F.array_distinct(F.array_sort("words", lambda a, b: F.length(b) - F.length(a))), " "))
    host = registered_domain(host_of(F.coalesce("final_url", "url")))
    rows = pages.where("text is not null and page_id is not null").select(host.alias("site"), "page_id", "text").where("site is not null")
    split = F.broadcast(shards(rows.select("site"), "site", SITE_PAGES))
    key = lambda shard: F.concat_ws("\n", shard.cast("string"), "site").alias("key")
    read = rows.where(stated.speaks_of(F.col("text"), L.CLOSING)).join(split, "site", "left").select(key(shard_of(F.col("text"))), F.lit(0).cast("bigint").alias("id"), "page_id", F.lit(False).alias("own"), "text", F.lit(None).cast("string").alias("words"))
    asked = lack.join(split, "site", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("shards", F.lit(1)) - 1))).select(key(F.col("shard")), "id", F.coalesce("page_id", F.lit(0)), F.col("page_id").isNotNull(), F.lit(None).cast("string"), "words")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, "key"):
            found = _stated_days(pdf[pdf["words"].isna()], pdf[pdf["words"].notna()])
            if found:
                yield pd.DataFrame(found, columns=["id", "page_id", "day"])

    found = by_key(read.unionAll(asked), "key").mapInPandas(run, "id bigint, page_id bigint, day date")
    return found.groupBy("id").agg(F.min(F.struct("page_id", "day")).alias("m")).select("id", "m.page_id", "m.day")


def _stated_days(pages: pd.DataFrame, records: pd.DataFrame) -> list[tuple[int, int, dt.date]]:
    """id, page_id, day: the least of a site's pages but the record's own that holds its words, the first of them as a whole word, and states a closing day.

    Texts are looked up by their words, each text once however many pages have it; dates are read only in texts that hold some
    record's words.
    """
    at: dict[str, list[int]] = {}
    for page, text in zip(pages["page_id"], pages["text"]):
        at.setdefault(text, []).append(page)
    asked = [w.split(" ") for w in records["words"]]
    if not at or not asked:
        return []
    texts, ids = list(at), [sorted(set(p)) for p in at.values()]
    tokens: dict[str, set[int]] = {}
    for i, text in enumerate(texts):
        for token in set(re.findall(r"[a-z0-9]{4,}", text.lower())):
            tokens.setdefault(token, set()).add(i)
    words = {w for ws in asked for w in ws}
    sizes, holds = sorted({len(w) for w in words}), {}
    for token, where in tokens.items():
        for w in {token[k : k + n] for n in sizes for k in range(len(token) - n + 1)} & words:
            holds.setdefault(w, set()).update(where)
    none: set[int] = set()

    @cache
    def day(i: int) -> dt.date | None:
        return next((d.day for d in S.days(texts[i]) if d.kind == "closing"), None)

    out = []
    for record, page, own, ws in zip(records["id"], records["page_id"], records["own"], asked):
        sets = [tokens.get(ws[0], none), *(holds.get(w, none) for w in ws[1:])]
        hits = set.intersection(*sorted(sets, key=len)) if all(sets) else none
        if best := min(((p, i) for i in hits for p in ids[i][:2] if not (own and p == page) and day(i)), default=None):
            out.append((record, best[0], day(best[1])))
    return out
