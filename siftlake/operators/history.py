"""Validity periods of changing attributes by presence bitmaps over numbered snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Snapshots that one word of a bitmap holds; longer histories take several words.
WORD = 60


def presence_bits(spans: DataFrame, *entity: str) -> DataFrame:
    """Bitmaps of spans (entity columns, value, first, until: ordinals of snapshots, until excluded): entity, value, word, bits.

    One bit for each snapshot in which the value of the entity holds. The aggregate is a bit-or with map-side combine, so
    repeated rows and hot entities cost nothing.
    """
    word = F.explode(F.sequence(F.floor(F.col("first") / WORD), F.floor((F.col("until") - 1) / WORD)))
    low = F.greatest(F.col("first") - F.col("word") * WORD, F.lit(0)).cast("int")
    high = F.least(F.col("until") - F.col("word") * WORD, F.lit(WORD)).cast("int")
    mask = F.expr("shiftleft(1L, hi) - shiftleft(1L, lo)")
    at = spans.where("first < until").withColumn("word", word).withColumn("lo", low).withColumn("hi", high).withColumn("m", mask)
    return at.groupBy(*entity, "value", "word").agg(F.bit_or("m").alias("bits"))


def bit_runs(bits: DataFrame, *entity: str) -> DataFrame:
    """Runs of consecutive bits: entity, value, first, last (ordinals, both included). Runs that meet at a word's end are one."""
    i = F.sequence(F.lit(0), F.lit(WORD - 1))
    one = lambda x, k: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0
    begins = F.col("bits").bitwiseAND(F.bitwise_not(F.shiftleft("bits", 1)))
    ends = F.col("bits").bitwiseAND(F.bitwise_not(F.shiftrightunsigned("bits", 1)))
    pairs = F.arrays_zip(F.filter(i, lambda k: one(begins, k)).alias("b"), F.filter(i, lambda k: one(ends, k)).alias("e"))
    runs = bits.select(*entity, "value", "word", F.explode(pairs).alias("p")).select(*entity, "value", (F.col("word") * WORD + F.col("p.b")).alias("first"), (F.col("word") * WORD + F.col("p.e")).alias("last"))
    w = W.partitionBy(*entity, "value").orderBy("first")
    new = F.when(F.col("first") == F.lag("last").over(w) + 1, 0).otherwise(1)
    island = F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))
    return runs.withColumn("new", new).withColumn("island", island).groupBy(*entity, "value", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def date_text(value: Column) -> Column:
    """A date in any of the log's notations as yyyy-MM-dd; null where it is none."""
    v = F.trim(value)
    iso = F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd")
    forms = [F.when(v.rlike(rx), F.try_to_date(v, f)) for rx, f in ((r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^[A-Za-z]{3,} \d{1,2}, \d{4}$", "MMMM d, yyyy"), (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"))]
    return F.date_format(F.coalesce(F.when(v.rlike(r"^\d{4}-\d\d-\d\d"), iso), *forms), "yyyy-MM-dd")


def status_text(value: Column) -> Column:
    """A status in its stored form: upper case, words joined by _; null where it is blank."""
    return F.nullif(F.upper(F.regexp_replace(F.trim(value), r"[\s_-]+", "_")), F.lit(""))


def attribute_history(records: DataFrame, log: DataFrame, runs: DataFrame) -> DataFrame:
    """scholarship_id, field_name, value_text, from_run, to_run: every version of closing_date and status of every record.

    records: id, first_run_id, closing_date, status (the present values); log: the change log; runs: run_id, started_at,
    finished_at (the calendar, one row for each run). Of an entry without run_id the run is the one whose time holds
    detected_at, or if there is none the last one begun before it. Of several entries of a record, field and run the
    last one counts, so repeated ones change nothing. The value before the first entry is that entry's old value, without
    entries the present value. A period without a value gives no version but ends the one before; another notation of
    a value is the same value. A record without first_run_id starts with the first run. Log entries of records that are
    not in records, of other fields, and repeated ids beyond the first row give nothing; nor does an empty calendar.
    """
    calendar = sorted(tuple(r) for r in runs.where("run_id is not null").groupBy("run_id").agg(F.min("started_at").alias("started_at")).collect())
    if not calendar:
        return records.select(F.col("id").alias("scholarship_id"), *[F.lit("").alias(c) for c in ("field_name", "value_text")], *[F.lit(0).cast("bigint").alias(c) for c in ("from_run", "to_run")]).limit(0)
    ids = F.array(*[F.lit(i).cast("bigint") for i, _ in calendar])
    starts = F.array(*[F.lit(t) for _, t in calendar])
    n = F.lit(len(calendar))
    value = lambda c: F.when(F.col("field_name") == "closing_date", date_text(F.col(c))).otherwise(status_text(F.col(c)))
    began = F.size(F.filter(starts, lambda t: t <= F.col("detected_at")))
    place = F.when(F.col("run_id").isNotNull(), F.array_position(ids, F.col("run_id"))).otherwise(began)
    events = (
        log.where(F.col("field_name").isin("closing_date", "status"))
        .select(F.col("scholarship_id").alias("id"), "field_name", "run_id", "detected_at", "change_id", value("old_value").alias("old"), value("new_value").alias("new"))
        .withColumn("at", place)
        .where("at > 0 and id is not null")
        .groupBy("id", "field_name", "at")
        .agg(F.max(F.struct("detected_at", "change_id", "new")).alias("l"), F.min(F.struct("detected_at", "change_id", "old")).alias("f"))
    )
    chain = events.groupBy("id", "field_name").agg(F.sort_array(F.collect_list(F.struct("at", F.col("l.new").alias("new"), F.col("f.old").alias("old")))).alias("c"))
    present = records.where("id is not null").groupBy("id").agg(F.max(F.struct("first_run_id", "closing_date", "status")).alias("r"))
    fields = F.explode(F.array(F.struct(F.lit("closing_date").alias("field_name"), F.date_format("r.closing_date", "yyyy-MM-dd").alias("now")), F.struct(F.lit("status").alias("field_name"), status_text(F.col("r.status")).alias("now"))))
    base = present.select("id", F.col("r.first_run_id").alias("first_run"), fields.alias("f")).select("id", "first_run", "f.field_name", "f.now")
    states = base.join(chain, ["id", "field_name"], "left")
    start = F.greatest(F.coalesce(F.array_position(ids, F.col("first_run")), F.lit(1)).cast("int"), F.lit(1))
    c = F.coalesce("c", F.array().cast("array<struct<at:int,new:string,old:string>>"))
    head = F.struct(start.alias("a"), F.coalesce(F.try_element_at(c, F.lit(1))["at"].cast("int"), n + 1).alias("b"), F.when(F.size(c) > 0, F.try_element_at(c, F.lit(1))["old"]).otherwise(F.col("now")).alias("v"))
    tail = F.transform(c, lambda x, i: F.struct(x["at"].cast("int").alias("a"), F.coalesce(F.try_element_at(c, i + 2)["at"].cast("int"), n + 1).alias("b"), x["new"].alias("v")))
    spans = states.select("id", "field_name", F.explode(F.concat(F.array(head), tail)).alias("s")).where("s.v is not null")
    spans = spans.select("id", "field_name", F.col("s.v").alias("value"), F.col("s.a").alias("first"), F.col("s.b").alias("until"))
    got = bit_runs(presence_bits(spans, "id", "field_name"), "id", "field_name")
    end = F.when(F.col("last") >= n, F.lit(-1)).otherwise(F.element_at(ids, F.col("last").cast("int")))
    return got.select(F.col("id").alias("scholarship_id"), "field_name", F.col("value").alias("value_text"), F.element_at(ids, F.col("first").cast("int")).alias("from_run"), end.cast("long").alias("to_run"))
