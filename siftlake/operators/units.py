"""Amounts stated in different currencies, scales and periods as whole units of one currency a year, or in all."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.quantity import currency_of, period_of, read
from siftlake.functions.trees import Forest
from siftlake.operators.sampling import bounded_sample
from siftlake.session import cut

#: Rows at most on which the forests for missing units are fitted (a sample by hash of the id), and the calibrated
#: confidence from which a missing unit is filled in; below it the row goes to review.
TRAIN_ROWS, CONFIDENT = 20_000, 0.8

FIELDS = ("id", "name", "provider", "source_type", "source_tier", "amount_text", "amount_currency", "amount_period", "income_limit_text", "gender", "age_min", "age_max")
_SCHEMA = "id bigint, quantity string, low decimal(38,6), high decimal(38,6), is_range boolean, is_bound boolean, currency string, period string, currency_from string, period_from string, confidence double"


def _code(value: object, bins: int = 61) -> int:
    return 0 if value is None or value != value else 1 + zlib.crc32(str(value).strip().lower().encode()) % bins


def features(pdf: pd.DataFrame, quantity: str, low: list, high: list) -> np.ndarray:
    """Binned features of rows: magnitude, trailing zeros, source, provider, kind of award, neighbouring fields."""
    digits = [f"{int(v)}" for v in high]
    cols = [
        [min(62, max(0, int(4 * np.log10(max(float(v), 1e-3))) + 12)) for v in high],
        [len(d) - len(d.rstrip("0")) for d in digits],
        [int(a != b) for a, b in zip(low, high)],
        [_code(v) for v in pdf["source_type"]],
        [_code(v) for v in pdf["source_tier"]],
        [_code(v) for v in pdf["provider"]],
        [_code(" ".join(str(v or "").lower().split()[2:4])) for v in pdf["name"]],
        [_code("overseas" in str(v or "").lower()) for v in pdf["name"]],
        [_code(v) for v in pdf["gender"]],
        [0 if v is None or v != v else min(62, 1 + int(v)) for v in pdf["age_max"]],
        [_code(currency_of(v)) for v in (pdf["amount_currency"] if quantity == "amount" else pdf["amount_text"])],
        [_code(period_of(v)) for v in pdf["amount_period" if quantity == "amount" else "amount_text"]],
    ]
    return np.array(cols, np.uint8).T.reshape(len(pdf), len(cols))


def _parsed(pdf: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame, list]]:
    """The rows of a batch that state a figure, for each quantity, with what was read."""
    for quantity, text in (("amount", "amount_text"), ("income", "income_limit_text")):
        got = [read(t) for t in pdf[text]]
        keep = [i for i, q in enumerate(got) if q is not None]
        if keep:
            yield quantity, pdf.iloc[keep].reset_index(drop=True), [got[i] for i in keep]


def fit_units(records: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, Forest]:
    """Forests that tell the currency and the period of an amount from its magnitude, source, kind and neighbouring fields.

    Labels are what texts and columns state; the features that give the label away are blanked in half of the rows, so
    that the trees work with and without them. The sample is bounded and the same at any partitioning.
    """
    sample = bounded_sample(records.select(*FIELDS), "id", rows, F.col("amount_text").isNotNull())
    models: dict[str, Forest] = {}
    for _, pdf, got in _parsed(sample.assign(income_limit_text=None)):
        x = features(pdf, "amount", [q.low for q in got], [q.high for q in got])
        x[::2, -2:] = 0
        for unit, label in (("currency", [q.currency or currency_of(v) for q, v in zip(got, pdf["amount_currency"])]), ("period", [q.period or period_of(v) for q, v in zip(got, pdf["amount_period"])])):
            known = [i for i, v in enumerate(label) if v]
            if known:
                models[unit] = Forest().fit(x[known], np.array([label[i] for i in known]))
    return models


def stated_units(records: DataFrame, models: dict[str, Forest]) -> DataFrame:
    """Each figure that a record states, with its units and where they come from: text, column, rule or forest.

    The text's word counts before the column's. An income without a period is yearly and without a currency in
    rupees (rule). What is still missing comes from the forests, with their calibrated confidence. Texts of more than two
    figures have confidence 0: which of them is meant is for a reader to tell. Null, empty and figureless texts give no
    row; repeated records give repeated rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for quantity, part, got in _parsed(pdf):
                out: dict[str, list] = {"currency": [], "period": []}
                source: dict[str, list] = {"currency": [], "period": []}
                sure = np.ones(len(part))
                for unit, column, of, rule in (("currency", "amount_currency", currency_of, "INR"), ("period", "amount_period", period_of, "per_year")):
                    for q, v in zip(got, part[column]):
                        said = getattr(q, unit)
                        beside = of(v) if quantity == "amount" else None
                        out[unit].append(said or beside or (rule if quantity == "income" else None))
                        source[unit].append("text" if said else "column" if beside else "rule" if quantity == "income" else None)
                    if (lack := [i for i, v in enumerate(out[unit]) if v is None]) and unit in models:
                        x = features(part.iloc[lack], quantity, [got[i].low for i in lack], [got[i].high for i in lack])
                        for i, v, p in zip(lack, *models[unit].predict(x)):
                            out[unit][i], source[unit][i] = v, "forest"
                            sure[i] = min(sure[i], p)
                    for i in [i for i, v in enumerate(out[unit]) if v is None]:
                        sure[i] = 0
                sure[[i for i, q in enumerate(got) if q.figures > 2]] = 0
                yield pd.DataFrame({
                    "id": part["id"], "quantity": quantity, "low": [q.low for q in got], "high": [q.high for q in got], "is_range": [q.is_range for q in got], "is_bound": [q.is_bound or quantity == "income" and not q.is_range for q in got],
                    "currency": out["currency"], "period": out["period"], "currency_from": source["currency"], "period_from": source["period"], "confidence": sure,
                })

    return records.select(*FIELDS).mapInPandas(run, _SCHEMA)


def to_common_units(stated: DataFrame, rates: DataFrame) -> DataFrame:
    """stated with low_inr, high_inr and basis: rupees a year, or in all for a single payment or a full course.

    rates: unit_code, unit_kind, factor, one row for each unit (a fixed table, read by the driver). A mere upper limit
    has low 0. Figures are decimals, rounded half up.
    """
    factors = {(r[1], r[0]): Decimal(str(r[2])) for r in rates.select("unit_code", "unit_kind", "factor").where("factor is not null and unit_code is not null").collect()}
    pick = lambda kind, col: F.coalesce(*[F.when(F.col(col) == k, F.lit(v.quantize(Decimal("1.0000"), ROUND_HALF_UP)).cast("decimal(16,4)")) for (u, k), v in factors.items() if u == kind], F.lit(None).cast("decimal(16,4)"))
    once = F.col("period").isin("once", "full_course")
    times = F.when(once, F.lit(Decimal(1)).cast("decimal(16,4)")).otherwise(pick("period", "period"))
    value = lambda c: F.round(F.col(c).cast("decimal(22,6)") * (pick("currency", "currency") * times).cast("decimal(16,4)"), 0).cast("bigint")
    low = F.when(F.col("is_bound"), F.lit(0).cast("bigint")).otherwise(value("low"))
    return stated.withColumn("low_inr", low).withColumn("high_inr", value("high")).withColumn("basis", F.when(once, "once").otherwise("year"))


def told_units(records: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """stated_units() with the forests fitted only if some figure lacks a unit, and asked only about the records that have such a figure."""
    stated = cut(stated_units(records, {}))
    lack = stated.where("currency is null or period is null")
    if lack.isEmpty():
        return stated
    models = fit_units(records, rows)
    keys = lack.select("id", "quantity").distinct()
    again = stated_units(records.join(keys.select("id").distinct(), "id", "left_semi"), models).join(keys, ["id", "quantity"], "left_semi")
    return stated.where("currency is not null and period is not null").join(keys, ["id", "quantity"], "left_anti").unionByName(again)


def found(records: DataFrame, rates: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """id, quantity, low_inr, high_inr, basis of every figure whose units are stated or told with confidence."""
    rows = to_common_units(told_units(records), rates)
    return rows.where((F.col("confidence") >= confident) & F.col("high_inr").isNotNull()).select("id", "quantity", "low_inr", "high_inr", "basis")


def review(records: DataFrame, rates: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """Every figure that found() leaves out, with the forest's guess and its confidence, for a reader to decide."""
    rows = to_common_units(told_units(records), rates)
    return rows.where((F.col("confidence") < confident) | F.col("high_inr").isNull()).select("id", "quantity", "low_inr", "high_inr", "basis", "currency", "period", F.round("confidence", 6).alias("confidence"))


def masked_units(records: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """unit, confidence (tenths), n, right: how well the forests tell units that are known, on records that they never saw.

    The records fall into two halves by a hash of the id. The forests are fitted on a bounded sample of one; every
    record of the other whose amount states a unit is asked for it without its text's and column's word.
    """
    other = F.pmod(F.xxhash64("id", F.lit(19)), F.lit(2)) == 1
    models = fit_units(records.where(~other), rows)
    units = (("currency", "amount_currency", currency_of), ("period", "amount_period", period_of))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for quantity, part, got in _parsed(pdf.assign(income_limit_text=None)):
                x = features(part, quantity, [q.low for q in got], [q.high for q in got])
                x[:, -2:] = 0
                for unit, column, of in units:
                    want = [getattr(q, unit) or of(v) for q, v in zip(got, part[column])]
                    know = [i for i, v in enumerate(want) if v]
                    if know and unit in models:
                        names, sure = models[unit].predict(x[know])
                        yield pd.DataFrame({"unit": unit, "confidence": np.minimum(np.floor(np.asarray(sure, float) * 10), 9) / 10, "hit": [int(v == want[i]) for i, v in zip(know, names)]})

    told = records.where(other).select(*FIELDS).mapInPandas(run, "unit string, confidence double, hit int")
    return told.groupBy("unit", "confidence").agg(F.count("*").alias("n"), F.sum("hit").alias("right"))
