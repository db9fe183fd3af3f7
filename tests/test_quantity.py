from decimal import Decimal

import numpy as np
import pytest

from siftlake.functions.quantity import currency_of, number, period_of, read
from siftlake.functions.trees import Forest


@pytest.mark.parametrize(("text", "value"), [("1,50,000", 150000), ("26.800,00", 26800), ("1'600", 1600), ("4.5", "4.5"), ("1,234.50", "1234.5"), ("0.025", "0.025"), ("1.500", 1500), ("12,5", "12.5")])
def test_number(text, value):
    assert number(text) == Decimal(value)


@pytest.mark.parametrize(
    ("text", "low", "high", "bound", "currency", "period"),
    [
        ("Rs. 330-331 thousand per annum", 330000, 331000, False, "INR", "per_year"),
        ("₹९ लाख से अधिक न हो", 900000, 900000, False, "INR", None),
        ("up to INR fifteen thousand per academic year", 15000, 15000, True, "INR", "per_year"),
        ("0.025 (Rs. in lakh) a year", 2500, 2500, False, "INR", "per_year"),
        ("In thousand rupees: 39 per quarter", 39000, 39000, False, "INR", "per_quarter"),
        ("SFr. 8'000 lump sum", 8000, 8000, False, "CHF", "once"),
        ("Session 2026-27: from ₹1,15,000 up to 1,18,000 Rs. yearly", 115000, 118000, False, "INR", "per_year"),
        ("maximum Rupees 25,000/-, 499 awards", 25000, 25000, True, "INR", None),
        ("A$1.3 thousand every six months", 1300, 1300, False, "AUD", "per_semester"),
        ("₹ 32500 p.m. for up to five years", 32500, 32500, False, "INR", "per_month"),
        ("two lakh fifty thousand rupees", 250000, 250000, False, "INR", None),
        ("13 LPA", 1300000, 1300000, False, None, "per_year"),
        ("$9,100", 9100, 9100, False, "USD", None),
    ],
)
def test_read(text, low, high, bound, currency, period):
    q = read(text)
    assert (q.low, q.high, q.is_bound, q.currency, q.period) == (low, high, bound, currency, period)


@pytest.mark.parametrize("text", [None, "", "   ", "As per norms of the board", "Full tuition fee waiver"])
def test_read_nothing(text):
    assert read(text) is None


def test_labels():
    assert [currency_of(x) for x in ("INR ", "Rs", "€", None, "US$")] == ["INR", "INR", "EUR", None, "USD"]
    assert [period_of(x) for x in ("PER_MONTH", "one time", "full_course", None)] == ["per_month", "once", "full_course", None]


def test_forest_learns_and_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 60, (3000, 4)).astype(np.uint8)
    y = np.where(x[:, 0] > 30, "a", np.where(x[:, 1] > 30, "b", "c"))
    f = Forest().fit(x[:2000], y[:2000])
    label, sure = f.predict(x[2000:])
    assert (label == y[2000:]).mean() > 0.95
    assert abs(sure.mean() - (label == y[2000:]).mean()) < 0.1
