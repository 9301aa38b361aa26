"""Rounding, rates, durations, tokens and costs, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Price of 1,000 input and output tokens, by model; and for other models.
PRICES = {"1-URGENT": (0.015, 0.075), "2-HIGH": (0.003, 0.015), "3-MEDIUM": (0.0005, 0.0015)}
DEFAULT_PRICE = (0.01, 0.03)


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero, for values of zero or more."""
    k = float(10**digits)
    return F.floor(value.cast("double") * k + 0.5).cast("double") / k


def truncated_round(value: Column, digits: int) -> Column:
    """Half added, then cut towards zero: negative halves go up."""
    k = float(10**digits)
    return (value.cast("double") * k + 0.5).cast("long").cast("double") / k


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, rounded; 0 where there is nothing."""
    return F.when(whole == 0, 0.0).otherwise(rounded(part * 100.0 / whole, digits))


def duration_ms(started: Column, completed: Column) -> Column:
    """Milliseconds between two timestamps; 0 if one is missing."""
    micros = F.unix_micros(completed.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.coalesce(F.floor(micros / 1000), F.lit(0)).cast("long")


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Price by model, rounded to six places."""
    a, b = F.lit(DEFAULT_PRICE[0]), F.lit(DEFAULT_PRICE[1])
    for name, (x, y) in PRICES.items():
        a, b = F.when(model == name, x).otherwise(a), F.when(model == name, y).otherwise(b)
    return rounded(tokens_in * a / 1000.0 + tokens_out * b / 1000.0, 6)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
