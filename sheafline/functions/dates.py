"""Dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ages at which an identity card expires.
CARD_AGES = (25, 40, 60)


def card_expiry(born: Column, issued: Column) -> Column:
    """The first of the birthdays at CARD_AGES after the day of issue; null (no expiry) after the last."""
    return F.array_min(F.filter(F.array(*(F.add_months(born, 12 * age) for age in CARD_AGES)), lambda d: d > issued))
