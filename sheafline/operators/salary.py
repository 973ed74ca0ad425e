"""Salary in a statement, as array expressions on a row: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import for_ascii, let
from ..model import CREDIT, RulesConfig


def is_salary(loai: Column, mo_ta: Column, rules: RulesConfig) -> Column:
    """A credit whose description, upper-cased and without accents, has one of the patterns."""
    return (loai == CREDIT) & F.upper(for_ascii(mo_ta)).rlike("|".join(f"(?:{p})" for p in rules.salary_patterns))


def salary_by_month(rows: Column, rules: RulesConfig) -> Column:
    """array<struct<month, total, n>> sorted by month."""
    paid = F.transform(F.filter(rows, lambda t: is_salary(t["loai"], t["mo_ta"], rules)), lambda t: F.struct(F.trunc(t["ngay"], "MM").alias("month"), t["so_tien"].alias("so_tien")))

    def by_month(own: Column) -> Column:
        def of(month: Column) -> Column:
            at = F.filter(own, lambda t: t["month"] == month)
            return F.struct(month.alias("month"), F.aggregate(at, F.lit(0).cast("bigint"), lambda s, t: s + t["so_tien"]).alias("total"), F.size(at).alias("n"))

        return F.transform(F.array_sort(F.array_distinct(F.transform(own, lambda t: t["month"]))), of)

    return let(paid, by_month)


def salary_average(months: Column) -> Column:
    """Mean over the months that have salary; null if none has."""
    total = F.aggregate(months, F.lit(0).cast("bigint"), lambda s, m: s + m["total"])
    return F.when(F.size(months) > 0, total.cast("double") / F.size(months))


def monthly_credit(txs: DataFrame, key: str = "bundle_id", rules: RulesConfig | None = None) -> DataFrame:
    """The same over exploded transactions (key, ngay, mo_ta, so_tien, loai): total and count by key and month."""
    rules = rules or RulesConfig()
    return txs.filter(is_salary(F.col("loai"), F.col("mo_ta"), rules)).groupBy(key, F.trunc("ngay", "MM").alias("month")).agg(F.sum("so_tien").alias("total"), F.count("*").alias("n"))
