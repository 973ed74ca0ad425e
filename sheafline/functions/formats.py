"""Display formats: how values are printed on documents and in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dotted(v: Column) -> Column:
    return F.translate(F.format_number(v, 0), ",", ".")


def money_as(v: Column, style: str) -> Column:
    """An amount as printed. `trieu` writes whole hundred thousands from a million up in millions, else like `dong`."""
    dong = F.concat(dotted(v), F.lit(" đồng"))
    if style == "trieu":
        tenths = (v / 100000).cast("bigint")
        text = F.concat((tenths / 10).cast("bigint").cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit(","), (tenths % 10).cast("string"))).otherwise(""))
        return F.when((v % 100000 == 0) & (v >= 1000000), F.concat(text, F.lit(" triệu đồng"))).otherwise(dong)
    return {"dong": dong, "vnd": F.concat(dotted(v), F.lit(" VNĐ")), "d": F.concat(dotted(v), F.lit("đ")), "comma": F.concat(F.format_number(v, 0), F.lit(" VND"))}[style]


def date_as(d: Column, style: str) -> Column:
    if style == "long":
        return F.concat(F.lit("ngày "), F.date_format(d, "dd"), F.lit(" tháng "), F.date_format(d, "MM"), F.lit(" năm "), F.date_format(d, "yyyy"))
    return F.date_format(d, {"slash": "dd/MM/yyyy", "dash": "dd-MM-yyyy", "dot": "dd.MM.yyyy"}[style])


def account_as(s: Column, grouped: bool) -> Column:
    return F.regexp_replace(s, "(.{4})(?=.)", "$1 ") if grouped else s


def phone_as(s: Column, grouped: bool) -> Column:
    return F.concat_ws(" ", F.substring(s, 1, 4), F.substring(s, 5, 3), F.substring(s, 8, 99)) if grouped else s


def money_shown(v: Column) -> Column:
    return F.coalesce(F.concat(dotted(v), F.lit(" ₫")), F.lit("—"))


def duration_shown(seconds: Column) -> Column:
    return F.when(seconds >= 60, F.concat(F.format_number(seconds / 60, 1), F.lit(" phút"))).otherwise(F.concat(F.format_number(seconds, 0), F.lit(" giây")))


def date_shown(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "dd/MM/yyyy"), F.lit("—"))


def percent_shown(x: Column) -> Column:
    return F.when(x.isNull(), "–").otherwise(F.format_string("%.1f%%", x * 100))


def rate(k: Column, n: Column) -> Column:
    """k of n; null where there are none."""
    return F.try_divide(k.cast("double"), n.cast("double"))
