"""Parsers of raw strings: Column -> struct<value, error>. They never throw; a failure is a value of null and an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CREDIT, DEBIT, FIXED_TERM, OPEN_ENDED, TRANSACTION
from .text import clean_text, collapsed, digits_only, for_ascii, let

# Units of money, words for no end date, and marks of direction.
UNITS = {"ty": 10**9, "trieu": 10**6, "nghin": 10**3, "ngan": 10**3, "k": 10**3}
NO_END = ["khong xac dinh", "khong thoi han", "none", "null", "-"]
CREDIT_MARKS = ["ghi_co", "co", "c", "cr", "credit", "+"]
DEBIT_MARKS = ["ghi_no", "no", "d", "dr", "debit", "-"]


def result(value: Column, what: str, raw: Column) -> Column:
    """value with an error that names the raw string where the value is null."""
    return F.struct(value.alias("value"), F.when(value.isNull(), F.concat(F.lit(f"not a valid {what}: "), raw)).alias("error"))


def digits_between(low: int, high: int) -> Callable[[Column], Column]:
    def parse(s: Column) -> Column:
        return let(digits_only(s), lambda d: F.when(F.length(d).between(low, high), d))

    return parse


identity = digits_between(12, 12)
phone = digits_between(9, 11)
account = digits_between(6, 19)


def integer(s: Column) -> Column:
    return digits_only(s).try_cast("bigint")


def money(s: Column) -> Column:
    """A leading number, with a unit or not; separators of thousands are dropped, a decimal sign counts before a unit."""
    head = r"^\s*([0-9.,]+)"
    unit_behind = rf"{head}\s*({'|'.join(UNITS)})?"

    def value(p: Column) -> Column:
        number, unit = p["number"], p["unit"]
        factor = F.lit(1)
        for name, n in UNITS.items():
            factor = F.when(unit == name, n).otherwise(factor)
        whole = (unit == "") | number.rlike(r"^[0-9]{1,3}([.,][0-9]{3})+$")
        digits = F.translate(number, ".,", "")
        times = F.try_multiply(digits.try_cast("decimal(28,0)"), factor.cast("decimal(10,0)")).try_cast("bigint")
        exact = F.when(unit == "", digits.try_cast("bigint")).otherwise(times)
        scaled = F.bround(F.replace(number, F.lit(","), F.lit(".")).try_cast("double") * factor).try_cast("bigint")
        return F.when(whole, exact).otherwise(scaled)

    def parts(t: Column) -> Column:
        number = F.regexp_extract(t, head, 1)
        return let(number, lambda n: F.struct(n.alias("number"), F.when(n == t, "").otherwise(F.regexp_extract(t, unit_behind, 2)).alias("unit")))

    # most amounts are whole numbers with commas and nothing else
    return F.when(s.rlike(r"\A[0-9]{1,3}(?:,[0-9]{3})*\z"), F.replace(s, F.lit(","), F.lit("")).try_cast("bigint")).otherwise(let(let(F.lower(for_ascii(s)), parts), value))


def usual_day(s: Column) -> Column:
    """Days written with two digits, two for the month and four for the year, as year-month-day; other text as it is, which
    differs from such text in its third character."""
    return F.regexp_replace(s, r"\A[^0-9]*([0-9]{2})[^0-9]+([0-9]{2})[^0-9]+((?!0000)[0-9]{4})[^0-9]*\z", "$3-$2-$1")


def day(s: Column, usual: Column | None = None) -> Column:
    """Three groups of digits: year first if the first has four, else day first. usual: `usual_day` of s, if bound."""
    usual = usual_day(s) if usual is None else usual
    return F.when(usual == s, any_day(s)).otherwise(usual.try_cast("date"))


def any_day(s: Column) -> Column:
    def value(parts: Column) -> Column:
        year_first = F.length(F.get(parts, 0)) == 4
        part = lambda i: F.ltrim(F.get(parts, i), F.lit("0"))
        return let(F.struct(F.when(year_first, part(0)).otherwise(part(2)).alias("y"), part(1).alias("m"), F.when(year_first, part(2)).otherwise(part(0)).alias("d"), F.size(parts).alias("n")), of)

    def of(p: Column) -> Column:
        fits = (p["n"] == 3) & F.length(p["y"]).between(1, 4) & F.length(p["m"]).between(1, 2) & F.length(p["d"]).between(1, 2)
        text = F.concat_ws("-", F.lpad(p["y"], 4, "0"), F.lpad(p["m"], 2, "0"), F.lpad(p["d"], 2, "0"))
        return F.when(fits, text.try_cast("date"))

    return let(F.regexp_extract_all(s, F.lit(r"([0-9]+)"), F.lit(1)), value)


def no_end_date(s: Column) -> Column:
    return F.lower(F.trim(for_ascii(s))).isin(NO_END)


def contract_kind(s: Column) -> Column:
    return let(F.lower(for_ascii(s)), lambda t: F.when(t.contains("khong xac dinh"), OPEN_ENDED).when(t.contains("xac dinh"), FIXED_TERM))


def transactions(s: Column) -> Column:
    """All rows of a statement, or null if any row is wrong.

    A row has one amount and a direction, or one of two amount columns filled. A sign before the amount decides the
    direction over everything else.
    """
    def taken(row: Column) -> Column:
        has = lambda k: F.map_contains_key(row, F.lit(k))
        get = lambda k: F.try_element_at(row, F.lit(k))
        filled = lambda k: F.coalesce(F.trim(get(k)) != "", F.lit(False))
        two = has(CREDIT) | has(DEBIT)
        one_of_two = F.when(filled(CREDIT) & ~filled(DEBIT), get(CREDIT)).when(filled(DEBIT) & ~filled(CREDIT), get(DEBIT))
        given = F.struct(
            get("ngay").alias("ngay"), F.when(has("mo_ta"), F.coalesce(get("mo_ta"), F.lit("None"))).alias("mo_ta"), F.trim(F.when(two, one_of_two).otherwise(get("so_tien"))).alias("amount"),
            F.when(two, F.when(filled(CREDIT), CREDIT).otherwise(DEBIT)).otherwise(get("loai")).alias("side"),
        )
        # most rows have these four keys and no other; whether a key is there takes longer than what it has
        plain = F.struct(get("ngay").alias("ngay"), get("mo_ta").alias("mo_ta"), F.trim(get("so_tien")).alias("amount"), get("loai").alias("side"))
        four = F.size(row) == 4
        for k in ("ngay", "mo_ta", "so_tien", "loai"):
            four = four & get(k).isNotNull()
        return F.when(four, plain).otherwise(given)

    def signed(t: Column) -> Column:
        sign = F.substring(t["amount"], 1, 1)
        by_sign = sign.isin("+", "-")
        return F.struct(t["ngay"].alias("ngay"), t["mo_ta"].alias("mo_ta"), F.when(by_sign, F.substring(t["amount"], 2, 1 << 20)).otherwise(t["amount"]).alias("amount"), F.when(by_sign, sign).otherwise(F.replace(F.lower(for_ascii(t["side"])), F.lit(" "), F.lit("_"))).alias("side"))

    def typed(t: Column) -> Column:
        return F.struct(let(usual_day(t["ngay"]), lambda d: day(t["ngay"], d)).alias("ngay"), clean_text(t["mo_ta"]).alias("mo_ta"), money(t["amount"]).alias("so_tien"), F.when(t["side"].isin(CREDIT_MARKS), CREDIT).when(t["side"].isin(DEBIT_MARKS), DEBIT).alias("loai"))

    def sound(rows: Column) -> Column:
        return F.forall(rows, lambda t: F.coalesce(t["ngay"].isNotNull() & t["mo_ta"].isNotNull() & (t["so_tien"] > 0) & t["loai"].isNotNull(), F.lit(False)))

    rows = F.from_json(s, "array<map<string,string>>")
    parsed = F.transform(F.transform(F.transform(rows, taken), signed), typed)
    return F.get(F.filter(F.array(parsed), lambda r: r.isNotNull() & F.coalesce(sound(r), F.lit(False))), 0).cast(f"array<{TRANSACTION.simpleString()}>")


#: By kind: the parser, the slot of the cell that its value takes, and what to call it. Names and texts are parsed from
#: composed text.
PARSERS: dict[str, tuple[Callable[[Column], Column], str, str]] = {
    "name": (lambda s: F.upper(collapsed(s)), "text", "name"),
    "text": (collapsed, "text", "text"),
    "cccd": (identity, "text", "identity number"),
    "account": (account, "text", "account number"),
    "digits": (phone, "text", "phone number"),
    "loai_hd": (contract_kind, "text", "contract kind"),
    "date": (day, "day", "date"),
    "opt_date": (day, "day", "date"),
    "money": (money, "amount", "amount"),
    "int": (integer, "amount", "number"),
    "transactions": (transactions, "rows", "list of transactions"),
}
