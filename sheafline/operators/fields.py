"""Finalization: raw strings of a document to typed cells with a binary confidence.

A cell is one struct with a slot for each type of value. It is made of plain columns of the row, some for each field of the
schema, so no shuffle is needed before documents of a bundle meet.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import PARSERS, no_end_date
from ..functions.text import all_own, all_settled, built_once, each_of, foreign_chars, nfc
from ..model import SCHEMA, TRANSACTION, RulesConfig, Thresholds, field_rows
from .salary import salary_by_month

CELL = f"struct<doc_type:string,field:string,field_ord:int,kind:string,critical:boolean,raw:string,page:int,text:string,day:date,amount:bigint,rows:array<{TRANSACTION.simpleString()}>,high:boolean,error:string>"
GARBLED = "garbled"
# The kinds whose strings are words, and the slots of a cell with their types.
WORDS = ("name", "text")
_SLOTS = {"text": "string", "day": "date", "amount": "bigint", "rows": f"array<{TRANSACTION.simpleString()}>"}


def parsed(kind: str, raw: Column) -> tuple[Column, Column]:
    """Value of a raw string, and whether it parses (an indefinite end date parses to null)."""
    value = PARSERS[kind][0](raw)
    return value, well_formed(kind, value, raw)


def well_formed(kind: str, value: Column, raw: Column) -> Column:
    return value.isNotNull() | F.coalesce(no_end_date(raw), F.lit(False)) if kind == "opt_date" else value.isNotNull()


class Reading:
    """What a document may give for a field: the strings of two passes, and a page. Strings are null where there is no such
    document. A second pass that is the first's own column agrees with it and is not looked at again."""

    def __init__(self, first: Column, second: Column | None, page: Column):
        self.first, self.page, self.again = first, page, second is first
        self.second = None if second is first else second


def in_columns(rows: DataFrame, given: dict[tuple[str, str], Reading], rules: RulesConfig | None = None, limits: Thresholds | None = None) -> DataFrame:
    """rows with plain columns for each field of the schema, whose names end in its type and name: r_ its raw string, p_ its
    page, v_ its value (null unless it is good), k_ its confidence, and e_ its error. `cell` makes a cell of them.

    All steps are columns of the row and none a function over an array of cells, so that they are compiled, and those that a
    query does not read are not made. A field that is not given is as one without a string."""
    rules, limits = rules or RulesConfig(), limits or Thresholds()
    null = lambda t: F.lit(None).cast(t)
    own = rows.columns
    every = [(d, f, kind, critical) for d, _, f, _, kind, critical in field_rows(limits)]
    twice = lambda d, f, critical: limits.use_self_consistency and critical and (d, f) in given and given[d, f].second is not None

    read = {f"r_{d}_{f}": g.first for (d, f), g in given.items()} | {f"p_{d}_{f}": g.page for (d, f), g in given.items()}
    read |= {f"s_{d}_{f}": given[d, f].second for d, f, _, critical in every if twice(d, f, critical)}
    rows = rows.withColumns(read)

    # words in composed form, and the foreign characters in them: most have neither to compose nor to report, which one look
    # at all of a row's words tells
    words, at = [], {}
    for d, f, kind, critical in every:
        if kind in WORDS and (d, f) in given:
            at["r", d, f] = len(words)
            words.append(F.col(f"r_{d}_{f}"))
            if twice(d, f, critical):
                at["s", d, f] = len(words)
                words.append(F.when(F.col(f"s_{d}_{f}") != F.col(f"r_{d}_{f}"), F.col(f"s_{d}_{f}")))
    if words:
        rows = rows.withColumn("__words", F.array(*words))
        rows = rows.withColumn("__words", built_once(("words",), lambda: F.when(all_settled(F.array_join("__words", "")), F.col("__words")).otherwise(F.transform("__words", nfc))))
        rows = rows.withColumn("__foreign", built_once(("foreign",), lambda: F.when(~all_own(F.array_join("__words", "")), F.transform("__words", lambda w: foreign_chars(w, composed=True)))))
    read_of = lambda p, d, f: F.get("__words", F.lit(at[p, d, f])) if (p, d, f) in at else F.col(f"{p}_{d}_{f}")

    values = {}
    for d, f, kind, critical in every:
        if (d, f) in given:
            values[f"x_{d}_{f}"] = PARSERS[kind][0](read_of("r", d, f))
            if twice(d, f, critical):
                values[f"y_{d}_{f}"] = F.when(F.col(f"s_{d}_{f}") != F.col(f"r_{d}_{f}"), PARSERS[kind][0](read_of("s", d, f)))
    rows = rows.withColumns(values)

    judged = {}
    for d, f, kind, critical in every:
        slot, what = PARSERS[kind][1:]
        if (d, f) not in given:
            judged |= {f"r_{d}_{f}": null("string"), f"p_{d}_{f}": null("int"), f"v_{d}_{f}": null(_SLOTS[slot]), f"k_{d}_{f}": F.lit(False), f"e_{d}_{f}": null("string")}
            continue
        raw, value = F.col(f"r_{d}_{f}"), F.col(f"x_{d}_{f}")
        ok = well_formed(kind, value, read_of("r", d, f))
        blank = raw.isNull() | ~raw.rlike(r"(?U)\S")
        good, error = ok, F.when(ok | blank, null("string")).otherwise(F.concat(F.lit(f"not a valid {what}: "), raw))
        if kind in WORDS:  # a blank word is a value as well; of other kinds none is
            garbled = F.coalesce(F.get("__foreign", F.lit(at["r", d, f])), F.lit(""))
            good = ok & (garbled == "") & ~blank
            error = F.when(good | blank, null("string")).when(garbled != "", F.concat(F.lit(f"{GARBLED}: "), garbled)).otherwise(F.concat(F.lit(f"not a valid {what}: "), raw))
        high = good
        if limits.use_self_consistency and critical:
            if given[d, f].again:
                agree = raw.isNotNull()
            elif given[d, f].second is None:
                agree = F.lit(False)
            else:
                second, other = F.col(f"s_{d}_{f}"), F.col(f"y_{d}_{f}")
                pair = (lambda v: salary_by_month(v, rules)) if kind == "transactions" else (lambda v: v)
                agree = (second == raw) | F.when(second != raw, well_formed(kind, other, read_of("s", d, f)) & pair(other).eqNullSafe(pair(value)))
            high = good & agree
        judged |= {f"v_{d}_{f}": F.when(good, value), f"k_{d}_{f}": F.coalesce(high, F.lit(False)), f"e_{d}_{f}": error}
    rows = rows.withColumns(judged)
    return rows.select(*(c for c in own if c not in judged), *(f"{p}_{d}_{f}" for p in "rpvke" for d, f, _, _ in every))


def cell(doc_type: str, order: int, name: str, kind: str, critical: bool) -> Column:
    """The cell of a field from its columns."""
    of = lambda p: F.col(f"{p}_{doc_type}_{name}")
    slots = {slot: of("v") if slot == PARSERS[kind][1] else F.lit(None).cast(t) for slot, t in _SLOTS.items()}
    return F.struct(
        F.lit(doc_type).alias("doc_type"), F.lit(name).alias("field"), F.lit(order).alias("field_ord"), F.lit(kind).alias("kind"), F.lit(critical).alias("critical"), of("r").alias("raw"), of("p").alias("page"),
        *(v.alias(s) for s, v in slots.items()), of("k").alias("high"), of("e").alias("error"),
    )


def cells_in_columns(doc_type: str, limits: Thresholds | None = None) -> Column:
    """All cells of a document from the columns of its fields, in order."""
    return F.array(*(cell(d, order, f, kind, critical) for d, _, f, order, kind, critical in field_rows(limits) if d == doc_type))


def finalize(docs: DataFrame, rules: RulesConfig | None = None, limits: Thresholds | None = None, first: str = "raw0", second: str = "raw1") -> DataFrame:
    """docs (doc_type and two maps field -> (raw, page), of which the second may be absent) with the column cells: every
    field its type declares, in order, whether the document gives it or not."""
    rules, limits = rules or RulesConfig(), limits or Thresholds()
    if second not in docs.columns:
        limits = replace(limits, use_self_consistency=False)

    def given(d: str, f: str) -> Reading:
        of = lambda m, part: F.when(F.col("doc_type") == d, F.try_element_at(m, F.lit(f))[part])
        return Reading(of(first, "raw"), of(second, "raw") if limits.use_self_consistency else None, of(first, "page"))

    made = in_columns(docs, {(d, f): given(d, f) for d, _, f, _, _, _ in field_rows()}, rules, limits)
    cells = F.array().cast(f"array<{CELL}>")
    for d in SCHEMA:
        cells = F.when(F.col("doc_type") == d, cells_in_columns(d, limits)).otherwise(cells)
    return made.select(*(F.col(f"`{c}`") for c in docs.columns if c != "cells"), cells.alias("cells"))


def long_fields(finalized: DataFrame) -> DataFrame:
    """One row for each field: the keys of the document and the cell's columns."""
    keys = [c for c in finalized.columns if c not in ("cells", "raw0", "raw1", "doc_type")]
    return finalized.select(*keys, each_of("cells").alias("c")).filter("c is not null").select(*keys, "c.*")


def long_columns(rows: DataFrame, wanted: list[tuple[str, str]], limits: Thresholds | None = None, key: str = "bundle_id") -> DataFrame:
    """The same of fields that are columns (in_columns), for those wanted: key and the cell's columns, of documents that are
    there (there_)."""
    made = {(d, f): cell(d, order, f, kind, critical) for d, _, f, order, kind, critical in field_rows(limits)}
    each = F.array(*(F.when(F.col(f"there_{d}"), made[d, f]) for d, f in wanted))
    return rows.select(key, each_of(each).alias("c")).filter("c is not null").select(key, "c.*")
