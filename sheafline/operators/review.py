"""Review of what was not passed: an append-only event log, the queue over it, and suggestions for flagged fields.

State is never updated in place. Opening and closing an item append events; its state is the first opening and the last
closing, so retried writes change nothing.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import each_of, let, names_match, normalize_name, same_names, strip_accents
from ..model import SCHEMA
from . import ranks

EVENTS = "bundle_id string, kind string, route string, reasons array<string>, reviewer string, conclusion string, edits string, note string, at double"
# What a reviewer may conclude, and the rules that compare values.
CONCLUSIONS = ("valid", "request_more", "discrepancy")
MATCH_RULES = ("R1", "R2", "R3", "R6")


def open_events(items: DataFrame, at: Column) -> DataFrame:
    """Events for (bundle_id, route, reasons) opened at a time."""
    none = F.lit(None).cast("string")
    return items.select("bundle_id", F.lit("open").alias("kind"), "route", "reasons", none.alias("reviewer"), none.alias("conclusion"), none.alias("edits"), none.alias("note"), at.cast("double").alias("at"))


def close_events(items: DataFrame, at: Column) -> DataFrame:
    """Events for (bundle_id, reviewer, conclusion, edits, note) closed at a time; an unknown conclusion is an error when
    the rows are read."""
    known = F.when(F.col("conclusion").isin(*CONCLUSIONS), F.col("conclusion")).otherwise(F.raise_error(F.concat(F.lit("not a conclusion: "), F.coalesce("conclusion", F.lit("null")))).cast("string"))
    return items.select("bundle_id", F.lit("close").alias("kind"), F.lit(None).cast("string").alias("route"), F.lit(None).cast("array<string>").alias("reasons"), "reviewer", known.alias("conclusion"), "edits", "note", at.cast("double").alias("at"))


def state(events: DataFrame) -> DataFrame:
    """One row for each bundle that was opened: open or closed, since when, and the last closing's data."""
    opened = F.col("kind") == "open"
    first = lambda c: F.min_by(F.when(opened, F.col(c)), F.when(opened, F.col("at")))
    last = lambda c: F.max_by(F.when(~opened, F.col(c)), F.when(~opened, F.col("at")))
    out = events.groupBy("bundle_id").agg(
        first("route").alias("route"), first("reasons").alias("reasons"), F.min(F.when(opened, F.col("at"))).alias("opened_at"), F.max(F.when(~opened, F.col("at"))).alias("closed_at"),
        *(last(c).alias(c) for c in ("reviewer", "conclusion", "edits", "note")),
    )
    return out.filter("opened_at is not null").withColumn("status", F.when(F.col("closed_at").isNull(), "open").otherwise("closed"))


def latest(events: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by an order that leaves no ties."""
    return events.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def edits(before: Column, after: Column) -> Column:
    """map<field, struct<from, to>> of what a reviewer changed, of two maps field -> value (a field absent is null)."""
    names = F.array_distinct(F.concat(F.map_keys(before), F.map_keys(after)))
    entries = F.transform(names, lambda k: F.struct(k.alias("key"), F.struct(F.try_element_at(before, k).alias("from"), F.try_element_at(after, k).alias("to")).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: ~e["value"]["from"].eqNullSafe(e["value"]["to"])))


def shown_message(message: Column, status: Column, documents: dict[str, str], labels: dict[str, str]) -> Column:
    """A check's message for people: references doc_type.field in words, and on a fail without the rule's own label."""
    text = F.when(status == "fail", F.regexp_replace(message, r"^[^:]*: ", "")).otherwise(message)
    for (d, f) in ((d, f) for d in SCHEMA for f, _ in SCHEMA[d]):
        if d in documents:
            text = F.regexp_replace(text, rf"\b{d}\.{f}\b", f"{documents[d]} · {labels.get(f, f).lower()}")
    return text


def queue(decisions: DataFrame, items: DataFrame, only: str | None = None, search: str | None = None, augment: str | None = None) -> DataFrame:
    """Bundles that need a person with their review state; by route, by a text in id or customer without case, and by the
    quality of their images."""
    rows = decisions.filter(F.col("route") == only if only else F.col("route") != "AUTO_PASS")
    if search:
        rows = rows.filter(F.lower(F.concat_ws(" ", "bundle_id", "customer")).contains(search.lower()))
    if augment:
        rows = rows.filter(F.col("augment") == augment)
    return rows.join(items.select("bundle_id", "status", "opened_at", "closed_at", "reviewer"), "bundle_id", "left").withColumn("status", F.coalesce("status", F.lit("new")))


def kpis(rows: DataFrame) -> DataFrame:
    """By route: bundles, closed ones and the mean time of handling."""
    return rows.groupBy("route").agg(F.count("*").alias("n"), F.count("closed_at").alias("closed"), F.avg(F.col("closed_at") - F.col("opened_at")).alias("mean_seconds"))


def next_open(rows: DataFrame, closed: DataFrame, order: str = "pos") -> DataFrame:
    """The first bundle in order that is not closed, in one row."""
    return rows.join(closed.select("bundle_id"), "bundle_id", "left_anti").agg(F.min_by("bundle_id", order).alias("bundle_id"), F.min(order).alias(order))


def neighbours(rows: DataFrame, by: str, order: str, key: str = "bundle_id") -> DataFrame:
    """The bundles before and after each in its class."""
    return ranks.neighbours(rows, [by], order, key)


def pick_samples(labelled: DataFrame, n_auto: int = 2) -> DataFrame:
    """A small set that covers every branch: the first right automatic passes, the first bundle of each error code and
    near-miss, and every clean bundle sent to review. (bundle_id, why) in order of choice, each bundle once.

    labelled: bundle_id, pos, expected, actual, errors and near (arrays of codes).
    """
    right = labelled.filter("expected = 'AUTO_PASS' and actual = 'AUTO_PASS'").orderBy("pos").limit(n_auto).select("bundle_id", F.lit(0).alias("step"), "pos", F.lit("auto").alias("why"))
    parts = [right]
    for step, column in ((1, "errors"), (2, "near")):
        each = labelled.filter(F.col("actual").isNotNull()).select("bundle_id", "pos", F.explode(column).alias("code"))
        parts.append(each.groupBy("code").agg(F.min_by("bundle_id", "pos").alias("bundle_id"), F.min("pos").alias("pos")).select("bundle_id", F.lit(step).alias("step"), "pos", F.col("code").alias("why")))
    parts.append(labelled.filter("expected = 'AUTO_PASS' and actual <> 'AUTO_PASS'").select("bundle_id", F.lit(3).alias("step"), "pos", F.lit("false_review").alias("why")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("bundle_id").agg(F.min(F.struct("step", "pos", "why")).alias("s")).select("bundle_id", "s.step", "s.pos", "s.why")


def mode_first_seen(values: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group with its count; of equals the one seen first."""
    n = values.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    return n.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "__first"))).filter("__r = 1").drop("__r", "__first")


def peers(evidence: DataFrame, key: list[str]) -> DataFrame:
    """Every piece of evidence with each other one of its check: (keys, pos, value, peer_pos, peer_value)."""
    a = evidence.select(*key, F.col("pos"), F.col("value"))
    b = evidence.select(*key, F.col("pos").alias("peer_pos"), F.col("value").alias("peer_value"))
    return a.join(b, key).filter("pos <> peer_pos")


#: Pairs of the positions 0 to 3, and sets of positions with the pairs they need (as bits), largest and earliest first.
_PAIRS = list(combinations(range(4), 2))
_CLIQUES = [(members, sum(1 << _PAIRS.index(p) for p in combinations(members, 2))) for size in (4, 3, 2, 1) for members in combinations(range(4), size)]


def majority(names: Column) -> Column:
    """struct<value, n, members>: of up to four names (nulls stand for none) the largest group in which all match each
    other. Matching is not transitive: a name without accents matches two that differ in theirs, which do not match each
    other, so groups are cliques and may overlap; of equally large ones the first counts. Its value is its first name with
    accents, or else its first."""
    forms = F.transform(names, lambda x: let(normalize_name(x), lambda n: F.struct(n.alias("n"), strip_accents(n).alias("bare"))))

    def found(f: Column) -> Column:
        at = lambda i: F.get(f, F.lit(i))
        joined = sum((F.when(F.coalesce(same_names(at(i)["n"], at(i)["bare"], at(j)["n"], at(j)["bare"]), F.lit(False)), 1 << k).otherwise(0) for k, (i, j) in enumerate(_PAIRS)), F.lit(0))
        there = sum((F.when(at(i)["n"].isNotNull(), 1 << i).otherwise(0) for i in range(4)), F.lit(0))

        def largest(bits: Column) -> Column:
            fits = [F.when(((bits["joined"].bitwiseAND(F.lit(need))) == need) & (bits["there"].bitwiseAND(F.lit(sum(1 << i for i in members))) == sum(1 << i for i in members)), F.array(*map(F.lit, members))) for members, need in _CLIQUES]
            return F.coalesce(*fits, F.array().cast("array<int>"))

        def named(members: Column) -> Column:
            values = F.transform(members, lambda i: F.struct(F.get(names, i).alias("raw"), (F.get(f, i)["bare"] != F.get(f, i)["n"]).alias("marked")))
            first = F.coalesce(F.get(F.filter(values, lambda v: v["marked"]), 0), F.get(values, 0))
            return F.struct(first["raw"].alias("value"), F.size(members).alias("n"), members.alias("members"))

        return let(let(F.struct(joined.alias("joined"), there.alias("there")), largest), named)

    return let(forms, found)


def flagged_fields(checked: DataFrame, key: str = "bundle_id", grouped: bool = False) -> DataFrame:
    """(bundle, doc_type, field): why it is flagged, its peers, and the value suggested instead.

    A failed check flags all its fields, an unknown one those not known. A comparing rule that failed suggests the other
    document's value if there are two, or the majority's if more agree. Values agree if they are equal; with `grouped`
    names agree as R1 compares them, and the value of their largest group is suggested to those that do not match it.
    """
    each = checked.select(key, each_of("checks").alias("c")).filter("c.status <> 'pass'").select(key, "c.rule_id", "c.status", F.filter("c.evidence", lambda e: e["field"].isNotNull()).alias("refs"))
    values = F.filter(F.transform("refs", lambda e: e["value"]), lambda v: v.isNotNull())
    counts = F.transform(F.array_distinct(values), lambda v: F.struct(v.alias("v"), F.size(F.filter(values, lambda x: x == v)).alias("n")))
    top = F.aggregate(counts, F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("n")), lambda best, c: F.when(c["n"] > best["n"], c).otherwise(best))
    if grouped:
        top = F.when(F.col("rule_id") == "R1", let(majority(F.transform("refs", lambda e: e["value"])), lambda m: F.struct(m["value"].alias("v"), m["n"].alias("n")))).otherwise(top)
    rows = each.withColumn("top", top).select("*", F.posexplode("refs").alias("i", "e")).filter((F.col("status") == "fail") | ~F.col("e.known"))
    others = F.filter("refs", lambda o, i: i != F.col("i"))
    name_rule = F.col("rule_id") == "R1"
    differs = lambda o: F.when(name_rule, ~names_match(F.col("e.value"), o["value"])).otherwise(F.col("e.value") != o["value"])
    fits = F.filter(others, lambda o: o["value"].isNotNull() & differs(o) & ((F.size("refs") == 2) | ((o["value"] == F.col("top.v")) & (F.col("top.n") >= 2))))
    suggest = F.when((F.col("status") == "fail") & F.col("rule_id").isin(*MATCH_RULES) & F.col("e.value").isNotNull(), fits)
    out = rows.select(key, "e.doc_type", "e.field", "rule_id", "status", F.transform(others, lambda o: F.struct(o["doc_type"], o["field"], o["value"])).alias("peers"), F.transform(suggest, lambda o: F.struct(o["value"].alias("value"), o["doc_type"].alias("doc_type"))).alias("suggest"))
    why = F.struct("rule_id", "status", "peers", "suggest")
    return out.groupBy(key, "doc_type", "field").agg(F.array_sort(F.collect_list(why)).alias("why"))
