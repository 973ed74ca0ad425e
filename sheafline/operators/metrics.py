"""Evaluation of decisions against labelled truth, in four tiers: fields, rules, routing and operation.

Each function takes plain tables, so the same operators run on any data that has their columns. Groups are combined
before they are shuffled; dimension tables (error codes, routes) are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.formats import rate
from ..functions.stats import upper_bound_95
from ..functions.text import clean_text, fold, normalize_name
from ..model import CREDIT, ERROR_RULE, ROUTES, RulesConfig
from .ranks import value_ranks
from .salary import salary_by_month


def same_value(kind: str, predicted: Column, truth: Column, rules: RulesConfig | None = None) -> Column:
    """Whether a value counts as right: both null, or equal as the kind is compared (text without case, statements by
    their salary)."""
    if kind == "text":
        equal = fold(predicted) == fold(clean_text(truth))
    elif kind == "name":
        equal = predicted == normalize_name(truth)
    elif kind == "transactions":
        equal = salary_by_month(predicted, rules or RulesConfig()).eqNullSafe(salary_by_month(truth, rules or RulesConfig()))
    else:
        equal = predicted == truth
    return F.when(predicted.isNull() | truth.isNull(), predicted.isNull() & truth.isNull()).otherwise(equal)


def field_accuracy(rows: DataFrame, groups: list[list[str]], ok: str = "ok") -> DataFrame:
    """n and accuracy by each set of columns in one pass (columns outside a set are null; gid tells the sets apart)."""
    columns = list(dict.fromkeys(c for g in groups for c in g))
    return rows.groupingSets([[F.col(c) for c in g] for g in groups], *(F.col(c) for c in columns)).agg(F.grouping_id().cast("bigint").alias("gid"), F.count("*").alias("n"), F.avg(F.col(ok).cast("double")).alias("acc"))


def bag_overlap(truth: DataFrame, predicted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """By group: rows of each bag, rows in both (the smaller count of each key), recall and precision."""
    left = truth.groupBy(*by, *keys).agg(F.count("*").alias("n_truth"))
    right = predicted.groupBy(*by, *keys).agg(F.count("*").alias("n_pred"))
    both = left.join(right, [*by, *keys], "full")
    out = both.groupBy(*by).agg(F.coalesce(F.sum("n_truth"), F.lit(0)).alias("n_truth"), F.coalesce(F.sum("n_pred"), F.lit(0)).alias("n_pred"), F.sum(F.least(F.coalesce("n_truth", F.lit(0)), F.coalesce("n_pred", F.lit(0)))).alias("hit"))
    return out.withColumns({"recall": rate(F.col("hit"), F.col("n_truth")), "precision": rate(F.col("hit"), F.col("n_pred"))})


def recall_by_code(spark: SparkSession, injected: DataFrame, checks: DataFrame, mapping: dict[str, str] | None = None, key: str = "bundle_id") -> DataFrame:
    """For every error code, injected or not: how often its rule failed, was unknown or passed, and the recall."""
    dim = spark.createDataFrame(list((mapping or ERROR_RULE).items()), "code string, rule_id string")
    hits = injected.select(key, "code").distinct().join(F.broadcast(dim), "code").join(checks.select(key, "rule_id", "status").hint("merge"), [key, "rule_id"])
    counts = hits.groupBy("code").agg(F.count("*").alias("n"), *(F.count_if(F.col("status") == s).alias(a) for s, a in (("fail", "caught"), ("unknown", "unknown"), ("pass", "missed"))))
    return dim.join(F.broadcast(counts), "code", "left").na.fill(0, ["n", "caught", "unknown", "missed"]).withColumn("recall", rate(F.col("caught"), F.col("n")))


def not_flagged(labelled: DataFrame) -> DataFrame:
    """Of clean bundles (near: array of codes; flagged: any rule failed) the share not flagged, by near-miss code, and
    for those with none under the code `clean`."""
    each = labelled.select(F.explode(F.when(F.size("near") > 0, F.col("near")).otherwise(F.array(F.lit("clean")))).alias("code"), "flagged")
    return each.groupBy("code").agg(F.count("*").alias("n"), rate(F.count_if(~F.col("flagged")), F.count("*")).alias("rate"))


def confusion(spark: SparkSession, pairs: DataFrame, routes: list[str] | None = None) -> DataFrame:
    """expected x actual counts with zeros, one row for each expected route."""
    routes = routes or ROUTES
    dim = spark.createDataFrame([(r,) for r in routes], "expected string")
    counts = pairs.groupBy("expected").agg(*(F.count_if(F.col("actual") == r).alias(r) for r in routes))
    return dim.join(F.broadcast(counts), "expected", "left").na.fill(0, routes)


def end_to_end(pairs: DataFrame) -> DataFrame:
    """Escape, false review and automation rates of (expected, actual) routes in one row."""
    auto, good = F.col("actual") == "AUTO_PASS", F.col("expected") == "AUTO_PASS"
    counted = pairs.agg(F.count("*").alias("n_bundles"), F.count_if(~good).alias("n_with_errors"), F.count_if(good).alias("n_clean"), F.count_if(auto & ~good).alias("escaped"), F.count_if(~auto & good).alias("reviewed"), F.count_if(auto).alias("auto"))
    return counted.select(
        "n_bundles", "n_with_errors", "n_clean", "escaped", rate(F.col("escaped"), F.col("n_with_errors")).alias("escape_rate"), upper_bound_95(F.col("escaped"), F.col("n_with_errors")).alias("escape_rate_upper95"),
        rate(F.col("reviewed"), F.col("n_clean")).alias("false_review_rate"), rate(F.col("auto"), F.col("n_bundles")).alias("automation_rate"),
    )


def latency(runs: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Median (interpolated) and 95th percentile (nearest rank) by group; groups without a value are left out."""
    by = by or []
    own = by or ["__all"]
    ranks = value_ranks(runs if by else runs.withColumn("__all", F.lit(0)), own, value)
    at = lambda rank: F.min(F.when(F.col("__upto") >= rank, F.col(value)))
    total = F.col("__total")
    found = ranks.groupBy(*own).agg(at(F.floor((total + 1) / 2)).alias("low"), at(F.floor(total / 2) + 1).alias("high"), at(F.floor((total * 95 + 99) / 100)).alias("p95"))
    return found.select(*by, ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95")


def operations(decided: DataFrame) -> DataFrame:
    """One row: latency, calls and cost by bundle, and documents whose extraction failed."""
    counted = decided.agg(F.avg("n_calls").alias("calls_per_bundle"), F.avg("cost_usd").alias("cost_per_bundle_usd"), F.sum("failed_docs").alias("docs_extract_failed"))
    spread = latency(decided, "latency_ms").select(F.col("p50").alias("latency_p50_ms"), F.col("p95").alias("latency_p95_ms"))
    return counted.withColumn("__one", F.lit(1)).join(spread.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")  # one row each


def call_costs(calls: DataFrame, by: list[str], tokens_in: str, tokens_out: str, price_in: float, price_out: float) -> DataFrame:
    """Calls and their cost by group, prices being for a million tokens."""
    cost = (F.col(tokens_in) * F.lit(float(price_in)) + F.col(tokens_out) * F.lit(float(price_out))) / 1e6
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(cost).alias("cost"))


def label_histogram(manifest: DataFrame) -> DataFrame:
    """(label, value, n): bundles by expected route, injected errors and near-misses by code, and documents by layout."""
    each = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    of = lambda label, column: F.transform(column, lambda v: each(label, v))
    labels = F.concat(
        F.array(each("route", F.col("expected_route"))), of("error", F.col("injected_errors.code")), of("near_miss", F.col("near_miss.code")),
        F.transform(F.map_entries("layout_ids"), lambda e: each("layout", F.concat_ws("/", e["key"], e["value"]))),
    )
    return manifest.select(F.explode(labels).alias("x")).groupBy("x.label", "x.value").agg(F.count("*").alias("n"))


def gate(runs: DataFrame) -> DataFrame:
    """Each run against the one before it with the same split and filter: the change of escape and automation, and
    whether it is rejected for letting more through."""
    w = W.partitionBy("split", "filter").orderBy("run_id")
    prior = {f"prev_{c}": F.lag(c).over(w) for c in ("run_id", "escape_rate", "automation_rate")}
    out = runs.withColumns(prior).withColumns({"d_escape": F.col("escape_rate") - F.col("prev_escape_rate"), "d_automation": F.col("automation_rate") - F.col("prev_automation_rate")})
    return out.withColumn("rejected", F.coalesce(F.col("d_escape") > 0, F.lit(False)))


def error_rows(fields: DataFrame, missed: DataFrame, flags: DataFrame, routes: DataFrame) -> DataFrame:
    """The four kinds of error rows in one table (bundle_id, kind, detail, expected, actual), in that order by ord."""
    names = ["bundle_id", "kind", "detail", "expected", "actual"]
    out = None
    for i, part in enumerate((fields, missed, flags, routes)):
        part = part.select(*(F.substring(F.col(c), 1, 200).alias(c) if c in ("expected", "actual") else F.col(c) for c in names), F.lit(i).alias("ord"))
        out = part if out is None else out.unionByName(part)
    return out


def statement_rows(fields: DataFrame) -> DataFrame:
    """Statements scored by row: fields has bundle_id, truth and pred (arrays of transactions; null: not parsed)."""
    rows = lambda c: fields.select("bundle_id", F.explode(c).alias("t")).select("bundle_id", "t.*")
    return row_scores(rows("truth"), rows("pred"))


def row_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """The same of rows of transactions (bundle_id, ngay, mo_ta, so_tien, loai). Both bags are counted by one grouping; rows
    with a null are counted but equal to none."""
    keys = ["bundle_id", "loai", "ngay", "mo_ta", "so_tien"]
    part = lambda df, t: df.select(*keys, F.lit(t).alias("t"))
    counts = part(truth, True).unionByName(part(predicted, False)).groupBy(*keys).agg(F.count_if("t").alias("n_truth"), F.count_if(~F.col("t")).alias("n_pred"))
    whole = F.concat(*(F.col(k).cast("string") for k in keys)).isNotNull()
    by_side = counts.withColumn("hit", F.when(whole, F.least("n_truth", "n_pred")).otherwise(0))
    summed = by_side.agg(F.sum("n_truth").alias("n_rows"), F.sum("n_pred").alias("n_pred"), F.sum("hit").alias("hit"), F.sum(F.when(F.col("loai") == CREDIT, F.col("n_truth"))).alias("n_credit_rows"), F.sum(F.when(F.col("loai") == CREDIT, F.col("hit"))).alias("credit_hit"))
    return summed.select("n_rows", rate(F.col("hit"), F.col("n_rows")).alias("row_recall"), rate(F.col("hit"), F.col("n_pred")).alias("row_precision"), "n_credit_rows", rate(F.col("credit_hit"), F.col("n_credit_rows")).alias("credit_row_recall"))
