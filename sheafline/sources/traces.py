"""Traces of decided bundles: all that a decision rests on, as one VARIANT a bundle.

A VARIANT holds a trace of any version, so tables of old and new runs are read together, and a field that a version does not
have is null. Values keep their types (dates, numbers, nested checks); paths are read without parsing text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DOC_TYPES, Thresholds, field_rows
from ..operators import fields

VERSION = "trace-2"
#: What extraction may add to decided bundles, and its type where it did not.
SPENT = {"latency_ms": "bigint", "n_calls": "bigint", "cost_usd": "double", "extract_errors": "array<string>", "model_outputs": "array<struct<doc_type:string,output:string>>"}


def trace(decided: DataFrame, model: str | None = None, prompt_version: str | None = None, limits: Thresholds | None = None) -> DataFrame:
    """bundle_id and trace of decided bundles; what extraction did not report is null. limits: those that fields were
    finalized with, for decided bundles whose fields are columns."""
    spent = [(F.col(c) if c in decided.columns else F.lit(None).cast(t)).alias(c) for c, t in SPENT.items()]
    cell = lambda c: F.struct(*(c[n].alias(n) for n in ("field", "kind", "critical", "raw", "page", "text", "day", "amount", "rows", "high", "error")))
    if "has_cccd" in decided.columns:  # fields that are columns are put together as they are written
        own = lambda d: F.array(*(cell(fields.cell(t, i, f, kind, critical)) for t, _, f, i, kind, critical in field_rows(limits) if t == d))
        read = F.array_compact(F.array(*(F.when(F.col(f"has_{d}"), F.struct(F.lit(d).alias("doc_type"), own(d).alias("fields"))) for d in DOC_TYPES)))
    else:
        read = F.transform(F.filter("docs", lambda d: d["readable"]), lambda d: F.struct(d["doc_type"].alias("doc_type"), F.transform(d["cells"], cell).alias("fields")))
    decision = F.struct("route", "reasons", "rules_version", "thresholds_version")
    whole = F.struct(F.lit(VERSION).alias("version"), F.lit(model).cast("string").alias("model"), F.lit(prompt_version).cast("string").alias("prompt_version"), *spent, "unreadable", read.alias("extractions"), "checks", decision.alias("decision"))
    return decided.select("bundle_id", F.to_variant_object(whole).alias("trace"))


def store_traces(traces: DataFrame, path: str, run_id: str) -> None:
    """Writes the traces of a run, in place of those it had before; other runs' stay."""
    traces.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def stored_traces(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """bundle_id, trace and run_id of all runs, or of one (others' files are not opened)."""
    found = spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string"))
    return found if run_id is None else found.filter(F.col("run_id") == run_id)


def scan_traces(spark: SparkSession, folder: str) -> DataFrame:
    """trace_id (a file's name without its ending) and trace of a folder of JSON documents, one a file, of any version. A
    file that is no JSON has a null trace."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("trace_id"), F.try_parse_json("value").alias("trace"))


def export_traces(traces: DataFrame, path: str) -> None:
    """One JSON line a bundle, for reading elsewhere."""
    traces.select("bundle_id", F.to_json("trace").alias("trace")).write.mode("overwrite").json(path)


def pick(fields: dict[str, tuple[str, str]], column: str = "trace") -> list[Column]:
    """Columns of a trace by path and type; null where the trace has no such field or one of another type."""
    return [F.try_variant_get(column, path, kind).alias(name) for name, (path, kind) in fields.items()]
