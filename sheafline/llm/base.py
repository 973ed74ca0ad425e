"""Shared helpers: Arrow batches as byte arrays, bounded work chunks, row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import discard, intermediate, shared_folder, stored

__all__ = ["as_bytes", "chunks", "crc32_sql", "discard", "fresh", "intermediate", "map_arrow", "numbered", "raw", "remainder", "shared_folder", "stored", "table", "tidy", "unused"]

#: Bytes of text that a Python worker holds in derived arrays at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow. Spark bounds its batches by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB), so that long texts
    come in few rows; `chunks` takes them on in smaller parts."""
    return df.mapInArrow(function, schema)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of a column as text, modulo divisor (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that nothing refers to any more: its cleaner waits for the driver to collect
    garbage, which many small jobs may not bring about for long."""
    spark._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """df with these text or number columns as new expressions: how they are partitioned is not known any more, so a join
    by them reads shuffled rows alone. Adaptive execution can split the partitions of hot keys only then."""
    text = {n for n, kind in df.dtypes if kind == "string"}
    return df.select(*(F.concat(F.col(c), F.lit("")).alias(c) if c in names and c in text else F.col(c).bitwiseXOR(F.lit(0).cast("long")).alias(c) if c in names else F.col(c) for c in df.columns))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, or as many underscores before them as it takes that df has none of them."""
    taken = {c.lower() for c in df.columns}
    while any(n.lower() in taken for n in names):
        names = tuple(f"_{n}" for n in names)
    return [*names]


def chunks(batch: pa.RecordBatch, column: str | pa.Array = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of the column (or of an array beside it) each."""
    col = batch.column(column) if isinstance(column, str) else column
    offsets = np.frombuffer(col.buffers()[1], "<i4", count=len(col) + 1, offset=col.offset * 4) if len(col) else np.zeros(1, "i4")
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets into them (null: empty)."""
    if len(col) == 0 or col.buffers()[2] is None:
        return np.zeros(0, "u1"), np.zeros(len(col) + 1, "i8")
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], "<i4", count=len(col) + 1, offset=col.offset * 4).astype("i8")
    data = np.frombuffer(col.buffers()[2], "u1") if col.buffers()[2] is not None else np.zeros(0, "u1")
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def as_bytes(col: pa.Array) -> list[bytes]:
    """Each text as bytes (null: empty)."""
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def numbered(rows: DataFrame, by: str, order: list, name: str) -> DataFrame:
    """rows (a stored table: it is read twice) with their place in the order, from 0, among the rows of equal `by`, which
    must come first in the order. Rows are sorted by range into runs, also by a hash of their row number, which deals rows
    of equal keys to many runs; a task counts on within its run, and the driver adds what earlier runs hold of a run's first
    value: one row a run."""

    def count_on(batches):
        run, before, place, at, first = TaskContext.get().partitionId(), None, 0, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = batch.column(by) if before is None else pa.concat_arrays([before, batch.column(by)])
            a, b = col.slice(0, len(col) - 1), col.slice(1)
            new = pc.if_else(pc.xor(a.is_null(), b.is_null()), True, pc.fill_null(pc.not_equal(a, b), False)).to_numpy(zero_copy_only=False)
            if before is None:
                new = np.concatenate([[False], new])
            i = np.arange(n)
            last = np.maximum.accumulate(np.where(new, i, -1))
            places = np.where(last < 0, place + i, i - last)
            heads = first & (last < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(np.full(n, run), pa.int32()), pa.array(at + i, pa.int64()), pa.array(heads, pa.bool_())], [*batch.schema.names, name, *own])
            before, place, at, first = batch.column(by).slice(n - 1), int(places[-1]) + 1, at + n, bool(heads[-1])

    spark = rows.sparkSession
    salt, *own = unused(rows, "_salt", "_run", "_at", "_head")
    keys = [*order, F.xxhash64(F.col(salt))]
    runs = rows.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(salt)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    runs = stored(map_arrow(runs, count_on, f"{kinds}, `{name}` long, `{own[0]}` int, `{own[1]}` long, `{own[2]}` boolean"), "runs")
    run, at, head = own
    ends = runs.groupBy(run).agg(F.min_by(by, at).alias("first"), F.max_by(by, at).alias("last"), F.max_by(name, at).alias("place"), F.bool_and(head).alias("whole")).orderBy(run).collect()
    offsets, before, carry = [], None, 0
    for k, r in enumerate(ends):
        offset = carry if k and r["first"] == before else 0
        offsets.append((r[run], offset))
        before, carry = r["last"], r["place"] + 1 + (offset if r["whole"] else 0)
    add = F.broadcast(spark.createDataFrame(offsets, f"`{run}` int, `{salt}` long"))
    return runs.join(add, run).withColumn(name, F.col(name) + F.when(F.col(head), F.col(salt)).otherwise(0)).drop(salt, *own)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the crc32 of a text's UTF-8 bytes, which DuckDB has no function for."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    data = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({data}, lambda a, b: xor(a >> 8, ({table})[CAST((xor(a, b) & 255) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
