"""Pages read through a model as a Spark data source: spark.read.format("extracted_pages").load(folder of pages).

`write_pages` stores the pages of documents, a row each, sorted by bundle, in row groups of a few hundred. The source has
them once for each pass (column `variant`) and calls the extractor's service where it is read. The plan is made from the
files' footers alone: a partition is up to `pages_per_partition` rows of a row group, or of several, in one pass, so tasks
hold about equally many calls however pages are spread over documents. Where that is not given it is 256, or more if there
would be over 1024 partitions: a task of a Python source takes some 0.1 s of its own. Filters on bundle_id and variant are pushed down: passes are
left out, row groups are pruned by their least and greatest bundle, and rows before anything is sent. A read without
filters calls for every page.

Readers of data sources run outside Spark and open files by pyarrow, so the folder must be one it can open (a shared mount,
or a store it knows by address). Equal pages of one partition are asked for once, as one row; across partitions a key may
come again, and `dropDuplicates(["key"])` leaves one. Null bundles are read and match no filter but that for null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..model import SCHEMA
from .extract import KEY_LENGTH, REPLIES, HttpExtractor, reply_batches

PAGES_PER_PARTITION, PARTITIONS = 256, 1024
#: Row groups of a file at most. Every partition reads its file's footer, which is as long as the file has groups.
GROUPS_PER_FILE = 64
VARIANTS = (0, 1)
STORED = ["bundle_id", "doc_id", "doc_type", "page", "n", "data"]


def write_pages(docs: DataFrame, path: str, rows_per_group: int = PAGES_PER_PARTITION) -> None:
    """Stores the pages (an array of bytes) of docs for the source, sorted by bundle."""
    each = docs.select(F.col("bundle_id").cast("string").alias("bundle_id"), F.col("doc_id").cast("string").alias("doc_id"), "doc_type", F.size("pages").alias("n"), F.posexplode("pages").alias("page", "data"))
    pages = each.withColumn("page", F.col("page") + 1).select(*STORED)
    pages.repartitionByRange("bundle_id", "doc_id", "page").sortWithinPartitions("bundle_id", "doc_id", "page").write.option("parquet.block.row.count.limit", rows_per_group).option("maxRecordsPerFile", GROUPS_PER_FILE * rows_per_group).parquet(path)


@dataclass
class Slice(InputPartition):
    """Rows of row groups, in one pass; start counts from the first of the groups."""

    file: str
    groups: list[int]
    start: int
    rows: int
    variant: int


#: What a filter asks of a value, given the filter's own.
_TESTS = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, IsNotNull: lambda x, v: True}
#: Whether a range of values may have one that passes.
_REACHES = {EqualTo: lambda a, b, v: a <= v <= b, In: lambda a, b, v: any(a <= x <= b for x in v), GreaterThan: lambda a, b, v: b > v, GreaterThanOrEqual: lambda a, b, v: b >= v, LessThan: lambda a, b, v: a < v, LessThanOrEqual: lambda a, b, v: a <= v, IsNotNull: lambda a, b, v: True}


def key_of(extractor: HttpExtractor, page: dict) -> str:
    """The key of a page, the same as that of `HttpExtractor.pages`."""
    fields = ",".join(f"{f} ({k})" for f, k in SCHEMA[page["doc_type"]])
    asked = [extractor.name, extractor.prompt_version, page["doc_type"], fields, str(page["page"]), str(page["n"]), str(page["variant"]), hashlib.sha256(page["data"]).hexdigest()]
    return hashlib.sha256("|".join(asked).encode()).hexdigest()[:KEY_LENGTH]


def pieces(groups: list[tuple[int, int]], size: int) -> list[tuple[list[int], int, int]]:
    """Row groups (number, rows) as pieces (groups, start, rows) of up to `size` rows: parts of one, or several whole ones."""
    out: list[tuple[list[int], int, int]] = []
    for g, n in groups:
        if out and out[-1][1] == 0 and out[-1][2] + n <= size:
            out[-1] = ([*out[-1][0], g], 0, out[-1][2] + n)
        else:
            out += [([g], start, min(size, n - start)) for start in range(0, n, size)]
    return out


class PageReader(DataSourceReader):
    def __init__(self, extractor: HttpExtractor, path: str, pages_per_partition: int | None = None):
        self.extractor, self.path, self.size = extractor, path, pages_per_partition
        self.filters: dict[str, list[Filter]] = {"bundle_id": [], "variant": []}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("bundle_id",), ("variant",)):
                self.filters[f.attribute[0]].append(f)
            else:
                yield f

    def passes(self, column: str, value) -> bool:
        wanted = self.filters[column]
        return not wanted or value is not None and all(_TESTS[type(f)](value, getattr(f, "value", None)) for f in wanted)

    def may_have(self, column: pq.ColumnChunkMetaData) -> bool:
        """Whether a row group may have a bundle that passes, by its statistics."""
        wanted, known = self.filters["bundle_id"], column.statistics
        if not wanted or known is None or not known.has_min_max:
            return not wanted or known is None or known.null_count != column.num_values
        return all(_REACHES[type(f)](known.min, known.max, getattr(f, "value", None)) for f in wanted)

    def store(self) -> tuple[pafs.FileSystem, str]:
        path = self.path.removeprefix("file:") if self.path.startswith("file:/") else self.path
        return (pafs.LocalFileSystem(), "/" + path.lstrip("/")) if "://" not in path else pafs.FileSystem.from_uri(path)

    def partitions(self) -> list[Slice]:
        files, folder = self.store()
        variants, found = [v for v in VARIANTS if self.passes("variant", v)], []
        for info in sorted(files.get_file_info(pafs.FileSelector(folder)), key=lambda f: f.path):
            if not info.path.endswith(".parquet") or not variants:
                continue
            with files.open_input_file(info.path) as f:
                footer = pq.ParquetFile(f).metadata
            at = footer.schema.names.index("bundle_id")
            groups = [(g, footer.row_group(g)) for g in range(footer.num_row_groups)]
            found.append((info.path, [(g, group.num_rows) for g, group in groups if self.may_have(group.column(at))]))
        pages = len(variants) * sum(n for _, groups in found for _, n in groups)
        size = self.size or max(PAGES_PER_PARTITION, -(-pages // PARTITIONS))
        return [Slice(path, *part, v) for path, groups in found for part in pieces(groups, size) for v in variants]

    def rows(self, part: Slice) -> Iterator[dict]:
        files, _ = self.store()
        at, seen = 0, set()
        with files.open_input_file(part.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(min(64, part.rows), row_groups=part.groups, columns=STORED):
                lo, hi = max(part.start - at, 0), min(part.start + part.rows - at, batch.num_rows)
                at += batch.num_rows
                if lo < hi:
                    for row in batch.slice(lo, hi - lo).to_pylist():
                        row["variant"] = part.variant
                        if self.passes("bundle_id", row["bundle_id"]):
                            row["key"] = key_of(self.extractor, row)
                            if row["key"] not in seen:
                                seen.add(row["key"])
                                yield row
                if at >= part.start + part.rows:
                    break

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.rows:
            yield from reply_batches(self.extractor.ask(self.rows(partition)))


def page_source(extractor: HttpExtractor) -> type[DataSource]:
    """The source over an extractor, for spark.dataSource.register."""

    class ExtractedPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return "extracted_pages"

        def schema(self) -> str:
            return REPLIES

        def reader(self, schema) -> PageReader:
            return PageReader(extractor, self.options["path"], int(self.options["pages_per_partition"]) if "pages_per_partition" in self.options else None)

    return ExtractedPages


def read_pages(extractor: HttpExtractor, docs: DataFrame, path: str, **options) -> DataFrame:
    """Stores the pages of docs and opens them as a source, with filters pushed down."""
    spark = docs.sparkSession
    write_pages(docs, path, int(options.get("pages_per_partition", PAGES_PER_PARTITION)))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(page_source(extractor))
    return spark.read.format("extracted_pages").options(**options).load(path)
