"""Benchmark decontamination by a hash set of normalised test n-grams.

Words are runs of digits, lower-cased ASCII letters and anything beyond ASCII. A benchmark item is the set of its windows
of `WINDOW` words (a shorter item is one window). Every window of a document is hashed and looked up in the sorted hashes
of all test windows; hits are verified word by word. Hit words can be removed as spans, or documents as a whole.

The test set is broadcast in blocks of at most BLOCK_WORDS words of windows, so that what a worker holds is bounded
however large the benchmark grows. Each further block is one more scan over rows that carry what was hit so far; between two
blocks the rows are written to the shared folder and the block before is released. Nothing is shuffled.

Null texts have no words. Items without words hit nothing, null item ids mark words but are not counted as items. Equal
items all count. Repeated rows and ids are judged each by its own text. A text is scanned a document at a time, some 60
bytes a word. Extra columns pass untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_bytes, chunks, discard, intermediate, map_arrow, stored

WINDOW = 10
#: Words of benchmark text in one broadcast block (some 60 bytes each in a worker).
BLOCK_WORDS = 1_000_000
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words(data: bytes) -> list[bytes]:
    return _WORD.findall(data.lower())


class TestSet:
    """Windows of benchmark items. A window is a row of word numbers; equal windows are kept once."""

    __test__ = False  # not a pytest class

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.names: list[str] = []
        rows: dict[int, list] = defaultdict(list)
        owner: dict[int, list] = defaultdict(list)
        for name, data in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words(data)]
            if not ids:
                continue
            size = min(window, len(ids))
            view = np.lib.stride_tricks.sliding_window_view(np.array(ids, "i8"), size)
            rows[size].append(view)
            owner[size].append(np.full(len(view), -1 if name is None else len(self.names)))
            if name is not None:
                self.names.append(name)
        for size in sorted(rows):
            unique, which = np.unique(np.concatenate(rows[size]), axis=0, return_inverse=True)
            order = np.argsort(which := which.reshape(-1), kind="stable")
            items_of = np.concatenate(owner[size])[order]
            starts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(unique)))])
            hashes = self.mix(unique)
            by = np.argsort(hashes, kind="stable")
            self.tables.append((size, hashes[by], unique[by].astype("i4"), starts, items_of))
            self.tables[-1] += (by,)  # the window's place in starts

    @staticmethod
    def mix(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), "u8")
        for j in range(rows.shape[1]):
            h = (h ^ (rows[:, j].astype("u8") + np.uint64(1))) * _FACTOR
            h ^= h >> np.uint64(29)
        return h

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """For word numbers (-1: in no item): which words are hit, and the items hit."""
        hit, found = np.zeros(len(ids) + 1, "i4"), set()
        for size, hashes, rows, starts, items_of, by in self.tables:
            if len(ids) < size:
                continue
            known = np.concatenate([[0], np.cumsum(ids >= 0)])
            at = np.nonzero(known[size:] - known[:-size] == size)[0]
            if not len(at):
                continue
            own = ids[at[:, None] + np.arange(size)]
            h = self.mix(own)
            first, last = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            maybe = np.nonzero(first < last)[0]
            for i in maybe.tolist():
                for j in range(first[i], last[i]):
                    if (rows[j] == own[i]).all():
                        hit[at[i]] += 1
                        hit[at[i] + size] -= 1
                        w = by[j]
                        found.update(items_of[starts[w] : starts[w + 1]].tolist())
        found.discard(-1)
        return np.cumsum(hit[:-1]) > 0, found


def test_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[TestSet]:
    """The benchmark as test sets of bounded size, brought to the driver one after another."""
    items, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("text").isNotNull()).toLocalIterator(prefetchPartitions=False):
        data = r["text"].encode()
        n = len(data) // 4 + 1
        if items and size + n > block_words:
            yield TestSet(items, window)
            items, size = [], 0
        items.append((r["item_id"], data))
        size += n
    yield TestSet(items, window)


def scan(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW, whole: bool = False) -> DataFrame:
    """doc_id (or with `whole` the struct __doc of all columns), __n (words), __runs (start and end of the maximal runs of
    hit words, in one array) and __items, one row for each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("__doc")) if whole else docs.select("doc_id", "text")
    own = rows.columns
    found = "__n long, __runs array<bigint>, __items array<string>"
    schema = rows.schema.simpleString()[7:-1]

    def block(rows: DataFrame, shared) -> DataFrame:
        first = rows.columns == own

        def run(batches):
            test = shared.value
            number = test.number.get
            for batch in batches:
                for part in chunks(batch, batch.column("__doc").field("text") if whole else "text"):
                    text = part.column("__doc").flatten()[names.index("text")] if whole else part.column("text")
                    n, runs, items = [], [], []
                    for data in as_bytes(text):
                        words_ = words(data)
                        n.append(len(words_))
                        hit, got = test.scan(np.fromiter((number(w, -1) for w in words_), "i8", len(words_)))
                        runs.append(np.nonzero(np.diff(np.concatenate([[False], hit, [False]]).astype("i1")))[0].tolist())
                        items.append(sorted(test.names[i] for i in got))
                    if not first:
                        runs = [a + b for a, b in zip(part.column("__runs").to_pylist(), runs, strict=True)]
                        items = [a + b for a, b in zip(part.column("__items").to_pylist(), items, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], [*own, "__n", "__runs", "__items"])

        return map_arrow(rows, run, f"{schema}, {found}")

    names = docs.columns
    several, before, folder = False, None, None
    for test in test_blocks(benchmark, block_words, window):
        if before is not None:
            several, last, folder = True, folder, intermediate(spark, "decontaminated")
            rows = stored(block(rows, before), "decontaminated", folder)
            before.unpersist()
            if last:
                discard(spark, last)
        before = spark.sparkContext.broadcast(test)
    rows = block(rows, before)
    rows = rows.withColumn("__runs", merge_runs(F.col("__runs"))) if several else rows
    return rows if whole else rows.drop("text")


def merge_runs(runs):
    """Runs given as start, end, start, end, ... in any order, united."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest((F.size(runs) / 2 - 1).cast("int"), F.lit(0))), lambda i: F.struct(F.get(runs, i * 2).alias("a"), F.get(runs, i * 2 + 1).alias("b"))))
    pairs = F.filter(pairs, lambda p: p["a"].isNotNull())
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")

    def add(done, p):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], p["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (last["b"] >= p["a"]), joined).otherwise(F.concat(done, F.array(p)))

    return F.flatten(F.transform(F.aggregate(pairs, empty, add), lambda p: F.array(p["a"], p["b"])))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found = scan(docs, benchmark, **options)
    size = lambda a: F.aggregate(F.transform(a, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return found.select(
        "doc_id", F.col("__n").alias("n_words"), size(F.col("__runs")).alias("n_hit"), F.size(F.array_distinct("__items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.array_distinct("__items")), ","), 256).alias("items_sha256"), (F.size("__runs") > 0).alias("contaminated"),
    )


def cut(data: bytes, runs: list[int]) -> bytes:
    """A text without the words of the runs; what stood between them goes too, and one space stays where a span was."""
    spans = [m.span() for m in _WORD.finditer(data.lower())]
    out, at = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out.append(data[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, data[at:]])


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", **options) -> DataFrame:
    """docs without what the benchmark has: its spans cut out, or (`documents`) the rows with a hit dropped.

    Rows without a hit are unchanged. A null text stays null.
    """
    names = docs.columns
    found = scan(docs, benchmark, whole=True, **options)
    if remove == "documents":
        return found.filter(F.size("__runs") == 0).select("__doc.*")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, batch.column("__doc").field("text")):
                columns = dict(zip(names, part.column("__doc").flatten(), strict=True))
                texts = columns["text"].cast(pa.binary()).to_pylist()
                runs = part.column("__runs").to_pylist()
                columns["text"] = pa.array([None if t is None else cut(t, r).decode() if r else t.decode() for t, r in zip(texts, runs, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values()], names)

    return map_arrow(found.select("__doc", "__runs"), run, docs.schema.simpleString()[7:-1])
