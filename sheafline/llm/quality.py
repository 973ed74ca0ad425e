"""Quality rules by compression bands.

Repetitive text compresses too well and random text hardly at all. Each text is compressed with zstandard as a whole and
in fixed chunks; the ratio (compressed over raw bytes) must lie in the band of its length, for short texts always
compress worse than long ones. Whole-text bands catch copies far apart; chunk bands catch a bad stretch that the rest of
a long text would average away.

Null and empty texts have no words and fail the base rules. A chunk that is the last of several and shorter than half a
chunk is judged with the one before it. Ties cannot arise; repeated rows are judged alike, and rows of one doc_id each by
their own text. A very long text is compressed a chunk at a time beside once as a whole; its repeated windows take some
hundred bytes a word. Extra columns are not read by `judge` and pass through `filter_quality`, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from itertools import compress

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .base import as_bytes, chunks, map_arrow

LEVEL = 3
CHUNK = 4096
#: (bytes from which it holds, least ratio, greatest ratio). Prose at this level has some 0.65 at 300 bytes, 0.5 at 2000 and
#: 0.4 at 30,000, and lies within a tenth of it; random letters and digits have 0.75 and more, hexadecimal ones 0.55.
BANDS = ((0, 0.5, 9.0), (128, 0.44, 1.0), (256, 0.42, 0.86), (512, 0.36, 0.78), (1024, 0.32, 0.68), (2048, 0.28, 0.62), (4096, 0.25, 0.58), (8192, 0.22, 0.55), (65536, 0.18, 0.54))
#: The same for chunks of a text of more than one; a chunk may repeat itself for a while in sound text (tables, lists).
CHUNK_BANDS = ((0, 0.15, 0.66),)
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words


def band(bands: tuple, size: int) -> tuple[float, float]:
    """The limits that hold for a size."""
    return next((low, high) for least, low, high in reversed(bands) if size >= least)


def pieces(data: bytes, size: int = CHUNK) -> list[bytes]:
    """Fixed chunks; a rest shorter than half a chunk stays with the chunk before it."""
    n = max(1, (len(data) + size // 2) // size)
    return [data[i * size : (i + 1) * size if i + 1 < n else len(data)] for i in range(n)]


def ratios(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Ratio of the whole text, and the least and greatest of its chunks (of the whole, if it is one chunk)."""
    if not data:
        return 0.0, 0.0, 0.0
    whole = len(packer.compress(data)) / len(data)
    parts = pieces(data)
    if len(parts) == 1:
        return whole, whole, whole
    each = [len(packer.compress(p)) / len(p) for p in parts]
    return whole, min(each), max(each)


def verdict(size: int, whole: float, least: float, most: float) -> bool:
    """Whether all ratios are within their bands."""
    low, high = band(BANDS, size)
    if not low <= whole <= high:
        return False
    if size <= CHUNK + CHUNK // 2:
        return True
    low, high = band(CHUNK_BANDS, size)
    return low <= least and most <= high


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside any window of `window` words that the text has twice or more."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    n = Counter(grams)
    covered = bytearray(len(words))
    one = b"\x01" * window
    for i in compress(range(len(grams)), [n[g] > 1 for g in grams]):
        covered[i : i + window] = one
    return covered.count(1)


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\f")]
    return len(lines) - len(set(lines))


def measure(data: bytes, packer: zstandard.ZstdCompressor) -> tuple:
    """n_words, the base measures, base_failed, kept and the three ratios of a text."""
    words = data.split()
    letters = b"".join(words)
    n = len(words)
    again = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * again > MOST_REPEATED * n
    found = ratios(data, packer)
    return n, len(letters.decode()), len(letters) - len(letters.translate(None, SYMBOLS)), repeated_lines(data), again, failed, not failed and verdict(len(data), *found), *found


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and the three ratios, one row for each row of docs."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in chunks(batch):
                columns = list(zip(*(measure(data, packer) for data in as_bytes(part.column("text"))), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:7]), *(pa.array(c, pa.float64()) for c in columns[7:])], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "least_chunk", "most_chunk"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in names[1:6]) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in names[8:]))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, each judged by its own text alone, with all their columns."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array([measure(data, packer)[6] for data in as_bytes(part.column("text"))], pa.bool_()))

    return map_arrow(docs, run, docs.schema.simpleString()[7:-1])
