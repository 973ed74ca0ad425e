"""Importance resampling towards a target distribution.

Texts and targets are bags of word n-grams hashed to buckets. The gain of a bucket is the scaled log ratio of its smoothed
share in the targets to that in all documents; a document's weight is the sum of its features' gains, and documents are
drawn without replacement by the greatest weight plus a Gumbel variate made of the document's number (Gumbel top-k).

Long texts are cut into chunks that overlap: a chunk ends at a word border, owns the n-grams that start in its own words
and carries the n - 1 words that follow, so every n-gram is counted once. Chunks are dealt to all tasks one by one; bucket
counts are summed over chunks, and counts and weights of a document over its chunks. A text up to CHUNK_BYTES is one chunk
and stays where it is. A worker holds one chunk at a time; only a single word may make a chunk longer.

What is counted is the whole corpus: each task adds up its buckets (a fixed number) before they are shuffled, and gains are
one table of that many numbers. Drawing sorts by range, equal scores spread over tasks, and ranks by sorted runs.

Null, empty and wordless texts have no features: weight 0 and never drawn. Repeated rows are documents of their own; those
of one doc_id and text get the same weight and score each. Ties of score go to the smaller doc_id (null first). A null
doc_id has the variate of the empty number. An empty table gives an empty one, empty targets a gain by smoothing alone.
Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import as_bytes, chunks, crc32_sql, map_arrow, numbered, stored

ORDER = 3
BUCKETS = 10_000
#: Bytes from which a text is cut.
CHUNK_BYTES = 1 << 18
#: Features that a worker holds before it counts them.
HELD = 1 << 19
SCALE = 1000
SEED = 42
PERCENT = 5
LEAST_WORDS = 20

#: Bytes as they are read: A-Z lower-cased, all but digits, letters and bytes over 127 as spaces.
_READ = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_READ).split()


def features(words: list[bytes], own: int, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the n-grams that start in the first `own` words; crc32 carries on from the (n-1)-gram."""
    spaced, grown, out = [b" " + w for w in words], [*map(crc32, words)], []
    for n in range(order):
        if n:
            grown = [*map(crc32, islice(spaced, n, None), grown)]
        out.append(np.fromiter(islice(grown, own), "u4"))
    return (np.concatenate(out) % buckets).astype("i8")


def cut(text: bytes, size: int, carry: int) -> list[tuple[bytes, int]]:
    """Chunks of a text as (bytes, own words): each begins with a word, about `size` bytes on, and carries words."""
    text = text.translate(_READ)
    ends = [0]
    while ends[-1] + size < len(text):
        at = text.find(b" ", ends[-1] + size)
        ends.append(len(text) if at < 0 else at)
    if ends[-1] < len(text):
        ends.append(len(text))
    out = []
    for lo, hi in zip(ends, ends[1:], strict=False):
        own = len(text[lo:hi].split())
        if own:
            out.append((text[lo : after(text, hi, carry)], own))
    return out or [(b"", 0)]


def after(text: bytes, at: int, carry: int) -> int:
    """Where the `carry` words that begin at or after a place end."""
    for _ in range(carry):
        while at < len(text) and text[at] == 0x20:
            at += 1
        end = text.find(b" ", at)
        at = len(text) if end < 0 else end
    return at


def chunked(docs: DataFrame, size: int = CHUNK_BYTES, order: int = ORDER) -> DataFrame:
    """The chunks of the long texts, dealt to all tasks: doc_id, print (of the text), chunk, own, part (bytes)."""

    def run(batches):
        names = ["doc_id", "print", "chunk", "own", "part"]
        for batch in batches:
            for i, text in enumerate(as_bytes(batch.column("text"))):
                for k, (part, own) in enumerate(cut(text, size, order - 1)):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), batch.column("print").slice(i, 1), pa.array([k], pa.int64()), pa.array([own], pa.int64()), pa.array([part], pa.binary())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    long = docs.filter(F.octet_length("text") > size).select("doc_id", "text", F.sha2("text", 256).alias("print"))
    return map_arrow(long, run, f"doc_id {kind}, print string, chunk long, own long, part binary").repartition("doc_id", "print", "chunk")


def short(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    return docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= size).select("doc_id", "text")


def parts_of(batch: pa.RecordBatch):
    """(bytes, own words or None for all) of the rows of a batch of chunks or of short texts."""
    if "part" in batch.schema.names:
        yield from zip(batch.column("part").to_pylist(), batch.column("own").to_pylist(), strict=True)
    else:
        for part in chunks(batch):
            yield from ((text, None) for text in as_bytes(part.column("text")))


def bucket_counts(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS, size: int = CHUNK_BYTES) -> DataFrame:
    """bucket and n over all texts of docs; a task adds up its own before they are shuffled."""

    def run(batches):
        total, held, size = np.zeros(buckets, "i8"), [], 0
        for batch in batches:
            for text, own in parts_of(batch):
                words = words_of(text)
                held.append(features(words, len(words) if own is None else own, order, buckets))
                size += len(held[-1])
                if size > HELD:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    texts = docs.select(F.lit(0).alias("doc_id"), "text")
    counted = [map_arrow(part, run, "bucket long, n long") for part in (short(texts, size), chunked(texts, size, order))]
    return counted[0].union(counted[1]).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, targets: DataFrame, order: int = ORDER, buckets: int = BUCKETS, size: int = CHUNK_BYTES) -> np.ndarray:
    """The gain of every bucket."""
    source, target = np.zeros(buckets), np.zeros(buckets)
    for counts, frame in ((source, docs), (target, targets)):
        for r in bucket_counts(frame, order, buckets, size).collect():  # `buckets` rows at most
            counts[r["bucket"]] = r["n"]
    s, t = float(source.sum()) + buckets, float(target.sum()) + buckets
    return np.array([math.floor(SCALE * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], "i8")


def weights(docs: DataFrame, gain: np.ndarray, order: int = ORDER, size: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            found = []
            for text, own in parts_of(batch):
                words = words_of(text)
                own = len(words) if own is None else own
                got = features(words, own, order, buckets)
                found.append((own, len(got), int(gain[got].sum())))
            keys = [c for c in batch.schema.names if c in ("doc_id", "print", "chunk")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))], [*keys, *measures])

    measures = ["n_words", "n_features", "weight"]
    made = ", ".join(f"{m} long" for m in measures)
    whole = map_arrow(short(docs, size), run, f"doc_id {kind}, {made}")
    summed = map_arrow(chunked(docs, size, order), run, f"doc_id {kind}, print string, chunk long, {made}").groupBy("doc_id", "print").agg(*(F.sum(m).alias(m) for m in measures), F.count_if(F.col("chunk") == 0).alias("rows"))
    rows = summed.select("doc_id", *(F.expr(f"{m} div rows").alias(m) for m in measures), F.explode(F.sequence(F.lit(1), "rows")).alias("row")).drop("row")
    return whole.unionByName(rows)


def variate(seed: int = SEED) -> Column:
    """The scaled Gumbel variate of a doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of all rows of `weights`."""
    scored = stored(weighed.withColumn("score", F.col("weight") + variate(seed)), "scores")
    enough = F.col("n_words") >= least_words
    n = scored.filter(enough).count() * percent // 100
    ranked = numbered(scored.filter(enough).withColumn("one", F.lit(0)), "one", ["one", F.desc("score"), F.asc("doc_id")], "rank")
    rank = F.when(F.col("rank") < n, F.col("rank") + 1).alias("rank")
    columns = "doc_id", "n_features", "weight", "score"
    return ranked.select(*columns, rank).union(scored.filter(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, targets: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of docs with its number of features, weight and score, and its rank among those drawn."""
    return draw(weights(docs, gains(docs, targets)), percent, least_words, seed)


def oracle_sql() -> str:
    """DuckDB SQL for op13: each different feature is hashed once."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = lambda source: f"SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM {source}"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {words} AS w FROM documents
), b AS MATERIALIZED (SELECT 0 AS id, {words} AS w FROM benchmark
), df AS MATERIALIZED (SELECT id, g, count(*) AS n FROM ({grams("d")}) GROUP BY id, g
), bf AS MATERIALIZED (SELECT g, count(*) AS n FROM ({grams("b")}) GROUP BY g
), buckets AS MATERIALIZED (SELECT g, {crc32_sql("g")} % {BUCKETS} AS bucket FROM (SELECT g FROM df UNION SELECT g FROM bf)
), s AS (SELECT bucket, sum(n) AS n FROM df JOIN buckets USING (g) GROUP BY bucket
), t AS (SELECT bucket, sum(n) AS n FROM bf JOIN buckets USING (g) GROUP BY bucket
), gain AS (
  SELECT k.bucket, CAST(floor({SCALE} * ln((coalesce(t.n, 0)::DOUBLE + 1) * (coalesce((SELECT sum(n) FROM df), 0)::DOUBLE + {BUCKETS}) / ((coalesce(s.n, 0)::DOUBLE + 1) * (coalesce((SELECT sum(n) FROM bf), 0)::DOUBLE + {BUCKETS})))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(0, {BUCKETS})) AS bucket) k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), weighed AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM df JOIN buckets USING (g) JOIN gain USING (bucket) GROUP BY id
), scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(x.n_features, 0) AS n_features, coalesce(x.weight, 0) AS weight,
         coalesce(x.weight, 0) + CAST(floor(-{SCALE} * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed x USING (id)
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= {LEAST_WORDS} AND row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) <= {PERCENT} * count(*) OVER (PARTITION BY n_words >= {LEAST_WORDS}) // 100
            THEN row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) END AS rank
FROM scored
"""
