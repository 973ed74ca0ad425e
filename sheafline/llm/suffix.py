"""Removal of repeated substrings by suffix buckets with a sampled cover.

Every byte covered by a SPAN-byte string that starts anywhere else too goes. Texts are UTF-8 bytes; strings do not cross
texts. What must be known of each start is whether the suffix there shares its first SPAN bytes with another, so suffixes
are sorted in buckets, no further than SPAN bytes, and never all at once:

1. Buckets. Each start belongs to one anchor: the leftmost position among those of its SPAN bytes where the hash of GRAM
   bytes is least. Equal strings have equal anchors at equal distances, so suffixes in different buckets differ. A run of
   neighbouring starts with one anchor is one row: the anchor's hash and a digest of the run's context, the bytes of all
   its strings. Only these rows are shuffled, some 2 for every SPAN - GRAM bytes, and anchors seen once end here. Runs of a
   text that repeat each other at equal distances (periodic text) are one row.
2. Equal contexts. Rows of a bucket with equal digests repeat each other in all their starts. The digests are
   cryptographic (BLAKE2b of 128 bits), so equal digests are taken for equal bytes. They are counted with map-side
   combination: a passage in a third of all documents, or any number of copies, is one row a task, and is sorted once.
3. Different contexts of one bucket are sorted one bucket at a time. Aligned on the anchor, the suffixes to be compared
   are congruent, so of a difference cover modulo BLOCK the residue 0 alone covers every pair: the positions at multiples
   of BLOCK from the anchor are ranked first (11 blocks, by doubling pairs of ranks), and a suffix is ordered by its bytes
   up to the next of them, that one's rank, and the few bytes after. A long tie is one comparison of ranks.
4. A bucket of more than BUCKET different contexts is sorted by Spark instead of one task, by the same keys: the cover's
   ranks are replaced by names that need no sorting (digests of their 11 blocks), and the keys of all suffixes are counted
   with map-side combination, in as many tasks as there are. So memory is bounded whatever a bucket's size.

Rows with equal text have equal results, so they share one key, the text's digest. Null texts are empty; texts shorter
than SPAN keep every byte. A text longer than SEGMENT is read in parts whose starts are the text's own. Extra columns are
not read; repeated rows and ids stay, each with its own result: what is left of its text, and where bytes were removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_bytes, chunks, fresh, map_arrow, stored

SPAN = 400
GRAM = 128
BLOCK = 32
#: Different contexts of one anchor that one task sorts.
BUCKET = 1500
COVER = 11 * BLOCK  # bytes from a cover position that its rank stands for
#: Starts whose anchors a worker finds at a time.
SEGMENT = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at every position that has as many after it, by doubling."""
    h = data.astype("u8")
    for shift in (1, 2, 4):
        h = h[:-shift] | h[shift:] << np.uint64(8 * shift)
    size = 8
    while size < GRAM:
        h = (h[:-size] ^ (h[:-size] >> np.uint64(32))) * _A + h[size:] * _B
        h ^= h >> np.uint64(29)
        size *= 2
    return h * _A


def runs_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start, anchor and its hash, of every run of starts in one text (or part of one)."""
    n = len(data) - SPAN + 1
    if n <= 0:
        return (np.zeros(0, "i8"),) * 4
    value = _gram_hashes(data)
    at = np.arange(len(value), dtype="i4")
    full, width = SPAN - GRAM + 1, 1
    while width < full:  # leftmost least value in windows of growing width
        step = min(width, full - width)
        less = value[step:] < value[:-step]
        at = np.where(less, at[step:], at[:-step])
        value = np.where(less, value[step:], value[:-step])
        width += step
    first = np.concatenate([[0], np.nonzero(at[1:] != at[:-1])[0] + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return first, last, at[first].astype("i8"), value[first].view("i8")


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def pack(length: np.ndarray, lead: np.ndarray, step: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A run's starts after its first (below 2 ** 10), bytes before its anchor, and distance and number of its repeats."""
    return times << 40 | step << 20 | lead << 10 | length


def unpack(shape: int) -> tuple[int, int, int, int]:
    return shape & 1023, shape >> 10 & 1023, shape >> 20 & 0xFFFFF, shape >> 40


def rows_of(text: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor hashes, context digests (two numbers each), first starts and shapes of a text's runs, by segment."""
    out = []
    for base in range(0, max(1, len(text) - SPAN + 1), SEGMENT):
        piece = text[base : base + SEGMENT + SPAN - 1]
        first, last, at, hashes = runs_of(np.frombuffer(piece, "u1"))
        if not len(first):
            continue
        names = [digest(piece[a : b + SPAN]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        step, times, keep = np.zeros(len(first), "i8"), np.ones(len(first), "i8"), np.ones(len(first), bool)
        if len(set(names)) < len(names):
            places: dict[bytes, list[int]] = {}
            for i, name in enumerate(names):
                places.setdefault(name, []).append(i)
            for same in places.values():
                if len(same) > 1 and (np.diff(first[same]) == (apart := first[same[1]] - first[same[0]])).all():
                    keep[same[1:]] = False
                    step[same[0]], times[same[0]] = apart, len(same)
        names = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
        out.append((hashes[keep], names[keep], (first + base)[keep], pack(last - first, at - first, step, times)[keep]))
    return out


def _rows(batches):
    for batch in batches:
        for part in chunks(batch):
            found, key = [], []
            for name, text in zip(part.column("key").to_pylist(), as_bytes(part.column("text")), strict=True):
                for rows in rows_of(text):
                    found.append(rows)
                    key += [name] * len(rows[0])
            if key:
                anchor, names, lo, shape = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(key, pa.binary()), pa.array(lo), pa.array(shape)], ["anchor", "d1", "d2", "key", "lo", "shape"])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SENT = np.dtype([("anchor", "<i8"), ("lo", "<i8"), ("size", "<i4"), ("lead", "<i2"), ("large", "?"), ("full", "?")])


def _first_look(batches):
    """Texts with their runs in shared buckets: what is left, if no context is left to compare; else the text, packed. A text
    chosen to stand for its contexts sends them (rows of one key follow each other, so mostly once)."""
    zip_ = zstandard.ZstdCompressor(level=1).compress
    before = None
    for batch in batches:
        for part in chunks(batch):
            rows = []
            for doc, key, text, runs in zip(*(part.column(c).to_pylist() for c in ("doc_id", "key")), as_bytes(part.column("text")), part.column("runs").to_pylist(), strict=True):
                spans, sent, sends, open_ = [], [], [], False
                for r in runs or ():
                    length, lead, step, times = unpack(r["shape"])
                    lo, size = r["lo"], length + SPAN
                    if not r["full"]:
                        open_ = True
                    elif step <= size:
                        spans.append((lo, lo + step * (times - 1) + size))
                    else:
                        spans += [(lo + step * i, lo + step * i + size) for i in range(times)]
                    if r["send"] and key != before:
                        sent.append((r["anchor"], lo, size, lead, r["large"], r["full"]))
                        sends.append(text[lo : lo + size])
                if sent:
                    before = key
                spans = merge(spans)
                rows.append((doc, key, len(text), None if open_ else cut(text, spans), spans, zip_(text) if open_ else None, zip_(np.array(sent, _SENT).tobytes() + b"".join(sends)) if sent else None, len(sent)))
            c = list(zip(*rows, strict=True))
            kinds = [part.schema.field("doc_id").type, pa.binary(), pa.int64(), pa.binary(), _PLACES, pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["doc_id", "key", "n_bytes", "kept", "spans", "text", "sends", "n_sends"])


def repeated_starts(contexts: list[bytes], before: list[int]) -> list[np.ndarray]:
    """Of contexts of one anchor (their starts: one for each byte but the last SPAN - 1; `before`: bytes before the
    anchor), which starts' strings occur in two of them."""
    parts, first, at = [], [], 0
    for data, lead in zip(contexts, before, strict=True):
        pad = -(at + lead) % BLOCK
        parts += [b"\0" * pad, data]
        first.append(at + pad)
        at += pad + len(data)
    x = np.frombuffer(b"".join([*parts, b"\0" * (BLOCK - at % BLOCK + 12 * BLOCK)]), "u1")
    rank = lambda *keys: np.unique(np.stack(keys, axis=1), axis=0, return_inverse=True)[1].reshape(-1) if len(keys) > 1 else np.unique(keys[0], return_inverse=True)[1].reshape(-1)
    pair = lambda a, b: np.unique(a.astype("i8") << 32 | b, return_inverse=True)[1].reshape(-1)
    r1 = rank(np.ascontiguousarray(x[: len(x) // BLOCK * BLOCK].reshape(-1, BLOCK)).view(f"V{BLOCK}").reshape(-1))
    r2 = pair(r1[:-1], r1[1:])
    r4 = pair(r2[:-2], r2[2:])
    r8 = pair(r4[:-4], r4[4:])
    n = len(r8) - 3
    cover = pair(pair(r8[:n], r2[8 : 8 + n]), r1[10 : 10 + n])  # 11 blocks, 352 bytes
    sizes = [len(c) - SPAN + 1 for c in contexts]
    starts = np.concatenate([np.arange(f, f + s) for f, s in zip(first, sizes, strict=True)])
    view = np.lib.stride_tricks.sliding_window_view(x, 48)
    ahead = -starts % BLOCK
    key = np.zeros((len(starts), 88), "u1")
    span = np.arange(48)
    key[:, :32] = np.where(span[None, :32] < ahead[:, None], view[starts][:, :32], 0)
    key[:, 32:80] = np.where(span[None, :] < (48 - ahead)[:, None], view[starts + ahead + 11 * BLOCK], 0)
    key[:, 80:84] = cover[(starts + ahead) // BLOCK].astype("<u4").view("u1").reshape(-1, 4)
    key[:, 84] = ahead
    _, which, count = np.unique(key.view("V88").reshape(-1), return_inverse=True, return_counts=True)
    again = (count > 1)[which.reshape(-1)]
    return np.split(again, np.cumsum(sizes)[:-1])


def _buckets(batches):
    """Of contexts sorted by anchor, key and place, the byte ranges that repeat, by key."""
    name, held = None, []

    def done():
        if len(held) < 2:
            return
        found = repeated_starts([h[2] for h in held], [h[4] for h in held])
        keys, spans = [], []
        for (key, lo, _, full, _), again in zip(held, found, strict=True):
            if full or not again.any():
                continue
            edges = np.nonzero(np.diff(np.concatenate([[0], again.astype("i1"), [0]])))[0]
            keys.append(key)
            spans.append([x for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) for x in (lo + a, lo + b - 1 + SPAN)])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(spans, pa.list_(pa.int64()))], ["key", "more"])

    for batch in batches:
        for anchor, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "lo", "context", "full", "lead")), strict=True):
            if anchor != name:
                yield from done()
                name, held = anchor, []
            if not held or row[:2] != held[-1][:2]:  # a context may have been sent twice
                held.append(row)
    yield from done()


def _contexts(batches):
    unzip = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for key, n, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "n_sends", "sends")), strict=True):
            data = unzip(packed)
            sent = np.frombuffer(data, _SENT, n)
            ends = n * _SENT.itemsize + np.cumsum(sent["size"], dtype="i8")
            context = [data[a:b] for a, b in zip((ends - sent["size"]).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sent["anchor"].copy()), pa.array([key] * n, pa.binary()), pa.array(sent["lo"].copy()), pa.array(context, pa.binary()), pa.array(sent["lead"].astype("i4")), pa.array(sent["full"].tolist(), pa.bool_()), pa.array(sent["large"].tolist(), pa.bool_())], ["anchor", "key", "lo", "context", "lead", "full", "large"])


def suffix_keys(data: bytes, lead: int) -> list[bytes]:
    """Digests of the sort keys of a context's suffixes: bytes up to the next cover position, its name, bytes after."""
    names, out = {}, []
    for start in range(len(data) - SPAN + 1):
        at = start + (lead - start) % BLOCK
        if (name := names.get(at)) is None:
            name = names[at] = digest(data[at : at + COVER])
        out.append(digest(bytes([at - start]) + data[start:at] + name + data[at + COVER : start + SPAN]))
    return out


def _strings(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            anchor, key, lo, data, lead, full = (batch.column(c)[row].as_py() for c in ("anchor", "key", "lo", "context", "lead", "full"))
            names = np.frombuffer(b"".join(suffix_keys(data, lead)), "<i8").reshape(-1, 2)
            n = len(names)
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array([anchor] * n, pa.int64()), pa.array([key] * n, pa.binary()), pa.array(np.arange(lo, lo + n)), pa.array([full] * n)], ["h1", "h2", "anchor", "key", "at", "full"])


def _finish(batches):
    unzip = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for packed, spans, more in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "more")), strict=True):
            text = unzip(packed)
            every = [x for m in more or () for x in m]
            found = merge([*((s["start"], s["end"]) for s in spans), *zip(every[::2], every[1::2], strict=True)])
            rows.append((len(text), cut(text, found), found))
        c = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], _PLACES)], ["doc_id", "n_bytes", "kept", "spans"])


def kept_texts(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that are left) and spans (the byte ranges removed, ends exclusive) of every row."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(map_arrow(docs.filter(F.octet_length("text") >= SPAN).select("key", "text"), _rows, "anchor long, d1 long, d2 long, key binary, lo long, shape long"), "runs")
    times = F.shiftright("shape", 40)
    shared = rows.groupBy("anchor").agg(F.sum(times).alias("n")).filter("n > 1").select("anchor")
    # neither the count before the join nor the one after it is bound to its partitions, so those of hot anchors can be split
    again = stored(fresh(rows.join(fresh(shared, "anchor"), "anchor", "left_semi"), "anchor").groupBy("anchor", "d1", "d2", "key", "lo", "shape").agg(F.sum(times).alias("n")), "shared_runs")
    alike = again.groupBy("anchor", "d1", "d2").agg(F.sum("n").alias("n"), F.min(F.struct("key", "lo")).alias("one"))
    kinds = alike.groupBy("anchor").agg(F.count("*").alias("kinds"))
    state = fresh(alike, "anchor").join(fresh(kinds, "anchor"), "anchor").select("anchor", "d1", "d2", (F.col("n") > 1).alias("full"), "one", "kinds")
    told = again.join(state, ["anchor", "d1", "d2"]).select(
        "key", F.struct("lo", "shape", "anchor", "full", ((F.col("kinds") > 1) & (F.struct("key", "lo") == F.col("one"))).alias("send"), (F.col("kinds") > bucket).alias("large")).alias("run")
    )
    # written, so that the join below reads shuffled rows alone on both sides and a text of many copies can be split
    by_text = stored(told.groupBy("key").agg(F.collect_list("run").alias("runs")), "runs_by_text").withColumnRenamed("key", "__key")
    joined = docs.join(by_text, F.col("key") == F.col("__key"), "left").select("doc_id", "key", "text", "runs")
    looked = stored(map_arrow(joined, _first_look, f"doc_id {kind}, key binary, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>, text binary, sends binary, n_sends long"), "looked")
    contexts = looked.filter("sends is not null").select("key", "sends", "n_sends").mapInArrow(_contexts, "anchor long, key binary, lo long, context binary, lead int, full boolean, large boolean")
    small = contexts.filter("not large").drop("large").repartition("anchor").sortWithinPartitions("anchor", "key", "lo").mapInArrow(_buckets, "key binary, more array<bigint>")
    strings = contexts.filter("large").drop("large").dropDuplicates(["key", "lo"]).mapInArrow(_strings, "h1 long, h2 long, anchor long, key binary, at long, full boolean")
    twice = strings.groupBy("h1", "h2", "anchor").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "anchor")
    large = strings.filter("not full").join(fresh(twice, "h1", "h2", "anchor"), ["h1", "h2", "anchor"], "left_semi").select("key", F.array(F.col("at"), F.col("at") + SPAN).alias("more"))
    more = small.unionByName(large).groupBy("key").agg(F.collect_list("more").alias("more")).withColumnRenamed("key", "__key")
    rest = looked.filter("kept is null").select("doc_id", "key", "text", "spans").join(more, F.col("key") == F.col("__key"), "left").select("doc_id", "text", "spans", "more")
    done = map_arrow(rest, _finish, f"doc_id {kind}, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>")
    return looked.filter("kept is not null").select("doc_id", "n_bytes", "kept", "spans").unionByName(done)


def digests(kept: DataFrame) -> DataFrame:
    """What `kept_texts` gives, as n_bytes, n_removed, n_spans and kept_sha256 before its texts and spans."""
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "kept", "spans")


def remove_repeats(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return digests(kept_texts(docs, bucket)).drop("kept", "spans")
