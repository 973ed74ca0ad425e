"""Near-duplicates by their words: texts of which the sets of 5-word shingles have a similarity (Jaccard) of 0.8 or more.

At that similarity two SimHashes of 64 bits differ in some 10 bits, too many for the keys of `near_dups`, which fix 33 bits.
So the Golay code is used with soft decisions here. A text's 128 sums (for each bit of two 64-bit hashes: shingles that set
it less shingles that do not) tell not only bits but how sure they are. Four segments of 24 sums are each decoded to the
NEAREST = 3 codewords of the extended [24,12,8] code with the highest correlation. Two texts at a similarity of 0.8 share a
codeword of a segment with a chance of 0.75 (measured), so by the pigeonhole at least two of four segments agree with a
chance of 0.947, at 0.85 of 0.983, at 0.9 of 0.997. A key is a pair of segments with a codeword of each: 54 keys a text.

What meets under a key and differs in MOST_BITS = 34 bits or fewer of all 128 (at 0.8: all but 0.0003) is a candidate. All
128 are needed: a key of two segments speaks for 48 of them, so of unrelated texts that meet by chance a large part would
pass a limit on 64 bits, and links by chance, which grow with the square of the texts, would unite most texts to one cluster.
Nothing is linked without comparison of the sets themselves:

1. Candidates are united to clusters by the forests and star steps of `near_dups`.
2. Each text of a cluster is compared with the one of the cluster's LEADERS, chosen by hash, whose bits are nearest, and
   linked if it is similar enough; what is linked so is a class.
3. In clusters of several classes all texts outside the largest class are compared with all others of the cluster, so no
   pair of a cluster is left that is neither united already nor compared. Clusters go out in pairs of blocks of BLOCK_ROWS
   texts or BLOCK_BYTES of sets, so a set moves once for each block it meets and not once for each pair, and a task holds
   two blocks; similarities of two blocks are products of matrices over the shingles that they share.

Fingerprints stand for texts: rows with the same fingerprint are one text (texts at a similarity of 0.7 share one with a
chance of 1e-6). Null and empty texts have fingerprint zero and are one. Fewer words than a shingle: the whole sequence.
Repeated rows, null and repeated doc_ids: as in `near_dups`. A very long text is hashed by parts; its set is 8 bytes a
shingle in one row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dups
from .base import as_bytes, chunks, fresh, map_arrow, shared_folder, tidy

WORDS = 5
LEAST = 0.8
SEGMENTS = 4
NEAREST = 3
MOST_BITS = 34
LEADERS = 8
BLOCK_ROWS = 1024
BLOCK_BYTES = 8 << 20
#: Shared shingles whose columns are multiplied at a time.
COLUMNS = 4096
#: Settles bits that half of the shingles set, the same way in all texts.
_TIES = np.unpackbits(np.array([xxhash.xxh64_intdigest(b"ties", k) for k in (0, 1)], "<u8").view("u1"), bitorder="little") - 0.5


def codewords() -> np.ndarray:
    """Half of the extended code as rows of 1 and -1; the other half are their complements."""
    message = np.arange(1 << 12)
    code = np.zeros(1 << 12, "i8")
    for bit in range(12):
        code ^= np.where(message >> bit & 1, near_dups._GENERATOR << bit, 0)
    code = code[code & 1 == 0]
    bits = code[:, None] >> np.arange(23) & 1
    return (np.concatenate([bits, bits.sum(1, keepdims=True) & 1], axis=1) * 2 - 1).astype("f4")


def shingles(data: bytes, shingle: int = WORDS) -> np.ndarray:
    """The hashes of a text's different shingles, in order."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, "u8")
    line, size = b" ".join(words), np.fromiter(map(len, words), "i8", len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: max(1, len(words) - shingle + 1)]
    last = end[shingle - 1 :] if len(words) >= shingle else end[-1:]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], near_dups.SEED) for a, b in zip(start.tolist(), last.tolist(), strict=True)), "u8", len(start)))


def sums(hashed: np.ndarray) -> np.ndarray:
    """The 128 sums of a set of shingles."""
    out = _TIES - len(hashed)
    for i in range(0, len(hashed), 50_000):
        one = hashed[i : i + 50_000]
        two = one * np.uint64(0x9E3779B97F4A7C15)
        two = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        two ^= two >> np.uint64(32)
        out += 2.0 * np.unpackbits(np.stack([one, two], axis=1).view("u1"), axis=1, bitorder="little").sum(0, dtype="i4")
    return out


def decode(sums: np.ndarray, code: np.ndarray) -> np.ndarray:
    """By text and segment: its NEAREST codewords, in order (u2)."""
    got = sums[:, : SEGMENTS * 24].reshape(-1, 24).astype("f4") @ code.T
    size = np.abs(got)
    best = np.argpartition(size, code.shape[0] - NEAREST, axis=1)[:, -NEAREST:]
    return np.sort(best * 2 + (np.take_along_axis(got, best, 1) < 0), axis=1).astype("<u2").reshape(len(sums), SEGMENTS, NEAREST)


def prints(docs: DataFrame, shingle: int = WORDS, keep: tuple[str, ...] = (), sets: bool = False) -> DataFrame:
    """doc_id, the columns of `keep`, fp and rest (the first and the last 64 bits as longs) and near (codewords of the segments); with `sets` the
    hashes of the shingles too. One row for each row of docs."""
    names = [*dict.fromkeys(["doc_id", *keep])]

    def run(batches):
        code = codewords()
        for batch in batches:
            for part in chunks(batch):
                hashed = [shingles(d, shingle) for d in as_bytes(part.column("text"))]
                for lo in range(0, len(hashed), 256):
                    some = hashed[lo : lo + 256]
                    total = np.stack([sums(h) for h in some])
                    fp, rest = np.packbits(total > 0, axis=1, bitorder="little").view("<u8").T.copy()
                    fp[[not len(h) for h in some]] = 0
                    cols = [*(part.column(c).slice(lo, len(some)) for c in names), pa.array(fp.view("i8")), pa.array(rest.view("i8")), pa.array([x.tobytes() for x in decode(total, code)], pa.binary())]
                    more = [pa.array([h.tobytes() for h in some], pa.binary())] if sets else []
                    yield pa.RecordBatch.from_arrays([*cols, *more], [*names, "fp", "rest", "near", *["shingles"][: len(more)]])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(docs.select(*dict.fromkeys([*names, "text"])), run, f"{schema}, fp long, rest long, near binary" + (", shingles binary" if sets else ""))


def expand(batches):
    """The keys of fingerprints: pairs of segments with a codeword of each. The column `rest` goes along."""
    for batch in batches:
        if not batch.num_rows:
            continue
        near = np.frombuffer(b"".join(batch.column("near").to_pylist()), "<u2").reshape(-1, SEGMENTS, NEAREST).astype("i8")
        pairs = [(p, q) for p in range(SEGMENTS) for q in range(p + 1, SEGMENTS)]
        keys = np.concatenate([(case << 24 | near[:, p, :, None] << 12 | near[:, q, None, :]).reshape(len(near), -1) for case, (p, q) in enumerate(pairs)], axis=1)
        others = [c for c in ("fp", "rest") if c in batch.schema.names]
        rows = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), keys.shape[1]) for c in others]
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *map(pa.array, rows)], ["key", *others])


def _similar(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), "u8") for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= LEAST * max(len(x), len(y)) else 0
            keep.append(both >= LEAST * (len(x) + len(y) - both) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of fingerprints whose sets are similar enough."""
    left = fresh(pairs, "a").join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a")
    both = fresh(left, "b").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    return map_arrow(both.select("a", "b", "x", "y"), _similar, "a long, b long")


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left has in common with each on the right."""
    out = np.zeros((len(left), len(right)), "f4")
    of = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    every = [np.concatenate(side) if side else np.zeros(0, "u8") for side in (left, right)]
    shared = np.intersect1d(*every)
    for lo in range(0, len(shared), COLUMNS):
        some, marks = shared[lo : lo + COLUMNS], []
        for hashed, row, n in zip(every, of, map(len, (left, right)), strict=True):
            at = np.searchsorted(some, hashed)
            hit = some[np.minimum(at, len(some) - 1)] == hashed
            mark = np.zeros((n, len(some)), "f4")
            mark[row[hit], at[hit]] = 1
            marks.append(mark)
        out += marks[0] @ marks[1].T
    return out


def _compared(batches):
    """Links between texts of different classes in pairs of blocks, of which rows come sorted by (root, i, j) and side: 0
    left, 1 right, and 2 for texts of clusters of one block, which are both. Of the links found a forest is kept."""
    held: list[tuple] = []

    def done():
        sides = [[r for r in held if r[3] in (k, 2)] for k in (0, 1)]
        held.clear()
        left, right = sides
        if left and left[0][3] == 2:
            left = [r for r in left if r[6]]
        sets = [[np.frombuffer(r[5], "u8") for r in side] for side in (left, right)]
        size = [np.array([len(x) for x in side], "f4") for side in sets]
        both = common(*sets)
        near = both >= LEAST * (size[0][:, None] + size[1][None, :] - both) - 1e-4
        own = [np.array([r[7] for r in side], "i8") for side in (left, right)]
        a, b = np.nonzero(near & (own[0][:, None] != own[1][None, :]))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = top(int(own[0][i])), top(int(own[1][j]))
            if x != y:
                root[y] = x
                out.append((left[i][4], right[j][4]))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "side", "fp", "shingles", "few", "own")), strict=True):
            if held and held[0][:3] != row[:3]:
                yield done()
            held.append(row)
    if held:
        yield done()


def apart(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between classes `own` of the clusters `root`, among members (fp, root, own), by their sets."""
    sized = members.join(sets.select("fp", F.octet_length("shingles").alias("bytes")), "fp")
    classes = sized.groupBy("root", "own").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    mixed = classes.groupBy("root").agg(F.max_by("own", F.struct("n", "own")).alias("top"), F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("n").alias("n_top"), F.max_by("bytes", F.struct("n", "own")).alias("bytes_top")).filter("classes > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    mixed = mixed.select("root", "top", blocks(F.col("n") - F.col("n_top"), F.col("bytes") - F.col("bytes_top")).alias("lefts"), blocks(F.col("n"), F.col("bytes")).alias("rights"))
    rows = fresh(members, "root").join(mixed, "root").withColumn("few", F.col("own") != F.col("top"))
    block = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    one = F.col("rights") == 1
    each = lambda n: F.sequence(F.lit(0), n - 1)
    columns = ["root", "fp", "own", "few"]
    dealt = (
        rows.filter(one).select(*columns, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))
        .unionByName(rows.filter(~one & F.col("few")).select(*columns, block(F.col("lefts")).alias("i"), F.explode(each(F.col("rights"))).alias("j"), F.lit(0).alias("side")))
        .unionByName(rows.filter(~one).select(*columns, F.explode(each(F.col("lefts"))).alias("i"), block(F.col("rights")).alias("j"), F.lit(1).alias("side")))
    )
    placed = dealt.join(sets, "fp").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side")
    return map_arrow(placed.select("root", "i", "j", "side", "fp", "shingles", "few", "own"), _compared, "a long, b long")


def rooted(docs: DataFrame, shingle: int = WORDS, cache: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) and root, one row for each row of docs."""
    shared_folder(docs.sparkSession)
    rows = cache(prints(docs, shingle))
    known = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("near", "rest")).alias("print")).select("fp", "least", "print.*")
    clusters = near_dups.components(near_dups.links(known.select("fp", "rest", "near"), expand, MOST_BITS))
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    members = known.join(clusters, known["fp"] == clusters["node"]).select("fp", "least", "root").checkpoint()

    wanted = members.select(F.col("least").alias("__least")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__least")), "left_semi")
    sets = prints(texts, shingle, sets=True).select("fp", "shingles").join(members.select("fp"), "fp", "left_semi")
    sets = sets.groupBy("fp").agg(F.min("shingles").alias("shingles")).checkpoint()
    tidy(docs.sparkSession)

    leaders = members.groupBy("root").agg(F.array_distinct(F.array(*(F.min_by("fp", F.xxhash64("fp", F.lit(k))) for k in range(LEADERS)))).alias("leaders"))
    nearest = F.array_min(F.transform(F.filter("leaders", lambda x: x != F.col("fp")), lambda x: F.struct(F.bit_count(x.bitwiseXOR(F.col("fp"))).alias("bits"), x.alias("leader"))))["leader"]
    led = fresh(members.select("fp", "root"), "root").join(leaders, "root").select("fp", nearest.alias("leader")).filter("leader is not null")
    first = similar(led.select(F.col("fp").alias("a"), F.col("leader").alias("b")), sets).checkpoint()
    own = near_dups.components(first)
    now = members.join(own, members["fp"] == own["node"], "left").select("fp", members["root"].alias("root"), F.coalesce(own["root"], "fp").alias("own")).checkpoint()
    second = apart(now, sets).checkpoint()
    tidy(docs.sparkSession)
    return near_dups.named(rows.select("doc_id", "fp"), known.select("fp", "least"), near_dups.components(first.unionByName(second)))


def one_of_each(docs: DataFrame, shingle: int = WORDS) -> DataFrame:
    """docs with one document of each component, as `near_dups.one_of_each` tells rows apart."""
    return near_dups.one_of_each(docs, shingle, rooted, prints)
