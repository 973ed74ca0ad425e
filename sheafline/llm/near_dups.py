"""SimHash near-duplicates found through the binary Golay code.

Fingerprints that differ in at most 3 of 64 bits are to be linked. A fingerprint is cut into three segments of 22, 21 and
21 bits, each read as a word of the perfect [23,12,7] Golay code. Every word lies within 3 bits of exactly one codeword,
so it decodes to one 12-bit index; `near(x)` holds x's own index and those indices of its one-bit neighbours that rank
below it (some 3 in all). Two words that differ in one bit or none always share an index of `near`: their own, or that of
the one that ranks lower.

Three errors over three segments leave two cases:

* some segment has no error; of the other two, one has at most one. Key: the exact segment and an index of `near` of the
  other (six ordered pairs of segments);
* each segment has exactly one error. Key: an index of `near` from each of the three.

So every link within 3 bits shares a key, and a key fixes 33 bits or more. Keys are dealt by hash, sorted within their
partition and read as a stream: a group of equal keys is compared there in blocks and yields a spanning forest of its
verified links, never its pairs. A group of over GROUP_ROWS different fingerprints is not gathered: its blocks are dealt
out in pairs, each pair of blocks to a task of its own. Rows with equal fingerprints are one fingerprint from the start,
whatever their number.

Forests are united by alternating large-star and small-star steps on the links, cut off from their lineage by
checkpoint().

A text without words (null, empty) has fingerprint zero and links like any other. Null doc_ids do not become a
component's id unless all its doc_ids are null. Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import as_bytes, chunks, map_arrow, shared_folder, tidy

SHINGLE = 3
SEED = 42
MOST_BITS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key compared in one task; more go out in pairs of blocks.
GROUP_ROWS = 4096
#: Groups of more fingerprints are linked by walks, not by a table of their differences.
WALK_ROWS = 64
#: Fingerprints of 128 bits.
WIDE = np.dtype([("fp", "<u8"), ("rest", "<u8")])
_GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, of the [23,12,7] Golay code


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By 23-bit word: the index of its codeword (u2); start of its list in `near` (i4); the lists of `near`, flat (u2)."""
    message = np.arange(1 << 12, dtype="i8")
    code = np.zeros(1 << 12, "i8")
    for bit in range(12):
        code ^= np.where(message >> bit & 1, _GENERATOR << bit, 0)
    index = np.zeros(1 << 23, "u2")
    bits = [1 << i for i in range(23)]
    errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    for e in errors:
        index[code ^ e] = message
    return index


class Golay:
    """Decoding of segments, made once a worker from the code's generator polynomial."""

    _own: Golay | None = None

    def __init__(self):
        self.index = golay_tables()

    @classmethod
    def get(cls) -> Golay:
        cls._own = cls._own or cls()
        return cls._own

    def near(self, words: np.ndarray, width: int) -> np.ndarray:
        """Indices of each word: its own and, where they rank lower, those of words one of the `width` bits away.
        Shape (words, n); repeats stand in unused places."""
        own = self.index[words]
        around = self.index[words[:, None] ^ (1 << np.arange(width))]
        around = np.sort(np.minimum(around, own[:, None]), axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = 0xFFFF
        around = np.sort(around, axis=1)
        most = int((around != 0xFFFF).sum(1).max(initial=1))
        around = around[:, : max(most, 1)]
        around = np.where(around == 0xFFFF, own[:, None], around)
        missing = ~(around == own[:, None]).any(1)
        if missing.any():
            around = np.concatenate([around, own[:, None]], axis=1)
        return around.astype("i8")

    def keys(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, fingerprint) pairs, each once."""
        whole = [(prints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype("i8") for shift, width in SEGMENTS]
        near = [self.near(w, width) for w, (_, width) in zip(whole, SEGMENTS, strict=True)]
        keys = []
        case = 0
        for p in range(3):
            for q in range(3):
                if p != q:
                    keys.append((case << 36 | whole[p] << 12)[:, None] | near[q])
                    case += 1
        a, b, c = near
        keys.append((case << 36 | a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]).reshape(len(prints), -1))
        key = np.concatenate(keys, axis=1)
        owner = np.repeat(prints, key.shape[1])
        key = key.reshape(-1)
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        return key[new], owner[new]


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles of a text's lower-cased words (ASCII only), each repeat counted."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), "i8", len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - shingle + 1)
    last = end[shingle - 1 :] if len(words) >= shingle else end[-1:]
    one = xxhash.xxh64_intdigest
    counts, done = np.zeros(64, "i8"), 0
    starts, ends = start[:n].tolist(), last.tolist()
    while done < n:  # a very long text by parts
        h = np.array([one(line[a:b], SEED) for a, b in zip(starts[done : done + 50_000], ends[done : done + 50_000], strict=True)], "<u8")
        counts += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
        done += len(h)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and the columns of `keep`, one row for each row of docs."""
    names = ["doc_id", *keep]

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                fp = np.array([fingerprint(d, shingle) for d in as_bytes(part.column("text"))], "u8").view("i8")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(fp)], [*names, "fp"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(docs.select(*dict.fromkeys([*names, "text"])), run, f"{schema}, fp long")


def _expand(batches):
    code = Golay.get()
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False).view("u8")
        for i in range(0, len(prints), 2000):
            key, owner = code.keys(prints[i : i + 2000])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner.view("i8"))], ["key", "fp"])


def _prints(fp: np.ndarray, rest: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of 64 bits, or of 128 with the bits in `rest`; the first 64 name the fingerprint."""
    if rest is None:
        return fp
    out = np.empty(len(fp), WIDE)
    out["fp"], out["rest"] = fp, rest
    return out


def _named(prints: np.ndarray) -> np.ndarray:
    return prints["fp"] if prints.dtype == WIDE else prints


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ."""
    if x.dtype != WIDE:
        return np.bitwise_count(x ^ y)
    return np.bitwise_count(x["fp"] ^ y["fp"]) + np.bitwise_count(x["rest"] ^ y["rest"])


def forest(left: np.ndarray, right: np.ndarray | None = None, most_bits: int = MOST_BITS, block: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links within `left`, or of those between left and right."""
    if len(left) > WALK_ROWS:
        return walks(left, right, most_bits)
    every = left if right is None else np.concatenate([left, right])
    name = _named(every)
    root = np.arange(len(every))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    cols = every if right is None else right
    shift = 0 if right is None else len(left)
    for lo in range(0, len(left), block):
        a, b = np.nonzero(_differ(left[lo : lo + block, None], cols[None, lo if right is None else 0 :]) <= most_bits)
        a, b = a + lo, b + (lo if right is None else shift)
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if i < j and (x := top(i)) != (y := top(j)):
                root[y] = x
                out.append((int(name[i]), int(name[j])))
    return out


def walks(left: np.ndarray, right: np.ndarray | None, most_bits: int) -> list[tuple[int, int]]:
    """The same for large groups: from each fingerprint to all linked ones that no walk has reached yet, so that a group of
    which all link costs its size and not its pairs."""
    rest = [left] if right is None else [left, right]
    out = []
    while len(rest[0]) and len(rest[-1]):
        queue, rest[0] = [(0, rest[0][0])], rest[0][1:]
        while queue:
            side, x = queue.pop()
            other = len(rest) - 1 - side
            hit = _differ(rest[other], x) <= most_bits
            if hit.any():
                new, rest[other] = rest[other][hit], rest[other][~hit]
                out += [(int(_named(x)), y) for y in _named(new).tolist()]
                queue += [(other, y) for y in new]
    return out


def _links(batches, most_bits: int = MOST_BITS):
    """Of rows sorted by key and fp: links found, as (a, b, null, null), and blocks of groups too large for one task,
    as (null, fp, key, block); with the column `rest` also its bits of a block's fingerprints."""
    rest_key, rest = None, np.zeros(0, "u8")
    block, wide = 0, False

    def group(key, prints, last):
        nonlocal block
        made, blocks = [], []
        while len(prints) > GROUP_ROWS:
            blocks.append((key, block, prints[:GROUP_ROWS]))
            prints, block = prints[GROUP_ROWS:], block + 1
        if last:
            if block:
                blocks.append((key, block, prints))
            elif len(prints) > 1:
                made = forest(prints, None, most_bits)
            prints, block = prints[:0], 0
        return made, blocks, prints

    def rows(made, blocks):
        n = len(made) + sum(len(p) for *_, p in blocks)
        if not n:
            return
        links = np.array(made, "u8").reshape(-1, 2).view("i8")
        parts = [np.concatenate([np.full(len(p), v, "i8") for *v_, p in blocks for v in [v_[i]]]) if blocks else np.zeros(0, "i8") for i in (0, 1)]
        prints = np.concatenate([p for *_, p in blocks]) if blocks else np.zeros(0, WIDE if wide else "u8")
        more = _named(prints).view("i8")
        none = np.arange(n) >= len(links)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([links[:, 0], more]), mask=none), pa.array(np.concatenate([links[:, 1], more])), pa.array(np.concatenate([links[:, 0], parts[0]]), mask=~none), pa.array(np.concatenate([links[:, 0], parts[1]]), mask=~none), *([pa.array(np.concatenate([links[:, 0], prints["rest"].view("i8")]), mask=~none)] if wide else [])], ["a", "b", "key", "block", *(["rest"] if wide else [])])

    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view("u8")
        wide = "rest" in batch.schema.names
        if wide:
            fp = _prints(fp, batch.column("rest").to_numpy(zero_copy_only=False).view("u8"))
        if not len(key):
            continue
        bounds = np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])
        made, blocks = [], []
        if rest_key is not None and key[0] != rest_key:
            m, b, rest = group(rest_key, rest, True)
            made += m
            blocks += b
        size = np.diff(bounds)
        inner = np.arange(len(size)) < len(size) - 1
        first_goes_on = rest_key is not None and key[0] == rest_key
        if first_goes_on:
            inner[0] = False
        two = bounds[:-1][inner & (size == 2)]
        near = two[_differ(fp[two], fp[two + 1]) <= most_bits]
        made += list(zip(_named(fp[near]).tolist(), _named(fp[near + 1]).tolist(), strict=True))
        for g in np.nonzero(inner & (size > 2))[0]:
            m, b, _ = group(int(key[bounds[g]]), fp[bounds[g] : bounds[g + 1]], True)
            made += m
            blocks += b
        if first_goes_on:
            m, b, rest = group(rest_key, np.concatenate([rest, fp[: bounds[1]]]), len(size) > 1)
            made += m
            blocks += b
        if len(size) > 1 or not first_goes_on:
            rest_key = int(key[bounds[-2]])
            m, b, rest = group(rest_key, fp[bounds[-2] :].copy(), False)
            made += m
            blocks += b
        yield from rows(made, blocks)
    if rest_key is not None:
        m, b, _ = group(rest_key, rest, True)
        yield from rows(m, b)


def _block_links(batches, most_bits: int = MOST_BITS):
    """Links of pairs of blocks. Rows come sorted by pair and side; one pair, of two blocks at most, is held at a time."""
    held: list[np.ndarray] = []  # rows of the pair in hand: key, i, j, side, fp, and rest if there is one

    def done():
        rows = np.concatenate(held)
        held.clear()
        prints = _prints(*(rows[:, c].view("u8") for c in range(4, rows.shape[1])))
        left, right = (prints[rows[:, 3] == s] for s in (0, 1))
        made = np.array(forest(left, right if rows[0, 1] != rows[0, 2] else None, most_bits), "u8").reshape(-1, 2).view("i8")
        return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("key", "i", "j", "side", "b", "rest") if c in batch.schema.names], axis=1)
        for part in np.split(rows, np.nonzero((rows[1:, :3] != rows[:-1, :3]).any(1))[0] + 1):
            if held and (held[0][0, :3] != part[0, :3]).any():
                yield done()
            held.append(part)
    if held:
        yield done()


def links(prints: DataFrame, expand: Callable = _expand, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b): links between different fingerprints of the column fp, enough for their components. `expand` gives the keys
    under which they meet. With a column `rest` the fingerprints have 128 bits, of which fp is the first half."""
    rest = ["rest"] if "rest" in prints.columns else []
    more = "".join(f", {c} long" for c in rest)
    keyed = map_arrow(prints, expand, f"key long, fp long{more}")
    within, between = (_links, _block_links) if most_bits == MOST_BITS else (partial(_links, most_bits=most_bits), partial(_block_links, most_bits=most_bits))
    found = keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(within, f"a long, b long, key long, block long{more}").checkpoint()
    direct = found.filter(F.col("key").isNull()).select("a", "b")
    large = found.filter(F.col("key").isNotNull())
    if large.isEmpty():
        return direct
    sizes = large.groupBy("key").agg(F.max("block").alias("last"))
    dealt = large.join(sizes, "key").select("key", "block", "b", *rest, F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "b", *rest)
    between_blocks = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(between, "a long, b long")
    return direct.unionByName(between_blocks)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the links (a, b), for every node that has one.

    Large-star and small-star steps in turn until nothing changes; what is shuffled is links, of which there are never
    more than at first.
    """
    edges = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint()
    before = None
    while True:
        # large star: every node joins its larger neighbours to the smallest node it sees
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every node joins its smaller neighbours and itself to the smallest of them
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(low, "u")
        edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        del both, least, low, joined
        tidy(edges.sparkSession)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def rooted(docs: DataFrame, shingle: int = SHINGLE, cache: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) and root (a fingerprint that names the component alone), one
    row for each row of docs."""
    shared_folder(docs.sparkSession)
    rows = cache(fingerprints(docs, shingle))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    return named(rows, prints, components(links(prints.select("fp"))))


def named(rows: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """What `rooted` returns, of rows with fp, the fingerprints with the least doc_id of each, and the roots of linked ones."""
    least = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(of_root, "root").select(F.col("fp").alias("print"), "component_id", "root")
    return rows.join(named, rows["fp"] == named["print"]).select("doc_id", "fp", "component_id", "root")


def classes(docs: DataFrame, shingle: int = SHINGLE, cache: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable), one row for each row of docs."""
    return rooted(docs, shingle, cache).drop("root")


def as_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, find: Callable = rooted, prints: Callable = fingerprints) -> DataFrame:
    """docs with one document of each component: the one whose doc_id names it.

    Rows with a doc_id of their own are judged by it, so only keys are shuffled with the ids of those to go. Null and
    repeated doc_ids tell no rows apart: their rows are judged by doc_id and fp together, and of rows equal in both one
    stays, if their component has no other document that names it.
    """
    found = find(docs, shingle).checkpoint()
    shared = found.groupBy("doc_id").count().filter("doc_id is null or count > 1").select(F.col("doc_id").alias("__again"))
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("doc_id").isNotNull()).select("doc_id")
    gone = gone.unionByName(shared.select(F.col("__again").alias("doc_id"))).distinct().select(F.col("doc_id").alias("__gone"))
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
    if shared.isEmpty():
        return kept
    keeps = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("fp", "doc_id")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.fp").alias("__fp"))
    again = docs.join(shared, docs["doc_id"].eqNullSafe(shared["__again"]), "left_semi")
    again = prints(again.select("doc_id", "text", F.struct("*").alias("__doc")), shingle, keep=("__doc",)).dropDuplicates(["doc_id", "fp"])
    again = again.join(keeps, (again["fp"] == keeps["__fp"]) & again["doc_id"].eqNullSafe(keeps["__id"]), "left_semi")
    return kept.unionByName(again.select("__doc.*"))
