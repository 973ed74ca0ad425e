"""Merkle manifest of a dataset, with its nodes in an external store.

Each row is hashed to a leaf, and leaves are sorted by (source, doc_id) into runs, which give each leaf its coordinate: its
source and its place there. From then on only digests move. Nodes are made in passes over HEIGHT levels. In a pass, nodes
come sorted by coordinate, ARITY ** HEIGHT of them (a block, the foot of a subtree) after each other; a task streams through
them, makes each level of a block from the level below it in order, and writes all of them to Parquet by level. The next
pass reads the topmost of these levels. So a tree of N leaves takes log(N) / log(2187) passes, and each level is read once.
The last node of a source is its subroot; the subroots, in the order of their sources, are the leaves of one more tree.

Proofs are extracted from the store from the root down, by merging scans in the order of coordinates: with the path of a
block's own node come the block's stored levels, from the top to its foot, and each foot's path is the siblings on its way
up followed by the block's path. A task holds one block (some 3300 digests); a source of any size is many blocks, so a hot
source is spread over all tasks. The driver reads one row for each sorted run (its first and last source and their numbers
of rows), the number of blocks and the root.

Null values count as `-` in a leaf; a null source comes first; null doc_ids come first in their source; rows of one source
and doc_id go by their leaves, so repeated rows are neighbours with the same leaf, each with its own place and proof. A
source of one row has its leaf as subroot. An empty table has no root (null) and no proofs. A text of any length is hashed
in the JVM and goes no further. Columns that are not hashed are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import crc32_sql, discard, intermediate, map_arrow, numbered, stored

ARITY = 3
#: Levels that a pass makes.
HEIGHT = 7
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "tree string, block long, height int, idx long, digest string"
_PATH = "lefts array<string>, rights array<string>"


def leaf(**instead: Column) -> Column:
    """The leaf of a row; a column may be replaced by an expression."""

    def field(name: str) -> Column:
        value = instead.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(field, HASHED)), 256)


def parent(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def climb(foot: list[str], first: bool, height: int) -> list[list[str]]:
    """The levels of a block above its foot. The first block of a tree may be the only one: it stops at a single node."""
    levels, only = [foot], first and len(foot) < ARITY**height
    while len(levels) <= height and not (only and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([parent(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels[1:]


def by_block(batches, columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((tree, block), rows) from batches sorted by tree and block."""
    key, rows = None, []
    for batch in batches:
        for tree, block, *row in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", *columns)), strict=True):
            if key != (tree, block):
                if rows:
                    yield key, rows
                key, rows = (tree, block), []
            rows.append(row)
    if rows:
        yield key, rows


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def make_levels(foot: DataFrame, height: int) -> DataFrame:
    """The nodes above rows of tree, block, idx, digest, with their heights over the foot. The last level of a block has
    one node, marked as top."""

    def run(batches):
        out, names = [], ["tree", "block", "height", "idx", "digest", "top"]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()))], names)

        for (tree, block), rows in by_block(batches, ("digest",)):
            levels = climb([r[0] for r in rows], block == 0, height)
            if not levels:  # the foot is a single node and the root of its tree
                out.append((tree, block, 0, 0, rows[0][0], True))
            for h, level in enumerate(levels, 1):
                start = block * ARITY ** (height - h)
                out += [(tree, block, h, start + i, d, h == len(levels)) for i, d in enumerate(level)]
            if len(out) > 10_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return map_arrow(dealt(foot.select("tree", "block", "idx", "digest"), "idx"), run, f"{_NODES}, top boolean")


def store_levels(foot: DataFrame, folder: str, height: int) -> tuple[list[str], DataFrame]:
    """Stores all levels above the foot (tree, idx, digest), pass by pass; the folders of passes, and the roots of trees."""
    spark, folders = foot.sparkSession, []
    size = ARITY**height
    while True:
        place = f"{folder}/pass={len(folders)}"
        made = make_levels(foot.withColumn("block", F.expr(f"idx div {size}")), height)
        made.write.option("compression", "zstd").partitionBy("height").parquet(place)
        folders.append(place)
        tops = spark.read.schema(f"{_NODES}, top boolean").parquet(place).filter("top").select("tree", F.col("block").alias("idx"), "digest")
        if not tops.agg(F.max("idx")).first()[0]:
            return folders, tops.select("tree", "digest")
        foot = tops


def paths(foot: DataFrame, folders: list[str], above: DataFrame, height: int) -> DataFrame:
    """The foot's rows (tree, idx, digest, payload) with subroot, lefts and rights: for each level on the way to the root the
    siblings on both sides, joined. `above` has what follows from each tree's root: tree, subroot, lefts, rights."""
    spark, size = foot.sparkSession, ARITY**height
    above = above.select("tree", F.lit(0).cast("long").alias("block"), "subroot", "lefts", "rights")
    for k in reversed(range(len(folders))):
        nodes = spark.read.schema(f"{_NODES}, top boolean").parquet(folders[k])
        if k:
            base = spark.read.schema(f"{_NODES}, top boolean").parquet(folders[k - 1]).filter("top").select("tree", F.col("block").alias("idx"), "digest", F.lit(None).cast("string").alias("payload"))
        else:
            base = foot
        scans = (
            above.select("tree", "block", F.lit(height + 1).alias("height"), F.lit(0).cast("long").alias("idx"), F.col("subroot").alias("digest"), "lefts", "rights", F.lit(None).cast("string").alias("payload"))
            .unionByName(nodes.filter("height > 0 and not top").select("tree", "block", "height", "idx", "digest"), allowMissingColumns=True)
            .unionByName(base.select("tree", F.expr(f"idx div {size}").alias("block"), F.lit(0).alias("height"), "idx", "digest", "payload"), allowMissingColumns=True)
        )
        found = map_arrow(dealt(scans.withColumn("up", -F.col("height")), "up", "idx"), merge_scan, f"tree string, idx long, digest string, payload string, subroot string, {_PATH}")
        above = found if not k else found.select("tree", F.col("idx").alias("block"), "subroot", "lefts", "rights")
    return above


def merge_scan(batches):
    """Paths of the feet of each block, whose path comes first, then its levels from the top on, then its foot."""
    kinds = pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())
    out: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["tree", "idx", "digest", "payload", "subroot", "lefts", "rights"])

    for (tree, _), rows in by_block(batches, ("height", "idx", "digest", "lefts", "rights", "payload")):
        (_, _, subroot, top_lefts, top_rights, _), *rows = rows
        way: list[tuple[list[str], list[str]]] = [(top_lefts, top_rights)]  # of the nodes of the level above, in order
        lo = 0
        while lo < len(rows):
            h = rows[lo][0]
            hi = next((i for i in range(lo, len(rows)) if rows[i][0] != h), len(rows))
            level, ways = rows[lo:hi], []
            alone = hi - lo == 1 and len(way) == 1 and h == 0 and lo == 0 and subroot == level[0][2]
            for i in range(len(level)):
                a = i - i % ARITY
                run = [r[2] for r in level[a : a + ARITY]]
                lefts, rights = way[i // ARITY]
                ways.append((lefts, rights) if alone else (["".join(run[: i - a]), *lefts], ["".join(run[i - a + 1 :]), *rights]))
            way, lo = ways, hi
        out += [(tree, r[1], r[2], r[5], subroot, *w) for r, w in zip(level, way, strict=True)]
        if len(out) > 2000:
            yield batch()
            out = []
    if out:
        yield batch()


@dataclass(frozen=True)
class Manifest:
    """The stored trees of a dataset: leaves (tree, idx, digest, payload), subroots likewise, the folders of their nodes."""

    root: str | None
    leaves: DataFrame
    subroots: DataFrame
    folders: list[str]
    top_folders: list[str]
    payload: str
    height: int

    def nodes(self, spark: SparkSession, which: str = "source") -> DataFrame:
        """The stored nodes over the leaves of sources, or over the subroots; height is that within the pass."""
        folders = self.folders if which == "source" else self.top_folders
        return spark.read.schema(f"{_NODES}, top boolean, pass int").option("basePath", folders[0].rsplit("/", 1)[0]).parquet(*folders)

    def proofs(self) -> DataFrame:
        """doc_id, what was carried, source, idx, leaf, subroot, lefts and rights of every leaf."""
        spark = self.leaves.sparkSession
        end = spark.createDataFrame([("", self.root, [], [])] if self.root else [], f"tree string, subroot string, {_PATH}")
        tops = paths(self.subroots, self.top_folders, end, self.height)
        above = tops.select(F.col("payload").alias("tree"), F.col("digest").alias("subroot"), "lefts", "rights")
        found = paths(self.leaves, self.folders, above, self.height)
        row = F.from_json("payload", self.payload)
        return found.select(row.alias("row"), F.col("tree").alias("source"), "idx", F.col("digest").alias("leaf"), "subroot", "lefts", "rights").select("row.*", "source", "idx", "leaf", "subroot", "lefts", "rights")


def build(docs: DataFrame, carried: dict[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of docs; carried expressions are evaluated by row and come back with the proofs."""
    spark = docs.sparkSession
    folder = intermediate(spark, "merkle")
    discard(spark, folder, now=False)
    row = F.struct(F.col("doc_id"), *(e.alias(n) for n, e in (carried or {}).items()))
    hashed = docs.select(F.col("source").cast("string").alias("tree"), "doc_id", leaf().alias("digest"), row.alias("payload"))
    kind = hashed.schema["payload"].dataType
    hashed = stored(hashed.withColumn("payload", F.to_json("payload")), "leaves")
    leaves = stored(numbered(hashed, "tree", ["tree", "doc_id", "digest"], "idx").drop("doc_id"), "coordinates")
    folders, subroots = store_levels(leaves, f"{folder}/sources", height)
    tops = stored(numbered(stored(subroots, "subroots").select(F.lit("").alias("tree"), "digest", F.col("tree").alias("payload")), "tree", ["payload"], "idx"), "subroots")
    top_folders, roots = store_levels(tops, f"{folder}/top", height)
    root = roots.first()
    return Manifest(root["digest"] if root else None, leaves, tops, folders, top_folders, kind.simpleString(), height)


def folded(digest: Column, lefts: str = "lefts", rights: str = "rights") -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(F.arrays_zip(F.col(lefts).alias("l"), F.col(rights).alias("r")), digest, lambda at, x: F.sha2(F.concat(x["l"], at, x["r"]), 256))


def proof_digest(lefts: str = "lefts", rights: str = "rights") -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.zip_with(lefts, rights, lambda x, y: F.concat(x, y))), 256)


def verify(manifest: Manifest, claimed: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the carried leaf and the stored siblings) and verified."""
    root = F.lit(manifest.root).cast("string")
    return manifest.proofs().select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest().alias("proof_sha256"), folded(F.col(claimed)).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """DuckDB SQL for op12: every level by recursion, proofs by joins on coordinates, folding by recursion."""
    fields = lambda text: " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))
    return f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, sha256({fields("text")}) AS leaf, sha256({fields("CASE WHEN doc_id IS NOT NULL AND " + crc32_sql("CAST(doc_id AS VARCHAR)") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS claimed FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed
), low AS (
  SELECT coalesce('x' || source, '') AS tree, 0 AS level, i, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), any_value((n + 2) // 3) FROM low WHERE n > 1 GROUP BY tree, level, i // 3
), subroots AS (
  SELECT tree, level AS height, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, place AS i, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY level, i // 3
), top AS (SELECT digest, level AS height FROM high WHERE n = 1
), nodes AS (
  SELECT tree, level, i, digest FROM low WHERE n > 1
  UNION ALL SELECT NULL, level, i, digest FROM high WHERE n > 1
), coords AS (
  SELECT row_number() OVER () AS id, doc_id, leaf, claimed, coalesce('x' || source, '') AS tree, i FROM leaves
), ways AS (
  SELECT c.id, l.level AS step, s.tree AS tree, l.level AS level, c.i // CAST(pow(3, l.level) AS BIGINT) AS at FROM coords c JOIN subroots s USING (tree), LATERAL (SELECT unnest(range(0, s.height)) AS level) l
  UNION ALL
  SELECT c.id, s.height + l.level, NULL, l.level, s.place // CAST(pow(3, l.level) AS BIGINT) FROM coords c JOIN subroots s USING (tree), top t, LATERAL (SELECT unnest(range(0, t.height)) AS level) l
), paths AS (
  SELECT w.id, w.step, coalesce(string_agg(x.digest, '' ORDER BY x.i) FILTER (WHERE x.i < w.at), '') AS l, coalesce(string_agg(x.digest, '' ORDER BY x.i) FILTER (WHERE x.i > w.at), '') AS r
  FROM ways w JOIN nodes x ON x.tree IS NOT DISTINCT FROM w.tree AND x.level = w.level AND x.i // 3 = w.at // 3 GROUP BY w.id, w.step
), fold AS (
  SELECT id, 0 AS step, claimed AS at FROM coords
  UNION ALL
  SELECT f.id, f.step + 1, sha256(p.l || f.at || p.r) FROM fold f JOIN paths p ON p.id = f.id AND p.step = f.step
), proof AS (SELECT id, string_agg(l || r, '' ORDER BY step) AS digests, count(*) AS steps FROM paths GROUP BY id)
SELECT c.doc_id, c.leaf, s.digest AS subroot, t.digest AS root, sha256(coalesce(p.digests, '')) AS proof_sha256, f.at AS folded_root, f.at = t.digest AS verified
FROM coords c JOIN subroots s USING (tree) CROSS JOIN top t LEFT JOIN proof p ON p.id = c.id JOIN fold f ON f.id = c.id AND f.step = coalesce(p.steps, 0)
"""
