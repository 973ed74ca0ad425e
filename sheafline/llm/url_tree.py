"""URL filters: rules by host and path, and a path-template tree for what no rule decides.

The tree of a host is built a level at a time. Where the children of a node are many and mostly different, the segment is
variable and its values become wildcards of their shape (runs of digits 0, of letters a). Siblings whose labelled share
of bad pages does not differ significantly from that of the rest of their node are merged into one branch (`~`); what
differs stays a branch of its own, and so does a segment or wildcard without siblings. A template is rejected if its smoothed labelled purity, the bad share with PRIOR_WEIGHT
pages of share PRIOR added, reaches REJECT.

All of it is DataFrame operations: per level two counts by node and segment, each combined before it is shuffled, and
joins with node tables that have each key once, so a hot host only lengthens the larger side. Both sides of a join are
shuffled for it alone (`fresh`), so adaptive execution splits that side. Hosts are never gathered.

Null urls and urls without :// have empty host and path, fit no rule and are of the empty host's tree. Repeated rows
stay repeated. A url without a label counts for the tree's shape only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fresh, shared_folder

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Least levels of the tree; it goes on to the deepest path.
DEPTH = 4
#: A segment is variable if a node has so many children, and more than one for each SHARE rows.
LEAST_CHILDREN = 8
SHARE = 4
#: Labelled pages that a branch and the rest of its node must have to be told apart, and the square of the z-score.
LEAST_LABELLED = 5
Z_SQUARED = 4.0
PRIOR, PRIOR_WEIGHT, REJECT = 0.1, 4.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as host and path; null if none does."""
    best = F.lit(None).cast("string")
    for name, start, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        best = F.when(((host == name) | host.endswith("." + name)) & path.startswith(start), name + start).otherwise(best)
    return best


def verdict_of(rule: Column, rules: tuple = RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, start, verdict in rules:
        out = F.when(rule == name + start, verdict).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The segments of a path, by level."""
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def templates(pages: DataFrame) -> DataFrame:
    """pages (with host, path and bad: 1, 0 or null) with the column template added: one branch a level, $ where the path
    has ended."""
    shared_folder(pages.sparkSession)
    at = pages.withColumn("__parts", segments(F.col("path"))).withColumn("template", F.lit(""))
    at = at.checkpoint()
    levels = max(DEPTH, at.agg(F.max(F.size("__parts"))).first()[0] or 0)
    for i in range(levels):
        if i:
            at = at.checkpoint()  # a level is read several times by the next
        seg = F.coalesce(F.get("__parts", F.lit(i)), F.lit("$"))
        children = at.groupBy("host", "template", seg.alias("__seg")).agg(F.count("*").alias("__n"))
        node = children.groupBy("host", "template").agg(((F.count("*") >= LEAST_CHILDREN) & (F.count("*") * SHARE > F.sum("__n"))).alias("__variable"))
        shape = F.regexp_replace(F.regexp_replace(seg, "[A-Za-z]+", "a"), "[0-9]+", "0")
        at = at.join(fresh(node, "host", "template"), ["host", "template"]).withColumn("__seg", F.when(F.col("__variable"), F.concat(F.lit("*"), shape)).otherwise(seg)).drop("__variable")
        at = fresh(at, "host", "template")
        branch = at.groupBy("host", "template", "__seg").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
        whole = branch.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"), F.count("*").alias("kinds"))
        n, k, rest, rest_k = F.col("n"), F.col("k"), F.col("all_n") - F.col("n"), F.col("all_k") - F.col("k")
        apart = (n >= LEAST_LABELLED) & (rest >= LEAST_LABELLED) & ((k * rest - rest_k * n) * (k * rest - rest_k * n) * F.col("all_n") > Z_SQUARED * n * rest * F.col("all_k") * (F.col("all_n") - F.col("all_k")))
        named = branch.join(whole, ["host", "template"]).select("host", "template", "__seg", F.when((F.col("kinds") == 1) | apart, F.col("__seg")).otherwise("~").alias("__branch"))
        at = at.join(fresh(named, "host", "template"), ["host", "template", "__seg"]).withColumn("template", F.concat("template", F.lit("/"), "__branch")).drop("__seg", "__branch")
    return at.drop("__parts").checkpoint()


def judge(pages: DataFrame, labels: DataFrame, key: Column, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every page; labels (doc_id, toxic) tell of the page whose `key`
    they bear whether it is bad (if several do: whether any says so)."""
    bad = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("bad"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key.alias("__key"))
    rows = rows.join(bad, rows["__key"] == bad["doc_id"], "left").drop("doc_id", "__key")
    found = templates(rows)
    purity = found.groupBy("host", "template").agg((F.coalesce(F.sum("bad"), F.lit(0)).cast("double") + PRIOR * PRIOR_WEIGHT).alias("k"), (F.count("bad").cast("double") + PRIOR_WEIGHT).alias("n")).select("host", "template", (F.col("k") >= REJECT * F.col("n")).alias("__bad"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    out = found.join(fresh(purity, "host", "template"), ["host", "template"]).withColumn("rule", rule)
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("__bad"), "block").otherwise("allow")).alias("verdict"), "template")


def oracle_sql(rules: tuple = RULES, depth: int = DEPTH) -> str:
    """The same rows in DuckDB SQL, for the pages and labels tables, if no path has more than `depth` segments."""
    best = "NULL"
    for name, start, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        best = f"CASE WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}') THEN '{name}{start}' ELSE {best} END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{n}{s}' THEN '{v}'" for n, s, v in rules) + " END"
    parts = "string_split(regexp_replace(path, '^/', ''), '/')"
    seg = [f"coalesce({parts}[{i + 1}], '$') AS s{i}" for i in range(depth - 1)]
    seg.append(f"CASE WHEN len({parts}) >= {depth} THEN array_to_string({parts}[{depth}:], '/') ELSE '$' END AS s{depth - 1}")
    sql = [
        f"u AS MATERIALIZED (SELECT page_id, url, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages)",
        "b AS MATERIALIZED (SELECT doc_id, max(toxic) AS bad FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id)",
        f"t0 AS MATERIALIZED (SELECT page_id, host, path, bad, '' AS template, {', '.join(seg)} FROM u LEFT JOIN b ON b.doc_id = TRY_CAST(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT))",
    ]
    for i in range(depth):
        sql += [
            f"v{i} AS MATERIALIZED (SELECT host, template, count(*) >= {LEAST_CHILDREN} AND count(*) * {SHARE} > sum(n) AS variable FROM (SELECT host, template, s{i}, count(*) AS n FROM t{i} GROUP BY ALL) GROUP BY ALL)",
            f"g{i} AS MATERIALIZED (SELECT t.*, CASE WHEN variable THEN '*' || regexp_replace(regexp_replace(s{i}, '[A-Za-z]+', 'a', 'g'), '[0-9]+', '0', 'g') ELSE s{i} END AS seg FROM t{i} t JOIN v{i} v ON t.host = v.host AND t.template = v.template)",
            f"c{i} AS MATERIALIZED (SELECT host, template, seg, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS k FROM g{i} GROUP BY ALL)",
            f"w{i} AS MATERIALIZED (SELECT host, template, sum(n) AS nn, sum(k) AS kk, count(*) AS kinds FROM c{i} GROUP BY ALL)",
            f"m{i} AS MATERIALIZED (SELECT c.host, c.template, seg, CASE WHEN kinds = 1 OR n >= {LEAST_LABELLED} AND nn - n >= {LEAST_LABELLED} AND (k * (nn - n) - (kk - k) * n) * (k * (nn - n) - (kk - k) * n) * nn > CAST({Z_SQUARED} AS DOUBLE) * n * (nn - n) * kk * (nn - kk) THEN seg ELSE '~' END AS branch FROM c{i} c JOIN w{i} w ON c.host = w.host AND c.template = w.template)",
            f"t{i + 1} AS MATERIALIZED (SELECT g.page_id, g.host, g.path, g.bad, g.template || '/' || m.branch AS template" + "".join(f", g.s{j}" for j in range(i + 1, depth)) + f" FROM g{i} g JOIN m{i} m ON g.host = m.host AND g.template = m.template AND g.seg = m.seg)",
        ]
    sql += [
        f"p AS MATERIALIZED (SELECT host, template, CAST(coalesce(sum(bad), 0) AS DOUBLE) + CAST({PRIOR * PRIOR_WEIGHT} AS DOUBLE) >= CAST({REJECT} AS DOUBLE) * (count(bad) + {PRIOR_WEIGHT}) AS is_bad FROM t{depth} GROUP BY ALL)",
        f"r AS MATERIALIZED (SELECT t.page_id, t.host, t.path, t.template, p.is_bad, {best.replace('host', 't.host').replace('path', 't.path')} AS rule FROM t{depth} t JOIN p ON t.host = p.host AND t.template = p.template)",
    ]
    return "WITH " + ",\n".join(sql) + f"\nSELECT page_id, host, path, rule, coalesce({verdict}, CASE WHEN is_bad THEN 'block' ELSE 'allow' END) AS verdict, template FROM r"
