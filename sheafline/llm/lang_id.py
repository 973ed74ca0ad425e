"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to `order`. A byte's code length is that of the longest context the
language has seen; a byte new to it costs the escape (PPM method C: distinct followers over total plus distinct) and goes
on in the next shorter context, with the followers already ruled out excluded, down to a uniform choice among the bytes
the language has never seen. The trees are frozen after training, so code lengths are exact and need no order of rows.
A text belongs to the language that codes it in the fewest bits.

As the trees are frozen, the cost of a byte depends on nothing but its context. It is tabulated once on the driver for
every context any language has seen; executors then score text by two table lookups a byte. However many languages there
are, none is left out: a table of over MODEL_BYTES is made as several, each one more scan over rows that carry the best so
far.

Null texts and texts without a letter are `und` with score 0; equal code lengths go to the alphabetically first language;
without labelled rows every text is `und`. Extra columns pass untouched, repeated rows are scored alike. A long text takes
some 60 bytes a byte while it is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import chunks, map_arrow, raw, stored

#: Longest context in bytes.
ORDER = 3
#: Documents of each language in the training sample (the expected number: rows are chosen by hash).
SAMPLE_ROWS = 1000
#: Times a context of two or more bytes must precede a byte in the sample to enter the tree.
MIN_COUNT = 2
#: Bytes that a model's table of costs may have (it is broadcast); the languages are dealt to as many models as that takes.
MODEL_BYTES = 256 << 20
#: Languages whose samples are counted and brought to the driver together.
AT_ONCE = 64
#: Bits a byte above which no learned language explains a text of MAX_BITS_FROM bytes or more (one key or address can
#: raise a short text's bits as much).
MAX_BITS, MAX_BITS_FROM = 7.5, 512
UNDETERMINED = "und"
_START = 0x0A  # every text counts as preceded by line ends


class Model:
    """Frozen trees: `state` maps packed contexts to a row of `cost`, which has bits by language, row and symbol."""

    def __init__(self, languages: list[str], symbol: np.ndarray, state: np.ndarray, cost: np.ndarray, order: int):
        self.languages, self.symbol, self.state, self.cost, self.order = languages, symbol, state, cost, order

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text under each language, shape (texts, languages)."""
        n, k, width = len(offsets) - 1, self.order, int(self.symbol.max()) + 1
        out = np.zeros((n, len(self.languages)))
        sizes = np.diff(offsets)
        full = np.nonzero(sizes)[0]
        if not len(full):
            return out
        starts = offsets[full]
        s = self.symbol[data].astype("i8")
        key = np.zeros(len(s), "i8")
        for back in range(k, 0, -1):
            prior = np.empty_like(s)
            prior[back:], prior[:back] = s[:-back], 0
            for j in range(back):  # the first bytes of a text have no predecessors of their own
                at = starts[sizes[full] > j] + j
                prior[at] = self.symbol[_START]
            key = key * width + prior
        at = self.state[key].astype("i8") * width + s
        for j in range(len(self.languages)):
            out[full, j] = np.add.reduceat(self.cost[j].take(at), starts, dtype="f8")
        return out


def _grams(order: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                labels = part.column("lang").to_pylist()
                data, offsets = raw(part.column("text"))
                padded = np.concatenate([np.concatenate([np.full(order, _START, "u1"), data[a:b]]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                size = np.diff(offsets) + order
                label = np.repeat(np.arange(len(labels)), size)
                inside = np.arange(len(padded)) - np.repeat(np.cumsum(size) - size, size)
                codes = {x: i for i, x in enumerate(dict.fromkeys(labels))}
                lang = np.array([codes[x] for x in labels], "i8")[label]
                names = list(codes)
                key = np.zeros(len(padded), "i8")
                for k in range(order + 1):
                    key = key + (np.concatenate([np.zeros(k, "i8"), padded[: len(padded) - k].astype("i8")]) << (8 * k))
                    own = inside >= order
                    found, n = np.unique((lang[own] << 40) | key[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in found >> 40], pa.string()), pa.array(np.full(len(found), k, "i4")), pa.array(found & ((1 << 40) - 1)), pa.array(n.astype("i8"))], ["lang", "k", "gram", "n"])

    return run


def fit(docs: DataFrame, where: Column | None = None, order: int = ORDER, sample_rows: int = SAMPLE_ROWS, min_count: int = MIN_COUNT) -> list[Model]:
    """Train on a sample of the rows with text and lang for which `where` holds; no models if there are none.

    The sample has about `sample_rows` whole documents of each language, chosen by a hash of the key, so what reaches the
    driver is bounded by the parameters and the number of languages and not by the corpus.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if where is None else rows.filter(where)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    trained, languages = [], sorted(sizes)
    for i in range(0, len(languages), AT_ONCE):
        part = languages[i : i + AT_ONCE]
        share = F.create_map(*(F.lit(x) for lang in part for x in (lang, int(min(1.0, sample_rows / sizes[lang]) * (1 << 30)))))
        sample = rows.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("lang sample")), F.lit(1 << 30)) < F.coalesce(F.try_element_at(share, "lang"), F.lit(0))).select("lang", "text")
        counts = map_arrow(sample, _grams(order), "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).filter((F.col("k") < 2) | (F.col("n") >= min_count))
        trained += models(counts.toPandas(), order)
    return trained


def models(counts, order: int = ORDER, limit: int | None = None) -> list[Model]:
    """Models of a table (lang, k, gram, n) of k+1-byte strings and their counts, each of at most `limit` bytes of costs (or
    of one language)."""
    if not len(counts):
        return []
    languages = sorted(counts["lang"].unique())
    width = counts.loc[counts["k"] == 0, "gram"].nunique() + 2
    contexts = sum(np.unique(g["gram"].to_numpy() >> 8).size for _, g in counts.groupby("k"))
    if len(languages) == 1 or len(languages) * contexts * width * 4 <= (MODEL_BYTES if limit is None else limit):
        return [build(counts, order)]
    half = set(languages[: len(languages) // 2])
    first = counts["lang"].isin(half)
    return models(counts[first], order, limit) + models(counts[~first], order, limit)


def build(counts, order: int = ORDER) -> Model:
    """The model of a table (lang, k, gram, n) of k+1-byte strings and their counts."""
    languages = sorted(counts["lang"].unique())
    zero = counts[counts["k"] == 0]
    seen = np.unique(np.append(zero["gram"].to_numpy(), _START))  # the start has a symbol of its own
    symbol = np.zeros(256, "u2")
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1  # symbol 0: bytes that no language has
    tables = {(lang, int(k)): (g["gram"].to_numpy("i8"), g["n"].to_numpy("i8")) for (lang, k), g in counts.sort_values("gram").groupby(["lang", "k"])}
    contexts = [np.unique(np.concatenate([t[0] >> 8 for (_, k2), t in tables.items() if k2 == k] or [np.zeros(0, "i8")])) for k in range(order + 1)]
    base = np.cumsum([0, *(len(c) for c in contexts)])
    cost = np.empty((len(languages), base[-1], width), "f4")
    for j, lang in enumerate(languages):
        whole = escaped = None
        sums = {}
        for k in range(order + 1):
            gram, n = tables.get((lang, k), (np.zeros(0, "i8"), np.zeros(0, "i8")))
            row, col = np.searchsorted(contexts[k], gram >> 8), symbol[gram & 255]
            count = np.zeros((len(contexts[k]), width), "f4")
            count[row, col] = n
            total, kinds = count.sum(1, dtype="f8"), (count > 0).sum(1).astype("f8")
            if k == 0:
                whole_below = np.full((1, width), 8.0)
                after = np.full((len(contexts[0]), width), np.log2(np.maximum(256 - kinds, 1))[:, None])
            else:
                parent = np.searchsorted(contexts[k - 1], contexts[k] & ((1 << (8 * (k - 1))) - 1))
                low, low_total, low_kinds = sums["count"][parent], sums["total"][parent], sums["kinds"][parent]
                left = low_total - np.where(count > 0, low, 0).sum(1, dtype="f8")
                kinds_left = low_kinds - kinds
                with np.errstate(divide="ignore", invalid="ignore"):
                    after = np.where(low > 0, np.log2((left + kinds_left)[:, None] / low), np.where(kinds_left > 0, np.log2((left + kinds_left) / kinds_left), 0.0)[:, None] + escaped[parent])
                whole_below = whole[parent]
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.where(count > 0, np.log2((total + kinds)[:, None] / count), np.log2((total + kinds) / kinds)[:, None] + after)
            whole = np.where((total > 0)[:, None], own, whole_below)
            escaped = np.where((total > 0)[:, None], after, 0.0)
            sums = {"count": count, "total": total, "kinds": kinds}
            cost[j, base[k] : base[k + 1]] = whole
    state = np.zeros(width**order, "i4")
    for k in range(order + 1):  # longer contexts overwrite the shorter ones they end with
        parts = [(contexts[k] >> (8 * i)) & 255 for i in range(k - 1, -1, -1)]
        tail = np.zeros(len(contexts[k]), "i8")
        for p in parts:
            tail = tail * width + symbol[p]
        grid = state.reshape(-1, width**k)
        grid[:, tail] = base[k] + np.arange(len(tail))
    return Model(languages, symbol, state, cost.reshape(len(languages), -1), order)


def predict(docs: DataFrame, trained: list[Model], text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "bits")) -> DataFrame:
    """docs with the language, score (the winner's probability among the learned languages, all equally likely before) and
    bits (a byte; null where undetermined) added under `names`; columns of these names that docs has are replaced."""
    own = [c for c in docs.columns if c not in names]
    rest = F.struct(F.lit(True).alias("__"), *(F.col(f"`{c}`") for c in own if c != text))
    rows = docs.select(rest.alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    for i, model in enumerate(trained):
        rows = map_arrow(rows, _scorer(docs.sparkSession.sparkContext.broadcast(model), i > 0), f"doc {kind}, text string, best double, share double, lang string")
        if i + 1 < len(trained):
            rows = stored(rows, "languages")
    if not trained:
        rows = rows.select("doc", "text", F.lit(0.0).alias("best"), F.lit(1.0).alias("share"), F.lit(UNDETERMINED).alias("lang"))
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(trained))
    return rows.select(
        *(F.col("text").alias(c) if c == text else F.col(f"doc.`{c}`") for c in own), F.when(known, F.col("lang")).otherwise(UNDETERMINED).alias(names[0]),
        F.when(known, 1 / F.col("share")).otherwise(0.0).alias(names[1]), F.when(known, F.col("best") / F.greatest(F.octet_length("text"), F.lit(1))).alias(names[2]),
    )


def _scorer(shared, further: bool):
    """Adds to each text the least bits of a model's languages, that language, and the sum of all languages' shares in units
    of its own; `further`: of this model's and those scored before."""

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in chunks(batch):
                data, offsets = raw(part.column("text"))
                bits = own.bits(data, offsets)
                at = bits.argmin(1)
                best = bits.min(1)
                share = np.exp2(best[:, None] - bits).sum(1)
                lang = [own.languages[i] for i in at]
                if further:
                    least, sums, names = part.column("best").to_numpy(zero_copy_only=False), part.column("share").to_numpy(zero_copy_only=False), part.column("lang").to_pylist()
                    low = np.minimum(least, best)
                    share = sums * np.exp2(low - least) + share * np.exp2(low - best)
                    lang = [a if x <= y else b for a, b, x, y in zip(names, lang, least, best, strict=True)]
                    best = low
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("text"), pa.array(best), pa.array(share), pa.array(lang, pa.string())], ["doc", "text", "best", "share", "lang"])

    return run
