"""Token counts of byte-level BPE at every prefix by dynamic programming.

A byte string has one encoding, and so has each of its prefixes. The last token of a prefix is the one vocabulary entry
ending there that can follow the last token of the prefix before it: no merge crosses their border before both are
complete. So tokens[i] = tokens[i - len(last)] + 1 fills a table of exact counts for all prefixes in one pass, and
questions of truncation or budget are answered from the table without encoding anything again.

The pre-tokenizer's pieces are independent, so the table of a text is made of the tables of its pieces. `prefix_tables`
stores it for every row, packed; `fitting` and `truncate` answer from the stored tables and know nothing of tokens.
`token_counts` needs the last entry alone, so it keeps the last entries of pieces (bounded; dropped as a whole when full).

Null texts count as empty; the special string counts as one token, as the library does by default. A very long text takes
some 100 bytes a character while its table is made. Repeated rows stay repeated; extra columns are not read by
`token_counts` and pass through `prefix_tables`, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import chunks, map_arrow

#: Pieces whose count a worker keeps.
CACHE_PIECES = 400_000
#: Tokens a document may have before it is over the limit.
LIMIT = 1024
_INF = 1 << 60
_WEST = 0x24F  # the last code point of Latin Extended-B


def _western(pattern: str) -> re.Pattern:
    """The same pattern for texts of code points up to _WEST, for the quicker of the two regular expression engines."""
    kind = lambda k: "".join(re.escape(chr(c)) for c in range(_WEST + 1) if unicodedata.category(chr(c))[0] == k)
    for k in "LN":
        pattern = pattern.replace(f"\\p{{{k}}}+", f"[{kind(k)}]+").replace(f"\\p{{{k}}}", kind(k))
    return re.compile(pattern)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for the tokenizer in a `tokenizers` JSON file (byte-level BPE with the usual pattern)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        code = lambda s: bytes(letters[c] for c in s)
        self.vocab = {code(k): v for k, v in spec["model"]["vocab"].items() if all(c in letters for c in k)}
        self.entries = ahocorasick.Automaton()
        for entry, token in self.vocab.items():
            self.entries.add_word(entry.decode("latin-1"), (len(entry), token))
        self.entries.make_automaton()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = code(a), code(b)
            ids = self.vocab[a], self.vocab[b]
            self.rank[ids] = r
            self.parts.setdefault(self.vocab[a + b], (*ids, r))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern = regex.compile(pattern)
        self.western, self.other = _western(pattern), re.compile(f"[^\\x00-\\x1b\\x20-{chr(_WEST)}]")
        self.kept: dict[str, int] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The outermost parts of a token on a side as they grow: (token, rank at which the next part swallows it)."""
        if (got := self.edges.get((token, side))) is None:
            chain, until = [], _INF
            while True:
                chain.append((token, until))
                if token not in self.parts:
                    break
                until, token = self.parts[token][2], self.parts[token][side]
            got = self.edges[chain[0][0], side] = chain[::-1]
        return got

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two complete tokens side by side are how their bytes are encoded."""
        if (got := self.follows.get((left, right))) is None:
            a, b, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
            while True:
                (x, x_end), (y, y_end) = a[i], b[j]
                crossing = self.rank.get((x, y), _INF)
                if crossing < x_end and crossing <= y_end and crossing < _INF:  # of equal ranks the leftmost merges first
                    got = False
                    break
                if x_end == y_end == _INF:
                    got = True
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            if len(self.follows) >= CACHE_PIECES:
                self.follows.clear()
            self.follows[left, right] = got
        return got

    def piece(self, data: bytes) -> list[int]:
        """Tokens of every prefix of one piece, by bytes."""
        tokens, last, follows = [0] * (len(data) + 1), [-1] * (len(data) + 1), self.follows
        done = -1
        for at, (size, token) in self.entries.iter(data.decode("latin-1")):  # all entries that end at a byte, longest first
            if at == done:
                continue
            start = at + 1 - size
            before = last[start]
            if before < 0:
                ok = start == 0 and self.whole(token)
            elif (ok := follows.get((before, token))) is None:
                ok = self.whole(token) and self.may_follow(before, token)
            if ok:
                tokens[at + 1], last[at + 1], done = tokens[start] + 1, token, at
        return tokens

    def count_piece(self, piece: str) -> int:
        data = piece.encode()
        if (token := self.vocab.get(data)) is not None and self.whole(token):
            n = 1
        else:
            n = self.piece(data)[-1]
        if len(self.kept) >= CACHE_PIECES:
            self.kept.clear()
        if len(data) <= 64:
            self.kept[piece] = n
        return n

    @lru_cache(maxsize=60_000)  # noqa: B019  one counter a worker
    def whole(self, token: int) -> bool:
        """Whether a vocabulary entry is reached by merging its own bytes."""
        return token not in self.parts or (self.whole(self.parts[token][0]) and self.whole(self.parts[token][1]) and self.may_follow_until(token))

    def may_follow_until(self, token: int) -> bool:
        left, right, rank = self.parts[token]
        a, b, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        while (i, j) != (len(a) - 1, len(b) - 1):
            (x, x_end), (y, y_end) = a[i], b[j]
            crossing = self.rank.get((x, y), _INF)
            if crossing < x_end and crossing <= y_end and crossing < _INF:
                return False
            if x_end <= y_end:
                i += 1
            else:
                j += 1
        return self.rank[left, right] == rank

    def count(self, text: str | None) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        if self.split is not None and any(s in text for s in self.special):
            parts = self.split.split(text)
            return len(parts) - 1 + sum(map(self.count, parts))
        kept, total = self.kept, 0
        for piece in (self.pattern if self.other.search(text) else self.western).findall(text):
            n = kept.get(piece)
            total += self.count_piece(piece) if n is None else n
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for every i from 0 to len(text), each as that prefix would be encoded alone."""
        out = np.zeros(len(text) + 1, "i8")
        done = at = 0
        spans = [m.span() for m in self.split.finditer(text)] if self.split is not None else []
        for start, end in [*spans, (len(text), len(text))]:
            done = self._ordinary(text, at, start, end, done, out)
            if end > start:
                done += 1
                out[end] = done
            at = end
        return out

    def _ordinary(self, text: str, at: int, end: int, until: int, done: int, out: np.ndarray) -> int:
        """Fills out for the prefixes that end in text[at:until], whose part after `end` is a special string still open."""
        open_at, open_done = at, done
        for m in self.pattern.finditer(text[at:end]):
            a, b = at + m.start(), at + m.end()
            open_at, open_done = a, done
            done = self._fill(text, a, b, done, out)
        for i in range(end + 1, until):  # a special string cut short is ordinary text
            out[i] = open_done + self.count(text[open_at:i])
        return done

    def _fill(self, text: str, a: int, b: int, done: int, out: np.ndarray) -> int:
        piece = text[a:b]
        table = self.piece(piece.encode())
        width = np.cumsum([0, *(len(c.encode()) for c in piece)])
        spaces = len(piece) - len(piece.lstrip())
        if spaces:  # white space at the end of a prefix is one piece, however it is divided before what follows
            lead = a
            while lead > 0 and text[lead - 1].isspace():
                lead -= 1
            run = text[lead : a + spaces]
            blank = self.piece(run.encode())
            at = np.cumsum([0, *(len(c.encode()) for c in run)])
        for i in range(1, len(piece) + 1):
            if i <= spaces:
                out[a + i] = int(out[lead]) + blank[at[a - lead + i]]
            elif piece[0] == "'" and len(piece) == 3 and i == 2 and piece[1:].isalpha():
                out[a + i] = done + self.piece(b"'")[-1] + self.piece(piece[1].encode())[-1]
            else:
                out[a + i] = done + table[width[i]]
        return done + table[-1]

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most `budget` tokens."""
        return text[: longest(self.prefix_counts(text), [budget])[0]]


def longest(counts: np.ndarray, budgets: list[int]) -> list[int]:
    """For each budget the length of the longest prefix within it (-1: none); one table of counts answers them all."""
    least = np.minimum.accumulate(counts[::-1])[::-1]  # a longer prefix may have fewer tokens
    return (np.searchsorted(least, budgets, "right") - 1).tolist()


@lru_cache(maxsize=2)
def counter(name: str) -> PrefixCounter:
    """The counter of one of the public tokenizers, once a worker."""
    import public_tokenizers

    return PrefixCounter(public_tokenizers.path(name), public_tokenizers.PATTERN)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. Null text: 0, 0, false. Repeated rows stay repeated."""

    def run(batches):
        own = counter(tokenizer)
        for batch in batches:
            for part in chunks(batch):
                n = pa.array([own.count(t) for t in part.column("text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    ready = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = ready.schema["doc_id"].dataType.simpleString()
    return map_arrow(ready, run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_tables(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(doc, n_tokens, table): the row as a struct, its tokens, and the count at every prefix (from 0 characters to all), as
    differences of 16 bits, packed."""

    def run(batches):
        own, pack = counter(tokenizer), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in chunks(batch):
                counts = [own.prefix_counts(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([int(c[-1]) for c in counts], pa.int64()), pa.array([pack(np.diff(c).astype("<i2").tobytes()) for c in counts], pa.binary())], ["doc", "n_tokens", "table"])

    ready = docs.select(F.struct("*").alias("doc"), "text")
    return map_arrow(ready, run, f"doc {ready.schema['doc'].dataType.simpleString()}, n_tokens long, table binary")


def unpack(table: bytes) -> np.ndarray:
    """The counts of a stored table."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(table), "<i2"), dtype="i8")])


def fitting(tables: DataFrame, budgets: list[int]) -> DataFrame:
    """tables with `fits`: for each budget the characters of the longest prefix within it."""

    def run(batches):
        for batch in batches:
            fits = [longest(unpack(t), budgets) for t in batch.column("table").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n_tokens"), pa.array(fits, pa.list_(pa.int64()))], ["doc", "n_tokens", "fits"])

    return map_arrow(tables.select("doc", "n_tokens", "table"), run, f"doc {tables.schema['doc'].dataType.simpleString()}, n_tokens long, fits array<bigint>")


def truncate(tables: DataFrame, budget: int) -> DataFrame:
    """The rows of the tables, each text cut to its longest prefix of at most `budget` tokens."""
    found = fitting(tables, [budget])
    names = found.schema["doc"].dataType.names
    return found.select(*(F.substring(F.col("doc.text"), F.lit(1), F.col("fits")[0].cast("int")).alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in names))
