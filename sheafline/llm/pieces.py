"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text is preceded by one space, as the model's dummy prefix wants, and every way to write it in vocabulary pieces is a
path through a lattice. A piece of rank r weighs (r + RANK_SHIFT) ** -alpha, a Zipf-Mandelbrot reading of the vocabulary's
order (its scores are ranks, not probabilities); a character without a piece is written in byte pieces. The forward pass
sums the weights of all ways to reach each character; a path is then drawn backwards, each edge in proportion to the
weight of the paths that end with it, so whole segmentations have exactly their share of the lattice's weight.

The numbers drawn are a hash of the row's key, the word and the step, so a row has the same segmentation whatever else is
in its batch, partition or run.

No piece has a space after another character, nor a line end or tab, so the lattice falls apart into words there. The
words of a chunk are filtered together, each different one once, in arrays over all of them.

Decoding is lossless: pieces spell their characters, byte pieces their bytes, U+2581 in a text is written in bytes as the
vocabulary means a space by it. Null texts encode as no pieces and decode as empty; empty texts likewise. Null keys are a
key like any other; rows of equal key and text have equal segmentations.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import chunks, map_arrow

#: Bytes of text whose words are filtered together: the more, the more words are the same.
CHUNK = 1 << 20
ALPHA = 1.0
RANK_SHIFT = 10.0
SEED = 7
_SPACE = "▁"
_WORD = re.compile(r" *[^ \n\t]+| +|[\n\t]")
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def ranked(key: np.ndarray) -> np.ndarray:
    """The stable order of keys that are not negative: packed with their places where both fit, for plain numbers sort
    much faster than places by number."""
    bits = max(1, int(len(key)).bit_length())
    if len(key) and int(key.max()).bit_length() + bits < 63:
        return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


class Lattice:
    """The pieces of a SentencePiece model as a trie in sorted arrays."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.spelling: list[bytes] = [b""] * n
        self.byte_piece = np.zeros(256, "i4")
        weight, plain = np.full(n, -np.inf), {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_piece[int(piece[3:5], 16)] = i
                self.spelling[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(_SPACE, " ")
                assert not re.search(r"[^ ] |[\n\t]", text), "a piece crosses words"
                plain[text] = i
                self.spelling[i] = text.encode()
                weight[i] = -alpha * np.log(min(-model.get_score(i), float(n)) + RANK_SHIFT)
        self.weight = weight
        self.byte_weight = -alpha * np.log(2.0 * n)
        assert max(map(len, plain)) <= 16, "a piece is longer than the keys of edges allow"
        nodes = {"": 0}
        for text in plain:
            for end in range(1, len(text) + 1):
                nodes.setdefault(text[:end], len(nodes))
        keys = np.array([(nodes[t[:-1]] << 21) | ord(t[-1]) for t in nodes if t], "i8")
        child = np.array([v for t, v in nodes.items() if t], "i4")
        order = np.argsort(keys)
        self.keys, self.child = keys[order], child[order]
        self.piece_at = np.full(len(nodes), -1, "i4")
        for text, i in plain.items():
            self.piece_at[nodes[text]] = i

    def edges(self, chars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every lattice edge; room: characters left in the word at each place. A piece below 0
        is the negated number of a character that is written in bytes."""
        starts, ends, pieces = [], [], []
        at, node, size = np.arange(len(chars)), np.zeros(len(chars), "i8"), 0
        single = np.zeros(len(chars), bool)
        while len(at):
            key = (node << 21) | chars[at + size]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[found] == key
            at, node = at[ok], self.child[found[ok]].astype("i8")
            size += 1
            piece = self.piece_at[node]
            has = piece >= 0
            if size == 1:
                single[at[has]] = True
            starts.append(at[has])
            ends.append(at[has] + size)
            pieces.append(piece[has].astype("i8"))
            more = room[at] > size
            at, node = at[more], node[more]
        lone = np.nonzero(~single)[0]
        return np.concatenate([*starts, lone]), np.concatenate([*ends, lone + 1]), np.concatenate([*pieces, -chars[lone].astype("i8") - 1])

    def sample(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        """The piece ids drawn for each text, by its 64-bit key."""
        words, count = [], []
        for text in texts:
            found = _WORD.findall(" " + text) if text else []
            count.append(len(found))
            words += found
        if not words:
            return [np.zeros(0, "i4") for _ in texts]
        number = dict.fromkeys(words)
        number = dict(zip(number, range(len(number)), strict=True))
        word = np.fromiter(map(number.__getitem__, words), "i8", len(words))
        size = np.fromiter(map(len, number), "i8", len(number))
        chars = np.frombuffer("".join(number).encode("utf-32-le"), "<u4").astype("i8")
        first = np.cumsum(size) - size
        inside = np.arange(len(chars)) - np.repeat(first, size)
        start, end, piece = self.edges(chars, np.repeat(size, size) - inside)
        # states: place p of the characters is "p characters of this and the earlier words are written"
        wide = lambda c: np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
        weight = np.where(piece >= 0, self.weight[np.maximum(piece, 0)], self.byte_weight * wide(-piece - 1))
        depth = inside[end - 1] + 1
        order = ranked((depth * (len(chars) + 1) + end) * 16 + (end - start - 1))  # no two are equal, so a row's order is its own
        start, end, piece, weight, depth = start[order], end[order], piece[order], weight[order], depth[order]
        total = np.full(len(chars), -np.inf)  # of the state after each character
        share = np.empty(len(start))
        bounds = np.concatenate([[0], np.nonzero(np.diff(depth))[0] + 1, [len(depth)]])
        origin = inside[start] == 0
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            s, e = start[lo:hi], end[lo:hi]
            value = weight[lo:hi] + np.where(origin[lo:hi], 0.0, total[s - 1])
            group = np.concatenate([[0], np.nonzero(np.diff(e))[0] + 1])
            most = np.maximum.reduceat(value, group)
            each = np.repeat(np.arange(len(group)), np.diff(np.concatenate([group, [len(e)]])))
            power = np.exp(value - most[each])
            sums = np.add.reduceat(power, group)
            total[e[group] - 1] = most + np.log(sums)
            share[lo:hi] = power / sums[each]
        order = ranked(end * 16 + (end - start - 1))
        start, end, piece, share = start[order], end[order], piece[order], share[order]
        new = np.concatenate([[0], np.nonzero(np.diff(end))[0] + 1, [len(end)]])
        run = np.cumsum(share)
        run -= np.repeat(np.concatenate([[0.0], run[new[1:-1] - 1]]), np.diff(new))
        run = np.minimum(run, 1.0)
        run[new[1:] - 1] = 1.0
        ladder = (end - 1) + run  # a state's edges lie between its number and the next
        # backward
        doc = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            seed = mix(keys[doc] + _GOLD * (nth.astype("u8") + np.uint64(1)))
        begin = first[word]
        active = ranked(word)  # equal words together, so that neighbours look up neighbouring states
        state = (first + size)[word[active]] - 1
        drawn, whose = [], []
        step = 0
        while len(active):
            with np.errstate(over="ignore"):
                u = (mix(seed[active] + np.uint64(step + 1) * _GOLD) >> np.uint64(11)).astype("f8") * 2.0**-53
            edge = np.searchsorted(ladder, state + u, "right")
            drawn.append(piece[edge])
            whose.append(active)
            state = start[edge] - 1
            going = state >= begin[active]
            active, state = active[going], state[going]
            step += 1
        drawn, who = np.concatenate(drawn), np.concatenate(whose)
        turn = np.repeat(np.arange(step), [len(w) for w in whose])
        length = np.bincount(who, minlength=len(word))
        out = np.empty(len(drawn), "i8")
        out[np.cumsum(length)[who] - 1 - turn] = drawn
        doc_of = np.repeat(doc, length)
        if (out < 0).any():
            code = np.where(out < 0, -out - 1, 0)
            spread = np.where(out < 0, wide(code), 1)
            flat = np.repeat(out, spread)
            lost = np.nonzero(out < 0)[0]
            data = np.frombuffer("".join(map(chr, code[lost].tolist())).encode(), "u1")
            flat[np.repeat(out < 0, spread)] = self.byte_piece[data]
            out, doc_of = flat, np.repeat(doc_of, spread)
        cuts = np.cumsum(np.bincount(doc_of, minlength=len(texts)))[:-1]
        return np.split(out.astype("i4"), cuts)

    def decode(self, ids: np.ndarray) -> str:
        """The text that pieces spell, without the dummy prefix."""
        return b"".join(map(self.spelling.__getitem__, ids.tolist()))[1:].decode()


@lru_cache(maxsize=2)
def lattice(name: str, alpha: float) -> Lattice:
    """The lattice of one of the public models, once a worker."""
    import public_tokenizers

    return Lattice(public_tokenizers.path(name), alpha)


def row_keys(keys: list, seed: int = SEED) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(k), seed) for k in keys], "u8")


def encode(docs: DataFrame, key: str = "doc_id", model: str = "piece_bpe_32k.model", alpha: float = ALPHA, seed: int = SEED, ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, pieces_sha256 (of the ids as little-endian 32-bit integers), round_trip (decoding gives
    the text again) and, if wanted, the ids of every row."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_pieces long, n_byte_pieces long, pieces_sha256 string, round_trip boolean" + ", pieces array<int>" * ids
    names = [key, "n_pieces", "n_byte_pieces", "pieces_sha256", "round_trip", *["pieces"] * ids]

    def run(batches):
        own = lattice(model, alpha)
        is_byte = np.zeros(len(own.spelling), bool)
        is_byte[own.byte_piece] = True
        for batch in batches:
            for part in chunks(batch, limit=CHUNK):
                texts = [t or "" for t in part.column("text").to_pylist()]
                drawn = own.sample(texts, row_keys(part.column(key).to_pylist(), seed))
                columns = [pa.array([len(d) for d in drawn], pa.int64()), pa.array([int(is_byte[d].sum()) for d in drawn], pa.int64())]
                columns.append(pa.array([hashlib.sha256(d.astype("<i4").tobytes()).hexdigest() for d in drawn]))
                columns.append(pa.array([own.decode(d) == t for d, t in zip(drawn, texts, strict=True)]))
                if ids:
                    columns.append(pa.array(drawn, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([part.column(key), *columns], names)

    return map_arrow(docs.select(key, "text"), run, schema)


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", alpha: float = ALPHA) -> DataFrame:
    """encoded with the column text spelled by its column pieces."""
    names = [c for c in encoded.columns if c != "text"]

    def run(batches):
        own = lattice(model, alpha)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                text = [own.decode(np.array(p or [], "i4")) for p in part.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(text, pa.string())], [*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "text")
    return map_arrow(encoded.select(*(F.col(f"`{c}`") for c in names)), run, f"{fields}, text string")
