"""Language model scoring with Brown classes.

A text is its words, lower-cased (ASCII), and one end. Every word belongs to a class; the model is

    log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class)

Every word seen LEAST_SEEN times or more is a type of its own, however many there are; all other words, seen or not, share
FORMS types by their form (a hash of the last bytes and of which kinds of character occur). Classes are found in two steps:

* Exchange clustering of the core, that is the LEXICON most frequent words, the end and the forms: each type in turn moves to
  the class that gives the training tokens the highest likelihood under the class bigram model, until no move helps. It
  needs the counts of pairs of core types, gathered over all training tokens.
* One exchange step for every other word, in parallel: its counts of neighbours by class are gathered by word, and it goes
  from its form's class to the class that raises the likelihood most, the table of the core held fixed.

Class bigrams are then counted again over all training tokens with the words' final classes.

P(word | class) is a word's share of its class. A form has the share of its words, and P(word | form): a word seen n times
has (n - DISCOUNT) of the form's tokens; what is discounted is left for unseen words, of which a form is taken to have one
more than it has seen ones. Class transitions are interpolated with class frequencies (Witten-Bell).

Word counts are exact over all training tokens, whatever their number. The HEAD most frequent words are broadcast (a size
bound that the choice of a least count keeps); the places of all other words are joined by word with counts and classes and
put into their row's sequence of classes. So no word with many tokens is ever shuffled by occurrence, and none is left out.

Null texts are empty: one end token. Rows of equal doc_id are scored apart. Without training rows every count is 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import as_bytes, chunks, map_arrow, shared_folder

LEXICON = 639
FORMS = 384
#: Occurrences in training from which a word has a class by its own contexts.
LEAST_SEEN = 5
CLASSES = 48
#: Most words whose counts are broadcast.
HEAD = 200_000
#: Words of the head that one row of neighbour counts stands for.
HEAD_BLOCK = 200
#: Occurrences of words outside the head whose counts meet in one row, as near as whole words allow.
BUCKET_TOKENS = 50_000
#: Size of the filter for words outside the head that are to have a class (4 MB).
TAIL_BITS = 1 << 25
DISCOUNT = 0.5
SWEEPS = 12
#: Different words a worker counts before it hands them on.
_FLUSH = 300_000
_CELLS = 1 << 14
#: Counts of neighbours a worker holds before it hands them on.
_HELD = 4_000_000
_OPEN = 255  # class of a word that is to be joined
_END = b" "  # no word has a space
#: Neighbouring types a worker holds before it counts them.
_LINE = 2_000_000


def tokens(data: bytes) -> list[bytes]:
    return data.lower().split()


#: What a form's key has for a word of letters, and for others by whether they are ASCII and have a digit among the first four.
_LETTERS = bytes((True, True, False))
_KINDS = {(a, d): bytes((False, a, d)) for a in (False, True) for d in (False, True)}
_DIGITS = b"0123456789"


def form(word: bytes) -> int:
    """The form type of a word, from 0 to FORMS - 1."""
    if word.isalpha():
        return zlib.crc32(word[-2:] + _LETTERS + word[-3:-2]) % FORMS
    first = word[:4]
    return zlib.crc32(word[-2:] + _KINDS[word.isascii(), first.translate(None, _DIGITS) != first]) % FORMS


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the texts, with the end as the word of one space."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            words = list(seen)
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], ["word", "n"])
            seen.clear()

        for batch in batches:
            for part in chunks(batch):
                texts = as_bytes(part.column("text"))
                for data in texts:
                    seen.update(tokens(data))
                seen[_END] += len(texts)
                if len(seen) > _FLUSH:
                    yield from out()
        yield from out()

    return map_arrow(texts.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Types:
    """Numbers of word types: 0 the end, then the lexicon, then the forms."""

    def __init__(self, lexicon: list[bytes]):
        self.number = {w: i + 1 for i, w in enumerate(lexicon)}
        self.forms_at = len(lexicon) + 1
        self.size = self.forms_at + FORMS

    def of(self, word: bytes) -> int:
        got = self.number.get(word)
        return self.forms_at + form(word) if got is None else got


def pair_counts(texts: DataFrame, head: dict[bytes, int], types: Types) -> np.ndarray:
    """Counts of neighbouring types over the texts, shape (types, types); each text starts after an end."""
    shared = texts.sparkSession.sparkContext.broadcast(({**head, _END: 0}, types.forms_at))
    size = types.size

    def run(batches):
        number, forms_at = shared.value
        at, total, held, n_held = number.get, np.zeros(size * size, "i8"), [], 0
        for batch in batches:
            for part in chunks(batch):
                words = [_END]
                for data in as_bytes(part.column("text")):
                    words += tokens(data)
                    words.append(_END)
                seq = np.fromiter(map(at, words, repeat(-1)), "i8", len(words))
                rest = np.nonzero(seq < 0)[0]
                seq[rest] = forms_at + np.fromiter(map(form, [words[i] for i in rest.tolist()]), "i8", len(rest))
                held.append(seq[:-1] * size + seq[1:])
                n_held += len(words)
                if n_held > _LINE:
                    total += np.bincount(np.concatenate(held), minlength=size * size)
                    held, n_held = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size * size)
        for lo in range(0, size * size, _CELLS):
            cells = total[lo : lo + _CELLS]
            if cells.any():
                used = np.nonzero(cells)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lo // _CELLS]), pa.array([used.astype("<i4").tobytes() + cells[used].astype("<i8").tobytes()], pa.binary())], ["part", "cells"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                n = len(data) // 12
                np.add.at(sums.setdefault(part, np.zeros(_CELLS, "i8")), np.frombuffer(data, "<i4", n), np.frombuffer(data, "<i8", n, 4 * n))
        for part, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([cells.tobytes()], pa.binary())], ["part", "cells"])

    found = map_arrow(texts.select("text"), run, "part long, cells binary").repartition("part").mapInArrow(add, "part long, cells binary")
    out = np.zeros((size * size + _CELLS - 1) // _CELLS * _CELLS, "i8")
    for r in found.toLocalIterator():
        out[r["part"] * _CELLS : (r["part"] + 1) * _CELLS] = np.frombuffer(r["cells"], "<i8")
    return out[: size * size].reshape(size, size)


def _xlogx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1.0)), 0.0)


def gains(table: np.ndarray, left: np.ndarray, right: np.ndarray, go: np.ndarray, come: np.ndarray, itself: float) -> np.ndarray:
    """Gain of adding a type with these counts to and from classes (and itself) to each class; the last takes none."""
    n_out, n_in = go.sum() + itself, come.sum() + itself
    # rows, columns, and the cell where both change
    rows = (_xlogx(table + go[None, :]) - _xlogx(table)).sum(1)
    cols = (_xlogx(table + come[:, None]) - _xlogx(table)).sum(0)
    d = table.diagonal()
    cross = _xlogx(d + go + come + itself) - _xlogx(d + go) - _xlogx(d + come) + _xlogx(d)
    gain = rows + cols + cross - (_xlogx(left + n_out) - _xlogx(left)) - (_xlogx(right + n_in) - _xlogx(right))
    gain[-1] = -np.inf
    return gain


def step_of(table: np.ndarray, a: int, go: np.ndarray, come: np.ndarray, itself: float) -> int:
    """The class to which exchange takes a type of class a; go and come have its neighbours of its own class without
    itself. Empty classes take none: words that move in parallel would all meet there."""
    table = table.copy()
    table[a] -= go
    table[:, a] -= come
    table[a, a] -= itself
    left, right = table.sum(1), table.sum(0)
    gain = gains(table, left, right, go, come, itself)
    gain[(left + right == 0) & (np.arange(len(table)) != a)] = -np.inf
    b = int(np.argmax(gain))
    return b if gain[b] > gain[a] + 1e-9 else a


def steps_of(table: np.ndarray, a: np.ndarray, go: np.ndarray, come: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """step_of for many words at once (go and come: a row each). Only cells that a word has are touched."""
    left, right, every = table.sum(1), table.sum(0), np.arange(len(a))

    def changes(own: np.ndarray, other: np.ndarray, by_class: np.ndarray) -> np.ndarray:
        """What adding `own` to each class changes in the rows of the table without the word; by_class[j]: what the classes
        have to or from class j."""
        w, j = np.nonzero(own)
        v, cell = own[w, j], by_class[j]
        mine = j == a[w]
        cell[mine] -= other[w[mine]]
        at = np.arange(len(w))
        cell[at, a[w]] -= v + np.where(mine, itself[w], 0.0)
        out = np.zeros((len(a), len(table)))
        if len(w):
            first = np.nonzero(np.concatenate([[True], w[1:] != w[:-1]]))[0]
            out[w[first]] = np.add.reduceat(_xlogx(cell + v[:, None]) - _xlogx(cell), first, axis=0)
        return out

    d = np.repeat(table.diagonal()[None, :], len(a), axis=0)
    d[every, a] -= go[every, a] + come[every, a] + itself
    cross = _xlogx(d + go + come + itself[:, None]) - _xlogx(d + go) - _xlogx(d + come) + _xlogx(d)
    out_sum, in_sum = go.sum(1) + itself, come.sum(1) + itself
    rows, cols = left - come, right - go
    rows[every, a] -= out_sum
    cols[every, a] -= in_sum
    gain = changes(go, come, np.ascontiguousarray(table.T)) + changes(come, go, table) + cross
    gain -= _xlogx(rows + out_sum[:, None]) - _xlogx(rows) + _xlogx(cols + in_sum[:, None]) - _xlogx(cols)
    gain[:, -1] = -np.inf
    empty = rows + cols == 0
    empty[every, a] = False
    gain[empty] = -np.inf
    b = gain.argmax(1)
    return np.where(gain[every, b] > gain[every, a] + 1e-9, b, a)


def known_tail(words: DataFrame) -> bytes:
    """One bit for each remainder that the crc32 of one of these words has: what tells most other words apart before they
    are shuffled. Its size is fixed; however full it is, no word of theirs is missed."""
    bit = F.crc32("word") % TAIL_BITS + 1  # Spark's buckets of bits count from 1
    out = bytearray(TAIL_BITS // 8)
    for r in words.select(bit.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits")).toLocalIterator():
        at = (r["k"] - 1) * len(r["bits"])
        out[at : at + len(r["bits"])] = r["bits"]
    return bytes(out)


def neighbours(texts: DataFrame, place: dict[bytes, int], kind: np.ndarray, own: np.ndarray, of: np.ndarray, forms_at: int, tail: bytes | None, buckets: int) -> DataFrame:
    """(block, words, sizes, cells), in parts to be added: counts of neighbours by class before, class after, and of the word
    after itself. A block from 0 stands for HEAD_BLOCK words of the head, of which only those count to which `own` points. A
    block below 0 is one of `buckets` of words outside the head that `tail` (see known_tail; None: there are none) may mean:
    words in a line, how many cells each has, and the cells."""
    shared = texts.sparkSession.sparkContext.broadcast((place, kind, own, of, tail))
    width = 2 * CLASSES + 1
    columns = ["block", "words", "sizes", "cells"]

    def run(batches):
        place, kind, own, of, tail = shared.value
        at, heads, end = place.get, len(place), place.get(_END, 0)
        far: dict[bytes, int] = {}
        held, n_held = [], 0

        def tail_number(w: bytes) -> int:
            if tail is None or not tail[(h := zlib.crc32(w) % TAIL_BITS) >> 3] >> (h & 7) & 1:
                return -1
            return heads + far.setdefault(w, len(far))

        def out():
            if held:
                code = np.concatenate([c for c, _ in held])
                order = np.argsort(code, kind="stable")
                code, n = code[order], np.concatenate([k for _, k in held])[order]
                first = np.nonzero(np.concatenate([[True], code[1:] != code[:-1]]))[0]
                code, n = code[first], np.add.reduceat(n, first)
                in_head = int(np.searchsorted(code, heads * width))
                pack = lambda code, n: np.stack([code, n], axis=1).astype("<i4").tobytes()
                rows = []
                block = code[:in_head] // (HEAD_BLOCK * width)
                bounds = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1, [in_head]]) if in_head else np.zeros(1, "i8")
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    rows.append((int(block[lo]), None, None, pack(code[lo:hi] - block[lo] * HEAD_BLOCK * width, n[lo:hi])))
                # the words of the tail by bucket
                word, cell, n = code[in_head:] // width - heads, code[in_head:] % width, n[in_head:]
                tails = list(far)
                bucket = np.fromiter((zlib.crc32(w) // 7 % buckets for w in tails), "i8", len(tails))
                order = np.lexsort((word, bucket[word])) if len(word) else np.zeros(0, "i8")
                word, cell, n = word[order], cell[order], n[order]
                bounds = np.concatenate([[0], np.nonzero(np.diff(bucket[word]))[0] + 1, [len(word)]]) if len(word) else np.zeros(1, "i8")
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    start = np.concatenate([[0], np.nonzero(np.diff(word[lo:hi]))[0] + 1])
                    names = [tails[i] for i in word[lo:hi][start].tolist()]
                    rows.append((-1 - int(bucket[word[lo]]), b" ".join(names), np.diff(np.append(start, hi - lo)).astype("<i4").tobytes(), pack(cell[lo:hi], n[lo:hi])))
                for i in range(0, len(rows), 200):
                    part = list(zip(*rows[i : i + 200], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), *(pa.array(c, pa.binary()) for c in part[1:])], columns)
            held.clear()
            far.clear()

        for batch in batches:
            for part in chunks(batch):
                # words of the part in a line, each text after an end and with one behind it
                words = [_END]
                for data in as_bytes(part.column("text")):
                    words += tokens(data)
                    words.append(_END)
                index = np.fromiter(map(at, words, repeat(-1)), "i8", len(words))
                index[:1] = end  # an end before the first
                rest = np.nonzero(index < 0)[0]
                strange = [words[i] for i in rest.tolist()]
                word, types = np.where(own[index], index, -1), kind[index]
                word[rest] = np.fromiter(map(tail_number, strange), "i8", len(strange))
                types[rest] = forms_at + np.fromiter(map(form, strange), "i8", len(strange))
                cls = of[types]
                use = np.nonzero(word >= 0)[0]
                if not len(use):
                    continue
                w = word[use]
                same = use[word[use] == word[use + 1]]
                code, n = np.unique(np.concatenate([w * width + cls[use - 1], w * width + CLASSES + cls[use + 1], word[same] * width + 2 * CLASSES]), return_counts=True)
                held.append((code, n))
                n_held += len(code)
                if n_held > _HELD or len(far) > _FLUSH:
                    yield from out()
                    n_held = 0
        yield from out()

    return map_arrow(texts.select("text"), run, "block long, words binary, sizes binary, cells binary")


def word_classes(cells: DataFrame, names: list[bytes], table: np.ndarray, of_form: np.ndarray) -> DataFrame:
    """(at, word, cls): the class of every word seen LEAST_SEEN times or more, by one exchange step from its form's; words
    of the head (`names`) by their place there, others by name."""
    shared = cells.sparkSession.sparkContext.broadcast((names, table.astype("f8"), of_form))
    width = 2 * CLASSES + 1

    def run(batches):
        names, table, of_form = shared.value
        for batch in batches:
            for block, parts in zip(batch.column("block").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                cell = np.frombuffer(b"".join(p["cells"] for p in parts), "<i4").reshape(-1, 2)
                first = block * HEAD_BLOCK
                if block >= 0:
                    words, code = names[first : first + HEAD_BLOCK], cell[:, 0].astype("i8")
                else:
                    number: dict[bytes, int] = {}
                    index = np.array([number.setdefault(w, len(number)) for p in parts for w in p["words"].split(b" ")], "i8")
                    words, code = list(number), np.repeat(index, np.frombuffer(b"".join(p["sizes"] for p in parts), "<i4")) * width + cell[:, 0]
                n = np.bincount(code, cell[:, 1], len(words) * width).reshape(-1, width)
                use = np.nonzero(n[:, :CLASSES].sum(1) >= LEAST_SEEN)[0]
                for i in range(0, len(use), 500):
                    at = use[i : i + 500]
                    come, go, itself, every = n[at, :CLASSES], n[at, CLASSES:-1], n[at, -1], np.arange(len(at))
                    a = of_form[np.array([form(words[k]) for k in at.tolist()], "i8")]
                    come[every, a] -= itself
                    go[every, a] -= itself
                    cls = steps_of(table, a, go, come, itself)
                    head = block >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(first + at if head else [None] * len(at), pa.int64()), pa.array([None] * len(at) if head else [words[k] for k in at.tolist()], pa.binary()), pa.array(cls.astype("i8"))], ["at", "word", "cls"])

    # a step takes long for its few bytes, so the number of tasks is not left to their size
    dealt = cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")
    return map_arrow(dealt.groupBy("block").agg(F.collect_list(F.struct("words", "sizes", "cells")).alias("parts")), run, "at long, word binary, cls long")


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every type; the end (type 0) keeps a class of its own, the last."""
    n = len(pairs)
    count = pairs.sum(1)
    order = [t for t in np.argsort(-count, kind="stable").tolist() if t != 0]
    of = np.zeros(n, "i8")
    of[order] = np.arange(len(order)) % (classes - 1)
    of[0] = classes - 1
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    table = one.T @ pairs @ one
    out_to, in_from = pairs @ one, pairs.T @ one  # by type: counts to and from each class
    left, right = table.sum(1), table.sum(0)
    for _ in range(sweeps):
        moved = 0
        for t in order:
            if not count[t]:
                continue
            a, itself = of[t], float(pairs[t, t])
            go, come = out_to[t].copy(), in_from[t].copy()
            go[a] -= itself
            come[a] -= itself
            n_out, n_in = go.sum() + itself, come.sum() + itself
            # without the type
            table[a] -= go
            table[:, a] -= come
            table[a, a] -= itself
            left[a] -= n_out
            right[a] -= n_in
            gain = gains(table, left, right, go, come, itself)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += go
            table[:, b] += come
            table[b, b] += itself
            left[b] += n_out
            right[b] += n_in
            if b != a:
                moved += 1
                of[t] = b
                out_to[:, a] -= pairs[:, t]
                out_to[:, b] += pairs[:, t]
                in_from[:, a] -= pairs[t]
                in_from[:, b] += pairs[t]
        if not moved:
            break
    return of


def transitions(table: np.ndarray) -> np.ndarray:
    """P(class | class before) of a table of class bigrams."""
    came = table.sum(0)
    plain = (came + 1) / (came.sum() + len(table))
    kinds = np.maximum((table > 0).sum(1), 1)
    return (table + kinds[:, None] * plain) / (table.sum(1) + kinds)[:, None]


class Model:
    """What scoring needs: log10 probabilities by type, and sums of tokens and of seen words by form type."""

    def __init__(self, types: Types, of: np.ndarray, pairs: np.ndarray, form_tokens: np.ndarray, form_words: np.ndarray, classes: int = CLASSES):
        self.types = types
        one = np.zeros((types.size, classes))
        one[np.arange(types.size), of] = 1
        table = one.T @ pairs @ one
        count = pairs.sum(0) + 0.5
        emit = count / (one.T @ count)[of]
        self.step = np.log10(transitions(table))[of][:, of].astype("f8") + np.log10(emit)[None, :]  # by type and the type before
        self.form_tokens, self.form_words = form_tokens, form_words

    def within(self, n: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """log10 P(word | form type) of words seen n times in training."""
        total, words = self.form_tokens[forms], self.form_words[forms]
        seen = (n - DISCOUNT) / np.maximum(total, 1)
        unseen = np.where(total > 0, DISCOUNT * words / np.maximum(total, 1), 1.0) / (words + 1)
        return np.log10(np.where(n > 0, np.maximum(seen, 1e-300), unseen))


def _form_share(model: Model, n: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """log10 of the tokens, of those of its class, that a word of a form type seen n times has."""
    return np.log10(model.form_tokens[forms] + 0.5) + model.within(n, forms)


def score(docs: DataFrame, held_out: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row, by a model of the rows where
    held_out is false."""
    shared_folder(docs.sparkSession)
    spark = docs.sparkSession
    train = docs.filter(~held_out).select("text")
    vocab = word_counts(train).checkpoint()
    # the least count of a word in the head: at most HEAD words have it
    eighths = F.floor(F.log2("n") * 8)
    steps = sorted(((r["e"], r["words"], r["tokens"]) for r in vocab.groupBy(eighths.alias("e")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()), reverse=True)
    n_words, n_tokens = sum(s[1] for s in steps), sum(s[2] for s in steps)
    least, held = None, 0
    for e, words, _ in steps:
        if held + words > HEAD:
            break
        least, held = e, held + words
    chosen = F.lit(False) if least is None else eighths >= least
    if least is None and steps:  # the topmost words alone are too many: the first of them by count and word
        last = vocab.filter(eighths == steps[0][0]).orderBy(F.desc("n"), "word").limit(HEAD).orderBy("n", F.desc("word")).first()
        chosen = (F.col("n") > last["n"]) | ((F.col("n") == last["n"]) & (F.col("word") <= F.lit(bytes(last["word"]))))
    in_head = chosen | (F.col("word") == F.lit(_END))
    counts = {bytes(r["word"]): r["n"] for r in vocab.filter(in_head).select("word", "n").toLocalIterator()}
    lexicon = sorted((w for w in counts if w != _END), key=lambda w: (-counts[w], w))[:LEXICON]
    types = Types(lexicon)
    numbers = {w: 0 if w == _END else types.of(w) for w in counts}
    pairs = pair_counts(train, {w: t for w, t in numbers.items() if w != _END}, types)

    listed = spark.sparkContext.broadcast(types)

    def by_form(batches):
        own = listed.value
        tokens_of, words_of = np.zeros(FORMS, "i8"), np.zeros(FORMS, "i8")
        for batch in batches:
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if n < LEAST_SEEN and w not in own.number and w != _END:
                    f = form(w)
                    tokens_of[f] += n
                    words_of[f] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FORMS)), pa.array(tokens_of), pa.array(words_of)], ["form", "tokens", "words"])

    form_tokens, form_words = np.zeros(FORMS, "i8"), np.zeros(FORMS, "i8")
    for r in vocab.mapInArrow(by_form, "form long, tokens long, words long").groupBy("form").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        form_tokens[r["form"]], form_words[r["form"]] = r["tokens"], r["words"]
    of = exchange(pairs)
    model = Model(types, of, pairs, form_tokens, form_words)
    # by head word: its count, type and class, and the log10 of its tokens within its class
    names = list(counts)
    place = {w: i for i, w in enumerate(names)}
    n = np.array([counts[w] for w in names], "f8")
    kind = np.array([numbers[w] for w in names], "i8")
    base_unit = np.log10(float(n_tokens + n_words + 1))
    in_form = kind >= types.forms_at
    one = np.eye(CLASSES)[of]
    clustered = vocab.filter(~in_head & (F.col("n") >= LEAST_SEEN))
    occurrences = clustered.agg(F.sum("n")).first()[0]
    tail = known_tail(clustered) if occurrences else None
    buckets = max(16, (occurrences or 0) // BUCKET_TOKENS)
    found = word_classes(neighbours(train, place, kind, in_form & (n >= LEAST_SEEN), of, types.forms_at, tail, buckets), names, one.T @ pairs @ one, of[types.forms_at :]).checkpoint()
    cls = of[kind]
    for r in found.filter("at is not null").select("at", "cls").toLocalIterator():
        cls[r["at"]] = r["cls"]
    share = np.where(in_form & (n < LEAST_SEEN), _form_share(model, n, np.where(in_form, kind - types.forms_at, 0)), np.log10(np.maximum(n, 0.5)))
    end_n = float(counts.get(_END, 0))
    shared = spark.sparkContext.broadcast((place, cls.astype("u1"), np.log10(n + 1) - base_unit, share))
    fields = ["__row", "doc_id", "held_out", *keep]

    def run(batches):
        place, cls, base, share = shared.value
        at = place.get
        for batch in batches:
            for part in chunks(batch):
                rows, local, tail = part.column("__row").to_pylist(), [], [[], [], []]
                for row, data in zip(rows, as_bytes(part.column("text")), strict=True):
                    words = tokens(data)
                    index = np.fromiter(map(at, words, repeat(-1)), "i8", len(words))
                    places: dict[bytes, bytes] = {}
                    absent = np.nonzero(index < 0)[0]
                    packed, at_word = absent.astype("<i4").tobytes(), places.get
                    for k, i in enumerate(absent.tolist()):
                        w, here = words[i], packed[4 * k : 4 * k + 4]
                        places[w] = here if (before := at_word(w)) is None else before + here
                    tail[0].append(np.full(len(places), row))
                    tail[1] += places
                    tail[2] += places.values()
                    known = index[index >= 0]
                    seq = np.full(len(words) + 1, _OPEN, "u1")
                    seq[-1] = CLASSES - 1
                    seq[:-1][index >= 0] = cls[known] if len(known) else 0
                    local.append((len(words) + 1, len(known) + (end_n > 0), float(base[known].sum()) + np.log10(end_n + 1) - base_unit, float(share[known].sum()) + np.log10(max(end_n, 0.5)), seq.tobytes()))
                total, known, base_sum, sum_, seqs = zip(*local, strict=True)
                n, m = len(rows), len(tail[1])
                null = lambda values, k: pa.concat_arrays([pa.array(values, k), pa.nulls(m, k)])
                columns = [pa.concat_arrays([part.column(c).combine_chunks() if isinstance(part.column(c), pa.ChunkedArray) else part.column(c), pa.array(np.concatenate(tail[0]), pa.int64()) if c == "__row" else pa.nulls(m, part.column(c).type)]) for c in fields]
                columns += [pa.array([*(b"\n%d" % r for r in rows), *tail[1]], pa.binary()), null(total, pa.int64()), null(known, pa.int64()), null(base_sum, pa.float64()), null(sum_, pa.float64()), null(seqs, pa.binary())]
                columns += [pa.concat_arrays([pa.nulls(n, k), pa.array(values, k)]) for values, k in ((tail[2], pa.binary()), ([*map(form, tail[1])], pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [*fields, "word", "n_tokens", "n_known", "base_score", "score", "seq", "places", "form"])

    ready = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", "text", held_out.alias("held_out"), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name not in ("text", "__row"))
    sums = "n_tokens long, n_known long, base_score double, score double, seq binary"
    parts = map_arrow(ready, run, f"__row long, {kept}, word binary, {sums}, places binary, form long")
    # rows that tell of a document itself have a word that no text has, and so find no count
    rare = vocab.filter(~in_head).join(found.filter("at is null").select("word", "cls"), "word", "left").select(F.col("word").alias("__word"), F.col("n").alias("__n"), F.col("cls").alias("__cls"))
    joined = parts.join(rare, parts["word"] == rare["__word"], "left")
    open_words = F.when(F.col("places").isNotNull(), F.struct("places", "form", F.coalesce("__n", F.lit(0)).alias("n"), F.coalesce("__cls", F.lit(-1)).alias("cls")))
    grouped = joined.groupBy("__row").agg(*(F.max(c).alias(c) for c in [*fields[1:], "n_tokens", "n_known", "base_score", "score", "seq"]), F.collect_list(open_words).alias("__open"))
    whole = spark.sparkContext.broadcast((model, of[types.forms_at :]))

    def fill(batches):
        model, of_form = whole.value
        for batch in batches:
            size = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            seq = np.frombuffer(b"".join(batch.column("seq").to_pylist()), "u1").copy()
            start = np.cumsum(size) - size
            known, base, own = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("n_known", "base_score", "score"))
            lists = batch.column("__open")
            items = lists.flatten()
            if len(items):
                row = np.repeat(np.arange(len(size)), np.diff(lists.offsets.to_numpy()))
                where = items.field("places").to_pylist()
                times = np.array([len(x) // 4 for x in where])
                n, forms, cls = (items.field(c).to_numpy(zero_copy_only=False) for c in ("n", "form", "cls"))
                seq[np.repeat(start[row], times) + np.frombuffer(b"".join(where), "<i4")] = np.repeat(np.where(cls < 0, of_form[forms], cls), times)
                share = np.where(cls < 0, _form_share(model, n, forms), np.log10(np.maximum(n, 1)))
                np.add.at(known, row, np.where(n > 0, times, 0))
                np.add.at(base, row, times * (np.log10(n + 1.0) - base_unit))
                np.add.at(own, row, times * share)
            filled = [seq[a : a + k].tobytes() for a, k in zip(start, size, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields[1:]), batch.column("n_tokens"), pa.array(known), pa.array(base), pa.array(own), pa.array(filled, pa.binary())], [*fields[1:], "n_tokens", "n_known", "base_score", "score", "seq"])

    filled = map_arrow(grouped.drop("__row"), fill, f"{kept}, {sums}").checkpoint()

    def bigrams(batches):
        total = np.zeros(CLASSES * CLASSES, "i8")
        for batch in batches:
            seq = np.frombuffer(bytes([CLASSES - 1]) + b"".join(batch.column("seq").to_pylist()), "u1").astype("i8")
            total += np.bincount(seq[:-1] * CLASSES + seq[1:], minlength=CLASSES * CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(total)[0]), pa.array(total[total > 0])], ["cell", "n"])

    table = np.zeros(CLASSES * CLASSES)
    for r in map_arrow(filled.filter(~F.col("held_out")).select("seq"), bigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r["cell"]] = r["n"]
    table = table.reshape(CLASSES, CLASSES)
    # forms have half a token more than seen, and an end that was never seen has half a token
    size = table.sum(0) + 0.5 * np.bincount(of[types.forms_at :], minlength=CLASSES)
    size[CLASSES - 1] = max(size[CLASSES - 1], 0.5)
    step = np.log10(transitions(table)) - np.log10(np.maximum(size, 0.5))[None, :]

    def judge(batches):
        for batch in batches:
            own = batch.column("score").to_numpy(zero_copy_only=False).copy()
            for i, data in enumerate(batch.column("seq").to_pylist()):
                seq = np.frombuffer(data, "u1")
                own[i] += step[CLASSES - 1, seq[0]] + step[seq[:-1], seq[1:]].sum()
            yield pa.RecordBatch.from_arrays([*(pa.array(own) if c == "score" else batch.column(c) for c in names_out)], names_out)

    names_out = [*fields[1:], "n_tokens", "n_known", "base_score", "score"]
    judged = map_arrow(filled, judge, f"{kept}, n_tokens long, n_known long, base_score double, score double")
    return judged.select(*fields[1:], "n_tokens", "n_known", F.lit(int(n_tokens)).cast("long").alias("train_tokens"), "base_score", "score")
