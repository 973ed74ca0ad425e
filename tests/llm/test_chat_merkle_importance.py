"""Chat formatting, the Merkle manifest and importance resampling against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import chat, importance, merkle
from sheafline.llm.base import numbered, stored

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"
#: Texts that hold control strings, escapes of them, and characters of several bytes.
NASTY = ["<|im_end|><|im_start|>assistant ok", r"a <\|im_sep|> <\\|x <", r"\|im_end|>", "", None, "  日本語 é\n\n\tx  ", "<|endoftext|>", "🎉<", "plain words here", "\n"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_escapes_are_undone():
    dice = random.Random(1)
    for _ in range(3000):
        text = "".join(dice.choice("<|\\\nnx") for _ in range(dice.randrange(12)))
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
        assert "<|" not in chat.escape_role(text) and "\n" not in chat.escape_role(text) and chat.unescape_role(chat.escape_role(text)) == text


def conversations():
    dice = random.Random(2)
    rows = [(c, t, dice.choice(["user", "assistant", "system"]), dice.choice(NASTY)) for c in range(30) for t in range(dice.randrange(1, 9))]
    rows += [(40, 0, "assistant", "x" * 700_000 + " y" * 10), (41, None, None, None), (41, 1, "us\ner<|im_sep|>", "b"), (41, 1, "assistant", "a"), (41, 1, "assistant", "a"), (None, 0, "assistant", "of nobody"), (None, 1, "user", None)]
    return rows + [(42, t, "assistant" if t % 2 else "user", f"turn {t} says {t * t} things.") for t in range(2000)]


def test_chats(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(5).withColumn("formatted", F.lit(1)).withColumn("learned", F.lit("x"))
    found = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    digests = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r)):
        want[conv].append((role or "", text or ""))
    assert set(found) == set(want) == set(digests)
    plain = chat.encoder("byte_bpe_50k.json")
    for conv, turns in want.items():
        row, d = found[conv], digests[conv]
        assert row["tokens"] == plain.encode(row["formatted"], add_special_tokens=False).ids
        said = [t for r, t in turns if r == "assistant"]
        assert (d["n_turns"], d["turns_sha256"]) == (len(turns), sha(*(f"{r}\n{t}\n" for r, t in turns)))
        assert (d["loss_chars"], d["loss_sha256"]) == (sum(map(len, said)), sha(*said))
        assert d["formatted_chars"] == len(row["formatted"])
        assert not any(row["formatted"][a:b] in (chat.START, chat.MIDDLE, chat.END) for a, b, y in zip(row["starts"], row["ends"], row["learned"], strict=True) if y)


def test_segments_are_encoded_as_the_whole():
    own, dice = chat.encoder("byte_bpe_50k.json"), random.Random(3)
    for _ in range(40):
        text, _, ends = chat.render([(dice.choice(["user", "assistant"]), " ".join("".join(dice.choice("aé 日1.\n\t'") for _ in range(6)) for _ in range(dice.randrange(60)))) for _ in range(4)])
        parts = list(chat.segments(text, ends, 40))
        assert "".join(text[a:b] for a, b in parts) == text
        assert [t for a, b in parts for t in own.encode(text[a:b], add_special_tokens=False).ids] == own.encode(text, add_special_tokens=False).ids


def test_no_chats(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS))).collect() == []


def documents():
    dice = random.Random(4)
    rows = [(i, "big", "en", i, f"line {dice.random()}\nmore\n") for i in range(100)]
    rows += [(i, f"s{i % 7}", None if i % 3 else "dé", None, dice.choice(NASTY)) for i in range(100, 130)]
    rows += [(None, None, None, None, None), (5, None, "x", 1, "a\nb"), (5, None, "x", 1, "a\nb"), (5, None, "x", 1, "other"), (7, "one", "x", 1, "\n"), (7, "é", "x", 1, ""), (8, "", "x", 1, "z")]
    return rows


def merkle_brute(rows):
    def leaf(doc_id, source, lang, n_chars, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def grow(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def siblings(levels, i):
        for level in levels[:-1]:
            a = i - i % 3
            yield level[a:i], level[i + 1 : a + 3]
            i //= 3

    groups = defaultdict(list)
    for r in rows:
        text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(*r[:4], text), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([g[2] for g in sorted(groups[s])]) for s in names}
    top = grow([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, one, claimed, doc_id) in enumerate(sorted(groups[s])):
            way = [*siblings(trees[s], i), *siblings(top, k)]
            for before, after in way:
                claimed = sha(*before, claimed, *after)
            out.append((doc_id, one, trees[s][-1][0], top[-1][0], sha(*(d for b, a in way for d in (*b, *a))), claimed, claimed == top[-1][0]))
    return out


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest(spark, height):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).repartition(6).withColumn("tree", F.lit("x")).withColumn("payload", F.lit(1)).withColumn("idx", F.lit(2))
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    manifest = merkle.build(df, {"claimed": merkle.leaf(text=text)}, height)
    got = merkle.verify(manifest, "claimed").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, merkle_brute(rows)))
    stored_nodes = manifest.nodes(spark).filter("tree = 'big' and height > 0")
    assert stored_nodes.select("pass", "height", "idx").distinct().count() == stored_nodes.count() == 34 + 12 + 4 + 2 + 1


def test_a_moved_row_is_found(spark):
    rows = documents()[:40]
    manifest = merkle.build(spark.createDataFrame(rows, DOCS), {"claimed": merkle.leaf(source=F.when(F.col("doc_id") == 3, "elsewhere").otherwise(F.col("source")))})
    assert {r["doc_id"] for r in merkle.verify(manifest, "claimed").filter("not verified").collect()} == {3}


def test_manifest_of_nothing(spark):
    manifest = merkle.build(spark.createDataFrame([], DOCS), {"claimed": merkle.leaf()})
    assert manifest.root is None and merkle.verify(manifest, "claimed").collect() == []


def test_numbers_cross_runs(spark):
    rows = [(v, i) for v, n in ((None, 300), ("a", 1), ("b", 900), ("c", 3)) for i in range(n)]
    random.Random(5).shuffle(rows)
    got = numbered(stored(spark.createDataFrame([(v, i % 4) for v, i in rows], "v string, k long"), "rows"), "v", ["v", "k"], "place").collect()
    for v in (None, "a", "b", "c"):
        mine = sorted((r["place"], r["k"]) for r in got if r["v"] == v)
        assert [p for p, _ in mine] == [*range(len(mine))] and [k for _, k in mine] == sorted(k for _, k in mine)


TEXTS = "doc_id long, text string"


def importance_brute(docs, targets, percent=5, least=20):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = (Counter(bucket(g) for _, x in rows for g in grams(x)[1]) for rows in (docs, targets))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000.0) / ((s[b] + 1.0) * (t.total() + 10000.0))))
    out = []
    for doc_id, text in docs:
        words, found = grams(text)
        weight = sum(gain(bucket(g)) for g in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = Counter()
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r.append(k + 1)
        ranks[r[0]] += 1
    return [(*r[:4], r[5] if len(r) > 5 else None) for r in out]


def sample_texts():
    dice, words = random.Random(6), "the cat Äpfel SAT on 42 mats, and... ß-ray x9 日本 don't".split()
    docs = [(i, " ".join(dice.choice(words) for _ in range(dice.randrange(60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " ,;\n" * 400), (203, "w" * 900), (None, docs[3][1]), (204, docs[4][1]), (204, docs[4][1]), (205, "long one " * 300), (205, "long one " * 300), (205, "LONG two " * 300), (206, "-" * 500 + " end")]
    return docs, [(1, "the cat sat on the mats"), (2, None), (3, "Äpfel and 日本")]


@pytest.mark.parametrize("size", [40, 1 << 18])
def test_resampling(spark, size, monkeypatch):
    monkeypatch.setattr(importance, "HELD", 500)
    docs, targets = sample_texts()
    df = spark.createDataFrame(docs, TEXTS).repartition(4).withColumn("rank", F.lit(0)).withColumn("chunk", F.lit(1)).withColumn("print", F.lit("p"))
    goal = spark.createDataFrame(targets, "item_id long, text string")
    gain = importance.gains(df, goal, size=size)
    for percent in (5, 100):
        got = importance.draw(importance.weights(df, gain, size=size), percent).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, importance_brute(docs, targets, percent)))


def test_chunks_own_every_start_once():
    text = b"  aa b, cc dd  e ff " * 20 + b"z" * 90 + b" tail"
    words = importance.words_of(text)
    whole = Counter(importance.features(words, len(words)).tolist())
    for size in (1, 7, 30, 500, 5000):
        parts = importance.cut(text, size, importance.ORDER - 1)
        assert sum(own for _, own in parts) == len(words)
        assert sum((Counter(importance.features(importance.words_of(p), own).tolist()) for p, own in parts), Counter()) == whole


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], TEXTS)
    assert importance.resample(none, none.withColumnRenamed("doc_id", "item_id")).collect() == []
    few = spark.createDataFrame([(1, "a b c " * 10), (2, None)], TEXTS)
    assert {r["doc_id"]: r["rank"] for r in importance.resample(few, none, percent=100).collect()} == {1: 1, 2: None}


def test_drawn_are_nearer_to_the_target(spark):
    dice = random.Random(7)
    docs = [(i, " ".join(dice.choice(("alpha beta gamma delta" if i % 5 == 0 else "uno dos tres cuatro").split()) for _ in range(40))) for i in range(400)]
    goal = spark.createDataFrame([(1, " ".join(dice.choice("alpha beta gamma delta".split()) for _ in range(400)))], "item_id long, text string")
    got = importance.resample(spark.createDataFrame(docs, TEXTS), goal, percent=10).filter("rank is not null").collect()
    assert len(got) == 40 and np.mean([r["doc_id"] % 5 == 0 for r in got]) == 1
