"""Each operator against brute force, and on empty, null, tied, repeated and oddly named input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from sheafline.llm import class_lm, decontam, lang_id, near_dups, near_texts, pieces, pii, quality, queries, suffix, tokcount, url_tree
from sheafline.llm.base import remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN, DE = "the of and to in that is was for with on be".split(), "der die das und ist nicht ein mit von zu über für".split()


def prose(words, n, seed):
    dice = random.Random(seed)
    return " ".join(dice.choice(words) for _ in range(n))


def corpus(n=60):
    rows = [(i, prose(EN if i % 2 else DE, 20 + i % 40, i), "en" if i % 2 else "de", "s", 0) for i in range(n)]
    return rows + [(100, None, None, None, None), (101, "", "en", "s", 0), (102, "12 34 --", "en", "s", 0), (103, rows[1][1], "en", "s", 0), (103, rows[1][1], "en", "s", 0), (None, "the of and", "en", "s", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(docs):
    """Extra columns with the names that operators use inside."""
    return docs.select("*", *(F.lit(1).alias(c) for c in ("fp", "bits", "score", "lang_pred", "n_words", "runs", "items", "key", "spans", "word", "form", "pieces", "anchor", "component_id", "n", "k")))


# language


def ppm_bits(counts, data: bytes, order: int) -> float:
    """Code length by walking the contexts of one language for each byte, straight from the definition."""
    total = 0.0
    padded = b"\n" * order + data
    for i in range(order, len(padded)):
        out: set[int] = set()
        for k in range(order, -1, -1):
            followers = counts[k].get(padded[i - k : i])
            if not followers:
                continue
            left = {b: n for b, n in followers.items() if b not in out}
            n, d = sum(left.values()), len(left)
            if padded[i] in left:
                total += math.log2((n + d) / left[padded[i]])
                break
            if d:
                total += math.log2((n + d) / d)
            out |= set(followers)
        else:
            total += math.log2(256 - len(out))
    return total


def test_code_lengths_are_exact():
    texts = {"en": [prose(EN, 40, i) for i in range(8)], "de": [prose(DE, 40, i) for i in range(8)]}
    rows, trees = [], {}
    for lang, own in texts.items():
        trees[lang] = [defaultdict(Counter) for _ in range(4)]
        for t in own:
            p = b"\n" * 3 + t.encode()
            for i in range(3, len(p)):
                for k in range(4):
                    trees[lang][k][p[i - k : i]][p[i]] += 1
        for k in range(4):
            rows += [(lang, k, int.from_bytes(c + bytes([b]), "big"), n) for c, f in trees[lang][k].items() for b, n in f.items()]
    model = lang_id.build(pd.DataFrame(rows, columns=["lang", "k", "gram", "n"]))
    tests = ["the und über zz", "xyzzy ÿ 日本", prose(EN, 30, 99), "a", ""]
    data = [t.encode() for t in tests]
    got = model.bits(np.frombuffer(b"".join(data), "u1"), np.cumsum([0, *map(len, data)]))
    want = [[ppm_bits(trees[lang], d, 3) for lang in model.languages] for d in data]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-3)


def test_language(docs, empty, odd):
    held = remainder("doc_id", 4) == 2
    model = lang_id.fit(docs, ~held)
    rows = lang_id.predict(docs, model).collect()
    assert len(rows) == docs.count() and all(r["lang_pred"] == r["lang"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 100)
    by_id = {r["doc_id"]: r for r in rows}
    assert [(by_id[i]["lang_pred"], by_id[i]["score"]) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert lang_id.fit(empty) == [] and lang_id.predict(empty, model).count() == 0
    assert {r["lang_pred"] for r in lang_id.predict(docs, []).collect()} == {"und"}
    assert lang_id.predict(odd, model).count() == odd.count()
    kept = lang_id.predict(odd, model, names=("a", "b", "c"))
    assert kept.columns == [*odd.columns, "a", "b", "c"] and kept.drop("a", "b", "c").exceptAll(odd).count() == 0


def test_languages_in_several_models(docs):
    """A table of costs over the limit is made as several models; what they say together is the same."""
    third = docs.select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")).alias("lang"), "source")
    whole = lang_id.fit(third)
    counts = lang_id.map_arrow(third.filter("lang is not null and text is not null").select("lang", "text"), lang_id._grams(3), "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).filter("k < 2 or n >= 2").toPandas()
    parts = lang_id.models(counts, limit=1)
    assert len(whole) == 1 and len(parts) == 3
    said = [sorted((repr(r["doc_id"]), r["lang_pred"], round(r["score"], 6), r["bits"] and round(r["bits"], 4)) for r in lang_id.predict(docs, m).collect()) for m in (whole, parts)]
    assert [x[:3] for x in said[0]] == [x[:3] for x in said[1]] and {x[1] for x in said[0]} == {"en", "de", "xx", "und"}


# decontamination


def decontam_brute(text, items):
    w = decontam.words((text or "").encode())
    hit, found = set(), set()
    for name, t in items:
        iw = decontam.words((t or "").encode())
        n = min(10, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, empty, odd):
    item = prose(EN, 25, 5)
    items = [(1, item), (2, item), (3, "short one here"), (4, None), (5, "--"), (10, prose(DE, 12, 6).upper()), (11, "été 12")]
    texts = [item, f"aa {item} bb", "SHORT, one here! short one", "no", None, "", "été  12", prose(DE, 12, 6), " ".join(item.split()[3:13]), " ".join(item.split()[3:12])] + [prose(EN, 50, i) for i in range(20)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = [decontam_brute(t, items) for t in texts]
    for options in ({}, {"block_words": 10}):
        got = {r[0]: tuple(r)[1:] for r in decontam.report(d, b, **options).collect()}
        assert [got[i] for i in range(len(texts))] == want
    cleaned = decontam.clean(d, b)
    assert cleaned.columns == d.columns and decontam.report(cleaned, b).filter("contaminated").count() == 0
    kept = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert all(kept[i] == t for i, t in enumerate(texts) if not want[i][4])
    gone = decontam.clean(d, b, remove="documents")
    assert {r["doc_id"] for r in gone.collect()} == {i for i, w in enumerate(want) if not w[4]}
    assert decontam.report(empty, b).count() == 0 and decontam.report(d, b.limit(0)).filter("contaminated").count() == 0
    strange = odd.select("*", *(F.lit("u").alias(c) for c in ("__n", "__runs", "__items", "__doc")))
    for options in ({}, {"block_words": 10}):
        for remove in ("spans", "documents"):
            same = decontam.clean(strange.filter("doc_id >= 100"), b, remove=remove, **options)
            assert same.columns == strange.columns and same.filter("__runs <> 'u' or __doc <> 'u'").count() == 0


# pieces


@pytest.fixture(scope="module")
def lattice():
    return pieces.lattice("piece_bpe_32k.model", 1.0)


def test_round_trip(lattice):
    texts = ["▁a b▁ \n\t  é日本\U0001f600", "", "a", " lead", "trail  ", "x\r\ny\x00", "ab" * 3000, "한국어 ▁▁ ok"]
    drawn = lattice.sample(texts, pieces.row_keys(range(len(texts))))
    assert [lattice.decode(d) for d in drawn] == texts and len(drawn[1]) == 0
    alone = [lattice.sample([t], pieces.row_keys([i]))[0] for i, t in enumerate(texts)]
    assert all((a == b).all() for a, b in zip(drawn, alone, strict=True))


def test_sampling_has_the_lattice_distribution(lattice):
    spelled = {s: i for i, s in enumerate(lattice.spelling) if lattice.weight[i] > -1e9}

    def paths(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in spelled:
                for rest in paths(s[n:]):
                    yield (spelled[s[:n]], *rest)

    weight = {p: math.exp(sum(lattice.weight[i] for i in p)) for p in paths(b" them")}
    n = 20_000
    seen = Counter(tuple(d.tolist()) for d in lattice.sample(["them"] * n, pieces.row_keys(range(n))))
    assert set(seen) <= set(weight) and max(abs(seen[p] / n - w / sum(weight.values())) for p, w in weight.items()) < 0.015


def test_piece_table(docs, empty):
    got = pieces.encode(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    again = {(r["doc_id"], r["pieces_sha256"]) for r in pieces.encode(docs.repartition(5)).collect()}
    assert {(r["doc_id"], r["pieces_sha256"]) for r in rows} == again
    assert sorted((r["text"] for r in pieces.decode(got).collect())) == sorted((r["text"] or "") for r in docs.collect())
    assert pieces.encode(empty).count() == 0


# language model


def test_class_model(docs, empty, odd):
    held = remainder("doc_id", 7) == 2
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    rows = docs.collect()
    c = Counter()
    for r in rows:
        if not is_held(r["doc_id"]):
            c.update([*(r["text"] or "").encode().lower().split(), b" "])
    n, v = sum(c.values()), len(c)
    got = class_lm.score(docs, held).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        w = [*(r["text"] or "").encode().lower().split(), b" "]
        want[(r["doc_id"], is_held(r["doc_id"]), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert class_lm.score(empty, held).count() == 0
    untrained = class_lm.score(docs, F.lit(True)).collect()
    assert len(untrained) == len(rows) and all(r["base_score"] == 0 and r["n_known"] == 0 for r in untrained)
    assert class_lm.score(odd, held).count() == len(rows)


def test_score_beats_the_base(spark):
    """On held-out rows of text with classes, and unseen words in it."""
    dice = random.Random(9)
    kinds = [[f"{c}{i}{e}" for i in range(60)] for c, e in (("n", "ab"), ("v", "cd"), ("a", "ef"))]
    rows = [(i, " ".join(dice.choice(k) if dice.random() > 0.03 else f"u{dice.randint(0, 10**9)}" for _ in range(12) for k in kinds), "en", "s", 0) for i in range(300)]
    got = class_lm.score(spark.createDataFrame(rows, SCHEMA).repartition(3), remainder("doc_id", 7) == 2).filter("held_out").collect()
    assert sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got) and len(got) > 20


def test_unseen_words_of_a_form_share_what_is_left():
    types = class_lm.Types([b"w"])
    forms = np.array([3])
    model = class_lm.Model(types, np.zeros(types.size, "i8"), np.zeros((types.size, types.size)), np.full(class_lm.FORMS, 10.0), np.full(class_lm.FORMS, 4.0), classes=2)
    seen, unseen = (10 ** model.within(np.array([float(n)]), forms)[0] for n in (1, 0))
    assert math.isclose(seen, 0.5 / 10) and math.isclose(unseen, 0.5 * 4 / 10 / 5)


def test_tail_words_are_joined(docs, monkeypatch):
    held = remainder("doc_id", 7) == 2
    whole = {(r["doc_id"], round(r["base_score"], 6), round(r["score"], 6)) for r in class_lm.score(docs, held).collect()}
    monkeypatch.setattr(class_lm, "HEAD", 5)
    monkeypatch.setattr(class_lm, "LEXICON", 3)
    few = {(r["doc_id"], round(r["base_score"], 6)) for r in class_lm.score(docs, held).collect()}
    assert few == {x[:2] for x in whole}


def test_exchange_and_probabilities():
    dice = np.random.default_rng(0)
    pairs = np.zeros((class_lm.FORMS + 7, class_lm.FORMS + 7), "i8")
    for t in range(1, 7):  # odd types follow even ones
        for u in range(1, 7):
            pairs[t, u] = dice.integers(50, 60) if (t + u) % 2 else 1
    pairs[0, 1] = pairs[2, 0] = 5
    of = class_lm.exchange(pairs, classes=3)
    assert len({of[1], of[3], of[5]}) == 1 and len({of[2], of[4], of[6]}) == 1 and of[1] != of[2] and of[0] == 2
    types = class_lm.Types([b"w%d" % i for i in range(6)])
    model = class_lm.Model(types, of, pairs, np.ones(class_lm.FORMS, "i8"), np.ones(class_lm.FORMS, "i8"), classes=3)
    assert np.allclose((10**model.step).sum(1), 1)


def test_steps_of_many_words_are_those_of_each():
    dice = np.random.default_rng(2)
    m = 7
    table = dice.integers(0, 40, (m, m)).astype("f8")
    table[:, 4] = table[4] = 0  # an empty class
    words, classes = [], [c for c in range(m - 1) if c != 4]
    for i in range(200):
        a = int(dice.choice(classes))
        # a word's counts are part of the table's
        go = np.floor(table[a] * dice.random(m) * (dice.random(m) < 0.4) / 2)
        come = np.floor(table[:, a] * dice.random(m) * (dice.random(m) < 0.4) / 2)
        itself = float(dice.integers(0, 2)) if table[a, a] > go[a] + come[a] + 1 else 0.0
        words.append((a, go, come, itself))
    a, go, come, itself = (np.array(x) for x in zip(*words, strict=True))
    assert class_lm.steps_of(table, a, go, come, itself).tolist() == [class_lm.step_of(table, *w) for w in words]


def test_every_word_with_contexts_is_clustered(spark, monkeypatch):
    """Words outside the lexicon, in the head or not, get their class by their own neighbours."""
    monkeypatch.setattr(class_lm, "LEXICON", 8)
    dice = random.Random(3)
    common = [["north", "east", "south", "west"], ["red", "blue", "green", "black"]]
    names = [[f"n{k:03d}{e}" for e in ("ab", "cd") for k in range(30)], [f"m{k:03d}{e}" for e in ("ab", "cd") for k in range(30)]]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):  # a word of kind 0 stands before one of kind 1, and they bear no kind in their form
            words += [dice.choice([*common[0] * 15, *names[0]]), dice.choice([*common[1] * 15, *names[1]])]
        rows.append((i, " ".join(words), "en", "s", 0))
    texts = spark.createDataFrame(rows, SCHEMA).repartition(3)
    held = remainder("doc_id", 7) == 2
    right, wrong = " ".join(f"{a} {b}" for a, b in zip(*names, strict=True)), " ".join([*names[0], *names[1]])
    both = texts.unionByName(spark.createDataFrame([(9001, right, "en", "s", 0), (9002, wrong, "en", "s", 0)], SCHEMA))
    held = held | (F.col("doc_id") > 9000)
    got = {}
    for head in (200_000, 30):
        monkeypatch.setattr(class_lm, "HEAD", head)
        got[head] = {r["doc_id"]: r["score"] for r in class_lm.score(both, held).collect()}
        assert got[head][9001] > got[head][9002] + 20
    assert all(abs(got[30][k] - v) < 1e-6 for k, v in got[200_000].items())


def test_head_of_words_of_one_count(spark, monkeypatch):
    """More words of the highest count than the head holds: the end is known all the same."""
    monkeypatch.setattr(class_lm, "HEAD", 5)
    texts = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)), "en", "s", 0)], SCHEMA)
    r = class_lm.score(texts, F.lit(False)).first()
    assert (r["n_tokens"], r["n_known"]) == (21, 21) and abs(r["base_score"] - 21 * math.log10(2 / (21 + 21 + 1))) < 1e-9


# near-duplicates


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_golay_keys_meet():
    code = near_dups.Golay.get()
    assert np.bincount(code.index.astype("i8"), minlength=4096).tolist() == [2048] * 4096
    dice = np.random.default_rng(1)
    x = dice.integers(0, 2**63, 300, dtype="u8")
    flips = [sum(1 << int(b) for b in dice.choice(64, dice.integers(0, 4), replace=False)) for _ in x]
    y = x ^ np.array(flips, "u8")
    kx, ox = code.keys(x)
    ky, oy = code.keys(y)
    a, b = set(zip(kx.tolist(), ox.tolist(), strict=True)), defaultdict(set)
    for k, o in zip(ky.tolist(), oy.tolist(), strict=True):
        b[o].add(k)
    mine = defaultdict(set)
    for k, o in a:
        mine[o].add(k)
    assert all(mine[int(p)] & b[int(q)] for p, q in zip(x, y, strict=True))


def brute_components(rows):
    prints = [(i, simhash(t)) for i, t in rows]
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for (i, _), x in zip(prints, label, strict=True):
        least[x] = i if least.get(x) is None else least[x] if i is None else min(i, least[x])
    return sorted(((i, format(p, "016x"), least[x]) for (i, p), x in zip(prints, label, strict=True)), key=repr)


def test_near_duplicates(spark, empty, odd):
    base = prose([f"w{i}" for i in range(90)], 150, 1).split()
    rows = [(i, " ".join([*base[: 20 + i], f"x{i % 7}", *base[21 + i :]])) for i in range(50)] + [(100 + i, prose(EN + DE, 60, i)) for i in range(15)] + [(200, None), (201, ""), (202, " \t"), (203, rows_text := "one two"), (204, rows_text), (204, rows_text), (None, rows_text)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dups.classes(d).select("doc_id", near_dups.as_hex(F.col("fp")).alias("f"), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)
    kept = near_dups.one_of_each(d).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({x[2] for x in brute_components(rows)})
    assert near_dups.classes(empty).count() == 0 and near_dups.one_of_each(empty).count() == 0
    assert near_dups.one_of_each(odd).columns == odd.columns


def test_rows_of_one_id_are_told_apart(spark):
    """Null and repeated doc_ids: each component keeps one row, whatever the ids of others."""
    text = [prose([f"{c}{i}" for i in range(60)], 40, 1) for c in "abcdef"]
    rows = [(1, text[0]), (None, text[0]), (None, text[1]), (None, text[2]), (None, text[2]), (7, text[3]), (7, text[4]), (7, text[0]), (8, text[5]), (8, text[5])]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in near_dups.one_of_each(d).collect()), key=repr)
    assert got == sorted([(1, text[0]), (None, text[1]), (None, text[2]), (7, text[3]), (7, text[4]), (8, text[5])], key=repr)


def test_large_groups_go_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "GROUP_ROWS", 3)
    import pyarrow as pa

    fp = np.array([0, 1, 3, 7, 15, 31, 63, 1 << 40, 1 << 41], "u8")
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), 5)), pa.array(np.sort(fp).view("i8"))], ["key", "fp"])
    out = pa.Table.from_batches([*near_dups._links(iter([batch.slice(0, 4), batch.slice(4)]))]).to_pylist()
    assert sorted(r["b"] for r in out if r["key"] is not None) == sorted(fp.view("i8").tolist()) and {r["block"] for r in out} == {0, 1, 2}


def test_pairs_of_blocks_are_read_one_at_a_time(spark, monkeypatch):
    """Groups over the limit give the same components."""
    dice = np.random.default_rng(5)
    seeds = dice.integers(0, 2**62, 12, dtype="i8")
    prints = sorted({int(s) ^ sum(1 << int(b) for b in dice.choice(20, dice.integers(0, 4), replace=False)) for s in seeds for _ in range(15)})
    d = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)
    whole = {tuple(r) for r in near_dups.components(near_dups.links(d)).collect()}
    monkeypatch.setattr(near_dups, "GROUP_ROWS", 4)
    # workers are forked from a daemon that has the module's own limit, so the limit goes with the function
    real = near_dups._links

    def few(batches):
        near_dups.GROUP_ROWS, usual = 4, near_dups.GROUP_ROWS
        yield from real(batches)
        near_dups.GROUP_ROWS = usual

    monkeypatch.setattr(near_dups, "_links", few)
    assert {tuple(r) for r in near_dups.components(near_dups.links(d)).collect()} == whole
    far = 0x5555555500000000
    rows = [(5, i, j, side, fp) for i, j in ((0, 0), (0, 1), (1, 1)) for side in ((0,) if i == j else (0, 1)) for fp in ((1, 3, 7), (15, far))[i if side == 0 else j]]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "i", "j", "side", "b"])
    cut = [batch.slice(k, 2) for k in range(0, len(rows), 2)]
    found = {(r["a"], r["b"]) for b in near_dups._block_links(iter(cut)) for r in b.to_pylist()}
    assert {x for e in found for x in e} == {1, 3, 7, 15} and far not in {x for e in found for x in e}


def shingle_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_texts(spark, empty, odd):
    """Components of all pairs at a similarity of 0.8 or more, by comparing every pair of sets."""
    dice = random.Random(3)
    rows = []
    for g in range(12):  # copies of a base text with words changed in some places
        base = prose([f"v{i}" for i in range(400)], 120 + 20 * g, g).split()
        for k in range(6):
            words = list(base)
            for at in dice.sample(range(len(words)), dice.choice((0, 1, 1, 2, 3, 12))):
                words[at] = f"new{dice.random()}"
            rows.append((10 * g + k, " ".join(words)))
    rows += [(200 + i, prose([f"v{i}" for i in range(400)], 60, 100 + i)) for i in range(20)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "one two"), (303, "one two"), (304, "one three"), (None, "one two"), (None, rows[0][1]), (None, "alone here"), (305, "w " * 60_000)]
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0:
                label = [label[b] if x == label[a] else x for x in label]
    least = {x: min((i for (i, _), y in zip(rows, label, strict=True) if y == x and i is not None), default=None) for x in label}
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_texts.rooted(d).collect()), key=repr)
    assert got == sorted(((i, least[x]) for (i, _), x in zip(rows, label, strict=True)), key=repr)
    assert 0 < len(set(label)) - 26 and max(label.count(x) for x in label) >= 4
    kept = sorted((r["doc_id"] for r in near_texts.one_of_each(d).collect()), key=repr)
    assert kept == sorted(least.values(), key=repr)
    assert near_texts.one_of_each(empty).count() == 0 and near_texts.one_of_each(odd).columns == odd.columns


@pytest.mark.parametrize("rows_a_block", [3, 1024])
def test_texts_still_apart_are_compared(spark, monkeypatch, rows_a_block):
    """Links between classes of a cluster are as many as unite what is similar, in any number of blocks; those within a
    class are not looked for, and other clusters are not met."""
    monkeypatch.setattr(near_texts, "BLOCK_ROWS", rows_a_block)
    monkeypatch.setattr(near_texts, "COLUMNS", 16)
    dice = np.random.default_rng(4)
    bases = [dice.integers(0, 1 << 60, 50).astype("u8") for _ in range(3)]
    members, sets, group = [], [], {}
    for fp in range(60):
        base = bases[fp % 3].copy()
        base[:2] = dice.integers(0, 1 << 60, 2)
        group[fp] = fp % 3
        sets.append((fp, np.unique(base).tobytes()))
        members.append((fp, fp // 30, (0 if fp % 3 == 0 else fp) + 1000))
    got = near_texts.apart(spark.createDataFrame(members, "fp long, root long, own long"), spark.createDataFrame(sets, "fp long, shingles binary")).collect()
    own = {m[0]: m[2] for m in members}
    assert got and all(group[r["a"]] == group[r["b"]] and r["a"] // 30 == r["b"] // 30 and own[r["a"]] != own[r["b"]] for r in got)
    label = {fp: (fp // 30, o) for fp, o in own.items()}
    for r in got:
        label = {fp: label[r["b"]] if x == label[r["a"]] else x for fp, x in label.items()}
    assert len(set(label.values())) == 2 * 3


def test_unrelated_texts_do_not_meet(spark):
    """Texts that share a key by chance are no candidates; those at a similarity of 0.85 or so are."""
    dice = np.random.default_rng(8)
    sums = dice.normal(size=(4000, 128)) * 30
    sums[2000:2200] = sums[:200] * 0.92 + dice.normal(size=(200, 128)) * 30 * 0.39
    fp, rest = np.packbits(sums > 0, axis=1, bitorder="little").view("<i8").T
    near = near_texts.decode(sums, near_texts.codewords())
    d = spark.createDataFrame([(int(a), int(b), n.tobytes()) for a, b, n in zip(fp, rest, near, strict=True)], "fp long, rest long, near binary").repartition(3)
    found = {frozenset((r["a"], r["b"])) for r in near_dups.links(d, near_texts.expand, near_texts.MOST_BITS).collect()}
    planted = {frozenset((int(fp[i]), int(fp[2000 + i]))) for i in range(200)}
    assert found <= planted and len(found) >= 190


def test_wide_prints_in_blocks(monkeypatch):
    """Fingerprints of 128 bits of a large group keep both halves, in blocks and between them."""
    import pyarrow as pa

    monkeypatch.setattr(near_dups, "GROUP_ROWS", 3)
    fp, rest = np.arange(8), np.where(np.arange(8) % 2, 0, -1)
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(8, 5)), pa.array(fp), pa.array(rest)], ["key", "fp", "rest"])
    out = pa.Table.from_batches([*near_dups._links(iter([batch.slice(0, 4), batch.slice(4)]), 34)]).to_pylist()
    assert sorted((r["b"], r["rest"]) for r in out if r["key"] is not None) == list(zip(fp.tolist(), rest.tolist(), strict=True))
    rows = [(5, 0, 1, int(r["block"] > 0), r["b"], r["rest"]) for r in sorted(out, key=lambda r: r["block"]) if r["block"] < 2]
    pairs = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "i", "j", "side", "b", "rest"])
    made = [(r["a"], r["b"]) for b in near_dups._block_links(iter([pairs.slice(0, 2), pairs.slice(2)]), 34) for r in b.to_pylist()]
    assert made and all((a - b) % 2 == 0 for a, b in made) and {x for e in made for x in e} == {0, 1, 2, 3, 4, 5}


def test_common_shingles_are_counted():
    dice = random.Random(5)
    sets = [np.unique(np.array([dice.randrange(60) for _ in range(dice.randrange(40))], "u8")) for _ in range(30)]
    got = near_texts.common(sets[:12], sets[12:])
    assert (got == [[len(np.intersect1d(x, y)) for y in sets[12:]] for x in sets[:12]]).all()


def test_walks_give_the_same_components():
    dice = np.random.default_rng(2)
    base = dice.integers(0, 2**62, 9, dtype="u8")
    x = np.unique(np.concatenate([b ^ (np.uint64(1) << dice.integers(0, 60, 30, dtype="u8")) for b in base]))

    def parts(links, nodes):
        root = {int(n): int(n) for n in nodes}
        for a, b in links:
            old, new = root[b], root[a]
            root = {k: new if v == old else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    pairs = [(int(a), int(b)) for i, a in enumerate(x) for b in x[:i] if (int(a) ^ int(b)).bit_count() <= 3]
    assert parts(near_dups.walks(x, None, 3), x) == parts(pairs, x) and len(near_dups.walks(x, None, 3)) == len(x) - 9
    left, right = x[::2], x[1::2]
    across = [(a, b) for a, b in pairs if (a in left) != (b in left)]
    assert parts(near_dups.walks(left, right, 3), x) == parts(across, x)


# personal data


@pytest.fixture(scope="module")
def weights():
    texts = [f"reach {prose(EN, 4, i)} jo.{i}@mail{i % 9}.example.com or +1 ({200 + i}) 555-{1000 + i} host 10.{i}.3.4 card {c} end" for i, c in enumerate(["4111111111111111", "5500000000000004", "340000000000009", "6011000000000004"] * 20)]
    return pii.train(texts)


def test_base_patterns():
    forms = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    ok = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 12 <= sum(map(str.isdigit, s)) <= 19 and pii.luhn(re.sub("[ -]", "", s)), lambda s: 9 <= sum(map(str.isdigit, s)) <= 15]
    dice = random.Random(3)
    for alphabet in ("a@.b1-2 é+_", "0123456789 -.+()", "+1 5(0)4.@a"):
        for _ in range(4000):
            t = "".join(dice.choice(alphabet) for _ in range(dice.randint(0, 30)))
            want = sorted((m.start(), k, m.end()) for k, f in enumerate(forms) for m in re.finditer(f, t) if ok[k](m[0]))
            assert pii.base_spans(t) == want, t


def test_field_adds_what_patterns_miss(weights):
    said = lambda t: [(pii.KINDS[k], t[a:b]) for a, k, b in pii.find(t, weights)[1]]
    assert said("two cards 7536784127813050 4845168114407329 here") == [("card", "7536784127813050"), ("card", "4845168114407329")]
    assert said("call (415) 555-1234 now") == [("phone", "(415) 555-1234")]
    assert said('token = "0641917ea4e9feb9cda83477b57ac2654884f485" and 12345 in 2021') == []
    assert pii.mask("a x@y.zz b", pii.base_spans("a x@y.zz b")) == "a [EMAIL] b"


def test_expectation_is_that_of_all_segmentations(weights):
    w = pii.windows("tel 415-555-1234 or 4111.1111 x")[0]
    n, segments = len(w.bounds), w.segments
    total, expected = 0.0, np.zeros((4, pii.FEATURES))

    def walk(at, score, used):
        nonlocal total, expected
        if at == n:
            total += math.exp(score)
            for s, k in used:
                expected[k] += math.exp(score) * segments[s][2]
            return
        walk(at + 1, score, used)
        for s, (i, j, f) in enumerate(segments):
            if i == at:
                for k in range(4):
                    walk(j, score + float(weights[k] @ f), [*used, (s, k)])

    walk(0, 0.0, [])
    z, got = pii.expectation(w, weights)
    assert math.isclose(z, math.log(total), rel_tol=1e-9) and np.allclose(got, expected / total)


def test_decision_is_the_best_segmentation(weights):
    for text in ("tel 415-555-1234 or 4111.1111 x", "(415) 555-1234 20", "ip 10 . 2 . 3 . 4 or 7", "a at b dot org"):
        for lo, hi in pii.stretches(text):
            for t in pii.token_windows(text, lo, hi):
                segments = [(i, j, k, float(weights[k] @ f) - pii.MARGIN) for j in range(1, len(t) + 1) for i, f in t.ending_at(j) for k in range(4)]

                def top(at, segments=segments, n=len(t)):
                    return 0.0 if at == n else max([top(at + 1), *(v + top(j) for i, j, _, v in segments if i == at)])

                value = {(i, k, j): v for i, j, k, v in segments}
                assert math.isclose(sum(value[s] for s in pii.best(t, weights)), top(0), abs_tol=1e-9)


def test_planted_forms_are_found(weights):
    """Recall by kind of forms that the patterns miss."""
    dice = random.Random(12)
    number = lambda n: "".join(dice.choice("0123456789") for _ in range(n))
    forms = {
        "email": [lambda: f"jo{number(2)} at mail{number(1)} dot example dot com", lambda: f"jo{number(2)}@mail[.]example[.]org", lambda: f"al.{number(2)} (at) host.example.net"],
        "ip": [lambda: f"10[.]{dice.randint(0, 255)}[.]{dice.randint(0, 255)}[.]7", lambda: f"192(.)168(.){dice.randint(0, 255)}(.)4"],
        "phone": [lambda: f"({dice.randint(200, 999)}) 555-{number(4)}", lambda: f"{dice.randint(200, 999)}-555-{number(4)}"],
    }
    for kind, made in forms.items():
        hits = 0
        for i in range(60):
            form = made[i % len(made)]()
            text = f"{prose(EN, 6, i)} contact {form} {prose(EN, 6, i + 1)}"
            at = text.index(form)
            hits += any(pii.KINDS[k] == kind and a < at + len(form) and b > at for a, k, b in sum(pii.find(text, weights), []))
        assert hits >= 54, (kind, hits)
    assert sum(bool(pii.find(f"{prose(EN, 8, i)} in {1900 + i} there were {i * 37} of {i + 2}.{i}", weights)[1]) for i in range(100)) == 0


def test_personal_data_table(docs, empty, odd, weights):
    assert pii.detect(docs, weights).count() == docs.count() and pii.detect(empty, weights).count() == 0
    same = pii.redact(odd, weights)
    assert same.columns == odd.columns and same.exceptAll(odd).count() == 0
    assert pii.sample(empty) == []


# repeated spans


def spans_brute(rows):
    n = Counter(b[i : i + 400] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 399))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if n[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\x01" * 400
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket", [suffix.BUCKET, 1])
def test_repeated_spans(spark, bucket):
    dice = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(dice.choice(vocabulary) for _ in range(n))
    passages = [text(150) for _ in range(4)]
    rows = []
    for i in range(25):
        parts = [text(dice.randint(0, 100))]
        for _ in range(dice.randint(0, 2)):
            p = dice.choice(passages)
            at = dice.randint(0, 100)
            q = p[at : at + dice.randint(200, 600)]
            parts += [q[:250] + "X" + q[251:] if dice.random() < 0.3 else q, text(dice.randint(0, 40))]
        rows.append((i, " ".join(parts)))
    rows += [(100, "a" * 1000), (101, "ab" * 450), (102, None), (103, ""), (104, rows[0][1]), (104, rows[0][1]), (106, "é" * 300), (107, "a" * 401), (None, "q" * 399), (108, f"{passages[0]} tail"), (109, f"{text(5)} {passages[1]} {passages[1]} {passages[1]} "), (110, "x" + "0123456789 unit " * 60)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bucket)
    assert sorted(map(tuple, got.collect()), key=repr) == spans_brute(rows)


def test_repeated_spans_give_texts(spark, tmp_path):
    """What is left and what was removed is given, not digests alone; the query's further columns are made of it."""
    shared = "".join(f"{i:04d}" for i in range(150))
    rows = [(1, f"é{shared} end"), (2, f"other {shared}"), (3, "short"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix.kept_texts(docs).collect()}
    for k, t in rows:
        data, at, left = (t or "").encode(), 0, b""
        for a, b in got[k]["spans"]:
            left, at = left + data[at:a], b
        assert bytes(got[k]["kept"]) == left + data[at:]
    assert [[tuple(s) for s in got[k]["spans"]] for k in (1, 2, 3, 4)] == [[(2, 602)], [(6, 606)], [], []]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: (r["text"], r["spans"], r["n_removed"], r["kept_sha256"]) for r in queries.op7_repeated_spans(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out == {1: ("é end", "2:602", 600, sha("é end")), 2: ("other ", "6:606", 600, sha("other ")), 3: ("short", "", 0, sha("short")), 4: ("", "", 0, sha(""))}


def test_repeated_spans_of_nothing(empty, odd):
    assert suffix.remove_repeats(empty).count() == 0 and suffix.remove_repeats(odd).count() == odd.count()


def test_long_texts_in_segments(monkeypatch):
    data = prose([f"v{i}" for i in range(500)], 2000, 2).encode()
    whole = suffix.runs_of(np.frombuffer(data, "u1"))
    assert whole[0][0] == 0 and whole[1][-1] == len(data) - suffix.SPAN and (whole[0][1:] == whole[1][:-1] + 1).all()

    def starts(rows):
        """Anchor and distance from it of every start that the rows cover."""
        out = {}
        for anchors, names, lo, shape in rows:
            for h, a, x in zip(anchors.tolist(), lo.tolist(), shape.tolist(), strict=True):
                length, lead, step, times = suffix.unpack(x)
                out |= {a + t * step + i: (h, lead - i) for t in range(times) for i in range(length + 1)}
        return out

    one = starts(suffix.rows_of(data))
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    parts = suffix.rows_of(data)
    assert len(parts) > 10 and starts(parts) == one and set(one) == set(range(len(data) - suffix.SPAN + 1))


def test_periodic_texts_are_few_rows():
    for unit in ("a", "abc", "0123456789 some longer unit of text, "):
        rows = suffix.rows_of((unit * (40_000 // len(unit))).encode())
        assert sum(len(r[0]) for r in rows) <= len(unit) + 300


# token counts


def test_token_counts(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    own = tokcount.counter("byte_bpe_50k.json")
    dice = random.Random(1)
    texts = ["I'll we're  \n\n x'r 're !!<|endoftext|>a<|endo <|endoftext|>", " a  b   ", "日本 語　ÿ 12 3", "a" * 30, "\x1c\x85\xa0 ²½ x"]
    texts += ["".join(dice.choice("'rels <|endoftx>\néa ") for _ in range(50)) for _ in range(30)]
    for t in texts:
        assert own.prefix_counts(t).tolist() == [count(t[:i]) for i in range(len(t) + 1)]
        assert own.count(t) == count(t)
        cut = own.truncate(t, 5)
        assert count(cut) <= 5 and all(count(t[:i]) > 5 for i in range(len(cut) + 1, len(t) + 1))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokcount.token_counts(docs).collect()}
    assert all(got[r["doc_id"]] == (len((r["text"] or "").encode()), count(r["text"] or ""), False) for r in docs.collect())
    assert tokcount.token_counts(empty).count() == 0
    # the stored tables answer budgets
    rows = docs.select("*", F.lit("u").alias("doc"), F.lit("u").alias("table"), F.lit(-1).alias("n_tokens"))
    tables = tokcount.prefix_tables(rows)
    for r in tables.collect():
        t = r["doc"]["text"] or ""
        assert r["n_tokens"] == count(t) and tokcount.unpack(r["table"]).tolist() == own.prefix_counts(t).tolist()
    budgets = [0, 3, 10, 10_000]
    for r in tokcount.fitting(tables, budgets).collect():
        t = r["doc"]["text"] or ""
        counts = [count(t[:i]) for i in range(len(t) + 1)]
        assert list(r["fits"]) == [max(i for i, c in enumerate(counts) if c <= b) for b in budgets]
    cut = tokcount.truncate(tables, 10)
    assert cut.columns == rows.columns and all(count(r["text"] or "") <= 10 for r in cut.collect())
    assert tokcount.prefix_tables(empty).count() == 0


def test_prefix_counts_of_white_space():
    own = tokcount.counter("byte_bpe_50k.json")
    t = "a" + " \n" * 3000 + "b  " * 50
    counts = own.prefix_counts(t)
    assert len(counts) == len(t) + 1 and all(counts[i] == own.count(t[:i]) for i in (1, 2, 3, 700, 5999, 6001, 6002, 6003, len(t)))


# quality


def test_quality(spark, docs, empty, odd):
    import zstandard

    dice = random.Random(2)
    sound = " ".join("".join(dice.choice("etaoinshrdlu") for _ in range(dice.randint(2, 8))) for _ in range(1500))
    noise = "".join(dice.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(9000))
    texts = [sound, "spam ham eggs and so on " * 100, noise, "few words", None, "", "a\nb\na\n \n \nb", sound[:2000] + "=" * 9000 + sound]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        w = b.split()
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in b.split(b"\n") if x.split()]
        r = got[i]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["n_symbols"], r["word_chars"]) == (len(w), len(covered), len(lines) - len(set(lines)), sum((t or "").count(c) for c in "#*$%&|<>"), sum(len(x.decode()) for x in w))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        if b:
            assert r["ratio"] == len(packer.compress(b)) / len(b)
    assert [got[i]["kept"] for i in range(8)] == [True, False, False, False, False, False, False, False]
    assert quality.judge(empty).count() == 0 and quality.filter_quality(odd).columns == odd.columns
    rows = spark.createDataFrame([(1, sound), (1, noise), (None, sound[:3000]), (None, "few words"), (2, None)], "doc_id long, text string")
    assert sorted(map(len, (r["text"] for r in quality.filter_quality(rows).collect()))) == sorted([len(sound), 3000])


def test_bands_reject_planted_stretches():
    """Repetition and noise in texts of all lengths that pass the base rules' windows; sound prose stays."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    dice = random.Random(8)
    # words with the frequencies and lengths of prose
    words = ["".join(dice.choice("etaoinshrdlucmfwypvbgk") for _ in range(dice.randint(2, 9))) for _ in range(4000)]
    weight = [1 / (r + 3) for r in range(4000)]
    text = lambda n: " ".join(dice.choices(words, weight, k=n // 6 + 20))[:n]
    ok = lambda t: quality.verdict(len(t.encode()), *quality.ratios(t.encode(), packer))
    kept = caught = noisy = 0
    for i in range(200):
        n = int(300 * 1.025**i)
        kept += ok(text(n))
        unit = text(70)
        caught += ok(text(n // 5) + " " + (unit + " ") * (n // len(unit)))
        noisy += ok("".join(dice.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)))
    assert kept >= 198 and caught <= 10 and noisy <= 45, (kept, caught, noisy)


# urls


def url_rows(spark):
    dice = random.Random(4)
    pages, labels = [], []
    for i in range(400):
        host = dice.choice(["a.example.org", "b.example.org", "WWW.x.net", "example.net", "sub.example.com"])
        kind = dice.choice(["news", "bad", "en", "de", "fr"])
        pages.append((i, f"https://{host}/{kind}/{i}{dice.choice(['', '/', '.html', '?q=1', '#t'])}"))
        labels.append((i, 1 if kind == "bad" and host[0] in "ab" else 0))
    odd = [None, "", "no scheme", "http://", "http://H/", "x://net", "x://net/", "x://evilexample.net/en/", "a://b://c/d", "http://example.net/en", "http://example.net/en/x"]
    pages += [(1000 + i, u) for i, u in enumerate(odd)] + [(5, pages[5][1])]
    return spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")


def test_urls(spark, empty):
    import duckdb

    pages, labels = url_rows(spark)
    key = F.expr("try_cast(nullif(regexp_extract(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '([0-9]+)[^0-9]*$', 1), '') as bigint)")
    got = url_tree.judge(pages, labels, key)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", pd.DataFrame([tuple(r) for r in labels.collect()], columns=["doc_id", "toxic"]).astype("Int64"))
    want = con.execute(url_tree.oracle_sql()).fetchall()
    rows = got.collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    by_id = {r["page_id"]: r for r in rows}
    assert [(by_id[1000 + i]["host"], by_id[1000 + i]["path"]) for i in range(9)] == [("", ""), ("", ""), ("", ""), ("", ""), ("h", "/"), ("net", ""), ("net", "/"), ("evilexample.net", "/en/"), ("b:", "//c/d")]
    assert [by_id[1000 + i]["rule"] for i in (5, 6, 7, 9, 10)] == [None, "net/", "net/", "net/", "example.net/en/"]
    assert any(r["verdict"] == "block" and r["rule"] is None for r in rows)
    assert url_tree.judge(pages.limit(0), labels, key).count() == 0
    assert {r["verdict"] for r in url_tree.judge(pages, labels.limit(0), key, rules=()).collect()} == {"allow"}


def test_deep_urls_keep_their_branches(spark):
    import duckdb

    rows = [(i, f"https://h.org/blog/2020/01/02/{'spam' if i % 3 else 'news'}/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, toxic int")
    key = F.expr("try_cast(regexp_extract(url, '([0-9]+)$', 1) as bigint)")
    got = url_tree.judge(pages, labels, key, rules=()).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 3 else "allow") for r in got) and len({r["template"] for r in got}) == 2
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", labels.toPandas())
    want = con.execute(url_tree.oracle_sql(depth=6)).fetchall()
    assert sorted(map(tuple, url_tree.judge(pages, labels, key).collect()), key=repr) == sorted(want, key=repr)


def test_wildcards_stay_in_templates(spark):
    rows = [(i, f"https://h.org/{'shop' if i % 2 else 'blog'}/item{i}.html") for i in range(100)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(100)], "doc_id long, toxic int")
    key = F.expr("try_cast(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) as bigint)")
    got = {(r["template"], r["verdict"]) for r in url_tree.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, key, rules=()).collect()}
    assert got == {("/shop/*a0.a/$/$", "block"), ("/blog/*a0.a/$/$", "allow")}


# very long texts, in every operator


def test_very_long_texts(spark, weights):
    """Texts of megabytes: whole results, beside a short text."""
    dice = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    long = " ".join(dice.choice(words) for _ in range(400_000))
    digits = " ".join(str(dice.randint(0, 9999)) for _ in range(6000))
    d = spark.createDataFrame([(1, long, "en", "s", 0), (2, "a" * 1_500_000, "en", "s", 0), (3, "the short one of ten words that is all here", "en", "s", 0), (4, digits, "en", "s", 0)], SCHEMA).repartition(2)
    size = {r["doc_id"]: len(r["text"]) for r in d.collect()}
    assert size[1] > 2 << 20
    assert {r["doc_id"]: r["n_words"] for r in quality.judge(d).collect()}[1] == 400_000
    assert {r["doc_id"]: r["n_tokens"] for r in class_lm.score(d, F.lit(False)).collect()} == {1: 400_001, 2: 2, 3: 11, 4: 6001}
    assert lang_id.predict(d, lang_id.fit(d)).filter("lang_pred = 'en'").count() == 3
    item = " ".join(long.split()[200_000:200_012])
    hit = {r["doc_id"]: r["n_hit"] for r in decontam.report(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hit == {1: 12, 2: 0, 3: 0, 4: 0}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(d).collect()}
    assert got[2] == (1_500_000, 1_500_000, 1) and got[1] == (size[1], 0, 0) and got[3][1] == 0
    assert near_dups.classes(d).count() == 4 and pii.detect(d, weights).count() == 4
    assert all(r["n_bytes"] == size[r["doc_id"]] for r in tokcount.token_counts(d).collect())
    assert all(r["round_trip"] for r in pieces.encode(d.filter("doc_id <> 2"), ids=False).collect())
