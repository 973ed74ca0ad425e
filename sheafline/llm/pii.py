"""Personal data: base patterns, and a semi-Markov conditional random field for forms they miss.

The patterns find e-mail addresses, IP addresses, card and phone numbers in their plain forms; what they find always
stays. The field then labels whole segments of the text around digits and address signs: a candidate segment is scored as
one unit by features of the whole span (its digit groups, separators, checksum, the words before it), so that boundaries
and types are chosen jointly. Dynamic programming over the tokens of a window takes the best segmentation; a segment has
at most SPAN_TOKENS tokens, and tokens outside any entity score 0.

A segment without a digit or an at-sign (or its spelled forms) cannot be an entity, so the field is run only in windows
of tokens around those; outside them its decision is fixed and the text is only scanned. Base spans split windows: what
the field adds never overlaps them.

The weights are trained by maximum likelihood (forward-backward over segments) on a bounded sample of windows with base
spans. As the base patterns can only teach their own forms, part of the sample is rewritten to others (defanged dots,
spelled at-signs, numbers without a plus sign); the rest of the digits of the sample are the counter-examples.

Null texts are empty. Positions are code points, ends exclusive. Repeated rows are judged alike; a text without digits and
at-signs has no windows. A long text is decided a window at a time, and a window, which grows while digits follow each
other closely, takes some 60 bytes a token: its candidates are scored as they come up and not kept. Extra columns are not
read by `detect` and pass through `redact`, whatever their names. An empty table trains no weights, and the field then adds
nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import chunks, map_arrow

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Documents in the training sample, chosen by hash among those with a base span.
SAMPLE_DOCS = 400
#: Windows that training uses at most.
SAMPLE_WINDOWS = 600
SPAN_TOKENS = 24
WINDOW_TOKENS = 14
EPOCHS = 12
#: What a segment must score above no entity to be added.
MARGIN = 2.0

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]|\s+")
_HINT = re.compile(r"[0-9@]|\bat\b(?=\W{0,3}[A-Za-z0-9-]+\s?[\[({]?\s?(?:\.[a-z]|dot\b))", re.IGNORECASE)
_DIGITS, _LETTER = re.compile(r"[0-9]+"), re.compile(r"[A-Za-z]")
_TRIGGER = re.compile(r"[0-9]+|@|at", re.IGNORECASE)
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\s?[\[({]?\s?(@|at|AT)\s?[\])}]?\s?[A-Za-z0-9-]+((\s?[\[({]\s?(\.|dot|DOT)\s?[\])}]\s?|\s(dot|DOT)\s|\.)[A-Za-z0-9-]+)+")
_DEFANGED = re.compile(r"[0-9]{1,3}(\s?[\[({]?\s?(\.|dot)\s?[\])}]?\s?[0-9]{1,3}){3}")
_CUE = {"email": re.compile(r"(e-?mail|mail|contact|correo|courriel)\W*$", re.I), "ip": re.compile(r"(ip|host|server|address|addr)\W*$", re.I), "card": re.compile(r"(card|visa|credit|karte|carte|tarjeta)\W*$", re.I), "phone": re.compile(r"(phone|tel|call|fax|mobile|telefon|cell|t)\W*$", re.I)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain forms, sorted; leftmost and non-overlapping for each kind."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:  # from the sign outwards, for a search from the left takes quadratic time on long words
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", at + 1)
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub(r"[ -]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


@dataclass
class Window:
    """A stretch of tokens with its candidate segments: (first token, end token, features)."""

    bounds: list[tuple[int, int]]
    segments: list[tuple[int, int, np.ndarray]] = field(default_factory=list)


FEATURES = 34


@lru_cache(maxsize=4096)
def cues(before: str) -> tuple[bool, ...]:
    """By kind, whether the text before a span names it."""
    return tuple(bool(_CUE[kind].search(before)) for kind in KINDS)


def features(text: str, a: int, b: int) -> np.ndarray | None:
    """Features of a span as a whole; None if it cannot be an entity."""
    s = text[a:b]
    if b - a > 120:
        return None
    groups = _DIGITS.findall(s)
    digits = "".join(groups)
    n = len(digits)
    address = ("@" in s or "at" in s or "AT" in s) and bool(_SPELLED.fullmatch(s))
    if not address and not 7 <= n <= 40 and not 4 <= n <= 12:
        return None
    letters = bool(_LETTER.search(s))
    dotted = len(groups) == 4 and bool(_DEFANGED.fullmatch(s))
    if not address and (n < 7 and not dotted or letters and not dotted):
        return None
    before, after = text[max(0, a - 16) : a], text[b : b + 1]
    prior = text[a - 1 : a]
    f = np.zeros(FEATURES)
    f[0] = 1
    f[1] = address
    f[2] = address and bool(re.search(r"(@|\bat\b)", s, re.I))
    f[3] = address and "@" in s
    f[4] = address and bool(re.search(r"[\[({]", s))
    f[5] = address and not bool(re.search(r"\s", s))
    f[6] = dotted
    f[7] = dotted and all(int(g) <= 255 for g in groups)
    f[8] = not address and n in (7, 8)
    f[9] = not address and n in (9, 10, 11)
    f[10] = not address and n in (12, 13)
    f[11] = not address and n in (14, 15, 16)
    f[12] = not address and n in (17, 18, 19)
    f[13] = not address and n > 19
    f[14] = not address and 12 <= n <= 19 and luhn(digits)
    f[15] = not address and 12 <= n <= 19 and not luhn(digits)
    f[16] = s[0] == "+"
    f[17] = s.startswith("00") and len(groups) > 1
    f[18] = "(" in s and ")" in s
    f[19] = ("(" in s) != (")" in s)
    f[20] = not address and len(groups) == 1
    f[21] = not address and len(groups) in (2, 3, 4) and not dotted
    f[22] = not address and len(groups) > 4
    f[23] = not address and len(groups) > 1 and all(len(g) == 4 for g in groups)
    f[24] = not address and [len(g) for g in groups][-2:] == [3, 4]
    f[25] = not address and "/" in s
    f[26] = prior.isalnum() or prior in ("+", "-", "_", "=", '"', "/", ".")
    f[27] = bool(after) and (after.isalnum() or after in ("-", "_", '"', "@", "/"))
    f[28] = not s[-1].isalnum()
    f[29] = any(k in s for k in ("  ", "\n", "\t"))
    f[30:] = cues(before)
    return f


def stretches(text: str, barriers: list[tuple[int, int, int]] = ()) -> Iterator[tuple[int, int]]:
    """Where digits and address signs are, with what lies around them, outside the spans given."""
    if not _HINT.search(text):
        return
    edges = [0]
    for a, _, b in barriers:
        if a > edges[-1]:
            edges += [a, b]
        else:
            edges[-1] = max(edges[-1], b)
    edges.append(len(text))
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        if lo >= hi or not _HINT.search(text, lo, hi):
            continue
        at = lo
        while at < hi:
            m = _HINT.search(text, at, hi)
            if m is None:
                break
            # tokens around the hints that lie close together
            start = max(lo, m.start() - 80)
            end, hint = min(hi, m.end() + 80), m
            while (hint := _HINT.search(text, hint.end(), end)) is not None:
                end = min(hi, hint.end() + 80)
            yield start, end
            at = end


class Tokens:
    """The tokens of a window: where they start and end, and which are triggers and may begin or end an entity."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, trigger: np.ndarray):
        self.text, self.start, self.end = text, start.tolist(), end.tolist()
        self.triggers = np.concatenate([[0], np.cumsum(trigger)]).tolist()
        first = [text[a] for a in self.start]
        self.ends = [c.isalnum() for c in first]
        self.begins = [c.isalnum() or c in "+(" for c in first]

    def __len__(self) -> int:
        return len(self.start)

    def ending_at(self, j: int) -> Iterator[tuple[int, np.ndarray]]:
        """First token and features of every candidate that ends before token j."""
        if not self.ends[j - 1]:
            return
        for i in range(max(0, j - SPAN_TOKENS), j):
            if self.begins[i] and self.triggers[i] < self.triggers[j] and (f := features(self.text, self.start[i], self.end[j - 1])) is not None:
                yield i, f


def token_windows(text: str, lo: int, hi: int) -> Iterator[Tokens]:
    """The tokens within WINDOW_TOKENS of a trigger, in windows."""
    found = np.fromiter((x for m in _TOKEN.finditer(text, lo, hi) for x in (m.start(), m.end(), _TRIGGER.fullmatch(text, m.start(), m.end()) is not None)), "i8").reshape(-1, 3)
    trigger = found[:, 2] > 0
    at = np.nonzero(trigger)[0]
    wanted = np.zeros(len(found) + 1, "i4")
    np.add.at(wanted, np.maximum(at - WINDOW_TOKENS, 0), 1)
    np.add.at(wanted, np.minimum(at + WINDOW_TOKENS + 1, len(found)), -1)
    turns = np.nonzero(np.diff(np.concatenate([[0], (np.cumsum(wanted[:-1]) > 0).astype("i1"), [0]])))[0]
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        yield Tokens(text, found[a:b, 0], found[a:b, 1], trigger[a:b])


def windows(text: str, barriers: list[tuple[int, int, int]] = ()) -> list[Window]:
    """Windows with all their candidates, for training."""
    out = []
    for lo, hi in stretches(text, barriers):
        for t in token_windows(text, lo, hi):
            w = Window([*zip(t.start, t.end, strict=True)], [(i, j, f) for j in range(1, len(t) + 1) for i, f in t.ending_at(j)])
            if w.segments:
                out.append(w)
    return out


def best(t: Tokens, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's entities: (first token, kind, end token)."""
    total, start, kind = np.zeros(len(t) + 1), np.full(len(t) + 1, -1, "i4"), np.zeros(len(t) + 1, "i1")
    for j in range(1, len(t) + 1):
        total[j] = total[j - 1]
        for i, f in t.ending_at(j):
            score = weights @ f - MARGIN
            k = int(score.argmax())
            if (value := total[i] + score[k]) > total[j] + 1e-12:
                total[j], start[j], kind[j] = value, i, k
    out, j = [], len(t)
    while j:
        if start[j] < 0:
            j -= 1
        else:
            out.append((int(start[j]), int(kind[j]), j))
            j = int(start[j])
    return out[::-1]


def expectation(w: Window, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition and expected features by kind, by forward-backward over segments."""
    f = np.stack([f for *_, f in w.segments])
    score = f @ weights.T
    n = len(w.bounds)
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    merged = np.logaddexp.reduce(score, axis=1)
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for s, (i, j, _) in enumerate(w.segments):
        by_end.setdefault(j, []).append(s)
        by_start.setdefault(i, []).append(s)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[w.segments[s][0]] + merged[s] for s in by_end.get(j, ()))])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[w.segments[s][1]] + merged[s] for s in by_start.get(i, ()))])
    first, last = np.array([s[0] for s in w.segments]), np.array([s[1] for s in w.segments])
    p = np.exp(ahead[first][:, None] + score + behind[last][:, None] - ahead[n])
    return float(ahead[n]), p.T @ f


def rewrite(text: str, spans: list[tuple[int, int, int]], dice: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with some of its spans in other forms, and where they are then."""
    out, at, moved = [], 0, []
    size = 0
    for a, k, b in spans:
        if a < at:
            continue
        s = text[a:b]
        if dice.random() < 0.5:
            if k == 0:
                name, host = s.split("@")
                sep, dot = dice.choice([("@", "[.]"), (" at ", " dot "), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" @ ", ".")])
                s = name + sep + host.replace(".", dot)
            elif k == 1:
                s = s.replace(".", dice.choice(["[.]", "(.)", " . ", "[dot]"]))
            elif k == 2:
                digits = re.sub(r"\D", "", s)
                sep = dice.choice([".", "/", "  "]) if len(digits) == 16 else ""
                s = sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if sep else digits
            else:
                digits = re.sub(r"\D", "", s)[-10:]
                x, y, z = digits[:-7], digits[-7:-4], digits[-4:]
                s = dice.choice([f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"00{s[1:]}", f"{x}.{y}.{z}", f"{x} {y} {z}"])
        out += [text[at:a], s]
        size += a - at
        moved.append((size, k, size + len(s)))
        size += len(s)
        at = b
    return "".join([*out, text[at:]]), moved


def train(texts: list[str], epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Weights by kind and feature, by stochastic gradient of the penalized likelihood."""
    dice = random.Random(seed)
    examples = []
    for text in texts:
        for _ in range(2):
            if len(examples) >= SAMPLE_WINDOWS:
                break
            own, spans = rewrite(text, base_spans(text), dice)
            for w in windows(own):
                ends = {b: i + 1 for i, (_, b) in enumerate(w.bounds)}
                starts = {a: i for i, (a, _) in enumerate(w.bounds)}
                gold = {(starts[a], ends[b]): k for a, k, b in spans if a in starts and b in ends}
                inside = [(a, b) for a, _, b in spans if a < w.bounds[-1][1] and b > w.bounds[0][0]]
                if len(inside) != len(gold):
                    continue
                seen = np.zeros((len(KINDS), FEATURES))
                hit = 0
                for i, j, f in w.segments:
                    if (k := gold.get((i, j))) is not None:
                        seen[k] += f
                        hit += 1
                if hit == len(gold):
                    examples.append((w, seen))
    weights = np.zeros((len(KINDS), FEATURES))
    weights[:, 0] = -3.0
    for epoch in range(epochs):
        dice.shuffle(examples)
        rate = 0.3 / (1 + epoch)
        for w, seen in examples:
            weights += rate * (seen - expectation(w, weights)[1] - 1e-4 * weights)
    return weights


def sample(docs: DataFrame, rows: int = SAMPLE_DOCS) -> list[str]:
    """Texts for training: about `rows` documents with a digit group or at-sign, by hash, each cut to what surrounds it."""
    likely = docs.filter(F.col("text").rlike(r"@|[0-9]{7}|\+[0-9]|[0-9]\.[0-9]+\.[0-9]")).select("text")
    n = likely.count()
    if not n:
        return []
    share = int(min(1.0, rows / n) * (1 << 30))
    picked = likely.filter(F.pmod(F.xxhash64("text", F.lit("pii sample")), F.lit(1 << 30)) < share)
    near = r"(?s).{0,120}(?:@|[0-9]{7}|\+[0-9]|[0-9]\.[0-9]+\.[0-9]).{0,120}"
    pieces = picked.select(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(near), F.lit(0)))).alias("p")).distinct().select(F.explode(F.slice("p", 1, 4)).alias("p"))
    return [r["p"] for r in pieces.orderBy(F.xxhash64("p"), "p").limit(2 * rows).collect()]


def find(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that the field adds."""
    base = base_spans(text)
    added = []
    for lo, hi in stretches(text, base):
        for t in token_windows(text, lo, hi):
            added += [(t.start[i], k, t.end[j - 1]) for i, k, j in best(t, weights)]
    return base, added


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap are one, of the kind of the first."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, the base counts, base_sha256 and spans of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    base, added = find(text or "", shared.value)
                    rows.append((*(sum(s[1] == k for s in base) for k in range(len(KINDS))), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + added)))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4]), pa.array(c[5])], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with every span of personal data in text replaced by its kind. Other rows are unchanged, null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = docs.columns

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                texts = []
                for text in part.column("text").to_pylist():
                    spans = sum(find(text, shared.value), []) if text else []
                    texts.append(mask(text, spans) if spans else text)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names], names)

    return map_arrow(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
