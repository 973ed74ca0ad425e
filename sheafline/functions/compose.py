"""Unicode canonical forms (NFD, NFC) of any script as column expressions, evaluated in the JVM.

Spark has no Unicode normalization. Python's unicodedata gives the tables, and expressions do the work: characters are
decomposed by `translate` (a hash lookup), each starter's marks are sorted by combining class, and starters are composed
with what follows in one fold over the characters. Hangul is arithmetic on code points. Only clusters that may change are
touched, that is a character with marks (or others that may compose with it) behind it, and characters that never stay as
they are; all other text is copied, and a row that has none is not even cut into clusters.

A cluster takes time that grows with the square of its length, which is the number of marks on one letter.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where Hangul syllables and their parts begin, and how many parts of each kind there are.
_SYLLABLES, _LEAD, _VOWEL, _TAIL = 0xAC00, 0x1100, 0x1161, 0x11A7
_LEADS, _VOWELS, _TAILS = 19, 21, 28


@lru_cache(maxsize=1)
def _characters() -> tuple[dict[str, str], dict[str, int], dict[str, dict[str, str]]]:
    """Full decompositions (without Hangul), combining classes that are not 0, and compositions: second -> first -> whole."""
    whole, rank, pairs = {}, {}, defaultdict(dict)
    for c in map(chr, range(0xC0, sys.maxunicode + 1)):
        if cls := unicodedata.combining(c):
            rank[c] = cls
        if _SYLLABLES <= ord(c) < _SYLLABLES + _LEADS * _VOWELS * _TAILS:
            continue
        if (full := unicodedata.normalize("NFD", c)) != c:
            whole[c] = full
            near = [chr(int(x, 16)) for x in unicodedata.decomposition(c).split()]
            if len(near) == 2 and unicodedata.normalize("NFC", c) == c:
                pairs[near[1]][near[0]] = c
    return whole, rank, dict(pairs)


def _ranges(chars, gap: int = 1) -> str:
    """A character class (without brackets) of many characters; ranges up to `gap` apart are one."""
    out, codes = [], sorted(map(ord, chars))
    start = before = None
    for code in [*codes, None]:
        if before is not None and (code is None or code > before + gap):
            out.append(rf"\x{{{start:X}}}" if start == before else rf"\x{{{start:X}}}-\x{{{before:X}}}")
            start = None
        start, before = code if start is None else start, code
    return "".join(out)


#: The characters below this one stay as they are and join nothing; classes test it first, their ranges being many. Where
#: text is cut, some more characters may count as changing, which makes classes short: what is cut out is composed as well.
_FIRST, _COARSE = 0x300, 12


def _within(chars, gap: int = _COARSE) -> str:
    return rf"[\x{{{_FIRST:X}}}-\x{{10FFFF}}&&[{_ranges(chars, gap)}]]"


def _without(chars, gap: int = _COARSE) -> str:
    return rf"[\x00-\x{{{_FIRST - 1:X}}}[^{_ranges(chars, gap)}]]"


@lru_cache(maxsize=1)
def _classes() -> tuple[set[str], set[str], str]:
    """What may join the character before it, what changes by itself, and what texts look like that have neither for certain."""
    whole, rank, pairs = _characters()
    jamo = [*map(chr, range(_VOWEL, _VOWEL + _VOWELS)), *map(chr, range(_TAIL + 1, _TAIL + _TAILS))]
    joins = {*rank, *pairs, *jamo, *(c for c, d in whole.items() if unicodedata.combining(d[0]))}
    alone = {c for c in whole if unicodedata.normalize("NFC", c) != c} - joins
    # Latin, punctuation, unified ideographs and Hangul syllables have neither. One run over the text is told some ten times
    # faster than whether a character outside the class is found, and the first range takes few tests, the others being a class
    return joins, alone, r"\A[\x00-\x{2FF}[\x{1E00}-\x{1EFF}\x{2002}-\x{206F}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]]*+\z"


def _char(code: Column) -> Column:
    """The character of a code point of four hexadecimal digits."""
    return F.decode(F.unhex(F.hex(code)), "UTF-16BE")


def _letters(s: Column) -> Column:
    return F.split(s, "")


def _mapped(s: Column, table: dict[str, str]) -> Column:
    """Each character of s that the table has replaced by what it has there, up to one character for each pass."""
    longest = sorted(table, key=lambda c: -len(table[c]))
    keys = "".join(longest)
    parts = [F.translate(s, keys, "".join(table[c][k] for c in longest if len(table[c]) > k)) for k in range(max(map(len, table.values())))]
    return F.when(parts[0] == s, s).otherwise(F.concat(*parts))


def _syllable_parts(c: Column) -> Column:
    """A Hangul syllable as its two or three parts."""
    at = F.ascii(c) - _SYLLABLES
    tail = at % _TAILS
    parts = F.concat(_char(F.lit(_LEAD) + F.floor(at / (_VOWELS * _TAILS))), _char(F.lit(_VOWEL) + F.floor(at % (_VOWELS * _TAILS) / _TAILS)))
    return F.when(tail == 0, parts).otherwise(F.concat(parts, _char(F.lit(_TAIL) + tail)))


def _decomposed(c: Column) -> Column:
    """One character in parts, marks in the order of the tables."""
    hangul = (c >= chr(_SYLLABLES)) & (c < chr(_SYLLABLES + _LEADS * _VOWELS * _TAILS))
    return F.when(hangul, _syllable_parts(c)).otherwise(_mapped(c, _characters()[0]))


def _rank(c: Column) -> Column:
    """The combining class of a character (0 for starters): marks are translated to characters that are class numbers."""
    rank = _characters()[1]
    number = F.translate(c, "".join(rank), "".join(chr(0x100 + r) for r in rank.values()))
    return F.when(number == c, 0).otherwise(F.ascii(number) - 0x100)


def _ordered(s: Column) -> Column:
    """Decomposed text as an array of (rank, character), marks sorted by class behind each starter, those of one class as
    they come."""
    groups = F.regexp_extract_all(s, F.lit(rf"(?s)(.{_within(_characters()[1], 1)}*)"), F.lit(1))
    marked = lambda g: F.array_sort(F.transform(_letters(g), lambda c, i: F.struct(_rank(c).alias("rank"), i.alias("i"), c.alias("c"))))
    return F.flatten(F.transform(groups, marked))


@lru_cache(maxsize=1)
def _pairs() -> str:
    """Compositions as text, for str_to_map, which is folded into one literal."""
    return "\n".join(f"{first}{second}\t{whole}" for second, table in _characters()[2].items() for first, whole in table.items())


def _joined(first: Column, second: Column) -> Column:
    """What two characters compose to, or null."""
    hangul = second.between(chr(_VOWEL), chr(_TAIL + _TAILS - 1))
    lead, vowel, tail, at = F.ascii(first) - _LEAD, F.ascii(second) - _VOWEL, F.ascii(second) - _TAIL, F.ascii(first) - _SYLLABLES
    code = F.when(lead.between(0, _LEADS - 1) & (vowel < _VOWELS), _SYLLABLES + (lead * _VOWELS + vowel) * _TAILS)
    code = code.when(at.between(0, _LEADS * _VOWELS * _TAILS - 1) & (at % _TAILS == 0) & (tail > 0), F.ascii(first) + tail)
    return F.when(hangul, _char(code)).otherwise(F.try_element_at(F.str_to_map(F.lit(_pairs()), F.lit("\n"), F.lit("\t")), F.concat(first, second)))


def _composed(chars: Column) -> Column:
    """An array of (rank, character) composed: each character joins the last starter, unless one of its class or a higher
    one stands between them."""
    text = F.lit("")
    start = F.struct(text.alias("done"), text.alias("starter"), text.alias("marks"), F.lit(0).alias("rank"))

    def step(state: Column, x: Column) -> Column:
        free = (state["starter"] != "") & ((state["marks"] == "") | ((state["rank"] < x["rank"]) & (state["rank"] > 0)))
        both = F.when(free, _joined(state["starter"], x["c"]))
        opened = F.struct(F.concat(state["done"], state["starter"], state["marks"]).alias("done"), x["c"].alias("starter"), text.alias("marks"), F.lit(0).alias("rank"))
        kept = F.struct(state["done"], state["starter"], F.concat(state["marks"], x["c"]).alias("marks"), x["rank"].alias("rank"))

        def chosen(made: Column) -> Column:
            grown = F.struct(state["done"], made.alias("starter"), state["marks"], state["rank"])
            return F.when(made.isNotNull(), grown).when(x["rank"] == 0, opened).otherwise(kept)

        return F.get(F.transform(F.array(both), chosen), 0)

    return F.aggregate(chars, start, step, lambda s: F.concat(s["done"], s["starter"], s["marks"]))


def nfd(s: Column) -> Column:
    """The decomposed form, marks in canonical order."""
    whole, rank, _ = _characters()
    some = s.rlike(rf"[{_ranges(whole)}{_ranges(rank)}\x{{AC00}}-\x{{D7A3}}]")
    apart = F.array_join(F.transform(_letters(s), _decomposed), "")
    return F.when(some, F.array_join(F.transform(_ordered(apart), lambda x: x["c"]), "")).otherwise(s)


def nfc(s: Column) -> Column:
    """The composed form."""
    joins, alone, settled = _classes()
    both, cluster = _within(joins | alone), rf"{_without(joins)}{_within(joins)}"
    pieces = F.regexp_extract_all(s, F.lit(rf"(?s)({cluster}+|{_within(joins)}+|{_within(alone)}|{_without(joins | alone)}+(?={cluster}|{_within(alone)}|$)|.)"), F.lit(1))
    composed = lambda p: _composed(_ordered(F.array_join(F.transform(_letters(p), _decomposed), "")))
    changed = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(both), composed(p)).otherwise(p)), "")
    return F.when(~s.rlike(settled) & s.rlike(both), changed).otherwise(s)


@lru_cache(maxsize=1)
def _bare_tables() -> tuple[dict[str, str], dict[str, str], str]:
    """What characters leave without nonspacing marks: one character, or more; and the marks."""
    spacing = lambda d: "".join(c for c in d if unicodedata.category(c) != "Mn")
    tables = {c: spacing(d) for c, d in _characters()[0].items()}
    marks = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Mn")
    return {c: d for c, d in tables.items() if len(d) == 1}, {c: d for c, d in tables.items() if len(d) > 1}, marks


def plain(s: Column, more: dict[str, str] | None = None) -> Column:
    """Like `bare`, for looking for ASCII: characters that come apart to several spacing ones (Hangul, some Indic vowels)
    stay as they are. more: what else is replaced, character by character."""
    one, _, marks = _bare_tables()
    one = one | (more or {})
    return F.translate(s, "".join(one) + marks, "".join(one.values()))


def bare(s: Column, also: dict[str, str] | None = None) -> Column:
    """The decomposed form without nonspacing marks (those of the tables, which may know more than the JVM)."""
    _, more, _ = _bare_tables()
    rare, quick = rf"{_ranges(more)}\x{{AC00}}-\x{{D7A3}}", rf"[\x{{{ord(min(more)):X}}}-\x{{10FFFF}}]"

    def whole(simple: Column) -> Column:
        pieces = F.regexp_extract_all(simple, F.lit(rf"(?s)([{rare}]|[^{rare}]+)"), F.lit(1))
        apart = F.transform(pieces, lambda p: F.when(F.length(p) > 1, p).when(p >= chr(_SYLLABLES), _decomposed(p)).otherwise(_mapped(p, more)))
        return F.when(simple.rlike(quick) & simple.rlike(f"[{rare}]"), F.array_join(apart, "")).otherwise(simple)

    return F.get(F.transform(F.array(plain(s, also)), whole), 0)
