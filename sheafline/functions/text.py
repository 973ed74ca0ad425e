"""Text normalization as column expressions, evaluated in the JVM.

Spark has no Unicode normalization; `compose` has its canonical forms.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import compose

# Letters with a stroke, which have no decomposition, and the marks of Vietnamese letters (tones, circumflex,
# horn, breve).
_STROKES = {"đ": "d", "Đ": "D"}
_MARKS = {chr(c) for c in (0x31B, 0x323, 0x300, 0x301, 0x303, 0x309, 0x302, 0x306)}


@lru_cache(maxsize=1)
def _precomposed() -> dict[str, str]:
    """Letters that decompose to one letter and marks, with their decomposition."""
    out = {}
    for c in map(chr, range(0xC0, 0x2000)):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and unicodedata.category(d[0])[0] == "L" and all(unicodedata.category(m) == "Mn" for m in d[1:]):
            out[c] = d
    return out


_COLUMNS: dict = {}


def built_once(key: tuple, build: Callable):
    """What `build` makes of columns, made once for each key while the Spark context lives: large expressions take the
    driver seconds to build."""
    key = (id(SparkContext._active_spark_context), *key)
    if key not in _COLUMNS:
        _COLUMNS[key] = build()
    return _COLUMNS[key]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it occurs there (higher-order functions are not subject to
    the elimination of common subexpressions)."""
    return F.get(F.transform(F.array(value), use), 0)


def each_of(array: str | Column) -> Column:
    """explode for arrays that are expensive to make. Below an explode Spark filters by the array's size, for which it makes
    the array a second time; not so below explode_outer, whose null rows are to be filtered out behind it."""
    return F.explode_outer(array)


def kept(*texts: Column) -> Column:
    """The texts that are not null (none is empty), without a function over the array."""
    return F.array_remove(F.array(*(F.coalesce(t, F.lit("")) for t in texts)), "").cast("array<string>")


def unless_ascii(s: Column, use: Callable[[Column], Column]) -> Column:
    """use(s), for forms that leave ASCII as it is: such text is told by its length in bytes and not looked at."""
    return F.when(F.octet_length(s) == F.char_length(s), s).otherwise(use(s))


@lru_cache(maxsize=1)
def _vietnamese() -> tuple[str, str]:
    """Vietnamese letters, and their ASCII letters."""
    own = {c: d[0] for c, d in _precomposed().items() if d[0].isascii() and set(d[1:]) <= _MARKS} | _STROKES
    return "".join(own), "".join(own.values())


def _to_ascii(s: Column, use: Callable[[Column], Column]) -> Column:
    """use(s), for forms that turn Vietnamese letters to ASCII ones: text with no others is told by a translate of these
    few, which takes less time than one of all that Unicode has."""
    return unless_ascii(s, lambda x: let(F.translate(x, *_vietnamese()), lambda y: unless_ascii(y, lambda _: use(x))))


def strip_accents(s: Column) -> Column:
    """Canonical decomposition without nonspacing marks; đ becomes d."""
    return _to_ascii(s, lambda x: compose.bare(x, _STROKES))


def for_ascii(s: Column) -> Column:
    """The same for comparison with ASCII text, by one translate."""
    return _to_ascii(s, lambda x: compose.plain(x, _STROKES))


def nfc(s: Column) -> Column:
    """The composed form, of any script."""
    return let(s, lambda x: unless_ascii(x, compose.nfc))


def collapsed(s: Column) -> Column:
    """Composed text with single spaces."""
    # single spaces, which most are, stay without being replaced
    return F.trim(F.regexp_replace(s, r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def clean_text(s: Column) -> Column:
    return collapsed(nfc(s))


def normalize_name(s: Column) -> Column:
    return F.upper(clean_text(s))


def has_diacritics(s: Column) -> Column:
    return strip_accents(s) != s


def names_match(a: Column, b: Column) -> Column:
    """Equal as normalized, or equal without accents where one side has none. Symmetric but not transitive."""
    def same(p: Column) -> Column:
        bare = F.struct(strip_accents(p["a"]).alias("a"), strip_accents(p["b"]).alias("b"))
        return (p["a"] == p["b"]) | let(bare, lambda q: without_accents(p["a"], q["a"], p["b"], q["b"]))

    return let(F.struct(normalize_name(a).alias("a"), normalize_name(b).alias("b")), same)


def without_accents(a: Column, bare_a: Column, b: Column, bare_b: Column) -> Column:
    """Whether normalized names are equal without accents, one of them having none."""
    return ((bare_a == a) | (bare_b == b)) & (bare_a == bare_b)


def same_names(a: Column, bare_a: Column, b: Column, bare_b: Column) -> Column:
    """The same of names already normalized, with their forms without accents."""
    return (a == b) | without_accents(a, bare_a, b, bare_b)


def digits_only(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def fold(s: Column) -> Column:
    """Case folding (the sharp s becomes ss)."""
    return F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))


@lru_cache(maxsize=1)
def _own_runs() -> str:
    """Runs of characters that are not foreign. A class is a chain of tests, the first of which lies deepest: ASCII stands
    before a class of its own for all others, so that most characters take two tests and not one for each range."""
    own = "".join(c for c, d in _precomposed().items() if d[0].isascii() and set(d[1:]) <= _MARKS)
    return rf"[\x00-\x7F[\p{{P}}\p{{Z}}\p{{S}}{compose._ranges(own + 'đĐ')}]]+"


def all_settled(s: Column) -> Column:
    """Whether text is composed for certain, as all parts of it then are."""
    return s.rlike(compose._classes()[2])


def all_own(s: Column) -> Column:
    """Whether `foreign_chars` of composed text are none."""
    return s.rlike(rf"\A(?:{_own_runs()}+)?\z")


def foreign_chars(s: Column, composed: bool = False) -> Column:
    """The characters that are neither ASCII, punctuation, space, symbol nor a Vietnamese letter."""
    return F.regexp_replace(s if composed else nfc(s), _own_runs(), "")
