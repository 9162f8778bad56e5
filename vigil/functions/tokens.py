"""Tokenisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import SPACE, WORD, has_non_ascii


def whitespace_tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda t: t != "")


def word_tokens(c: Column) -> Column:
    """Maximal runs of at least two word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD + "{2,}"), 0)


def _ranges(codes: list[int], gap: int = 1) -> str:
    """Character class of the code points; neighbours up to ``gap`` apart share a range."""
    spans: list[list[int]] = []
    for code in codes:
        if spans and code - spans[-1][1] <= gap:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, list[int], dict[str, str]]:
    """(accented, base, marks, expansions) derived from the Unicode database.

    A character whose compatibility decomposition without combining marks is one
    character goes to the ``translate`` table; a longer one (ligatures, fractions)
    to the expansions. Hangul syllables decompose by arithmetic (:func:`_jamo`). No
    character above the last plane looked at decomposes.
    """
    source, target, marks, expansions = [], [], [], {}
    for code in range(0x80, 0x30000):
        ch = chr(code)
        if unicodedata.combining(ch):
            marks.append(code)
            continue
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        plain = unicodedata.normalize("NFKD", ch)
        bare = "".join(p for p in plain if not unicodedata.combining(p))
        if not bare:
            marks.append(code)
        if bare == ch or not bare:
            continue
        if len(bare) == 1:
            source.append(ch)
            target.append(bare)
        else:
            expansions[ch] = bare
    return "".join(source), "".join(target), marks, expansions


#: The first syllable, and the first lead, vowel and (one before the first) tail letter
#: with their numbers: fixed values of Unicode's Hangul composition.
HANGUL, LEADS, VOWELS, TAILS = 0xAC00, (0x1100, 19), (0x1161, 21), (0x11A7, 28)


def _jamo(syllable: Column) -> Column:
    """The letters of one composed Hangul syllable."""

    def letter(first: tuple[int, int], at: Column) -> Column:
        letters = F.split(F.lit(",".join(chr(first[0] + i) for i in range(first[1]))), ",")
        return F.get(letters, at.cast("int"))

    n = F.ascii(syllable) - HANGUL
    tail = F.when(n % TAILS[1] > 0, letter(TAILS, n % TAILS[1])).otherwise("")
    block = TAILS[1] * VOWELS[1]
    return F.concat(letter(LEADS, F.floor(n / block)), letter(VOWELS, F.floor(n % block / TAILS[1])), tail)


def strip_accents(c: Column) -> Column:
    """Compatibility-decompose and drop combining marks; ASCII rows pass untouched.

    The exact classes have hundreds of ranges, so coarse classes with few ranges
    decide first whether a row needs them.
    """
    source, target, marks, expansions = _accent_tables()
    codes = sorted(ord(k) for k in expansions)
    # One folded constant instead of hundreds of literals.
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in expansions.items())), F.lit("\x01"), F.lit("\x02"))
    expanded = F.array_join(
        F.transform(F.split(c, ""), lambda p: F.when(p.rlike(_ranges(codes)), table[p]).otherwise(p)), ""
    )
    # Western European text is settled by the first, very small class.
    low = [k for k in codes if k < 0x250]
    few = _ranges(low, gap=48)[:-1] + "\\x{250}-\\x{10ffff}]"
    wide = F.when(c.rlike(few) & c.rlike(_ranges(codes, gap=48)), expanded).otherwise(c)
    hangul = f"[\\x{{{HANGUL:x}}}-\\x{{d7a3}}]"
    spelt = F.array_join(F.transform(F.split(wide, ""), lambda p: F.when(p.rlike(hangul), _jamo(p)).otherwise(p)), "")
    wide = F.when(c.rlike(hangul), spelt).otherwise(wide)
    based = F.translate(wide, source, target)
    # Not \p{M}: the JVM may know fewer marks.
    # A class of few ranges, which leaves out Latin letters and quotes, goes first.
    marked = c.rlike(_ranges(marks, gap=512)) & c.rlike(_ranges(marks, gap=48))
    bare = F.when(marked, F.regexp_replace(based, _ranges(marks), "")).otherwise(based)
    return F.when(has_non_ascii(c), bare).otherwise(c)


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams with ``low <= n <= high``, space-joined, shorter ones first.

    ``tokens`` should be a plain column, not an expression: it is read once per
    n-gram. Element access is constant time, so the cost is linear in the text.
    """

    def of_size(n: int) -> Column:
        if n == 1:
            return tokens
        heads = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
        return F.transform(heads, lambda t, i: F.concat_ws(" ", t, *[F.get(tokens, i + k) for k in range(1, n)]))

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


def with_term_counts(df: DataFrame, grams: str, out: str = "terms") -> DataFrame:
    """Add ``out``: array of (term, tf) of the array column ``grams``, without a shuffle.

    A text never leaves its row: the array is sorted and run-length encoded, so
    counting terms inside a text costs no exchange of the exploded tokens.
    """
    tokens, starts = f"_{out}_sorted", f"_{out}_starts"
    s, b = F.col(tokens), F.col(starts)
    first = lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i).otherwise(F.lit(-1))
    return (
        df.withColumn(tokens, F.sort_array(F.col(grams)))
        .withColumn(starts, F.filter(F.transform(s, first), lambda i: i >= 0))
        .withColumn(
            out,
            F.transform(
                b,
                lambda p, j: F.struct(
                    F.get(s, p).alias("term"),
                    (F.coalesce(F.get(b, j + 1), F.size(s)) - p).cast("long").alias("tf"),
                ),
            ),
        )
        .drop(tokens, starts)
    )


