"""Evasion spelling: leet, repeated consonants, masked vowels, spread-out words.

Everything happens inside the row. Each alphabetic token gets a digest of (row key,
token position) and one for each eight characters; every draw is a window of its own
of their hex digits, compared as a string with a fixed-width bound, which needs no
number conversion.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.hashing import hex_below
from vigil.functions.numeric import let
from vigil.functions.text import NONSPACE, SPACE

# Substitution table, letter classes, masks and rates.
LEET_FROM = "aeioslt"
LEET_TO = "@3!0$17"
VOWELS = "aeiou"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
# In both cases, so that no character is lower-cased by itself; the Kelvin sign's is k.
ANY_VOWEL = VOWELS + VOWELS.upper()
ANY_CONSONANT = CONSONANTS + CONSONANTS.upper() + "\u212a"
MASKS = "*.!"
RATES = {"leet": 0.30, "repeat": 0.05, "punct": 0.10, "space": 0.05}
RULES = ("leet", "repeat", "punct", "space")
# The token's digest has one draw for each of these; every character has two of its own
# in the digest of its block of eight characters. No window is used twice.
PUNCT_AT, SLOT_AT, MASK_AT, SPACE_AT = 1, 5, 9, 13
BLOCK, LEET_AT, REPEAT_AT = 8, 1, 33


def _draw(blocks: Column, start: int, position: Column) -> Column:
    return F.substring(F.get(blocks, F.floor(position / BLOCK).cast("int")), (position % BLOCK) * 4 + start, F.lit(4))


def _number(d: Column, start: int) -> Column:
    return F.conv(F.substring(d, start, 4), 16, 10).cast("int")


def obfuscate_token(token: Column, key: Column, position: Column, rules: tuple[str, ...] = RULES) -> Column:
    """The rules in their order: leet, repetition, masked vowel, spreading."""
    name = F.concat(key, F.lit(":"), position.cast("string"))
    digest = F.sha2(name, 256)
    numbers = F.sequence(F.lit(0), F.floor((F.length(token) - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda k: F.sha2(F.concat(name, F.lit(":"), k.cast("string")), 256))

    def char(c: Column, i: Column, d: Column) -> Column:
        """Leet, or else repetition: no letter that leet puts in is a consonant."""
        out = c
        if "repeat" in rules:
            hit = F.lit(ANY_CONSONANT).contains(c) & (_draw(d, REPEAT_AT, i) < hex_below(RATES["repeat"]))
            out = F.when(hit, F.concat(c, c)).otherwise(out)
        if "leet" in rules:
            hit = F.lit(LEET_FROM).contains(c) & (_draw(d, LEET_AT, i) < hex_below(RATES["leet"]))
            out = F.when(hit, F.translate(c, LEET_FROM, LEET_TO)).otherwise(out)
        return out

    def masked(chars: Column, d: Column) -> Column:
        """Replace one vowel that leet left over, chosen by the token digest."""
        if "punct" not in rules:
            return chars
        slots = F.filter(
            F.transform(chars, lambda c, i: F.when(F.lit(ANY_VOWEL).contains(c), i).otherwise(F.lit(-1))),
            lambda i: i >= 0,
        )

        def mask(at: Column) -> Column:
            slot = F.get(at, _number(d, SLOT_AT) % F.size(at))
            sign = F.substring(F.lit(MASKS), _number(d, MASK_AT) % len(MASKS) + 1, F.lit(1))
            return F.transform(chars, lambda c, i: F.when(i == slot, sign).otherwise(c))

        chosen = F.substring(d, PUNCT_AT, 4) < hex_below(RATES["punct"])
        return F.when(
            chosen, let(slots, lambda at: F.when(F.size(at) > 0, mask(at)).otherwise(chars))
        ).otherwise(chars)

    def spread(s: Column, d: Column) -> Column:
        if "space" not in rules:
            return s
        chosen = (F.length(s) > 3) & (F.substring(d, SPACE_AT, 4) < hex_below(RATES["space"]))
        return F.when(chosen, F.array_join(F.split(s, ""), " ")).otherwise(s)

    # Digests are the dear part: only those that a rule draws from are made.
    letters = F.split(token, "")
    if "leet" in rules or "repeat" in rules:
        letters = let(blocks, lambda bs: F.transform(F.split(token, ""), lambda c, i: char(c, i, bs)))
    if "punct" not in rules and "space" not in rules:
        return F.array_join(letters, "")

    def build(d: Column) -> Column:
        joined = let(letters, lambda cs: F.array_join(masked(cs, d), ""))
        return let(joined, lambda s: spread(s, d))

    return let(digest, build)


def obfuscate_text(c: Column, key: Column, rules: tuple[str, ...] = RULES) -> Column:
    """Obfuscate the purely alphabetic tokens; white-space runs and the rest stay as they are."""
    parts = F.regexp_extract_all(c, F.lit(f"{SPACE}+|{NONSPACE}+"), 0)
    text_key = key.cast("string")
    return F.array_join(
        F.transform(
            parts,
            lambda p, i: F.when(p.rlike(r"^\p{L}+$"), obfuscate_token(p, text_key, i, rules)).otherwise(p),
        ),
        "",
    )
