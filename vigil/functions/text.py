"""Comment normalisation as one fused column expression.

Regular-expression classes are spelled out because ``\\w``, ``\\s`` and ``\\d``
mean ASCII in the JVM, while the wanted semantics are Unicode.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.numeric import let

# Character classes and patterns.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NONSPACE = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
RT = rf"(?i)^RT{SPACE}+"
ENTITY = r"&[a-z]+;|&#\p{Nd}+;"
URL = rf"https?://{NONSPACE}+|www\.{NONSPACE}+"
MENTION = rf"@{WORD}+"
HASHTAG = rf"#({WORD}+)"

# Emoji whose usual name is not their Unicode name, and sequences; the
# blocks of pictographs; the emoji among the other signs; the names of the skin tones.
EMOJI_NAMES = {
    "\U0001f602": "face_with_tears_of_joy",
    "\U0001f60d": "smiling_face_with_heart-eyes",
    "\U0001f644": "face_with_rolling_eyes",
    "\U0001f64f": "folded_hands",
    "\U0001f44d": "thumbs_up",
    "\U0001f44e": "thumbs_down",
    "\U0001f44f": "clapping_hands",
    "\u2764\ufe0f": "red_heart",
    "\u2764": "red_heart",
    "\u2600": "sun",
    "\u2639": "frowning_face",
    "\u263a": "smiling_face",
    "\u2665": "heart_suit",
    "\u26a1": "high_voltage",
    "\u2705": "check_mark_button",
    "\u2714": "check_mark",
    "\u2753": "red_question_mark",
    "\u2757": "red_exclamation_mark",
    "\u2b50": "star",
}
PICTOGRAPHS = ((0x1F300, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F900, 0x1F9FF), (0x1FA70, 0x1FAFF))
SIGNS = (
    "00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 "
    "25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 "
    "265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE "
    "26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 "
    "271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 "
    "2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A "
    "1F22F 1F232-1F23A 1F250-1F251 1F7E0-1F7EB 1F7F0"
)
KEYCAPS, KEYCAP = "#*0123456789", "\u20e3"
REGIONAL_A = 0x1F1E6
TONES = ("light", "medium-light", "medium", "medium-dark", "dark")
TONE, VARIATION = 0x1F3FB, "\ufe0f"
#: The first code point beyond the letters, quotes and dashes of ordinary prose.
PROSE = 0x2030


@lru_cache(maxsize=1)
def emoji_names() -> dict[str, str]:
    """Names of all pictographs and signs: their Unicode names in lower case with underscores,
    except where :data:`EMOJI_NAMES` has another; ``keycap_1`` for keycaps and ``flag_de`` for
    pairs of regional letters."""
    spans = [(a, b, "So") for a, b in PICTOGRAPHS]
    for span in SIGNS.split():
        low, _, high = span.partition("-")
        spans.append((int(low, 16), int(high or low, 16), ""))
    names = {}
    for low, high, category in spans:
        for ch in map(chr, range(low, high + 1)):
            if unicodedata.category(ch).startswith(category):
                names[ch] = unicodedata.name(ch).lower().replace(" ", "_")
    for key in KEYCAPS:
        names[key + KEYCAP] = names[key + VARIATION + KEYCAP] = f"keycap_{key}"
    for a in range(26):
        for b in range(26):
            names[chr(REGIONAL_A + a) + chr(REGIONAL_A + b)] = f"flag_{chr(97 + a)}{chr(97 + b)}"
    return names | EMOJI_NAMES


def _spans(codes: list[int], gap: int = 1) -> str:
    """Ranges of a character class over sorted code points; neighbours up to ``gap`` apart share one."""
    spans: list[list[int]] = []
    for code in codes:
        if spans and code - spans[-1][1] <= gap:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)


def few_spans(chars: set[str]) -> str:
    """A handful of ranges that hold all of ``chars``. Beyond the letters and marks of
    ordinary prose they also hold the characters in between: the JVM tries the ranges of a
    class one after the other, so hundreds of them make each character of a text costly."""
    codes = sorted(map(ord, chars))
    low, high = [c for c in codes if c < PROSE], [c for c in codes if c >= PROSE]
    return _spans(low) + _spans(high, 0x400)


def emoji_patterns(names: dict[str, str]) -> tuple[str, str, str]:
    """(sequences, class of single emoji, what may follow one): parts of patterns. Sequences
    share their first character, and a longer one goes before those that it begins with."""
    rests: dict[str, list[str]] = {}
    for e in sorted((e for e in names if len(e) > 1), key=lambda e: (-len(e), e)):
        rests.setdefault(e[0], []).append(re.escape(e[1:]))
    sequences = "|".join(f"{re.escape(head)}(?:{'|'.join(rest)})" for head, rest in rests.items())
    single = _spans(sorted(ord(e) for e in names if len(e) == 1))
    return sequences, single, f"[\\x{{{TONE:x}}}-\\x{{{TONE + len(TONES) - 1:x}}}]?{VARIATION}?"


def strip_rt(c: Column) -> Column:
    return F.regexp_replace(c, RT, "")


def strip_entities(c: Column) -> Column:
    return F.regexp_replace(c, ENTITY, " ")


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL, " ")


def strip_mentions(c: Column) -> Column:
    return F.regexp_replace(c, MENTION, " ")


def hashtags(c: Column, keep: bool = True) -> Column:
    return F.regexp_replace(c, HASHTAG, "$1" if keep else " ")


def collapse_space(c: Column) -> Column:
    """Each white-space run becomes one blank; a lone blank is not touched (and costs nothing)."""
    return F.trim(F.regexp_replace(c, f"{SPACE}{{2,}}|[{SPACE}&&[^ ]]", " "))


def has_non_ascii(c: Column) -> Column:
    """Cheap test that spares plain ASCII rows the Unicode expressions."""
    return F.octet_length(c) > F.length(c)


def demojize(c: Column, names: dict[str, str] | None = None) -> Column:
    """Replace each known emoji by its name between spaces; longest sequence first, and a
    skin tone after an emoji by the tone's name.

    Rows without any emoji (nearly all) pay for one regex test and nothing more.
    Other rows are cut into emoji and runs of other text, and only pieces that
    are emoji are looked up, in one folded constant.
    """
    names = emoji_names() if names is None else names
    if not names:
        return c
    sequences, single, tail = emoji_patterns(names)
    ones, more = {e for e in names if len(e) == 1}, [e for e in names if len(e) > 1]
    first = {e[0] for e in more}
    heads = single + re.escape("".join(sorted(first)))
    # A character that is in each emoji but not in plain text: ASCII heads do not count.
    rare = {next((ch for ch in e if not ch.isascii() and ch != VARIATION), e[0]) for e in more}
    trigger = f"[{few_spans(ones | rare)}&&[{single}{re.escape(''.join(sorted(rare)))}]]"
    plain = f"[[^{few_spans(ones | first)}][^{heads}]]"
    known = "|".join(x for x in (sequences, f"[{single}]{tail}" if single else "") if x)
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in names.items())), F.lit("\x01"), F.lit("\x02"))
    tones = F.lit("".join(chr(TONE + i) for i in range(len(TONES))))

    def named(p: Column) -> Column:
        tone = F.array(*[F.lit(f"_{t}_skin_tone") for t in TONES])
        at = F.instr(tones, F.substring(p, 2, 1))
        toned = F.when((F.length(p) > 1) & (at > 0), F.get(tone, at - 1)).otherwise("")
        name = F.coalesce(table[p], F.concat(table[F.substring(p, 1, 1)], toned))
        return F.when(p.rlike(f"^(?:{known})$"), F.concat(F.lit(" "), name, F.lit(" "))).otherwise(p)

    def spelt(v: Column) -> Column:
        pieces = F.regexp_extract_all(v, F.lit(rf"(?s){known}|{plain}+|."), 0)
        return F.when(has_non_ascii(v) & v.rlike(trigger), F.array_join(F.transform(pieces, named), "")).otherwise(v)

    return let(c, spelt)


def clean_text(
    c: Column,
    *,
    lowercase: bool = True,
    urls: bool = True,
    mentions: bool = True,
    keep_hashtag_text: bool = True,
    emoji: bool = True,
    emoji_names: dict[str, str] | None = None,
) -> Column:
    """RT, entities, URLs, mentions, hashtags, emoji, case, white space: in that order."""
    out = strip_entities(strip_rt(F.coalesce(c, F.lit(""))))
    if urls:
        out = strip_urls(out)
    if mentions:
        out = strip_mentions(out)
    out = hashtags(out, keep_hashtag_text)
    if emoji:
        out = demojize(out, emoji_names)
    if lowercase:
        out = F.lower(out)
    return collapse_space(out)


def clean_column(df: DataFrame, name: str = "text", **options) -> DataFrame:
    """Clean a column in place; a column that does not hold strings becomes ``''``."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return df.withColumn(name, F.lit(""))
    return df.withColumn(name, clean_text(F.col(name), **options))


def drop_empty(df: DataFrame, name: str = "text") -> DataFrame:
    return df.filter(F.length(name) > 0)


def clean_nonempty(df: DataFrame, name: str = "text", **options) -> DataFrame:
    """Clean a column and drop the rows that are empty afterwards.

    A filter on a cleaned column would be moved down to the scan with a second
    copy of all the expressions. A one-element generator keeps it above, so each
    text is cleaned once.
    """
    once = F.explode(F.array(clean_text(F.col(name), **options)))
    return drop_empty(df.select(*[once.alias(name) if c == name else F.col(c) for c in df.columns]), name)
