"""Sample documents for the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket int, data string, node long, row long, score double, n_words int, cut_text string, bpe int, toxicity int, component_id string"


def words(seed, n):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta Eps zeta eta theta iota kappa lambda mu nu xi été ß 漢字 🙂 don't 42".split()) + str(r.randint(0, 40)) for _ in range(n)]


def thue_morse(letters):
    """Two words of so many letters (a power of two) that any polynomial modulo 2^64 confuses."""
    a, b = "a", "b"
    while len(a) < letters:
        a, b = a + b, b + a
    return a, b


def strange():
    """(doc_id, text) with every case that the docstrings define."""
    passage = " ".join(words(1, 30))
    base = words(2, 120)
    almost = base[:60] + ["changed"] + base[61:]
    rows = [
        (10, None), (11, ""), (12, " \n\t "), (13, "One"), (14, "one two three"), (15, "ONE  two\nthree"),
        (16, " ".join(base)), (17, " ".join(almost)), (18, " ".join(base)), (18, " ".join(base)), (19, passage + " " + " ".join(words(3, 50))),
        (20, " ".join(words(4, 20)) + "\n" + passage), (20, "same id, other text " + " ".join(words(5, 15))), (None, " ".join(base)),
        (None, None), (21, passage + "\n" + passage), (22, " ".join(words(6, 40_000))), (23, "x" * 300_000), (24, "a" + "\x00" + "b c d e"),
        (-5, " ".join(base[:100])), (25, " ".join(words(6, 40_000)[100:400])), (26, "<|endoftext|> text <|endoftext|>"), (27, "\r\n".join([passage] * 3)),
    ]
    for letters in (1024, 8192):
        for i, w in enumerate(thue_morse(letters)):
            rows += [(letters + i, w), (letters + 10 + i, " ".join([*words(8, 12), w]))]
    return rows


def frame(spark, rows):
    full = [(d, t, ["en", None, "de"][i % 3], "s", len(t) if t else None, "c", i, "d", 7, 9, 0.1, 3, "cut", 1, 0, "z") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
