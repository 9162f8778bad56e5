"""Decontamination, language model, BPE, token counts, fingerprints, toxicity, pages."""

import hashlib
import math
import os
import random
import re
import tempfile
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from samples import frame, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import bpe, decontaminate, fingerprints, html_text, language_id, ngram_lm, token_counts, toxicity, transducer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def train():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2


def items(spark):
    p = words(1, 30)
    rows = [(1, " ".join(p[:12])), (2, " ".join(p[5:25]).upper()), (3, "One"), (3, "one two"), (4, None), (5, "--"), (None, "two three"), (6, "don't 42")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


# ------------------------------------------------------------- decontamination
@pytest.mark.parametrize("report", [decontaminate.report, decontaminate.hits_by_join])
def test_contamination(spark, strange_docs, strange_rows, report):
    rows, table = items(spark)
    small = [r for r in strange_rows if not r[1] or len(r[1]) < 100_000]
    docs, want = (strange_docs, strange_rows) if report is decontaminate.report else (frame(spark, small), small)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in report(docs, table).collect()), key=str)
    assert got == sorted(brute.contamination(want, rows), key=str)


@pytest.mark.parametrize("bound", [decontaminate.MAX_BROADCAST_BYTES, 0])
def test_contaminated_texts_are_cut_or_dropped(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_BYTES", bound)
    p = " ".join(words(1, 12))
    docs = frame(spark, [(1, f"Clean start here. {p}, and {' '.join(words(9, 40))}"), (2, re.sub("[a-z]", lambda m: m[0].upper(), p) + "!"), (3, "nothing of it"), (4, None), (None, "")])
    table = spark.createDataFrame([(1, p)], "item_id long, text string")
    out = decontaminate.clean(docs, table)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == docs.columns and set(got) == {1, 3, 4, None} and got[3] == "nothing of it"
    assert got[1].startswith("Clean start here. , and ") and p not in got[1]


def test_contamination_of_empty_tables(spark, no_docs, strange_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(no_docs, items(spark)[1]).count() == 0
    assert decontaminate.report(strange_docs, none).filter("contaminated").count() == 0
    assert decontaminate.clean(strange_docs, none).count() == strange_docs.count()


# -------------------------------------------------------------- language model
def test_base_score_is_exact(spark, strange_docs, strange_rows):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in ngram_lm.report(strange_docs, train()).collect()), key=str)
    want = sorted(brute.unigrams(strange_rows, lambda d: d is None or brute.crc_mod(d, 7) != 2), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) <= 1e-9 * abs(w[4]) for g, w in zip(got, want))


def test_model_without_rows(spark, no_docs, strange_docs):
    assert ngram_lm.report(no_docs, train()).count() == 0
    rows = ngram_lm.report(strange_docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["held_out"] and r["base_score"] == 0 for r in rows)


def held_levels(text, bits, hashes):
    """Keys and exact levels of a text's 2- and 3-grams, with the filter segment that holds them."""
    out = {}
    for order in ngram_lm.ORDERS:
        keys, c = np.unique(ngram_lm.keys_of(text, np.array([0, len(text)]), order, bits)[1], return_counts=True)
        out[order] = keys, ngram_lm.level_of(c), ngram_lm.segment_of(keys, ngram_lm.level_of(c), hashes)
    return out


def test_filter_holds_every_ngram_and_errs_at_its_rate():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 63, 200_000, dtype=np.uint64))
    held, others = keys[::2], keys[1::2]
    levels = ngram_lm.level_of(rng.zipf(1.7, len(held)).clip(1, 1 << 20))
    segment = ngram_lm.segment_of(held, levels, ngram_lm.HASHES)
    assert abs(np.unpackbits(segment).mean() - 0.5) < 0.01
    assert abs(8 * len(segment) / levels.sum() - ngram_lm.HASHES / math.log(2)) < 0.01
    got = ngram_lm.probe(segment, held, ngram_lm.HASHES)
    assert (got >= levels).all() and (got > levels).mean() < 0.006
    assert 0.002 < (ngram_lm.probe(segment, others, ngram_lm.HASHES) > 0).mean() < 0.006
    empty = ngram_lm.segment_of(held[:0], levels[:0], ngram_lm.HASHES)
    assert not len(empty) and not ngram_lm.probe(empty, others, ngram_lm.HASHES).any()


def test_levels_of_counts():
    counts = np.array([1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 15, 16, (1 << 40) - 1, 1 << 40])
    assert ngram_lm.level_of(counts).tolist() == [1, 2, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 79, 80]
    assert ngram_lm.least_count(np.arange(9)).tolist() == [0, 1, 2, 3, 4, 6, 8, 12, 16]


def test_probabilities_sum_to_one_at_most():
    rng = np.random.default_rng(1)
    vocab = rng.integers(1, 1 << 63, 40, dtype=np.uint64)
    text = vocab[np.minimum(rng.geometric(0.15, 20_000), 40) - 1]
    names, counts = np.unique(text, return_counts=True)
    held = held_levels(text, 38, 40)
    for u, v in rng.choice(names, (30, 2)):
        total = 0.0
        for w in names:
            h, first = np.array([u, v, w], dtype=np.uint64), np.array([0, 3])
            c = np.array([counts[np.searchsorted(names, x)] for x in h])
            levels = {o: ngram_lm.probe(held[o][2], ngram_lm.keys_of(h, first, o, 38)[1], 40) for o in ngram_lm.ORDERS}
            total += 10 ** ngram_lm.smoothed(h, first, c, len(text), len(names), levels)[1][2]
        assert 0.3 < total <= 1 + 1e-9


def brute_scores(rows, is_train):
    """Smoothed scores by counting all n-grams in dictionaries."""
    def of(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")), None]

    counts = {n: Counter(tuple(t[i : i + n]) for d, x in rows if is_train(d) for t in [of(x)] for i in range(len(t) - n + 1)) for n in (1, 2, 3)}
    total, distinct, k, out = sum(counts[1].values()), len(counts[1]), ngram_lm.K, []
    steps = [0, 1, *(m << i for i in range(40) for m in (2, 3)), 1 << 41]
    low = lambda *g: max(x for x in steps if x <= counts[len(g)][g])
    for d, x in rows:
        t, score = of(x), 0.0
        for i in range(len(t)):
            p = (counts[1][(t[i],)] + 1) / (total + distinct + 1)
            if i >= 1 and (c := counts[1][(t[i - 1],)]):
                p = (low(*t[i - 1 : i + 1]) + k * p) / (c + k)
            if i >= 2 and (pair := low(*t[i - 2 : i])):
                high = min(steps[steps.index(pair) + 1] - 1, counts[1][(t[i - 2],)])
                p = (min(high, low(*t[i - 2 : i + 1])) + k * p) / (high + k)
            score += math.log10(p)
        out.append((d, len(t), score))
    return out


@pytest.mark.parametrize("broadcast_bytes", [ngram_lm.BROADCAST_BYTES, 0])
def test_scores_equal_a_count_of_all_ngrams(spark, strange_docs, strange_rows, broadcast_bytes):
    """With 40 bits per insertion no probe errs; with eight, few do, and the same in both ways."""
    want = sorted(brute_scores(strange_rows, lambda d: d is None or brute.crc_mod(d, 7) != 2), key=str)
    for hashes, bound in ((40, 1e-9), (ngram_lm.HASHES, 0.02)):
        rows = ngram_lm.report(strange_docs, train(), hashes, broadcast_bytes).collect()
        got = sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in rows), key=str)
        assert sorted((g[:2] for g in got), key=str) == sorted((w[:2] for w in want), key=str)
        assert abs(sum(g[2] for g in got) - sum(w[2] for w in want)) <= bound * abs(sum(w[2] for w in want))
        if hashes == 40:
            assert all(abs(g[2] - w[2]) <= 1e-9 * abs(w[2]) for g, w in zip(got, want))


def test_both_ways_to_the_bits_give_the_same_scores(spark, strange_docs):
    ways = [sorted(map(str, ngram_lm.report(strange_docs, train(), broadcast_bytes=b).collect())) for b in (ngram_lm.BROADCAST_BYTES, 0)]
    assert ways[0] == ways[1]


def test_ngrams_seen_once_count(spark):
    got = {r["doc_id"]: r["score"] for r in ngram_lm.report(frame(spark, [(1, "one two three")]), F.lit(True), 40).collect()}
    # Each of the four tokens (the end is one) occurs once, as does each n-gram.
    k = ngram_lm.K
    p1 = 2 / 9
    p2 = (1 + k * p1) / (1 + k)
    p3 = (1 + k * p2) / (1 + k)
    assert abs(got[1] - math.log10(p1 * p2 * p3 * p3)) < 1e-12


def test_more_copies_gain_more(spark):
    rows = [(i * 100 + j, " ".join(words(i, 80))) for i, n in enumerate((1, 2, 3, 4, 8, 16), 1) for j in range(n)]
    rows += [(10_000 + i, " ".join(words(60 + i, 80))) for i in range(20)]
    got = {r["doc_id"]: (r["score"], r["score"] - r["base_score"]) for r in ngram_lm.report(frame(spark, rows), F.col("doc_id") < 10_000).collect()}
    scores = [got[i * 100][0] for i in range(1, 7)]
    assert scores == sorted(scores)
    assert min(got[i * 100][1] for i in range(1, 7)) > 20 > max(gain for i, (_, gain) in got.items() if i >= 10_000)


def test_repeated_text_scores_higher(spark):
    known = " ".join(words(7, 60))
    rows = [(i, known) for i in range(1, 40)] + [(100 + i, " ".join(words(50 + i, 60))) for i in range(10)]
    got = ngram_lm.report(frame(spark, rows), train()).collect()
    assert all(r["score"] > r["base_score"] + 20 for r in got if r["doc_id"] < 100)


# ------------------------------------------------------------------------- BPE
@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_codec_equals_the_library(library):
    codec = bpe.Codec(bpe.Vocabulary(VOCABULARY))
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\x1c", "\x85", "\xa0", "　", "​", "'s", "'LL", "a", "é", "1", "Ⅷ", "漢", "🙂", "́", "<|endoftext|>", "<|", "_", "?!", "\x00", "the", " of"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        coded = codec.encode(text)
        assert np.frombuffer(coded, "<u4").tolist() == ids, text
        assert codec.decode(coded) == library.decode(ids, skip_special_tokens=False)


def test_texts_of_a_slice_are_coded_together(library, monkeypatch):
    vocabulary = bpe.Vocabulary(VOCABULARY)
    known = {w: vocabulary.merged(w) for w in (b" the", b"the", b" of", "é".encode(), b"\n", b" ")}
    codec = bpe.Codec(vocabulary, transducer.Transducer(transducer.compile_words(known)))
    r = random.Random(3)
    parts = [" ", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\xa0", "'s", "a", "strange", "é", "ß", "1", "漢", "🙂", "́", "×", "<|endoftext|>", "_", "?!", ".", ",", "the", " of", "x" * 70]
    texts = [None, "", *("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000))]
    texts += ["".join(r.choice([" ", "\n", "the", "é", "漢", ".", "!", "ab"]) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(c, "<u4").tolist() for c in codec.encode_all(texts)] == want
    assert codec.encode_all([]) == [] and codec.encode_all([None]) == [b""]
    # Plain texts are not coded word by word.
    monkeypatch.setattr(codec, "encode", None)
    monkeypatch.setattr(codec.memory.lexicon, "find", None)
    monkeypatch.setattr(vocabulary, "_short", None)
    assert np.frombuffer(codec.encode_all(["the strange é of.\n the"])[0], "<u4").tolist() == library.encode("the strange é of.\n the", add_special_tokens=False).ids


def test_words_merged_together_equal_words_merged_alone():
    vocabulary = bpe.Vocabulary(VOCABULARY)
    r = random.Random(4)
    words_ = [b"".join(r.choice([b"a", b"an", b" ", b"tion", b"er", "é".encode(), b"\xff", b"\0"]) for _ in range(r.randint(1, 20))) for _ in range(4000)]
    assert vocabulary.merged_all(words_) == [np.array(vocabulary.merged(w), dtype="<u4").tobytes() for w in words_]
    assert vocabulary.merged_all([]) == [] and vocabulary.merged_all([b""]) == [b""]
    for n in (0, 3, 900):
        known = {w: (i, i + 1) for i, w in enumerate(words_[:n])} | ({b"": (7,)} if n == 3 else {})
        t = transducer.Transducer(transducer.compile_words(known))
        assert t.find_all([b"", *words_]) == [None if (f := t.find(w)) is None else np.array(f, dtype="<u4").tobytes() for w in [b"", *words_]]


def test_documents_equal_the_library(spark, library, strange_docs, strange_rows):
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.report(strange_docs, VOCABULARY).collect()), key=str)
    want = []
    for d, t in strange_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_ids_round_trip_and_columns_stay(spark, strange_docs, no_docs):
    coded = bpe.encode(strange_docs, VOCABULARY)
    assert coded.columns[:-1] == strange_docs.columns
    back = bpe.decode(coded.select("doc_id", "text", F.col(f"{coded.columns[-1]}.ids").alias("ids")), VOCABULARY)
    assert back.filter("decoded <> coalesce(text, '')").count() == 0
    assert bpe.report(no_docs, VOCABULARY).count() == 0


def test_transducer_is_a_minimal_map(tmp_path):
    r = random.Random(2)
    words_ = {bytes(r.choice(b"abc") for _ in range(r.randint(0, 7))): tuple(r.randint(0, 50_000) for _ in range(r.randint(0, 4))) for _ in range(800)}
    data = transducer.compile_words(words_)
    path = tmp_path / "words.bin"
    path.write_bytes(data)
    for t in (transducer.Transducer(data), transducer.Transducer.mapped(str(path))):
        assert all(t.find(w) == ids for w, ids in words_.items())
        for _ in range(2000):
            w = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 8)))
            assert t.find(w) == words_.get(w)
    # Right languages of the states: no two states accept the same words.
    t = transducer.Transducer(data)
    seen = set()
    for s in range(t.states):
        key = (data[t.ends + s], data[t.labels + t.first[s] : t.labels + t.first[s + 1]], tuple(t.target[t.first[s] : t.first[s + 1]]))
        assert key not in seen
        seen.add(key)
    assert transducer.Transducer(transducer.compile_words({})).find(b"a") is None


# ---------------------------------------------------------------- token counts
def test_counts_of_documents(spark, strange_docs, strange_rows, no_docs):
    def spaces():
        return lambda text: [1] * len(text.split())

    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.report(strange_docs, spaces, end=9).collect()), key=str)
    assert got == sorted(((d, len((t or "").split())) for d, t in strange_rows), key=str)
    assert token_counts.report(no_docs, spaces, end=9).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_raw_files_with_ends_anywhere(spark, monkeypatch, width):
    monkeypatch.setattr(token_counts, "RUN", 3)
    r, want = random.Random(width), {}
    folder = tempfile.mkdtemp()
    for f in range(6):
        lengths = [r.choice([0, 0, 1, 3, 50, 400]) for _ in range(r.randint(0, 40))] if f else []
        tail = r.choice([0, 5, 100])
        ids = [i for n in lengths for i in [*(r.randint(0, 8) for _ in range(n)), 9]] + [1] * tail
        np.array(ids, dtype=f"<u{width}").tofile(f"{folder}/{f}.bin")
        want[f] = [(n, True) for n in lengths] + ([(tail, False)] if tail else [])
    got: dict = {}
    for x in token_counts.counts(token_counts.blocks_of_files(spark, folder, width, 16), 9, width).collect():
        got.setdefault(int(os.path.basename(x["file"])[0]), []).append((x["place"], x["n_tokens"], x["closed"]))
    for f, rows in want.items():
        assert [g[1:] for g in sorted(got.get(f, []))] == rows
        assert [g[0] for g in sorted(got.get(f, []))] == list(range(len(rows)))


# ---------------------------------------------------------------- fingerprints
PIECES = re.compile(r"(?m)^[^\n]{1,48}|[^\n]{1,400}")


def likeness(a, b):
    a, b = set(PIECES.findall(a)), set(PIECES.findall(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, no_docs):
    r = random.Random(5)
    rows = [(i * 7 - 20, "\n".join(" ".join(words(i * 100 + k, r.randint(0, 90))) for k in range(r.choice([0, 1, 2, 5, 30])))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, "x"), (503, "漢字🙂" * 200), (504, "\n".join(f"line {i} of many" for i in range(3000))), (505, "\n".join(f"row {i} of many" for i in range(2500)))]
    rows += [(600, rows[3][1]), (601, "tail")]
    got = {x["doc_id"]: x for x in fingerprints.report(frame(spark, rows)).collect()}
    order = sorted((d, t or "") for d, t in rows)
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[1][:q]
        x = got[d]
        assert (x["n_chars"], x["next_id"], x["edited_sha256"]) == (len(t), nxt[0], hashlib.sha256(edited.encode()).hexdigest())
        assert abs(x["near_edited"] - likeness(t, edited)) < 1e-12 and abs(x["near_next"] - likeness(t, nxt[1])) < 1e-12
        assert (x["fingerprint"] == x["edited_fingerprint"]) == (set(PIECES.findall(t)) == set(PIECES.findall(edited)))
    assert got[600]["fingerprint"] == got[rows[3][0]]["fingerprint"]
    assert fingerprints.report(no_docs).count() == 0


def test_fingerprints_of_strange_rows(spark, strange_docs, strange_rows):
    got = fingerprints.report(strange_docs).collect()
    assert len(got) == len(strange_rows)
    assert all(r["near_edited"] is not None and 0 <= r["near_next"] <= 1 for r in got)
    one = fingerprints.report(frame(spark, [(1, "only one row")])).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["next_id"] == 1


def test_fingerprints_run_no_python(spark, strange_docs):
    plan = fingerprints.report(strange_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_decode_together_as_alone():
    codec = bpe.Codec(bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    coded = [codec.encode(t) for t in ("A word, \u00e9t\u00e9 \U0001f600!", "", "<|endoftext|>x", "\n")]
    coded += [coded[0][:-8], b"", codec.encode("\U0001f600")[:4]]  # ids that end inside a character
    assert codec.decode_all(coded) == [codec.decode(c).encode() for c in coded]
    assert codec.decode_all([b"", b""]) == [b"", b""] and codec.decode_all([]) == []


# -------------------------------------------------------------------- toxicity
def labelled(spark, n=400):
    r, rows, labels = random.Random(6), [], []
    for i in range(n):
        w, toxic = words(i, r.randint(5, 60)), int(r.random() < 0.3)
        for _ in range(2 * toxic):
            w[r.randrange(len(w))] = r.choice(["Grumpf", "zonk!", "blarg-head"])
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    return frame(spark, rows), spark.createDataFrame(labels + [(0, None), (10_000, 1)], "doc_id long, toxic int"), dict(labels)


def test_toxic_words_are_learned(spark):
    docs, labels, truth = labelled(spark)
    rows = toxicity.report(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (brute.crc_mod(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert len(held) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9
    out = toxicity.reject(docs, labels)
    assert out.columns == docs.columns and out.count() < docs.count()


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = labelled(spark, 120)
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.report(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_places_go_to_usable_labels(spark, monkeypatch):
    """Labels of absent, null and overlong documents take no place of the bounded sample."""
    seen = {}
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 20)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 20)
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, *rest: seen.update(texts=texts, y=y))
    long_text = "x" * (toxicity.MAX_TRAIN_BYTES + 1)
    docs = frame(spark, [(i, "short text" if i < 100 else None if i < 200 else long_text) for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    assert len(seen["texts"]) == 40 and seen["y"].sum() == 20 and set(seen["texts"]) == {b"short text"}


def test_every_label_counts(spark, monkeypatch):
    """More labelled texts than the start takes, one of them overlong: all are learned from."""
    docs, labels, truth = labelled(spark, 500)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts[1000] = "hapax " * 20_000
    docs, labels = frame(spark, list(texts.items())), labels.union(spark.createDataFrame([(1000, 1)], labels.schema))
    truth = truth | {1000: 1}
    taken = {i: t for i, t in truth.items() if brute.crc_mod(i, 5)}
    rows = toxicity.every_row(docs, labels).cache()
    assert sorted((r["text"], r["toxic"], r["fold"]) for r in rows.collect()) == sorted((texts[i], bool(t), brute.crc_mod(i, 5)) for i, t in taken.items())
    buckets = [toxicity.word_buckets([texts[i].encode()])[0] for i in taken]
    assert np.allclose(toxicity._z_of_all(rows)[2], toxicity._z_values(buckets, np.array(list(taken.values()))))
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 4)
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 4)
    held = [r for r in toxicity.report(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9


def test_toxicity_of_strange_rows(spark, strange_docs, strange_rows, no_docs):
    _, labels, _ = labelled(spark, 60)
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    for x in (labels, nothing):
        rows = toxicity.report(strange_docs, x).collect()
        assert len(rows) == len(strange_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.report(no_docs, labels).count() == 0
    assert toxicity.reject(strange_docs, nothing).count() == len(strange_rows)


# ----------------------------------------------------------------------- pages
PAGE = """<html><head><title>T</title><style>x</style></head><body><header class="site"><a href="/">Home</a> Name</header>
<div id="cookie-notice">We use cookies to give you a better experience on this site. <button>OK</button></div>
<nav><ul><li><a>One</a></li></ul></nav><main><article><header><h1>Title of &quot;it&quot;</h1></header><p>First   para with <a href=x>link</a>.</p>
<p>Short.</p><ul><li>item one</li><li>two</li></ul><div class="ad-slot">Buy now things</div><p>Another&nbsp;para 1 &lt; 2
<script>if(a<b){document.write("<p>no</p>")}</script>tail</p><form><p>Fill in this form please</p></form></article>
<section id="comments"><article class="comment"><p>A very long and thoughtful reader comment that goes on for many words.</p></article></section></main>
<aside><p>Side text that is long enough to look like real text, with many words and no links at all.</p></aside><footer><p>&copy; 2020</p></footer></body></html>"""


def test_main_text():
    tree = html_text.train()
    assert html_text.main_text(PAGE, tree) == 'Title of "it"\n\nFirst para with link.\n\nShort.\n\nitem one\n\ntwo\n\nAnother para 1 < 2 tail'
    plain = '<body><div id=menu><a href=1>A</a> <a href=2>B</a></div><div class=content><h2>Head</h2><p>One has words.<p>Two<br>line</div><div class="comments"><p>nice</p></div><div class=footer>foot</div>'
    assert html_text.main_text(plain, tree) == "Head\n\nOne has words.\n\nTwo line"
    for page in (None, "", "<!-- open <p>x", "<script>x", "<div><div", "</p></p>"):
        assert html_text.main_text(page, tree) == ""


def test_one_name_does_not_drop_an_article():
    tree, body = html_text.train(), "<p>One paragraph that has some ten words in its line.</p><p>Another has words.</p>"
    want = "One paragraph that has some ten words in its line.\n\nAnother has words."
    for start, end in [
        ("<article class='post has-sidebar'>", "</article>"), ("<div class='content no-comments'>", "</div>"), ("<article class='post tag-social category-search'>", "</article>"),
        ("<main class='widget'>", "</main>"), ("<div class='entry sponsored'>", "</div>"), ("<div class='post category-search'>", "</div>"),
    ]:
        assert html_text.main_text(f"<body>{start}{body}{end}</body>", tree) == want, start
    for start, end in [("<div class='post-navigation'>", "</div>"), ("<article id='comment-5' class='comment'>", "</article>"), ("<article hidden>", "</article>"), ("<div class='sidebar'>", "</div>")]:
        assert html_text.main_text(f"<body>{start}{body}{end}</body>", tree) == "", start


def test_neighbours_count_inside_an_article():
    tree = html_text.train()
    paragraph, link = f"<p>{'word ' * 65}</p>", "<p><a href=1>one</a></p>"
    line = "<p><a href=2>Nine linked words that say where to read</a> more</p>"
    of = lambda around: "Nine linked" in html_text.main_text(f"<article>{paragraph}{around}{line}{around}</article>", tree)
    assert of(paragraph) and not of(link)


def test_the_tree_fits_its_table():
    data, tree = html_text.labelled(), html_text.train()
    assert np.mean([tree.says(tuple(r[:-1])) == bool(r[-1]) for r in data]) > 0.95


def test_pages_with_strange_rows(spark):
    rows = [(1, "http://a.example/x", PAGE), (1, "http://a.example/x", PAGE), (2, None, None), (None, "u", ""), (3, "", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, text string, main_text int")
    got = html_text.report(pages).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == sorted((r[0] or 0, len(html_text.main_text(r[2], html_text.train()))) for r in rows)
    assert [r["n_chars"] for r in got if r["page_id"] == 3] == [499_999]
    assert html_text.report(pages.limit(0)).count() == 0
    texts = spark.createDataFrame([("the cat sat on the mat with another cat", "en"), ("der hund und die katze sind nicht hier", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    found = {(r["page_id"], r["url"]): r for r in language_id.identify(pages, texts).collect()}
    assert set(found) == {(r[0], r[1]) for r in rows} and found[2, None]["text_lang"] is None
    assert language_id.identify(pages.limit(0), texts).count() == 0
    assert {r["lang"] for r in language_id.identify(pages, texts.limit(0)).collect()} == {None}


def test_language_evidence_is_fused(spark):
    en, de = "the cat sat on the mat and the dog ran to the house with them " * 3, "der hund und die katze sind nicht im haus und das ist gut so " * 3
    texts = spark.createDataFrame([(en, "en"), (de, "de")], "text string, lang string")
    page = lambda text, lang="": f"<html {lang}><body><article><p>{text}</p></article></body></html>"
    rows = [(i, f"http://haus.example.de/{i}", page(de, "lang=de")) for i in range(30)] + [(100 + i, f"http://house.example.com/{i}", page(en, "lang='en'")) for i in range(30)]
    rows += [(200, "http://haus.example.de/x", page("42")), (201, "http://house.example.com/x", page("42")), (202, "http://new.example.org/x", page("42", "lang=de-AT")), (203, "http://haus.example.de/y", page(en))]
    got = {r["page_id"]: r["lang"] for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), texts).collect()}
    assert got[200] == "de" and got[201] == "en" and got[202] == "de" and got[203] == "en"
    assert all(got[i] == "de" and got[100 + i] == "en" for i in range(30))


def test_trigram_counts_are_sums_over_all_texts(spark):
    rows = [(t, lang) for lang, t in (("en", "the cat sat"), ("de", "der hund"), ("en", "on the mat"), (None, "x"), ("de", None), ("fr", ""))] * 3
    langs, logs = language_id.fit(spark.createDataFrame(rows, "text string, lang string").repartition(5))
    assert set(langs) >= {"de", "en"}
    for lang in ("de", "en"):
        n = sum(np.bincount(language_id.trigrams(t.encode()), minlength=language_id.BUCKETS) for t, x in rows if x == lang and t)
        assert np.allclose(logs[langs.index(lang)], np.log((n + 0.5) / (n.sum() + 0.5 * language_id.BUCKETS)))


def test_declared_language_is_found_anywhere(spark):
    texts = spark.createDataFrame([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")], "text string, lang string")
    tail = "<body><p>42</p></body></html>"
    pages = {
        1: (f"<!-- {'licence ' * 1000} --><html lang=de>{tail}", "de"),
        2: ("\n" * 5000 + f"<HTML class='a' LANG='FR-ca'>{tail}", "fr"),
        3: (f"<script>var s = '<html lang=fr>';{'x;' * 4000}</script><html lang=de>{tail}", "de"),
        4: (f"<!-- <html lang=fr> --><html lang=de>{tail}", "de"),
        5: (f"<html><!-- <html lang=fr> -->{tail}", None),
        6: (f"<html data-x='a > b' lang=en>{tail}", "en"),
        7: ("<html " * 50_000, None),
        8: (f"<html data-lang='fr' xml:lang='fr' lang='en'>{tail}", "en"),
        9: (f"<html data-lang=fr>{tail}", None),
    }
    rows = [(i, f"http://a.example/{i}", page) for i, (page, _) in pages.items()]
    got = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), texts).collect()
    assert {r["page_id"]: r["declared"] for r in got} == {i: lang for i, (_, lang) in pages.items()}


def test_the_start_of_the_toxicity_model_gets_buckets_not_texts(spark, monkeypatch):
    texts = {i: f"word{i % 7} other{i % 3} " * (i % 5) + ("awful" if i % 4 == 0 else "fine") for i in range(40)}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in texts], "doc_id long, toxic int")
    given = []
    monkeypatch.setattr(toxicity, "fit", lambda *a: given.append(a))
    toxicity.train(docs, labels)
    words = given[0][0]
    want = [toxicity.word_buckets([t.encode()])[0] for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5]
    assert all(w.dtype.itemsize == 2 for w in words)
    assert sorted(w.astype(np.int32).tobytes() for w in words) == sorted(w.astype(np.int32).tobytes() for w in want)
