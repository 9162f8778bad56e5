"""Byte-level BPE encoding and decoding with a transducer of the frequent words.

A text is cut at the vocabulary's special strings and by its pre-split pattern. The
corpus' frequent words, counted over all documents, are merged once on the driver
and compiled with their ids into a minimal acyclic transducer
(:mod:`vigil.llm.transducer`). It is written to the shared folder, handed to the
executors as a Spark file and memory-mapped by their workers; a new executor fetches
it again. Words that it lacks are merged exactly, so the ids never depend on it.
The texts of a slice are cut at once into tokens, the distinct ones looked up and merged
together. Texts with special strings or rare white space go one by one; for these each
worker remembers a bounded number of the words it met last.

The vocabulary file (the public ``tokenizers`` JSON format: byte-level BPE without
normaliser) is read by the driver and broadcast; it has a fixed number of entries.

Defined cases: null and empty texts have no ids; other columns ride along; repeated
rows are encoded one by one; an empty table gives an empty transducer.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.frames import fresh, plus
from vigil.llm.transducer import Transducer, compile_words
from vigil.llm.words import parts_of, sha256_hex
from vigil.session import materialise, scratch_path

#: Words of the transducer: the most frequent ones with at least so many occurrences.
MAX_WORDS = 1 << 17
LEAST_COUNT = 2
#: Words up to this length are merged with a list, longer ones with a heap.
SHORT = 40
#: Words, and runs, that a worker remembers, and the longest of them in bytes.
MEMORY = 200_000
MEMORY_BYTES = 64
#: Lengths in bytes up to which words are merged together, and entries of their matrix.
LENGTHS = (8, 12, 16, 24, 40, 64)
MATRIX = 1 << 19
#: Steps of the histogram of word counts for a factor e.
LEVELS = 32
#: Distinct words that a worker counts before it passes them on.
COUNTED = 300_000
#: The pre-split of byte-level BPE (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable Latin-1 bytes as
    themselves, the others as the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special strings of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in name)
        for name, i in self.special.items():
            self.token[i] = name.encode()
        self.byte = [0] * 256
        for c, b in letters.items():
            self.byte[b] = vocab[c]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.made.append(vocab[a + b])
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
            self.rank.setdefault((vocab[a], vocab[b]), rank)
        # The same for many pairs at once: sorted pairs and their ranks.
        pairs = np.array(sorted((a * len(self.token) + b, r) for (a, b), r in self.rank.items()), dtype=np.int64).reshape(-1, 2)
        self.pairs, self.ranks = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int32)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the number of merges where there is none."""
        none = len(self.made)
        if not len(self.pairs):
            return np.full(a.shape, none, dtype=np.int32)
        key = a.astype(np.int64) * len(self.token) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], none).astype(np.int32)

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """:meth:`merged` of each word as little-endian 32-bit integers. Words of like
        length are rows of a matrix; a step merges one pair of every row."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        lower = 0
        for upper in [*LENGTHS, max(sizes, default=0)]:
            rows = np.flatnonzero((sizes > lower) & (sizes <= upper))
            for part in np.array_split(rows, len(rows) * upper // MATRIX + 1) if len(rows) else []:
                for row, packed in self._merged_rows([words[r] for r in part], sizes[part]):
                    out[part[row]] = packed
            lower = max(lower, upper)
        return out

    def _merged_rows(self, words: list[bytes], sizes: np.ndarray):
        """row, packed ids of words that are not empty."""
        width, none = int(sizes.max()), len(self.made)
        made, byte = np.array([*self.made, -1], dtype=np.int32), np.array(self.byte, dtype=np.int32)
        columns = np.arange(width)
        ids = np.full((len(words), width), -1, dtype=np.int32)
        ids[columns < sizes[:, None]] = byte[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width), none, dtype=np.int32)
        ranks[:, :-1] = self.ranks_of(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(words))
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            ready = best == none
            if ready.any():
                ended = ids[ready]
                inside = ended >= 0
                ends = 4 * np.cumsum(inside.sum(axis=1))
                flat = ended[inside].astype("<i4").tobytes()
                yield from ((r, flat[a:b]) for r, a, b in zip(row[ready].tolist(), [0, *ends.tolist()], ends.tolist()))
                ids, ranks, row, at, best = ids[~ready], ranks[~ready], row[~ready], at[~ready], best[~ready]
                if not len(row):
                    return
            # The merged id takes the place of its left half, what is right of it moves up.
            later = columns[:-1] >= at[:, None]
            ranks[:, :-1] = np.where(later, ranks[:, 1:], ranks[:, :-1])
            later[np.arange(len(row)), at] = False
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            all_rows = np.arange(len(row))
            new = made[best]
            ids[all_rows, at] = new
            right = np.where(at + 1 < width, ids[all_rows, np.minimum(at + 1, width - 1)], -1)
            ranks[all_rows, at] = self.ranks_of(new, right)
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self.ranks_of(ids[inner, at[inner] - 1], new[inner])

    def merged(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: always the pair with the lowest rank first, left to right."""
        ids = [self.byte[b] for b in word]
        return self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> tuple[int, ...]:
        """By a list of the neighbours' ranks."""
        get, none = self.rank.get, len(self.made)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return tuple(ids)

    def _long(self, ids: list[int]) -> tuple[int, ...]:
        """By a heap of the neighbours' ranks: n log n steps for words of any length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = self.merge.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    found = self.merge.get((ids[left], ids[right]))
                    if found:
                        heapq.heappush(heap, (found[0], left, ids[left], ids[right], found[1]))
        return tuple(i for i in ids if i >= 0)


class _Memory(dict):
    """Little-endian ids of words; what is not remembered is looked up or merged."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def packed(self, raw: bytes) -> bytes:
        """Ids of a word that is not remembered: from the transducer, or merged."""
        ids = self.lexicon.find(raw) if self.lexicon else None
        return array("I", self.vocabulary.merged(raw) if ids is None else ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        packed = self.packed(raw)
        if len(raw) <= MEMORY_BYTES:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = packed
        return packed


class _Runs(dict):
    """Ids of a run of visible characters, with the blank before it if it has one: a
    blank is always cut before, so runs can be remembered whole."""

    def __init__(self, blank: str, words, memory: _Memory):
        self.blank, self.words, self.memory = blank, words, memory

    def __missing__(self, run: str) -> bytes:
        if run.isalpha():  # letters only: one word
            packed = self.memory.packed((self.blank + run).encode())
        elif run[-1] in MARKS and run[:-1].isalpha():
            packed = self[run[:-1]] + self.memory[run[-1]]
        else:
            packed = b"".join(map(self.memory.__getitem__, self.words(self.blank + run)))
        if len(run) <= MEMORY_BYTES:
            if len(self) >= MEMORY:
                self.clear()
            self[run] = packed
        return packed


#: A mark that ends a run of letters is a word of its own.
MARKS = frozenset(".,;:!?")
#: White space other than blanks and line ends.
ODD_SPACE = re.compile(r"[^\S \n]")
#: Flags per byte: blank or line end, mark.
SPACES, MARKED = (np.isin(np.arange(256), list(chars.encode())) for chars in (" \n", "".join(MARKS)))
#: Flags per code point of the basic plane: a letter, as the pattern has it.
LETTERS = np.zeros(1 << 16, dtype=bool)
LETTERS[[ord(c) for c in regex.findall(r"\p{L}", "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000))]] = True


def letters_of(data: np.ndarray) -> np.ndarray:
    """Flags per byte of UTF-8: part of a letter (beyond the basic plane all are taken for none)."""
    out = LETTERS[data] & (data < 0x80)
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        out[high] = data[high] < 0xC0
        for lead, size in ((0xC0, 2), (0xE0, 3)):
            at = high[(data[high] >= lead) & (data[high] < lead + (64 >> size - 1))]
            code = data[at].astype(np.int64) & (0x7F >> size)
            for k in range(1, size):
                code = code << 6 | (data[at + k] & 0x3F)
            out[at] = LETTERS[code]
    return out


def cut_points(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the tokens of texts start that have no white space but blanks and line ends
    (the texts end at ``ends``; the last point is the end). As the pattern has it, white
    space before a visible character gives up its last character: a blank goes to the
    run that follows, a line end is a token. White space and visible runs are tokens; of
    letters with a mark at the end, the mark is a token of its own."""
    n = len(data)
    space = SPACES[data]
    begins = np.zeros(n + 1, dtype=bool)
    begins[0] = begins[ends] = True
    inner = np.zeros(n, dtype=bool)  # a character of the same text follows
    inner[:-1] = ~begins[1:n]
    follows = np.zeros(n, dtype=bool)  # a visible character of the same text follows
    follows[:-1] = ~space[1:]
    follows &= inner
    # The first of a white space, and its last character before something visible.
    before = np.zeros(n, dtype=bool)
    before[1:] = space[:-1]
    begins[:n] |= space & (~before | follows)
    # After a line end that a visible character follows.
    begins[1:][(data == 0x0A) & follows] = True
    # Before a mark that ends letters.
    last = ~space & ~np.concatenate((~space[1:], [False])) | ~space & ~inner
    at = np.flatnonzero(last & MARKED[data])
    letters = letters_of(data)
    at = at[at > 0]
    at = at[letters[at - 1] & ~begins[at]]
    points = np.flatnonzero(begins)
    start = points[np.searchsorted(points, at, side="right") - 1]
    start += data[start] == 0x20
    odd = np.concatenate(([0], np.cumsum(~letters)))
    begins[at[odd[at] == odd[start]]] = True
    return np.flatnonzero(begins)


def one_word(tokens: pa.LargeBinaryArray) -> np.ndarray:
    """Flags: tokens of :func:`cut_points` that surely are one word: letters, with
    or without a blank before them, white space, or a single mark."""
    _, offsets, data = tokens.buffers()
    at = np.frombuffer(offsets, "<i8", len(tokens) + 1, tokens.offset * 8)
    data = np.frombuffer(data, np.uint8)
    letters = np.concatenate(([0], np.cumsum(letters_of(data))))
    spaces = np.concatenate(([0], np.cumsum(SPACES[data])))
    size, first = np.diff(at), data[at[:-1]]
    n_letters, n_spaces = letters[at[1:]] - letters[at[:-1]], spaces[at[1:]] - spaces[at[:-1]]
    return (n_spaces == size) | (n_letters + ((first == 0x20) & (n_letters > 0)) == size) | ((size == 1) & MARKED[first])


def runs_of(text: str) -> list[list[str]] | None:
    """For each line its runs of visible characters, where single blanks and single line
    ends are all the white space of the text; else None."""
    if ODD_SPACE.search(text):
        return None
    lines = [line.split(" ") for line in text.split("\n")]
    return None if any("" in line for line in lines) else lines


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None = None):
        self.memory = _Memory(vocabulary, lexicon)
        self.words = regex.compile(PATTERN).findall
        self.first, self.later = _Runs("", self.words, self.memory), _Runs(" ", self.words, self.memory)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = {t: array("I", [vocabulary.special[t]]).tobytes() for t in special}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.token = vocabulary.token
        self.tokens = pa.array(vocabulary.token, pa.large_binary())

    def parts(self, text: str) -> list[str]:
        if self.cut and any(t in text for t in self.special):
            return [p for p in self.cut(text) if p]
        return [text] if text else []

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of many texts. They are cut at once into tokens, which are words or runs
        that need the pattern; each distinct one is looked up or merged once."""
        out = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if ODD_SPACE.search(text) or any(t in text for t in self.special):
                out[i] = self.encode(text)
            else:
                plain.append(i)
        if not plain:
            return out
        raw = [texts[i].encode() for i in plain]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        buffer = b"".join(raw)
        cuts = cut_points(np.frombuffer(buffer, np.uint8), ends)
        tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype("<i8")), pa.py_buffer(buffer)])
        distinct = tokens.dictionary_encode()
        coded = pa.array(self._ids_of(distinct.dictionary), pa.large_binary()).take(distinct.indices)
        _, offsets, data = coded.buffers()
        at = np.frombuffer(offsets, "<i8", len(coded) + 1, coded.offset * 8)
        at = at[np.searchsorted(cuts, [0, *ends])].tolist()
        for i, a, b in zip(plain, at, at[1:]):
            out[i] = data[a:b].to_pybytes()
        return out

    def _ids_of(self, tokens: pa.LargeBinaryArray) -> list[bytes]:
        """Ids of distinct tokens: those of :func:`one_word` are looked up and merged
        together, the others cut by the pattern."""
        values = tokens.to_pylist()
        single = one_word(tokens)
        out = [b""] * len(values)
        rows = np.flatnonzero(single).tolist()
        words = [values[i] for i in rows]
        parted = []
        if len(rows) < len(values):
            place: dict[bytes, int] = {}
            for i in np.flatnonzero(~single).tolist():
                own = [w.encode() for w in self.words(values[i].decode())]
                parted.append((i, [place.setdefault(w, len(words) + len(place)) for w in own]))
            words += place
        packed = self._looked_up(words)
        for i, found in zip(rows, packed):
            out[i] = found
        for i, own in parted:
            out[i] = b"".join([packed[j] for j in own])
        return out

    def _looked_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, each from the transducer or merged."""
        vocabulary, lexicon = self.memory.vocabulary, self.memory.lexicon
        found: list[bytes | None] = lexicon.find_all(words) if lexicon else [None] * len(words)
        short = [i for i, f in enumerate(found) if f is None and len(words[i]) <= MEMORY_BYTES]
        for i, packed in zip(short, vocabulary.merged_all([words[i] for i in short])):
            found[i] = packed
        return [array("I", vocabulary.merged(w)).tobytes() if f is None else f for w, f in zip(words, found)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.parts(text):
            known = self.special.get(part)
            out.append(known if known else self._plain(part))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        lines = runs_of(text)
        if lines is None:
            return b"".join(map(self.memory.__getitem__, self.words(text)))
        later = self.later.__getitem__
        return self.memory["\n"].join([self.first[line[0]] + b"".join(map(later, line[1:])) for line in lines])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def decode_all(self, coded: list[bytes]) -> list[bytes]:
        """The decoded texts in UTF-8: the tokens of all texts are put together at once."""
        if not coded:
            return []
        ends = np.cumsum([0] + [len(c) // 4 for c in coded])
        taken = self.tokens.take(pa.array(np.frombuffer(b"".join(coded), "<u4")))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, "<i8", len(taken) + 1, taken.offset * 8)[ends].tolist()
        whole = memoryview(data) if data is not None else b""
        return [_replaced(bytes(whole[a:b])) for a, b in zip(at, at[1:])]


def _replaced(raw: bytes) -> bytes:
    """``raw`` if it is UTF-8, else with its faults replaced."""
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def word_counts(docs: DataFrame, special: list[str]) -> DataFrame:
    """word, n over all texts, pre-aggregated by the workers."""

    def run(batches):
        words = regex.compile(PATTERN).findall
        cut = regex.compile("|".join(map(regex.escape, special))).split if special else None
        first: Counter[str] = Counter()
        later: Counter[str] = Counter()
        other: Counter[str] = Counter()

        def rows():
            for blank, runs in (("", first), (" ", later)):
                for run, n in runs.items():
                    if run.isalpha():
                        other[blank + run] += n
                    elif run[-1] in MARKS and run[:-1].isalpha():
                        other[blank + run[:-1]] += n
                        other[run[-1]] += n
                    else:
                        for word in words(blank + run):
                            other[word] += n
                runs.clear()
            out = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in other], pa.binary()), pa.array(list(other.values()), pa.int64())], names=["word", "n"])
            other.clear()
            return out

        for batch in parts_of(batches, "text"):
            for text in batch.column(0).to_pylist():
                for part in (cut(text) if cut else [text]) if text else []:
                    lines = runs_of(part)
                    if lines is None:
                        other.update(words(part))
                        continue
                    for line in lines:
                        first[line[0]] += 1
                        later.update(line[1:])
                    if len(lines) > 1:
                        other["\n"] += len(lines) - 1
                if len(first) + len(later) + len(other) > COUNTED:
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, words: int = MAX_WORDS) -> str:
    """Compiles the frequent words of ``docs``; the name of the Spark file."""
    spark = docs.sparkSession
    counts = word_counts(docs, list(vocabulary.special)).filter((F.col("n") >= LEAST_COUNT) & (F.length("word") <= MEMORY_BYTES))
    counts = materialise(counts, "words")
    # The least count of a word that is taken, from a histogram of bounded size: a sorted
    # limit would send as many rows from every task.
    level = F.floor(F.log("n") * LEVELS).cast("int")
    taken, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect(), key=lambda r: -r["level"]):
        taken += r["words"]
        if taken > words:
            break
        least = r["n"]
    top = [] if least is None else counts.filter(F.col("n") >= least).select("word").toLocalIterator()
    data = compile_words({bytes(r[0]): vocabulary.merged(bytes(r[0])) for r in top})
    folder, name = scratch_path(spark, "lexicon"), f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(data))
    stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encode(docs: DataFrame, vocabulary_path: str, digests: bool = True, ids: bool = True) -> DataFrame:
    """``docs`` with a struct ``bpe``: n_tokens, ids, sha256 of the ids and of the decoded text.

    ``ids=False`` or ``digests=False`` leave the respective fields null.
    """
    vocabulary = Vocabulary(vocabulary_path)
    lexicon = build_lexicon(docs, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    name = fresh("bpe", docs.columns)

    def run(batches):
        codec = Codec(shared.value, Transducer.mapped(SparkFiles.get(lexicon)))
        for batch in parts_of(batches, "text"):
            texts = batch.column("text").to_pylist()
            coded = codec.encode_all(texts)
            sizes = np.array([len(c) // 4 for c in coded], dtype=np.int64)
            at = pa.array(np.concatenate(([0], np.cumsum(sizes))) if ids else np.zeros(len(texts) + 1), pa.int32())
            flat = pa.array(np.frombuffer(b"".join(coded) if ids else b"", "<u4").astype(np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(at, flat) if ids else pa.nulls(len(texts), pa.list_(pa.int32()))
            sha = [pa.array([sha256_hex(c) for c in coded]), pa.array([sha256_hex(t) for t in codec.decode_all(coded)])] if digests else [pa.nulls(len(texts), pa.string())] * 2
            made = pa.StructArray.from_arrays([pa.array(sizes), lists, *sha], names=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, plus(docs.schema, **{name: "struct<n_tokens:bigint,ids:array<int>,ids_sha256:string,decoded_sha256:string>"}))


def decode(coded: DataFrame, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """``coded`` with the text of its id lists in a column ``decoded``; null ids give ''."""
    shared = coded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    name = fresh("decoded", coded.columns)

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return coded.mapInArrow(run, plus(coded.schema, **{name: "string"}))


def report(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document row."""
    coded = encode(docs.select("doc_id", "text"), vocabulary_path, ids=False)
    return coded.select("doc_id", *[F.col(f"bpe.{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])
