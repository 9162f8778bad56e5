"""Spelling variants: words of a corpus one edit apart, found by pairs of trie nodes.

The words that occur often enough are numbered in sorted order, and so are the nodes
of their trie and of the trie of the reversed words (:func:`trie_nodes`). A word of
length L then is 2L + 1 pairs of integers: one (prefix node, suffix node) for each
skipped position, and one for each place where a letter may be inserted. Words that
differ in one replaced letter share a pair of skipped positions; a word with one letter
more shares such a pair with the place in the shorter word. An equal pair is an equal
string, so the join finds exact neighbours and nothing is compared afterwards. A letter
skipped within a run of the same letter gives the same string; for insertions only the
run's first letter counts, so each two neighbours meet in one group.

A group holds at most one word per letter of the alphabet, plus one. It gives each
member its number of neighbours and the most frequent one from the group's two best,
so pairs are never listed. Forms are followed to their roots by doubling: a form is at
least twice as frequent, so a few rounds do.

Tries are numbered in ranges of sorted words. A node belongs to the first range that
holds its prefix; only prefixes of a range's last word can go on into later ranges,
and these carry the range and their depth as their number, which every later range
derives from the list of first and last words.

Defined cases: null texts have no words; a null id counts as the empty text in the
hash of a run; repeated rows count each; empty tables give no rows; other columns are
not read; runs of any length are words.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.words import parts_of
from vigil.session import materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
#: One letter is lost where this divides a run's hash.
DRAW = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: Words, and their letters, that a worker counts before it passes them on.
COUNTED = 200_000
COUNTED_LETTERS = 8 << 20
#: Bytes of words in one range of a trie.
RANGE_BYTES = 4 << 20
LEAST_RANGES = 8
#: Numbers of a range's nodes that are no prefix of its last word begin here.
INNER = 1 << 39


def read_word(head: int, run: str) -> str:
    """What is counted for a run: lower-cased in A-Z, with one letter less where the hash
    (continued from ``head``, that of the id and a colon) draws it."""
    run = run.lower() if run.isascii() else run.translate(ASCII_LOWER)
    h = zlib.crc32(run.encode(), head)
    if h % DRAW == 0:
        at = h % len(run)
        run = run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n over all texts (doc_id, text), pre-aggregated by the workers."""

    def run(batches):
        total: Counter[str] = Counter()
        letters = 0

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in parts_of(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for given, n in Counter(RUN.findall(text or "")).items():
                    word = read_word(head, given)
                    if len(word) >= least_length:
                        total[word] += n
                        letters += len(word)
                if len(total) > COUNTED or letters > COUNTED_LETTERS:
                    letters = 0
                    yield rows()
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    return len(os.path.commonprefix((a, b)))


def inherited(first: str, lasts: list[str], part: int) -> list[int]:
    """Numbers of the prefixes of a range's first word that earlier ranges own, by depth
    (0 is the root): the first range of those whose last words share the prefix."""
    owner: list[int] = []
    depth = None
    for k in range(part - 1, -1, -1):
        shared = common(first, lasts[k])
        depth = shared if depth is None else min(depth, shared)
        if depth == 0:
            break
        if not owner:
            owner = [k] * depth
        owner[:depth] = [k] * depth
    return [0, *[(k << 40) | d for d, k in enumerate(owner, 1)]]


def number_range(words: list[str], lasts: list[str], part: int) -> list[list[int]]:
    """Node numbers of all prefixes (from the empty one on) of a range's sorted words."""
    out, nodes, before, fresh = [], inherited(words[0], lasts, part), None, INNER
    for word in words:
        if before is not None:
            nodes = nodes[: common(before, word) + 1]
        border = common(word, lasts[part])
        for d in range(len(nodes), len(word) + 1):
            if d <= border:
                nodes.append((part << 40) | d)
            else:
                fresh += 1
                nodes.append((part << 40) | fresh)
        out.append(nodes)
        nodes, before = list(nodes), word
    return out


def trie_nodes(words: DataFrame, key: str) -> DataFrame:
    """``words`` (distinct strings ``key``) with ``nodes``, the trie node of every prefix,
    and ``rank``, a number in the order of ``key``."""
    size = words.agg(F.sum(F.octet_length(key))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_BYTES))
    parted = materialise(words.repartitionByRange(ranges, key).withColumn("part", F.spark_partition_id()), "ranges")
    ends = sorted(map(tuple, parted.groupBy("part").agg(F.max(key)).collect()))
    lasts = [""] * (ends[-1][0] + 1 if ends else 0)
    for part, last in ends:
        lasts[part] = last
    # A range that got no words ends where the one before it does.
    for part in range(1, len(lasts)):
        lasts[part] = lasts[part] or lasts[part - 1]
    shared = words.sparkSession.sparkContext.broadcast(lasts)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column(key)))
        part = table.column("part")[0].as_py()
        nodes = number_range(table.column(key).to_pylist(), shared.value, part)
        rank = pa.array(range(part << 32, (part << 32) + len(nodes)), pa.int64())
        return table.drop_columns(["part"]).append_column("nodes", pa.array(nodes, pa.list_(pa.int64()))).append_column("rank", rank)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + ", nodes array<bigint>, rank bigint"
    return parted.groupBy("part").applyInArrow(run, schema)


def _starts(words: DataFrame) -> DataFrame:
    """``words`` with ``starts``: whether a letter differs from the one before it."""

    def run(batches):
        for batch in batches:
            starts = [[i == 0 or w[i] != w[i - 1] for i in range(len(w))] for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.list_(pa.bool_()))], names=[*batch.schema.names, "starts"])

    return words.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema) + ", starts array<boolean>")


def dictionary(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered words (id, word, n), and their pair dictionary: p, s, id, n, kind (0
    and 1 a skipped letter, 1 the first of a run of it; 2 a place between letters)."""
    forward = materialise(_starts(trie_nodes(words, "word")).withColumnsRenamed({"nodes": "pre", "rank": "id"}), "forward")
    back = trie_nodes(forward.select("id", F.reverse("word").alias("back")), "back").select("id", F.col("nodes").alias("suf"))
    both = forward.select("id", "n", "pre", "starts").join(back, "id")
    skip = F.expr("transform(starts, (b, i) -> struct(pre[i] AS p, suf[size(starts) - 1 - i] AS s, int(b) AS kind))")
    place = F.expr("transform(pre, (q, i) -> struct(q AS p, suf[size(starts) - i] AS s, 2 AS kind))")
    pairs = both.select("id", "n", F.explode(F.concat(skip, place)).alias("e")).select("e.p", "e.s", "id", "n", F.col("e.kind").cast("byte").alias("kind"))
    return forward.select("id", "word", "n"), pairs


def neighbours(pairs: DataFrame) -> DataFrame:
    """id, n_near, best (n, minus id) of every word that has a neighbour.

    A group is bounded by the alphabet: one word per skipped letter, one with none.
    """
    groups = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("n", (-F.col("id")).alias("i"), "kind")).alias("m")).filter("size(m) > 1 AND exists(m, x -> x.kind < 2)")
    # One written step keeps the sorted lists from being made in each use.
    groups = groups.select(F.expr("sort_array(filter(m, x -> x.kind < 2), false)").alias("k"), F.expr("filter(m, x -> x.kind = 2)").alias("v"))
    each = groups.select(F.explode(F.concat("k", "v")).alias("u"), "v", F.expr("filter(k, x -> x.kind = 1)").alias("longer"), F.expr("size(k)").alias("same"), F.expr("slice(k, 1, 2)").alias("top"))
    skipped = F.col("u.kind") < 2
    n_near = F.when(skipped, F.col("same") - 1 + F.when(F.col("u.kind") == 1, F.size("v")).otherwise(0)).otherwise(F.size("longer"))
    near = F.when(skipped, F.concat(F.expr("filter(top, x -> x.i != u.i)"), F.when(F.col("u.kind") == 1, F.col("v")).otherwise(F.expr("slice(v, 1, 0)")))).otherwise(F.expr("slice(longer, 1, 1)"))
    best = F.array_max(F.transform(near, lambda x: F.struct(x["n"].alias("n"), x["i"].alias("i"))))
    found = each.select((-F.col("u.i")).alias("id"), n_near.cast("long").alias("n_near"), best.alias("best")).filter("n_near > 0")
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root for links (id, form) without cycles, by doubling."""
    links = materialise(forms.select("id", F.col("form").alias("root")), "links")
    while True:
        step = links.alias("a").join(links.select(F.col("id").alias("at"), F.col("root").alias("on")), F.col("root") == F.col("at"), "left")
        step = materialise(step.select("id", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "links")
        links = step.select("id", "root")
        if step.filter("moved").isEmpty():
            return links


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct ``words`` (word, n)."""
    numbered, pairs = dictionary(words)
    near = neighbours(pairs)
    made = numbered.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best.n") >= factor * F.col("n"), -F.col("best.i")).alias("form_id")
    )
    made = materialise(made, "forms")
    names = numbered.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    last = roots(made.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    last = last.join(numbered.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    out = made.join(names, "form_id", "left").join(last, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus."""
    return variants(materialise(word_counts(docs).filter(F.col("n") >= least_count), "words"))
