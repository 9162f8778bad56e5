"""Language of web pages: Bayesian fusion of text, declared language, address and host.

* Text: a naive Bayes model over hashed byte trigrams, counted over ALL labelled texts
  (sums per task, then per language and bucket by a
  grouped aggregation that combines before it shuffles). The
  likelihood of a page is tempered to that of ``EVIDENCE`` trigrams at most, because
  neighbouring trigrams are not independent.
* Declared: the ``lang`` attribute of the markup's html tag, wherever on the page that
  stands outside comments and scripts, and a language code in the path. How
  far to trust each is counted over all pages that have one, against the text.
* Host: a page's prior is its host's share of languages, smoothed by that of its
  address suffix, which is smoothed by that of all pages. The shares are sums of the
  pages' own posteriors by grouped aggregation, without the page itself.

Host rows are sent to ``SALTS`` parts of a host's pages, so that a host with a third
of all pages is no hot key; pages travel without their markup.

Defined cases: null and empty pages have no text evidence and get the fused prior; a
null or strange address has host and suffix ''; an unknown declared language is no
evidence; repeated rows are judged one by one; without labelled texts the language
is null; more than 256 labels raise a ``ValueError``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.html_text import _CLOSE, _TOKEN, blocks, main_text, train
from vigil.llm.words import LOWER, U64, mix, pieces, raw_texts
from vigil.session import materialise

BUCKETS = 1 << 15
EVIDENCE = 60
#: Pseudo-counts of pages by which a level of the hierarchy leans on the one above it.
LEAN = 5.0
SALTS = 16
#: More labels than this are no languages.
MOST_LANGUAGES = 256

_KEEP = np.ones(256, dtype=bool)
_KEEP[:0x41] = False
_KEEP[0x5B:0x61] = False
_KEEP[0x7B:0x80] = False
#: The attribute named lang itself, behind whole other attributes.
_DECLARED = re.compile(r"""<html(?:\s+|/)(?:(?!lang\s*=)[^\s"'>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?(?:\s+|/))*?lang\s*=\s*["']?\s*([A-Za-z]{2,3})\b""", re.I)
_HTML = re.compile(r"<html\b", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)([^?#]*)", re.I)


def trigrams(text: bytes) -> np.ndarray:
    """Hash buckets of the byte trigrams of a text's letters, runs of others as one space."""
    raw = LOWER[np.frombuffer(text, dtype=np.uint8)]
    kept = _KEEP[raw]
    raw = np.where(kept, raw, 0x20)
    raw = raw[kept | np.concatenate(([True], kept[:-1]))]
    raw = np.concatenate(([0x20], raw, [0x20])).astype(np.uint64)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64)
    return (mix(raw[:-2] << U64(16) | raw[1:-1] << U64(8) | raw[2:]) % U64(BUCKETS)).astype(np.int64)


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log probabilities of the trigram buckets, from (text, lang)."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(raw_texts(batch.column("text")), batch.column("lang").to_pylist()):
                if lang not in totals:
                    if len(totals) == MOST_LANGUAGES:
                        raise ValueError(f"more than {MOST_LANGUAGES} labels in column lang")
                    totals[lang] = np.zeros(BUCKETS, dtype=np.int64)
                for at in range(0, len(text), 1 << 20):
                    totals[lang] += np.bincount(trigrams(text[at : at + (1 << 20) + 2]), minlength=BUCKETS)
        for lang, n in totals.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(met), pa.string()), pa.array(met, pa.int32()), pa.array(n[met])], names=["lang", "bucket", "n"])

    # Never more than languages x BUCKETS rows, however many tasks and texts there are.
    counted = labelled.filter("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = summed.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("n")).collect()
    langs = sorted({r[0] for r in rows})
    n = np.zeros((len(langs), BUCKETS))
    for lang, counts in rows:
        n[langs.index(lang), [c[0] for c in counts]] = [c[1] for c in counts]
    return langs, np.log((n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))


def address(url: str | None) -> tuple[str, str, list[str]]:
    """Host, suffix (its last label) and the parts of the path."""
    m = _HOST.match(url or "")
    if not m:
        return "", "", []
    host = m[1].lower().rstrip(".")
    return host, host.rpartition(".")[2], [p.lower() for p in m[2].split("/") if p]


def declared_language(page: str) -> str | None:
    """Language code of the first html tag that has one, wherever on the page it stands.
    Comments hold no tags, nor do scripts, styles and other raw elements."""
    if not _HTML.search(page):
        return None
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        if found := _DECLARED.match(m[0]):
            return found[1].lower()
        name = (m[2] or "").lower()
        # The head's own elements are read one by one.
        if name in _CLOSE and name != "head" and not m[1] and not m[3].endswith("/"):
            stop = _CLOSE[name].search(page, at)
            at = stop.end() if stop else (len(page) if name in ("script", "style") else at)
    return None


def evidence(pages: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, url, host, suffix, declared, in_path, text (log likelihoods, tempered)."""
    shared = pages.sparkSession.sparkContext.broadcast((logs, train()))
    known = set(langs)

    def run(batches):
        table, tree = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                host, suffix, path = address(url)
                declared = declared_language(page) if page else None
                text = (main_text(page, tree) or " ".join(b.text for b in blocks(page))) if page else ""
                total, n = np.zeros(len(langs)), 0
                raw = text.encode()
                for at in range(0, len(raw), 1 << 20):
                    g = trigrams(raw[at : at + (1 << 20) + 2])
                    total += table[:, g].sum(axis=1)
                    n += len(g)
                total *= min(1.0, EVIDENCE / max(1, n))
                for c, v in zip(cols, (host, suffix, declared if declared in known else None, next((p for p in path if p in known), None), (total - total.max()).tolist())):
                    c.append(v)
            kinds = [pa.string()] * 4 + [pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["page_id", "url", "host", "suffix", "declared", "in_path", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, host string, suffix string, declared string, in_path string, text array<double>")


def _normal(logs: str) -> str:
    """SQL: probabilities of an array of log weights."""
    return f"transform(array(transform({logs}, v -> exp(v - array_max({logs})))), w -> transform(w, v -> v / aggregate(w, 0D, (a, b) -> a + b)))[0]"


def identify(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, url, host, lang, probability, text_lang, declared of every page row."""
    langs, logs = fit(labelled)
    pages = pages.select("page_id", "url", "html")
    if not langs:
        nothing = F.lit(None).cast("string")
        return pages.select("page_id", "url", nothing.alias("host"), nothing.alias("lang"), F.lit(None).cast("double").alias("probability"), nothing.alias("text_lang"), nothing.alias("declared"))
    names = F.array(*[F.lit(x) for x in langs])
    seen = materialise(evidence(pages, langs, logs).withColumn("soft", F.expr(_normal("text"))), "evidence")
    best = F.expr("array_position(text, array_max(text))").cast("int")
    clear = F.expr("array_max(soft)") > 0.9
    trust = {}
    agreed = seen.agg(*[F.struct(F.sum((clear & (F.col(c) == F.element_at(names, best))).cast("long")), F.sum((clear & F.col(c).isNotNull()).cast("long"))).alias(c) for c in ("declared", "in_path")]).first()
    for c in ("declared", "in_path"):
        trust[c] = ((agreed[c][0] or 0) + 1) / ((agreed[c][1] or 0) + 2)
    weight = "text"
    for c in ("declared", "in_path"):
        right, wrong = float(np.log(trust[c])), float(np.log((1 - trust[c]) / max(1, len(langs) - 1)))
        sure = ", ".join(f"if({c} = '{x}', {right}D, {wrong}D)" for x in langs)
        weight = f"if({c} IS NULL, {weight}, zip_with({weight}, array({sure}), (p, q) -> p + q))"
    page = seen.withColumn("weight", F.expr(weight)).withColumn("own", F.expr(_normal("weight")))
    page = materialise(page.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")), "evidence")
    sums = lambda of: [F.sum(F.col(of)[i]).alias(f"s{i}") for i in range(len(langs))]
    packed = F.array(*[F.col(f"s{i}") for i in range(len(langs))])
    by_host = page.groupBy("suffix", "host").agg(*sums("own")).select("suffix", "host", packed.alias("h"))
    by_suffix = by_host.groupBy("suffix").agg(*sums("h")).select("suffix", packed.alias("x"))
    everything = by_suffix.agg(*sums("x")).first()
    total = [float(v or 0.0) for v in everything]
    every = "array(" + ", ".join(f"{v!r}D" for v in total) + ")"

    def share(counts: str, above: str) -> str:
        return f"zip_with({counts}, {above}, (p, q) -> (p + {LEAN}D * q) / (aggregate({counts}, 0D, (a, b) -> a + b) + {LEAN}D))"

    def less(counts: str) -> str:
        """Counts without the page itself."""
        return f"zip_with({counts}, own, (p, q) -> greatest(p - q, 0D))"

    prior = by_host.join(by_suffix, "suffix").select("host", "suffix", "h", "x", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    met = page.join(prior, ["host", "suffix", "salt"])
    flat = "array(" + ", ".join([f"{1 / len(langs)!r}D"] * len(langs)) + ")"
    met = met.withColumn("g", F.expr(less(every))).withColumn("x0", F.expr(less("x"))).withColumn("h0", F.expr(less("h")))
    met = met.withColumn("p0", F.expr(share("g", flat))).withColumn("p1", F.expr(share("x0", "p0"))).withColumn("p2", F.expr(share("h0", "p1")))
    met = met.withColumn("fused", F.expr(_normal("zip_with(weight, p2, (p, q) -> p + ln(q))")))
    top = F.expr("array_max(fused)")
    known = F.expr("exists(text, v -> v < 0D)")
    return met.select(
        "page_id", "url", "host", F.element_at(names, F.expr("array_position(fused, array_max(fused))").cast("int")).alias("lang"), top.alias("probability"),
        F.when(known, F.element_at(names, best)).alias("text_lang"), "declared",
    )
