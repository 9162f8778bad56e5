"""Near-duplicate documents: sets of word shingles with Jaccard similarity of 0.8 or more.

1. One narrow pass makes each document's set of 4-word shingles, its sketch
   (:mod:`vigil.llm.sketch`) and 32 band keys. Documents with equal sets are one
   class, kept by its smallest id; only classes go on. A pair at 0.8 meets in no
   band with a probability of 0.59 ** 32 = 5e-8.
2. Classes that meet another one in a band exchange their shingles
   (:mod:`vigil.llm.exchange`): ``common`` counts the shingles that any other such
   class has. Two sets with common parts c (the smaller one) cannot reach the
   threshold if 100 c < 80 (n1 + n2 - c); this exact bound removes most chance
   meetings before any set travels.
3. Pairs are confirmed on full sets, never all pairs of a band: first each member
   with the band's leader. Pairs inside one component cannot change the result any
   more, so then the members outside a band's largest component are a query set
   that is compared in blocks with the members of other components; no link is lost.
   A set is shipped once to each place that needs it.

Defined cases: null and empty texts have no shingles and link with nothing; fewer
than 4 words are one shingle; rows are judged one by one, rows with one id share a
node if their sets lead a class; a null id never links and is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import exchange as X
from vigil.llm.components import components
from vigil.llm.frames import fresh
from vigil.llm.sketch import band_keys, sketches
from vigil.llm.words import NOT_SPACE, U64, Words, mix, parts_of, pieces, raw_texts, windows
from vigil.session import kept, materialise, scratch_path, scratch_scope

SHINGLE = 4
PERCENT = 80
#: Sets that one member of the query set is compared with at a time.
PROBED = 64
#: Chunks of documents whose sets share a home when members of components are compared.
CHUNKS_OF_HOME = 8


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for piece in pieces(texts):
        w = Words(texts[piece], NOT_SPACE, lower=True)
        h = w.hashes()
        start, run = windows(h, w.first, size)
        border = np.searchsorted(start, w.first)
        for i in range(len(w.first) - 1):
            n = w.first[i + 1] - w.first[i]
            if n >= size:
                out.append(np.unique(run[border[i] : border[i + 1]]))
            elif n:
                _, whole = windows(h[w.first[i] : w.first[i + 1]], np.array([0, n]), int(n))
                out.append(mix(whole + U64(n)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def _signed(x: np.ndarray) -> int:
    return int(x.astype(np.int64))


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, two longs that name the set, band keys."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    def run(batches):
        for batch in parts_of(batches, "text"):
            sets = shingle_sets(raw_texts(batch.column("text")), size)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            if full:
                first = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])))
                for i, k in zip(full, band_keys(sketches(np.concatenate([sets[i] for i in full]), first))):
                    bands[i] = k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_signed(mix(s).sum()) for s in sets], pa.int64()),
                    pa.array([_signed(np.bitwise_xor.reduce(mix(s + U64(77)))) if len(s) else 0 for s in sets], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, n, data (the packed set) of the given classes."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.select("node"), "node", "left_semi")

    def run(batches):
        for batch in parts_of(batches, "text"):
            sets = shingle_sets(raw_texts(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([X.pack(s) for s in sets], pa.binary())],
                names=["node", "n", "data"],
            )

    return texts.mapInArrow(run, "node long, n long, data binary")


def _common(sets: DataFrame, layout: X.Layout) -> DataFrame:
    """node, common: shingles that another class of ``sets`` has too."""

    def send(key, table):
        cols = [X.unpack(d)[0] for d in table.column("data").to_pylist()]
        h = np.sort(np.concatenate(cols) >> U64(64 - layout.bits))
        if not len(h):
            return X.message("bucket", [], "chunk", [], [])
        at = X.groups(h)
        several = (np.diff(np.append(at, len(h))) > 1).astype(np.uint8)
        return X.to_buckets(key[0].as_py(), layout.bits, layout.buckets, h[at], several)

    def meet(key, table):
        chunks, (h, several) = X.gather(table, np.uint8)
        order = np.argsort(h, kind="stable")
        h, several, chunks = h[order], several[order], chunks[order]
        at = X.groups(h)
        count = np.diff(np.append(at, len(h)))
        shared = np.repeat((count > 1) | (np.bitwise_or.reduceat(several, at) > 0), count)
        return X.answer(key[0].as_py(), chunks[shared], h[shared])

    def count(key, left, told):
        nodes, out = left.column("node"), []
        got = [X.unpack(d)[0] for d in told.column("data").to_pylist()]
        shared = np.sort(np.concatenate(got)) if got else np.zeros(0, dtype=np.uint64)
        for d in left.column("data").to_pylist():
            h = X.unpack(d)[0] >> U64(64 - layout.bits)
            at = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
            out.append(int((shared[at] == h).sum()) if len(shared) else 0)
        return pa.table({"node": nodes, "n": left.column("n"), "common": pa.array(out, pa.int64())})

    by_chunk = sets.select("chunk", "node", "n", "data").groupBy("chunk")
    told = by_chunk.applyInArrow(send, X.TO_BUCKET).groupBy("bucket").applyInArrow(meet, X.TO_CHUNK)
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(count, "node long, n long, common long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; tested in the chunk of a."""
    here = pairs.join(sets.select(F.col("node").alias("a"), F.col("chunk").alias("chunk")).distinct(), "a")
    ship = here.select("chunk", "b").distinct().join(sets.select(F.col("node").alias("b"), "data"), "b")
    asked = here.select("chunk", "a", "b", F.lit(None).cast("binary").alias("data")).unionByName(ship.select("chunk", F.lit(None).cast("long").alias("a"), "b", "data"))

    def test(key, left, right):
        wanted: dict[int, list[int]] = {}
        sent: dict[int, list[bytes]] = {}
        for a, b, data in zip(*(right.column(c).to_pylist() for c in ("a", "b", "data"))):
            if data is None:
                wanted.setdefault(b, []).append(a)
            else:
                sent.setdefault(b, []).append(data)
        need = {a for v in wanted.values() for a in v}
        own: dict[int, list[np.ndarray]] = {}
        for node, data in zip(left.column("node").to_pylist(), left.column("data").to_pylist()):
            if node in need:
                own.setdefault(node, []).append(X.unpack(data)[0])
        links = []
        for b, group in wanted.items():
            for theirs in [X.unpack(d)[0] for d in sent.get(b, [])]:
                for a in group:
                    for mine in own.get(a, []):
                        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                        both = int((theirs[at] == mine).sum())
                        if 100 * both >= percent * (len(mine) + len(theirs) - both):
                            links.append((a, b))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    left = sets.select(F.col("chunk").alias("home"), F.col("node").alias("node"), F.col("data").alias("data"))
    return left.groupBy("home").cogroup(asked.groupBy("chunk")).applyInArrow(test, "a long, b long").distinct()


def _led(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each member with the leader of each of its bands: the member
    whose shingles are the least its own. One pair per member and band."""
    lead = members.groupBy("key").agg(F.min_by(F.struct("node", "n", "common"), F.struct(1 - F.col("common") / F.col("n"), "node")).alias("lead"))
    lead = lead.select("key", *[F.col(f"lead.{c}").alias(f"o_{c}") for c in ("node", "n", "common")])
    c = F.least("common", "o_common")
    possible = (100 * c >= percent * (F.col("n") + F.col("o_n") - c)) & (F.col("node") != F.col("o_node"))
    return members.join(lead, "key").filter(possible).select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (key, node, n, common, component) of different
    components. In a band, those outside its largest component are the query set: each
    is sent, once, to every home that holds members of its bands, and compared there in
    blocks with the members of other components; no pair becomes a row. One link to a
    component is enough, so its other members are skipped."""
    by_part = members.groupBy("key", "component").agg(F.count("*").alias("m"))
    bands = by_part.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("m", "component")).alias("major")).filter("parts > 1")
    open_ = materialise(members.join(bands.select("key", "major"), "key"), "members")
    facts = ("node", "n", "common", "component")
    here = open_.groupBy(*facts).agg(F.collect_list("key").alias("keys"))
    at = sets.select(F.col("node").alias("at_node"), F.col("home").alias("at_home")).distinct()
    homes = open_.join(at, F.col("node") == F.col("at_node")).groupBy("key").agg(F.collect_set("at_home").alias("homes"))
    asking = open_.filter("component <> major").join(homes, "key").groupBy(*facts).agg(F.collect_list("key").alias("keys"), F.array_distinct(F.flatten(F.collect_list("homes"))).alias("homes"))
    stored = sets.select("home", F.col("node").alias("set_node"), "data")
    columns = (*facts, "keys", "data")
    left = stored.join(here, F.col("node") == F.col("set_node")).select(F.col("home").alias("home"), *[F.col(c).alias(c) for c in columns])
    asked = sets.select(F.col("node").alias("set_node"), "data").join(asking, F.col("node") == F.col("set_node"))
    asked = asked.select(F.explode("homes").alias("to_home"), *[F.col(c).alias(c) for c in columns])

    def test(key, mine, queries):
        node, n, common, part = (np.array(mine.column(c).to_pylist(), dtype=np.int64) for c in facts)
        own: list = [None] * len(node)
        packed = mine.column("data").to_pylist()
        index: dict[int, list[int]] = {}
        for i, keys in enumerate(mine.column("keys").to_pylist()):
            for k in keys:
                index.setdefault(k, []).append(i)
        links = []
        for a, an, ac, ap, keys, data in zip(*(queries.column(c).to_pylist() for c in (*facts, "keys", "data"))):
            near = np.array(sorted({i for k in keys for i in index.get(k, ())}), dtype=np.int64)
            c = np.minimum(common[near], ac)
            near = near[(part[near] != ap) & (100 * c >= percent * (n[near] + an - c))]
            ask, done = X.unpack(data)[0], set()
            for begin in range(0, len(near), PROBED):
                block = [i for i in near[begin : begin + PROBED].tolist() if part[i] not in done]
                if not block:
                    continue
                for i in block:
                    if own[i] is None:
                        own[i] = X.unpack(packed[i])[0]
                flat = np.concatenate([own[i] for i in block])
                hit = ask[np.minimum(np.searchsorted(ask, flat), len(ask) - 1)] == flat
                both = np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum([len(own[i]) for i in block])[:-1])))
                for i, x in zip(block, both.tolist()):
                    if part[i] not in done and 100 * x >= percent * (len(own[i]) + len(ask) - x):
                        done.add(int(part[i]))
                        links.append((a, int(node[i])))
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return left.groupBy("home").cogroup(asked.groupBy("to_home")).applyInArrow(test, "a long, b long").distinct()


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and (k1, k2, component_id) of every set."""
    spark = docs.sparkSession
    signed = materialise(signatures(docs, size), "signatures")
    path = scratch_path(spark, "components")
    # What is made on the way is dropped as soon as the components are written.
    with scratch_scope(spark):
        component = kept(_components_of(docs, signed, size, percent), path)
    return signed.select("doc_id", "n_shingles", "k1", "k2"), component


def _components_of(docs: DataFrame, signed: DataFrame, size: int, percent: int) -> DataFrame:
    layout = X.Layout.of(docs)
    named = signed.filter("n_shingles > 0 and doc_id is not null")
    reps = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    spread = reps.select("node", F.posexplode("bands").alias("band", "at")).select("node", F.xxhash64("band", "at").alias("key"))
    met = spread.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    members = materialise(spread.join(met, "key").select("key", "node"), "members")
    chunk = F.pmod(F.xxhash64("node"), F.lit(layout.chunks)).cast("int").alias("chunk")
    home = F.pmod(F.xxhash64("node"), F.lit(max(X.LEAST, layout.chunks // CHUNKS_OF_HOME))).cast("int").alias("home")
    sets = materialise(_sets_of(docs, members.select("node").distinct(), size).select(chunk, home, "*"), "sets")
    common = _common(sets, layout).groupBy("node").agg(F.max("n").alias("n"), F.max("common").alias("common"))
    common = common.filter(100 * F.col("common") >= percent * F.col("n"))
    members = materialise(members.join(common, "node").select("key", "node", "n", "common"), "members")
    links = materialise(_confirmed(materialise(_led(members, percent), "pairs"), sets, percent), "links")
    label = components(links)
    now = members.join(label, "node", "left").withColumn("component", F.coalesce("component", F.col("node")))
    links = links.unionByName(_across(now, sets, percent))
    label = components(links).withColumnRenamed("component", "component_id")
    reps = reps.select("k1", "k2", "node").join(label, "node", "left")
    return reps.select("k1", "k2", F.coalesce("component_id", F.col("node")).alias("component_id"))


def report(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document row."""
    signed, component = classes(docs, size, percent)
    component = component.withColumn("n0", F.lit(False))
    out = signed.withColumn("n0", F.col("n_shingles") == 0).join(component, ["k1", "k2", "n0"], "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", F.col("doc_id")))
    out = out.select("doc_id", "n_shingles", found.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one id of each component, and null ids."""
    goes = report(docs, size, percent).filter(~F.col("kept")).select(F.col("doc_id").alias(fresh("goes", docs.columns))).distinct()
    name = goes.columns[0]
    return docs.join(goes, docs["doc_id"].cast("long") == goes[name], "left_anti")
