"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

DataFrame functions only. A text is cut into paragraphs (lines; a long line into a
first piece and further pieces, so that one edit does not change it whole); the
distinct paragraph digests go into ``3 * WIDTH`` cells, each into one cell of
every third, where a cell keeps their number, the xor of the digests and the xor of
their check hashes. Two sketches are subtracted cell by cell and peeled: a cell with
one digest left names it, and taking it out of its other cells frees more, until
all differing digests are recovered. Where peeling fails, the digests are dealt to
sketches of a larger table (one sketch for each ``SHARE`` expected digests, chosen
by the digest, so that cost stays linear) and tried again, each time larger; what
``ATTEMPTS`` leave over is compared digest by digest.

The likeness of two sketches with n1 and n2 digests and D differing ones is
(n1 + n2 - D) / (n1 + n2 + D), the share of common digests in all.

Defined cases: null texts are empty; an empty text has no digests, two empty ones are
alike (1.0); identical rows count as one document in the order and are all returned;
null ids come first; the only row of a table follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.session import materialise, scratch_path, scratch_scope

WIDTH = 24
ROUNDS = 20
SHARE = 16
ATTEMPTS = 3
#: A paragraph: up to 48 code points at a line's begin, then up to 400 of its rest.
PIECES = r"(?md)^[^\n]{1,48}|[^\n]{1,400}"
RANGE_BYTES = 16 << 20


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda p: F.xxhash64(p)))


def _place(digest: str, third: int, salt: int) -> str:
    source = f"xxhash64({digest}, {salt})" if salt else digest
    return f"pmod(shiftrightunsigned({source}, {13 * third}), {WIDTH}) + {WIDTH * third}"


def sketch(units: str, salt: int = 0) -> str:
    """SQL of the cells of an array of digests: struct of counts, digests and checks."""
    thirds = ", ".join(f"transform(sequence({WIDTH * t}, {WIDTH * (t + 1) - 1}), j -> filter({units}, d -> {_place('d', t, salt)} = j))" for t in range(3))
    cells = f"concat({thirds})"
    made = (
        "named_struct('c', transform(cells, l -> size(l)), 'k', transform(cells, l -> aggregate(l, 0L, (a, d) -> a ^ d)), "
        "'x', transform(cells, l -> aggregate(l, 0L, (a, d) -> a ^ xxhash64(d))))"
    )
    return f"transform(array({cells}), cells -> {made})[0]"


def peel(a: str, b: str, salt: int = 0) -> str:
    """SQL of the peeled difference of two sketches: struct of the cells that are left,
    the digests found (with 1 for those of ``a`` and -1 for those of ``b``), and done."""
    start = (
        f"named_struct('c', zip_with({a}.c, {b}.c, (p, q) -> p - q), 'k', zip_with({a}.k, {b}.k, (p, q) -> p ^ q), "
        f"'x', zip_with({a}.x, {b}.x, (p, q) -> p ^ q), 'found', cast(array() as array<struct<d:bigint,s:int>>), 'stuck', false)"
    )
    pure = (
        f"array_distinct(transform(filter(sequence(0, {3 * WIDTH - 1}), j -> abs(st.c[j]) = 1 AND st.x[j] = xxhash64(st.k[j])), "
        "j -> named_struct('d', st.k[j], 's', st.c[j])))"
    )

    def without(field: str, take: str) -> str:
        thirds = ", ".join(
            f"transform(sequence({WIDTH * t}, {WIDTH * (t + 1) - 1}), j -> aggregate(filter(p, e -> {_place('e.d', t, salt)} = j), st.{field}[j], (v, e) -> {take}))" for t in range(3)
        )
        return f"concat({thirds})"

    step = (
        f"named_struct('c', {without('c', 'v - e.s')}, 'k', {without('k', 'v ^ e.d')}, 'x', {without('x', 'v ^ xxhash64(e.d)')}, "
        "'found', concat(st.found, p), 'stuck', false)"
    )
    stuck = "named_struct('c', st.c, 'k', st.k, 'x', st.x, 'found', st.found, 'stuck', true)"
    turn = f"if(st.stuck, st, transform(array({pure}), p -> if(size(p) = 0, {stuck}, {step}))[0])"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (st, r) -> {turn})"


def clean(peeled: str) -> str:
    """SQL: whether peeling emptied the sketch."""
    return f"(forall({peeled}.c, v -> v = 0) AND forall({peeled}.k, v -> v = 0L))"


def shown(cells: Column) -> Column:
    """A sketch as text: count, digest and check of each cell in hexadecimal."""
    row = F.arrays_zip(cells["c"].alias("c"), cells["k"].alias("k"), cells["x"].alias("x"))
    return F.array_join(F.transform(row, lambda e: F.concat_ws(".", F.hex(e["c"]), F.hex(e["k"]), F.hex(e["x"]))), "-")


def order_of(docs: DataFrame) -> DataFrame:
    """row, next_row, need: each row's successor by ascending id (the first after the
    last) and a quarter of its length. Ids are sorted in ranges; only one row per
    range is compared across ranges."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids = docs.select("row", "doc_id", F.length("text").alias("n")).dropDuplicates(["row"])
    ids = ids.repartitionByRange(max(24, size // RANGE_BYTES + 1), "doc_id", "row").withColumn("part", F.spark_partition_id())
    ids = materialise(ids, "order")
    w = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "row")
    inner = ids.withColumn("next_row", F.lead("row").over(w))
    first = ids.groupBy("part").agg(F.min_by("row", F.struct(F.col("doc_id").isNotNull(), "doc_id", "row")).alias("first_row"))
    # As many rows as there are ranges.
    parts = Window.orderBy("part")
    heads = first.withColumn("head", F.coalesce(F.lead("first_row").over(parts), F.first("first_row").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    out = inner.join(heads.select("part", "head"), "part").select("row", F.coalesce("next_row", "head").alias("next_row"), F.floor(F.col("n") / 4).cast("int").alias("need"))
    return materialise(out, "order")


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a compressed table at ``path``."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _likeness(n1: Column, n2: Column, differing: Column) -> Column:
    return F.when(n1 + n2 == 0, 1.0).otherwise((n1 + n2 - differing) / (n1 + n2 + differing))


def _retried(pairs: DataFrame) -> DataFrame:
    """row, side, differing for pairs (row, side, a, b of digests) whose sketches failed."""
    unit = F.explode(F.concat(F.transform("a", lambda d: F.struct(d.alias("d"), F.lit(True).alias("mine"))), F.transform("b", lambda d: F.struct(d.alias("d"), F.lit(False).alias("mine")))))
    groups = F.greatest(F.lit(1), F.ceil((F.size("a") + F.size("b")) / SHARE)).cast("long")
    units = pairs.select("row", "side", groups.alias("groups"), unit.alias("u")).select("row", "side", "groups", "u.d", "u.mine")
    units = units.withColumn("part", F.lit(0).cast("long"))
    total = None
    for salt in range(1, ATTEMPTS + 1):
        deal = F.pmod(F.xxhash64("d", F.lit(1000 + salt)), F.col("groups"))
        dealt = units.groupBy("row", "side", "groups", F.xxhash64("part", deal).alias("part")).agg(
            F.expr("collect_list(d) FILTER (WHERE mine)").alias("a"), F.expr("collect_list(d) FILTER (WHERE NOT mine)").alias("b")
        )
        cells = dealt.withColumn("sa", F.expr(sketch("a", salt))).withColumn("sb", F.expr(sketch("b", salt)))
        peeled = cells.withColumn("left", F.expr(peel("sa", "sb", salt))).withColumn("ok", F.expr(clean("left")))
        exact = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
        last = salt == ATTEMPTS
        result = peeled.select("row", "side", "groups", "part", "a", "b", F.when(F.col("ok"), F.size("left.found")).otherwise(exact if last else F.lit(None)).alias("differing"))
        result = materialise(result, "peeled")
        sums = result.filter("differing is not null").groupBy("row", "side").agg(F.sum("differing").alias("differing"))
        total = sums if total is None else total.unionByName(sums)
        units = result.filter("differing is null").select("row", "side", F.lit(4).cast("long").alias("groups"), "part", unit.alias("u")).select("row", "side", "groups", "part", "u.d", "u.mine")
    return total.groupBy("row", "side").agg(F.sum("differing").alias("differing"))


def _units(docs: DataFrame, path: str) -> DataFrame:
    """row, doc_id, next_id, n_chars, edited_sha256 and the digests of the text, of the
    edited text and of the next text. Array functions without code generation are copied
    into each use by the optimizer: a written table makes every list once."""
    order = order_of(docs)
    before = order.select(F.col("next_row").alias("row"), F.col("row").alias("to"), "need")
    given = docs.join(before, "row").select("to", "doc_id", F.expr("substring(text, 1, need)").alias("begin"), digests(F.col("text")).alias("next_units"))
    given = given.groupBy(F.col("to").alias("row")).agg(F.first("begin").alias("begin"), F.first("next_units").alias("next_units"), F.first("doc_id").alias("next_id"))
    both = docs.join(given, "row")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.col("begin"))
    units = both.select(
        "row", "doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), digests(F.col("text")).alias("units"), digests(edited).alias("edited_units"), "next_units"
    )
    return _written(units, path)


def _first_round(units: DataFrame, path: str) -> DataFrame:
    """``units`` with sketches, their sizes, the numbers of differing digests (null where
    peeling failed) and, for failed pairs alone, the digests again."""
    cells = units.select("*", *[F.expr(sketch(u)).alias(f"s_{u}") for u in ("units", "edited_units", "next_units")])
    cells = cells.select("row", "doc_id", "next_id", "n_chars", "edited_sha256", "units", "edited_units", "next_units", "s_units", "s_edited_units", "s_next_units")
    differing = {
        side: F.expr(f"transform(array({peel('s_units', f's_{side}_units')}), z -> if({clean('z')}, size(z.found), cast(null as int)))[0]") for side in ("edited", "next")
    }
    first = cells.select(
        "row", "doc_id", "next_id", "n_chars", F.unhex("edited_sha256").alias("edited_sha256"), "s_units", "s_edited_units",
        *[d.alias(f"d_{side}") for side, d in differing.items()], *[F.size(f"{u}").alias(f"n_{u}") for u in ("units", "edited_units", "next_units")],
        *[F.when(differing[side].isNull(), F.array("units", f"{side}_units")).alias(f"again_{side}") for side in ("edited", "next")],
    )
    return _written(first, path)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, next_id for every document row."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    docs = docs.select(F.xxhash64("doc_id", text).alias("row"), "doc_id", text.alias("text"))
    path = scratch_path(spark, "sketches")
    # Tables made on the way go as soon as the next one is written.
    with scratch_scope(spark):
        at = scratch_path(spark, "units")
        with scratch_scope(spark):
            units = _units(docs, at)
        first = _first_round(units, path)
    failed = None
    for side in ("edited", "next"):
        part = first.filter(F.col(f"d_{side}").isNull()).select("row", F.lit(side).alias("side"), F.col(f"again_{side}")[0].alias("a"), F.col(f"again_{side}")[1].alias("b")).dropDuplicates(["row"])
        failed = part if failed is None else failed.unionByName(part)
    more = _retried(failed).groupBy("row").agg(*[F.max(F.when(F.col("side") == s, F.col("differing"))).alias(f"more_{s}") for s in ("edited", "next")])
    out = first.join(more, "row", "left")
    near = {s: _likeness(F.col("n_units"), F.col(f"n_{s}_units"), F.coalesce(f"d_{s}", f"more_{s}")) for s in ("edited", "next")}
    prints = [shown(F.col(f"s_{u}")).alias(name) for u, name in (("units", "fingerprint"), ("edited_units", "edited_fingerprint"))]
    return out.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), *prints, near["edited"].alias("near_edited"), near["next"].alias("near_next"), "next_id")
