"""Corpus building: labels, annotator votes, exact splits, exemplars, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.hashing import digest
from vigil.functions.numeric import ratio

#: Rows of one per stratum or class that are broadcast; beyond, an ordinary join is used.
MAX_BROADCAST_ROWS = 10_000

# Label and split names, polarity, target categories.
LABEL3 = {"hatespeech": 0, "offensive": 1, "normal": 2}
CLASS_NAMES = ["hate", "offensive", "neither/normal"]
SPLIT_ALIASES = {"validation": "val"}
TARGET_CATEGORY = {
    "African": "Race",
    "Arab": "Race",
    "Asian": "Race",
    "Caucasian": "Race",
    "Hispanic": "Race",
    "Indian": "Race",
    "Indigenous": "Race",
    "Buddhism": "Religion",
    "Christian": "Religion",
    "Hindu": "Religion",
    "Islam": "Religion",
    "Jewish": "Religion",
    "Men": "Gender",
    "Women": "Gender",
    "Homosexual": "Sexual Orientation",
    "Heterosexual": "Sexual Orientation",
    "Bisexual": "Sexual Orientation",
    "Disability": "Other",
    "Economic": "Other",
    "Refugee": "Other",
    "Other": "Other",
    "Minority": "Other",
    "None": "None",
}
GROUP_ORDER = ["Race", "Religion", "Gender", "Sexual Orientation", "Other", "None"]


def _lookup(mapping: dict, key: Column) -> Column:
    """Constant-table lookup inside the row; null for an unknown key."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


# --------------------------------------------------------------------- labels
def binarize(label3: Column) -> Column:
    """Polarity flip: class 0 of three is hate, class 1 of two is hate."""
    return (label3 == 0).cast("int")


def map_label3(label: Column, mapping: dict[str, int] | None = None) -> Column:
    return _lookup(mapping or LABEL3, label)


def known_labels(df: DataFrame, label: str, mapping: dict[str, int] | None = None) -> DataFrame:
    return df.filter(F.col(label).isin(*(mapping or LABEL3)))


def target_category(fine: Column, mapping: dict[str, str] | None = None) -> Column:
    return F.coalesce(_lookup(mapping or TARGET_CATEGORY, fine), F.lit("Other"))


# ---------------------------------------------------------------------- votes
def _votes_in_row(votes: Column) -> Column:
    """Most frequent element of an array; ties go to the one that occurs first.

    ``sort_array`` on (count, -first position) keeps the whole vote inside the
    row; a post has a handful of annotators.
    """
    tally = F.transform(
        F.array_distinct(votes),
        lambda v: F.struct(
            F.size(F.filter(votes, lambda w: w == v)).alias("n"),
            (-F.array_position(votes, v)).alias("first"),
            v.alias("vote"),
        ),
    )
    return F.array_max(tally)["vote"]


def majority_label(annotators: Column) -> Column:
    """Majority of ``annotators[].label`` for nested posts; ties: first annotator."""
    return _votes_in_row(F.transform(annotators, lambda a: a["label"]))


def majority_target(annotators: Column) -> Column:
    """Majority over all ``annotators[].target`` entries.

    An empty or missing list votes ``None``; ``None`` wins only without a rival.
    """
    none = F.array(F.lit("None"))
    lists = F.transform(
        annotators,
        lambda a: F.when(F.size(F.coalesce(a["target"], F.array().cast("array<string>"))) == 0, none).otherwise(
            a["target"]
        ),
    )
    named = F.filter(F.flatten(lists), lambda t: t != "None")
    return F.coalesce(_votes_in_row(named), F.lit("None"))


def majority_vote(votes: DataFrame, by: str, vote: str, order: str, weak: str | None = None) -> DataFrame:
    """Majority of a long vote table: by -> winner, n_votes; ties: lowest ``order``.

    Two combinable aggregates, so neither a key nor a vote that holds a third of
    the rows meets a single task. ``weak`` names a vote that wins only alone.
    """
    tally = votes.groupBy(by, vote).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    strong = F.lit(1) if weak is None else (F.col(vote) != weak).cast("int")
    rank = F.struct(strong.alias("s"), F.col("_n"), (-F.col("_first")).alias("f"))
    return tally.groupBy(by).agg(
        F.max_by(F.col(vote), rank).alias("winner"),
        F.max_by(F.col("_n"), rank).alias("n_votes"),
    )


def few_values(df: DataFrame, column: Column):
    """Hint for tables with a row per value of ``column``: a broadcast if ``df`` has few
    values; a caller's column may have more than classes, and then an ordinary join is right."""
    few = df.select(column.alias("v")).distinct().limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    return F.broadcast if few else (lambda table: table)


# --------------------------------------------------------------------- splits
def stratified_split(
    df: DataFrame,
    key: str,
    stratum: str,
    shares: tuple[float, float] = (0.8, 0.9),
    salt: str = ":split",
    prefix_digits: int = 4,
) -> DataFrame:
    """Exact train/val/test shares within every stratum, by hash order.

    The row at position floor(share * n) of the hash order is the cut. It is found
    without sorting a stratum: a histogram over the leading hex digits of the
    hash tells in which of 65,536 equal slices the cut falls, and only those two
    slices per stratum are ranked. Hashes of distinct keys are uniform, so no
    slice is hot. The rows themselves are compared with the cuts in a narrow
    pass; the broadcast cut table has one row per class.
    """
    h = digest(F.col(key), salt)
    name = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    hint = few_values(df, name)
    ids = df.select(name.alias("_s"), h.alias("_h")).withColumn(
        "_slice", F.substring("_h", 1, prefix_digits)
    )
    histogram = ids.groupBy("_s", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_s")
    upto = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    placed = histogram.select(
        "_s", "_slice", "_n", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(whole).alias("_size")
    )
    cuts = F.array(*[F.struct(F.lit(n).alias("cut"), F.lit(s).alias("share")) for n, s in zip(("a", "b"), shares)])
    targets = (
        placed.select("*", F.inline(cuts))
        # The small constant keeps an exact product from falling below its integer.
        .withColumn("_rank", F.floor(F.col("share") * F.col("_size") + 1e-9))
        .filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
        .select("_s", "_slice", "cut", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )
    inside = Window.partitionBy("_s", "_slice", "cut").orderBy("_h")
    found = (
        ids.join(hint(targets), ["_s", "_slice"])
        .withColumn("_at", F.row_number().over(inside))
        .filter(F.col("_at") == F.col("_rank"))
        .groupBy("_s")
        .agg(
            F.max(F.when(F.col("cut") == "a", F.col("_h"))).alias("_a"),
            F.max(F.when(F.col("cut") == "b", F.col("_h"))).alias("_b"),
        )
    )
    part = (
        F.when(F.col("_h") <= F.col("_a"), "train").when(F.col("_h") <= F.col("_b"), "val").otherwise("test")
    )
    return (
        df.withColumn("_h", h)
        .withColumn("_s", name)
        .join(hint(found), "_s", "left")
        .withColumn("split", part)
        .drop("_h", "_s", "_a", "_b")
    )


def official_split(df: DataFrame, split_ids: DataFrame, key: str) -> DataFrame:
    """Join rows with a (split, key) table; ``validation`` is stored as ``val``.

    Ids that the corpus lacks vanish, rows of no split vanish.
    """
    named = split_ids.select(key, split_name(F.col("split")).alias("split")).distinct()
    return df.join(named, key)


def split_name(raw: Column) -> Column:
    return F.coalesce(_lookup(SPLIT_ALIASES, raw), raw)


def leaked_ids(splits: DataFrame, key: str) -> DataFrame:
    """Ids that occur in more than one split (empty when the splits are sound)."""
    return (
        splits.groupBy(key)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .filter(F.col("first_split") != F.col("last_split"))
    )


def split_columns(df: DataFrame, split: str, three_way: bool = False) -> DataFrame:
    """One split as (doc_id, text, y)."""
    return df.filter(F.col("split") == split).select(
        "doc_id", "text", F.col("label3" if three_way else "label").alias("y")
    )


def seeded(run_name: str, seed: int | None, default: int = 42) -> tuple[str, str]:
    """Run name and hash salt for a seed; another seed than the default is in the name."""
    if seed is None:
        return run_name, f":{default}"
    return f"{run_name}_s{seed}", f":{seed}"


# ------------------------------------------------------------------- sampling
def fewshot_examples(df: DataFrame, key: str = "doc_id", k: int = 4, seed: int = 42) -> DataFrame:
    """k/2 positives and the rest negatives in hash order, then shuffled by hash.

    ``row_number() <= constant`` is turned into a limit per class before the
    exchange, so at most k rows per class and task are shuffled.
    """
    positives = max(1, k // 2)
    order = Window.partitionBy("label").orderBy(digest(F.col(key), f":shot:{seed}"), key)
    top = (
        df.filter(F.col("label").isin(0, 1))
        .withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= max(positives, k - positives))
        .filter(F.col("_rn") <= F.when(F.col("label") == 1, positives).otherwise(k - positives))
    )
    # At most k rows are left, so one window over all of them is bounded.
    mix = Window.partitionBy(F.lit(0)).orderBy(digest(F.col(key), f":mix:{seed}"), key)
    return top.withColumn("position", F.row_number().over(mix)).drop("_rn")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """label -> n, weight = n_total / (K * n_class); one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class: the window sees K rows.
    whole = Window.partitionBy(F.lit(0))
    return counts.select(
        label,
        "n",
        ratio(F.sum("n").over(whole), F.count(F.lit(1)).over(whole) * F.col("n")).alias("weight"),
    )


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight``; the broadcast table has one row per class."""
    weights = balanced_weights(df, label).select(label, "weight")
    return df.join(few_values(df, F.col(label))(weights), label)
