"""Readers and writers of the corpus, cache and metrics files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.text import clean_nonempty
from vigil.operators.corpus import binarize, known_labels, majority_label, map_label3, split_name
from vigil.session import scratch_path

# The fields of the public corpus, cache and metrics files.
ANNOTATOR = "struct<label:string,target:array<string>>"
POST = f"struct<post_tokens:array<string>,annotators:array<{ANNOTATOR}>>"
RESPONSE = (
    "struct<label:int,p_hate:double,raw:string,input_tokens:long,output_tokens:long,"
    "cost_usd:double,errored:boolean,error:string>"
)
METRICS_SCHEMA = (
    "accuracy double, precision double, recall double, f1_binary double, f1_macro double, "
    "f1_weighted double, roc_auc double, confusion array<array<long>>, "
    "f1_per_class array<double>, precision_per_class array<double>, recall_per_class array<double>, "
    "class_names array<string>"
)
METRICS_FILE = "metrics.json"


# ------------------------------------------------------------------- corpora
def read_csv_corpus(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the columns ``class`` and ``tweet``, bound by header name -> text, label,
    label3; rows with an empty class or tweet are dropped, a class that is no number fails.

    Other columns may stand before, between and after; all files share one header. Quoted line breaks force one task
    per file (the format cannot be split); large corpora should arrive as many files.
    """
    form = {"header": True, "multiLine": True, "escape": '"'}
    raw = spark.read.csv(path, **form)
    absent = {"class", "tweet"} - set(raw.columns)
    if absent:
        raise ValueError(f"{path}: no column {', '.join(sorted(absent))} in {raw.columns}")
    if not any(re.fullmatch(r"_c\d+", c) for c in raw.columns):
        # Spark then compares every file's header; it cannot where a column has no name.
        raw = spark.read.csv(path, schema=raw.schema, enforceSchema=False, **form)
    number = F.col("class").try_cast("double").try_cast("int")
    label3 = F.when(number.isNull() & F.col("class").isNotNull(), F.raise_error(F.concat(F.lit("class is no number: "), "class"))).otherwise(number)
    return unify_labels(raw.select(label3.cast("int").alias("label3"), F.col("tweet").alias("text"))).dropna(subset=["text", "label", "label3"])


def unify_labels(df: DataFrame) -> DataFrame:
    extra = [c for c in df.columns if c not in ("text", "label", "label3")]
    return df.withColumn("label", binarize(F.col("label3"))).select(*extra, "text", "label", "label3")


def write_csv_corpus(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"', quoteAll=True)


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """``value``: whole files, or their non-blank lines."""
    return spark.read.text(path, wholetext=not lines).filter(F.trim("value") != "")


def _parsed(doc: Column, kind: str) -> Column:
    """``doc`` as JSON of that kind; what does not parse ends the job."""
    value = F.from_json(doc, T._parse_datatype_string(kind), {"mode": "FAILFAST"})
    broken = F.raise_error(F.concat(F.lit("no readable JSON: "), F.substring(doc, 1, 80)))
    return F.coalesce(value, broken.cast(kind))


def read_posts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON objects ``{post_id: post}`` -> post_id, post_tokens, annotators.

    By default each file is one document, however it is indented; a file is then read
    by one task. ``lines=True`` reads one object per line, which splits over tasks:
    :func:`posts_to_lines` converts a large corpus once. A broken document fails.
    """
    return parse_posts(_documents(spark, path, lines), F.col("value"))


def parse_posts(df: DataFrame, doc: Column) -> DataFrame:
    posts = _parsed(doc, f"map<string,{POST}>")
    return df.select(F.explode(posts).alias("post_id", "post")).select("post_id", "post.*")


def posts_to_lines(posts: DataFrame, path: str) -> None:
    """Posts as one ``{post_id: post}`` object per line."""
    post = F.struct("post_tokens", "annotators")
    posts.select(F.to_json(F.create_map("post_id", post)).alias("value")).write.text(path)


def unify_posts(posts: DataFrame) -> DataFrame:
    """post_id, text, label, label3 by majority vote; unknown majorities are dropped."""
    voted = known_labels(posts.withColumn("majority", majority_label(F.col("annotators"))), "majority")
    label3 = map_label3(F.col("majority"))
    return voted.select(
        "post_id",
        F.array_join("post_tokens", " ").alias("text"),
        binarize(label3).alias("label"),
        label3.alias("label3"),
    )


def read_split_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``{split: [post ids]}`` JSON, a document per file or per line -> split, post_id."""
    return parse_split_map(_documents(spark, path, lines), F.col("value"))


def parse_split_map(df: DataFrame, doc: Column) -> DataFrame:
    splits = _parsed(doc, "map<string,array<string>>")
    lists = df.select(F.explode(splits).alias("split", "ids"))
    return lists.select(split_name(F.col("split")).alias("split"), F.explode("ids").alias("post_id"))


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per dataset and split, so that readers prune by path."""
    df.write.partitionBy("dataset", "split").parquet(path)


def read_splits(
    spark: SparkSession, path: str, dataset: str | None = None, split: str | None = None, preprocess: bool = True
) -> DataFrame:
    """Prepared corpus; ``dataset`` and ``split`` prune partitions before any file is opened."""
    df = spark.read.parquet(path)
    if dataset is not None:
        df = df.filter(F.col("dataset") == dataset)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return clean_nonempty(df) if preprocess else df


# --------------------------------------------------------------------- cache
def append_cache(entries: DataFrame, path: str) -> None:
    """Append (key, response) rows as JSON lines that number themselves: every line's
    ``seq`` is above all earlier ones of the log. A given ``seq`` is kept."""
    if "seq" not in entries.columns:
        last = _last_number(entries.sparkSession, path)
        entries = entries.withColumn("seq", F.lit(last + 1) + F.monotonically_increasing_id())
    entries.select("seq", "key", "response").write.mode("append").json(path)


def _last_number(spark: SparkSession, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return -1
    last = read_cache_log(spark, path).agg(F.max("seq")).first()[0]
    return -1 if last is None else last


def read_cache_log(spark: SparkSession, path: str) -> DataFrame:
    """All readable lines of the cache log: seq, at, key, response.

    ``at`` is the line's place (file time, file, split, line of the split), by which
    lines without a ``seq`` are ordered. Blank and broken lines and lines without key or
    response are skipped; a response written as null stays, as an answer that is none.
    """
    schema = f"seq long, key string, response {RESPONSE}, _corrupt_record string"
    files = spark.read.text(path).select("value", "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start")
    at = F.struct(
        F.col("file_modification_time").alias("time"),
        F.col("file_path").alias("file"),
        F.col("file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
    )
    lines = files.select("value", at.alias("at")).filter(F.trim("value") != "")
    parsed = F.from_json(
        "value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    emptied = F.col("value").rlike(r'"response"\s*:\s*null\s*[,}]')
    return (
        lines.select("at", "value", parsed.alias("line"))
        .select("line.seq", "at", "line.key", "line.response", "line._corrupt_record", "value")
        .filter(F.col("_corrupt_record").isNull() & F.col("key").isNotNull() & (F.col("response").isNotNull() | emptied))
        .drop("_corrupt_record", "value")
    )


# ------------------------------------------------------------------- metrics
def write_metrics(metrics: DataFrame, path: str, run: str = "run_name") -> None:
    """One indented ``<path>/<run>/metrics.json`` per row; ``run`` names the folder.

    Spark writes the rows to a scratch folder; their files, one per run, then get the
    public name. Runs are few: a row is an experiment.
    """
    spark = metrics.sparkSession
    made = scratch_path(spark, "metrics")
    fields = F.struct(*[c for c in metrics.columns if c != run])
    rows = metrics.select(run, F.to_json(fields, {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))
    rows.write.partitionBy(run).text(made)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(Path(f"{made}/{run}=*/part-*")):
        file = status.getPath()
        folder = Path(path, file.getParent().getName().split("=", 1)[1])
        fs.mkdirs(folder)
        target = Path(folder, METRICS_FILE)
        fs.delete(target, False)
        if not fs.rename(file, target):
            raise OSError(f"{file} could not be moved to {target}")


def read_run_folders(spark: SparkSession, path: str, schema: str = METRICS_SCHEMA) -> DataFrame:
    """All ``metrics.json`` files below ``path`` as one table, keyed by their run folder.

    The folder is ``<model>_<dataset>[_zeroshot|_fewshot][_3way][_s<seed>]``; seed 42 has
    no suffix. A run without a file is simply absent; a file without accuracy fails.
    """
    folder = F.regexp_extract("file_path", r"([^/=]+)/[^/]*$", 1)
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", METRICS_FILE)
    files = reader.json(path, multiLine=True)
    named = files.select("*", F.col("_metadata.file_path")).withColumn("run_name", folder)
    broken = F.raise_error(F.concat(F.lit("no metrics in "), "file_path")).cast("double")
    named = named.withColumn("accuracy", F.coalesce("accuracy", broken)).drop("file_path")
    return named.withColumns(run_key_columns(F.col("run_name")))


def run_key_columns(run: Column) -> dict[str, Column]:
    pattern = r"^([^_]+)_(.+?)(?:_(zeroshot|fewshot))?(_3way)?(?:_s(\d+))?$"
    seed = F.regexp_extract(run, pattern, 5)
    return {
        "model": F.regexp_extract(run, pattern, 1),
        "dataset": F.regexp_extract(run, pattern, 2),
        "regime": F.nullif(F.regexp_extract(run, pattern, 3), F.lit("")),
        "task": F.when(F.regexp_extract(run, pattern, 4) != "", "multiclass").otherwise("binary"),
        "seed": F.coalesce(seed.try_cast("int"), F.lit(42)),
    }
