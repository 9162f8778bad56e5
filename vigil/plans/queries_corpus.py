"""Registered queries: sources and sinks, splits, sampling, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.hashing import uniform
from vigil.operators import corpus as C
from vigil.operators import metrics as M
from vigil.operators import responses as R
from vigil.operators import sweeps as S
from vigil.operators.report import MODELS, fixed, grid
from vigil.plans import sql as Q
from vigil.plans import tables as T
from vigil.plans.queries_text import _MAP3, _VOTED, clean_sql
from vigil.plans.registry import query
from vigil.plans.rounding import rounded
from vigil.session import scratch_path
from vigil.sources import files as FS


# ------------------------------------------------------------------- sources
@query(
    "src_csv_unify",
    f"""WITH {T.CORPUS} SELECT text, (label3 = 0)::INTEGER AS label, label3 FROM corpus
        WHERE doc_id % 9 <> 0""",
)
def src_csv_unify(spark, sf_dir):
    """The corpus written as raw CSV in the public column order (an unnamed index and
    annotator counts before class and tweet; some classes empty), then read back."""
    path = scratch_path(spark, "csv")
    some = F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("label3"))
    votes = [F.lit(3).alias("count"), *[(F.col("label3") == i).cast("int").alias(n) for i, n in enumerate(("hate_speech", "offensive_language", "neither"))]]
    raw = T.corpus(spark, sf_dir).select(F.col("doc_id").alias("_c0"), *votes, some.alias("class"), F.col("text").alias("tweet"))
    FS.write_csv_corpus(raw, path)
    return FS.read_csv_corpus(spark, path)


@query(
    "src_json_posts",
    f"""WITH {_VOTED} SELECT post_id, array_to_string(post_tokens, ' ') AS text,
        ({_MAP3} = 0)::INTEGER AS label, {_MAP3} AS label3
        FROM voted WHERE majority IN ('hatespeech', 'offensive', 'normal')""",
)
def src_json_posts(spark, sf_dir):
    """Posts written as indented documents ``{id: post, ...}`` of at most 1000 posts,
    one document per file, read back and unified by majority."""
    path = scratch_path(spark, "posts")
    part = F.floor(F.substring("post_id", 5, 20).cast("long") / 1000).alias("part")
    entry = F.struct("post_id", F.struct("post_tokens", "annotators"))
    posts = F.map_from_entries(F.collect_list(entry))
    _write_documents(T.posts(spark, sf_dir).groupBy(part).agg(posts.alias("doc")), path)
    return FS.unify_posts(FS.read_posts(spark, path))


def _write_documents(docs, path):
    """One file with one indented JSON document for each row (part, doc)."""
    docs.select("part", F.to_json("doc", {"pretty": "true"}).alias("value")).write.partitionBy("part").text(path)


def split_ids(spark, sf_dir):
    """Official split map derived from the documents: ids bucketed by hash."""
    u = uniform(F.col("doc_id"), ":official")
    name = F.when(u < 0.7, "train").when(u < 0.85, "validation").when(u < 0.95, "test").otherwise(None)
    ids = F.concat(F.lit("post"), F.col("doc_id").cast("string"))
    return T.read(spark, sf_dir, "documents").select(name.alias("split"), ids.alias("post_id")).dropna()


_U = T.u_sql("doc_id || ':official'")
SPLIT_IDS = f"""split_ids AS (
  SELECT CASE WHEN {_U} < 0.7 THEN 'train' WHEN {_U} < 0.85 THEN 'val' ELSE 'test' END AS split,
         'post' || doc_id AS post_id
  FROM documents WHERE {_U} < 0.95)"""


@query("src_split_map", f"WITH {SPLIT_IDS} SELECT split, post_id FROM split_ids")
def src_split_map(spark, sf_dir):
    """``{split: [ids], ...}`` written as indented documents for 1000 ids each, read back."""
    path = scratch_path(spark, "splits")
    part = F.floor(F.substring("post_id", 5, 20).cast("long") / 1000).alias("part")
    lists = split_ids(spark, sf_dir).groupBy(part, "split").agg(F.collect_list("post_id").alias("ids"))
    whole = F.map_from_entries(F.collect_list(F.struct("split", "ids")))
    _write_documents(lists.groupBy("part").agg(whole.alias("doc")), path)
    return FS.read_split_map(spark, path)


PREPARED = f"""{T.CORPUS}, prepared AS (
  SELECT *, CASE WHEN {T.u_sql("doc_id || ':part'")} < 0.8 THEN 'train' WHEN {T.u_sql("doc_id || ':part'")} < 0.9
         THEN 'val' ELSE 'test' END AS split FROM corpus)"""


def prepared(spark, sf_dir):
    u = uniform(F.col("doc_id"), ":part")
    split = F.when(u < 0.8, "train").when(u < 0.9, "val").otherwise("test")
    return T.corpus(spark, sf_dir).select("doc_id", "dataset", split.alias("split"), "text", "label", "label3")


@query(
    "src_parquet_split",
    f"WITH {PREPARED} SELECT doc_id, dataset, split, {clean_sql('text')} AS text, label, label3 FROM prepared WHERE dataset = 'A' AND split = 'test'",
)
def src_parquet_split(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    FS.write_splits(prepared(spark, sf_dir), path)
    return FS.read_splits(spark, path, "A", "test").select("doc_id", "dataset", "split", "text", "label", "label3")


@query(
    "sink_parquet_split",
    f"WITH {PREPARED} SELECT dataset, split, count(*) AS n, sum(label)::BIGINT AS n_hate FROM prepared GROUP BY ALL",
)
def sink_parquet_split(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    FS.write_splits(prepared(spark, sf_dir), path)
    written = FS.read_splits(spark, path, preprocess=False)
    return written.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_hate"))


def _broken_lines(log):
    broken = F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.concat(F.lit('{"key": "'), "key", F.lit('", "respo')))
    return log.filter(F.col("doc_id") % 5 == 0).select(broken.alias("value"))


@query(
    "src_jsonl_cache",
    f"WITH {T.CACHE} SELECT key, label, p_hate, raw, input_tokens, output_tokens, round(cost_usd, 12) AS cost_usd, CASE WHEN errored THEN true END AS errored, error FROM entries",
)
def src_jsonl_cache(spark, sf_dir):
    """A log in the public layout, lines of key and response without a number, with
    blank and broken lines: the last line of a key wins. All lines of a key are in one
    file, in the order of their calls."""
    path = scratch_path(spark, "cache")
    log = T.cache_log(spark, sf_dir)
    ordered = log.repartition("key").sortWithinPartitions("key", "seq")
    ordered.select(F.to_json(F.struct("key", "response")).alias("value")).write.text(path)
    _broken_lines(log).write.mode("append").text(path)
    entries = R.latest_entries(FS.read_cache_log(spark, path))
    return entries.select("key", "response.*").withColumn("cost_usd", F.round("cost_usd", 12))


@query("sink_jsonl_cache", f"WITH {T.CACHE} SELECT seq % 2 = 1 AS later, key, p_hate, raw FROM log")
def sink_jsonl_cache(spark, sf_dir):
    """Two appends that number their own lines: the second's numbers are all above the first's."""
    path = scratch_path(spark, "cache")
    log = T.cache_log(spark, sf_dir)
    FS.append_cache(log.filter(F.col("seq") % 2 == 0).drop("seq"), path)
    last = FS.read_cache_log(spark, path).agg(F.max("seq").alias("last"))
    FS.append_cache(log.filter(F.col("seq") % 2 == 1).drop("seq"), path)
    _broken_lines(log).write.mode("append").text(path)
    lines = FS.read_cache_log(spark, path).crossJoin(F.broadcast(last.limit(1)))
    return lines.select((F.col("seq") > F.col("last")).alias("later"), "key", "response.p_hate", "response.raw")


RUNS_SQL = f"""{T.CORPUS}, {T.scored_sql('', 's42')}, {T.scored_sql('7', 's7')}, {T.scored_sql('1337', 's1337')},
scored AS (SELECT 42 AS seed, * FROM s42 UNION ALL SELECT 7, * FROM s7 UNION ALL SELECT 1337, * FROM s1337),
tests AS (
  SELECT 'tfidf' AS model, dataset, seed, label, p1 AS p FROM scored WHERE split = 'test'
  UNION ALL SELECT 'verifier', dataset, seed, label, p2 FROM scored WHERE split = 'test' AND NOT (seed = 7 AND dataset = 'B'))"""


def test_scores(spark, sf_dir):
    """model, dataset, seed, label, p: test scores of two models under three seeds, one cell missing."""
    seeds = None
    for seed, salt in ((42, ""), (7, "7"), (1337, "1337")):
        s = T.scored(spark, sf_dir, salt).filter(F.col("split") == "test").withColumn("seed", F.lit(seed))
        seeds = s if seeds is None else seeds.unionByName(s)
    # Both scores of a row in one pass over the corpus.
    both = F.array(
        F.struct(F.lit("tfidf").alias("model"), F.col("p1").alias("p")),
        F.struct(F.lit("verifier").alias("model"), F.col("p2").alias("p")),
    )
    rows = seeds.select("dataset", "seed", "label", F.inline(both))
    return rows.filter(~((F.col("model") == "verifier") & (F.col("seed") == 7) & (F.col("dataset") == "B")))


RUN_KEYS = ["model", "dataset", "seed"]
RUN_METRICS = f"{RUNS_SQL}, {Q.evaluated('runs', 'tests', RUN_KEYS, 'label', 'p')}"


def run_metrics(spark, sf_dir):
    """One metrics row per model, dataset and seed."""
    return M.evaluate(test_scores(spark, sf_dir), RUN_KEYS, "label", "p")


def _written_runs(spark, sf_dir, regimes=False):
    """Metric files in the run-folder layout ``<model>_<dataset>[_<regime>][_s<seed>]/metrics.json``."""
    path = scratch_path(spark, "runs")
    runs = run_metrics(spark, sf_dir)
    suffix = F.when(F.col("seed") == 42, "").otherwise(F.concat(F.lit("_s"), F.col("seed").cast("string")))
    regime = F.when((F.col("model") == "verifier") & F.lit(regimes), F.when(F.col("dataset") == "A", "zeroshot").otherwise("fewshot"))
    named = runs.withColumn("run_name", F.concat_ws("_", "model", "dataset", regime))
    named = named.withColumn("run_name", F.concat("run_name", suffix)).select("run_name", *M.METRICS)
    FS.write_metrics(named, path)
    return path


@query(
    "src_metrics_runs",
    f"""WITH {RUN_METRICS} SELECT model, dataset, seed, 'binary' AS task,
        CASE WHEN model = 'verifier' THEN CASE WHEN dataset = 'A' THEN 'zeroshot' ELSE 'fewshot' END END AS regime, {Q.rounded(Q.RATES)} FROM runs""",
)
def src_metrics_runs(spark, sf_dir):
    """Indented files in run folders; those of one model carry a prompt regime."""
    runs = FS.read_run_folders(spark, _written_runs(spark, sf_dir, regimes=True))
    return rounded(runs.select("model", "dataset", "seed", "task", "regime", *M.METRICS))


@query(
    "sink_metrics_json",
    f"WITH {RUN_METRICS} SELECT model || '_' || dataset || CASE WHEN seed = 42 THEN '' ELSE '_s' || seed END AS run_name, {Q.rounded(['f1_binary', 'roc_auc'])} FROM runs",
)
def sink_metrics_json(spark, sf_dir):
    path = _written_runs(spark, sf_dir)
    return rounded(FS.read_run_folders(spark, path).select("run_name", "f1_binary", "roc_auc"))


# -------------------------------------------------------------------- splits
SPLIT_SQL = f"""{T.CORPUS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label3 ORDER BY md5(doc_id || ':split')) AS rn,
         count(*) OVER (PARTITION BY label3) AS n
  FROM corpus),
parted AS (
  SELECT * EXCLUDE (rn, n), CASE WHEN rn <= floor(0.8::DOUBLE * n + 1e-9) THEN 'train'
         WHEN rn <= floor(0.9::DOUBLE * n + 1e-9) THEN 'val' ELSE 'test' END AS split
  FROM ranked)"""


@query("split_stratified", f"WITH {SPLIT_SQL} SELECT doc_id, label3, split FROM parted")
def split_stratified(spark, sf_dir):
    return C.stratified_split(T.corpus(spark, sf_dir).select("doc_id", "label3"), "doc_id", "label3")


@query(
    "split_official",
    f"WITH {SPLIT_IDS}, {_VOTED} SELECT post_id, split, {_MAP3} AS label3 FROM voted JOIN split_ids USING (post_id) WHERE majority IN ('hatespeech', 'offensive', 'normal')",
)
def split_official(spark, sf_dir):
    corpus = FS.unify_posts(T.posts(spark, sf_dir)).select("post_id", "label3")
    return C.official_split(corpus, split_ids(spark, sf_dir), "post_id").select("post_id", "split", "label3")


@query(
    "split_leakage_check",
    f"""WITH {SPLIT_IDS}, again AS (
          SELECT split, post_id FROM split_ids UNION ALL
          SELECT 'test', 'post' || doc_id FROM documents WHERE doc_id % 11 = 0)
        SELECT post_id, min(split) AS first_split, max(split) AS last_split FROM again
        GROUP BY post_id HAVING min(split) <> max(split)""",
)
def split_leakage_check(spark, sf_dir):
    """The official split, spoiled on purpose by putting every eleventh id into test again."""
    ids = split_ids(spark, sf_dir).withColumn("split", C.split_name(F.col("split")))
    extra = T.read(spark, sf_dir, "documents").filter(F.col("doc_id") % 11 == 0)
    spoiled = extra.select(F.lit("test").alias("split"), F.concat(F.lit("post"), F.col("doc_id").cast("string")).alias("post_id"))
    return C.leaked_ids(ids.unionByName(spoiled), "post_id")


_SHOTS = """shots AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':shot:42'), doc_id) AS rn FROM corpus)
  WHERE rn <= 2),
examples AS (
  SELECT doc_id, text, label, row_number() OVER (ORDER BY md5(doc_id || ':mix:42'), doc_id)::INTEGER AS position FROM shots)"""


@query("sample_fewshot", f"WITH {T.CORPUS}, {_SHOTS} SELECT doc_id, label, position FROM examples")
def sample_fewshot(spark, sf_dir):
    return C.fewshot_examples(T.corpus(spark, sf_dir)).select("doc_id", "label", "position")


_WEIGHTS = """weights AS (
  SELECT label, count(*) AS n,
         (sum(count(*)) OVER ())::DOUBLE / ((count(*) OVER ()) * count(*)) AS weight
  FROM corpus GROUP BY label)"""


@query("weights_balanced", f"WITH {T.CORPUS}, {_WEIGHTS} SELECT label, n, round(weight, 9) AS weight FROM weights")
def weights_balanced(spark, sf_dir):
    return rounded(C.balanced_weights(T.corpus(spark, sf_dir)))


@query(
    "weights_balanced_rows",
    f"WITH {T.CORPUS}, {_WEIGHTS} SELECT doc_id, label, round(weight, 9) AS weight FROM corpus JOIN weights USING (label)",
)
def weights_balanced_rows(spark, sf_dir):
    return rounded(C.with_weights(T.corpus(spark, sf_dir).select("doc_id", "label")).select("doc_id", "label", "weight"))


@query(
    "seed_override",
    f"""WITH {T.CORPUS}, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY label3 ORDER BY md5(doc_id || ':7')) AS rn,
                 count(*) OVER (PARTITION BY label3) AS n FROM corpus)
        SELECT doc_id, 'tfidf_A_s7' AS run_name, CASE WHEN rn <= floor(0.8::DOUBLE * n + 1e-9) THEN 'train'
               WHEN rn <= floor(0.9::DOUBLE * n + 1e-9) THEN 'val' ELSE 'test' END AS split FROM ranked""",
)
def seed_override(spark, sf_dir):
    name, salt = C.seeded("tfidf_A", 7)
    rows = T.corpus(spark, sf_dir).select("doc_id", "label3")
    split = C.stratified_split(rows, "doc_id", "label3", salt=salt)
    return split.select("doc_id", F.lit(name).alias("run_name"), "split")


# --------------------------------------------------------------------- joins
@query(
    "join_semi_split",
    f"WITH {SPLIT_IDS}, {T.POSTS} SELECT doc_id, post_id FROM posts WHERE post_id IN (SELECT post_id FROM split_ids WHERE split = 'test')",
)
def join_semi_split(spark, sf_dir):
    test = split_ids(spark, sf_dir).filter(F.col("split") == "test")
    return T.posts(spark, sf_dir).select("doc_id", "post_id").join(test, "post_id", "left_semi")


@query(
    "join_inner_ids",
    f"""WITH {SPLIT_IDS}, {_VOTED}, listed_ids AS (
          SELECT post_id, split FROM split_ids
          UNION ALL SELECT 'lost' || doc_id, 'test' FROM documents WHERE doc_id % 50 = 0)
        SELECT post_id, doc_id, majority FROM listed_ids JOIN voted USING (post_id)
        WHERE split = 'test' AND majority IN ('hatespeech', 'offensive', 'normal')""",
)
def join_inner_ids(spark, sf_dir):
    """Test ids looked up in the posts; ids that the posts lack are skipped."""
    lost = T.read(spark, sf_dir, "documents").filter(F.col("doc_id") % 50 == 0)
    lost = lost.select(F.lit("test").alias("split"), F.concat(F.lit("lost"), F.col("doc_id").cast("string")).alias("post_id"))
    ids = split_ids(spark, sf_dir).unionByName(lost).filter(F.col("split") == "test")
    votes = T.posts(spark, sf_dir).select("post_id", "doc_id", C.majority_label(F.col("annotators")).alias("majority"))
    return C.known_labels(ids.join(votes, "post_id"), "majority").select("post_id", "doc_id", "majority")


@query(
    "join_routed_scatter",
    f"WITH {T.SCORED} SELECT doc_id, CASE WHEN p1 >= 0.3::DOUBLE THEN p2 ELSE p1 END AS p_hate, p1 >= 0.3::DOUBLE AS routed FROM scored",
)
def join_routed_scatter(spark, sf_dir):
    """Stage-2 scores overwrite routed rows: filter, score, union (not a conditional scorer)."""
    first = T.scored(spark, sf_dir).select("doc_id", "label", "p1")
    second = T.scored(spark, sf_dir).select("doc_id", "p2")
    done = S.run_cascade(
        first,
        lambda df: df.withColumnRenamed("p1", "p_hate"),
        lambda df: df.join(second.withColumnRenamed("p2", "p_hate"), "doc_id"),
        0.3,
    )
    return done.select("doc_id", "p_hate", "routed")


_DIMS = "dims AS (SELECT * FROM (VALUES ('tfidf'), ('embed'), ('verifier')) m(model), (VALUES ('A'), ('B')) d(dataset))"


@query(
    "grid_cross",
    f"WITH {RUN_METRICS}, {_DIMS} SELECT model, dataset, coalesce(printf('%.4f', f1_binary), '—') AS f1 FROM dims LEFT JOIN (SELECT * FROM runs WHERE seed = 42) r USING (model, dataset)",
)
def grid_cross(spark, sf_dir):
    runs = run_metrics(spark, sf_dir).filter(F.col("seed") == 42)
    full = grid(spark, {"model": MODELS, "dataset": ["A", "B"]}, runs)
    return full.select("model", "dataset", fixed(F.col("f1_binary")).alias("f1"))


@query(
    "join_baseline",
    f"""WITH {RUN_METRICS} SELECT r.dataset, r.seed, round(r.f1_binary, 9) AS f1, round(b.f1_binary, 9) AS base_f1
        FROM runs r LEFT JOIN (SELECT dataset, seed, f1_binary FROM runs WHERE model = 'verifier') b USING (dataset, seed)
        WHERE r.model = 'tfidf'""",
)
def join_baseline(spark, sf_dir):
    runs = run_metrics(spark, sf_dir)
    base = runs.filter(F.col("model") == "verifier").select("dataset", "seed", F.col("f1_binary").alias("base_f1"))
    mine = runs.filter(F.col("model") == "tfidf").select("dataset", "seed", F.col("f1_binary").alias("f1"))
    return rounded(mine.join(base, ["dataset", "seed"], "left"))


@query(
    "union_regimes",
    f"""WITH {T.SCORED}, stacked AS (
          SELECT 'baseline' AS regime, dataset, label, p2 AS p FROM scored UNION ALL
          SELECT 'zero-shot', dataset, label, p1 FROM scored UNION ALL
          SELECT '4-shot', dataset, label, p_obf FROM scored),
        {Q.evaluated('e', 'stacked', ['regime', 'dataset'], 'label', 'p')}
        SELECT regime, dataset, {Q.rounded(Q.RATES)} FROM e""",
)
def union_regimes(spark, sf_dir):
    s = T.scored(spark, sf_dir)
    names = {"baseline": "p2", "zero-shot": "p1", "4-shot": "p_obf"}
    parts = [s.select(F.lit(n).alias("regime"), "dataset", "label", F.col(c).alias("p")) for n, c in names.items()]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(M.evaluate(stacked, ["regime", "dataset"], "label", "p").select("regime", "dataset", *M.METRICS))
