"""Frames that the registered queries start from, and the same frames in SQL.

The given tables hold no comment corpus, so one is derived: labelled documents
are the comments, sources 0-9 and 10-19 two corpora, deterministic scores stand
for the two stages of a cascade. Every frame grows with the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.hashing import uniform
from vigil.functions.responses import cache_key, call_cost, prompt
from vigil.session import spread

LANGUAGES = ["de", "en", "es", "fr"]
MODEL = "google/gemini-2.5-flash"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, text of all documents, with a task per core for the text work."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")


def u_sql(expr: str) -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


# ------------------------------------------------------------------- corpus
def corpus(spark: SparkSession, sf_dir: str, text_work: bool = False) -> DataFrame:
    """doc_id, text, lang, source, dataset, label, label3."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if text_work:
        docs = spread(docs, "doc_id")
    labels = read(spark, sf_dir, "labels")
    label3 = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    first = F.substring("source", 4, 10).cast("int") < 10
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.when(first, "A").otherwise("B").alias("dataset"),
        F.col("toxic").alias("label"),
        label3.alias("label3"),
    )


CORPUS = """corpus AS (
  SELECT d.doc_id, d.text, d.lang, d.source,
         CASE WHEN CAST(substr(d.source, 4) AS INTEGER) < 10 THEN 'A' ELSE 'B' END AS dataset,
         l.toxic AS label,
         CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 0 THEN 1 ELSE 2 END AS label3
  FROM documents d JOIN labels l USING (doc_id))"""


def scored(spark: SparkSession, sf_dir: str, salt: str = "") -> DataFrame:
    """corpus without text + p1, p2 (tied on purpose), p_obf, split."""
    key = F.col("doc_id")
    tied = F.floor(uniform(key, f":s1{salt}") * 1000) / 1000.0
    return corpus(spark, sf_dir).drop("text").select(
        "*",
        (F.lit(0.7) * tied + F.lit(0.3) * F.col("label")).alias("p1"),
        (F.lit(0.4) * uniform(key, f":s2{salt}") + F.lit(0.6) * F.col("label")).alias("p2"),
        (F.lit(0.85) * uniform(key, f":s3{salt}") + F.lit(0.15) * F.col("label")).alias("p_obf"),
        F.when(uniform(key, ":part") < 0.5, "train")
        .when(uniform(key, ":part") < 0.75, "val")
        .otherwise("test")
        .alias("split"),
    )


def scored_sql(salt: str = "", name: str = "scored") -> str:
    u1, u2, u3, up = (u_sql(f"doc_id || ':{s}'") for s in (f"s1{salt}", f"s2{salt}", f"s3{salt}", "part"))
    return f"""{name} AS (
  SELECT doc_id, lang, source, dataset, label, label3,
         0.7::DOUBLE * (floor({u1} * 1000) / 1000.0::DOUBLE) + 0.3::DOUBLE * label AS p1,
         0.4::DOUBLE * {u2} + 0.6::DOUBLE * label AS p2,
         0.85::DOUBLE * {u3} + 0.15::DOUBLE * label AS p_obf,
         CASE WHEN {up} < 0.5 THEN 'train' WHEN {up} < 0.75 THEN 'val' ELSE 'test' END AS split
  FROM corpus)"""


SCORED = f"{CORPUS}, {scored_sql()}"


# -------------------------------------------------------------------- noise
def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with retweet marks, mentions, links, tags, entities and emoji put in."""
    key = F.col("doc_id")
    lead = F.when(key % 3 == 0, "RT ").when(key % 3 == 1, "rt\t ").otherwise("")
    many = F.lit("".join(map(chr, range(0x1F300, 0x1F300 + 400))))
    one = F.substring(many, (key % 400 + 1).cast("int"), F.lit(1))
    emoji = F.when(key % 5 == 0, "\U0001f44d\U0001f3fd").when(key % 5 == 1, "\u2764\ufe0f\U0001f525").when(key % 5 == 2, one).otherwise("")
    return texts(spark, sf_dir).select(
        "doc_id",
        "lang",
        F.concat(
            lead,
            F.lit("@user"),
            key.cast("string"),
            F.lit(" "),
            "text",
            F.lit(" https://x.y/z?d="),
            key.cast("string"),
            F.lit(" #Tag_"),
            key.cast("string"),
            F.lit("! &amp;&#39; &AMP;\u00a0www.q.r "),
            emoji,
        ).alias("text"),
    )


NOISY = """noisy AS (
  SELECT doc_id, lang,
         concat(CASE doc_id % 3 WHEN 0 THEN 'RT ' WHEN 1 THEN 'rt' || chr(9) || ' ' ELSE '' END,
                '@user', doc_id, ' ', text, ' https://x.y/z?d=', doc_id, ' #Tag_', doc_id,
                '! &amp;&#39; &AMP;' || chr(160) || 'www.q.r ',
                CASE doc_id % 5 WHEN 0 THEN chr(128077) || chr(127997)
                                WHEN 1 THEN chr(10084) || chr(65039) || chr(128293)
                                WHEN 2 THEN chr((127744 + doc_id % 400)::INTEGER) ELSE '' END) AS text
  FROM documents)"""


# -------------------------------------------------------------------- posts
def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested posts: three annotators per document with label and target votes.

    Some annotators list no target, some two; unknown labels and targets occur.
    """
    key = F.col("doc_id")

    def pick(values: list[str], *salt):
        return F.element_at(
            F.array(*[F.lit(v) for v in values]), F.floor(uniform(key, *salt) * len(values)).cast("int") + 1
        )

    def annotator(i: int):
        targets = F.when(uniform(key, f":empty{i}") < 0.3, F.array().cast("array<string>")).otherwise(
            F.when(
                uniform(key, f":two{i}") < 0.4, F.array(pick(TARGETS, f":t{i}"), pick(TARGETS, f":u{i}"))
            ).otherwise(F.array(pick(TARGETS, f":t{i}")))
        )
        return F.struct(pick(VOTES, f":v{i}").alias("label"), targets.alias("target"))

    tokens = F.filter(F.split("text", " "), lambda t: t != "")
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("post"), key.cast("string")).alias("post_id"),
        "doc_id",
        tokens.alias("post_tokens"),
        F.array(*[annotator(i) for i in range(3)]).alias("annotators"),
    )


VOTES = ["hatespeech", "offensive", "normal", "unclear"]
TARGETS = ["African", "Islam", "Women", "Homosexual", "Refugee", "None", "Martian"]


def _pick_sql(values: list[str], salt: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    draw = u_sql(f"doc_id || '{salt}'")
    return f"[{listed}][floor({draw} * {len(values)})::INTEGER + 1]"


def posts_sql() -> str:
    annotators = []
    for i in range(3):
        empty, two = u_sql(f"doc_id || ':empty{i}'"), u_sql(f"doc_id || ':two{i}'")
        t, s = _pick_sql(TARGETS, f":t{i}"), _pick_sql(TARGETS, f":u{i}")
        annotators.append(
            f"{{'label': {_pick_sql(VOTES, f':v{i}')}, 'target': CASE WHEN {empty} < 0.3 THEN []::VARCHAR[] "
            f"WHEN {two} < 0.4 THEN [{t}, {s}] ELSE [{t}] END}}"
        )
    return f"""posts AS (
  SELECT 'post' || doc_id AS post_id, doc_id,
         list_filter(string_split(text, ' '), lambda t: t <> '') AS post_tokens,
         [{", ".join(annotators)}] AS annotators
  FROM documents)"""


POSTS = posts_sql()


# ---------------------------------------------------------------- responses
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, lang, prompt, key over all documents (label 0 without a label row)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    ask = prompt(F.col("text"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        "lang",
        F.coalesce("toxic", F.lit(0)).alias("label"),
        ask.alias("prompt"),
        cache_key(MODEL, ask).alias("key"),
    )


PROMPTS = f"""prompts AS (
  SELECT d.doc_id, d.lang, coalesce(l.toxic, 0) AS label,
         'Comment: "' || d.text || '"' || chr(10) || chr(10) || 'JSON:' AS prompt,
         sha1('{MODEL}' || chr(10) || 'Comment: "' || d.text || '"' || chr(10) || chr(10) || 'JSON:') AS key
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

# Forms of raw answers; {p} is a probability with three decimals.
RAW_FORMS = [
    '{"label": "hate", "p_hate": {p}}',
    '```json\n{"label": "non-hate", "p_hate": {p}}\n```',
    'Sure! {"label": " HATE ", "p_hate": "{p}"} done',
    '{"label": "unsure", "p_hate": {p}}',
    '{"label": "hate", "p_hate": 7{p}}',
    '{"label": "hate", "p_hate": }',
    "I cannot answer",
    '{"p_hate": {p}}',
]


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only answers: seq, key, response. Some missing, some errored, some rewritten."""
    key = F.col("doc_id")
    ask = prompts(spark, sf_dir)
    base = ask.filter(uniform(key, ":gone") >= 0.2)
    p = F.format_string("%.3f", F.floor(uniform(key, ":p") * 1000) / 1000.0)
    form = F.floor(uniform(key, ":form") * len(RAW_FORMS)).cast("int")
    raw = F.replace(F.element_at(F.array(*[F.lit(r) for r in RAW_FORMS]), form + 1), F.lit("{p}"), p)
    tokens_in = F.floor(F.length("prompt") / 4).cast("long")
    tokens_out = (F.floor(uniform(key, ":out") * 60) + 10).cast("long")
    errored = uniform(key, ":err") < 0.15
    ok = F.struct(
        (p.cast("double") >= 0.5).cast("int").alias("label"),
        p.cast("double").alias("p_hate"),
        raw.alias("raw"),
        tokens_in.alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        call_cost(F.lit(MODEL), tokens_in, tokens_out).alias("cost_usd"),
        F.lit(None).cast("boolean").alias("errored"),
        F.lit(None).cast("string").alias("error"),
    )
    kind = F.floor(uniform(key, ":kind") * 4).cast("int")
    message = F.element_at(
        F.array(F.lit("HTTP 429"), F.lit("Rate limit hit"), F.lit("socket closed"), F.lit("QUOTA gone")), kind + 1
    )
    failed = F.struct(
        F.lit(None).cast("int").alias("label"),
        F.lit(None).cast("double").alias("p_hate"),
        F.lit(None).cast("string").alias("raw"),
        F.lit(None).cast("long").alias("input_tokens"),
        F.lit(None).cast("long").alias("output_tokens"),
        F.lit(None).cast("double").alias("cost_usd"),
        F.lit(True).alias("errored"),
        message.alias("error"),
    )
    second = base.filter(uniform(key, ":again") < 0.3)
    first_lines = base.select((key * 2).alias("seq"), "key", "doc_id", F.when(errored, failed).otherwise(ok).alias("response"))
    later_lines = second.select((key * 2 + 1).alias("seq"), "key", "doc_id", ok.alias("response"))
    return first_lines.unionByName(later_lines)


def cache_log_sql() -> str:
    u = lambda s: u_sql(f"doc_id || ':{s}'")
    forms = ", ".join("'" + f.replace("\n", "' || chr(10) || '") + "'" for f in RAW_FORMS)
    p = f"printf('%.3f', floor({u('p')} * 1000) / 1000.0::DOUBLE)"
    return f"""{PROMPTS}, answers AS (
  SELECT doc_id, key, {u('err')} < 0.15 AS failed, {u('again')} < 0.3 AS again,
         {p}::DOUBLE AS p_hate,
         replace([{forms}][floor({u('form')} * {len(RAW_FORMS)})::INTEGER + 1], '{{p}}', {p}) AS raw,
         floor(length(prompt) / 4)::BIGINT AS input_tokens,
         (floor({u('out')} * 60) + 10)::BIGINT AS output_tokens,
         ['HTTP 429', 'Rate limit hit', 'socket closed', 'QUOTA gone'][floor({u('kind')} * 4)::INTEGER + 1] AS message
  FROM prompts WHERE {u('gone')} >= 0.2),
lines AS (
  SELECT doc_id * 2 AS seq, doc_id, key, failed, p_hate, raw, input_tokens, output_tokens, message FROM answers
  UNION ALL
  SELECT doc_id * 2 + 1, doc_id, key, false, p_hate, raw, input_tokens, output_tokens, message FROM answers WHERE again),
log AS (
  SELECT seq, doc_id, key,
         CASE WHEN failed THEN NULL ELSE (p_hate >= 0.5)::INTEGER END AS label,
         CASE WHEN failed THEN NULL ELSE p_hate END AS p_hate,
         CASE WHEN failed THEN NULL ELSE raw END AS raw,
         CASE WHEN failed THEN NULL ELSE input_tokens END AS input_tokens,
         CASE WHEN failed THEN NULL ELSE output_tokens END AS output_tokens,
         CASE WHEN failed THEN NULL ELSE input_tokens / 1e6::DOUBLE * 0.075::DOUBLE
              + output_tokens / 1e6::DOUBLE * 0.3::DOUBLE END AS cost_usd,
         failed AS errored, CASE WHEN failed THEN message END AS error
  FROM lines),
entries AS (
  SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"""


CACHE = cache_log_sql()


# ------------------------------------------------------------------ timings
def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("seq"), F.col("value").alias("ms")
    )


TIMINGS = "timings AS (SELECT event_type AS run, event_id AS seq, value AS ms FROM events)"
