"""Registered queries: text functions, labels, votes, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import text as X
from vigil.functions import tokens as K
from vigil.functions.numeric import argmax, decide
from vigil.operators import corpus as C
from vigil.plans import tables as T
from vigil.plans.registry import query


# ------------------------------------------------------------------ SQL twins
def _rx(expr: str, pattern: str, new: str, flags: str = "g") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({expr}, '{quoted}', '{new}', '{flags}')"


def rt_sql(e: str) -> str:
    return _rx(e, X.RT, "", "")


def entities_sql(e: str) -> str:
    return _rx(e, X.ENTITY, " ")


def urls_sql(e: str) -> str:
    return _rx(e, X.URL, " ")


def mentions_sql(e: str) -> str:
    return _rx(e, X.MENTION, " ")


def hashtags_sql(e: str, keep: bool = True) -> str:
    return _rx(e, X.HASHTAG, r"\1" if keep else " ")


def demojize_sql(e: str) -> str:
    names = X.emoji_names()
    sequences, single, tail = X.emoji_patterns(names)
    heads = single + "".join(sorted({n[0] for n in names if len(n) > 1}))
    known = f"{sequences}|[{single}]{tail}"
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}"
    tones = " ".join(f"WHEN {X.TONE + i} THEN '_{t}_skin_tone'" for i, t in enumerate(X.TONES))
    name = f"coalesce({table}[p], {table}[p[1:1]] || CASE unicode(p[2:2]) {tones} ELSE '' END)"
    pieces = f"regexp_extract_all(v, '(?s){known}|[^{heads}]+|.')"
    spelt = f"array_to_string(list_transform({pieces}, lambda p: CASE WHEN regexp_matches(p, '^(?:{known})$') THEN ' ' || {name} || ' ' ELSE p END), '')"
    return f"(SELECT CASE WHEN regexp_matches(v, '[{heads}]') THEN {spelt} ELSE v END FROM (SELECT {e} AS v))"


def collapse_sql(e: str) -> str:
    return f"trim({_rx(e, X.SPACE + '+', ' ')})"


def clean_sql(e: str) -> str:
    marks = mentions_sql(urls_sql(entities_sql(rt_sql(f"coalesce({e}, '')"))))
    return collapse_sql(f"lower({demojize_sql(hashtags_sql(marks))})")


def _text(name: str, function, sql_function):
    def run(spark, sf_dir):
        return T.noisy(spark, sf_dir).select("doc_id", function(F.col("text")).alias("text"))

    query(name, f"WITH {T.NOISY} SELECT doc_id, {sql_function('text')} AS text FROM noisy")(run)


_text("text_strip_rt", X.strip_rt, rt_sql)
_text("text_strip_entities", X.strip_entities, entities_sql)
_text("text_strip_urls", X.strip_urls, urls_sql)
_text("text_strip_mentions", X.strip_mentions, mentions_sql)
_text("text_hashtags", X.hashtags, hashtags_sql)
_text("text_hashtags_drop", lambda c: X.hashtags(c, keep=False), lambda e: hashtags_sql(e, keep=False))
_text("text_demojize", X.demojize, demojize_sql)
_text("text_lower", F.lower, lambda e: f"lower({e})")
_text("text_collapse_ws", X.collapse_space, collapse_sql)
_text("text_clean", X.clean_text, clean_sql)


@query(
    "text_clean_batch",
    f"WITH {T.NOISY} SELECT doc_id, lang, {clean_sql('CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END')} AS text FROM noisy",
)
def text_clean_batch(spark, sf_dir):
    some_null = F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("text"))
    return X.clean_column(T.noisy(spark, sf_dir).withColumn("text", some_null))


# A third of the texts is reduced to what cleaning removes.
_BLANKED = "CASE WHEN doc_id % 3 = 0 THEN '@user' || doc_id || ' https://x.y' ELSE text END"


@query(
    "flt_nonempty_clean",
    f"WITH c AS (SELECT doc_id, {clean_sql(_BLANKED)} AS text FROM documents) SELECT * FROM c WHERE length(text) > 0",
)
def flt_nonempty_clean(spark, sf_dir):
    docs = T.read(spark, sf_dir, "documents").select("doc_id", "text")
    blank = F.concat(F.lit("@user"), F.col("doc_id").cast("string"), F.lit(" https://x.y"))
    mixed = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, blank).otherwise(F.col("text")))
    return X.clean_nonempty(mixed)


@query(
    "flt_dropna",
    """SELECT d.doc_id, d.n_chars, l.toxic AS label, l.quality AS label3
       FROM documents d JOIN labels l USING (doc_id)""",
)
def flt_dropna(spark, sf_dir):
    docs, labels = T.read(spark, sf_dir, "documents"), T.read(spark, sf_dir, "labels")
    wide = docs.join(labels, "doc_id", "left")
    rows = wide.select("doc_id", "n_chars", F.col("toxic").alias("label"), F.col("quality").alias("label3"))
    return rows.dropna(subset=["label", "label3"])


_MAJORITY = """list_sort([{'n': len(list_filter(votes, lambda w: w = v)), 'first': -list_position(votes, v), 'vote': v}
              FOR v IN list_distinct(votes)], 'DESC')[1].vote"""
_VOTED = f"""{T.POSTS}, listed AS (
  SELECT *, [a.label FOR a IN annotators] AS votes FROM posts),
voted AS (SELECT *, {_MAJORITY} AS majority FROM listed)"""
_MAP3 = "CASE majority WHEN 'hatespeech' THEN 0 WHEN 'offensive' THEN 1 WHEN 'normal' THEN 2 END"


@query(
    "flt_known_labels",
    f"WITH {_VOTED} SELECT doc_id, majority FROM voted WHERE majority IN ('hatespeech', 'offensive', 'normal')",
)
def flt_known_labels(spark, sf_dir):
    voted = T.posts(spark, sf_dir).select("doc_id", C.majority_label(F.col("annotators")).alias("majority"))
    return C.known_labels(voted, "majority")


@query("lab_binarize", f"WITH {T.CORPUS} SELECT doc_id, label3, (label3 = 0)::INTEGER AS binary_label FROM corpus")
def lab_binarize(spark, sf_dir):
    return T.corpus(spark, sf_dir).select("doc_id", "label3", C.binarize(F.col("label3")).alias("binary_label"))


@query("lab_map3", f"WITH {_VOTED} SELECT doc_id, majority, {_MAP3} AS label3 FROM voted")
def lab_map3(spark, sf_dir):
    voted = T.posts(spark, sf_dir).select("doc_id", C.majority_label(F.col("annotators")).alias("majority"))
    return voted.withColumn("label3", C.map_label3(F.col("majority")))


@query("arr_join_tokens", f"WITH {T.POSTS} SELECT doc_id, array_to_string(post_tokens, ' ') AS text FROM posts")
def arr_join_tokens(spark, sf_dir):
    return T.posts(spark, sf_dir).select("doc_id", F.array_join("post_tokens", " ").alias("text"))


_CATEGORY = "CASE " + " ".join(f"WHEN fine = '{t}' THEN '{c}'" for t, c in C.TARGET_CATEGORY.items()) + " ELSE 'Other' END"
_TARGETED = f"""{T.POSTS}, flat AS (
  SELECT doc_id, flatten([CASE WHEN len(coalesce(a.target, [])) = 0 THEN ['None'] ELSE a.target END FOR a IN annotators]) AS given
  FROM posts),
named AS (SELECT doc_id, list_filter(given, lambda t: t <> 'None') AS votes FROM flat),
targeted AS (SELECT doc_id, CASE WHEN len(votes) = 0 THEN 'None' ELSE {_MAJORITY} END AS fine FROM named)"""


@query("cat_map_targets", f"WITH {_TARGETED} SELECT doc_id, fine, {_CATEGORY} AS category FROM targeted")
def cat_map_targets(spark, sf_dir):
    fine = T.posts(spark, sf_dir).select("doc_id", C.majority_target(F.col("annotators")).alias("fine"))
    return fine.withColumn("category", C.target_category(F.col("fine")))


@query("agg_majority_target", f"WITH {_TARGETED} SELECT doc_id, fine FROM targeted")
def agg_majority_target(spark, sf_dir):
    return T.posts(spark, sf_dir).select("doc_id", C.majority_target(F.col("annotators")).alias("fine"))


@query("agg_majority_label_nested", f"WITH {_VOTED} SELECT doc_id, majority FROM voted")
def agg_majority_label_nested(spark, sf_dir):
    return T.posts(spark, sf_dir).select("doc_id", C.majority_label(F.col("annotators")).alias("majority"))


@query(
    "agg_majority_label",
    """WITH t AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
       SELECT user_id, event_type AS winner, n AS n_votes FROM t
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""",
)
def agg_majority_label(spark, sf_dir):
    return C.majority_vote(T.read(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("prj_split_columns", f"WITH {T.CORPUS}, s AS (SELECT *, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM corpus) SELECT doc_id, text, label3 AS y FROM s WHERE split = 'test'")
def prj_split_columns(spark, sf_dir):
    split = F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test")
    return C.split_columns(T.corpus(spark, sf_dir).withColumn("split", split), "test", three_way=True)


@query(
    "dec_threshold",
    f"WITH {T.SCORED} SELECT doc_id, p1, (p1 >= 0.5::DOUBLE)::INTEGER AS pred, (p1 >= 0.3::DOUBLE)::INTEGER AS pred_low FROM scored",
)
def dec_threshold(spark, sf_dir):
    p = F.col("p1")
    return T.scored(spark, sf_dir).select(
        "doc_id", "p1", decide(p).alias("pred"), decide(p, 0.3).alias("pred_low")
    )


@query(
    "dec_argmax",
    f"""WITH {T.SCORED}, p AS (SELECT doc_id, [p1 * (1 - p2), p2, (1 - p1) * (1 - p2)] AS probs FROM scored)
        SELECT doc_id, (list_position(probs, list_max(probs)) - 1)::INTEGER AS pred FROM p""",
)
def dec_argmax(spark, sf_dir):
    p1, p2 = F.col("p1"), F.col("p2")
    probs = F.array(p1 * (1 - p2), p2, (1 - p1) * (1 - p2))
    return T.scored(spark, sf_dir).select("doc_id", argmax(probs).alias("pred"))


@query(
    "tok_whitespace",
    f"SELECT doc_id, list_filter(string_split(text, ' '), lambda t: t <> '') AS tokens FROM (WITH {T.NOISY} SELECT doc_id, {clean_sql('text')} AS text FROM noisy)",
)
def tok_whitespace(spark, sf_dir):
    cleaned = X.clean_column(T.noisy(spark, sf_dir))
    return cleaned.select("doc_id", K.whitespace_tokens(F.col("text")).alias("tokens"))


WORDS_SQL = "regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


@query("tok_word2plus", f"SELECT doc_id, {WORDS_SQL.format(e='text')} AS tokens FROM documents")
def tok_word2plus(spark, sf_dir):
    return T.texts(spark, sf_dir).select("doc_id", K.word_tokens(F.col("text")).alias("tokens"))


@query("tok_strip_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def tok_strip_accents(spark, sf_dir):
    return T.texts(spark, sf_dir).select("doc_id", K.strip_accents(F.col("text")).alias("text"))


GRAMS_SQL = "tokens || [tokens[i] || ' ' || tokens[i + 1] FOR i IN range(1, len(tokens))]"


@query(
    "tok_ngrams",
    f"WITH t AS (SELECT doc_id, {WORDS_SQL.format(e='text')} AS tokens FROM documents) SELECT doc_id, {GRAMS_SQL} AS grams FROM t",
)
def tok_ngrams(spark, sf_dir):
    docs = T.texts(spark, sf_dir).select("doc_id", K.word_tokens(F.col("text")).alias("tokens"))
    return docs.select("doc_id", K.ngrams(F.col("tokens"), 1, 2).alias("grams"))
