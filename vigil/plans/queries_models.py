"""Registered queries: features in long form, fitted models, experiments with them."""

from __future__ import annotations

import hashlib

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from vigil.functions.text import clean_text
from vigil.operators import features as X
from vigil.operators import models as ML
from vigil.operators import report as P
from vigil.operators.embedding import EmbedConfig
from vigil.plans import experiments as E
from vigil.plans import many as Y
from vigil.plans import tables as T
from vigil.plans.queries_corpus import SPLIT_SQL
from vigil.plans.queries_text import GRAMS_SQL, WORDS_SQL
from vigil.plans.registry import query
from vigil.plans.rounding import rounded
from vigil.session import materialise, scratch_path

# -------------------------------------------------------- features, long form
_WORDS = WORDS_SQL.format(e="text").replace("lower(text)", "strip_accents(lower(text))")
TERMS = f"""words AS (SELECT doc_id, {_WORDS} AS tokens FROM documents),
grams AS (SELECT doc_id, unnest({GRAMS_SQL}) AS term FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
freq AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term)"""


def _vocab_sql(size: int, min_df: int = 2) -> str:
    return f"""vocab AS (SELECT term, df, cf, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1 AS idf
  FROM freq WHERE df >= {min_df} ORDER BY cf DESC, term LIMIT {size})"""


LONG = X.TfidfConfig()


def _docs(spark, sf_dir, cfg=LONG):
    return X.with_terms(T.texts(spark, sf_dir).select("doc_id", "text"), cfg)


@query("feat_df_idf", f"WITH {TERMS}, {_vocab_sql(10**9, 1)} SELECT term, df, cf, round(idf, 9) AS idf FROM vocab")
def feat_df_idf(spark, sf_dir):
    """Document frequency and smoothed idf of every term."""
    docs = _docs(spark, sf_dir)
    n = T.read(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    return rounded(X.term_frequencies(docs).withColumn("idf", X.idf(n, F.col("df"))))


@query("win_vocab_topk", f"WITH {TERMS}, {_vocab_sql(LONG.max_features)} SELECT term, df, cf FROM vocab")
def win_vocab_topk(spark, sf_dir):
    return X.vocabulary(X.term_frequencies(_docs(spark, sf_dir)), LONG)


@query(
    "feat_tfidf",
    f"""WITH {TERMS}, {_vocab_sql(LONG.max_features)}, w AS (SELECT doc_id, term, tf, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term))
        SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM w""",
)
def feat_tfidf(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return rounded(X.tfidf(docs, X.idf_table(docs, LONG), LONG))


# -------------------------------------------------------------- fitted models
TFIDF = X.TfidfConfig()
EMBED = EmbedConfig()
VERIFY = ML.VerifierConfig()


def prepared(spark, sf_dir):
    return E.prepare(T.corpus(spark, sf_dir, text_work=True))


def _fitted(name: str, model_type: str, cfg):
    @query(name)
    def run(spark, sf_dir):
        return rounded(E.in_domain(model_type, prepared(spark, sf_dir), cfg), 6)

    return run


_fitted("mdl_tfidf_lr", "tfidf", TFIDF)
_fitted("mdl_embed_lr", "embed", EMBED)
_fitted("mdl_verifier", "verifier", VERIFY)


@query("mdl_embed_infer")
def mdl_embed_infer(spark, sf_dir):
    """Vectors of unseen texts (all conversations) from a model fitted on documents."""
    model = E.fit("embed", prepared(spark, sf_dir), cfg=EMBED)
    talk = T.read(spark, sf_dir, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return model.vectors(talk.select(key.alias("doc_id"), clean_text(F.col("text")).alias("text")))


@query("mdl_select_best")
def mdl_select_best(spark, sf_dir):
    """Two settings fitted on train, compared by macro F1 on val."""
    p = prepared(spark, sf_dir)
    fits = {
        f"C={c}": E.fit("tfidf", p, cfg=X.TfidfConfig(C=c)) for c in (0.1, 10.0)
    }
    best, board = ML.select_best(fits, E.part(p, "val"))
    return rounded(board.withColumn("chosen", F.col("model") == best), 6)


@query("mdl_three_way")
def mdl_three_way(spark, sf_dir):
    classwise, summary = E.three_way("tfidf", prepared(spark, sf_dir), TFIDF)
    totals = summary.select("model", "accuracy", "f1_macro", "f1_weighted")
    return rounded(classwise.select("model", "class", "precision", "recall", "f1", "support").join(totals, "model"), 6)


@query("mdl_score")
def mdl_score(spark, sf_dir):
    """p_hate of all documents, labelled or not, cleaned like the training texts."""
    model = E.fit("tfidf", prepared(spark, sf_dir), cfg=TFIDF)
    return model.score(T.texts(spark, sf_dir).withColumn("text", clean_text(F.col("text"))))


def given_coefficient(term: str) -> float:
    """A coefficient between -0.5 and 0.5 that both sides derive from the term."""
    return int(hashlib.md5(f"{term}:coefficient".encode()).hexdigest()[:8], 16) / 2**32 - 0.5


@query(
    "mdl_score_given",
    f"""WITH {TERMS}, {_vocab_sql(LONG.max_features)}, w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
        m AS (SELECT doc_id, sum(w * ({T.u_sql("term || ':coefficient'")} - 0.5::DOUBLE)) / sqrt(sum(w * w)) AS margin FROM w GROUP BY doc_id)
        SELECT doc_id, round(1 / (1 + exp(-(coalesce(margin, 0) + 0.25::DOUBLE))), 6) AS p_hate FROM documents LEFT JOIN m USING (doc_id)""",
)
def mdl_score_given(spark, sf_dir):
    """The scoring of the TF-IDF model with given coefficients instead of fitted ones."""
    terms = X.idf_table(_docs(spark, sf_dir), LONG).orderBy(F.col("cf").desc(), "term").select("term", "idf").collect()
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in terms], inputCol="_grams", outputCol="_tf")
    coefficients = [[given_coefficient(r["term"]) for r in terms]]
    model = ML.TfidfModel(LONG, counter, [float(r["idf"]) for r in terms], coefficients, [0.25])
    return rounded(model.score(T.texts(spark, sf_dir).select("doc_id", "text")), 6)


_TEST = f"{SPLIT_SQL}, held AS (SELECT doc_id, label FROM parted WHERE split = 'test')"


@query("mdl_save_load", f"WITH {_TEST} SELECT model, doc_id, true AS same FROM held, (VALUES ('tfidf'), ('verifier')) v(model)")
def mdl_save_load(spark, sf_dir):
    """Whether saved and loaded models give each test row the score of the fitted ones."""
    p = prepared(spark, sf_dir)
    test = E.part(p, "test")
    out = None
    for name, cfg in (("tfidf", TFIDF), ("verifier", VERIFY)):
        model = E.fit(name, p, cfg=cfg)
        path = scratch_path(spark, f"saved-{name}")
        model.save(path)
        again = type(model).load(spark, path)
        before = model.score(test).withColumnRenamed("p_hate", "p_fitted")
        same = F.abs(F.col("p_fitted") - F.col("p_hate")) < 1e-12
        rows = before.join(again.score(test), "doc_id").select(F.lit(name).alias("model"), "doc_id", same.alias("same"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- experiments
MODELS = (("tfidf", TFIDF), ("embed", EMBED), ("verifier", VERIFY))
DATASETS = ("A", "B")


def _corpora(spark, sf_dir):
    """The comments of each corpus."""
    corpus = T.corpus(spark, sf_dir, text_work=True)
    return {d: corpus.filter(F.col("dataset") == d) for d in DATASETS}


@query("exp_in_domain")
def exp_in_domain(spark, sf_dir):
    """Report rows of all three models on each corpus, fitted and scored on its own split."""
    corpus, runs = T.corpus(spark, sf_dir, text_work=True), None
    for dataset in ("A", "B"):
        p = E.prepare(corpus.filter(F.col("dataset") == dataset))
        for name, cfg in (("tfidf", TFIDF), ("embed", EMBED), ("verifier", VERIFY)):
            m = E.in_domain(name, p, cfg).withColumn("dataset", F.lit(dataset))
            runs = m if runs is None else runs.unionByName(m)
    return P.in_domain_table(materialise(runs, "runs"), ["A", "B"])


@query("exp_cross_dataset_fitted")
def exp_cross_dataset_fitted(spark, sf_dir):
    """All three models, fitted on each corpus and scored on the other."""
    return rounded(Y.cross_dataset(MODELS, _corpora(spark, sf_dir)), 6)


@query("exp_threshold_tune_fitted")
def exp_threshold_tune_fitted(spark, sf_dir):
    """The tuned threshold of all three models on each corpus."""
    return rounded(Y.threshold_tuning(MODELS, _corpora(spark, sf_dir)), 6)


@query("exp_cascade_fitted", f"WITH {_TEST} SELECT doc_id, label, true AS routed_by_first, true AS scored_by_its_stage FROM held")
def exp_cascade_fitted(spark, sf_dir):
    """Every test row: whether the first score routed it, and its final score is its stage's."""
    c = E.cascade_scores(prepared(spark, sf_dir), 0.2, cfgs=(TFIDF, VERIFY))
    routed = F.col("routed") == (F.col("p1") >= 0.2)
    final = F.col("p_hate") == F.when(F.col("routed"), F.col("p2")).otherwise(F.col("p1"))
    return c.select("doc_id", "label", routed.alias("routed_by_first"), final.alias("scored_by_its_stage"))


@query("exp_cascade_sweep_fitted")
def exp_cascade_sweep_fitted(spark, sf_dir):
    return rounded(E.cascade_frontier(prepared(spark, sf_dir), (TFIDF, VERIFY)), 6)


@query("exp_robustness_fitted")
def exp_robustness_fitted(spark, sf_dir):
    """All three models on the clean and the obfuscated test rows of each corpus."""
    return rounded(Y.robustness(MODELS, _corpora(spark, sf_dir)), 6)


@query("exp_group_audit_fitted")
def exp_group_audit_fitted(spark, sf_dir):
    """Share of toxic comments that the fitted filter catches, per language, on held-out rows."""
    return rounded(E.group_audit("tfidf", prepared(spark, sf_dir), "lang", T.LANGUAGES, TFIDF), 6)


@query("exp_multi_seed")
def exp_multi_seed(spark, sf_dir):
    """All three models on each corpus under several split seeds."""
    return rounded(Y.multi_seed(MODELS, _corpora(spark, sf_dir)), 6)
