"""Registered queries of the operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.llm import bpe, decontaminate, fingerprints, html_text, language_id, lexical, near_dedup, ngram_lm, spelling, substring_dedup, token_counts, toxicity, warc
from vigil.llm.frames import read
from vigil.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS k, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
iv AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS ws FROM iw),
ks AS (SELECT DISTINCT k FROM iv),
dw AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN ks ON len(w) >= k),
dv AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS ws FROM dw),
hits AS (SELECT doc_id, i, k, item_id FROM dv JOIN iv USING (k, ws)),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits),
nh AS (SELECT doc_id, count(*) AS n FROM pos GROUP BY doc_id),
ni AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(nh.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(nh.n, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)"""


@query("op5_decontaminate", OP5_SQL)
def op5(spark, sf_dir):
    found = decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("items")


SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, {SPACED} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS ws
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_id AS (SELECT ws, min(doc_id) AS m FROM win GROUP BY ws),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN least_id USING (ws) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query("op3_substring_dedup", OP3_SQL)
def op3(spark, sf_dir):
    return substring_dedup.report(read(spark, sf_dir, "documents"))


OP2_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS s FROM
        (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS root, b AS node FROM edge UNION SELECT r.root, e.b FROM reach r JOIN edge e ON r.node = e.a),
comp AS (SELECT node, min(root) AS c FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.node = d.doc_id"""


@query("op2_minhash_near_dedup", OP2_SQL)
def op2(spark, sf_dir):
    return near_dedup.report(read(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def vocabulary_path() -> str:
    """The byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_bpe_codec")
def op6(spark, sf_dir):
    return bpe.report(read(spark, sf_dir, "documents"), vocabulary_path())


@query("op4_ngram_lm")
def op4(spark, sf_dir):
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    return ngram_lm.report(read(spark, sf_dir, "documents"), train)


@query("op8_html_text")
def op8(spark, sf_dir):
    return html_text.report(read(spark, sf_dir, "pages"))


@query("op10_token_counts")
def op10(spark, sf_dir):
    import base64

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = spark.sparkContext.broadcast(ranks)
    encoder = token_counts.tiktoken_encoder_of(shared, public_tokenizers.PATTERN)
    return token_counts.report(read(spark, sf_dir, "documents"), encoder, end=len(ranks))


@query("op9_fingerprints")
def op9(spark, sf_dir):
    return fingerprints.report(read(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7(spark, sf_dir):
    return language_id.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE steps AS (SELECT x AS b, 0 AS k, CAST(x AS BIGINT) AS v FROM range(256) t(x)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents) GROUP BY ALL),
coded AS (SELECT w, n, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)), '..'),
  lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM runs),
hashed AS (SELECT w, n, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM coded, tab),
cut AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
skips AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT s.word, o.word AS other, o.n AS m FROM skips s JOIN skips o USING (a, b) WHERE s.word != o.word
  UNION SELECT s.word, w.word, w.n FROM skips s JOIN words w ON w.word = s.a || s.b
  UNION SELECT w.word, s.word, s.n FROM skips s JOIN words w ON w.word = s.a || s.b),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form,
  CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM formed JOIN ends USING (word)"""


@query("op11_spelling_variants", OP11_SQL)
def op11(spark, sf_dir):
    return spelling.report(read(spark, sf_dir, "documents"))


OP12_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS hex, min(page_id) OVER (PARTITION BY sha256(b)) AS first FROM p),
d AS (SELECT page_id, n, first, array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((CAST('0x' || substr(hex, 5 * (j // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) + 1, 1)), '') AS code FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, code AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d"""


@query("op12_warc", OP12_SQL)
def op12(spark, sf_dir):
    return warc.report(read(spark, sf_dir, "pages"))


TERMS = r"list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS t FROM documents),
dt AS (SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, sum(n) AS terms FROM dt),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM dt) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
b AS (SELECT row_number() OVER () AS i, item_id, {TERMS} AS t FROM benchmark),
bt AS (SELECT DISTINCT i, unnest(t) AS term FROM b),
m AS (SELECT r, doc_id, 100 - 90 + CAST((90 * n * docs) // terms AS BIGINT) AS m FROM dt, total),
s AS (SELECT i, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM bt JOIN tf USING (term) JOIN df USING (term) JOIN m USING (r) GROUP BY i, r),
k AS (SELECT i, m.doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, m.doc_id NULLS LAST) AS rank
      FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN b USING (i) WHERE rank <= 10"""


@query("op13_lexical_search", OP13_SQL)
def op13(spark, sf_dir):
    return lexical.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
