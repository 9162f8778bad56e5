"""The same rows as stream and as batch."""

from pyspark.sql import functions as F

from vigil.functions.text import clean_nonempty
from vigil.operators.sweeps import cascade_scores
from vigil.session import scratch_path
from vigil.streaming import comments as S


def test_stream_equals_batch(spark):
    source, out, mark = (scratch_path(spark, n) for n in ("s-in", "s-out", "s-mark"))
    rows = [(i, f"RT @u{i} Text {i}" if i % 3 else "@gone", i / 20, 1 - i / 20) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, p1 double, p2 double").repartition(4)
    df.write.parquet(source)
    stream = S.comment_stream(spark, source, df.schema, files_per_trigger=1)
    S.to_table(S.route_comments(S.clean_comments(stream), 0.3), out, mark).start().awaitTermination(120)
    want = cascade_scores(clean_nonempty(df), 0.3)
    key = lambda d: sorted((r.doc_id, r.text, r.p_hate, r.routed) for r in d.collect())
    assert key(spark.read.parquet(out)) == key(want)
    assert want.filter(F.col("text") == "").count() == 0
