import numpy as np
from pyspark.sql import functions as F
from quillon.operators import embed, runs, serving, suite


def table(spark):
    rows = [(i, f"powershell -enc aGVsbG8{i} -nop hidden" if i % 2 else f"notepad file{i}.txt open", i % 2) for i in range(60)]
    return spark.createDataFrame(rows, "k int, t string, label int")


def test_suite_and_summary(spark):
    out = suite.run(table(spark), "k", "t", ["manual", "tfidf_word"], [3, 7], held_out=table(spark).limit(20))
    assert out.count() == 4 and out.agg(F.min("f1_malware")).first()[0] > 0.9 and "test_fpr" in out.columns
    assert runs.mean_std(out, ["f1_malware", "test_fpr"]).count() == 2


def test_embeddings(spark):
    df = table(spark).select(F.explode(F.split("t", " ")).alias("value")).unionByName(spark.createDataFrame([(None,)], "value string"))
    out = embed.embed_tokens(df)
    assert out.count() == df.count()
    for r in out.limit(5).collect():
        assert len(r.embedding) == 64 and abs(np.linalg.norm(r.embedding) - 1) < 1e-5
    model, features = embed.static_classifier(table(spark), "t")
    assert model.transform(table(spark).withColumn("features", features)).where("prediction <> label").count() == 0


def test_latency(spark):
    """Means and deviations over batches and over commands, as plain numbers give them."""
    times = [(2, 1, [0.010, 0.030], 0.050, 0.004), (1, 0, [0.020], 0.021, 0.003), (0, 3, [], 0.5, 0.0)]
    got = {r.stage: r for r in suite.latency(spark.createDataFrame(times, serving.TIMES)).collect()}
    assert set(got) == {"preprocess", "model", "combined"} and all((r.commands, r.batches) == (3, 2) for r in got.values())
    for stage, batches, commands in (("preprocess", [50, 21], [10, 30, 20]), ("model", [4, 3], [2, 2, 3]), ("combined", [54, 24], [12, 32, 23])):
        r = got[stage]
        assert np.allclose([r.batch_ms_mean, r.batch_ms_std, r.row_ms_mean, r.row_ms_std, r.total_s * 1000], [np.mean(batches), np.std(batches), np.mean(commands), np.std(commands), sum(batches)])
        assert np.isclose(r.batch_ms_p99, max(batches))
