import numpy as np

from engramlake.operators import vectors


def test_nearest_in_blocks_and_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = e.where("vec_id % 50 = 0")
    truth = vectors.nearest(e, queries, 10)
    small = vectors.nearest(e, queries, 10, config=vectors.VectorConfig(query_block=3))
    plain = lambda df: sorted((r.query_id, r.vec_id, round(r.score, 9)) for r in df.collect())
    assert plain(truth) == plain(small)
    centres = vectors.centroids(e)
    found = vectors.approximate(vectors.indexed(e, centres), queries, centres, 10)
    assert vectors.recall(found, truth).first().recall >= 0.9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = vectors.nearest(df, df.where("vec_id = 1"), 5).collect()
    assert [(r.vec_id, round(r.score, 3)) for r in got] == [(5, 0.707), (2, 0.0)]
    assert vectors.nearest(df, df.where("vec_id > 9"), 5).count() == 0
    assert np.isfinite(got[0].score)
