import numpy as np
from pyspark.sql import functions as F

from textmill.llm import ivfpq


def test_large_groups_of_near_copies(spark):
    """Quantisation can't tell the members of a group apart; all cells are probed, so nothing may be lost."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(2, 64))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), 3000, axis=0) + rng.normal(scale=0.01, size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ivfpq.search(df, F.col("vec_id") % 300 == 0, k=20, probed=1.0, cells=4).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, 6000, 300):
        score = x @ x[q]
        score[q] = -np.inf
        assert got[q] == set(np.argsort(-score)[:20].tolist())
