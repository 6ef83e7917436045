"""The forest at sizes where it decides: recall, and the share of the table that it reads."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from massflow.llm import nearest


def _clustered(n, rng):
    centers = rng.standard_normal((n // 40, 64))
    x = np.repeat(centers, 40, axis=0)[:n] + 0.35 * rng.standard_normal((n, 64))
    return x[rng.permutation(n)]


@pytest.mark.parametrize(("kind", "most"), [("isotropic", 1.0), ("clustered", 0.12)])
def test_recall_and_rows_read(spark, tmp_path, monkeypatch, kind, most):
    rng = np.random.default_rng(11)
    n = 20_000
    x = rng.standard_normal((n, 64)) if kind == "isotropic" else _clustered(n, rng)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x))}), str(tmp_path / "v.parquet"))
    seen = {}
    fitted = nearest._fitted

    def spy(coded, counts, bits, k, dim, total):
        enough = seen["enough"] = fitted(coded, counts, bits, k, dim, total)
        own = counts.where((F.col("rows") >= max(enough, nearest.TREES * (k + 1))) & (F.col("rows") < total)).groupBy("c").agg(F.max(F.struct("depth", "rows")).alias("m"))
        seen["read"] = (own.agg(F.sum("m.rows")).first()[0] or 0) + (n // 20 - own.count()) * total
        seen["past_the_axis"] = own.where("m.depth > 1").count()
        return enough

    monkeypatch.setattr(nearest, "_fitted", spy)
    got = nearest.search(spark.read.parquet(str(tmp_path / "v.parquet"))).toPandas()
    asked = np.arange(0, n, 20)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -2
    want = {(int(q), int(j)) for q, s in zip(asked, score) for j in np.argpartition(-s, 20)[:20]}
    assert len(got) == len(want) and not got.duplicated(["query_id", "vec_id"]).any()
    recall = len(want & set(zip(got.query_id, got.vec_id))) / len(want)
    share = seen["read"] / (len(asked) * n)
    print(kind, "recall", recall, "share", share, "past the axis", seen["past_the_axis"])
    assert recall >= 0.9 and share <= most
    if kind == "clustered":
        assert seen["past_the_axis"] > 0.9 * len(asked)


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(40)] + [(100, [1.0, 2.0, 3.0]), (120, [1.0])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))).collect()
    assert {r.query_id for r in got} == {0, 20} and len(got) == 40
    assert max(r.vec_id for r in got) < 100


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_small_tables_are_searched_in_the_forest(spark, monkeypatch, sf):
    """Recall of at least 0.9 with under 5 % of the queries at the root, and strings long enough to tell all rows apart."""
    import os

    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    seen, ascended = {}, nearest._ascended

    def spy(coded, bits, k, dim, total):
        placed = ascended(coded, bits, k, dim, total)
        seen["root"] = placed.where("depth = 0").count() / placed.count()
        seen["alike"] = coded.select(F.posexplode("codes").alias("tree", "code")).groupBy("tree", "code").count().agg(F.avg("count")).first()[0]
        return placed

    monkeypatch.setattr(nearest, "_ascended", spy)
    table = spark.read.parquet(path)
    got = {(r.query_id, r.vec_id) for r in nearest.search(table).collect()}
    rows = table.select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(float)
    asked = np.flatnonzero(ids % 20 == 0)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = {(int(ids[q]), int(ids[j])) for q, s in zip(asked, score) for j in np.argpartition(-s, 20)[:20]}
    print(sf, seen, len(want & got) / len(want))
    assert len(want & got) >= 0.9 * len(want) and seen["root"] < 0.05 and seen["alike"] < 1.2


def test_a_repeated_id_asks_with_its_least_vector(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0])]
    for parts in (1, 4):
        got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)).collect()
        assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(20, 1, 1, 2.0), (20, 2, 2, 0.0)]
