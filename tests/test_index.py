import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import index, search


def test_recall_against_a_full_search(spark, sf, tmp_path):
    rows = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/embeddings.parquet").select(F.col("vec_id").alias("point_id"), "embedding")
    whole = search.indexable(rows)
    own = index.CellIndex(spark, str(tmp_path / "index")).build(rows)
    found = everything = 0
    for r in rows.where("point_id % 100 = 0").collect():
        want = {x.point_id for x in search.top_k(whole, r.embedding, 10, length="norm").collect()}
        got = own.search(r.embedding, 10).collect()
        found, everything = found + len(want & {x.key for x in got}), everything + len(want)
        assert got[0].key == r.point_id
    assert found >= 0.9 * everything
    # all cells: the full search itself
    query = [1.0] * len(rows.first().embedding)
    all_cells = own.search(query, 20, probes=10_000)
    assert [tuple(x) for x in all_cells.collect()] == [tuple(x) for x in search.top_k(whole, query, 20, length="norm").collect()]
    assert "cell" in all_cells._jdf.queryExecution().toString().split("PartitionFilters")[1][:80]


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((20, 8)), 60, axis=0) + 0.02 * rng.standard_normal((1200, 8))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "point_id long, embedding array<double>")
    own = index.CellIndex(spark, str(tmp_path / "index")).build(rows, cells=40, sample=600)
    assert spark.read.parquet(str(tmp_path / "index" / "centers")).first()["probes"] <= 10
    whole = search.indexable(rows)
    for i in range(0, 1200, 200):
        query = x[i].tolist()
        want = {r.point_id for r in search.top_k(whole, query, 10, length="norm").collect()}
        assert len(want & {r.key for r in own.search(query, 10).collect()}) >= 9


def test_index_edges(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [0.0, 2.0]), (3, [0.0, 2.0])], "point_id long, embedding array<double>")
    own = index.CellIndex(spark, str(tmp_path / "a")).build(rows, cells=9)
    assert [r.key for r in own.search([0.0, 1.0], 5, probes=9).collect()] == [3, 3, 0]
    with pytest.raises(ValueError, match="no vector"):
        index.CellIndex(spark, str(tmp_path / "b")).build(rows.limit(0))
    assert np.allclose(np.linalg.norm(index.centroids_of(np.eye(3), 2), axis=1), 1)
