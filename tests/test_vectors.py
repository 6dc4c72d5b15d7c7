"""Queries of vectors beyond the short list."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import vector
from palimpsest.plans import catalog, kept


def test_every_hundredth_vector_is_a_query(spark, tmp_path):
    spark.range(100_301).selectExpr("id AS vec_id", "id % 3 AS label", "array(CAST(id AS float), 1.0F) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    _, queries = catalog._vectors(spark, str(tmp_path))
    assert queries.count() == 1004


@pytest.mark.parametrize("find", [vector.top_k, vector.knn_vote, lambda v, q: vector.lsh_top_k(v, q, dim=8)])
def test_queries_in_blocks_give_the_same(spark, find, monkeypatch):
    x = np.random.default_rng(1).standard_normal((300, 8))
    v = spark.createDataFrame([(k, k % 3, row.tolist()) for k, row in enumerate(x)], "vec_id long, label long, embedding array<float>")
    ids = list(range(0, 300, 10))
    want = sorted(map(tuple, find(v, ids).collect()))
    monkeypatch.setattr(vector, "BLOCK", 7)
    assert {r[0] for r in want} == set(ids) and sorted(map(tuple, find(v, v.where("vec_id % 10 = 0").select("vec_id")).collect())) == want


def test_kept_index_finds_most_neighbours(spark):
    """Every hundredth id that is held, against an exact search of what is held; before, 0.9 was measured on five ids."""
    directory = "/root/testdata/sf0.1"
    vecs = kept._kept_vectors(spark, directory)
    held = vecs.vectors()
    queries = held.where("id % 100 = 0").select(F.col("id").alias("query"), "vector")
    found = {(r["query"], r["id"]) for r in vecs.search(queries).collect()}
    exact = {(r["query"], r["id"]) for r in vector.block_top_k(held, queries.withColumnRenamed("query", "key"), 10).collect()}
    assert len(exact) >= 150 and len(found & exact) >= 0.9 * len(exact)


def test_embeddings_of_long_texts_go_in_blocks(spark):
    """What is held at once is bounded by characters, not by the rows of a batch."""
    texts = ["ab " * n for n in (1, 5, 400, 2, 0, 30)] + ["x" * 50]
    blocks = list(vector.text_blocks(texts, 100))
    assert [t for b in blocks for t in b] == texts and all(len(b) == 1 or sum(map(len, b)) <= 100 for b in blocks)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    for r in vector.embeddings(rows).collect():
        assert np.allclose(r["embedding"], vector.embed(texts[r["id"]]))
