"""Vector queries see whole labels, not blocks of neighbouring ids."""

import numpy as np

from factloom.operators import vectors as V
from factloom.plans.registry import QUERIES
from factloom.plans import facts  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def test_pairs_cross_the_blocks(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    u = V.unit(np.array([r.embedding for r in rows], float))
    sims = u @ u.T
    want = {(rows[i].vec_id, rows[j].vec_id) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i].label == rows[j].label and sims[i, j] >= 0.3}
    got = {(r.i, r.j) for r in QUERIES["label_cosine_pairs"](spark, FOLDER).collect()}
    assert got == want and any(i // 50 != j // 50 for i, j in got)


def test_five_representatives_of_a_label_and_five_clusters(spark):
    chosen = QUERIES["facility_topk"](spark, FOLDER).toPandas()
    assert chosen.groupby("label").size().tolist() == [5] * 10
    placed = QUERIES["coalesce_clusters"](spark, FOLDER).toPandas()
    assert len(placed) == 500 and placed["cluster"].nunique() == 5
    assert (placed.groupby("label")["cluster"].nunique() == 1).all()


def test_representatives_in_blocks():
    v = np.random.default_rng(1).normal(size=(90, 8))
    assert V.representatives(v, 7, block=16) == V.representatives(v, 7)


def test_pairs_of_one_large_group_are_found_in_many_tiles(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 12)).astype(np.float32)
    v[7] = 0
    rows = [(1, k, v[k].tolist()) for k in range(300)] + [(1, 300, None), (1, 301, [1.0]), (1, 302, [1.0, None]), (1, 5, v[5].tolist()), (None, 1, v[1].tolist()), (2, None, v[2].tolist())]
    df = spark.createDataFrame(rows, "g int, id long, embedding array<float>")
    found = V.cosine_pairs(df, "g", "id", 0.4, tile=40)
    u = V.unit(v.astype(float))
    sims = u @ u.T
    want = sorted((i, j) for i in range(300) for j in range(i + 1, 300) for _ in range(1 + (5 in (i, j))) if sims[i, j] >= 0.4)
    got = found.collect()
    assert sorted((r.i, r.j) for r in got) == want and all(abs(r.similarity - sims[r.i, r.j]) < 1e-9 for r in got)
    tiles = {(r.p, r.q): r["count"] for r in V.tiled(df, "g", "id", tile=40).where("g = 1").groupBy("p", "q").count().collect()}
    assert len(tiles) == 8 * 9 // 2 and max(tiles.values()) < 150  # no task holds the group
    odd = V.cosine_pairs(df.where("id in (3, 7, 300, 301, 302)"), "g", "id", 0.0, tile=2).collect()
    assert sorted((r.i, r.j, r.similarity) for r in odd) == [(i, j, 0.0) for i, j in [(3, 7), (3, 300), (3, 301), (3, 302), (7, 300), (7, 301), (7, 302), (300, 301), (300, 302), (301, 302)]]
