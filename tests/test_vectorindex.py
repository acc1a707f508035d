"""The vector index against exact search: recall, what is read, filters, and vectors without a direction."""

import numpy as np
import pytest

from tessera.operators.vectorindex import VectorIndex, build


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 4
    return {i: (centres[i % 20] + rng.normal(size=16)).astype("float32").tolist() for i in range(2000)}


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    rows = [*vectors.items(), (9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [])]
    folder = str(tmp_path_factory.mktemp("vectors") / "a")
    build(spark.createDataFrame(rows, "id long, v array<float>"), folder, id_col="id", vector="v", cells=40, recall=0.95, k=20)
    return VectorIndex(spark, folder)


def exact(vectors, query, limit, allowed=None):
    ids = np.array([i for i in vectors if allowed is None or i in allowed])
    m = np.array([vectors[i] for i in ids], "float64")
    score = m @ np.array(query) / np.linalg.norm(m, axis=1) / np.linalg.norm(query)
    return [int(ids[j]) for j in np.lexsort((ids, -score))[:limit]]


def test_recall_and_cells(index, vectors):
    assert index.recall >= 0.95 and index.probes <= 12 and index.cells == 40
    hits = []
    for i in range(0, 2000, 250):
        near = index.search(vectors[i], limit=20)
        hits.append(len({r.id for r in near.rows.collect()} & set(exact(vectors, vectors[i], 20))) / 20)
        assert near.read == index.probes
    assert np.mean(hits) >= 0.9
    everything = index.search(vectors[7], limit=30, probes=40).rows.collect()
    assert [r.id for r in everything] == exact(vectors, vectors[7], 30) and everything[0].score == pytest.approx(1)


def test_only_the_nearest_cells_are_read(index, vectors):
    plan = index.search(vectors[3], limit=5, probes=2).rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") and index.vectors().count() == 2000


def test_filters_widen_the_probes(spark, index, vectors):
    few = set(range(0, 2000, 100)) | {1999}
    near = index.search(vectors[5], limit=15, probes=1, allowed=spark.createDataFrame([(i,) for i in few], "id long"))
    rows = [r.id for r in near.rows.collect()]
    assert len(rows) == 15 and set(rows) <= few and near.read > 1


def test_queries_without_a_direction(index):
    for bad in ([0.0] * 16, [float("nan")] * 16, []):
        with pytest.raises(ValueError):
            index.search(bad, limit=3)


def test_few_vectors(spark, tmp_path):
    made = lambda n: spark.createDataFrame([(i, [1.0 + i, 2.0]) for i in range(n)], "id long, v array<double>")
    with pytest.raises(ValueError, match="no vector"):
        build(made(0), str(tmp_path / "0"), id_col="id", vector="v")
    for n in (1, 3):
        build(made(n), str(tmp_path / str(n)), id_col="id", vector="v")
        assert VectorIndex(spark, str(tmp_path / str(n))).search([1.0, 1.0], limit=5, probes=9).rows.count() == n
