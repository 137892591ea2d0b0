"""Near vectors of different labels never link, whatever cluster they are in."""

import math

import numpy as np

from learntrail.llm import embeddings


def test_equal_vectors_of_different_labels_stay_apart(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 16))
    rows = [(k, (base[k % 4] + 1e-4 * rng.normal(size=16)).tolist(), k // 4 % 3) for k in range(60)] + [(100 + k, base[0].tolist(), k) for k in range(5)]
    found = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for i, a, x in rows:
        near = [j for j, b, y in rows if x == y and np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.98]
        assert found[i].n_links == len(near) - 1 and found[i].component_id == min(near)


def test_clusters_that_mix_labels_are_parted(spark, monkeypatch):
    rows = [(k, [1.0, k * 1e-3, 0.0], k % 2) for k in range(20)]
    monkeypatch.setattr(embeddings, "components", lambda edges, real=embeddings.components: real(edges) if "least" in str(edges.columns) else one_cluster(edges, real))

    def one_cluster(edges, real):
        """All ids of the candidate edges as one component, as if the keys of two labels had collided."""
        return real(edges).selectExpr("id", "0L AS component") if edges.columns == ["u", "v"] and not seen.append(1) and len(seen) == 1 else real(edges)

    seen: list = []
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {k: (9, k % 2) for k in range(20)}
