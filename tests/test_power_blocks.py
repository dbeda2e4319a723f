"""Power iteration on blocks against a dense matrix."""

import random

import numpy as np
import pytest

from quillgraph.functions.rng import uniform
from quillgraph.operators import community, power_blocks


def _dense(rows, start, rounds):
    ids = sorted({x for a, b, _ in rows if a != b for x in (a, b)})
    w = np.zeros((len(ids), len(ids)))
    for a, b, x in rows:
        if a != b:
            i, j = ids.index(a), ids.index(b)
            w[i, j] += x
            w[j, i] += x
    w /= np.maximum(w.sum(axis=1), np.finfo(float).eps)[:, None]
    x, change = np.array([start[i] for i in ids]), None
    x /= abs(x).sum()
    for _ in range(rounds):
        y = w @ x
        y /= abs(y).sum()
        now = abs(y - x).sum()
        x = y
        if change is not None and abs(now - change) < max(1e-5 / len(ids), 1e-8):
            break
        change = now
    return dict(zip(ids, x, strict=True))


@pytest.mark.parametrize("nodes", [4, 1000])
def test_blocks_equal_dense(spark, monkeypatch, nodes):
    """Weights, repeated pairs, self-loops, many blocks or one; no graph of another library is built."""
    monkeypatch.setattr(power_blocks, "NODES", nodes)
    rng = random.Random(4)
    rows = [(a, b, rng.random()) for a, b in (rng.sample(range(0, 90, 3), 2) for _ in range(80))] + [(3, 3, 5.0), (91, 91, 1.0), (200, 201, 1.0)]
    pairs = spark.createDataFrame(rows, "src long, dst long, weight double")
    ids = spark.range(202)
    start = {r[0]: r[1] for r in ids.select("id", uniform(7, "pic", "id") - 0.5).collect()}
    for rounds in (1, 7, 20):
        got = {r["id"]: r["x"] for r in power_blocks.power_iteration(pairs, rounds).collect()}
        assert got == pytest.approx(_dense(rows, start, rounds), abs=1e-12)
    import pyspark.ml.clustering as ml

    monkeypatch.setattr(ml, "PowerIterationClustering", None)
    found = {r["id"]: r["cluster"] for r in community.power_iteration_clusters(pairs, 3).collect()}
    assert found.keys() == got.keys() and set(found.values()) <= {0, 1, 2}
    assert community.power_iteration_clusters(pairs.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="negative"):
        power_blocks.power_iteration(spark.createDataFrame([(1, 2, -1.0)], pairs.schema), 3)
