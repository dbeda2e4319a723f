"""Leading modularity eigenvectors on blocks of nodes: against dense ones."""

import random

import numpy as np

from quillgraph.operators import krylov
from quillgraph.operators.graph import adjacency, undirected


def dense(pairs, ids):
    at = {x: i for i, x in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for u, v in pairs:
        a[at[u], at[v]] = a[at[v], at[u]] = 1.0
    k = a.sum(axis=1) + np.diag(a)
    return a - np.outer(k, k) / k.sum()


def test_blocks_and_parts(spark, monkeypatch):
    """Two parts over four blocks, with self-loops, and a part without edges; what is sent grows with the arcs, not with the tasks."""
    monkeypatch.setattr(krylov, "FEW_NODES", 40)
    rng = random.Random(4)
    pairs = {(b + s + rng.randrange(50), b + s + rng.randrange(50)) for b in (0, 100) for s in (0, 50) for _ in range(300)} | {(b + i, b + 50 + i) for b in (0, 100) for i in range(9)}
    pairs = sorted({tuple(sorted(p)) for p in pairs})
    assert any(u == v for u, v in pairs)
    e = undirected(spark.createDataFrame(pairs, "src long, dst long")).cache()
    members = spark.createDataFrame([(1 + i // 100, i) for i in range(200)] + [(7, 500), (7, 501)], "part int, node_id long")
    got = {(r["part"], r["node_id"]): r["x"] for r in krylov.leading_vectors(members, adjacency(e)).collect()}
    assert len(got) == 202 and got[7, 500] == got[7, 501] == 0
    for part, ids in ((1, range(100)), (2, range(100, 200))):
        m = dense([p for p in pairs if p[0] in ids], list(ids))
        x = np.array([got[part, i] for i in ids])
        values, vectors = np.linalg.eigh(m)
        assert abs(x @ vectors[:, -1]) / np.linalg.norm(x) > 0.999
        assert np.linalg.norm(m @ x - values[-1] * x) <= 3e-3 * values[-1] * np.linalg.norm(x)


def test_ritz_from_moments():
    """A Krylov space of 12 dimensions from its moments alone: values as from the whole space."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 60))
    a, x, bound = a + a.T, rng.normal(size=60), 25.0
    t = [x, a @ x / bound]
    while len(t) < 25:
        t.append(2 * a @ t[-1] / bound - t[-2])
    moments = krylov.moments(np.array([[t[j] @ t[j], t[j] @ t[j - 1] if j else 0.0] for j in range(13)]))
    assert np.allclose(moments, [x @ y for y in t])
    mix, top, residual, far = krylov.ritz(moments, bound)
    space = np.linalg.qr(np.array(t[:12]).T)[0]
    values = np.linalg.eigvalsh(space.T @ a @ space)
    y = sum(c * z for c, z in zip(mix, t, strict=False))
    assert np.isclose(top, values[-1]) and np.isclose(far, max(abs(values[0]), values[-1])) and np.isclose(np.linalg.norm(y), 1)
    assert np.isclose(residual, np.linalg.norm(a @ y - top * y))
