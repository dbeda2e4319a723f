"""Networks learned in tasks: the sums of tasks against one place, whatever the partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions.metrics import accuracy
from quillgraph.operators import networks, sampling
from quillgraph.operators.graph import RelGraph
from quillgraph.plans.synth import planted_graph


@pytest.fixture(scope="module")
def graph(spark):
    g = planted_graph(spark, 200, classes=2, homophily=0.9, signal=0.8, mean_degree=6.0, seed=2)
    return RelGraph(g.nodes.cache(), g.edges.cache(), g.features.cache())


def egos(spark, n, width, parts):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(-(2**62), 2**62)), rng.normal(size=width).tolist(), rng.normal(size=width).tolist(), int(i % 3), 1.0 + i % 2, rng.normal(size=(i % 5, width)).tolist(), rng.normal(size=(i % 5, width)).tolist()) for i in range(n)]
    names = ["mark", "x", "m0", "class_idx", "w", "near_x", "near_m"]
    schema = "mark long, x array<double>, m0 array<double>, class_idx int, w double, near_x array<array<double>>, near_m array<array<double>>"
    return spark.createDataFrame(rows, schema).repartition(parts), dict(zip(names, (list(c) for c in zip(*rows, strict=True)), strict=True))


def plain(rows, weights, gradient, turns, rate):
    """All rows in one place, one step after the other."""
    adam, losses = networks.Adam(weights, rate), []
    for turn in range(turns):
        loss, g = gradient(weights, rows, turn)
        losses.append(loss / len(rows["mark"]))
        adam.step([x / len(rows["mark"]) for x in g])
    return weights, losses


@pytest.mark.parametrize("parts", [1, 7])
def test_tasks_learn_as_one_place(spark, parts):
    df, rows = egos(spark, 40, 6, parts)
    start = lambda: networks.means_weights(np.random.default_rng(3), 6, 8, 3)
    step = lambda now, part, turn: networks.means_rows_gradient(now, part, 5, turn, 2, 0.3)
    want, losses = plain(rows, start(), step, 4, 0.05)
    got, seen = networks.fit_in_tasks(df, start(), step, 4, 0.05)
    assert seen == pytest.approx(losses, rel=1e-9)
    for a, b in zip(got, want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9)


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    _, width = None, 4
    own, mean, near, near_mean = rng.normal(size=(5, width)), rng.normal(size=(5, width)), rng.normal(size=(7, width)), rng.normal(size=(7, width))
    of, y, w = np.array([0, 0, 1, 2, 2, 2, 4]), np.array([0, 1, 2, 0, 1]), np.array([1, 2, 1, 1, 0.5])
    net = networks.means_weights(rng, width, 6, 3)
    masks = [(rng.random(s) >= 0.3) / 0.7 for s in ((5, width), (5, width), (7, width), (7, width), (5, 6), (7, 6))]
    loss, g = networks.means_gradient(net, own, mean, near, near_mean, of, y, w, masks)
    for x, dx in zip(net, g, strict=True):
        for at in [tuple(rng.integers(0, s) for s in x.shape) for _ in range(4)]:
            x[at] += 1e-6
            moved = networks.means_gradient(net, own, mean, near, near_mean, of, y, w, masks)[0]
            x[at] -= 1e-6
            assert (moved - loss) / 1e-6 == pytest.approx(dx[at], abs=1e-4)


def test_batches_cover_every_row_once_an_epoch(spark):
    df, rows = egos(spark, 30, 3, 4)
    seen = []
    for b in range(3):
        part = df.where(F.pmod(F.xxhash64("mark", F.lit(2)), F.lit(3)) == b)
        seen += [r["mark"] for r in part.select("mark").collect()]
    assert sorted(seen) == sorted(rows["mark"])
    step = lambda now, part, turn: networks.softmax_rows_gradient(now, part, 1, turn, 0.0)
    _, losses = networks.fit_in_tasks(df, [np.zeros((3, 3)), np.zeros(3)], step, 3, 0.1, batches=3)
    assert len(losses) == 9 and np.mean(losses[-3:]) < np.mean(losses[:3])


def test_many_labelled_nodes(spark, graph, monkeypatch):
    monkeypatch.setattr(networks, "MOST_LABELLED", 20)
    split = sampling.stratified_split(graph.nodes, 0.5, 1)
    train, test = split.where("is_train"), split.where("not is_train")
    for f in (networks.simple_convolution, networks.sampled_means):
        out = f(graph, train, test, epochs=10)
        assert accuracy(out, []).first()[0] > 0.8, f.__name__
    with pytest.raises(ValueError, match="in one place"):
        networks.simple_convolution(graph, train, test, in_tasks=False)
    with pytest.raises(ValueError, match="a labelled node"):
        networks.simple_convolution(graph, train.limit(0), test)


def test_rows_become_arrays_once(spark):
    """A step works on arrays that are kept: the table is not read again."""
    df, rows = egos(spark, 40, 6, 5)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    step = lambda now, part, turn: networks.means_rows_gradient(now, part, 5, turn, 2, 0.3)
    start = lambda: networks.means_weights(np.random.default_rng(3), 6, 8, 3)
    want, _ = plain(rows, start(), step, 6, 0.05)
    got, losses = networks.fit_in_tasks(df.mapInArrow(counted, df.schema), start(), step, 6, 0.05)
    assert seen.value == 40 and len(losses) == 6
    for a, b in zip(got, want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9)


def test_lists_of_vectors_are_not_written(spark, graph, monkeypatch):
    """Spark's reader would hold thousands of rows of 40 vectors at once; what tasks learn from goes to blocks of a bounded size without a table between."""
    written, whole, blocks = [], networks.scratch.materialise, []
    monkeypatch.setattr(networks.scratch, "materialise", lambda df, name, *a: written.append([k for _, k in df.dtypes]) or whole(df, name, *a))
    limit = networks.scratch.small_batches
    monkeypatch.setattr(networks.scratch, "small_batches", lambda s, rows=1000: blocks.append(rows) or limit(s, rows))
    train = graph.nodes.where("node_id % 2 = 0")
    got = networks.sampled_means(graph, train, graph.nodes.where("node_id % 2 = 1"), epochs=1, in_tasks=True)
    assert got.count() > 0
    assert written and not any("array<array" in k for kinds in written for k in kinds)
    width = len(graph.features.first()["features"])
    assert all(rows * 41 * 2 * width <= networks.BLOCK_VALUES or rows == 1 for rows in blocks if rows != 1000)
