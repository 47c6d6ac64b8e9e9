import random

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import components as components_module
from tessera.llm.components import components


def roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_chains_stars_and_odd_edges(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    edges += [(None, 1), (1, None), (5, 5), edges[0], edges[0][::-1]]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    assert {r.node: r.root for r in components(df).collect()} == roots(edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_that_differ_when_they_are_made_again(spark):
    """Each run of this plan picks another centre for the star; one set of edges must be used."""

    def star(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            centre = random.SystemRandom().choice(ids)
            others = [i for i in ids if i != centre]
            yield pa.RecordBatch.from_arrays([pa.array(others, pa.int64()), pa.array([centre] * len(others), pa.int64())], names=["a", "b"])

    for _ in range(3):
        edges = spark.range(0, 50, 1, 1).select(F.col("id")).mapInArrow(star, "a long, b long")
        assert {r.root for r in components(edges).collect()} == {0}


def test_rounds_go_on_with_fewer_edges(spark, monkeypatch):
    """Rows of many stars: what later rounds join is a small part of the edges, whatever the rounds."""
    edges = [(c, i) for i in range(100, 1000) for c in {i * k % 97 for k in (1, 2, 3, 5)}] + [(i, i + 1) for i in range(2000, 2200)]
    sizes, keep = [], components_module.stored

    def seen(df, name):
        found = keep(df, name)
        if name == "cc-edges":
            sizes.append(found.count())
        return found

    monkeypatch.setattr(components_module, "stored", seen)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    assert {r.node: r.root for r in components(df).collect()} == roots(edges)
    assert sizes[-1] == 0 and sum(sizes[1:]) < sizes[0] / 4
